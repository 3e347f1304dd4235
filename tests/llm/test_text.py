"""Chat formatting, personal data, URLs: against plain Python."""

import hashlib
import math
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from tidewell.llm import chat, pii, urls
from tidewell.llm.chat import Template, format_chat, parse_chat
from tidewell.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
TURN = "conv_id long, turn long, role string, text string"


def test_control_strings_come_back(spark):
    rng = random.Random(2)
    bits = ["[INST]", "[/INST]", "</s>", "<s>", "\\", "[", "<", "[SYS]", "[/ROLE]", "[TEXT]", "a", "\n", "é😀", "$1", ""]
    rows = [(c, t, rng.choice(["user", "assistant", "system", "tool[TEXT]", "", None]), "".join(rng.choice(bits) for _ in range(rng.randint(0, 12)))) for c in range(60) for t in range(rng.randint(1, 6))]
    t = Template()
    out = format_chat(spark.createDataFrame(rows, TURN), t).withColumn("back", parse_chat(F.col("formatted"), t)).collect()
    for r in out:
        want = [(x[2] or "", x[3]) for x in sorted((x for x in rows if x[0] == r.conv_id), key=lambda x: x[1])]
        assert [(b.role, b.text) for b in r.back] == want
        assert "".join(s.text for s in r.segments) == r.formatted
        assert sum(s.loss for s in r.segments) == sum(role == "assistant" for role, _ in want)


@pytest.mark.parametrize("roles,state,accepted", [
    ("ua", "answered", 2), ("sua", "answered", 3), ("uaua", "answered", 4), ("u", "asked", 1), ("s", "told", 1), ("au", "invalid", 0),
    ("uu", "invalid", 1), ("uas", "invalid", 2), ("sau", "invalid", 1), ("x", "invalid", 0), ("uuaa", "invalid", 1),
])
def test_turn_order(spark, roles, state, accepted):
    names = {"u": "user", "a": "assistant", "s": "system", "x": "tool"}
    r = format_chat(spark.createDataFrame([(1, k, names[c], "t") for k, c in enumerate(roles)], TURN)).first()
    assert (r.state, r.valid, r.n_accepted) == (state, state == "answered", accepted)


def test_chat_edge_cases(spark):
    rows = [(None, 1, "user", None), (None, 1, "user", None), (2, 1, "user", "b"), (2, 1, "user", "a"), (2, None, "system", "n"), (2, 1, "user", "a"), (3, 1, None, "")]
    df = spark.createDataFrame(rows, TURN).withColumn("formatted", F.lit(1)).withColumn("segments", F.lit(2))
    out = {r.conv_id: r.formatted for r in format_chat(df).collect()}
    assert out == {None: "[INST][/INST]", 2: "[SYS]n[/SYS][INST]a[/INST][INST]a[/INST][INST]b[/INST]", 3: "[ROLE][TEXT][/ROLE]"}
    assert format_chat(df).count() == 4 and format_chat(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        Template(other=("ROLE", "[T]", "[E]"))


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, name):
    c = duckdb.connect()
    for t in ("conversations", "documents", "embeddings", "pages"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got, want = queries()[name](spark, SF), c.sql(oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(map(repr, (tuple(r[c] for c in want.columns) for r in got.collect()))) == sorted(map(repr, want.fetchall()))


def test_chat_query(spark):
    r = chat.op1_chat_format(spark, SF).where("conv_id = -1").first()
    assert r.n_turns == 2 and r.loss_chars == len(chat.CONTROL) and r.loss_sha256 == hashlib.sha256(chat.CONTROL.encode()).hexdigest()


BASE = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, s):
    d = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(reversed(d))) % 10 == 0
    return kind == "email" or 9 <= len(d) <= 15


def base_spans(text):
    return [(k, m.start(), m.end()) for k, p in BASE.items() for m in re.finditer(p, text) if passes(k, m[0])]


def test_base_spans_equal_plain_regexes(spark):
    rng = random.Random(4)
    bits = ["a@b.c", "x.y@d-e.com_", "@", ".", "1.2.3.4", "256.1.1.1", "007.8.9.10.", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", " ", "-", "é", "😀", "\n", "a", "\x01", "\x02", "0" * 5]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 14))) for _ in range(400)]
    texts += ["9" * 5000, "a" * 5000 + "@", "1-" * 3000, "+1" + "2" * 4000, "1." * 4000, "a@b" * 1000 + ".c", "x@y.zz " * 700, None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.find_pii(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.spans if s.kind in pii.BASE] == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]


def test_checksums_and_context(spark):
    key = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
    texts = {
        1: "IBAN DE89 3704 0044 0532 0130 00 here", 2: "DE89 3704 0044 0532 0130 01", 3: "my SSN is 078-05-1120", 4: "part 078-05-1120 of it", 5: "", 6: "mail me: a@b.de",
        7: "serial DE89370400440532013000", 8: "DE89370400440532013000", 9: "ssn 1078-05-1120, ssn 078-05-11201, social 078-05-1120-1", 10: f'token = "{key}"', 11: f"the commit {key} and no more",
        12: f"a hash of the token: {key}", 13: "token aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", 14: "secret thisisonlyaverylongwordoflowercase", 15: "sample mail a@b.de", 16: f"x {key}", 17: "token abc1", 18: f"password:{'é' * 60}{key}",
    }
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("spans", F.lit("x")).withColumn("_t", F.lit(1))
    got = {r.doc_id: [(s.kind, texts[r.doc_id][s.start:s.end], round(s.score, 2)) for s in r.spans] for r in pii.find_pii(df).collect()}
    assert got[1] == [("iban", "DE89 3704 0044 0532 0130 00", 1.0)] and got[2] == [] and got[5] == []
    assert got[3] == [("ssn", "078-05-1120", 0.8)] and got[4] == [] and got[6] == [("email", "a@b.de", 1.0)]
    # words lower what would pass alone, and raise what would not
    assert got[7] == [] and got[8] == [("iban", "DE89370400440532013000", 0.7)] and got[9] == []
    assert got[10] == [("secret", key, 0.8)] and [got[k] for k in (11, 12, 13, 14, 16, 17, 18)] == [[]] * 7
    assert got[15] == [("email", "a@b.de", 0.6)]  # a base kind stays
    assert pii.find_pii(df.limit(0)).count() == 0
    assert pii.find_pii(df.where("doc_id = 6").union(df.where("doc_id = 6"))).count() == 2


def judged(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.key), default=None)
    return host, path, best and best.key, best and best.verdict


URLS = [
    "http://a.example.org/en/1", "http://EXAMPLE.org/es/x?y", "https://org/", "http://org", "http://x.com/de/a#b", "http://com/fr/", "http://xcom/fr/",
    "http://badorg.net/", "no scheme", "", None, "://", "http://", "http://a.b.c.d.e.f.g.h.com/de/", "ftp://bad.host/x", "http://sub.bad.host", "http://a..org/", "http://.org/z", "http://x.com/fr", "http://é.org/ü", "a://b://c.org/",
]


@pytest.mark.parametrize("bits", [1 << 28, 8])
def test_urls(spark, bits):
    df = spark.createDataFrame(list(enumerate(URLS)) + [(0, URLS[0])], "page_id long, url string").withColumn("host", F.lit("z"))
    listed = spark.createDataFrame([("bad.host",), (None,), ("never.seen",), ("b.c.d.e.f.g.h.com",)], "host string")
    out = urls.judge(df, listed, block_bits=bits).collect()
    assert len(out) == len(URLS) + 1
    for r in out:
        host, path, rule, verdict = judged(URLS[r.page_id])
        on = any(host == h or host.endswith("." + h) for h in ("bad.host", "b.c.d.e.f.g.h.com"))
        assert (r.host, r.path, r.rule, r.listed) == (host, path, rule, on), URLS[r.page_id]
        assert r.verdict == (verdict or ("block" if on else "allow"))
    assert urls.judge(df.limit(0), listed.limit(0)).count() == 0


@pytest.mark.parametrize("labels", [40, 120])
def test_hosts_of_many_labels(spark, labels):
    far = "x." + ".".join(f"l{k}" for k in range(labels)) + ".net"
    found = [f"http://{far}/x", f"http://www.{far}/", f"http://{far[2:]}/", f"http://{'a.' * labels}example.org/es/", "http://ok.net/"]
    df = spark.createDataFrame(list(enumerate(found)), "page_id long, url string")
    listed = spark.createDataFrame([(far,), ("example.org",)], "host string")
    got = {r.page_id: (r.verdict, r.listed) for r in urls.judge(df, listed, rules=()).collect()}
    assert got == {0: ("block", True), 1: ("block", True), 2: ("allow", False), 3: ("block", True), 4: ("allow", False)}


def test_blocklist_reaches_subdomains(spark, tmp_path):
    found = ["http://free-bets.example.net/en/1", "http://m.spam-farm1999.example.org/x", "http://spam-farm2000.example.net/", "http://xfree-bets.example.net/", "http://free-bets.example.org/en/2", "http://adult-x.example.com/fr/1"]
    spark.createDataFrame(list(enumerate(found)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: (r.verdict, r.listed) for r in urls.op8_url_filter(spark, str(tmp_path)).collect()}
    assert got == {0: ("block", True), 1: ("allow", True), 2: ("allow", False), 3: ("allow", False), 4: ("allow", True), 5: ("allow", True)}


@pytest.mark.parametrize("n,listed,bits", [(1_000_000, 1, urls.BLOCK_BITS), (300_000, 30_000, 1 << 16), (50_000, 40_000, 1 << 15)])
def test_levels_of_a_block_are_bounded(spark, n, listed, bits):
    keys = spark.range(n).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") < listed).alias("listed"))
    blocks = 0
    for c in urls.build(keys, bits):
        total, blocks = sum(x.bits for x in c.levels), c.blocks
        assert total <= bits and total <= 1.25 * urls.planned_bits(listed, n - listed) + urls.LEAST_BITS * len(c.levels)
        if c.block == 2:
            break
    assert blocks == max(1, math.ceil(1.25 * urls.planned_bits(listed, n - listed) / bits))


def test_cascade_is_exact(spark):
    keys = spark.range(20_000).select(F.concat(F.lit("k"), "id").alias("key"), (F.col("id") % 7 == 0).alias("listed"))
    levels = list(urls.build(keys))
    assert len(levels[0].levels) > 2
    got = keys.select("listed", urls._listed(levels, spark, F.array("key"))[0].alias("found"))
    assert got.where("listed <> found").count() == 0
