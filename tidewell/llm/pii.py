"""Personal data in texts with DataFrame functions only.

Regular expressions propose spans, checks confirm them (Luhn for cards, mod-97 for bank accounts, digit
counts, mixed characters for secrets, neighbours that are not part of a longer number), and words near a
span raise or lower its score. Spans of the four base kinds that pass their own check stay whatever their
score; bank accounts, social security numbers and secrets (keys, tokens, passwords) must reach `threshold`,
so for each of these the words around it can decide.

Spans come from marking: a match is wrapped in two control characters (which the text itself then
no longer has), the text is split at them, and lengths are summed up to offsets, in code points.

Edge cases: a null or empty text has no spans; very long texts are matched whole, by patterns whose
work is linear in the text and whose recursion is bounded; rows are independent, so repeated rows,
ties and other columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import text_of

#: Starts only where no character of the run came before, or right after the last match, so that a
#: long run is read once; possessive where giving back could not help.
_LOCAL = r"[A-Za-z0-9._%+-]"


@dataclass(frozen=True)
class Kind:
    """needs: a pattern that a text with a span matches somewhere. near: words that raise the score by `lift`, far: words that lower it by FALL."""

    name: str
    pattern: str
    needs: str
    base: bool
    score: float
    near: str
    lift: float = 0.4
    far: str = "example|sample|fictitious|dummy"


FALL = 0.4
_SECRET = "token|secret|password|passwd|api.?key|private.?key|access.?key|bearer|credential"
KINDS = (
    Kind("email", rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True, 0.8, "mail|contact|write|reach", 0.2),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]\.[0-9]", True, 0.6, "ip|host|server|address|login", far="version|release|chapter|section"),
    Kind("card", r"(?:(?<![0-9])|\G)[0-9](?:[ -]?[0-9])++", "[0-9]", True, 0.7, "card|visa|credit|payment|pay", 0.3),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9]", True, 0.6, "phone|tel|call|mobile|fax"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}", "[A-Z]{2}[0-9]{2}", False, 0.7, "iban|account|bank|transfer", 0.3, "example|sample|serial|part|model|order"),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", "[0-9]-[0-9]{2}-[0-9]", False, 0.4, "ssn|social|security", far="example|sample|serial|part|model|order"),
    Kind("secret", r"(?:(?<![A-Za-z0-9_-])|\G)[A-Za-z0-9_-]{20,}+", f"(?i)(?:{_SECRET})", False, 0.4, _SECRET, far="example|sample|commit|digest|checksum|hash"),
)
BASE = tuple(k.name for k in KINDS if k.base)
OPEN, CLOSE, CHUNK = "\u0001", "\u0002", 256
#: Characters before and behind a span in which words count.
BEFORE, BEHIND = 40, 24
SPANS = "array<struct<kind:string,start:bigint,end:bigint,score:double>>"


def digits_of(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn test."""
    n = F.length(digits)

    def add(s: Column, i: Column) -> Column:
        d = F.ascii(F.substring(digits, i, F.lit(1))) - 48
        twice = d * 2 - F.when(d > 4, 9).otherwise(0)
        return s + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether a bank account number (letters, digits, blanks) leaves 1 when divided by 97, its first four moved to the end."""
    a = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(a, F.lit(5), F.length(a)), F.substring(a, 1, 4))

    def add(s: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, F.lit(1)))
        return F.when(c >= 65, s * 100 + c - 55).otherwise(s * 10 + c - 48) % 97

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


def _confirmed(kind: str, m: Column, before: Column, behind: Column) -> Column:
    """Whether a match is what its kind says. before, behind: the characters next to it."""
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+(?=.)", "")
        return F.forall(F.split(m, r"\."), lambda p: (F.length(part(p)) <= 3) & F.coalesce(part(p).try_cast("int") <= 255, F.lit(False)))
    d = digits_of(m)
    if kind == "card":
        return F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)
    if kind == "phone":
        return F.length(d).between(9, 15)
    if kind == "iban":
        return mod97(m) & ~before.rlike("[A-Za-z0-9]") & ~behind.rlike("[A-Za-z0-9]")
    if kind == "ssn":
        return ~before.rlike("[0-9-]") & ~behind.rlike("[0-9-]")
    if kind == "secret":
        return m.rlike("[0-9]") & m.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(m, ""))) >= 10)
    return F.lit(True)


def _running(lens: Column) -> Column:
    """Sums of all lengths before each place. In chunks, so that work grows as n * CHUNK, not n * n."""
    n = F.size(lens)
    add = lambda a, x: F.array_append(a, F.element_at(a, -1) + x)
    part = lambda c: F.slice(lens, c * CHUNK + 1, F.lit(CHUNK))
    chunks = F.sequence(F.lit(0), F.floor((n - 1) / CHUNK).cast("int"))
    zero = F.lit(0)
    sums = F.aggregate(F.transform(chunks, lambda c: F.aggregate(part(c), zero, lambda s, x: s + x)), F.array(zero), add)
    return F.flatten(F.transform(chunks, lambda c: F.slice(F.aggregate(part(c), F.array(F.element_at(sums, c + 1)), add), F.lit(1), F.size(part(c)))))


def _spans(kind: Kind, pieces: str, threshold: float) -> Column:
    """Spans from `pieces`, the column of a text marked and split for the kind."""
    p = F.col(pieces)
    starts = _running(F.transform(p, lambda x: F.length(x) - F.when(F.contains(x, F.lit(CLOSE)), 1).otherwise(0)))
    tail = lambda x: F.substring_index(x, CLOSE, -1)
    word = lambda words: rf"(?i)(?<![A-Za-z])(?:{words})"

    def candidate(x: Column, before: Column, start: Column) -> Column:
        m = F.substring_index(x, CLOSE, 1)
        around = F.concat(F.substring(tail(before), -BEFORE, BEFORE), F.lit(" "), F.substring(tail(x), 1, BEHIND))
        score = F.lit(kind.score) + F.when(around.rlike(word(kind.near)), kind.lift).otherwise(0.0) - F.when(around.rlike(word(kind.far)), FALL).otherwise(0.0)
        return F.struct(
            F.lit(kind.name).alias("kind"), start.cast("long").alias("start"), (start + F.length(m)).cast("long").alias("end"), F.round(score, 2).alias("score"), m.alias("m"),
            F.substring(F.translate(before, CLOSE, ""), -1, 1).alias("before"), F.substring(tail(x), 1, 1).alias("behind"),
        )

    z = F.arrays_zip(F.slice(p, F.lit(2), F.size(p) - 1).alias("x"), F.slice(p, F.lit(1), F.size(p) - 1).alias("b"), F.slice(starts, F.lit(2), F.size(p) - 1).alias("s"))
    found = F.transform(z, lambda r: candidate(r["x"], r["b"], r["s"]))
    kept = F.filter(found, lambda c: _confirmed(kind.name, c["m"], c["before"], c["behind"]) & (F.lit(kind.base) | (c["score"] >= threshold)))
    bare = F.transform(kept, lambda c: F.struct(c["kind"].alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["score"].alias("score")))
    return F.when(F.size(p) > 1, bare).otherwise(F.array().cast(SPANS))


def find_pii(docs: DataFrame, kinds: tuple[Kind, ...] = KINDS, threshold: float = 0.7, id_col: str = "doc_id") -> DataFrame:
    """id, spans array<struct<kind, start, end, score>> by kind as listed, then start; code points, end exclusive."""
    d = docs.select(F.col(id_col), F.translate(text_of(), OPEN + CLOSE, "\ufffd\ufffd").alias("_t"))
    for k in kinds:
        marked = F.split(F.regexp_replace("_t", k.pattern, f"{OPEN}$0{CLOSE}"), OPEN)
        may = F.contains(F.col("_t"), F.lit(k.needs)) if k.needs == "@" else F.col("_t").rlike(k.needs)
        d = d.withColumn(f"_p_{k.name}", F.when(may, marked).otherwise(F.array(F.lit(""))))
    return d.select(id_col, F.concat(*[_spans(k, f"_p_{k.name}", threshold) for k in kinds]).alias("spans"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every whole text of documents."""
    found = find_pii(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    of = lambda *names: F.filter("spans", lambda s: s["kind"].isin(*names))
    return found.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE],
        F.sha2(joined(of(*BASE)), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
        *[F.size(of(k.name)).cast("long").alias(f"n_{k.name}") for k in KINDS if not k.base],
    )


def _sql_kind(k: Kind) -> str:
    """A kind as a row of SQL; a greedy match takes whole runs, so what keeps the work linear in Java is left out."""
    plain = k.pattern.replace("++", "+").replace("}+", "}")
    plain = plain[plain.index(r"|\G)") + 4:] if r"|\G)" in plain else plain
    return f"('{k.name}', {KINDS.index(k)}, '{plain}', {str(k.base).lower()}, {k.score}, '(?i)(^|[^A-Za-z])({k.near})', {k.lift}, '(?i)(^|[^A-Za-z])({k.far})')"


ORACLE_SQL = rf"""
WITH kinds(kind, rank, pattern, base, score, near, lift, far) AS (VALUES {", ".join(map(_sql_kind, KINDS))}),
d AS (SELECT doc_id, translate(coalesce(text, ''), chr(1) || chr(2), chr(65533) || chr(65533)) AS t FROM documents),
p AS (SELECT doc_id, k.*, string_split(regexp_replace(t, pattern, chr(1) || '\0' || chr(2), 'g'), chr(1)) AS p FROM d, kinds k),
x AS (SELECT * EXCLUDE (p), p[n] AS b, p[n + 1] AS x, list_sum(list_transform(p[:n], lambda z: length(z) - CASE WHEN contains(z, chr(2)) THEN 1 ELSE 0 END))::BIGINT AS a FROM (SELECT *, unnest(range(1, len(p))) AS n FROM p)),
m AS (SELECT *, split_part(x, chr(2), 1) AS m, split_part(x, chr(2), 2) AS behind, CASE WHEN contains(b, chr(2)) THEN split_part(b, chr(2), 2) ELSE b END AS ahead, right(replace(b, chr(2), ''), 1) AS l FROM x),
c AS (SELECT *, regexp_replace(m, '[^0-9]', '', 'g') AS g, right(ahead, {BEFORE}) || ' ' || left(behind, {BEHIND}) AS around, replace(m, ' ', '') AS z FROM m),
s AS (SELECT *, a + length(m) AS e, round(score + CASE WHEN regexp_matches(around, near) THEN lift ELSE 0 END - CASE WHEN regexp_matches(around, far) THEN {FALL} ELSE 0 END, 2) AS points, CASE kind
  WHEN 'ip' THEN list_bool_and(list_transform(string_split(m, '.'), lambda q: length(ltrim(q, '0')) <= 3 AND coalesce(try_cast(ltrim(q, '0') AS INTEGER), 0) <= 255))
  WHEN 'card' THEN length(g) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length(g) + 1), lambda i: CASE WHEN (length(g) - i) % 2 = 1 THEN ascii(g[i]) * 2 - 96 - CASE WHEN ascii(g[i]) > 52 THEN 9 ELSE 0 END ELSE ascii(g[i]) - 48 END)) % 10 = 0
  WHEN 'phone' THEN length(g) BETWEEN 9 AND 15
  WHEN 'iban' THEN NOT regexp_matches(l, '[A-Za-z0-9]') AND NOT regexp_matches(left(behind, 1), '[A-Za-z0-9]')
    AND list_reduce(list_concat([0], list_transform(string_split(substr(z, 5) || left(z, 4), ''), lambda q: ascii(q))), lambda r, q: CASE WHEN q >= 65 THEN (r * 100 + q - 55) % 97 ELSE (r * 10 + q - 48) % 97 END) = 1
  WHEN 'ssn' THEN NOT regexp_matches(l, '[0-9-]') AND NOT regexp_matches(left(behind, 1), '[0-9-]')
  WHEN 'secret' THEN regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') AND len(list_distinct(string_split(m, ''))) >= 10
  ELSE true END AS fine FROM c),
f AS (SELECT doc_id, count(*) FILTER (WHERE kind = 'email') AS n_email, count(*) FILTER (WHERE kind = 'ip') AS n_ip, count(*) FILTER (WHERE kind = 'card') AS n_card, count(*) FILTER (WHERE kind = 'phone') AS n_phone,
  count(*) FILTER (WHERE kind = 'iban') AS n_iban, count(*) FILTER (WHERE kind = 'ssn') AS n_ssn, count(*) FILTER (WHERE kind = 'secret') AS n_secret,
  string_agg(kind || ':' || a || ':' || e, ',' ORDER BY rank, a) FILTER (WHERE base) AS base, string_agg(kind || ':' || a || ':' || e, ',' ORDER BY rank, a) AS spans
  FROM s WHERE fine AND (base OR points >= 0.7) GROUP BY doc_id)
SELECT doc_id, {", ".join(f"coalesce(n_{k.name}, 0) AS n_{k.name}" for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents LEFT JOIN f USING (doc_id)
"""
