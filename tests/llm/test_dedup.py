"""The dedup operators, decontamination and components against brute force."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import common, decontaminate, linededup, neardup, substrings, vectordedup
from tidewell.llm.hnsw import Graph

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string"


def united(ids, links):
    parent = {i: i for i in ids}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {i: root(i) for i in ids}


@pytest.mark.parametrize("few", [0, 10_000])
def test_components(spark, few):
    rng = random.Random(8)
    links = [(k, k + 1) for k in range(100, 130)] + [(500, k) for k in range(501, 560)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(150)] + [(7, 7)]
    ids = list(range(600))
    out = common.components(spark.createDataFrame([(i,) for i in ids], "id long"), spark.createDataFrame(links, "a long, b long"), few=few)
    assert {r.id: r.component for r in out.collect()} == united(ids, links)


def test_components_without_links(spark):
    none = spark.createDataFrame([], "a long, b long")
    assert [tuple(r) for r in common.components(spark.range(2), none).collect()] == [(0, 0), (1, 1)]
    assert common.components(spark.range(0), none).count() == 0


def sets(text, n):
    w = (text or "").encode().lower().split()
    return {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def brute_near(rows, n):
    s = defaultdict(list)
    for i, t in rows:
        s[i].append(sets(t, n))
    links = [(i, j) for i in s for j in s if i < j and any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in s[i] for y in s[j])]
    return united(list(s), links)


def words(rng, n):
    return [f"{rng.choice('abcdefgh')}{rng.randrange(400)}" for _ in range(n)]


def family(rng, n, size, change):
    base = words(rng, size)
    return [" ".join(rng.choice(words(rng, 1)) if rng.random() < change else w for w in base) for _ in range(n)]


@pytest.mark.parametrize("n", [4, 5])
def test_near_duplicates_equal_brute_force(spark, n):
    rng = random.Random(11)
    texts = family(rng, 60, 120, 0.02) + family(rng, 30, 40, 0.05) + family(rng, 20, 300, 0.005) + [" ".join(words(rng, 50)) for _ in range(40)]
    texts += ["", None, "one two", "One  TWO", "one\ttwo\n", "three words only", " x y z w v", "a b c d e", "A B C D E"] + [texts[0]] * 30
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    got = neardup.near_duplicates(df, words=n).collect()
    want = brute_near(rows, n)
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets(dict(rows)[r.doc_id], n)), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_near_duplicate_edge_cases(spark):
    t = " ".join(f"w{k}" for k in range(30))
    df = spark.createDataFrame([(None, t), (5, t), (5, t), (5, "other text here now"), (9, "other text here now"), (7, None)], DOCS).withColumns({"i": F.lit(1), "n": F.lit(2), "rep": F.lit(3)})
    got = sorted(tuple(r) for r in neardup.near_duplicates(df, words=4).fillna(-1).collect())
    assert got == [(-1, 27, 5, False), (5, 1, 5, True), (5, 27, 5, True), (5, 27, 5, True), (7, 0, 7, True), (9, 1, 5, False)]
    assert neardup.near_duplicates(df.limit(0)).count() == 0
    kept = neardup.keep_one(df, words=4)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [5, 5, 5, 7]


def test_near_duplicates_without_ids(spark):
    rng = random.Random(31)
    a, b, c = (" ".join(words(rng, 60)) for _ in range(3))
    rows = [(None, a + " x"), (5, a), (None, b + " y"), (9, b), (None, c), (None, c + " z"), (None, c), (None, ""), (None, None)]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or -1, r.component_id or -1, r.kept) for r in neardup.near_duplicates(df).collect())
    # null ids join nothing by themselves: a and b stay apart
    c_kept = sum(r[2] for r in got if r[:2] == (-1, -1)) - 2
    assert [r for r in got if r[1] > 0] == [(-1, 5, False), (-1, 9, False), (5, 5, True), (9, 9, True)] and c_kept in (1, 2)
    kept = [r.text for r in neardup.keep_one(df).collect()]
    assert a in kept and b in kept and "" in kept and None in kept and len({t for t in kept if t and t.startswith(c)}) == 1 and len(kept) == 4 + c_kept


def test_sketch_bounds():
    rng = random.Random(1)
    for _ in range(200):
        n = rng.choice([5, 60, 900])
        a = {rng.getrandbits(64) for _ in range(n)}
        b = {x for x in a if rng.random() < 0.93} | {rng.getrandbits(64) for _ in range(n // 20)}
        if not b or len(a & b) < 0.8 * len(a | b):
            continue
        x, y = (np.array(sorted(s), dtype=np.uint64) for s in (a, b))
        (kx, ox), (ky, oy) = (neardup.folded(neardup.minhash(s)) for s in (x, y))
        count = lambda u: int(np.unpackbits(u.view(np.uint8)).sum())
        assert (kx == ky).any() and count(ox ^ oy) <= neardup.sketch_bound(0.8)
        assert count(neardup.parity(x) ^ neardup.parity(y)) <= len(a ^ b)


def test_line_chunks_cover_and_resist_shifts():
    rng = random.Random(3)
    lines = [" ".join(words(rng, 5)) for _ in range(60)]
    text = "\n".join(lines)
    spans = linededup.chunks(text)
    assert spans[0][0] == 0 and spans[-1][1] == 60 and all(a[1] == b[0] for a, b in zip(spans, spans[1:]))
    assert all(b - a >= 2 for a, b in spans)
    moved = {c for _, c in linededup.multi_line("\n".join(["new line", *lines]))}
    assert len(moved & {c for _, c in linededup.multi_line(text)}) >= len(spans) - 3
    assert linededup.without(text, []) == text


def brute_lines(rows):
    order = sorted({(i, neardup.LAST if i is None else i, t) for i, t in rows if t}, key=lambda x: x[1])
    first, out = {}, {}
    for i, _, t in order:
        out[i, t] = [k for k, c in linededup.multi_line(t) if first.setdefault(c, (i, t, k)) != (i, t, k)]
    return out


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(6)
    blocks = ["\n".join(" ".join(words(rng, 4)) for _ in range(rng.randint(3, 9))) for _ in range(12)]
    texts = ["\n".join(rng.choice(blocks) if rng.random() < 0.6 else " ".join(words(rng, 6)) for _ in range(rng.randint(1, 6))) for _ in range(80)]
    rows = list(enumerate(texts + [texts[0], "", None, "one line", "\n\n\n", "a\nb", "a\nb"]))
    df = spark.createDataFrame(rows, DOCS).repartition(4).withColumns({"i": F.lit(0), "k": F.lit(""), "at": F.lit(1)})
    out = linededup.line_dedup(df)
    assert out.columns == [*df.columns, "_removed"]
    want = brute_lines(rows)
    for r in out.collect():
        t = dict(rows)[r.doc_id]
        gone = want.get((r.doc_id, t), [])
        assert sorted(r._removed) == gone and r.text == (linededup.without(t, gone) if gone else t)


def without_runs(rows):
    """Every run from one line that is not blank to another, held against all earlier ones; no chunks."""
    seen, out = set(), {}
    for i, t in sorted(rows):
        lines = t.split("\n")
        full, gone = [k for k, x in enumerate(lines) if x.strip()], set()
        for a in full:
            for b in full:
                if a < b:
                    run = "\n".join(lines[a:b + 1])
                    gone.update(k for k in range(a, b + 1) if run in seen)
        seen.update("\n".join(lines[a:b + 1]) for a in full for b in full if a < b)
        out[i] = [x for k, x in enumerate(lines) if k not in gone and x.strip()]
    return out


def test_line_dedup_takes_every_repeated_run_of_lines(spark):
    rng = random.Random(14)
    line = lambda: " ".join(words(rng, 6))
    runs = ["\n".join(line() + rng.choice(["", "", "\n"]) for _ in range(rng.randint(2, 5))) for _ in range(20)]
    rows = [(k, "\n".join([line(), runs[k % 20], line(), *([line(), runs[(k * 7 + 3) % 20]] if k % 3 else [])])) for k in range(90) if (k * 7 + 3) % 20 != k % 20]
    want = without_runs(rows)
    got = {r.doc_id: [x for x in r.text.split("\n") if x.strip()] for r in linededup.line_dedup(spark.createDataFrame(rows, DOCS).repartition(3)).collect()}
    assert got == want and all(len(want[k]) == 2 + bool(k % 3) for k in want if k >= 40)


def test_line_dedup_pairs_and_blank_lines(spark):
    rows = [(1, "a\na\na"), (2, "b\nc"), (3, "x\nb\n\nc\ny"), (4, "z\nb\nc\n\nu"), (5, "d\n\n"), (6, "v\na\na\nw\na\na")]
    got = {r.doc_id: r.text for r in linededup.line_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: "a\na\na", 2: "b\nc", 3: "x\nb\n\nc\ny", 4: "z\n\nu", 5: "d\n\n", 6: "v\nw"}


def test_line_dedup_edge_cases(spark):
    t = "first line\nsecond line\nthird line"
    df = spark.createDataFrame([(None, t), (4, t), (4, t), (4, "x")], DOCS)
    got = sorted((r.doc_id is None, r.text) for r in linededup.line_dedup(df).collect())
    assert got == [(False, t), (False, t), (False, "x"), (True, "")]
    assert linededup.line_dedup(df.limit(0)).count() == 0


def test_substrings(spark):
    rng = random.Random(9)
    sentence = lambda n: " ".join(words(rng, n)).capitalize() + "."
    passage = " ".join(sentence(9) for _ in range(8))
    short = sentence(6)
    texts = [f"{sentence(12)} {passage} {sentence(10)}", f"{sentence(7)}\n{sentence(8)} {passage.upper()} {short}", short + " " + sentence(9), f"{passage} {sentence(5)} {passage}", "", None, "no words: ...\n\n"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumns({"i": F.lit(1), "d1": F.lit(2), "gone": F.lit(3), "_spans": F.lit(4), "row": F.lit(5)})
    found = substrings.substring_dedup(df, short=3)
    assert found.columns == ["doc_id", "text", "i", "d1", "gone", "row", "_spans"]
    out = {r.doc_id: r for r in found.collect()}
    assert out[0]._spans == [] and out[4].text == "" and out[5].text is None and out[6].text == texts[6]
    (s,) = out[1]._spans
    assert texts[1][s.start:s.end] == passage.upper() + " " and passage.upper() not in out[1].text
    assert [texts[2][s.start:s.end] for s in out[2]._spans] == [short + " "]
    assert [texts[3][s.start:s.end].strip() for s in out[3]._spans] == [passage, passage]
    assert substrings.substring_dedup(df.limit(0), short=3).count() == 0
    twice = df.where("doc_id = 1").unionByName(df.where("doc_id = 1"))
    assert all(r._spans == [] for r in substrings.substring_dedup(twice, short=3).collect())


def test_substrings_leave_what_is_not_repeated(spark):
    a, b = "The first sentence that repeats itself.", "And a second one of this kind."
    rows = [(1, f"{a} {b}"), (2, f"{a} Ada won. {b}"), (3, f"{a}\nAda won.\n{b}"), (4, f"{a} Ada won"), (5, "Ada won."), (6, "Ada won.")]
    got = {r.doc_id: r.text for r in substrings.substring_dedup(spark.createDataFrame(rows, DOCS), short=3).collect()}
    assert got == {1: f"{a} {b}", 2: f"Ada won. {b}", 3: "Ada won.\n", 4: "Ada won", 5: "Ada won.", 6: "Ada won."}


@pytest.mark.parametrize("short", [3, 8])
def test_substrings_equal_brute_force(spark, short):
    rng = random.Random(21)
    pool = [" ".join(words(rng, rng.choice([2, 3, 5, 40]))) + rng.choice([". ", "! ", "\n", "?\n", " "]) for _ in range(40)]
    texts = ["".join(rng.choice(pool) if rng.random() < 0.5 else " ".join(words(rng, 6)) + rng.choice([". ", "\n"]) for _ in range(rng.randint(0, 9))) for _ in range(60)]
    texts.append("".join(rng.choice(pool) for _ in range(3000)))
    rows = [(k % 45 if k % 5 else None, t) for k, t in enumerate(texts)]
    rows += rows[:9] + [(None, None), (3, None), (None, texts[1])]
    df = spark.createDataFrame(rows, DOCS).repartition(5)
    hashes = {r.text: r.h for r in df.select("text", F.xxhash64("text").alias("h")).collect()}
    order = sorted(set(rows), key=lambda r: (neardup.LAST if r[0] is None else r[0], hashes[r[1]]))
    firsts, want = {}, {}
    for i, t in order:
        for a, b, w in substrings.places(t or "", short):
            key = " ".join(w)
            if firsts.setdefault(key, (i, t, a)) != (i, t, a):
                want.setdefault((i, t), set()).update(range(a, b))
        for a, b, w in substrings.places(t or "", short):  # a place is the earliest by offset, not by the order in which units are listed
            assert firsts[" ".join(w)][:2] != (i, t) or firsts[" ".join(w)][2] <= a
    out = substrings.substring_dedup(df.withColumn("was", F.col("text")), short=short).collect()
    assert len(out) == len(rows)
    for r in out:
        gone = {c for s in r._spans for c in range(s.start, s.end)}
        assert gone == want.get((r.doc_id, r.was), set())
        assert r.text == (r.was and "".join(c for k, c in enumerate(r.was) if k not in gone))
    assert sum(r.doc_id is None and bool(r._spans) for r in out) > 1


def test_op6_takes_every_repeated_line(spark, tmp_path):
    rng = random.Random(15)
    line = lambda: rng.choice(["", "Yes. ", "Oh no! "]) + " ".join(words(rng, rng.choice([3, 9, 40]))).capitalize() + rng.choice(["", ". Ok", ". So it goes. End."])
    common = [line() for _ in range(15)]
    rows = [(k, "\n".join(x for j in range(4) for x in (line(), common[(k + j * (k % 4 + 1)) % 15]))) for k in range(50)]
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    seen, want = set(), {}
    for i, t in rows:
        want[i] = []
        for x in t.split("\n"):
            key = substrings.WORD.findall(x.lower())
            if len(key) < substrings.SHORT or tuple(key) not in seen:
                want[i].append(x)
            seen.add(tuple(key))
    got = {r.doc_id: r.kept_text for r in substrings.op6_substring_dedup(spark, str(tmp_path)).collect()}
    for i, t in rows:
        kept = [x for x in got[i].split("\n") if x.strip()]
        assert not [x for x in kept if x in common and x not in want[i]]
        # a sentence that repeats goes from a line that stays; nothing else does
        assert all(any(set(x.split()) <= set(y.split()) for y in want[i]) for x in kept)


def test_units_cover_all_words():
    text = "One two. Three, four!\nfive " + " ".join(f"w{k}" for k in range(200)) + "?! End of it\n\n.  "
    found = list(substrings.units(text, 3))
    assert [w for _, _, ws in found for w in ws] == substrings.WORD.findall(text.lower())
    assert all(a < b <= c for (a, b, _), (c, _, _) in zip(found, found[1:])) and max(len(w) for _, _, w in found) < 200
    assert [text[a:b] for a, b, _ in found[:2]] == ["One two. Three, four!", found[1] and text[found[1][0]:found[1][1]]]


def lev(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        before, row[0] = row[0], i
        for j, c in enumerate(t, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (a != c))
    return min(row)


def test_myers_equals_plain_distance():
    rng = random.Random(1)
    for _ in range(200):
        p, t = ("".join(rng.choice("abc") for _ in range(rng.randint(a, b))) for a, b in ((1, 90), (0, 130)))
        assert decontaminate.myers(p, t)[0] == lev(p, t)


def occurs(item, text):
    """The plain rule: as many edits as a twelfth of the item's characters, borders of words included."""
    item, text = decontaminate.reduced(item), decontaminate.reduced(text)
    return bool(item and text) and lev(f" {item} ", f" {text} ") <= len(item) // 12


def test_decontamination(spark):
    rng = random.Random(12)
    items = [" ".join(words(rng, 30)) for _ in range(6)] + ["tiny", "", None, "The quick brown fox", "tiny"]
    benchmark = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("doc_id", F.lit(1))
    noise = lambda: " ".join(words(rng, 40))
    red = decontaminate.reduced(items[2])
    edited = list(red)
    for k in rng.sample(range(len(edited)), decontaminate.budget(f" {red} ")):
        edited[k] = "z"
    too_many = "".join("z" if k % 3 == 0 else c for k, c in enumerate(red))
    texts = [noise(), f"{noise()} {items[0]} {noise()}", f"{noise()}, {items[1].upper().replace(' ', ' - ')}! {noise()}", f"{noise()} {''.join(edited)} {noise()}", f"{noise()} {too_many}", "Tiny!", "tiny thing", "destiny", "", None, items[3] + " " + items[4]]
    texts += [f"{noise()} the quick brown fox {noise()}", f"{noise()} the quick brwn fox {noise()}", f"{noise()} the quirk brwn fox {noise()}", " ".join([noise()] * 300) + f" {items[5]}"]
    df = spark.createDataFrame(list(enumerate(texts)), DOCS).withColumn("items", F.lit("clash"))
    want = {i: [k for k, t in enumerate(items) if occurs(t, x if len(x or "") < 9999 else x[-999:])] for i, x in enumerate(texts)}
    assert [want[k] for k in range(1, 15)] == [[0], [1], [2], [], [6, 10], [6, 10], [], [], [], [3, 4], [9], [9], [], [5]]
    for chars in (4_000_000, 200):
        got = {r.doc_id: [x.item_id for x in r["items"]] for r in decontaminate.match_benchmark(df, benchmark, block_chars=chars).collect()}
        assert got == want
        kept = decontaminate.drop_contaminated(df, benchmark, block_chars=chars)
        assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {i for i, x in want.items() if not x}
    few = decontaminate.match_benchmark(df, benchmark, least_chars=10)
    assert {r.doc_id: [x.item_id for x in r["items"]] for r in few.collect()} == {i: [k for k in x if k not in (6, 10)] for i, x in want.items()}
    assert decontaminate.match_benchmark(df, benchmark.limit(0)).where(F.size("items") > 0).count() == 0
    assert decontaminate.match_benchmark(df.limit(0), benchmark).count() == 0
    assert decontaminate.match_benchmark(df.unionByName(df), benchmark, block_chars=200).count() == 2 * len(texts)


@pytest.mark.parametrize("chars", [4_000_000, 40])
def test_decontamination_keeps_rows_of_one_id_apart(spark, chars):
    benchmark = spark.createDataFrame([(1, "a first item of the benchmark"), (2, "some second item of the same")], "item_id long, text string")
    rows = [(1, "here a first item of the benchmark stands"), (1, "and some second item of the same here"), (1, "neither"), (None, "neither"), (None, "a first item of the benchmark")]
    df = spark.createDataFrame(rows, DOCS)
    got = sorted((r.doc_id or 0, [x.item_id for x in r["items"]]) for r in decontaminate.match_benchmark(df, benchmark, block_chars=chars).collect())
    assert got == [(0, []), (0, [1]), (1, []), (1, [1]), (1, [2])]
    assert decontaminate.drop_contaminated(df, benchmark, block_chars=chars).count() == 2


def clusters(rng, n):
    centres = rng.standard_normal((12, 16))
    return np.concatenate([centres[rng.integers(12, size=n)] + rng.standard_normal((n, 16)) * 0.25, rng.standard_normal((n, 16))]).astype(np.float32)


def unit(x):
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def test_graph_recall():
    x = unit(clusters(np.random.default_rng(5), 1500))
    g = Graph.build(x[:2500])
    ef, slack, recall = g.audited(0.9, 0.99, x[2500:])
    row, node = g.within(x[:700], 0.9, ef, slack)
    true = x[:700] @ x[:2500].T >= 0.9
    assert recall >= 0.99 and len(row) >= 0.99 * true.sum() and true[row, node].all()


def test_audit_sees_a_bad_graph_without_links_in_the_data():
    rng = np.random.default_rng(6)
    x = unit(rng.standard_normal((3000, 48))).astype(np.float32)
    g = Graph.build(x)
    none = np.zeros((0, 48))
    good = g.audited(0.9, 0.99, none)
    # without most links a narrow beam finds itself, as it starts anywhere, but not the nodes near a query
    g.links = [np.where(rng.random(l.shape) < 0.85, -1, l).astype(np.int32) for l in g.links]
    bad = g.audited(0.9, 0.99, none)
    assert good[2] >= 0.99 and bad[0] > good[0]
    _, _, recall = Graph(x[:5], np.zeros(5, dtype=np.int64), [np.full((5, 4), -1, dtype=np.int32)]).audited(0.9, 0.99, none)
    assert recall < 0.99  # nothing can be found, and the audit says so


def test_few_links_between_shards_are_found(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((3000, 40))
    for k in range(100):  # pairs of cosine 0.91 to 0.99, spread over all shards
        noise = rng.standard_normal(40)
        noise -= noise @ x[k] / (x[k] @ x[k]) * x[k]
        x[2900 + k] = x[k] + noise / np.linalg.norm(noise) * np.linalg.norm(x[k]) * np.tan(np.arccos(0.91 + 0.0008 * k))
    rows = [(k, v.tolist()) for k, v in enumerate(x)]
    got = {r.vec_id: r for r in vectordedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4), shard=400).collect()}
    v = unit(x)
    close = v @ v.T >= 0.9
    links = [(a, b) for a, b in zip(*np.nonzero(close)) if a < b]
    assert len(links) >= 100
    found = sum(got[a].n_links > 0 and got[b].n_links > 0 and got[a].component_id == got[b].component_id for a, b in links)
    assert found >= 0.97 * len(links)
    assert sum(r.n_links for r in got.values()) % 2 == 0  # both ends of a link count it
    assert all(r.n_links <= close[k].sum() - 1 for k, r in got.items())


def test_vectors_without_ids_and_ids_with_several_vectors(spark):
    e = lambda *at: [1.0 if k in at else 0.0 for k in range(8)]
    rows = [(None, e(0)), (None, e(1)), (5, e(0)), (6, e(1)), (7, e(2)), (7, e(3)), (8, e(3)), (9, e(2)), (None, e(4)), (None, e(5)), (None, e(4))]
    got = sorted(tuple(-1 if x is None else x for x in r) for r in vectordedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == sorted([(-1, 1, 5, False), (-1, 1, 6, False), (5, 1, 5, True), (6, 1, 6, True), (7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 1, 7, False), (-1, 1, -1, True), (-1, 1, -1, True), (-1, 0, -1, True)])


def test_vectors_equal_brute_force(spark):
    x = clusters(np.random.default_rng(6), 250)
    rows = [(10 + k, v.tolist()) for k, v in enumerate(x)] + [(1000 + k, x[3].tolist()) for k in range(40)] + [(2000, (x[3] * 1e-30).tolist()), (2001, (x[5] * 7).tolist())]
    rows += [(3000, None), (3001, []), (3002, [0.0] * 16), (3003, [float("nan")] + [1.0] * 15), (3004, [None] + [1.0] * 15), (3005, [float("inf")] * 16), (3006, [1.0, 2.0]), (3007, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"c": F.lit(1), "label": F.lit(2), "i": F.lit(3)})
    got = {r.vec_id: r for r in vectordedup.near_vectors(df.repartition(3)).collect()}
    v = np.array([r[1] for r in rows[:-8]], dtype=np.float32).astype(float)
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    close = v @ v.T >= 0.9
    ids = [r[0] for r in rows[:-8]]
    want = united(ids, [(ids[a], ids[b]) for a, b in zip(*np.nonzero(close)) if a < b])
    found = sum(got[i].n_links for i in ids)
    assert found >= 0.98 * (close.sum() - len(ids)) and all(got[i].n_links <= close[k].sum() - 1 for k, i in enumerate(ids))
    assert sum(got[i].component_id != want[i] for i in ids) <= 2
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(3000, 3006))
    assert (got[3006].n_links, got[3007].component_id, got[3007].kept) == (1, 3006, False)
    assert vectordedup.near_vectors(df.limit(0)).count() == 0
