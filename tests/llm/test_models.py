"""Quality classifier and SentencePiece operator; the pipeline."""

import math
import random
import zlib

import pytest
import sentencepiece
from pyspark.sql import functions as F

from tidewell.llm import pieces, quality
from tidewell.llm.queries import queries

SF, SF2 = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def ours():
    return pieces.Pieces(open(pieces.DEFAULT_MODEL, "rb").read())


@pytest.fixture(scope="module")
def theirs():
    return sentencepiece.SentencePieceProcessor(model_file=pieces.DEFAULT_MODEL)


def test_ids_equal_the_library(ours, theirs):
    rng = random.Random(5)
    bits = ["a", "b", "The ", "ing", "  ", "\n", "\t", "é", "ß", "中文", "🙂", "12345", "<s>", "</s>", "<0x0A>", "▁", ".", ",", "'", "-", "====", "aaaa", "tion", "\x00", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(0, 40))) for _ in range(2000)] + ["", " ", "  ", "a" * 3000, "x " * 2000, " " * 500, open(pieces.__file__).read()]
    assert ours.encode(texts).to_pylist() == theirs.encode(texts)
    assert [ours.decode(x) for x in ours.encode(texts).to_pylist()] == [t.replace("▁", " ") for t in texts]


def test_corpus_equals_the_library(spark, theirs):
    rows = spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in rows.collect()}
    got = {r.doc_id: r for r in pieces.encode(rows, check=True).collect()}
    assert all(r.same for r in got.values())
    assert [got[i].ids for i in sorted(texts)] == theirs.encode([texts[i] for i in sorted(texts)])


def test_unigram_viterbi():
    from sentencepiece import sentencepiece_model_pb2 as pb

    m = pb.ModelProto()
    m.trainer_spec.model_type = 1
    m.normalizer_spec.name, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.add_dummy_prefix = "identity", False, True
    scores = {"▁": -3.0, "a": -2.0, "b": -2.5, "ab": -3.0, "▁a": -2.5, "ba": -2.0, "aba": -5.5, "▁ab": -9.0}
    m.pieces.add(piece="<unk>", score=0, type=2)
    for p, s in scores.items():
        m.pieces.add(piece=p, score=s, type=1)
    ours = pieces.Pieces(m.SerializeToString())

    def brute(word):
        if not word:
            return 0.0, []
        options = [(s + brute(word[len(p):])[0], [p] + brute(word[len(p):])[1]) for p, s in scores.items() if word.startswith(p)]
        return max(options, default=(-1e9, []))

    for word in ["a", "ab", "aba", "abab", "bbaab", "ababab"]:
        got = [ours.name[i] for i in ours.encode([word]).to_pylist()[0]]
        assert sum(scores[p] for p in got) == pytest.approx(brute("▁" + word)[0])
    assert ours.encode(["aqb"]).to_pylist()[0].count(0) == 1


def best_split(score, word, worst):
    """The best sum over all ways to cut a word, tried one by one."""
    best = (-1e300, ())
    for mask in range(1 << max(0, len(word) - 1)):
        cuts = [0, *(k + 1 for k in range(len(word) - 1) if mask >> k & 1), len(word)]
        parts = [word[a:b] for a, b in zip(cuts, cuts[1:])]
        if all(p in score or len(p) == 1 for p in parts):
            best = max(best, (sum(score.get(p, worst) for p in parts), tuple(parts)))
    return best


def test_best_paths_of_the_public_model_equal_brute_force(ours):
    by_score = pieces.Pieces(open(pieces.DEFAULT_MODEL, "rb").read(), by_score=True)
    rng = random.Random(17)
    texts = ["".join(rng.choice(["th", "e", "an", "ing", "q", "tion", "x", "é", "中", "aa", "1"]) for _ in range(rng.randint(1, 5)))[:10] for _ in range(150)]
    worst = min(ours.given.values()) - 10
    ids, best = by_score.scored(texts)
    _, beside = ours.scored(texts)
    for t, i, b, also in zip(texts, ids.to_pylist(), best, beside):
        want = best_split(by_score.given, "▁" + t, worst)
        assert b == want[0]
        if all(p in by_score.ids for p in want[1]):
            assert sum(by_score.given[by_score.name[k]] for k in i) == b and by_score.decode(i) == t
        assert also == b
    two = ours.scored([f"{texts[0]} {texts[1]}"])[1][0]
    assert two == beside[0] + beside[1]


def test_encode_edge_cases(spark):
    df = spark.createDataFrame([(None, "x"), (1, None), (1, None), (2, "")], "doc_id long, text string").withColumn("ids", F.lit(3))
    assert sorted((r.doc_id or 0, len(r.ids), r.best < 0) for r in pieces.encode(df).collect()) == [(0, 1, True), (1, 0, False), (1, 0, False), (2, 0, False)]
    texts = spark.createDataFrame([(1, "The best path of all.")], "doc_id long, text string")
    plain, best = (pieces.encode(texts, by_score=x, check=True).first() for x in (False, True))
    assert plain.same and best.same and plain.best == best.best
    assert pieces.encode(df.limit(0)).count() == 0
    bad = spark.createDataFrame([(1, [99999999, 5, None]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in pieces.decode(bad).collect()} == {1: "�\x02�", 2: "", 3: ""}


def test_held_out_accuracy(spark):
    docs, labels = spark.read.parquet(f"{SF2}/documents.parquet"), spark.read.parquet(f"{SF2}/labels.parquet")
    got = {r.doc_id: r for r in queries()["op3_quality"](spark, SF2).collect()}
    want = {r.doc_id: r.quality for r in labels.collect()}
    assert len(got) == docs.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    out = [(got[i].score, q) for i, q in want.items() if got[i].held_out]
    good, bad = [s for s, q in out if q], [s for s, q in out if not q]
    assert sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad)) > 0.95
    assert sum((s >= 0.3) == bool(q) for s, q in out) / len(out) > 0.93


def test_labels_of_held_out_rows_do_not_matter(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.fit(docs, x, sample=50) for x in (labels, turned))
    assert (a.near == b.near).all() and (a.y == b.y).all()


def test_votes_equal_brute_force(spark):
    rng = random.Random(23)
    vocabulary = [["ha", "ho", "lorem", "amet", "vita"], ["buy", "win!!!", "$$$", "click", "now"], ["zeta", "eta", "iota", "phi", "chi"]]
    texts = [" ".join(rng.choice(rng.choices(vocabulary, [5, 1 + k % 3, k % 2])[0]) + str(rng.randrange(4)) for _ in range(rng.randint(5, 90))) for k in range(160)]
    docs = spark.createDataFrame([*enumerate(texts), (0, "zz first"), (500, ""), (501, None)], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(k, k % 2) for k in range(0, 160, 2)] + [(1, 1), (3, 1), (5, 1), (7, 1), (9, 1), (11, 1)], "doc_id long, quality int")
    m = quality.fit(docs, labels, sample=60, dims=6, k=5)
    assert len(m.y) == 60
    # the statistics, counted one by one
    x = [quality.term_counts(t or "", {}) for t in [*texts, "zz first", "", None]]
    df = [sum(v[j] > 0 for v in x) for j in range(quality.TERMS)]
    assert all(abs(m.idf[j] - (math.log((1 + len(x)) / (1 + df[j])) + 1)) < 1e-5 for j in range(0, quality.TERMS, 7))
    got = {r.doc_id: r.score for r in quality.score(docs.where("coalesce(text, '') <> 'zz first'"), m).collect()}
    near = [[float(a) for a in v] for v in m.near]
    for k in range(0, 160, 9):
        z = [float(a) for a in (x[k] * m.idf - m.mean) @ m.v]
        norm = math.sqrt(sum(a * a for a in z))
        sims = sorted(((sum(a * b for a, b in zip(z, v)) / norm, float(y)) for v, y in zip(near, m.y)), reverse=True)[:5]
        w = [max(s, 1e-6) ** 4 for s, _ in sims]
        assert abs(got[k] - sum(a * y for a, (_, y) in zip(w, sims)) / sum(w)) < 1e-3
    assert got[500] == got[501] == pytest.approx(m.prior)


def test_quality_edge_cases(spark):
    docs = spark.createDataFrame([(1, ""), (2, None), (2, None), (None, "a b"), (3, "x" * 100_000), (4, "\x00 \n ")], "doc_id long, text string").withColumns({"score": F.lit(1), "x": F.lit(2)})
    none = spark.createDataFrame([(1, None), (9, 1)], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.fit(docs, none)).collect()] == [0.5] * 6
    some = spark.createDataFrame([(1, 1), (3, 0), (3, 1), (4, 1), (None, 1)], "doc_id long, quality int")
    m = quality.fit(docs, some)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, m).collect()) and quality.score(docs.limit(0), m).count() == 0
    assert quality.keep_good(docs, m, least=0.0).columns == docs.columns and quality.keep_good(docs, m, least=0.0).count() == 6


def test_pipeline_equals_its_parts(spark):
    import corpus_pipeline as p
    from tidewell.llm import decontaminate, linededup

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    steps, at = {}, docs
    for name, stage in p.STAGES:
        at = stage(spark, at, SF)
        at = p.written(at, "test")
        steps[name] = {r.doc_id: r for r in at.collect()}
        assert at.columns == docs.columns or name == p.STAGES[-1][0]
    scores = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))).collect()}
    assert set(steps["quality"]) == {i for i, s in scores.items() if s >= 0.3}
    seen, want = set(), {}
    for i in sorted(steps["quality"]):
        t = steps["quality"][i].text
        gone = [k for k, c in linededup.multi_line(t) if c in seen]
        seen |= {c for _, c in linededup.multi_line(t)}
        t = linededup.without(t, gone) if gone else t
        if not gone or t.strip():
            want[i] = t
    assert {i: r.text for i, r in steps["line_dedup"].items()} == want

    def near(t):
        w = t.encode().lower().split()
        return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets, kept, parent = {i: near(t) for i, t in want.items()}, [], {i: i for i in want}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    kept = {i for i in sets if root(i) == i}
    assert set(steps["near_dedup"]) == kept
    finder = decontaminate.Finder([(r.item_id, r.text) for r in bench.collect()])
    assert set(steps["decontaminate"]) == {i for i in kept if not finder.find(decontaminate.reduced(want[i]))}
    assert set(steps["encode"]) == set(steps["decontaminate"]) and all(len(r.ids) == r.n_ids for r in steps["encode"].values())
    assert {r.doc_id: r.ids for r in p.run(spark, SF).collect()} == {i: r.ids for i, r in steps["encode"].items()}
