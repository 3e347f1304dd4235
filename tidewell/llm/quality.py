"""Quality scores by nearest-neighbour voting over latent-semantic vectors.

A document becomes counts of hashed terms: its words, triples of character classes (each
punctuation mark is a class of its own), and a few terms for repetition. The counts are damped,
weighted by inverse document frequency, centred, and projected on the leading singular vectors of a
labelled sample. Document frequencies and means are counted over all documents. The sample has at
most `sample` documents, so its vectors are broadcast; every document meets every labelled vector in
exact blocked products, and the `k` nearest vote with their cosine similarity as weight.

Only the labelled sample is bounded (`sample`, 4000 labelled documents, chosen by a hash of doc_id);
statistics and scores read every whole text. Edge cases: null and empty texts, and texts without terms,
get the share of label 1 in the sample; without any usable label every score is 0.5; a null label is not
used; of repeated labels or documents of one id the smallest label and text is used for fitting, and
every row is scored; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS, SHAPES, EXTRA = 1024, 1024, 32
TERMS = WORDS + SHAPES + EXTRA
BLOCK = 1 << 20
WEIGHTS = (0.5, 1.0, 1.0)


def _classes() -> np.ndarray:
    """byte -> class: letters by case, digits, blanks, every other ASCII mark by itself, non-ASCII bytes."""
    out = np.arange(256, dtype=np.int64)
    out[ord("a"): ord("z") + 1] = 1
    out[ord("A"): ord("Z") + 1] = 2
    out[ord("0"): ord("9") + 1] = 3
    out[128:] = 4
    return out


CLASS = _classes()


def term_counts(text: str, cache: dict[bytes, int]) -> np.ndarray:
    """Counts of the hashed terms of a whole text, damped; three parts, each of length 1 unless empty."""
    out = np.zeros(TERMS, dtype=np.float32)
    data = text.encode("utf-8", "replace")
    words = data.split()
    if not words:
        return out
    if len(cache) > 300_000:
        cache.clear()
    ids = []
    for w in words:
        i = cache.get(w)
        if i is None:
            i = cache[w] = zlib.crc32(w.lower()) % WORDS
        ids.append(i)
    part = np.bincount(np.array(ids, dtype=np.int64), minlength=WORDS)
    out[:WORDS] = np.log1p(part)
    shapes = np.zeros(SHAPES)
    for a in range(0, len(data), BLOCK):
        c = CLASS[np.frombuffer(data, dtype=np.uint8, count=min(BLOCK + 2, len(data) - a), offset=a)]
        if len(c) > 2:
            h = (c[:-2] * 66049 + c[1:-1] * 257 + c[2:]) * 2654435761 % 4294967296 >> 12
            shapes += np.bincount(h % SHAPES, minlength=SHAPES)
    out[WORDS:-EXTRA] = np.log1p(1000 * shapes / max(1, len(data)))
    n = len(words)
    again = sum(map(bytes.__eq__, words, words[1:])) / n
    lines = data.split(b"\n")
    for k, share in enumerate((again, len(set(words)) / n, len(set(lines)) / len(lines), sum(map(len, words)) / n / 20)):
        out[-EXTRA + 8 * k + min(7, int(8 * min(share, 1)))] = 1
    for a, b, w in ((0, WORDS, WEIGHTS[0]), (WORDS, TERMS - EXTRA, WEIGHTS[1]), (TERMS - EXTRA, TERMS, WEIGHTS[2])):
        if norm := np.linalg.norm(out[a:b]):
            out[a:b] *= w / norm
    return out


@dataclass
class Statistics:
    """Of all documents: how many there are, in how many each term occurs, and its mean count."""

    n: int
    df: np.ndarray
    mean: np.ndarray


def statistics(docs: DataFrame) -> Statistics:
    """A task counts its documents into one vector, so that a few rows for each term are added up; in whole numbers, so that the order does not matter."""
    unit = 1 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        n, df, total = 0, np.zeros(TERMS, dtype=np.int64), np.zeros(TERMS, dtype=np.int64)
        for b in batches:
            for a in range(0, b.num_rows, 256):
                for t in b.column(0).slice(a, 256).to_pylist():
                    x = term_counts(t or "", cache)
                    n += 1
                    df += x > 0
                    total += np.rint(x * unit).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, TERMS), pa.int32()), pa.array([n, *df.tolist()], pa.int64()), pa.array([0, *total.tolist()], pa.int64())], names=["term", "df", "total"])

    got = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "term int, df long, total long").groupBy("term").agg(F.sum("df"), F.sum("total"))
    rows = {r[0]: (r[1], r[2]) for r in got.collect()}  # a row for each term
    n = rows.get(-1, (0, 0))[0]
    of = np.array([rows.get(k, (0, 0)) for k in range(TERMS)], dtype=np.float64)
    return Statistics(n, of[:, 0], of[:, 1] / unit / max(1, n))


class Model:
    """What is broadcast: term weights, projection, labelled unit vectors and labels; a few MB at most."""

    def __init__(self, x: np.ndarray, y: np.ndarray, statistics: Statistics, dims: int, k: int, power: float):
        self.k, self.power, self.y = k, power, y.astype(np.float32)
        self.prior = float(y.mean()) if len(y) else 0.5
        self.idf = np.log((1 + statistics.n) / (1 + statistics.df)).astype(np.float32) + 1
        self.mean = (statistics.mean * self.idf).astype(np.float32)
        w = x * self.idf - self.mean
        rng = np.random.default_rng(7)
        if len(x):
            q = w @ rng.standard_normal((TERMS, min(dims + 16, *w.shape))).astype(np.float32)
            for _ in range(4):
                q = w @ (w.T @ np.linalg.qr(q)[0])
            _, _, v = np.linalg.svd(np.linalg.qr(q)[0].T @ w, full_matrices=False)
            self.v = np.ascontiguousarray(v[:dims].T)
        else:
            self.v = np.zeros((TERMS, 1), dtype=np.float32)
        self.near = self.vectors(x)

    def vectors(self, x: np.ndarray) -> np.ndarray:
        z = (x * self.idf - self.mean) @ self.v
        return z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-12)

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.y):
            return np.full(len(x), 0.5)
        sims = self.vectors(x) @ self.near.T
        k = min(self.k, len(self.y))
        top = np.argpartition(-sims, k - 1, axis=1)[:, :k]
        w = np.maximum(np.take_along_axis(sims, top, 1), 1e-6) ** self.power
        out = (w * self.y[top]).sum(1) / w.sum(1)
        return np.where((x != 0).any(1), np.clip(out, 0, 1), self.prior).astype(np.float64)


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, sample: int = 4000, dims: int = 64, k: int = 15, power: float = 4.0) -> Model:
    """docs: doc_id, text. labels: doc_id, quality. Learns from rows that held_out() leaves."""
    chosen = (
        labels.select("doc_id", F.col("quality").cast("int").alias("quality")).where(~held_out(F.col("doc_id")) & F.col("quality").isin(0, 1))
        .groupBy("doc_id").agg(F.min("quality").alias("quality"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # one text for each id, so that at most `sample` rows come back
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"), F.min("quality").alias("quality"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache: dict[bytes, int] = {}
        for b in batches:
            x = [term_counts(t, cache).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(x, pa.binary()), b.column(2)], names=["doc_id", "x", "y"])

    got = rows.mapInArrow(counted, "doc_id long, x binary, y int").toArrow().sort_by("doc_id").to_pydict()
    x = np.array([np.frombuffer(v, dtype=np.float32) for v in got["x"]], dtype=np.float32).reshape(len(got["x"]), TERMS)
    return Model(x, np.array(got["y"]), statistics(docs), dims, k, power)


def score(docs: DataFrame, model: Model, block: int = 256) -> DataFrame:
    """docs with columns doc_id and score, one row for each row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                x = np.stack([term_counts(t or "", cache) for t in part.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(m.score(x), pa.float64())], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def keep_good(docs: DataFrame, model: Model, least: float = 0.3, block: int = 256) -> DataFrame:
    """The rows of docs, with all their columns, that score at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, cache = shared.value, {}
        for b in batches:
            for a in range(0, b.num_rows, block):
                part = b.slice(a, block)
                x = np.stack([term_counts(t or "", cache) for t in part.column(at).to_pylist()])
                yield part.filter(pa.array(m.score(x) >= least))

    return docs.mapInArrow(run, docs.schema)


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every whole text of documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).cast("int").alias("predicted")
    )
