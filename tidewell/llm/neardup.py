"""MinHash near-duplicates with odd sketches.

A document's set is that of its distinct word shingles (64-bit hashes). BANDS * ROWS MinHash samples
give BANDS bucket keys, and are folded into an odd sketch: a bitmap in which every sample flips one
bit, so that the population count of the XOR of two sketches estimates high similarities closely.

1. Equal sets are one class with a number of its own; only classes go on.
2. In every bucket, members meet the bucket's first document (the pivot), not each other. Pairs that
   the sketches and the set sizes allow are verified on the full sets, and the links united.
3. In buckets that still hold several components, members outside the bucket's largest component meet
   all members of other components, again through the sketches and the full sets. Pairs inside one
   component are never needed, so no link that would join components is lost.
4. Each step is written to the shared folder; ids and links stay distributed.

At similarity 0.8, a pair shares no bucket with probability (1 - 0.8^5)^36 = 6e-7, and the bound on the
sketches of samples is six standard deviations wide. A second odd sketch has one bit flipped for every
element of the set; its XOR has no more bits than the sets' difference has elements, so its bound loses
nothing, and for documents of up to some hundreds of words it leaves hardly any false candidate.

Edge cases: null and empty texts, or texts without words, have an empty set and are linked with
nothing; a text with fewer words than a shingle is one shingle; rows that share a doc_id are one node
for linking; rows repeated whole get the same result; rows with a null doc_id are linked by their texts
only, and of a component of such rows, which is null, those with the first text by hash are kept; very
long texts are hashed whole; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import LAST, broadcast_if_small, components, forget, identity, written

BANDS, ROWS, BITS, SET_BITS = 36, 5, 512, 1024
SAMPLES = BANDS * ROWS
LONGS, SET_LONGS = BITS // 64, SET_BITS // 64
#: Ids (8 bytes each) that may be broadcast once counted.
FEW_IDS = 500_000
_RNG = np.random.default_rng(20240229)
_A = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, SAMPLES, dtype=np.uint64)
_M = _RNG.integers(0, 1 << 63, 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct hashes of the shingles of a text: A-Z lower-cased, parted by blanks, tabs and line ends."""
    w = (text or "").encode("utf-8", "replace").lower().split()
    if not w:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, w), dtype=np.uint64, count=len(w))
    n = min(words, len(h))
    out = np.full(len(h) - n + 1, n, dtype=np.uint64)
    for k in range(n):
        out = mixed(out + h[k:len(h) - n + 1 + k]) * _M[k % 16]
    return np.unique(out)


def minhash(s: np.ndarray) -> np.ndarray:
    out = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(s), 1024):
        np.minimum(out, (s[None, a:a + 1024] * _A[:, None] ^ _B[:, None]).min(axis=1), out=out)
    return out


def folded(samples: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bucket keys, one for each band, and the odd sketch."""
    keys = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in samples.reshape(BANDS, ROWS).T:
        keys = mixed(keys ^ r)
    at = (mixed(samples + np.arange(SAMPLES, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) % np.uint64(BITS)).astype(np.int64)
    bits = np.bincount(at, minlength=BITS).astype(np.uint8) & 1
    return keys.view(np.int64), np.packbits(bits).view(np.int64)


def parity(s: np.ndarray) -> np.ndarray:
    """The odd sketch of a whole set."""
    bits = np.bincount((s >> np.uint64(20)).astype(np.int64) % SET_BITS, minlength=SET_BITS).astype(np.uint8) & 1
    return np.packbits(bits).view(np.int64)


def sketch_bound(similarity: float, sd: float = 6.0) -> int:
    """The most bits in which the sketches of two sets of that similarity differ, but for `sd` standard deviations."""
    miss = SAMPLES * (1 - similarity)
    most = min(SAMPLES, miss + sd * math.sqrt(miss * similarity))
    mean = BITS / 2 * (1 - math.exp(-4 * most / BITS))
    return math.ceil(mean + 4 * math.sqrt(BITS / 4 * (1 - math.exp(-8 * most / BITS))))


def _sketches(docs: DataFrame, words: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                p = b.slice(a, 512)
                n, d1, d2, keys, odd = [], [], [], [], []
                for t in p.column(2).to_pylist():
                    s = shingles(t, words)
                    n.append(len(s))
                    d = xxhash.xxh3_128_intdigest(s.tobytes())
                    d1.append((d >> 64) - (1 << 63)), d2.append((d & (1 << 64) - 1) - (1 << 63))
                    x, y = folded(minhash(s)) if len(s) else (np.zeros(0, np.int64), np.zeros(LONGS, np.int64))
                    keys.append(x), odd.append(np.concatenate([y, parity(s)]))
                yield pa.RecordBatch.from_arrays(
                    [p.column(0), p.column(1), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(odd, pa.list_(pa.int64()))],
                    names=["i", "k", "n", "d1", "d2", "keys", "odd"],
                )

    return docs.mapInArrow(run, "i long, k long, n long, d1 long, d2 long, keys array<long>, odd array<long>")


def _may_link(least: int, of: int) -> Column:
    """Whether sizes and sketches (na, nb, oa, ob) allow the similarity least / of."""
    differ = lambda a, b: sum((F.bit_count(F.col("oa")[k].bitwiseXOR(F.col("ob")[k])) for k in range(a, b)), F.lit(0))
    sizes = (F.col("na") * of >= F.col("nb") * least) & (F.col("nb") * of >= F.col("na") * least)
    # |A ^ B| <= (|A| + |B|) * (of - least) / (of + least)
    whole = differ(LONGS, LONGS + SET_LONGS) * (of + least) <= (F.col("na") + F.col("nb")) * (of - least)
    return sizes & whole & (differ(0, LONGS) <= sketch_bound(least / of))


def _verified(pairs: DataFrame, classes: DataFrame, texts: DataFrame, words: int, least: int, of: int) -> DataFrame:
    """The pairs (a, b) of classes whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, np.ndarray] = {}

        def set_of(c: int, t: str | None) -> np.ndarray:
            if c not in kept:
                if len(kept) > 64:
                    kept.clear()
                kept[c] = shingles(t, words)
            return kept[c]

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                out = []
                for a, b, ta, tb in zip(*(c.to_pylist() for c in batch.slice(at, 512).columns)):
                    x, y = shingles(ta, words), set_of(b, tb)
                    same = len(x) + len(y) - len(np.union1d(x, y))
                    if of * same >= least * (len(x) + len(y) - same) and len(x):
                        out.append((a, b))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], names=["a", "b"])

    # only the text that shows each candidate moves; a row repeated whole is one text
    wanted = pairs.select(F.col("a").alias("c")).unionByName(pairs.select(F.col("b").alias("c"))).distinct()
    wanted = written(classes.select("c", "i", "k").join(broadcast_if_small(written(wanted, "wanted"), FEW_IDS), "c"), "wanted")
    some = written(texts.join(broadcast_if_small(wanted, FEW_IDS), ["i", "k"]).dropDuplicates(["c"]).select("c", "text"), "texts")
    full = (
        pairs.join(some.select(F.col("c").alias("a"), F.col("text").alias("ta")), "a")
        .join(some.select(F.col("c").alias("b"), F.col("text").alias("tb")), "b").select("a", "b", "ta", "tb")
    )
    out = written(full.mapInArrow(run, "a long, b long").distinct(), "links")
    for t in (wanted, some):
        forget(t)
    return out


def _of_one_id(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes with rows of one id."""
    known = rows.where((F.col("i") != LAST) & (F.col("n") > 0)).select("i", "d1", "d2")
    several = known.groupBy("i").agg(F.min("d1").alias("x"), F.max("d1").alias("y"), F.min("d2").alias("z"), F.max("d2").alias("w")).where("x <> y or z <> w")
    several = broadcast_if_small(written(several.select("i"), "several"), FEW_IDS)
    of = written(known.join(several, "i").distinct().join(classes.select("d1", "d2", "c"), ["d1", "d2"]).select("i", "c"), "several")
    return of.join(of.groupBy("i").agg(F.min("c").alias("b")), "i").select(F.col("c").alias("a"), "b").where("a <> b")


def _components(texts: DataFrame, words: int, least: int, of: int) -> DataFrame:
    """i, k, n, component, kept for every row of (i, k, text)."""
    all_rows = written(_sketches(texts, words), "sketches")
    some = all_rows.where("n > 0")
    # equal sets have equal sketches; a class is shown by its first row and named by a number, fixed as the table is written
    mine = some.groupBy("d1", "d2").agg(F.min(F.struct("i", "k")).alias("at"), F.first("n").alias("n"), F.first("keys").alias("keys"), F.first("odd").alias("odd"))
    mine = written(mine.select("d1", "d2", "at.i", "at.k", "n", "keys", "odd", F.monotonically_increasing_id().alias("c")), "classes")
    slim = mine.select("c", "n", "odd")
    side = lambda s: slim.select(F.col("c").alias(s), F.col("n").alias(f"n{s}"), F.col("odd").alias(f"o{s}"))

    may = lambda pairs: pairs.join(side("a"), "a").join(side("b"), "b").where(_may_link(least, of)).select("a", "b")

    buckets = mine.select("c", "i", F.explode("keys").alias("key"))
    # written, here and below, so that the join deals both sides anew and a bucket of many members can be split
    first_of = F.min_by("c", "i").alias("p")
    shared = written(buckets.groupBy("key").agg(first_of, F.min("c").alias("x"), F.max("c").alias("y")).where("x <> y").select("key", "p"), "shared")
    inside = written(buckets.join(shared, "key").select("key", "c", "p"), "buckets")
    near = written(may(inside.where("c <> p").select(F.col("c").alias("a"), F.col("p").alias("b")).distinct()), "pivots")
    links = written(_verified(near, mine, texts, words, least, of).unionByName(_of_one_id(all_rows, mine)), "links")
    ids = mine.select(F.col("c").alias("id"))
    comp = written(components(ids, links), "components")

    # buckets of several components: who is outside the largest meets all of other components
    with_c = inside.join(comp.withColumnsRenamed({"id": "c", "component": "r"}), "c").select("key", "c", "r")
    sizes = with_c.groupBy("key", "r").agg(F.count("*").alias("m"))
    main = sizes.groupBy("key").agg(F.max(F.struct("m", "r")).alias("x"), F.count("*").alias("k")).where("k > 1").select("key", F.col("x.r").alias("main"))
    main = written(main, "main")
    mixed_in = written(with_c.join(main, "key").join(slim, "c"), "mixed")
    left = mixed_in.where("r <> main").select("key", F.col("c").alias("a"), F.col("r").alias("ra"), F.col("n").alias("na"), F.col("odd").alias("oa"))
    right = mixed_in.select("key", F.col("c").alias("b"), F.col("r").alias("rb"), "main", F.col("n").alias("nb"), F.col("odd").alias("ob"))
    cond = (left["key"] == right["key"]) & (F.col("ra") != F.col("rb")) & ((F.col("rb") == F.col("main")) | (F.col("a") < F.col("b"))) & _may_link(least, of)
    late = left.join(right, cond).select("a", "b").distinct().join(near.select("a", "b"), ["a", "b"], "left_anti")
    late = late.join(near.select(F.col("b").alias("a"), F.col("a").alias("b")), ["a", "b"], "left_anti")
    late = written(late, "late")
    if late.limit(1).count():
        more = _verified(late, mine, texts, words, least, of)
        comp = written(components(ids, links.unionByName(more)), "components")
        forget(more)

    rooted = mine.select("c", "d1", "d2", "i", "k").join(comp.select(F.col("id").alias("c"), F.col("component").alias("r")), "c")
    first = rooted.groupBy("r").agg(F.min(F.struct("i", "k")).alias("first"))
    # written, so that rows of a hot text can be split in the join
    named = written(rooted.join(first, "r").select("d1", "d2", "first"), "named")
    for t in (mine, shared, inside, near, links, mixed_in, main, late):
        forget(t)
    found = all_rows.select("i", "k", "n", "d1", "d2").join(named, ["d1", "d2"], "left")
    alone = F.struct("i", "k")
    first = F.when(F.col("n") > 0, F.coalesce("first", alone)).otherwise(alone)
    return found.select("i", "k", "n", first["i"].alias("component"), ((first["i"] == F.col("i")) & ((F.col("i") != LAST) | (first["k"] == F.col("k")))).alias("kept"))


def _identified(docs: DataFrame) -> DataFrame:
    i, k = identity(docs)
    return docs.select(i.alias("i"), k.alias("k"), F.col("text").cast("string").alias("text"))


def near_duplicates(docs: DataFrame, words: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row. Linked: of * |A & B| >= least * |A | B|."""
    known = lambda c: F.when(F.col(c) != LAST, F.col(c))
    return _components(_identified(docs), words, least, of).select(known("i").alias("doc_id"), F.col("n").alias("n_shingles"), known("component").alias("component_id"), "kept")


def keep_one(docs: DataFrame, words: int = 5, least: int = 80, of: int = 100) -> DataFrame:
    """The rows of docs, with all their columns, whose document comes first in its component."""
    kept = written(_components(_identified(docs), words, least, of).where("kept").select("i", "k").distinct(), "kept")
    i, k = identity(docs)
    return docs.join(kept, (i == kept["i"]) & (k == kept["k"]), "left_semi")


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all whole documents, on shingles of four words."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4)
