"""Embedding near-duplicates: a navigable small-world graph per shard, every shard asked for every vector.

Equal vectors are one class with a weight, dealt to shards of bounded size by a hash. Each shard's graph
is built by one task, audited against full scans (hnsw.Graph.audited: queries from all shards, no vector
as its own hit), its beam widened until the recall passes, and written to the shared folder as the files of
its shard. A search task then holds the graphs of a few shards and streams the files of other shards past
them, a batch at a time, so no vector is shuffled to be searched. Found pairs count only if the cosine in
double precision is high enough.

Every pair of vectors is looked for from one side only, that of the later shard (within a shard, of the
later node), and counts for both, so n_links is symmetric. A task returns summed weights for queries and
nodes that found something, and of the links only a spanning forest for each batch, so that a dense group
costs rows in proportion to its size, not to its square.

Searches number vectors times shards / 2, whatever the layout: for a table of 10^9 vectors, `shard` should
be as large as a task's memory lets it be. Python workers read the shared folder by pyarrow.fs, which knows
local paths, HDFS, S3 and GCS.

Edge cases: null vectors, zero vectors and those with null or non-finite components are returned with
no links; vectors of different lengths never link, and the lengths that occur are collected as a set; rows
with one vec_id and different vectors are searched each, and are one node in components; equal rows link
with each other; rows with a null vec_id link as any other but join nothing by their id, and a component of
such rows only is null; labels and other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.dataset
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import LAST, broadcast_if_small, components, drop, forget, shared_path, written
from tidewell.llm.hnsw import Graph

SHARD, LEAST_SHARDS = 20_000, 4
#: At most so many graphs are held by a search task and so many shards streamed past them; of few shards fewer, so that there is work for all.
HELD, STREAMED, TASKS = 4, 8, 20_000
QUERY, SAMPLE = 512, 256
MARGIN = 1e-4
NODE = "shard long, node int, c long, m long, v {kind}, links binary, ef int, slack double"


def _matrix(col: pa.Array, d: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(col), d)


def _unit(v: np.ndarray) -> np.ndarray:
    big = np.abs(v).max(axis=1, keepdims=True)
    v = v / np.where(big > 0, big, 1)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _build(table: pa.Table, least: float, recall: float, sample: list[tuple[int, list[float]]]) -> pa.Table:
    table = table.combine_chunks().sort_by("c")
    d, n, c = len(table["v"][0]), table.num_rows, table["c"].to_numpy()
    g = Graph.build(_unit(_matrix(table["v"].combine_chunks(), d)).astype(np.float32))
    own = set(c.tolist())
    foreign = [v for i, v in sample if len(v) == d and i not in own]
    ef, slack, _ = g.audited(least - MARGIN, recall, _unit(np.array(foreign, dtype=np.float64)) if foreign else np.zeros((0, d)))
    links = [b"".join(np.int32(len(l[i])).tobytes() + l[i].tobytes() for l in g.links[: int(g.level[i]) + 1]) for i in range(n)]
    return pa.table({
        "shard": table["shard"], "node": pa.array(range(n), pa.int32()), "c": table["c"], "m": table["m"], "v": table["v"],
        "links": pa.array(links, pa.binary()), "ef": pa.array([ef] * n, pa.int32()), "slack": pa.array([slack] * n, pa.float64()),
    })


def _files(path: str, shard: int) -> pa.dataset.Dataset:
    """The files of a shard, as a worker reads them."""
    fs, at = pa.fs.FileSystem.from_uri(f"{path}/shard={shard}")
    return pa.dataset.dataset(at, filesystem=fs, format="parquet")


class _Shard:
    """A graph read back from its files, and what it has answered."""

    def __init__(self, path: str, shard: int, least: float):
        t = _files(path, shard).to_table().combine_chunks().sort_by("node")
        self.shard, self.least = shard, least
        self.c, self.m = t["c"].to_numpy().astype(np.int64), t["m"].to_numpy().astype(np.int64)
        self.v = _unit(_matrix(t["v"].combine_chunks(), len(t["v"][0])))
        read = []
        for blob in t["links"].to_pylist():
            a, layers = np.frombuffer(blob, dtype=np.int32), []
            while len(a):
                layers.append(a[1:1 + a[0]])
                a = a[1 + a[0]:]
            read.append(layers)
        level = np.array([len(x) - 1 for x in read])
        arrays = [np.full((len(read), max(len(x[k]) for x in read if len(x) > k)), -1, dtype=np.int32) for k in range(int(level.max()) + 1)]
        for i, layers in enumerate(read):
            for k, x in enumerate(layers):
                arrays[k][i] = x
        self.graph = Graph(self.v.astype(np.float32), level, arrays)
        self.ef, self.slack = int(t["ef"][0].as_py()), float(t["slack"][0].as_py())
        self.weight = np.zeros(len(self.c), dtype=np.int64)
        self.told: set[tuple[int, int]] = set()

    def ask(self, c: np.ndarray, m: np.ndarray, v: np.ndarray, later: np.ndarray | None) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """For queries (class, weight, unit vector): summed weight of the links of each, and links (class, class) of a spanning forest.

        The queries' weights are added to those of the nodes found. later: the nodes that the queries are; only nodes after these count.
        """
        row, node = self.graph.within(v.astype(np.float32), self.least - MARGIN, self.ef, self.slack)
        if later is not None:
            after = node > later[row]
            row, node = row[after], node[after]
        ok = np.concatenate([np.einsum("id,id->i", v[row[a:a + 50_000]], self.v[node[a:a + 50_000]]) >= self.least for a in range(0, len(row), 50_000)] or [np.zeros(0, bool)])
        row, node = row[ok], node[ok]
        weight = np.bincount(row, weights=self.m[node], minlength=len(c)).astype(np.int64)
        self.weight += np.bincount(node, weights=m[row], minlength=len(self.c)).astype(np.int64)
        # labels spread until they settle: over nodes, and over queries, which within a shard are other nodes
        of_node, of_row = np.arange(len(self.c)), np.full(len(c), len(self.c))
        while len(row):
            new = of_row.copy()
            np.minimum.at(new, row, of_node[node])
            back = of_node.copy()
            np.minimum.at(back, node, new[row])
            if (new == of_row).all() and (back == of_node).all():
                break
            of_row, of_node = new, back
        links = [(int(c[r]), int(self.c[of_row[r]])) for r in np.unique(row)]
        for k in np.unique(node):
            pair = (int(self.c[k]), int(self.c[of_node[k]]))
            if pair[0] != pair[1] and pair not in self.told:
                self.told.add(pair)
                links.append(pair)
        return weight, links


def _found(c: np.ndarray, n: np.ndarray, links: list[tuple[int, int]]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))
    hit = np.flatnonzero(n)
    if len(hit):
        out = [[] for _ in hit]
        out[0] = [{"a": a, "b": b} for a, b in links]
        yield pa.RecordBatch.from_arrays([pa.array(c[hit]), pa.array(n[hit]), pa.array(out, kind)], names=["c", "n", "links"])


def _search(path: str, lengths: list[int], shards: int, least: float):
    """What a task does, and how many there are; a task's number names a length of vectors, shards to hold and shards to stream."""
    held_, streamed_ = min(HELD, -(-shards // 16)), min(STREAMED, -(-shards // 16))
    groups, slices = -(-shards // held_), -(-shards // streamed_)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for task in b.column(0).to_pylist():
                base, (group, slice_) = lengths[task // (groups * slices)] * shards, divmod(task % (groups * slices), slices)
                first, last = group * held_, min(shards, (group + 1) * held_)
                streamed = range(max(first, slice_ * streamed_), min(shards, (slice_ + 1) * streamed_))
                if not streamed:
                    continue
                held = [_Shard(path, base + s, least) for s in range(first, last) if _exists(path, base + s)]
                for t in streamed:
                    if not held or not _exists(path, base + t):
                        continue
                    for part in _files(path, base + t).to_batches(columns=["node", "c", "m", "v"], batch_size=QUERY):
                        if not part.num_rows:
                            continue
                        node, c, m = (part.column(k).to_numpy().astype(np.int64) for k in range(3))
                        v = _unit(_matrix(part.column(3), len(part.column(3)[0])))
                        for g in held:
                            if g.shard <= base + t:
                                weight, links = g.ask(c, m, v, node if g.shard == base + t else None)
                                yield from _found(c, weight, links)
                for g in held:
                    yield from _found(g.c, g.weight, [])

    return run, len(lengths) * groups * slices


def _exists(path: str, shard: int) -> bool:
    fs, at = pa.fs.FileSystem.from_uri(f"{path}/shard={shard}")
    return fs.get_file_info(at).type != pa.fs.FileType.NotFound


def near_vectors(vectors: DataFrame, least: float = 0.9, recall: float = 0.99, shard: int = SHARD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of (vec_id, embedding)."""
    spark = vectors.sparkSession
    kind = "array<float>" if dict(vectors.dtypes)["embedding"] == "array<float>" else "array<double>"
    rows = vectors.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(LAST)).alias("i"), F.col("embedding").cast(kind).alias("v"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    good = F.col("v").isNotNull() & F.coalesce(F.forall("v", finite), F.lit(False)) & F.coalesce(F.exists("v", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("h", F.when(good, F.sha2(F.array_join(F.transform("v", lambda x: (x.cast("double") + 0.0).cast("string")), ","), 256)))
    kept = rows.where(F.col("h").isNotNull())
    # a class is named by a number of its own, which is fixed as the table is written
    classes = kept.groupBy("h").agg(F.count("*").alias("m"), F.min("i").alias("rep"), F.first("v").alias("v"))
    classes = written(classes.withColumns({"d": F.size("v"), "c": F.monotonically_increasing_id()}), "vectors")
    n, lengths = classes.agg(F.count("*"), F.collect_set("d")).first()
    shards, path = max(LEAST_SHARDS, math.ceil(n / shard)), shared_path(spark, "graphs")
    sample = [(r[0], list(r[1])) for r in classes.orderBy(F.xxhash64("c"), "c").select("c", "v").limit(SAMPLE).collect()]
    named = classes.select((F.col("d").cast("long") * shards + F.pmod(F.xxhash64("c", F.lit(1)), F.lit(shards))).alias("shard"), "c", "m", "v")
    graphs = named.groupBy("shard").applyInArrow(lambda t: _build(t, least, recall, sample), NODE.format(kind=kind))
    graphs.write.partitionBy("shard").parquet(path)
    run, tasks = _search(path, sorted(lengths), shards, least)
    asked = spark.range(0, tasks, 1, max(1, min(TASKS, tasks)))
    found = written(asked.mapInArrow(run, "c long, n long, links array<struct<a:long,b:long>>"), "found")
    drop(spark, path)
    counts = found.groupBy("c").agg(F.sum("n").alias("n"))
    pairs = found.select(F.explode("links").alias("x")).select("x.a", "x.b").distinct()
    comp = components(classes.select(F.col("c").alias("id")), pairs.unionByName(_of_one_id(kept, classes)))
    named = written(classes.join(comp.select(F.col("id").alias("c"), F.col("component").alias("root")), "c").select("c", "h", "m", "rep", "root"), "roots")
    label = named.groupBy("root").agg(F.min("rep").alias("component"))
    of_class = named.join(counts, "c", "left").join(label, "root").select("h", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n_links"), "component")
    # written, so that rows of a hot vector can be split in the join
    of_class = written(of_class, "classes")
    for t in (classes, found, named):
        forget(t)
    out = rows.select("i", "h").join(of_class, "h", "left")
    component = F.coalesce("component", "i")
    return out.select(
        F.when(F.col("i") != LAST, F.col("i")).alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.when(component != LAST, component).alias("component_id"), (component == F.col("i")).alias("kept"),
    )


def _of_one_id(kept: DataFrame, classes: DataFrame) -> DataFrame:
    """Links (a, b) between classes with rows of one id."""
    h = F.xxhash64("h")
    known = kept.where(F.col("i") != LAST)
    several = written(known.groupBy("i").agg(F.min(h).alias("x"), F.max(h).alias("y")).where("x <> y").select("i"), "several")
    of = known.join(broadcast_if_small(several, 100_000), "i").select("i", "h").distinct().join(classes.select("h", "c"), "h")
    of = written(of.select("i", "c"), "several")
    first = of.groupBy("i").agg(F.min("c").alias("b"))
    return of.join(first, "i").select(F.col("c").alias("a"), "b").where("a <> b")


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all embeddings."""
    return near_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))
