"""What the operators share: tables written between stages, edge cases of the input, connected components."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.sources.shared import drop, shared_path

_SHIPPED: set[str] = set()


def ship_code(spark: SparkSession) -> None:
    """Gives this package to the Python workers of the session, once, as they need not find it on their own path."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="tidewell-code-")) / "tidewell_code.zip"
    with zipfile.ZipFile(path, "w") as z:
        for f in sorted(top.rglob("*.py")):
            z.write(f, f.relative_to(top.parent))
    spark.sparkContext.addPyFile(str(path))
    _SHIPPED.add(app)


def with_code(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """query, its code shipped first."""

    def run(spark: SparkSession, *args):
        ship_code(spark)
        return query(spark, *args)

    return run


def written(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._tidewell_path = path
    return out


def counted(df: DataFrame, name: str) -> tuple[DataFrame, int]:
    """written(df), and its rows, counted as they are written."""
    seen = Observation()
    return written(df.observe(seen, F.count(F.lit(1)).alias("n")), name), seen.get["n"]


def forget(df: DataFrame) -> None:
    """Deletes the files of a table made by written()."""
    drop(df.sparkSession, df._tidewell_path)


def small_count(df: DataFrame, limit: int) -> int:
    """Rows of df, or limit + 1 if there are more; reads no further than that."""
    return df.limit(limit + 1).count()


def broadcast_if_small(df: DataFrame, limit: int) -> DataFrame:
    """df marked for broadcast if it has been counted and has at most `limit` rows; else unmarked, so that it is joined by a shuffle."""
    return F.broadcast(df) if small_count(df, limit) <= limit else df


#: Stands for a null id, so that it ranks last.
LAST = (1 << 63) - 1


def identity(docs: DataFrame) -> tuple[Column, Column]:
    """What tells documents apart and orders them: doc_id, null last, then a hash of the text; rows repeated whole are one document."""
    return F.coalesce(docs["doc_id"].cast("long"), F.lit(LAST)), F.xxhash64(docs["text"].cast("string"))


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one that no column of df has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def text_of(column: str = "text") -> Column:
    """A text column, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


#: Links that one task may unite; more go through rounds of joins.
FEW_LINKS = 16_384


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of a task as a forest of stars (a, b), b the smallest of its tree; holds only what it has read since it last wrote."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := parent.setdefault(x, x)) != x:
            parent[x] = x = parent[y]
        return x

    def stars() -> pa.RecordBatch:
        leaves = [x for x in parent if root(x) != x]
        return pa.RecordBatch.from_arrays([pa.array(leaves, pa.int64()), pa.array([root(x) for x in leaves], pa.int64())], names=["a", "b"])

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
        if len(parent) > 1_000_000:
            yield stars()
            parent.clear()
    yield stars()


def components(nodes: DataFrame, edges: DataFrame, few: int = FEW_LINKS) -> DataFrame:
    """Connected components: (id, component) for every id of `nodes`; component is the smallest id reachable.

    edges has (a, b), in any direction. Every task first reduces its links to a forest. Up to `few` links
    in all, counted, are united by one task on an executor; more by alternating large-star and small-star
    steps, of an aggregation and a join each, where hubs are pre-aggregated and links stay distributed.
    Only counts reach the driver.
    """
    e = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b")
    e = written(e.mapInArrow(_forest, "a long, b long"), "cc")
    if small_count(e, few) <= few:
        stars = written(e.coalesce(1).mapInArrow(_forest, "a long, b long"), "cc")
        leaves = broadcast_if_small(stars, few)
    else:
        leaves = _stars(e)
    leaves = leaves.select(F.col("a").alias("id"), F.col("b").alias("component"))
    return nodes.select("id").join(leaves, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def _stars(e: DataFrame) -> DataFrame:
    while True:  # every round that does not settle joins stars; their number falls until none can be joined
        # large star: every neighbour larger than the node is linked with the smallest of the neighbourhood
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # written, here and below, so that the join deals both sides anew and a hub can be split
        least = written(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        big = written(both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct(), "big")
        # small star: every smaller neighbour, and the node, is linked with the smallest of them
        least2 = written(big.groupBy("a").agg(F.min("b").alias("m")), "least")
        joined = big.join(least2, "a")
        small = (
            joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least2.select("a", F.col("m").alias("b")))
            .where("a <> b").distinct()
        )
        nxt = written(small, "cc")
        # stars only: no node is both a leaf of one link and a centre of another, and no leaf has two centres
        centres = nxt.select(F.col("b").alias("a")).distinct()
        tangled = nxt.groupBy("a").agg(F.countDistinct("b").alias("n")).where("n > 1").select("a").unionByName(
            nxt.join(centres, "a", "left_semi").select("a")
        )
        for t in (e, least, big, least2):
            forget(t)
        e = nxt
        if not tangled.limit(1).count():
            return e
