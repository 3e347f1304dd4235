"""Merging of versions: last writer wins.

Records are (key, value, seq); a value of length 0 is a tombstone. A read view is one aggregation on
the key with a partial step before its shuffle, so a key written often is merged where it is read.
Filters on key pass through it down to the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def latest(records: DataFrame, *order: str | Column, key: str = "key") -> DataFrame:
    """For each key the row that is last in `order` (by default seq); give a total order to be sure of ties."""
    order_by = F.struct(*(order or ("seq",)))
    rest = [c for c in records.columns if c != key]
    return records.groupBy(key).agg(F.max_by(F.struct(*rest), order_by).alias("_")).select(key, "_.*")


def alive(records: DataFrame, value: str = "value") -> DataFrame:
    """Without tombstones."""
    return records.where(F.length(value) > 0)


def live_view(records: DataFrame, *order: str | Column) -> DataFrame:
    """What a reader sees: the latest version of each key, deleted keys left out."""
    return alive(latest(records, *order))


def union_levels(*levels: DataFrame) -> DataFrame:
    """Levels from oldest to newest as one set of records; ranks them before seq, so a newer level wins."""
    out = None
    for rank, level in enumerate(levels):
        level = level.withColumn("level", F.lit(rank))
        out = level if out is None else out.unionByName(level)
    return out


def compact(records: DataFrame, *order: str | Column, drop_tombstones: bool = False) -> DataFrame:
    """One version for each key. Tombstones stay unless the result replaces every older level."""
    merged = latest(records, *order)
    return alive(merged) if drop_tombstones else merged


def valid_prefix(log: DataFrame, bad: Column, seq: str = "seq") -> DataFrame:
    """The entries of a log before its first damaged one. The cut is one aggregated value, joined back as such."""
    first = log.where(bad).agg(F.min(seq).alias("_cut"))
    return log.join(F.broadcast(first), F.col("_cut").isNull() | (F.col(seq) < F.col("_cut"))).drop("_cut")


def range_scan(records: DataFrame, first: int, last: int, *order: str | Column) -> DataFrame:
    """Live records with first <= key <= last, in key order. The range is applied before merging, which is legal as key groups."""
    return live_view(records.where(F.col("key").between(first, last)), *order).orderBy("key")


def get(records: DataFrame, key: int, *order: str | Column) -> DataFrame:
    return live_view(records.where(F.col("key") == key), *order)


def get_many(records: DataFrame, keys: DataFrame, *order: str | Column, small: int = 100_000) -> DataFrame:
    """Live records of many keys (column key): a semi-join before merging. Keys are broadcast only if counted to be few."""
    wanted = keys.select(F.col("key").cast("long").alias("key")).distinct()
    if wanted.limit(small + 1).count() <= small:
        wanted = F.broadcast(wanted)
    return live_view(records.join(wanted, "key", "left_semi"), *order)


def shard_counts(records: DataFrame, shards: int) -> DataFrame:
    from tidewell.functions.keys import shard_col

    return records.groupBy(shard_col("key", shards).alias("shard")).agg(F.count("*").alias("records"))


def pending_size(records: DataFrame) -> DataFrame:
    """Distinct keys and bytes (8 for a key, and the value) of records not yet merged; bytes count every version."""
    return records.agg(
        F.countDistinct("key").alias("records"), F.coalesce(F.sum(8 + F.length("value")), F.lit(0)).cast("long").alias("bytes")
    )
