"""Synthetic records: keys that rise by steps of 1 to 5 from a random start."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def rising(spark: SparkSession, n: int, start: int, step: Column) -> DataFrame:
    """i, key: start plus the running sum of `step` (an expression of i). Sums run in blocks of i, then over the blocks' totals, so no task sees all rows."""
    rows = spark.range(n).withColumnRenamed("id", "i").withColumn("step", step.cast("long")).withColumn("block", F.shiftright("i", 16))
    totals = rows.groupBy("block").agg(F.sum("step").alias("t"))
    before = F.coalesce(F.sum("t").over(Window.partitionBy(F.lit(0)).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = totals.select("block", before.alias("before"))
    within = F.sum("step").over(Window.partitionBy("block").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    return rows.join(base, "block").select("i", (F.lit(start) + F.col("before") + within).cast("long").alias("key"))


def synthetic(spark: SparkSession, n: int = 100_000, seed: int = 1, prefix: str = "data-") -> DataFrame:
    """n records (key, value): value is the prefix with the key."""
    step = 1 + F.pmod(F.xxhash64(F.col("i"), F.lit(seed)), F.lit(5))
    rows = rising(spark, n, random.Random(seed).randrange(1_000_000), step)
    return rows.select("key", F.concat(F.lit(prefix), F.col("key").cast("string")).cast("binary").alias("value"))
