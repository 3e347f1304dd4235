"""Learned positions: a two-level linear model of where a key stands among the sorted keys.

Keys fall into `fanout` buckets by their share of the range; each bucket is a line fitted by least
squares from raw sums, which add up, so a model can be merged with the sums of new data. Everything is
done for each shard by itself, or for all keys as one. Positions come from ranges of keys and running
counts, so that no task sees all keys of a shard; training adds a bucket's keys in their order, so that
a task sees all keys of a bucket, which are those of a shard only if nearly all of them are close together.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FANOUT = 1000
SUMS = ("n", "sx", "sy", "sxy", "sxx")


def positions(keys: DataFrame, *shard: str, parts: int = 0) -> DataFrame:
    """keys with pos, the place of key in its shard (or in all), and the shard's lo, hi and size.

    Keys are cut into `parts` ranges at approximate quantiles; each range of a shard is counted, and keys
    are numbered within it, so no task sees a whole shard. The cuts are plain numbers: unlike partition
    numbers they are the same wherever a row is read again.
    """
    from pyspark.ml.feature import Bucketizer

    n = parts or int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = keys.select(F.col("key").cast("double").alias("key")).approxQuantile("key", [k / n for k in range(1, n)], 0.2 / n) if n > 1 else []
    edges = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(edges) > 2:
        dealt = Bucketizer(splits=edges, inputCol="_k", outputCol="_c").transform(keys.withColumn("_k", F.col("key").cast("double"))).withColumn("_c", F.col("_c").cast("int")).drop("_k")
    else:
        dealt = keys.withColumn("_c", F.lit(0))
    counts = dealt.groupBy(*shard, "_c").agg(F.count("*").alias("_n"), F.min("key").alias("_lo"), F.max("key").alias("_hi"))
    # at most `parts` rows for each shard
    one = Window.partitionBy(*(shard or (F.lit(0),)))
    before = counts.select(
        *shard, "_c", F.coalesce(F.sum("_n").over(one.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"),
        F.min("_lo").over(one).alias("lo"), F.max("_hi").over(one).alias("hi"), F.sum("_n").over(one).alias("size"),
    )
    within = (F.row_number().over(Window.partitionBy(*shard, "_c").orderBy("key")) - 1).cast("long")
    return dealt.withColumn("_w", within).join(before, [*shard, "_c"]).withColumn("pos", F.col("_w") + F.col("_before")).drop("_c", "_w", "_before")


def bucket(fanout: int = FANOUT) -> Column:
    """The bucket of key between lo and hi; 0 if these are the same."""
    share = (F.col("key") - F.col("lo")).cast("double") / (F.col("hi") - F.col("lo")).cast("double") * fanout
    inside = F.least(F.greatest(share.cast("long"), F.lit(0)), F.lit(fanout - 1))
    return F.when(F.col("hi") == F.col("lo"), F.lit(0).cast("long")).otherwise(inside)


def sums(placed: DataFrame, *by: str) -> DataFrame:
    """The sums that a line needs, for each group, added from the lowest key to the highest.

    Beyond 2^53 sums of doubles depend on their order, and slopes and places cut from them do too. So each
    group is dealt to one task, which sorts it (on disk if need be) and adds as it reads: no partial sums.
    """
    x, y = F.col("key").cast("double"), F.col("pos").cast("double")
    rows = placed.select(*by, "key", "pos")
    rows = (rows.repartition(*by) if by else rows.repartition(1)).sortWithinPartitions(*by, "key", "pos")
    return rows.groupBy(*by).agg(
        F.count("*").cast("double").alias("n"), F.sum(x).alias("sx"), F.sum(y).alias("sy"), F.sum(x * y).alias("sxy"), F.sum(x * x).alias("sxx")
    )


def merge_sums(a: DataFrame, b: DataFrame, *by: str) -> DataFrame:
    """Sums of both inputs together: how a line learns more points."""
    both = a.select(*by, *SUMS).unionByName(b.select(*by, *SUMS))
    return both.groupBy(*by).agg(*[F.sum(c).alias(c) for c in SUMS])


def lines(s: DataFrame) -> DataFrame:
    """slope and intercept from sums; both 0 where the points do not define a line."""
    d = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
    slope = F.when(d == 0, 0.0).otherwise((F.col("n") * F.col("sxy") - F.col("sx") * F.col("sy")) / F.when(d == 0, 1.0).otherwise(d))
    return s.withColumn("slope", slope).withColumn("intercept", F.when(d == 0, 0.0).otherwise((F.col("sy") - F.col("slope") * F.col("sx")) / F.col("n")))


def predicted() -> Column:
    """The place that a line gives for key, cut toward zero; null where that is no 64-bit number."""
    return (F.col("slope") * F.col("key").cast("double") + F.col("intercept")).try_cast("long")


def train(placed: DataFrame, *shard: str, fanout: int = FANOUT) -> DataFrame:
    """The model: a line for each shard and bucket, with the sums it came from."""
    return lines(sums(placed.withColumn("bucket", bucket(fanout)), *shard, "bucket"))


def predict(placed: DataFrame, model: DataFrame, *shard: str, fanout: int = FANOUT) -> DataFrame:
    """placed with pred and error (pos - pred). The model has at most fanout rows for a shard: small for one shard, joined by a shuffle for many."""
    m = model.select(*shard, "bucket", "slope", "intercept")
    at = placed.withColumn("bucket", bucket(fanout)).join(m, [*shard, "bucket"])
    guess = F.when(F.col("hi") == F.col("lo"), F.lit(0).cast("long")).otherwise(predicted())
    return at.withColumn("pred", guess).withColumn("error", F.col("pos") - F.col("pred"))


def error_bounds(found: DataFrame, *shard: str) -> DataFrame:
    """min_error (at most 0) and max_error (at least 0) for each shard: where a key is, given its prediction."""
    return found.groupBy(*shard).agg(
        F.least(F.min("error"), F.lit(0).cast("long")).alias("min_error"), F.greatest(F.max("error"), F.lit(0).cast("long")).alias("max_error")
    )


def append(model: DataFrame, bounds: DataFrame, new: DataFrame, *shard: str, fanout: int = FANOUT) -> tuple[DataFrame, DataFrame]:
    """A model and its error bounds after learning more keys: their sums are added, and the bounds widen to hold them.

    new: key, pos and the shard's lo, hi and size as when the model was trained; keys beyond hi fall into the last
    bucket. As with any online model, older keys may move out of their bounds; train() again restores these.
    """
    more = sums(new.withColumn("bucket", bucket(fanout)), *shard, "bucket")
    grown = lines(merge_sums(model, more, *shard, "bucket"))
    wide = error_bounds(predict(new, grown, *shard, fanout=fanout), *shard)
    both = bounds.unionByName(wide)
    return grown, both.groupBy(*shard).agg(F.min("min_error").alias("min_error"), F.max("max_error").alias("max_error"))


def window_lookup(found: DataFrame, bounds: DataFrame, *shard: str) -> DataFrame:
    """found with the window of places to search, cut to the shard, and how a search goes in it: by steps if it is short, else by halving."""
    w = found.join(bounds, list(shard)) if shard else found.join(F.broadcast(bounds))
    first = F.greatest(F.col("pred") + F.col("min_error"), F.lit(0).cast("long"))
    last = F.least(F.col("pred") + F.col("max_error"), F.col("size") - 1)
    return w.withColumn("first", first).withColumn("last", last).withColumn("linear", (F.col("last") - F.col("first")) < 16)


def sampled(found: DataFrame, most: int, *shard: str) -> DataFrame:
    """Every k-th place of a shard, k = size // most for a shard of more than `most` keys, else every place: the report's own sampling."""
    step = F.when(F.col("size") > most, F.floor(F.col("size") / most)).otherwise(1)
    return found.where(F.col("pos") % step == 0)


def diagnostics(found: DataFrame, *shard: str, each: int = 5000, most: int = 5000) -> DataFrame:
    """key, real_pos, predicted_pos, error: sampled in each shard, the first `most` by shard and place."""
    out = sampled(found, each, *shard).orderBy(*shard, "pos").limit(most)
    return out.select("key", F.col("pos").alias("real_pos"), F.col("pred").alias("predicted_pos"), "error")


def heatmap(found: DataFrame, most: int = 2000) -> DataFrame:
    """k, e: key and error at every k-th place."""
    return sampled(found, most).select(F.col("key").alias("k"), F.col("error").alias("e"))


def probe_steps(found: DataFrame, bounds: DataFrame, *shard: str) -> DataFrame:
    """Steps of a search over all keys and over the model's window, by key: what the benchmark compares."""
    w = window_lookup(found, bounds, *shard)
    halving = lambda n: F.ceil(F.log2(F.greatest(n, F.lit(1)) + 1)).cast("long")
    width = F.greatest(F.col("last") - F.col("first") + 1, F.lit(1).cast("long"))
    return w.select("key", halving(F.col("size")).alias("full_steps"), F.when(F.col("linear"), F.col("pos") - F.col("first") + 1).otherwise(halving(width)).alias("model_steps"))


def random_keys(found: DataFrame, lookups: int, seed: int = 1) -> DataFrame:
    """About `lookups` rows drawn with replacement."""
    return found.sample(True, min(1000.0, lookups / max(1, found.count())), seed)


def benchmark(found: DataFrame, bounds: DataFrame, *shard: str, lookups: int = 50_000, seed: int = 1) -> dict:
    """Mean steps over random keys, drawn with replacement, and the seconds that took."""
    picks = random_keys(found, lookups, seed)
    began = time.perf_counter()
    full, model, count = probe_steps(picks, bounds, *shard).agg(F.avg("full_steps"), F.avg("model_steps"), F.count("*")).first()
    return {"lookups": count, "full_steps": full, "model_steps": model, "speedup": full / model if model else None, "seconds": time.perf_counter() - began}
