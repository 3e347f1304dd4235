"""Counters, ratios and the text form of store statistics."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime, and two numbers that it is multiplied out with, for the hashes of Bloom filters.
BLOOM_MOD, BLOOM_BY = 2147483647, (48271, 69621)
#: name, kind, help and the statistic it shows.
METRICS = (
    ("reads_total", "counter", "Read operations.", "read_count"),
    ("writes_total", "counter", "Write operations.", "write_count"),
    ("hits_total", "counter", "Reads that found a record.", "hit_count"),
    ("pending_records", "gauge", "Records in deltas not yet merged.", "pending_record_count"),
    ("learned_indexes", "gauge", "Learned models kept.", "learned_indexes_count"),
    ("files", "gauge", "Data files.", "file_count"),
    ("delta_files", "gauge", "Files of deltas.", "delta_file_count"),
    ("base_files", "gauge", "Files of the base.", "base_file_count"),
    ("pending_writes", "gauge", "Writes accepted but not committed.", "pending_writes"),
    ("log_bytes", "gauge", "Bytes of deltas.", "log_size_bytes"),
    ("rw_ratio", "gauge", "Reads for each write.", "rw_ratio"),
)


def ratio(reads: int, writes: int) -> float:
    """Reads for each write; 100 without writes if there were reads, else 0."""
    return reads / writes if writes else 100.0 if reads else 0.0


def ratio_col(reads: Column, writes: Column) -> Column:
    return F.when(writes > 0, reads.cast("double") / F.when(writes > 0, writes)).when(reads > 0, 100.0).otherwise(0.0)


def metrics_text(stats: dict, prefix: str = "tidewell") -> str:
    """Statistics in the text format that monitoring servers read."""
    out = []
    for name, kind, says, key in METRICS:
        value = float(stats.get(key, 0) or 0)
        shown = f"{value:.6f}" if key == "rw_ratio" else f"{value:.0f}"
        out += [f"# HELP {prefix}_{name} {says}", f"# TYPE {prefix}_{name} {kind}", f"{prefix}_{name} {shown}"]
    return "\n".join(out) + "\n"


def bloom_size(n: int, rate: float) -> tuple[int, int]:
    """Bits and hashes of a Bloom filter for n keys and a rate of false positives."""
    bits = math.ceil(n * math.log(rate) / math.log(2 ** -math.log(2)))
    return bits, max(1, math.ceil(bits / n * math.log(2)))


def bloom_places(key: Column | str, bits: int, hashes: int) -> list[Column]:
    """The bits of a key: two hashes, then steps of the second from the first."""
    key = (F.col(key) if isinstance(key, str) else key).cast("long")
    x = F.pmod(key.bitwiseXOR(F.shiftright(key, 32)), F.lit(BLOOM_MOD))
    a, b = (F.pmod((x + 1) * m, F.lit(BLOOM_MOD)) for m in BLOOM_BY)
    return [F.pmod(a + b * k, F.lit(bits).cast("long")) for k in range(hashes)]


def bloom(keys: DataFrame, rate: float = 0.01, n: int = 0, most: int = 1 << 26) -> DataFrame:
    """A Bloom filter of column key as one row (bits, hashes, words array<bigint>), of at most `most` bits; n: how many keys, if known."""
    bits, hashes = bloom_size(max(1, n or keys.count()), rate)
    if bits > most:
        raise ValueError(f"a filter of {bits} bits is more than {most}; take a higher rate, or one filter for each range of keys")
    at = keys.select(F.explode(F.array(*bloom_places("key", bits, hashes))).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at % 64 as int))")).alias("v"))
    every = keys.sparkSession.range(-(-bits // 64)).select(F.col("id").alias("w"))
    one = every.join(words, "w", "left").agg(F.array_sort(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0).cast("long")).alias("v")))).alias("x"))
    return one.select(F.lit(bits).alias("bits"), F.lit(hashes).alias("hashes"), F.col("x.v").alias("words"))


def may_contain(probes: DataFrame, filter_: DataFrame) -> DataFrame:
    """probes with maybe: whether the filter may hold the column key; where it is false, no key does. The filter's one row is broadcast."""
    bits, hashes = filter_.select("bits", "hashes").first()
    hit = F.lit(True)
    for at in bloom_places("key", bits, hashes):
        word = F.element_at("words", (F.shiftright(at, 6) + 1).cast("int"))
        hit &= F.expr("1L") == F.call_function("shiftright", word, F.pmod(at, F.lit(64)).cast("int")).bitwiseAND(F.lit(1))
    return probes.join(F.broadcast(filter_.select("words"))).withColumn("maybe", hit).drop("words")
