"""Readers for the files of a log-structured store: sorted tables (.sst) and write-ahead logs (.wal).

Files come through Spark's binaryFile source, so any file system works and each file is one task's work.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The magic number at the end of a sorted table.
SST_MAGIC = 0x4E4555524F444201
NAME = r"shard-(\d+)-(?:l(\d)-)?(\d+)"


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """key, value, shard, level, stamp, place of all records of .sst files; level 1 where a name has none.

    A file is records (key i64, length i32, value), then an index, then the index's place and the magic
    number, all little-endian. The place bounds the records; a file without the magic number is an error.
    """
    magic = SST_MAGIC

    def parse(batches):
        import struct

        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                end, mark = struct.unpack_from("<qQ", data, len(data) - 16) if len(data) >= 16 else (0, 0)
                if mark != magic or not 0 <= end <= len(data) - 16:
                    raise ValueError(f"not a sorted table: {name}")
                at, keys, values = 0, [], []
                while at < end:
                    key, size = struct.unpack_from("<qi", data, at)
                    if size < 0 or at + 12 + size > end:
                        raise ValueError(f"damaged record at {at} of {name}")
                    keys.append(key)
                    values.append(data[at + 12:at + 12 + size])
                    at += 12 + size
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys, pa.int64()), pa.array(values, pa.binary()), pa.array(range(len(keys)), pa.int64())], names=["name", "key", "value", "place"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.sst").load(path).select("path", "content")
    out = raw.mapInArrow(parse, "name string, key bigint, value binary, place bigint")
    part = lambda k: F.regexp_extract("name", NAME, k)
    level = F.when(part(2) == "", 1).otherwise(part(2).try_cast("int"))
    return out.select("key", "value", part(1).try_cast("int").alias("shard"), level.alias("level"), part(3).try_cast("long").alias("stamp"), "place")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """key, value, name, stamp, seq of .wal files, each up to its first damaged entry.

    An entry is (crc u32, stamp u64, key u64, size u32, value), little-endian; the CRC covers key, size and value.
    seq counts the entries of a file, stamp is the entry's own time.
    """

    def parse(batches):
        import struct
        import zlib

        import pyarrow as pa

        for b in batches:
            for name, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                at, keys, values, stamps = 0, [], [], []
                while at + 24 <= len(data):
                    crc, stamp, key, size = struct.unpack_from("<IqqI", data, at)
                    if at + 24 + size > len(data) or zlib.crc32(data[at + 12:at + 24 + size]) != crc:
                        break
                    keys.append(key)
                    values.append(data[at + 24:at + 24 + size])
                    stamps.append(stamp)
                    at += 24 + size
                cols = [pa.array(keys, pa.int64()), pa.array(values, pa.binary()), pa.array([name.rsplit("/", 1)[-1]] * len(keys), pa.string()), pa.array(stamps, pa.int64()), pa.array(range(len(keys)), pa.int64())]
                yield pa.RecordBatch.from_arrays(cols, names=["key", "value", "name", "stamp", "seq"])

    raw = spark.read.format("binaryFile").option("pathGlobFilter", "*.wal").load(path).select("path", "content")
    return raw.mapInArrow(parse, "key bigint, value binary, name string, stamp bigint, seq bigint")


def log_entry(key: int, value: bytes, stamp: int = 0) -> bytes:
    """One entry of a .wal file."""
    rest = struct.pack("<qI", key, len(value)) + value
    return struct.pack("<Iq", zlib.crc32(rest), stamp) + rest


def sorted_table(records: list[tuple[int, bytes]]) -> bytes:
    """A .sst file of records, for exchange; its index has every hundredth key and the place of its record."""
    body, index = b"", []
    for k, (key, value) in enumerate(sorted(records, key=lambda r: r[0])):
        if k % 100 == 0:
            index.append((key, len(body)))
        body += struct.pack("<qi", key, len(value)) + value
    return body + struct.pack("<i", len(index)) + b"".join(struct.pack("<qq", *x) for x in index) + struct.pack("<qQ", len(body), SST_MAGIC)


def write_file(spark: SparkSession, path: str, data: bytes) -> None:
    """A file on any file system that Spark knows."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = at.getFileSystem(spark._jsc.hadoopConfiguration()).create(at, True)
    out.write(bytearray(data))
    out.close()
