"""Backups: JSON with base64 values. A folder of JSON lines scales; one document is read too."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "generated_at STRING, record_count BIGINT, records ARRAY<STRUCT<Key: BIGINT, Value: STRING>>"
LINE = "Key BIGINT, Value STRING"


def encoded(view: DataFrame) -> DataFrame:
    """Key, Value (base64) of records (key, value)."""
    return view.select(F.col("key").alias("Key"), F.base64(F.col("value")).alias("Value"))


def decoded(lines: DataFrame) -> DataFrame:
    return lines.where("Key IS NOT NULL").select(F.col("Key").alias("key"), F.coalesce(F.to_binary("Value", F.lit("base64")), F.lit(b"")).alias("value"))


def write_backup(view: DataFrame, path: str) -> None:
    encoded(view).write.mode("overwrite").json(f"{path}/records")


def read_backup(spark: SparkSession, path: str) -> DataFrame:
    """Records of a folder made by write_backup(), or of a file with one document; damaged text is an error."""
    if path.endswith(".json"):
        doc = spark.read.schema(DOCUMENT).json(path, multiLine=True, mode="FAILFAST")
        return decoded(doc.select(F.explode("records").alias("r")).select("r.*"))
    return decoded(spark.read.schema(LINE).json(f"{path}/records", mode="FAILFAST"))


def backup_document(view: DataFrame) -> DataFrame:
    """All records as one row (generated_at, record_count, records), for stores that fit in one document."""
    r = encoded(view).select(F.struct("Key", "Value").alias("r"))
    return r.agg(F.sort_array(F.collect_list("r")).alias("records")).select(
        F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("generated_at"), F.size("records").cast("long").alias("record_count"), "records"
    )
