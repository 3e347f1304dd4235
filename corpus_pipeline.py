"""A corpus pipeline: rejects low quality, takes out repeated lines, keeps one of each near-duplicate group,
drops documents with benchmark items, and encodes the rest.

STAGES names the stages in order; each takes (spark, docs, sf_dir) and returns a DataFrame. All but the
last return the columns of documents. None of them looks at labels, languages or sources for a decision,
other than the quality classifier's fit on labels.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm import decontaminate, linededup, neardup, pieces, quality
from tidewell.llm.common import ship_code, with_code, written

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it is fitted on labelled documents of this input."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_good(docs.select(*COLUMNS), model)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the chunks of lines that an earlier one has; those of which nothing is left go."""
    out = linededup.line_dedup(docs.select(*COLUMNS))
    emptied = (F.size("_removed") > 0) & (F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) == "")
    return out.where(~emptied).select("doc_id", "text", "lang", "source", F.when(F.size("_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast("long").alias("n_chars"))


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (shingles of five words, similarity 0.8)."""
    return neardup.keep_one(docs.select(*COLUMNS))


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    return decontaminate.drop_contaminated(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, the ids of the text, and their number."""
    return pieces.encode(docs).select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids")


STAGES = [
    ("quality", with_code(good_quality)),
    ("line_dedup", with_code(without_repeated_lines)),
    ("near_dedup", with_code(one_of_each)),
    ("decontaminate", with_code(without_benchmark)),
    ("encode", with_code(encoded)),
]

#: Nearest-neighbour votes, edit distances and piece ids have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    ship_code(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
