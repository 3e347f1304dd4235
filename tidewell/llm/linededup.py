"""Line dedup over content-defined chunks of lines and over pairs of lines.

Every line has a hash, and a rolling hash over the last WINDOW line hashes says where a chunk ends,
so that lines put in or taken out move only the borders near them. A second, overlapping chunking has
every two neighbouring lines that are not blank, with the blank ones between them, so that a repeated
run of lines is found wherever its chunks' borders lie. Digests of both are counted over all documents.
The bytes of chunks whose digest repeats are then compared (grouped with their digest as key and their
text as proof), the earliest by (doc_id, place) stays, the others go.

So every line goes that stands in a run of at least two lines that are not blank, if an earlier document
has that run; within a document only whole chunks are taken out as repeats. The earliest place of a line
never goes. The pair of lines where two repeated runs meet may go though it stands there first; each of
its lines then stands earlier.

Digests and places travel without texts; only chunks that repeat by digest are moved as texts, and
equal ones are merged before they are moved. The text itself is read again to cut chunks out.

Edge cases: a null text counts as empty and stays null; a chunk needs two lines that are not blank,
so a text of one line never loses it; blank lines are compared as they are, and those at the ends of
a repeated run may stay; rows of one doc_id with different texts are told apart by a
hash of the text, rows repeated whole get the same result; a null doc_id ranks last and all rows of
that id with the same text count as one; ties cannot occur beyond that; other columns stay as they
are, whatever their names, but for one named _removed, which is replaced; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import forget, identity, written

WINDOW, MEAN, LEAST = 2, 4, 2
#: What the rolling hash multiplies by.
STEP = 1099511628211
MASK = (1 << 64) - 1
BLANK = " \t\v\f\r"


def line_hash(line: str) -> int:
    return int.from_bytes(hashlib.md5(line.encode("utf-8", "replace"), usedforsecurity=False).digest()[8:], "little")


def chunks(text: str) -> list[tuple[int, int]]:
    """(first line, line after the last) of each chunk of the lines of text; together they are all lines."""
    lines = text.split("\n")
    hashes = [line_hash(x) for x in lines]
    out, begin = [], 0
    for i in range(len(lines)):
        if i + 1 - begin < LEAST:
            continue
        rolled = 0
        for h in hashes[i + 1 - WINDOW:i + 1]:
            rolled = (rolled * STEP + h) & MASK
        if (rolled >> 40) % MEAN == 0:
            out.append((begin, i + 1))
            begin = i + 1
    if begin < len(lines):
        if out and len(lines) - begin < LEAST:
            out[-1] = (out[-1][0], len(lines))
        else:
            out.append((begin, len(lines)))
    return out


def spans(text: str) -> list[tuple[str, list[tuple[int, int]]]]:
    """What stands at each place, and its (first line, line after the last): chunks with at least two lines that are not blank, then
    pairs of such lines. A pair has one place in a text, that of an equal chunk if there is one, and all its lines there."""
    lines = text.split("\n")
    full = [k for k, x in enumerate(lines) if x.strip(BLANK)]
    if len(full) < LEAST:
        return []
    out: list[tuple[str, list[tuple[int, int]]]] = []
    first: dict[str, int] = {}
    for a, b in chunks(text):
        if bisect_left(full, b) - bisect_left(full, a) >= LEAST:
            first.setdefault(chunk := "\n".join(lines[a:b]), len(out))
            out.append((chunk, [(a, b)]))
    for a, b in pairwise(full):
        k = first.setdefault(pair := "\n".join(lines[a:b + 1]), len(out))
        if k == len(out):
            out.append((pair, []))
        out[k][1].append((a, b + 1))
    return out


def multi_line(text: str) -> Iterator[tuple[int, str]]:
    """Place and text of the chunks and pairs of text."""
    if "\n" in text:
        for k, (chunk, _) in enumerate(spans(text)):
            yield k, chunk


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def line_dedup(docs: DataFrame) -> DataFrame:
    """docs with every column, text without repeated chunks, and _removed array<int>, the places of chunks and pairs taken out."""
    docs = docs.drop("_removed")
    rank, key = identity(docs)
    slim = docs.select(rank.alias("i"), key.alias("k"), F.col("text").cast("string").alias("text"))

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            i, k, d1, d2, at = [], [], [], [], []
            for x, y, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                for n, c in multi_line(t or ""):
                    d = xxhash.xxh3_128_intdigest(c.encode("utf-8", "replace"))
                    i.append(x), k.append(y), at.append(n), d1.append(_signed(d >> 64)), d2.append(_signed(d & MASK))
            yield pa.RecordBatch.from_arrays(
                [pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(at, pa.int32())],
                names=["d1", "d2", "i", "k", "at"],
            )

    table = written(slim.mapInArrow(digests, "d1 long, d2 long, i long, k long, at int"), "chunks")
    # the smallest and largest place say whether a chunk repeats: rows repeated whole are one place
    place = F.struct("i", "k", "at")
    # written, so that the join deals both sides anew and a digest with many rows can be split
    again = written(table.groupBy("d1", "d2").agg(F.min(place).alias("a"), F.max(place).alias("b")).where("a <> b").select("d1", "d2"), "again")
    suspects = written(table.join(again, ["d1", "d2"], "left_semi").groupBy("i", "k").agg(F.collect_set("at").alias("at")), "suspects")

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 256):
                p = b.slice(a, 256)
                i, k, at, out = [], [], [], []
                for x, y, t, found in zip(*(p.column(c).to_pylist() for c in range(4))):
                    found = set(found)
                    for n, c in multi_line(t):
                        if n in found:
                            i.append(x), k.append(y), at.append(n), out.append(c)
                yield pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(k, pa.int64()), pa.array(at, pa.int32()), pa.array(out, pa.string())], names=["i", "k", "at", "chunk"])

    # lists grow with the input: joined alike at every size, as files of some MB would be broadcast in small runs only
    parts = slim.join(suspects.hint("merge"), ["i", "k"]).select("i", "k", "text", "at").mapInArrow(texts, "i long, k long, at int, chunk string")
    parts = written(parts, "repeats")
    firsts = written(parts.groupBy("chunk").agg(F.min(F.struct("i", "k", "at")).alias("first")), "firsts")
    gone = (
        parts.join(firsts, "chunk").where(F.struct("i", "k", "at") != F.col("first"))
        .groupBy("i", "k").agg(F.array_sort(F.collect_set("at")).alias("_removed"))
    )
    gone = written(gone, "gone")
    for t in (table, again, parts, firsts):
        forget(t)
    keyed = docs.select(F.struct("*").alias("row"), rank.alias("i"), key.alias("k"))
    out = keyed.join(gone.hint("merge"), ["i", "k"], "left").select("row.*", F.coalesce("_removed", F.array().cast("array<int>")).alias("_removed"))
    at_text = docs.columns.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a in range(0, b.num_rows, 512):
                p = b.slice(a, 512)
                removed = p.column(p.num_columns - 1).to_pylist()
                if any(removed):
                    new = [without(t, r) if r else t for t, r in zip(p.column(at_text).to_pylist(), removed)]
                    cols = p.columns
                    cols[at_text] = pa.array(new, p.schema.field(at_text).type)
                    p = pa.RecordBatch.from_arrays(cols, schema=p.schema)
                yield p

    return out.mapInArrow(cut, out.schema)


def without(text: str, places: list[int]) -> str:
    found = spans(text)
    gone = {k for n in places for a, b in found[n][1] for k in range(a, b)}
    return "\n".join(x for k, x in enumerate(text.split("\n")) if k not in gone) if gone else text


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated chunks: what was taken out, and the text that is left."""
    out = line_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", F.size("_removed").cast("long").alias("n_removed"), F.array_join(F.col("_removed").cast("array<string>"), ",").alias("removed"),
        F.length(F.coalesce("text", F.lit(""))).cast("long").alias("kept_chars"), F.col("text").alias("kept_text"),
    )


#: flags: for each line 1 if a chunk may end with it. Pieces of them are chunks; pairs equal to a chunk of the text have its place.
ORACLE_SQL = rf"""
WITH l AS (
  SELECT doc_id, lines, list_filter(range(1, len(lines) + 1), lambda k: trim(lines[k], ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS full_, list_transform(lines, lambda x: md5_number_lower(x)::HUGEINT) AS h
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents)
), f AS (
  SELECT *, regexp_extract_all(array_to_string(list_transform(range(1, len(lines) + 1), lambda k: CASE WHEN k > 1 AND (h[k - 1] * {STEP}::HUGEINT + h[k]) % 18446744073709551616::HUGEINT // 1099511627776 % {MEAN} = 0 THEN '1' ELSE '0' END), ''), '[01][01]*?1|[01]+') AS r FROM l
), g AS (
  SELECT *, list_transform(CASE WHEN len(r) > 1 AND length(r[-1]) = 1 THEN list_concat(r[:-3], [r[-2] || r[-1]]) ELSE r END, lambda x: length(x)) AS sizes FROM f WHERE len(full_) >= 2
), cs AS (
  SELECT doc_id, q, array_to_string(lines[b - sizes[q] + 1:b], chr(10)) AS chunk, b - sizes[q] + 1 AS a, b FROM (SELECT *, list_sum(sizes[:q])::BIGINT AS b FROM (SELECT *, unnest(range(1, len(sizes) + 1)) AS q FROM g))
  WHERE len(list_filter(full_, lambda k: k BETWEEN b - sizes[q] + 1 AND b)) >= 2
), c AS (SELECT doc_id, chunk, a, b, row_number() OVER (PARTITION BY doc_id ORDER BY q) - 1 AS place FROM cs),
fc AS (SELECT doc_id, chunk, min(place) AS place FROM c GROUP BY ALL),
p AS (SELECT doc_id, array_to_string(lines[full_[q]:full_[q + 1]], chr(10)) AS chunk, full_[q] AS a, full_[q + 1] AS b FROM (SELECT *, unnest(range(1, len(full_))) AS q FROM g)),
pn AS (SELECT doc_id, chunk, coalesce(n, 0) + row_number() OVER (PARTITION BY doc_id ORDER BY first_) - 1 AS place FROM (SELECT doc_id, chunk, min(a) AS first_ FROM p ANTI JOIN fc USING (doc_id, chunk) GROUP BY ALL) LEFT JOIN (SELECT doc_id, count(*) AS n FROM c GROUP BY ALL) USING (doc_id)),
places AS (SELECT doc_id, chunk, place FROM c UNION ALL SELECT doc_id, chunk, place FROM pn),
covers AS (SELECT doc_id, place, a, b FROM c UNION ALL SELECT p.doc_id, place, a, b FROM p JOIN (SELECT * FROM fc UNION ALL SELECT * FROM pn) USING (doc_id, chunk)),
firsts AS (SELECT chunk, min((doc_id, place)) AS first_ FROM places GROUP BY chunk),
gone AS (SELECT doc_id, place FROM places JOIN firsts USING (chunk) WHERE (doc_id, place) <> first_),
cut AS (SELECT DISTINCT doc_id, unnest(range(a, b + 1)) AS k FROM gone JOIN covers USING (doc_id, place)),
kept AS (SELECT doc_id, array_to_string(list_transform(list_filter(range(1, len(lines) + 1), lambda k: NOT list_contains(ks, k)), lambda k: lines[k]), chr(10)) AS kept FROM l JOIN (SELECT doc_id, list(k) AS ks FROM cut GROUP BY doc_id) USING (doc_id)),
r AS (SELECT doc_id, count(*) AS n, string_agg(place::VARCHAR, ',' ORDER BY place) AS removed FROM gone GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_removed, coalesce(removed, '') AS removed, length(coalesce(kept, text, ''))::BIGINT AS kept_chars, coalesce(kept, text) AS kept_text
FROM documents LEFT JOIN r USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
