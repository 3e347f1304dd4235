"""Substring dedup by hashing units of text.

Texts are cut into lines, and these into sentences of at least `short` words (a shorter one is one with the
next); a sentence of more than LONG words is cut again, after words whose hash says so, into parts of at
least PART words. What is left at the end of a line, with fewer than `short` words, is no unit. A line of at
least `short` words is a unit as well. A unit is normalised (lower-case words joined by blanks) and hashed.
By default units have 8 words at least: shorter ones are the same by chance in texts that share nothing.

Digests are grouped over all documents. The earliest place of a unit, by doc_id and offset, keeps it;
every other place is removed, and nothing else is: a line goes with its line end, a sentence with the
blanks behind it. Removed spans keep their offsets in the original text, in code points; spans that touch
are one.

Digests and offsets travel without texts. A document's list of spans is never longer than itself; the text
is moved once, to meet its list.

Edge cases: a null text counts as empty and stays null; lines of fewer than `short` words are never removed;
rows of one doc_id with different texts are documents of their own, ordered by a hash of the text, and
rows repeated whole get the same result; a null doc_id ranks last; very long texts are cut as any other;
other columns stay as they are, whatever their names, but for one named _spans, which is replaced; an
empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import forget, fresh, identity, written

LONG, SHORT, PART = 32, 8, 8
WORD = re.compile(r"\w+")
TOKEN = re.compile(r"\W*\w+")


@cache
def sentence(short: int) -> re.Pattern:
    """`short` words, then up to marks that end a sentence and stand before a blank, with the blanks; or up to the line's end."""
    words = rf"[^\w\n]*\w+(?:[^\w\n]+\w+){{{short - 1}}}"
    return re.compile(words + r"[^.!?\n]*(?:[.!?]+[^.!?\x09\x0A-\x0D\x20][^.!?\n]*)*(?:[.!?]+[\x09\x0B-\x0D\x20]*)?")


def units(text: str, short: int = SHORT) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of the sentences of text and of their parts, in order; a line's begin where the line does."""
    cuts: dict[str, bool] = {}
    for m in sentence(short).finditer(text):
        words = WORD.findall(m[0].lower()) if m[0].isascii() else [w.lower() for w in WORD.findall(m[0])]
        if len(words) <= LONG:
            yield m.start(), m.end(), words
            continue
        begin, part = m.start(), []
        for n, (token, word) in enumerate(zip(TOKEN.finditer(text, m.start(), m.end()), words), 1):
            part.append(word)
            if len(part) >= PART and n < len(words):
                if word not in cuts:
                    cuts[word] = hashlib.md5(word.encode("utf-8", "replace"), usedforsecurity=False).hexdigest()[0] in "01"
                if cuts[word]:
                    yield begin, token.end(), part
                    begin, part = token.end(), []
        yield begin, m.end(), part


def places(text: str, short: int = SHORT) -> Iterator[tuple[int, int, list[str]]]:
    """(start, end, words) of all units with at least `short` words: sentences and parts, and lines with their line ends."""
    first, begin, line = -1, 0, []
    end = text.find("\n")
    end = len(text) if end < 0 else end

    def whole() -> Iterator[tuple[int, int, list[str]]]:
        tail = WORD.findall(text[last:end])
        if first >= 0:
            yield begin, min(end + 1, len(text)), line + [w.lower() for w in tail]

    last = 0
    for a, b, words in units(text, short):
        if a > end:
            yield from whole()
            begin, first, line = text.rfind("\n", 0, a) + 1, -1, []
            end = text.find("\n", a)
            end = len(text) if end < 0 else end
        first, last, line = a, b, line + words
        if len(words) >= short:
            yield a, b, words
    yield from whole()


def digest(words: list[str]) -> tuple[int, int]:
    d = xxhash.xxh3_128_intdigest(" ".join(words).encode("utf-8", "replace"))
    h = d >> 64
    return h - (1 << 64) if h >> 63 else h, (d & 0xFFFFFFFF) - (1 << 31)


def united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans in order, those that touch or overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def without(text: str, spans: list[tuple[int, int]]) -> str:
    keep, at = [], 0
    for a, b in spans:
        keep.append(text[at:a])
        at = b
    return "".join(keep) + text[at:]


def substring_dedup(docs: DataFrame, short: int = SHORT) -> DataFrame:
    """docs with every column, text without repeated units, and _spans array<struct<start, end>> of what was taken out."""
    docs = docs.drop("_spans")
    i, k = identity(docs)
    slim = docs.select(i.alias("i"), k.alias("k"), F.col("text").cast("string").alias("text"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                p = batch.slice(at, 256)
                cols: tuple[list, ...] = ([], [], [], [], [], [])
                for x, y, t in zip(*(p.column(c).to_pylist() for c in range(3))):
                    for a, b, words in places(t, short) if t else ():
                        for c, v in zip(cols, (*digest(words), x, y, a, b)):
                            c.append(v)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=["d1", "d2", "i", "k", "a", "b"])

    # every table is written, so that each join deals both sides anew and a digest or document with many rows can be split
    table = written(slim.mapInArrow(hashed, "d1 long, d2 int, i long, k long, a int, b int"), "units")
    again = written(table.groupBy("d1", "d2").agg(F.count("*").alias("n")).where("n > 1").select("d1", "d2"), "again")
    suspects = written(table.join(again, ["d1", "d2"]), "suspects")
    firsts = written(suspects.groupBy("d1", "d2").agg(F.min(F.struct("i", "k", "a")).alias("first")), "firsts")
    others = suspects.join(firsts, ["d1", "d2"]).where(F.struct("i", "k", "a") != F.col("first"))
    gone = written(others.groupBy("i", "k").agg(F.array_sort(F.collect_set(F.struct("a", "b"))).alias("gone")), "gone")
    for t in (table, again, suspects, firsts):
        forget(t)

    keyed = docs.select(F.struct("*").alias("row"), i.alias("i"), k.alias("k"))
    # the list grows with the input: joined alike at every size, as a file of some MB would be broadcast in small runs only
    out = keyed.join(gone.hint("merge"), ["i", "k"], "left").select("row.*", F.col("gone").alias(fresh(docs, "gone")))
    at, names = docs.columns.index("text"), [*docs.columns, "_spans"]
    schema = docs.selectExpr("*", "cast(null as array<struct<start:bigint,end:bigint>>) as _spans").schema
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for z in range(0, batch.num_rows, 256):
                p = batch.slice(z, 256)
                spans = [united([(x["a"], x["b"]) for x in s]) if s else [] for s in p.column(p.num_columns - 1).to_pylist()]
                cols = p.columns[:-1]
                if any(spans):
                    new = [without(t, s) if s else t for t, s in zip(cols[at].to_pylist(), spans)]
                    cols[at] = pa.array(new, p.schema.field(at).type)
                cols.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind))
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return out.mapInArrow(cut, schema)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without repeated units, with the offsets of what was taken out."""
    out = substring_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return out.select(
        "doc_id", F.size("_spans").cast("long").alias("n_spans"),
        F.aggregate("_spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"]).alias("removed_chars"),
        F.array_join(F.transform("_spans", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string"))), ",").alias("spans"),
        F.col("text").alias("kept_text"),
    )


#: Atoms are sentences, parts, what is left of a line, and its line end; a line that repeats takes all of its atoms.
ORACLE_SQL = r"""
WITH l AS (
  SELECT doc_id, text, n, line, CAST(sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY n) - length(line) - 1 AS BIGINT) AS begins, n = len(all_lines) AS is_last
  FROM (SELECT doc_id, text, all_lines, unnest(all_lines) AS line, unnest(range(1, len(all_lines) + 1)) AS n
    FROM (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS all_lines FROM documents))
), s AS (
  SELECT *, regexp_extract_all(line, '[^\p{L}\p{N}_]*[\p{L}\p{N}_]+(?:[^\p{L}\p{N}_]+[\p{L}\p{N}_]+){7}[^.!?]*(?:[.!?]+[^.!?\x09\x0A-\x0D\x20][^.!?]*)*(?:[.!?]+[\x09\x0B-\x0D\x20]*)?') AS ss FROM l
), e AS (
  SELECT doc_id, n, m, x, regexp_extract_all(x, '[^\p{L}\p{N}_]*[\p{L}\p{N}_]+') AS tokens
  FROM (SELECT doc_id, n, unnest(ss) AS x, unnest(range(1, len(ss) + 1)) AS m FROM s)
), f AS (
  SELECT doc_id, n, m, x, tokens, CASE WHEN len(tokens) <= 32 THEN [repeat('0', len(tokens))]
    ELSE regexp_extract_all(array_to_string(list_transform(tokens, lambda t: CASE WHEN md5(lower(regexp_extract(t, '[\p{L}\p{N}_]+'))) < '2' THEN '1' ELSE '0' END), ''), '[01]{7}[01]*?1|[01]+') END AS flags FROM e
), p AS (
  SELECT doc_id, n, m, q, CASE WHEN q = len(flags) THEN substr(x, length(array_to_string(tokens[:first - 1], '')) + 1) ELSE array_to_string(tokens[first:first + length(flags[q]) - 1], '') END AS x
  FROM (SELECT *, CAST(list_sum(list_transform(flags[:q - 1], lambda z: length(z))) AS BIGINT) AS before, coalesce(before, 0) + 1 AS first FROM (SELECT *, unnest(range(1, len(flags) + 1)) AS q FROM f))
), atoms AS (
  SELECT doc_id, n, m, q, x, false AS is_end FROM p
  UNION ALL SELECT doc_id, n, 1000000000, 1, substr(line, length(array_to_string(ss, '')) + 1), false FROM s WHERE length(line) > length(array_to_string(ss, ''))
  UNION ALL SELECT doc_id, n, 1000000000, 2, chr(10), true FROM s WHERE NOT is_last
), placed AS (
  SELECT *, sum(length(x)) OVER (PARTITION BY doc_id ORDER BY n, m, q) - length(x) AS a, regexp_extract_all(x, '[\p{L}\p{N}_]+') AS ws FROM atoms
), us AS (
  SELECT doc_id, n, a, lower(array_to_string(ws, ' ')) AS u, false AS whole FROM placed WHERE len(ws) >= 8 AND m < 1000000000
  UNION ALL SELECT doc_id, n, begins, lower(array_to_string(regexp_extract_all(line, '[\p{L}\p{N}_]+'), ' ')), true FROM s WHERE len(ss) > 0
), firsts AS (SELECT u, min((doc_id, a)) AS f FROM us GROUP BY u),
gone AS (SELECT doc_id, n, a, whole FROM us JOIN firsts USING (u) WHERE (doc_id, a) <> f),
marked AS (
  SELECT p.*, EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND g.whole AND g.n = p.n) OR (NOT is_end AND EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = p.doc_id AND NOT g.whole AND g.a = p.a AND length(p.x) > 0)) AS gone
  FROM placed p
), runs AS (
  SELECT *, sum(CASE WHEN gone AND coalesce(was, false) THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY n, m, q) AS run
  FROM (SELECT *, lag(gone) OVER (PARTITION BY doc_id ORDER BY n, m, q) AS was FROM marked)
), cuts AS (SELECT doc_id, CAST(min(a) AS BIGINT) AS a, CAST(max(a + length(x)) AS BIGINT) AS b FROM runs WHERE gone GROUP BY doc_id, run),
c AS (SELECT doc_id, count(*) AS n_spans, CAST(sum(b - a) AS BIGINT) AS removed_chars, string_agg(a || ':' || b, ',' ORDER BY a) AS spans FROM cuts GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(x, '' ORDER BY n, m, q) FILTER (WHERE NOT gone) AS kept FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(c.n_spans, 0) AS n_spans, coalesce(removed_chars, 0) AS removed_chars, coalesce(spans, '') AS spans,
  CASE WHEN d.text IS NOT NULL THEN coalesce(kept, '') END AS kept_text
FROM documents d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
