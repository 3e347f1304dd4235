"""Benchmark decontamination by pigeonhole edit matching.

Texts are reduced to lower-case words joined by single blanks, with a blank at both ends, so that a match
pays for borders that are no word borders. A test item of n characters has an error budget of
n // PER_ERROR edits; cut into one piece more than that, it cannot occur within the budget without one
piece intact. All pieces are searched at once (Aho-Corasick); around each exact hit, Myers' bit-parallel
distance decides whether the item occurs with at most the budgeted edits. The rule is the same for items
of every length: one of under PER_ERROR characters must stand as whole words, without an edit.

The items are read in blocks of at most `block_chars` characters, a block at a time: each is broadcast,
searched in one pass over the rows, and forgotten before the next. Passes write their rows to the shared
folder, with what was found so far, so a benchmark of any size takes bounded memory. Every document is
one row and never meets another.

Edge cases: null and empty texts match nothing; items without words match nothing; repeated items are
reported each; rows that share an id stay apart and repeated rows get the same result; long texts are
read whole; other columns are kept by drop_contaminated and ignored elsewhere; empty tables give no
matches. `least_chars` leaves out shorter items, as a benchmark of single common words marks everything;
by default none is left out.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.llm.common import forget, written

PER_ERROR = 12
BLOCK_CHARS = 4_000_000
WORD = re.compile(r"\w+")


def reduced(text: str | None) -> str:
    return " ".join(WORD.findall((text or "").lower()))


def padded(words: str) -> str:
    """A reduced text with a blank at both ends."""
    return f" {words} "


def budget(item: str, per_error: int = PER_ERROR) -> int:
    """Edits allowed for a padded item; none where per_error is 0."""
    return (len(item) - 2) // per_error if per_error else 0


def pieces(item: str, per_error: int = PER_ERROR) -> list[tuple[int, str]]:
    """Offset and text of budget + 1 pieces that make up a padded item."""
    n = budget(item, per_error) + 1
    cuts = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """The least edit distance between pattern and any substring of text, and the (first) end of such a substring."""
    m = len(pattern)
    eq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    mask, top = (1 << m) - 1, 1 << m - 1
    pv, mv, score, best, at = mask, 0, m, m, 0
    for j, c in enumerate(text, 1):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = mv | ~(xh | pv), pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
            if score < best:
                best, at = score, j
        ph, mh = ph << 1, mh << 1
        pv, mv = (mh | ~(xv | ph)) & mask, ph & xv & mask
    return best, at


class Finder:
    """Finds the items of one block in reduced texts."""

    def __init__(self, items: list[tuple[int, str]], least_chars: int = 0, per_error: int = PER_ERROR):
        self.per_error = per_error
        self.items = [(i, padded(t)) for i, t in ((i, reduced(t)) for i, t in items) if t and len(t) >= least_chars]
        self.auto = ahocorasick.Automaton()
        where: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for a, p in pieces(t, per_error):
                where.setdefault(p, []).append((k, a))
        for p, at in where.items():
            self.auto.add_word(p, (len(p), at))
        if where:
            self.auto.make_automaton()
        self.any = bool(where)

    def find(self, text: str) -> list[tuple[int, int]]:
        """(item id, distance) of every item that occurs in a reduced text."""
        if not self.any or not text:
            return []
        text, out = padded(text), []
        windows: dict[int, list[tuple[int, int]]] = {}
        for end, (n, at) in self.auto.iter(text):
            for k, a in at:
                begin, item = end + 1 - n - a, self.items[k][1]
                room = budget(item, self.per_error)
                windows.setdefault(k, []).append((begin - room, begin + len(item) + room))
        for k, spans in windows.items():
            item = self.items[k][1]
            most, best = budget(item, self.per_error), None
            spans.sort()
            a, b = spans[0]
            for c, d in (*spans[1:], (1 << 60, 0)):
                if c <= b:
                    b = max(b, d)
                    continue
                part = text[max(0, a):b]
                score = 0 if item in part else myers(item, part)[0]
                best = score if best is None else min(best, score)
                if best == 0:
                    break
                a, b = c, d
            if best <= most:
                out.append((self.items[k][0], best))
        return sorted(out)


def blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[int, str]]]:
    """The items in blocks of at most block_chars characters (an item longer than that is a block), one at a time."""
    block, room = [], 0
    rows = benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").orderBy("item_id", "text")
    for r in rows.toLocalIterator():
        if block and room + len(r[1]) > block_chars:
            yield block
            block, room = [], 0
        block.append((r[0], r[1]))
        room += len(r[1])
    if block:
        yield block


def _passes(docs: DataFrame, benchmark: DataFrame, block_chars: int, least_chars: int, per_error: int, make, kept: list[str]) -> DataFrame:
    """docs after a pass for each block; the last returns the columns `kept`.

    make: from a batch, what is found in each of its texts and the names of columns wanted to a batch of these.
    """
    spark, at = docs.sparkSession, docs.columns.index("text")
    todo = blocks(benchmark, block_chars)
    block = next(todo, None)
    while block is not None:
        shared, ahead = spark.sparkContext.broadcast(block), next(todo, None)
        names = docs.columns if ahead is not None else kept

        def run(batches: Iterator[pa.RecordBatch], shared=shared, names=names) -> Iterator[pa.RecordBatch]:
            f = Finder(shared.value, least_chars, per_error)
            for b in batches:
                for a in range(0, b.num_rows, 512):
                    part = b.slice(a, 512)
                    yield make(part, [f.find(reduced(t)) for t in part.column(at).to_pylist()], names)

        before, docs, block = docs, docs.mapInArrow(run, docs.select(*names).schema), ahead
        if block is not None:  # the last pass is left to the caller's plan
            docs = written(docs, "searched")
            shared.destroy()
            if hasattr(before, "_tidewell_path"):
                forget(before)
    return docs.select(*kept)


def match_benchmark(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, least_chars: int = 0, per_error: int = PER_ERROR) -> DataFrame:
    """doc_id, items array<struct<item_id, distance>> for every row of docs."""
    kind = "array<struct<item_id:long,distance:int>>"
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.array().cast(kind).alias("items"), F.col("text").cast("string").alias("text"))
    arrow = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32())]))

    def make(part: pa.RecordBatch, found: list, names: list[str]) -> pa.RecordBatch:
        items = [old + [{"item_id": i, "distance": s} for i, s in x] for old, x in zip(part.column(1).to_pylist(), found)]
        return pa.RecordBatch.from_arrays([part.column(0), pa.array(items, arrow), *part.columns[2:len(names)]], names=names)

    out = _passes(d, benchmark, block_chars, least_chars, per_error, make, ["doc_id", "items"])
    return out.select("doc_id", F.array_sort("items").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, block_chars: int = BLOCK_CHARS, least_chars: int = 0, per_error: int = PER_ERROR) -> DataFrame:
    """The rows of docs, with all their columns, in which no benchmark item occurs."""
    make = lambda part, found, _: part.filter(pa.array([not f for f in found], pa.bool_()))
    return _passes(docs, benchmark, block_chars, least_chars, per_error, make, docs.columns)


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which benchmark items occur in each whole document, and how closely."""
    found = match_benchmark(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select(
        "doc_id", (F.size("items") > 0).alias("contaminated"), F.size("items").cast("long").alias("n_items"),
        F.col("items.item_id").alias("item_ids"), F.array_min(F.col("items.distance")).cast("long").alias("least_distance"),
    )
