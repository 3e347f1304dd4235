"""Boxes over Z-ordered keys: a cover of key ranges that prunes the scan, then the exact test."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.keys import CODES, SIDE, decode3d_col, encode3d_col


@dataclass(frozen=True)
class Box:
    """Inclusive bounds on each axis."""

    x: tuple[int, int]
    y: tuple[int, int]
    z: tuple[int, int]

    @property
    def axes(self) -> tuple[tuple[int, int], ...]:
        return self.x, self.y, self.z

    def has(self, x: int, y: int, z: int) -> bool:
        return all(a <= v <= b for v, (a, b) in zip((x, y, z), self.axes))


def coalesced(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Inclusive ranges in order, joined where they touch or overlap."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1] + 1:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def z_ranges(box: Box, budget: int | None = None) -> list[tuple[int, int]]:
    """Key ranges that cover a box: exactly, or at most about `budget` ranges that may cover more.

    Cubes of a level are split together, the level below only if the budget allows, so a coarse
    cover is even. An empty box has no range.
    """
    if any(a > b or b < 0 or a >= SIDE for a, b in box.axes):
        return []
    whole: list[tuple[int, int]] = []
    border, side, cells = [(0, 0, 0, 0)], SIDE, CODES
    while border:
        inner, edge = [], []
        for code, *corner in border:
            spans = [(c, c + side - 1) for c in corner]
            if all(a <= c and d <= b for (a, b), (c, d) in zip(box.axes, spans)):
                inner.append((code, code + cells - 1))
            elif all(c <= b and a <= d for (a, b), (c, d) in zip(box.axes, spans)):
                edge.append((code, *corner))
        whole += inner
        if budget is not None and len(coalesced(whole + [(c[0], c[0] + cells - 1) for c in edge])) > budget // 4 and edge:
            return _at_most(coalesced(whole + [(c[0], c[0] + cells - 1) for c in edge]), budget)
        side, cells = side // 2, cells // 8
        border = [
            (code + k * cells, x + (k & 1) * side, y + (k >> 1 & 1) * side, z + (k >> 2) * side)
            for code, x, y, z in edge for k in range(8)
        ]
    return coalesced(whole)


def _at_most(ranges: list[tuple[int, int]], n: int) -> list[tuple[int, int]]:
    """Joins neighbours over the smallest gaps until there are at most n ranges."""
    if len(ranges) <= n:
        return ranges
    gaps = sorted(range(1, len(ranges)), key=lambda k: ranges[k][0] - ranges[k - 1][1], reverse=True)
    cuts = sorted(gaps[: n - 1])
    return [(ranges[a][0], ranges[b - 1][1]) for a, b in zip([0, *cuts], [*cuts, len(ranges)])]


def in_box(box: Box, x: Column, y: Column, z: Column) -> Column:
    return reduce(lambda a, b: a & b, [c.between(*r) for c, r in zip((x, y, z), box.axes)])


def scan_box(records: DataFrame, box: Box, budget: int = 32) -> DataFrame:
    """Records (key, ...) whose Z-order key is in a box, with x, y, z, in key order.

    The ranges become one pushed-down OR of BETWEENs; the decoded coordinates decide.
    """
    ranges = z_ranges(box, budget)
    near = reduce(lambda a, b: a | b, [F.col("key").between(a, b) for a, b in ranges], F.lit(False))
    points = records.where(near).withColumns(decode3d_col("key"))
    return points.where(in_box(box, F.col("x"), F.col("y"), F.col("z"))).orderBy("key")


def points(df: DataFrame, x: Column | str, y: Column | str, z: Column | str, data: Column | str) -> DataFrame:
    """Records (key, value) of points; a coordinate out of range is an error."""
    return df.select(encode3d_col(x, y, z).alias("key"), (F.col(data) if isinstance(data, str) else data).cast("binary").alias("value"))


def coalesce_ranges(ranges: DataFrame, *group: str) -> DataFrame:
    """coalesced() for a DataFrame of (a, b) ranges in each group: gaps and islands by windows, so groups stay distributed."""
    order = Window.partitionBy(*group).orderBy("a", "b")
    before = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = ranges.withColumn("_new", F.when(before.isNull() | (F.col("a") > before + 1), 1).otherwise(0))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*group, "_island").agg(F.min("a").alias("a"), F.max("b").alias("b")).drop("_island")
