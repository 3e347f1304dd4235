"""The query dialect: SELECT * FROM table [WHERE id op int] [LIMIT n].

parse() gives a statement, plan() a DataFrame. Filters and limits are put in the logical plan, so the
key range reaches the Parquet scan and LIMIT becomes a top-k; nothing runs before an action.
"""

from __future__ import annotations

import operator
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import INT64_MAX, INT64_MIN

OPS: dict[str, Callable] = {"=": operator.eq, "!=": operator.ne, ">=": operator.ge, "<=": operator.le, ">": operator.gt, "<": operator.lt}
NAME = r"[A-Za-z_][A-Za-z0-9_]*"
GRAMMAR = re.compile(
    rf"SELECT\s+\*\s+FROM\s+(?P<table>{NAME})"
    rf"(?:\s+WHERE\s+(?P<field>{NAME})\s*(?P<op>{'|'.join(sorted(OPS, key=len, reverse=True))})\s*(?P<value>-?[0-9]+))?"
    r"(?:\s+LIMIT\s+(?P<limit>[0-9]+))?\s*;?\s*", re.IGNORECASE | re.ASCII,
)


class QueryError(ValueError):
    """A query that the dialect does not allow."""


@dataclass(frozen=True)
class Where:
    op: str
    value: int

    def matches(self, key):
        """Of an int a bool, of a column a column."""
        return OPS[self.op](key, self.value)


@dataclass(frozen=True)
class Select:
    table: str
    where: Where | None = None
    limit: int = -1

    def matches(self, key: int) -> bool:
        return self.where is None or self.where.matches(key)


def parse(query: str) -> Select:
    text = query.strip().removesuffix(";").strip()
    if not text:
        raise QueryError("empty query")
    m = GRAMMAR.fullmatch(text)
    if not m:
        raise QueryError("syntax: expected SELECT * FROM <table> [WHERE id <op> <int>] [LIMIT <n>]")
    where = None
    if m["field"]:
        if m["field"].lower() != "id":
            raise QueryError("only WHERE id is supported")
        value = int(m["value"])
        if not INT64_MIN <= value <= INT64_MAX:
            raise QueryError("invalid WHERE value")
        where = Where(m["op"], value)
    limit = -1 if m["limit"] is None else int(m["limit"])
    if limit > 2**31 - 1:
        raise QueryError("invalid LIMIT value")
    return Select(m["table"], where, limit)


def plan(stmt: Select, records: DataFrame, ordered: bool = True) -> DataFrame:
    """id, data of the records (key, value) of the statement's table, in key order."""
    out = records.select(F.col("key").cast("long").alias("id"), F.col("value").cast("string").alias("data"))
    if stmt.where is not None:
        out = out.where(stmt.where.matches(F.col("id")))
    if ordered or stmt.limit >= 0:
        out = out.orderBy("id")
    return out if stmt.limit < 0 else out.limit(stmt.limit)
