"""A prompt over a store: put|set key words..., get key, del|rm key, scan first last, sql query, stats, help, exit|quit."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator

from pyspark.sql import SparkSession

from tidewell.plans.dialect import QueryError
from tidewell.sources.store import KVStore

SHOWN = 20
HELP = __doc__.split(": ", 1)[1].strip()


def answers(store: KVStore, lines: Iterable[str]) -> Iterator[str]:
    """What to print for each line, until exit or quit."""
    for line in lines:
        words = line.split()
        if not words:
            continue
        name = words[0].lower()
        if name in ("exit", "quit"):
            return
        try:
            yield _answer(store, name, words[1:], line)
        except (QueryError, ValueError, IndexError) as e:
            yield f"error: {e if isinstance(e, QueryError) else 'usage: ' + HELP}"


def _answer(store: KVStore, name: str, args: list[str], line: str) -> str:
    if name in ("put", "set"):
        if len(args) < 2:
            raise IndexError
        store.put(int(args[0]), " ".join(args[1:]))
        return "ok"
    if name == "get":
        found = store.get(int(args[0]))
        return "not found" if found is None else found.decode("utf-8", "replace")
    if name in ("del", "rm"):
        store.delete(int(args[0]))
        return "ok"
    if name == "scan":
        return _table(store.scan(int(args[0]), int(args[1])).selectExpr("key", "cast(value AS string)"))
    if name == "sql":
        return _table(store.sql(line.strip()[3:]))
    if name == "stats":
        return "\n".join(f"{k}: {v}" for k, v in store.stats().items())
    return HELP


def _table(df) -> str:
    """The first SHOWN rows, and how many more there are."""
    head = df.take(SHOWN + 1)
    out = [f"{r[0]}\t{r[1]}" for r in head[:SHOWN]]
    if len(head) > SHOWN:
        out.append(f"... and {df.count() - SHOWN} more")
    return "\n".join(out) or "nothing"


def main() -> None:
    spark = SparkSession.builder.appName("tidewell").getOrCreate()
    for text in answers(KVStore(spark, sys.argv[1] if len(sys.argv) > 1 else "data"), sys.stdin):
        print(text, flush=True)


if __name__ == "__main__":
    main()
