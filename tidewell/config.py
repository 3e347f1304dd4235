"""Settings of a store, from a dict or a YAML/JSON file; values that make no sense fall back to the defaults."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Config:
    path: str = "data"
    shards: int = 16
    flush: int = 2000
    compaction: int = 4
    batch: int = 500
    buffer: int = 5000
    bloom_size: int = 100_000
    bloom_rate: float = 0.01

    @classmethod
    def of(cls, values: dict) -> Config:
        """values: flat, or nested in sections as in the sample files."""
        flat: dict = {}
        for k, v in values.items():
            flat |= v if isinstance(v, dict) else {k: v}
        names = {"shard_count": "shards", "memtable_flush_threshold": "flush", "compaction_threshold": "compaction", "wal_batch_size": "batch", "wal_buffer_size": "buffer", "bloom_false_prob": "bloom_rate"}
        out = cls()
        for k, v in flat.items():
            k = names.get(k, k)
            if k in {f.name for f in fields(cls)}:
                ok = isinstance(v, str) and v if k == "path" else isinstance(v, (int, float)) and v > 0
                if ok and not (k == "bloom_rate" and v >= 1):
                    out = replace(out, **{k: v})
        return out

    @classmethod
    def load(cls, path: str = "", defaults: tuple[str, ...] = ("configs/store.yaml", "store.yaml")) -> Config:
        """The file named, which must exist; else the first default there is; else the defaults."""
        for p in (path,) if path else defaults:
            if path or Path(p).exists():
                return cls.of(_parsed(Path(p).read_text()))
        return cls()


def _parsed(text: str) -> dict:
    if text.lstrip().startswith("{"):
        return json.loads(text)
    out: dict = {}
    section = out
    for line in text.splitlines():
        body = line.split("#")[0].rstrip()
        if not body.strip():
            continue
        key, _, value = body.strip().partition(":")
        value = value.strip().strip("'\"")
        if not value:
            section = out.setdefault(key, {})
            continue
        number = float(value) if value.replace(".", "", 1).replace("e-", "", 1).lstrip("-").isdigit() else None
        where = section if body[0] == " " else out
        where[key] = value if number is None else int(number) if number.is_integer() and "." not in value else number
    return out
