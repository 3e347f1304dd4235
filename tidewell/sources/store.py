"""A store of versioned records in Parquet: key BIGINT, value BINARY, seq BIGINT.

Every commit adds one folder of files sorted by key, with its number as seq, and then one manifest that
lists the folders in force; a manifest is a new file that is created or fails, so a commit is atomic and
two writers cannot both make the same one. A folder without a manifest is never read. Manifests keep the
key range of each folder, so scans and lookups skip folders as Parquet statistics skip row groups.

Folders have levels: a put adds one of level 0, and as soon as a level has as many as config.compaction they
are merged into one of the next level, so a record is written again once for each level, of which there are
as many as the logarithm of the puts. Newer folders never have a higher level, so merging a whole level keeps
their order; tombstones go when nothing older is left.

One writer at a time is assumed. Puts are durable when they return. An empty value deletes.
"""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tidewell.config import Config
from tidewell.functions.keys import INT64_MAX, INT64_MIN, encode3d, shard_col, table_range
from tidewell.operators import learned, merge, spatial, stats
from tidewell.plans.dialect import parse, plan
from tidewell.sources.backup import backup_document, read_backup, write_backup
from tidewell.sources.files import read_log, read_tables

SCHEMA = "key BIGINT, value BINARY, seq BIGINT"
ROWS_A_FILE = 4_000_000


class Conflict(RuntimeError):
    """Another writer has made the same commit."""


class KVStore:
    def __init__(self, spark: SparkSession, path: str, config: Config | None = None, auto_compact: bool = True):
        self.spark, self.path, self.config, self.auto = spark, path.rstrip("/"), config or Config(), auto_compact
        self.reads = self.writes = self.hits = self.memory_hits = 0
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at(f"{self.path}/manifest"))

    # manifests

    def _versions(self) -> list[int]:
        found = self._fs.listStatus(self._at(f"{self.path}/manifest"))
        names = [f.getPath().getName() for f in found]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self) -> dict:
        if not (all_ := self._versions()):
            return {"version": 0, "commit": 0, "folders": [], "epochs": {}, "merged": 0}
        text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(self._fs.open(self._at(f"{self.path}/manifest/{all_[-1]:012d}.json")), "UTF-8")
        return json.loads(text)

    def _publish(self, m: dict) -> None:
        target = self._at(f"{self.path}/manifest/{m['version']:012d}.json")
        part = self._at(f"{self.path}/manifest/.{m['version']:012d}-{time.time_ns()}.part")
        out = self._fs.create(part, False)
        out.write(bytearray(json.dumps(m).encode()))
        out.close()
        if self._fs.exists(target) or not self._fs.rename(part, target):
            self._fs.delete(part, False)
            raise Conflict(f"version {m['version']} of {self.path} exists")

    # reading

    def _read(self, folders: list[dict]) -> DataFrame:
        if not folders:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(*[f"{self.path}/{f['name']}" for f in folders])

    def records(self, first: int = INT64_MIN, last: int = INT64_MAX) -> DataFrame:
        """All versions in folders that may hold keys of a range."""
        found = [f for f in self.manifest()["folders"] if f["rows"] and f["lo"] <= last and first <= f["hi"]]
        return self._read(found)

    def view(self, first: int = INT64_MIN, last: int = INT64_MAX) -> DataFrame:
        """key, value of live records in a range, unordered."""
        r = self.records(first, last)
        if (first, last) != (INT64_MIN, INT64_MAX):
            r = r.where(F.col("key").between(first, last))
        return merge.live_view(r).select("key", "value")

    def scan(self, first: int, last: int) -> DataFrame:
        self.reads += 1
        return self.view(first, last).orderBy("key")

    def get(self, key: int) -> bytes | None:
        self.reads += 1
        row = self.view(key, key).head()
        self.hits += row is not None
        return bytes(row["value"]) if row else None

    def get_many(self, keys: DataFrame) -> DataFrame:
        self.reads += 1
        return merge.get_many(self.records(), keys).select("key", "value")

    def scan_box(self, box: spatial.Box, budget: int = 32) -> DataFrame:
        self.reads += 1
        ranges = spatial.z_ranges(box, budget)
        if not ranges:
            return spatial.scan_box(self.view(0, 0), box)
        return spatial.scan_box(self.view(ranges[0][0], ranges[-1][1]), box, budget)

    def sql(self, query: str) -> DataFrame:
        """id, data of a query in the dialect; a table is a range of keys, and WHERE id compares whole keys."""
        stmt = parse(query)
        self.reads += 1
        return plan(stmt, self.view(*table_range(stmt.table)))

    # writing

    def put_many(self, rows: DataFrame, *order: str | Column, epoch: tuple[str, int] | None = None) -> int:
        """Commits rows (key, value); of rows with one key the last by `order` counts, or as they come. Returns the commit's number.

        epoch: (source, number) of a stream's batch; one that is not newer than the last of its source is left out.
        """
        m = self.manifest()
        if epoch and m["epochs"].get(epoch[0], -1) >= epoch[1]:
            return m["commit"]
        commit = m["commit"] + 1
        rows = rows.select(F.col("key").cast("long"), F.coalesce(F.col("value").cast("binary"), F.lit(b"")).alias("value"), *[c for c in rows.columns if c not in ("key", "value")])
        one = merge.latest(rows, *order) if order else merge.latest(rows.withColumn("_at", F.monotonically_increasing_id()), "_at")
        folder = self._write(one.select("key", "value", F.lit(commit).cast("long").alias("seq")), f"delta/{commit:012d}-{time.time_ns()}")
        m["folders"].append(folder | {"level": 0})
        if epoch:
            m["epochs"][epoch[0]] = epoch[1]
        self._publish(m | {"version": m["version"] + 1, "commit": commit})
        self.writes += folder["rows"]
        if self.auto:
            self.tidy()
        return commit

    def _write(self, rows: DataFrame, name: str, files: int = 0) -> dict:
        if files:
            rows = rows.repartitionByRange(files, "key")
        seen = Observation()
        rows = rows.observe(seen, F.count(F.lit(1)).alias("rows"), F.min("key").alias("lo"), F.max("key").alias("hi"))
        rows.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{name}")
        return {"name": name, "rows": seen.get["rows"], "lo": seen.get["lo"], "hi": seen.get["hi"]}

    def put(self, key: int, value: bytes | str) -> int:
        value = value.encode() if isinstance(value, str) else value
        return self.put_many(self.spark.range(1).select(F.lit(key).cast("long").alias("key"), F.lit(bytearray(value)).alias("value")))

    def delete(self, key: int) -> int:
        return self.put(key, b"")

    def delete_many(self, keys: DataFrame) -> int:
        return self.put_many(keys.select("key", F.lit(b"").alias("value")))

    def put_point(self, x: int, y: int, z: int, data: bytes | str) -> int:
        """Stores data at a point and returns its key."""
        key = encode3d(x, y, z)
        self.put(key, data)
        return key

    # maintenance

    def tidy(self) -> int:
        """Merges every level that is full into one folder of the next; how many merges that took."""
        done, level = 0, 0
        while True:
            folders = self.manifest()["folders"]
            if sum(f["level"] == level for f in folders) >= self.config.compaction:
                self._merge([f for f in folders if f["level"] == level], level + 1)
                done += 1
            elif all(f["level"] <= level for f in folders):
                return done
            level += 1

    def _merge(self, chosen: list[dict], level: int, drop_tombstones: bool = True) -> None:
        """Replaces folders, which are neighbours in time, by one. Tombstones may go if no older folder is left."""
        m = self.manifest()
        names = {f["name"] for f in chosen}
        oldest = m["folders"] and m["folders"][0]["name"] in names
        found = [f for f in chosen if f["rows"]]
        rows = sum(f["rows"] for f in found)
        merged = merge.compact(self._read(found), drop_tombstones=drop_tombstones and bool(oldest)).select("key", "value", "seq")
        new = self._write(merged, f"base/{m['version'] + 1:012d}-{time.time_ns()}", max(1, -(-rows // ROWS_A_FILE))) | {"level": level}
        at = next((k for k, f in enumerate(m["folders"]) if f["name"] in names), 0)
        rest = [f for f in m["folders"] if f["name"] not in names]
        self._publish(m | {"version": m["version"] + 1, "folders": rest[:at] + [new] + rest[at:], "merged": m.get("merged", 0) + new["rows"]})

    def compact(self, drop_tombstones: bool = True) -> None:
        """Replaces all folders by one with a version of each key; nothing older is left, so tombstones may go."""
        folders = self.manifest()["folders"]
        self._merge(folders, max([1, *(f["level"] for f in folders)]), drop_tombstones)

    def checkpoint(self) -> None:
        """Merges what was written so far and trains the model for it."""
        self.compact(drop_tombstones=False)
        self.model()

    def vacuum(self) -> int:
        """Removes folders that the newest manifest does not name, and older manifests; how many folders went."""
        m, gone = self.manifest(), 0
        named = {f["name"] for f in m["folders"]}
        for kind in ("base", "delta", "model"):
            top = self._at(f"{self.path}/{kind}")
            for f in self._fs.listStatus(top) if self._fs.exists(top) else ():
                name = f"{kind}/{f.getPath().getName()}"
                if name not in named and name != f"model/{m['version']}":
                    gone += self._fs.delete(f.getPath(), True)
        for v in self._versions()[:-1]:
            self._fs.delete(self._at(f"{self.path}/manifest/{v:012d}.json"), False)
        return gone

    def reset(self) -> None:
        m = self.manifest()
        self._publish({"version": m["version"] + 1, "commit": m["commit"], "folders": [], "epochs": {}, "merged": 0})
        self.reads = self.writes = self.hits = 0
        self.vacuum()

    def log(self, first: int = INT64_MIN, last: int = INT64_MAX) -> DataFrame:
        """Versions of a range of keys that are not yet merged, in commit order."""
        found = [f for f in self.manifest()["folders"] if f["level"] == 0 and f["rows"] and f["lo"] <= last and first <= f["hi"]]
        return self._read(found).where(F.col("key").between(first, last)).orderBy("seq", "key")

    def pending(self, first: int = INT64_MIN, last: int = INT64_MAX) -> DataFrame:
        """key, value of what is not yet merged, the latest of each key, in key order; a tombstone is an empty value."""
        return merge.latest(self.log(first, last)).select("key", "value").orderBy("key")

    def backup(self, path: str) -> None:
        write_backup(self.view(), path)

    def backup_document(self) -> DataFrame:
        return backup_document(self.view())

    def restore(self, path: str) -> None:
        """Replaces everything by the records of a backup, which is read and written before anything old goes."""
        m, commit = self.manifest(), self.manifest()["commit"] + 1
        rows = merge.latest(read_backup(self.spark, path).withColumn("_at", F.monotonically_increasing_id()), "_at")
        folder = self._write(rows.select("key", "value", F.lit(commit).cast("long").alias("seq")), f"delta/{commit:012d}-{time.time_ns()}")
        self._publish({"version": m["version"] + 1, "commit": commit, "folders": [folder | {"level": 0}], "epochs": {}, "merged": 0})
        self.reads = self.hits = 0
        self.writes = folder["rows"]
        self.vacuum()

    def import_files(self, path: str) -> int:
        """Commits the records of a folder of sorted tables and logs: tables of level 1, then of level 0, by the time in their names, then logs by theirs."""
        tables = read_tables(self.spark, path).select("key", "value", (1 - F.col("level")).alias("rank"), F.coalesce("stamp", F.lit(0)).alias("stamp"), "place")
        logs = read_log(self.spark, path).select("key", "value", F.lit(2).alias("rank"), F.coalesce("stamp", F.lit(0)).alias("stamp"), F.col("seq").alias("place"))
        return self.put_many(tables.unionByName(logs), "rank", "stamp", "place")

    def ingest(self, n: int = 100_000, seed: int = 1) -> int:
        from tidewell.sources.ingest import synthetic

        return self.put_many(synthetic(self.spark, n, seed))

    # model

    def model(self, fanout: int = learned.FANOUT) -> DataFrame:
        """The model of the live records, kept for the manifest's version: shard, bucket, sums, slope, intercept."""
        path = f"{self.path}/model/{self.manifest()['version']}"
        if not self._fs.exists(self._at(f"{path}/_SUCCESS")):
            learned.train(self._placed(), "shard", fanout=fanout).write.mode("overwrite").parquet(path)
        return self.spark.read.parquet(path)

    def _placed(self) -> DataFrame:
        keys = self.view().select("key", "value", shard_col("key", self.config.shards).alias("shard"))
        return learned.positions(keys, "shard")

    def get_learned(self, keys: DataFrame) -> DataFrame:
        """key, value of live records of keys, each looked for in the window of places that the model gives."""
        found = self._found()
        wanted = keys.select(F.col("key").cast("long").alias("key")).distinct()
        at = learned.window_lookup(found.join(wanted, "key"), learned.error_bounds(found, "shard"), "shard")
        return at.where(F.col("pos").between(F.col("first"), F.col("last"))).select("key", "value")

    def _found(self) -> DataFrame:
        return learned.predict(self._placed(), self.model(), "shard")

    def diagnostics(self) -> DataFrame:
        return learned.diagnostics(self._found(), "shard")

    def heatmap(self) -> DataFrame:
        return learned.heatmap(self._found())

    def export_model(self, path: str) -> None:
        """The diagnostics as CSV with a header."""
        names = {"key": "Key", "real_pos": "RealPos", "predicted_pos": "PredictedPos", "error": "Error"}
        self.diagnostics().withColumnsRenamed(names).write.mode("overwrite").csv(path, header=True)

    def benchmark(self, lookups: int = 50_000) -> dict:
        found = self._found()
        return learned.benchmark(found, learned.error_bounds(found, "shard"), "shard", lookups=lookups)

    # reports

    def stats(self) -> dict:
        m = self.manifest()
        delta = [f for f in m["folders"] if f["level"] == 0]
        size: Callable[[dict], int] = lambda f: self._fs.getContentSummary(self._at(f"{self.path}/{f['name']}")).getLength()
        files: Callable[[dict], int] = lambda f: sum(x.getPath().getName().endswith(".parquet") for x in self._fs.listStatus(self._at(f"{self.path}/{f['name']}")))
        counts = [files(f) for f in m["folders"]]
        return {
            "pending_record_count": sum(f["rows"] for f in delta), "learned_indexes_count": int(self._fs.exists(self._at(f"{self.path}/model/{m['version']}/_SUCCESS"))),
            "delta_file_count": sum(n for n, f in zip(counts, m["folders"]) if f["level"] == 0), "base_file_count": sum(n for n, f in zip(counts, m["folders"]) if f["level"] > 0),
            "file_count": sum(counts), "read_count": self.reads, "write_count": self.writes, "hit_count": self.hits,
            "shards_active": self.config.shards, "pending_writes": 0, "log_size_bytes": sum(map(size, delta)),
            "rw_ratio": stats.ratio(self.reads, self.writes), "mode": "base and deltas with learned positions",
        }

    def metrics_text(self) -> str:
        return stats.metrics_text(self.stats())

    def health(self) -> dict:
        self.manifest()
        return {"status": "ok"}
