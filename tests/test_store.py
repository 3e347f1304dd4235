import json
import struct
import zlib

import pytest

from tidewell.config import Config
from tidewell.functions.keys import table_range
from tidewell.operators.spatial import Box
from tidewell.sources.files import SST_MAGIC, read_log, read_tables
from tidewell.sources.store import Conflict, KVStore
from tidewell.streaming.ingest import stream_put


@pytest.fixture
def store(spark, tmp_path):
    return KVStore(spark, str(tmp_path / "kv"), Config(compaction=100))


def kv(df):
    return [(r.key, bytes(r.value)) for r in df.collect()]


def frame(spark, *rows):
    return spark.createDataFrame(list(rows), "key long, value binary")


def test_overwrite_delete_and_reopen(spark, store):
    store.put(1, "v1"), store.put(1, "v2"), store.put(2, "alive"), store.delete(2), store.put(-7, "minus")
    for s in (store, KVStore(spark, store.path), KVStore(spark, store.path)):
        assert s.get(1) == b"v2" and s.get(2) is None and s.get(99) is None and s.get(-7) == b"minus"
    assert store.stats()["read_count"] == 4 and store.stats()["hit_count"] == 2 and store.stats()["write_count"] == 5
    store.compact()
    assert kv(store.scan(-100, 100)) == [(-7, b"minus"), (1, b"v2")]
    store.put(1, "v3"), store.delete(-7)
    assert kv(store.scan(-100, 100)) == [(1, b"v3")]
    assert store.log().count() == 2 and store.vacuum() > 0 and kv(store.scan(-100, 100)) == [(1, b"v3")]


def test_compaction_starts_by_itself(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "kv"), Config(compaction=2))
    s.put_many(frame(spark, (1, b"old"), (2, b"alive")))
    s.put_many(frame(spark, (1, b"new"), (2, b""), (3, b"v3")))
    assert [f["level"] for f in s.manifest()["folders"]] == [1]
    assert kv(s.scan(0, 9)) == [(1, b"new"), (3, b"v3")]


def test_rows_written_again_grow_with_the_logarithm(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "kv"), Config(compaction=3))
    for k in range(40):
        s.put_many(frame(spark, *((100 * k + j, b"v%d" % k) for j in range(5)), (7, b"" if k == 39 else b"%d" % k)))
        assert all(sum(f["level"] == l for f in s.manifest()["folders"]) < 3 for l in range(9))
    m = s.manifest()
    levels = [f["level"] for f in m["folders"]]
    assert levels == sorted(levels, reverse=True) and max(levels) == 3  # 40 = 1111 in base 3
    assert m["merged"] <= 40 * 6 * 3  # at most once for each level
    assert s.get(7) is None and s.get(3901) == b"v39" and s.get(0) == b"v0" and s.view().count() == 200
    s.compact()
    assert s.view().count() == 200 and len(s.manifest()["folders"]) == 1


def test_tombstones_stay_while_older_folders_are_left(spark, tmp_path):
    s = KVStore(spark, str(tmp_path / "kv"), Config(compaction=2))
    s.put(1, "a"), s.put(2, "b")
    s.delete(1), s.put(3, "c")
    assert s.get(1) is None and kv(s.scan(0, 9)) == [(2, b"b"), (3, b"c")]
    assert [f["level"] for f in s.manifest()["folders"]] == [2] and s.records().count() == 2


def test_damaged_backup_loses_nothing(spark, store, tmp_path):
    store.put(1, "kept")
    (tmp_path / "bad.json").write_text('{"generated_at": "x", "record_count": 1, "records": [{"Key": 5, "Value": "%%%"}]}')
    (tmp_path / "cut.json").write_text('{"generated_at": "x", "record_count": 1, "records": [{"Key": 5, "Va')
    (tmp_path / "lines" / "records").mkdir(parents=True)
    (tmp_path / "lines" / "records" / "part.json").write_text('{"Key": 5, "Value": "aGk="}\n{"Key": 6, "Va')
    for name in ("bad.json", "cut.json", "lines"):
        with pytest.raises(Exception):
            store.restore(str(tmp_path / name))
    with pytest.raises(Exception):
        store.restore(str(tmp_path / "missing"))
    assert store.get(1) == b"kept"


def test_last_row_of_an_unordered_batch_counts(spark, store):
    store.put_many(spark.createDataFrame([(k % 7, b"%d" % k) for k in range(700)], "key long, value binary").repartition(1))
    got = {k: int(v) for k, v in kv(store.scan(0, 9))}
    assert len(got) == 7
    store.put_many(spark.createDataFrame([(1, b"a"), (1, b"b"), (2, b"x"), (1, b"c")], "key long, value binary").coalesce(1))
    assert store.get(1) == b"c"
    assert [(r.key, bytes(r.value)) for r in store.pending(2, 2).collect()] == [(2, b"x")]


def test_import_of_files(spark, store, tmp_path):
    from tidewell.sources.files import log_entry, sorted_table, write_file

    write_file(spark, str(tmp_path / "f/shard-0-l1-9.sst"), sorted_table([(1, b"one"), (2, b"two"), (3, b"three")]))
    write_file(spark, str(tmp_path / "f/shard-0-l0-5.sst"), sorted_table([(2, b"newer"), (3, b"newer")]))
    write_file(spark, str(tmp_path / "f/x.wal"), log_entry(3, b"") + log_entry(4, b"four"))
    store.import_files(str(tmp_path / "f"))
    assert kv(store.scan(0, 9)) == [(1, b"one"), (2, b"newer"), (4, b"four")]


def test_checkpoint_and_model(spark, store):
    store.put_many(frame(spark, (10, b"ten"), (11, b"eleven")))
    store.checkpoint()
    again = KVStore(spark, store.path)
    assert again.get(10) == b"ten" and again.get(11) == b"eleven" and again.log().count() == 0
    assert again.stats()["learned_indexes_count"] == 1 and again.diagnostics().count() == 2 and again.heatmap().count() == 2


def test_backup_reset_restore(spark, store, tmp_path):
    store.put_many(frame(spark, (100, b"a"), (101, b"b\xff")))
    store.backup(str(tmp_path / "b"))
    doc = store.backup_document().first()
    assert doc.record_count == 2 and doc.records[0].Key == 100
    store.reset()
    assert store.get(100) is None
    store.restore(str(tmp_path / "b"))
    assert kv(store.scan(0, 999)) == [(100, b"a"), (101, b"b\xff")]
    (tmp_path / "one.json").write_text(json.dumps({"generated_at": "x", "record_count": 1, "records": [{"Key": 5, "Value": "aGk="}]}, indent=1))
    store.restore(str(tmp_path / "one.json"))
    assert kv(store.scan(0, 999)) == [(5, b"hi")]


def test_sql(spark, store):
    a, b = table_range("users")
    store.put_many(frame(spark, (a + 1, b"a"), (a + 2, b"b"), (a + 3, b"c"), (b + 1, b"outside")))
    got = store.sql(f"SELECT * FROM Users WHERE id >= {a + 2} LIMIT 2").collect()
    assert [(r.id, r.data) for r in got] == [(a + 2, "b"), (a + 3, "c")]
    assert store.sql("SELECT * FROM users").count() == 3 and store.sql("SELECT * FROM nothing_here").count() == 0


def test_points_ingest_export_benchmark(spark, store, tmp_path):
    key = store.put_point(1, 2, 3, "p")
    assert [r.key for r in store.scan_box(Box((0, 4), (0, 4), (0, 4))).collect()] == [key]
    assert store.scan_box(Box((4, 0), (0, 1), (0, 1))).count() == 0
    store.reset()
    store.ingest(500)
    assert store.view().count() == 500
    store.export_model(str(tmp_path / "csv"))
    assert spark.read.csv(str(tmp_path / "csv"), header=True).columns == ["Key", "RealPos", "PredictedPos", "Error"]
    assert store.benchmark(100)["lookups"] > 0 and "_reads_total" in store.metrics_text() and store.health() == {"status": "ok"}


def test_one_commit_wins(spark, store):
    other = KVStore(spark, store.path)
    m = other.manifest()
    store.put(1, "x")
    with pytest.raises(Conflict):
        other._publish(m | {"version": m["version"] + 1})
    assert store.get(1) == b"x"


def test_last_row_of_a_batch_by_order(spark, store):
    rows = spark.createDataFrame([(1, b"b", 2), (1, b"a", 1), (1, b"c", 3)], "key long, value binary, at int")
    store.put_many(rows, "at")
    assert store.get(1) == b"c"
    store.delete_many(frame(spark, (1, b"")))
    assert store.get(1) is None
    assert store.get_many(frame(spark, (1, b""))).count() == 0


def test_stream_commits_once(spark, store, tmp_path):
    frame(spark, (1, b"a"), (2, b"b")).write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("key long, value binary").parquet(str(tmp_path / "in"))
    stream_put(store, src, str(tmp_path / "cp"), once=True).awaitTermination()
    assert kv(store.scan(0, 9)) == [(1, b"a"), (2, b"b")]
    commit = store.manifest()["commit"]
    assert store.put_many(frame(spark, (1, b"again")), epoch=("stream", 0)) == commit and store.get(1) == b"a"


def test_sorted_tables_and_logs(spark, tmp_path):
    recs = [(4294967297, b"one"), (-2, b""), (7, b"x" * 300)]
    body = b"".join(struct.pack("<qi", k, len(v)) + v for k, v in recs)
    index = struct.pack("<i", 1) + struct.pack("<qq", recs[0][0], 0)
    (tmp_path / "shard-3-l0-17.sst").write_bytes(body + index + struct.pack("<qQ", len(body), SST_MAGIC))
    (tmp_path / "shard-3-9.sst").write_bytes(struct.pack("<iqQ", 0, 0, SST_MAGIC))
    got = read_tables(spark, str(tmp_path)).orderBy("place").collect()
    assert [(r.key, bytes(r.value), r.shard, r.level, r.stamp) for r in got] == [(k, v, 3, 0, 17) for k, v in recs]
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "shard-1-l1-2.sst").write_bytes(b"nothing like it at all")
    with pytest.raises(Exception, match="not a sorted table"):
        read_tables(spark, str(tmp_path / "bad")).collect()

    def entry(k, v, spoil=0):
        rest = struct.pack("<qI", k, len(v)) + v
        return struct.pack("<IQ", zlib.crc32(rest) ^ spoil, 123) + rest

    (tmp_path / "a.wal").write_bytes(entry(1, b"one") + entry(2, b"two") + entry(3, b"three", 1) + entry(4, b"four"))
    assert [(r.key, bytes(r.value)) for r in read_log(spark, str(tmp_path / "a.wal")).orderBy("seq").collect()] == [(1, b"one"), (2, b"two")]


def test_config(tmp_path):
    assert Config.load(defaults=()) == Config() and Config().shards == 16 and Config().flush == 2000
    f = tmp_path / "c.yaml"
    f.write_text("system:\n  shard_count: 8  # few\nstorage:\n  path: \"x\"\n  memtable_flush_threshold: 1000\n  compaction_threshold: 3\n  wal_batch_size: 200\n  wal_buffer_size: -1\n")
    c = Config.load(str(f))
    assert (c.shards, c.flush, c.compaction, c.batch, c.path, c.buffer) == (8, 1000, 3, 200, "x", 5000)
    with pytest.raises(OSError):
        Config.load(str(tmp_path / "missing.yaml"))
