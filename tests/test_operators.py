import random

import pytest
from pyspark.sql import functions as F

from tidewell.functions import keys as K
from tidewell.operators import learned, merge, spatial, stats, timeline
from tidewell.operators.spatial import Box
from tidewell.sources.ingest import rising, synthetic

REC = "key long, value binary, seq long"


def rows(df):
    return sorted((r.key, bytes(r.value)) for r in df.collect())


def test_latest_equals_replay(spark):
    rng = random.Random(3)
    log = [(rng.randint(-9, 9), rng.choice([b"", b"a", b"bb"]), s) for s in range(300)]
    state = {}
    for k, v, _ in log:
        state[k] = v
    shuffled = rng.sample(log, len(log))
    df = spark.createDataFrame(shuffled, REC)
    assert rows(merge.latest(df)) == sorted(state.items())
    assert rows(merge.live_view(df)) == sorted((k, v) for k, v in state.items() if v)
    assert rows(merge.range_scan(df, -3, 4)) == sorted((k, v) for k, v in state.items() if v and -3 <= k <= 4)


def test_compaction_keeps_and_drops_tombstones(spark):
    old = spark.createDataFrame([(1, b"old", 1), (2, b"alive", 1)], REC)
    new = spark.createDataFrame([(1, b"new", 2), (2, b"", 2), (3, b"v3", 2)], REC)
    both = old.unionByName(new)
    assert rows(merge.compact(both)) == [(1, b"new"), (2, b""), (3, b"v3")]
    assert rows(merge.compact(both, drop_tombstones=True)) == [(1, b"new"), (3, b"v3")]


def test_newer_level_wins_whatever_its_seq(spark):
    a = spark.createDataFrame([(1, b"base", 99)], REC)
    b = spark.createDataFrame([(1, b"delta", 1)], REC)
    assert rows(merge.latest(merge.union_levels(a, b), "level", "seq")) == [(1, b"delta")]


def test_prefix_of_a_damaged_log(spark):
    df = spark.createDataFrame([(k, b"x", k) for k in range(10)], REC)
    assert merge.valid_prefix(df, F.col("key").isin(4, 7)).count() == 4
    assert merge.valid_prefix(df, F.lit(False)).count() == 10


def test_get_many_and_pending(spark):
    df = spark.createDataFrame([(1, b"a", 1), (1, b"bb", 2), (2, b"c", 1)], REC)
    wanted = spark.createDataFrame([(1,), (1,), (7,)], "key long")
    assert rows(merge.get_many(df, wanted)) == rows(merge.get_many(df, wanted, small=0)) == [(1, b"bb")]
    assert tuple(merge.pending_size(df).first()) == (2, 28)
    assert tuple(merge.pending_size(df.limit(0)).first()) == (0, 0)


def test_range_reaches_the_scan(spark, tmp_path):
    spark.range(1000).selectExpr("id AS key", "cast(cast(id AS string) AS binary) AS value", "1L AS seq").write.parquet(str(tmp_path / "t"))
    text = merge.range_scan(spark.read.parquet(str(tmp_path / "t")), 10, 20)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(key,10)" in text and "LessThanOrEqual(key,20)" in text


def inside(ranges):
    return {k for a, b in ranges for k in range(a, b + 1)}


@pytest.mark.parametrize("box", [Box((0, 3), (0, 3), (0, 3)), Box((1, 6), (2, 5), (3, 3)), Box((1023, 1023), (0, 0), (5, 5)), Box((5, 4), (0, 1), (0, 1)), Box((-4, 2), (1020, 2000), (7, 9))])
def test_exact_cover(box):
    want = {K.encode3d(x, y, z) for x in range(max(0, box.x[0]), min(1023, box.x[1]) + 1) for y in range(max(0, box.y[0]), min(1023, box.y[1]) + 1) for z in range(max(0, box.z[0]), min(1023, box.z[1]) + 1)}
    got = spatial.z_ranges(box)
    assert inside(got) == want and got == spatial.coalesced(got)


def test_cover_sizes_and_budget():
    assert spatial.z_ranges(Box((0, 1023), (0, 1023), (0, 1023))) == [(0, K.CODES - 1)]
    box = Box((1, 64), (1, 64), (1, 64))
    exact = spatial.z_ranges(box)
    assert len(exact) == 14082 and sum(b - a + 1 for a, b in exact) == 64**3
    coarse = spatial.z_ranges(box, 32)
    assert len(coarse) <= 32 and all(any(c <= a and b <= d for c, d in coarse) for a, b in exact)


def test_box_scan_equals_brute_force(spark):
    rng = random.Random(5)
    pts = {(rng.randrange(64), rng.randrange(64), rng.randrange(64)) for _ in range(500)}
    df = spark.createDataFrame([(K.encode3d(*p),) for p in pts], "key long")
    for box in (Box((1, 40), (3, 50), (7, 33)), Box((0, 1023), (0, 1023), (0, 1023)), Box((9, 3), (0, 1), (0, 1))):
        got = [(r.x, r.y, r.z) for r in spatial.scan_box(df, box, 8).collect()]
        assert sorted(got) == sorted(p for p in pts if box.has(*p)) and got == sorted(got, key=lambda p: K.encode3d(*p))


def test_coalesced_ranges(spark):
    r = [(5, 9), (1, 2), (3, 4), (20, 30), (22, 23)]
    assert spatial.coalesced(r) == [(1, 9), (20, 30)]
    got = spatial.coalesce_ranges(spark.createDataFrame([("g", *x) for x in r], "g string, a long, b long"), "g")
    assert sorted((x.a, x.b) for x in got.collect()) == [(1, 9), (20, 30)]


def test_fan_out_and_sync(spark):
    m = spark.createDataFrame([("alice", "PUBLIC", "hi all", 1000), ("alice", "bob", "hello", 2000), ("carl", "carl", "note", 0)], "sender string, receiver string, body string, ts long")
    r = timeline.fan_out(m)
    assert r.count() == 4
    assert [x.body for x in timeline.sync(r, "bob", "PUBLIC").collect()] == ["hi all"]
    assert [x.body for x in timeline.sync(r, "alice", "bob").collect()] == ["hello"] == [x.body for x in timeline.sync(r, "bob", "alice").collect()]
    assert timeline.sync(r, "bob", "alice", last=2000).count() == 0 == timeline.sync(r, "bob", "alice", cursor=2000).count()
    assert [x.ts for x in timeline.sync(r, "carl", "carl").collect()] == [1]
    assert rows(timeline.cursors(timeline.mailbox(r, K.owner_of("alice")))) == [(K.cursor_key(K.owner_of("alice")), b"2000")]


@pytest.mark.parametrize("keys", [[5], [7, 8], list(range(0, 3000, 3)), [k * k for k in range(500)], [-50, -3, 0, 2**40]])
def test_windows_hold_every_key(spark, keys):
    p = learned.positions(spark.createDataFrame([(k,) for k in keys], "key long"), parts=3)
    assert [r.pos for r in p.orderBy("key").collect()] == list(range(len(keys)))
    f = learned.predict(p, learned.train(p, fanout=10), fanout=10)
    w = learned.window_lookup(f, learned.error_bounds(f)).collect()
    assert len(w) == len(keys) and all(r["first"] <= r.pos <= r["last"] for r in w)


def test_sums_add_up(spark):
    p = learned.positions(spark.range(100).select(F.col("id").alias("key"), F.lit(0).alias("shard")), "shard").withColumn("bucket", learned.bucket(7))
    whole = learned.lines(learned.sums(p, "bucket")).orderBy("bucket").collect()
    parts = learned.lines(learned.merge_sums(learned.sums(p.where("key < 31"), "bucket"), learned.sums(p.where("key >= 31"), "bucket"), "bucket")).orderBy("bucket").collect()
    assert whole == parts and all(abs(r.slope - 1) < 1e-9 for r in whole)


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_sums_are_added_by_key(spark, parts):
    keys = [10**10 + 3 * k for k in range(5000)]
    want = [float(len(keys)), 0.0, 0.0, 0.0, 0.0]
    for pos, key in enumerate(keys):
        x, y = float(key), float(pos)
        want[1:] = want[1] + x, want[2] + y, want[3] + x * y, want[4] + x * x
    p = learned.positions(spark.createDataFrame([(k,) for k in keys[::-1]], "key long").repartition(parts), parts=parts)
    for by in ([], ["bucket"]):
        got = learned.sums(p.withColumn("bucket", F.lit(0)), *by).first()
        assert [got[c] for c in learned.SUMS] == want


def test_reports(spark):
    p = learned.positions(spark.range(7000).select(F.col("id").alias("key"), (F.col("id") % 2).alias("shard")), "shard")
    f = learned.predict(p, learned.train(p, "shard"), "shard")
    assert learned.heatmap(f).count() == 7000 and learned.diagnostics(f, "shard").count() == 5000
    assert learned.diagnostics(f, "shard").columns == ["key", "real_pos", "predicted_pos", "error"]
    b = learned.benchmark(f, learned.error_bounds(f, "shard"), "shard", lookups=500)
    assert b["lookups"] > 0 and b["full_steps"] >= b["model_steps"] > 0


def test_stats():
    assert (stats.ratio(6, 3), stats.ratio(1, 0), stats.ratio(0, 0)) == (2.0, 100.0, 0.0)
    assert stats.bloom_size(100_000, 0.01) == (958506, 7)
    text = stats.metrics_text({"read_count": 3, "rw_ratio": 1.5})
    assert "tidewell_reads_total 3\n" in text and "tidewell_rw_ratio 1.500000\n" in text and text.count("# TYPE") == 11


def test_bloom(spark):
    b = stats.bloom(spark.range(1000).select(F.col("id").alias("key")))
    ask = lambda keys: [r.maybe for r in stats.may_contain(keys.select(F.col("id").alias("key")), b).collect()]
    assert all(ask(spark.range(1000))) and sum(ask(spark.range(10**6, 10**6 + 2000))) < 60 and sum(ask(spark.range(-(1 << 62), -(1 << 62) + 2000))) < 60
    with pytest.raises(ValueError):
        stats.bloom(spark.range(1).select(F.col("id").alias("key")), n=10**9)
    nothing = stats.bloom(spark.range(0).select(F.col("id").alias("key")))
    assert not any(r.maybe for r in stats.may_contain(spark.range(9).select(F.col("id").alias("key")), nothing).collect())


def test_positions_of_no_keys(spark):
    assert learned.positions(spark.range(0).select(F.col("id").alias("key"))).count() == 0


def test_appended_keys_stay_within_bounds(spark):
    keys = spark.range(1000).select((F.col("id") * F.col("id")).alias("key"))
    old = learned.positions(keys.where("key < 400000"))
    model = learned.train(old, fanout=8)
    bounds = learned.error_bounds(learned.predict(old, model, fanout=8))
    one = old.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("size"))
    new = learned.positions(keys.where("key >= 400000")).drop("lo", "hi", "size").join(one).withColumn("pos", F.col("pos") + F.col("size"))
    grown, wide = learned.append(model, bounds, new, fanout=8)
    was, now = bounds.first(), wide.first()
    assert now.min_error <= was.min_error and now.max_error >= was.max_error and grown.agg(F.sum("n")).first()[0] == 1000
    errors = [r.error for r in learned.predict(new, grown, fanout=8).collect()]
    assert now.min_error <= min(errors) and max(errors) <= now.max_error


def test_rising_keys(spark):
    got = [r.key for r in rising(spark, 70_000, 10, 1 + F.col("i") % 3).orderBy("i").collect()]
    want, k = [], 10
    for i in range(70_000):
        k += 1 + i % 3
        want.append(k)
    assert got == want
    r = synthetic(spark, 1000).collect()
    assert len({x.key for x in r}) == 1000 and all(bytes(x.value) == f"data-{x.key}".encode() for x in r)
