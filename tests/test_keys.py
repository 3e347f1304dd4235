import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewell.functions import keys as K
from tidewell.sources.files import log_entry

coord = st.integers(0, K.SIDE - 1)


@given(coord, coord, coord)
def test_codes_come_back(x, y, z):
    code = K.encode3d(x, y, z)
    assert 0 <= code < K.CODES and K.decode3d(code) == (x, y, z)


def test_codes_interleave():
    assert K.encode3d(1, 0, 0) == 1 and K.encode3d(0, 1, 0) == 2 and K.encode3d(0, 0, 1) == 4
    assert K.spread(1023) == 0x09249249
    with pytest.raises(ValueError):
        K.encode3d(1024, 0, 0)


@given(st.integers(0, K.OWNER_MASK), st.integers(0, K.TIME_MASK))
def test_timeline_keys_come_back(owner, ms):
    key = K.timeline_key(owner, ms)
    assert K.INT64_MIN <= key <= K.INT64_MAX
    assert (K.timeline_owner(key), K.timeline_time(key)) == (owner, ms)


def test_timeline_order_and_bounds():
    assert K.timeline_key(1, 100) < K.timeline_key(1, 200) < K.timeline_key(1, 300)
    assert K.timeline_key(0, 1000) < K.timeline_key(1, 1000)
    a, b = K.timeline_bounds(5, 100)
    assert (K.timeline_owner(a), K.timeline_time(a)) == (5, 101)
    assert (K.timeline_owner(b), K.timeline_time(b)) == (5, K.TIME_MASK)
    assert K.timeline_time(K.cursor_key(7)) == 0 and K.timeline_owner(K.cursor_key(7)) == 7
    assert K.timeline_bounds(5, K.TIME_MASK)[0] == K.timeline_key(5, 0)


def test_owners_and_tables():
    assert [K.owner_of(n) for n in ("", "PUBLIC", "alice", "bob")] == [0, 0, 628352, 97717]
    assert K.table_range("users") == K.table_range("USERS") == (1045188146474206464, 1045188146475206463)
    assert K.table_range("orders") == (78879281342000000, 78879281342999999)


def test_columns_equal_functions(spark):
    names = ["", "PUBLIC", "public", "alice", "bob", "al😀ce", "é" * 40, "x" * 200, "Customer#000000012"]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", K.owner_of_col("n").alias("o")).collect()
    assert [r.o for r in got] == [K.owner_of(n) for n in names]
    assert spark.createDataFrame([(None,)], "n string").select(K.owner_of_col("n")).first()[0] is None
    points = [(0, 0, 0), (1023, 1023, 1023), (5, 700, 33)]
    df = spark.createDataFrame(points, "x int, y int, z int").withColumn("c", K.encode3d_col("x", "y", "z"))
    rows = df.select("c", *K.decode3d_col("c").values()).collect()
    assert [r.c for r in rows] == [K.encode3d(*p) for p in points] and [(r.x, r.y, r.z) for r in rows] == points
    bad = spark.createDataFrame([(1024, 0, 0), (0, -1, 0), (None, 0, 0)], "x int, y int, z int")
    assert [r[0] for r in bad.select(K.encode3d_col("x", "y", "z", strict=False)).collect()] == [None] * 3
    with pytest.raises(Exception, match="coordinates"):
        bad.limit(1).select(K.encode3d_col("x", "y", "z")).collect()
    owners = [(0, 1), (1 << 21, 5), (K.OWNER_MASK, K.TIME_MASK), (1 << 30, 7)]
    df = spark.createDataFrame(owners, "o long, t long").withColumn("k", K.timeline_key_col("o", "t"))
    rows = df.select("k", K.timeline_owner_col("k").alias("o"), K.timeline_time_col("k").alias("t")).collect()
    assert [tuple(r) for r in rows] == [(K.timeline_key(o, t), o & K.OWNER_MASK, t) for o, t in owners]


def test_shards_of_negative_keys(spark):
    got = spark.createDataFrame([(-5,), (5,), (-16,)], "key long").select(K.shard_col("key", 16)).collect()
    assert [r[0] for r in got] == [11, 5, 0]


def test_checksum(spark):
    df = spark.createDataFrame([(258, b"abc"), (-1, b"")], "key long, value binary")
    want = [struct.unpack("<I", log_entry(k, v)[:4])[0] for k, v in ((258, b"abc"), (-1, b""))]
    assert [r[0] for r in df.select(K.crc_of_col("key", "value")).collect()] == want
    five = spark.createDataFrame([(5, b"abc")], "key long, value binary")
    assert five.select(K.crc_of_col("key", "value")).first()[0] == 534331169


@settings(max_examples=30)
@given(st.integers())
def test_wrap(n):
    assert (K.wrap64(n) - n) % (1 << 64) == 0 and K.INT64_MIN <= K.wrap64(n) <= K.INT64_MAX


def test_epoch_does_not_depend_on_the_zone(spark):
    df = spark.sql("SELECT TIMESTAMP_NTZ'2024-03-10 02:30:00.123' AS ts")
    before = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        assert df.select(K.epoch_ms(F.col("ts"))).first()[0] == 1710037800123
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
