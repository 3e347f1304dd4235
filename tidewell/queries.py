"""The queries of the library over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.config import Config
from tidewell.functions import keys as K
from tidewell.operators import learned, merge, spatial, stats, timeline
from tidewell.plans.dialect import parse, plan
from tidewell.sources import backup, files
from tidewell.sources.ingest import rising
from tidewell.sources.shared import shared_path
from tidewell.sources.store import KVStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
SHARDS = 16


def query(sql: str | None, name: str = "") -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        n = name or f.__name__
        QUERIES[n] = f
        if sql:
            SQL[n] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def order_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"), F.col("o_orderstatus").cast("binary").alias("value"))


# The dialect


def _dialect(name: str, text: str, sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return plan(parse(text), order_records(spark, sf_dir))

    query(f"SELECT o_orderkey AS id, o_orderstatus AS data FROM orders {sql}", name)(run)


_dialect("sql_select_all", "SELECT * FROM orders", "")
for _n, _op in (("eq", "="), ("ne", "!="), ("gt", ">"), ("lt", "<"), ("ge", ">="), ("le", "<=")):
    _dialect(f"sql_where_{_n}", f"select * from orders where id {_op} 700;", f"WHERE o_orderkey {_op} 700")
_dialect("sql_limit", "SELECT * FROM orders LIMIT 10", "ORDER BY o_orderkey LIMIT 10")
_dialect("sql_where_limit", "SELECT * FROM orders WHERE id>=100 LIMIT 5", "WHERE o_orderkey >= 100 ORDER BY o_orderkey LIMIT 5")
_dialect("sql_limit_zero", "SELECT * FROM orders LIMIT 0", "WHERE false")

TABLES = ("users", "Products", "orders", "my_table_1", "lineitem")


@query(f"""
WITH t AS (SELECT * FROM (VALUES {", ".join(f"('{t}')" for t in TABLES)}) v(name)),
h AS (SELECT name, list_reduce(list_concat([{K.FNV_OFFSET}::HUGEINT], list_transform(string_split(lower(name), ''), lambda c: ascii(c)::HUGEINT)), lambda a, b: xor(a, b) * {K.FNV_PRIME}::HUGEINT % 18446744073709551616::HUGEINT) AS h FROM t),
p AS (SELECT name, (h // 65536) % 140737488355328::HUGEINT * 1000000 % 18446744073709551616::HUGEINT AS p FROM h),
b AS (SELECT name, CASE WHEN p >= 9223372036854775808::HUGEINT THEN 18446744073709551616::HUGEINT - p ELSE p END AS b FROM p)
SELECT name, b::BIGINT AS first_key, (b + 999999)::BIGINT AS last_key FROM b
""")
def table_key_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t, *K.table_range(t)) for t in TABLES], "name string, first_key bigint, last_key bigint")


# Lookups and scans

KV = "SELECT o_orderkey AS key, o_orderstatus AS value FROM orders"


def _text(df: DataFrame) -> DataFrame:
    return df.select("key", F.col("value").cast("string").alias("value"))


def _versioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_records(spark, sf_dir).withColumn("seq", F.lit(1).cast("long"))


@query(f"{KV} WHERE o_orderkey = 123")
def point_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(merge.get(_versioned(spark, sf_dir), 123))


@query(f"{KV} WHERE false")
def point_get_miss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(merge.get(_versioned(spark, sf_dir), -5))


@query(f"{KV} WHERE o_orderkey IN (SELECT (c_custkey * 7) FROM customer)")
def multi_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7).alias("key"))
    return _text(merge.get_many(_versioned(spark, sf_dir), wanted))


@query(f"{KV} WHERE o_orderkey BETWEEN 200 AND 999")
def range_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(merge.range_scan(_versioned(spark, sf_dir), 200, 999))


@query(KV)
def full_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(merge.live_view(_versioned(spark, sf_dir)))


@query(f"{KV} WHERE false")
def range_scan_empty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(merge.range_scan(_versioned(spark, sf_dir), 999, 200))


BLOOM = f"list_transform(range(hashes), lambda k: ((x + 1) * {stats.BLOOM_BY[0]} % {stats.BLOOM_MOD} + (x + 1) * {stats.BLOOM_BY[1]} % {stats.BLOOM_MOD} * k) % bits)"


@query(f"""
WITH o AS (SELECT o_orderkey AS key, xor(o_orderkey, o_orderkey >> 32) % {stats.BLOOM_MOD} AS x FROM orders),
c AS (SELECT c_custkey * 37 AS key, xor(c_custkey * 37, (c_custkey * 37) >> 32) % {stats.BLOOM_MOD} AS x FROM customer),
m AS (SELECT CAST(ceil(count(*) * ln(0.05) / ln(pow(2, -ln(2)))) AS BIGINT) AS bits, CAST(ceil(bits / count(*) * ln(2)) AS BIGINT) AS hashes FROM orders),
f AS (SELECT DISTINCT unnest({BLOOM}) AS place FROM o, m),
p AS (SELECT key, unnest({BLOOM}) AS place FROM c, m)
SELECT key, bool_and(f.place IS NOT NULL) AS maybe, key IN (SELECT o_orderkey FROM orders) AS found FROM p LEFT JOIN f ON f.place = p.place GROUP BY key
""")
def bloom_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence of keys: a Bloom filter says which are surely absent, a semi-join looks for the others only."""
    keys = order_records(spark, sf_dir).select("key")
    probes = table(spark, sf_dir, "customer").select((F.col("c_custkey") * 37).alias("key"))
    asked = stats.may_contain(probes, stats.bloom(keys, rate=0.05))
    there = asked.where("maybe").join(keys, "key", "left_semi").select("key", F.lit(True).alias("found"))
    return asked.join(there, "key", "left").select("key", "maybe", F.coalesce("found", F.lit(False)).alias("found"))


# Merging

EVENT_ORDER = ("ts", "event_id")


def event_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as versions of users: an error deletes."""
    value = F.when(F.col("event_type") == "error", F.lit("")).otherwise(F.concat_ws("|", "event_type", "props"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), value.cast("binary").alias("value"), "ts", "event_id")


EVENTS = "SELECT user_id AS key, CASE WHEN event_type = 'error' THEN '' ELSE concat_ws('|', event_type, props) END AS value, ts, event_id FROM events"
LATEST = "SELECT key, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY {order}) AS n FROM ({rows})) WHERE n = 1"
NEWEST = LATEST.format(order="ts DESC, event_id DESC", rows=EVENTS)


@query(NEWEST)
def lww_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.latest(event_records(spark, sf_dir), *EVENT_ORDER)
    return out.select("key", F.col("value").cast("string").alias("value"), "event_id")


@query(f"SELECT * FROM ({NEWEST}) WHERE length(value) > 0")
def lww_tombstone_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.live_view(event_records(spark, sf_dir), *EVENT_ORDER)
    return out.select("key", F.col("value").cast("string").alias("value"), "event_id")


@query("""
SELECT key, qty, line FROM (
  SELECT l_orderkey AS key, l_quantity AS qty, l_linenumber AS line, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC, l_returnflag DESC) AS n, l_returnflag AS f
  FROM lineitem) WHERE n = 1 AND f <> 'R'
""")
def upsert_delete_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replays a log of puts and deletes (returned lines delete) and shows what is left."""
    log = table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("key"), F.when(F.col("l_returnflag") == "R", F.lit("")).otherwise(F.lit("x")).cast("binary").alias("value"),
        F.col("l_quantity").alias("qty"), F.col("l_linenumber").alias("line"), "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag",
    )
    return merge.live_view(log, "line", "l_partkey", "l_suppkey", "l_extendedprice", "qty", "l_returnflag").select("key", "qty", "line")


@query(f"SELECT key, event_id, length(value) = 0 AS deleted FROM ({NEWEST})")
def compaction_keep_tombstones(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = merge.compact(event_records(spark, sf_dir), *EVENT_ORDER)
    return out.select("key", "event_id", (F.length("value") == 0).alias("deleted"))


@query(f"SELECT key, event_id FROM ({NEWEST}) WHERE length(value) > 0")
def compaction_gc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.compact(event_records(spark, sf_dir), *EVENT_ORDER, drop_tombstones=True).select("key", "event_id")


LOG = "SELECT user_id AS key, event_id, event_type FROM events"
BAD = "event_type = 'purchase' AND user_id % 10 = 3"


@query(f"""
WITH bad AS (SELECT min(event_id) AS cut FROM events WHERE {BAD})
SELECT key, event_id, event_type FROM (
  SELECT l.*, row_number() OVER (PARTITION BY key ORDER BY event_id DESC) AS n FROM ({LOG}) l, bad WHERE cut IS NULL OR event_id < cut) WHERE n = 1
""")
def wal_prefix_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after replaying a log up to its first damaged entry."""
    log = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "event_id", "event_type", F.expr(BAD).alias("bad"))
    return merge.latest(merge.valid_prefix(log, F.col("bad"), "event_id").drop("bad"), "event_id")


@query(LATEST.format(order="event_id >= 500 DESC, ts DESC, event_id DESC", rows=EVENTS))
def level_union_precedence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two levels of files read as one: the newer level wins, whatever its times."""
    e = event_records(spark, sf_dir)
    both = merge.union_levels(e.where("event_id < 500"), e.where("event_id >= 500"))
    return merge.latest(both, "level", *EVENT_ORDER).select("key", F.col("value").cast("string").alias("value"), "event_id")


@query("SELECT o_orderkey AS key, o_orderkey % 16 AS shard FROM orders")
def shard_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_records(spark, sf_dir).select("key", K.shard_col("key", SHARDS).alias("shard"))


@query("SELECT o_orderkey % 16 AS shard, count(*) AS records FROM orders GROUP BY 1")
def shard_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.shard_counts(order_records(spark, sf_dir), SHARDS)


# Z-order

XYZ = "o_orderkey % 1024 AS x, o_custkey % 1024 AS y, (o_orderkey // 1024) % 1024 AS z"


def _sql_spread(c: str) -> str:
    return "(" + " | ".join(f"((({c} >> {k}) & 1) << {3 * k})" for k in range(K.SIDE_BITS)) + ")"


CODE = f"({_sql_spread('x')} | ({_sql_spread('y')} << 1) | ({_sql_spread('z')} << 2))"


def order_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 1024).alias("x"), (F.col("o_custkey") % 1024).alias("y"),
        F.expr("(o_orderkey div 1024) % 1024").alias("z"), F.col("o_orderstatus").alias("data"),
    )


@query(f"SELECT id, {CODE} AS code FROM (SELECT o_orderkey AS id, {XYZ} FROM orders)")
def morton_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_points(spark, sf_dir).select("id", K.encode3d_col("x", "y", "z").alias("code"))


@query(f"SELECT id, {CODE} AS code, x, y, z FROM (SELECT o_orderkey AS id, {XYZ} FROM orders)")
def morton_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = order_points(spark, sf_dir).select("id", K.encode3d_col("x", "y", "z").alias("code"))
    return p.withColumns(K.decode3d_col("code"))


BOX = spatial.Box((100, 700), (50, 900), (1, 9))
IN_BOX = "x BETWEEN 100 AND 700 AND y BETWEEN 50 AND 900 AND z BETWEEN 1 AND 9"


@query(f"SELECT DISTINCT {CODE} AS key, x, y, z FROM (SELECT {XYZ} FROM orders) WHERE {IN_BOX}")
def box_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "points")
    order_points(spark, sf_dir).select(K.encode3d_col("x", "y", "z").alias("key")).distinct().write.parquet(path)
    # stored keys: the ranges reach the scan, and are compared with a column instead of the whole encoding
    return spatial.scan_box(spark.read.schema("key bigint").parquet(path), BOX)


@query(f"SELECT count(*) AS points FROM (SELECT {XYZ} FROM orders) WHERE x BETWEEN 3 AND 66 AND y BETWEEN 5 AND 68 AND z BETWEEN 0 AND 63")
def z_ranges_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points whose key is in the exact cover of a box, without looking at coordinates; the cover's ranges are a table joined by cells."""
    ranges = spatial.z_ranges(spatial.Box((3, 66), (5, 68), (0, 63)))
    cells = spark.createDataFrame([(c, a, b) for a, b in ranges for c in range(a >> 12, (b >> 12) + 1)], "cell bigint, a bigint, b bigint")
    keys = order_points(spark, sf_dir).select(K.encode3d_col("x", "y", "z").alias("key"))
    near = keys.join(cells, (F.shiftright("key", 12) == F.col("cell")) & F.col("key").between(F.col("a"), F.col("b")), "left_semi")
    return near.agg(F.count("*").alias("points"))


@query("""
WITH r AS (SELECT o_custkey % 50 AS g, o_orderkey AS a, o_orderkey + o_custkey % 300 AS b FROM orders),
m AS (SELECT *, max(b) OVER (PARTITION BY g ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r),
i AS (SELECT *, sum(CASE WHEN before IS NULL OR a > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY g ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS n FROM m)
SELECT g, min(a) AS a, max(b) AS b FROM i GROUP BY g, n
""")
def range_coalesce(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = table(spark, sf_dir, "orders").select((F.col("o_custkey") % 50).alias("g"), F.col("o_orderkey").alias("a"), (F.col("o_orderkey") + F.col("o_custkey") % 300).alias("b"))
    return spatial.coalesce_ranges(r, "g")


@query(f"SELECT {CODE} AS key, min(data) AS value, count(*) AS versions FROM (SELECT {XYZ}, o_orderstatus AS data FROM orders) GROUP BY 1")
def mocap_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spatial.points(order_points(spark, sf_dir), "x", "y", "z", "data")
    return p.groupBy("key").agg(F.min(F.col("value").cast("string")).alias("value"), F.count("*").alias("versions"))


# Timelines

MS = "(epoch_us(ts) // 1000)"
TKEY = f"((user_id::BIGINT << 42) | {MS})"


def event_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select("event_id", "user_id", "event_type", K.timeline_key_col("user_id", K.epoch_ms("ts")).alias("key"))


@query(f"SELECT event_id, {TKEY} AS key FROM events")
def timeline_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_keys(spark, sf_dir).select("event_id", "key")


@query(f"SELECT event_id, user_id AS owner, {MS} AS ms FROM events")
def timeline_unpack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_keys(spark, sf_dir).select("event_id", K.timeline_owner_col("key").alias("owner"), K.timeline_time_col("key").alias("ms"))


@query("""
WITH RECURSIVE h(name, k, v) AS (
  SELECT DISTINCT c_name, 0, 0::HUGEINT FROM customer
  UNION ALL SELECT name, k + 1, (v * 31 + unicode(substr(name, k + 1, 1))) % 18446744073709551616 FROM h WHERE k < length(name)
)
SELECT c_custkey, (CASE WHEN v >= 9223372036854775808 THEN 18446744073709551616 - v ELSE v END % 4194304)::BIGINT AS owner
FROM customer JOIN h ON name = c_name AND k = length(name)
""")
def owner_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", K.owner_of_col("c_name").alias("owner"))


@query(f"SELECT {TKEY} AS key, event_type AS value FROM events WHERE user_id = 7")
def mailbox_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_keys(spark, sf_dir).select("key", F.col("event_type").alias("value"))
    return timeline.mailbox(r, 7)


CURSOR = 1_704_500_000_000


@query(f"SELECT {TKEY} AS key, event_type AS value FROM events WHERE user_id = 7 AND {MS} > {CURSOR}")
def mailbox_after_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = event_keys(spark, sf_dir).select("key", F.col("event_type").alias("value"))
    return timeline.mailbox(r, 7, CURSOR)


@query(f"SELECT user_id::BIGINT << 42 AS key, CAST(max({MS}) AS VARCHAR) AS value FROM events GROUP BY user_id")
def cursor_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _text(timeline.cursors(event_keys(spark, sf_dir)))


@query("""
WITH RECURSIVE m AS (SELECT role AS sender, CASE WHEN conv_id % 5 = 0 THEN 'PUBLIC' ELSE 'conv' || conv_id END AS receiver, greatest(conv_id * 100 + turn, 1) AS ts FROM conversations),
n AS (SELECT sender AS name FROM m UNION SELECT receiver FROM m),
h(name, k, v) AS (SELECT name, 0, 0::HUGEINT FROM n UNION ALL SELECT name, k + 1, (v * 31 + unicode(substr(name, k + 1, 1))) % 18446744073709551616 FROM h WHERE k < length(name)),
o AS (SELECT name, CASE WHEN name = 'PUBLIC' THEN 0 ELSE (CASE WHEN v >= 9223372036854775808 THEN 18446744073709551616 - v ELSE v END % 4194304)::BIGINT END AS owner FROM h WHERE k = length(name)),
f AS (SELECT ts, a.owner AS a, b.owner AS b FROM m JOIN o a ON a.name = sender JOIN o b ON b.name = receiver)
SELECT b AS owner, ts FROM f UNION ALL SELECT a, ts FROM f WHERE b <> 0 AND a <> b
""")
def write_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    to = F.when(F.col("conv_id") % 5 == 0, "PUBLIC").otherwise(F.concat(F.lit("conv"), F.col("conv_id")))
    m = c.select(F.col("role").alias("sender"), to.alias("receiver"), F.col("text").alias("body"), (F.col("conv_id") * 100 + F.col("turn")).alias("ts"))
    return timeline.fan_out(m).select(K.timeline_owner_col("key").alias("owner"), K.timeline_time_col("key").alias("ts"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def message_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


BOB = K.owner_of("bob")


@query(f"SELECT {TKEY} - (7::BIGINT << 42) + ({BOB}::BIGINT << 42) AS key, {MS} AS ts, event_type AS sender, 'bob' AS receiver, props AS body FROM events WHERE user_id = 7 AND {MS} > {CURSOR} UNION ALL SELECT {MS}, {MS}, event_type, 'PUBLIC', props FROM events WHERE user_id = 8")
def mailbox_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages as JSON, read back from a user's mailbox after a cursor and from the public one; damaged ones are left out."""
    e = table(spark, sf_dir, "events").where("user_id IN (7, 8, 9)").withColumn("ms", K.epoch_ms("ts"))
    to = F.when(F.col("user_id") == 7, "bob").when(F.col("user_id") == 8, "PUBLIC").otherwise("eve")
    text = timeline.encode_message(F.col("event_type"), to, F.col("props"), F.col("ms"))
    r = e.select(K.timeline_key_col(K.owner_of_col(to), "ms").alias("key"), text.cast("binary").alias("value"))
    broken = r.where("key % 3 = 0").select((F.col("key") + 1).alias("key"), F.lit(b"{not json").alias("value"))
    r = r.unionByName(broken)
    return timeline.sync(r, "bob", "bob", cursor=CURSOR).unionByName(timeline.sync(r, "bob")).select("key", "ts", "sender", "receiver", "body")


# Learned positions


def placed_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.positions(order_records(spark, sf_dir).select("key"))


def _model_sql(fanout: int, shard: str = "0") -> str:
    return f"""
WITH p AS (
  SELECT o_orderkey AS key, {shard} AS shard, row_number() OVER w - 1 AS pos, min(o_orderkey) OVER (PARTITION BY {shard}) AS lo,
    max(o_orderkey) OVER (PARTITION BY {shard}) AS hi, count(*) OVER (PARTITION BY {shard}) AS size
  FROM orders WINDOW w AS (PARTITION BY {shard} ORDER BY o_orderkey)
), b AS (SELECT *, least(greatest(CAST(trunc((key - lo)::DOUBLE / (hi - lo)::DOUBLE * {fanout}) AS BIGINT), 0), {fanout - 1}) AS bucket FROM p),
s AS (SELECT shard, bucket, count(*)::DOUBLE AS n, sum(key::DOUBLE) AS sx, sum(pos::DOUBLE) AS sy, sum(key::DOUBLE * pos::DOUBLE) AS sxy, sum(key::DOUBLE * key::DOUBLE) AS sxx FROM b GROUP BY ALL),
l AS (SELECT *, CASE WHEN n * sxx - sx * sx = 0 THEN 0.0::DOUBLE ELSE (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM s),
m AS (SELECT *, CASE WHEN n * sxx - sx * sx = 0 THEN 0.0::DOUBLE ELSE (sy - slope * sx) / n END AS intercept FROM l),
f AS (SELECT b.*, CAST(trunc(slope * key::DOUBLE + intercept) AS BIGINT) AS pred FROM b JOIN m USING (shard, bucket)),
e AS (SELECT *, pos - pred AS error FROM f),
w AS (SELECT shard, least(min(error), 0) AS min_error, greatest(max(error), 0) AS max_error FROM e GROUP BY shard)
"""


FAN = 100
MODEL, SHARD_MODEL = _model_sql(FAN), _model_sql(FAN, "o_orderkey % 16")


@query(f"{MODEL} SELECT bucket, n, sx, sy, sxy, sxx, round(slope, 6) AS slope, round(intercept, 3) AS intercept FROM m")
def rmi_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = learned.train(placed_orders(spark, sf_dir), fanout=FAN)
    return m.withColumns({"slope": F.round("slope", 6), "intercept": F.round("intercept", 3)})


def found_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = placed_orders(spark, sf_dir)
    return learned.predict(p, learned.train(p, fanout=FAN), fanout=FAN)


@query(f"{MODEL} SELECT key, pos, bucket, pred FROM f")
def rmi_predict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_orders(spark, sf_dir).select("key", "pos", "bucket", "pred")


@query(f"{MODEL} SELECT min_error, max_error FROM w")
def rmi_error_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.error_bounds(found_orders(spark, sf_dir))


@query(f"{MODEL} SELECT key, pos, greatest(pred + min_error, 0) AS first, least(pred + max_error, size - 1) AS last, least(pred + max_error, size - 1) - greatest(pred + min_error, 0) < 16 AS linear FROM e, w")
def rmi_window_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = found_orders(spark, sf_dir)
    return learned.window_lookup(f, learned.error_bounds(f)).select("key", "pos", "first", "last", "linear")


def sharded_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = order_records(spark, sf_dir).select("key", K.shard_col("key", SHARDS).alias("shard"))
    p = learned.positions(k, "shard")
    return learned.predict(p, learned.train(p, "shard", fanout=FAN), "shard", fanout=FAN)


@query(f"{SHARD_MODEL} SELECT shard, min_error, max_error FROM w")
def rmi_per_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.error_bounds(sharded_orders(spark, sf_dir), "shard")


@query(f"{SHARD_MODEL} SELECT key, pos AS real_pos, pred AS predicted_pos, error FROM e WHERE size <= 300 OR pos % (size // 300) = 0 ORDER BY shard, pos LIMIT 5000")
def model_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As in reports, but of a few hundred keys in a shard, so that small tables are sampled as well."""
    return learned.diagnostics(sharded_orders(spark, sf_dir), "shard", each=300)


@query(f"{MODEL} SELECT key AS k, error AS e FROM e WHERE size <= 2000 OR pos % (size // 2000) = 0")
def heatmap_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return learned.heatmap(found_orders(spark, sf_dir))


@query(f"{SHARD_MODEL} SELECT concat_ws(',', key, pos, pred, error) AS line FROM e UNION ALL SELECT 'Key,RealPos,PredictedPos,Error'")
def model_csv_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sharded_orders(spark, sf_dir).select(F.to_csv(F.struct("key", "pos", "pred", "error")).alias("line"))
    return lines.unionByName(spark.range(1).select(F.lit("Key,RealPos,PredictedPos,Error").alias("line")))


@query(f"{MODEL} SELECT bucket, n, sx, sy, sxy, sxx FROM s")
def incremental_model_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of two halves, added: the same as those of the whole."""
    p = placed_orders(spark, sf_dir).withColumn("bucket", learned.bucket(FAN))
    return learned.merge_sums(learned.sums(p.where("key % 2 = 0"), "bucket"), learned.sums(p.where("key % 2 <> 0"), "bucket"), "bucket")


@query(f"{MODEL} SELECT count(*) AS lookups, max(ceil(log2(size + 1)))::BIGINT AS full_steps, sum(CASE WHEN least(pred + max_error, size - 1) - greatest(pred + min_error, 0) < 16 THEN pos - greatest(pred + min_error, 0) + 1 ELSE ceil(log2(greatest(least(pred + max_error, size - 1) - greatest(pred + min_error, 0) + 1, 1) + 1)) END)::BIGINT AS model_steps FROM e, w")
def algorithm_benchmark(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search steps over all keys, by halving everything and by the model's window."""
    f = found_orders(spark, sf_dir)
    return learned.probe_steps(f, learned.error_bounds(f)).agg(F.count("*").alias("lookups"), F.max("full_steps").alias("full_steps"), F.sum("model_steps").alias("model_steps"))


# Backup, statistics, ingest


@query("SELECT o_orderkey AS \"Key\", base64(encode(o_orderstatus)) AS \"Value\" FROM orders")
def backup_base64(spark: SparkSession, sf_dir: str) -> DataFrame:
    return backup.encoded(order_records(spark, sf_dir))


@query(KV)
def restore_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records through the backup's JSON lines and back."""
    lines = backup.encoded(order_records(spark, sf_dir)).select(F.to_json(F.struct("Key", "Value")).alias("line"))
    return _text(backup.decoded(lines.select(F.from_json("line", backup.LINE).alias("r")).select("r.*")))


@query("""
SELECT count(*) AS record_count, string_agg(o_orderkey || '=' || base64(encode(o_orderstatus)), ',' ORDER BY o_orderkey) AS records, true AS dated FROM orders
""")
def backup_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole document of a backup, its records as one text."""
    doc = backup.backup_document(order_records(spark, sf_dir))
    records = F.array_join(F.transform("records", lambda r: F.concat_ws("=", r["Key"].cast("string"), r["Value"])), ",")
    return doc.select("record_count", records.alias("records"), F.col("generated_at").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d").alias("dated"))


@query(f"SELECT count(DISTINCT key) AS records, CAST(sum(8 + strlen(value)) AS BIGINT) AS bytes FROM ({EVENTS})")
def memtable_count_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.pending_size(event_records(spark, sf_dir))


COUNTS = "count(*) FILTER (WHERE event_type = 'view') AS reads, count(*) FILTER (WHERE event_type <> 'view') AS writes"
RATIO = "CASE WHEN writes > 0 THEN reads::DOUBLE / writes WHEN reads > 0 THEN 100.0 ELSE 0.0 END"


def _counts(*by: str | Column) -> Callable[[DataFrame], DataFrame]:
    view = F.col("event_type") == "view"
    return lambda e: e.groupBy(*by).agg(F.count_if(view).alias("reads"), F.count_if(~view).alias("writes"))


@query(f"SELECT user_id, reads, writes, {RATIO} AS rw_ratio FROM (SELECT user_id, {COUNTS} FROM events GROUP BY user_id)")
def rw_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts("user_id")(table(spark, sf_dir, "events"))
    return c.withColumn("rw_ratio", stats.ratio_col(F.col("reads"), F.col("writes")))


@query(f"""
SELECT c.reads AS read_count, c.writes AS write_count, {RATIO} AS rw_ratio, k.n AS live_count, k.d AS deleted_count, 16::BIGINT AS shards_active
FROM (SELECT {COUNTS} FROM events) c, (SELECT count(*) FILTER (WHERE length(value) > 0) AS n, count(*) FILTER (WHERE length(value) = 0) AS d FROM ({NEWEST})) k
""")
def store_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _counts()(table(spark, sf_dir, "events"))
    k = merge.latest(event_records(spark, sf_dir), *EVENT_ORDER).agg(
        F.count_if(F.length("value") > 0).alias("live_count"), F.count_if(F.length("value") == 0).alias("deleted_count")
    )
    # one row each
    return c.join(F.broadcast(k)).select(
        F.col("reads").alias("read_count"), F.col("writes").alias("write_count"), stats.ratio_col(F.col("reads"), F.col("writes")).alias("rw_ratio"),
        "live_count", "deleted_count", F.lit(SHARDS).cast("long").alias("shards_active"),
    )


@query("""
SELECT key, 'data-' || key AS value FROM (SELECT CAST(1000 + sum(1 + i * 7919 % 5) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) AS BIGINT) AS key FROM range(100000) t(i))
""")
def synthetic_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = rising(spark, 100_000, 1000, 1 + F.col("i") * 7919 % 5)
    return rows.select("key", F.concat(F.lit("data-"), F.col("key").cast("string")).alias("value"))


#: CRC-32 of 8 bytes of a key, 4 of a length of 1 and one character, a bit at a time.
CRC = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(8), lambda k: (key >> (8 * k)) & 255), [1, 0, 0, 0], [ascii(value)::BIGINT]),
  lambda crc, b: list_reduce(list_concat([xor(crc, b)], range(8)), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END))))"""


@query(f"SELECT key, {CRC} AS crc FROM ({KV})")
def log_checksums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checksum that each record has in a log."""
    return order_records(spark, sf_dir).select("key", K.crc_of_col("key", "value").alias("crc"))


@query(f"SELECT key, {CRC} AS crc FROM ({KV}) WHERE key % 97 = 5")
def log_checksum_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log entries whose stored checksum is not that of their key and value: one in 97 was damaged after it was written."""
    log = order_records(spark, sf_dir).withColumn("crc", K.crc_of_col("key", "value"))
    damaged = F.when(F.col("key") % 97 == 5, F.concat(F.col("value"), F.lit(b"x"))).otherwise(F.col("value"))
    return log.withColumn("value", damaged).where(F.col("crc") != K.crc_of_col("key", "value")).select("key", "crc")


# Stores and their files


def _store(spark: SparkSession, auto: bool = False, **config) -> KVStore:
    """A new store in the shared folder."""
    return KVStore(spark, shared_path(spark, "kv"), Config(**config), auto_compact=auto)


def _commits(spark: SparkSession, sf_dir: str, **config) -> KVStore:
    """A store with the events in two commits."""
    store, e = _store(spark, **config), event_records(spark, sf_dir)
    for part in ("event_id < 500", "event_id >= 500"):
        store.put_many(e.where(part), *EVENT_ORDER)
    return store


USERS = K.table_range("users")[0]


@query(f"SELECT o_orderkey + {USERS} AS id, o_orderstatus AS data FROM orders WHERE o_orderkey BETWEEN 700 AND 706")
def store_sql(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dialect over a store: the table's name is a range of keys; what lies outside is not seen."""
    store, o = _store(spark), order_records(spark, sf_dir)
    store.put_many(o.unionByName(o.withColumn("key", F.col("key") + USERS)))
    return store.sql(f"SELECT * FROM Users WHERE id >= {USERS + 700} LIMIT 7")


BY_COMMIT = LATEST.format(order="event_id >= 500 DESC, ts DESC, event_id DESC", rows=EVENTS)


@query(f"SELECT key, value FROM ({BY_COMMIT}) WHERE key BETWEEN 10 AND 99")
def store_pending_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is not yet merged, in a range of keys, tombstones included."""
    return _text(_commits(spark, sf_dir).pending(10, 99))


@query(f"SELECT key, value FROM ({BY_COMMIT}) WHERE length(value) > 0")
def store_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The live records of a store with several commits, merged by itself."""
    return _text(_commits(spark, sf_dir, compaction=2).view())


@query("SELECT 2 AS level, count(*) AS records, 2 * count(*) AS merged FROM orders")
def compaction_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nine commits where three of a level are merged: a record is written again once for each of two levels."""
    store, o = _store(spark, auto=True, compaction=3), order_records(spark, sf_dir)
    for k in range(9):
        store.put_many(o.where(F.col("key") % 9 == k))
    m = store.manifest()
    return spark.createDataFrame([(f["level"], f["rows"], m["merged"]) for f in m["folders"]], "level int, records bigint, merged bigint")


@query(f"SELECT count(*) FILTER (WHERE length(value) > 0) AS live, 0 AS pending, 1 AS models, true AS readable FROM ({BY_COMMIT})")
def store_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after a checkpoint, opened again: all merged, a model kept, nothing lost."""
    store = _commits(spark, sf_dir)
    store.checkpoint()
    again = KVStore(spark, store.path)
    known, live = again.view().orderBy("key").first(), again.view()
    return live.agg(F.count("*").alias("live"), F.lit(again.log().count()).cast("int").alias("pending"), F.lit(again.stats()["learned_indexes_count"]).alias("models"), F.lit(again.get(known["key"]) == bytes(known["value"])).alias("readable"))


@query("SELECT 0 AS records, 0 AS folders, 3 AS commit, 1 AS after FROM range(1)")
def store_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store after a reset, and after one more put."""
    store = _commits(spark, sf_dir)
    store.reset()
    empty, folders = store.view().count(), len(store.manifest()["folders"])
    commit = store.put(5, "five")
    return spark.createDataFrame([(empty, folders, commit, store.view().count())], "records int, folders int, commit int, after int")


#: Statistics of a store after two commits, three lookups, one of which misses, and a scan.
COUNTERS = ("pending_record_count", "learned_indexes_count", "base_file_count", "read_count", "write_count", "hit_count", "shards_active", "pending_writes", "rw_ratio")


@query(f"""
WITH w AS (SELECT (SELECT count(DISTINCT user_id) FROM events WHERE event_id < 500) + (SELECT count(DISTINCT user_id) FROM events WHERE event_id >= 500) AS w),
h AS (SELECT count(*) FILTER (WHERE key IN (1, 2) AND length(value) > 0) AS h FROM ({BY_COMMIT}))
SELECT name, value FROM (
  SELECT 'pending_record_count' AS name, w::DOUBLE AS value FROM w UNION ALL SELECT 'learned_indexes_count', 0 UNION ALL SELECT 'base_file_count', 0 UNION ALL SELECT 'read_count', 4
  UNION ALL SELECT 'write_count', w FROM w UNION ALL SELECT 'hit_count', h FROM h UNION ALL SELECT 'shards_active', 16 UNION ALL SELECT 'pending_writes', 0 UNION ALL SELECT 'rw_ratio', 4 / w FROM w
  UNION ALL SELECT 'files_add_up', 1 UNION ALL SELECT 'log_has_bytes', 1 UNION ALL SELECT 'mode_is_named', 1)
""")
def store_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _commits(spark, sf_dir)
    store.get(1), store.get(2), store.get(-1), store.scan(0, 5)
    s = store.stats()
    rows = [(n, float(s[n])) for n in COUNTERS]
    rows += [("files_add_up", float(s["file_count"] == s["delta_file_count"] + s["base_file_count"] > 0)), ("log_has_bytes", float(s["log_size_bytes"] > 0)), ("mode_is_named", float(bool(s["mode"])))]
    return spark.createDataFrame(rows, "name string, value double")


@query("""
SELECT CASE k WHEN 0 THEN '# HELP tidewell_' || n || ' ' || h WHEN 1 THEN '# TYPE tidewell_' || n || ' ' || t ELSE 'tidewell_' || n || ' ' || v END AS line
FROM (VALUES ('reads_total', 'counter', 'Read operations.', '3'), ('writes_total', 'counter', 'Write operations.', '12'), ('hits_total', 'counter', 'Reads that found a record.', '2'),
  ('pending_records', 'gauge', 'Records in deltas not yet merged.', '7'), ('learned_indexes', 'gauge', 'Learned models kept.', '0'), ('files', 'gauge', 'Data files.', '4'), ('delta_files', 'gauge', 'Files of deltas.', '3'),
  ('base_files', 'gauge', 'Files of the base.', '1'), ('pending_writes', 'gauge', 'Writes accepted but not committed.', '0'), ('log_bytes', 'gauge', 'Bytes of deltas.', '99'), ('rw_ratio', 'gauge', 'Reads for each write.', '0.250000')) v(n, t, h, v), range(3) r(k)
""")
def metrics_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics in the text form that monitoring servers read, a row for each line."""
    shown = {"read_count": 3, "write_count": 12, "hit_count": 2, "pending_record_count": 7, "file_count": 4, "delta_file_count": 3, "base_file_count": 1, "log_size_bytes": 99, "rw_ratio": stats.ratio(3, 12)}
    return spark.createDataFrame([(x,) for x in stats.metrics_text(shown).splitlines()], "line string")


@query(f"{KV} WHERE o_orderkey IN (SELECT c_custkey * 7 + 3 FROM customer)")
def learned_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of many keys, each looked for in the window of places that the store's model gives."""
    store = _store(spark)
    store.put_many(order_records(spark, sf_dir))
    return _text(store.get_learned(table(spark, sf_dir, "customer").select((F.col("c_custkey") * 7 + 3).alias("key"))))


@query(f"{MODEL} SELECT bucket, n, sx, sy, sxy, sxx FROM s")
def model_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model that a store keeps for its version, as read back by another."""
    store = _store(spark, shards=1)
    store.put_many(order_records(spark, sf_dir))
    store.model(fanout=FAN)
    return KVStore(spark, store.path, Config(shards=1)).model().select("bucket", "n", "sx", "sy", "sxy", "sxx")


@query(f"""
WITH a AS (SELECT o_orderkey AS key, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos FROM orders),
c AS (SELECT min(key) AS lo, max(key) AS hi, count(*) AS size FROM a WHERE key % 4 <> 1 AND key < 900),
o AS (SELECT key, row_number() OVER (ORDER BY key) - 1 AS pos, 0 AS new FROM a WHERE key % 4 <> 1 AND key < 900
  UNION ALL SELECT key, size + row_number() OVER (ORDER BY key) - 1, 1 FROM a, c WHERE key >= 900),
b AS (SELECT key, pos, new, least(greatest(CAST(trunc((key - lo)::DOUBLE / (hi - lo)::DOUBLE * {FAN}) AS BIGINT), 0), {FAN - 1}) AS bucket FROM o, c),
s AS (SELECT all_, bucket, count(*)::DOUBLE AS n, sum(key::DOUBLE) AS sx, sum(pos::DOUBLE) AS sy, sum(key::DOUBLE * pos::DOUBLE) AS sxy, sum(key::DOUBLE * key::DOUBLE) AS sxx FROM b, (VALUES (0), (1)) v(all_) WHERE new <= all_ GROUP BY ALL),
l AS (SELECT *, CASE WHEN n * sxx - sx * sx = 0 THEN 0.0::DOUBLE ELSE (n * sxy - sx * sy) / (n * sxx - sx * sx) END AS slope FROM s),
m AS (SELECT *, CASE WHEN n * sxx - sx * sx = 0 THEN 0.0::DOUBLE ELSE (sy - slope * sx) / n END AS intercept FROM l),
e AS (SELECT pos - CAST(trunc(slope * key::DOUBLE + intercept) AS BIGINT) AS error FROM b JOIN m USING (bucket) WHERE new = all_)
SELECT least(min(error), 0) AS min_error, greatest(max(error), 0) AS max_error FROM e
""")
def rmi_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error bounds of a model after learning keys beyond those it was trained with."""
    keys = order_records(spark, sf_dir).select("key")
    old = learned.positions(keys.where("key % 4 <> 1 AND key < 900"))
    model = learned.train(old, fanout=FAN)
    bounds = learned.error_bounds(learned.predict(old, model, fanout=FAN))
    # one row
    was = old.agg(F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("*").alias("size"))
    new = learned.positions(keys.where("key >= 900")).drop("lo", "hi", "size").join(F.broadcast(was)).withColumn("pos", F.col("pos") + F.col("size"))
    return learned.append(model, bounds, new, fanout=FAN)[1]


@query("SELECT true AS known, true AS about_as_many, true AS repeats")
def random_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys drawn with replacement for a benchmark: all are in the table, as many as asked for, some twice."""
    f = placed_orders(spark, sf_dir)
    n = f.count()
    picks = learned.random_keys(f, n)
    return picks.join(f.select("key", F.col("pos").alias("there")), "key", "left").agg(
        F.every(F.col("pos") == F.col("there")).alias("known"), F.abs(F.count("*") - n).__lt__(max(60, n // 10)).alias("about_as_many"), (F.countDistinct("key") < F.count("*")).alias("repeats")
    )


def _exchange_files(spark: SparkSession, sf_dir: str) -> str:
    """A folder with two sorted tables and two logs, one of them damaged, of the nations and regions (30 rows at most are collected)."""
    path = shared_path(spark, "files")
    n = [(r[0], r[1].encode()) for r in table(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").limit(25).collect()]
    g = [(r[0], r[1].encode()) for r in table(spark, sf_dir, "region").select("r_regionkey", "r_name").orderBy("r_regionkey").limit(5).collect()]
    files.write_file(spark, f"{path}/shard-2-l1-100.sst", files.sorted_table([(k, b"old " + v) for k, v in n]))
    files.write_file(spark, f"{path}/shard-2-l0-200.sst", files.sorted_table([(k, v) for k, v in n if k % 3 == 0] + [(1, b"")]))
    log = [files.log_entry(k, b"log " + v, stamp=1000 + k) for k, v in n]
    log[17] = log[17][:-1] + b"?"
    files.write_file(spark, f"{path}/a.wal", b"".join(log[10:]))
    files.write_file(spark, f"{path}/b.wal", b"".join(files.log_entry(100 + k, v, stamp=5) for k, v in g) + b"cut")
    return path


TABLES_SQL = """SELECT n_nationkey::BIGINT AS key, 'old ' || n_name AS value, 2 AS shard, 1 AS level, 100::BIGINT AS stamp, n_nationkey::BIGINT AS place FROM nation
UNION ALL SELECT key, value, 2, 0, 200, row_number() OVER (ORDER BY key) - 1 FROM (SELECT n_nationkey::BIGINT AS key, n_name AS value FROM nation WHERE n_nationkey % 3 = 0 UNION ALL SELECT 1, '')"""
LOGS_SQL = """SELECT n_nationkey::BIGINT AS key, 'log ' || n_name AS value, 'a.wal' AS name, 1000 + n_nationkey::BIGINT AS stamp, n_nationkey::BIGINT - 10 AS seq FROM nation WHERE n_nationkey BETWEEN 10 AND 16
UNION ALL SELECT 100 + r_regionkey::BIGINT, r_name, 'b.wal', 5, r_regionkey::BIGINT FROM region"""


@query(TABLES_SQL)
def table_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All records of a folder of sorted tables."""
    t = files.read_tables(spark, _exchange_files(spark, sf_dir))
    return t.withColumn("value", F.col("value").cast("string"))


@query(LOGS_SQL)
def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entries of a folder of logs, each up to its first damaged one."""
    t = files.read_log(spark, _exchange_files(spark, sf_dir))
    return t.withColumn("value", F.col("value").cast("string"))


@query(f"""
SELECT key, value FROM (SELECT key, value, row_number() OVER (PARTITION BY key ORDER BY rank DESC) AS k FROM (
  SELECT key, value, 1 - level AS rank FROM ({TABLES_SQL}) UNION ALL SELECT key, value, 2 FROM ({LOGS_SQL}))) WHERE k = 1 AND length(value) > 0
""")
def import_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A store made from a folder of sorted tables and logs: logs win over tables of level 0, these over level 1."""
    store = _store(spark)
    store.import_files(_exchange_files(spark, sf_dir))
    return _text(store.view())
