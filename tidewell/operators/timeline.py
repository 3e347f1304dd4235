"""Messages in mailboxes: keys of owner and time, fan-out on write, reads after a cursor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.keys import cursor_key, owner_of, owner_of_col, timeline_bounds, timeline_key_col, timeline_owner_col, timeline_time_col

MESSAGE = "sender string, receiver string, body string, ts bigint"
PUBLIC = 0


def encode_message(sender: Column, receiver: Column, body: Column, ts: Column) -> Column:
    return F.to_json(F.struct(sender.alias("sender"), receiver.alias("receiver"), body.alias("body"), ts.alias("ts")))


def fan_out(messages: DataFrame) -> DataFrame:
    """Records (key, value) of messages (sender, receiver, body, ts): one for the public owner, else one for
    the sender and one for the receiver, a single one if these have the same number. Times below 1 become 1."""
    ts = F.greatest(F.col("ts").cast("long"), F.lit(1).cast("long"))
    to = owner_of_col("receiver")
    owners = F.when(to == PUBLIC, F.array(to)).otherwise(F.array_distinct(F.array(owner_of_col("sender"), to)))
    text = encode_message(F.col("sender"), F.col("receiver"), F.col("body"), ts)
    return messages.select(F.explode(owners).alias("owner"), ts.alias("ts"), text.alias("text")).select(
        timeline_key_col("owner", "ts").alias("key"), F.col("text").cast("binary").alias("value")
    )


def mailbox(records: DataFrame, owner: int, last: int = 0) -> DataFrame:
    """Records of an owner after a time, in order: one key range, pushed down to the scan."""
    a, b = timeline_bounds(owner, last)
    return records.where(F.col("key").between(a, b)).orderBy("key")


def sync(records: DataFrame, caller: str, target: str = "", last: int = 0, cursor: int | None = None) -> DataFrame:
    """Messages of the public mailbox for '' or PUBLIC, else of the caller's own, after `last` or else the cursor. Texts that are not messages are left out."""
    owner = PUBLIC if target in ("", "PUBLIC") else owner_of(caller)
    rows = mailbox(records, owner, last if last > 0 else cursor or 0)
    m = rows.select("key", F.from_json(F.col("value").cast("string"), MESSAGE).alias("m"))
    return m.where(F.col("m.ts").isNotNull()).select("key", "m.*")


def cursors(read: DataFrame) -> DataFrame:
    """Cursor records (key, value) from what was read (key): the last time of each owner, as text, at its time 0."""
    last = read.groupBy(timeline_owner_col("key").alias("owner")).agg(F.max(timeline_time_col("key")).alias("ts"))
    return last.select(timeline_key_col("owner", F.lit(0)).alias("key"), F.col("ts").cast("string").cast("binary").alias("value"))


def cursor_at(owner: int) -> int:
    return cursor_key(owner)
