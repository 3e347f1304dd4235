"""Key arithmetic, as Python functions for literals and as column expressions for data.

Columns stay inside generated code: no UDFs, no folds over arrays except for user names. Spark runs
with ANSI checks on, so what wraps around in 64 bits is written with masks or in two halves.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SIDE_BITS = 10
SIDE = 1 << SIDE_BITS
CODES = 1 << 3 * SIDE_BITS
OWNER_BITS, TIME_BITS = 22, 42
OWNER_MASK, TIME_MASK = (1 << OWNER_BITS) - 1, (1 << TIME_BITS) - 1
TABLE_SPAN = 1_000_000
INT64_MIN, INT64_MAX = -(1 << 63), (1 << 63) - 1
# FNV-1a, 64 bits, offset and prime.
FNV_OFFSET, FNV_PRIME = 14695981039346656037, 1099511628211


def wrap64(n: int) -> int:
    """n as a signed 64-bit number."""
    return (n + (1 << 63)) % (1 << 64) - (1 << 63)


def _long(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


# Z-order


def spread(n: int) -> int:
    """The low ten bits of n, each moved to three times its place."""
    return sum((n >> k & 1) << 3 * k for k in range(SIDE_BITS))


def gather(code: int) -> int:
    """Inverse of spread(); other bits are ignored."""
    return sum((code >> 3 * k & 1) << k for k in range(SIDE_BITS))


def encode3d(x: int, y: int, z: int) -> int:
    if not all(0 <= v < SIDE for v in (x, y, z)):
        raise ValueError(f"coordinates must be in 0..{SIDE - 1}")
    return spread(x) | spread(y) << 1 | spread(z) << 2


def decode3d(code: int) -> tuple[int, int, int]:
    return gather(code), gather(code >> 1), gather(code >> 2)


def _or(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), parts)


# Masks of ten bits moved apart in four steps, and the widths of the steps.
MASKS, STEPS = (0x30000FF, 0x300F00F, 0x30C30C3, 0x9249249), (16, 8, 4, 2)


def spread_col(c: Column | str) -> Column:
    c = _long(c).bitwiseAND(F.lit(SIDE - 1))
    for step, mask in zip(STEPS, MASKS):
        c = c.bitwiseOR(F.shiftleft(c, step)).bitwiseAND(F.lit(mask))
    return c


def gather_col(c: Column | str) -> Column:
    c = _long(c).bitwiseAND(F.lit(MASKS[-1]))
    for step, mask in zip(reversed(STEPS), (*reversed(MASKS[:-1]), SIDE - 1)):
        c = c.bitwiseXOR(F.shiftright(c, step)).bitwiseAND(F.lit(mask))
    return c


def encode3d_col(x: Column | str, y: Column | str, z: Column | str, strict: bool = True) -> Column:
    """Z-order code; a coordinate outside 0..1023 is an error, or null if not strict."""
    x, y, z = _long(x), _long(y), _long(z)
    code = _or([spread_col(x), F.shiftleft(spread_col(y), 1), F.shiftleft(spread_col(z), 2)])
    ok = x.between(0, SIDE - 1) & y.between(0, SIDE - 1) & z.between(0, SIDE - 1)
    bad = F.raise_error(F.lit(f"coordinates must be in 0..{SIDE - 1}")).cast("long") if strict else F.lit(None).cast("long")
    known = x.isNotNull() & y.isNotNull() & z.isNotNull()
    return F.when(ok, code).when(known, bad)


def decode3d_col(code: Column | str) -> dict[str, Column]:
    code = _long(code)
    return {n: gather_col(F.shiftright(code, k) if k else code).alias(n) for k, n in enumerate("xyz")}


# Owner and time


def timeline_key(owner: int, ms: int) -> int:
    return wrap64((owner & OWNER_MASK) << TIME_BITS | ms & TIME_MASK)


def timeline_time(key: int) -> int:
    return key & TIME_MASK


def timeline_owner(key: int) -> int:
    return key >> TIME_BITS & OWNER_MASK


def cursor_key(owner: int) -> int:
    """Where an owner's last-read time is kept: time 0."""
    return timeline_key(owner, 0)


def timeline_bounds(owner: int, last: int) -> tuple[int, int]:
    """First and last key of an owner after a time. The largest time wraps to 0, as masks do."""
    return timeline_key(owner, last + 1), timeline_key(owner, TIME_MASK)


def timeline_key_col(owner: Column | str, ms: Column | str) -> Column:
    return F.shiftleft(_long(owner).bitwiseAND(F.lit(OWNER_MASK)), TIME_BITS).bitwiseOR(_long(ms).bitwiseAND(F.lit(TIME_MASK)))


def timeline_time_col(key: Column | str) -> Column:
    return _long(key).bitwiseAND(F.lit(TIME_MASK))


def timeline_owner_col(key: Column | str) -> Column:
    return F.shiftright(_long(key), TIME_BITS).bitwiseAND(F.lit(OWNER_MASK))


def owner_of(name: str) -> int:
    """A user's 22-bit number; the public owner, 0, for '' and 'PUBLIC'."""
    if name in ("", "PUBLIC"):
        return 0
    h = 0
    for c in name:
        h = wrap64(h * 31 + ord(c))
    return abs(h) & OWNER_MASK


def owner_of_col(name: Column | str) -> Column:
    """owner_of() of a column: the 64-bit sum is carried as two halves of 32 bits, so nothing overflows."""
    name = (F.col(name) if isinstance(name, str) else name).cast("string")
    low32 = F.lit(0xFFFFFFFF)

    def step(acc: Column, c: Column) -> Column:
        low = acc["lo"] * 31 + F.ascii(c)
        return F.struct(
            (acc["hi"] * 31 + F.shiftright(low, 32)).bitwiseAND(low32).alias("hi"), low.bitwiseAND(low32).alias("lo")
        )

    zero = F.struct(F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"))
    h = F.aggregate(F.split(name, ""), zero, step, lambda a: F.when(
        F.shiftright(a["hi"], 31) == 1, F.pmod(-a["lo"].bitwiseAND(F.lit(OWNER_MASK)), F.lit(OWNER_MASK + 1))
    ).otherwise(a["lo"].bitwiseAND(F.lit(OWNER_MASK))))
    return F.when(name.isin("", "PUBLIC"), F.lit(0).cast("long")).otherwise(h)


# Tables and shards


def fnv1a(data: bytes) -> int:
    h = FNV_OFFSET
    for b in data:
        h = (h ^ b) * FNV_PRIME % (1 << 64)
    return h


def table_range(name: str) -> tuple[int, int]:
    """First and last key of a table in the one key space. Names fold case; the product wraps around."""
    base = wrap64((fnv1a(name.lower().encode()) >> 16 & (1 << 47) - 1) * TABLE_SPAN)
    base = -base if base < 0 else base
    return base, wrap64(base + TABLE_SPAN - 1)


def shard_col(key: Column | str, shards: int) -> Column:
    """The shard of a key, never negative."""
    return F.pmod(_long(key), F.lit(shards).cast("long"))


def epoch_ms(ts: Column | str) -> Column:
    """Milliseconds since 1970 of a timestamp without zone, whatever the session's zone and its clock changes."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    day = F.datediff(ts.cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    minute = (day * 24 + F.hour(ts)) * 60 + F.minute(ts)
    return minute * 60_000 + F.floor(F.date_part(F.lit("SECOND"), ts) * 1000).cast("long")


def _little_endian(c: Column, size: int) -> Column:
    """The hex digits of an integer as `size` bytes, lowest first."""
    digits = F.lpad(F.hex(c), 2 * size, "0")
    return F.concat(*[F.substring(digits, 2 * k + 1, 2) for k in reversed(range(size))])


def crc_of_col(key: Column | str, value: Column | str) -> Column:
    """CRC-32 of a log entry: key (8 bytes) and value length (4), both little-endian, then the value."""
    value = F.col(value) if isinstance(value, str) else value
    return F.crc32(F.concat(F.unhex(F.concat(_little_endian(_long(key), 8), _little_endian(F.length(value), 4))), value))
