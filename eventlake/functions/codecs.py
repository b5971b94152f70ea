"""Scalar encodings as column expressions."""

from __future__ import annotations

from functools import lru_cache, reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def zigzag(n: Column) -> Column:
    """0, -1, 1, -2 ... as 0, 1, 2, 3 ..."""
    n = n.cast("bigint")
    return F.shiftleft(n, 1).bitwiseXOR(F.shiftright(n, 63))


def unzigzag(z: Column) -> Column:
    return F.shiftrightunsigned(z, 1).bitwiseXOR(-z.bitwiseAND(F.lit(1)))


def varint_hex(z: Column) -> Column:
    """Seven bits a byte, the lowest first, the high bit set on all but the last, as hex."""
    def byte(i: int) -> Column:
        rest = F.shiftrightunsigned(z, 7 * i)
        more = F.shiftrightunsigned(z, 7 * (i + 1)) != 0 if i < 9 else F.lit(False)
        value = rest.bitwiseAND(F.lit(127)) + F.when(more, 128).otherwise(0)
        return F.when((rest != 0) | F.lit(i == 0), F.lpad(F.lower(F.hex(value)), 2, "0")).otherwise("")

    return F.concat(*(byte(i) for i in range(10)))


def envelope_hex(schema_id: Column, payload: Column) -> Column:
    """Magic byte 0, the schema id as four big-endian bytes, then the payload, as hex."""
    return F.concat(F.lit("00"), F.lpad(F.lower(F.hex(schema_id.cast("bigint"))), 8, "0"), F.lower(F.hex(payload.cast("binary"))))


def frame_hex(payload: Column) -> Column:
    """The payload's length as four big-endian bytes, then the payload, as hex."""
    body = payload.cast("binary")
    return F.concat(F.lpad(F.lower(F.hex(F.octet_length(body).cast("bigint"))), 8, "0"), F.lower(F.hex(body)))


@lru_cache
def _crc32c_rows() -> tuple[int, ...]:
    """The byte table of the reflected polynomial 0x82F63B78, by its rule."""
    out = []
    for n in range(256):
        for _ in range(8):
            n = n >> 1 ^ (0x82F63B78 if n & 1 else 0)
        out.append(n)
    return tuple(out)


def crc32c(data: Column) -> Column:
    """CRC-32C of bytes, by a fold over their hex digits against a table literal; null for null."""
    table = F.array(*(F.lit(x).cast("bigint") for x in _crc32c_rows()))
    codes = F.transform(F.split(F.regexp_replace(F.hex(data.cast("binary")), "(..)", "$1 "), " "), lambda h: F.conv(h, 16, 10).cast("bigint"))
    body = F.filter(codes, lambda c: c.isNotNull())

    def step(table: Column) -> Column:
        return F.aggregate(body, F.lit(0xFFFFFFFF).cast("bigint"), lambda a, c: F.shiftright(a, 8).bitwiseXOR(F.get(table, a.bitwiseXOR(c).bitwiseAND(F.lit(255)).cast("int"))))

    return F.get(F.transform(F.array(table), step), F.lit(0)).bitwiseXOR(F.lit(0xFFFFFFFF).cast("bigint"))


def shared_prefix(a: Column, b: Column) -> Column:
    """How many leading characters two strings share."""
    n = F.least(F.length(a), F.length(b))
    same = F.filter(F.sequence(F.lit(0), n), lambda i: F.substr(a, F.lit(1), i) == F.substr(b, F.lit(1), i))
    return F.coalesce(F.array_max(same), F.lit(0))


def coalesce_first(*pairs: tuple[Column, Column], otherwise: Column) -> Column:
    """The value of the first condition that holds."""
    head, *rest = pairs
    return reduce(lambda w, p: w.when(p[0], p[1]), rest, F.when(head[0], head[1])).otherwise(otherwise)
