"""Scalar functions as Column expressions: validation, modular arithmetic, sizes, fingerprints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..limits import NAME_BYTES, SEQUENCE_RANGE


def valid_name(name: Column) -> Column:
    """Whether a topic, group or member may be called so."""
    return F.coalesce(name.rlike(f"^[A-Za-z0-9._-]{{1,{NAME_BYTES}}}$") & ~name.isin(".", ".."), F.lit(False))


def valid_prefix(name: Column) -> Column:
    """Whether stored keys may begin so: nothing, or names parted by single slashes."""
    parts = F.split(name, "/")
    return F.coalesce((name == "") | F.forall(parts, lambda p: p.rlike("^[A-Za-z0-9._-]+$") & ~p.isin(".", "..")), F.lit(False))


def valid_host(name: Column) -> Column:
    """Whether clients may be told this host: 1 to 255 characters without white space or slashes."""
    return F.coalesce(F.length(name).between(1, 255) & ~name.rlike(r"[\s/]"), F.lit(False))


def next_sequence(sequence: Column, count: Column) -> Column:
    """The sequence after a batch: modulo 2^31."""
    return F.pmod(sequence.cast("long") + count.cast("long"), F.lit(SEQUENCE_RANGE))


def wrapped_int(value: Column) -> Column:
    """A long brought into the range of a 32-bit integer by wrapping."""
    return (F.pmod(value + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")


def zigzag(value: Column) -> Column:
    v = value.cast("long")
    return F.shiftleft(v, 1).bitwiseXOR(F.shiftright(v, 63))


def varint_size(value: Column) -> Column:
    """Bytes of a signed number as a zig-zag variable-length integer."""
    z = zigzag(value)
    out = F.lit(10)
    for n in range(9, 0, -1):
        out = F.when(F.shiftrightunsigned(z, 7 * n) == 0, F.lit(n)).otherwise(out)
    return out


def record_size(offset_delta: Column, timestamp_delta: Column, key: Column, value: Column) -> Column:
    """Encoded bytes of a record without headers, its length prefix included."""

    def blob(c: Column) -> Column:
        return F.when(c.isNull(), F.lit(1)).otherwise(varint_size(F.octet_length(c)) + F.octet_length(c))

    body = F.lit(1) + varint_size(timestamp_delta) + varint_size(offset_delta) + blob(key) + blob(value) + F.lit(1)
    return body + varint_size(body)


def framed(*fields: Column) -> Column:
    """Fields in one string that no other fields give: each with its length before it, nulls apart."""
    return F.concat(*[F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-1:")) for f in fields])


def timestamp_span(low: Column, high: Column) -> Column:
    """high - low; null where that overflows."""
    return F.try_subtract(high, low)
