"""Record encoding as column expressions: 8-byte big-endian time, then the value's bytes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def long_key(n: Column | str) -> Column:
    """An integer as an 8-byte key that sorts as the integer does (from zero on)."""
    return F.unhex(F.lpad(F.hex(_c(n).cast("long")), 16, "0"))


def encode(t: Column | str, v: Column | str) -> Column:
    return F.concat(long_key(t), _c(v))


def decode_time(rec: Column | str) -> Column:
    """The time of an encoded record; 0 for one shorter than 8 bytes."""
    r = _c(rec)
    return F.when(F.octet_length(r) < 8, F.lit(0).cast("long")).otherwise(F.conv(F.hex(F.substring(r, 1, 8)), 16, -10).cast("long"))


def decode_value(rec: Column | str) -> Column:
    """The value of an encoded record; empty for one shorter than 8 bytes."""
    r = _c(rec)
    return F.when(F.octet_length(r) < 8, F.lit(b"")).otherwise(F.substring(r, F.lit(9), F.octet_length(r)))


def record_string(t: Column | str, v: Column | str) -> Column:
    return F.format_string("%s [%d]", F.decode(_c(v), "UTF-8"), _c(t).cast("long"))


def entry_bytes(k: Column | str, rec: Column | str) -> Column:
    """What a put counts in a memory segment: two lengths, the key, the encoded record."""
    return (F.lit(16) + F.octet_length(_c(k)) + F.octet_length(_c(rec))).cast("long")


def block_bytes(k: Column | str, rec: Column | str) -> Column:
    """What a row takes in a block: two 16-bit lengths, the key, the encoded record."""
    return (F.lit(4) + F.octet_length(_c(k)) + F.octet_length(_c(rec))).cast("long")
