"""Seeded, reproducible orders: a hash of seed and key replaces a random stream."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def seeded_key(seed: Column, *parts: Column) -> Column:
    """Hex string whose order is a seeded shuffle of ``parts``."""
    return F.md5(F.concat_ws(":", seed.cast("string"), *[p.cast("string") for p in parts]))


def key_bucket(hex_key: Column, digits: int = 3) -> Column:
    """Leading hex digits: an even split that keeps the order of the key."""
    return F.substring(hex_key, 1, digits)


def hash_int(hex_key: Column) -> Column:
    """First 32 bits of a hex key as a whole number."""
    return F.conv(F.substring(hex_key, 1, 8), 16, 10).cast("bigint")


def hash_long(hex_key: Column) -> Column:
    """First 60 bits of a hex key as a whole number."""
    return F.conv(F.substring(hex_key, 1, 15), 16, 10).cast("bigint")


def hash_unit(hex_key: Column) -> Column:
    """First 32 bits of a hex key as a number in [0, 1)."""
    return hash_int(hex_key) / F.lit(4294967296.0)
