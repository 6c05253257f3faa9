"""Stable content hashes and hash ordering."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEPARATOR = "|"


def seeded(seed: int | str, *parts: Column) -> Column:
    """Hex SHA-256 of the seed and the parts; sorts rows in a repeatable random order."""
    return F.sha2(F.concat_ws(SEPARATOR, F.lit(str(seed)), *[p.cast("string") for p in parts]), 256)


def content(*parts: Column) -> Column:
    """Fingerprint of a row's canonical JSON."""
    return F.sha2(F.to_json(F.struct(*parts)), 256)


def edge(a: Column, b: Column) -> Column:
    """Fingerprint of an ordered pair."""
    return F.sha1(F.concat_ws("->", a.cast("string"), b.cast("string")))


def prefix(hash_col: Column, n: int = 3) -> Column:
    """Leading hex digits: equal-sized bins along hash order."""
    return F.substring(hash_col, 1, n)
