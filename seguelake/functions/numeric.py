"""Small numeric helpers shared by the column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clip(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    """Bound ``x``; null stays null."""
    return F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(lo)), F.lit(hi)))


def rounded(x: Column, digits: int = 6) -> Column:
    """Round half away from zero in double arithmetic; no negative zero."""
    scale = F.lit(10.0**digits)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + F.lit(0.0)


def mean_of(*parts: Column) -> Column:
    """Mean over the non-null arguments; null when all are null."""
    # plain sums: functions over arrays are interpreted row by row
    total, known = F.lit(0.0), F.lit(0)
    for part in parts:
        total, known = total + F.coalesce(part.cast("double"), F.lit(0.0)), known + part.isNotNull().cast("int")
    return F.when(known > 0, total / known)


def lookup(key: Column, table: dict, default=None) -> Column:
    """Value of a small fixed table, as a literal map."""
    pairs = [F.lit(x) for item in table.items() for x in item]
    found = F.try_element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))
