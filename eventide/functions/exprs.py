"""Column expressions shared by operators (all JVM-side built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0

# Event strings understood by the event encoder.
EVENT_TRUE = ("1", "yes", "true", "event", "dead", "death", "y", "t")
EVENT_FALSE = ("0", "no", "false", "censored", "alive", "n", "f")


def hash_int(seed, key: Column) -> Column:
    """First 8 hex digits of md5('seed:key') as an integer in [0, 2^32)."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("long")


def hash_unit(seed, key: Column) -> Column:
    """``hash_int`` scaled to [0, 1) — a deterministic per-row uniform draw."""
    return hash_int(seed, key) / F.lit(TWO_32)


def event_from_string(c: Column) -> Column:
    s = F.lower(F.trim(c.cast("string")))
    return F.when(s.isin(*EVENT_TRUE), 1).when(s.isin(*EVENT_FALSE), 0)
