"""Hash-based randomness.

``rand(seed)`` depends on how rows are spread over partitions. Hashing a row key
gives the same decision for a row whatever the layout, survives task retries,
and can be recomputed in any SQL engine.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexiloom.functions.text import _col

# Fixed value: what separates the parts of a hashed record.
SEPARATOR = "||"


def seeded_hash(key: Column | str, seed: int | str = 42) -> Column:
    """Hex digest of ``seed`` and ``key``; uniform, so its order is a random order."""
    return F.md5(F.concat_ws(SEPARATOR, F.lit(str(seed)), _col(key).cast("string")))


def unit_interval(digest: Column | str) -> Column:
    """First 32 bits of a hex digest as a number in [0, 1)."""
    return F.conv(F.substring(_col(digest), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def record_key(*columns: Column | str) -> Column:
    """One string from several columns; missing values count as ''."""
    return F.concat_ws(
        SEPARATOR, *[F.coalesce(_col(c).cast("string"), F.lit("")) for c in columns]
    )


def keep_with_probability(key: Column | str, probability: float | Column) -> Column:
    """True for the given share of keys, always the same ones."""
    p = F.lit(probability) if isinstance(probability, (int, float)) else probability
    return unit_interval(F.md5(_col(key).cast("string"))) < p
