"""Hot keys: found by counting, split only where they occur.

A key is hot when it has more than ``hot_rows`` rows. Counting is a map-side
combined aggregate over the key columns alone. The list of hot keys grows with the data, so
nothing here asks for a broadcast: Spark decides by its size. With no hot key
adaptive execution removes the joins on it altogether, so ordinary data pays for
the count only.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_ROWS = 1_000_000
SALTS = 4096


def hot_keys(df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS) -> DataFrame:
    """Keys with more than ``hot_rows`` rows, marked ``_hot``."""
    counted = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows")).where(F.col("_rows") > hot_rows)
    return counted.select(*keys, F.lit(True).alias("_hot"))


def lookup_join(
    large: DataFrame,
    unique: DataFrame,
    on: Sequence[str],
    spread: Column,
    how: str = "left",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Join ``large`` with a side that has one row per key.

    Rows of a hot key go to one of ``SALTS`` salts by the hash of ``spread``,
    and only the hot keys of the unique side are repeated, once per salt.
    """
    on = list(on)
    hot = hot_keys(large, on, hot_rows)
    salt = F.when(F.col("_hot"), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int")).otherwise(0)
    copies = F.sequence(F.lit(0), F.when(F.col("_hot"), SALTS - 1).otherwise(0))
    salted = large.join(hot, on, "left").withColumn("_salt", salt).drop("_hot")
    repeated = unique.join(hot, on, "left").withColumn("_salt", F.explode(copies)).drop("_hot")
    return salted.join(repeated, [*on, "_salt"], how).drop("_salt")
