"""Running aggregates that survive hot groups.

A plain window over ``partitionBy(keys)`` puts a whole group in one task, so a
repository or session holding a third of all rows would be one giant sort.
Groups of ordinary size take exactly that window. A hot group's order values are
cut at their quantiles, from a sketch of fixed size that is merged on the map side,
into strips of about equally many rows, and each strip into as many blocks as its
row count asks for. So values may come dense, sparse or in bursts (dense numbers,
snowflake ids, microseconds). Blocks are summarised with map-side combining, only
the summaries are scanned per group, and the row-level window runs per (group, block).
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexfold.functions.skew import HOT_ROWS, hot_keys

BLOCK_ROWS = 4096
BLOCKS_PER_HOT_GROUP = 256  # for a group of hot_rows rows, and in proportion
STRIPS = 64  # of about equally many rows in every hot group
PART_CHARS = 16 * 1024 * 1024


def block_of(order: str, block: int) -> Column:
    return F.floor(F.col(order) / F.lit(block))


def _strip_and_block(value: Column, cuts: Column, blocks: Column) -> tuple[Column, Column]:
    """Number of the strip between ``cuts`` that holds ``value``, and of its block in it;
    both grow with ``value``, also where a sketched end lies inside the range."""
    strip = F.size(F.filter(cuts, lambda cut: cut <= value))
    low, high = F.get(cuts, strip - 1), F.get(cuts, strip)
    share = (value - low) / (high - low).cast("double")
    return strip.alias("_strip"), F.coalesce(F.floor(share * F.ceil(blocks / STRIPS)), F.lit(0)).alias("_number")


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    order: str | Sequence[str],
    measures: Mapping[str, tuple[str, Column]],
    hot_rows: int = HOT_ROWS,
    hot: DataFrame | None = None,
) -> DataFrame:
    """Add, per measure, its aggregate over the rows *before* each row.

    ``measures`` maps an output name to ``("sum" | "max", column)``. The last
    order column is a whole number unique within keys and the other order
    columns. Before the first row a sum is 0 and a maximum is NULL. ``hot`` gives
    the hot keys, by all or some of ``keys``, where ``df`` is costly to count.
    """
    order = [order] if isinstance(order, str) else list(order)
    keys = list(keys)
    cell = [*keys, "_block"]
    agg = {"sum": F.sum, "max": F.max}
    hot = hot_keys(df, keys, hot_rows) if hot is None else hot
    hot_by = [c for c in hot.columns if c != "_hot"]
    last = F.col(order[-1])
    ranges = df.join(hot, hot_by).groupBy(*keys).agg(
        F.percentile_approx(last, [k / STRIPS for k in range(STRIPS + 1)]).alias("_cuts"), F.count(F.lit(1)).alias("_size")
    )
    block = F.struct(*order[:-1], *_strip_and_block(last, F.col("_cuts"), F.col("_size") * BLOCKS_PER_HOT_GROUP / hot_rows))

    cells = (
        df.join(ranges, keys)
        .withColumns({"_block": block, **{f"_m_{n}": c for n, (_, c) in measures.items()}})
        .groupBy(*cell)
        .agg(*[agg[fn](f"_m_{n}").alias(f"_c_{n}") for n, (fn, _) in measures.items()])
    )
    earlier_cells = (
        Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = cells.select(
        *cell,
        *[agg[fn](f"_c_{n}").over(earlier_cells).alias(f"_o_{n}") for n, (fn, _) in measures.items()],
    )

    earlier_rows = (
        Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    out = (
        df.join(ranges, keys, "left")
        .withColumns(
            {"_block": F.when(F.col("_size").isNotNull(), block), **{f"_m_{n}": c for n, (_, c) in measures.items()}}
        )
        .drop("_cuts", "_size")
        .join(offsets, cell, "left")
    )
    for name, (fn, _) in measures.items():
        local, before = agg[fn](f"_m_{name}").over(earlier_rows), F.col(f"_o_{name}")
        if fn == "sum":
            value = F.coalesce(before, F.lit(0)) + F.coalesce(local, F.lit(0))
        else:
            value = F.greatest(before, local)
        out = out.withColumn(name, value)
    return out.drop("_block", *[f"_{t}_{n}" for n in measures for t in "mo"])


def ordered_text(order: str, text: str) -> Column:
    """Concatenate ``text`` in ``order``; use on groups of bounded size."""
    return F.expr(f"listagg({text}, '') WITHIN GROUP (ORDER BY {order})")
