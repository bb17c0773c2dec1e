"""Response patterns: a table of rows becomes its distinct rows with summed weights, without loss.

One aggregation with map-side combination; null is a code of its own.  Iterations then cost by patterns, not by rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def collapse(df: DataFrame, items: Sequence[str], weight: str | None = None, extra: Sequence[str] = (), names: tuple[str, str] = ("w", "n")) -> DataFrame:
    """Distinct rows of items (and extra columns) with w, the sum of weights, and n, the number of rows (or other `names`)."""
    w = F.sum(F.col(weight)) if weight else F.sum(F.lit(1.0))
    return df.groupBy(*(F.col(f"`{c}`") for c in [*items, *extra])).agg(w.alias(names[0]), F.count(F.lit(1)).alias(names[1]))


def numbered(patterns: DataFrame, items: Sequence[str]) -> DataFrame:
    """Patterns with pattern_id, numbered from 1 in the order of their items, null first.

    Patterns are numbered within those of the same first half of the items, in parallel; only these halves, about the square root of
    the patterns, are put in order in one task.
    """
    from pyspark.sql import Window

    order = lambda cols: [F.col(f"`{c}`").asc_nulls_first() for c in cols]
    half = list(items[: max(1, len(items) // 2)])
    sizes = patterns.groupBy(*(F.col(f"`{c}`") for c in half)).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy(*order(half)).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*(F.col(f"`{c}`").alias(f"_h{i}") for i, c in enumerate(half)), before.alias("_before"))
    own = patterns.withColumn("_own", F.row_number().over(Window.partitionBy(*(F.col(f"`{c}`") for c in half)).orderBy(*order(items[len(half) :] or half))))
    same = F.lit(True)
    for i, c in enumerate(half):
        same = same & F.col(f"`{c}`").eqNullSafe(F.col(f"_h{i}"))
    out = own.join(offsets, same).withColumn("pattern_id", (F.col("_before") + F.col("_own")).cast("int"))
    return out.drop("_own", "_before", *(f"_h{i}" for i in range(len(half))))


def expand(df: DataFrame, patterns: DataFrame, items: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Each row of df with its pattern's values, in place of columns of the same name (null-safe join; Spark broadcasts the patterns where they are small enough)."""
    df = df.drop(*values)
    p = patterns.select(*(F.col(f"`{c}`").alias(f"_p{k}") for k, c in enumerate(items)), *values)
    same = F.lit(True)
    for k, c in enumerate(items):
        same = same & df[f"`{c}`"].eqNullSafe(p[f"_p{k}"])
    return df.join(p, same, "left").drop(*(f"_p{k}" for k in range(len(items))))


def worth_collapsing(df: DataFrame, items: Sequence[str], most: float = 0.5) -> bool:
    """Whether at most that share of rows are distinct patterns (approximate count, one pass)."""
    row = df.agg(F.approx_count_distinct(F.struct(*(F.col(f"`{c}`") for c in items))).alias("d"), F.count(F.lit(1)).alias("n")).first()
    return row.n > 0 and row.d <= most * row.n
