"""Exact ranks, order statistics and row numbers that never sort one group in one task.

A window with one huge partition runs in a single task. Here a group is cut into ordered
blocks first: block sizes are counted, a running sum over the (small) block table gives each
block's offset, and rows are ranked inside their own block only.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join that also matches NULL keys, keeping the left copy of the keys."""
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    cond = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def probability_block(p) -> Column:
    """Monotone block number of a probability: fine near 0 and near 1, about 0.6 million at most."""
    c = F.col(p) if isinstance(p, str) else p
    odds = F.log2(c) - F.log2(F.lit(1.0) - c)
    return (
        F.when(c <= 0, F.lit(-10_000_000))
        .when(c >= 1, F.lit(10_000_000))
        .otherwise(F.floor(odds * 512))
        .cast("bigint")
    )


def block_offsets(df: DataFrame, group: Sequence[str], block: str, weight: Column) -> DataFrame:
    """(group, block, before): summed weight of all earlier blocks of the same group."""
    per_block = df.groupBy(*group, block).agg(F.sum(weight).alias("__w"))
    earlier = Window.partitionBy(*group).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return per_block.select(
        *group, block, F.coalesce(F.sum("__w").over(earlier), F.lit(0)).alias("before")
    )


def rank_by_key(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    tie: Sequence[str],
    key_bits: int,
    out: str = "rank",
) -> DataFrame:
    """Row number of each row in its group by an (unsigned, evenly spread) integer key.

    The top 16 of ``key_bits`` bits name the block, so a group is ranked in up to 65,536 parts.
    """
    shift = max(key_bits - 16, 0)
    blocked = df.withColumn("__block", F.shiftright(F.col(key), shift))
    offsets = block_offsets(blocked, group, "__block", F.lit(1))
    inside = Window.partitionBy(*group, "__block").orderBy(key, *tie)
    return (
        join_null_safe(blocked, offsets, [*group, "__block"])
        .withColumn(out, F.col("before") + F.row_number().over(inside))
        .drop("__block", "before")
    )


def order_statistics(
    df: DataFrame,
    value: str,
    fractions: Sequence[tuple[int, int]],
    group: Sequence[str] = (),
) -> DataFrame:
    """Exact nearest-rank cut points: the value of rank ceil(n * num / den).

    Returns (group, num, den, n, cut). A quantile sketch brackets each cut to a sliver of the
    rows; only the distinct values inside the bracket are ranked, and rows below are counted.
    """
    accuracy, slack = 20_000, 1e-4
    keys = list(group) or ["__all"]
    rows = df.filter(F.col(value).isNotNull())
    if not group:
        rows = rows.withColumn("__all", F.lit(1))
    rows = rows.select(*keys, F.col(value).alias("__v"))
    bounds = []
    for num, den in fractions:
        f = num / den
        bounds += [max(f - slack, 0.0), min(f + slack, 1.0)]
    sketch = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("__v", bounds, accuracy).alias("__b"),
    )
    cuts = F.array(*[
        F.struct(
            F.lit(num).alias("num"),
            F.lit(den).alias("den"),
            F.ceil(F.col("n") * F.lit(num) / F.lit(den)).alias("k"),
            F.col("__b")[2 * i].alias("lo"),
            F.col("__b")[2 * i + 1].alias("hi"),
        )
        for i, (num, den) in enumerate(fractions)
    ])
    wanted = sketch.select(*keys, "n", F.inline(cuts))
    if not group:
        wanted = F.broadcast(wanted)  # one row per cut point
    # one pass: rows below a bracket collapse to one counter, rows inside to one per value
    hit = (
        join_null_safe(rows, wanted, keys)
        .filter(F.col("__v") <= F.col("hi"))
        .withColumn("__in", F.when(F.col("__v") >= F.col("lo"), F.col("__v")))
        .groupBy(*keys, "num", "den", "n", "k", "__in")
        .agg(F.count(F.lit(1)).alias("__c"))
    )
    running = Window.partitionBy(*keys, "num", "den").orderBy(F.col("__in").asc_nulls_first())
    upto = running.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        hit.withColumn("__cum", F.sum("__c").over(upto))
        .filter(F.col("__in").isNotNull() & (F.col("__cum") >= F.col("k")))
        .groupBy(*keys, "num", "den", "n")
        .agg(F.min("__in").alias("cut"))
        .select(*group, "num", "den", "n", "cut")
    )


def row_slice(df: DataFrame, first: int, last: int) -> DataFrame:
    """Rows ``first``..``last`` (1-based, inclusive) in scan order; empty when first exceeds the table."""
    return with_line_number(df, "__line").filter(F.col("__line").between(first - 1, last - 1)).drop("__line")


def with_line_number(df: DataFrame, out: str = "line") -> DataFrame:
    """0-based row number in scan order, from per-partition counts (no single-task sort)."""
    tagged = df.withColumn("__id", F.monotonically_increasing_id())
    part = F.shiftright(F.col("__id"), 33)
    sizes = tagged.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(earlier), F.lit(0)).alias("__start"))
    inside = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return (
        tagged.withColumn("__part", part)
        .join(starts, "__part")
        .withColumn(out, F.col("__start") + inside)
        .drop("__part", "__start", "__id")
    )
