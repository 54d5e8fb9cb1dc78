"""Context strata: tertiles, balanced down-sampling and seeded draws."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.operators.ordering import join_null_safe, order_statistics, rank_by_key

TERTILES = [(1, 3), (2, 3)]


def tertile_cuts(df: DataFrame, value: str, group: Sequence[str] = ()) -> DataFrame:
    """(group, lower, upper): the values of rank ceil(n/3) and ceil(2n/3)."""
    cuts = order_statistics(df, value, TERTILES, group)
    pick = [F.max(F.when(F.col("num") == k, F.col("cut"))).alias(name) for k, name in ((1, "lower"), (2, "upper"))]
    return cuts.groupBy(*group).agg(*pick)


def stratum(value, lower, upper) -> Column:
    """low: x < lower; mid: lower <= x <= upper; high: x > upper."""
    x, lo, hi = (F.col(c) if isinstance(c, str) else c for c in (value, lower, upper))
    return F.when(x < lo, "low").when(x <= hi, "mid").when(x > hi, "high")


def with_tertile(df: DataFrame, value: str, group: Sequence[str] = (), out: str = "stratum") -> DataFrame:
    g = list(group) or ["__all"]
    left = df if group else df.withColumn("__all", F.lit(1))
    cuts = tertile_cuts(left, value, group)
    if not group:
        cuts = F.broadcast(cuts.withColumn("__all", F.lit(1)))  # one row
    return join_null_safe(left, cuts, g).withColumn(out, stratum(value, "lower", "upper")).drop("__all", "lower", "upper")


def seeded_key(seed: int, *ids) -> Column:
    """32-bit draw order of a row, a pure function of seed and ids."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *ids), 32)


def balanced_sample(
    df: DataFrame,
    balance: str,
    within: Sequence[str],
    ids: Sequence[str],
    seed: int = 0,
    order_key: Column | None = None,
) -> DataFrame:
    """Down-sample without replacement so all ``balance`` levels are equal inside each ``within``.

    Rows are taken in the order of a seeded 32-bit key; ranks are built block by block, so two or
    four strata over any number of rows do not end up in two or four tasks.
    """
    keyed = df.withColumn("__key", order_key if order_key is not None else seeded_key(seed, *ids))
    sizes = keyed.groupBy(*within, balance).agg(F.count(F.lit(1)).alias("__n"))
    quota = sizes.groupBy(*within).agg(F.min("__n").alias("__quota"))
    ranked = rank_by_key(keyed, [*within, balance], "__key", ids, key_bits=32, out="__rank")
    return (
        join_null_safe(ranked, quota, within).filter(F.col("__rank") <= F.col("__quota"))
        .drop("__key", "__rank", "__quota")
    )

