"""Multiple-testing corrections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceweave.operators.ordering import join_null_safe, probability_block


def benjamini_hochberg(
    df: DataFrame, p: str = "p", out: str = "q", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Benjamini-Hochberg adjusted p-values.

    NULL p-values stay NULL but count in ``n``. Corrections run over the whole table, or inside
    each ``partition_by`` group. Equal p-values share one row while ranking, and ranks are
    computed block by block, so neither ties nor one huge group end up in a single task.
    """
    g = list(partition_by)
    tally = df.groupBy(*g, p).agg(F.count(F.lit(1)).alias("__c")).withColumn("__block", probability_block(p))

    blocks = tally.groupBy(*g, "__block").agg(F.sum("__c").alias("__bc"))
    before = Window.partitionBy(*g).orderBy(F.col("__block").asc_nulls_first()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    known = F.when(F.col("__block").isNotNull(), F.col("__bc"))
    blocks = (
        blocks.withColumn("__n", F.sum("__bc").over(Window.partitionBy(*g)))
        .withColumn("__before", F.coalesce(F.sum(known).over(before), F.lit(0)))
        .filter(F.col("__block").isNotNull())
        .drop("__bc")
    )
    inside = Window.partitionBy(*g, "__block").orderBy(p)
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = join_null_safe(tally.filter(F.col(p).isNotNull()), blocks, [*g, "__block"]).select(
        *g, p, "__block",
        (F.col("__n") * F.col(p) / (F.col("__before") + F.sum("__c").over(upto))).alias("__raw"),
    )

    later = Window.partitionBy(*g).orderBy(F.col("__block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    tails = ranked.groupBy(*g, "__block").agg(F.min("__raw").alias("__m")).select(
        *g, "__block", F.min("__m").over(later).alias("__tail")
    )
    from_here = inside.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    adjusted = join_null_safe(ranked, tails, [*g, "__block"]).select(
        *g, p,
        F.least(F.lit(1.0), F.min("__raw").over(from_here), F.col("__tail")).alias(out),
    )
    tested = join_null_safe(df.filter(F.col(p).isNotNull()), adjusted, [*g, p], "left")
    untested = df.filter(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double"))
    return tested.unionByName(untested)


def bonferroni(p, n) -> Column:
    """min(1, p * n), the single-value adjustment."""
    p = F.col(p) if isinstance(p, str) else p
    n = F.col(n) if isinstance(n, str) else F.lit(n)
    return F.least(F.lit(1.0), p * n)


def chunk_number(ordinal, size: int = 1000) -> Column:
    """1-based chunk of a 1-based row ordinal."""
    c = F.col(ordinal) if isinstance(ordinal, str) else ordinal
    return F.ceil(c / F.lit(size)).cast("bigint")
