"""Phenotype filtering, imputation and wide/long reshaping."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceweave.session import cut_lineage


def site_spread(usage: DataFrame, site: Sequence[str], n_samples: int, ddof: int = 1) -> DataFrame:
    """Per site: covered samples, sparsity over ``n_samples``, SD of the usage ratio, medians.

    Only covered samples need rows; absent (site, sample) pairs count as zero coverage.
    """
    seen = F.col("total") > 0
    sd = F.stddev_samp if ddof == 1 else F.stddev_pop
    return usage.groupBy(*site).agg(
        F.count_if(seen).alias("n_covered"),
        (F.lit(1.0) - F.count_if(seen) / F.lit(n_samples)).alias("sparsity"),
        sd(F.when(seen, F.col("included") / F.col("total"))).alias("sd"),
        F.median(F.when(seen, F.col("included"))).alias("median_included"),
        F.median(F.when(seen, F.col("total"))).alias("median_total"),
    )


def retained_sites(
    usage: DataFrame, site: Sequence[str], n_samples: int, min_sd: float = 0.1, max_sparsity: float = 0.5, ddof: int = 1
) -> DataFrame:
    """Sites with sparsity strictly below and SD strictly above the thresholds."""
    return site_spread(usage, site, n_samples, ddof).filter(
        (F.col("sparsity") < max_sparsity) & (F.col("sd") > min_sd)
    )


def fill_uncovered(
    usage: DataFrame,
    retained: DataFrame,
    site: Sequence[str],
    samples: DataFrame,
    n_samples: int,
    sample: str = "metacell",
    rounding: str = "half_even",
) -> DataFrame:
    """Every retained site for every sample; uncovered cells get the site's median counts.

    ``samples`` is (sample_idx 0..n-1, sample). Rows are expanded from the index range, which is
    the size of the result. ``rounding``: half_even, half_up or none for medians ending in .5.
    """
    fill = {"half_even": F.bround, "half_up": F.round, "none": lambda c: c}[rounding]
    grid = retained.select(
        *site,
        fill(F.col("median_included")).alias("__mi"),
        fill(F.col("median_total")).alias("__mt"),
        F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))).alias("sample_idx"),
    ).join(samples.select(F.col("sample_idx").cast("int"), sample), "sample_idx")
    seen = usage.filter("total > 0").select(*site, sample, "included", "total")
    out_type = "double" if rounding == "none" else "bigint"
    return grid.join(seen, [*site, sample], "left").select(
        *site, sample, "sample_idx",
        F.coalesce(F.col("included").cast(out_type), F.col("__mi").cast(out_type)).alias("included"),
        F.coalesce(F.col("total").cast(out_type), F.col("__mt").cast(out_type)).alias("total"),
        F.col("total").isNull().alias("imputed"),
    )


def filter_phenotype(
    usage: DataFrame,
    site: Sequence[str],
    samples: DataFrame,
    n_samples: int,
    min_sd: float = 0.1,
    max_sparsity: float = 0.5,
    sample: str = "metacell",
    ddof: int = 1,
    rounding: str = "half_even",
) -> DataFrame:
    """Retained sites, dense over samples, with counts, usage ratio and ``imputed``."""
    usage = cut_lineage(usage)  # read twice: thresholds, then fill
    kept = retained_sites(usage, site, n_samples, min_sd, max_sparsity, ddof)
    filled = fill_uncovered(usage, kept, site, samples, n_samples, sample, rounding)
    return filled.withColumn("ratio", F.round(F.try_divide("included", "total"), 6))


def drop_all_zero(counts: DataFrame, site: Sequence[str], value: str = "n") -> DataFrame:
    """Rows of sites whose values do not all sum to zero over the samples."""
    alive = counts.groupBy(*site).agg(F.sum(value).alias("__s")).filter("__s > 0").select(*site)
    return counts.join(alive, list(site), "left_semi")


def widen(long: DataFrame, rows: Sequence[str], sample: str, value: str, names: Sequence[str], fill=0) -> DataFrame:
    """Long to wide with one column per named sample (export only). A sample that is not named is an error."""
    known = F.when(F.col(sample).isin(*names), F.col(sample)).otherwise(F.raise_error(F.concat(F.lit("no column for sample "), F.col(sample))))
    wide = long.withColumn(sample, known).groupBy(*rows).pivot(sample, list(names)).agg(F.first(value))
    return wide.na.fill(fill) if fill is not None else wide


def lengthen(wide: DataFrame, rows: Sequence[str], names: Sequence[str], sample: str, value: str) -> DataFrame:
    """Wide sample columns back to one row per (row, sample)."""
    return wide.unpivot(list(rows), list(names), sample, value)


def rows_by_name(df: DataFrame, names: DataFrame, key: str) -> DataFrame:
    """Rows whose key is listed, in list order; ``names`` is (key, ord). Repeated names repeat rows."""
    return df.join(names.select(key, "ord"), key).orderBy("ord").drop("ord")


def covariates_by_sample(long: DataFrame, names: Sequence[str], sample: str = "metacell") -> DataFrame:
    """(sample, cov, value) rows transposed to one named column per covariate."""
    return long.groupBy(sample).pivot("cov", list(names)).agg(F.first("value"))
