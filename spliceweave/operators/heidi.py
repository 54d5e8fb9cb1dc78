"""Heterogeneity in dependent instruments: do a probe's variants point to one effect, or to several linked ones?

Under one shared causal variant the ratio of GWAS effect and QTL effect is the same for all variants of a region. The test compares
each variant's ratio with that of the top variant; linkage between variants (from dosages) gives the covariance of these differences, and the sum
of squared z-scores is a weighted sum of chi-squares.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceweave.functions.distributions import weighted_chi2_sf
from spliceweave.operators.gwas import best_hit
from spliceweave.session import cut_lineage, ship_package


def pairwise_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlations of the rows of two dosage tables over the donors that both rows have (NaN: missing, or no variation)."""
    seen_a, seen_b = ~np.isnan(a), ~np.isnan(b)
    x, y = np.where(seen_a, a, 0.0), np.where(seen_b, b, 0.0)
    n = seen_a.astype(float) @ seen_b.T
    sx, sy = x @ seen_b.T, seen_a @ y.T
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = (x @ y.T) - sx * sy / n
        var = ((x * x) @ seen_b.T - sx * sx / n) * (seen_a @ (y * y).T - sy * sy / n)
        return np.where(var > 1e-18, cov / np.sqrt(var), np.nan)


def row_correlation(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Correlation of each row of one dosage table with the same row of another, over the donors that both have (NaN: missing, or no variation)."""
    both = ~(np.isnan(a) | np.isnan(b))
    x, y, n = np.where(both, a, 0.0), np.where(both, b, 0.0), both.sum(axis=1)
    sx, sy = x.sum(axis=1), y.sum(axis=1)
    with np.errstate(invalid="ignore", divide="ignore"):
        cov = (x * y).sum(axis=1) - sx * sy / n
        var = ((x * x).sum(axis=1) - sx * sx / n) * ((y * y).sum(axis=1) - sy * sy / n)
        return np.where(var > 1e-18, cov / np.sqrt(var), np.nan)


def ratio_covariance(b_x, se_x, b_y, se_y, r) -> np.ndarray:
    """Covariance of the ratios b_y / b_x of variants with correlations ``r``, to second order (delta method)."""
    ratio, z = b_y / b_x, b_x / se_x
    rise, zz = np.outer(se_y / b_x, se_y / b_x), np.outer(z, z)
    return r * rise + np.outer(ratio, ratio) * (r / zz - 1.0 / zz**2)


def heterogeneity(b_x, se_x, b_y, se_y, r) -> tuple[int, float, float]:
    """(variants compared, statistic, p) with the top variant first; p is NaN where nothing can be compared."""
    cov, ratio = ratio_covariance(b_x, se_x, b_y, se_y, r), b_y / b_x
    gap = ratio[1:] - ratio[0]
    both = cov[1:, 1:] - cov[1:, :1] - cov[:1, 1:] + cov[0, 0]
    use = np.diag(both) > 1e-18
    if not use.any():
        return 0, float("nan"), float("nan")
    sd = np.sqrt(np.diag(both)[use])
    z = gap[use] / sd
    stat = float(z @ z)
    weights = np.linalg.eigvalsh(both[np.ix_(use, use)] / np.outer(sd, sd))
    return int(use.sum()), stat, weighted_chi2_sf(stat, weights)


def heidi(merged: DataFrame, genotypes: DataFrame, probe: Sequence[str], p_qtl_max: float = 1.57e-3, min_r2: float = 0.05, max_r2: float = 0.9,
          most: int = 20, tie: Sequence[str] = ()) -> DataFrame:
    """(probe..., top, n_variants, t_heidi, p_heidi) of every probe with a top variant and another one to compare.

    ``merged`` has a probe's variants: variant_id, beta_gwas, se_gwas, beta_sqtl, se_sqtl, p_sqtl; of a variant's rows the one with the smallest p (then
    ``tie``) counts. ``genotypes`` (variant_id, dosage ARRAY over the donors). Variants with a QTL p of at most ``p_qtl_max`` take part if their
    squared correlation with the top variant is from ``min_r2`` to ``max_r2``; of these the ``most`` with the smallest p are compared, as the
    method defines it. Only these meet in one group: variants are compared with their probe's top variant a batch at a time.
    """
    ship_package(merged.sparkSession)
    probe = list(probe)
    known = merged.filter((F.col("p_sqtl") <= p_qtl_max) & (F.col("beta_sqtl") != 0) & (F.col("se_sqtl") > 0) & (F.col("se_gwas") > 0) & F.col("beta_gwas").isNotNull())
    listed = best_hit(known, [*probe, "variant_id"], "p_sqtl", list(tie)).select(
        *probe, "variant_id", "beta_gwas", "se_gwas", "beta_sqtl", "se_sqtl", "p_sqtl")
    # merged: dosages made from a small file would else be broadcast
    rows = cut_lineage(listed.join(genotypes.select("variant_id", F.col("dosage").cast("array<double>").alias("dosage")).hint("merge"), "variant_id"))
    first = F.min(F.struct("p_sqtl", "variant_id", "dosage")).alias("first")
    names = rows.columns
    tops = rows.groupBy(*probe).agg(first).select(*probe, F.col("first.variant_id").alias("top"), F.col("first.dosage").alias("top_dosage"))

    def against_top(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            with_top = row_correlation(*(np.vstack([np.array(d, float) for d in pdf[c]]) for c in ("dosage", "top_dosage"))) ** 2
            keep = (pdf.variant_id == pdf.top) | ((with_top >= min_r2) & (with_top <= max_r2))
            yield pdf.loc[keep, [*names, "top"]]

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    near = rows.join(tops, probe).mapInPandas(against_top, ", ".join(f"`{c}` {kinds[c]}" for c in names) + f", top {kinds['variant_id']}")
    place = F.row_number().over(Window.partitionBy(*probe).orderBy("p_sqtl", "variant_id"))  # the top variant comes first
    picked = near.withColumn("__place", place).filter(F.col("__place") <= most + 1).drop("__place")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) < 2:
            return pd.DataFrame()
        pdf = pdf.sort_values(["p_sqtl", "variant_id"], ignore_index=True)
        doses = np.vstack([np.array(d, float) for d in pdf.dosage])
        b_x, se_x, b_y, se_y = (pdf[c].to_numpy(float) for c in ("beta_sqtl", "se_sqtl", "beta_gwas", "se_gwas"))
        r = np.nan_to_num(pairwise_correlation(doses, doses))
        np.fill_diagonal(r, 1.0)
        n, stat, p = heterogeneity(b_x, se_x, b_y, se_y, r)
        return pd.DataFrame([{**{c: pdf[c].iloc[0] for c in probe}, "top": pdf.top.iloc[0], "n_variants": n, "t_heidi": stat, "p_heidi": p}]) if n else pd.DataFrame()

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in probe) + f", top {kinds['variant_id']}, n_variants bigint, t_heidi double, p_heidi double"
    return picked.groupBy(*probe).applyInPandas(run, schema)
