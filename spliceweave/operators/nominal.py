"""Linear cis comparator: rank-normalised phenotypes, covariates, nominal p-values."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceweave.functions.distributions import correlation_p, norm_ppf
from spliceweave.operators.association import cis_qtl
from spliceweave.session import cut_lineage, ship_package

LINEAR_SCHEMA = (
    "site string, chrom string, strand string, pos bigint, sqrt_r double, resid array<double>, w array<double>, "
    "xw array<double>, xwx_inv array<double>, xr array<double>, n bigint, n_cov bigint"
)


def rank_normal(pheno: DataFrame, value: str = "ratio", out: str = "value") -> DataFrame:
    """Normal quantile of (average rank - 0.5) / n within each site."""
    site = Window.partitionBy("site")
    first = F.rank().over(site.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy("site", value))
    level = (first + (ties - 1) / 2 - 0.5) / F.count(F.lit(1)).over(site)
    return pheno.filter(F.col(value).isNotNull()).withColumn("__level", level).withColumn(
        out, norm_ppf("__level")).drop("__level")


def _linear_site(n_donors: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf.x.to_numpy())]) if len(pdf.x.iloc[0]) else np.ones((len(pdf), 1))
        y, d = pdf.value.to_numpy(float), pdf.donor_idx.to_numpy(int)
        inv = np.linalg.pinv(x.T @ x)
        res = y - x @ (inv @ (x.T @ y))
        spread = float(np.sqrt(np.mean(res * res)))
        if not spread > 0:
            return pd.DataFrame()
        head = pdf.iloc[0]
        by = lambda v: np.bincount(d, v, n_donors)
        return pd.DataFrame([{
            "site": head.site, "chrom": head.chrom, "strand": head.strand, "pos": head.pos, "sqrt_r": spread,
            "resid": by(res), "w": by(np.ones(len(d))), "xw": np.stack([by(c) for c in x.T], axis=1).ravel(),
            "xwx_inv": inv.ravel(), "xr": x.T @ res, "n": len(pdf), "n_cov": x.shape[1] - 1}])

    return run


def nominal_linear(
    pheno: DataFrame, genotypes: DataFrame, design: DataFrame, n_donors: int, window: int = 1_000_000,
    normal: bool = True, sample: str = "metacell",
) -> DataFrame:
    """(site, snp, r, slope, p) of partial correlations of usage with dosage in the cis window.

    ``pheno`` (site, chrom, strand, pos, sample, ratio). Runs on the same variant blocks as the
    score test; its z is sqrt(n) times the partial correlation here.
    """
    ready = rank_normal(pheno) if normal else pheno.withColumn("value", F.col("ratio"))
    rows = ready.select("site", "chrom", "strand", "pos", sample, "value").join(
        design.select(sample, "donor_idx", "x"), sample)
    ship_package(rows.sparkSession)
    fitted = cut_lineage(rows.groupBy("site").applyInPandas(_linear_site(n_donors), LINEAR_SCHEMA))  # read for the test and its sizes
    tested = cis_qtl(fitted.drop("n", "n_cov"), genotypes, window).join(fitted.select("site", "n", "n_cov"), "site")
    out = tested.withColumn("r", F.col("z") / F.sqrt("n"))
    return out.select(
        "site", "snp", "r", (F.col("beta") * F.lit(1.0)).alias("slope_scaled"), correlation_p("r", F.col("n") - F.col("n_cov")).alias("p"))
