"""Score tests on fitted null models: cis, trans and between groups."""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceweave.functions.distributions import two_sided_p
from spliceweave.operators.blocks import over_block_pairs, salted

RESULT = "site string, snp string, z double, beta double, se double"
WIDE = 4
TOGETHER = 16, 32
MODEL = ["site", "pos", "sqrt_r", "resid", "w", "xw", "xwx_inv", "xr"]


def _min_abs_z(p_max: float) -> float:
    return 0.0 if p_max >= 1 else -NormalDist().inv_cdf(p_max / 2.0) * (1 - 1e-9)


def _block_kernel(window: int | None, p_max: float):
    z_min = _min_abs_z(p_max)

    def run(sites: pd.DataFrame, snps: pd.DataFrame) -> pd.DataFrame:
        if sites.empty or snps.empty:
            return pd.DataFrame()
        g = np.vstack(snps.dosage.to_numpy()).astype(float).T
        mean = np.nanmean(np.where(np.isnan(g).all(axis=0), 0.0, g), axis=0)
        g = np.where(np.isnan(g), mean, g)
        resid, w = np.vstack(sites.resid.to_numpy()), np.vstack(sites.w.to_numpy())
        ns, nd = resid.shape
        xr = np.vstack(sites.xr.to_numpy())
        p = xr.shape[1]
        xw = np.vstack(sites.xw.to_numpy()).reshape(ns, nd, p)
        inv = np.vstack(sites.xwx_inv.to_numpy()).reshape(ns, p, p)
        xwg = (xw.transpose(0, 2, 1).reshape(ns * p, nd) @ g).reshape(ns, p, -1)
        back = inv @ xwg
        score = resid @ g - np.einsum("sp,spg->sg", xr, back)
        plain = w @ (g * g)
        var = plain - np.sum(xwg * back, axis=1)
        usable = var > 1e-9 * np.maximum(plain, 1.0)
        var = np.where(usable, var, 1.0) * (sites.sqrt_r.to_numpy(float) ** 2)[:, None]
        z = score / np.sqrt(var)
        keep = usable & (np.abs(z) >= z_min)
        if window is not None:
            keep &= np.abs(sites.pos.to_numpy()[:, None] - snps.snp_pos.to_numpy()[None, :]) <= window
        s, v = np.nonzero(keep)
        return pd.DataFrame({
            "site": sites.site.to_numpy()[s], "snp": snps.snp.to_numpy()[v],
            "z": z[s, v], "beta": score[s, v] / var[s, v], "se": 1.0 / np.sqrt(var[s, v])})

    return run


def _finish(raw: DataFrame, p_max: float) -> DataFrame:
    """p of each row; at a ``p_max`` of 1 or more nothing is left to filter, as a row's z is a number, and p is made only where it is read."""
    out = raw.withColumn("p", two_sided_p("z")).select("site", "snp", "p", "beta", "se", "z")
    return out.filter(F.col("p") <= p_max) if p_max < 1 else out


def cis_qtl(
    null_models: DataFrame,
    genotypes: DataFrame,
    window: int = 500_000,
    p_max: float = 1.0,
    chrom: str | None = None,
    site_rows: int = 256,
    snp_rows: int = 2048,
) -> DataFrame:
    """Test every site against the variants within ``window`` bp (inclusive).

    ``genotypes`` is (snp, chrom, snp_pos, dosage ARRAY by donor index); missing dosages take the
    variant's mean. Sites are copied to the tiles their window touches, variants stay in one
    tile, and a tile is worked in bounded site x variant blocks with matrix products. A tile is ``WIDE`` windows long: sparse regions
    give fewer groups and copies of sites, dense ones are cut into blocks anyway.
    """
    if chrom is not None:
        null_models, genotypes = null_models.filter(F.col("chrom") == chrom), genotypes.filter(F.col("chrom") == chrom)
    tile = max(1, WIDE * window)
    sites = null_models.select("chrom", *MODEL).withColumn("tile", F.explode(F.sequence(
        F.floor((F.col("pos") - window) / tile), F.floor((F.col("pos") + window) / tile))))
    snps = genotypes.select("chrom", "snp", "snp_pos", "dosage").withColumn("tile", F.floor(F.col("snp_pos") / tile))
    raw = over_block_pairs(sites, snps, ["chrom", "tile"], ["site"], ["snp"], site_rows, snp_rows,
                           _block_kernel(window, p_max), RESULT)
    return _finish(raw, p_max)


def trans_qtl(
    null_models: DataFrame,
    genotypes: DataFrame,
    variants: DataFrame,
    p_max: float = 1.0,
    chrom: str | None = None,
    site_rows: int = 256,
    snp_rows: int = 512,
) -> DataFrame:
    """Test every site against the listed variants, anywhere (``chrom`` restricts the variants).

    Sites and variants are spread over salted groups first, so the all-against-all work starts
    from many keys and ends in bounded blocks; only rows with p <= ``p_max`` leave a block. At a ``p_max`` of 1 a block returns
    a row for each of its pairs, so blocks are smaller than those of the cis test. ``TOGETHER`` blocks share a group, so that sites and
    variants aren't copied for every block of the other side.
    """
    listed = genotypes.join(variants.select("snp").distinct(), "snp", "left_semi")
    if chrom is not None:
        listed = listed.filter(F.col("chrom") == chrom)
    sites, snps, groups = salted(null_models.select(*MODEL), listed.select("snp", "snp_pos", "dosage"), "site", "snp")
    raw = over_block_pairs(sites, snps, groups, ["site"], ["snp"], site_rows, snp_rows, _block_kernel(None, p_max), RESULT, TOGETHER)
    return _finish(raw, p_max)


def _group_kernel(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values("sample_idx")
    x = np.column_stack([np.ones(len(pdf)), np.vstack(pdf.x.to_numpy())]) if len(pdf.x.iloc[0]) else np.ones((len(pdf), 1))
    pi, n, y = pdf.pi.to_numpy(float), pdf.total.to_numpy(float), pdf.y.to_numpy(float)
    w, res, g = n * pi * (1 - pi), y - n * pi, pdf.label.to_numpy(float)
    xw = x.T * w
    g = g - x @ np.linalg.lstsq(xw @ x, xw @ g, rcond=None)[0]
    var = np.sum(w * g * g) * float(pdf.sqrt_r.iloc[0]) ** 2
    if not var > 1e-9:
        return pd.DataFrame()
    s = g @ res
    return pd.DataFrame({"site": [pdf.site.iloc[0]], "z": [s / np.sqrt(var)], "beta": [s / var], "se": [1 / np.sqrt(var)]})


def diff_splicing(null_models: DataFrame, groups: DataFrame, design: DataFrame, p_max: float = 1.0) -> DataFrame:
    """Score test of a two-group label (0 / 2) in the genotype slot, per site.

    ``groups`` is (sample_idx, label). Samples without a label are left out.
    """
    arrays = F.arrays_zip("sample_idx", "pi", "total", "y")
    rows = (
        null_models.select("site", "sqrt_r", F.inline(arrays))
        .join(groups.select("sample_idx", "label"), "sample_idx")
        .join(design.select("sample_idx", "x"), "sample_idx")
    )
    raw = rows.groupBy("site").applyInPandas(_group_kernel, "site string, z double, beta double, se double")
    return raw.withColumn("p", two_sided_p("z")).filter(F.col("p") <= p_max)
