"""Context-dependent QTL effects: interaction models and stratified refits per (site, variant)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.functions.distributions import two_sided_p
from spliceweave.operators.correlation import standardised_slope
from spliceweave.operators.glmm import Families, at_once, fit_many
from spliceweave.operators.multiple_testing import benjamini_hochberg
from spliceweave.operators.null_model import sample_grid
from spliceweave.operators.strata import balanced_sample, with_tertile
from spliceweave.session import cut_lineage, ship_package

FIT_SCHEMA = "site string, snp string, fit string, status string, n bigint, z_geno double, z_inter double"


def _fit_block(max_iter: int):
    """Wald z of the dosage and, in the ``all`` fits, of its product with the context; the fits of one kind in a block share arrays."""

    def run(rows: pd.DataFrame, samples: pd.DataFrame) -> pd.DataFrame:
        if rows.empty:
            return pd.DataFrame()
        pairs = rows[["site", "snp"]].drop_duplicates(ignore_index=True)
        pairs["pair"] = range(len(pairs))
        rows = rows.merge(pairs, on=["site", "snp"]).merge(samples, on="metacell")
        out = [_fit_kind(rows, pairs, "all", max_iter)]
        out += [_fit_kind(part, pairs, fit, max_iter) for fit, part in rows.groupby("stratum")]
        return pd.concat(out)

    return run


def _fit_kind(rows: pd.DataFrame, pairs: pd.DataFrame, fit: str, max_iter: int) -> pd.DataFrame:
    """One fit of every pair in ``rows``; designs differ in the dosage, its product and the samples only."""
    found, model = np.unique(rows.pair, return_inverse=True)
    samples, column, y, n = sample_grid(rows, model, len(found))
    whole = fit == "all"
    base = np.vstack([np.ones(len(samples)), *np.vstack(samples["x" if whole else "x_stratum"].to_numpy()).T.reshape(-1, len(samples))])
    g = np.zeros(y.shape)
    g[model, column] = rows.dosage
    ctx = samples.ctx.to_numpy(float)
    donors, code = np.unique(samples.donor_idx.to_numpy(), return_inverse=True)
    kin, p = Families.unrelated(len(donors)), len(base) + (3 if whole else 1)
    z, status = np.full((len(found), p), np.nan), np.full(len(found), "Unidentified", object)
    some = at_once(len(samples), p, kin)
    for lo in range(0, len(found), some):
        at = np.arange(lo, min(lo + some, len(found)))
        seen = (n[at] > 0)[:, None, :]
        x = np.broadcast_to(base, (len(at), *base.shape))
        extra = [np.broadcast_to(ctx, g[at].shape), g[at], g[at] * ctx] if whole else [g[at]]
        x = np.where(seen, np.concatenate([x, np.stack(extra, axis=1)], axis=1), 0.0)
        size, count = np.linalg.svd(x, compute_uv=False), seen[:, 0].sum(axis=1)
        rank = np.sum(size > (size[:, 0] * np.maximum(count, p) * np.finfo(float).eps)[:, None], axis=1)
        use = (rank == p) & (count > p)
        if use.any():
            fits = fit_many(y[at][use], n[at][use], x[use], code, kin, max_iter)
            status[at[use]] = fits.status
            z[at[use]] = fits.alpha / np.sqrt(np.maximum(np.einsum("bii->bi", fits.cov), 1e-300))
    return pairs.iloc[found][["site", "snp"]].assign(
        fit=fit, status=status, n=(n > 0).sum(axis=1), z_geno=z[:, -2 if whole else -1], z_inter=z[:, -1] if whole else np.nan)


def context_effects(
    pheno: DataFrame,
    pairs: DataFrame,
    genotype: DataFrame,
    design: DataFrame,
    strata: Sequence[str],
    residuals: DataFrame | None = None,
    fdr_by: Sequence[str] = (),
    sample: str = "metacell",
    max_iter: int = 60,
    block_pairs: int = 256,
) -> DataFrame:
    """One row per (site, snp): p of the dosage and of the interaction, q, and per stratum p and slope.

    ``pheno`` (site, sample, included, total), ``pairs`` (site, snp, fdr_by...), ``genotype``
    (snp, dosage ARRAY by donor index) or (snp, donor_idx, dosage), ``design`` (sample, sample_idx, donor_idx, x, x_stratum, ctx,
    stratum), ``residuals`` (site, sample_idx, working_residual). Missing dosages drop out. The
    fits of all pairs run in one job, about ``block_pairs`` pairs in a group that meets one copy of the design; those of one kind are made
    together (``fit_many``). A fit takes
    ``max_iter`` steps at most before it falls back to fixed effects.
    """
    ship_package(pheno.sparkSession)
    listed = genotype.join(pairs.select("snp").distinct(), "snp", "left_semi")  # before dosage arrays are exploded
    if "donor_idx" not in genotype.columns:
        listed = listed.select("snp", F.posexplode("dosage").alias("donor_idx", "dosage"))
    rows = cut_lineage(  # read by the fits and by the slopes
        pheno.select("site", sample, "included", "total").filter("total > 0")
        .join(pairs.select("site", "snp"), "site")
        .join(design, sample)
        .join(listed.select("snp", "donor_idx", "dosage"), ["snp", "donor_idx"])
        .filter(F.col("dosage").isNotNull())
    )
    blocks = max(pheno.sparkSession.sparkContext.defaultParallelism, -(-pairs.count() // block_pairs))
    work = rows.select(
        F.pmod(F.xxhash64("site", "snp"), F.lit(blocks)).cast("int").alias("block"), "site", "snp", F.col(sample).alias("metacell"), "donor_idx",
        "included", "total", "dosage")
    copies = design.select(F.col(sample).alias("metacell"), "sample_idx", "x", "x_stratum", "ctx", "stratum").withColumn(
        "block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    # rows are few bytes for the work they make, so blocks are dealt to tasks by number and not by size
    fits = work.repartition(blocks, "block").groupBy("block").cogroup(copies.repartition(blocks, "block").groupBy("block")).applyInPandas(
        _fit_block(max_iter), FIT_SCHEMA).select(
        "site", "snp", "fit", F.nanvl("z_geno", F.lit(None)).alias("z_geno"), F.nanvl("z_inter", F.lit(None)).alias("z_inter")
    ).withColumn("p_geno", two_sided_p("z_geno")).withColumn("p_inter", two_sided_p("z_inter"))
    wide = fits.groupBy("site", "snp").agg(
        F.max(F.when(F.col("fit") == "all", F.col("p_geno"))).alias("p_geno"),
        F.max("p_inter").alias("p_interaction"),
        *[F.max(F.when(F.col("fit") == s, F.col("p_geno"))).alias(f"p_{s}") for s in strata])
    if residuals is not None:
        slopes = rows.filter("stratum IS NOT NULL").join(residuals, ["site", "sample_idx"]).groupBy("site", "snp").agg(*[
            standardised_slope(*[F.when(F.col("stratum") == s, F.col(c)) for c in ("working_residual", "dosage")]).alias(f"slope_{s}")
            for s in strata])
        wide = wide.join(slopes, ["site", "snp"], "left")
    if fdr_by:
        wide = wide.join(pairs.select("site", "snp", *fdr_by), ["site", "snp"])
    return benjamini_hochberg(cut_lineage(wide), "p_interaction", "q", fdr_by)  # which reads it several times


def _design(samples: DataFrame, covariates: Sequence[str], ctx: str, stratum: Column, drop: Sequence[str] = ()) -> DataFrame:
    def vector(names):
        return F.array(*[F.col(c).cast("double") for c in names]) if names else F.array().cast("array<double>")

    others = [c for c in covariates if c != ctx]
    return samples.select(
        "metacell", "sample_idx", "donor_idx", vector(others).alias("x"),
        vector([c for c in others if c not in drop]).alias("x_stratum"),
        F.col(ctx).cast("double").alias("ctx"), stratum.alias("stratum"))


def disease_design(samples: DataFrame, covariates: Sequence[str], seed: int = 0) -> DataFrame:
    """Disease context (``AD`` 0/1): sexes are balanced inside each disease group."""
    kept = balanced_sample(samples, "sex", ["AD"], ["metacell"], seed)
    return _design(kept, covariates, "AD", F.when(F.col("AD") == 0, "control").when(F.col("AD") == 1, "case"))


def sex_design(samples: DataFrame, covariates: Sequence[str], seed: int = 0) -> DataFrame:
    """Sex context (1/2): disease groups are balanced inside each sex."""
    kept = balanced_sample(samples, "AD", ["sex"], ["metacell"], seed)
    return _design(kept, covariates, "sex", F.when(F.col("sex") == 1, "male").when(F.col("sex") == 2, "female"))


def state_design(samples: DataFrame, covariates: Sequence[str], state: str = "state", drop: Sequence[str] = ("AD",)) -> DataFrame:
    """Cell-state context: strata are the tertiles of the state over the samples."""
    cut = with_tertile(samples.filter(F.col(state).isNotNull()), state)
    return _design(cut, covariates, state, F.col("stratum"), drop)
