"""GWAS integration: shared loci, merges, lead clumping, colocalisation and SMR."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceweave.functions.distributions import chi2_1df_sf, with_norm_ppf
from spliceweave.functions.genotype import ref_frequency
from spliceweave.functions.keys import strip_chr, variant_locus
from spliceweave.operators.intervals import window_exists, window_join
from spliceweave.session import cut_lineage, drop_stage


def shared_loci(sites: DataFrame, gwas: DataFrame, width: int = 500_000) -> DataFrame:
    """(site, study) pairs with a GWAS variant strictly within ``width`` on the same chromosome.

    ``sites`` is (site, chrom, pos), ``gwas`` (study, chrom, snp_pos).
    """
    return window_exists(sites, gwas, ["chrom"], "pos", "snp_pos", width, per=["study"])


def merge_gwas(assoc: DataFrame, maf: DataFrame, gwas: DataFrame) -> DataFrame:
    """QTL associations joined to allele frequencies and GWAS rows by upper-cased chrom:pos.

    Alleles are dropped from the key, so multi-allelic positions multiply.
    """
    q = assoc.withColumn("variant_id", variant_locus("variant_id")).withColumnsRenamed(
        {"beta": "beta_sqtl", "se": "se_sqtl", "p": "p_sqtl"})
    m = maf.withColumn("variant_id", variant_locus("variant_id"))
    g = gwas.withColumn("variant_id", variant_locus("variant_id")).withColumnsRenamed(
        {"beta": "beta_gwas", "se": "se_gwas", "p": "p_gwas"})
    return q.join(m, "variant_id").join(g, "variant_id")


def best_hit(df: DataFrame, locus: Sequence[str], p: str, tie: Sequence[str]) -> DataFrame:
    """The row with the smallest p per locus, as a combinable minimum."""
    rest = [c for c in df.columns if c not in locus]
    row = F.struct(F.col(p).alias("__p"), *[F.col(t).alias(f"__t{i}") for i, t in enumerate(tie)],
                   F.struct(*rest).alias("__row"))
    return (
        df.filter(F.col(p).isNotNull()).groupBy(*locus).agg(F.min(row).alias("__m"))
        .select(*locus, "__m.__row.*")
    )


def first_per_key(df: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key in the given order, as a combinable minimum."""
    rest = [c for c in df.columns if c not in key]
    row = F.struct(*[F.col(o).alias(f"__o{i}") for i, o in enumerate(order)], F.struct(*rest).alias("__row"))
    return df.groupBy(*key).agg(F.min(row).alias("__m")).select(*key, "__m.__row.*").select(*df.columns)


def clump_leads(
    gwas: DataFrame, p_max: float = 1e-7, width: int = 500_000, per: Sequence[str] = ("study",), keep: Sequence[str] = ("variant_id",)
) -> DataFrame:
    """Lead variants: greedy by p, dropping every variant within ``width`` of a chosen lead.

    Rows are (per..., chrom, pos, p) and those of the ``keep`` columns that are there, which name the variant. Each round keeps all variants that are the best one in
    their own window and removes what they cover, which gives the same leads as the sequential
    rule; it chooses one lead at least, so the loop ends. A position keeps its best row first, so a tile holds at most ``width`` rows.
    """
    g, keep = [*per, "chrom"], [c for c in keep if c in gwas.columns]
    best = F.min(F.struct("p", *keep)).alias("best")
    left = cut_lineage(
        gwas.filter(F.col("p") < p_max).groupBy(*g, "pos").agg(best).select(*g, "pos", "best.*"))
    leads = None
    while leads is None or not left.isEmpty():
        tile = F.floor(F.col("pos") / width)
        spread = left.withColumn("home", tile).withColumn("tile", F.explode(F.sequence(tile - 1, tile + 1)))
        around = Window.partitionBy(*g, "tile").orderBy("pos").rangeBetween(-width, width)
        chosen = cut_lineage(
            spread.withColumn("top", F.min(F.struct("p", "pos")).over(around))
            .filter((F.col("tile") == F.col("home")) & (F.col("top.pos") == F.col("pos")))
            .select(*g, "pos", "p", *keep)
        )
        leads = chosen if leads is None else leads.unionByName(chosen)
        near = chosen.select(*g, F.col("pos").alias("lead"), F.explode(F.sequence(
            F.floor((F.col("pos") - width) / width), F.floor((F.col("pos") + width) / width))).alias("tile"))
        cond = [left[c] == near[c] for c in g] + [
            F.floor(left["pos"] / width) == near["tile"], F.abs(left["pos"] - near["lead"]) <= width]
        before, left = left, cut_lineage(left.join(near, cond, "left_anti"))
        drop_stage(before)
    return leads


def quant_variance(maf="maf", n="n") -> Column:
    """Variance of a standardised effect from allele frequency and sample size."""
    maf, n = (F.col(c) if isinstance(c, str) else c for c in (maf, n))
    return F.lit(1.0) / (F.lit(2.0) * n * maf * (F.lit(1.0) - maf))


def log_bayes_factor(z, variance, prior_sd) -> Column:
    """Wakefield's log approximate Bayes factor."""
    prior = prior_sd * prior_sd
    shrink = prior / (prior + variance)
    return F.lit(0.5) * (F.log(F.lit(1.0) - shrink) + shrink * z * z)


def coloc_abf(
    merged: DataFrame,
    locus: Sequence[str],
    trait_type: str = "trait_type",
    min_snps: int = 10,
    p1: float = 1e-4,
    p2: float = 1e-4,
    p12: float = 1e-5,
) -> DataFrame:
    """Posterior support of H0-H4 per locus.

    ``merged`` rows carry beta_gwas, se_gwas, n_gwas, maf, p_sqtl, n_sqtl and ``trait_type``
    (cc or quant). The GWAS side uses effect and variance, the QTL side p, N and MAF. The
    quantitative prior scales with the trait SD; the case-control prior SD is 0.2. Loci with
    ``min_snps`` merged rows or fewer are left out; rows without a usable frequency, variance or p count for that, but carry no
    evidence. The merge is stored once. Sums are combinable aggregates.
    """
    needed = ["beta_gwas", "se_gwas", "n_gwas", "maf", "p_sqtl", "n_sqtl", trait_type]
    merged = cut_lineage(merged.select(*locus, *needed, F.expr("coalesce(maf > 0 AND maf < 1 AND se_gwas > 0 AND p_sqtl >= 0, false)").alias("__usable")))
    counts = merged.groupBy(*locus).agg(F.count(F.lit(1)).alias("nsnps")).filter(F.col("nsnps") > min_snps)
    q = merged.filter("__usable").withColumn("__p", F.when(F.col("p_sqtl") == 0, F.lit(1e-100)).otherwise(F.col("p_sqtl")))
    q = q.withColumn("__half", F.col("__p") * 0.5)
    var2 = quant_variance("maf", "n_sqtl")
    # sd(Y) of a quantitative GWAS: slope through the origin of N on the 1 / (2 var f (1-f)) scale
    oneover = F.lit(1.0) / (F.col("se_gwas") * F.col("se_gwas"))
    nvx = F.lit(2.0) * F.col("n_gwas") * F.col("maf") * (F.lit(1.0) - F.col("maf"))
    sdy = q.groupBy(*locus).agg(
        F.sqrt(F.sum(nvx * oneover) / F.sum(oneover * oneover)).alias("__sdy")
    ).join(counts, list(locus))
    prior1 = F.when(F.col(trait_type) == "cc", F.lit(0.2)).otherwise(F.col("__sdy") * 0.15)
    rows = (
        with_norm_ppf(q, "__half", "__z2").join(sdy, list(locus))
        .withColumn("l1", log_bayes_factor(F.try_divide("beta_gwas", "se_gwas"),
                                           F.col("se_gwas") * F.col("se_gwas"), prior1))
        .withColumn("l2", log_bayes_factor(F.col("__z2"), var2, F.lit(0.15)))
        .select(*locus, "nsnps", "l1", "l2")
    )
    rows = cut_lineage(rows)  # read twice: peaks, then sums
    peak = rows.groupBy(*locus).agg(
        F.max("l1").alias("m1"), F.max("l2").alias("m2"), F.max(F.col("l1") + F.col("l2")).alias("m12"))
    sums = (
        rows.join(peak, list(locus))
        .groupBy(*locus, "nsnps", "m1", "m2", "m12")
        .agg(
            F.sum(F.exp(F.col("l1") - F.col("m1"))).alias("s1"),
            F.sum(F.exp(F.col("l2") - F.col("m2"))).alias("s2"),
            F.sum(F.exp(F.col("l1") + F.col("l2") - F.col("m12"))).alias("s12"),
        )
        .select(*locus, "nsnps",
                (F.col("m1") + F.log("s1")).alias("L1"), (F.col("m2") + F.log("s2")).alias("L2"),
                (F.col("m12") + F.log("s12")).alias("L12"))
    )
    return posteriors(sums, locus, p1, p2, p12)


def posteriors(sums: DataFrame, locus: Sequence[str], p1: float, p2: float, p12: float) -> DataFrame:
    """Normalised posteriors from the three log sums L1, L2, L12."""
    both = F.col("L1") + F.col("L2")
    # log(exp(L1 + L2) - exp(L12)); a single shared variant leaves nothing for two distinct ones
    rest = F.lit(1.0) - F.exp(F.col("L12") - both)
    h3 = F.when(rest > 0, both + F.log(rest) + F.log(F.lit(p1)) + F.log(F.lit(p2)))
    logs = (
        sums.withColumn("h0", F.lit(0.0))
        .withColumn("h1", F.log(F.lit(p1)) + F.col("L1"))
        .withColumn("h2", F.log(F.lit(p2)) + F.col("L2"))
        .withColumn("h3", h3)
        .withColumn("h4", F.log(F.lit(p12)) + F.col("L12"))
        .withColumn("__top", F.greatest("h0", "h1", "h2", "h3", "h4"))
    )
    weights = [F.coalesce(F.exp(F.col(f"h{i}") - F.col("__top")), F.lit(0.0)) for i in range(5)]
    total = sum(weights[1:], weights[0])
    return logs.select(*locus, "nsnps", *[(w / total).alias(f"pp_h{i}") for i, w in enumerate(weights)])


def case_fraction(case, control) -> Column:
    return F.col(case) / (F.col(case) + F.col(control))


def smr_statistic(merged: DataFrame, p_qtl_max: float = 1.0) -> DataFrame:
    """SMR test per row: T = z_g^2 z_e^2 / (z_g^2 + z_e^2), chi-square with one df.

    ``p_qtl_max`` keeps variants whose QTL p-value (``p_sqtl``) is small enough to be instruments.
    """
    if p_qtl_max < 1:
        merged = merged.filter(F.col("p_sqtl") <= p_qtl_max)
    zg = F.try_divide("beta_gwas", "se_gwas")
    ze = F.try_divide("beta_sqtl", "se_sqtl")
    return (
        merged.withColumn("b_smr", F.try_divide("beta_gwas", "beta_sqtl"))
        .withColumn("t_smr", F.try_divide(zg * zg * ze * ze, zg * zg + ze * ze))
        .withColumn("p_smr", chi2_1df_sf("t_smr"))
    )


def smr_per_probe(merged: DataFrame, probe: Sequence[str], p_qtl_max: float = 1e-3, tie: Sequence[str] = ("variant_id",)) -> DataFrame:
    """SMR of each probe on its best QTL variant: (probe..., tie..., b_smr, se_smr, t_smr, p_smr).

    Only variants with a QTL p of at most ``p_qtl_max`` are instruments; probes without one have no row.
    """
    best = best_hit(merged.filter((F.col("p_sqtl") <= p_qtl_max) & F.col("beta_gwas").isNotNull()), probe, "p_sqtl", tie)
    rows = smr_statistic(best)
    se = F.try_divide(F.abs("b_smr"), F.sqrt("t_smr"))
    return rows.select(*probe, *tie, "b_smr", se.alias("se_smr"), "t_smr", "p_smr")


def coloc_table(
    qtl: DataFrame, maf: DataFrame, gwas: DataFrame, centres: DataFrame, width: int = 500_000, min_snps: int = 10,
) -> DataFrame:
    """One row a (cell, study, locus): top QTL and GWAS variants with their p, nsnps and pp_h0..pp_h4.

    ``centres`` (cell, study, locus, chrom, pos) names the loci; rows of ``qtl`` (cell, variant_id, beta, se, p, n_sqtl) and ``gwas`` (study,
    variant_id, chrom, snp_pos, beta, se, p, n_gwas, trait_type) within ``width`` of a centre (inclusive) are merged with ``maf``.
    """
    key = ["cell", "study", "locus"]
    near = window_join(centres, gwas.withColumnRenamed("study", "__s"), ["chrom"], "pos", "snp_pos", width)
    near = near.filter(F.col("study") == F.col("__s")).select(
        *key, variant_locus("variant_id").alias("variant_id"), F.col("beta").alias("beta_gwas"), F.col("se").alias("se_gwas"),
        F.col("p").alias("p_gwas"), "n_gwas", "trait_type")
    q = qtl.select("cell", variant_locus("variant_id").alias("variant_id"), F.col("p").alias("p_sqtl"), "n_sqtl")
    m = maf.select(variant_locus("variant_id").alias("variant_id"), "maf")
    merged = cut_lineage(near.join(q, ["cell", "variant_id"]).join(m, "variant_id"))
    top = merged.groupBy(*key).agg(
        F.min(F.struct("p_sqtl", "variant_id")).alias("q"), F.min(F.struct("p_gwas", "variant_id")).alias("g"))
    return coloc_abf(merged, key, min_snps=min_snps).join(top, key).select(
        *key, F.col("q.variant_id").alias("top_qtl"), F.col("q.p_sqtl").alias("p_qtl"), F.col("g.variant_id").alias("top_gwas"),
        F.col("g.p_gwas").alias("p_gwas"), "nsnps", *[f"pp_h{i}" for i in range(5)])


def smr_inputs(assoc: DataFrame, gwas: DataFrame, vcf: DataFrame, n_gwas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(GWAS table, QTL table) for SMR, one row per SNP, site and study.

    ``assoc`` (cell, site, variant_id, p, beta, se), ``gwas`` (study, variant_id, beta, se, p), ``vcf``
    (chrom, pos, id, ref, alt, info), ``n_gwas`` (study, n). The effect allele is REF and its
    frequency 1 - AF. Repeated SNPs keep their first row in variant order.
    """
    where = F.split("variant_id", ":")
    q = assoc.withColumn("variant_id", variant_locus("variant_id"))
    g = gwas.select("study", variant_locus("variant_id").alias("variant_id"),
                    F.col("beta").alias("b_g"), F.col("se").alias("se_g"), F.col("p").alias("p_g"))
    v = vcf.select(
        F.concat_ws(":", F.upper("chrom"), F.col("pos").cast("string")).alias("variant_id"),
        F.col("id").alias("SNP"), strip_chr("chrom").alias("Chr"), F.col("pos").alias("BP"),
        F.col("ref").alias("A1"), F.col("alt").alias("A2"), ref_frequency("info").alias("Freq"),
    )
    rows = q.join(g, "variant_id").join(v, "variant_id").join(n_gwas, "study").withColumn(
        "__order", where[1].cast("bigint"))
    key = ["cell", "site", "study", "SNP"]
    once = cut_lineage(first_per_key(rows, key, ["__order", "A1", "A2", "p_g", "p"]))  # both tables come from it
    gwas_table = once.select("cell", "site", "study", "SNP", "A1", "A2", "Freq",
                             F.col("b_g").alias("b"), F.col("se_g").alias("se"), F.col("p_g").alias("p"),
                             F.col("n").alias("N"))
    part = F.split("site", ":")
    qtl_table = once.select("cell", "site", "study", "SNP", "Chr", "BP", "A1", "A2", "Freq",
                            F.col("site").alias("Probe"), F.col("Chr").alias("Probe_Chr"),
                            part[2].cast("bigint").alias("Probe_bp"), F.col("site").alias("Gene"),
                            part[1].alias("Orientation"), F.col("beta").alias("b"), "se", "p")
    return gwas_table, qtl_table


def missing_results(expected: DataFrame, done: DataFrame, key: Sequence[str]) -> DataFrame:
    """Expected keys without a result."""
    return expected.join(done.select(*key).distinct(), list(key), "left_anti")
