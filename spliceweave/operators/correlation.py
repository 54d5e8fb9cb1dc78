"""Correlations: genes with components, dosage with usage, truth recovery."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spliceweave.functions.distributions import correlation_p
from spliceweave.operators.intervals import point_in_interval
from spliceweave.operators.multiple_testing import bonferroni
from spliceweave.session import cut_lineage


def standardised_slope(x, y) -> Column:
    """Slope of standardised y on standardised x, which is their Pearson correlation.

    Pairs with a NULL do not count; NULL when either side does not vary.
    """
    x, y = (F.col(c) if isinstance(c, str) else c for c in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))


def mean_scores(cells: DataFrame, labels: DataFrame, n_pcs: int = 8, cell: str = "cell_id", group: str = "metacell") -> DataFrame:
    """Mean of the first ``n_pcs`` components per metacell, all in one pass."""
    return cells.join(labels, cell).groupBy(group).agg(
        *[F.avg(F.col("pc")[i].cast("double")).alias(f"pc{i + 1}") for i in range(n_pcs)])


def gene_pc_correlation(expression: DataFrame, scores: DataFrame, n_pcs: int = 8, cell: str = "cell_id") -> DataFrame:
    """(gene, pc, corr) over all cells; absent expression rows are zeros.

    Sums over the stored entries are enough, so sparse matrices stay sparse.
    """
    pcs = range(n_pcs)
    y = [F.col("pc")[i].cast("double") for i in pcs]
    whole = scores.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.sum(y[i]).alias(f"sy{i}") for i in pcs], *[F.sum(y[i] * y[i]).alias(f"syy{i}") for i in pcs],
    ).withColumn("__all", F.lit(1))
    x = F.col("value").cast("double")
    per_gene = (
        expression.join(scores, cell).groupBy("gene")
        .agg(F.sum(x).alias("sx"), F.sum(x * x).alias("sxx"), *[F.sum(x * y[i]).alias(f"sxy{i}") for i in pcs])
        .withColumn("__all", F.lit(1))
        .join(F.broadcast(whole), "__all")  # one row of totals
    )

    def corr(i):
        cov = F.col("n") * F.col(f"sxy{i}") - F.col("sx") * F.col(f"sy{i}")
        vx = F.col("n") * F.col("sxx") - F.col("sx") * F.col("sx")
        vy = F.col("n") * F.col(f"syy{i}") - F.col(f"sy{i}") * F.col(f"sy{i}")
        return F.try_divide(cov, F.sqrt(vx * vy))

    return per_gene.select("gene", F.inline(F.array(*[
        F.struct(F.lit(i + 1).alias("pc"), corr(i).alias("corr")) for i in pcs])))


def top_by_abs(df: DataFrame, group: Sequence[str], value: str, k: int, tie: Sequence[str]) -> DataFrame:
    """The k rows of largest |value| per group with their rank; each task keeps at most k per group."""
    order = Window.partitionBy(*group).orderBy(F.abs(F.col(value)).desc_nulls_last(), *tie)
    return df.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def ground_truth_association(
    usage: DataFrame, truth: DataFrame, genotype: DataFrame, skip_chrom: Sequence[str] = ("chrX", "chrY")
) -> DataFrame:
    """cor.test of usage with the dosage of the truth SNP whose gene contains the site.

    ``usage`` (site, chrom, pos, sample, donor, ratio), ``truth`` (snp, chrom, start, end),
    ``genotype`` (snp, donor, dosage) or (snp, dosage ARRAY by donor index). Dosages of the sites' truth SNPs are stored before anything is
    joined to them: a planner that knows no more than file sizes takes dosages, which are made from few stored columns, for a small table and
    would broadcast all of them.
    """
    usage = cut_lineage(usage)  # read twice: sites, then their samples
    sites = usage.select("site", "chrom", "pos").distinct().filter(~F.col("chrom").isin(*skip_chrom))
    hits = cut_lineage(point_in_interval(sites, truth, ["chrom"], "pos", "start", "end").select("site", "snp").distinct())
    known = cut_lineage(genotype.join(hits.select("snp").distinct(), "snp", "left_semi"))
    if "donor" in genotype.columns:
        pairs = usage.join(hits, "site").join(known, ["snp", "donor"])
    else:
        pairs = usage.join(hits.join(known, "snp"), "site").withColumn("dosage", F.get("dosage", F.col("donor")))
    tested = pairs.filter(F.col("ratio").isNotNull() & F.col("dosage").isNotNull())
    return (
        tested.groupBy("site", "snp")
        .agg(standardised_slope("dosage", "ratio").alias("r"), F.count(F.lit(1)).alias("n"))
        .withColumn("p", correlation_p("r", "n"))
    )


def power_summary(assoc: DataFrame, n_tests: int = 1000, fdr: float = 0.05, p_max: float = 1e-2) -> DataFrame:
    """Distinct truth SNPs recovered after the single-value adjustment and by raw p."""
    return assoc.withColumn("adj", bonferroni("p", n_tests)).agg(
        F.count_distinct(F.when(F.col("adj") < fdr, F.col("snp"))).alias("n_adjusted"),
        F.count_distinct(F.when(F.col("p") < p_max, F.col("snp"))).alias("n_nominal"),
    )
