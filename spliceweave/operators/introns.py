"""Intron clusters and splice-site usage from junction counts.

A splice site is an endpoint of an intron: (chrom, strand, pos, side) with side ``start`` or
``end``. A competing intron of a site shares the opposite endpoint with an intron that uses it.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.functions.keys import intron_key, joined
from spliceweave.operators.components import connected_components
from spliceweave.operators.junctions import JUNCTION, intron_totals
from spliceweave.session import cut_lineage

LOCUS = ["chrom", "strand"]
SITE = [*LOCUS, "pos", "side"]


def endpoints(introns: DataFrame, *carry: str) -> DataFrame:
    """Two rows per intron: its sites, each with the opposite endpoint as partner."""
    return introns.select(
        *LOCUS,
        F.inline(F.array(
            F.struct(F.col("j_start").alias("pos"), F.lit("start").alias("side"),
                     F.col("j_end").alias("partner"), F.lit("end").alias("partner_side")),
            F.struct(F.col("j_end").alias("pos"), F.lit("end").alias("side"),
                     F.col("j_start").alias("partner"), F.lit("start").alias("partner_side")),
        )),
        *carry,
    )


def intron_clusters(introns: DataFrame) -> DataFrame:
    """Introns with ``cluster`` (smallest site of the component) from shared splice sites."""
    found = connected_components(introns, "j_start", "j_end", within=LOCUS)
    labels = found.select(*LOCUS, F.col("node").alias("j_start"), F.col("component").alias("cluster"))
    return introns.join(labels, [*LOCUS, "j_start"])


def cluster_name() -> Column:
    return joined("chrom", "strand", "cluster")


def mark_single(introns: DataFrame) -> DataFrame:
    """Add ``single``: neither site of the intron is a site of another one."""
    touch = endpoints(introns).groupBy(*LOCUS, "pos").agg(F.count(F.lit(1)).alias("__t"))
    at_start = touch.withColumnsRenamed({"pos": "j_start", "__t": "__s"})
    at_end = touch.withColumnsRenamed({"pos": "j_end", "__t": "__e"})
    return (
        introns.join(at_start, [*LOCUS, "j_start"])
        .join(at_end, [*LOCUS, "j_end"])
        .withColumn("single", (F.col("__s") == 1) & (F.col("__e") == 1))
        .drop("__s", "__e")
    )


def single_intron_sites(introns: DataFrame) -> DataFrame:
    """The two sites of every intron that shares no site with another intron."""
    alone = mark_single(introns).filter("single")
    return endpoints(alone).select(*SITE, F.col("partner"))


def competitor_counts(introns: DataFrame) -> DataFrame:
    """Per site: introns using it, and introns competing with them (no pairs formed)."""
    ends = endpoints(introns)
    degree = ends.groupBy(*SITE).agg(F.count(F.lit(1)).alias("uses"))
    opposite = degree.select(*LOCUS, F.col("pos").alias("partner"), F.col("side").alias("partner_side"),
                             F.col("uses").alias("partner_uses"))
    return ends.join(opposite, [*LOCUS, "partner", "partner_side"]).groupBy(*SITE).agg(
        F.count(F.lit(1)).alias("n_included"),
        F.sum(F.col("partner_uses") - 1).alias("n_excluded"),
    )


def included_excluded(introns: DataFrame) -> DataFrame:
    """Lists of included and excluded introns per site, for the text export.

    The lists are the product itself and are as long as a site has competitors; everything
    downstream uses sums (``site_usage``) instead.
    """
    ends = endpoints(introns, "j_start", "j_end")
    item = F.struct("j_start", "j_end")
    opposite = ends.select(*LOCUS, F.col("pos").alias("partner"), F.col("side").alias("partner_side"),
                           F.col("j_start").alias("r_start"), F.col("j_end").alias("r_end"))
    rivals = ends.join(opposite, [*LOCUS, "partner", "partner_side"]).select(
        *SITE, F.col("r_start").alias("j_start"), F.col("r_end").alias("j_end"))
    rows = ends.select(*SITE, "j_start", "j_end").withColumn("own", F.lit(True)).unionByName(rivals.withColumn("own", F.lit(False)))
    once = rows.groupBy(*SITE, "j_start", "j_end").agg(F.max("own").alias("own"))  # a rival that two partners share counts once
    none = F.array().cast("array<struct<j_start:bigint,j_end:bigint>>")
    pick = lambda own: F.coalesce(F.array_sort(F.collect_list(F.when(F.col("own") == own, item))), none)
    return once.groupBy(*SITE).agg(pick(True).alias("included"), pick(False).alias("excluded"))


def site_usage(counts: DataFrame, introns: DataFrame, sample: str = "metacell", competitors: str = "partner") -> DataFrame:
    """(site, sample, included, total) from intron counts in long form.

    ``partner``: total adds every intron sharing the opposite endpoint. Introns ending at one
    partner are summed once per sample and that sum is added per partner, so a busy site
    multiplies no rows. ``cluster``: total is the read count of the whole cluster.
    """
    kept = counts.join(introns.select(*JUNCTION, *(["cluster"] if competitors == "cluster" else [])), JUNCTION)
    if competitors == "cluster":
        own = endpoints(kept, "cluster", sample, "n").groupBy(*SITE, "cluster", sample).agg(F.sum("n").alias("included"))
        whole = kept.groupBy(*LOCUS, "cluster", sample).agg(F.sum("n").alias("total"))
        member = endpoints(introns, "cluster").select(*SITE, "cluster").distinct()
        return (
            member.join(whole, [*LOCUS, "cluster"])
            .join(own, [*SITE, "cluster", sample], "left")
            .select(*SITE, sample, F.coalesce("included", F.lit(0)).alias("included"), "total")
        )
    used = endpoints(kept, sample, "n").groupBy(*SITE, sample).agg(F.sum("n").alias("n"))
    rival = used.select(*LOCUS, F.col("pos").alias("partner"), F.col("side").alias("partner_side"), sample, "n")
    totals = endpoints(introns).join(rival, [*LOCUS, "partner", "partner_side"]).select(
        *SITE, sample, F.lit(0).cast("bigint").alias("included"), F.col("n").alias("total"))
    own = used.select(*SITE, sample, F.col("n").alias("included"), F.lit(0).cast("bigint").alias("total"))
    return totals.unionByName(own).groupBy(*SITE, sample).agg(
        F.sum("included").alias("included"), F.sum("total").alias("total")
    )


def with_site_name(usage: DataFrame) -> DataFrame:
    """Add ``site`` = chrom:strand:pos.

    A position that is a start of one intron and an end of another names two different sites;
    only those carry their side as a fourth token.
    """
    roles = usage.groupBy(*LOCUS, "pos").agg(F.min("side").alias("__a"), F.max("side").alias("__b"))
    double = roles.filter(F.col("__a") != F.col("__b")).select(*LOCUS, "pos", F.lit(True).alias("__two"))
    named = usage.join(double, [*LOCUS, "pos"], "left")
    return named.withColumn("site", F.when(F.col("__two"), joined("chrom", "strand", "pos", "side")).otherwise(
        joined("chrom", "strand", "pos"))).drop("__two")


class IntronGroups(NamedTuple):
    introns: DataFrame       # kept introns with reads, cluster, single
    intron_counts: DataFrame  # (cluster, intron, sample, n)
    refined: DataFrame       # clusters with their introns and total reads
    site: DataFrame          # competitive-site phenotype


def group_introns(
    stat: DataFrame,
    min_reads: float = 50,
    min_intron: int = 50,
    max_intron: int = 500_000,
    sample: str = "metacell",
    competitors: str = "partner",
) -> IntronGroups:
    """Filter introns, cluster them by shared sites and measure competitive-site usage."""
    width = F.col("j_end") - F.col("j_start")
    introns = cut_lineage(intron_totals(stat.filter(width.between(min_intron, max_intron)), min_reads))
    introns = cut_lineage(mark_single(intron_clusters(introns)))
    counts = stat.join(introns.select(*JUNCTION, "cluster"), JUNCTION)
    intron_counts = counts.select(
        cluster_name().alias("cluster_id"), intron_key().alias("intron"), sample, "n"
    )
    refined = introns.groupBy(cluster_name().alias("cluster_id")).agg(
        F.array_sort(F.collect_list(F.struct("j_start", "j_end", "reads"))).alias("introns")
    )
    rivals = introns.filter(~F.col("single"))
    return IntronGroups(introns, intron_counts, refined, site_usage(stat, rivals, sample, competitors))


def cluster_intron_ratio(counts: DataFrame, n_samples: int, sample: str = "metacell") -> DataFrame:
    """Intron share of its cluster per sample, for clusters of two or more introns.

    ``counts`` holds (cluster_id, intron, sample, n) for non-zero cells. Samples where the
    cluster has no reads get round(median(n)) / round(median(total)) over the covered samples
    (half-even rounding); the fill is one row per intron in ``fill``, NULL when it divides by 0.
    """
    introns = counts.select("cluster_id", "intron").distinct()
    several = introns.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).filter("size >= 2")
    totals = counts.groupBy("cluster_id", sample).agg(F.sum("n").alias("total"))
    covered = totals.join(several.select("cluster_id"), "cluster_id")
    dense = (
        introns.join(covered, "cluster_id")
        .join(counts, ["cluster_id", "intron", sample], "left")
        .select("cluster_id", "intron", sample, F.coalesce("n", F.lit(0)).alias("n"), "total")
    )
    fill = dense.groupBy("cluster_id", "intron").agg(
        F.median("n").alias("__mn"), F.median("total").alias("__mt"), F.count(F.lit(1)).alias("n_covered")
    ).select(
        "cluster_id", "intron", (F.lit(n_samples) - F.col("n_covered")).alias("n_filled"),
        F.try_divide(F.bround("__mn"), F.bround("__mt")).alias("fill"),
    )
    return dense.join(fill, ["cluster_id", "intron"]).withColumn("ratio", F.try_divide("n", "total"))
