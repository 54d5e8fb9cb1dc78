"""Intron retention: non-split evidence at single-intron sites."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceweave.operators.introns import LOCUS, endpoints, single_intron_sites
from spliceweave.operators.junctions import cigar_blocks, read_strand


def extract_nonsplit(
    alignments: DataFrame, sites: DataFrame, strand: str = "RF", tile: int = 4096, barcodes: DataFrame | None = None
) -> DataFrame:
    """Unspliced reads that cross a site: (chrom, strand, pos, cb, umi, n).

    With ``barcodes`` (cb, and library if both sides have it) only their reads are looked at, before anything is exploded.

    Sites and reads meet on genome tiles; a read lies in the few tiles its span touches.
    """
    carry = [c for c in ("library",) if c in alignments.columns]
    if barcodes is not None:
        keys = [k for k in ("cb", "library") if k in barcodes.columns and k in alignments.columns]
        alignments = alignments.join(barcodes.select(*keys).distinct(), keys, "left_semi")
    where = sites.select(*LOCUS, F.col("pos").alias("site_pos")).distinct().withColumn(
        "tile", F.floor(F.col("site_pos") / tile))
    span = F.aggregate(
        cigar_blocks(), F.lit(0).cast("bigint"),
        lambda acc, b: F.when(b["op"].isin("M", "D", "=", "X"), acc + b["len"]).otherwise(acc),
    )
    reads = (
        alignments.filter(~F.col("cigar").contains("N") & F.col("cb").isNotNull() & F.col("umi").isNotNull())
        .select(*carry, "chrom", read_strand(strand).alias("strand"), "cb", "umi",
                F.col("pos").alias("from_pos"), (F.col("pos") + span).alias("to_pos"))
        .withColumn("tile", F.explode(F.sequence(F.floor(F.col("from_pos") / tile), F.floor(F.col("to_pos") / tile))))
    )
    return (
        reads.join(where, [*LOCUS, "tile"])
        .filter((F.col("site_pos") > F.col("from_pos")) & (F.col("site_pos") < F.col("to_pos")))
        .groupBy(*carry, *LOCUS, F.col("site_pos").alias("pos"), "cb", "umi")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def nonsplit_counts(nonsplit: DataFrame, barcodes: DataFrame, sample: str = "metacell") -> DataFrame:
    """Distinct (CB, UMI) per site and metacell.

    Barcodes match within their library or individual whenever both sides carry it.
    """
    keys = [k for k in ("cb", "library", "donor") if k in barcodes.columns and k in nonsplit.columns]
    member = barcodes.select(*keys, sample).distinct()
    return (
        nonsplit.select(*keys, *LOCUS, "pos", "umi")
        .join(member, keys)
        .groupBy(*LOCUS, "pos", sample)
        .agg(F.count_distinct(*keys, "umi").alias("nonsplit"))
    )


def combine_ir(
    nonsplit: DataFrame, introns: DataFrame, counts: DataFrame, sample: str = "metacell", require_nonsplit: bool = True
) -> DataFrame:
    """Retention phenotype at single-intron sites: included = split, total = split + non-split.

    ``nonsplit`` is (site, sample, nonsplit), ``counts`` (junction, sample, n). Sites without any
    non-split read in any sample are dropped unless ``require_nonsplit`` is off.
    """
    sites = single_intron_sites(introns)
    as_sites = endpoints(counts, sample, "n").select(
        *LOCUS, "pos", "side", "partner", sample, F.col("n").alias("split"), F.lit(0).cast("bigint").alias("nonsplit"))
    evidence = nonsplit.join(sites, [*LOCUS, "pos"]).select(
        *LOCUS, "pos", "side", "partner", sample, F.lit(0).cast("bigint").alias("split"), "nonsplit")
    split = as_sites.join(sites, [*LOCUS, "pos", "side", "partner"], "left_semi")
    both = split.unionByName(evidence).groupBy(*LOCUS, "pos", "side", sample).agg(
        F.sum("split").alias("included"), F.sum(F.col("split") + F.col("nonsplit")).alias("total"))
    if not require_nonsplit:
        return both
    seen = evidence.filter("nonsplit > 0").select(*LOCUS, "pos", "side").distinct()
    return both.join(seen, [*LOCUS, "pos", "side"], "left_semi")
