"""Domain relations derived from the star-schema tables, over all of their rows.

A line item is a read of a gene (50 consecutive parts), an order is a cell, a customer's nation
is the donor and nation:parity the metacell. Parts are also variants, nations the genotyped
donors, event types GWAS studies, and embeddings cells with component scores.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spliceweave.functions.distributions import two_sided_p
from spliceweave.operators.junctions import junction_stats
from spliceweave.session import cut_lineage


def load(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def reads(spark: SparkSession, sf: str) -> DataFrame:
    """All reads with gene geometry; ``is_split`` tells junction reads from non-split ones."""
    return (
        load(spark, sf, "lineitem")
        .select(
            "l_orderkey", "l_linenumber", "l_returnflag",
            F.expr("CAST(l_quantity AS BIGINT)").alias("q"),
            F.expr("l_partkey div 50").alias("gene"),
        )
        .withColumn("si", F.expr("CASE WHEN gene % 4 = 0 THEN 0 ELSE q % 3 END"))
        .withColumn("ei", F.expr("CASE WHEN gene % 4 = 0 THEN 0 ELSE si % 2 + 2 * ((q div 3) % 2) END"))
        .select(
            F.expr("concat('chr', gene % 5 + 1)").alias("chrom"),
            F.expr("CASE WHEN (gene div 5) % 2 = 0 THEN '+' ELSE '-' END").alias("strand"),
            F.expr("gene * 100000 + si * 1000").alias("j_start"),
            F.expr("gene * 100000 + 10000 + ei * 1000").alias("j_end"),
            F.array(F.expr("CAST(4 + l_linenumber * 2 AS INT)"), F.expr("CAST(4 + q % 20 AS INT)")).alias("anchors"),
            F.col("l_orderkey").alias("cb"),
            F.col("l_linenumber").cast("bigint").alias("umi"),
            (F.col("l_returnflag") != "N").alias("is_split"),
            "gene",
        )
    )


def junctions(spark, sf) -> DataFrame:
    return reads(spark, sf).filter("is_split").drop("is_split")


def nonsplit(spark, sf) -> DataFrame:
    """Non-split reads: odd UMIs cover the intron start, even ones its end."""
    return reads(spark, sf).filter("NOT is_split").select(
        "chrom", "strand", F.expr("CASE WHEN umi % 2 = 1 THEN j_start ELSE j_end END").alias("pos"), "cb", "umi")


def barcodes(spark, sf) -> DataFrame:
    """(cb, donor, metacell, donor_idx) of every cell."""
    cust = load(spark, sf, "customer").select("c_custkey", "c_nationkey", "c_acctbal", "c_mktsegment")
    return load(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").alias("cb"),
        F.expr("concat('D', c_nationkey)").alias("donor"),
        F.expr("concat('D', c_nationkey, ':', o_custkey % 2 + 1)").alias("metacell"),
    )


def samples(spark, sf) -> DataFrame:
    """(sample_idx, metacell, donor, donor_idx): at most two metacells per nation."""
    names = load(spark, sf, "orders").join(
        load(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")
    ).select(
        F.expr("concat('D', c_nationkey, ':', o_custkey % 2 + 1)").alias("metacell"),
        F.expr("concat('D', c_nationkey)").alias("donor"),
        F.col("c_nationkey").alias("donor_idx"),
    ).distinct()
    return names.withColumn("sample_idx", F.row_number().over(Window.orderBy("metacell")) - 1)


def stat(spark, sf) -> DataFrame:
    return junction_stats(junctions(spark, sf), barcodes(spark, sf))


def stat_table(spark, sf) -> DataFrame:
    """The per-metacell counts as a stored table: a stage boundary, read by every later step."""
    return cut_lineage(stat(spark, sf))


def variants(spark, sf) -> DataFrame:
    """(snp, k, chrom, snp_pos): one variant per part, 2 kb apart."""
    return load(spark, sf, "part").select(
        F.col("p_partkey").alias("k"),
        F.expr("concat('chr', p_partkey % 5 + 1, ':', p_partkey * 2000, ':A:G')").alias("snp"),
        F.expr("concat('chr', p_partkey % 5 + 1)").alias("chrom"),
        F.expr("p_partkey * 2000").alias("snp_pos"),
    )


def hash32(factor: str) -> str:
    """SQL of factor * 2654435761 modulo 2^32, in halves of the multiplier so that no product leaves the range of a bigint."""
    m = f"(({factor}) % 4294967296)"
    return f"(({m} * 40503 % 4294967296 * 65536 + {m} * 31153) % 4294967296)"


DOSAGE = "CAST(" + hash32("(CAST(d AS BIGINT) + 3) * (k + 7)") + " div 65536 % 3 AS INT)"


def n_donors(spark, sf) -> int:
    """Length of donor arrays: one more than the largest nation key."""
    return load(spark, sf, "nation").agg(F.max("n_nationkey")).first()[0] + 1


def genotypes(spark, sf, listed: DataFrame | None = None) -> DataFrame:
    """Variants (those in ``listed`` by snp, if given) with ``dosage`` ARRAY<DOUBLE> over the donor indices; spread first, as a few MB of keys become as many arrays."""
    named = variants(spark, sf)
    if listed is not None:
        named = named.join(listed.select("snp").distinct(), "snp", "left_semi").select(*named.columns)
    spread = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return named.repartition(spread, "k").withColumn(
        "dosage", F.expr(f"transform(sequence(0, {n_donors(spark, sf) - 1}), d -> CAST({DOSAGE} AS DOUBLE))"))


def genotype_long(spark, sf) -> DataFrame:
    return genotypes(spark, sf).select("snp", "k", "chrom", "snp_pos", F.posexplode("dosage").alias("donor_idx", "dosage"))


def gwas(spark, sf) -> DataFrame:
    """(study, variant_id, chrom, snp_pos, beta, se, p, event_id): one row per event."""
    base = load(spark, sf, "events").select(
        F.col("event_type").alias("study"),
        F.expr("user_id * 13").alias("k"),
        ((F.col("value") - 50.0) / 100.0).alias("beta"),
        (F.lit(0.1) + F.lit(0.02) * F.expr("event_id % 5")).alias("se"),
        "event_id",
    )
    return base.select(
        "study",
        F.expr("concat('chr', k % 5 + 1, ':', k * 2000)").alias("variant_id"),
        F.expr("concat('chr', k % 5 + 1)").alias("chrom"),
        F.expr("k * 2000").alias("snp_pos"),
        "k", "beta", "se", (F.col("beta") / F.col("se")).alias("z"), "event_id",
    ).withColumn("p", two_sided_p("z"))


def maf(spark, sf) -> DataFrame:
    return load(spark, sf, "part").select(
        F.expr("concat('chr', p_partkey % 5 + 1, ':', p_partkey * 2000)").alias("variant_id"),
        (F.lit(0.05) + F.lit(0.009) * F.col("p_size")).alias("maf"),
    )


def studies(spark, sf) -> DataFrame:
    """Study dimension: cases and controls from event counts (in thousands), or a total for the quantitative study."""
    n = load(spark, sf, "events").groupBy(F.col("event_type").alias("study")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") < 50).alias("low"))
    quant = F.col("study") == "error"
    return n.select(
        "study", F.when(quant, "quant").otherwise("cc").alias("trait_type"),
        (F.when(quant, F.col("n")).otherwise(F.col("low") + 1) * 1000).alias("n_case"),
        (F.when(quant, F.lit(0)).otherwise(F.col("n") - F.col("low") + 1) * 1000).alias("n_control"))


def cells(spark, sf) -> DataFrame:
    """(cell_id, donor, pc): component scores of cells."""
    return load(spark, sf, "embeddings").select(
        F.col("vec_id").alias("cell_id"), F.expr("concat('D', label)").alias("donor"),
        F.transform("embedding", lambda x: x.cast("double")).alias("pc"),
    )
