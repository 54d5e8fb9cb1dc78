"""Query catalogue: each entry is a Spark job and, where SQL can say it, its check in SQL.

All entries read the whole tables. Reads, cells, donors, variants and studies are derived in
``tables`` (Spark) and ``oracle_tables`` (SQL).
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceweave.functions import genotype, keys
from spliceweave.functions.distributions import norm_ppf_sql
from spliceweave.operators import (
    association, context, correlation, gwas, heidi, intervals, introns, junctions, metacells, multiple_testing,
    nominal, null_model, phenotype, relatedness, retention, strata,
)
from spliceweave.operators import splicing_pcs as splicing_pc
from spliceweave.plans import oracle_tables as o
from spliceweave.plans import tables as t
from spliceweave.session import cut_lineage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
MIN_READS = 10
MARKER_ROWS = 1 << 12


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def r6(col, name):
    return F.round(col, 6).alias(name)


# ------------------------------------------------------------------ junction reads

@query("junc_anchor_filter", f"""WITH {o.READS}
SELECT chrom, strand, j_start, j_end, cb, umi, anchor_l, anchor_r FROM junc
WHERE j_end - j_start BETWEEN 8500 AND 11500 AND least(anchor_l, anchor_r) >= 8""")
def junc_anchor_filter(spark, sf):
    kept = junctions.filter_junctions(t.junctions(spark, sf), 8, 8500, 11500)
    return kept.select("chrom", "strand", "j_start", "j_end", "cb", "umi",
                       F.col("anchors")[0].alias("anchor_l"), F.col("anchors")[1].cast("bigint").alias("anchor_r"))


@query("junc_stat_dedup", f"WITH {o.STAT} SELECT * FROM stat")
def junc_stat_dedup(spark, sf):
    return t.stat(spark, sf)


@query("stat_read_threshold", f"WITH {o.INTRONS} SELECT chrom, strand, j_start, j_end, reads FROM introns")
def stat_read_threshold(spark, sf):
    return junctions.intron_totals(t.stat(spark, sf), MIN_READS)


@query("junc_sample_totals", f"""WITH {o.STAT}
SELECT metacell, CAST(sum(n) AS BIGINT) AS reads, count(*) AS n_introns FROM stat GROUP BY ALL""")
def junc_sample_totals(spark, sf):
    return t.stat(spark, sf).groupBy("metacell").agg(F.sum("n").alias("reads"), F.count(F.lit(1)).alias("n_introns"))


@query("junc_anti_missing", f"""WITH {o.STAT}
SELECT i.chrom, i.strand, i.j_start, i.j_end, s.metacell
FROM (SELECT DISTINCT chrom, strand, j_start, j_end FROM stat) i CROSS JOIN samples s
WHERE NOT EXISTS (SELECT 1 FROM stat x WHERE x.chrom = i.chrom AND x.strand = i.strand
  AND x.j_start = i.j_start AND x.j_end = i.j_end AND x.metacell = s.metacell)""")
def junc_anti_missing(spark, sf):
    """Expected (intron, metacell) results that no count file provides."""
    stat = t.stat_table(spark, sf)
    samples, n = sample_frame(spark, sf)
    seen = stat.select(*junctions.JUNCTION).distinct().withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    expected = seen.join(samples.select("sample_idx", "metacell"), "sample_idx").drop("sample_idx")
    return gwas.missing_results(expected, stat, [*junctions.JUNCTION, "metacell"])


# ------------------------------------------------------------------ introns and sites

def kept_introns(spark, sf):
    return cut_lineage(junctions.intron_totals(t.stat(spark, sf), MIN_READS))


@query("intron_endpoints", f"""WITH {o.INTRONS}
SELECT chrom, strand, pos, side, count(*) AS n_introns FROM ends GROUP BY ALL""")
def intron_endpoints(spark, sf):
    return introns.endpoints(kept_introns(spark, sf)).groupBy(*introns.SITE).agg(F.count(F.lit(1)).alias("n_introns"))


CLUSTERS = o.INTRONS.replace("WITH ", "") + """,
links AS (SELECT DISTINCT chrom, strand, j_start AS a, j_end AS b FROM introns
          UNION SELECT DISTINCT chrom, strand, j_end, j_start FROM introns),
reach AS (
  SELECT chrom, strand, a AS node, a AS seen FROM links
  UNION
  SELECT r.chrom, r.strand, r.node, l.b FROM reach r
  JOIN links l ON l.chrom = r.chrom AND l.strand = r.strand AND l.a = r.seen),
label AS (SELECT chrom, strand, node, min(seen) AS cluster FROM reach GROUP BY ALL),
clustered AS (
  SELECT i.*, l.cluster FROM introns i
  JOIN label l ON l.chrom = i.chrom AND l.strand = i.strand AND l.node = i.j_start)"""


@query("intron_clusters", f"WITH RECURSIVE {CLUSTERS} SELECT chrom, strand, j_start, j_end, reads, cluster FROM clustered")
def intron_clusters(spark, sf):
    return introns.intron_clusters(kept_introns(spark, sf)).select(*junctions.JUNCTION, "reads", "cluster")


@query("refined_clusters", f"""WITH RECURSIVE {CLUSTERS}
SELECT chrom || ':' || strand || ':' || cluster AS cluster_id, count(*) AS n_introns, CAST(sum(reads) AS BIGINT) AS reads,
       string_agg(j_start || ':' || j_end || ':' || reads, ' ' ORDER BY j_start, j_end) AS introns
FROM clustered GROUP BY ALL""")
def refined_clusters(spark, sf):
    named = introns.intron_clusters(kept_introns(spark, sf)).withColumn("cluster_id", introns.cluster_name())
    item = F.struct("j_start", "j_end", "reads")
    return named.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("n_introns"), F.sum("reads").alias("reads"),
        F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda s: F.concat_ws(
            ":", s["j_start"].cast("string"), s["j_end"].cast("string"), s["reads"].cast("string"))), " ").alias("introns"))


@query("single_intron_sites", f"""WITH {o.INTRONS}
SELECT e.chrom, e.strand, e.pos, e.side, e.partner FROM ends e
JOIN marked m USING (chrom, strand, j_start, j_end) WHERE m.single""")
def single_intron_sites(spark, sf):
    return introns.single_intron_sites(kept_introns(spark, sf))


@query("included_excluded", f"""WITH {o.INTRONS},
pairs AS (
  SELECT DISTINCT e.chrom, e.strand, e.pos, e.side, r.j_start, r.j_end,
         CASE WHEN e.side = 'start' THEN r.j_start ELSE r.j_end END = e.pos AS own
  FROM ends e JOIN ends r ON e.chrom = r.chrom AND e.strand = r.strand AND r.side <> e.side AND r.pos = e.partner)
SELECT chrom, strand, pos, side, count(*) FILTER (own) AS n_included, count(*) FILTER (NOT own) AS n_excluded
FROM pairs GROUP BY ALL""")
def included_excluded(spark, sf):
    return introns.competitor_counts(kept_introns(spark, sf))


@query("included_excluded_lists", f"""WITH {o.INTRONS},
pairs AS (
  SELECT DISTINCT e.chrom, e.strand, e.pos, e.side, r.j_start, r.j_end,
         CASE WHEN e.side = 'start' THEN r.j_start ELSE r.j_end END = e.pos AS own
  FROM ends e JOIN ends r ON e.chrom = r.chrom AND e.strand = r.strand AND r.side <> e.side AND r.pos = e.partner)
SELECT chrom, strand, pos, side,
  coalesce(string_agg(j_start || ':' || j_end, ' ' ORDER BY j_start, j_end) FILTER (own), '') AS included,
  coalesce(string_agg(j_start || ':' || j_end, ' ' ORDER BY j_start, j_end) FILTER (NOT own), '') AS excluded
FROM pairs GROUP BY ALL""")
def included_excluded_lists(spark, sf):
    lists = introns.included_excluded(kept_introns(spark, sf))

    def text(c):
        return F.array_join(F.transform(c, lambda s: F.concat_ws(
            ":", s["j_start"].cast("string"), s["j_end"].cast("string"))), " ").alias(c)

    return lists.select(*introns.SITE, text("included"), text("excluded"))


def competitive_usage(spark, sf):
    stat = t.stat_table(spark, sf)
    kept = cut_lineage(junctions.intron_totals(stat, MIN_READS))
    rivals = cut_lineage(introns.mark_single(kept).filter(~F.col("single")))
    return introns.site_usage(stat, rivals)


@query("site_phenotype", f"WITH {o.USAGE} SELECT * FROM usage")
def site_phenotype(spark, sf):
    return competitive_usage(spark, sf)


@query("site_phenotype_cluster", f"""WITH RECURSIVE {CLUSTERS},
whole AS (SELECT c.chrom, c.strand, c.cluster, s.metacell, CAST(sum(s.n) AS BIGINT) AS total
          FROM clustered c JOIN stat s USING (chrom, strand, j_start, j_end) GROUP BY ALL),
own AS (SELECT e.chrom, e.strand, e.pos, e.side, s.metacell, CAST(sum(s.n) AS BIGINT) AS included
        FROM ends e JOIN stat s USING (chrom, strand, j_start, j_end) GROUP BY ALL),
member AS (SELECT DISTINCT e.chrom, e.strand, e.pos, e.side, c.cluster
           FROM ends e JOIN clustered c USING (chrom, strand, j_start, j_end))
SELECT m.chrom, m.strand, m.pos, m.side, w.metacell, coalesce(o.included, 0) AS included, w.total
FROM member m JOIN whole w USING (chrom, strand, cluster)
LEFT JOIN own o ON o.chrom = m.chrom AND o.strand = m.strand AND o.pos = m.pos AND o.side = m.side AND o.metacell = w.metacell""")
def site_phenotype_cluster(spark, sf):
    stat = t.stat_table(spark, sf)
    clustered = cut_lineage(introns.intron_clusters(cut_lineage(junctions.intron_totals(stat, MIN_READS))))
    return introns.site_usage(stat, clustered, competitors="cluster")


# ------------------------------------------------------------------ intron retention

NONSPLIT = """,
nons AS (
  SELECT chrom, strand, CASE WHEN umi % 2 = 1 THEN j_start ELSE j_end END AS pos, metacell,
         count(DISTINCT (cb, umi)) AS nonsplit
  FROM reads JOIN barcodes USING (cb) WHERE NOT is_split GROUP BY ALL)"""


@query("barcode_semi_counts", f"WITH {o.READS}, {o.BARCODES} {NONSPLIT} SELECT * FROM nons")
def barcode_semi_counts(spark, sf):
    return retention.nonsplit_counts(t.nonsplit(spark, sf), t.barcodes(spark, sf).drop("donor"))


IR = o.INTRONS + NONSPLIT + """,
alone AS (SELECT e.* FROM ends e JOIN marked m USING (chrom, strand, j_start, j_end) WHERE m.single),
parts AS (
  SELECT a.chrom, a.strand, a.pos, a.side, s.metacell, s.n AS split, 0 AS nonsplit
  FROM alone a JOIN stat s USING (chrom, strand, j_start, j_end)
  UNION ALL
  SELECT a.chrom, a.strand, a.pos, a.side, x.metacell, 0, x.nonsplit FROM alone a JOIN nons x USING (chrom, strand, pos)),
ir AS (
  SELECT chrom, strand, pos, side, metacell, CAST(sum(split) AS BIGINT) AS included,
         CAST(sum(split + nonsplit) AS BIGINT) AS total
  FROM parts WHERE (chrom, strand, pos) IN (SELECT (chrom, strand, pos) FROM nons) GROUP BY ALL)"""


def retention_usage(spark, sf):
    stat = t.stat_table(spark, sf)
    counts = retention.nonsplit_counts(t.nonsplit(spark, sf), t.barcodes(spark, sf).drop("donor"))
    return retention.combine_ir(cut_lineage(counts), cut_lineage(junctions.intron_totals(stat, MIN_READS)), stat)


@query("ir_usage", f"""WITH {IR}
SELECT *, round(included::DOUBLE / nullif(total, 0), 6) AS ratio FROM ir""")
def ir_usage(spark, sf):
    return retention_usage(spark, sf).withColumn("ratio", F.round(F.try_divide("included", "total"), 6))


@query("nonsplit_nonzero_sites", f"""WITH {o.READS}, {o.BARCODES} {NONSPLIT},
net AS (SELECT *, nonsplit - 1 AS extra FROM nons)
SELECT chrom, strand, pos, metacell, extra FROM net
WHERE (chrom, strand, pos) IN (SELECT (chrom, strand, pos) FROM net GROUP BY chrom, strand, pos HAVING sum(extra) > 0)""")
def nonsplit_nonzero_sites(spark, sf):
    counts = retention.nonsplit_counts(t.nonsplit(spark, sf), t.barcodes(spark, sf).drop("donor"))
    net = counts.select("chrom", "strand", "pos", "metacell", (F.col("nonsplit") - 1).alias("extra"))
    return phenotype.drop_all_zero(net, ["chrom", "strand", "pos"], "extra")


# ------------------------------------------------------------------ phenotype filtering

SITE = introns.SITE
MIN_SD, MAX_SPARSITY = 0.2, 0.5


def sample_frame(spark, sf):
    samples = t.samples(spark, sf)
    return samples, samples.count()


@query("site_filter_sd_sparsity", f"""WITH {o.SPREAD}
SELECT chrom, strand, pos, side, round(sparsity, 6) AS sparsity, round(sd, 6) AS sd FROM kept""")
def site_filter_sd_sparsity(spark, sf):
    _, n = sample_frame(spark, sf)
    kept = phenotype.retained_sites(competitive_usage(spark, sf), SITE, n, MIN_SD, MAX_SPARSITY)
    return kept.select(*SITE, r6("sparsity", "sparsity"), r6("sd", "sd"))


@query("ir_filter_sd_sparsity", f"""WITH {IR},
spread AS (
  SELECT chrom, strand, pos, side, 1e0 - count(*) FILTER (total > 0) / (SELECT count(*) FROM samples)::DOUBLE AS sparsity,
         stddev_samp(included::DOUBLE / total) FILTER (total > 0) AS sd FROM ir GROUP BY ALL)
SELECT chrom, strand, pos, side, round(sparsity, 6) AS sparsity, round(sd, 6) AS sd FROM spread
WHERE sparsity < 0.5 AND sd > 0.1""")
def ir_filter_sd_sparsity(spark, sf):
    _, n = sample_frame(spark, sf)
    kept = phenotype.retained_sites(retention_usage(spark, sf), SITE, n, 0.1, 0.5)
    return kept.select(*SITE, r6("sparsity", "sparsity"), r6("sd", "sd"))


def filled_phenotype(spark, sf):
    samples, n = sample_frame(spark, sf)
    return phenotype.filter_phenotype(competitive_usage(spark, sf), SITE, samples, n, MIN_SD, MAX_SPARSITY)


@query("median_impute", f"""WITH {o.SPREAD}
SELECT chrom, strand, pos, side, metacell, included, total, imputed,
       round(included::DOUBLE / nullif(total, 0), 6) AS ratio FROM filled""")
def median_impute(spark, sf):
    return filled_phenotype(spark, sf).select(*SITE, "metacell", "included", "total", "imputed", "ratio")


DONOR_SAMPLES = [f"D{d}:{k}" for d in range(25) for k in (1, 2)]
PROP_COLUMNS = ", ".join(
    f"max(round(included::DOUBLE / nullif(total, 0), 6)) FILTER (metacell = '{s}') AS \"{s.replace(':', '_')}\"" for s in DONOR_SAMPLES)


@query("usage_prop_export", f"""WITH {o.SPREAD}
SELECT chrom || ':' || strand || ':' || pos AS site, {PROP_COLUMNS} FROM filled GROUP BY chrom, strand, pos, side""")
def usage_prop_export(spark, sf):
    long = filled_phenotype(spark, sf).withColumn("site", keys.site_key())
    names = [f"D{d}:{k}" for d in range(t.n_donors(spark, sf)) for k in (1, 2)]
    wide = phenotype.widen(long, ["site", "side"], "metacell", "ratio", names, fill=None)
    return wide.select("site", *[F.col(f"`{s}`").alias(s.replace(":", "_")) for s in names])


@query("unpivot_counts", """WITH wide AS (
  SELECT l_suppkey, CAST(count(*) FILTER (l_returnflag = 'A') AS BIGINT) AS A, CAST(count(*) FILTER (l_returnflag = 'N') AS BIGINT) AS N,
         CAST(count(*) FILTER (l_returnflag = 'R') AS BIGINT) AS R FROM lineitem GROUP BY ALL)
SELECT l_suppkey, 'A' AS flag, A AS n FROM wide UNION ALL SELECT l_suppkey, 'N', N FROM wide
UNION ALL SELECT l_suppkey, 'R', R FROM wide""")
def unpivot_counts(spark, sf):
    counts = t.load(spark, sf, "lineitem").groupBy("l_suppkey", "l_returnflag").agg(F.count(F.lit(1)).alias("n"))
    wide = phenotype.widen(counts, ["l_suppkey"], "l_returnflag", "n", ["A", "N", "R"])
    return phenotype.lengthen(wide, ["l_suppkey"], ["A", "N", "R"], "flag", "n")


@query("covariate_transpose", f"""WITH {o.BARCODES},
c AS (SELECT 'D' || c_nationkey || ':' || (c_custkey % 2 + 1) AS metacell, c_acctbal FROM customer)
SELECT metacell, round(avg(c_acctbal), 6) AS mean_state, CAST(count(*) AS DOUBLE) AS num_cells, round(max(c_acctbal), 6) AS top_state
FROM c GROUP BY ALL""")
def covariate_transpose(spark, sf):
    """Covariate rows (one per covariate and sample) turned into covariate columns."""
    c = t.load(spark, sf, "customer").select(
        F.expr("concat('D', c_nationkey, ':', c_custkey % 2 + 1)").alias("metacell"), "c_acctbal")
    per = c.groupBy("metacell").agg(F.avg("c_acctbal").alias("a"), F.count(F.lit(1)).cast("double").alias("b"),
                                    F.max("c_acctbal").alias("d"))
    long = per.select("metacell", F.inline(F.array(
        F.struct(F.lit("mean_state").alias("cov"), F.round("a", 6).alias("value")),
        F.struct(F.lit("num_cells").alias("cov"), F.col("b").alias("value")),
        F.struct(F.lit("top_state").alias("cov"), F.round("d", 6).alias("value")))))
    return phenotype.covariates_by_sample(long, ["mean_state", "num_cells", "top_state"])


@query("cluster_intron_ratio", f"""WITH RECURSIVE {CLUSTERS},
counts AS (SELECT c.chrom || ':' || c.strand || ':' || c.cluster AS cluster_id,
                  s.chrom || ':' || s.strand || ':' || s.j_start || ':' || s.j_end AS intron, s.metacell, s.n
           FROM clustered c JOIN stat s USING (chrom, strand, j_start, j_end)),
several AS (SELECT cluster_id FROM counts GROUP BY ALL HAVING count(DISTINCT intron) >= 2),
totals AS (SELECT cluster_id, metacell, sum(n) AS total FROM counts GROUP BY ALL),
dense AS (
  SELECT i.cluster_id, i.intron, t.metacell, coalesce(c.n, 0) AS n, CAST(t.total AS BIGINT) AS total
  FROM (SELECT DISTINCT cluster_id, intron FROM counts WHERE cluster_id IN (SELECT cluster_id FROM several)) i
  JOIN totals t USING (cluster_id) LEFT JOIN counts c USING (cluster_id, intron, metacell)),
fill AS (SELECT cluster_id, intron, CAST((SELECT count(*) FROM samples) - count(*) AS BIGINT) AS n_filled,
                round_even(median(n), 0) / nullif(round_even(median(total), 0), 0) AS fill FROM dense GROUP BY ALL)
SELECT d.cluster_id, d.intron, d.metacell, d.n, d.total, round(d.n::DOUBLE / nullif(d.total, 0), 6) AS ratio,
       f.n_filled, round(f.fill, 6) AS fill FROM dense d JOIN fill f USING (cluster_id, intron)""")
def cluster_intron_ratio(spark, sf):
    stat = t.stat_table(spark, sf)
    clustered = cut_lineage(introns.intron_clusters(cut_lineage(junctions.intron_totals(stat, MIN_READS))))
    counts = stat.join(clustered.select(*junctions.JUNCTION, "cluster"), junctions.JUNCTION).select(
        introns.cluster_name().alias("cluster_id"), keys.intron_key().alias("intron"), "metacell", "n")
    _, n = sample_frame(spark, sf)
    return introns.cluster_intron_ratio(counts, n).select(
        "cluster_id", "intron", "metacell", "n", "total", r6("ratio", "ratio"), "n_filled", r6("fill", "fill"))


# ------------------------------------------------------------------ range joins

def gene_sites(spark, sf):
    """Every used splice site of every gene: (chrom, strand, pos)."""
    ends = introns.endpoints(t.junctions(spark, sf).select(*junctions.JUNCTION).distinct())
    return ends.select("chrom", "strand", "pos").distinct()


SITES = """sites AS (SELECT DISTINCT chrom, strand, j_start AS pos FROM junc
  UNION SELECT DISTINCT chrom, strand, j_end FROM junc)"""


@query("cis_window_pairs", f"""WITH {o.READS}, {SITES}, {o.VARIANTS}
SELECT s.chrom, s.strand, s.pos, v.snp, CAST(v.snp_pos - s.pos AS BIGINT) AS offset_bp
FROM sites s JOIN variants v ON v.chrom = s.chrom AND abs(v.snp_pos - s.pos) <= 500000""")
def cis_window_pairs(spark, sf):
    pairs = intervals.window_join(gene_sites(spark, sf), t.variants(spark, sf), ["chrom"], "pos", "snp_pos", 500_000)
    return pairs.select("chrom", "strand", "pos", "snp", (F.col("snp_pos") - F.col("pos")).alias("offset_bp"))


@query("shared_loci_semi", f"""WITH {o.READS}, {SITES}, {o.GWAS},
hits AS (SELECT * FROM gwas WHERE p < 1e-3)
SELECT s.chrom, s.strand, s.pos, d.study FROM sites s CROSS JOIN (SELECT DISTINCT study FROM hits) d
WHERE EXISTS (SELECT 1 FROM hits h WHERE h.study = d.study AND h.chrom = s.chrom
  AND h.snp_pos < s.pos + 30000 AND h.snp_pos > s.pos - 30000)""")
def shared_loci_semi(spark, sf):
    hits = t.gwas(spark, sf).filter("p < 1e-3")
    return gwas.shared_loci(gene_sites(spark, sf), hits, 30_000)


GENES = """genes AS (SELECT DISTINCT gene, 'chr' || (gene % 5 + 1) AS chrom, gene * 100000 AS g_start,
  gene * 100000 + 11000 AS g_end FROM reads)"""


@query("point_in_interval", f"""WITH {o.READS}, {GENES}, {o.VARIANTS}
SELECT v.snp, g.gene FROM variants v JOIN genes g ON g.chrom = v.chrom AND g.g_start < v.snp_pos AND v.snp_pos < g.g_end""")
def point_in_interval(spark, sf):
    genes = t.reads(spark, sf).select("gene", "chrom").distinct().selectExpr(
        "gene", "chrom", "gene * 100000 AS g_start", "gene * 100000 + 11000 AS g_end")
    return intervals.point_in_interval(t.variants(spark, sf), genes, ["chrom"], "snp_pos", "g_start", "g_end").select("snp", "gene")


@query("intron_in_gene", f"""WITH {o.READS},
genes AS (SELECT DISTINCT gene, 'chr' || (gene % 5 + 1) AS chrom, gene * 100000 AS g_start, gene * 100000 + 12500 AS g_end FROM reads),
spans AS (SELECT DISTINCT chrom, strand, j_start, j_end FROM junc)
SELECT s.chrom, s.strand, s.j_start, s.j_end, g.gene FROM spans s
JOIN genes g ON g.chrom = s.chrom AND g.g_start < s.j_start AND s.j_end < g.g_end""")
def intron_in_gene(spark, sf):
    genes = t.reads(spark, sf).select("gene", "chrom").distinct().selectExpr(
        "gene", "chrom", "gene * 100000 AS g_start", "gene * 100000 + 12500 AS g_end")
    spans = t.junctions(spark, sf).select(*junctions.JUNCTION).distinct()
    return intervals.span_in_interval(spans, genes, ["chrom"], "j_start", "j_end", "g_start", "g_end").select(
        *junctions.JUNCTION, "gene")


# ------------------------------------------------------------------ genotype and text columns

@query("genotype_dosage", """WITH g AS (
  SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN '0|0:35' WHEN 1 THEN '0|1:12' WHEN 2 THEN '1|0:9'
    WHEN 3 THEN '1|1:40' WHEN 4 THEN '0/1:8' ELSE './.' END AS gt FROM part)
SELECT p_partkey, gt, CASE WHEN starts_with(gt, '0|0') THEN 0 WHEN starts_with(gt, '0|1') THEN 1
  WHEN starts_with(gt, '1|0') THEN 1 WHEN starts_with(gt, '1|1') THEN 2 END AS dosage FROM g""")
def genotype_dosage(spark, sf):
    gt = F.expr("CASE p_size % 6 WHEN 0 THEN '0|0:35' WHEN 1 THEN '0|1:12' WHEN 2 THEN '1|0:9' "
                "WHEN 3 THEN '1|1:40' WHEN 4 THEN '0/1:8' ELSE './.' END")
    return t.load(spark, sf, "part").select("p_partkey", gt.alias("gt")).withColumn(
        "dosage", genotype.dosage("gt").cast("int"))


@query("variant_id_parse", f"""WITH {o.VARIANTS}
SELECT snp, split_part(snp, ':', 1) AS chrom, CAST(split_part(snp, ':', 2) AS BIGINT) AS pos, split_part(snp, ':', 3) AS ref,
       split_part(snp, ':', 4) AS alt, upper(split_part(snp, ':', 1)) || ':' || split_part(snp, ':', 2) AS locus,
       replace(chrom, 'chr', '') AS chrom_number FROM variants""")
def variant_id_parse(spark, sf):
    return t.variants(spark, sf).select(
        "snp", keys.parse_variant("snp").alias("v"), keys.variant_locus("snp").alias("locus"),
        keys.strip_chr("chrom").alias("chrom_number")).select("snp", "v.*", "locus", "chrom_number")


@query("barcode_parts", """WITH b AS (
  SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' THEN 'Target' ELSE 'Source' END || ':D' || (o_custkey % 7) AS batch_ind,
    CASE WHEN o_orderstatus = 'O' THEN '' ELSE 'lib' || (o_orderkey % 3) || '_' END || 'AC' || o_orderkey || '-1' AS barcode FROM orders)
SELECT o_orderkey, split_part(batch_ind, ':', 1) AS batch, split_part(batch_ind, ':', 2) AS ind,
  CASE WHEN starts_with(batch_ind, 'Source') THEN split_part(barcode, '_', 1) END AS lib,
  'AC' || o_orderkey AS cb FROM b""")
def barcode_parts(spark, sf):
    raw = t.load(spark, sf, "orders").select(
        "o_orderkey",
        F.expr("concat(CASE WHEN o_orderstatus = 'O' THEN 'Target' ELSE 'Source' END, ':D', o_custkey % 7)").alias("batch_ind"),
        F.expr("concat(CASE WHEN o_orderstatus = 'O' THEN '' ELSE concat('lib', o_orderkey % 3, '_') END, 'AC', o_orderkey, '-1')").alias("barcode"))
    return raw.select("o_orderkey", keys.cell_barcode("batch_ind", "barcode").alias("b")).select("o_orderkey", "b.*")


@query("info_af_extract", """WITH v AS (
  SELECT p_partkey, 'AC=' || p_size || ';AF=' || (p_size / 100e0) || ';AN=100' AS info FROM part)
SELECT p_partkey, round(1 - CAST(regexp_extract(info, ';AF=([^;]+)', 1) AS DOUBLE), 6) AS freq FROM v""")
def info_af_extract(spark, sf):
    info = F.expr("concat('AC=', p_size, ';AF=', p_size / 100D, ';AN=100')")
    return t.load(spark, sf, "part").select("p_partkey", info.alias("info")).select(
        "p_partkey", r6(genotype.ref_frequency("info"), "freq"))


# ------------------------------------------------------------------ multiple testing

# ties: the largest rank of equal p-values decides, and the running minimum carries it to the others
BH = """ranked AS (SELECT *, rank() OVER ({part} ORDER BY p) + count(*) OVER (PARTITION BY {tie}) - 1 AS rk,
  count(*) OVER ({part}) AS n FROM src),
adj AS (SELECT *, least(1e0, min(n * p / rk) OVER ({part} ORDER BY p DESC RANGE UNBOUNDED PRECEDING)) AS q0 FROM ranked)
SELECT event_id, study, round(p, 9) AS p, round(q0, 6) AS q FROM adj"""


@query("bh_fdr", f"WITH {o.GWAS}, src AS (SELECT * FROM gwas), " + BH.format(part="", tie="p"))
def bh_fdr(spark, sf):
    out = multiple_testing.benjamini_hochberg(t.gwas(spark, sf).select("event_id", "study", "p"))
    return out.select("event_id", "study", F.round("p", 9).alias("p"), r6("q", "q"))


@query("bh_fdr_by_study", f"WITH {o.GWAS}, src AS (SELECT * FROM gwas), " + BH.format(part="PARTITION BY study", tie="study, p"))
def bh_fdr_by_study(spark, sf):
    out = multiple_testing.benjamini_hochberg(t.gwas(spark, sf).select("event_id", "study", "p"), partition_by=["study"])
    return out.select("event_id", "study", F.round("p", 9).alias("p"), r6("q", "q"))


@query("bh_fdr_chunked", f"WITH {o.GWAS}, src AS (SELECT *, event_id // 1000 AS chunk FROM gwas), "
       + BH.format(part="PARTITION BY chunk", tie="chunk, p"))
def bh_fdr_chunked(spark, sf):
    src = t.gwas(spark, sf).select("event_id", "study", "p").withColumn(
        "chunk", multiple_testing.chunk_number(F.col("event_id") + 1))
    out = multiple_testing.benjamini_hochberg(src, partition_by=["chunk"])
    return out.select("event_id", "study", F.round("p", 9).alias("p"), r6("q", "q"))


@query("bonferroni_scalar", f"WITH {o.GWAS} SELECT event_id, round(least(1e0, p * 1000), 9) AS p_adj FROM gwas")
def bonferroni_scalar(spark, sf):
    return t.gwas(spark, sf).select("event_id", F.round(multiple_testing.bonferroni("p", 1000), 9).alias("p_adj"))


@query("p_from_z", f"WITH {o.GWAS} SELECT event_id, round(-log10(greatest(p, 1e-300)), 6) AS neg_log10_p, "
       f"round({norm_ppf_sql('(least(greatest(p, 1e-300), 0.999999e0) * 0.5e0)')}, 6) AS z_back FROM gwas")
def p_from_z(spark, sf):
    floor = F.greatest(F.col("p"), F.lit(1e-300))
    back = norm_ppf_sql("half")
    return t.gwas(spark, sf).withColumn("half", F.least(floor, F.lit(0.999999)) * 0.5).select(
        "event_id", r6(-F.log10(floor), "neg_log10_p"), r6(F.expr(back), "z_back"))


# ------------------------------------------------------------------ GWAS integration

@query("gwas_merge_maf", f"""WITH {o.GWAS}, q AS (SELECT * FROM gwas WHERE study = 'click'), w AS (SELECT * FROM gwas WHERE study = 'view')
SELECT upper(q.variant_id) AS variant_id, q.event_id AS q_event, w.event_id AS g_event, round(q.beta, 6) AS beta_sqtl,
       round(w.beta, 6) AS beta_gwas, round(m.maf, 6) AS maf
FROM q JOIN maf m ON upper(m.variant_id) = upper(q.variant_id) JOIN w ON upper(w.variant_id) = upper(q.variant_id)""")
def gwas_merge_maf(spark, sf):
    rows = t.gwas(spark, sf)
    q = rows.filter("study = 'click'").select("variant_id", "beta", "se", "p", F.col("event_id").alias("q_event"))
    g = rows.filter("study = 'view'").select("variant_id", "beta", "se", "p", F.col("event_id").alias("g_event"))
    return gwas.merge_gwas(q, t.maf(spark, sf), g).select(
        "variant_id", "q_event", "g_event", r6("beta_sqtl", "beta_sqtl"), r6("beta_gwas", "beta_gwas"), r6("maf", "maf"))


@query("best_hit_per_locus", f"""WITH {o.GWAS} SELECT study, chrom, event_id, variant_id, round(beta / se, 6) AS z FROM (
  SELECT *, row_number() OVER (PARTITION BY study, chrom ORDER BY p, event_id) AS rk FROM gwas) WHERE rk = 1""")
def best_hit_per_locus(spark, sf):
    rows = t.gwas(spark, sf).select("study", "chrom", "event_id", "variant_id", "p", "z")
    return gwas.best_hit(rows, ["study", "chrom"], "p", ["event_id"]).select(
        "study", "chrom", "event_id", "variant_id", r6("z", "z"))


@query("dedup_first", f"""WITH {o.GWAS} SELECT study, variant_id, event_id, round(beta, 6) AS beta FROM (
  SELECT *, row_number() OVER (PARTITION BY study, variant_id ORDER BY event_id) AS rk FROM gwas) WHERE rk = 1""")
def dedup_first(spark, sf):
    rows = t.gwas(spark, sf).select("study", "variant_id", "event_id", r6("beta", "beta"))
    return gwas.first_per_key(rows, ["study", "variant_id"], ["event_id"])


@query("case_fraction_dim", f"""WITH {o.GWAS}
SELECT g.study, s.trait_type, count(*) AS n_rows, round(max(s.n_case)::DOUBLE / max(s.n_case + s.n_control), 6) AS case_fraction,
       CAST(max(s.n_case + s.n_control) AS BIGINT) AS n_total FROM gwas g JOIN studies s USING (study) GROUP BY ALL""")
def case_fraction_dim(spark, sf):
    joined = t.gwas(spark, sf).join(t.studies(spark, sf), "study")
    return joined.groupBy("study", "trait_type").agg(
        F.count(F.lit(1)).alias("n_rows"), F.max(F.round(gwas.case_fraction("n_case", "n_control"), 6)).alias("case_fraction"),
        F.max(F.col("n_case") + F.col("n_control")).alias("n_total"))


@query("power_by_study", f"""WITH {o.GWAS}
SELECT study, count(DISTINCT variant_id) FILTER (p < 1e-2) AS n_nominal,
       count(DISTINCT variant_id) FILTER (least(1e0, p * 1000) < 0.05) AS n_adjusted FROM gwas GROUP BY ALL""")
def power_by_study(spark, sf):
    return t.gwas(spark, sf).withColumn("adj", multiple_testing.bonferroni("p", 1000)).groupBy("study").agg(
        F.count_distinct(F.when(F.col("p") < 1e-2, F.col("variant_id"))).alias("n_nominal"),
        F.count_distinct(F.when(F.col("adj") < 0.05, F.col("variant_id"))).alias("n_adjusted"))


MERGED = """
qtl AS (SELECT variant_id, chrom, event_id, beta, se, p FROM gwas WHERE study = 'click'),
merged AS (
  SELECT g.study, g.chrom, s.trait_type, g.beta AS beta_gwas, g.se AS se_gwas, (s.n_case + s.n_control) AS n_gwas,
         m.maf, q.beta AS beta_sqtl, q.se AS se_sqtl, q.p AS p_sqtl, (SELECT count(*) FROM events WHERE event_type = 'click') AS n_sqtl, g.event_id AS g_event, q.event_id AS q_event
  FROM qtl q JOIN maf m USING (variant_id) JOIN gwas g USING (variant_id) JOIN studies s ON s.study = g.study)"""


def merged_loci(spark, sf):
    rows = t.gwas(spark, sf)
    q = rows.filter("study = 'click'").select("variant_id", "beta", "se", "p", F.col("event_id").alias("q_event"))
    g = rows.select("variant_id", "study", "chrom", "beta", "se", "p", F.col("event_id").alias("g_event"))
    return gwas.merge_gwas(q, t.maf(spark, sf), g).join(t.studies(spark, sf), "study").withColumn(
        "n_gwas", F.col("n_case") + F.col("n_control")).withColumn("n_sqtl", F.lit(t.load(spark, sf, "events").filter("event_type = 'click'").count()))


ZBACK = norm_ppf_sql("half")


@query("coloc_abf", f"""WITH {o.GWAS}, {MERGED},
sdy AS (
  SELECT study, chrom, count(*) AS nsnps, sqrt(sum(2e0 * n_gwas * maf * (1 - maf) / (se_gwas * se_gwas)) / sum(1 / (se_gwas * se_gwas) / (se_gwas * se_gwas))) AS sdy
  FROM merged GROUP BY ALL HAVING count(*) > 10),
pre AS (
  SELECT m.*, d.nsnps, CASE WHEN trait_type = 'cc' THEN 0.2e0 ELSE 0.15e0 * sdy END AS prior1, se_gwas * se_gwas AS v1,
         1 / (2e0 * n_sqtl * maf * (1 - maf)) AS v2, (CASE WHEN p_sqtl = 0 THEN 1e-100 ELSE p_sqtl END) * 0.5e0 AS half
  FROM merged m JOIN sdy d USING (study, chrom)),
pre2 AS (SELECT *, prior1 * prior1 / (prior1 * prior1 + v1) AS s1, 0.0225e0 / (0.0225e0 + v2) AS s2, {ZBACK} AS z2 FROM pre),
lab AS (SELECT study, chrom, nsnps, 0.5e0 * (ln(1 - s1) + s1 * (beta_gwas / se_gwas) * (beta_gwas / se_gwas)) AS l1,
               0.5e0 * (ln(1 - s2) + s2 * z2 * z2) AS l2 FROM pre2),
peak AS (SELECT study, chrom, max(l1) AS m1, max(l2) AS m2, max(l1 + l2) AS m12 FROM lab GROUP BY ALL),
sums AS (
  SELECT study, chrom, nsnps, m1 + ln(sum(exp(l1 - m1))) AS a, m2 + ln(sum(exp(l2 - m2))) AS b, m12 + ln(sum(exp(l1 + l2 - m12))) AS ab
  FROM lab JOIN peak USING (study, chrom) GROUP BY study, chrom, nsnps, m1, m2, m12),
hyp AS (
  SELECT *, 0e0 AS h0, ln(1e-4) + a AS h1, ln(1e-4) + b AS h2,
    CASE WHEN 1 - exp(ab - (a + b)) > 0 THEN a + b + ln(1 - exp(ab - (a + b))) + ln(1e-4) + ln(1e-4) END AS h3, ln(1e-5) + ab AS h4 FROM sums),
w AS (
  SELECT *, exp(h0 - top) AS w0, exp(h1 - top) AS w1, exp(h2 - top) AS w2, coalesce(exp(h3 - top), 0) AS w3, exp(h4 - top) AS w4
  FROM (SELECT *, greatest(h0, h1, h2, h3, h4) AS top FROM hyp))
SELECT study, chrom, nsnps, round(w0 / (w0 + w1 + w2 + w3 + w4), 6) AS pp_h0, round(w1 / (w0 + w1 + w2 + w3 + w4), 6) AS pp_h1,
  round(w2 / (w0 + w1 + w2 + w3 + w4), 6) AS pp_h2, round(w3 / (w0 + w1 + w2 + w3 + w4), 6) AS pp_h3,
  round(w4 / (w0 + w1 + w2 + w3 + w4), 6) AS pp_h4 FROM w""")
def coloc_abf(spark, sf):
    out = gwas.coloc_abf(merged_loci(spark, sf), ["study", "chrom"])
    return out.select("study", "chrom", "nsnps", *[r6(f"pp_h{i}", f"pp_h{i}") for i in range(5)])


@query("smr_stat", f"""WITH {o.GWAS}, {MERGED},
zz AS (SELECT *, beta_gwas / se_gwas AS zg, beta_sqtl / se_sqtl AS ze FROM merged)
SELECT study, g_event, q_event, round(beta_gwas / nullif(beta_sqtl, 0), 9) AS b_smr,
  round(zg * zg * ze * ze / nullif(zg * zg + ze * ze, 0), 9) AS t_smr FROM zz""")
def smr_stat(spark, sf):
    return gwas.smr_statistic(merged_loci(spark, sf)).select(
        "study", "g_event", "q_event", F.round("b_smr", 9).alias("b_smr"), F.round("t_smr", 9).alias("t_smr"))


@query("smr_inputs", f"""WITH {o.GWAS},
vcf AS (SELECT 'chr' || (p_partkey % 5 + 1) || ':' || (p_partkey * 2000) AS variant_id, 'rs' || p_partkey AS snp,
          CAST(p_partkey % 5 + 1 AS VARCHAR) AS chr, p_partkey * 2000 AS bp, round(1 - p_size / 100e0, 6) AS freq FROM part),
rows0 AS (
  SELECT q.study || '-' || q.chrom AS cell, q.chrom || ':+:' || 5000000 AS site, g.study, v.snp, v.chr, v.bp, v.freq,
         q.beta, q.se, q.p, g.beta AS b_g, g.se AS se_g, g.p AS p_g
  FROM gwas q JOIN gwas g USING (variant_id) JOIN vcf v USING (variant_id) JOIN studies s ON s.study = g.study WHERE q.study = 'signup'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY cell, site, study, snp ORDER BY bp, p_g, p) AS rk FROM rows0)
SELECT cell, site, study, snp AS "SNP", chr AS "Chr", bp AS "BP", freq AS "Freq", round(beta, 6) AS b, round(se, 6) AS se,
       round(p, 9) AS p, round(b_g, 6) AS b_gwas FROM ranked WHERE rk = 1""")
def smr_inputs(spark, sf):
    rows = t.gwas(spark, sf)
    assoc = rows.filter("study = 'signup'").select(
        F.expr("concat(study, '-', chrom)").alias("cell"), F.expr("concat(chrom, ':+:', 5000000)").alias("site"),
        "variant_id", "beta", "se", "p")
    vcf = t.load(spark, sf, "part").select(
        F.expr("concat('chr', p_partkey % 5 + 1)").alias("chrom"), F.expr("p_partkey * 2000").alias("pos"),
        F.expr("concat('rs', p_partkey)").alias("id"), F.lit("A").alias("ref"), F.lit("G").alias("alt"),
        F.expr("concat('AC=1;AF=', p_size / 100D, ';AN=9')").alias("info"))
    sizes = t.studies(spark, sf).select("study", (F.col("n_case") + F.col("n_control")).alias("n"))
    g, q = gwas.smr_inputs(assoc, rows.select("study", "variant_id", "beta", "se", "p"), vcf, sizes)
    key = ["cell", "site", "study", "SNP"]
    return q.join(g.select(*key, F.col("b").alias("b_g")), key).select(
        *key, "Chr", "BP", r6("Freq", "Freq"), r6("b", "b"), r6("se", "se"), F.round("p", 9).alias("p"), r6("b_g", "b_gwas"))


@query("clump_leads", f"""WITH RECURSIVE {o.GWAS},
once AS (SELECT study, chrom, snp_pos AS pos, min(p) AS p, variant_id FROM gwas WHERE p < 1e-3 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY study, chrom ORDER BY p, pos) AS rk FROM once),
walk AS (
  SELECT study, chrom, rk, [pos] AS leads, TRUE AS lead FROM ranked WHERE rk = 1
  UNION ALL
  SELECT w.study, w.chrom, r.rk, CASE WHEN len(list_filter(w.leads, lambda x: abs(x - r.pos) <= 100000)) > 0 THEN w.leads ELSE list_append(w.leads, r.pos) END,
         len(list_filter(w.leads, lambda x: abs(x - r.pos) <= 100000)) = 0
  FROM walk w JOIN ranked r ON r.study = w.study AND r.chrom = w.chrom AND r.rk = w.rk + 1)
SELECT r.study, r.chrom, r.pos, round(r.p, 12) AS p, r.variant_id FROM ranked r JOIN walk w USING (study, chrom, rk) WHERE w.lead""")
def clump_leads(spark, sf):
    rows = t.gwas(spark, sf).select("study", "chrom", F.col("snp_pos").alias("pos"), "p", "variant_id")
    return gwas.clump_leads(rows, p_max=1e-3, width=100_000).select("study", "chrom", "pos", F.round("p", 12).alias("p"), "variant_id")


@query("donor_dosage_lookup", f"""WITH {o.BARCODES}, {o.GENOTYPES}, {o.GWAS},
listed AS (SELECT DISTINCT k FROM gwas WHERE p < 1e-4)
SELECT s.metacell, g.snp, g.dosage FROM samples s JOIN geno g USING (donor_idx) WHERE g.k IN (SELECT k FROM listed)""")
def donor_dosage_lookup(spark, sf):
    """Every metacell with its donor's dosage at the variants on the lead list; others are pruned before they are unfolded."""
    listed = t.gwas(spark, sf).filter("p < 1e-4").select("k").distinct()
    wanted = t.genotypes(spark, sf).join(listed, "k", "left_semi").select("snp", F.posexplode("dosage").alias("donor_idx", "dosage"))
    return wanted.join(t.samples(spark, sf).select("metacell", "donor_idx"), "donor_idx").select(
        "metacell", "snp", F.col("dosage").cast("int").alias("dosage"))


@query("smr_probe", f"""WITH {o.GWAS}, {MERGED},
best AS (SELECT *, row_number() OVER (PARTITION BY study, chrom ORDER BY p_sqtl, q_event, g_event) AS rk FROM merged WHERE p_sqtl <= 1e-3),
zz AS (SELECT *, beta_gwas / se_gwas AS zg, beta_sqtl / se_sqtl AS ze FROM best WHERE rk = 1),
s AS (SELECT study, chrom, beta_gwas / nullif(beta_sqtl, 0) AS b, zg * zg * ze * ze / nullif(zg * zg + ze * ze, 0) AS t FROM zz)
SELECT study, chrom, round(b, 9) AS b_smr, round(abs(b) / nullif(sqrt(t), 0), 9) AS se_smr,
  round(1 - (sqrt(t) / 400 / 3) * 2 / sqrt(2 * pi()) * (SELECT sum(CASE WHEN i = 0 OR i = 400 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END
    * exp(-power(i * sqrt(t) / 400, 2) / 2)) FROM generate_series(0, 400) g(i)), 6) AS p_smr FROM s""")
def smr_probe(spark, sf):
    """SMR on each probe's best QTL variant; the check sums the tail from the density."""
    out = gwas.smr_per_probe(merged_loci(spark, sf), ["study", "chrom"], 1e-3, ["q_event", "g_event"])
    return out.select("study", "chrom", F.round("b_smr", 9).alias("b_smr"), F.round("se_smr", 9).alias("se_smr"), r6("p_smr", "p_smr"))


@query("heidi", f"""WITH {o.GWAS}, {MERGED}, {o.GENOTYPES},
mg AS (SELECT g.study, g.chrom, q.variant_id, g.beta AS beta_gwas, g.se AS se_gwas, q.beta AS beta_sqtl, q.se AS se_sqtl, q.p AS p_sqtl,
         g.event_id AS g_event, q.event_id AS q_event FROM qtl q JOIN maf m USING (variant_id) JOIN gwas g USING (variant_id) JOIN studies s ON s.study = g.study),
one AS (SELECT *, row_number() OVER (PARTITION BY study, chrom, variant_id ORDER BY p_sqtl, q_event, g_event) AS rk
        FROM mg WHERE p_sqtl <= 0.05 AND beta_sqtl <> 0),
v AS (SELECT study, chrom, variant_id, p_sqtl, beta_gwas / beta_sqtl AS b, beta_sqtl / se_sqtl AS z, se_gwas / beta_sqtl AS e FROM one WHERE rk = 1
      AND variant_id || ':A:G' IN (SELECT snp FROM variants)),
t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY study, chrom ORDER BY p_sqtl, variant_id) AS rk FROM v) WHERE rk = 1),
near AS (SELECT t.study, t.chrom, t.variant_id AS top, v.variant_id, corr(x.dosage, y.dosage) AS r
         FROM v JOIN t ON t.study = v.study AND t.chrom = v.chrom AND t.variant_id <> v.variant_id
         JOIN geno x ON x.snp = v.variant_id || ':A:G' JOIN geno y ON y.snp = t.variant_id || ':A:G' AND y.donor_idx = x.donor_idx GROUP BY ALL),
picked AS (SELECT n.*, row_number() OVER (PARTITION BY n.study, n.chrom ORDER BY v.p_sqtl, v.variant_id) AS rk
         FROM near n JOIN v USING (study, chrom, variant_id) WHERE r * r BETWEEN 0.01 AND 0.9),
d AS (SELECT study, chrom, top, v.b - t.b AS gap,
        v.e * v.e + v.b * v.b * (1 / v.z ** 2 - 1 / v.z ** 4) + t.e * t.e + t.b * t.b * (1 / t.z ** 2 - 1 / t.z ** 4)
        - 2 * (r * v.e * t.e + v.b * t.b * (r / (v.z * t.z) - 1 / (v.z ** 2 * t.z ** 2))) AS var
      FROM picked JOIN v USING (study, chrom, variant_id) JOIN t USING (study, chrom) WHERE picked.rk <= 20)
SELECT study, chrom, upper(top) AS top, count(*) AS n_variants, round(sum(gap * gap / var), 6) AS t_heidi, TRUE AS p_ok FROM d WHERE var > 1e-18 GROUP BY ALL""")
def heidi_statistic(spark, sf):
    """Heterogeneity of each probe's variants against its best one; p, which SQL can't tell, is in ``heidi_test``."""
    out = heidi_rows(spark, sf)
    return out.select("study", "chrom", "top", "n_variants", r6("t_heidi", "t_heidi"), F.col("p_heidi").between(0, 1).alias("p_ok"))


def heidi_rows(spark, sf):
    geno = t.genotypes(spark, sf).select(F.upper(F.regexp_replace("snp", ":A:G$", "")).alias("variant_id"), "dosage")
    return heidi.heidi(merged_loci(spark, sf), geno, ["study", "chrom"], 0.05, 0.01, 0.9, 20, ["q_event", "g_event"])


@query("heidi_test")
def heidi_test(spark, sf):
    return heidi_rows(spark, sf)


# ------------------------------------------------------------------ cells

@query("metacell_mean_pc", f"""WITH {o.CELLS}
SELECT donor AS metacell, {', '.join(f'round(avg(x) FILTER (dim = {i}), 6) AS pc{i}' for i in range(1, 9))} FROM coords GROUP BY ALL""")
def metacell_mean_pc(spark, sf):
    cells = t.cells(spark, sf)
    means = correlation.mean_scores(cells.select("cell_id", "pc"), cells.select("cell_id", F.col("donor").alias("metacell")))
    return means.select("metacell", *[r6(f"pc{i}", f"pc{i}") for i in range(1, 9)])


def expression(spark, sf):
    return t.cells(spark, sf).select("cell_id", F.posexplode(F.expr("slice(pc, 9, 56)")).alias("g", "value")).select(
        "cell_id", F.expr("concat('gene', g + 9)").alias("gene"), "value")


CORR = f"""{o.CELLS},
pcs AS (SELECT cell_id, dim AS pc, x AS y FROM coords WHERE dim <= 8),
expr AS (SELECT cell_id, 'gene' || dim AS gene, x FROM coords WHERE dim > 8),
cors AS (SELECT gene, pc, corr(x, y) AS c FROM expr JOIN pcs USING (cell_id) GROUP BY ALL)"""


@query("gene_pc_correlation", f"WITH {CORR} SELECT gene, CAST(pc AS INTEGER) AS pc, round(c, 6) AS corr FROM cors")
def gene_pc_correlation(spark, sf):
    out = correlation.gene_pc_correlation(expression(spark, sf), t.cells(spark, sf).select("cell_id", "pc"))
    return out.select("gene", "pc", r6("corr", "corr"))


@query("topk_abs_corr", f"""WITH {CORR} SELECT CAST(pc AS INTEGER) AS pc, gene, round(c, 6) AS corr, CAST(rk AS INTEGER) AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY pc ORDER BY abs(c) DESC, gene) AS rk FROM cors) WHERE rk <= 5""")
def topk_abs_corr(spark, sf):
    out = correlation.gene_pc_correlation(expression(spark, sf), t.cells(spark, sf).select("cell_id", "pc"))
    return correlation.top_by_abs(out, ["pc"], "corr", 5, ["gene"]).select("pc", "gene", r6("corr", "corr"), "rank")


@query("std_slope", f"""WITH {o.CELLS},
pair AS (SELECT cell_id, donor, max(x) FILTER (dim = 1) AS a, max(x) FILTER (dim = 2) AS b FROM coords GROUP BY ALL)
SELECT donor, round(corr(a, b), 6) AS slope FROM pair GROUP BY ALL""")
def std_slope(spark, sf):
    return t.cells(spark, sf).groupBy("donor").agg(
        r6(correlation.standardised_slope(F.col("pc")[0], F.col("pc")[1]), "slope"))


@query("nearest_centroid", f"""WITH {o.CELLS},
cent AS (SELECT donor AS centroid, dim, avg(x) AS m FROM coords GROUP BY ALL),
d AS (SELECT c.cell_id, k.centroid, sqrt(sum((c.x - k.m) * (c.x - k.m))) AS dist FROM coords c JOIN cent k USING (dim) GROUP BY ALL)
SELECT cell_id, centroid, round(dist, 6) AS dist FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, centroid) AS rk FROM d) WHERE rk = 1""")
def nearest_centroid(spark, sf):
    cells = t.cells(spark, sf)
    centroids = metacells.centroids(cells.withColumn("centroid", F.col("donor")).drop("donor"), ["centroid"])
    out = metacells.nearest_anywhere(cells, centroids.withColumnRenamed("centroid", "ref_id"), spread=8)
    return out.select("cell_id", F.col("ref_id").alias("centroid"), r6("dist", "dist"))


@query("knn_graph", f"""WITH {o.CELLS},
d AS (SELECT a.donor, a.cell_id, b.cell_id AS neighbour, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist
      FROM coords a JOIN coords b ON a.donor = b.donor AND a.dim = b.dim AND a.cell_id <> b.cell_id GROUP BY ALL)
SELECT donor, cell_id, neighbour, round(dist, 6) AS dist, CAST(rk AS INTEGER) AS "rank" FROM (
  SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY dist, neighbour) AS rk FROM d) WHERE rk <= 4""")
def knn_graph(spark, sf):
    out = metacells.knn(t.cells(spark, sf), 5)
    return out.select("donor", "cell_id", "neighbour", r6("dist", "dist"), "rank")


@query("ch_index", f"""WITH {o.CELLS},
lab AS (SELECT *, CASE WHEN cell_id % 3 = 0 THEN 'a' ELSE 'b' END AS meta FROM coords),
grand AS (SELECT donor, dim, avg(x) AS gm FROM lab GROUP BY ALL),
cent AS (SELECT donor, meta, dim, avg(x) AS m, count(*) AS n FROM lab GROUP BY ALL),
b AS (SELECT donor, sum(n * (m - gm) * (m - gm)) AS between_ss FROM cent JOIN grand USING (donor, dim) GROUP BY ALL),
w AS (SELECT donor, sum((x - m) * (x - m)) AS within_ss FROM lab JOIN cent USING (donor, meta, dim) GROUP BY ALL),
k AS (SELECT donor, count(DISTINCT cell_id) AS n, count(DISTINCT meta) AS k FROM lab GROUP BY ALL)
SELECT donor, round((between_ss / (k - 1)) / (within_ss / (n - k)), 6) AS ch FROM b JOIN w USING (donor) JOIN k USING (donor)""")
def ch_index(spark, sf):
    cells = t.cells(spark, sf).withColumn("meta", F.when(F.col("cell_id") % 3 == 0, "a").otherwise("b"))
    return metacells.calinski_harabasz(cells).select("donor", r6("ch", "ch"))


@query("silhouette", f"""WITH {o.CELLS},
lab AS (SELECT *, CASE WHEN cell_id % 3 = 0 THEN 'a' ELSE 'b' END AS meta FROM coords),
d AS (SELECT a.donor, a.cell_id, a.meta, b.cell_id AS other, b.meta AS other_meta, sqrt(sum((a.x - b.x) * (a.x - b.x))) AS dist
      FROM lab a JOIN lab b ON a.donor = b.donor AND a.dim = b.dim AND a.cell_id <> b.cell_id GROUP BY ALL),
m AS (SELECT donor, cell_id, meta, other_meta, avg(dist) AS md FROM d GROUP BY ALL),
s AS (SELECT donor, cell_id, max(md) FILTER (meta = other_meta) AS a, min(md) FILTER (meta <> other_meta) AS b FROM m GROUP BY ALL)
SELECT donor, round(avg(coalesce((b - a) / greatest(a, b), 0)), 6) AS silhouette FROM s GROUP BY ALL""")
def silhouette(spark, sf):
    cells = t.cells(spark, sf).withColumn("meta", F.when(F.col("cell_id") % 3 == 0, "a").otherwise("b"))
    return metacells.silhouette(cells).select("donor", r6("silhouette", "silhouette"))


# ------------------------------------------------------------------ strata

@query("tertile_strata", """WITH cuts AS (
  SELECT quantile_disc(c_acctbal, 1/3) AS lower, quantile_disc(c_acctbal, 2/3) AS upper FROM customer)
SELECT c_custkey, CASE WHEN c_acctbal < lower THEN 'low' WHEN c_acctbal <= upper THEN 'mid' ELSE 'high' END AS stratum
FROM customer, cuts""")
def tertile_strata(spark, sf):
    cust = t.load(spark, sf, "customer").select("c_custkey", "c_acctbal")
    return strata.with_tertile(cust, "c_acctbal").select("c_custkey", "stratum")


@query("tertile_cuts_by_group", """SELECT c_mktsegment, quantile_disc(c_acctbal, 1/3) AS lower, quantile_disc(c_acctbal, 2/3) AS upper
FROM customer GROUP BY ALL""")
def tertile_cuts_by_group(spark, sf):
    return strata.tertile_cuts(t.load(spark, sf, "customer"), "c_acctbal", ["c_mktsegment"])


@query("balanced_downsample", """WITH k AS (
  SELECT o_orderkey, o_orderstatus, o_custkey % 2 AS ctx, (o_orderkey * 2654435761) % 4294967296 AS key FROM orders),
n AS (SELECT ctx, o_orderstatus, count(*) AS c FROM k GROUP BY ALL),
quota AS (SELECT ctx, min(c) AS quota FROM n GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY ctx, o_orderstatus ORDER BY key, o_orderkey) AS rk FROM k)
SELECT o_orderkey, o_orderstatus, ctx FROM r JOIN quota USING (ctx) WHERE rk <= quota""")
def balanced_downsample(spark, sf):
    rows = t.load(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.expr("o_custkey % 2").alias("ctx"))
    key = F.expr(t.hash32("o_orderkey"))
    return strata.balanced_sample(rows, "o_orderstatus", ["ctx"], ["o_orderkey"], order_key=key)


# ------------------------------------------------------------------ association

def site_frame(spark, sf):
    """Phenotype of all retained sites, stored: models and tests read it several times."""
    samples = t.samples(spark, sf)
    named = introns.with_site_name(filled_phenotype(spark, sf))
    return cut_lineage(named.join(samples.select("metacell", "donor", "donor_idx"), "metacell"))


def screening_null(spark, sf, pheno=None):
    """Null models are fitted once and stored; every test reads the stored table."""
    pheno = site_frame(spark, sf) if pheno is None else pheno
    return cut_lineage(null_model.fit_intercept_only(pheno, t.n_donors(spark, sf)))


SCORE = """
pheno AS (SELECT chrom || ':' || strand || ':' || pos AS site, chrom, strand, pos, donor_idx, sample_idx, metacell, included, total FROM filled),
rate AS (SELECT site, sum(included)::DOUBLE / sum(total) AS rate FROM pheno GROUP BY ALL),
null0 AS (
  SELECT p.site, p.chrom, p.pos, p.donor_idx, sum(included - total * rate) AS r, sum(total * rate * (1 - rate)) AS w
  FROM pheno p JOIN rate USING (site) WHERE rate > 0 AND rate < 1 GROUP BY ALL)"""
SUMS = """
SELECT {keys}, round(s / sqrt(v), 6) AS z, round(s / v, 6) AS beta, round(1 / sqrt(v), 6) AS se FROM (
  SELECT {keys}, sum(g * r) - sum(g * w) / sum(w) * sum(r) AS s, sum(w * g * g) - sum(g * w) * sum(g * w) / sum(w) AS v,
         sum(w * g * g) AS plain
  FROM tested GROUP BY {keys}) WHERE v > 1e-9 * greatest(plain, 1)"""


@query("cis_association", f"""WITH {o.SPREAD}, {SCORE}, {o.GENOTYPES},
tested AS (SELECT n.site, x.snp, x.dosage AS g, n.r, n.w FROM null0 n JOIN geno x ON x.chrom = n.chrom
  AND abs(x.snp_pos - n.pos) <= 500000 AND x.donor_idx = n.donor_idx) {SUMS.format(keys='site, snp')}""")
def cis_association(spark, sf):
    null = screening_null(spark, sf)
    out = association.cis_qtl(null, t.genotypes(spark, sf), 500_000)
    return out.select("site", "snp", r6("z", "z"), r6("beta", "beta"), r6("se", "se"))


@query("trans_association", f"""WITH {o.SPREAD}, {SCORE}, {o.GENOTYPES}, {o.GWAS},
listed AS (SELECT DISTINCT k FROM gwas WHERE p < 1e-4),
tested AS (SELECT n.site, x.snp, x.dosage AS g, n.r, n.w FROM null0 n JOIN geno x USING (donor_idx) WHERE x.k IN (SELECT k FROM listed))
{SUMS.format(keys='site, snp')}""")
def trans_association(spark, sf):
    null = screening_null(spark, sf)
    listed = t.gwas(spark, sf).filter("p < 1e-4").select("k").distinct()
    wanted = t.variants(spark, sf).join(listed, "k", "left_semi").select("snp")
    out = association.trans_qtl(null, t.genotypes(spark, sf), wanted)
    return out.select("site", "snp", r6("z", "z"), r6("beta", "beta"), r6("se", "se"))


@query("diff_splicing_z", f"""WITH {o.SPREAD}, {SCORE},
tested AS (SELECT site, CASE WHEN donor_idx % 2 = 0 THEN 0 ELSE 2 END AS g, included - total * rate AS r, total * rate * (1 - rate) AS w
           FROM pheno JOIN rate USING (site) WHERE rate > 0 AND rate < 1) {SUMS.format(keys='site')}""")
def diff_splicing_z(spark, sf):
    pheno = site_frame(spark, sf)
    rate = pheno.groupBy("site").agg((F.sum("included") / F.sum("total")).alias("rate")).filter("rate > 0 AND rate < 1")
    per = pheno.join(rate, "site").groupBy("site").agg(F.collect_list(F.struct(
        F.col("sample_idx"), F.col("rate").alias("pi"), F.col("total"), F.col("included").alias("y"))).alias("a"))
    models = per.select("site", F.lit(1.0).alias("sqrt_r"), F.col("a.sample_idx").alias("sample_idx"), F.col("a.pi").alias("pi"),
                        F.col("a.total").alias("total"), F.col("a.y").alias("y"))
    samples = t.samples(spark, sf)
    groups = samples.select("sample_idx", F.expr("CASE WHEN donor_idx % 2 = 0 THEN 0 ELSE 2 END").alias("label"))
    out = association.diff_splicing(models, groups, null_model.design_table(samples))
    return out.select("site", r6("z", "z"), r6("beta", "beta"), r6("se", "se"))


# ------------------------------------------------------------------ models without a SQL form

def metacell_covariates(spark, sf):
    """Sample table with covariates: sex, disease, age and cell state of each metacell."""
    cust = t.load(spark, sf, "customer").select(
        F.expr("concat('D', c_nationkey, ':', c_custkey % 2 + 1)").alias("metacell"), "c_acctbal",
        F.length("c_mktsegment").alias("len"))
    per = cust.groupBy("metacell").agg(F.avg(F.col("c_acctbal") / 1000).alias("state"), F.avg("len").alias("age"),
                                       F.log(F.count(F.lit(1)).cast("double")).alias("num_cells"))
    return t.samples(spark, sf).join(per, "metacell").withColumn(
        "sex", F.expr("donor_idx % 2 + 1")).withColumn("AD", F.expr("donor_idx div 2 % 2"))


def grm_table(spark, sf):
    return cut_lineage(relatedness.relatedness(t.genotypes(spark, sf), t.n_donors(spark, sf)))


def fitted_null(spark, sf, pheno=None, **options):
    pheno = site_frame(spark, sf) if pheno is None else pheno
    samples = cut_lineage(metacell_covariates(spark, sf))
    x = samples.select("metacell", F.array("state", "age", "num_cells").alias("x"))
    design = cut_lineage(null_model.design_table(samples, x, grm_table(spark, sf), grm_min=0.05, **options.pop("design", {})))
    return cut_lineage(null_model.fit_null(pheno, design, t.n_donors(spark, sf), **options))


@query("grm", f"""WITH {o.GENOTYPES},
f AS (SELECT snp, avg(dosage) / 2 AS f FROM geno GROUP BY ALL HAVING avg(dosage) > 0 AND avg(dosage) < 2),
s AS (SELECT snp, donor_idx, (dosage - 2 * f) / sqrt(2 * f * (1 - f)) AS g FROM geno JOIN f USING (snp))
SELECT a.donor_idx AS i, b.donor_idx AS j, round(avg(a.g * b.g), 6) AS k FROM s a JOIN s b USING (snp) GROUP BY ALL""")
def grm(spark, sf):
    return relatedness.relatedness(t.genotypes(spark, sf), t.n_donors(spark, sf)).select("i", "j", r6("k", "k"))


SITES = f"""WITH {o.SPREAD},
ph AS (SELECT chrom || ':' || strand || ':' || pos AS site, chrom, pos, included, total, donor_idx, sample_idx FROM filled)"""


def design_columns(spark, sf):
    samples = metacell_covariates(spark, sf)
    return samples, samples.select("metacell", F.array("state", "age", "num_cells").alias("x"))


@query("check_null_glmm", f"""{SITES}
SELECT site, count(*) FILTER (total > 0) AS n_samples, CAST(sum(included) FILTER (total > 0) AS BIGINT) AS included,
       CAST(sum(total) FILTER (total > 0) AS BIGINT) AS total, TRUE AS residuals_ok, TRUE AS score_ok, TRUE AS status_ok
FROM ph GROUP BY site HAVING count(*) FILTER (total > 0) > 0""")
def check_null_glmm(spark, sf):
    """Fitted models by what a fit must satisfy: residuals y - n pi, score equations X'(y - n pi) = 0, a status and a positive ratio."""
    models = fitted_null(spark, sf)
    samples, x = design_columns(spark, sf)
    rows = models.select("site", F.inline(F.arrays_zip("sample_idx", "residuals", "pi", "total", "y"))).join(
        samples.join(x, "metacell").select("sample_idx", "x"), "sample_idx")
    gap = F.abs(F.col("residuals") - (F.col("y") - F.col("total") * F.col("pi")))
    score = [F.sum(F.col("residuals") * c) for c in (F.lit(1.0), *[F.col("x")[i] for i in range(3)])]
    scale = [F.sum(F.col("total") * F.abs(c)) for c in (F.lit(1.0), *[F.col("x")[i] for i in range(3)])]
    per = rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_samples"), F.sum("y").cast("bigint").alias("included"), F.sum("total").cast("bigint").alias("total"),
        (F.max(gap) < 1e-9).alias("residuals_ok"), F.forall(F.array(*[F.abs(u) / v for u, v in zip(score, scale)]), lambda r: r < 5e-3).alias("score_ok"))
    status = models.select("site", (F.col("status").isin("Converged", "Fixed", "Unsettled") & (F.col("sqrt_r") > 0)).alias("status_ok"))
    return per.join(status, "site").select("site", "n_samples", "included", "total", "residuals_ok", "score_ok", "status_ok")


@query("null_glmm")
def null_glmm(spark, sf):
    """Fitted models: status, ratio, variance, and residuals, rates and counts of each sample."""
    return fitted_null(spark, sf).select("site", "chrom", "strand", "pos", "status", "sqrt_r", "tau_g", "sample_idx", "residuals", "pi", "total", "y")


@query("score_test_p")
def score_test_p(spark, sf):
    return association.cis_qtl(fitted_null(spark, sf), t.genotypes(spark, sf), 500_000, p_max=0.05)


@query("diff_splicing")
def diff_splicing(spark, sf):
    return group_differences(spark, sf)


@query("splicing_pcs")
def splicing_pcs(spark, sf):
    return splicing_pc.splicing_pcs(site_frame(spark, sf).select("site", "sample_idx", "ratio"), n_pcs=4)


@query("louvain_metacells")
def louvain_metacells(spark, sf):
    return metacells.call_metacells(t.cells(spark, sf), 10)


@query("metacell_quality")
def metacell_quality(spark, sf):
    cells = t.cells(spark, sf)
    return metacells.metacell_quality(cells, cut_lineage(metacells.call_metacells(cells, 10)))


@query("community_modularity")
def community_modularity(spark, sf):
    return cell_communities(spark, sf)


def p_matches(z):
    """The stored p against a tail that is summed from the density."""
    steps = 400

    @F.pandas_udf("double")
    def inside(z: pd.Series) -> pd.Series:
        weight = np.where(np.arange(steps + 1) % 2 == 1, 4.0, 2.0)
        weight[[0, -1]] = 1.0
        half, out = np.abs(z.to_numpy(float)) / steps, np.empty(len(z))
        for lo in range(0, len(z), 1024):
            at = half[lo:lo + 1024, None] * np.arange(steps + 1)
            out[lo:lo + 1024] = np.exp(-at * at / 2) @ weight
        return pd.Series(out * half / 3 * (2 / math.sqrt(2 * math.pi)))

    return F.abs(F.col("p") - (F.lit(1.0) - inside(z))) < 1e-6


@query("check_score_test_p", f"""{SITES}, {o.GENOTYPES}, where_at AS (SELECT DISTINCT site, chrom, pos FROM ph)
SELECT w.site, x.snp, TRUE AS p_ok FROM where_at w JOIN geno x ON x.chrom = w.chrom AND abs(x.snp_pos - w.pos) <= 500000
GROUP BY w.site, x.snp HAVING count(DISTINCT x.dosage) > 1""")
def check_score_test_p(spark, sf):
    out = association.cis_qtl(fitted_null(spark, sf), t.genotypes(spark, sf), 500_000, p_max=1.0)
    return out.select("site", "snp", p_matches(F.col("beta") / F.col("se")).alias("p_ok"))


@query("null_glmm_sample_mode")
def null_glmm_sample_mode(spark, sf):
    """Variance ratio from real markers: every variant of the GWAS table is a marker. Sites stay only with a converged positive variance."""
    listed = cut_lineage(t.gwas(spark, sf).select("k").distinct())
    parts = max(1, -(-listed.count() // MARKER_ROWS))
    long = t.genotypes(spark, sf).join(listed, "k", "left_semi").select(
        F.pmod(F.xxhash64("k"), F.lit(parts)).alias("part"), "k", F.posexplode("dosage").alias("donor_idx", "dosage"))
    markers = long.groupBy("part", "donor_idx").agg(F.array_sort(F.collect_list(F.struct("k", "dosage"))).alias("m")).select(
        "part", "donor_idx", F.col("m.dosage").alias("dosage"))
    models = fitted_null(spark, sf, mode="sample", design={"markers": markers}).select("site", "status", "sqrt_r", "tau_g")
    return models


@query("check_null_glmm_sample_mode", f"""{SITES}
SELECT site, TRUE AS ok FROM ph GROUP BY site""")
def check_null_glmm_sample_mode(spark, sf):
    """Sites stay exactly if the fit, made without markers, converged with a positive variance; their ratio is positive."""
    models = null_glmm_sample_mode(spark, sf)
    plain = fitted_null(spark, sf, n_perm=8).select(
        "site", ((F.col("status") == "Converged") & (F.col("tau_g") > null_model.TAU_FLOOR)).alias("stays"))
    good = (F.col("status") == "Converged") & (F.col("tau_g") > null_model.TAU_FLOOR) & (F.col("sqrt_r") > 0)
    both = plain.join(models, "site", "full")
    return both.select("site", F.coalesce(F.coalesce(good, F.lit(False)) == F.col("stays"), F.lit(False)).alias("ok"))


@query("check_diff_splicing", f"""{SITES}
SELECT site, TRUE AS p_ok FROM ph GROUP BY site""")
def check_diff_splicing(spark, sf):
    return group_differences(spark, sf).select("site", p_matches(F.col("z")).alias("p_ok"))


def group_differences(spark, sf):
    samples, x = design_columns(spark, sf)
    groups = samples.select("sample_idx", F.expr("CASE WHEN AD = 1 THEN 2 ELSE 0 END").alias("label"))
    return association.diff_splicing(fitted_null(spark, sf), groups, null_model.design_table(samples, x))


def lead_pairs(spark, sf, pheno):
    """Best cis variant of every retained site."""
    cis = association.cis_qtl(screening_null(spark, sf, pheno), t.genotypes(spark, sf), 500_000)
    return cut_lineage(gwas.best_hit(cis.select("site", "snp", "p"), ["site"], "p", ["snp"]).select("site", "snp"))


def context_rows(spark, sf, design, names):
    """Interaction fits of the lead pairs: p of the dosage, of the interaction and in each stratum, q and slopes."""
    pheno = site_frame(spark, sf)
    models, pairs = fitted_null(spark, sf, pheno), lead_pairs(spark, sf, pheno)
    return context.context_effects(
        pheno, pairs, cut_lineage(t.genotypes(spark, sf, pairs)), cut_lineage(design), names, null_model.working_residuals(models))


def run_context(spark, sf, design, names):
    """What must hold for interaction fits: p in [0, 1], q at least p, slopes finite."""
    out = context_rows(spark, sf, design, names)
    p = F.array("p_geno", "p_interaction", *[f"p_{n}" for n in names])
    slopes = F.array(*[f"slope_{n}" for n in names])
    return out.groupBy("site").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.bool_and(F.forall(p, lambda v: v.isNull() | v.between(0, 1))).alias("p_ok"),
        F.bool_and(F.col("p_interaction").isNull() | ((F.col("q") >= F.col("p_interaction") - 1e-12) & (F.col("q") <= 1))).alias("q_ok"),
        F.bool_and(F.forall(slopes, lambda v: v.isNull() | (F.abs(v) < float("inf")))).alias("slopes_ok"))


CONTEXT = f"""{SITES}, {o.GENOTYPES}, rate AS (SELECT site FROM ph GROUP BY site HAVING sum(included) > 0 AND sum(included) < sum(total)),
cis AS (SELECT DISTINCT p.site FROM ph p JOIN variants v ON v.chrom = p.chrom AND abs(v.snp_pos - p.pos) <= 500000 WHERE p.site IN (SELECT site FROM rate))
SELECT site, 1 AS n_pairs, TRUE AS p_ok, TRUE AS q_ok, TRUE AS slopes_ok FROM cis"""


CONTEXTS = {
    "glmm_interaction": (lambda x: context.disease_design(x, ["sex", "age", "AD", "num_cells"]), ["control", "case"]),
    "glmm_sex_interaction": (lambda x: context.sex_design(x, ["sex", "age", "AD", "num_cells"]), ["male", "female"]),
    "glmm_state_interaction": (lambda x: context.state_design(x, ["sex", "age", "AD", "num_cells", "state"]), ["low", "mid", "high"]),
}


def register_contexts():
    for name, (design, strata) in CONTEXTS.items():
        query(name)(lambda spark, sf, d=design, n=strata: context_rows(spark, sf, d(metacell_covariates(spark, sf)), n))
        query(f"check_{name}", CONTEXT)(lambda spark, sf, d=design, n=strata: run_context(spark, sf, d(metacell_covariates(spark, sf)), n))


register_contexts()


LINEAR = f"""
ph AS (SELECT chrom || ':' || strand || ':' || pos AS site, chrom, pos, donor_idx, included::DOUBLE / total AS ratio FROM filled WHERE total > 0),
lev AS (SELECT *, (rank() OVER (PARTITION BY site ORDER BY round(ratio, 6)) + (count(*) OVER (PARTITION BY site, round(ratio, 6)) - 1) / 2e0 - 0.5e0)
          / count(*) OVER (PARTITION BY site) AS lv FROM ph),
val AS (SELECT site, chrom, pos, donor_idx, {norm_ppf_sql('lv')} AS y FROM lev)"""


@query("nominal_linear", f"""WITH {o.SPREAD}, {LINEAR}, {o.GENOTYPES},
c AS (SELECT v.site, x.snp, corr(x.dosage, v.y) AS r, stddev_pop(x.dosage) AS sx FROM val v JOIN geno x ON x.chrom = v.chrom
  AND abs(x.snp_pos - v.pos) <= 1000000 AND x.donor_idx = v.donor_idx GROUP BY ALL)
SELECT site, snp, round(r, 6) AS r FROM c WHERE sx > 1e-6""")
def nominal_linear(spark, sf):
    samples = t.samples(spark, sf)
    out = nominal.nominal_linear(site_frame(spark, sf), t.genotypes(spark, sf), null_model.design_table(samples), t.n_donors(spark, sf))
    return out.select("site", "snp", r6("r", "r"))


@query("truth_recovery", f"""WITH {o.SPREAD}, {o.GENOTYPES},
genes AS (SELECT DISTINCT gene, 'chr' || (gene % 5 + 1) AS chrom, gene * 100000 AS g_start, gene * 100000 + 14000 AS g_end,
            'chr' || (gene * 50 % 5 + 1) || ':' || (gene * 50 * 2000) || ':A:G' AS snp FROM reads),
ph AS (SELECT chrom || ':' || strand || ':' || pos AS site, chrom, pos, donor_idx, round(included::DOUBLE / nullif(total, 0), 6) AS ratio FROM filled),
hit AS (SELECT DISTINCT p.site, g.snp FROM ph p JOIN genes g ON g.chrom = p.chrom AND g.g_start < p.pos AND p.pos < g.g_end
        WHERE p.chrom NOT IN ('chrX', 'chrY'))
SELECT h.site, h.snp, round(corr(x.dosage, p.ratio), 6) AS r, count(*) AS n
FROM hit h JOIN ph p USING (site) JOIN geno x ON x.snp = h.snp AND x.donor_idx = p.donor_idx WHERE p.ratio IS NOT NULL GROUP BY ALL""")
def truth_recovery(spark, sf):
    usage = site_frame(spark, sf).withColumn("donor", F.col("donor_idx"))
    truth = t.reads(spark, sf).select("gene", "chrom").distinct().selectExpr(
        "concat('chr', gene * 50 % 5 + 1, ':', gene * 50 * 2000, ':A:G') AS snp", "chrom",
        "gene * 100000 AS start", "gene * 100000 + 14000 AS end")
    geno = t.genotypes(spark, sf).select("snp", "dosage")
    return correlation.ground_truth_association(usage, truth, geno).select("site", "snp", r6("r", "r"), "n")


@query("check_splicing_pcs", f"""WITH {o.SPREAD}
SELECT sample_idx, TRUE AS unit_ok, TRUE AS eigen_ok FROM (SELECT DISTINCT sample_idx FROM filled)""")
def check_splicing_pcs(spark, sf):
    """Components by what they must satisfy: unit length, and A'A v = lambda v for the centred usage matrix A."""
    usage = cut_lineage(site_frame(spark, sf).select("site", "sample_idx", "ratio"))
    pcs = cut_lineage(splicing_pc.splicing_pcs(usage, n_pcs=4))
    mean = usage.groupBy("site").agg(F.avg("ratio").alias("mean"))
    a = usage.join(mean, "site").select("site", "sample_idx", F.coalesce(F.col("ratio") - F.col("mean"), F.lit(0.0)).alias("a"))
    sums = lambda v: F.array(*[F.sum(F.col("a") * F.col(v)[i]) for i in range(4)])
    av = a.join(pcs, "sample_idx").groupBy("site").agg(sums("pc").alias("av"))
    back = a.join(av, "site").groupBy("sample_idx").agg(sums("av").alias("back")).join(pcs, "sample_idx")
    gap = F.array(*[F.abs(F.col("back")[i] - F.col("variance")[i] * F.col("pc")[i]) for i in range(4)])
    unit = pcs.agg(F.array(*[F.sum(F.col("pc")[i] * F.col("pc")[i]) for i in range(4)]).alias("norm"))
    return back.join(F.broadcast(unit)).select(  # one row of norms
        "sample_idx", F.forall("norm", lambda v: F.abs(v - 1) < 1e-9).alias("unit_ok"), F.forall(gap, lambda v: v < 1e-6).alias("eigen_ok"))


@query("check_louvain_metacells", """SELECT 'D' || label AS donor, count(*) AS n_cells, TRUE AS size_ok, TRUE AS small_ok FROM embeddings GROUP BY label""")
def check_louvain_metacells(spark, sf):
    """Metacells by their rules: at least 10 cells each, or one metacell; donors with fewer than 20 cells have one."""
    sizes = metacells.call_metacells(t.cells(spark, sf), 10).groupBy("donor", "meta").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("donor").agg(
        F.sum("n").alias("n_cells"), ((F.min("n") >= 10) | (F.count(F.lit(1)) == 1)).alias("size_ok"),
        ((F.sum("n") >= 20) | (F.count(F.lit(1)) == 1)).alias("small_ok"))


@query("check_metacell_quality", """SELECT 'D' || label AS donor, TRUE AS null_ok, TRUE AS range_ok FROM embeddings GROUP BY label""")
def check_metacell_quality(spark, sf):
    """Scores by their rules: NULL for donors of one metacell only, silhouettes in [-1, 1], variance ratios not negative."""
    cells = t.cells(spark, sf)
    labels = cut_lineage(metacells.call_metacells(cells, 10))
    several = labels.groupBy("donor").agg((F.count_distinct("meta") > 1).alias("several"))
    out = metacells.metacell_quality(cells, labels).join(several, "donor")
    return out.select(
        "donor", ((F.col("silhouette").isNotNull() == F.col("several")) & (F.col("ch").isNotNull() == F.col("several"))).alias("null_ok"),
        (F.coalesce(F.col("silhouette").between(-1, 1), F.lit(True)) & F.coalesce(F.col("ch") >= 0, F.lit(True))).alias("range_ok"))


@query("check_community_modularity", """SELECT 'D' || label AS donor, TRUE AS better FROM embeddings GROUP BY label""")
def check_community_modularity(spark, sf):
    """Communities of the cells' neighbour graphs are better than single cells."""
    return cell_communities(spark, sf).select("donor", (F.col("modularity") > 0).alias("better"))


def cell_communities(spark, sf):
    cells = t.cells(spark, sf)
    graph = cut_lineage(metacells.neighbour_graph(metacells.knn(cells, 10)))
    return metacells.modularity(graph, metacells.louvain(graph, cells.select("donor", F.col("cell_id").alias("node"))))
