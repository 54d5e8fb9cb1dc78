"""Catalogue entries for the text formats: lines are made from the given tables, parsed by the readers, and checked in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from spliceweave.operators import introns
from spliceweave.plans import oracle_tables as o
from spliceweave.plans import tables as t
from spliceweave.plans.catalog import filled_phenotype, kept_introns, query, r6, site_frame
from spliceweave.session import cut_lineage
from spliceweave.sources import text, write


def intron():
    return F.concat_ws(":", "chrom", "strand", F.col("j_start").cast("string"), F.col("j_end").cast("string"))


def line(*parts, sep: str = "\t"):
    return F.concat_ws(sep, *[F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts]).alias("value")


@query("format_junc", f"""WITH {o.READS}
SELECT chrom, strand, j_start - anchor_l AS read_start, j_end + anchor_r AS read_end, j_start, j_end, anchor_l, anchor_r,
       CAST(cb AS VARCHAR) AS cb, CAST(umi AS VARCHAR) AS umi, 1 AS n_reads FROM junc""")
def format_junc(spark, sf):
    rows = t.junctions(spark, sf)
    a = F.col("anchors")
    made = rows.select(line("chrom", F.col("j_start") - a[0], F.col("j_end") + a[1], F.lit(1), "strand", "j_start", "j_end",
                            F.array_join(a.cast("array<string>"), ","), "cb", "umi"))
    return text.read_junctions(spark, made).select(
        "chrom", "strand", "read_start", "read_end", "j_start", "j_end", F.col("anchors")[0].cast("bigint").alias("anchor_l"),
        F.col("anchors")[1].cast("bigint").alias("anchor_r"), "cb", "umi", "n_reads")


@query("format_stat", f"WITH {o.STAT} SELECT * FROM stat")
def format_stat(spark, sf):
    made = t.stat(spark, sf).select(F.concat(intron(), F.lit("\t"), F.col("n").cast("string")).alias("value"), F.col("metacell").alias("stem"))
    return text.read_stat(spark, made)


@query("format_nonsplit", f"""WITH {o.READS}
SELECT 'x' AS source, chrom, strand, CASE WHEN umi % 2 = 1 THEN j_start ELSE j_end END AS pos, CAST(cb AS VARCHAR) AS cb,
       CAST(umi AS VARCHAR) AS umi, 2 AS n FROM reads WHERE NOT is_split""")
def format_nonsplit(spark, sf):
    key = F.concat_ws(":", "chrom", F.col("pos").cast("string"), "strand", F.col("cb").cast("string"), F.col("umi").cast("string"))
    return text.read_nonsplit(spark, t.nonsplit(spark, sf).select(F.concat(key, F.lit(" 2")).alias("value"), F.lit("x").alias("stem")))


@query("format_barcodes", f"WITH {o.BARCODES} SELECT CAST(cb AS VARCHAR) AS cb, metacell FROM barcodes")
def format_barcodes(spark, sf):
    return text.read_barcodes(spark, t.barcodes(spark, sf).select(F.col("cb").cast("string").alias("value"), F.col("metacell").alias("stem")))


def sample_list(spark, sf):
    return t.samples(spark, sf).select(F.col("sample_idx").cast("int").alias("sample_idx"), F.col("metacell").alias("sample"))


@query("format_site", f"""WITH {o.SPREAD}
SELECT chrom, strand, pos, side, sample_idx, metacell AS sample, included, total FROM filled""")
def format_site(spark, sf):
    """``.filtered`` lines of one side at a time, written and read back."""
    long = cut_lineage(filled_phenotype(spark, sf))
    names = sample_list(spark, sf)
    both = None
    for side in ("start", "end"):
        made = write.site_lines(introns.with_site_name(long.filter(F.col("side") == side)))
        back = text.read_site(spark, made, names).withColumn("side", F.lit(side))
        both = back if both is None else both.unionByName(back)
    return both.select("chrom", "strand", "pos", "side", "sample_idx", "sample", "included", "total")


@query("format_prop", f"""WITH {o.SPREAD}
SELECT chrom || ':' || strand || ':' || pos || ':' || side AS site, sample_idx, metacell AS sample,
       round(included::DOUBLE / nullif(total, 0), 6) AS ratio FROM filled""")
def format_prop(spark, sf):
    named = filled_phenotype(spark, sf).withColumn("site", F.concat_ws(":", "chrom", "strand", F.col("pos").cast("string"), "side"))
    return text.read_prop(spark, write.prop_lines(named), sample_list(spark, sf))


@query("format_intron_out", f"""WITH {o.STAT}
SELECT i.intron, s.sample_idx, s.metacell AS sample, coalesce(x.n, 0) AS n FROM
 (SELECT DISTINCT chrom, strand, j_start, j_end, chrom || ':' || strand || ':' || j_start || ':' || j_end AS intron FROM stat) i
 CROSS JOIN samples s LEFT JOIN stat x ON x.chrom = i.chrom AND x.strand = i.strand AND x.j_start = i.j_start AND x.j_end = i.j_end
   AND x.metacell = s.metacell""")
def format_intron_out(spark, sf):
    stat = t.stat(spark, sf).select(intron().alias("intron"), F.lit("c").alias("cluster_id"), "metacell", "n")
    names = t.samples(spark, sf)
    dense = write.dense_counts(stat, names, names.count(), ["cluster_id", "intron"])
    return text.read_intron_out(spark, write.intron_lines(dense), sample_list(spark, sf)).select("intron", "sample_idx", "sample", "n")


@query("format_intron_lists", f"""WITH {o.INTRONS},
pairs AS (
  SELECT DISTINCT e.chrom, e.strand, e.pos, e.side, r.j_start, r.j_end, CASE WHEN e.side = 'start' THEN r.j_start ELSE r.j_end END = e.pos AS own
  FROM ends e JOIN ends r ON e.chrom = r.chrom AND e.strand = r.strand AND r.side <> e.side AND r.pos = e.partner)
SELECT chrom || ':' || strand || ':' || side AS cluster_id, pos, count(*) FILTER (own) AS n_included, count(*) FILTER (NOT own) AS n_excluded,
       CAST(sum(j_end - j_start) AS BIGINT) AS span FROM pairs GROUP BY chrom, strand, side, pos""")
def format_intron_lists(spark, sf):
    """``.inclu_exclu`` lines."""
    lists = introns.included_excluded(kept_introns(spark, sf))
    shown = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["j_start"].cast("string"), s["j_end"].cast("string"))), " ")
    made = lists.select(F.concat_ws(" ", F.concat_ws(":", "chrom", "strand", "side"), F.col("pos").cast("string"), F.lit("included"), shown("included"),
                                    F.lit("excluded"), shown("excluded")).alias("value"))
    back = text.read_inclu_exclu(spark, made)
    span = F.aggregate(F.concat("included", "excluded"), F.lit(0).cast("bigint"), lambda acc, x: acc + x["j_end"] - x["j_start"])
    return back.select("cluster_id", "pos", F.size("included").cast("bigint").alias("n_included"), F.size("excluded").cast("bigint").alias("n_excluded"), span.alias("span"))


@query("format_refined", f"""WITH {o.INTRONS} SELECT chrom || ':' || strand AS cluster_id, j_start, j_end, reads FROM introns""")
def format_refined(spark, sf):
    item = F.concat_ws(":", F.col("j_start").cast("string"), F.col("j_end").cast("string"), F.col("reads").cast("string"))
    made = kept_introns(spark, sf).select(F.concat_ws(" ", F.concat_ws(":", "chrom", "strand"), item).alias("value"))
    return text.read_refined(spark, made).select("cluster_id", F.inline("introns"))


@query("format_vcf", f"""WITH {o.VARIANTS}
SELECT v.chrom, v.snp_pos AS pos, 'rs' || v.k AS id, 'A' AS ref, 'G' AS alt, round(p_size / 100e0, 6) AS af FROM variants v JOIN part ON p_partkey = v.k""")
def format_vcf(spark, sf):
    rows = t.variants(spark, sf).join(t.load(spark, sf, "part").select(F.col("p_partkey").alias("k"), "p_size"), "k")
    info = F.concat(F.lit("AC=1;AF="), (F.col("p_size") / 100.0).cast("string"), F.lit(";AN=9"))
    made = rows.select(line("chrom", "snp_pos", F.concat(F.lit("rs"), F.col("k").cast("string")), F.lit("A"), F.lit("G"), F.lit("."), F.lit("PASS"), info))
    head = spark.createDataFrame([("##fileformat=VCFv4.2",), ("#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO",)], "value string")
    back = text.read_vcf(spark, head.unionByName(made))
    return back.select("chrom", "pos", "id", "ref", "alt", F.round(F.regexp_extract("info", r";AF=([0-9.]+)", 1).cast("double"), 6).alias("af"))


@query("format_vcf_genotypes", f"""WITH {o.GENOTYPES} SELECT snp, chrom, snp_pos, donor_idx, dosage FROM geno""")
def format_vcf_genotypes(spark, sf):
    shown = F.array_join(F.transform("dosage", lambda d: F.element_at(F.array(F.lit("0|0"), F.lit("0|1"), F.lit("1|1")), d.cast("int") + 1)), "\t")
    made = t.genotypes(spark, sf).select(line("chrom", "snp_pos", F.lit("."), F.lit("A"), F.lit("G"), F.lit("."), F.lit("."), F.lit("."), F.lit("GT"), shown))
    names = "\t".join(f"D{i}" for i in range(t.n_donors(spark, sf)))
    head = spark.createDataFrame([(f"#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\t{names}",)], "value string")
    variants, _ = text.read_vcf_genotypes(spark, head.unionByName(made))
    return variants.select("snp", "chrom", "snp_pos", F.posexplode("dosage").alias("donor_idx", "d")).select(
        "snp", "chrom", "snp_pos", F.col("donor_idx").cast("bigint").alias("donor_idx"), F.col("d").cast("int").alias("dosage"))


@query("format_markers", f"""WITH {o.GENOTYPES} SELECT k, donor_idx, dosage FROM geno""")
def format_markers(spark, sf):
    """Marker lines: a header and one line a donor, variants in the order of their keys."""
    keys = F.array_sort(F.collect_list(F.struct("k", F.col("dosage").cast("int").alias("g"))))
    rows = t.genotype_long(spark, sf).groupBy("donor_idx").agg(keys.alias("m"))
    body = rows.select(F.concat_ws(" ", F.concat(F.lit("D"), F.col("donor_idx").cast("string")), F.array_join(F.col("m.g").cast("array<string>"), " ")).alias("value"),
                       (F.col("donor_idx") + 1).cast("bigint").alias("line"))
    head = rows.limit(1).select(F.concat_ws(" ", F.lit("id"), F.array_join(F.transform("m", lambda x: F.concat(F.lit("v"), x["k"].cast("string"))), " ")).alias("value"),
                                F.lit(0).cast("bigint").alias("line"))
    back = text.read_markers(spark, cut_lineage(head.unionByName(body)))
    order = rows.limit(1).select(F.posexplode("m.k").alias("i", "k"))
    return back.select("donor_idx", F.posexplode("dosage").alias("i", "g")).join(order, "i").select(
        "k", F.col("donor_idx").cast("bigint").alias("donor_idx"), F.col("g").cast("int").alias("dosage"))


@query("format_results", f"""WITH {o.VARIANTS} SELECT 'chr1:+:' || snp_pos AS site, snp, round(1e0 / (k + 1), 9) AS p, k * 0.5e0 AS beta, 2e0 AS se FROM variants""")
def format_results(spark, sf):
    rows = t.variants(spark, sf).select(F.concat(F.lit("chr1:+:"), F.col("snp_pos").cast("string")).alias("site"), "snp",
                                        (F.lit(1.0) / (F.col("k") + 1)).alias("p"), (F.col("k") * 0.5).alias("beta"), F.lit(2.0).alias("se"))
    return text.read_results(spark, rows.select(line("site", "snp", "p", "beta", "se"))).withColumn("p", F.round("p", 9))


@query("format_groups_and_samples", f"""WITH {o.BARCODES} SELECT sample_idx, metacell AS sample, CAST(CASE WHEN donor_idx % 2 = 0 THEN 0 ELSE 2 END AS INT) AS label FROM samples""")
def format_groups_and_samples(spark, sf):
    rows = t.samples(spark, sf)
    names = text.read_samples(spark, rows.select(F.col("metacell").alias("value"), F.col("sample_idx").alias("line")))
    labels = text.read_groups(spark, rows.select(F.expr("CASE WHEN donor_idx % 2 = 0 THEN '0' ELSE '2' END").alias("value"), F.col("sample_idx").alias("line")))
    return names.join(labels, "sample_idx").select("sample_idx", "sample", "label")


@query("format_covariates", f"""WITH {o.BARCODES} SELECT sample_idx, metacell AS sample, c AS cov, donor_idx * 1e0 + c AS value
FROM samples CROSS JOIN (SELECT unnest([0, 1, 2])::BIGINT AS c)""")
def format_covariates(spark, sf):
    s = t.samples(spark, sf).agg(F.array_sort(F.collect_list(F.struct("sample_idx", "metacell", "donor_idx"))).alias("s"))  # at most two samples a nation
    cells = F.transform("s", lambda x: (x["donor_idx"] + F.col("c")).cast("double").cast("string"))
    body = s.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2)))).select(F.array_join(cells, " ").alias("value"), (F.col("c") + 1).cast("bigint").alias("line"))
    head = s.select(F.array_join("s.metacell", " ").alias("value"), F.lit(0).cast("bigint").alias("line"))
    back = text.read_covariates(spark, cut_lineage(head.unionByName(body)))
    return back.select(F.col("sample_idx").cast("bigint").alias("sample_idx"), "sample", "cov", "value")


@query("format_null_models", f"""WITH {o.SPREAD},
ph AS (SELECT chrom || ':' || strand || ':' || pos || ':' || side AS site, sample_idx, included, total FROM filled),
r AS (SELECT site, sum(included)::DOUBLE / sum(total) AS rate FROM ph GROUP BY site)
SELECT site, sample_idx, round(included - total * rate, 6) AS residual, round(rate, 6) AS pi, total::DOUBLE AS total, included::DOUBLE AS y FROM ph JOIN r USING (site)""")
def format_null_models(spark, sf):
    """``.middle`` texts of rate models, written and read back."""
    rows = site_frame(spark, sf).withColumn("site", F.concat_ws(":", "site", "side"))
    rate = rows.groupBy("site").agg((F.sum("included") / F.sum("total")).alias("rate"))
    item = F.struct("sample_idx", (F.col("included") - F.col("total") * F.col("rate")).alias("r"), F.col("rate").alias("p"),
                    F.col("total").cast("double").alias("t"), F.col("included").cast("double").alias("y"))
    models = rows.join(rate, "site").groupBy("site").agg(F.array_sort(F.collect_list(item)).alias("a")).select(
        "site", F.lit("Fixed").alias("status"), F.lit(1.0).alias("sqrt_r"), F.lit(-1.0).alias("tau_g"), F.col("a.sample_idx").cast("array<int>").alias("sample_idx"),
        F.col("a.r").alias("residuals"), F.col("a.p").alias("pi"), F.col("a.t").alias("total"), F.col("a.y").alias("y"))
    texts = write.null_model_lines(write.every_sample(models, t.samples(spark, sf)))
    back = text.read_null_models(spark, texts.select("value"))
    return back.select("site", F.inline(F.arrays_zip("sample_idx", "residuals", "pi", "total", "y"))).select(
        "site", F.col("sample_idx").cast("bigint").alias("sample_idx"), r6("residuals", "residual"), r6("pi", "pi"), "total", "y")


@query("format_sam", f"""WITH {o.READS} SELECT chrom, j_start AS pos, '50M' AS cigar, 16 AS flag, 60 AS mapq, CAST(cb AS VARCHAR) AS cb, CAST(umi AS VARCHAR) AS umi FROM reads""")
def format_sam(spark, sf):
    rows = t.reads(spark, sf)
    made = rows.select(line(F.lit("r"), F.lit(16), "chrom", F.col("j_start") + 1, F.lit(60), F.lit("50M"), F.lit("*"), F.lit(0), F.lit(0), F.lit("A"), F.lit("F"),
                            F.concat(F.lit("CB:Z:"), F.col("cb").cast("string")), F.concat(F.lit("UB:Z:"), F.col("umi").cast("string"))))
    head = spark.createDataFrame([("@HD\tVN:1.6",), ("r\t4\t*\t0\t0\t*\t*\t0\t0\tA\tF",)], "value string")
    return text.read_sam(spark, head.unionByName(made))


@query("format_ground_truth", f"""WITH {o.READS} SELECT DISTINCT 'v' || gene AS snp, chrom, gene * 100000 AS "start", gene * 100000 + 14000 AS "end" FROM reads""")
def format_ground_truth(spark, sf):
    rows = t.reads(spark, sf).select("gene", "chrom").distinct()
    span = F.concat_ws("_", "chrom", (F.col("gene") * 100000).cast("string"), (F.col("gene") * 100000 + 14000).cast("string"))
    return text.read_ground_truth(spark, rows.select(line(F.lit("x"), F.concat(F.lit("v"), F.col("gene").cast("string")), span)))
