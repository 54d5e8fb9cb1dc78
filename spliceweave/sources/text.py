"""Text formats to typed, long DataFrames.

Wide files hold one column per sample; they are read as lines and exploded by position, so any
number of samples needs no schema. Positions are named by the file's header or a sample list.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceweave.functions.genotype import dosage
from spliceweave.functions.keys import parse_count_pair, parse_intron, parse_site, token
from spliceweave.operators.ordering import with_line_number

INTRON_LIST = "array<struct<j_start:bigint,j_end:bigint>>"


def fields(col="value") -> Column:
    """Tokens of a line separated by any white space."""
    return F.split(F.trim(F.col(col)), r"\s+")


def file_stem(col: Column | None = None) -> Column:
    """File name without folders and extension, from the scan metadata.

    Hadoop file systems refuse ``:`` in names, so a metacell file is stored as ``D1%3A1.stat``.
    """
    name = F.element_at(F.split(col if col is not None else F.url_decode("_metadata.file_path"), "/"), -1)
    bare = F.regexp_replace(name, r"\.[^.]*(\.gz)?$", "")
    return F.coalesce(F.try_url_decode(bare), bare)


def lines(spark: SparkSession, path) -> DataFrame:
    """Lines with text, of files or of a line table: every reader takes either.

    A line table is a DataFrame with ``value``, and ``stem`` or ``line`` where a reader needs the file's name or a line's number.
    """
    rows = path if isinstance(path, DataFrame) else spark.read.text(path)
    return rows.filter(F.length(F.trim("value")) > 0)


def named_lines(spark: SparkSession, path, name: str) -> DataFrame:
    """(value, name): lines with the name of their file."""
    rows = lines(spark, path)
    return rows.select("value", (F.col("stem") if "stem" in rows.columns else file_stem()).alias(name))


def numbered_lines(spark: SparkSession, path, out: str = "line") -> DataFrame:
    """(value, out): lines with their number from 0."""
    rows = lines(spark, path)
    if "line" in rows.columns:
        return rows.select("value", F.col("line").cast("bigint").alias(out))
    return with_line_number(rows, out)


def _typed(df: DataFrame, names: list[tuple[str, str]]) -> DataFrame:
    parts = df.select("*", fields().alias("__f"))
    return parts.select(
        *[c for c in df.columns if c != "value"],
        *[F.try_element_at("__f", F.lit(i + 1)).try_cast(kind).alias(n) for i, (n, kind) in enumerate(names)])


def _items(col: Column, kind: str) -> Column:
    """``start:end[:reads]`` tokens to structs."""
    if kind == INTRON_LIST:
        return F.transform(col, lambda s: F.struct(
            token(s, 1).cast("bigint").alias("j_start"), token(s, 2).cast("bigint").alias("j_end")))
    return F.transform(col, lambda s: F.struct(
        token(s, 1).cast("bigint").alias("j_start"), token(s, 2).cast("bigint").alias("j_end"), token(s, 3).cast("bigint").alias("reads")))


def directory(spark: SparkSession, path: str) -> DataFrame:
    """(path, stem) of every file under a glob, without reading contents."""
    listing = spark.read.format("binaryFile").load(path).select("path")
    return listing.select("path", file_stem(F.col("path")).alias("stem"))


def read_if_present(spark: SparkSession, path: str, reader, schema: str) -> DataFrame:
    """``reader(spark, path)``, or an empty table of ``schema`` when no such file exists."""
    try:
        return reader(spark, path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def lines_with(spark: SparkSession, path, text: str) -> DataFrame:
    """Lines that contain a substring."""
    return lines(spark, path).filter(F.col("value").contains(text))


def read_sam(spark: SparkSession, path) -> DataFrame:
    """Mapped alignments of SAM text in the layout of the ``bam`` source (0-based ``pos``)."""
    f = F.split("value", "\t")
    rows = lines(spark, path).filter(~F.col("value").startswith("@")).select(f.alias("f"))
    mapped = rows.filter(F.col("f")[1].cast("int").bitwiseAND(F.lit(4)) == 0)

    def tag(name):
        hit = F.filter("f", lambda t: t.startswith(f"{name}:Z:"))
        return F.substring(F.try_element_at(hit, F.lit(1)), 6, 1 << 30)

    return mapped.select(
        F.col("f")[2].alias("chrom"), (F.col("f")[3].cast("bigint") - 1).alias("pos"), F.col("f")[5].alias("cigar"),
        F.col("f")[1].cast("int").alias("flag"), F.col("f")[4].cast("int").alias("mapq"), tag("CB").alias("cb"), tag("UB").alias("umi"))


# ------------------------------------------------------------------ reads and counts

def read_junctions(spark, path) -> DataFrame:
    """``.junc`` records."""
    raw = _typed(lines(spark, path), [
        ("chrom", "string"), ("read_start", "bigint"), ("read_end", "bigint"), ("n_reads", "int"), ("strand", "string"),
        ("j_start", "bigint"), ("j_end", "bigint"), ("anchors", "string"), ("cb", "string"), ("umi", "string")])
    return raw.withColumn("anchors", F.split("anchors", ",").cast("array<int>"))


def read_stat(spark, path) -> DataFrame:
    """``.stat`` files of all metacells; the file name is the metacell."""
    raw = _typed(named_lines(spark, path, "metacell"), [("intron", "string"), ("n", "bigint")])
    return raw.select("metacell", parse_intron(F.col("intron")).alias("i"), "n").select("metacell", "i.*", "n")


def read_nonsplit(spark, path) -> DataFrame:
    """``chrom:pos:strand:CB:UMI count`` lines; ``source`` is the file name."""
    raw = _typed(named_lines(spark, path, "source"), [("key", "string"), ("n", "bigint")])
    k = F.col("key")
    return raw.select(
        "source", token(k, 1).alias("chrom"), token(k, 3).alias("strand"), token(k, 2).try_cast("bigint").alias("pos"),
        token(k, 4).alias("cb"), token(k, 5).alias("umi"), "n")


def read_barcodes(spark, path) -> DataFrame:
    """Barcode lists, one file per metacell."""
    return named_lines(spark, path, "metacell").select(F.trim("value").alias("cb"), "metacell")


def read_metacell_labels(spark, path) -> DataFrame:
    """CSV of (meta, cell_id, ind_id, combine_meta)."""
    raw = spark.read.csv(path, header=True, schema="meta string, cell_id string, ind_id string, combine_meta string")
    return raw.select("cell_id", F.col("ind_id").alias("donor"), "meta", F.col("combine_meta").alias("metacell"))


# ------------------------------------------------------------------ introns and sites

def read_inclu_exclu(spark, path) -> DataFrame:
    parts = lines(spark, path).select(fields().alias("f"))
    cut = F.array_position("f", "excluded").cast("int")
    tail = F.slice("f", cut + 1, F.size("f"))
    mid = F.slice("f", F.lit(4), cut - 4)
    return parts.select(
        F.col("f")[0].alias("cluster_id"), F.col("f")[1].cast("bigint").alias("pos"),
        _items(mid, INTRON_LIST).alias("included"), _items(tail, INTRON_LIST).alias("excluded"))


def read_refined(spark, path) -> DataFrame:
    parts = lines(spark, path).select(fields().alias("f"))
    return parts.select(F.col("f")[0].alias("cluster_id"),
                        _items(F.slice("f", F.lit(2), F.size("f")), "refined").alias("introns"))


def read_intron_out(spark, path, samples: DataFrame) -> DataFrame:
    """(cluster_id, intron, sample, n) for every cell, zeros included."""
    parts = lines(spark, path).select(fields().alias("f"))
    long = parts.select(F.col("f")[0].alias("cluster_id"), F.col("f")[1].alias("intron"),
                        F.posexplode(F.slice("f", F.lit(3), F.size("f"))).alias("sample_idx", "n"))
    return long.join(samples, "sample_idx").select("cluster_id", "intron", "sample_idx", "sample", F.col("n").cast("bigint").alias("n"))


def wide_matrix(spark, path, cell: str, row_label: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows (site, sample_idx, value), header (sample_idx, sample)) of a wide file.

    ``cell`` is a pattern for the first value; a line that does not match it is the header.
    ``row_label`` says whether the header names the row column too.
    """
    parts = lines(spark, path).select(fields().alias("f"))
    is_row = F.coalesce(F.try_element_at("f", F.lit(2)).rlike(cell), F.lit(False))
    rows = parts.filter(is_row).select(
        F.col("f")[0].alias("site"), F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("sample_idx", "value"))
    skip = F.lit(2 if row_label else 1)
    header = parts.filter(~is_row).select(F.posexplode(F.slice("f", skip, F.size("f"))).alias("sample_idx", "sample"))
    return rows, header


def read_site(spark, path, samples: DataFrame | None = None, row_label: bool = False) -> DataFrame:
    """``.site`` or ``.filtered``: (site, chrom, strand, pos, sample_idx, sample, included, total)."""
    rows, header = wide_matrix(spark, path, r"^\d+:\d+$", row_label)
    named = rows.join(samples if samples is not None else header, "sample_idx")
    return named.select("site", parse_site(F.col("site")).alias("s"), "sample_idx", "sample",
                        parse_count_pair("value").alias("c")).select("site", "s.*", "sample_idx", "sample", "c.*")


def read_prop(spark, path, samples: DataFrame | None = None, row_label: bool = False) -> DataFrame:
    rows, header = wide_matrix(spark, path, r"^[-+]?[0-9.]+([eE][-+]?[0-9]+)?$|^(NA|NaN|nan)$", row_label)
    named = rows.join(samples if samples is not None else header, "sample_idx")
    return named.select("site", "sample_idx", "sample", F.nanvl(F.col("value").try_cast("double"), F.lit(None)).alias("ratio"))


def read_samples(spark, path) -> DataFrame:
    """(sample_idx, sample) from a list with one name per line."""
    return numbered_lines(spark, path, "sample_idx").select("sample_idx", F.trim("value").alias("sample"))


def header_samples(spark, path, row_label: bool = False) -> DataFrame:
    """Sample list of a phenotype file's header line."""
    return wide_matrix(spark, path, r"^\d+:\d+$", row_label)[1]


# ------------------------------------------------------------------ model inputs

def read_covariates(spark, path) -> DataFrame:
    """(sample, cov, value): a header of samples, then one line per covariate (cov = 0, 1, ...)."""
    numbered = numbered_lines(spark, path, "line").select("line", fields().alias("f"))
    header = numbered.filter("line = 0").select(F.posexplode("f").alias("sample_idx", "sample"))
    cells = numbered.filter("line > 0").select(
        (F.col("line") - 1).alias("cov"), F.posexplode("f").alias("sample_idx", "value"))
    return cells.join(header, "sample_idx").select("sample_idx", "sample", "cov", F.col("value").cast("double").alias("value"))


def covariate_vectors(long: DataFrame) -> DataFrame:
    """(sample, x ARRAY) in covariate order."""
    return long.groupBy("sample").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("cov", "value"))), lambda s: s["value"]).alias("x"))


def read_grm(spark, path) -> tuple[DataFrame, DataFrame]:
    """(entries (i, j, k), labels (donor_idx, donor)) of a labelled square matrix."""
    numbered = numbered_lines(spark, path, "line").select("line", fields().alias("f"))
    labels = numbered.filter("line = 0").select(F.posexplode("f").alias("donor_idx", "donor"))
    cells = numbered.filter("line > 0").select(
        F.col("f")[0].alias("donor"), F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("j", "k"))
    entries = cells.join(labels, "donor").select(F.col("donor_idx").alias("i"), "j", F.col("k").cast("double").alias("k"))
    return entries, labels


def read_markers(spark, path, header: bool | None = None) -> DataFrame:
    """(donor_idx, dosage ARRAY) in file order; NA is NULL. An optional header line is skipped."""
    numbered = numbered_lines(spark, path, "line").select("line", fields().alias("f"))
    is_head = (F.col("line") == 0) & ~F.coalesce(F.col("f")[1].rlike(r"^([0-9.]+|NA)$"), F.lit(False))
    flagged = numbered.withColumn("head", is_head if header is None else (F.col("line") == 0) & F.lit(header))
    shift = flagged.agg(F.max(F.col("head").cast("int")).alias("shift")).withColumn("one", F.lit(1))
    return flagged.filter(~F.col("head")).withColumn("one", F.lit(1)).join(F.broadcast(shift), "one").select(
        (F.col("line") - F.col("shift")).cast("int").alias("donor_idx"),
        F.transform(F.slice("f", F.lit(2), F.size("f")), lambda v: v.try_cast("double")).alias("dosage"))


def read_groups(spark, path) -> DataFrame:
    """(sample_idx, label) from one 0/2 label per line."""
    return numbered_lines(spark, path, "sample_idx").select("sample_idx", F.trim("value").cast("int").alias("label"))


def read_null_models(spark, path) -> DataFrame:
    """``.middle`` files: status line, then residuals, pi, total and y rows."""
    texts = path if isinstance(path, DataFrame) else spark.read.text(path, wholetext=True)
    whole = texts.select(F.split(F.trim("value"), r"\n").alias("l"))

    def numbers(i):
        f = F.split(F.trim(F.col("l")[i]), r"\s+")
        return F.slice(f, F.lit(2), F.size(f)).cast("array<double>")

    head = F.split(F.trim(F.col("l")[0]), r"\s+")
    return whole.select(
        head[1].alias("site"), parse_site(head[1]).alias("s"), head[0].alias("status"), head[2].cast("double").alias("sqrt_r"),
        head[3].cast("double").alias("tau_g"), numbers(1).alias("residuals"), numbers(2).alias("pi"), numbers(3).alias("total"),
        numbers(4).alias("y")).select("site", "s.*", "status", "sqrt_r", "tau_g", "residuals", "pi", "total", "y") \
        .withColumn("sample_idx", F.transform("y", lambda _, i: i))


def rename_site(models: DataFrame, new_site: str) -> DataFrame:
    """Give every model the same (artificial) site, as the simulated variants expect."""
    return models.withColumn("source_site", F.col("site")).drop("chrom", "strand", "pos").withColumn(
        "site", F.lit(new_site)).withColumn("s", parse_site(F.col("site"))).select("*", "s.*").drop("s")


# ------------------------------------------------------------------ associations and genotypes

def read_results(spark, path) -> DataFrame:
    return _typed(lines(spark, path), [("site", "string"), ("snp", "string"), ("p", "double"), ("beta", "double"), ("se", "double")])


def read_gene_summary(spark, path) -> DataFrame:
    """Summary TSV: site, lead variant, V3..V9 with the significance flag in V7."""
    raw = spark.read.csv(path, sep="\t", schema=", ".join(f"V{i} string" for i in range(1, 10)))
    return raw.withColumnsRenamed({"V1": "site", "V2": "snp", "V7": "sig_flag", "V8": "gene", "V9": "gene_alt"})


def significant(summary: DataFrame) -> DataFrame:
    return summary.filter(F.col("sig_flag") == "sig_splice")


def read_gwas(spark, path, study: str | None = None) -> DataFrame:
    """GWAS TSV with a header (plain or gz); columns beta, se, pvalue by name."""
    raw = spark.read.csv(path, sep="\t", header=True)
    out = raw.select("variant_id", *[F.col(c).try_cast("double").alias(c) for c in ("beta", "se", "pvalue")])
    return out.withColumnRenamed("pvalue", "p").withColumn("study", F.lit(study) if study else F.lit(None).cast("string"))


def read_maf(spark, path) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True).toDF("variant_id", "maf").withColumn("maf", F.col("maf").try_cast("double"))


def read_ground_truth(spark, path) -> DataFrame:
    """(snp, chrom, start, end): variant in V2, gene span ``chr_start_end`` in V3."""
    raw = _typed(lines(spark, path), [("v1", "string"), ("snp", "string"), ("span", "string")])
    s = F.col("span")
    return raw.select("snp", token(s, 1, "_").alias("chrom"), token(s, 2, "_").try_cast("bigint").alias("start"),
                      token(s, 3, "_").try_cast("bigint").alias("end"))


def read_vcf(spark, path) -> DataFrame:
    """(chrom, pos, id, ref, alt, info) of VCF records."""
    f = F.split("value", "\t")
    return lines(spark, path).filter(~F.col("value").startswith("#")).select(
        f[0].alias("chrom"), f[1].cast("bigint").alias("pos"), f[2].alias("id"), f[3].alias("ref"), f[4].alias("alt"), f[7].alias("info"))


def read_vcf_genotypes(spark, path, unphased: bool = False) -> tuple[DataFrame, DataFrame]:
    """(variants (snp, chrom, snp_pos, dosage ARRAY), donors (donor_idx, donor)) of a VCF.

    One VCF or a glob of files with the same sample columns.
    """
    raw = lines(spark, path)
    donors = raw.filter(F.col("value").startswith("#CHROM")).select(
        F.posexplode(F.slice(F.split("value", "\t"), 10, 1 << 30)).alias("donor_idx", "donor")).distinct()
    f = F.split("value", "\t")
    rows = raw.filter(~F.col("value").startswith("#")).select(f.alias("f"))
    variants = rows.select(
        F.concat_ws(":", F.col("f")[0], F.col("f")[1], F.col("f")[3], F.col("f")[4]).alias("snp"),
        F.col("f")[0].alias("chrom"), F.col("f")[1].cast("bigint").alias("snp_pos"),
        F.transform(F.slice("f", F.lit(10), F.size("f")), lambda g: dosage(g, unphased).cast("double")).alias("dosage"))
    return variants, donors


def read_simulated_genotypes(spark, path) -> DataFrame:
    """(snp, donor, dosage) of a matrix whose header names the samples only."""
    numbered = numbered_lines(spark, path, "line").select("line", fields().alias("f"))
    header = numbered.filter("line = 0").select(F.posexplode("f").alias("i", "donor"))
    cells = numbered.filter("line > 0").select(F.col("f")[0].alias("snp"), F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("i", "g"))
    return cells.join(header, "i").select("snp", "donor", F.col("g").try_cast("double").alias("dosage"))


def read_bed_phenotype(spark, path, id_column: str = "ID", skip: int = 4) -> DataFrame:
    """(ID, sample, value) of a BED phenotype file (plain or gz)."""
    wide = spark.read.csv(path, sep="\t", header=True)
    names = [c for c in wide.columns[skip:] if c != id_column]
    return wide.unpivot([id_column], names, "sample", "value").withColumn("value", F.col("value").try_cast("double"))


def read_count_matrix(spark, path, sep: str = ",") -> DataFrame:
    """(row, col, value) of a headerless matrix whose first column is a name."""
    numbered = numbered_lines(spark, path, "row").select("row", F.split("value", sep).alias("f"))
    return numbered.select("row", F.posexplode(F.slice("f", F.lit(2), F.size("f"))).alias("col", "v")).select(
        "row", "col", F.col("v").try_cast("double").alias("value"))


def read_cells(spark, path, normalisation: str) -> DataFrame:
    """Cells with component scores from Parquet ``<path>/<normalisation>``; unknown names are rejected."""
    if normalisation not in ("log_normalize", "SCTransform"):
        raise ValueError("normalisation must be log_normalize or SCTransform")
    return spark.read.parquet(f"{path}/{normalisation}").select("cell_id", "donor", F.col("pc").cast("array<double>").alias("pc"))
