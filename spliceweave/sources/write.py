"""Writers of the interchange files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.functions.keys import count_pair
from spliceweave.session import cut_lineage, drop_stage


def write_table(df: DataFrame, path: str, sep: str = "\t", header: bool = False) -> None:
    df.write.csv(path, sep=sep, header=header, emptyValue="", nullValue="NA")


def write_if_any(df: DataFrame, path: str, sep: str = "\t", header: bool = False) -> bool:
    """Write only when there are rows; tells whether it did. The plan runs once: rows are stored, then copied."""
    stored = cut_lineage(df)
    some = not stored.isEmpty()
    if some:
        write_table(stored, path, sep, header)
    drop_stage(stored)
    return some


def write_by_key(df: DataFrame, path: str, keys: Sequence[str], sep: str = "\t", header: bool = True) -> None:
    """One folder per key value, and few files in each; keys without rows get none."""
    df.repartition(*keys).write.partitionBy(*keys).csv(path, sep=sep, header=header, nullValue="NA")


def write_sorted(df: DataFrame, path: str, chrom: str = "chrom", pos: str = "pos", files: int | None = None) -> None:
    """Coordinate-sorted Parquet by chromosome: range access prunes folders and row groups. ``files`` ranges, else as many as shuffle partitions."""
    by = (chrom, pos) if files is None else (files, chrom, pos)
    df.repartitionByRange(*by).sortWithinPartitions(chrom, pos).write.partitionBy(chrom).parquet(path)


def _rows(long: DataFrame, row: Sequence[str], value: Column, sep: str = " ") -> DataFrame:
    """One text line per row with its values in sample order."""
    cells = F.transform(F.array_sort(F.collect_list(F.struct(F.col("sample_idx"), value.alias("v")))), lambda s: s["v"])
    return long.groupBy(*row).agg(cells.alias("__c")).select(F.concat_ws(sep, *row, F.array_join("__c", sep)).alias("value"))


def site_lines(pheno: DataFrame) -> DataFrame:
    """``.site`` / ``.filtered`` lines from (site, sample_idx, included, total), dense over samples."""
    return _rows(pheno, ["site"], count_pair())


def prop_lines(pheno: DataFrame) -> DataFrame:
    """``.prop`` lines with six decimals."""
    return _rows(pheno, ["site"], F.format_string("%.6f", F.col("ratio")))


def intron_lines(counts: DataFrame) -> DataFrame:
    """``.intron.out`` lines from (cluster_id, intron, sample_idx, n), dense over samples."""
    return _rows(counts, ["cluster_id", "intron"], F.col("n").cast("string"))


def dense_counts(counts: DataFrame, samples: DataFrame, n_samples: int, keys: Sequence[str], sample: str = "metacell") -> DataFrame:
    """Every key for every sample, zeros where absent; expanded from the sample index range."""
    grid = counts.select(*keys).distinct().withColumn("sample_idx", F.explode(F.sequence(F.lit(0), F.lit(n_samples - 1))))
    named = counts.join(samples.select(F.col("sample_idx").cast("int"), sample), sample).select(*keys, "sample_idx", "n")
    return grid.join(named, [*keys, "sample_idx"], "left").na.fill({"n": 0})


def header_line(samples: DataFrame, sample: str = "sample", sep: str = " ") -> DataFrame:
    names = F.transform(F.array_sort(F.collect_list(F.struct("sample_idx", F.col(sample).alias("s")))), lambda x: x["s"])
    return samples.agg(F.array_join(names, sep).alias("value"))


def write_lines(path: str, body: DataFrame, header: DataFrame | None = None) -> None:
    """Text folder; the header goes first in its own part file."""
    if header is not None:
        first = header.select(F.lit(0).alias("__k"), "value")
        body = first.unionByName(body.select(F.lit(1).alias("__k"), "value"))
        body = body.repartitionByRange("__k", "value").sortWithinPartitions("__k", "value").select("value")
    body.write.text(path)


def null_model_lines(models: DataFrame) -> DataFrame:
    """(site, value): the five-line text of each null model."""
    def row(name, col):
        return F.concat(F.lit(name + "\t"), F.array_join(F.transform(col, lambda v: v.cast("string")), "\t"))

    head = F.concat_ws("\t", "status", "site", F.col("sqrt_r").cast("string"), F.col("tau_g").cast("string"))
    return models.select("site", F.concat_ws("\n", head, row("residuals", "residuals"), row("pi", "pi"), row("total", "total"), row("y", "y")).alias("value"))


def every_sample(models: DataFrame, samples: DataFrame) -> DataFrame:
    """Models whose arrays hold every sample in list order: what a site does not cover has total 0, residual 0 and pi 0.

    The text form has no sample numbers, so readers number its values from 0.
    """
    names = ["residuals", "pi", "total", "y"]
    size = samples.agg(F.max("sample_idx") + 1).first()[0] or 0

    def spread(c):
        by_sample = F.map_from_arrays("__at", c)
        return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.element_at(by_sample, i.cast("int")), F.lit(0.0))).alias(c)

    rest = [c for c in models.columns if c not in (*names, "sample_idx")]
    known = models.withColumnRenamed("sample_idx", "__at")
    return known.select(*rest, F.sequence(F.lit(0), F.lit(size - 1)).alias("sample_idx"), *[spread(c) for c in names])


def write_null_models(models: DataFrame, path: str) -> None:
    """One folder per site, as the text form is one file per site."""
    null_model_lines(models).write.partitionBy("site").text(path)


def write_results(assoc: DataFrame, path: str, p_max: float = 1.0) -> None:
    """``.result`` lines; associations with p above ``p_max`` are not written."""
    write_table(assoc.filter(F.col("p") <= p_max).select("site", "snp", "p", "beta", "se"), path)
