"""Region access to coordinate-sorted tables.

Beside a table written by ``write_sorted`` lies an index: for each file the smallest and largest position (its zone map), filed under every bin
of positions that the file covers. Files are disjoint ranges, so the index has about as many rows as there are bins and files. A region reads the
index rows of its bins, and then the files these name and nothing else; inside a file, row groups are skipped by their own minima and maxima.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceweave.sources.write import write_sorted

INDEX = "_region_index"


def write_indexed(df: DataFrame, path: str, chrom: str = "chrom", pos: str = "pos", files: int | None = None, bin_size: int = 1 << 16) -> None:
    """Coordinate-sorted Parquet with its region index. Rows without a position are kept and are in no region."""
    write_sorted(df, path, chrom, pos, files)
    index_table(df.sparkSession, path, chrom, pos, bin_size)


def index_table(spark: SparkSession, path: str, chrom: str = "chrom", pos: str = "pos", bin_size: int = 1 << 16) -> None:
    """Write the index of a table at ``path``; only chromosome and position are read."""
    spans = (
        spark.read.parquet(path).filter(F.col(pos).isNotNull())
        .groupBy(F.col(chrom).cast("string").alias("chrom"), F.url_decode("_metadata.file_path").alias("file"))
        .agg(F.min(pos).cast("long").alias("first"), F.max(pos).cast("long").alias("last"), F.count(F.lit(1)).alias("rows"))
    )
    bins = F.sequence(F.floor(F.col("first") / bin_size), F.floor(F.col("last") / bin_size))
    filed = spans.withColumn("bin", F.explode(bins)).select(
        "chrom", (F.col("bin") * bin_size).alias("bin_start"), ((F.col("bin") + 1) * bin_size - 1).alias("bin_end"), "first", "last", "rows", "file")
    filed.repartitionByRange("chrom", "bin_start").sortWithinPartitions("chrom", "bin_start").write.mode("overwrite").parquet(f"{path}/{INDEX}")


def parse_region(region: str) -> tuple[str, int, int]:
    """``chrom:from-to`` (both inclusive, thousands separators allowed), ``chrom:pos`` or ``chrom``."""
    chrom, _, span = region.rpartition(":") if ":" in region else (region, "", "")
    if not span:
        return chrom, 0, (1 << 62)
    first, _, last = span.replace(",", "").partition("-")
    lo, hi = int(first), int(last or first)
    if lo > hi:
        raise ValueError(f"region ends before it starts: {region}")
    return chrom, lo, hi


def region_files(spark: SparkSession, path: str, region: str) -> list[str]:
    """Files that hold positions of the region; their number follows the region, not the table."""
    chrom, lo, hi = parse_region(region)
    index = spark.read.parquet(f"{path}/{INDEX}")
    met = index.filter((F.col("chrom") == chrom) & (F.col("bin_start") <= hi) & (F.col("bin_end") >= lo) & (F.col("first") <= hi) & (F.col("last") >= lo))
    return sorted(r["file"] for r in met.select("file").distinct().collect())


def read_region(spark: SparkSession, path: str, region: str, chrom: str = "chrom", pos: str = "pos") -> DataFrame:
    """Rows of an indexed table inside ``chrom:from-to``. A region or chromosome without rows gives an empty table."""
    name, lo, hi = parse_region(region)
    files = region_files(spark, path, region)
    rows = spark.read.option("basePath", path).parquet(*files) if files else spark.read.parquet(path).filter(F.lit(False))
    return rows.filter((F.col(chrom) == name) & F.col(pos).between(lo, hi))
