"""Catalogue entries for incremental counts and region access; tables are derived from the given ones and stored in the stage folder first."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from spliceweave.plans import oracle_tables as o
from spliceweave.plans import tables as t
from spliceweave.plans.catalog import query
from spliceweave.session import checkpoint_dir_ready
from spliceweave.sources import regions
from spliceweave.streaming import counts

REGION = "chr2:100000-5000000"


def stage_folder(spark, name: str) -> str:
    checkpoint_dir_ready(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


@query("stream_junction_counts", f"WITH {o.STAT} SELECT * FROM stat")
def stream_junction_counts(spark, sf):
    """The counts of ``junc_stat_dedup`` from a stream: all reads arrive in several batches, and then all of them once more."""
    folder = stage_folder(spark, "stream-counts")
    reads = t.junctions(spark, sf)
    for _ in range(2):
        reads.write.mode("append").parquet(f"{folder}/reads")
    stored = spark.read.parquet(f"{folder}/reads")
    cells = t.barcodes(spark, sf)
    stream = counts.junction_stream(spark, f"{folder}/reads", stored.schema, max(1, len(stored.inputFiles()) // 3))
    job = counts.start_counts(counts.new_molecules(stream, cells), f"{folder}/counts", f"{folder}/state")
    job.awaitTermination()
    return counts.counted(spark, f"{folder}/counts", stored.schema, cells)


@query("region_reads", f"""WITH {o.READS}
SELECT chrom, strand, j_start, j_end, cb, umi FROM junc WHERE chrom = 'chr2' AND j_start BETWEEN 100000 AND 5000000""")
def region_reads(spark, sf):
    """Junction reads of one region from an indexed table."""
    path = stage_folder(spark, "regions")
    regions.write_indexed(t.junctions(spark, sf), path, pos="j_start")
    return regions.read_region(spark, path, REGION, pos="j_start").select("chrom", "strand", "j_start", "j_end", "cb", "umi")


@query("region_zone_map", f"""WITH {o.READS}
SELECT chrom, count(*) AS n_rows, min(j_start) AS first, max(j_start) AS last FROM junc GROUP BY chrom""")
def region_zone_map(spark, sf):
    """The index summed up by chromosome: every row of the table is filed, under its own range."""
    path = stage_folder(spark, "regions")
    regions.write_indexed(t.junctions(spark, sf), path, pos="j_start")
    files = spark.read.parquet(f"{path}/{regions.INDEX}").select("chrom", "file", "first", "last", "rows").distinct()
    return files.groupBy("chrom").agg(F.sum("rows").alias("n_rows"), F.min("first").alias("first"), F.max("last").alias("last"))
