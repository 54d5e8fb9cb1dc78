"""Streamed counts against the batch operator, and region access against a plain filter."""
import random

import pytest
from pyspark.sql import functions as F

from spliceweave.operators.junctions import junction_stats
from spliceweave.sources import regions
from spliceweave.streaming import counts

READS = "chrom string, strand string, j_start long, j_end long, cb string, umi string"


def made_reads(spark, seed, n=400):
    rng = random.Random(seed)
    rows = [("chr1", "+", 100 * rng.randint(1, 4), 5000, f"C{rng.randint(0, 9)}", rng.choice(["A", "C", "G", None])) for _ in range(n)]
    return spark.createDataFrame(rows, READS)


@pytest.mark.parametrize("files_per_batch", [1, 2, 100])
def test_streamed_counts_equal_batch_counts(spark, tmp_path, files_per_batch):
    cells = spark.createDataFrame([(f"C{i}", f"D{i % 3}") for i in range(8)], "cb string, metacell string")
    src, out, state = (str(tmp_path / x) for x in ("reads", "counts", "state"))
    made_reads(spark, 1).repartition(3).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema

    def go():
        stream = counts.junction_stream(spark, src, schema, files_per_batch)
        counts.start_counts(counts.new_molecules(stream, cells), out, state, partitions=2).awaitTermination()
        return sorted(map(tuple, counts.counted(spark, out, schema, cells).collect()))

    expect = lambda: sorted(tuple(r) for r in junction_stats(spark.read.parquet(src), cells).collect() if r.n)
    assert go() == expect()
    made_reads(spark, 2).repartition(2).write.mode("append").parquet(src)  # a second start goes on; known molecules don't count again
    made_reads(spark, 1).write.mode("append").parquet(src)
    assert go() == expect() and go() == expect()


def test_batch_that_runs_again_replaces_its_counts(spark, tmp_path):
    cells = spark.createDataFrame([("C1", "D1")], "cb string, metacell string")
    src, out, state = (str(tmp_path / x) for x in ("reads", "counts", "state"))
    made_reads(spark, 3).write.parquet(src)
    schema = spark.read.parquet(src).schema
    for again in ("a", "b"):  # a lost checkpoint: batch 0 is run anew
        stream = counts.junction_stream(spark, src, schema)
        counts.start_counts(counts.new_molecules(stream, cells), out, state + again).awaitTermination()
    got = sorted(map(tuple, counts.counted(spark, out, schema, cells).collect()))
    assert got == sorted(tuple(r) for r in junction_stats(spark.read.parquet(src), cells).collect() if r.n)


def test_counts_of_an_empty_folder(spark, tmp_path):
    cells = spark.createDataFrame([("C1", "D1")], "cb string, metacell string")
    assert counts.counted(spark, str(tmp_path / "none"), made_reads(spark, 1).schema, cells).count() == 0


def test_regions_read_only_their_files(spark, tmp_path):
    rng = random.Random(5)
    rows = [(f"chr{rng.randint(1, 3)}", rng.randint(0, 900_000), i) for i in range(3000)] + [("chr1", None, -1)] + [("chr1", 5000, 9000 + i) for i in range(50)]
    df = spark.createDataFrame(rows, "chrom string, pos long, id long")
    path = str(tmp_path / "t")
    regions.write_indexed(df, path, files=12, bin_size=1000)
    every = spark.read.parquet(path)
    assert every.count() == len(rows)
    for region, lo, hi in [("chr1:5000-5000", 5000, 5000), ("chr2:100,000-180,000", 100_000, 180_000), ("chr3", 0, 10**9), ("chr1:5000", 5000, 5000),
                           ("chr9:1-5", 1, 5), ("chr1:2000000-3000000", 2_000_000, 3_000_000)]:
        got = regions.read_region(spark, path, region)
        expect = {r[2] for r in rows if r[0] == region.split(":")[0] and r[1] is not None and lo <= r[1] <= hi}
        assert {r.id for r in got.collect()} == expect
        assert got.columns == every.columns
    files = len(every.inputFiles())
    assert 0 < len(regions.region_files(spark, path, "chr2:100,000-180,000")) <= 3 < files
    assert set(regions.read_region(spark, path, "chr2:100000-180000").inputFiles()) < set(every.inputFiles())
    with pytest.raises(ValueError):
        regions.parse_region("chr1:9-3")


def test_region_index_of_an_empty_table(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("chr1", 5)], "chrom string, pos long")
    regions.write_indexed(df.filter(F.col("pos") > 5).unionByName(df), path)
    assert regions.read_region(spark, path, "chr1:6-9").count() == 0
