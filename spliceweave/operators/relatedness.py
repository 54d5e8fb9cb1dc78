"""Genetic relatedness from dosages."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceweave.session import ship_package


def _standardised(rows: pa.Table, column: str, freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Variants x donors of a tile, standardised with zeros where a dosage is missing, and which are there."""
    g = rows[column].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(rows), -1)
    g = (g - 2 * freq[:, None]) / np.sqrt(2 * freq * (1 - freq))[:, None]
    return np.nan_to_num(g), (~np.isnan(g)).astype(float)


def _tile_kernel(tile: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.filter(pc.and_(pc.greater(rows["f"], 0.0), pc.less(rows["f"], 1.0)))
        if not len(rows):
            return pa.table({"i": pa.array([], "int64"), "j": pa.array([], "int64"), "s": pa.array([], "float64"), "m": pa.array([], "float64")})
        freq, ti, tj = rows["f"].to_numpy(), rows["ti"][0].as_py(), rows["tj"][0].as_py()
        a, seen_a = _standardised(rows, "a", freq)
        b, seen_b = (a, seen_a) if ti == tj else _standardised(rows, "b", freq)
        k, m = a.T @ b, seen_a.T @ seen_b
        i, j = np.indices(k.shape)
        return pa.table({"i": (i + ti * tile).ravel(), "j": (j + tj * tile).ravel(), "s": k.ravel(), "m": m.ravel()})

    return run


def relatedness(genotypes: DataFrame, n_donors: int, tile: int = 512, snp_rows: int = 4096) -> DataFrame:
    """(i, j, k) over donor indices: mean product of standardised dosages, both triangles.

    ``genotypes`` is (snp, dosage ARRAY). Donors are cut into tiles and variants into blocks, so
    a task multiplies one bounded pair of slices; partial sums are combined by (i, j).
    Monomorphic variants and missing dosages do not count. Frequencies are taken from whole rows, once a row: nothing filters on them
    before the kernel, as a filter would be pushed below the dosages and make them again for each of its terms.
    """
    ship_package(genotypes.sparkSession)
    known = F.filter("dosage", lambda d: d.isNotNull())
    freq = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, d: s + d) / (F.size(known) * 2))
    tiles = -(-n_donors // tile)
    pairs = F.explode(F.array(*[
        F.struct(F.lit(a).alias("ti"), F.lit(b).alias("tj")) for a in range(tiles) for b in range(a, tiles)]))
    blocks = max(1, -(-genotypes.count() // snp_rows))
    part = lambda t: F.slice("dosage", F.col(t) * tile + 1, F.lit(tile))
    work = (
        genotypes.select("snp", F.col("dosage").cast("array<double>").alias("dosage"))
        .select(F.pmod(F.xxhash64("snp"), F.lit(blocks)).alias("block"), "dosage", freq.alias("f"))
        .select("block", "dosage", "f", pairs.alias("t")).select("block", "dosage", "f", "t.ti", "t.tj")
        .select("block", "f", "ti", "tj", part("ti").alias("a"), F.when(F.col("ti") < F.col("tj"), part("tj")).alias("b")))
    parts = work.groupBy("ti", "tj", "block").applyInArrow(_tile_kernel(tile), "i bigint, j bigint, s double, m double")
    half = parts.groupBy("i", "j").agg((F.sum("s") / F.sum("m")).alias("k")).withColumn("upper", F.col("i") <= F.col("j"))
    cell = F.struct(F.col("i"), F.col("j"), F.col("k"))
    mirror = F.struct(F.col("j").alias("i"), F.col("i").alias("j"), F.col("k"))
    both = F.when(F.col("i") == F.col("j"), F.array(cell)).when(F.col("upper"), F.array(cell, mirror))
    return half.select(F.inline(both))
