"""Splicing principal components of samples from usage ratios."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceweave.session import cut_lineage, ship_package


def _through(rows: DataFrame, q: np.ndarray) -> np.ndarray:
    """A'A q for the stored site rows: each task multiplies its rows and returns one small sample matrix."""
    held = rows.sparkSession.sparkContext.broadcast(q)  # samples x a few vectors

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros_like(held.value)
        for b in batches:
            if len(b):
                a = np.vstack(b["a"].to_numpy())
                total += a.T @ (a @ held.value)
        yield pd.DataFrame({"i": np.arange(len(total)), "v": list(total)})

    parts = rows.mapInPandas(kernel, "i int, v array<double>")
    sums = parts.groupBy("i").agg(F.array(*[F.sum(F.col("v")[j]) for j in range(q.shape[1])]).alias("v")).toPandas().sort_values("i")
    return np.vstack(sums["v"].to_numpy())


def splicing_pcs(usage: DataFrame, n_pcs: int = 8, tol: float = 1e-9, seed: int = 0) -> DataFrame:
    """(sample_idx, pc ARRAY, variance ARRAY): leading components of the site-centred ratios.

    ``usage`` is (site, sample_idx, ratio); missing ratios count as the site's mean. A site is stored once as an array over
    the samples. Block Lanczos: each turn multiplies these rows with a few sample vectors and sums the small
    products, so the matrix is never shuffled; the sample vectors (samples x a few) are all that
    reaches the driver. Turns go on until every wanted vector's residual is below ``tol`` times the largest value, or the
    vectors span all samples. ``variance`` repeats the squared singular values.
    """
    spark = usage.sparkSession
    ship_package(spark)
    ids = [r[0] for r in usage.select("sample_idx").distinct().orderBy("sample_idx").collect()]
    at = {s: i for i, s in enumerate(ids)}
    n, names = len(ids), np.array(ids)
    if not n:
        return spark.createDataFrame([], "sample_idx int, pc array<double>, variance array<double>")

    def centre(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = np.zeros((len(b), n))
            for row, entries in zip(out, b["e"], strict=True):
                values = [(at[e["sample_idx"]], e["ratio"]) for e in entries if e["ratio"] is not None]
                if values:
                    where, x = (np.array(v) for v in zip(*values, strict=True))
                    row[where] = x - x.mean()
            yield pd.DataFrame({"a": list(out)})

    per_site = usage.groupBy("site").agg(F.collect_list(F.struct("sample_idx", F.col("ratio").cast("double").alias("ratio"))).alias("e"))
    rows = cut_lineage(per_site.select("e").mapInPandas(centre, "a array<double>"))
    width = min(n, n_pcs + 4)
    basis = np.linalg.qr(np.random.default_rng(seed).standard_normal((n, width)))[0]
    image = _through(rows, basis)
    while True:
        small = basis.T @ image
        values, turn = np.linalg.eigh((small + small.T) / 2)
        lead = np.argsort(values)[::-1][:n_pcs]
        pcs, values = basis @ turn[:, lead], values[lead]
        gap = np.linalg.norm(image @ turn[:, lead] - pcs * values, axis=0)
        if basis.shape[1] == n or gap.max() <= tol * max(values.max(), 1e-300):
            break
        fresh = image[:, -width:]
        for _ in range(2):
            fresh = fresh - basis @ (basis.T @ fresh)
        left, size, _ = np.linalg.svd(fresh, full_matrices=False)
        fresh = left[:, size > 1e-12 * max(size.max(), 1e-300)][:, :n - basis.shape[1]]
        if not fresh.shape[1]:
            break
        fresh = np.linalg.qr(fresh - basis @ (basis.T @ fresh))[0]
        basis, image = np.hstack([basis, fresh]), np.hstack([image, _through(rows, fresh)])
        width = min(width, fresh.shape[1])
    data = [(s.item(), row.tolist(), values.tolist()) for s, row in zip(names, pcs, strict=True)]
    kind = usage.schema["sample_idx"].dataType.simpleString()
    return spark.createDataFrame(data, f"sample_idx {kind}, pc array<double>, variance array<double>")
