"""Embedding near-duplicates with an inverted multi-index.

The two halves of unit vectors have codebooks of their own; their product is a grid of cells, and every vector is indexed in the
cell of its nearest centroids. A query visits cells in the order of the displacement that would carry it there (the distances to the
bisectors between its own and the other centroids, added over both halves) until neighbours at the threshold are found with the
target recall, and verifies what it meets in double precision. Displacements are taken as random directions: of a step of length e in
d dimensions, the two components across bisectors have a squared length over ``-2 ln(1 - recall) e^2 / d`` with probability ``1 - recall``.

Equal vectors are one class. Visits of a cell are cut into block pairs whose kernel counts links and returns a spanning forest of
them, so a dense group never turns into all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import forest
from spliceweave.operators.blocks import over_block_pairs
from spliceweave.operators.components import connected_components
from spliceweave.session import cut_lineage, ship_package


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances to all centroids and the index of the nearest."""
    d2 = np.maximum((x ** 2).sum(1)[:, None] - 2 * x @ centroids.T + (centroids ** 2).sum(1)[None, :], 0)
    return d2, d2.argmin(axis=1)


def codebook(x: np.ndarray, k: int, turns: int = 10) -> np.ndarray:
    """k-means from the first distinct rows."""
    _, first = np.unique(x, axis=0, return_index=True)
    centroids = x[np.sort(first)[:k]].copy()
    for _ in range(turns):
        own = nearest(x, centroids)[1]
        for c in range(len(centroids)):
            if (own == c).any():
                centroids[c] = x[own == c].mean(axis=0)
    return centroids


def bisector_steps(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distance from each row to the bisector between its own centroid and every other one (0 for its own); its own."""
    d2, own = nearest(x, centroids)
    apart = np.sqrt(((centroids[:, None] - centroids[None, :]) ** 2).sum(axis=2))[own]
    gap = d2 - d2[np.arange(len(x)), own][:, None]
    return np.where(apart > 0, (gap / (2 * np.maximum(apart, 1e-12))) ** 2, 0.0), own


def visits(unit: np.ndarray, books: tuple[np.ndarray, np.ndarray], reach2: float) -> tuple[np.ndarray, list[np.ndarray]]:
    """Own cell of each unit vector and the cells to visit, nearest first: the walk over both sorted lists ends at ``reach2``."""
    half = unit.shape[1] // 2
    (s1, c1), (s2, c2) = bisector_steps(unit[:, :half], books[0]), bisector_steps(unit[:, half:], books[1])
    k2 = len(books[1])
    order1, order2 = s1.argsort(axis=1), s2.argsort(axis=1)
    cells = []
    for i in range(len(unit)):
        a, b = s1[i, order1[i]], s2[i, order2[i]]
        take = np.searchsorted(b, reach2 - a[a <= reach2], side="right")
        x, y = np.repeat(np.arange(len(take)), take), np.concatenate([np.arange(t) for t in take])
        by = np.argsort(a[x] + b[y], kind="stable")
        cells.append((order1[i][x] * k2 + order2[i][y])[by])
    return c1 * k2 + c2, cells


def usable(rows: DataFrame) -> DataFrame:
    """Rows that may link: id and label not null, components finite and not all zero."""
    v = F.col("embedding")
    return (
        rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & v.isNotNull())
        .filter(F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0))
    )


def padded_length(size: Column) -> Column:
    """Length that vectors of ``size`` components are filled up to: the next power of two, at least 4."""
    return F.greatest(F.lit(4), F.pow(F.lit(2.0), F.ceil(F.log2(size.cast("double")))).cast("int"))


def near_vectors(vectors: DataFrame, threshold: float = 0.98, recall: float = 0.999, cell_rows: int = 512,
                 sample_rows: int = 16_384, block_rows: int = 2048) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors link when labels and lengths are equal and the cosine is ``threshold`` or more. Each range of lengths up to a power of two has an index of
    its own, in which vectors are filled up with zeros (this changes no cosine) and the length is part of the label. n_links counts other rows, copies included. Rows that can't
    link (see ``usable``) have no links and are components of their own. Repeated rows are copies of one another. The codebooks are fitted on at
    most ``sample_rows`` vectors, chosen by hash; every vector is indexed and is a query. Other columns are ignored.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("embedding"))
    alone = rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    classes = cut_lineage(
        usable(rows).groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("size"))
    )
    keyed = classes.select(
        F.concat_ws(":", F.size("embedding").cast("string"), "label").alias("label"), "rep", "size", "embedding", padded_length(F.size("embedding")).alias("d"))
    indexes = keyed.groupBy("d").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("label").alias("labels"), F.min(F.size("embedding")).alias("least")).orderBy("d").collect()  # 31 at most
    if indexes:
        parts = [
            _class_links(keyed.filter(F.col("d") == about["d"]).select(
                "label", "rep", "size", F.concat("embedding", F.array_repeat(F.lit(0.0), F.lit(about["d"]) - F.size("embedding"))).alias("embedding")),
                about, threshold, recall, cell_rows, sample_rows, block_rows)
            for about in indexes]
        found = reduce(DataFrame.unionByName, parts)
        copies = classes.filter("size > 1").select("label", "embedding", "rep")
        copy = F.when(F.col("vec_id").isNotNull(), F.col("rep"))
        own = rows.join(copies, ["label", "embedding"], "left").select("vec_id", F.coalesce(copy, F.col("vec_id")).alias("rep"))
        alone = own.join(found, "rep", "left").select(
            "vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("component_id"),
        )
    return alone.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _class_links(classes: DataFrame, about, threshold: float, recall: float, cell_rows: int, sample_rows: int, block_rows: int) -> DataFrame:
    """(rep, links, component) for classes with links."""
    d, k = about["d"], max(4, math.ceil(math.sqrt(about["n"] / max(about["labels"], 1) / cell_rows)))
    reach2 = -2 * math.log(1 - min(recall, 1 - 1e-12)) * (2 - 2 * threshold) / about["least"]
    sample = classes.orderBy(F.xxhash64("rep"), "rep").limit(sample_rows).select("embedding").toPandas()["embedding"]
    x = np.stack([np.asarray(v) for v in sample])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    books = classes.sparkSession.sparkContext.broadcast((codebook(x[:, :d // 2], k), codebook(x[:, d // 2:], k)))

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for part in np.array_split(np.arange(len(b)), len(b) // 2000 + 1):
                if not len(part):
                    continue
                rows = b.iloc[part]
                v = np.stack([np.asarray(e) for e in rows["embedding"]])
                home, cells = visits(v / np.linalg.norm(v, axis=1, keepdims=True), books.value, reach2)
                yield pd.DataFrame({"label": rows["label"].to_numpy(), "rep": rows["rep"].to_numpy(), "size": rows["size"].to_numpy(),
                                    "vec": [e.tobytes() for e in v], "home": home, "cells": cells})

    placed = cut_lineage(
        classes.mapInPandas(place, "label string, rep long, size long, vec binary, home long, cells array<long>")
    )
    n_cells = k * k

    def unit(rows: pd.DataFrame) -> np.ndarray:
        v = np.frombuffer(b"".join(rows["vec"])).reshape(len(rows), -1)
        return v / np.linalg.norm(v, axis=1, keepdims=True)

    def kernel(q: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if q.empty or y.empty:
            return pd.DataFrame({"a": [], "b": [], "n": []})
        ids, others = q["rep"].to_numpy(), y["rep"].to_numpy()
        links = (unit(q) @ unit(y).T >= threshold) & (ids[:, None] != others[None, :])
        n = links @ y["size"].to_numpy()
        i, j = np.nonzero(links)
        seen = np.concatenate([np.zeros(0, np.int64), *(t * n_cells + np.asarray(c) for t, c in enumerate(y["cells"]))])
        missed = ~np.isin(j * n_cells + q["home"].to_numpy()[i], seen)  # y itself doesn't visit q's cell
        back = np.bincount(j[missed], q["size"].to_numpy()[i[missed]], minlength=len(y)).astype(np.int64)
        rows, cols = forest(links)
        a, b = np.concatenate([ids[rows >= 0], others[cols >= 0]]), others[np.concatenate([rows[rows >= 0], cols[cols >= 0]])]
        counted = pd.DataFrame({"a": np.concatenate([ids[n > 0], others[back > 0]]), "n": np.concatenate([n[n > 0], back[back > 0]])})
        edges = pd.DataFrame({"a": a, "b": b, "n": 0})[a != b]
        return pd.concat([counted.assign(b=pd.NA)[["a", "b", "n"]], edges]).astype({"a": "Int64", "b": "Int64", "n": "Int64"})

    index = placed.withColumn("cell", F.col("home"))
    probes = placed.withColumn("cell", F.explode("cells"))
    found = cut_lineage(over_block_pairs(probes.drop("cells").withColumn("cells", F.lit(None).cast("array<long>")), index, ["label", "cell"],
                                         ["rep"], ["rep"], block_rows, block_rows, kernel, "a long, b long, n long"))
    copies = classes.filter("size > 1").select(F.col("rep").alias("a"), (F.col("size") - 1).alias("n"))
    counts = found.filter("b IS NULL").select("a", "n").unionByName(copies).groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("links"))
    component = connected_components(found.filter("b IS NOT NULL"), "a", "b").withColumnRenamed("node", "rep")
    return cut_lineage(counts.join(component, "rep", "left"))
