"""Quality by nearest-neighbour voting in a latent semantic space.

A text becomes two blocks of terms: hashed words (tf-idf) and marks of its form (word shapes, punctuation, repetition). A truncated SVD of a
bounded sample of labelled texts gives the latent space. The sample's vectors are broadcast, each document's cosine with all
of them is computed exactly, in blocks, and the nearest vote with their similarity.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import label_sample, slices
from spliceweave.session import ship_package

BUCKETS, FORMS = 4096, 512
_RUNS = (re.compile("[A-Z]+"), re.compile("[a-z]+"), re.compile("[0-9]+"), re.compile(r"[^\x00-\x7f]+"))


def held_out(doc_id: Column) -> Column:
    """True for rows whose labels are never learnt from: crc32 of the id as text is 0 modulo 5; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(5)) == 0, F.lit(False))


def _shape(word: str) -> str:
    for mark, run in zip("Xx9u", _RUNS, strict=True):
        word = run.sub(mark, word)
    return word[:8]


class Terms(dict):
    """Word -> (word bucket, form bucket), remembered."""

    def __missing__(self, word: str) -> tuple[int, int]:
        out = (
            xxhash.xxh64_intdigest(word.strip(".,;:!?").lower().encode("utf-8", "replace")) % BUCKETS,
            32 + xxhash.xxh64_intdigest(_shape(word).encode("utf-8", "replace")) % (FORMS - 32),
        )
        if len(self) < 100_000 and len(word) <= 64:
            self[word] = out
        return out


def features(text: str, memory: Terms) -> tuple[np.ndarray, np.ndarray]:
    """Term ids (words below BUCKETS, forms from there on) and values. Forms hold shares, so length doesn't matter to them.

    Forms 0..31: ten steps each of the share of words equal to the one before, of repeated word pairs and of distinct words.
    """
    words = text.split()
    if not words:
        return np.zeros(0, np.int64), np.zeros(0)
    counts = Counter(words)
    ids = np.array([memory[w] for w in counts], np.int64)
    n = np.fromiter(counts.values(), np.float64, len(counts))
    pairs = Counter(zip(words, words[1:], strict=False))
    total = max(len(words) - 1, 1)
    shares = (
        sum(c for (x, y), c in pairs.items() if x == y) / total,
        sum(c for c in pairs.values() if c > 1) / total,
        len(counts) / len(words),
    )
    marks = np.array([10 * i + min(int(10 * s), 9) for i, s in enumerate(shares)])
    at = np.concatenate([ids[:, 0], BUCKETS + ids[:, 1], BUCKETS + marks])
    value = np.concatenate([1 + np.log(n), n / len(words), [0.5] * len(marks)])
    where, inverse = np.unique(at, return_inverse=True)
    return where, np.bincount(inverse, value)


@dataclass
class Model:
    """Latent space, and the labelled vectors in it."""

    idf: np.ndarray
    project: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float


def weighted(where: np.ndarray, value: np.ndarray, idf: np.ndarray, form_weight: float = 2.0) -> np.ndarray:
    """Term values with both blocks at unit length, forms counting ``form_weight`` times."""
    out = value * idf[where]
    form = where >= BUCKETS
    for block, w in ((~form, 1.0), (form, form_weight)):
        out[block] *= w / max(np.sqrt((out[block] ** 2).sum()), 1e-12)
    return out


def fit(docs: DataFrame, labels: DataFrame, max_labels: int = 4000, dims: int = 64) -> Model | None:
    """Model from at most ``max_labels`` labelled rows outside the held-out fold, chosen by a hash of doc_id. None without any."""
    ship_package(docs.sparkSession)
    sample = label_sample(labels, "quality", ~held_out(F.col("doc_id")), max_labels)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        memory = Terms()
        for b in batches:
            rows = [features(t or "", memory) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "label": b["label"], "ids": [i for i, _ in rows], "values": [v for _, v in rows]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = (
        rows.join(F.broadcast(sample), "doc_id")  # at most max_labels rows
        .mapInPandas(kernel, "doc_id long, label int, ids array<long>, values array<double>").toPandas().sort_values("doc_id", kind="stable")
    )
    found = found[found["ids"].map(len) > 0].drop_duplicates("doc_id")
    if found.empty:
        return None
    n, width = len(found), BUCKETS + FORMS
    df = np.bincount(np.concatenate(list(found["ids"])), minlength=width)
    idf = np.log((n + 1) / (df + 1)) + 1
    dense = np.zeros((n, width), np.float32)
    for i, (ids, values) in enumerate(zip(found["ids"], found["values"], strict=True)):
        dense[i, ids] = weighted(np.asarray(ids), np.array(values), idf)
    k = min(dims, n)
    basis = np.linalg.qr(dense.T @ np.random.default_rng(7).standard_normal((n, min(k + 16, n))).astype(np.float32))[0]
    for _ in range(4):
        basis = np.linalg.qr(dense.T @ (dense @ basis))[0]
    _, _, right = np.linalg.svd(dense @ basis, full_matrices=False)
    project = (basis @ right[:k].T).astype(np.float32)
    vectors = dense @ project
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    label = found["label"].to_numpy(np.float32)
    return Model(idf, project, vectors.astype(np.float32), label, float(label.mean()))


def vote(latent: np.ndarray, model: Model, neighbours: int, block: int = 512) -> np.ndarray:
    """Share of label 1 among the nearest labelled vectors, weighted by similarity; the prior for a vector of zeros."""
    out = np.full(len(latent), model.prior)
    k = min(neighbours, len(model.labels))
    size = np.linalg.norm(latent, axis=1)
    for lo in range(0, len(latent), block):
        part = latent[lo:lo + block] / np.maximum(size[lo:lo + block, None], 1e-9)
        cosine = part @ model.vectors.T
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 0) ** 4 + 1e-9
        out[lo:lo + block] = (weight * model.labels[near]).sum(axis=1) / weight.sum(axis=1)
    return np.where(size > 1e-9, np.clip(out, 0, 1), model.prior)


def score_quality(docs: DataFrame, model: Model | None, neighbours: int = 25) -> DataFrame:
    """(doc_id, score double) for every row; score is 0 to 1, higher where label 1 is likelier.

    Only the text is looked at. Null and empty texts get the share of label 1 in the sample, and without labelled rows every text
    gets 0.5. Rows are kept one to one; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(model)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory, m = Terms(), held.value
        for b in slices(batches, 512):
            texts = b.column(1).to_pylist()
            if m is None:
                score = np.full(len(texts), 0.5)
            else:
                latent = np.zeros((len(texts), m.project.shape[1]), np.float32)
                for i, t in enumerate(texts):
                    where, value = features(t or "", memory)
                    if len(where):
                        latent[i] = weighted(where, value, m.idf).astype(np.float32) @ m.project[where]
                score = vote(latent, m, neighbours)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(score, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, score double")
