"""Importance resampling towards a target distribution, with bit-sliced weights.

Word runs are hashed into buckets. A document's bucket counts become bit planes, one bit a bucket: plane k holds bit k of every
count. The buckets' gains (scaled log ratios of target and corpus shares, as integers) become planes as well, of positive and negative
gains apart. The sum of count times gain is then the sum over pairs of planes of a power of two times the bits set in both, which is exact.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceweave.llm.common import byte_slices, id_digest, digest_word, text_windows
from spliceweave.session import cut_lineage, ship_package

BUCKETS, ORDER, SCALE = 10_000, 2, 1000
#: Bytes of words: digits, letters in lower case, all beyond ASCII. Everything else becomes a space.
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
_GUMBEL = 1 << 32


def feature_counts(text: str | None, order: int = ORDER, buckets: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket counts of all runs of 1 to ``order`` words; read in windows, so a text may be of any length."""
    n, carry, counts = 0, 0, np.zeros(buckets, np.int64)
    data = (text or "").encode("utf-8", "surrogatepass").translate(_WORDS)
    for words, _ in text_windows(data, order - 1):
        n += len(words) - carry
        codes = list(map(crc32, words))
        spaced = [b" " + w for w in words]
        for k in range(order):
            if k:  # a run's CRC goes on from that of the run without its last word
                codes = list(map(crc32, spaced[k:], codes))
            fresh = codes[max(carry - k, 0):]
            if fresh:
                counts += np.bincount(np.array(fresh, np.int64) % buckets, minlength=buckets)
        carry = min(order - 1, len(words))
    return n, counts


def count_features(docs: DataFrame, keep: Sequence[str] = (), text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """The ``keep`` columns, n_words, n_features and the filled buckets and their counts (packed uint16 and uint32) of every row."""
    ship_package(docs.sparkSession)
    k = len(keep)
    names = [*keep, "n_words", "n_features", "buckets", "counts"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, k, 1 << 22):
            n_words, n_features, where, how_many = [], [], [], []
            for text in b.column(k).to_pylist():
                n, counts = feature_counts(text, order, buckets)
                filled = np.flatnonzero(counts)
                n_words.append(n)
                n_features.append(int(counts.sum()))
                where.append(filled.astype("<u2").tobytes())
                how_many.append(counts[filled].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k], pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()), pa.array(where, pa.binary()),
                 pa.array(how_many, pa.binary())], names=names)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:k])
    return rows.mapInArrow(kernel, kept + "n_words bigint, n_features bigint, buckets binary, counts binary")


def bucket_totals(counted: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Sum of all rows' counts for each bucket; a task adds up its rows, so ``buckets`` rows of it are shuffled at most."""

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            for at in range(0, len(b), 512):
                part = b.slice(at, 512)
                where = np.frombuffer(b"".join(part.column(0).to_pylist()), "<u2").astype(np.int64)
                total += np.bincount(where, np.frombuffer(b"".join(part.column(1).to_pylist()), "<u4"), buckets).astype(np.int64)
        filled = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(filled, pa.int32()), pa.array(total[filled], pa.int64())], names=["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    summed = counted.select("buckets", "counts").mapInArrow(kernel, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    for r in summed.collect():  # one number a bucket
        out[r.bucket] = r.n
    return out


def gains(target: np.ndarray, corpus: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Scaled logarithm of target share over corpus share of each bucket, with one added to every count, rounded down."""
    s_all, t_all, k = float(corpus.sum()), float(target.sum()), len(corpus)
    return np.array([
        math.floor(scale * math.log((float(t) + 1) * (s_all + k) / ((float(s) + 1) * (t_all + k)))) for t, s in zip(target, corpus, strict=True)
    ], np.int64)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """(planes, rows, words): bit k of every number of ``values`` (rows x buckets, not negative) in plane k."""
    planes = max(int(values.max(initial=0)).bit_length(), 1)
    wide = -(-values.shape[1] // 64) * 8
    out = np.zeros((planes, len(values), wide), np.uint8)
    for k in range(planes):
        packed = np.packbits(((values >> k) & 1).astype(np.uint8), axis=1)
        out[k, :, :packed.shape[1]] = packed
    return out.view(np.uint64)


def gain_planes(gain: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(planes, words) of the gains' magnitudes and the signed power of two of each; positive gains first, then negative ones."""
    up, down = (bit_planes(np.maximum(sign * gain, 0)[None, :])[:, 0] for sign in (1, -1))
    powers = [1 << k for k in range(len(up))] + [-(1 << k) for k in range(len(down))]
    return np.concatenate([up, down]), np.array(powers, np.int64)


def sliced_sums(counts: np.ndarray, planes: np.ndarray, powers: np.ndarray) -> np.ndarray:
    """Exact sum of count times gain for each row of ``counts`` (rows x buckets)."""
    total = np.zeros(len(counts), np.int64)
    for k, plane in enumerate(bit_planes(counts)):
        some = np.flatnonzero(plane.any(axis=1))  # few rows have high bits
        for plane_g, power in zip(planes, powers, strict=True):
            total[some] += (int(power) << k) * np.bitwise_count(plane[some] & plane_g).sum(axis=1, dtype=np.int64)
    return total


def weigh(counted: DataFrame, gain: np.ndarray, seed: int = 7, id_col: str = "doc_id") -> DataFrame:
    """``counted`` without its counts, with weight (mean gain, rounded down; 0 without features) and score long.

    The score is the weight plus Gumbel noise from the digest of the id, so the highest scores are a draw without replacement.
    """
    ship_package(counted.sparkSession)
    buckets = len(gain)
    held = counted.sparkSession.sparkContext.broadcast(gain_planes(gain))
    others = [c for c in counted.columns if c not in ("buckets", "counts")]
    k, at = len(others), others.index("n_features")

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes, powers = held.value
        for batch in batches:
            for lo in range(0, len(batch), 64):
                b = batch.slice(lo, 64)
                counts = np.zeros((len(b), buckets), np.uint32)
                for i, (where, n) in enumerate(zip(b.column(k + 1).to_pylist(), b.column(k + 2).to_pylist(), strict=True)):
                    counts[i, np.frombuffer(where, "<u2")] = np.frombuffer(n, "<u4")
                sums, n = sliced_sums(counts, planes, powers), b.column(at).to_numpy()
                weight = np.where(n > 0, sums // np.maximum(n, 1), 0)
                noise = [math.floor(-SCALE * math.log(-math.log((h + 0.5) / _GUMBEL))) for h in b.column(k).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*b.columns[:k], pa.array(weight, pa.int64()), pa.array(weight + np.array(noise, np.int64), pa.int64())],
                    names=[*others, "weight", "score"])

    rows = counted.select(*[F.col(f"`{c}`") for c in others], digest_word(id_digest(seed, F.col(f"`{id_col}`")), 0).alias("__h"), "buckets", "counts")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:k])
    return rows.mapInArrow(kernel, f"{fields}, weight bigint, score bigint")


def rank_highest(rows: DataFrame, eligible, percent: int, id_col: str = "doc_id") -> DataFrame:
    """``rows`` (stored) with rank 1, 2, ... for the highest scores among the ``eligible`` ones, null for all others.

    ``percent`` of the eligible rows are drawn, rounded down; ties go to the smaller id. Score counts tell the cut, only rows from there
    on are sorted, and ranks are places in a sorted part plus the sizes of the parts before it.
    """
    ship_package(rows.sparkSession)
    able = F.coalesce(eligible, F.lit(False))
    scores = rows.filter(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))  # integers around 0: few different ones
    higher = Window.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    many = scores.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0] * percent // 100
    cut = scores.withColumn("before", F.coalesce(F.sum("n").over(higher), F.lit(0))).filter(F.col("before") < many).agg(F.min("score")).first()[0]
    if cut is None:
        return rows.withColumn("rank", F.lit(None).cast("long"))
    top = able & (F.col("score") >= cut)
    named = rows.columns

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for b in batches:
            places = pa.array(np.arange(at + 1, at + 1 + len(b)), pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([part] * len(b), pa.int32()), places], names=[*named, "__part", "__at"])
            at += len(b)

    order = [F.desc("score"), F.asc_nulls_last(f"`{id_col}`")]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    # rows that repeat score and id may lie in any order, so noise may deal them
    dealt = rows.filter(top).repartitionByRange(*order, F.xxhash64(*[F.col(f"`{c}`") for c in named])).sortWithinPartitions(*order)
    placed = cut_lineage(dealt.mapInArrow(number, f"{fields}, __part int, __at bigint"))
    parts = placed.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))  # one row a task
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__start"))
    rank = F.col("__start") + F.col("__at")
    drawn = placed.join(starts, "__part").select(*[F.col(f"`{c}`") for c in named], F.when(rank <= many, rank).alias("rank"))
    return drawn.unionByName(rows.filter(~top).withColumn("rank", F.lit(None).cast("long")))


def importance_resample(docs: DataFrame, target: DataFrame, percent: int = 25, min_words: int = 20, seed: int = 7, order: int = ORDER,
                        buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()) -> DataFrame:
    """The id, the ``keep`` columns, n_words, n_features, weight, score and rank of every row of ``docs``.

    Features are runs of 1 to ``order`` words of whole texts, hashed into ``buckets`` (65,536 at most) by CRC-32; null texts have none. Rows with
    ``min_words`` words or more may be drawn: ``percent`` of them, by the highest scores. Weights compare the texts of ``target`` with those
    of all ``docs``; without target texts all gains come from the corpus alone. Repeated rows count, and are drawn, one by one; rows without id share one
    draw of noise and come last among equal scores. Other columns are ignored; an empty table gives an empty result.
    """
    if not 0 < buckets <= 1 << 16:
        raise ValueError("buckets must be 1 to 65,536")
    kept = [id_col, *[c for c in keep if c != id_col]]
    counted = cut_lineage(count_features(docs, kept, text_col, order, buckets))
    gain = gains(bucket_totals(count_features(target, (), text_col, order, buckets), buckets), bucket_totals(counted, buckets))
    return rank_highest(cut_lineage(weigh(counted, gain, seed, id_col)), F.col("n_words") >= min_words, percent, id_col)
