"""Small helpers that the training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceweave.session import cut_lineage

SPACE = b" \t\n\x0b\x0c\r"
#: Java pattern of the white space that separates words.
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z only, whatever the locale."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def only_names(docs: DataFrame, used: Sequence[str]) -> DataFrame:
    """``docs`` with all columns but the ``used`` ones named by position, so that none clashes with names of a step."""
    return docs.toDF(*[c if c in used else f"_c{i}" for i, c in enumerate(docs.columns)])


def slices(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The same rows in short batches, so that few texts are Python objects at a time."""
    for b in batches:
        for at in range(0, len(b), rows):
            yield b.slice(at, rows)


def byte_slices(batches: Iterator[pa.RecordBatch], column: int, most: int = 1 << 24, rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes in the string ``column`` (or one longer row), ``rows`` at most."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(b):
            held = int(ends[at - 1]) if at else 0
            size = min(max(int(np.searchsorted(ends, held + most)) - at, 1), rows)
            yield b.slice(at, size)
            at += size


def id_digest(seed: int, doc_id: Column) -> Column:
    """Hex SHA-256 of ``seed:id``, the id in decimal (null: nothing); draws that depend on the id alone are taken from it."""
    return F.sha2(F.encode(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), "UTF-8"), 256)


def digest_word(digest: Column, i: int) -> Column:
    """The i-th group of eight hex digits as an unsigned integer."""
    return F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long")


def text_windows(data: bytes, overlap: int, size: int = 1 << 20) -> Iterator[tuple[list[bytes], bool]]:
    """Words of ``data`` in pieces of about ``size`` bytes, each with the last ``overlap`` words of the one before.

    Bounds the word objects alive at once, so a text of any length can be read. The flag is True for the last piece.
    """
    if len(data) <= size:
        yield data.split(), True
        return
    carry: list[bytes] = []
    start = 0
    while start < len(data):
        end = min(start + size, len(data))
        while end < len(data) and data[end] not in SPACE:
            step = data[end:end + 4096].split(None, 1)[0] if data[end:end + 4096].split() else b""
            end += max(len(step), 1)
        words = carry + data[start:end].split()
        yield words, end >= len(data)
        carry = words[-overlap:] if overlap else []
        start = end


def shingle_hashes(words: list[bytes], width: int) -> np.ndarray:
    """XXH64 (seed 42) of all runs of ``width`` words; of the whole sequence if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), 42)], np.uint64)
    runs = map(b" ".join, zip(*(words[i:] for i in range(width)), strict=False))
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(42)), np.uint64, len(words) - width + 1)


def split_by_ids(docs: DataFrame, id_col: str, wanted: DataFrame, bits: int = 1 << 26) -> tuple[DataFrame, DataFrame]:
    """``docs`` in two: rows whose id may be in ``wanted`` (column id), and rows whose id is not. No row is shuffled.

    A bitmap of hashed ids is broadcast, ``bits`` / 8 bytes (8 MB) at most whatever the tables. The more ids are wanted the more
    other rows come along; what is exact is only that no wanted row is left out.
    """
    place = lambda c: F.pmod(F.xxhash64(F.col(c).cast("long")), F.lit(bits)) + 1
    at = wanted.select(place("id").alias("at")).distinct()
    maps = cut_lineage(at.groupBy(F.bitmap_bucket_number("at").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("__map")))
    tagged = docs.withColumn("__at", place(id_col)).withColumn("__bucket", F.bitmap_bucket_number("__at"))
    met = tagged.join(F.broadcast(maps), "__bucket", "left")  # at most ``bits`` / 32768 rows of 4 KB
    spot = F.bitmap_bit_position("__at")
    byte = F.conv(F.hex(F.substring("__map", (F.floor(spot / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(F.getbit(byte, (spot % 8).cast("int")) == 1, F.lit(False))
    return tuple(met.filter(x).select(*[F.col(f"`{c}`") for c in docs.columns]) for x in (hit, ~hit))


def label_sample(labels: DataFrame, column: str, keep: Column, max_rows: int) -> DataFrame:
    """(doc_id, label) of at most ``max_rows`` labelled rows, chosen by a hash of doc_id; one row per doc_id.

    A doc_id with several labels counts as 1 if any of them is 1. Rows without doc_id or label are left out.
    """
    rows = (
        labels.filter(F.col("doc_id").isNotNull() & F.col(column).isNotNull() & keep)
        .groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(column)).cast("int").alias("label"))
    )
    total = rows.count()
    if total <= max_rows:
        return rows
    place = F.xxhash64("doc_id")
    if (share := 2 * max_rows / total) < 0.5:  # twice the rows wanted, so few rows are sorted whatever the table
        some = rows.filter(place < int(-(2.0**63) + share * 2.0**64))
        rows = some if some.count() >= max_rows else rows
    return rows.orderBy(place, "doc_id").limit(max_rows)


def popcount_links(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """Boolean matrix of 64-bit values that differ in at most ``most`` bits."""
    return np.bitwise_count(a[:, None] ^ b[None, :]) <= most


def forest(links: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Component labels (-1: no link) of the rows and columns of a bipartite link matrix.

    A label is the index of a column of the same component, so edges (node, column) span what the matrix links.
    """
    big = links.shape[1]
    cols = np.where(links.any(axis=0), np.arange(big), big)
    while True:
        rows = np.where(links, cols[None, :], big).min(axis=1)
        new = np.minimum(cols, np.where(links, rows[:, None], big).min(axis=0))
        if (new == cols).all():
            return np.where(rows < big, rows, -1), np.where(cols < big, cols, -1)
        cols = new
