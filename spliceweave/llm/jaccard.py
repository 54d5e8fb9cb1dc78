"""Groups of documents whose shingle sets reach a Jaccard similarity.

Candidates share one of ``BANDS`` keys, each of which names ``BAND_ROWS`` minima of the set under independent hash functions. A pair of
similarity s shares a key with probability 1 - (1 - s ** BAND_ROWS) ** BANDS, whatever the sizes and wherever the texts differ: for 48
keys of 6 minima it is missed with 5e-7 at 0.8 and less above. Keys only bring documents together: components of shared keys are
stars, not pairs, and within them the full sets decide, in blocks of bounded size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import shingle_hashes, slices, split_by_ids, text_windows
from spliceweave.operators.blocks import over_block_pairs
from spliceweave.operators.components import connected_components
from spliceweave.session import cut_lineage, ship_package

BANDS, BAND_ROWS = 48, 6
WIDTH = 5
_RNG = np.random.default_rng(42)
_SALTS = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 1 << 64, BANDS * BAND_ROWS, dtype=np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, BAND_ROWS), dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of all ``width``-word shingles; of the whole sequence of words if it is shorter."""
    parts: list[np.ndarray] = []
    for words, last in text_windows((text or "").encode("utf-8", "surrogatepass").lower(), width - 1):
        if len(words) < width and (parts or not last):
            continue
        parts.append(np.unique(shingle_hashes(words, width)))
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """The ``BANDS`` candidate keys of a shingle set; equal sets have equal keys."""
    low = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 256):
        np.minimum(low, ((hashes[at:at + 256, None] ^ _SALTS) * _FACTORS).min(axis=0), out=low)
    low ^= low >> np.uint64(31)
    return (low.reshape(BANDS, BAND_ROWS) * _MIX).sum(axis=1, dtype=np.uint64)


def set_rows(docs: DataFrame, sketch: Callable[[np.ndarray], int]) -> DataFrame:
    """(id, text_hash, node, fp, keys) of every row; node is the same for equal shingle sets, fp their ``sketch``."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = [shingle_set(t) for t in b.column(2).to_pylist()]
            node = np.array([xxhash.xxh64_intdigest(s.tobytes(), 42) for s in sets], np.uint64).view(np.int64)
            keys = np.array([band_keys(s) for s in sets]).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, BANDS, dtype=np.int32), keys.ravel())
            fp = np.array([sketch(s) for s in sets], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(node), pa.array(fp), lists], names=["id", "text_hash", "node", "fp", "keys"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return rows.mapInArrow(kernel, "id long, text_hash long, node long, fp long, keys array<long>")


def set_links(nodes: np.ndarray, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): nodes whose sets reach ``similarity``, spanning the same components as all such pairs.

    Each member found is compared with all that no component has yet, so every pair that could join two components is computed.
    """
    sizes = np.array([len(s) for s in sets])
    codes = np.unique(np.concatenate(sets), return_inverse=True)[1] if sizes.sum() else np.zeros(0, np.int64)
    begin = np.cumsum(sizes) - sizes
    mark = np.zeros(int(codes.max()) + 1 if len(codes) else 0, bool)
    left = np.arange(len(nodes))
    held, owner = codes, np.repeat(left, sizes)
    found_a, found_b = [], []
    queue: list[int] = []
    while len(left):
        if not queue:
            queue.append(int(left[0]))
            keep = owner != left[0]
            held, owner, left = held[keep], owner[keep], left[1:]
        p = queue.pop()
        mine = codes[begin[p]:begin[p] + sizes[p]]
        mark[mine] = True
        same = np.bincount(owner[mark[held]], minlength=len(nodes))[left]
        mark[mine] = False
        near = same >= similarity * (sizes[p] + sizes[left] - same) - 1e-9
        if near.any():
            new = left[near]
            found_a.append(np.full(len(new), nodes[p]))
            found_b.append(nodes[new])
            queue.extend(new.tolist())
            gone = np.zeros(len(nodes), bool)
            gone[new] = True
            left = left[~near]
            keep = ~gone[owner]
            held, owner = held[keep], owner[keep]
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *found_a]), np.concatenate([empty, *found_b])


def jaccard_groups(docs: DataFrame, sketch: Callable[[np.ndarray], int], sketch_links: Callable[[DataFrame], DataFrame],
                   similarity: float = 0.8, block_rows: int = 1024) -> DataFrame:
    """(id, text_hash, component) of every different (doc_id, text) of ``docs``; links are pairs of that similarity or more.

    Candidates are sets with an equal key or an equal ``sketch``, and those that ``sketch_links`` finds among the different sketches (node, fp).
    """
    rows = cut_lineage(set_rows(docs, sketch))
    keyed = rows.select("node", F.explode(F.array_append("keys", F.col("fp"))).alias("key")).repartition("key")
    shared = keyed.groupBy("key").agg(F.min("node").alias("a"), F.max("node").alias("z")).filter("a < z").select("key", "a")
    near = sketch_links(cut_lineage(rows.groupBy("fp").agg(F.min("node").alias("node")))).select("a", "b")
    stars = cut_lineage(keyed.join(shared, "key").filter("node != a").select("a", F.col("node").alias("b")).unionByName(near).distinct())
    different = rows.select("id", "text_hash", "node").distinct()
    if stars.isEmpty():
        return cut_lineage(different.select("id", "text_hash", F.col("node").alias("component")))
    member = connected_components(stars, "a", "b").select("node", F.col("component").alias("candidates"))
    chosen = cut_lineage(
        different.join(member, "node").groupBy("node", "candidates").agg(F.min(F.struct("id", "text_hash")).alias("one"))
        .select("node", "candidates", F.col("one.id").alias("id"), F.col("one.text_hash").alias("text_hash"))
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            values = pa.array([shingle_set(t).tobytes() for t in b.column(2).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), values], names=["candidates", "node", "shingles"])

    text = F.col("text").cast("string")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.xxhash64(text).alias("hash"), text.alias("text"))
    texts, _ = split_by_ids(texts, "doc", chosen.select("id"))
    met = texts.join(chosen, F.col("doc").eqNullSafe(F.col("id")) & (F.col("hash") == F.col("text_hash")))
    full = cut_lineage(met.select("candidates", "node", "text").mapInArrow(sets, "candidates long, node long, shingles binary"))

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty or x["__lb"].iloc[0] > x["__rb"].iloc[0]:  # the same two blocks meet the other way round
            return pd.DataFrame({"a": [], "b": []})
        both = pd.concat([x, y]).drop_duplicates("node")
        a, b = set_links(both["node"].to_numpy(np.int64), [np.frombuffer(v, np.uint64) for v in both["shingles"]], similarity)
        return pd.DataFrame({"a": a, "b": b})

    links = cut_lineage(over_block_pairs(full, full, ["candidates"], ["node"], ["node"], block_rows, block_rows, kernel, "a long, b long"))
    groups = connected_components(links, "a", "b")
    return cut_lineage(different.join(groups, "node", "left").select("id", "text_hash", F.coalesce("component", "node").alias("component")))
