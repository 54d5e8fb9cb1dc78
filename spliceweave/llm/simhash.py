"""SimHash near-duplicates by the generalised pigeonhole principle.

A fingerprint's 64 bits are grouped into partitions of correlated bits. If the thresholds t of m partitions add up to
``max_bits - m + 1``, two fingerprints within ``max_bits`` differ by at most t in one partition at least, so it is enough to
probe each partition within its own threshold (-1: not at all) and to verify what meets. The number of partitions and the
thresholds are chosen by dynamic programming on candidate counts, which come from bit statistics of all fingerprints.

Work is done on distinct fingerprints. Buckets of up to ``bucket_rows`` fingerprints are joined; larger ones are cut
into block pairs whose kernel returns a spanning forest of the links it finds, so a dense group never turns into all its pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import forest, only_names, popcount_links, shingle_hashes, slices, split_by_ids, text_windows
from spliceweave.llm.jaccard import jaccard_groups
from spliceweave.operators.blocks import over_block_pairs
from spliceweave.operators.components import connected_components
from spliceweave.session import cut_lineage, ship_package

BITS, ATOM = 64, 8
LANES = np.uint64(0x0101010101010101)


def _majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Fingerprints of runs of hashes that begin at ``starts``; eight bit counters share a word, so runs are cut at 255."""
    ends = np.append(starts[1:], len(hashes))
    pieces = np.concatenate([np.arange(a, b, 255) for a, b in zip(starts, ends, strict=True)])
    owner = np.searchsorted(starts, pieces, side="right") - 1
    first = np.searchsorted(owner, np.arange(len(starts)))
    out = np.zeros(len(starts), np.uint64)
    half = (ends - starts)[:, None]
    for shift in range(8):
        packed = np.add.reduceat((hashes >> np.uint64(shift)) & LANES, pieces)
        counts = np.add.reduceat(packed.view(np.uint8).reshape(-1, 8).astype(np.int64), first)
        bits = (2 * counts > half).astype(np.uint8)
        out |= np.ascontiguousarray(bits).view(np.uint64)[:, 0] << np.uint64(shift)
    return out


def text_fingerprints(texts: list[str | None], width: int) -> np.ndarray:
    """SimHash of each text; zero for a text without words.

    Hashes of the batch are counted together once there are about a million; a longer text is counted window by window.
    """
    out = np.zeros(len(texts), np.uint64)
    held: list[np.ndarray] = []
    place: list[int] = []

    def flush() -> None:
        if held:
            sizes = np.array([len(h) for h in held])
            out[place] = _majority(np.concatenate(held), np.cumsum(sizes) - sizes)
            held.clear()
            place.clear()

    size = 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if len(data) <= 1 << 20:
            if len(h := shingle_hashes(data.split(), width)):
                held.append(h)
                place.append(i)
                size += len(h)
                if size > 1_000_000:
                    flush()
                    size = 0
            continue
        counts, total = np.zeros(BITS, np.int64), 0
        for words, last in text_windows(data, width - 1):
            if len(words) < width and (total or not last):
                continue
            h = shingle_hashes(words, width)
            total += len(h)
            counts += np.array([int(((h >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(BITS)])
        out[i] = sum(1 << b for b in range(BITS) if 2 * counts[b] > total)
    flush()
    return out


def fingerprints(docs: DataFrame, width: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp long) of every row, whatever its other columns; a null text counts as empty (fingerprint 0)."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 1024):
            fp = text_fingerprints(b.column(1).to_pylist(), width)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(kernel, "id long, fp long")


@dataclass(frozen=True)
class Plan:
    """Bit masks of the partitions and the threshold of each (-1: not probed)."""

    masks: tuple[int, ...]
    thresholds: tuple[int, ...]


def _bit_pairs(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints with both bits set, over all rows; each task returns one matrix."""
    ship_package(fps.sparkSession)

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((BITS, BITS))
        for b in batches:
            for part in np.array_split(b["fp"].to_numpy(), len(b) // 100_000 + 1):
                bits = np.unpackbits(np.ascontiguousarray(part).view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float32)
                total += bits.T @ bits
        i, j = np.indices(total.shape)
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total.ravel()})

    rows = fps.mapInPandas(kernel, "i int, j int, n double").groupBy("i", "j").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros((BITS, BITS))
    out[rows["i"], rows["j"]] = rows["n"]
    return out


def correlated_atoms(pairs: np.ndarray, n: int) -> list[list[int]]:
    """Eight groups of eight bits: each starts at the most correlated free bits and takes what correlates most with it."""
    p = np.diag(pairs) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((pairs / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd))
    np.fill_diagonal(corr, 0)
    free, atoms = list(range(BITS)), []
    while free:
        sub = corr[np.ix_(free, free)]
        atom = [free[int(np.unravel_index(sub.argmax(), sub.shape)[0])]]
        while len(atom) < ATOM:
            rest = [b for b in free if b not in atom]
            atom.append(max(rest, key=lambda b: (corr[b, atom].sum(), -b)))
        atoms.append(sorted(atom))
        free = [b for b in free if b not in atom]
    return atoms


def _atom_distances(fps: DataFrame, atoms: list[list[int]]) -> np.ndarray:
    """For each atom the share of fingerprint pairs at distance 0..8, exactly, from value counts of all rows."""

    def kernel(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(atoms), 1 << ATOM))
        for b in batches:
            fp = b["fp"].to_numpy().view(np.uint64)
            for a, bits in enumerate(atoms):
                value = sum((((fp >> np.uint64(x)) & np.uint64(1)) << np.uint64(k) for k, x in enumerate(bits)), np.uint64(0))
                total[a] += np.bincount(value.astype(np.int64), minlength=1 << ATOM)
        a, v = np.indices(total.shape)
        yield pd.DataFrame({"a": a.ravel(), "v": v.ravel(), "n": total.ravel()})

    rows = fps.mapInPandas(kernel, "a int, v int, n double").groupBy("a", "v").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(atoms), 1 << ATOM))
    counts[rows["a"], rows["v"]] = rows["n"]
    share = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
    v = np.arange(1 << ATOM)
    apart = np.bitwise_count(v[:, None] ^ v[None, :])
    return np.array([[(s[:, None] * s[None, :])[apart == d].sum() for d in range(ATOM + 1)] for s in share])


def choose_plan(atoms: list[list[int]], distances: np.ndarray, n: int, max_bits: int,
                row_cost: float = 1.0, pair_cost: float = 0.05) -> Plan:
    """Partition count and thresholds of least cost: rows that are shuffled and candidate pairs that are verified.

    A partition is a run of atoms; its pair distances are the convolution of theirs. Thresholds are allocated by dynamic
    programming over (partition, sum so far).
    """
    best: tuple[float, Plan] | None = None
    for m in range(1, len(atoms) + 1):
        goal = max_bits - m + 1
        if goal < -m:
            continue
        options = []
        for part in np.array_split(np.arange(len(atoms)), m):
            spread = np.array([1.0])
            for a in part:
                spread = np.convolve(spread, distances[a])
            bits = sum((atoms[a] for a in part), [])
            cost = {-1: 0.0}
            for t in range(max_bits + 1):
                probes = sum(comb(len(bits), d) for d in range(t + 1))
                cost[t] = row_cost * n * (1 + probes) + pair_cost * n * n / 2 * spread[:t + 1].sum()
            options.append((sum(1 << b for b in bits), cost))
        reach: dict[int, tuple[float, tuple[int, ...]]] = {0: (0.0, ())}
        for _, cost in options:
            step: dict[int, tuple[float, tuple[int, ...]]] = {}
            for total, (spent, chosen) in reach.items():
                for t, c in cost.items():
                    if total + t not in step or spent + c < step[total + t][0]:
                        step[total + t] = (spent + c, (*chosen, t))
            reach = step
        if goal in reach and (best is None or reach[goal][0] < best[0]):
            best = (reach[goal][0], Plan(tuple(mask for mask, _ in options), reach[goal][1]))
    return best[1]


def make_plan(fps: DataFrame, n: int, max_bits: int, least_rows: int = 2_000_000) -> Plan:
    """Plan for the distinct fingerprints ``fps`` (column fp). Tables under ``least_rows`` are planned as if they had
    that many, so that work grows with the table and not by changes of plan."""
    atoms = correlated_atoms(_bit_pairs(fps), n)
    return choose_plan(atoms, _atom_distances(fps, atoms), max(n, least_rows), max_bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _flips(mask: int, most: int) -> list[int]:
    bits = [b for b in range(BITS) if mask >> b & 1]
    return [_signed(sum(1 << b for b in c)) for d in range(most + 1) for c in combinations(bits, d)]


def link_fingerprints(fps: DataFrame, plan: Plan, max_bits: int, bucket_rows: int = 128, block_rows: int = 2048) -> DataFrame:
    """(a, b): links that span the same components as all pairs of ``fps`` within ``max_bits``.

    ``fps`` has node and fp. All links of buckets of up to ``bucket_rows`` nodes come out; of larger buckets a spanning
    forest per block pair.
    """
    ship_package(fps.sparkSession)
    used = [(i, m, t) for i, (m, t) in enumerate(zip(plan.masks, plan.thresholds, strict=True)) if t >= 0]
    fp = F.col("fp")
    entry = [F.struct(F.lit(i).alias("part"), fp.bitwiseAND(F.lit(_signed(m))).alias("key")) for i, m, _ in used]
    index = fps.select("node", "fp", F.inline(F.array(*entry)))

    def probe(i: int, m: int, t: int) -> Column:
        key = fp.bitwiseAND(F.lit(_signed(m)))
        return F.transform(F.array(*[F.lit(e) for e in _flips(m, t)]), lambda e: F.struct(F.lit(i).alias("part"), key.bitwiseXOR(e).alias("key")))

    probes = fps.select("node", "fp", F.inline(F.flatten(F.array(*[probe(*x) for x in used])))) if any(t for _, _, t in used) else index
    bucket = ["part", "key"]
    hot = cut_lineage(index.groupBy(*bucket).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > bucket_rows).select(*bucket))
    crowded = not hot.isEmpty()
    left, right = (x.join(hot, bucket, "left_anti") if crowded else x for x in (probes, index))
    links = (
        left.select(F.col("node").alias("a"), F.col("fp").alias("fa"), *bucket)
        .join(right.select(F.col("node").alias("b"), F.col("fp").alias("fb"), *bucket), bucket)
        .filter((F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= max_bits)).select("a", "b")
    )
    if not crowded:
        return links

    def kernel(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if x.empty or y.empty:
            return pd.DataFrame({"a": [], "b": []})
        near = popcount_links(x["fp"].to_numpy().view(np.uint64), y["fp"].to_numpy().view(np.uint64), max_bits)
        rows, cols = forest(near)
        p, q = x["node"].to_numpy(), y["node"].to_numpy()
        a, b = np.concatenate([p[rows >= 0], q[cols >= 0]]), q[np.concatenate([rows[rows >= 0], cols[cols >= 0]])]
        return pd.DataFrame({"a": a, "b": b})[a != b]

    def crowd(x: DataFrame) -> DataFrame:
        return cut_lineage(x.join(hot, bucket, "left_semi"))

    dense = over_block_pairs(crowd(probes), crowd(index), bucket, ["node"], ["node"], block_rows, block_rows, kernel, "a long, b long")
    return links.unionByName(dense)


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp, component_id) for every row of ``docs``; component_id is the smallest id that links reach.

    Fingerprints link within ``max_bits``. Null texts count as empty; texts without words share fingerprint 0 and so one
    component. Rows with a null id take part and get the smallest id of their component (null if all are null); repeated rows
    stay repeated. Other columns are ignored. An empty table gives an empty result.
    """
    rows = cut_lineage(fingerprints(docs, width, id_col, text_col).withColumn("node", F.col("fp")))
    classes = cut_lineage(rows.groupBy("node", "fp").agg(F.min("id").alias("first_id")))
    n = classes.count()
    if n < 2:
        named = classes.select("node", F.col("first_id").alias("component_id"))
    else:
        links = link_fingerprints(classes.select("node", "fp"), make_plan(classes, n, max_bits), max_bits)
        nodes = connected_components(links, "a", "b")
        member = cut_lineage(
            classes.select("node", "first_id").join(nodes, "node", "left")
            .select("node", "first_id", F.coalesce("component", "node").alias("component"))
        )
        first = member.groupBy("component").agg(F.min("first_id").alias("component_id"))
        named = cut_lineage(member.join(first, "component").select("node", "component_id"))
    return rows.join(named, "node", "left").select("id", "fp", "component_id")


def near_groups(docs: DataFrame, similarity: float = 0.8, max_bits: int = 3, block_rows: int = 1024) -> DataFrame:
    """(id, text_hash, component) of every different (doc_id, text): groups of ``drop_near_duplicates``."""
    def sketch(hashes: np.ndarray) -> int:
        return int(_majority(hashes, np.zeros(1, np.int64))[0]) if len(hashes) else 0

    def links(fps: DataFrame) -> DataFrame:
        n = fps.count()
        return link_fingerprints(fps, make_plan(fps, n, max_bits), max_bits) if n > 1 else fps.select(F.col("node").alias("a"), F.col("node").alias("b")).limit(0)

    return jaccard_groups(docs, sketch, links, similarity, block_rows)


def drop_near_duplicates(docs: DataFrame, similarity: float = 0.8, max_bits: int = 3) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: that with the smallest doc_id, then the smallest text hash.

    Groups link documents whose sets of five-word shingles have a Jaccard similarity of ``similarity`` or more, computed on the
    full sets (``jaccard.py``). Candidates come from two sides: SimHash fingerprints of these sets within ``max_bits``, found as in
    ``near_duplicates``, and keys of minima, since fingerprints alone miss pairs near the limit. Documents with null doc_id count last. Repeated rows
    of one doc_id and text are for the exact stage: they share their fate here. Null texts count as empty, and texts without words are copies of
    each other. All columns stay as they are; an empty table stays empty. Only rows that may go are shuffled again.
    """
    rows = near_groups(docs, similarity, max_bits)
    first = rows.groupBy("component").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("id").isNull(), "id", "text_hash")).alias("first"))
    drop = cut_lineage(
        rows.join(cut_lineage(first.filter("n > 1")), "component")
        .filter(~(F.col("id").eqNullSafe(F.col("first.id")) & (F.col("text_hash") == F.col("first.text_hash"))))
        .select("id", F.col("text_hash").alias("drop_hash"))
    )
    suspects, others = split_by_ids(only_names(docs, ("doc_id", "text")), "doc_id", drop.select("id"))
    gone = F.col("doc_id").cast("long").eqNullSafe(F.col("id")) & (F.xxhash64(F.col("text").cast("string")) == F.col("drop_hash"))
    return others.unionByName(suspects.join(drop, gone, "left_anti")).toDF(*docs.columns)


def hex_fingerprint(c: str = "fp") -> Column:
    return F.lpad(F.lower(F.hex(F.col(c))), 16, "0")
