"""Metacells per donor: neighbour graph, communities, centroids and quality scores."""

from __future__ import annotations

from collections import deque
from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spliceweave.operators.blocks import over_block_pairs
from spliceweave.operators.components import connected_components
from spliceweave.session import cut_lineage, drop_stage, ship_package

BLOCK = 8192
SLICE = 64
PAIRS = 1 << 16
GRAPH_BLOCK = 1 << 17


def _exact(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Euclidean distances of row ``i`` of ``a`` and row ``j`` of ``b`` from their differences, a bounded number of pairs at a time."""
    out = np.empty(len(i))
    for lo in range(0, len(i), PAIRS):
        gap = a[i[lo:lo + PAIRS]] - b[j[lo:lo + PAIRS]]
        out[lo:lo + PAIRS] = np.sqrt(np.einsum("ij,ij->i", gap, gap))
    return out


def _places(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``np.nonzero`` of a mask that is mostly empty: eight places at a time are looked at first."""
    flat = np.ascontiguousarray(mask).ravel()
    end = len(flat) // 8 * 8
    at = (np.flatnonzero(flat[:end].view(np.uint64))[:, None] * 8 + np.arange(8)).ravel()
    return np.divmod(np.concatenate([at[flat[at]], end + np.flatnonzero(flat[end:])]), mask.shape[1])


def _distances(a: np.ndarray, b: np.ndarray):
    """Euclidean distances of a few rows of ``a`` at a time against all of ``b`` by matrix products; small ones, where a product loses digits, from differences."""
    whole = np.isfinite(b).all(axis=1)  # a vector that isn't spoils no other one's distances
    middle = b[whole].mean(axis=0) if whole.any() else 0.0
    a, b = a - middle, b - middle
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    left, right = np.column_stack([-2.0 * a, aa, np.ones(len(a))]), np.column_stack([b, np.ones(len(b)), bb]).T.copy()
    for lo in range(0, len(a), SLICE):
        d = left[lo:lo + SLICE] @ right
        i, j = _places(d < (1e-4 * aa[lo:lo + SLICE, None] + 1e-300) + 1e-4 * bb[None, :])
        np.sqrt(np.maximum(d, 0.0, out=d), out=d)
        d[i, j] = _exact(a[lo:lo + SLICE], b, i, j)
        yield lo, d


def _stack(col) -> np.ndarray:
    return np.vstack(col.to_numpy()).astype(float)


def _kth_at_most(v: np.ndarray, k: int) -> np.ndarray:
    """A bound that ``k`` values of each row don't exceed: the k-th smallest of the minima of groups of columns, of which there are many times ``k``."""
    m = v.shape[1]
    if m < k:
        return np.full(len(v), np.inf, v.dtype)
    groups = max(128, 16 * k)
    deep = m // groups
    if deep > 1:
        v = np.concatenate([v[:, :deep * groups].reshape(len(v), deep, groups).min(axis=1), v[:, deep * groups:]], axis=1)
    return np.partition(v, k - 1, axis=1)[:, k - 1]


def _nearest_pairs(x: np.ndarray, y: np.ndarray, k: int, first: np.ndarray, last: np.ndarray):
    """(i, j, distance) of the ``k`` nearest rows of ``y`` of each row of ``x``, by distance and place; rows ``first`` up to ``last`` of ``y`` are left out.

    Single-precision products rule rows out, with a margin for all that their rounding can do; what is left is compared by exact distances.
    """
    middle = y.mean(axis=0)
    a, b = x - middle, y - middle
    far = max(np.abs(a).max(), np.abs(b).max(), 1e-300)
    a, b = a / far, b / far
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    left = np.column_stack([-2.0 * a, np.ones(len(a))]).astype(np.float32)
    right = np.column_stack([b, bb]).T.astype(np.float32, order="C")
    margin = 2.5 * (x.shape[1] + 4) * 2.0 ** -24 * (np.sqrt(aa) + np.sqrt(bb.max())) ** 2 + 1e-30
    for lo in range(0, len(a), SLICE):
        v = left[lo:lo + SLICE] @ right
        own, stop = first[lo:lo + SLICE], last[lo:lo + SLICE]
        for back in range(int((stop - own).max())):
            i = np.flatnonzero(own + back < stop)
            v[i, own[i] + back] = np.inf
        cut = np.nextafter((_kth_at_most(v, k) + margin[lo:lo + SLICE]).astype(np.float32), np.float32(np.inf))
        i, j = _places(v <= cut[:, None])
        i, j = (c[v[i, j] < np.inf] for c in (i, j))
        if len(i) > 8 * k * len(v):  # vectors of very unequal lengths: double precision rules out more
            sq = bb[j] - 2.0 * np.concatenate([np.einsum("ij,ij->i", a[lo + i[s:s + PAIRS]], b[j[s:s + PAIRS]]) for s in range(0, len(i), PAIRS)])
            order = np.lexsort((sq, i))
            kth = np.searchsorted(i, np.arange(len(v))) + k - 1
            most = sq[order][np.minimum(kth, len(i) - 1)]
            most[kth >= np.searchsorted(i, np.arange(len(v)), side="right")] = np.inf
            keep = sq <= (most + margin[lo:lo + SLICE] * 2.0 ** -28)[i]
            i, j = i[keep], j[keep]
        d = _exact(x[lo:lo + SLICE], y, i, j)
        order = np.lexsort((j, d, i))  # the smaller reference id first among equal distances
        i, j, d = i[order], j[order], d[order]
        keep = (np.arange(len(i)) - np.searchsorted(i, i) < k) & np.isfinite(d)
        yield i[keep] + lo, j[keep], d[keep]


def _nearest_kernel(k: int, skip_self: bool):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not (len(left) and len(right)):
            return pd.DataFrame()
        refs = right.sort_values("ref_id", ignore_index=True)
        x, y = _stack(left.pc), _stack(refs.pc)
        mine, theirs = np.isfinite(x).all(axis=1), np.isfinite(y).all(axis=1)
        if not (mine.any() and theirs.any()):
            return pd.DataFrame()
        cells, ids = left.cell_id.to_numpy()[mine], refs.ref_id.to_numpy()[theirs]
        first = np.searchsorted(ids, cells) if skip_self else np.zeros(len(cells), int)
        last = np.searchsorted(ids, cells, side="right") if skip_self else first
        i, j, d = (np.concatenate(c) for c in zip(*_nearest_pairs(x[mine], y[theirs], k, first, last), strict=True))
        return pd.DataFrame({"donor": np.repeat(left.donor.to_numpy()[:1], len(i)), "cell_id": cells[i], "ref_id": ids[j], "dist": d})

    return run


def nearest(cells: DataFrame, refs: DataFrame, k: int = 1, skip_self: bool = False, block: int = BLOCK) -> DataFrame:
    """The k nearest references of every cell of the same donor, exactly.

    ``cells`` (donor, cell_id, pc) and ``refs`` (donor, ref_id, pc). Work runs in bounded block
    pairs and every block keeps k per cell, so a large donor only means more blocks.
    Ties go to the smaller reference id.
    """
    types = {f.name: f.dataType.simpleString() for f in [*cells.schema.fields, *refs.schema.fields]}
    schema = f"donor {types['donor']}, cell_id {types['cell_id']}, ref_id {types['ref_id']}, dist double"
    found = over_block_pairs(
        cells.select("donor", "cell_id", "pc"), refs.select("donor", "ref_id", "pc"), ["donor"],
        ["cell_id"], ["ref_id"], block, 4 * block, _nearest_kernel(k, skip_self), schema)
    order = Window.partitionBy("donor", "cell_id").orderBy("dist", "ref_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_anywhere(cells: DataFrame, refs: DataFrame, k: int = 1, spread: int = 64, block: int = BLOCK) -> DataFrame:
    """``nearest`` without a donor key: cells are spread over groups and every group sees all references."""
    group = F.pmod(F.xxhash64("cell_id"), F.lit(spread)).cast("int")
    copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1)))
    found = nearest(cells.select(group.alias("donor"), "cell_id", "pc"), refs.select("ref_id", "pc", copies.alias("donor")), k, block=block)
    return found.drop("donor")


def knn(cells: DataFrame, n_neighbors: int, block: int = BLOCK) -> DataFrame:
    """(donor, cell_id, neighbour, dist, rank): ``n_neighbors`` counts the cell itself."""
    refs = cells.select("donor", F.col("cell_id").alias("ref_id"), "pc")
    return nearest(cells, refs, n_neighbors - 1, skip_self=True, block=block).withColumnRenamed("ref_id", "neighbour")


def centroids(cells: DataFrame, by: Sequence[str]) -> DataFrame:
    """Mean vector per group, one average per component (combined map-side)."""
    means = (
        cells.select(*by, F.posexplode("pc").alias("dim", "x"))
        .groupBy(*by, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    )
    return means.groupBy(*by).agg(F.transform(
        F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("pc"))


def calinski_harabasz(cells: DataFrame) -> DataFrame:
    """(donor, ch) from (donor, meta, pc): between over within variance, from sums only."""
    x = cells.select("donor", "meta", F.posexplode("pc").alias("dim", "x")).groupBy("donor", "meta", "dim").agg(
        F.count(F.lit(1)).alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count(F.lit(1))).alias("within"))
    whole = x.groupBy("donor", "dim").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("gm"))
    per = x.join(whole, ["donor", "dim"])
    gap = F.col("m") - F.col("gm")
    sums = per.groupBy("donor").agg(F.sum(F.col("n") * gap * gap).alias("b"), F.sum("within").alias("w"))
    sizes = cells.groupBy("donor", "meta").agg(F.count(F.lit(1)).alias("c")).groupBy("donor").agg(
        F.sum("c").alias("n"), F.count(F.lit(1)).alias("k"))
    return sums.join(sizes, "donor").select("donor", F.try_divide(
        F.col("b") * (F.col("n") - F.col("k")), F.col("w") * (F.col("k") - 1)).alias("ch"))


def _spread_kernel(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """Per cell and block: distances to the own metacell, the smallest mean to others that are whole here, and sums to parts of larger ones."""
    if left.empty or right.empty:
        return pd.DataFrame()
    right = right.sort_values("ref_meta", ignore_index=True)
    names, first = np.unique(right.ref_meta.to_numpy(), return_index=True)
    n, parts = right.n.to_numpy()[first].astype(float), right.parts.to_numpy()[first]
    out = []
    for lo, d in _distances(_stack(left.pc), _stack(right.pc)):
        cells = left.iloc[lo:lo + len(d)]
        sums = np.add.reduceat(d, first, axis=1)
        own = cells.meta.to_numpy()[:, None] == names[None, :]
        whole = np.where(own | (parts > 1)[None, :], np.inf, sums / n)
        base = cells[["donor", "cell_id"]]
        out.append(base.assign(a=np.where(own, sums, 0).sum(axis=1), b=whole.min(axis=1), other=None, total=0.0))
        for j in np.nonzero(parts > 1)[0]:
            out.append(base[~own[:, j]].assign(a=0.0, b=np.inf, other=names[j], total=sums[~own[:, j], j] / n[j]))
    return pd.concat(out)


def silhouette(cells: DataFrame, block: int = BLOCK) -> DataFrame:
    """(donor, silhouette): mean Euclidean silhouette, NULL for donors with one metacell.

    A metacell of up to ``block`` cells lies in one block and is reduced there, so about one row a cell and block is shuffled;
    larger ones are cut into parts whose sums are added.
    """
    cid = cells.schema["cell_id"].dataType.simpleString()
    base = cut_lineage(cells.select("donor", "cell_id", F.col("meta").cast("string").alias("meta"), "pc"))
    sizes = base.groupBy("donor", "meta").agg(F.count(F.lit(1)).alias("n")).withColumn("parts", F.ceil(F.col("n") / block))
    refs = base.join(sizes, ["donor", "meta"]).select(
        "donor", F.col("cell_id").alias("ref_id"), F.col("meta").alias("ref_meta"), "pc", "n", "parts",
        F.pmod(F.xxhash64("cell_id"), F.col("parts")).alias("part"))
    found = over_block_pairs(
        base, cut_lineage(refs), ["donor"], ["cell_id"], ["ref_meta", "part"], block, block, _spread_kernel,
        f"donor string, cell_id {cid}, a double, b double, other string, total double",
    ).groupBy("donor", "cell_id", "other").agg(F.sum("a").alias("a"), F.min("b").alias("b"), F.sum("total").alias("total"))
    per = found.groupBy("donor", "cell_id").agg(
        F.sum("a").alias("a"), F.min(F.when(F.col("other").isNull(), F.col("b")).otherwise(F.col("total"))).alias("b"))
    own = base.select("donor", "cell_id", "meta").join(sizes, ["donor", "meta"]).select("donor", "cell_id", "n")
    rows = per.join(own, ["donor", "cell_id"]).select(
        "donor", F.when(F.col("n") > 1, F.col("a") / (F.col("n") - 1)).alias("a"), F.when(F.col("b") < float("inf"), F.col("b")).alias("b"))
    value = F.when(F.col("b").isNotNull(), F.coalesce(
        F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return rows.groupBy("donor").agg(F.avg(value).alias("silhouette"))


STEPS = 16


def _best_moves(state: DataFrame, ties: DataFrame, total: DataFrame) -> DataFrame:
    """(donor, node, deg, comm, two_m, pick, more) of every node that would gain ``more`` by joining the neighbouring community ``pick``."""
    where = state.select("donor", F.col("node").alias("dst"), F.col("comm").alias("to_comm"))
    pull = ties.join(where, ["donor", "dst"]).select("donor", F.col("src").alias("node"), "to_comm", F.col("w").alias("k_in"))
    stay = state.select("donor", "node", F.col("comm").alias("to_comm"), F.lit(0.0).alias("k_in"))
    options = pull.unionByName(stay).groupBy("donor", "node", "to_comm").agg(F.sum("k_in").alias("k_in"))
    mass = state.groupBy("donor", F.col("comm").alias("to_comm")).agg(F.sum("deg").alias("mass"))
    here = F.col("to_comm") == F.col("comm")
    gain = F.col("k_in") - F.col("deg") * (F.col("mass") - F.when(here, F.col("deg")).otherwise(0.0)) / F.col("two_m")
    scored = options.join(state, ["donor", "node"]).join(mass, ["donor", "to_comm"]).join(total, "donor").withColumn("gain", gain)
    best = scored.groupBy("donor", "node", "deg", "comm", "two_m").agg(
        F.min(F.when(~here, F.struct(-F.round("gain", 9), F.col("to_comm").alias("pick"), F.col("gain")))).alias("top"),
        F.max(F.when(here, F.col("gain"))).alias("own"))
    return best.select("donor", "node", "deg", "comm", "two_m", "top.pick", (F.col("top.gain") - F.col("own")).alias("more")).filter("more > 1e-9")


def _safe_moves(moves: DataFrame, seed: int) -> DataFrame:
    """(donor, node, pick): moves that raise modularity together, whatever order they are made in.

    Moves are ordered by their gain a degree, in octaves, and by a seeded hash. The first move that touches a community makes it a giving or a
    receiving one, and only moves from giving to receiving communities count: no node enters a community that another one leaves. Two moves
    that share a community then lose at most the product of their degrees over ``two_m``, so a move stands if its gain exceeds that loss to all
    moves up to its place. The very first move of both its communities always stands. Sums are kept by place (a few hundred a community), so
    no community's moves are gathered.
    """
    octave = F.least(F.greatest(F.floor(-F.log2(F.col("more") / F.col("deg"))) + 8, F.lit(0)), F.lit(47))
    place = octave * STEPS + F.pmod(F.xxhash64(F.lit(seed), "node"), F.lit(STEPS))
    placed = moves.withColumn("place", place.cast("int"))
    turn = F.struct("place", (-F.col("more") / F.col("deg")).alias("slow"), "node")
    touched = F.inline(F.array(
        F.struct(F.col("comm").alias("c"), F.lit(False).alias("enters")), F.struct(F.col("pick").alias("c"), F.lit(True).alias("enters"))))
    both = placed.select("donor", "node", "deg", "two_m", "pick", "more", "place", turn.alias("turn"), touched)
    lead = both.groupBy("donor", "c").agg(F.min(F.struct("turn", "enters")).alias("lead")).select(
        "donor", "c", F.col("lead.turn.node").alias("leader"), F.col("lead.enters").alias("receives"))
    ends = F.collect_list(F.struct("c", (F.col("leader") == F.col("node")).alias("leads")))  # two at most
    free = cut_lineage(
        both.join(lead, ["donor", "c"]).filter(F.col("enters") == F.col("receives"))
        .groupBy("donor", "node", "pick", "deg", "two_m", "more", "place").agg(ends.alias("ends")).filter(F.size("ends") == 2))
    allowed = free.select("donor", "node", "pick", "deg", "two_m", "more", "place", F.inline("ends"))
    upto = Window.partitionBy("donor", "c").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    load = allowed.groupBy("donor", "c", "place").agg(F.sum("deg").alias("d")).select("donor", "c", "place", F.sum("d").over(upto).alias("load"))
    judged = allowed.join(load, ["donor", "c", "place"]).groupBy("donor", "node", "pick", "deg", "two_m", "more").agg(
        F.sum(F.col("load") - F.col("deg")).alias("load"), F.min("leads").alias("first"))
    return judged.filter(F.col("first") | (F.col("more") > F.col("deg") * F.col("load") / F.col("two_m") + 1e-9)).select("donor", "node", "pick")


def _settled(comm: np.ndarray, deg: np.ndarray, two_m: float, at: np.ndarray, other: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Communities after moves of one node after another until none gains. Nodes whose neighbours moved get another turn.

    ``at`` are the places where the neighbours ``other`` of each node begin, ``w`` their weights.
    """
    mass, comm, deg = np.bincount(comm, deg, comm.max() + 1).tolist(), comm.tolist(), deg.tolist()
    at, other, w = at.tolist(), other.tolist(), w.tolist()
    eager = True
    while eager:  # masses change for nodes that are no neighbours too, so a last turn of all nodes has to find nothing
        eager, queue, waiting = False, deque(range(len(deg))), [True] * len(deg)
        while queue:
            i = queue.popleft()
            waiting[i], own, d = False, comm[i], deg[i]
            near, pull = other[at[i]:at[i + 1]], {own: 0.0}
            for j, k in zip(near, w[at[i]:at[i + 1]], strict=True):
                c = comm[j]
                pull[c] = pull.get(c, 0.0) + k
            if len(pull) == 1:
                continue
            gain = {c: k - d * (mass[c] - (d if c == own else 0.0)) / two_m for c, k in pull.items()}
            least = gain[own] + 1e-9
            if max(gain.values()) <= least:
                continue
            pick = min(gain, key=lambda c: (-round(gain[c], 9), c))
            if gain[pick] > least:
                mass[own], mass[pick], comm[i], eager = mass[own] - d, mass[pick] + d, pick, True
                for j in near:
                    if not waiting[j] and comm[j] != pick:
                        waiting[j] = True
                        queue.append(j)
    return np.array(comm)


def _parts(comm: np.ndarray, at: np.ndarray, other: np.ndarray) -> np.ndarray:
    """The smallest node of each node's connected part of its community."""
    part, inside, at, other = np.full(len(comm), -1).tolist(), comm.tolist(), at.tolist(), other.tolist()
    for start in range(len(comm)):
        if part[start] < 0:
            part[start], stack = start, [start]
            while stack:
                i = stack.pop()
                for j in other[at[i]:at[i + 1]]:
                    if part[j] < 0 and inside[j] == inside[start]:
                        part[j] = start
                        stack.append(j)
    return np.array(part)


def _merged_in_block(comm: np.ndarray, deg: np.ndarray, src: np.ndarray, dst: np.ndarray, w: np.ndarray):
    """The block's graph with communities as nodes: their code of each node, degrees, and edges as begins, ends and weights."""
    _, code = np.unique(comm, return_inverse=True)
    k = code.max() + 1
    pair, at = np.unique(code[src] * k + code[dst], return_inverse=True)
    cs, cd, cw = pair // k, pair % k, np.bincount(at, w, len(pair))
    apart = cs != cd
    return code, np.bincount(code, deg, k), cs[apart], cd[apart], cw[apart]


def _move_in_block(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
    """(donor, node, pick) of the nodes that change community when nodes of one block move, and then its communities as nodes, until none gains.

    Communities lie in the block as a whole, so all gains are exact. If the block is the donor, communities that fell apart are cut as well, so
    nothing is left to do for it.
    """
    if nodes.empty or edges.empty:
        return pd.DataFrame({"donor": [], "node": [], "pick": []})
    nodes = nodes.sort_values("node", ignore_index=True)
    ids, deg, two_m, alone = nodes.node.to_numpy(), nodes.deg.to_numpy(float), float(nodes.two_m.iloc[0]), nodes.parts.iloc[0] == 1
    names = np.unique(np.concatenate([ids, nodes.comm.to_numpy()]))
    start = np.searchsorted(names, nodes.comm.to_numpy())
    src, dst, w = np.searchsorted(ids, edges.src.to_numpy()), np.searchsorted(ids, edges.dst.to_numpy()), edges.w.to_numpy(float)
    order = np.lexsort((dst, src))
    src, dst, w = src[order], dst[order], w[order]

    def begins(s, n):
        return np.searchsorted(s, np.arange(n + 1))

    at, comm = begins(src, len(ids)), start
    while True:
        comm = _settled(comm, deg, two_m, at, dst, w)
        before = comm
        while True:
            code, mass, cs, cd, cw = _merged_in_block(comm, deg, src, dst, w)
            label = np.empty(len(mass), int)
            label[code] = comm
            merged = _settled(np.arange(len(mass)), mass, two_m, begins(cs, len(mass)), cd, cw)
            if (merged == np.arange(len(mass))).all():
                break
            comm = label[merged[code]]
        changed = (comm != before).any()
        if alone:  # communities are named by their smallest node; the donor has no others
            count, comm = len(np.unique(comm)), np.searchsorted(names, ids)[_parts(comm, at, dst)]
            changed |= len(np.unique(comm)) > count
        if not changed:
            break
    moved = np.flatnonzero(comm != start)
    return pd.DataFrame({"donor": nodes.donor.to_numpy()[moved].tolist(), "node": ids[moved], "pick": names[comm[moved]]})


def _block_moves(state: DataFrame, ties: DataFrame, total: DataFrame, seed: int, block: int) -> DataFrame:
    """(donor, node, pick) of moves inside blocks of whole communities, dealt by a seeded hash; communities beyond ``block`` nodes sit out."""
    ship_package(state.sparkSession)
    sizes = state.groupBy("donor", "comm").agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") <= block).drop("__n")
    where = F.pmod(F.xxhash64(F.lit(seed), "comm"), F.col("parts")).cast("int").alias("blk")
    placed = state.join(sizes, ["donor", "comm"], "left_semi").join(total, "donor").select("donor", where, "node", "deg", "comm", "two_m", "parts")
    ends = placed.select("donor", "blk", "node")
    inner = (
        ties.join(ends.toDF("donor", "__a", "src"), ["donor", "src"]).join(ends.toDF("donor", "__b", "dst"), ["donor", "dst"])
        .filter("__a = __b").select("donor", "__a", "src", "dst", "w").toDF("donor", "blk", "src", "dst", "w"))
    kinds = {f.name: f.dataType.simpleString() for f in state.schema.fields}
    schema = f"donor {kinds['donor']}, node {kinds['node']}, pick {kinds['comm']}"

    def run(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        moved = _move_in_block(nodes.to_pandas(), edges.to_pandas())
        return pa.table({c: pa.array(moved[c].tolist(), nodes.schema.field(of).type) for c, of in (("donor", "donor"), ("node", "node"), ("pick", "comm"))})

    return placed.groupBy("donor", "blk").cogroup(inner.groupBy("donor", "blk")).applyInArrow(run, schema)


def _settle(flow: DataFrame, member: DataFrame, seed: int, block: int) -> tuple[DataFrame, bool]:
    """(donor, node, comm) after moves of single nodes until none gains, from ``member``; and whether any moved.

    Rounds take turns: nodes move inside blocks, then what is left to gain between blocks is done by moves that don't hinder each other. Donors of
    one block are done after the first turn; settled donors rest.
    """
    degree = flow.groupBy("donor", F.col("src").alias("node")).agg(F.sum("w").alias("deg"))
    state = cut_lineage(member.join(degree, ["donor", "node"]).select("donor", "node", "deg", "comm"))
    total = cut_lineage(state.groupBy("donor").agg(F.sum("deg").alias("two_m"), F.ceil(F.count(F.lit(1)) / block).alias("parts")))
    ties = flow.filter("src <> dst")  # loops hold weight inside a merged node: they count for degree, not for moves
    awake, moved, turn = total, False, 0
    large = total.filter("parts > 1")
    several = not large.isEmpty()

    def after(moves: DataFrame) -> DataFrame:
        return cut_lineage(state.join(moves, ["donor", "node"], "left").select("donor", "node", "deg", F.coalesce("pick", "comm").alias("comm")))

    while True:
        inside = cut_lineage(_block_moves(state.join(awake, "donor", "left_semi"), ties, total, seed + turn, block))
        if not inside.isEmpty():
            before, state, moved = state, after(inside), True
            drop_stage(before)
        drop_stage(inside)
        if several:
            best = cut_lineage(_best_moves(state.join(large if turn == 0 else awake, "donor", "left_semi"), ties, total))
        if not several or best.isEmpty():
            return state.select("donor", "node", "comm"), moved
        before, state, moved = state, after(_safe_moves(best, seed + turn)), True
        drop_stage(before)
        awake, turn = best.select("donor").distinct(), turn + 1


def _merged(flow: DataFrame, member: DataFrame) -> DataFrame:
    """The graph whose nodes are the communities."""
    a = member.select("donor", F.col("node").alias("src"), F.col("comm").alias("ns"))
    b = member.select("donor", F.col("node").alias("dst"), F.col("comm").alias("nd"))
    return flow.join(a, ["donor", "src"]).join(b, ["donor", "dst"]).groupBy(
        "donor", F.col("ns").alias("src"), F.col("nd").alias("dst")).agg(F.sum("w").alias("w"))


def _connected(flow: DataFrame, member: DataFrame) -> tuple[DataFrame, bool]:
    """Communities cut into their connected parts, and whether any had several."""
    a = member.select("donor", F.col("node").alias("src"), F.col("comm").alias("cs"))
    b = member.select("donor", F.col("node").alias("dst"), F.col("comm").alias("cd"))
    inside = flow.filter("src < dst").join(a, ["donor", "src"]).join(b, ["donor", "dst"]).filter("cs = cd").select("donor", "src", "dst")
    parts = connected_components(cut_lineage(inside), "src", "dst", ["donor"]).select("donor", "node", F.col("component").alias("part"))
    cut = cut_lineage(member.join(parts, ["donor", "node"], "left").select("donor", "node", "comm", F.coalesce("part", "node").alias("part")))
    several = cut.groupBy("donor", "comm").agg(F.min("part").alias("a"), F.max("part").alias("b")).filter("a < b")
    return cut.select("donor", "node", F.col("part").alias("comm")), not several.isEmpty()


def _levels(flow: DataFrame, member: DataFrame, seed: int, block: int) -> DataFrame:
    """(donor, node, comm) from a partition in which no node gains: communities move as nodes of the next levels and are cut into their
    connected parts, and nodes move again, until none of it changes anything."""
    while True:
        merged, level = False, flow
        while True:
            step = member if level is flow else upper
            coarse = cut_lineage(_merged(level, step))
            own = coarse.select("donor", F.col("src").alias("node"), F.col("src").alias("comm")).distinct()
            upper, moved = _settle(coarse, own, seed, block)
            if not moved:
                break
            merged, level, upper = True, coarse, cut_lineage(upper)
            label = upper.select("donor", F.col("node").alias("comm"), F.col("comm").alias("next"))
            member = cut_lineage(member.join(label, ["donor", "comm"]).select("donor", "node", F.col("next").alias("comm")))
        if not merged:
            member, apart = _connected(flow, member)
            if not apart:
                return member
        member = cut_lineage(_settle(flow, member, seed, block)[0])


def louvain(edges: DataFrame, nodes: DataFrame, seed: int = 0, block: int = GRAPH_BLOCK) -> DataFrame:
    """(donor, node, community) by modularity moves on all donors' graphs at once.

    ``edges`` (donor, u, v) is undirected and simple. Nodes move until none gains, then communities are merged as nodes of the
    next level, until no level changes anything; communities that fell apart are cut, and nodes move again from what was found. At the end no
    move of a single node gains and communities are connected. Nodes and then communities move inside blocks of whole communities, about ``block`` nodes, which are
    dealt anew each time, and between blocks by all moves at once that don't hinder each other (``_safe_moves``); either raises modularity, so rounds
    stay few. A donor of up to ``block`` nodes is one block, in which all of that is done in one turn; the block bounds what a task holds, and a larger
    donor means more blocks and more rounds. Nodes without an edge stay alone.
    """
    flow = cut_lineage(edges.select("donor", F.inline(F.array(
        F.struct(F.col("u").alias("src"), F.col("v").alias("dst")),
        F.struct(F.col("v").alias("src"), F.col("u").alias("dst"))))).withColumn("w", F.lit(1.0)))
    member = cut_lineage(flow.select("donor", F.col("src").alias("node"), F.col("src").alias("comm")).distinct())
    large = cut_lineage(member.groupBy("donor").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > block).select("donor"))
    member = cut_lineage(_settle(flow, member, seed, block)[0])
    if not large.isEmpty():  # donors of one block are done: there is nothing left to move, to merge or to cut
        done = member.join(large, "donor", "left_anti")
        member = done.unionByName(_levels(
            cut_lineage(flow.join(large, "donor", "left_semi")), cut_lineage(member.join(large, "donor", "left_semi")), seed, block))
    found = nodes.select("donor", "node").join(member, ["donor", "node"], "left")
    return cut_lineage(found.select("donor", "node", F.coalesce("comm", "node").alias("community")))


def modularity(edges: DataFrame, member: DataFrame) -> DataFrame:
    """(donor, modularity) of a partition."""
    m = member.select("donor", "node", "community")
    joined = edges.join(m.withColumnsRenamed({"node": "u", "community": "cu"}), ["donor", "u"]).join(
        m.withColumnsRenamed({"node": "v", "community": "cv"}), ["donor", "v"])
    inside = joined.groupBy("donor").agg(F.count(F.lit(1)).alias("m"), F.count_if(F.col("cu") == F.col("cv")).alias("inner"))
    ends = joined.select("donor", F.explode(F.array("cu", "cv")).alias("c")).groupBy("donor", "c").agg(F.count(F.lit(1)).alias("d"))
    spread = ends.groupBy("donor").agg(F.sum(F.col("d").cast("double") * F.col("d")).alias("dd"))
    return inside.join(spread, "donor").select(
        "donor", (F.col("inner") / F.col("m") - F.col("dd") / (4.0 * F.col("m") * F.col("m"))).alias("modularity"))


def neighbour_graph(neighbours: DataFrame) -> DataFrame:
    """Undirected simple edges (donor, u, v) of a neighbour list."""
    return neighbours.select(
        "donor", F.least("cell_id", "neighbour").alias("u"), F.greatest("cell_id", "neighbour").alias("v")
    ).filter("u <> v").distinct()


def duplicate_barcodes(cells: DataFrame) -> DataFrame:
    """Cell ids that occur more than once (must be empty before calling metacells)."""
    return cells.groupBy("cell_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def call_metacells(cells: DataFrame, size: int, seed: int = 0, block: int = BLOCK) -> DataFrame:
    """(donor, cell_id, meta, metacell) with at least ``size`` cells per metacell.

    Donors with fewer than 2 * size cells, or with fewer than two communities of ``size`` cells,
    are one metacell ``0``. Smaller communities are dissolved and their cells go to the nearest
    remaining centroid.
    """
    if not duplicate_barcodes(cells).isEmpty():
        raise ValueError("cell barcodes must be unique")
    counts = cells.groupBy("donor").agg(F.count(F.lit(1)).alias("n"))
    large = cells.join(counts.filter(F.col("n") >= 2 * size).select("donor"), "donor", "left_semi")
    graph = cut_lineage(neighbour_graph(knn(large, size, block)))
    found = louvain(graph, large.select("donor", F.col("cell_id").alias("node")), seed)
    sized = found.groupBy("donor", "community").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= size)
    per_donor = sized.groupBy("donor").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("donor")
    kept = sized.join(per_donor, "donor", "left_semi").select("donor", "community").withColumn(
        "meta", (F.row_number().over(Window.partitionBy("donor").orderBy("community")) - 1).cast("string"))
    labelled = cut_lineage(
        large.join(found.withColumnRenamed("node", "cell_id"), ["donor", "cell_id"])
        .join(kept, ["donor", "community"], "left")
        .join(per_donor.withColumn("clustered", F.lit(True)), "donor", "left")
        .select("donor", "cell_id", "pc", "meta", "clustered"))
    assigned = labelled.filter(F.col("meta").isNotNull())
    loose = labelled.filter(F.col("meta").isNull() & F.col("clustered"))
    middle = centroids(assigned, ["donor", "meta"]).withColumnRenamed("meta", "ref_id")
    adopted = nearest(loose, middle, 1, block=block).select("donor", "cell_id", F.col("ref_id").alias("meta"))
    done = assigned.select("donor", "cell_id", "meta").unionByName(adopted)
    whole = cells.select("donor", "cell_id").join(done, ["donor", "cell_id"], "left")
    return whole.select("donor", "cell_id", F.coalesce("meta", F.lit("0")).alias("meta")).withColumn(
        "metacell", F.concat_ws(":", F.col("donor").cast("string"), "meta"))


def metacell_quality(cells: DataFrame, labels: DataFrame, block: int = BLOCK) -> DataFrame:
    """(donor, silhouette, ch); both NULL for donors that stayed one metacell."""
    x = cells.join(labels.select("donor", "cell_id", "meta"), ["donor", "cell_id"])
    several = labels.groupBy("donor").agg(F.count_distinct("meta").alias("k")).filter("k > 1").select("donor")
    part = x.join(several, "donor", "left_semi")
    return (
        labels.select("donor").distinct()
        .join(silhouette(part, block), "donor", "left")
        .join(calinski_harabasz(part), "donor", "left")
    )
