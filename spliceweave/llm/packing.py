"""Best-fit-decreasing packing of tokenised documents into sequences of a fixed length.

Best fit needs to know of an open bin only how much room is left, and of a piece only how long it is. So all pieces of one length, and
all bins of one room, are handled as counts: the plan is made from the number of pieces of each length (at most ``size`` numbers, however many
documents there are), with a segment tree over remaining capacities that finds the tightest open bin in logarithmic time. It is the
packing that placing piece after piece gives. What the plan says of the k-th piece of a length is then looked up for each piece in
parallel.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spliceweave.llm.bpe import ascii_pattern, byte_characters
from spliceweave.llm.common import byte_slices
from spliceweave.session import cut_lineage, ship_package


@lru_cache(1)
def vocabulary(path: str):
    """Model of a tokenizers file, read once by a worker."""
    return Tokenizer.from_file(path).model


class Encoder(dict):
    """Ids (bytes of uint32) by piece: pieces are cut by the pre-tokenizer's pattern and merged by the model of the tokenizers library.

    Short pieces are remembered, ``most`` of them and as many that were met before. Strings of special tokens are ordinary text.
    """

    def __init__(self, path: str, pattern: str, most: int = 250_000) -> None:
        super().__init__()
        self.model, self.table = vocabulary(path), dict(enumerate(byte_characters()))
        self.pattern, self.plain = regex.compile(pattern), ascii_pattern(pattern)
        self.most, self.older = most, {}

    def __missing__(self, piece: str) -> bytes:
        out = self.older.get(piece)
        if out is None:
            written = piece.encode("utf-8").decode("latin-1").translate(self.table)
            out = array("I", [t.id for t in self.model.tokenize(written)]).tobytes()
        if len(piece) <= 64:
            self[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids of a whole text, as one call of the tokenizers library gives them; pieces of a long text never exist all at once."""
        if len(self) > self.most:
            self.older = dict(self)
            self.clear()
        rule = self.plain if self.plain and text.isascii() else self.pattern
        pieces = rule.findall(text) if len(text) < 1 << 22 else (m.group() for m in rule.finditer(text))
        return b"".join(map(self.__getitem__, pieces))


def token_pieces(docs: DataFrame, tokenizer: str, pattern: str, size: int = 2048, end_id: int = 0, keep: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The ``keep`` columns, piece int, start long, length long, ids binary and ids_crc32 long of every piece of every row.

    A row's ids are those of its whole text (null: empty) and ``end_id``. Up to ``size`` ids make one piece; longer ones are cut into
    pieces of ``size``, the first one holding what is left over. Repeated rows and rows without id stay as they are; other columns are
    ignored; an empty table gives no pieces. part and nth name a piece among those of its length: the task that made it, and its place there.
    They hold only for a stored table.
    """
    ship_package(docs.sparkSession)
    keep, k = list(keep), len(keep)
    names = [*keep, "piece", "start", "length", "ids", "ids_crc32", "part", "nth"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, task = Encoder(tokenizer, pattern), TaskContext.get().partitionId()
        end, met = np.array([end_id], "<u4").tobytes(), np.zeros(size + 1, np.int64)
        for b in byte_slices(batches, k, 1 << 22):
            rows, piece, start, length, ids, crc, nth = [], [], [], [], [], [], []
            for i, text in enumerate(b.column(k).to_pylist()):
                data = (encoder.encode(text) if text else b"") + end
                n = len(data) // 4
                first = (n - 1) % size + 1
                for p, at in enumerate([0, *range(first, n, size)]):
                    part = data[4 * at:4 * (at + (size if at else first))]
                    rows.append(i)
                    piece.append(p)
                    start.append(at)
                    length.append(len(part) // 4)
                    ids.append(part)
                    crc.append(zlib.crc32(part))
                    nth.append(int(met[length[-1]]))
                    met[length[-1]] += 1
            yield pa.RecordBatch.from_arrays(
                [*[c.take(pa.array(rows, pa.int64())) for c in b.columns[:k]], pa.array(piece, pa.int32()), pa.array(start, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(ids, pa.binary()), pa.array(crc, pa.int64()), pa.array([task] * len(rows), pa.int32()),
                 pa.array(nth, pa.int64())], names=names)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:k])
    schema = f"{kept}, piece int, start bigint, length bigint, ids binary, ids_crc32 bigint, part int, nth bigint"
    return rows.mapInArrow(kernel, schema.removeprefix(", "))


@dataclass
class OpenBins:
    """Bins by remaining capacity, under a segment tree whose nodes count the open ones below."""

    size: int
    groups: list[list[tuple[int, int]]] = field(init=False)
    counts: list[int] = field(init=False)

    def __post_init__(self) -> None:
        self.leaves = 1 << self.size.bit_length()
        self.groups = [[] for _ in range(self.size + 1)]
        self.counts = [0] * (2 * self.leaves)

    def add(self, room: int, first: int, n: int) -> None:
        """Bins ``first`` to ``first + n - 1`` have ``room`` left; full ones are closed."""
        if room and n:
            self.groups[room].append((first, n))
            self._count(room, n)

    def take(self, room: int) -> tuple[int, int]:
        first, n = self.groups[room].pop()
        self._count(room, -n)
        return first, n

    def _count(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.counts[at] += n
            at //= 2

    def tightest(self, length: int) -> int | None:
        """The least remaining capacity of an open bin that holds ``length``."""
        at = self.leaves + length
        if self.counts[at]:
            return length
        while at > 1:
            if at % 2 == 0 and self.counts[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.counts[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


#: A run of a plan: the pieces of ``length`` from rank ``first`` on lie in bins from ``bin`` on, ``each`` in a bin, from ``offset`` there.
Run = tuple[int, int, int, int, int]


def best_fit_decreasing(lengths: dict[int, int], size: int) -> tuple[list[Run], int]:
    """Runs (length, first, each, bin, offset) for the number of pieces of each length, and the number of bins.

    A length leaves at most two groups of bins more than there were, and a group that takes pieces has less than half of its room left,
    so the runs are at most about ``2 * size * log2(size)``, whatever the counts.
    """
    open_bins, runs, bins = OpenBins(size), [], 0
    for length in sorted(lengths, reverse=True):
        if not 0 < length <= size:
            raise ValueError(f"a piece of {length} does not fit into {size}")
        left, rank = lengths[length], 0
        while left:
            room = open_bins.tightest(length)
            if room is None:
                room, first = size, bins
                n = -(-left // (size // length))
                bins += n
            else:
                first, n = open_bins.take(room)
            each = room // length
            whole = min(n, left // each)
            if whole:
                runs.append((length, rank, each, first, size - room))
                open_bins.add(room - each * length, first, whole)
                rank, left = rank + whole * each, left - whole * each
            if whole < n and left:  # fewer pieces than one more bin of this group could take
                runs.append((length, rank, each, first + whole, size - room))
                open_bins.add(room - left * length, first + whole, 1)
                whole, left = whole + 1, 0
            open_bins.add(room, first + whole, n - whole)
    return runs, bins


def pack(pieces: DataFrame, size: int = 2048) -> DataFrame:
    """``pieces`` with sequence_id and offset: few sequences of at most ``size``, each filled without gaps from 0.

    ``pieces`` is a stored table of ``token_pieces`` (length, part, nth and whatever else). Only the number of pieces of each length, at most
    ``size`` rows, comes to the driver. Ranks inside a length are sums of what earlier tasks made, so a length that a third of all pieces
    share is as spread as they are.
    """
    per_task = cut_lineage(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")))
    lengths = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs, _ = best_fit_decreasing(lengths, size)
    held = pieces.sparkSession.sparkContext.broadcast(np.array(sorted(runs), np.int64).reshape(-1, 5))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("__before"))
    others = [c for c in pieces.columns if c not in ("part", "nth")]
    ranked = pieces.join(before, ["length", "part"]).select(*others, (F.col("__before") + F.col("nth")).alias("__rank"))
    at, k = others.index("length"), len(others)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value if len(held.value) else np.zeros((1, 5), np.int64)
        starts = np.searchsorted(table[:, 0], np.arange(size + 2))  # runs of a length lie together, by rank
        step = int(table[:, 1].max()) + 1
        place = table[:, 0] * step + table[:, 1]
        for b in batches:
            length, rank = b.column(at).to_numpy(), b.column(k).to_numpy()
            found = np.searchsorted(place, length * step + np.minimum(rank, step - 1), side="right") - 1
            found = np.clip(found, starts[length], starts[length + 1] - 1)
            inside = rank - table[found, 1]
            sequence = table[found, 3] + inside // table[found, 2]
            offset = table[found, 4] + inside % table[found, 2] * length
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:k], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=[*others, "sequence_id", "offset"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields[:k])
    return ranked.mapInArrow(kernel, f"{fields}, sequence_id bigint, offset bigint")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids binary): the packed sequences themselves, from pieces that still have their ``ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select(
        "sequence_id", F.aggregate(F.col("p.ids"), F.to_binary(F.lit(""), F.lit("hex")), lambda s, x: F.concat(s, x)).alias("ids"))
