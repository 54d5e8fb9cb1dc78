"""Byte-level BPE encoding and decoding over Arrow batches.

A ranks file (base64 bytes and rank a line) becomes a model of the tokenizers library: bytes are written as printable
characters by the usual byte table, and the merge that makes each token is found by merging its own bytes with lower ranks. Texts
are cut by the pattern, pieces are encoded by that model (met pieces are remembered), and the ids' byte lengths give byte
offsets, which the byte-to-character map turns into character offsets. Decoding looks ids up in the reversed byte table.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers.models import BPE

from spliceweave.llm.common import slices
from spliceweave.session import ship_package

LOST = "�".encode()


def byte_characters() -> list[str]:
    """The character that stands for each byte: itself where printable, else the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


def read_ranks(path: str) -> list[bytes]:
    """Token bytes by id."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    out = [b""] * (max(int(r) for _, r in pairs) + 1)
    for token, rank in pairs:
        out[int(rank)] = base64.b64decode(token)
    return out


def merges_of(tokens: Sequence[bytes]) -> list[tuple[bytes, bytes]]:
    """The two parts that each token of several bytes is merged from, in rank order."""
    ranks = {t: i for i, t in enumerate(tokens) if t}
    out = []
    for rank, token in enumerate(tokens):
        parts = [token[i:i + 1] for i in range(len(token))]
        while len(parts) > 2:
            best, at = min(((ranks.get(x + y, rank), i) for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False))), default=(rank, 0))
            if best >= rank:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        if len(parts) == 2:
            out.append((parts[0], parts[1]))
    return out


def ascii_pattern(pattern: str) -> re.Pattern | None:
    """The same pattern for texts of ASCII characters only, where letters and digits are plain ranges; None if it can't be told."""
    plain = pattern.replace(r"\p{L}", "A-Za-z").replace(r"\p{N}", "0-9")
    plain = re.sub(r"(?<![\[A-Za-z0-9^\\-])(A-Za-z|0-9)(?![A-Za-z0-9\]-])", r"[\1]", plain)
    try:
        return None if r"\p" in plain else re.compile(plain, re.ASCII)
    except re.error:
        return None


class Coder:
    """Encoder of one vocabulary; ``pattern`` cuts texts into the pieces that are encoded alone."""

    def __init__(self, tokens: Sequence[bytes], merges: Sequence[tuple[bytes, bytes]], pattern: str, memory: int = 100_000) -> None:
        chars = byte_characters()
        word = lambda b: "".join(map(chars.__getitem__, b))
        self.table = dict(enumerate(chars))
        self.model = BPE(vocab={word(t): i for i, t in enumerate(tokens) if t}, merges=[(word(x), word(y)) for x, y in merges])
        self.pattern, self.plain, self.memory = regex.compile(pattern), ascii_pattern(pattern), memory
        self.lengths = np.array([len(t) for t in tokens], np.int64)
        self.ids = _Pieces(self)

    def encode(self, text: str) -> np.ndarray:
        """Ids of a text; a very long one is cut piece by piece, so that its pieces never exist all at once."""
        pattern = self.plain if self.plain and text.isascii() else self.pattern
        pieces: Iterable[str] = pattern.findall(text) if len(text) < 1 << 22 else (m.group() for m in pattern.finditer(text))
        out = np.frombuffer(b"".join(map(self.ids.__getitem__, pieces)), np.int32)
        if len(self.ids) > self.memory:
            self.ids.older = dict(self.ids)
            self.ids.clear()
        return out

    def spans(self, text: str, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """First character and end of each token, and how many tokens begin inside a character.

        A token that holds part of a character spans that whole character.
        """
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        if text.isascii():
            return starts, ends, 0
        lead = (np.frombuffer(text.encode("utf-8"), np.uint8) & 0xC0) != 0x80
        char = np.cumsum(lead) - 1
        return char[starts], char[ends - 1] + 1, int((~lead[starts]).sum())


class _Pieces(dict):
    """Ids, as bytes of int32, of pieces met lately; ``older`` keeps those met before, so that common ones last."""

    def __init__(self, coder: Coder) -> None:
        super().__init__()
        self.coder, self.older = coder, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            word = piece.encode("utf-8").decode("latin-1").translate(self.coder.table)
            ids = array("i", [t.id for t in self.coder.model.tokenize(word)]).tobytes()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


def decode_ids(tokens: Sequence[bytes], ids: Sequence[int | None]) -> bytes:
    """Bytes of ids; an id that is null or unknown gives the replacement character."""
    try:
        return b"".join(map(tokens.__getitem__, ids))
    except (IndexError, TypeError):
        return b"".join(tokens[i] if i is not None and 0 <= i < len(tokens) else LOST for i in ids)


def decode_pieces(tokens: Sequence[bytes], ids: Sequence[int]) -> list[str]:
    """Text that each token completes: characters split over tokens come out with their last one."""
    held = codecs.getincrementaldecoder("utf-8")("replace")
    out = [held.decode(decode_ids(tokens, [i])) for i in ids]
    if rest := held.decode(b"", True):
        out.append(rest)
    return out


def encode(docs: DataFrame, ranks: str, pattern: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",),
           offsets: bool = False, decoded: bool = False) -> DataFrame:
    """The ``keep`` columns, token_ids array<int>, split_tokens int; with ``offsets`` also starts and ends (characters).

    With ``decoded`` the ids are decoded again in the same pass, to ``decoded`` binary (see ``decode``).

    Whole texts, without special tokens; null counts as empty and gives no ids. Rows are kept one to one, so repeated rows,
    null keys and empty tables come out as they are. Columns not named in ``keep`` are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    tokens = read_ranks(ranks)
    held = spark.sparkContext.broadcast((tokens, merges_of(tokens)))
    n = len(keep)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value[0]
        coder = Coder(*held.value, pattern)  # a task's own, so that its memory goes with the task
        for batch in slices(batches):
            for lo, part in _by_size(batch, n):
                ids, split, starts, ends, back = [], [], [], [], []
                for text in part:
                    text = text or ""
                    ids.append(coder.encode(text))
                    a, b, k = coder.spans(text, ids[-1])
                    split.append(k)
                    if offsets:
                        starts.append(a)
                        ends.append(b)
                    if decoded:
                        back.append(decode_ids(known, ids[-1].tolist()))
                lists = [ids, starts, ends] if offsets else [ids]
                cols = [_list_array(x) for x in lists]
                rows = batch.slice(lo, len(part))
                yield pa.RecordBatch.from_arrays(
                    [*rows.columns[:n], cols[0], pa.array(split, pa.int32()), *cols[1:], *[pa.array(back, pa.binary())] * decoded],
                    names=[*keep, "token_ids", "split_tokens", *["starts", "ends"] * offsets, *["decoded"] * decoded],
                )

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col).cast("string").alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:n])
    schema = f"{kept}, token_ids array<int>, split_tokens int" + ", starts array<int>, ends array<int>" * offsets + ", decoded binary" * decoded
    return rows.mapInArrow(kernel, schema.removeprefix(", "))


def _by_size(batch: pa.RecordBatch, column: int, most: int = 1 << 22) -> Iterator[tuple[int, list[str | None]]]:
    """Runs of rows with about ``most`` characters, so that results stay small whatever the batch."""
    texts = batch.column(column).to_pylist()
    lo = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield lo, texts[lo:i + 1]
            lo, size = i + 1, 0
    if lo < len(texts):
        yield lo, texts[lo:]


def _list_array(arrays: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(x) for x in arrays)])
    flat = np.concatenate([np.zeros(0, np.int32), *arrays]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))


def decode(rows: DataFrame, ranks: str, pattern: str, ids_col: str = "token_ids", as_text: bool = False) -> DataFrame:
    """``rows`` with ``decoded`` binary, or with ``as_text`` string where broken characters become replacement characters.

    Null ids decode to nothing; a null or unknown id inside a list gives the replacement character.
    """
    spark = rows.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast(read_ranks(ranks))
    at, names = rows.columns.index(ids_col), [*rows.columns, "decoded"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = held.value
        for batch in batches:
            col = batch.column(at)
            for lo in range(0, len(batch), 512):
                part = batch.slice(lo, 512)
                data = [decode_ids(tokens, ids.values.to_pylist() if ids.is_valid else []) for ids in col.slice(lo, 512)]
                out = pa.array([d.decode("utf-8", "replace") for d in data]) if as_text else pa.array(data, pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, out], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(kernel, f"{fields}, decoded {'string' if as_text else 'binary'}")


def digests(decoded: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Token count and digests of ids and decoded bytes."""
    return decoded.select(
        *[F.col(f"`{c}`") for c in keep], F.size("token_ids").cast("long").alias("n_tokens"), "split_tokens",
        F.sha2(F.encode(F.array_join(F.col("token_ids").cast("array<string>"), " "), "UTF-8"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
