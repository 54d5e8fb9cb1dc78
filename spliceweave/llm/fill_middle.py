"""Fill-in-middle rearrangement of documents as a pyarrow.compute pipeline.

A batch's texts are split into units (lines with their line feed) as list arrays; the flat units keep the index of their
row, so an ordinal inside the row tells prefix, middle and suffix apart. Filtered units are put back into one list a row and joined.
Nothing is done row by row in Python. The cuts and forms come from a digest of the id, so any run gives the same rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import byte_slices, id_digest, digest_word
from spliceweave.session import ship_package

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def split_units(texts: pa.StringArray) -> tuple[pa.Array, pa.Array, pa.Array, pa.Array]:
    """Flat units of all rows, the row of each, its ordinal in the row, and the number of units of each row."""
    lists = pc.split_pattern(texts, "\n")
    flat, row = pc.list_flatten(lists), pc.list_parent_indices(lists)
    pieces = pc.list_value_length(lists).cast(pa.int64())
    ends = pc.cumulative_sum(pieces)
    ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(pc.subtract(ends, pieces), row))
    last = pc.equal(ordinal, pc.subtract(pc.take(pieces, row), 1))
    # what follows a row's last line feed is a unit only if there is something
    real = pc.or_(pc.invert(last), pc.not_equal(flat, ""))
    closed = pc.equal(pc.take(flat, pc.subtract(ends, 1)), "")
    units = pc.binary_join_element_wise(flat, pc.if_else(last, "", "\n"), "")
    return pc.filter(units, real), pc.filter(row, real), pc.filter(ordinal, real), pc.subtract(pieces, closed.cast(pa.int64()))


def join_units(units: pa.Array, keep: pa.Array, sizes: pa.Array) -> pa.Array:
    """The kept units of each row as one string; ``sizes`` says how many each row keeps."""
    ends = pc.cumulative_sum(sizes).cast(pa.int32())
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends])
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.filter(units, keep)), "")


def _modulo(a: pa.Array, b: pa.Array | int) -> pa.Array:
    return pc.subtract(a, pc.multiply(pc.divide(a, b), b))


def rearrange(texts: pa.Array, draws: Sequence[pa.Array], rate: int, spm_rate: int, marks: Sequence[str]) -> dict[str, pa.Array]:
    """Columns n, form, prefix_chars, middle_chars and output of a batch; ``draws`` are the four digest words of each row."""
    if not len(texts):
        return {"n": pa.array([], pa.int64()), "form": pa.array([], pa.string()), "prefix_chars": pa.array([], pa.int64()),
                "middle_chars": pa.array([], pa.int64()), "output": pa.array([], pa.string())}
    units, row, ordinal, n = split_units(texts)
    places = pc.add(n, 1)
    one, two = _modulo(draws[0], places), _modulo(draws[1], places)
    lo, hi = pc.min_element_wise(one, two), pc.max_element_wise(one, two)
    before, until = pc.less(ordinal, pc.take(lo, row)), pc.less(ordinal, pc.take(hi, row))
    prefix = join_units(units, before, lo)
    middle = join_units(units, pc.and_not(until, before), pc.subtract(hi, lo))
    suffix = join_units(units, pc.invert(until), pc.subtract(n, hi))
    plain = pc.or_(pc.equal(texts, ""), pc.greater_equal(_modulo(draws[2], 100), rate))
    for m in marks:
        plain = pc.or_(plain, pc.match_substring(texts, m))
    spm = pc.less(_modulo(draws[3], 100), spm_rate)
    p, s, m = marks
    first = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
    other = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
    chars = lambda part: pc.if_else(plain, pa.scalar(None, pa.int64()), pc.utf8_length(part).cast(pa.int64()))
    return {
        "n": n, "form": pc.if_else(plain, "plain", pc.if_else(spm, "spm", "psm")), "prefix_chars": chars(prefix),
        "middle_chars": chars(middle), "output": pc.if_else(plain, texts, pc.if_else(spm, other, first)),
    }


def fill_in_middle(docs: DataFrame, rate: int = 100, spm_rate: int = 50, seed: int = 7, marks: Sequence[str] = (PREFIX, SUFFIX, MIDDLE),
                   id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, n (units), form, prefix_chars, middle_chars and output of every row.

    Units are lines with their line feed, over whole texts. ``rate`` percent of the rows are rearranged, and of these ``spm_rate``
    percent with the suffix first (``spm``), the others with the prefix first (``psm``). A null text counts as empty. Empty texts, and
    those that hold one of ``marks``, stay ``plain`` (no split sizes), so output can always be read back. Cuts depend on id and
    ``seed`` only: repeated rows come out alike, and rows without id share the digest of an empty id. Other columns are ignored;
    an empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    keep, marks, k = list(keep), tuple(marks), len(keep)
    names = [*keep, "n", "form", "prefix_chars", "middle_chars", "output"]

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in byte_slices(batches, k):
            made = rearrange(b.column(k), b.columns[k + 1:], rate, spm_rate, marks)
            yield pa.RecordBatch.from_arrays([*b.columns[:k], *[made[c] for c in names[k:]]], names=names)

    digest = id_digest(seed, F.col(f"`{id_col}`"))
    rows = docs.select(
        *[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("__text"),
        *[digest_word(digest, i).alias(f"__h{i}") for i in range(4)])
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:k])
    schema = f"{kept}, n bigint, form string, prefix_chars bigint, middle_chars bigint, output string"
    return rows.mapInArrow(kernel, schema.removeprefix(", "))


def restored(output: Column, form: Column, marks: Sequence[str] = (PREFIX, SUFFIX, MIDDLE)) -> Column:
    """The text that a rearranged output was made from. No text that was rearranged holds a mark, so marks cut it exactly."""
    parts = F.split(output, "|".join(re.sub(r"([^\w])", r"\\\1", m) for m in marks), -1)
    return (
        F.when(form == "psm", F.concat(parts[1], parts[3], parts[2]))
        .when(form == "spm", F.concat(parts[2], parts[3], parts[1])).otherwise(output)
    )
