"""License scan by patience alignment of texts with license templates.

Words that occur once in both a stretch of text and a template are anchors; their longest increasing subsequence is kept, and the gaps
between kept anchors are aligned in the same way. Coverage is the share of the template's words that are aligned.

Only stretches that can reach the wanted coverage are aligned: a match lacks at most ``(1 - coverage) * length`` template words, so it holds
one at least of that many plus one of the template's words. The rarest in the text are taken, and each occurrence of one
names the stretch around it.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import slices
from spliceweave.session import ship_package

# Notices by which well-known licenses are named in texts.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with "
                         "the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "MIT": "Released under the MIT License.",
    "MIT grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
                 "(the \"Software\"), to deal in the Software without restriction",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "All rights reserved": "All rights reserved.",
}
_WORD = re.compile(r"[^\W_]+(?:\.\d+)*")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def increasing(values: Sequence[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    below = [-1] * len(values)
    for i, v in enumerate(values):
        p = bisect_left(tops, v)
        below[i] = piles[p - 1] if p else -1
        tops[p:p + 1], piles[p:p + 1] = [v], [i]
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = below[i]
    return out[::-1]


def align(text: Sequence[str], template: Sequence[str]) -> list[tuple[int, int]]:
    """Aligned (text, template) positions; gaps are worked off from a list, so depth doesn't matter."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:  # what agrees at either end
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a == b or c == d:
            continue
        once = {w for w, n in Counter(template[c:d]).items() if n == 1}
        met = Counter(w for w in text[a:b] if w in once)
        place = {template[i]: i for i in range(c, d)}
        anchors = [(i, place[text[i]]) for i in range(a, b) if met.get(text[i]) == 1]
        kept = [anchors[i] for i in increasing([y for _, y in anchors])]
        if not kept:
            continue
        out += kept
        edges = [(a - 1, c - 1), *kept, (b, d)]
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:], strict=False)]
    return sorted(out)


def find_license(words: Sequence[str], places: Mapping[str, Sequence[int]], template: Sequence[str], coverage: float) -> list[tuple[float, int, int]]:
    """(coverage, first word, end word) of all stretches that reach ``coverage``; they don't overlap, the best come first."""
    distinct = dict.fromkeys(template)
    length = len(template)
    need = math.ceil(coverage * length - 1e-9)
    if not length or sum(min(len(places.get(w, ())), n) for w, n in Counter(template).items()) < need:
        return []
    counts = Counter(template)
    rare, lacking = [], 0
    for w in sorted(distinct, key=lambda w: (len(places.get(w, ())), w)):
        rare.append(w)
        lacking += counts[w]
        if lacking > length - need:
            break
    slack = length - need + 2
    starts = sorted({max(i - j - slack, 0) for w in rare for i in places.get(w, ()) for j, t in enumerate(template) if t == w})
    found, last = [], -1
    for s in starts:
        if last >= 0 and s <= last:  # stretches that begin within the slack see the same words
            continue
        last = s + slack // 2
        pairs = align(words[s:s + length + 2 * slack + slack // 2], template)
        if len(pairs) >= need:
            found.append((len(pairs) / length, s + pairs[0][0], s + pairs[-1][0] + 1))
    out: list[tuple[float, int, int]] = []
    for c, a, b in sorted(found, key=lambda x: (-x[0], x[1])):
        if all(b <= y or a >= z for _, y, z in out):
            out.append((c, a, b))
    return out


def scan_licenses(docs: DataFrame, templates: Mapping[str, str] = TEMPLATES, coverage: float = 0.8) -> DataFrame:
    """(doc_id, license, coverage, first_word, end_word): every license notice of every row; rows without one come out once, with nulls.

    Words are lower-case runs of letters and digits. Null and empty texts have no notice. A notice that is part of a longer one is
    reported for both. Rows are kept, repeated rows too; other columns are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    split = {name: words_of(t) for name, t in templates.items()}
    vocabulary = {w for t in split.values() for w in t}

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            out: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words = words_of(text or "")
                places: dict[str, list[int]] = {}
                for i, w in enumerate(words):
                    if w in vocabulary:
                        places.setdefault(w, []).append(i)
                hits = [(doc_id, name, *hit) for name, t in split.items() for hit in find_license(words, places, t, coverage)]
                out += hits or [(doc_id, None, None, None, None)]
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=["doc_id", "license", "coverage", "first_word", "end_word"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(kernel, "doc_id long, license string, coverage double, first_word int, end_word int")
