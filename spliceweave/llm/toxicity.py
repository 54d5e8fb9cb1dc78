"""Toxicity by a weighted lexicon, matched with Aho-Corasick in folded texts.

Folding lowers case, strips accents, maps homoglyphs and digit substitutions to letters and everything that is no letter to a
space. Lexicon entries are whole words or word beginnings with a log-odds weight learnt from labelled rows; phrases in ``exceptions`` cancel the
matches inside them. The sum of weights is damped by the text's length; it and the largest weight give a logistic score whose scale is
learnt from the same rows, so that a word that also occurs in clean texts has to occur more than once.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import label_sample, only_names, shingle_hashes, slices, text_windows
from spliceweave.operators.components import connected_components
from spliceweave.session import cut_lineage, ship_package

# Letters of other scripts that look like Latin ones, and digits and signs that stand for letters.
HOMOGLYPHS = {
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "к": "k", "м": "m", "т": "t", "в": "b",
    "н": "h", "ԁ": "d", "ո": "n", "α": "a", "ε": "e", "ο": "o", "ρ": "p", "ν": "v", "ι": "i", "κ": "k", "τ": "t", "υ": "u", "ı": "i", "ɡ": "g",
    "ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l",
}
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}

#: Lengths of the word beginnings that can become entries.
BEGINNINGS = range(3, 9)

#: Keys that bring variants of a labelled document together, each of two minima of its shingles.
FAMILY_KEYS, KEY_MINIMA = 32, 2
_RNG = np.random.default_rng(42)
_SALTS = _RNG.integers(0, 1 << 64, FAMILY_KEYS * KEY_MINIMA, dtype=np.uint64)
_FACTORS = _RNG.integers(0, 1 << 64, FAMILY_KEYS * KEY_MINIMA, dtype=np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (FAMILY_KEYS, KEY_MINIMA), dtype=np.uint64) | np.uint64(1)

#: Harmless phrases around words that are often insults.
EXCEPTIONS = ("trash can", "trash bin", "clown fish", "clown nose", "clown car", "pond scum", "soap scum", "sore loser", "idiot proof")


class _Fold(dict):
    """str.translate table that is filled as characters are met."""

    def __missing__(self, code: int) -> str:
        char = chr(code)
        if char in SUBSTITUTES:
            out = SUBSTITUTES[char]
        else:
            plain = "".join(c for c in unicodedata.normalize("NFKD", char.lower()) if not unicodedata.combining(c))
            plain = "".join(HOMOGLYPHS.get(c, c) for c in plain)
            out = plain if plain.isalnum() else ("" if unicodedata.combining(char) or unicodedata.category(char) == "Cf" else " ")
        self[code] = out
        return out


_FOLD = _Fold()


def fold(text: str) -> str:
    """Folded words between single or several spaces, with one at each end."""
    return f" {text.translate(_FOLD)} "


def in_training(doc_id: Column) -> Column:
    """True where labels may be learnt from: crc32 of the id as text is not 2 modulo 4."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) != 2, F.lit(False))


def word_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(word, toxic, clean): numbers of labelled documents with each folded word, summed in the task before the shuffle."""
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = (Counter(), Counter())

        def flush() -> pa.RecordBatch:
            words = list(counts[0].keys() | counts[1].keys())
            cols = [pa.array(words, pa.string()), *(pa.array([counts[k][w] for w in words], pa.int64()) for k in (1, 0))]
            for c in counts:
                c.clear()
            return pa.RecordBatch.from_arrays(cols, names=["word", "toxic", "clean"])

        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[label].update(set(fold(text or "").split()))
            if len(counts[0]) + len(counts[1]) > 150_000:
                yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.join(F.broadcast(labels), "doc_id")  # a sample of at most max_labels ids
    return (
        rows.select("text", "label").mapInArrow(kernel, "word string, toxic long, clean long")
        .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    )


def family_classes(texts: DataFrame) -> DataFrame:
    """(doc_id, text, family) of ``texts`` (doc_id, text): documents that share a key of their five-word shingles are one family.

    A pair whose shingle sets have a Jaccard similarity of 0.3 shares a key with a chance of 0.95, one of 0.02 with 0.01; variants of a
    family also meet through each other. Keys make stars, never pairs.
    """
    ship_package(texts.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            keys = np.array([family_keys(t) for t in b.column(1).to_pylist()])
            lists = pa.ListArray.from_arrays(np.arange(0, keys.size + 1, FAMILY_KEYS, dtype=np.int32), keys.ravel())
            yield pa.RecordBatch.from_arrays([b.column(0), lists], names=["doc_id", "keys"])

    keyed = cut_lineage(texts.mapInArrow(kernel, "doc_id long, keys array<long>").select("doc_id", F.posexplode("keys").alias("at", "key")))
    first = keyed.groupBy("at", "key").agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("z")).filter("a < z").select("at", "key", "a")
    stars = cut_lineage(keyed.join(first, ["at", "key"]).filter("doc_id != a").select("a", F.col("doc_id").alias("b")).distinct())
    if stars.isEmpty():
        return texts.withColumn("family", F.col("doc_id"))
    found = cut_lineage(connected_components(stars, "a", "b")).select(F.col("node").alias("doc_id"), F.col("component").alias("family"))
    met = texts.join(F.broadcast(found), "doc_id", "left")  # as many ids as ``texts`` has, a bounded sample
    return met.select("doc_id", "text", F.coalesce("family", "doc_id").alias("family"))


def family_keys(text: str | None) -> np.ndarray:
    """The ``FAMILY_KEYS`` keys of a text's folded five-word shingles; texts without words have one key in common."""
    low = np.full(FAMILY_KEYS * KEY_MINIMA, np.iinfo(np.uint64).max, np.uint64)
    for words, last in text_windows(fold(text or "").encode(), 4):
        if len(words) >= 5 or last:
            hashes = shingle_hashes(words, 5)
            for at in range(0, len(hashes), 1024):
                np.minimum(low, ((hashes[at:at + 1024, None] ^ _SALTS) * _FACTORS).min(axis=0), out=low)
    low ^= low >> np.uint64(31)
    return (low.reshape(FAMILY_KEYS, KEY_MINIMA) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def family_counts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(term, families): in how many families of near copies each word and word beginning occurs among documents labelled toxic.

    A family counts once however many variants of it there are, so words of one much-copied and edited document don't pass for a lexicon.
    """
    ship_package(docs.sparkSession)

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: set[tuple[str, int]] = set()

        def flush() -> pa.RecordBatch:
            cols = [pa.array([t for t, _ in met], pa.string()), pa.array([h for _, h in met], pa.int64())]
            met.clear()
            return pa.RecordBatch.from_arrays(cols, names=["term", "family"])

        for b in slices(batches):
            for text, family in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for word in set(fold(text or "").split()):
                    met.update((term, family) for term in (*(f" {word[:k]}" for k in BEGINNINGS if len(word) >= k), f" {word} "))
                if len(met) > 150_000:
                    yield flush()
        yield flush()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    toxic = rows.join(F.broadcast(labels.filter("label = 1").select("doc_id")), "doc_id").select("doc_id", "text")  # a sample of at most max_labels ids
    met = family_classes(toxic).select("text", "family").mapInArrow(kernel, "term string, family long")
    return met.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("families"))


def training_sample(labels: DataFrame, max_labels: int = 300_000) -> DataFrame:
    """(doc_id, label) of at most ``max_labels`` labelled rows outside the held-out fold, chosen by a hash of doc_id."""
    return cut_lineage(label_sample(labels, "toxic", in_training(F.col("doc_id")), max_labels))


def learn_lexicon(docs: DataFrame, labels: DataFrame, max_labels: int = 300_000, min_support: int = 4, min_weight: float = 3.0,
                  min_families: int = 5) -> dict[str, float]:
    """Lexicon entries (folded, " word " or " beginning") and weights from labelled documents outside the held-out fold."""
    return lexicon_of(docs, training_sample(labels, max_labels), min_support, min_weight, min_families)


def lexicon_of(docs: DataFrame, sample: DataFrame, min_support: int = 4, min_weight: float = 3.0, min_families: int = 5) -> dict[str, float]:
    """Lexicon entries and weights from the labelled documents of ``sample`` (``training_sample``).

    All their words and beginnings are candidates; those with the weight that occur in ``min_families`` families of near copies
    are pruned with ``prune_terms``, and only what is left is collected.
    """
    size = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    toxic, clean = size.get(1, 0), size.get(0, 0)
    if not toxic:
        return {}
    words = word_counts(docs, sample)
    starts = F.array(*[F.when(F.length("word") >= k, F.concat(F.lit(" "), F.substring("word", 1, k))) for k in BEGINNINGS])
    whole = F.array(F.concat(F.lit(" "), F.col("word"), F.lit(" ")))
    weight = F.log((F.col("toxic") + 0.5) / (toxic + 1)) - F.log((F.col("clean") + 0.5) / (clean + 1))
    terms = (
        words.select(F.explode(F.concat(F.array_compact(starts), whole)).alias("term"), "toxic", "clean")
        .groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
        .withColumn("weight", weight).filter((F.col("toxic") >= min_support) & (F.col("weight") >= min_weight))
        .join(family_counts(docs, sample).filter(F.col("families") >= min_families), "term")
    )

    def prune(group: pd.DataFrame) -> pd.DataFrame:
        kept = prune_terms(list(zip(group["term"], group["toxic"], group["weight"], strict=True)))
        return pd.DataFrame({"term": list(kept), "weight": list(kept.values())}).astype({"term": object, "weight": float})

    # a beginning has three letters at least, so it shares the first with all its continuations
    groups = terms.select(F.substring("term", 1, 1 + BEGINNINGS[0]).alias("start"), "term", "toxic", "weight").groupBy("start")
    return {r["term"]: r["weight"] for r in groups.applyInPandas(prune, "term string, weight double").collect()}


def fit_scale(docs: DataFrame, sample: DataFrame, lexicon: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS, half_words: float = 2000.0,
              penalty: float = 1e-3) -> tuple[float, float, float] | None:
    """Factors of the two match figures (``match_figures``) and the bias of a logistic score, from the labelled documents of ``sample``.

    None, i.e. the plain score of ``weigh``, where there are no entries or only one label occurs.
    """
    if not lexicon or sample.select("label").distinct().count() < 2:
        return None
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    met = score_toxicity(rows, lexicon, exceptions, half_words, keep=("label",), figures=True).select("label", "damped", "largest")
    rows = cut_lineage(met.withColumn("figures", array_to_vector(F.array("damped", "largest"))))
    if rows.select("label").distinct().count() < 2:
        return None
    fitted = LogisticRegression(featuresCol="figures", labelCol="label", regParam=penalty, standardization=False,
                                lowerBoundsOnCoefficients=Matrices.dense(1, 2, [0.0, 0.0])).fit(rows)
    return float(fitted.coefficients[0]), float(fitted.coefficients[1]), float(fitted.intercept)


def learn(docs: DataFrame, labels: DataFrame, max_labels: int = 300_000) -> tuple[dict[str, float], tuple[float, float, float] | None]:
    """Lexicon and scale of the score."""
    sample = training_sample(labels, max_labels)
    lexicon = lexicon_of(docs, sample)
    return lexicon, fit_scale(docs, sample, lexicon)


def prune_terms(terms: Iterable[tuple[str, int, float]]) -> dict[str, float]:
    """Entries without the beginnings of others that have nearly their support, or half of it and a clearly larger weight, and
    without continuations of entries that weigh about as much."""
    support = {t: n for t, n, _ in terms}
    weights = {t: w for t, _, w in terms}
    open_ends = {
        t[:k] for t, n in support.items() for k in range(2, len(t))
        if (m := support.get(t[:k], math.inf)) * 0.95 <= n or m * 0.5 <= n and weights[t] >= weights[t[:k]] + 1
    }
    out: dict[str, float] = {}
    for t in sorted(weights, key=lambda t: (len(t), t)):
        if t not in open_ends and not any(out.get(t[:k], -math.inf) >= weights[t] - 1 for k in range(2, len(t))):
            out[t] = weights[t]
    return out


def build_automaton(lexicon: dict[str, float], exceptions: Sequence[str]) -> ahocorasick.Automaton:
    """Entries carry (length, weight); exception phrases carry no weight."""
    automaton = ahocorasick.Automaton()
    for phrase in exceptions:
        if words := fold(phrase).split():
            key = f" {' '.join(words)} "
            automaton.add_word(key, (len(key), None))
    for term, weight in lexicon.items():
        automaton.add_word(term, (len(term), weight))
    if len(automaton):
        automaton.make_automaton()
    return automaton


def match_figures(text: str, automaton: ahocorasick.Automaton, half_words: float) -> tuple[float, float, int]:
    """Logarithm of one plus the sum of weights damped by length, largest weight and number of toxic words of a text.

    Entries that start at the same word count once, with the largest weight; exception phrases cancel the matches inside them.
    """
    if not len(automaton):
        return 0.0, 0.0, 0
    folded = fold(text)
    hits: dict[int, float] = {}
    spared: list[tuple[int, int]] = []
    for end, (length, weight) in automaton.iter(folded):
        start = end - length + 1
        if weight is None:
            spared.append((start, end))
        else:
            hits[start] = max(weight, hits.get(start, 0.0))
    for lo, hi in spared:
        for s in [s for s in hits if lo <= s < hi]:
            del hits[s]
    if not hits:
        return 0.0, 0.0, 0
    return math.log1p(sum(hits.values()) / (1 + len(folded.split()) / half_words)), max(hits.values()), len(hits)


def weigh(text: str, automaton: ahocorasick.Automaton, half_words: float, scale: tuple[float, float, float] | None = None) -> tuple[float, int]:
    """Score and number of toxic words of a text: logistic in its figures by ``scale``, else 1 - exp(-damped sum); 0 without a match."""
    damped, largest, words = match_figures(text, automaton, half_words)
    return squash(damped, largest, words, scale), words


def squash(damped: float, largest: float, words: int, scale: tuple[float, float, float] | None) -> float:
    if not words:
        return 0.0
    if scale is None:
        return 1 - math.exp(-math.expm1(damped))
    return 1 / (1 + math.exp(-max(min(scale[0] * damped + scale[1] * largest + scale[2], 700.0), -700.0)))


def score_toxicity(docs: DataFrame, lexicon: dict[str, float], exceptions: Sequence[str] = EXCEPTIONS, half_words: float = 2000.0,
                   keep: Sequence[str] = ("doc_id",), scale: tuple[float, float, float] | None = None, figures: bool = False) -> DataFrame:
    """The ``keep`` columns, score double (0 to 1) and toxic_words int of every row; with ``figures`` damped and largest as well.

    Only the text is looked at. Null and empty texts score 0; rows are kept one to one. Columns not in ``keep`` are ignored.
    """
    spark = docs.sparkSession
    ship_package(spark)
    held = spark.sparkContext.broadcast((lexicon, tuple(exceptions)))
    n = len(keep)

    rows = docs.select(*[F.col(f"`{c}`") for c in keep], *[F.col("text").cast("string").alias("__text")] * ("text" not in keep))
    at = rows.columns.index("text" if "text" in keep else "__text")
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:n])
    more = ["damped", "largest"] * figures

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = build_automaton(*held.value)
        for b in slices(batches):
            found = [match_figures(t or "", automaton, half_words) for t in b.column(at).to_pylist()]
            cols = [pa.array([squash(*f, scale) for f in found], pa.float64()), pa.array([f[2] for f in found], pa.int32())]
            cols += [pa.array([f[i] for f in found], pa.float64()) for i in range(len(more))]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *cols], names=[*keep, "score", "toxic_words", *more])

    return rows.mapInArrow(kernel, f"{fields}score double, toxic_words int{''.join(f', {c} double' for c in more)}")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without rows that score ``threshold`` or more; all columns stay. Empty tables, and labels without a toxic row, drop nothing."""
    lexicon, scale = learn(docs, labels)
    rows = only_names(docs, ("text",))
    scored = score_toxicity(rows, lexicon, keep=rows.columns, scale=scale)
    return scored.filter(F.col("score") < threshold).drop("score", "toxic_words").toDF(*docs.columns)
