"""Fill-in-middle, packing and resampling against plain brute-force versions, with odd input."""
import hashlib
import math
import re
import zlib
from bisect import bisect_left, insort
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spliceweave.llm import fill_middle, packing, queries, resample
from spliceweave.llm.common import table

JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SMALL = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, n long, form string, output string, __text string"
TEXTS = [None, "", "\n", "\n\n\n", "one line", "a\nb", "a\nb\n", "\na\r\n b \n\n c", "<P>x", "x <S> y\nz", "<<M\nS>\n<P", "é\n漢字\n😀\n", "tab\there\x0bnot a line\x0c\n",
         "a\nb", "word " * 30000, "l\n" * 50000, "x" * 100000]


def rows_of(spark, texts, first=0):
    """Documents whose other columns clash with the names of results; the last row has no id and repeats the last text."""
    rows = [(i + first, t, "en", -1, "old", "old", "old") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, texts[-1], None, None, None, None, None)] if texts else [], DOCS)


def words_of_digest(doc_id):
    h = hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(h[8 * i:8 * i + 8], 16) for i in range(4)]


def middle_by_hand(doc_id, text, rate=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = words_of_digest(doc_id)
    lo, hi = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= rate:
        return len(units), "plain", None, None, text
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    if h[3] % 100 < spm:
        return len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@pytest.mark.parametrize("rate,spm", [(100, 50), (40, 0), (0, 50), (100, 100)])
def test_middles_match_a_plain_loop(spark, rate, spm):
    out = fill_middle.fill_in_middle(rows_of(spark, TEXTS), rate, spm).withColumn("back", fill_middle.restored(F.col("output"), F.col("form"))).collect()
    assert len(out) == len(TEXTS) + 1
    for r in out:
        text = TEXTS[-1 if r.doc_id is None else r.doc_id]
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == middle_by_hand(r.doc_id, text, rate, spm)
        assert r.back == (text or "")
    assert fill_middle.fill_in_middle(rows_of(spark, [])).count() == 0


def test_middles_repeat_with_rows_and_follow_the_seed(spark):
    df = rows_of(spark, ["a\nb\nc\nd\n"] * 20)
    twice = fill_middle.fill_in_middle(df.unionByName(df)).groupBy("doc_id").agg(F.count_distinct("output").alias("d"), F.count("*").alias("n"))
    assert all((r.d, r.n) == (1, 2) for r in twice.collect())
    one, two = ([r.output for r in fill_middle.fill_in_middle(df, seed=s).orderBy("doc_id").collect()] for s in (7, 8))
    assert one != two


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="a\n<PSM>é", max_size=12), min_size=1, max_size=8))
def test_middles_of_any_batch(texts):
    draws = np.array([words_of_digest(i) for i in range(len(texts))])
    got = fill_middle.rearrange(pa.array(texts, pa.string()), [pa.array(c) for c in draws.T], 100, 50, ("<P>", "<S>", "<M>"))
    want = [middle_by_hand(i, t) for i, t in enumerate(texts)]
    for j, c in enumerate(("n", "form", "prefix_chars", "middle_chars", "output")):
        assert got[c].to_pylist() == [w[j] for w in want]


def test_fill_in_middle_matches_sql(spark):
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{SMALL}/documents.parquet'")
    df = queries.op11_fill_in_middle(spark, SMALL)
    want = con.sql(f"select {', '.join(df.columns)} from ({queries.ORACLES['op11_fill_in_middle']})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(want)


@pytest.fixture(scope="module")
def tokenizer():
    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return t


SPACES = ["", " ", "  ", " a", "a ", " a  b ", "a\n b", "a \n b", "a\n\n  b\tc", "it's we'LL  'tis", "x  y", "x\x1c y \x1cz", "é e ́x", "٣½ ⅷ ²x", "漢字 かな",
          "<|endoftext|> x <|endoftext|>", "\x85 \x85a　 b", "a" * 3000, " " * 300 + "z", "a b " * 2000]


def test_encoder_gives_the_ids_of_one_call(tokenizer, spark):
    encoder = packing.Encoder(JSON, PATTERN, most=50)
    texts = SPACES + [r.text or "" for r in table(spark, SMALL, "documents").select("text").collect()]
    for text in texts + SPACES:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    assert len(encoder) < 2000  # what is remembered is bounded


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=" \n\ta'sé1.\x1c　", max_size=20))
def test_encoder_on_any_spacing(tokenizer, text):
    encoder = test_encoder_on_any_spacing.__dict__.setdefault("encoder", packing.Encoder(JSON, PATTERN))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def one_at_a_time(lengths, size):
    """Number of bins of each room left, by placing piece after piece into the tightest bin."""
    rooms = []
    for n in sorted(lengths, reverse=True):
        at = bisect_left(rooms, n)
        room = rooms.pop(at) if at < len(rooms) else size
        insort(rooms, room - n)
    return Counter(rooms)


def rooms_of(runs, lengths, size):
    """The same from runs, checking that every rank is placed once and that bins have no gaps."""
    placed = {}
    nth = Counter()
    by_length = {}
    for length, first, each, at, offset in sorted(runs):
        by_length.setdefault(length, []).append((first, each, at, offset))
    for length, n in lengths.items():
        for rank in range(n):
            first, each, at, offset = [r for r in by_length[length] if r[0] <= rank][-1]
            placed.setdefault(at + (rank - first) // each, []).append((offset + (rank - first) % each * length, length))
            nth[length] += 1
    assert nth == Counter(lengths)
    out = Counter()
    for parts in placed.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
        out[size - end] += 1
    return out


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=120), st.integers(40, 64))
def test_counted_packing_is_best_fit_decreasing(lengths, size):
    runs, bins = packing.best_fit_decreasing(Counter(lengths), size)
    want = one_at_a_time(lengths, size)
    assert rooms_of(runs, Counter(lengths), size) == want and bins == sum(want.values())


def test_runs_stay_few_whatever_the_counts():
    rng = np.random.default_rng(3)
    few, many = ({n: int(c) for n, c in zip(range(1, 2049), rng.integers(1, top, 2048), strict=True)} for top in (10, 10 ** 12))
    sizes = [len(packing.best_fit_decreasing(x, 2048)[0]) for x in (few, many)]
    assert max(sizes) < 2 * 2048 * 11
    with pytest.raises(ValueError):
        packing.best_fit_decreasing({2049: 1}, 2048)
    assert packing.best_fit_decreasing({}, 2048) == ([], 0)


def check_packing(rows, size):
    ends, rooms = {}, Counter()
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends.get(r.sequence_id, 0)
        ends[r.sequence_id] = r.offset + r.length
    for end in ends.values():
        assert end <= size
        rooms[size - end] += 1
    return rooms


def test_pieces_and_sequences(spark, tokenizer):
    texts = [t for t in TEXTS if t is None or len(t) < 70000] + ["a b c d " * 700] * 3
    docs = rows_of(spark, texts).repartition(5)
    from spliceweave.session import cut_lineage
    pieces = cut_lineage(packing.token_pieces(docs, JSON, PATTERN, 64))
    packed = cut_lineage(packing.pack(pieces, 64))
    rows = packed.collect()
    assert check_packing(rows, 64) == one_at_a_time([r.length for r in rows], 64)
    for i, text in [*enumerate(texts), (None, texts[-1])]:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        mine = sorted((r for r in rows if r.doc_id == i), key=lambda r: r.piece)
        assert [r.piece for r in mine] == list(range(len(mine))) and all(r.length == 64 for r in mine[1:])
        assert np.frombuffer(b"".join(map(bytes, (r.ids for r in mine))), "<u4").tolist() == ids
        assert all(r.ids_crc32 == zlib.crc32(np.array(ids[r.start:r.start + r.length], "<u4").tobytes()) for r in mine)
    whole = {r.sequence_id: bytes(r.ids) for r in packing.sequences(packed).collect()}
    assert all(whole[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)] == bytes(r.ids) for r in rows)
    empty = cut_lineage(packing.token_pieces(rows_of(spark, []), JSON, PATTERN))
    assert packing.pack(empty).count() == 0


def test_packing_query_is_as_good_as_one_at_a_time(spark):
    rows = queries.op12_best_fit_packing(spark, SMALL).collect()
    assert check_packing(rows, 2048) == one_at_a_time([r.length for r in rows], 2048)
    assert len({r.doc_id for r in rows}) == table(spark, SMALL, "documents").count()


def features_by_hand(text, buckets):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return words, Counter(zlib.crc32(f.encode()) % buckets for f in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)])


def resample_by_hand(docs, target, buckets=10_000, percent=25, min_words=20):
    corpus, goal, held = Counter(), Counter(), []
    for doc_id, text in docs:
        words, counts = features_by_hand(text, buckets)
        corpus += counts
        held.append((doc_id, len(words), counts))
    for text in target:
        goal += features_by_hand(text, buckets)[1]
    s_all, t_all = corpus.total(), goal.total()
    gain = [math.floor(1000 * math.log((goal[b] + 1) * (s_all + buckets) / ((corpus[b] + 1) * (t_all + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, n, counts in held:
        weight = sum(c * gain[b] for b, c in counts.items()) // counts.total() if counts else 0
        h = words_of_digest(doc_id)[0]
        out.append([doc_id, n, counts.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], math.inf if r[0] is None else r[0]))
    for i, r in enumerate(out):
        rank = next((k + 1 for k, a in enumerate(able[:percent * len(able) // 100]) if a is r), None)
        out[i] = (*r, rank) if rank else (*r, None)
    return [(r[0], r[2], r[3], r[4], r[5]) for r in out]


def test_resampling_query_matches_a_plain_loop(spark):
    docs = [tuple(r) for r in table(spark, SMALL, "documents").select("doc_id", "text").collect()]
    target = [r.text for r in table(spark, SMALL, "benchmark").collect()]
    got = queries.op13_importance_resampling(spark, SMALL)
    assert [t for _, t in got.dtypes] == ["bigint"] * 5
    order = lambda rows: sorted(map(tuple, rows), key=lambda r: r[0])
    assert order(got.collect()) == order(resample_by_hand(docs, target))


def test_resampling_odd_rows(spark):
    texts = [*TEXTS, "A1-b2_Ç ß.é", "x y " * 300_000, *["same words " * 12] * 40]
    df = rows_of(spark, texts)
    target = spark.createDataFrame([("same words here",), (None,)], "text string")
    got = [tuple(r) for r in resample.importance_resample(df.repartition(3), target).select("doc_id", "n_features", "weight", "score", "rank").collect()]
    want = resample_by_hand([*enumerate(texts), (None, texts[-1])], ["same words here", None])
    key = lambda r: math.inf if r[0] is None else r[0]
    assert sorted(got, key=key) == sorted(want, key=key)
    twice = resample.importance_resample(df.unionByName(df), target)
    ranks = sorted(r.rank for r in twice.collect() if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and twice.count() == 2 * len(want)
    none = resample.importance_resample(df, target.limit(0))
    assert none.count() == len(want)
    assert resample.importance_resample(rows_of(spark, []), target).count() == 0
    assert resample.importance_resample(df, target, min_words=10**9).filter("rank IS NOT NULL").count() == 0
    with pytest.raises(ValueError):
        resample.importance_resample(df, target, buckets=70_000)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5000), min_size=70, max_size=70), min_size=1, max_size=4), st.lists(st.integers(-9000, 9000), min_size=70, max_size=70))
def test_sliced_sums_are_exact(counts, gain):
    c, g = np.array(counts), np.array(gain)
    assert resample.sliced_sums(c, *resample.gain_planes(g)).tolist() == (c @ g).tolist()
