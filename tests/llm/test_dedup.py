"""Exact, near and embedding dedup against brute force, with odd input."""
import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from spliceweave.llm import block_dedup, embed_dedup, simhash

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s1", len(t or "")) for i, t in rows], DOCS)


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()) + str(rng.randint(0, 40)) for _ in range(n))


ODD = [(1, None), (2, ""), (3, " \t\n"), (4, " "), (5, "one"), (6, "ONE"), (7, "one two"), (8, "one  two"), (9, "é ü 漢字 😀"), (10, "a\x0bb\x1cc"),
       (11, "x" * 5000), (12, "x" * 5000 + "y"), (None, "one"), (None, None), (5, "one")]


def plain_fingerprint(text):
    tokens = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode().lower())
    if not tokens:
        return 0
    runs = [b" ".join(tokens[i:i + 3]) for i in range(len(tokens) - 2)] or [b" ".join(tokens)]
    h = [xxhash.xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(keys, linked):
    parent = {k: k for k in keys}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in keys:
        for b in keys:
            if linked(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {k: find(k) for k in keys}


def test_exact_duplicates_match_grouping(spark):
    rng = random.Random(3)
    base = [words(rng, n) for n in (3, 40, 400, 2000)]
    rows = ODD + [(100 + i, base[i % 4].replace(" ", rng.choice([" ", "\n", " \t "])) + rng.choice(["", "", "!"])) for i in range(80)]
    got = block_dedup.exact_duplicates(frame(spark, rows), size=16).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    want = sorted((str(i), str(min((x for x in g if x is not None), default=None)), len(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g)
    assert sorted((str(r.id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
    assert sum(r.kept for r in got) == len(groups)
    assert all(r.id == r.keep_id for r in got if r.kept)


def test_exact_duplicates_of_one_hot_text(spark):
    rows = [(i, "the same text " * 30 if i % 3 else f"text number {i} " * 20) for i in range(600)]
    got = block_dedup.exact_duplicates(frame(spark, rows), size=64).collect()
    assert {r.keep_id for r in got if r.id % 3} == {1} and sum(r.kept for r in got) == 201


def test_equal_hashes_never_merge_names(spark, monkeypatch):
    """Names compare contents: they stay apart even if every block has the same hash."""
    monkeypatch.setattr(block_dedup.F, "xxhash64", lambda *c: F.lit(7).cast("long"))
    got = block_dedup.exact_duplicates(frame(spark, [(i, f"doc {i % 5}") for i in range(50)]), size=4).collect()
    assert {r.id: r.keep_id for r in got} == {i: i % 5 for i in range(50)}


def test_drop_exact_duplicates_keeps_one_row_each(spark):
    df = frame(spark, ODD).withColumn("__sha", F.lit(1)).withColumn("row", F.lit("x"))
    out = block_dedup.drop_exact_duplicates(df)
    assert out.columns == df.columns
    left = [re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "") for r in out.collect()]
    assert len(left) == len(set(left)) == len({re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for _, t in ODD})


@pytest.mark.parametrize("df", ["exact", "near"])
def test_empty_tables(spark, df):
    empty = frame(spark, [])
    out = block_dedup.exact_duplicates(empty) if df == "exact" else simhash.near_duplicates(empty)
    assert out.count() == 0
    assert block_dedup.drop_exact_duplicates(empty).count() == 0 and simhash.drop_near_duplicates(empty).count() == 0


def test_fingerprints_match_the_definition(spark):
    rng = random.Random(1)
    rows = ODD + [(100 + n, words(rng, n)) for n in (1, 2, 3, 4, 5, 254, 255, 256, 257, 258, 600, 3000)]
    got = simhash.fingerprints(frame(spark, rows)).collect()
    assert sorted((str(r.id), r.fp % 2**64) for r in got) == sorted((str(i), plain_fingerprint(t)) for i, t in rows)


def test_windows_give_the_same_fingerprint(monkeypatch):
    text = words(random.Random(5), 4000)
    want = simhash.text_fingerprints([text], 3)[0]
    cut = simhash.text_windows
    monkeypatch.setattr(simhash, "text_windows", lambda data, overlap: cut(data, overlap, size=300))
    long = text + " " * (1 << 20)  # beyond the size that is read at once
    assert simhash.text_fingerprints([long], 3)[0] == want


def test_plans_find_every_pair():
    """Whatever thresholds are chosen: of values within the distance, some partition is within its own."""
    rng = np.random.default_rng(0)
    for bits in (0, 1, 3, 5, 8):
        for n in (50, 10_000, 10_000_000, 10**10):
            atoms = [sorted(x) for x in rng.permutation(64).reshape(8, 8).tolist()]
            share = rng.dirichlet(np.ones(9), 8)
            plan = simhash.choose_plan(atoms, share, n, bits)
            assert sum(plan.masks) == 2**64 - 1 and sum(plan.thresholds) == bits - len(plan.masks) + 1
            for _ in range(200):
                flips = sum(1 << int(b) for b in rng.choice(64, bits, replace=False))
                assert any((flips & m).bit_count() <= t for m, t in zip(plan.masks, plan.thresholds, strict=True))


def test_correlated_bits_share_an_atom():
    rng = np.random.default_rng(2)
    lead = rng.integers(0, 2, (4000, 8))
    bits = np.where(rng.random((4000, 64)) < 0.1, rng.integers(0, 2, (4000, 64)), np.repeat(lead, 8, axis=1)).astype(float)
    atoms = simhash.correlated_atoms(bits.T @ bits, 4000)
    assert sorted(atoms) == [list(range(8 * i, 8 * i + 8)) for i in range(8)]


@pytest.mark.parametrize("bucket", [2, 128])
def test_components_match_all_pairs(spark, bucket, monkeypatch):
    rng = random.Random(11)
    base = [words(rng, 60) for _ in range(12)]
    rows = list(ODD)
    for i in range(240):
        w = base[i % 12].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = f"new{rng.randint(0, 5)}"
        rows.append((100 + i, " ".join(w)))
    plain = simhash.link_fingerprints
    monkeypatch.setattr(simhash, "link_fingerprints", lambda *a, **k: plain(*a, **k, bucket_rows=bucket, block_rows=32))
    got = simhash.near_duplicates(frame(spark, rows)).collect()
    fps = {t: plain_fingerprint(t) for _, t in rows}
    comp = components(sorted(set(fps.values())), lambda a, b: (a ^ b).bit_count() <= 3)
    first = {}
    for i, t in rows:
        if i is not None:
            first[comp[fps[t]]] = min(i, first.get(comp[fps[t]], i))
    assert sorted((str(r.id), r.component_id) for r in got) == sorted((str(i), first[comp[fps[t]]]) for i, t in rows)


def test_near_stage_drops_near_copies_only(spark):
    rng = random.Random(7)
    rows = []
    for i in range(40):
        w = words(rng, 200).split()
        copy = list(w)
        copy[50] = "changed"
        half = w[:100] + words(rng, 100).split()  # similarity about a third
        rows += [(3 * i, " ".join(w)), (3 * i + 1, " ".join(copy)), (3 * i + 2, " ".join(half))]
    alone = [(None, words(rng, 200)), (None, words(rng, 200)), (None, rows[0][1] + " end")]  # without id: two stand alone, one is a near copy
    df = frame(spark, rows + alone).withColumn("id", F.lit(0)).withColumn("drop_hash", F.lit("x"))
    out = simhash.drop_near_duplicates(df)
    assert out.columns == df.columns
    left = [(r.doc_id, r.text) for r in out.collect()]
    assert sorted(i for i, _ in left if i is not None) == sorted(i for i, _ in rows if i % 3 != 1)
    assert sorted(t for i, t in left if i is None) == sorted(t for _, t in alone[:2])


VECTORS = "vec_id long, embedding array<float>, label int, text string"


def vectors(seed=0, n=400, d=16):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 4, d))
    rows = []
    for i in range(n):
        v = base[rng.integers(len(base) // 3)] + rng.choice([0, 0.02, 0.06]) * rng.normal(size=d)
        rows.append([i, [float(np.float32(x)) for x in v], int(rng.integers(3)), "t"])
    rows += [[n + i, rows[5][1], rows[5][2], "copy"] for i in range(60)]
    rows += [[n + 100, None, 1, ""], [n + 101, [0.0] * d, 1, ""], [n + 102, [float("nan")] + [1.0] * (d - 1), 1, ""], [n + 103, rows[5][1], None, ""],
             [n + 104, [None] + [1.0] * (d - 1), 1, ""], [n + 105, [1.0, 2.0], 1, ""], [n + 106, [], 1, ""], [n + 107, [float("inf")] + [1.0] * (d - 1), 1, ""],
             [n + 108, [10 * x for x in rows[5][1]], rows[5][2], "longer"], [None, rows[5][1], rows[5][2], "no id"]]
    return rows


@pytest.mark.parametrize("blocks,cells", [(2048, 512), (16, 8)])
def test_embedding_links_match_all_pairs(spark, blocks, cells):
    rows = vectors()
    out = {r.vec_id: r for r in embed_dedup.near_vectors(spark.createDataFrame(rows, VECTORS), recall=1.0, cell_rows=cells, block_rows=blocks).collect()}
    good = [r for r in rows if r[0] is not None and r[2] is not None and r[1] and len(r[1]) == 16 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])]
    x = np.array([r[1] for r in good])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    label = np.array([r[2] for r in good])
    links = (x @ x.T >= 0.98) & (label[:, None] == label[None, :])
    np.fill_diagonal(links, False)
    comp = components(list(range(len(good))), lambda a, b: links[a, b])
    want = {good[i][0]: (int(links[i].sum()), good[comp[i]][0]) for i in range(len(good))}
    assert len(out) == len(rows)
    for i, r in out.items():
        n, c = want.get(i, (0, i))
        assert (r.n_links, r.component_id, r.kept) == (n, c, i == c or i is None)


def test_vectors_of_every_length_link_with_their_own(spark):
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for d in (1, 2, 3, 5, 8, 9, 16):
        base = rng.normal(size=(4, d))
        for _ in range(24 if d != 2 else 3):
            rows.append([i, [float(x) for x in base[rng.integers(4)] + rng.choice([0, 0.05]) * rng.normal(size=d)], int(rng.integers(2)), ""])
            i += 1
    rows += [[i, [3.0] * 20, 1, ""], [i + 1, [3.0] * 20, 1, ""], [i + 2, [3.0] * 20 + [0.0], 1, ""]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, text string")
    out = {r.vec_id: r for r in embed_dedup.near_vectors(df, recall=1.0).collect()}

    def linked(a, b):
        (_, x, p, _), (_, y, q, _) = rows[a], rows[b]
        return a != b and p == q and len(x) == len(y) and np.dot(x, y) / np.linalg.norm(x) / np.linalg.norm(y) >= 0.98 - 1e-12

    comp = components(list(range(len(rows))), linked)
    assert len(out) == len(rows)
    for a in range(len(rows)):
        assert (out[a].n_links, out[a].component_id) == (sum(linked(a, b) for b in range(len(rows))), comp[a]), rows[a]


def test_embedding_recall_at_the_default_target(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(600, 64))
    rows = [[2 * i + k, [float(y) for y in b / np.linalg.norm(b) + k * 0.18 * e / np.linalg.norm(e)], 0, ""]
            for i, b in enumerate(base) for k, e in ((0, b), (1, rng.normal(size=64)))]
    out = embed_dedup.near_vectors(spark.createDataFrame(rows, VECTORS), cell_rows=8)
    x = np.array([r[1] for r in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    true = int((x @ x.T >= 0.98).sum()) - len(rows)
    found = out.agg(F.sum("n_links")).first()[0]
    assert 0.9 * true <= found <= true and true > 500


def test_no_vectors_link(spark):
    assert embed_dedup.near_vectors(spark.createDataFrame([], VECTORS)).count() == 0
    out = embed_dedup.near_vectors(spark.createDataFrame([[1, None, 1, ""], [2, [1.0], None, ""]], VECTORS)).collect()
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in out) == [(1, 0, 1, True), (2, 0, 2, True)]


def five_word_set(text):
    w = text.split()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def test_near_stage_links_added_passages(spark):
    """One text is the other plus a block: every pair of similarity 0.80 and more must be found, wherever the block is."""
    rng = random.Random(21)
    rows = []
    for k in range(300):
        w, n = words(rng, 204).split(), 50 - k % 40  # similarity (200 - cut) / (200 + n)
        at = rng.choice([0, 204])
        other = w[:at] + words(rng, n).split() + w[at:]
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(other))]
    sets = [five_word_set(t) for _, t in rows]
    alike = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert min(alike) == pytest.approx(0.8, abs=0.001) and max(alike) > 0.9
    left = {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()}
    assert left == {2 * k for k in range(300)} | {2 * k + 1 for k in range(300) if alike[k] < 0.8}


def test_near_stage_decides_on_exact_similarity(spark):
    """Pairs just under the limit stay, pairs at and above it go, in small groups and over several blocks."""
    rng = random.Random(22)
    rows, want = [], set()
    for k in range(200):
        n = rng.choice([4, 40, 400])
        w = words(rng, n + 4).split()
        more = n // 4 + k % 2 * max(n // 100, 1)  # similarity exactly 0.8, or a little less
        rows += [(2 * k, " ".join(w)), (2 * k + 1, " ".join(w + words(rng, more).split()))]
        want |= {2 * k, 2 * k + 1} if k % 2 else {2 * k}
    assert {r.doc_id for r in simhash.drop_near_duplicates(frame(spark, rows)).collect()} == want

    texts = {}
    for i in range(60):  # one chain of changes: neighbours are alike, ends are not
        w = words(random.Random(5), 200).split()
        for j in range(i * 3):
            w[j] = f"new{j}"
        texts[i] = " ".join(w)
    for i in range(60, 70):
        texts[i] = words(rng, 60)
    sets = {i: five_word_set(t) for i, t in texts.items()}
    linked = {(i, j) for i in texts for j in texts if i < j and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])}
    group = components(texts, lambda a, b: (a, b) in linked)
    found = {r.id: r.component for r in simhash.near_groups(frame(spark, list(texts.items())), block_rows=16).collect()}
    assert all((group[i] == group[j]) == (found[i] == found[j]) for i in texts for j in texts)


def test_rows_are_split_by_id_without_loss(spark):
    from spliceweave.llm.common import split_by_ids

    docs = frame(spark, [(i, str(i)) for i in range(-500, 500)] + [(None, "n"), (7, "again")])
    wanted = spark.createDataFrame([(i,) for i in range(0, 500, 7)] + [(None,)], "id long")
    for bits in (1 << 26, 1 << 16, 4):
        some, others = (x.collect() for x in split_by_ids(docs, "doc_id", wanted, bits))
        assert len(some) + len(others) == 1002
        assert {r.text for r in some} >= {str(i) for i in range(0, 500, 7)} | {"n", "again"}
        if bits > 4:
            assert len(some) < 80
    none, every = split_by_ids(docs, "doc_id", wanted.limit(0))
    assert none.count() == 0 and every.count() == 1002
