import math
import os
import random
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spliceweave.operators import (
    association, components, correlation, gwas, intervals, introns, junctions, metacells, multiple_testing, null_model,
    ordering, phenotype, relatedness, retention, splicing_pcs, strata,
)

FEW = settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))


def bh(ps):
    n = len(ps)
    idx = sorted((i for i, p in enumerate(ps) if p is not None), key=lambda i: -ps[i])
    out, best, k = [None] * n, 1.0, len(idx)
    for rank, i in enumerate(idx):
        best = min(best, n * ps[i] / (k - rank))
        out[i] = best
    return out


def test_bh_hand_example(spark):
    ps = [0.005, 0.02, 0.03, 0.005, None, 0.04]
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    got = {r.i: r.q for r in multiple_testing.benjamini_hochberg(df).collect()}
    want = bh([0.005, 0.02, 0.03, 0.005, None, 0.04])
    for i, w in enumerate(want):
        assert got[i] is None if w is None else got[i] == pytest.approx(w)


@FEW
@given(st.lists(st.one_of(st.none(), st.sampled_from([0.0, 1.0, 0.5]), st.floats(0, 1)), min_size=1, max_size=60))
def test_bh_random(spark, ps):
    df = spark.createDataFrame(list(enumerate(ps)), "i int, p double")
    got = {r.i: r.q for r in multiple_testing.benjamini_hochberg(df).collect()}
    for i, w in enumerate(bh(ps)):
        assert (got[i] is None) == (w is None) and (w is None or got[i] == pytest.approx(min(w, 1.0), abs=1e-12))


@FEW
@given(st.lists(st.tuples(st.integers(0, 25), st.integers(0, 25)), min_size=1, max_size=40))
def test_components(spark, pairs):
    df = spark.createDataFrame(pairs, "a bigint, b bigint")
    got = {r.node: r.component for r in components.connected_components(df, "a", "b").collect()}
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        root[max(ra, rb)] = min(ra, rb)
    assert got == {n: find(n) for n in root}


def test_components_long_chain(spark):
    df = spark.range(300).selectExpr("id AS a", "id + 1 AS b")
    out = components.connected_components(df, "a", "b").agg(F.min("component"), F.max("component"), F.count("*")).first()
    assert tuple(out) == (0, 0, 301)


def test_printed_cluster_has_one_component(spark):
    rows = [("chr10", "+", 119207969, 119326515, 530), ("chr10", "+", 119207969, 119380814, 38), ("chr10", "+", 119326611, 119380814, 182)]
    df = spark.createDataFrame(rows, "chrom string, strand string, j_start bigint, j_end bigint, reads bigint")
    assert {r.cluster for r in introns.intron_clusters(df).collect()} == {119207969}
    lists = {(r.pos, r.side): r for r in introns.included_excluded(df).collect()}
    site = lists[(119326515, "end")]
    assert [tuple(x) for x in site.included] == [(119207969, 119326515)]
    assert [tuple(x) for x in site.excluded] == [(119207969, 119380814)]


def test_window_joins(spark):
    rng = random.Random(3)
    sites = [(i, f"chr{rng.randint(1, 2)}", rng.randint(0, 3000)) for i in range(60)]
    snps = [(i, f"chr{rng.randint(1, 2)}", rng.randint(0, 3000)) for i in range(80)]
    a = spark.createDataFrame(sites, "site int, chrom string, pos bigint")
    b = spark.createDataFrame(snps, "snp int, chrom string, snp_pos bigint")
    for inclusive in (True, False):
        got = {(r.site, r.snp) for r in intervals.window_join(a, b, ["chrom"], "pos", "snp_pos", 100, inclusive).collect()}
        near = (lambda d: d <= 100) if inclusive else (lambda d: d < 100)
        assert got == {(s[0], v[0]) for s in sites for v in snps if s[1] == v[1] and near(abs(s[2] - v[2]))}
    got = [r.site for r in intervals.window_exists(a, b, ["chrom"], "pos", "snp_pos", 40).collect()]
    assert sorted(got) == sorted({s[0] for s in sites for v in snps if s[1] == v[1] and abs(s[2] - v[2]) < 40})


def test_window_edge(spark):
    a = spark.createDataFrame([(1, "c", 1000)], "site int, chrom string, pos bigint")
    b = spark.createDataFrame([(1, "c", 1100), (2, "c", 900), (3, "c", 1101)], "snp int, chrom string, snp_pos bigint")
    assert intervals.window_join(a, b, ["chrom"], "pos", "snp_pos", 100).count() == 2
    assert intervals.window_join(a, b, ["chrom"], "pos", "snp_pos", 100, inclusive=False).count() == 0
    assert intervals.window_exists(a, b, ["chrom"], "pos", "snp_pos", 100).count() == 0


def test_clumping_matches_sequential_rule(spark):
    rng = random.Random(5)
    rows = [("s", "chr1", rng.randint(0, 4000), rng.random() / 10) for _ in range(200)]
    df = spark.createDataFrame(rows, "study string, chrom string, pos bigint, p double")
    got = {r.pos for r in gwas.clump_leads(df, p_max=0.09, width=150).collect()}
    leads = []
    for _, _, pos, p in sorted((r for r in rows if r[3] < 0.09), key=lambda r: (r[3], r[2])):
        if all(abs(pos - q) > 150 for q in leads):
            leads.append(pos)
    assert got == set(leads)


@FEW
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=50))
def test_tertile_cuts(spark, xs):
    df = spark.createDataFrame([(float(x),) for x in xs], "x double")
    r = strata.tertile_cuts(df, "x").first()
    s, n = sorted(xs), len(xs)
    assert (r.lower, r.upper) == (s[math.ceil(n / 3) - 1], s[math.ceil(2 * n / 3) - 1])


def test_order_statistics_on_many_ties(spark):
    df = spark.range(30_000).selectExpr("CAST(id % 7 AS DOUBLE) AS x", "id % 2 AS g")
    for r in ordering.order_statistics(df, "x", [(1, 3), (1, 2), (2, 3)], ["g"]).collect():
        xs = sorted(i % 7 for i in range(30_000) if i % 2 == r.g)
        assert r.cut == xs[math.ceil(len(xs) * r.num / r.den) - 1]


def test_balanced_sample(spark):
    df = spark.range(1000).selectExpr("id", "IF(id % 10 < 3, 1, 2) AS sex", "id % 2 AS AD")
    out = strata.balanced_sample(df, "sex", ["AD"], ["id"], seed=4)
    n = {(r.AD, r.sex): r["count"] for r in out.groupBy("AD", "sex").count().collect()}
    assert n[(0, 1)] == n[(0, 2)] == 200 and n[(1, 1)] == n[(1, 2)] == 100
    again = strata.balanced_sample(df.repartition(7), "sex", ["AD"], ["id"], seed=4)
    assert {r.id for r in out.collect()} == {r.id for r in again.collect()}


def test_line_numbers(spark, tmp_path):
    spark.range(0, 997, numPartitions=5).selectExpr("CAST(id AS STRING) AS value").write.text(str(tmp_path / "t"))
    df = ordering.with_line_number(spark.read.text(str(tmp_path / "t")))
    r = df.agg(F.min("line"), F.max("line"), F.count_distinct("line")).first()
    assert tuple(r) == (0, 996, 997)


# ------------------------------------------------------------------ reads

ALN = "chrom string, pos bigint, cigar string, flag int, cb string, umi string"


def test_extract_junctions(spark):
    rows = [("chr1", 100, "10M100N20M", 0, "A", "U1"), ("chr1", 95, "15M100N12M", 0, "A", "U1"),
            ("chr1", 100, "10M100N5M", 0, "B", "U2"), ("chr1", 100, "10M2D8M60N9M1I9M70N10M", 16, "C", "U3"),
            ("chr1", 100, "5S10M20N20M", 0, "D", "U4"), ("chr1", 100, "40M", 0, "E", "U5"), ("chr1", 100, "10M100N20M", 0, None, "U6")]
    out = junctions.extract_junctions(spark.createDataFrame(rows, ALN)).collect()
    got = {(r.cb, r.j_start, r.j_end, r.strand, r.n_reads, tuple(r.anchors)) for r in out}
    assert got == {("A", 110, 210, "+", 2, (15, 20)), ("C", 120, 180, "-", 1, (20, 18)), ("C", 198, 268, "-", 1, (18, 10))}
    for r in out:
        assert r.j_start == r.read_start + r.anchors[0] and r.j_end == r.read_end - r.anchors[1]
    flipped = junctions.extract_junctions(spark.createDataFrame(rows[:1], ALN), strand="FR").first()
    assert flipped.strand == "-"


def test_extract_nonsplit(spark):
    reads = [("chr1", 4090, "20M", 0, "A", "U1"), ("chr1", 4090, "20M", 0, "A", "U1"), ("chr1", 4100, "20M", 0, "B", "U2"),
             ("chr1", 4090, "5M100N15M", 0, "C", "U3"), ("chr1", 4090, "20M", 16, "D", "U4")]
    sites = spark.createDataFrame([("chr1", "+", 4100), ("chr1", "+", 4109)], "chrom string, strand string, pos bigint")
    got = {(r.pos, r.cb, r.n) for r in retention.extract_nonsplit(spark.createDataFrame(reads, ALN), sites).collect()}
    assert got == {(4100, "A", 2), (4109, "A", 2), (4109, "B", 1)}


def test_library_keeps_equal_barcodes_apart(spark):
    junc = spark.createDataFrame([("L1", "A", "U1"), ("L2", "A", "U1"), ("L2", "A", "U1")], "library string, cb string, umi string").withColumns(
        {"chrom": F.lit("c"), "strand": F.lit("+"), "j_start": F.lit(1), "j_end": F.lit(90)})
    bars = spark.createDataFrame([("L1", "A", "D1:1"), ("L2", "A", "D2:1")], "library string, cb string, metacell string")
    assert {(r.metacell, r.n) for r in junctions.junction_stats(junc, bars).collect()} == {("D1:1", 1), ("D2:1", 1)}


def test_all_zero_and_uncovered(spark):
    rows = [("a", "m1", 0, 0), ("a", "m2", 3, 4), ("a", "m3", 0, 4), ("b", "m1", 2, 2), ("b", "m2", 2, 2)]
    usage = spark.createDataFrame(rows, "site string, metacell string, included bigint, total bigint")
    samples = spark.createDataFrame([(0, "m1"), (1, "m2"), (2, "m3")], "sample_idx int, metacell string")
    out = phenotype.filter_phenotype(usage, ["site"], samples, 3, 0.1, 0.5).collect()
    assert {(r.metacell, r.included, r.total, r.imputed) for r in out} == {("m1", 2, 4, True), ("m2", 3, 4, False), ("m3", 0, 4, False)}
    assert phenotype.retained_sites(usage, ["site"], 3, 0.1, 1 / 3).count() == 0  # strict sparsity bound
    zero = usage.withColumn("n", F.col("included")).filter("site = 'a' AND metacell <> 'm2'")
    assert phenotype.drop_all_zero(zero, ["site"]).count() == 0


# ------------------------------------------------------------------ cells

@pytest.fixture(scope="module")
def cells(spark):
    rng = np.random.default_rng(1)
    rows, cid = [], 0
    for donor, sizes in {"A": (40, 40), "B": (30, 30, 4), "C": (12,)}.items():
        for k, n in enumerate(sizes):
            for v in rng.normal(k * 8.0, 1.0, (n, 5)):
                rows.append((donor, cid, k, [float(x) for x in v]))
                cid += 1
    return rows, spark.createDataFrame([(d, c, p) for d, c, _, p in rows], "donor string, cell_id bigint, pc array<double>")


def test_knn_in_small_blocks(spark, cells):
    rows, df = cells
    got = {(r.cell_id, r["rank"]): r.neighbour for r in metacells.knn(df, 6, block=16).collect()}
    for d, c, _, p in rows:
        near = sorted((math.dist(p, q), e) for d2, e, _, q in rows if d2 == d and e != c)[:5]
        assert [got[(c, i + 1)] for i in range(5)] == [e for _, e in near]


def test_silhouette_in_small_blocks(spark, cells):
    rows, df = cells
    lab = spark.createDataFrame([(c, str(k)) for _, c, k, _ in rows], "cell_id bigint, meta string")
    a = {r.donor: r.silhouette for r in metacells.silhouette(df.join(lab, "cell_id"), block=16).collect()}
    b = {r.donor: r.silhouette for r in metacells.silhouette(df.join(lab, "cell_id")).collect()}
    assert a["C"] is None and a["A"] == pytest.approx(b["A"]) and a["A"] > 0.7


def test_metacells(spark, cells):
    rows, df = cells
    out = metacells.call_metacells(df, 10).toPandas()
    assert len(out) == len(rows) and out.groupby("metacell").size().min() >= 10
    assert (out[out.donor == "C"].meta == "0").all()
    truth = {c: k for _, c, k, _ in rows}
    a = out[out.donor == "A"].assign(k=lambda x: x.cell_id.map(truth))
    assert (a.groupby("meta").k.nunique() == 1).all() and a.meta.nunique() >= 2
    quality = {r.donor: r for r in metacells.metacell_quality(df, spark.createDataFrame(out)).collect()}
    assert quality["C"].ch is None and quality["A"].ch > 0
    with pytest.raises(ValueError):
        metacells.call_metacells(df.unionByName(df), 10)


def test_sparse_correlation(spark):
    rng = np.random.default_rng(2)
    pc, x = rng.normal(size=(30, 2)), np.maximum(rng.normal(size=30), 0)
    scores = spark.createDataFrame([(i, [float(v) for v in pc[i]]) for i in range(30)], "cell_id int, pc array<double>")
    expr = spark.createDataFrame([(i, "g", float(x[i])) for i in range(30) if x[i] > 0], "cell_id int, gene string, value double")
    got = {r.pc: r["corr"] for r in correlation.gene_pc_correlation(expr, scores, 2).collect()}
    for i in range(2):
        assert got[i + 1] == pytest.approx(np.corrcoef(x, pc[:, i])[0, 1])


def test_splicing_pcs(spark):
    rng = np.random.default_rng(3)
    m = rng.normal(size=(40, 3)) @ np.diag([5, 3, 2]) @ rng.normal(size=(3, 20)) + 0.05 * rng.normal(size=(40, 20))
    df = spark.createDataFrame([(f"s{i}", j, float(m[i, j])) for i in range(40) for j in range(20)], "site string, sample_idx int, ratio double")
    out = sorted(splicing_pcs.splicing_pcs(df, 3).collect(), key=lambda r: r.sample_idx)
    _, s, vt = np.linalg.svd(m - m.mean(axis=1, keepdims=True), full_matrices=False)
    got = np.array([r.pc for r in out])
    for i in range(3):
        assert abs(got[:, i] @ vt[i]) == pytest.approx(1.0, abs=1e-6)
    assert out[0].variance == pytest.approx(list(s[:3] ** 2), rel=1e-6)


def test_relatedness_tiles_and_missing(spark):
    rng = np.random.default_rng(4)
    g = rng.binomial(2, 0.3, (50, 7)).astype(float)
    g[3, 2] = np.nan
    df = spark.createDataFrame([(f"v{i}", [None if np.isnan(x) else float(x) for x in g[i]]) for i in range(50)], "snp string, dosage array<double>")
    got = {(r.i, r.j): r.k for r in relatedness.relatedness(df, 7, tile=3, snp_rows=16).collect()}
    f = np.nanmean(g, axis=1) / 2
    use = (f > 0) & (f < 1)
    z = ((g - 2 * f[:, None]) / np.sqrt(2 * f * (1 - f))[:, None])[use]
    for i in range(7):
        for j in range(7):
            assert got[(i, j)] == pytest.approx(np.nanmean(z[:, i] * z[:, j]))


# ------------------------------------------------------------------ models

def simulate(spark, n_sites=6, n_donors=30, per=3, seed=0, effect=0.0):
    rng = np.random.default_rng(seed)
    samples = pd.DataFrame([(d * per + k, f"D{d}:{k}", d) for d in range(n_donors) for k in range(per)], columns=["sample_idx", "metacell", "donor_idx"])
    cov = rng.normal(size=(len(samples), 2))
    geno = rng.binomial(2, 0.4, n_donors).astype(float)
    rows = []
    for s in range(n_sites):
        u = rng.normal(0, 0.5, n_donors)[samples.donor_idx]
        eta = 0.3 + 0.4 * cov[:, 0] + u + effect * geno[samples.donor_idx]
        n = rng.integers(5, 30, len(samples))
        y = rng.binomial(n, 1 / (1 + np.exp(-eta)))
        rows += [(f"chr1:+:{1000 + s}", "chr1", "+", 1000 + s, m, int(a), int(b)) for m, a, b in zip(samples.metacell, y, n)]
    pheno = spark.createDataFrame(rows, "site string, chrom string, strand string, pos bigint, metacell string, included bigint, total bigint")
    x = spark.createDataFrame([(m, [float(v) for v in c]) for m, c in zip(samples.metacell, cov)], "metacell string, x array<double>")
    return pheno, spark.createDataFrame(samples), x, geno, cov


def test_null_model_and_score_test(spark):
    pheno, samples, x, geno, cov = simulate(spark, effect=0.8)
    design = null_model.design_table(samples, x)
    models = null_model.fit_null(pheno, design, 30, n_perm=400, related=False)
    rows = models.collect()
    assert len(rows) == 6 and all(r.status == "Converged" and r.tau_g > 0 for r in rows)
    for r in rows:
        assert np.allclose(r.residuals, np.array(r.y) - np.array(r.total) * np.array(r.pi))
    snps = spark.createDataFrame([("chr1:900:A:G", "chr1", 900, [float(v) for v in geno]), ("chr1:999999:A:G", "chr1", 999999, [1.0] * 30)],
                                 "snp string, chrom string, snp_pos bigint, dosage array<double>")
    out = association.cis_qtl(models, snps, 5000).collect()
    assert len(out) == 6 and np.median([o.p for o in out]) < 0.01
    donor = np.repeat(np.arange(30), 3)
    by_site = {r.site: r for r in rows}
    for o in out:  # dense check of the blocked kernel
        r = by_site[o.site]
        pi, n, y = np.array(r.pi), np.array(r.total), np.array(r.y)
        X, w, g = np.column_stack([np.ones(90), cov]), n * pi * (1 - pi), geno[donor]
        g = g - X @ np.linalg.solve((X.T * w) @ X, (X.T * w) @ g)
        assert o.z == pytest.approx(g @ (y - n * pi) / np.sqrt(r.sqrt_r**2 * np.sum(w * g * g)), rel=1e-8)
        assert o.beta / o.se == pytest.approx(o.z)
    few = association.cis_qtl(models, snps, 5000, p_max=0.01).collect()
    assert {o.site for o in few} == {o.site for o in out if o.p <= 0.01}
    wanted = spark.createDataFrame([("chr1:900:A:G",)], "snp string")
    trans = association.trans_qtl(models, snps, wanted, site_rows=2, snp_rows=1).collect()
    assert sorted((t.site, round(t.z, 9)) for t in trans) == sorted((o.site, round(o.z, 9)) for o in out)


def test_null_model_uses_relatedness_and_markers(spark):
    pheno, samples, x, geno, _ = simulate(spark, n_sites=3, seed=1)
    grm = spark.createDataFrame([(i, j, 1.0 if i == j else 0.01) for i in range(30) for j in range(30)], "i bigint, j bigint, k double")
    rng = np.random.default_rng(0)
    marks = spark.createDataFrame([(d, [float(v) for v in rng.binomial(2, 0.5, 30)]) for d in range(30)], "donor_idx bigint, dosage array<double>")
    design = null_model.design_table(samples, x, grm, marks, grm_min=0.05)
    plain = {r.site: r.tau_g for r in null_model.fit_null(pheno, null_model.design_table(samples, x), 30, related=False).collect()}
    for r in null_model.fit_null(pheno, design, 30, mode="sample").collect():
        assert r.tau_g == pytest.approx(plain[r.site], rel=1e-6) and 0 < r.sqrt_r < 3
    with pytest.raises(ValueError):
        null_model.fit_null(pheno, design, 30, mode="other")


def test_score_test_is_calibrated(spark):
    pheno, samples, x, geno, _ = simulate(spark, n_sites=40, seed=2)
    models = null_model.fit_null(pheno, null_model.design_table(samples, x), 30, related=False)
    rng = np.random.default_rng(9)
    snps = spark.createDataFrame([(f"v{i}", "chr1", 1000, [float(v) for v in rng.binomial(2, 0.4, 30)]) for i in range(10)],
                                 "snp string, chrom string, snp_pos bigint, dosage array<double>")
    p = np.array([r.p for r in association.cis_qtl(models, snps, 5000).collect()])
    assert len(p) == 400 and 0.02 < np.mean(p < 0.05) < 0.1 and 0.4 < np.mean(p) < 0.6


def test_group_difference(spark):
    pheno, samples, x, geno, _ = simulate(spark, n_sites=2, seed=3)
    models = null_model.fit_null(pheno, null_model.design_table(samples, x), 30, related=False)
    groups = samples.select("sample_idx", F.expr("IF(donor_idx % 2 = 0, 0, 2)").alias("label"))
    label = [2.0 * (d % 2) for d in range(30)]
    snps = spark.createDataFrame([("v", "chr1", 1000, label)], "snp string, chrom string, snp_pos bigint, dosage array<double>")
    a = {r.site: r.z for r in association.diff_splicing(models, groups, null_model.design_table(samples, x)).collect()}
    b = {r.site: r.z for r in association.cis_qtl(models, snps, 5000).collect()}
    assert a == pytest.approx(b)


def test_context_models(spark):
    """An effect present in one disease group only shows up as an interaction."""
    from spliceweave.operators import context

    rng = np.random.default_rng(12)
    rows, geno = [], rng.binomial(2, 0.5, 60).astype(float)
    people = pd.DataFrame([(d * 3 + k, f"D{d}:{k}", d, 1 + d % 2, (d // 2) % 2, float(rng.normal())) for d in range(60) for k in range(3)],
                          columns=["sample_idx", "metacell", "donor_idx", "sex", "AD", "age"])
    for s, effect in (("hit", 1.2), ("none", 0.0)):
        eta = 0.2 + effect * geno[people.donor_idx] * people.AD + rng.normal(0, 0.3, 60)[people.donor_idx]
        n = rng.integers(10, 40, len(people))
        y = rng.binomial(n, 1 / (1 + np.exp(-eta)))
        rows += [(s, m, int(a), int(b)) for m, a, b in zip(people.metacell, y, n)]
    pheno = spark.createDataFrame(rows, "site string, metacell string, included bigint, total bigint")
    pairs = spark.createDataFrame([("hit", "v"), ("none", "v")], "site string, snp string")
    dosage = [None if d == 59 else float(g) for d, g in enumerate(geno)]
    long = spark.createDataFrame([("v", d, g) for d, g in enumerate(dosage)], "snp string, donor_idx bigint, dosage double")
    res = pheno.join(spark.createDataFrame(people[["metacell", "sample_idx"]]), "metacell").selectExpr(
        "site", "sample_idx", "included / total - 0.5 AS working_residual")
    design = context.disease_design(spark.createDataFrame(people), ["sex", "age", "AD"], seed=1)
    out = {r.site: r for r in context.context_effects(pheno, pairs, long, design, ["control", "case"], res).collect()}
    assert out["hit"].p_interaction < 1e-3 and out["hit"].q < 1e-2 and out["hit"].p_case < 1e-4
    assert out["none"].p_interaction > 1e-3 and out["hit"].slope_case > 0.5 > abs(out["hit"].slope_control)
    state = context.state_design(spark.createDataFrame(people.assign(state=people.age)), ["sex", "AD", "state"])
    assert {r.stratum: r["count"] for r in state.groupBy("stratum").count().collect()} == {"low": 59, "mid": 61, "high": 60}
    assert len(state.first().x) == 2 and len(state.first().x_stratum) == 1
    assert context.sex_design(spark.createDataFrame(people), ["sex", "age", "AD"]).count() <= len(people)


def test_power_summary(spark):
    df = spark.createDataFrame([("a", 1e-6), ("a", 0.5), ("b", 5e-3), ("c", 0.9)], "snp string, p double")
    assert tuple(correlation.power_summary(df).first()) == (1, 2)


def test_grouping_in_one_call(spark):
    rows = [("m1", "c", "+", 100, 200, 30), ("m2", "c", "+", 100, 200, 25), ("m1", "c", "+", 100, 300, 60), ("m2", "c", "+", 1000, 1100, 80),
            ("m1", "c", "+", 500, 600, 3)]
    stat = spark.createDataFrame(rows, "metacell string, chrom string, strand string, j_start bigint, j_end bigint, n bigint")
    g = introns.group_introns(stat, min_reads=50)
    assert {(r.j_start, r.j_end, r.single) for r in g.introns.collect()} == {(100, 200, False), (100, 300, False), (1000, 1100, True)}
    assert {(r.pos, r.side, r.metacell, r.included, r.total) for r in g.site.collect()} == {
        (100, "start", "m1", 90, 90), (100, "start", "m2", 25, 25), (200, "end", "m1", 30, 90), (200, "end", "m2", 25, 25),
        (300, "end", "m1", 60, 90), (300, "end", "m2", 0, 25)}
    assert {r.cluster_id: len(r.introns) for r in g.refined.collect()} == {"c:+:100": 2, "c:+:1000": 1}
    assert g.intron_counts.count() == 4


def test_uncovered_lead_sample_keeps_kinship(spark):
    """The fit doesn't depend on which of a donor's samples comes first, covered or not."""
    pheno, samples, x, geno, _ = simulate(spark, n_sites=2, seed=5)
    rng = np.random.default_rng(1)
    root = rng.normal(size=(30, 40))
    kin = root @ root.T / 40
    grm = spark.createDataFrame([(i, j, float(kin[i, j])) for i in range(30) for j in range(30)], "i bigint, j bigint, k double")
    first = samples.groupBy("donor_idx").agg(F.min("sample_idx").alias("sample_idx")).join(samples, ["donor_idx", "sample_idx"]).select("metacell")
    bare = first.withColumn("bare", F.lit(True))
    holes = pheno.join(bare, "metacell", "left").select(
        "site", "chrom", "strand", "pos", "metacell", *[F.when(F.col("bare").isNotNull(), F.lit(0)).otherwise(F.col(c)).cast("bigint").alias(c)
                                                        for c in ("included", "total")])
    turned = samples.withColumn("sample_idx", F.lit(89) - F.col("sample_idx"))  # another sample leads
    a, b = ({r.site: (r.tau_g, r.status) for r in null_model.fit_null(holes, null_model.design_table(s, x, grm), 30, n_perm=10).collect()}
            for s in (samples, turned))
    for site, (tau, status) in a.items():
        assert b[site][1] == status and b[site][0] == pytest.approx(tau, rel=1e-6)
    only = null_model.fit_null(holes, null_model.design_table(samples, x, grm), 30, n_perm=10, related=False)
    assert any(r.tau_g != pytest.approx(a[r.site][0], rel=1e-3) for r in only.collect())


def test_saved_models_give_the_same_tests(spark, tmp_path):
    from spliceweave.sources import text, write

    pheno, samples, x, geno, _ = simulate(spark, n_sites=3, seed=6)
    design = null_model.design_table(samples, x)
    gaps = pheno.withColumn("total", F.when(F.expr("pos = 1001 AND metacell LIKE '%:1'"), 0).otherwise(F.col("total"))).withColumn(
        "included", F.least("included", "total"))
    models = null_model.fit_null(gaps, design, 30, n_perm=50, related=False)
    write.write_null_models(write.every_sample(models, samples), str(tmp_path / "middle"))
    back = null_model.donor_sums(text.read_null_models(spark, str(tmp_path / "middle" / "*")), design, 30)
    snps = spark.createDataFrame([("v", "chr1", 1000, [float(v) for v in geno])], "snp string, chrom string, snp_pos bigint, dosage array<double>")
    direct = {r.site: r.z for r in association.cis_qtl(models, snps, 5000, p_max=1.0).collect()}
    saved = {r.site: r.z for r in association.cis_qtl(back, snps, 5000, p_max=1.0).collect()}
    assert saved == pytest.approx(direct, rel=1e-6)


def test_splicing_components_match_an_exact_svd(spark):
    from spliceweave.operators.splicing_pcs import splicing_pcs

    m = np.random.default_rng(4).uniform(size=(300, 40))  # a slowly falling spectrum
    rows = [(f"s{i}", j, float(m[i, j])) for i in range(300) for j in range(40)]
    out = splicing_pcs(spark.createDataFrame(rows, "site string, sample_idx int, ratio double"), n_pcs=8).orderBy("sample_idx").collect()
    _, size, right = np.linalg.svd(m - m.mean(axis=1, keepdims=True))
    assert np.allclose(out[0].variance, size[:8] ** 2, rtol=1e-6)
    got = np.array([r.pc for r in out])
    assert np.allclose(np.abs((got * right[:8].T).sum(axis=0)), 1, atol=1e-6)


@pytest.mark.parametrize("block", [4096, 12])
def test_no_single_move_improves_communities(spark, block):
    from spliceweave.operators import metacells

    rng = np.random.default_rng(8)
    edges = sorted({(min(a, b), max(a, b)) for a, b in rng.integers(0, 60, (240, 2)).tolist() if a != b})
    e = spark.createDataFrame([("D", a, b) for a, b in edges], "donor string, u bigint, v bigint")
    nodes = spark.createDataFrame([("D", i) for i in range(60)], "donor string, node bigint")
    comm = {r.node: r.community for r in metacells.louvain(e, nodes, block=block).collect()}
    w = np.zeros((60, 60))
    for a, b in edges:
        w[a, b] = w[b, a] = 1

    def score(c):
        same = np.array([[c[i] == c[j] for j in range(60)] for i in range(60)])
        d = w.sum(axis=1)
        return ((w - np.outer(d, d) / w.sum()) * same).sum() / w.sum()

    base, names = score(comm), set(comm.values())
    merged = [score({n: (x if c == y else c) for n, c in comm.items()}) for x in names for y in names if x < y]
    assert base > 0.2 and max(merged, default=0) <= base + 1e-9
    for n in range(60):
        assert all(score(comm | {n: c}) <= base + 1e-9 for c in {comm[j] for j in np.flatnonzero(w[n])})
    for c in names:
        inside = [n for n in comm if comm[n] == c]
        reached, queue = {inside[0]}, [inside[0]]
        while queue:
            queue += (new := [j for j in np.flatnonzero(w[queue.pop()]) if comm[j] == c and j not in reached])
            reached |= set(new)
        assert c == min(inside) and reached == set(inside)


def test_safe_moves_raise_modularity_together(spark):
    from spliceweave.operators import metacells

    rng = np.random.default_rng(4)
    edges = sorted({(min(a, b), max(a, b)) for a, b in (rng.integers(0, 40, (300, 2)) + rng.integers(0, 3, (300, 1)) * 40).tolist() if a != b})
    e = spark.createDataFrame([("D", a, b) for a, b in edges], "donor string, u bigint, v bigint")
    flow = e.selectExpr("donor", "u src", "v dst", "1.0D w").unionAll(e.selectExpr("donor", "v src", "u dst", "1.0D w"))
    state = flow.groupBy("donor", "src").agg(F.sum("w").alias("deg")).selectExpr("donor", "src node", "deg", "src comm")
    total = state.groupBy("donor").agg(F.sum("deg").alias("two_m"))
    deg = {r.node: r.deg for r in state.collect()}
    two_m = sum(deg.values())

    def quality(comm):
        mass = {}
        for n, c in comm.items():
            mass[c] = mass.get(c, 0) + deg[n]
        return sum(2 for a, b in edges if comm[a] == comm[b]) / two_m - sum(m * m for m in mass.values()) / two_m ** 2

    comm, rounds, counts = {n: n for n in deg}, 0, []
    while rows := metacells._best_moves(state, flow, total).collect():
        moves = {r.node: r.pick for r in metacells._safe_moves(metacells._best_moves(state, flow, total), rounds).collect()}
        assert moves and set(moves) <= {r.node for r in rows}
        new = comm | moves
        assert quality(new) > quality(comm)
        comm, rounds = new, rounds + 1
        counts.append(len(moves))
        state = spark.createDataFrame([("D", n, deg[n], c) for n, c in comm.items()], "donor string, node bigint, deg double, comm bigint").coalesce(1)
    assert max(counts) > 10 and rounds < 60 and quality(comm) > 0.3


def test_clumping_follows_long_chains(spark):
    rows = [("s", "chr1", 1000 * i, 1e-8 * (i + 1) / 1000, f"v{i}") for i in range(60)]
    df = spark.createDataFrame(rows, "study string, chrom string, pos bigint, p double, variant_id string")
    out = sorted((r.pos, r.variant_id) for r in gwas.clump_leads(df, 1e-7, 1500).collect())
    assert out == [(1000 * i, f"v{i}") for i in range(0, 60, 2)]


def test_one_colocalisation_row_per_locus(spark):
    rng = np.random.default_rng(2)
    pos = [1000 * i for i in range(40)]
    ids = [f"chr1:{p}" for p in pos]
    g = spark.createDataFrame([("t", v, "chr1", p, float(b), 0.1, 1e-5 if i == 7 else 0.5, 5000, "cc")
                               for i, (v, p, b) in enumerate(zip(ids, pos, rng.normal(0, 0.1, 40)))],
                              "study string, variant_id string, chrom string, snp_pos bigint, beta double, se double, p double, n_gwas bigint, trait_type string")
    q = spark.createDataFrame([("c", v, 0.1, 0.1, 1e-6 if i == 9 else 0.4, 1000) for i, v in enumerate(ids)],
                              "cell string, variant_id string, beta double, se double, p double, n_sqtl bigint")
    maf = spark.createDataFrame([(v, 0.0 if i == 3 else 0.3) for i, v in enumerate(ids)], "variant_id string, maf double")
    centres = spark.createDataFrame([("c", "t", "near", "chr1", 5000), ("c", "t", "far", "chr1", 900_000)],
                                    "cell string, study string, locus string, chrom string, pos bigint")
    out = gwas.coloc_table(q, maf, g, centres, width=20_000).collect()
    assert [(r.locus, r.nsnps, r.top_qtl, r.top_gwas) for r in out] == [("near", 26, "CHR1:9000", "CHR1:7000")]
    assert sum(out[0][f"pp_h{i}"] for i in range(5)) == pytest.approx(1)


def test_nonsplit_reads_of_listed_barcodes_only(spark):
    reads = spark.createDataFrame([("chr1", 100, "50M", 0, "A", "u1"), ("chr1", 100, "50M", 0, "B", "u2")],
                                  "chrom string, pos bigint, cigar string, flag int, cb string, umi string")
    sites = spark.createDataFrame([("chr1", "+", 120), ("chr1", "-", 120)], "chrom string, strand string, pos bigint")
    one = spark.createDataFrame([("A",)], "cb string")
    assert {r.cb for r in retention.extract_nonsplit(reads, sites).collect()} == {"A", "B"}
    assert {r.cb for r in retention.extract_nonsplit(reads, sites, barcodes=one).collect()} == {"A"}


def related_trial(seed, donors=60, per=3, sites=2):
    """Counts of donors in families of 1 to 5, with their relatedness as a plain matrix."""
    rng = np.random.default_rng(seed)
    kin, at = np.eye(donors), 0
    while at < donors:
        size = min(int(rng.integers(1, 6)), donors - at)
        kin[at:at + size, at:at + size] += 0.5 * (1 - np.eye(size))
        at += size
    shuffle = rng.permutation(donors)
    kin = kin[np.ix_(shuffle, shuffle)]
    u = np.linalg.cholesky(kin + 1e-9 * np.eye(donors)) @ rng.normal(0, 0.7, donors)
    donor = np.repeat(np.arange(donors), per)
    x = np.column_stack([np.ones(len(donor)), rng.normal(size=len(donor))])
    n = rng.integers(5, 40, len(donor)).astype(float)
    y = rng.binomial(n.astype(int), 1 / (1 + np.exp(-(0.2 + u[donor])))).astype(float)
    return y, n, x, donor, kin


@pytest.mark.parametrize("seed", range(4))
def test_family_blocks_equal_the_dense_fit(seed):
    from spliceweave.operators import glmm

    y, n, x, donor, kin = related_trial(seed)
    i, j = np.nonzero(kin)
    family = np.arange(len(kin))
    for a, b in zip(i, j):
        family[family == family[max(a, b)]] = family[min(a, b)]
    families = glmm.Families.of(family, i, j, kin[i, j])
    assert max(k.shape[1] for _, k in families.stacks) <= 5
    dense, sparse = glmm.fit_mixed(y, n, x, donor, kin), glmm.fit_mixed(y, n, x, donor, families)
    assert dense.status == sparse.status == "Converged" and dense.tau_g > 0.05
    for a, b in ((dense.tau_g, sparse.tau_g), (dense.tau_o, sparse.tau_o), (dense.pi, sparse.pi), (dense.alpha, sparse.alpha), (dense.cov, sparse.cov)):
        assert np.allclose(a, b, rtol=0, atol=1e-8)
    some = donor < 20  # families without a sample are left out, members without one change nothing
    cut, local = families.touching(np.arange(20))
    part = glmm.fit_mixed(y[some], n[some], x[some], local[donor[some]], cut)
    whole = glmm.fit_mixed(y[some], n[some], x[some], donor[some], kin[:20, :20])
    assert part.status == whole.status and abs(part.tau_g - whole.tau_g) < 1e-8 and cut.n < len(kin)


def test_many_donors_in_small_families(spark):
    donors = 100_000
    grm = spark.range(donors).selectExpr("cast(id as int) i", "explode(sequence(id - id % 4, id - id % 4 + 3)) j").selectExpr(
        "i", "cast(j as int) j", "CASE WHEN i = j THEN 1.0D ELSE 0.5D END k")
    samples = spark.range(donors).selectExpr("concat('m', id) metacell", "cast(id as int) sample_idx", "cast(id as int) donor_idx")
    pheno = spark.range(donors).selectExpr(
        "'chr1:+:5' site", "'chr1' chrom", "'+' strand", "5L pos", "concat('m', id) metacell",
        "cast(6 + 3 * (id div 4 % 3 - 1) + id % 3 - 1 as bigint) included", "12L total")
    design = null_model.design_table(samples, grm=grm, grm_min=0.05)
    assert design.filter("metacell IS NULL").agg(F.max(F.size("kin_idx")), F.count_distinct("family")).first()[:] == (4, donors // 4)
    fit = null_model.fit_null(pheno, design, donors, n_perm=20).first()
    assert fit.status == "Converged" and fit.tau_g > 0.05 and len(fit.resid) == donors and 0.5 < fit.sqrt_r < 2


def test_a_donor_without_relatedness_fails_the_job(spark):
    samples = spark.createDataFrame([("a", 0, 0), ("b", 1, 1)], "metacell string, sample_idx int, donor_idx int")
    grm = spark.createDataFrame([(0, 0, 1.0)], "i int, j int, k double")
    with pytest.raises(Exception, match="the GRM lacks donor 1"):
        null_model.design_table(samples, grm=grm).collect()


def test_dense_vectors_fill_gaps(spark):
    df = spark.createDataFrame([(3, 1.5), (0, 2.0), (7, -1.0)], "i int, v double")
    assert df.agg(null_model.dense_vector("i", "v", 9).alias("x")).first().x == [2.0, 0, 0, 1.5, 0, 0, 0, -1.0, 0]
    assert df.limit(0).agg(null_model.dense_vector("i", "v", 2).alias("x")).first().x == [0.0, 0.0]


@pytest.mark.parametrize("weights", [[1.0, 1.0], [3.0, 1.0, 0.5, 0.1], [1.0] * 10, [5.0, 0.2, 0.2, 0.2, 0.2, 0.2]])
def test_weighted_chi_square_tail(weights):
    from spliceweave.functions.distributions import weighted_chi2_sf

    lam = np.array(weights)
    drawn = (np.random.default_rng(1).chisquare(1, (400_000, len(lam))) * lam).sum(axis=1)
    for q in (0.3 * lam.sum(), lam.sum(), lam.sum() * (1 + 1e-9), 2 * lam.sum(), 4 * lam.sum()):
        want = (drawn > q).mean()
        assert abs(weighted_chi2_sf(q, lam) - want) < 0.02 * want + 0.008
    if weights == [1.0, 1.0]:  # the exact tail is exp(-q / 2)
        assert abs(weighted_chi2_sf(40.0, lam) / np.exp(-20) - 1) < 0.1
    assert weighted_chi2_sf(0.0, lam) == 1.0 and weighted_chi2_sf(5.0, np.zeros(0)) == 1.0


def test_heidi_against_plain_loops(spark):
    from spliceweave.operators import heidi

    rng = np.random.default_rng(6)
    base = rng.integers(0, 3, (8, 200)).astype(float)
    dose = np.array([np.where(rng.random(200) < 0.7, base[0], b) for b in base])
    dose[3, :20] = np.nan
    rows, truth = [], {}
    for probe in ("one", "two", "alone"):
        b_x, se_x, se_y = rng.normal(0.6, 0.05, 8), np.full(8, 0.08), np.full(8, 0.05)
        b_y = 0.4 * b_x + rng.normal(0, 0.01, 8) + (np.arange(8) % 2 * 0.5 if probe == "two" else 0)
        some = range(1) if probe == "alone" else range(8)
        rows += [(probe, f"v{i}", float(b_y[i]), 0.05, float(b_x[i]), 0.08, 1e-6 * (i + 1)) for i in some]
        rows += [(probe, "v0", 9.0, 0.05, 0.5, 0.08, 0.5)]  # a worse row of the same variant
        cor = lambda i, j: np.corrcoef(*(d[~np.isnan(dose[i] + dose[j])] for d in (dose[i], dose[j])))[0, 1]
        part = [0] + [i for i in range(1, 8) if 0.05 <= cor(0, i) ** 2 <= 0.9][:5]

        def cov(i, j):
            r, zi, zj = 1.0 if i == j else cor(i, j), b_x[i] / se_x[i], b_x[j] / se_x[j]
            return r * se_y[i] * se_y[j] / (b_x[i] * b_x[j]) + b_y[i] / b_x[i] * b_y[j] / b_x[j] * (r / (zi * zj) - 1 / (zi * zj) ** 2)

        stat = sum((b_y[i] / b_x[i] - b_y[0] / b_x[0]) ** 2 / (cov(i, i) + cov(0, 0) - 2 * cov(i, 0)) for i in part[1:])
        truth[probe] = len(part) - 1, stat
    merged = spark.createDataFrame(rows, "probe string, variant_id string, beta_gwas double, se_gwas double, beta_sqtl double, se_sqtl double, p_sqtl double")
    geno = spark.createDataFrame([(f"v{i}", [None if np.isnan(x) else float(x) for x in d]) for i, d in enumerate(dose)], "variant_id string, dosage array<double>")
    got = {r.probe: r for r in heidi.heidi(merged, geno, ["probe"], most=5).collect()}
    assert set(got) == {"one", "two"} and all(r.top == "v0" for r in got.values())
    for probe, r in got.items():
        assert r.n_variants == truth[probe][0] and abs(r.t_heidi - truth[probe][1]) < 1e-6 * (1 + truth[probe][1])
    assert got["one"].p_heidi > 0.01 > 1e-4 > got["two"].p_heidi


def test_truth_recovery_does_not_broadcast_dosages(spark, tmp_path):
    """Dosages made from a small stored table: the planner takes them for small, and they must not reach the driver."""
    usage = spark.range(40).selectExpr(
        "concat('s', id div 10) site", "'chr1' chrom", "id div 10 * 100 + 50 pos", "concat('m', id % 10) sample", "cast(id % 10 as int) donor",
        "double(id % 7) ratio")
    truth = spark.range(3).selectExpr("concat('v', id) snp", "'chr1' chrom", "id * 100 start", "id * 100 + 99 end")
    spark.range(5000).selectExpr("concat('v', id) snp", "id k").write.parquet(str(tmp_path / "v"))
    arrays = spark.read.parquet(str(tmp_path / "v")).selectExpr("snp", "transform(sequence(0, 9), d -> double((d * 3 + k) % 4 % 3)) dosage")
    long = arrays.selectExpr("snp", "posexplode(dosage) as (donor, dosage)")
    want = {}
    for s in range(3):
        x, y = [float((d * 3 + s) % 4 % 3) for d in range(10)], [float((s * 10 + d) % 7) for d in range(10)]
        want[f"s{s}", f"v{s}"] = round(float(np.corrcoef(x, y)[0, 1]), 9), 10
    for geno in (arrays, long):
        out = correlation.ground_truth_association(usage, truth, geno)
        assert {(r.site, r.snp): (round(r.r, 9), r.n) for r in out.collect()} == want
        assert "sequence" not in out._jdf.queryExecution().toString()  # read from what was stored of the truth SNPs


def test_trans_blocks_return_few_rows(spark, monkeypatch):
    """Every pair leaves its block at p_max = 1, so a block's pairs bound what a task holds."""
    sizes = {}
    real = association.over_block_pairs

    def watched(left, right, keys, left_id, right_id, left_rows, right_rows, *rest):
        sizes["pairs"] = left_rows * right_rows
        return real(left, right, keys, left_id, right_id, left_rows, right_rows, *rest)

    monkeypatch.setattr(association, "over_block_pairs", watched)
    models = spark.createDataFrame([("s", 1, 1.0, [1.0, -1.0, 0.0], [1.0] * 3, [1.0] * 3, [1 / 3], [0.0])], "site string, pos bigint, sqrt_r double, "
                                   "resid array<double>, w array<double>, xw array<double>, xwx_inv array<double>, xr array<double>")
    snps = spark.createDataFrame([("v", "chr1", 5, [0.0, 1.0, 2.0])], "snp string, chrom string, snp_pos bigint, dosage array<double>")
    assert association.trans_qtl(models, snps, snps.select("snp")).count() == 1 and sizes["pairs"] <= 1 << 17


def test_trans_groups_share_blocks(spark, monkeypatch):
    """Sites and variants are copied once a group of many blocks and not for every block of the other side; all pairs come out once, in small blocks."""
    from spliceweave.operators import blocks

    rng = np.random.default_rng(11)
    w = rng.random((120, 5)) + 0.1
    rows = [(f"s{i}", "chr1", i, 1.0, rng.normal(size=5).tolist(), w[i].tolist(), w[i].tolist(), [float(1 / w[i].sum())], [float(i % 3)]) for i in range(120)]
    models = spark.createDataFrame(rows, "site string, chrom string, pos bigint, sqrt_r double, resid array<double>, w array<double>, xw array<double>, "
                                   "xwx_inv array<double>, xr array<double>")
    dosage = [[float(v) for v in rng.integers(0, 3, 5)] for _ in range(299)] + [[0.0, float("nan"), 1.0, 2.0, 1.0]]
    snps = spark.createDataFrame([(f"v{k}", "chr1", k, d) for k, d in enumerate(dosage)], "snp string, chrom string, snp_pos bigint, dosage array<double>")
    met, real = [], type(models).repartition

    def watched(self, n, *by):
        met.append(self.count())
        return real(self, n, *by)

    monkeypatch.setattr(type(models), "repartition", watched)
    out = association.trans_qtl(models, snps, snps.select("snp"), site_rows=8, snp_rows=4)
    assert met and met[-1] <= 8 * (120 + 300)
    key = lambda r: (r.site, r.snp, round(r.z, 9), round(r.beta, 9), round(r.se, 9), round(r.p, 9))
    rows = out.collect()
    assert sorted(map(key, rows)) == sorted(map(key, association.cis_qtl(models, snps, 10**6).collect()))
    few = association.trans_qtl(models, snps, snps.select("snp"), p_max=0.2).collect()
    assert {(r.site, r.snp) for r in few} == {(r.site, r.snp) for r in rows if r.p <= 0.2}

    def sizes(x, y):
        return pd.DataFrame({"n": [len(x)], "m": [len(y)], "a": [x.i.min()], "big": [x.big.max()]})

    for k in (F.lit("x"), F.lit(None).cast("string")):
        left = spark.range(70).select(k.alias("k"), F.col("id").alias("i"), (F.col("id") + 9007199254740993).alias("big"))
        right = spark.range(90).select(k.alias("k"), F.col("id").alias("i"))
        found = blocks.over_block_pairs(left, right, ["k"], ["i"], ["i"], 10, 20, sizes, "n long, m long, a long, big long", (2, 100)).toPandas()
        assert (found.n * found.m).sum() == 70 * 90 and found.n.max() <= 10 and found.m.max() <= 20 and found.big.max() == 9007199254740993 + 69


def test_heidi_groups_hold_no_more_than_what_is_compared(spark):
    """A probe of many variants: rows beyond the top variant and the compared ones never meet in one group."""
    from spliceweave.operators import heidi

    rng = np.random.default_rng(5)
    n, most = 3000, 4
    geno = spark.createDataFrame([(f"v{i:05d}", [float(v) for v in rng.integers(0, 3, 12)]) for i in range(n)], "variant_id string, dosage array<double>")
    merged = spark.createDataFrame(
        [("one", f"v{i:05d}", float(b), 0.1, float(c), 0.1, float(p)) for i, (b, c, p) in enumerate(zip(rng.normal(1, 0.1, n), rng.normal(1, 0.1, n), rng.uniform(0, 1, n)))],
        "probe string, variant_id string, beta_gwas double, se_gwas double, beta_sqtl double, se_sqtl double, p_sqtl double")
    out = heidi.heidi(merged, geno, ["probe"], p_qtl_max=1.0, min_r2=0.01, most=most)
    assert [r.n_variants for r in out.collect()] == [most]

    def read_by(node):
        kids = node.children().iterator()
        if node.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
            return read_by(node.executedPlan())
        if node.getClass().getSimpleName().endswith("QueryStageExec"):
            return read_by(node.plan())
        if node.metrics().contains("numOutputRows") and node.getClass().getSimpleName() == "FilterExec":
            return node.metrics().apply("numOutputRows").value()
        found = None
        while found is None and kids.hasNext():
            found = read_by(kids.next())
        return found

    assert read_by(out._jdf.queryExecution().executedPlan()) == most + 1


def test_a_donor_of_some_thousand_cells_is_settled_without_rounds_between_blocks(spark, monkeypatch):
    monkeypatch.setattr(metacells, "_safe_moves", None)
    monkeypatch.setattr(metacells, "_best_moves", None)
    n = 6000
    edges = spark.range(n).selectExpr("'D' donor", "explode(array(id div 10 * 10 + (id + 1) % 10, id div 10 * 10 + (id + 3) % 10, (id + 10) % " + str(n) + ")) v", "id u")
    edges = edges.selectExpr("donor", "least(u, v) u", "greatest(u, v) v").distinct()
    nodes = spark.range(n).selectExpr("'D' donor", "id node")
    member = metacells.louvain(edges, nodes)
    assert member.count() == n and metacells.modularity(edges, member).first().modularity > 0.6


def test_distances_in_bounded_memory(spark):
    """Distances of copies are zero, ties go to the smaller id, a vector that isn't finite spoils no other, and no block x block x dimensions array is made."""
    import tracemalloc

    rng = np.random.default_rng(3)
    b = rng.normal(1, 1, (8192, 64))
    b[50:90], b[100] = b[7], b[8] + 1e-7
    want = np.array([[np.sqrt(((x - y) ** 2).sum()) for y in b[:120]] for x in b[:64]])
    tracemalloc.start()
    got = np.vstack([d for _, d in metacells._distances(b[:64], b)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.abs(got[:, :120] - want).max() < 1e-9 and got[7, 50] == 0 and peak < 60 << 20
    b[0] = np.nan
    cells = pd.DataFrame({"donor": "D", "cell_id": range(200), "pc": list(b[:200])})
    near = metacells._nearest_kernel(3, True)(cells, cells.rename(columns={"cell_id": "ref_id"}))
    assert near[near.cell_id == 60].ref_id.tolist() == [7, 50, 51] and not (near.ref_id == 0).any() and near.cell_id.nunique() == 199


def test_relatedness_makes_dosages_once(spark):
    """Neither a filter on frequencies nor the standardising may repeat the expression that dosages come from, and few keys are spread before they unfold."""
    from spliceweave.plans import tables

    made = spark.range(40).selectExpr("concat('v', id) AS snp", "transform(sequence(0, 4), d -> CAST((id * 7 + d * id) % 3 AS DOUBLE)) AS dosage")
    plan = relatedness.relatedness(made, 5)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("transform(") == 1 and "Filter" not in plan
    assert tables.genotypes(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_markers_stay_out_of_fit_blocks(spark, monkeypatch):
    """Blocks of fits get no copy of the markers; pieces of markers and parts of them give the ratio of all, with missing dosages and a donor without any."""
    pheno, samples, x, _, _ = simulate(spark, n_sites=3, seed=1)
    grm = spark.createDataFrame([(i, j, 1.0 if i == j else 0.3) for i in range(30) for j in range(30) if i // 3 == j // 3], "i bigint, j bigint, k double")
    rng = np.random.default_rng(6)
    g = [[None if rng.random() < 0.05 else float(v) for v in rng.binomial(2, 0.5, 38)] + [1.0, None] for _ in range(29)]
    whole = spark.createDataFrame(list(enumerate(g)), "donor_idx bigint, dosage array<double>")
    parted = spark.createDataFrame([(p, d, v[p::3]) for d, v in enumerate(g) for p in range(3)], "part bigint, donor_idx bigint, dosage array<double>")
    met, frame = [], type(pheno).repartition

    def watched(self, n, *by):
        met.append((by, self.columns))
        return frame(self, n, *by)

    monkeypatch.setattr(type(pheno), "repartition", watched)
    fit = lambda markers, grm=grm: {r.site: (r.sqrt_r, r.tau_g) for r in null_model.fit_null(
        pheno, null_model.design_table(samples, x, grm, markers, grm_min=0.05), 30, mode="sample").collect()}
    want = fit(whole)
    assert len(want) and all("marker" not in columns for by, columns in met if by == ("block",)) and any(by == ("block",) for by, _ in met)
    ratios = null_model.marker_ratios
    monkeypatch.setattr(null_model, "marker_ratios", lambda *a: ratios(*a, site_rows=1, entries=30 * 7, together=(2, 2)))
    got = fit(parted)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    with pytest.raises(Exception, match="no markers"):
        fit(whole.limit(0), None)


def test_many_fits_at_once_equal_single_ones():
    """Models with different samples, converging or not, get what they get alone; samples a model lacks change nothing."""
    from spliceweave.operators import glmm

    rng = np.random.default_rng(4)
    y, n, x, donor, kin = related_trial(1)
    some = rng.random((40, len(y))) < rng.uniform(0.3, 1, 40)[:, None]
    n = np.where(some, n, 0)
    y = rng.binomial(n.astype(int), 1 / (1 + np.exp(-(rng.normal(0, 2, 40)[:, None] + rng.normal(0, 0.6, (40, len(kin)))[:, donor])))).astype(float)
    y[:4] = np.where(x[:, 1] > 0, n[:4], 0)  # separated: coefficients run away
    i, j = np.nonzero(kin)
    family = np.array([min(np.flatnonzero(k)) for k in kin])
    families = glmm.Families.of(family, i, j, kin[i, j])
    fits = glmm.fit_many(y, n, x.T[None], donor, families)
    assert "Converged" in fits.status and not set(fits.status[:4]) & {"Converged"}
    for b in range(40):
        use = n[b] > 0
        one = glmm.fit_mixed(y[b, use], n[b, use], x[use], donor[use], families)
        assert (b < 4 or one.status == fits.status[b]) and np.allclose(one.alpha, fits.alpha[b], atol=1e-6 if b > 3 else 1e-2) and np.allclose(one.pi, fits.pi[b, use], atol=1e-8)
        assert one.tau_g == pytest.approx(fits.tau_g[b], abs=1e-8) and (b < 4 or np.allclose(one.cov, fits.cov[b], rtol=1e-6))


def test_marker_ratio_at_donor_level(spark):
    """The ratio of real markers against the samples-by-markers form, with missing dosages and uncovered donors; arrays of markers x samples are not made."""
    from spliceweave.operators import glmm

    y, n, x, donor, kin = related_trial(2)
    rng = np.random.default_rng(0)
    marks = np.where(rng.random((len(kin), 90)) < 0.05, np.nan, rng.binomial(2, 0.4, (len(kin), 90)).astype(float))
    use = donor < 50
    fit = glmm.fit_mixed(y[use], n[use], x[use], donor[use], kin)
    w = n[use] * fit.pi * (1 - fit.pi)
    z = np.eye(len(kin))[donor[use]]
    v = np.linalg.inv(np.diag(1 / w + fit.tau_o) + fit.tau_g * z @ kin @ z.T)
    p = v - v @ x[use] @ np.linalg.inv(x[use].T @ v @ x[use]) @ x[use].T @ v
    g = np.where(np.isnan(marks[:50]), np.nanmean(marks[:50], axis=0), marks[:50])[donor[use]]
    inv = np.linalg.inv((x[use].T * w) @ x[use])
    g = g - x[use] @ (inv @ ((x[use].T * w) @ g))
    want = np.mean(np.sum(g * (p @ g), axis=0) / np.sum(g * g * w[:, None], axis=0))
    projector = glmm.Projectors((w / (1 + fit.tau_o * w))[None], donor[use], glmm.Families.whole(kin), np.array([fit.tau_g]), x[use].T[None])
    got = null_model.marker_ratio(projector, w, x[use].T, inv, marks, np.arange(50), some=40)
    assert fit.status == "Converged" and got == pytest.approx(want, rel=1e-9)


def test_context_fits_of_a_block_share_arrays(spark, monkeypatch):
    """A call of the model for each kind of fit and not for each pair; a pair's z is that of its samples alone, one without spread stays unidentified."""
    from spliceweave.operators import context, glmm

    rng = np.random.default_rng(6)
    samples = pd.DataFrame({"metacell": [f"m{i}" for i in range(60)], "sample_idx": range(60), "ctx": [float(i % 2) for i in range(60)],
                            "x": [[float(v)] for v in rng.normal(size=60)], "stratum": [("a", "b")[i % 2] for i in range(60)]})
    samples["x_stratum"] = samples["x"]
    rows = pd.DataFrame([(f"s{s}", "v", f"m{i}", i // 3, int(rng.integers(0, 9)), 9, float(s > 0) * rng.integers(0, 3))
                         for s in range(12) for i in rng.permutation(60)[:50]], columns=["site", "snp", "metacell", "donor_idx", "included", "total", "dosage"])
    calls, fit_many = [], context.fit_many
    monkeypatch.setattr(context, "fit_many", lambda *a: calls.append(len(a[0])) or fit_many(*a))
    out = context._fit_block(60)(rows, samples)
    assert len(calls) == 3 and len(out) == 36 and set(out[out.site == "s0"].status) == {"Unidentified"}
    mine = rows[rows.site == "s5"].merge(samples, on="metacell")
    x = np.column_stack([np.ones(50), np.vstack(mine.x), mine.ctx, mine.dosage, mine.dosage * mine.ctx])
    donors, code = np.unique(mine.donor_idx, return_inverse=True)
    one = glmm.fit_mixed(mine.included.to_numpy(float), mine.total.to_numpy(float), x, code, glmm.Families.unrelated(len(donors)), 60)
    got = out[(out.site == "s5") & (out.fit == "all")].iloc[0]
    assert got.n == 50 and got.status == one.status
    assert [got.z_geno, got.z_inter] == pytest.approx((one.alpha / np.sqrt(np.diag(one.cov)))[-2:], rel=1e-7)


def test_stored_p_is_checked_in_batches(spark):
    """The summed tail finds right and wrong p, leaves NULL, and isn't 401 interpreted steps a row."""
    from spliceweave.plans import catalog

    rows = spark.createDataFrame([(0.0, 1.0), (1.96, 0.04999579), (-1.96, 0.04999579), (1.96, 0.0501), (None, None)], "z double, p double")
    out = rows.select("z", "p", catalog.p_matches(F.col("z")).alias("ok"))
    assert [r.ok for r in out.collect()] == [True, True, True, False, None]
    assert "sequence(" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_donors_of_one_block_need_no_levels_between_tasks(spark, monkeypatch):
    """Levels and cuts of a donor that fits a block are made in its block, not by rounds of joins."""
    for name in ("_merged", "_connected", "_best_moves", "_safe_moves"):
        monkeypatch.setattr(metacells, name, None)
    rng = np.random.default_rng(3)
    pairs = {(d, *sorted(map(int, p))) for d in "ab" for p in rng.integers(0, 400, (1600, 2)) if p[0] != p[1]}
    pairs |= {(d, 20 * g + i, 20 * g + j) for d in "ab" for g in range(20) for i in range(20) for j in range(i) if (i + j) % 3}
    edges = spark.createDataFrame(sorted({(d, min(u, v), max(u, v)) for d, u, v in pairs}), "donor string, u bigint, v bigint")
    member = {(r.donor, r.node): r.community for r in metacells.louvain(
        edges, edges.selectExpr("donor", "explode(array(u, v)) node").distinct()).collect()}
    for d in "ab":
        mine = [(u, v) for e, u, v in sorted({(e, min(u, v), max(u, v)) for e, u, v in pairs}) if e == d]
        comm = {n: c for (e, n), c in member.items() if e == d}
        deg, inner, mass, m = Counter(x for p in mine for x in p), Counter(), Counter(), len(mine)
        for u, v in mine:
            inner[tuple(sorted((comm[u], comm[v])))] += 1
        for n, k in deg.items():
            mass[comm[n]] += k
        assert 5 < len(mass) < 60
        assert all(n <= mass[a] * mass[b] / (2 * m) + 1e-6 for (a, b), n in inner.items() if a != b)  # no two communities gain by a merger
        for c in mass:  # connected
            left, stack = {n for n in comm if comm[n] == c}, []
            stack.append(left.pop())
            links = {n: [] for n in comm}
            for u, v in mine:
                links[u].append(v)
                links[v].append(u)
            while stack:
                near = left & set(links[stack.pop()])
                left -= near
                stack += near
            assert not left


def test_block_moves_cut_what_fell_apart():
    """A community of two parts without an edge between them is cut in its block."""
    edges = [(0, 1), (1, 2), (0, 2), (5, 6), (6, 7), (5, 7)]
    both = pd.DataFrame([(a, b, 1.0) for u, v in edges for a, b in ((u, v), (v, u))], columns=["src", "dst", "w"])
    nodes = pd.DataFrame({"donor": "D", "node": [0, 1, 2, 5, 6, 7], "deg": 2.0, "comm": 1, "two_m": 12.0, "parts": 1})
    moved = metacells._move_in_block(nodes, both)
    after = dict(zip(nodes.node, nodes.comm)) | dict(zip(moved.node, moved.pick))
    assert after[0] == after[1] == after[2] != after[5] == after[6] == after[7]


@pytest.mark.parametrize("kind", ["plain", "far", "copies", "offset", "holes", "few"])
def test_single_precision_rules_no_neighbour_out(kind):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6 if kind == "few" else 3000, 7))
    if kind == "far":
        x[:3] = [[1e4], [1e9], [-1e12]]
    if kind == "copies":
        x = x[rng.integers(0, 60, len(x))]
    if kind == "offset":
        x += 1e5
    if kind == "holes":
        x[rng.random(x.shape) < 0.01] = np.nan
    cells = pd.DataFrame({"donor": "D", "cell_id": rng.permutation(len(x)), "pc": list(x)})
    got = metacells._nearest_kernel(9, True)(cells, cells.rename(columns={"cell_id": "ref_id"}))
    ids, got = cells.cell_id.to_numpy(), {c: g.ref_id.tolist() for c, g in got.sort_values(["dist", "ref_id"]).groupby("cell_id")}
    for row in rng.permutation(len(x))[:150]:
        d = np.sqrt(np.einsum("ij,ij->i", x[row] - x, x[row] - x))
        ok = np.isfinite(d) & (np.arange(len(x)) != row)
        want = ids[ok][np.lexsort((ids[ok], d[ok]))][:9].tolist()
        assert got.get(ids[row], []) == want


def test_large_blocks_keep_places():
    mask = np.random.default_rng(0).random((37, 1003)) < 0.01
    assert all((a == b).all() for a, b in zip(metacells._places(mask), np.nonzero(mask), strict=True))


def test_context_fits_are_made_once_and_in_several_tasks(spark, tmp_path, monkeypatch):
    """FDR and slopes read stored fits, and blocks are dealt to tasks by number, as their rows are few bytes."""
    from spliceweave.operators import context

    make, folder = context._fit_block, str(tmp_path)

    def counted(max_iter):
        run = make(max_iter)

        def fit(rows, samples):
            import uuid

            from pyspark import TaskContext

            if len(rows):
                open(f"{folder}/{TaskContext.get().partitionId()}-{uuid.uuid4().hex}", "w").close()
            return run(rows, samples)

        return fit

    monkeypatch.setattr(context, "_fit_block", counted)
    rng = np.random.default_rng(4)
    people = [(f"m{i}", i, i, [float(rng.normal())], [], float(i % 2), "ab"[i % 2]) for i in range(24)]
    design = spark.createDataFrame(people, "metacell string, sample_idx int, donor_idx int, x array<double>, x_stratum array<double>, ctx double, stratum string")
    rows = [(f"s{s}", f"m{i}", int(rng.binomial(20, 0.4)), 20) for s in range(40) for i in range(24)]
    pheno = spark.createDataFrame(rows, "site string, metacell string, included bigint, total bigint")
    pairs = spark.createDataFrame([(f"s{s}", f"v{s % 7}") for s in range(40)], "site string, snp string")
    genotype = spark.createDataFrame([(f"v{v}", [float(g) for g in rng.integers(0, 3, 24)]) for v in range(7)], "snp string, dosage array<double>")
    out = context.context_effects(pheno, pairs, genotype, design, ["a", "b"]).collect()
    calls = [name.split("-")[0] for name in os.listdir(folder)]
    assert len(out) == 40 and all(r.p_interaction is not None and r.q >= r.p_interaction - 1e-12 for r in out)
    assert len(calls) <= spark.sparkContext.defaultParallelism and len(set(calls)) > 1


def test_cis_tiles_are_several_windows_long():
    """Sites are copied to the tiles of their window only: with tiles as long as a window each went to three groups."""
    pos, window = np.arange(0, 10_000_000, 1000), 500_000
    tile = association.WIDE * window
    copies = (pos + window) // tile - (pos - window) // tile + 1
    assert copies.mean() <= 1.6
