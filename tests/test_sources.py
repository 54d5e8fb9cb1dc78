import gzip

import pytest
from pyspark.sql import functions as F

from spliceweave.operators import null_model
from spliceweave.sources import text, write


def put(path, content):
    path.write_text(content)
    return str(path)


def test_junctions(spark, tmp_path):
    p = put(tmp_path / "a.junc", "chr1\t960660\t961744\t6\t+\t960800\t961628\t140,116 TGCACCTAGGTCGGAT\tGCGCGCGCGT\n"
            "chr1\t961651\t961879\t4\t+\t961750\t961825\t99,54\tTGCACCTAGGTCGGAT\tGCGCGCGCGT\n")
    rows = text.read_junctions(spark, p).collect()
    assert len(rows) == 2 and rows[0].umi == "GCGCGCGCGT"
    for r in rows:
        assert r.j_start == r.read_start + r.anchors[0] and r.j_end == r.read_end - r.anchors[1]


def test_stat_nonsplit_barcodes(spark, tmp_path):
    (tmp_path / "s").mkdir()
    put(tmp_path / "s" / "D1%3A1.stat", "chr10:+:124484326:124488421\t1\nchr10:+:125719915:125721203\t3\n")
    put(tmp_path / "s" / "D2%3A1.stat", "chr10:+:22931995:22925636\t2\n")
    got = {(r.metacell, r.j_start, r.j_end, r.n) for r in text.read_stat(spark, str(tmp_path / "s")).collect()}
    assert got == {("D1:1", 124484326, 124488421, 1), ("D1:1", 125719915, 125721203, 3), ("D2:1", 22925636, 22931995, 2)}
    assert {r.stem for r in text.directory(spark, str(tmp_path / "s" / "*.stat")).collect()} == {"D1:1", "D2:1"}
    n = put(tmp_path / "x.nonsplit", "chr10:100523886:-:CATCCC:CGCGG 5\n")
    r = text.read_nonsplit(spark, n).first()
    assert (r.source, r.chrom, r.strand, r.pos, r.cb, r.umi, r.n) == ("x", "chr10", "-", 100523886, "CATCCC", "CGCGG", 5)
    b = put(tmp_path / "D1%3A1.barcode", "AAA\nCCC\n")
    assert {tuple(r) for r in text.read_barcodes(spark, b).collect()} == {("AAA", "D1:1"), ("CCC", "D1:1")}


def test_intron_lists(spark, tmp_path):
    p = put(tmp_path / "a.inclu_exclu",
            "chr10:+:73 110985627 included 110919657:110985627 excluded 110919657:110951607 110919657:110964124\n"
            "chr10:+:76 111114416 included 111114416:111114902 111114416:111117959 excluded\n")
    rows = {r.pos: r for r in text.read_inclu_exclu(spark, p).collect()}
    assert [tuple(x) for x in rows[110985627].included] == [(110919657, 110985627)]
    assert len(rows[110985627].excluded) == 2
    assert len(rows[111114416].included) == 2 and rows[111114416].excluded == []
    q = put(tmp_path / "a.refined", "chr10:+:115 119207969:119326515:530 119207969:119380814:38 119326611:119380814:182\n")
    assert [tuple(x) for x in text.read_refined(spark, q).first().introns][1] == (119207969, 119380814, 38)


def test_wide_matrices(spark, tmp_path):
    s = put(tmp_path / "names", "A:1\nB:1\nC:1\n")
    samples = text.read_samples(spark, s)
    io = put(tmp_path / "a.intron.out", "chr10:+:233 chr10:+:22925636:22931995 2 0 1\n")
    assert sorted((r.sample, r.n) for r in text.read_intron_out(spark, io, samples).collect()) == [("A:1", 2), ("B:1", 0), ("C:1", 1)]
    plain = put(tmp_path / "a.site", "chr10:-:16816972 11:13 11:11 14:18\n")
    rows = sorted(text.read_site(spark, plain, samples).collect(), key=lambda r: r.sample_idx)
    assert [(r.sample, r.included, r.total) for r in rows] == [("A:1", 11, 13), ("B:1", 11, 11), ("C:1", 14, 18)]
    assert rows[0].strand == "-" and rows[0].pos == 16816972
    filtered = put(tmp_path / "a.filtered", "A:1 B:1 C:1\nchr10:-:16816972 11:13 11:11 14:18\n")
    df = text.read_site(spark, filtered)
    assert sorted((r.sample, r.included) for r in df.collect()) == [("A:1", 11), ("B:1", 11), ("C:1", 14)]
    ratio = df.withColumn("ratio", F.col("included") / F.col("total"))
    line = write.prop_lines(ratio).first().value
    assert line == "chr10:-:16816972 0.846154 1.000000 0.777778"
    prop = put(tmp_path / "a.prop", "A:1 B:1 C:1\n" + line + "\n")
    assert {r.sample: r.ratio for r in text.read_prop(spark, prop).collect()}["C:1"] == pytest.approx(0.777778)
    assert write.site_lines(df).first().value == "chr10:-:16816972 11:13 11:11 14:18"
    out = str(tmp_path / "out")
    write.write_lines(out, write.site_lines(df), write.header_line(text.header_samples(spark, filtered)))
    assert text.read_site(spark, out).count() == 3


def test_model_inputs(spark, tmp_path):
    cov = put(tmp_path / "a.PC", "A:1\tB:1\n-2.78\t-2.54\n1.36\t0.62\n")
    x = {r.sample: r.x for r in text.covariate_vectors(text.read_covariates(spark, cov)).collect()}
    assert x == {"A:1": [-2.78, 1.36], "B:1": [-2.54, 0.62]}
    g = put(tmp_path / "GRM.txt", "D1 D2\nD1 0.98 0.03\nD2 0.03 0.97\n")
    entries, labels = text.read_grm(spark, g)
    assert sorted(tuple(r) for r in entries.collect()) == [(0, 0, 0.98), (0, 1, 0.03), (1, 0, 0.03), (1, 1, 0.97)]
    lone = spark.createDataFrame([("D1",), ("D9",)], "donor string")
    assert [r.donor for r in null_model.missing_donors(lone, labels).collect()] == ["D9"]
    for head in ("donor_id\trs1\trs2\n", ""):
        m = put(tmp_path / f"m{len(head)}", head + "D001\t0\tNA\nD002\t1\t2\n")
        assert {r.donor_idx: list(r.dosage) for r in text.read_markers(spark, m).collect()} == {0: [0.0, None], 1: [1.0, 2.0]}
    grp = put(tmp_path / "a.group", "0\n2\n2\n")
    assert sorted(tuple(r) for r in text.read_groups(spark, grp).collect()) == [(0, 0), (1, 2), (2, 2)]


def test_null_model_file(spark, tmp_path):
    body = ("Converged     chr19:+:34254614        0.89        0.015\nresiduals\t0.031698\t0.02629\t0.015532\n"
            "pi\t0.984151\t0.986855\t0.984468\ntotal\t2\t2\t1\ny\t2\t2\t1\n")
    p = put(tmp_path / "a.middle", body)
    m = text.read_null_models(spark, p)
    r = m.first()
    assert (r.site, r.status, r.sqrt_r, r.tau_g, r.pos) == ("chr19:+:34254614", "Converged", 0.89, 0.015, 34254614)
    for res, pi, n, y in zip(r.residuals, r.pi, r.total, r.y):
        assert res == pytest.approx(y - n * pi, abs=1e-5)
    work = {w.sample_idx: w.working_residual for w in null_model.working_residuals(m).collect()}
    assert work[0] == pytest.approx(1 - 0.984151)
    assert [r.site for r in null_model.fitted_sites(m).collect()] == ["chr19:+:34254614"]
    out = str(tmp_path / "models")
    write.write_null_models(m, out)
    back = text.read_null_models(spark, out + "/*/*.txt").first()
    assert list(back.pi) == list(r.pi)
    assert text.rename_site(m, "chr1:+:500").first().pos == 500


def test_association_files(spark, tmp_path):
    p = put(tmp_path / "a.result", "chr6:-:100847625\tchr6:100351323:C:T\t0.00253261\t0.0413224\t0.0136855\n")
    assert text.read_results(spark, p).first().p == 0.00253261
    gz = tmp_path / "g.txt.gz"
    gz.write_bytes(gzip.compress(b"variant_id\tbeta\tse\tpvalue\nchr1:5:A:T\t0.1\t0.2\tNA\n"))
    r = text.read_gwas(spark, str(gz), "ad").first()
    assert (r.variant_id, r.beta, r.p, r.study) == ("chr1:5:A:T", 0.1, None, "ad")
    t = put(tmp_path / "truth", "1\tsnp7\tchr2_100_900\n")
    assert tuple(text.read_ground_truth(spark, t).first()) == ("snp7", "chr2", 100, 900)
    s = put(tmp_path / "sum", "\t".join(["chr1:+:5", "chr1:9:A:T", "a", "b", "c", "d", "sig_splice", "G1", "G2"]) + "\n"
            + "\t".join(["chr1:+:6", "chr1:9:A:T", "a", "b", "c", "d", "no", "G1", "G2"]) + "\n")
    assert [x.site for x in text.significant(text.read_gene_summary(spark, s)).collect()] == ["chr1:+:5"]
    v = put(tmp_path / "a.vcf", "##x\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tD1\tD2\n"
            "chr1\t10\trs1\tA\tG\t.\tPASS\tAC=1;AF=0.25;AN=4\tGT\t0|1\t./.\n")
    assert text.read_vcf(spark, v).first().info == "AC=1;AF=0.25;AN=4"
    var, donors = text.read_vcf_genotypes(spark, v)
    assert list(var.first().dosage) == [1.0, None] and donors.count() == 2
    sim = put(tmp_path / "geno.txt", "S1 S2\nsnp1 0 NA\n")
    assert {(r.donor, r.dosage) for r in text.read_simulated_genotypes(spark, sim).collect()} == {("S1", 0.0), ("S2", None)}
    bed = put(tmp_path / "p.bed", "#Chr\tstart\tend\tID\tS1\tS2\nchr1\t1\t2\tx\t0.5\t0.7\n")
    assert {(r["sample"], r.value) for r in text.read_bed_phenotype(spark, bed).collect()} == {("S1", 0.5), ("S2", 0.7)}
    cm = put(tmp_path / "cm.csv", "g1,1,2\ng2,3,4\n")
    assert sorted(tuple(r) for r in text.read_count_matrix(spark, cm).collect()) == [(0, 0, 1.0), (0, 1, 2.0), (1, 0, 3.0), (1, 1, 4.0)]
    with pytest.raises(ValueError):
        text.read_cells(spark, "x", "raw")


def test_writers(spark, tmp_path):
    df = spark.createDataFrame([("s", "v", 0.5, 0.1, 0.2), ("s", "w", 0.01, 0.1, 0.2)], "site string, snp string, p double, beta double, se double")
    write.write_results(df, str(tmp_path / "r"), 0.05)
    assert text.read_results(spark, str(tmp_path / "r")).count() == 1
    assert not write.write_if_any(df.filter("p > 2"), str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()
    write.write_by_key(df, str(tmp_path / "k"), ["snp"])
    assert sorted(p.name for p in (tmp_path / "k").glob("snp=*")) == ["snp=v", "snp=w"]
    counts = spark.createDataFrame([("c", "i", "A", 2)], "cluster_id string, intron string, metacell string, n bigint")
    samples = spark.createDataFrame([(0, "A"), (1, "B")], "sample_idx int, metacell string")
    full = write.dense_counts(counts, samples, 2, ["cluster_id", "intron"])
    assert write.intron_lines(full).first().value == "c i 2 0"
    geo = spark.createDataFrame([("chr1", 5), ("chr1", 1)], "chrom string, pos bigint")
    write.write_sorted(geo, str(tmp_path / "sorted"), files=2)
    assert spark.read.parquet(str(tmp_path / "sorted")).filter("pos < 3").count() == 1


def test_guards_and_slices(spark, tmp_path):
    from spliceweave.operators import ordering, phenotype

    gone = text.read_if_present(spark, str(tmp_path / "none.result"), text.read_results, "site string, snp string, p double, beta double, se double")
    assert gone.count() == 0 and gone.columns[0] == "site"
    p = put(tmp_path / "meta", "\n".join(f"c{i} {'Source' if i % 2 else 'Target'}" for i in range(10)) + "\n")
    assert text.lines_with(spark, p, "Source").count() == 5
    assert [r.value.split()[0] for r in ordering.row_slice(text.lines(spark, p), 9, 12).collect()] == ["c8", "c9"]
    assert ordering.row_slice(text.lines(spark, p), 11, 20).count() == 0
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    names = spark.createDataFrame([("b", 1), ("a", 2), ("b", 3)], "k string, ord int")
    assert [r.v for r in phenotype.rows_by_name(df, names, "k").collect()] == [2, 1, 2]


def test_sam(spark, tmp_path):
    p = put(tmp_path / "a.sam", "@HD\tVN:1.6\nr\t16\tchr1\t101\t60\t10M100N20M\t*\t0\t0\tAC\tII\tNH:i:1\tCB:Z:AAA-1\tUB:Z:GG\n"
            "u\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n")
    assert [tuple(r) for r in text.read_sam(spark, p).collect()] == [("chr1", 100, "10M100N20M", 16, 60, "AAA-1", "GG")]


def test_site_with_two_roles(spark):
    from spliceweave.operators import introns

    df = spark.createDataFrame([("c", "+", 5, "start"), ("c", "+", 5, "end"), ("c", "+", 9, "end")], "chrom string, strand string, pos bigint, side string")
    assert {r.site for r in introns.with_site_name(df).collect()} == {"c:+:5:start", "c:+:5:end", "c:+:9"}
