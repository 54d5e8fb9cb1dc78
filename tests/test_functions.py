import math
from statistics import NormalDist

import numpy as np
import pytest
from pyspark.sql import functions as F

from spliceweave.functions import distributions as d
from spliceweave.functions import genotype, keys


def test_two_sided_p(spark):
    zs = [0.0, 0.1, 0.45, 0.66, 0.67, 1.0, 1.96, 3.0, 5.6, 5.7, 8.0, 20.0, 37.0, -2.5]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", d.two_sided_p("z").alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(math.erfc(abs(r.z) / math.sqrt(2)), rel=1e-11)


def test_printed_association_rows(spark):
    rows = [(0.0413224, 0.0136855, 0.00253261), (0.00847691, 0.0573062, 0.882403), (-0.00176255, 0.00233887, 0.451096)]
    df = spark.createDataFrame(rows, "b double, s double, p double").withColumn("z", F.col("b") / F.col("s"))
    for r in df.select("p", d.two_sided_p("z").alias("got")).collect():
        assert r.got == pytest.approx(r.p, rel=2e-4)


def test_norm_ppf(spark):
    ps = [1e-300, 1e-100, 1e-12, 0.001, 0.074, 0.076, 0.5, 0.92, 0.99999]
    got = spark.createDataFrame([(p,) for p in ps], "p double").select("p", d.norm_ppf("p").alias("q")).collect()
    for r in got:
        assert r.q == pytest.approx(NormalDist().inv_cdf(r.p), abs=1e-12)


def test_correlation_p(spark):
    got = spark.createDataFrame([(0.5, 12), (0.0, 12), (1.0, 5), (0.3, 2)], "r double, n bigint").select(
        d.correlation_p("r", "n").alias("p")).collect()
    assert got[0].p == pytest.approx(0.0978, abs=2e-4)
    assert got[1].p == pytest.approx(1.0)
    assert got[2].p == 0.0
    assert got[3].p is None
    assert d.student_t_p_values(np.array([12.7062047]), np.array([1.0]))[0] == pytest.approx(0.05, rel=1e-6)


def test_dosage(spark):
    gts = ["0|0:1", "0|1", "1|0:x", "1|1", "0/1", "./.", None]
    df = spark.createDataFrame([(i, g) for i, g in enumerate(gts)], "i int, g string")
    assert [r.d for r in df.orderBy("i").select(genotype.dosage("g").alias("d")).collect()] == [0, 1, 1, 2, None, None, None]
    assert [r.d for r in df.orderBy("i").select(genotype.dosage("g", True).alias("d")).collect()][4] == 1


def test_keys(spark):
    row = spark.range(1).select(
        keys.variant_locus(F.lit("chr10:5:A:T")).alias("v"), keys.token(F.lit("a:b"), 3).alias("missing"),
        keys.drop_suffix(F.lit("ACGT-1x")).alias("cut"), keys.strip_chr(F.lit("chr17")).alias("c"),
        keys.cell_barcode(F.lit("Source:D1"), F.lit("L2_ACG-1")).alias("a"), keys.cell_barcode(F.lit("Target:D1"), F.lit("ACG-1")).alias("b"),
        genotype.ref_frequency(F.lit("AC=1;AF=0.25;AN=4")).alias("f")).first()
    assert (row.v, row.missing, row.cut, row.c, row.f) == ("CHR10:5", None, "ACGT", "17", 0.75)
    assert tuple(row.a) == ("Source", "D1", "L2", "ACG") and tuple(row.b) == ("Target", "D1", None, "ACG")
