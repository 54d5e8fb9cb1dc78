"""The pipeline's stages, one after the other, and the registered queries on the smallest tables."""
import hashlib
import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from spliceweave.llm import queries
from tests.check_catalog import TABLES, compare

SF = "/root/testdata/sf0.001"


def test_stages_only_take_rows_away(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    every = {r.doc_id: r for r in docs.collect()}
    before = set(every)
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if i == len(corpus_pipeline.STAGES) - 1:
            break
        assert out.columns == docs.columns and dict(out.dtypes) == dict(docs.dtypes), name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept = [r.doc_id for r in docs.collect()]
        assert len(kept) == len(set(kept)) and set(kept) <= before, name
        assert all(every[r.doc_id] == r for r in docs.collect()), name
        before = set(kept)
    rows = out.collect()
    assert {r.doc_id for r in rows} == before
    assert all(r.decoded_sha256 == hashlib.sha256((every[r.doc_id].text or "").encode()).hexdigest() for r in rows)


@pytest.mark.parametrize("rows", [
    [], [(None, None), (1, None), (2, ""), (2, ""), (None, "a b"), (3, "a  b"), (4, "x" * 200_000), (5, "word " * 50_000), (5, "word " * 50_000)]])
def test_stages_take_odd_rows(spark, rows):
    """Empty tables, null texts and ids, repeated rows, long texts and columns named as those of steps."""
    docs = spark.createDataFrame([(i, t, "en", "s1", 1, "x", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, id string, __at int")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF)
        left = out.collect()
        assert len(left) <= len(rows) and ("token" in " ".join(out.columns) or out.columns == docs.columns), name
        assert bool(left) == bool(rows), name


def test_run_gives_the_last_stage(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and len({r.doc_id for r in rows}) == len(rows)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    verdict = compare(spark, con, SF, name)
    assert verdict.startswith("ok") or "(no sql)" in verdict, verdict
    assert name in entry.queries()


def test_kernels_run_from_any_folder(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    code = f"""
import sys; sys.path.insert(0, {root!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").getOrCreate()
import __spark_entry__ as e
print("rows", e.queries()["op1_simhash_near_dedup"](spark, {SF!r}).count())
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "rows 200" in said.stdout, said.stderr[-2000:]
