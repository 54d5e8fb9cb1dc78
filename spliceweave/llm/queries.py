"""Queries on the training-data tables, and their SQL checks where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceweave.llm import (
    block_dedup, bpe, embed_dedup, fill_middle, license_scan, mixing, packing, preference, quality, resample, simhash, toxicity, url_rules,
)
from spliceweave.llm.common import table
from spliceweave.session import cut_lineage

RANKS = "byte_bpe_50k.tiktoken"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, max_bits=3)
    return found.select(F.col("id").alias("doc_id"), simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_dedup.exact_duplicates(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), fraction=1.0, max_epochs=3).select(
        "doc_id", "domain", "lang", "source", "n_tokens", "budget", "copies")


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks, pattern = public_tokenizers.path(RANKS), public_tokenizers.PATTERN
    return bpe.digests(bpe.encode(table(spark, sf_dir, "documents"), ranks, pattern, decoded=True))


def op5_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(table(spark, sf_dir, "embeddings"), threshold=0.98)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = quality.score_quality(docs, quality.fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lexicon, scale = toxicity.learn(docs, table(spark, sf_dir, "labels"))
    scored = toxicity.score_toxicity(docs, lexicon, scale=scale)
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_words")


def op10_preference_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = preference.format_preferences(*preference.repetition_pairs(table(spark, sf_dir, "conversations"), seed=7))
    spans = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws("-", s["start"].cast("string"), s["end"].cast("string"))), ",")
    return rows.select(F.col("pair_id").alias("conv_id"), "prompt_turns", "prompt", "chosen", "rejected",
                       spans("chosen_spans").alias("chosen_spans"), spans("rejected_spans").alias("rejected_spans"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_middle.fill_in_middle(table(spark, sf_dir, "documents"), rate=100, spm_rate=50, seed=7)
    sha = lambda c: F.sha2(F.encode(c, "UTF-8"), 256)
    back = fill_middle.restored(F.col("output"), F.col("form"))
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(back).alias("restored_sha256"))


def op12_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    vocabulary, pattern = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    pieces = packing.token_pieces(table(spark, sf_dir, "documents"), vocabulary, pattern, size=2048, end_id=0)
    return packing.pack(cut_lineage(pieces.drop("ids")), size=2048)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return resample.importance_resample(docs, target, percent=25, min_words=20, seed=7).select("doc_id", "n_features", "weight", "score", "rank")


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_exact_dedup, op3_source_mixing, op4_byte_bpe, op5_url_rules, op6_embedding_near_dedup, op7_quality_classifier,
    op8_license_scan, op9_toxicity, op10_preference_format, op11_fill_in_middle, op12_best_fit_packing, op13_importance_resampling,
)}

ORACLES = {
    "op2_exact_dedup": r"""
        WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept,
               sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
    "op11_fill_in_middle": r"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
        u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS units,
                     [('0x' || substr(h, 1 + 8 * i, 8))::BIGINT FOR i IN [0, 1, 2, 3]] AS w FROM d),
        c AS (SELECT *, least(w[1] % (len(units) + 1), w[2] % (len(units) + 1)) AS lo, greatest(w[1] % (len(units) + 1), w[2] % (len(units) + 1)) AS hi,
                     CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR w[3] % 100 >= 100 THEN 'plain'
                          WHEN w[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM u),
        s AS (SELECT *, array_to_string(units[1:lo], '') AS p, array_to_string(units[lo + 1:hi], '') AS m, array_to_string(units[hi + 1:], '') AS s FROM c)
        SELECT doc_id, len(units) AS n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
               sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
               sha256(t) AS restored_sha256
        FROM s""",
    "op10_preference_format": """
        WITH t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
        b AS (SELECT conv_id, min(turn) AS first, max(turn) FILTER (WHERE role = 'assistant') AS last FROM t GROUP BY conv_id),
        a AS (SELECT conv_id, any_value(last) AS last, arg_min(turn, sha256('7:' || conv_id || ':' || turn)) AS astray
              FROM t JOIN b USING (conv_id) WHERE role = 'assistant' AND turn > first GROUP BY conv_id),
        s AS (SELECT conv_id, arg_max(text, (CASE WHEN role = 'assistant' THEN 1 ELSE 0 END) * 1000000 + turn) AS said
              FROM t JOIN a USING (conv_id) WHERE turn < astray GROUP BY conv_id),
        u AS (SELECT conv_id, turn, '<|' || role || '|>' || chr(10) AS head, role = 'assistant' AS learn, text AS c,
                     CASE WHEN role = 'assistant' AND turn >= astray THEN said ELSE text END AS r, chr(10) || '<|end|>' || chr(10) AS mark
              FROM t JOIN a USING (conv_id) JOIN s USING (conv_id) WHERE turn <= last),
        d AS (SELECT *, min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY conv_id) AS differs FROM u),
        e AS (SELECT *, coalesce(sum(length(head || c || mark)) OVER w, 0) AS at_c, coalesce(sum(length(head || r || mark)) OVER w, 0) AS at_r
              FROM d WHERE differs IS NOT NULL
              WINDOW w AS (PARTITION BY conv_id, turn >= differs ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
        SELECT conv_id, (count(*) FILTER (WHERE turn < differs))::INT AS prompt_turns,
               coalesce(string_agg(head || c || mark, '' ORDER BY turn) FILTER (WHERE turn < differs), '') AS prompt,
               string_agg(head || c || mark, '' ORDER BY turn) FILTER (WHERE turn >= differs) AS chosen,
               string_agg(head || r || mark, '' ORDER BY turn) FILTER (WHERE turn >= differs) AS rejected,
               string_agg((at_c + length(head))::BIGINT || '-' || (at_c + length(head || c || mark))::BIGINT, ',' ORDER BY turn)
                   FILTER (WHERE learn AND turn >= differs) AS chosen_spans,
               string_agg((at_r + length(head))::BIGINT || '-' || (at_r + length(head || r || mark))::BIGINT, ',' ORDER BY turn)
                   FILTER (WHERE learn AND turn >= differs) AS rejected_spans
        FROM e GROUP BY conv_id""",
}
