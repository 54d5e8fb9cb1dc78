"""Split-read junctions: extraction, deduplicated counts per metacell, read thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

JUNCTION = ["chrom", "strand", "j_start", "j_end"]


def read_strand(strand_rule: str, flag="flag") -> Column:
    """Transcript strand of an alignment from its SAM flag under the RF or FR rule."""
    if strand_rule not in ("RF", "FR"):
        raise ValueError("strand rule must be RF or FR")
    f = F.col(flag) if isinstance(flag, str) else flag
    reverse = f.bitwiseAND(F.lit(16)) != 0
    first = f.bitwiseAND(F.lit(64)) != 0
    plus = reverse == first
    return F.when(plus if strand_rule == "RF" else ~plus, F.lit("+")).otherwise(F.lit("-"))


def cigar_blocks(cigar="cigar") -> Column:
    """CIGAR text to ARRAY<STRUCT<len, op>>."""
    c = F.col(cigar) if isinstance(cigar, str) else cigar
    lens = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(1))
    ops = F.regexp_extract_all(c, F.lit(r"(\d+)([MIDNSHP=X])"), F.lit(2))
    return F.zip_with(lens, ops, lambda n, o: F.struct(n.cast("bigint").alias("len"), o.alias("op")))


def _spans(blocks: Column, pos: Column) -> Column:
    """Aligned spans between N operations: ARRAY<STRUCT<s, e>> in reference coordinates."""
    start = F.struct(
        pos.cast("bigint").alias("at"),
        pos.cast("bigint").alias("s"),
        F.array().cast("array<struct<s:bigint,e:bigint>>").alias("done"),
    )

    def step(acc, b):
        moves = b["op"].isin("M", "D", "N", "=", "X")
        nxt = F.when(moves, acc["at"] + b["len"]).otherwise(acc["at"])
        is_gap = b["op"] == "N"
        closed = F.array(F.struct(acc["s"].alias("s"), acc["at"].alias("e")))
        return F.struct(
            nxt.alias("at"),
            F.when(is_gap, nxt).otherwise(acc["s"]).alias("s"),
            F.when(is_gap, F.concat(acc["done"], closed)).otherwise(acc["done"]).alias("done"),
        )

    return F.aggregate(
        blocks, start, step,
        lambda acc: F.concat(acc["done"], F.array(F.struct(acc["s"].alias("s"), acc["at"].alias("e")))),
    )


def extract_junctions(
    alignments: DataFrame,
    min_anchor: int = 8,
    min_intron: int = 50,
    max_intron: int = 500_000,
    strand: str = "RF",
) -> DataFrame:
    """Alignments (chrom, pos, cigar, flag, cb, umi) to junction records, one per (junction, CB, UMI).

    Reads sharing a CB-UMI are counted in ``n_reads`` and their widest anchors kept, so
    ``j_start = read_start + anchors[0]`` and ``j_end = read_end - anchors[1]``.
    """
    carry = [c for c in ("library",) if c in alignments.columns]
    spliced = (
        alignments.filter(F.col("cigar").contains("N") & F.col("cb").isNotNull() & F.col("umi").isNotNull())
        .withColumn("strand", read_strand(strand))
        .withColumn("__sp", _spans(cigar_blocks(), F.col("pos")))
    )
    gaps = spliced.select(
        *carry, "chrom", "strand", "cb", "umi",
        F.inline(F.expr(
            "transform(sequence(0, size(__sp) - 2), i -> struct("
            "__sp[i].s AS left_at, __sp[i].e AS j_start, __sp[i+1].s AS j_end, __sp[i+1].e AS right_at))"
        )),
    )
    merged = (
        gaps.filter((F.col("j_end") - F.col("j_start")).between(min_intron, max_intron))
        .groupBy(*carry, *JUNCTION, "cb", "umi")
        .agg(
            F.count(F.lit(1)).cast("int").alias("n_reads"),
            F.min("left_at").alias("read_start"),
            F.max("right_at").alias("read_end"),
        )
        .withColumn("anchors", F.array(
            (F.col("j_start") - F.col("read_start")).cast("int"),
            (F.col("read_end") - F.col("j_end")).cast("int"),
        ))
    )
    return merged.filter(F.least(F.col("anchors")[0], F.col("anchors")[1]) >= min_anchor).select(
        *carry, "chrom", "read_start", "read_end", "n_reads", "strand", "j_start", "j_end", "anchors", "cb", "umi"
    )


def filter_junctions(junc: DataFrame, min_anchor: int = 8, min_intron: int = 50, max_intron: int = 500_000) -> DataFrame:
    """Inclusive intron-length bounds and the anchor minimum on both sides."""
    return junc.filter(
        (F.col("j_end") - F.col("j_start")).between(min_intron, max_intron)
        & (F.least(F.col("anchors")[0], F.col("anchors")[1]) >= min_anchor)
    )


def junction_stats(junc: DataFrame, barcodes: DataFrame, sample: str = "metacell") -> DataFrame:
    """Distinct (CB, UMI) per junction and metacell, for all metacells in one job.

    ``barcodes`` lists (cb[, library], metacell). Duplicates collapse map-side before the shuffle.
    """
    keys = [k for k in ("cb", "library") if k in barcodes.columns and k in junc.columns]
    member = barcodes.select(*keys, sample).distinct()
    return (
        junc.select(*keys, *JUNCTION, "umi")
        .join(member, keys)
        .groupBy(sample, *JUNCTION)
        .agg(F.count_distinct(*keys, "umi").alias("n"))
    )


def intron_totals(stat: DataFrame, min_reads: float = 50) -> DataFrame:
    """Introns whose reads over all metacells reach the threshold."""
    return stat.groupBy(*JUNCTION).agg(F.sum("n").alias("reads")).filter(F.col("reads") >= min_reads)
