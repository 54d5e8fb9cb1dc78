"""Exact dedup by deterministic block naming.

A normalised text is cut into blocks of a fixed number of bytes. All blocks are sorted and equal ones get the same integer
name; then adjacent names are paired, the pairs are sorted and named, and so on until each document has one name. Two
documents have the same (block count, last name) exactly if their texts are equal: names come from comparing contents,
not from a digest.

Sorting is by (hash, content, row, position), dealt by ranges of (hash, row, position), so that a block that a third of
all rows share is spread over many tasks. A name is (task, run number in the task). A run may cross tasks, so each task also
reports the contents of its first and last hash, a few rows that are named together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spliceweave.llm.common import SPACE_RUN, only_names, split_by_ids
from spliceweave.session import cut_lineage, ship_package


def normalised(text: Column) -> Column:
    """Every run of white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), SPACE_RUN, " ")


def text_blocks(docs: DataFrame, size: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, sha256, blocks, pos, content): the blocks of every row; id and sha256 on the first block only."""
    data = F.encode(F.col("norm"), "UTF-8")
    rows = (
        docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), normalised(F.col(text_col)).alias("norm"))
        .select("row", "id", data.alias("data"), F.sha2(data, 256).alias("sha"))
        .withColumn("blocks", F.greatest(F.ceil(F.length("data") / size), F.lit(1)).cast("int"))
    )
    cut = rows.select("row", "id", "sha", "blocks", "data", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("pos"))
    first = F.col("pos") == 0
    return cut.select(
        "row", F.when(first, F.col("id")).alias("id"), F.when(first, F.col("sha")).alias("sha256"), "blocks", "pos",
        F.substring("data", F.col("pos") * size + 1, F.lit(size)).alias("content"),
    )


def name_by_sorting(rows: DataFrame) -> DataFrame:
    """``rows`` (row, pos, content, others) with ``name`` in place of ``content``: equal for equal contents only."""
    ship_package(rows.sparkSession)
    others = [c for c in rows.columns if c not in ("row", "pos", "content")]
    keyed = rows.select("row", "pos", *others, F.xxhash64("content").alias("__h"), "content")
    dealt = keyed.repartitionByRange("__h", "row", "pos").sortWithinPartitions("__h", "content", "row", "pos")
    fields = [f for f in keyed.schema.fields if f.name not in ("__h", "content")]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", local bigint, h bigint, edge binary"

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId() << 36
        run, last, last_h, first_h = -1, None, None, None
        tail: dict[bytes, int] = {}
        for b in batches:
            hashes, contents = b.column(len(fields)).to_pylist(), b.column(len(fields) + 1).to_pylist()
            local, edge = [], []
            for h, content in zip(hashes, contents, strict=True):
                new = content != last
                if new:
                    run, last = run + 1, content
                    first_h = h if first_h is None else first_h
                    if h != last_h:
                        tail, last_h = {}, h
                    tail[content] = run
                local.append(task | run)
                edge.append(content if new and h == first_h else None)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:len(fields)], pa.array(local, pa.int64()), pa.array(hashes, pa.int64()), pa.array(edge, pa.binary())],
                names=[*(f.name for f in fields), "local", "h", "edge"],
            )
        if last_h is not None and last_h != first_h:  # marked by a null row: not a document's block
            n = len(tail)
            empty = [pa.nulls(n, x) for x in b.schema.types[:len(fields)]]
            yield pa.RecordBatch.from_arrays(
                [*empty, pa.array([task | r for r in tail.values()], pa.int64()), pa.array([last_h] * n, pa.int64()), pa.array(list(tail), pa.binary())],
                names=[*(f.name for f in fields), "local", "h", "edge"],
            )

    sorted_rows = cut_lineage(dealt.mapInArrow(kernel, schema))
    edges = sorted_rows.filter(F.col("edge").isNotNull()).select("edge", "local")
    same = cut_lineage(
        edges.join(edges.groupBy("edge").agg(F.min("local").alias("name")), "edge").filter("local <> name").select("local", "name").distinct()
    )
    return (
        sorted_rows.filter(F.col("row").isNotNull()).drop("edge", "h").join(same, "local", "left")
        .withColumn("name", F.coalesce("name", "local")).drop("local")
    )


def document_names(docs: DataFrame, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, sha256, blocks, name) for every row; (blocks, name) is equal exactly for equal normalised texts.

    One stored table a level; levels grow with the logarithm of the longest text.
    """
    level = cut_lineage(name_by_sorting(text_blocks(docs, size, id_col, text_col)).withColumn("width", F.col("blocks")))
    done = []
    while True:
        done.append(level.filter("width = 1").select("row", "id", "sha256", "blocks", "name"))
        rest = level.filter("width > 1")
        if rest.isEmpty():
            break
        name = lambda side: F.coalesce(F.max(F.when(F.col("pos") % 2 == side, F.col("name"))), F.lit(-1))
        pairs = (
            rest.groupBy("row", (F.col("pos") / 2).cast("int").alias("pos"), "blocks", "width")
            .agg(F.max("id").alias("id"), F.max("sha256").alias("sha256"), name(0).alias("x"), name(1).alias("y"))
            .select("row", "id", "sha256", "blocks", "pos", F.ceil(F.col("width") / 2).cast("int").alias("width"),
                    F.concat(F.to_binary(F.lpad(F.hex("x"), 16, "0"), F.lit("hex")), F.to_binary(F.lpad(F.hex("y"), 16, "0"), F.lit("hex"))).alias("content"))
        )
        level = cut_lineage(name_by_sorting(pairs))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def exact_duplicates(docs: DataFrame, size: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) for every row of ``docs``.

    Texts are equal when they agree after each run of white space becomes one space; null counts as empty. The row with the
    smallest id stays (null ids count last; of repeated rows with that id one stays). keep_id is the smallest id, null only
    if the group has none. Other columns are ignored; an empty table gives an empty result.
    """
    names = cut_lineage(document_names(docs, size, id_col, text_col))
    group = ["blocks", "name"]
    best = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row"))
    groups = cut_lineage(
        names.groupBy(*group).agg(F.count(F.lit(1)).alias("group_size"), best.alias("best")).filter("group_size > 1")
        .select(*group, "group_size", F.col("best.id").alias("keep_id"), F.col("best.row").alias("keep_row"))
    )
    return names.join(groups, group, "left").select(
        "id", F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(True)).alias("kept"), F.col("sha256").alias("text_sha256"),
    )


def drop_exact_duplicates(docs: DataFrame, size: int = 1024) -> DataFrame:
    """``docs`` with one row of each group of equal texts; all columns stay. Of rows that repeat doc_id and text any one stays.

    Only rows whose id is that of a repeated text are shuffled again; all others pass by. Null texts count as empty; an empty table stays empty.
    """
    found = exact_duplicates(docs, size)
    marks = cut_lineage(
        found.filter("group_size > 1").groupBy("id", "text_sha256")
        .agg(F.max("kept").alias("any_kept"), F.count(F.lit(1)).alias("n"))
        .filter("NOT any_kept OR n > 1").select(F.col("id").alias("__id"), F.col("text_sha256").alias("__sha"), "any_kept")
    )
    suspects, others = split_by_ids(only_names(docs, ("doc_id", "text")), "doc_id", marks.select(F.col("__id").alias("id")))
    sha = F.sha2(F.encode(normalised(F.col("text")), "UTF-8"), 256)
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__id")) & (F.col("__s") == F.col("__sha"))
    tagged = suspects.withColumn("__s", sha).join(marks, same, "left")
    kept = tagged.filter("any_kept IS NULL")
    if not marks.filter("any_kept").isEmpty():
        kept = kept.unionByName(tagged.filter("any_kept").dropDuplicates(["__id", "__sha"]))
    return others.unionByName(kept.drop("__s", "__id", "__sha", "any_kept")).toDF(*docs.columns)
