"""Pairs of bounded blocks: dense work on two tables that share a key.

All-against-all work inside one key (neighbours of a donor's cells, sites against the variants
of a region) is cut into block pairs. A key with many rows becomes many block pairs, each of
about ``left_rows`` x ``right_rows``, so no task or group grows with a key. Blocks carry whole
rows; nothing is sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType

from spliceweave.session import ship_package

SALTS = 32


def over_block_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_id: Sequence[str],
    right_id: Sequence[str],
    left_rows: int,
    right_rows: int,
    kernel: Callable,
    schema: str,
    together: tuple[int, int] = (1, 1),
) -> DataFrame:
    """Apply ``kernel(left_block, right_block) -> pandas`` to every block pair of every key that has rows on both sides.

    Both sides are read twice (sizes, then rows): give stored tables, or plans that are cheap to repeat. Only keys of more than one block
    are looked up, with salted rows, so a key that many rows share is spread before it meets its sizes.

    A row is copied for every group it meets. ``together`` is how many left and right blocks share a group, so copies fall by that factor; the
    group holds these blocks and takes their pairs one after another, and rows of a pair leave it before the next pair is taken.
    """
    ship_package(left.sparkSession)
    keys = list(keys)
    right = right.toDF(*right.columns)  # fresh column identities: both sides may share a source
    n_left = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (left_rows * together[0])).cast("int").alias("__nl"))
    n_right = right.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / (right_rows * together[1])).cast("int").alias("__nr"))
    large = n_left.join(n_right, keys).filter("__nl > 1 OR __nr > 1").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))

    def cut(df, ids, mine, other, my_n, other_n):
        one = lambda c: F.coalesce(F.col(c), F.lit(1))
        return (
            df.withColumn("__salt", F.pmod(F.xxhash64(F.lit(1), *ids), F.lit(SALTS)).cast("int")).join(large, [*keys, "__salt"], "left")
            .withColumn(mine, F.pmod(F.xxhash64(*ids), one(my_n)).cast("int"))
            .withColumn(other, F.explode(F.sequence(F.lit(0), one(other_n) - 1)))
            .drop("__nl", "__nr", "__salt")
        )

    def both(x, y):
        return kernel(x, y) if len(x) and len(y) else pd.DataFrame()

    pair = [*keys, "__lb", "__rb"]
    a = cut(left, left_id, "__lb", "__rb", "__nl", "__nr")
    b = cut(right, right_id, "__rb", "__lb", "__nr", "__nl")
    if together == (1, 1):
        return a.groupBy(*pair).cogroup(b.groupBy(*pair)).applyInPandas(both, schema)
    spark = left.sparkSession
    sides = [(df.columns, [f"__{at}_{c}" for c in df.columns]) for at, df in enumerate((left, right))]
    named = [df.select(*pair, F.lit(at).alias("__side"), *[F.col(c).alias(n) for c, n in zip(*sides[at], strict=True)]) for at, df in enumerate((a, b))]
    # groups are dealt by number and not by size: few bytes make many pairs
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = named[0].unionByName(named[1], allowMissingColumns=True).repartition(tasks, *pair)
    made = to_arrow_schema(DataType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = pa.Table.from_batches(batches)
        x, y = (held.filter(pc.equal(held["__side"], at)).select(names).rename_columns(columns).to_pandas() for at, (columns, names) in enumerate(sides))
        for i in range(0, len(x), left_rows):
            for j in range(0, len(y), right_rows):
                out = kernel(x[i:i + left_rows].reset_index(drop=True), y[j:j + right_rows].reset_index(drop=True))
                if len(out):
                    yield pa.RecordBatch.from_pandas(out, schema=made, preserve_index=False)

    return rows.groupBy(*pair).applyInArrow(run, schema)


def salted(left: DataFrame, right: DataFrame, left_id: str, right_id: str) -> tuple[DataFrame, DataFrame, list[str]]:
    """Both sides with two keys under which every left row meets every right row once, and these keys: all-against-all work starts from many groups."""
    salts = max(1, math.ceil(math.sqrt(4 * left.sparkSession.sparkContext.defaultParallelism)))
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1)).cast("array<bigint>"))
    own = lambda c: F.pmod(F.xxhash64(c), F.lit(salts))
    return left.withColumn("lg", own(left_id)).withColumn("rg", every), right.withColumn("rg", own(right_id)).withColumn("lg", every), ["lg", "rg"]
