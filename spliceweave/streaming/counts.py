"""Junction counts that grow with arriving read files.

A molecule counts once however many files it occurs in, so the state holds the molecules seen (metacell, junction, barcode, UMI), spread over the
shuffle partitions by their hash and kept in RocksDB with its snapshots in the checkpoint folder. Only molecules that are new leave
the state; each batch stores their counts in a folder named by the batch. A batch that is run again after a failure gets the same rows
from the same state and replaces its folder, so totals are exact.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from spliceweave.operators.junctions import JUNCTION

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def junction_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1000) -> DataFrame:
    """Junction reads of a folder of Parquet files, ``files_per_batch`` files at a time."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def new_molecules(junc: DataFrame, barcodes: DataFrame, sample: str = "metacell") -> DataFrame:
    """Rows of the stream whose (barcode[, library], UMI) was not seen before in its junction and metacell.

    ``barcodes`` is the fixed list (cb[, library], metacell). Nulls in a key never join, as in ``junction_stats``; a null UMI is no molecule.
    """
    keys = [k for k in ("cb", "library") if k in barcodes.columns and k in junc.columns]
    member = barcodes.select(*keys, sample).distinct()
    columns = [sample, *JUNCTION, *keys, "umi"]
    return junc.select(*keys, *JUNCTION, "umi").join(member, keys).filter(F.col("umi").isNotNull()).select(*columns).dropDuplicates(columns)


def start_counts(molecules: DataFrame, out: str, checkpoint: str, sample: str = "metacell", partitions: int | None = None) -> StreamingQuery:
    """Start the job that adds what ``molecules`` brings to the counts in ``out`` and ends with the files there are now.

    Started again with the same ``checkpoint`` it goes on where it stopped. ``partitions`` of the state are fixed by the first start.
    """
    spark = molecules.sparkSession

    def store(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(sample, *JUNCTION).agg(F.count(F.lit(1)).alias("n"))
        counts.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    names = {"spark.sql.streaming.stateStore.providerClass": ROCKSDB}
    if partitions is not None:
        names["spark.sql.shuffle.partitions"] = str(partitions)
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        return (molecules.writeStream.outputMode("append").option("checkpointLocation", checkpoint)
                .trigger(availableNow=True).foreachBatch(store).start())
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def counted(spark: SparkSession, out: str, junc: StructType, barcodes: DataFrame, sample: str = "metacell") -> DataFrame:
    """(metacell, junction, n) over all batches so far, as ``junction_stats`` gives it. A folder without batches has no rows."""
    kinds = {f.name: f.dataType.simpleString() for f in junc.fields}
    schema = ", ".join([f"`{sample}` {barcodes.schema[sample].dataType.simpleString()}", *(f"`{c}` {kinds[c]}" for c in JUNCTION), "n bigint"])
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)
    return spark.read.schema(schema).parquet(out).groupBy(sample, *JUNCTION).agg(F.sum("n").alias("n"))
