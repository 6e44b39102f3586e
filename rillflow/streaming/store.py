"""Where streams keep checkpoints and results: the folder that all executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def shared_folder(spark: SparkSession, tag: str) -> str:
    """A new folder in spark.checkpoint.dir; only where that is unset, in one process, a temporary one."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir isn't set: the executors of a cluster need a folder that all of them share")
        base = "file://" + tempfile.mkdtemp(prefix="rillflow-stream-")
    return f"{base.rstrip('/')}/rillflow/{tag}-{uuid.uuid4().hex}"


def drained(stream: DataFrame, tag: str, mode: str = "append") -> DataFrame:
    """All that the stream gives for what its source holds now, as a table.

    Every batch is a folder of its own, so a batch that is repeated replaces itself. In update mode a
    later batch's rows stand beside the earlier ones', with the batch's number in the column batch.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder = shared_folder(spark, tag)
    export(stream, f"{folder}/rows", f"{folder}/checkpoint", mode).awaitTermination()
    table = spark.read.schema(schema.add("batch", "long")).parquet(f"{folder}/rows")
    return table if mode == "update" else table.drop("batch")


def export(stream: DataFrame, folder: str, checkpoint: str, mode: str = "append", after=None, available_now: bool = True):
    """Starts writing every batch to its own folder; `after` (table, number) is called for each batch that holds rows.

    State is kept by RocksDB, so it may outgrow the memory of an executor.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    empty = f"{folder}/batch=-1"
    spark.createDataFrame([], stream.schema).write.mode("overwrite").parquet(empty)  # a stream without rows is an empty table

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={number}")
        if after is not None:
            made = batch.sparkSession.read.schema(batch.schema).parquet(f"{folder}/batch={number}")
            if not made.isEmpty():
                after(made, number)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
