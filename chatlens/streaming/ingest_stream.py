"""Optional streaming front end for the loaders (the reference loads in
batches only, so this adds no semantics): raw message records arriving as
files in a dump folder are flattened by the same batch functions inside
``foreachBatch`` and appended first-write-wins to the parquet tables.

A dump is not in time order, so there is no watermark: nothing is dropped for
being old. Duplicates are dropped within a micro-batch by key and across them
by the anti-join against what is stored. Lines that are no records are
kept under ``rejects`` as text. The stream's checkpoint must live in a shared
folder so a restarted driver or a lost executor resumes exactly where the last
committed batch ended.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from chatlens.operators.ingest import explode_mentions, normalize_messages
from chatlens.sources.records import split_rejects, with_rejects


def read_record_stream(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return with_rejects(spark.readStream.option("maxFilesPerTrigger", max_files)).json(path)


def _stored(spark: SparkSession, path: str) -> bool:
    """Whether the table has been written before; any other failure of the
    storage is raised."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(target)


def _append_new(batch: DataFrame, target: str, key: list[str]) -> None:
    spark = batch.sparkSession
    fresh = batch.dropDuplicates(key)
    if _stored(spark, target):
        fresh = fresh.join(spark.read.schema(batch.schema).parquet(target).select(*key), key, "left_anti")
    fresh.write.mode("append").partitionBy("tenant_id").parquet(target)


def start_ingest(records: DataFrame, tenant_id: str, out_root: str, checkpoint: str,
                 trigger_available_now: bool = True):
    """Start the stream; returns the StreamingQuery."""
    root = out_root.rstrip("/")

    def handle(batch: DataFrame, epoch_id: int) -> None:
        whole = batch = batch.persist()
        try:
            batch, rejects = split_rejects(batch)
            # a folder of its own for each batch, so a batch that is run again
            # writes its rejects over, not twice
            rejects.write.mode("overwrite").text(f"{root}/rejects/batch={epoch_id}")
            _append_new(normalize_messages(batch, tenant_id), f"{root}/messages", ["tenant_id", "id"])
            _append_new(explode_mentions(batch, tenant_id), f"{root}/message_mentions",
                        ["tenant_id", "message_id", "mentioned_user_id"])
        finally:
            whole.unpersist()

    w = records.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if trigger_available_now else w.trigger(processingTime="1 minute")
    return w.start()
