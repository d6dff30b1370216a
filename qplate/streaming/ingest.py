"""Incremental ingest of plate exports (the batch reader, driven by Structured Streaming).

The analysis itself is batch (it needs complete replicate groups); what grows
continuously is the export archive.  ``ingest_plates`` watches a directory of
exports, parses each micro-batch exactly like ``sources.plates.read_plates``
(banner/header skipped, decimal comma, provenance) and writes the wells to the
``batch_id=<n>`` folder of a Parquet table.  A batch that runs again after a
restart overwrites its own folder, so nothing is doubled; ``well_ord`` = (batch id,
plate rank in batch, well index) keeps arrival order deterministic across restarts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qplate.operators._util import materialize
from qplate.sources.files import plain_path
from qplate.sources.plates import ORD_STRIDE, arrival_ordinal, export_options, plate_name, wells_of

_BATCH_STRIDE = 1 << 40


def _reject_twins(plates: DataFrame, base: str, batch_id: int) -> None:
    spark = plates.sparkSession
    known = plates.select("file_name", "_path")
    ledger = spark._jvm.org.apache.hadoop.fs.Path(f"{base}/_plates")
    if ledger.getFileSystem(spark._jsc.hadoopConfiguration()).exists(ledger):
        # the batch itself may be there from an attempt before
        before = spark.read.parquet(f"{base}/_plates").filter(F.col("batch_id") != batch_id)
        known = known.unionByName(before.join(known.select("file_name"), "file_name", "left_semi").select("file_name", "_path"))
    twin = known.groupBy("file_name").agg(F.countDistinct("_path").alias("n"), F.min("_path").alias("a"), F.max("_path").alias("b")) \
        .filter("n > 1").limit(1).collect()
    if twin:
        raise ValueError(f"two plates of one name: {twin[0].a} and {twin[0].b}")


def ingest_plates(spark: SparkSession, source_dir: str, table_path: str, checkpoint_location: str,
                  available_now: bool = True, plate_cols: int = 24):
    """Start the ingest query; returns the StreamingQuery (``availableNow`` drains and stops).

    Lines are read by the batch reader's own rules (:func:`qplate.sources.plates.wells_of`): an unreadable one fails its batch.  The plates
    of a batch are ranked by full path.  A plate whose name was ingested before from another file, or stands twice in a
    batch, fails the batch; the names are kept per batch in the hidden folder ``_plates`` of the table.
    """
    stream = export_options(spark.readStream).option("maxFilesPerTrigger", 1000).csv(source_dir) \
        .withColumn("_path", plain_path(F.col("_metadata.file_path")))
    base = table_path.rstrip("/")

    def write_batch(batch: DataFrame, batch_id: int) -> None:
        wells = materialize(wells_of(batch.withColumn("file_name", plate_name(F.col("_path"))), plate_cols, "fail", "_path"), "cache")
        # at most as many plates as files in a trigger, hence the unpartitioned window
        plates = wells.select("file_name", "_path").distinct().withColumn("_rank", F.dense_rank().over(Window.orderBy("_path")) - 1)
        _reject_twins(plates, base, batch_id)
        plates.select("file_name", "_path").write.mode("overwrite").parquet(f"{base}/_plates/batch_id={batch_id}")
        plate = F.lit(batch_id).cast("long") * (_BATCH_STRIDE // ORD_STRIDE) + F.col("_rank")
        ranked = wells.join(plates.drop("file_name"), "_path")
        ranked.withColumn("well_ord", arrival_ordinal(plate, F.col("Pos"), plate_cols)).drop("_rank", "_path") \
            .write.mode("overwrite").parquet(f"{base}/batch_id={batch_id}")
        wells.unpersist()

    writer = (stream.writeStream.foreachBatch(write_batch).option("checkpointLocation", checkpoint_location))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start()
