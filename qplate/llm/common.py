"""Helpers shared by the operators of this package."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qplate.session import ensure_checkpoint_dir
from qplate.sources.files import qualified

NO_ID = -(1 << 63)  # stands in for a NULL id inside join keys


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``, with the scheme of the file system that Spark resolves it to."""
    return qualified(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/qplate-llm/{name}-{uuid.uuid4().hex}")


def spare(df: DataFrame, name: str) -> str:
    """``name`` with as many underscores as no column of ``df`` has (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while any(c.startswith(name.lower()) for c in taken):
        name += "_"
    return name


def pin(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back (cuts lineage)."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_key(id_col: str, text_col: str) -> list[Column]:
    """Key (k1, k2) of a row: its id and a hash of its text.

    Results depend on the text only, so repeated rows share a key and a result;
    rows that share an id but not a text stay apart.
    """
    return [F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("k1"),
            F.xxhash64(F.col(text_col)).alias("k2")]


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once (not once per lambda element)."""
    return F.transform(F.array(value), body)[0]


def numbered(df: DataFrame, order: list[Column], name: str, weight: Column | None = None) -> DataFrame:
    """Dense global numbering in ``order`` as columns ``_row`` (from 0) and, with ``weight``, its
    exclusive running sum ``_before``.

    Range partitioning and a sort inside partitions; the driver and the last join only see one
    row per partition.  The numbered rows are pinned, so ids are stable.
    """
    cols = df.columns
    part = df.repartitionByRange(*order).sortWithinPartitions(*order)
    rows = pin(part.withColumn("_mid", F.monotonically_increasing_id()), name)
    rows = rows.withColumn("_pid", F.shiftright("_mid", 33)).withColumn("_pos", F.col("_mid").bitwiseAND((1 << 33) - 1))
    w = weight if weight is not None else F.lit(0)
    totals = rows.groupBy("_pid").agg(F.count("*").alias("_n"), F.sum(w).alias("_w"))
    # one row per partition: bounded by the partition count, hence the unpartitioned window and the broadcast
    over = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("_pid", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_n0"),
                           F.coalesce(F.sum("_w").over(over), F.lit(0)).alias("_w0"))
    out = rows.join(F.broadcast(starts), "_pid")
    keep = [*cols, (F.col("_n0") + F.col("_pos")).alias("_row")]
    if weight is not None:
        inner = Window.partitionBy("_pid").orderBy("_mid").rowsBetween(Window.unboundedPreceding, -1)
        keep.append((F.col("_w0") + F.coalesce(F.sum(w).over(inner), F.lit(0))).cast("long").alias("_before"))
    return out.select(*keep)

