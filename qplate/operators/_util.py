"""Join helpers shared by the operators."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from qplate.session import ensure_checkpoint_dir


def join_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner",
              null_safe: bool = True) -> DataFrame:
    """Equi-join on ``keys``; NULL-safe by default (a NULL gene is a group of its own).

    Right-side keys are renamed first, so frames derived from the same lineage
    join without ambiguous references; the output keeps the left key columns.
    With ``null_safe=False`` (keys known non-NULL) the join is a plain equi-join,
    whose output stays hash-partitioned on the keys for the next aggregate.
    """
    renamed = right
    for k in keys:
        renamed = renamed.withColumnRenamed(k, f"__r_{k}")
    if null_safe:
        cond = [left[k].eqNullSafe(renamed[f"__r_{k}"]) for k in keys]
    else:
        cond = [left[k] == renamed[f"__r_{k}"] for k in keys]
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def new_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the cluster's shared ``spark.checkpoint.dir``."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/qplate-{name}/{uuid.uuid4().hex}"


def materialize(df: DataFrame, mode: str) -> DataFrame:
    """Pin an intermediate that several branches consume.

    ``table``: write it once as Parquet under the cluster's shared
    ``spark.checkpoint.dir`` and read it back (cuts lineage, survives executor
    loss, and the read-back gets column pruning / predicate pushdown).
    ``checkpoint``: Spark's reliable RDD checkpoint (same folder; computes the
    plan twice unless cached).  ``cache``: MEMORY_AND_DISK persist.
    ``none``: stay lazy.
    """
    if mode == "table":
        path = new_folder(df.sparkSession, "tables")
        df.write.mode("overwrite").parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)  # no footers are read to find the schema
    if mode == "checkpoint":
        ensure_checkpoint_dir(df.sparkSession)
        return df.checkpoint(eager=True)
    if mode == "cache":
        return df.persist(StorageLevel.MEMORY_AND_DISK)
    return df


def number_rows(df: DataFrame, order: Sequence[Column], weight: Column | None = None) -> DataFrame:
    """Pinned ``df`` with ``_row``, its dense place (from 0) in ``order``, and with ``weight`` also ``_before``, the sum of the
    weights ahead of it.

    Rows are dealt by ranges whose bounds Spark samples from the order itself, so no key, however crowded, sets the size of a
    task; a partition's offset is the sum of the partitions before it, from a table of one row a partition.
    """
    columns = df.columns
    order = list(order)
    spread = df.withColumn("_w", weight if weight is not None else F.lit(0)).repartitionByRange(*order).sortWithinPartitions(*order)
    rows = materialize(spread.withColumn("_id", F.monotonically_increasing_id()), "table")
    rows = rows.withColumn("_part", F.shiftright("_id", 33)).withColumn("_place", F.col("_id").bitwiseAND((1 << 33) - 1))
    totals = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"), F.sum("_w").alias("_sum"))
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as partitions
    offsets = totals.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_n0"),
                            F.coalesce(F.sum("_sum").over(ahead), F.lit(0)).alias("_s0"))
    out = rows.join(F.broadcast(offsets), "_part")
    placed = (F.col("_n0") + F.col("_place")).alias("_row")
    if weight is None:
        return out.select(*columns, placed)
    inside = Window.partitionBy("_part").orderBy("_id").rowsBetween(Window.unboundedPreceding, -1)
    return out.select(*columns, placed, (F.col("_s0") + F.coalesce(F.sum("_w").over(inside), F.lit(0))).alias("_before"))
