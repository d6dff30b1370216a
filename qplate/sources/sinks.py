"""Table sinks whose files stay of bounded size: sorted by ranges with a manifest, or split by group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ROWS_PER_FILE = 1_000_000


def write_sorted(df: DataFrame, path: str, order: Sequence[Column], keys: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> DataFrame:
    """Write ``df`` as Parquet files that follow each other in ``order``, none with more than ``rows_per_file`` rows; returns the manifest.

    Ranges are sampled from the order itself and each is sorted and written by its own task; there is no global sort into one reader.  ``df`` is
    evaluated twice (once for the sample), so it should be a table that is cheap to read.  The manifest, also kept under
    ``<path>/_manifest``, has a row per file: file_no, file_name, n_rows, first_row (rows before it), and the ``keys`` of its first and
    last row as first_key and last_key.
    """
    base = path.rstrip("/")
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).parquet(base)
    rows = df.sparkSession.read.parquet(base)
    at = rows.select(F.col("_metadata.file_name").alias("file_name"), F.col("_metadata.row_index").alias("_at"), F.struct(*keys).alias("_key"))
    files = at.groupBy("file_name").agg(F.count(F.lit(1)).alias("n_rows"), F.min_by("_key", "_at").alias("first_key"), F.max_by("_key", "_at").alias("last_key"))
    part = F.regexp_extract("file_name", r"^part-(\d+)", 1).cast("long")
    by_name = Window.orderBy(part, "file_name")  # one row a file
    manifest = files.select((F.row_number().over(by_name) - 1).cast("long").alias("file_no"), "file_name", "n_rows",
                            F.coalesce(F.sum("n_rows").over(by_name.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("first_row"),
                            "first_key", "last_key")
    manifest.write.mode("overwrite").parquet(f"{base}/_manifest")
    return df.sparkSession.read.parquet(f"{base}/_manifest")


def read_sorted(spark: SparkSession, path: str, place: str = "row_no") -> DataFrame:
    """A table of :func:`write_sorted` with each row's place in its order (from 0) as ``place``; a range of places or keys reads
    only the files that the manifest names for it."""
    base = path.rstrip("/")
    rows = spark.read.parquet(base)
    files = spark.read.parquet(f"{base}/_manifest").select(F.col("file_name").alias("_file"), "first_row")
    named = rows.select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return named.join(files, "_file").select(*rows.columns, (F.col("first_row") + F.col("_at")).alias(place))


def write_split(df: DataFrame, path: str, by: Sequence[str], rows_per_file: int = ROWS_PER_FILE) -> None:
    """Write ``df`` into one folder per value of ``by``, the rows of a group dealt over ceil(n / ``rows_per_file``) tasks by a hash
    of the row, so that a group with most of the rows has many files and many writers; no file has more than ``rows_per_file`` rows."""
    by = list(by)
    sizes = df.groupBy(*by).agg(F.ceil(F.count(F.lit(1)) / rows_per_file).alias("_parts"))
    renamed = sizes.select(*[F.col(c).alias(f"_b_{c}") for c in by], "_parts")
    match = [df[c].eqNullSafe(renamed[f"_b_{c}"]) for c in by]
    dealt = df.join(renamed, match).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.col("_parts")))
    spread = dealt.repartition(*[F.col(c) for c in by], F.col("_salt")).select(*df.columns)
    spread.write.mode("overwrite").option("maxRecordsPerFile", rows_per_file).partitionBy(*by).parquet(path.rstrip("/"))
