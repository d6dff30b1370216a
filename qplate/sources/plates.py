"""Instrument exports, layout/metadata sheets and table sinks.

Plate export format: tab-separated, a free-text banner on line 1, the header
``Include Color Pos Name Cp Concentration Standard Status`` on line 2, one
line per well, decimal comma (``26,44``), blank Cp for undetected wells and
CRLF line ends.  Many files are read in one scan; each row keeps its
provenance (``file_name`` without ``.txt``) and an arrival ordinal.  Files are
numbered by Spark (:func:`qplate.sources.files.numbered_files`), and lines
that are no well, header or banner are never read as something else: they fail the
query or go to :func:`rejected_lines`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qplate.functions.wells import pos_column, well_index
from qplate.operators._util import number_rows
from qplate.sources.files import PLACE, numbered_files, scans

EXPORT_COLUMNS = ("Include", "Color", "Pos", "Name", "Cp", "Concentration", "Standard", "Status")
_DAMAGED = "_damaged"  # the text of lines with another number of fields
EXPORT_SCHEMA = T.StructType([T.StructField(c, T.StringType(), True) for c in (*EXPORT_COLUMNS, _DAMAGED)])

# Wells per plate reserved in the arrival ordinal; 1536-well plates (32 x 48) fit, larger ones are rejected.
ORD_STRIDE = 1 << 12
BOOLEANS = ("True", "False", "TRUE", "FALSE")


def export_options(reader):
    """Schema and options of the exports for a batch or stream reader; only a reader of all columns sees that a line has too few."""
    return (reader.schema(EXPORT_SCHEMA).option("sep", "\t").option("header", "false").option("quote", '"')
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", _DAMAGED).option("columnPruning", "false"))


def _cp_text() -> Column:
    return F.trim(F.regexp_replace("Cp", "\r", ""))


def _decimal_comma(text: Column) -> Column:
    return F.regexp_replace(F.when(text != "", text), ",", ".").try_cast("double")


def plate_name(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.txt$", "")


def is_well() -> Column:
    """Banner and header lines do not begin with a boolean."""
    return F.coalesce(F.trim(F.col("Include")).isin(*BOOLEANS), F.lit(False))


def line_fault(plate_cols: int) -> Column:
    """Why a well's line cannot be read, NULL if it can: its fields, its position or its Cp."""
    index = well_index(F.trim(F.col("Pos")), plate_cols)
    no_place = index.isNull() | (index < 0) | (index >= ORD_STRIDE) | (pos_column(F.trim(F.col("Pos"))) > plate_cols)
    readable = F.coalesce(_cp_text(), F.lit("")).rlike(r"^(-?\d+([,.]\d+)?)?$")
    return (F.when(F.col(_DAMAGED).isNotNull(), F.lit("fields")).when(F.coalesce(no_place, F.lit(True)), F.lit("position"))
            .when(~readable, F.lit("Cp")))


def arrival_ordinal(plate: Column, pos: Column, plate_cols: int) -> Column:
    """``plate`` * ORD_STRIDE + row-major well index; a missing or too large index fails the query."""
    index = well_index(pos, plate_cols)
    bad = plate.isNull() | index.isNull() | (index < 0) | (index >= ORD_STRIDE) | (pos_column(pos) > plate_cols)
    return F.when(bad, F.raise_error(F.concat(F.lit("no arrival ordinal for well "), F.coalesce(pos, F.lit("NULL")))).cast("long")) \
        .otherwise(plate.cast("long") * F.lit(ORD_STRIDE) + index)


def wells_of(lines: DataFrame, plate_cols: int, on_bad_line: str, *extra: str) -> DataFrame:
    """The wells among raw export lines with the columns of ``extra``: file_name, Pos, Cp and the raw columns.

    ``on_bad_line``: ``fail`` fails the query at a line with a :func:`line_fault`, ``drop`` leaves it out.
    """
    if on_bad_line not in ("fail", "drop"):
        raise ValueError(f"on_bad_line={on_bad_line!r}: use 'fail' or 'drop'")
    fault = line_fault(plate_cols)
    rows = lines.filter(is_well())
    cp = _decimal_comma(_cp_text())
    if on_bad_line == "drop":
        rows = rows.filter(fault.isNull())
    else:
        told = F.concat(F.lit("unreadable "), fault, F.lit(" in a line of "), F.col("file_name"), F.lit(": "),
                        F.concat_ws(" ", *[F.col(c) for c in EXPORT_COLUMNS]))
        cp = F.when(fault.isin("fields", "Cp"), F.raise_error(told).cast("double")).otherwise(cp)
    return rows.select(
        "file_name", F.trim(F.col("Pos")).alias("Pos"), cp.alias("Cp"), F.trim(F.col("Include")).alias("Include"),
        F.trim(F.col("Color")).try_cast("long").alias("Color"), F.col("Name"),
        F.regexp_replace(F.col("Status"), "\r", "").alias("Status"), *extra)


def _export_lines(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    lines = scans(spark, paths, lambda given: export_options(spark.read).csv(given))
    return lines.withColumn("file_name", plate_name(F.col("_path")))


def read_plates(spark: SparkSession, paths: str | Sequence[str], plate_cols: int = 24, on_bad_line: str = "fail") -> DataFrame:
    """Read plate exports; returns file_name, Pos, Cp (double, NULL when blank), plate_ord, well_ord, plus raw columns.

    ``paths`` are files, folders or patterns in any spelling.  ``plate_ord`` numbers the files: by the first
    entry of ``paths`` that holds them, then by full path; ``well_ord`` = plate_ord * 4096 + row-major well index, which
    reproduces the export's own order.  Plate columns beyond ``plate_cols`` and malformed positions fail, and so does a
    Cp that is no number or a line with another number of fields; with ``on_bad_line="drop"`` such lines are left out
    (:func:`rejected_lines` lists them).  Layouts and overrides name plates by file name, so two files of one name are rejected.
    """
    files = numbered_files(spark, paths)
    twin = files.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("path").alias("a"), F.max("path").alias("b")).filter("n > 1").limit(1).collect()
    if twin:
        raise ValueError(f"two plates of one name: {twin[0].a} and {twin[0].b}")
    rows = wells_of(_export_lines(spark, paths), plate_cols, on_bad_line, "_path")
    order = files.select(F.col("path").alias("_path"), F.col("_row").cast("int").alias("plate_ord"))
    rows = rows.join(order, "_path", "left").drop("_path")
    return rows.withColumn("well_ord", arrival_ordinal(F.col("plate_ord"), F.col("Pos"), plate_cols))


def rejected_lines(spark: SparkSession, paths: str | Sequence[str], plate_cols: int = 24) -> DataFrame:
    """(file_name, line, reason, text) of the lines that ``read_plates(..., on_bad_line="drop")`` leaves out, and of those that are
    neither well nor header although they are not the banner (``reason`` "kind").  ``line`` counts a file's lines from 1, without empty ones."""
    place = F.row_number().over(Window.partitionBy("_path").orderBy("_block", "_id"))  # a plate's lines are few
    lines = _export_lines(spark, paths).withColumn("line", place)
    other = ~is_well() & (F.coalesce(F.trim(F.col("Include")), F.lit("")) != "Include") & (F.col("line") > 1)
    reason = F.when(is_well(), line_fault(plate_cols)).when(other, F.lit("kind"))
    text = F.coalesce(F.col(_DAMAGED), F.concat_ws("\t", *[F.coalesce(F.col(c), F.lit("")) for c in EXPORT_COLUMNS]))
    return lines.select("file_name", F.col("line").cast("long").alias("line"), reason.alias("reason"), F.regexp_replace(text, "\r", "").alias("text")) \
        .filter("reason is not null")


def read_sheet(spark: SparkSession, path: str | Sequence[str], fmt: str = "csv",
               schema: T.StructType | str | None = None, ordinal: str | None = "sheet_ord") -> DataFrame:
    """Layout / metadata / annotation sheet (CSV with header, or Parquet).

    Spreadsheets arrive as CSV/Parquet exports; ``path`` is a file, folder or pattern, or a list of them.  With ``ordinal`` set, a
    dense row ordinal is attached, so that "first match wins" lookups are deterministic: files by the first entry of
    ``path`` that holds them, then by full path, rows in file order, however Spark packs files into tasks.  Sheets of
    a list may differ in their columns; those of a folder or pattern must not.
    """
    def load(given: list[str]) -> DataFrame:
        reader = spark.read.schema(schema) if schema is not None else spark.read.option("enforceSchema", "false")
        return reader.option("header", "true").csv(given) if fmt == "csv" else reader.format(fmt).load(given)

    rows = scans(spark, path, load, apart=not isinstance(path, str))
    if not ordinal:
        return rows.drop(*PLACE)
    files = numbered_files(spark, path).select(F.col("path").alias("_path"), F.col("_row").alias("_file"))
    ranked = rows.join(files, "_path")
    numbered = number_rows(ranked, [F.col("_file"), F.col("_block"), F.col("_id")])
    return numbered.withColumn(ordinal, F.col("_row")).drop(*PLACE, "_file", "_row")


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] | None = None,
                mode: str = "overwrite", fmt: str = "parquet") -> None:
    """Sink: overwrite a Parquet table, optionally partitioned (e.g. by file_name or zscoring_group)."""
    w = df.write.mode(mode).format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)
