"""Plate layouts: expansion of compact sheets and annotation of wells.

A layout sheet row says which gene (or sample replicate) occupies a block of
wells: ``rows`` like ``"A,B"`` and ``cols`` like ``"1-3,7"``.  Token rules
(spreadsheet text, kept as the original analysis parses it):

* split on ``,``; one trailing empty piece is ignored and ``""`` gives no pieces;
* row tokens are used verbatim (not trimmed);
* a column token containing ``-`` is an integer range ``a-b`` (descending
  ranges count down), otherwise an integer; unparsable tokens give ``NA``,
  so the position (e.g. ``"ANA"``) matches no well;
* the block is the product rows x cols, row outer, column inner.

Lookups are "first match wins": the earliest (sheet row, row token, column
token) for a well decides, and a lookup never multiplies wells.

A sheet's file is far smaller than its cells, so sheets are spread by their
cell count before they are expanded, and the joins are merge joins: Spark's
size estimates do not see the expansion and would broadcast whole lookups.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qplate.functions.wells import hk_type
from qplate.operators._util import join_keys

WELL_KEY = ["file_name", "Pos"]
CELLS_PER_TASK = 500_000  # cells that one task expands and sorts


def _pieces(text: Column, sep: str = ",") -> Column:
    """Split on ``sep`` dropping exactly one trailing empty piece; '' -> []."""
    parts = F.split(text, sep, -1)
    n = F.size(parts)
    return (F.when(text.isNull(), F.array(F.lit(None).cast("string")))
            .when(text == "", F.array().cast("array<string>"))
            .when(F.try_element_at(parts, F.lit(-1)) == "", F.slice(parts, F.lit(1), n - 1))
            .otherwise(parts))


def _as_int(tok: Column) -> Column:
    return F.trim(tok).try_cast("double").try_cast("int")


def _col_numbers(tok: Column) -> Column:
    """Column token -> array of column numbers (NULL element for an unparsable token)."""
    ends = _pieces(tok, "-")
    a, b = _as_int(F.try_element_at(ends, F.lit(1))), _as_int(F.try_element_at(ends, F.lit(2)))
    rng = F.when(a.isNotNull() & b.isNotNull(),
                 F.sequence(a, b, F.when(a <= b, F.lit(1)).otherwise(F.lit(-1))))
    return F.when(tok.contains("-"), rng).otherwise(F.array(_as_int(tok)))


def expand_layout(sheet: DataFrame, value_col: str, ordinal: str = "sheet_ord") -> DataFrame:
    """One row per (sheet row, row token, column number): id_of_col, file_name, <value_col>, Pos, _ord."""
    rows = sheet.select("file_name", value_col, ordinal, F.posexplode(_pieces(F.col("rows"))).alias("_ri", "_row"),
                        F.col("cols"))
    cols = rows.select("*", F.posexplode(_pieces(F.col("cols"))).alias("_ti", "_tok"))
    cells = cols.select("*", F.posexplode(_col_numbers(F.col("_tok"))).alias("_ci", "_col"))
    pos = F.concat(F.coalesce(F.col("_row"), F.lit("NA")), F.coalesce(F.col("_col").cast("string"), F.lit("NA")))
    return cells.select(
        F.concat(F.col("file_name"), F.lit("_"), pos).alias("id_of_col"),
        "file_name", value_col, pos.alias("Pos"),
        F.struct(F.col(ordinal).alias("s"), F.col("_ri").alias("r"), F.col("_ti").alias("t"),
                 F.col("_ci").alias("c")).alias("_ord"))


def spread_sheet(sheet: DataFrame, cells_per_task: int = CELLS_PER_TASK) -> DataFrame:
    """``sheet`` dealt to as many tasks as its cells need (one pass counts them)."""
    columns = F.aggregate(F.transform(_pieces(F.col("cols")), lambda tok: F.coalesce(F.size(_col_numbers(tok)), F.lit(0)).cast("long")),
                          F.lit(0).cast("long"), lambda a, n: a + F.greatest(n, F.lit(0)))
    cells = sheet.agg(F.sum(F.size(_pieces(F.col("rows"))) * columns)).first()[0] or 0
    return sheet.repartition(math.ceil(cells / cells_per_task)) if cells > cells_per_task else sheet


def first_match(expanded: DataFrame, value_col: str, out_col: str) -> DataFrame:
    """(file_name, Pos) -> value of the earliest layout cell; partial aggregation, no fan-out."""
    return (expanded.groupBy(*WELL_KEY)
            .agg(F.min(F.struct(F.col("_ord"), F.col(value_col).alias("v"))).alias("_m"))
            .select(*WELL_KEY, F.col("_m.v").alias(out_col)))


def attach_layouts(wells: DataFrame, gene_layout: DataFrame, sample_layout: DataFrame) -> DataFrame:
    """Left-attach Gene and replicate_name by well: both lookups are merged first, so the wells are joined once."""
    genes = first_match(expand_layout(spread_sheet(gene_layout), "gene"), "gene", "Gene")
    samples = first_match(expand_layout(spread_sheet(sample_layout), "sample"), "sample", "replicate_name")
    lookup = genes.join(samples.hint("merge"), WELL_KEY, "full")
    return join_keys(wells, lookup.hint("merge"), WELL_KEY, "left")


def annotate_wells(wells: DataFrame, gene_layout: DataFrame, sample_layout: DataFrame, meta: DataFrame,
                   hk_genes, meta_key: str = "replicate_name") -> DataFrame:
    """Wells + Gene, type_of_gene, replicate_name and metadata.

    Unassigned wells (no replicate) are dropped; metadata is an inner join
    that keeps duplicate metadata rows (fan-out), as the original merge does.
    ``meta_key`` names the metadata key column when it is not ``replicate_name``.
    """
    w = attach_layouts(wells, gene_layout, sample_layout)
    w = w.withColumn("type_of_gene", hk_type(F.col("Gene"), hk_genes))
    w = w.filter(F.col("replicate_name").isNotNull())
    m = meta.withColumnRenamed(meta_key, "replicate_name") if meta_key != "replicate_name" else meta
    return w.join(m.hint("merge"), "replicate_name", "inner")


def unmatched_wells(wells: DataFrame, gene_layout: DataFrame, sample_layout: DataFrame, meta: DataFrame,
                    meta_key: str = "replicate_name") -> DataFrame:
    """Data-quality report of wells the annotation drops silently: reason 'no_replicate' or 'no_metadata'."""
    w = attach_layouts(wells, gene_layout, sample_layout)
    keys = meta.select(F.col(meta_key).alias("replicate_name")).distinct()
    no_rep = w.filter(F.col("replicate_name").isNull()).withColumn("reason", F.lit("no_replicate"))
    no_meta = (w.filter(F.col("replicate_name").isNotNull()).join(keys.hint("merge"), "replicate_name", "left_anti")
               .withColumn("reason", F.lit("no_metadata")))
    return no_rep.unionByName(no_meta)


def duplicate_metadata_keys(meta: DataFrame, meta_key: str = "replicate_name") -> DataFrame:
    """Metadata keys listed more than once (each multiplies its wells in the inner join)."""
    return meta.groupBy(meta_key).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") > 1)
