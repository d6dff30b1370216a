"""Well-coordinate and labelling helpers."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_POS_RE = r"^([A-Za-z]+)([0-9]+)$"


def pos_row(pos: Column) -> Column:
    """Row letters of a well position (``"B12"`` -> ``"B"``)."""
    return F.regexp_extract(pos, _POS_RE, 1)


def pos_column(pos: Column) -> Column:
    """Column number of a well position (``"B12"`` -> 12); NULL when malformed."""
    return F.regexp_extract(pos, _POS_RE, 2).try_cast("int")


def well_index(pos: Column, plate_cols: int = 24) -> Column:
    """Row-major well index (A1 = 0, A2 = 1, ..., B1 = plate_cols): numeric, not text order.

    Rows go A..Z, AA..AZ and so on; a malformed position has no index (NULL).
    """
    letters = F.filter(F.split(F.upper(pos_row(pos)), ""), lambda c: c != "")
    row = F.aggregate(letters, F.lit(0), lambda acc, c: acc * 26 + F.ascii(c) - 64) - 1
    return row * F.lit(plate_cols) + pos_column(pos) - F.lit(1)


def hk_type(gene: Column, hk_genes: Iterable[str]) -> Column:
    """'HK' for housekeeping genes, 'Normal' otherwise (NULL gene is 'Normal')."""
    hk = list(hk_genes)
    return F.when(F.coalesce(gene.isin(hk), F.lit(False)), F.lit("HK")).otherwise(F.lit("Normal"))


def sample_from_replicate(replicate: Column) -> Column:
    """Sample name = replicate name without its last dot-suffix (``S1.2`` -> ``S1``)."""
    return F.regexp_replace(replicate, r"\.[^.]*$", "")
