"""Which wells of a technical group lie within the tolerance of which, as bitmaps over the group's arrival order.

Wells of equal value compare alike with all others, so a group needs one bitmap per distinct value, not one list per well.  A bitmap is
cut at every ``ARRIVALS`` wells and stored by its runs: the first bit and the places where the bit changes.  It is made by tiles of
(up to ``VALUES`` distinct values, up to ``ARRIVALS`` wells), each a row of its own, so a group of any size is spread over
many tasks and none of them holds it whole.  Counts read the runs; the text of the original's comparison column is rendered
from them only where it is asked for.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from qplate.operators._util import join_keys, materialize, number_rows

GROUP = ("replicate_name", "Gene")
ARRIVALS, VALUES = 1024, 256  # wells and distinct values a tile, at most


def _arrivals(wells: DataFrame, keys: list[str], cp: str, order: str) -> DataFrame:
    """Pinned (keys, x, rank): the wells of each group in arrival order, densely ranked from 0."""
    d = wells.select(*keys, F.col(cp).alias("x"), F.col(order).alias("_o"))
    rows = number_rows(d, [*[F.col(k).asc_nulls_first() for k in keys], F.col("_o"), F.col("x")])
    starts = materialize(rows.groupBy(*keys).agg(F.min("_row").alias("_start")), "table")
    return materialize(join_keys(rows, starts, keys).select(*keys, "x", (F.col("_row") - F.col("_start")).alias("rank")), "table")


def _changes(bits: Column) -> Column:
    """Places (from 1) whose bit differs from the one before."""
    return F.filter(F.sequence(F.lit(1), F.size(bits) - 1), lambda i: (i >= 1) & (i < F.size(bits)) & (F.get(bits, i) != F.get(bits, i - 1)))


def tolerance_bitmaps(wells: DataFrame, tol: float = 0.5, keys: Sequence[str] = GROUP, cp: str = "Cp", order: str = "well_ord") -> DataFrame:
    """(keys, x, first, chunk, n, head, changes): for each distinct value ``x`` of a group and each run of ``ARRIVALS`` wells in arrival
    order (``chunk``, from 0, of ``n`` wells), whether ``abs(other - x) <= tol``: ``head`` for the first well, changing
    at each place of ``changes``.  ``first`` is the rank of the first well with that value.  A NULL value is within no tolerance.
    """
    keys = list(keys)
    ranked = _arrivals(wells, keys, cp, order)
    tiles = ranked.groupBy(*keys, F.floor(F.col("rank") / ARRIVALS).alias("chunk")) \
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "x"))), lambda s: s["x"]).alias("others"))  # at most ARRIVALS
    values = ranked.groupBy(*keys, "x").agg(F.min("rank").alias("first"))
    # the value's own place in its group, by first arrival, cuts the distinct values into blocks
    placed = number_rows(values, [*[F.col(k).asc_nulls_first() for k in keys], F.col("first")])
    sizes = materialize(placed.groupBy(*keys).agg(F.min("_row").alias("_start"), F.count(F.lit(1)).alias("_n")), "table")
    blocks = join_keys(placed, sizes, keys).withColumn("block", F.floor((F.col("_row") - F.col("_start")) / VALUES)) \
        .groupBy(*keys, "block").agg(F.collect_list(F.struct("x", "first")).alias("values"))  # at most VALUES
    spread = join_keys(tiles, sizes.select(*keys, F.floor((F.col("_n") - 1) / VALUES).alias("_last")), keys) \
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_last")))).drop("_last")
    tile = join_keys(spread, materialize(blocks, "table"), [*keys, "block"])
    rows = tile.select(*keys, "chunk", "others", F.explode("values").alias("v")).select(*keys, "chunk", "others", "v.x", "v.first")
    bits = F.transform("others", lambda y: F.coalesce(F.abs(y - F.col("x")) <= F.lit(float(tol)), F.lit(False)))
    rows = rows.select(*keys, "x", "first", "chunk", bits.alias("bits"))
    return rows.select(*keys, "x", "first", "chunk", F.size("bits").cast("long").alias("n"), F.col("bits")[0].alias("head"),
                       _changes(F.col("bits")).alias("changes"))


def good_in_chunk() -> Column:
    """Set bits of a bitmap row: the lengths of its runs that are good."""
    bounds = F.concat(F.array(F.lit(0)), F.col("changes"), F.array(F.col("n").cast("int")))
    lengths = F.transform(F.sequence(F.lit(0), F.size("changes")), lambda i: F.get(bounds, i + 1) - F.get(bounds, i))
    odd = F.when(F.col("head"), F.lit(0)).otherwise(F.lit(1))
    return F.aggregate(F.filter(lengths, lambda _, i: i % 2 == odd), F.lit(0).cast("long"), lambda a, b: a + b)


def bitmap_totals(bitmaps: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """(keys, x, first, n_wells, n_good, n_runs) of each distinct value; ``n_good`` counts the well itself."""
    return bitmaps.withColumn("_good", good_in_chunk()).groupBy(*keys, "x", "first").agg(
        F.sum("n").alias("n_wells"), F.sum("_good").alias("n_good"), F.sum(F.size("changes") + 1).cast("long").alias("n_runs"))


def rendered(bitmaps: DataFrame, keys: Sequence[str] = GROUP) -> DataFrame:
    """(keys, x, comparison_results): ``good`` or ``bad`` for every other well in arrival order, leaving out the first well of the value.

    A text is as long as its group, as the column is defined; there is one per distinct value.
    """
    own = F.when(F.floor(F.col("first") / ARRIVALS) == F.col("chunk"), (F.col("first") % ARRIVALS).cast("int"))
    own = F.when(F.col("x").isNotNull(), own)
    bounds = F.concat(F.array(F.lit(0)), F.col("changes"), F.array(F.col("n").cast("int")))

    def run(i: Column) -> Column:
        start, end = F.get(bounds, i), F.get(bounds, i + 1)
        size = end - start - F.coalesce(((start <= own) & (own < end)).cast("int"), F.lit(0))
        label = F.when(F.col("head") == (i % 2 == 0), F.lit("good")).otherwise(F.lit("bad"))
        return F.array_repeat(label, size)

    text = F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), F.size("changes")), run)), ",")
    parts = bitmaps.select(*keys, "x", F.struct("chunk", text.alias("text")).alias("part"))
    joined = F.filter(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["text"]), lambda t: t != "")
    return parts.groupBy(*keys, "x").agg(F.array_join(joined, ",").alias("comparison_results"))


def comparison_strings(wells: DataFrame, tol: float = 0.5, keys: Sequence[str] = GROUP, cp: str = "Cp",
                       order: str = "well_ord") -> DataFrame:
    """``wells`` with the verbatim audit column ``comparison_results`` ("good,bad,..."): each well's comparison with every other
    well of the group in arrival order, skipping the first well whose Cp equals its own.

    Keep flags do not need it (see ``technical_qc``); the column is quadratic in the group by definition, its making is not:
    texts are rendered once per distinct value from :func:`tolerance_bitmaps`.  Wells without a Cp compare as bad.
    """
    keys = list(keys)
    texts = rendered(tolerance_bitmaps(wells, tol, keys, cp, order), keys)
    return join_keys(wells, texts.withColumnRenamed("x", cp), [*keys, cp], "left")
