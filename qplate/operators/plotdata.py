"""Tables behind the bar plots and heatmaps (rendering itself is out of scope).

One table covers all plot groups: the per-group loop of the original script
becomes a grouping key (``zscoring_group``).

* ``plot_points``  - non-HK representative rows with a value, plus the bar order
  (``ordering`` = sample_testing-group_gene, level index by first appearance
  after sorting by gene and testing group)
* ``bar_table``    - bar height, error-bar ends (mean, mean + sd) and colours
  looked up by key
* ``pvalue_labels`` - "p = <2 significant digits>" label, y = 1.1 x tallest bar of
  the group, x = midpoint of the colour scale
* ``magnitude_breaks`` - axis-break candidates where consecutive sorted values
  jump by >= ``jump`` decades (computed on a per-decade summary, not on rows)
* ``heatmap_matrix`` - long -> wide pivot with an explicit column list
* ``column_dictionary`` / ``wide_rows`` - long -> wide over columns that the data name: a dense position for each column
  of a group, and rows as arrays aligned to it
* ``category_levels`` / ``with_category`` - ordered categories with an explicit level list
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from qplate.operators._util import join_keys, materialize, number_rows

PLOT_GROUP = "zscoring_group"


def plot_points(report: DataFrame, group: str = PLOT_GROUP) -> DataFrame:
    """Plot rows: non-HK wells with a normalized value (one per technical group), with bar order by first appearance
    (for an order by an explicit level list see :func:`with_category`)."""
    d = report.filter((F.col("type_of_gene") != "HK") & F.col("normalized_expression").isNotNull())
    d = d.select(group, "replicate_name", "sample_name", "testing_group", "Gene", "normalized_expression",
                 "normalized_expression_mean", "normalized_expression_sd", "qc_flag")
    d = d.withColumn("ordering", F.concat_ws(
        "_", *[F.coalesce(F.col(c), F.lit("NA")) for c in ("sample_name", "testing_group", "Gene")]))
    levels = (d.groupBy(group, "ordering", "Gene", "testing_group")
              .agg(F.min("replicate_name").alias("_first_rep")))
    # level = levels of earlier (gene, testing group) blocks of the plot + rank inside the block:
    # the prefix runs over a one-row-per-block table, the rank over (plot, gene, testing group)
    blocks = levels.groupBy(group, "Gene", "testing_group").agg(F.count(F.lit(1)).alias("_n"))
    wb = Window.partitionBy(group).orderBy(F.col("Gene").asc_nulls_last(), F.col("testing_group").asc_nulls_last()) \
        .rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_off", F.coalesce(F.sum("_n").over(wb), F.lit(0))).drop("_n")
    wi = Window.partitionBy(group, "Gene", "testing_group").orderBy("_first_rep")
    levels = join_keys(levels.withColumn("_in", F.row_number().over(wi)), blocks, [group, "Gene", "testing_group"])
    levels = levels.select(group, "ordering", "Gene", "testing_group", (F.col("_off") + F.col("_in")).cast("long").alias("ordering_level"))
    # labels may clash across genes and testing groups, so these are join keys too
    return join_keys(d, levels, [group, "ordering", "Gene", "testing_group"]).drop("replicate_name")


def colour_rule(key: Column) -> Column:
    """Deterministic colour for a key when no colour sheet is given: '#' + first 6 hex digits of md5."""
    return F.concat(F.lit("#"), F.substring(F.md5(key.cast("string")), 1, 6))


def bar_table(points: DataFrame, group_colours: DataFrame, sample_annotation: DataFrame,
              group: str = PLOT_GROUP) -> DataFrame:
    """Bars: height = normalized_expression_mean, error bar from mean to mean + sd.

    ``group_colours``: (testing_group, colour) -> outline colour; ``sample_annotation``:
    (zscoring_group, colour) -> fill colour; both joined by key (small tables,
    broadcast by AQE), never by position.
    """
    bars = points.filter(F.col("normalized_expression_mean").isNotNull()).select(
        group, "sample_name", "testing_group", "Gene", "ordering", "ordering_level",
        F.col("normalized_expression_mean").alias("bar_height"),
        F.col("normalized_expression_mean").alias("ymin"),
        (F.col("normalized_expression_mean") + F.col("normalized_expression_sd")).alias("ymax"))
    bars = join_keys(bars, group_colours.select("testing_group", F.col("colour").alias("outline_colour")),
                     ["testing_group"], "left")
    fill = sample_annotation.select(F.col("zscoring_group").alias(group), F.col("colour").alias("fill_colour"))
    return join_keys(bars, fill, [group], "left")


def _scale10(x: Column, e: Column) -> Column:
    """x / 10^e using an exact integer power of ten on either side."""
    return F.when(e < 0, x * F.pow(F.lit(10.0), -e)).otherwise(x / F.pow(F.lit(10.0), e))


def with_r_number(df: DataFrame, src: str, out: str) -> DataFrame:
    """Adds ``out``: text of ``src`` (a number rounded to <= 2 significant digits) as R prints it,
    fixed notation unless scientific (``1.2e-05``) is strictly shorter.  Intermediates are staged
    as columns so the generated code stays small."""
    x = F.col(src)
    df = df.withColumn("_e0", F.floor(F.log10(F.abs(x))).cast("int"))
    df = df.withColumn("_d0", F.round(_scale10(F.abs(x), F.col("_e0") - 1), 0).cast("int"))  # 10..99, 100 on carry
    df = df.withColumn("_e", F.when(F.col("_d0") >= 100, F.col("_e0") + 1).otherwise(F.col("_e0"))) \
        .withColumn("_d", F.when(F.col("_d0") >= 100, F.lit(10)).otherwise(F.col("_d0")))
    df = df.withColumn("_one", F.pmod(F.col("_d"), F.lit(10)) == 0)
    df = df.withColumn("_digs", F.when(F.col("_one"), (F.col("_d") / 10).cast("int").cast("string"))
                       .otherwise(F.col("_d").cast("string")))
    df = df.withColumn("_mant", F.when(F.col("_one"), F.col("_digs")).otherwise(
        F.concat(F.substring("_digs", 1, 1), F.lit("."), F.substring("_digs", 2, 1))))
    e = F.col("_e")
    df = df.withColumn("_sci", F.concat(F.col("_mant"), F.when(e < 0, F.lit("e-")).otherwise(F.lit("e+")),
                                        F.lpad(F.abs(e).cast("string"), 2, "0")))
    df = df.withColumn("_fixed", F.when(e < 0, F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), F.col("_digs")))
                       .when(F.col("_one"), F.concat(F.col("_digs"), F.repeat(F.lit("0"), e)))
                       .when(e == 0, F.col("_mant"))
                       .otherwise(F.concat(F.col("_digs"), F.repeat(F.lit("0"), e - 1))))
    txt = F.concat(F.when(x < 0, F.lit("-")).otherwise(F.lit("")),
                   F.when(F.length("_fixed") <= F.length("_sci"), F.col("_fixed")).otherwise(F.col("_sci")))
    df = df.withColumn(out, F.when(x.isNull() | F.isnan(x), F.lit("NA")).when(x == 0, F.lit("0")).otherwise(txt))
    return df.drop("_e0", "_d0", "_e", "_d", "_one", "_digs", "_mant", "_sci", "_fixed")


def pvalue_labels(stats: DataFrame, points: DataFrame, n_colours: Column | int, group: str = PLOT_GROUP) -> DataFrame:
    """Label rows per test: p_rounded (2 significant digits), p_label, y_pos, x_pos."""
    tallest = points.groupBy(group).agg(F.max("normalized_expression_mean").alias("_ymax"))
    s = join_keys(stats, tallest, [group], "left")
    p = F.col("pvalue")
    s = s.withColumn("_pe", F.floor(F.log10(F.abs(p))).cast("int"))
    e = F.col("_pe")
    s = s.withColumn("p_rounded", F.when(p.isNull() | (p == 0), p).otherwise(
        F.when(e < 0, F.round(p * F.pow(F.lit(10.0), -e), 1) / F.pow(F.lit(10.0), -e))
        .otherwise(F.round(p / F.pow(F.lit(10.0), e), 1) * F.pow(F.lit(10.0), e))))
    s = with_r_number(s, "p_rounded", "_ptxt")
    k = n_colours if isinstance(n_colours, Column) else F.lit(int(n_colours))
    return s.select(*stats.columns, "p_rounded",
                    F.concat(F.lit("p = "), F.col("_ptxt")).alias("p_label"),
                    (F.col("_ymax") + F.col("_ymax") * 0.1).alias("y_pos"),
                    ((F.lit(1) + k) / 2.0).alias("x_pos"))


NEG_DECADE = -200000   # negative values: log10 undefined, never part of a boundary
ZERO_DECADE = -100000  # zero: log10 = -inf, a jump to any positive decade


def magnitude_breaks(points: DataFrame, value: str = "points_of_plot", group: str = PLOT_GROUP,
                     jump: int = 2) -> DataFrame:
    """Axis breaks per group: for each boundary between consecutive sorted values whose decades differ
    by >= jump, the value before (DOWN, break = x + x/10) and after (UP, break = x - x/10).

    Output: group, points_of_plot, id (1-based position in the sorted values), up_down,
    real_break, use_breaks (more than one marked row in the group).
    """
    x = F.col(value)
    dec = (F.when(x < 0, F.lit(NEG_DECADE)).when(x == 0, F.lit(ZERO_DECADE))
           .otherwise(F.floor(F.log10(x)).cast("int")))
    d = (points.filter(x.isNotNull()).withColumn("_dec", dec)
         .groupBy(group, "_dec").agg(F.count(F.lit(1)).alias("_n"), F.min(value).alias("_lo"),
                                     F.max(value).alias("_hi")))
    w = Window.partitionBy(group).orderBy("_dec")
    d = d.select("*", F.lag("_dec").over(w).alias("_pdec"), F.lag("_hi").over(w).alias("_phi"),
                 F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    d = d.withColumn("_jump", F.col("_pdec").isNotNull() & (F.col("_pdec") != NEG_DECADE)
                     & (F.col("_dec") != NEG_DECADE) & ((F.col("_dec") - F.col("_pdec")) >= jump))
    ups = d.filter("_jump").select(group, F.col("_lo").alias("points_of_plot"), (F.col("_before") + 1).alias("id"),
                                   F.lit("UP").alias("up_down"))
    downs = d.filter("_jump").select(group, F.col("_phi").alias("points_of_plot"), F.col("_before").alias("id"),
                                     F.lit("DOWN").alias("up_down"))
    marks = ups.unionByName(downs)
    # a row that is both the first of one jump and the last before the next is UP only
    marks = marks.groupBy(group, "id").agg(F.max("up_down").alias("up_down"),   # 'UP' > 'DOWN'
                                           F.max("points_of_plot").alias("points_of_plot"))
    v = F.col("points_of_plot")
    marks = marks.withColumn("real_break", F.when(F.col("up_down") == "UP", v - v / 10).otherwise(v + v / 10))
    n = marks.groupBy(group).agg((F.count(F.lit(1)) > 1).alias("use_breaks"))
    return join_keys(marks, n, [group]).select(group, "points_of_plot", "id", "up_down", "real_break", "use_breaks")


def break_points(points: DataFrame, labels: DataFrame, group: str = PLOT_GROUP) -> DataFrame:
    """Values scanned for breaks: every label height of the group plus every plotted value (duplicates kept)."""
    return (labels.select(group, F.col("y_pos").alias("points_of_plot"))
            .unionAll(points.select(group, F.col("normalized_expression").alias("points_of_plot"))))


def heatmap_matrix(long: DataFrame, index: Sequence[str], columns: str, value: str,
                   column_values: Sequence[str], agg: str = "first") -> DataFrame:
    """Long -> wide: one row per ``index``, one column per value of ``columns`` (explicit list,
    so no driver-side distinct).  ``agg='first'`` expects unique cells (see ``duplicate_cells``)."""
    f = {"first": F.first, "avg": F.avg, "max": F.max}[agg]
    return long.groupBy(*index).pivot(columns, list(column_values)).agg(f(value))


def duplicate_cells(long: DataFrame, index: Sequence[str], columns: str) -> DataFrame:
    """Cells with more than one value (they would become list cells in a wide table)."""
    return long.groupBy(*index, columns).count().filter(F.col("count") > 1)


BLOCK_COLUMNS = 4096  # cells of a wide row that stand in one array


def column_dictionary(long: DataFrame, groups: Sequence[str], columns: str) -> DataFrame:
    """(groups, ``columns``, position): the distinct columns of each group, densely numbered from 0 in their order (a NULL column last).

    The numbering is one range-partitioned pass over the distinct columns of all groups; no list of them is collected.
    """
    groups = list(groups)
    distinct = long.select(*groups, columns).distinct()
    rows = number_rows(distinct, [*[F.col(g).asc_nulls_first() for g in groups], F.col(columns).asc_nulls_last()])
    starts = materialize(rows.groupBy(*groups).agg(F.min("_row").alias("_start")), "table")
    return materialize(join_keys(rows, starts, groups).select(*groups, columns, (F.col("_row") - F.col("_start")).alias("position")), "table")


def wide_rows(long: DataFrame, index: Sequence[str], columns: str, value: str, groups: Sequence[str] = (PLOT_GROUP,),
              dictionary: DataFrame | None = None, block: int = BLOCK_COLUMNS) -> DataFrame:
    """(groups, index, block, first, cells): the wide table over all columns that a group's rows name.

    ``cells`` are the values at the positions of the group's :func:`column_dictionary` from ``first`` on, NULL where the row has no
    such cell.  A row is cut into arrays of ``block`` cells (``block`` numbers them), so that no row outgrows a task; a
    group of up to ``block`` columns has one array a row, and blocks without any cell are left out.  A cell with more than one row fails the query
    (:func:`duplicate_cells` lists such cells).
    """
    groups, index = list(groups), list(index)
    known = dictionary if dictionary is not None else column_dictionary(long, groups, columns)
    placed = join_keys(long.select(*groups, *index, columns, F.col(value).alias("_x")), known, [*groups, columns])
    cells = placed.groupBy(*groups, *index, "position").agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("x"))
    told = F.concat_ws(" ", F.lit("more than one value in cell"), *[F.col(c).cast("string") for c in (*groups, *index)], F.col("position").cast("string"))
    x = F.when(F.col("_n") > 1, F.raise_error(told).cast(dict(cells.dtypes)["x"])).otherwise(F.col("x"))
    cells = cells.select(*groups, *index, F.floor(F.col("position") / block).alias("block"), (F.col("position") % block).cast("int").alias("p"), x.alias("x"))
    widths = known.groupBy(*groups).agg(F.count(F.lit(1)).alias("_width"))
    rows = join_keys(cells.groupBy(*groups, *index, "block").agg(F.array_sort(F.collect_list(F.struct("p", "x"))).alias("c")), widths, groups)
    c, size = F.col("c"), F.least(F.lit(block), F.col("_width") - F.col("block") * block).cast("int")
    hole = F.lit(None).cast(dict(cells.dtypes)["x"])

    def cell(e: Column, i: Column) -> Column:  # with the holes before it
        before = F.when(i == 0, F.lit(-1)).otherwise(F.get(c, i - 1)["p"])
        return F.concat(F.array_repeat(hole, e["p"] - before - 1), F.array(e["x"]))

    aligned = F.concat(F.flatten(F.transform(c, cell)), F.array_repeat(hole, size - 1 - F.element_at(c, -1)["p"]))
    return rows.select(*groups, *index, "block", (F.col("block") * block).alias("first"), aligned.alias("cells"))


def category_levels(levels: DataFrame | Sequence[str], spark=None, level: str = "level", rank: str | None = "rank") -> DataFrame:
    """(level, level_rank): an explicit level list as a table, ranked from 1 in list order or by the column ``rank`` of a table.

    Repeated levels fail, as an order with two places for a value is none; a NULL level is not one and is left out.
    """
    if isinstance(levels, DataFrame):
        rows = levels.select(F.col(level).alias("level"), F.col(rank).cast("long").alias("_r")).filter("level is not null")
        rows = rows.groupBy("level").agg(F.count(F.lit(1)).alias("_n"), F.min("_r").alias("_r"))
        twice = F.raise_error(F.concat(F.lit("repeated level "), F.col("level"))).cast("long")
        rows = number_rows(rows.withColumn("_r", F.when(F.col("_n") > 1, twice).otherwise(F.col("_r"))), [F.col("_r"), F.col("level")])
        return rows.select("level", (F.col("_row") + 1).alias("level_rank"))
    given = [v for v in levels if v is not None]
    if len(set(given)) < len(given):
        raise ValueError(f"repeated level {next(v for i, v in enumerate(given) if v in given[:i])!r}")
    listed = F.posexplode(F.array(*[F.lit(v) for v in given]) if given else F.array().cast("array<string>"))
    return spark.range(1).select(listed).select(F.col("col").alias("level"), (F.col("pos") + 1).cast("long").alias("level_rank"))


def with_category(df: DataFrame, column: str, levels: DataFrame, out: str | None = None) -> DataFrame:
    """Adds the ordered category of ``column``: ``<out>`` (the value, NULL where it is no level) and ``<out>_rank`` to sort by.

    Values that are no level stay as rows with a missing category.  ``levels`` comes from :func:`category_levels`.
    """
    out = out or f"{column}_level"
    table = levels.select(F.col("level").alias(column), F.col("level_rank").alias(f"{out}_rank"), F.col("level").alias("_level"))
    joined = df.join(table, column, "left")
    return joined.select(*df.columns, F.col("_level").alias(out), f"{out}_rank")
