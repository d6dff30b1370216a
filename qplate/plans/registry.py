"""Registered queries over the driver's tables (see ``sources.driver_tables``).

Each query takes (spark, sf_dir) and returns a DataFrame whose double columns
pass through the shared comparison projection.  The matching DuckDB SQL lives
in ``plans.oracle``; column names are identical.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qplate.config import AnalysisConfig
from qplate.operators.expression import cp_ratio
from qplate.operators.comparisons import bitmap_totals, comparison_strings, tolerance_bitmaps
from qplate.operators.replicate_qc import drop_failed_replicates, screened_technical_qc
from qplate.functions.wells import pos_column, pos_row, well_index
from qplate.plans.compare import for_compare
from qplate.operators._util import join_keys, materialize, new_folder
from qplate.operators.outliers import loo_outliers
from qplate.operators.plotdata import (
    bar_table,
    break_points,
    category_levels,
    colour_rule,
    column_dictionary,
    magnitude_breaks,
    plot_points,
    pvalue_labels,
    wide_rows,
    with_category,
)
from qplate.operators.summary import zscore
from qplate.operators.variants import delta_delta, sample_labels
from qplate.plans.pipeline import GROUP, REPORT_KEYS, analyse, prepare_wells, recalculate, report_order
from qplate.plans.replay import merge_changes, replay_changes
from qplate.operators.significance import ranksum_test, two_group_test
from qplate.operators.layout import annotate_wells, expand_layout, unmatched_wells
from qplate.sources.driver_tables import (
    EVENT_HK_GENES,
    LAYOUT_HK_GENES,
    gene_sheet,
    load_table,
    metadata_table,
    raw_wells_from_events,
    sample_sheet,
    wells_from_events,
)
from qplate.sources.exports import write_exports
from qplate.sources.plates import read_plates, rejected_lines
from qplate.sources.sinks import read_sorted, write_sorted, write_split

# Parameters of the event-table mapping: tolerance 2.0 exercises every keep branch on this data.
EVENT_CFG = AnalysisConfig(hk_genes=EVENT_HK_GENES, tolerance=2.0)

Query = Callable[[SparkSession, str], DataFrame]

# Fixed values of the event mapping used by the plot and variant queries.
HEATMAP_COLUMNS = ("control", "treated")
TRIAL_DISPERSION = 3.0


def _wells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wells_from_events(load_table(spark, sf_dir, "events"), EVENT_CFG.hk_genes)


def q_hk_failed_drop(spark, sf_dir):
    w = _wells(spark, sf_dir).filter(F.col("replicate_name").isNotNull())
    out = drop_failed_replicates(w, EVENT_CFG.bad_replicate_cp, drop=True)
    return for_compare(out.select("file_name", "Pos", "replicate_name", "Gene", "type_of_gene", "Cp", "good_replicate"))


def q_hk_failed_flag(spark, sf_dir):
    w = _wells(spark, sf_dir).filter(F.col("replicate_name").isNotNull())
    out = drop_failed_replicates(w, EVENT_CFG.bad_replicate_cp, drop=False)
    return for_compare(out.select("file_name", "Pos", "replicate_name", "Gene", "type_of_gene", "Cp", "good_replicate"))


def q_fill_undetected(spark, sf_dir):
    w = prepare_wells(_wells(spark, sf_dir), EVENT_CFG)
    return for_compare(w.select("file_name", "Pos", "replicate_name", "Gene", "Cp"))


def q_technical_qc(spark, sf_dir):
    w = _wells(spark, sf_dir).filter(F.col("replicate_name").isNotNull())
    out = screened_technical_qc(w, EVENT_CFG.bad_replicate_cp, EVENT_CFG.tolerance, EVENT_CFG.keep_slack, GROUP, "Cp", EVENT_CFG.chunk_width)
    return for_compare(out.select("file_name", "Pos", "replicate_name", "Gene", "Cp", "valid_counter",
                                  "n_of_samples", "group_type", "keep_this_value"))


def q_comparison_string(spark, sf_dir):
    w = prepare_wells(_wells(spark, sf_dir), EVENT_CFG)
    out = comparison_strings(w, EVENT_CFG.tolerance)
    return out.select("file_name", "Pos", "replicate_name", "Gene", "comparison_results")


def q_relative_expression(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    return for_compare(a.groups.select("replicate_name", "Gene", "type_of_gene", "n_kept", "elevated_value_mean",
                                       "normalized_expression", "log2_expression_value"))


def q_first_row_only(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    rep = a.report(ordered=False)
    return for_compare(rep.select("file_name", "Pos", "replicate_name", "Gene", "keep_this_value", "elevated_value",
                                  "elevated_value_mean", "normalized_expression", "log2_expression_value"))


def q_cp_ratio(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    out = cp_ratio(a.values, GROUP, "Cp", on="cp")
    return for_compare(out.select("replicate_name", "Gene", "type_of_gene", "mean_value", "sd_value",
                                  "hk_mean_value", "deltaCT"))


def q_loo_outliers(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    return for_compare(a.bio.select("file_name", "Pos", "sample_name", "Gene", "normalized_expression",
                                    "mean_others", "sd_others", "qc_flag"))


def q_sample_summary(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    return for_compare(a.summary.select("file_name", "Pos", "sample_name", "zscoring_group", "Gene",
                                        "normalized_expression_mean", "normalized_expression_sd",
                                        "log2_expression_value_mean", "log2_expression_value_sd"))


def q_zscore(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    return for_compare(a.summary.select("file_name", "Pos", "zscoring_group", "Gene",
                                        "log2_expression_value_mean", "zscored_value"))


def q_report(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    return for_compare(a.report().drop("well_ord"))


def q_welch_test(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    return for_compare(a.statistics)


def _sheets(spark, sf_dir):
    t = lambda n: load_table(spark, sf_dir, n)
    return (raw_wells_from_events(t("events")), gene_sheet(t("nation"), t("region"), t("supplier")), sample_sheet(t("customer")),
            metadata_table(t("customer"), t("supplier")))


def q_layout_expand(spark, sf_dir):
    _, genes, _, _ = _sheets(spark, sf_dir)
    return expand_layout(genes, "gene").select("id_of_col", "file_name", "gene", "Pos")


def q_annotate_first_match(spark, sf_dir):
    wells, genes, samples, meta = _sheets(spark, sf_dir)
    out = annotate_wells(wells, genes, samples, meta, LAYOUT_HK_GENES)
    return for_compare(out.select("file_name", "Pos", "well_ord", "Cp", "Gene", "type_of_gene", "replicate_name",
                                  "sample_name", "zscoring_group", "testing_group"))


def q_unmatched_wells(spark, sf_dir):
    wells, genes, samples, meta = _sheets(spark, sf_dir)
    return unmatched_wells(wells, genes, samples, meta).select("file_name", "Pos", "Gene", "replicate_name", "reason")


def q_ranksum_test(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    good = a.bio.filter((F.col("qc_flag") == "GOOD") & (F.col("type_of_gene") != "HK"))
    return for_compare(ranksum_test(good, ("zscoring_group", "Gene"), "normalized_expression", "testing_group"))


def _overrides(report: DataFrame) -> DataFrame:
    """Curated edits by rule: wells with Cp >= 40 set to 'NO keep'; representatives with
    normalized_expression > 10 set to 'BAD'."""
    o = report.select("file_name", "Pos",
                      F.when(F.col("Cp") >= 40, F.lit("NO keep")).alias("keep_this_value"),
                      F.when(F.col("normalized_expression") > 10, F.lit("BAD")).alias("qc_flag"))
    return o.filter(F.col("keep_this_value").isNotNull() | F.col("qc_flag").isNotNull())


def _recalculated(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    # the replay reads the written report back, as the curation loop does
    rep = materialize(a.report(ordered=False), "table")
    return recalculate(rep, EVENT_CFG, _overrides(rep))


def q_recalculate(spark, sf_dir):
    rep, _ = _recalculated(spark, sf_dir)
    return for_compare(rep.select("file_name", "Pos", "replicate_name", "Gene", "keep_this_value", "qc_flag",
                                  "elevated_value_mean", "normalized_expression", "log2_expression_value",
                                  "normalized_expression_mean", "normalized_expression_sd",
                                  "log2_expression_value_mean", "log2_expression_value_sd", "zscored_value"))


def _recalculated_changes(spark, sf_dir):
    """The same edits by change propagation, merged into the report before them."""
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    rep, stats = materialize(a.report(), "table"), materialize(a.statistics, "table")
    return merge_changes(rep, stats, replay_changes(rep, _overrides(rep), EVENT_CFG))


def q_recalculate_changed(spark, sf_dir):
    rep, _ = _recalculated_changes(spark, sf_dir)
    return for_compare(rep.select("file_name", "Pos", "replicate_name", "Gene", "keep_this_value", "qc_flag",
                                  "elevated_value_mean", "normalized_expression", "log2_expression_value",
                                  "normalized_expression_mean", "normalized_expression_sd",
                                  "log2_expression_value_mean", "log2_expression_value_sd", "zscored_value"))


def q_recalculate_changed_stats(spark, sf_dir):
    _, stats = _recalculated_changes(spark, sf_dir)
    return for_compare(stats)


def q_recalculate_stats(spark, sf_dir):
    _, stats = _recalculated(spark, sf_dir)
    return for_compare(stats)


def q_plot_points_recalculated(spark, sf_dir):
    """Plot rows from the replayed report (curated flags), as the bar-plot flow uses them."""
    rep, _ = _recalculated(spark, sf_dir)
    pts = plot_points(rep)
    return for_compare(pts.select("zscoring_group", "sample_name", "testing_group", "Gene", "normalized_expression",
                                  "normalized_expression_mean", "normalized_expression_sd", "qc_flag",
                                  "ordering", "ordering_level"))


def _plot_inputs(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    # one row per plotted representative; labels, bars and breaks all read it
    pts = materialize(plot_points(a.report(ordered=False)), "table")
    return a, pts


def q_plot_points(spark, sf_dir):
    _, pts = _plot_inputs(spark, sf_dir)
    return for_compare(pts.select("zscoring_group", "sample_name", "testing_group", "Gene", "normalized_expression",
                                  "normalized_expression_mean", "normalized_expression_sd", "qc_flag",
                                  "ordering", "ordering_level"))


def _colour_sheets(a):
    # plotted groups are those of the sample summary; the wells are not scanned again for them
    groups = a.summary.select("testing_group").distinct().withColumn("colour", colour_rule(F.col("testing_group")))
    annot = a.summary.select("zscoring_group").distinct().withColumn("colour", colour_rule(F.col("zscoring_group")))
    return groups, annot


def q_bar_table(spark, sf_dir):
    a, pts = _plot_inputs(spark, sf_dir)
    groups, annot = _colour_sheets(a)
    return for_compare(bar_table(pts, groups, annot))


def _labels(spark, sf_dir):
    a, pts = _plot_inputs(spark, sf_dir)
    groups, _ = _colour_sheets(a)
    # the number of colours is a scalar subquery: nothing is counted ahead in the driver
    return pts, pvalue_labels(a.statistics, pts, groups.agg(F.count(F.lit(1))).scalar())


def q_pvalue_labels(spark, sf_dir):
    _, labels = _labels(spark, sf_dir)
    return for_compare(labels)


def q_magnitude_breaks(spark, sf_dir):
    pts, labels = _labels(spark, sf_dir)
    return for_compare(magnitude_breaks(break_points(pts, labels), jump=EVENT_CFG.magnitude_jump))


def q_heatmap_matrix(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    long = a.summary.select("zscoring_group", "Gene", "testing_group", "zscored_value", "normalized_expression_mean")
    wide = long.groupBy("zscoring_group", "Gene").pivot("testing_group", list(HEATMAP_COLUMNS)).agg(
        F.avg("zscored_value").alias("z"), F.avg("normalized_expression_mean").alias("q"))
    return for_compare(wide)


def q_sample_labels(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer")
    reps = c.select("c_custkey", F.concat(
        F.col("c_mktsegment"), F.col("c_nationkey").cast("string"),
        F.when(F.col("c_acctbal") < 1000, F.lit("DN")).otherwise(F.lit("TRES")), F.lit("."),
        F.pmod(F.col("c_custkey"), F.lit(3)).cast("string"), F.lit("."),
        F.pmod(F.col("c_custkey"), F.lit(4)).cast("string")).alias("replicate_name"))
    return sample_labels(reps)


def q_delta_delta(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    cr = cp_ratio(a.values, GROUP, "Cp", on="cp")
    reps = a.groups.select(*GROUP, F.col("_first.well_ord").alias("well_ord"),
                           F.col("_first.sample_name").alias("sample_name"),
                           F.col("_first.zscoring_group").alias("cell_line"),
                           F.col("_first.testing_group").alias("sample_group"))
    ratios = cr.filter((F.col("type_of_gene") != "HK") & F.col("deltaCT").isNotNull())
    d = join_keys(ratios.select(*GROUP, "deltaCT"), reps, GROUP)
    d = loo_outliers(d, ("sample_name", "Gene"), "deltaCT", TRIAL_DISPERSION, ("replicate_name", "well_ord"))
    out = delta_delta(d, "control")
    return for_compare(out.select("replicate_name", "sample_name", "cell_line", "sample_group", "Gene", "deltaCT",
                                  "qc_flag", "delta_delta_CT", "elevated_value", "mean_value", "sd_value"))


def _delta_ct_flags(spark, sf_dir):
    """Cp-ratio variant: non-HK replicate-level deltaCT with leave-one-out flags (dispersion 3)."""
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    cr = cp_ratio(a.values, GROUP, "Cp", on="cp")
    reps = a.groups.select(*GROUP, F.col("_first.well_ord").alias("well_ord"),
                           F.col("_first.sample_name").alias("sample_name"),
                           F.col("_first.zscoring_group").alias("cell_line"),
                           F.col("_first.testing_group").alias("sample_group"))
    ratios = cr.filter((F.col("type_of_gene") != "HK") & F.col("deltaCT").isNotNull())
    d = join_keys(ratios.select(*GROUP, "deltaCT"), reps, GROUP)
    return loo_outliers(d, ("sample_name", "Gene"), "deltaCT", TRIAL_DISPERSION, ("replicate_name", "well_ord"))


def q_delta_ct_zscore(spark, sf_dir):
    d = _delta_ct_flags(spark, sf_dir).filter(F.col("qc_flag") == "GOOD")
    means = d.groupBy("sample_name", "Gene").agg(F.avg("deltaCT").alias("mean_value"),
                                                 F.min("cell_line").alias("zscoring_group"))
    return for_compare(zscore(means, ("zscoring_group", "Gene"), "mean_value", "zscored_value"))


def q_delta_delta_test(spark, sf_dir):
    d = _delta_ct_flags(spark, sf_dir).filter(F.col("qc_flag") == "GOOD")
    return for_compare(two_group_test(d, ("cell_line", "Gene"), "deltaCT", "sample_group", "ttest"))


def q_flag_mode_ratio(spark, sf_dir):
    """Earlier variant: failed replicates flagged, not dropped; ratio of kept elevated-value means;
    sample mean/sd of the ratio with missing values removed."""
    cfg = AnalysisConfig(hk_genes=EVENT_CFG.hk_genes, tolerance=EVENT_CFG.tolerance, drop_failed=False)
    a = analyse(_wells(spark, sf_dir), cfg)
    cr = cp_ratio(a.values, GROUP, "Cp", on="elevated")
    reps = a.groups.select(*GROUP, F.col("_first.well_ord").alias("_first_ord"),
                           F.col("_first.sample_name").alias("sample_name"))
    g = join_keys(cr, reps, GROUP)
    samp = g.groupBy("sample_name", "Gene").agg(F.avg("deltaCT").alias("mean_deltaCT"),
                                                F.stddev_samp("deltaCT").alias("sd_deltaCT"))
    g = join_keys(g.drop("type_of_gene"), samp, ["sample_name", "Gene"], "left")
    per_value = join_keys(a.values.select(*GROUP, "Cp", "keep_this_value", "good_replicate"), g, GROUP)
    wells = a.source.withColumn("Cp", F.coalesce(F.col("Cp"), F.lit(cfg.bad_replicate_cp))).drop("sample_name")
    out = join_keys(wells, per_value, [*GROUP, "Cp"], "inner")
    first = F.col("well_ord") == F.col("_first_ord")
    out = out.select("file_name", "Pos", "replicate_name", "sample_name", "Gene", "type_of_gene", "good_replicate",
                     "keep_this_value", *[F.when(first, F.col(c)).alias(c) for c in ("mean_value", "sd_value", "deltaCT")],
                     "hk_mean_value", "mean_deltaCT", "sd_deltaCT")
    return for_compare(out)


def q_zscore_lineitem(spark, sf_dir):
    li = load_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    part = load_table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    d = li.join(part, li.l_partkey == part.p_partkey).drop("p_partkey", "l_partkey")
    return for_compare(zscore(d, ("p_brand", "p_size"), "l_extendedprice"))


def q_tolerance_bitmaps(spark, sf_dir):
    """Per distinct value of a technical group: the wells of the group, those within the tolerance and the runs of its bitmap."""
    w = prepare_wells(_wells(spark, sf_dir), EVENT_CFG)
    return for_compare(bitmap_totals(tolerance_bitmaps(w, EVENT_CFG.tolerance)).withColumnRenamed("x", "Cp")
                       .withColumnRenamed("first", "first_rank"))


def q_plate_exports(spark, sf_dir):
    """All events written as instrument exports into the shared folder and read back."""
    folder = new_folder(spark, "exports")
    write_exports(raw_wells_from_events(load_table(spark, sf_dir, "events")), folder).agg(F.sum("n_lines")).collect()
    wells = read_plates(spark, folder)
    return for_compare(wells.select("file_name", "Pos", "Cp", F.col("plate_ord").cast("long").alias("plate_ord"), "well_ord"))


def _spoiled(wells: DataFrame) -> DataFrame:
    """Exports with lines that cannot be read, by event: no number, a grouped number, no position."""
    e = F.col("well_ord")
    cp = F.replace(F.col("Cp").cast("string"), F.lit("."), F.lit(","))
    return wells.select("file_name", F.when(e % 103 == 9, F.lit("1A")).otherwise(F.col("Pos")).alias("Pos"), "well_ord",
                        F.when(e % 97 == 5, F.lit("n/a")).when(e % 101 == 7, F.lit("26.441,10")).otherwise(cp).alias("text"))


def q_rejected_lines(spark, sf_dir):
    folder = new_folder(spark, "exports")
    write_exports(_spoiled(raw_wells_from_events(load_table(spark, sf_dir, "events"))), folder, "text").agg(F.sum("n_lines")).collect()
    return rejected_lines(spark, folder).select("file_name", "line", "reason")


def _heat(spark, sf_dir):
    a = analyse(_wells(spark, sf_dir), EVENT_CFG)
    return a.summary.select("zscoring_group", "Gene", "sample_name", "zscored_value")


def q_heatmap_columns(spark, sf_dir):
    return column_dictionary(_heat(spark, sf_dir), ["zscoring_group"], "sample_name")


def q_heatmap_wide(spark, sf_dir):
    """The z-score heatmap with all samples of a group as columns; cells in millionths, for the comparison as text."""
    wide = wide_rows(materialize(_heat(spark, sf_dir), "table"), ["Gene"], "sample_name", "zscored_value")
    cells = F.transform("cells", lambda z: F.coalesce(F.round(z * 1e6).cast("long").cast("string"), F.lit("")))
    return wide.select("zscoring_group", "Gene", "block", "first", F.size("cells").cast("long").alias("n_columns"),
                       F.size(F.filter("cells", lambda z: z.isNotNull())).cast("long").alias("n_filled"),
                       F.array_join(cells, "|").alias("cells"))


def q_report_sink(spark, sf_dir):
    """The report written as sorted files of at most 5,000 rows and read back with each row's place in the order."""
    folder = new_folder(spark, "report")
    report = materialize(analyse(_wells(spark, sf_dir), EVENT_CFG).report(), "table")
    write_sorted(report, folder, report_order(), REPORT_KEYS, rows_per_file=5000)
    return read_sorted(spark, folder).select("row_no", "file_name", "Pos", "replicate_name", "Gene")


def q_split_sink(spark, sf_dir):
    """The wells split by z-scoring group into files of at most 2,000 rows: rows of each group and whether every file keeps the bound."""
    folder = new_folder(spark, "split")
    write_split(_wells(spark, sf_dir), folder, ["zscoring_group"], rows_per_file=2000)
    files = spark.read.schema("well_ord long, zscoring_group string").parquet(folder) \
        .groupBy("zscoring_group", F.col("_metadata.file_path").alias("f")).agg(F.count(F.lit(1)).alias("n"))
    return files.groupBy("zscoring_group").agg(F.sum("n").alias("n_rows"), (F.max("n") <= 2000).alias("within_bound"))


# An explicit order that leaves segments out and names one that no customer has.
SEGMENT_LEVELS = ("MACHINERY", "AUTOMOBILE", "AEROSPACE", "BUILDING")


def q_category_levels(spark, sf_dir):
    c = load_table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return with_category(c, "c_mktsegment", category_levels(SEGMENT_LEVELS, spark), "segment")


def q_category_table_levels(spark, sf_dir):
    """Levels from a table: suppliers by nation, nations ordered by region and falling key, those of one region left out."""
    nations = load_table(spark, sf_dir, "nation").filter("n_regionkey <> 2") \
        .select(F.col("n_nationkey").cast("string").alias("level"), (F.col("n_regionkey") * 1000 - F.col("n_nationkey")).alias("rank"))
    s = load_table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("nation"))
    return with_category(s, "nation", category_levels(nations, spark))


def q_plate_coordinates(spark, sf_dir):
    wells = raw_wells_from_events(load_table(spark, sf_dir, "events"))
    return wells.select("file_name", "Pos", "well_ord", pos_row(F.col("Pos")).alias("row_letter"),
                        pos_column(F.col("Pos")).cast("long").alias("plate_column"), well_index(F.col("Pos"), 24).cast("long").alias("well"))


def q_annotate_other_key(spark, sf_dir):
    """Metadata whose key column has another name than the wells' replicate."""
    wells, genes, samples, meta = _sheets(spark, sf_dir)
    out = annotate_wells(wells, genes, samples, meta.withColumnRenamed("replicate_name", "sample"), LAYOUT_HK_GENES, meta_key="sample")
    return for_compare(out.select("file_name", "Pos", "well_ord", "Cp", "Gene", "type_of_gene", "replicate_name",
                                  "sample_name", "zscoring_group", "testing_group"))


REGISTRY: dict[str, Query] = {
    "recalculate_changed": q_recalculate_changed,
    "recalculate_changed_stats": q_recalculate_changed_stats,
    "report_sink": q_report_sink,
    "split_sink": q_split_sink,
    "tolerance_bitmaps": q_tolerance_bitmaps,
    "plate_exports": q_plate_exports,
    "rejected_lines": q_rejected_lines,
    "heatmap_columns": q_heatmap_columns,
    "heatmap_wide": q_heatmap_wide,
    "category_levels": q_category_levels,
    "category_table_levels": q_category_table_levels,
    "plate_coordinates": q_plate_coordinates,
    "annotate_other_key": q_annotate_other_key,
    "recalculate": q_recalculate,
    "recalculate_stats": q_recalculate_stats,
    "plot_points": q_plot_points,
    "plot_points_recalculated": q_plot_points_recalculated,
    "bar_table": q_bar_table,
    "pvalue_labels": q_pvalue_labels,
    "magnitude_breaks": q_magnitude_breaks,
    "heatmap_matrix": q_heatmap_matrix,
    "sample_labels": q_sample_labels,
    "delta_delta": q_delta_delta,
    "zscore_lineitem": q_zscore_lineitem,
    "delta_ct_zscore": q_delta_ct_zscore,
    "delta_delta_test": q_delta_delta_test,
    "flag_mode_ratio": q_flag_mode_ratio,
    "ranksum_test": q_ranksum_test,
    "layout_expand": q_layout_expand,
    "annotate_first_match": q_annotate_first_match,
    "unmatched_wells": q_unmatched_wells,
    "hk_failed_drop": q_hk_failed_drop,
    "hk_failed_flag": q_hk_failed_flag,
    "fill_undetected": q_fill_undetected,
    "technical_qc": q_technical_qc,
    "comparison_string": q_comparison_string,
    "relative_expression": q_relative_expression,
    "first_row_only": q_first_row_only,
    "cp_ratio": q_cp_ratio,
    "loo_outliers": q_loo_outliers,
    "sample_summary": q_sample_summary,
    "zscore": q_zscore,
    "report": q_report,
    "welch_test": q_welch_test,
}
