"""End-to-end plans: wells -> report + statistics, and the replay from curated flags.

Shuffle budget of ``analyse`` (the wells table is the only big input):

1. one scan of the wells: blank fill and aggregation to distinct
   (replicate, gene, Cp) values with multiplicity and failed-HK evidence
   (map-side partial aggregation, so the shuffle carries distinct values);
2. exact band counts on value-chunked windows, written once (pinned);
3. failed-replicate screen, keep flags, group expression, leave-one-out,
   sample summary, z-score and tests all run on the pinned value / per-group
   tables (joins on (replicate, gene) are plain equi-joins);
4. one final join of the wells with the value-level result on
   (replicate, gene, Cp) emits the well-level report (the second and last scan).
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.config import AnalysisConfig
from qplate.functions.numeric import log2_or_null, safe_div
from qplate.operators._util import join_keys, materialize
from qplate.operators.expression import finish_weighted_mean, group_expression, weighted_mean_exact
from qplate.operators.outliers import loo_outliers
from qplate.operators.comparisons import comparison_strings
from qplate.operators.replicate_qc import (
    drop_failed_replicates,
    fill_undetected,
    qc_from_values,
    screened_values,
)
from qplate.operators.significance import two_group_test
from qplate.operators.summary import sample_summary, zscore

GROUP = ["replicate_name", "Gene"]
CARRY = ("file_name", "Pos", "sample_name", "zscoring_group", "testing_group", "type_of_gene")
SUMMARY_COLS = ["normalized_expression_mean", "normalized_expression_sd",
                "log2_expression_value_mean", "log2_expression_value_sd", "zscored_value"]
REPORT_COLS = ["file_name", "Pos", "well_ord", "replicate_name", "sample_name", "zscoring_group", "testing_group",
               "Gene", "type_of_gene", "Cp", "good_replicate", "keep_this_value", "elevated_value",
               "elevated_value_mean", "normalized_expression", "log2_expression_value",
               "mean_others", "sd_others", "qc_flag", *SUMMARY_COLS]


class Analysis:
    """The analysis of a table of wells.  What only some consumers need (the value table once more, the sample summary, tests, the screened
    wells) is made, and where several branches read it pinned, when it is first asked for."""

    def __init__(self, source: DataFrame, values: DataFrame, groups: DataFrame, bio: DataFrame, cfg: AnalysisConfig, pins: dict[str, str]):
        """All frames with the NULL-gene sentinel, so that their joins are plain equi-joins."""
        self.cfg, self._pins, self._source, self._unpinned, self._groups, self._bio = cfg, pins, source, values, groups, bio

    @cached_property
    def _values(self) -> DataFrame:
        return materialize(self._unpinned, self._pins["values"])

    @cached_property
    def _summary(self) -> DataFrame:
        return materialize(summarise_samples(self._bio), self._pins["bio"])

    @cached_property
    def source(self) -> DataFrame:
        """Assigned wells as given (the report joins these once)."""
        return _restore_gene(self._source)

    @cached_property
    def wells(self) -> DataFrame:
        """Annotated wells, failed replicates screened out (or flagged), Cp filled."""
        good = self._values.select("replicate_name", "good_replicate").distinct()
        return _restore_gene(join_keys(fill_undetected(self._source, self.cfg.bad_replicate_cp), good, ["replicate_name"], null_safe=False))

    @cached_property
    def values(self) -> DataFrame:
        """Value-level technical QC (replicate, gene, Cp, m, keep_this_value, _first)."""
        return _restore_gene(self._values)

    @cached_property
    def groups(self) -> DataFrame:
        """Per technical group: expression."""
        return _restore_gene(self._groups)

    @cached_property
    def bio(self) -> DataFrame:
        """Representative rows with leave-one-out flags."""
        return _restore_gene(self._bio)

    @cached_property
    def summary(self) -> DataFrame:
        """Per (sample, gene) representative with stats and z-score."""
        return _restore_gene(self._summary)

    @cached_property
    def statistics(self) -> DataFrame:
        """Per (zscoring_group, gene) test."""
        return _restore_gene(statistics_table(self._bio, self.cfg))

    def report(self, with_comparisons: bool = False, ordered: bool = False) -> DataFrame:
        return assemble_report(self, with_comparisons, ordered)


def prepare_wells(wells: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    """Unassigned wells dropped, failed replicates dropped (or flagged), blank Cp filled."""
    w = wells.filter(F.col("replicate_name").isNotNull())
    w = drop_failed_replicates(w, cfg.bad_replicate_cp, cfg.drop_failed)
    return fill_undetected(w, cfg.bad_replicate_cp)


def bio_table(groups: DataFrame) -> DataFrame:
    """Representative row of every technical group that kept at least one well."""
    return groups.filter(F.col("elevated_value_mean").isNotNull()).select(
        F.col("_first.file_name").alias("file_name"), F.col("_first.Pos").alias("Pos"),
        F.col("_first.well_ord").alias("well_ord"), "replicate_name",
        F.col("_first.sample_name").alias("sample_name"), F.col("_first.zscoring_group").alias("zscoring_group"),
        F.col("_first.testing_group").alias("testing_group"), "Gene", "type_of_gene",
        "elevated_value_mean", "normalized_expression", "log2_expression_value")


def summarise_samples(bio_qc: DataFrame) -> DataFrame:
    s = sample_summary(bio_qc)
    s = s.filter(F.col("normalized_expression_mean").isNotNull())
    return zscore(s)


def statistics_table(bio_qc: DataFrame, cfg: AnalysisConfig) -> DataFrame:
    good = bio_qc.filter((F.col("qc_flag") == "GOOD") & (F.col("type_of_gene") != "HK"))
    return two_group_test(good, ("zscoring_group", "Gene"), "normalized_expression", "testing_group", cfg.test_type, cfg.exact_limit)


# A NULL gene is a group of its own.  Inside ``analyse`` it is carried as this fixed
# sentinel so the joins on (replicate, gene) are plain equi-joins (their output stays
# hash-partitioned for the next aggregate); every public output maps it back to NULL.
NULL_GENE = "\u0000"


def _restore_gene(df: DataFrame) -> DataFrame:
    if "Gene" not in df.columns:
        return df
    return df.withColumn("Gene", F.when(F.col("Gene") != F.lit(NULL_GENE), F.col("Gene")))


def analyse(wells: DataFrame, cfg: AnalysisConfig | None = None, pin: str | dict = "table") -> Analysis:
    """Full analysis of annotated wells.

    ``wells`` columns: file_name, Pos, well_ord (arrival ordinal), replicate_name,
    sample_name, zscoring_group, testing_group, Gene, type_of_gene, Cp.
    ``pin`` decides how the shared intermediates (value-level band counts,
    per-group table, leave-one-out table; all far smaller than the wells) are
    materialized.
    """
    cfg = cfg or AnalysisConfig()
    pins = pin if isinstance(pin, dict) else {"values": pin, "groups": pin, "bio": pin}
    assigned = (wells.filter(F.col("replicate_name").isNotNull())
                .withColumn("Gene", F.coalesce(F.col("Gene"), F.lit(NULL_GENE))))
    vals = screened_values(assigned, cfg.bad_replicate_cp, GROUP, "Cp", CARRY)
    qv = qc_from_values(vals, cfg.tolerance, cfg.keep_slack, GROUP, "Cp", cfg.chunk_width, pin=pins["values"],
                        drop_failed=cfg.drop_failed, null_safe=False)
    groups = materialize(group_expression(qv, GROUP, null_safe=False), pins["groups"])
    bio = materialize(loo_outliers(bio_table(groups), ("sample_name", "Gene"), "normalized_expression",
                                   cfg.dispersion, ("replicate_name", "well_ord"), cfg.loo_chunk_rows), pins["bio"])
    return Analysis(assigned, qv, groups, bio, cfg, pins)


def _group_level(a: Analysis) -> DataFrame:
    """Per technical group: expression, leave-one-out columns and (on the sample representative) summary."""
    g = a._groups.select(*GROUP, "_first", "elevated_value_mean", "normalized_expression", "log2_expression_value")
    g = join_keys(g, a._bio.select(*GROUP, "mean_others", "sd_others", "qc_flag"), GROUP, "left", null_safe=False)
    return join_keys(g, a._summary.select(*GROUP, *SUMMARY_COLS), GROUP, "left", null_safe=False)


def assemble_report(a: Analysis, with_comparisons: bool = False, ordered: bool = False) -> DataFrame:
    """Well-level report: every kept well with QC flags; group, sample and z-score columns on representatives.

    One inner join of the (filled) wells with the value-level result on
    (replicate, gene, Cp); wells of failed replicates have no value row and drop out.  ``ordered`` sorts globally, for
    small reports; a large one is written in order by ``sources.sinks.write_sorted``.
    """
    per_value = join_keys(a._values.select(*GROUP, "Cp", "keep_this_value", "good_replicate"), _group_level(a), GROUP, null_safe=False)
    wells = fill_undetected(a._source, a.cfg.bad_replicate_cp)
    if with_comparisons:
        wells = comparison_strings(wells, a.cfg.tolerance)
    rep = join_keys(wells, per_value, [*GROUP, "Cp"], "inner", null_safe=False)
    # one row per group: where metadata multiplies a well, its least metadata row represents it
    first = F.struct("well_ord", *CARRY) == F.col("_first")
    masked = ["elevated_value_mean", "normalized_expression", "log2_expression_value",
              "mean_others", "sd_others", "qc_flag", *SUMMARY_COLS]
    rep = rep.withColumn("elevated_value", F.pow(F.lit(0.5), F.col("Cp")))
    rep = rep.select(*[c for c in rep.columns if c not in masked],
                     *[F.when(first, F.col(c)).alias(c) for c in masked])
    cols = REPORT_COLS if not with_comparisons else [*REPORT_COLS[:11], "comparison_results", *REPORT_COLS[11:]]
    rep = _restore_gene(rep.select(*cols))
    return rep.orderBy(*report_order()) if ordered else rep


REPORT_KEYS = ["replicate_name", "Gene", "elevated_value_mean", "well_ord"]


def report_order() -> list:
    """The report's order: representatives lead their group, missing values come last."""
    return [F.col("replicate_name").asc_nulls_last(), F.col("Gene").asc_nulls_last(), F.col("elevated_value_mean").isNull().asc(),
            F.col("well_ord").asc()]


def recalculate(report: DataFrame, cfg: AnalysisConfig | None = None,
                overrides: DataFrame | None = None, pin: str = "table") -> tuple[DataFrame, DataFrame]:
    """Replay downstream of curated flags (returns report, statistics).

    ``report`` is a well-level report (columns as ``assemble_report``);
    ``overrides`` is an optional (file_name, Pos, keep_this_value, qc_flag)
    table of hand-edited flags, applied with ``coalesce(override, report)``.
    Keep flags and qc flags are taken as given (not re-derived); means,
    ratios, log2, sample statistics, z-scores and fresh p-values are
    recomputed.  As in the original replay, only representative rows carry a
    qc flag, and GOOD-filtering uses the curated flag.
    """
    cfg = cfg or AnalysisConfig()
    r = report.select(*REPLAY_INPUT)
    if overrides is not None:
        r = with_overrides(r, overrides)
    r = materialize(r, pin)
    grp = materialize(replayed_groups(r), pin)
    bio = materialize(replayed_bio(grp), pin)
    summary = materialize(summarise_samples(bio), pin)
    stats = statistics_table(bio, cfg)
    return replayed_report(r, grp, summary), stats


REPLAY_INPUT = ["file_name", "Pos", "well_ord", "replicate_name", "sample_name", "zscoring_group", "testing_group", "Gene", "type_of_gene",
                "Cp", "good_replicate", "keep_this_value", "elevated_value", "qc_flag"]


def with_overrides(rows: DataFrame, overrides: DataFrame) -> DataFrame:
    o = overrides.select("file_name", "Pos", F.col("keep_this_value").alias("_k"), F.col("qc_flag").alias("_q"))
    return (join_keys(rows, o, ["file_name", "Pos"], "left")
            .withColumn("keep_this_value", F.coalesce("_k", "keep_this_value"))
            .withColumn("qc_flag", F.coalesce("_q", "qc_flag")).drop("_k", "_q"))


def replayed_groups(r: DataFrame) -> DataFrame:
    """Per technical group of whole replicates: means, ratios and the first row, from the flags as given."""
    kept = F.col("keep_this_value") == "keep"
    grp = r.groupBy(*GROUP).agg(
        F.sum(F.when(kept, 1).otherwise(0)).alias("n_kept"),
        F.sum(F.when(kept, F.col("elevated_value"))).alias("_sev"),
        F.min(F.struct("well_ord", *CARRY)).alias("_first"),
        F.min(F.struct("well_ord", *CARRY, "qc_flag")).alias("_firstq"))
    grp = grp.withColumn("elevated_value_mean", safe_div(F.col("_sev"), F.col("n_kept").cast("double")))
    grp = grp.withColumn("type_of_gene", F.col("_first.type_of_gene"))
    hk = (grp.filter((F.col("type_of_gene") == "HK") & (F.col("n_kept") > 0)).groupBy("replicate_name")
          .agg(*weighted_mean_exact("elevated_value_mean", "n_kept"))
          .select("replicate_name", finish_weighted_mean("elevated_value_mean").alias("_hk")))
    grp = join_keys(grp, hk, ["replicate_name"], "left")
    grp = grp.withColumn("normalized_expression", safe_div(F.col("elevated_value_mean"), F.col("_hk"))) \
        .withColumn("log2_expression_value", log2_or_null(F.col("normalized_expression")))
    return grp.drop("_hk")


def replayed_bio(grp: DataFrame) -> DataFrame:
    """Representatives with the flag of their first row."""
    return join_keys(bio_table(grp), grp.select(*GROUP, F.col("_firstq.qc_flag").alias("qc_flag")), GROUP)


def replayed_report(r: DataFrame, grp: DataFrame, summary: DataFrame) -> DataFrame:
    """The rows with their group's and sample's values on representatives."""
    g = grp.select(*GROUP, "_first", "elevated_value_mean",
                   "normalized_expression", "log2_expression_value", F.col("_firstq.qc_flag").alias("_qc"))
    g = join_keys(g, summary.select("replicate_name", "Gene", *SUMMARY_COLS), GROUP, "left")
    out = join_keys(r.drop("qc_flag"), g, GROUP, "left")
    first = F.struct("well_ord", *CARRY) == F.col("_first")
    for c in ["elevated_value_mean", "normalized_expression", "log2_expression_value", *SUMMARY_COLS]:
        out = out.withColumn(c, F.when(first, F.col(c)))
    return out.withColumn("qc_flag", F.when(first, F.col("_qc"))).drop("_qc", "_first")


def run_files(spark, plates, gene_layout: DataFrame, sample_layout: DataFrame, metadata: DataFrame,
              out_dir: str, cfg: AnalysisConfig | None = None, meta_key: str = "replicate_name",
              partition_by: tuple[str, ...] = ("zscoring_group",)) -> Analysis:
    """The file workflow end to end: plate exports (paths) + layout sheets + metadata ->
    annotated wells -> analysis -> Parquet sinks under ``out_dir``:

    ``wells`` (annotated, failed replicates screened, blanks filled), ``report`` (well level, files in the report's
    order with a manifest), ``statistics``, ``unmatched`` (wells dropped by the annotation), ``repeated_metadata`` (metadata keys that
    multiply wells) and ``rejected`` (lines of the exports that could not be read; they are no wells).  The annotated
    wells are pinned once for all sinks.
    """
    from qplate.operators.layout import annotate_wells, duplicate_metadata_keys, unmatched_wells
    from qplate.sources.plates import read_plates, rejected_lines, write_table
    from qplate.sources.sinks import write_sorted, write_split

    cfg = cfg or AnalysisConfig()
    raw = read_plates(spark, plates, on_bad_line="drop").select("file_name", "Pos", "well_ord", "Cp")
    raw = materialize(raw, "table")
    wells = materialize(annotate_wells(raw, gene_layout, sample_layout, metadata, cfg.hk_genes, meta_key), "table")
    a = analyse(wells, cfg)
    base = out_dir.rstrip("/")
    write_table(rejected_lines(spark, plates), f"{base}/rejected")
    write_split(a.wells, f"{base}/wells", partition_by)
    write_sorted(materialize(a.report(), "table"), f"{base}/report", report_order(), REPORT_KEYS)
    write_table(a.statistics, f"{base}/statistics")
    write_table(unmatched_wells(raw, gene_layout, sample_layout, metadata, meta_key), f"{base}/unmatched")
    write_table(duplicate_metadata_keys(metadata, meta_key), f"{base}/repeated_metadata")
    return a


def replay_files(spark, report_path: str, out_dir: str, cfg: AnalysisConfig | None = None,
                 overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The curation loop: read a report back, apply hand-edited flags (see :func:`recalculate`) and write the
    replayed ``report`` and its ``statistics`` under ``out_dir``, which must not be the folder that is read."""
    from qplate.sources.plates import write_table

    report, stats = recalculate(spark.read.parquet(report_path), cfg, overrides)
    base = out_dir.rstrip("/")
    write_table(report, f"{base}/report")
    write_table(stats, f"{base}/statistics")
    return report, stats
