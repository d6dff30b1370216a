"""Replay of what changed: hand-edited flags carried through the analysis to the groups that they touch.

A changed flag touches its replicate (a housekeeping well changes every ratio of it), the replicate's samples, the z-score
groups that these samples are or were in, and the tests of its genes.  Only those are recomputed, from the touched replicates' wells and
from the representatives that an earlier report already holds for the rest of the touched samples and groups; everything
else of the report stays as it is.  The result equals :func:`qplate.plans.pipeline.recalculate` over the whole report.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from qplate.config import AnalysisConfig
from qplate.operators._util import join_keys, materialize
from qplate.operators.summary import sample_summary, zscore
from qplate.plans.pipeline import (
    GROUP,
    REPLAY_INPUT,
    SUMMARY_COLS,
    replayed_bio,
    replayed_groups,
    replayed_report,
    statistics_table,
    with_overrides,
)

ROW = ["file_name", "Pos", "replicate_name", "sample_name", "zscoring_group", "testing_group", "Gene"]
TEST = ["zscoring_group", "Gene"]
OUTPUT = [*[c for c in REPLAY_INPUT if c != "qc_flag"], "elevated_value_mean", "normalized_expression", "log2_expression_value",
          *SUMMARY_COLS, "qc_flag"]
NAMED = 1000  # touched replicates whose names are pushed down to the report's files


@dataclass
class Changes:
    rows: DataFrame        # the report rows that change, whole
    tests: DataFrame       # the tests that may change: (zscoring_group, Gene)
    statistics: DataFrame  # their fresh rows


def _bio_columns(df: DataFrame) -> DataFrame:
    return df.select("file_name", "Pos", "well_ord", "replicate_name", "sample_name", "zscoring_group", "testing_group", "Gene", "type_of_gene",
                     "elevated_value_mean", "normalized_expression", "log2_expression_value", "qc_flag")


def _without(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return join_keys(df, keys, on, "left_anti")


def _within(df: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    return join_keys(df, keys, on, "left_semi")


def touched_replicates(report: DataFrame, overrides: DataFrame) -> DataFrame:
    """Replicates with a row that an override really changes; reads the flags and keys of the report only."""
    o = overrides.select("file_name", "Pos", F.col("keep_this_value").alias("_k"), F.col("qc_flag").alias("_q"))
    flags = report.select("file_name", "Pos", "replicate_name", "keep_this_value", "qc_flag")
    differs = (F.col("_k").isNotNull() & ~F.col("_k").eqNullSafe(F.col("keep_this_value"))) \
        | (F.col("_q").isNotNull() & ~F.col("_q").eqNullSafe(F.col("qc_flag")))
    return join_keys(flags, o, ["file_name", "Pos"]).filter(differs).select("replicate_name").distinct()


def _named(report: DataFrame, replicates: DataFrame) -> DataFrame:
    """The report with the touched names pushed down to its files where they are few; it is sorted by them, so most row
    groups are skipped.  The semi-join that follows does not depend on it."""
    names = [r[0] for r in replicates.limit(NAMED + 1).collect()]
    return report.filter(F.col("replicate_name").isin(names)) if len(names) <= NAMED else report


def replay_changes(report: DataFrame, overrides: DataFrame, cfg: AnalysisConfig | None = None, pin: str = "table") -> Changes:
    """What changes in ``report`` (an analysis report or an earlier replay) and in its tests under ``overrides``
    (file_name, Pos, keep_this_value, qc_flag; NULL leaves a flag alone)."""
    cfg = cfg or AnalysisConfig()
    replicates = materialize(touched_replicates(report, overrides), pin)
    rows = with_overrides(_within(_named(report, replicates), replicates, ["replicate_name"]).select(*REPLAY_INPUT), overrides)
    rows = materialize(rows, pin)
    groups = materialize(replayed_groups(rows), pin)
    fresh = materialize(_bio_columns(replayed_bio(groups)), pin)
    samples = materialize(rows.select("sample_name").distinct(), pin)

    # representatives of the earlier report: one per technical group, so far fewer than the wells
    earlier = report.filter(F.col("elevated_value_mean").isNotNull())
    rest = _bio_columns(_without(_within(earlier, samples, ["sample_name"]), replicates, ["replicate_name"]))
    summary = sample_summary(fresh.unionByName(rest)).filter(F.col("normalized_expression_mean").isNotNull())
    summary = materialize(summary, pin)

    # z-score groups that a touched sample is in now or was in before
    columns = [c for c in SUMMARY_COLS if c != "zscored_value"]
    summed = earlier.filter(F.col("normalized_expression_mean").isNotNull())
    was = _within(summed, samples, ["sample_name"])
    z_groups = materialize(was.select(*TEST).unionByName(summary.select(*TEST)).distinct(), pin)
    others = _without(_within(summed, z_groups, TEST), samples, ["sample_name"])
    scored = materialize(zscore(summary.select(*GROUP, *TEST[:1], *columns).unionByName(others.select(*GROUP, *TEST[:1], *columns))), pin)

    changed = replayed_report(rows, groups, scored).select(*OUTPUT)
    # representatives of other replicates that gain, lose or change a summary or a z-score
    moved = was.select(*GROUP).unionByName(scored.select(*GROUP)).distinct()
    outside = _without(_within(earlier, moved, GROUP), replicates, ["replicate_name"]).drop(*SUMMARY_COLS)
    outside = join_keys(outside, scored.select(*GROUP, *SUMMARY_COLS), GROUP, "left").select(*OUTPUT)

    tested = _within(earlier, replicates, ["replicate_name"]).select(*TEST).unionByName(fresh.select(*TEST)).distinct()
    tests = materialize(tested, pin)
    values = fresh.unionByName(_bio_columns(_without(_within(earlier, tests, TEST), replicates, ["replicate_name"])))
    return Changes(changed.unionByName(outside), tests, statistics_table(values, cfg))


def merge_changes(report: DataFrame, statistics: DataFrame, changes: Changes) -> tuple[DataFrame, DataFrame]:
    """The earlier report and statistics with the changed rows in place of theirs."""
    rows = materialize(changes.rows, "table")
    kept = _without(report.select(*OUTPUT), rows.select(*ROW), ROW)
    fresh = changes.statistics
    return kept.unionByName(rows), _without(statistics.select(*fresh.columns), changes.tests, TEST).unionByName(fresh)
