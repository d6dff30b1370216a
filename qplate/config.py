"""Analysis constants.

Fixed values that must equal the original analysis for identical results:
housekeeping genes ["RHOA"], failed-replicate cycle threshold 35, technical
tolerance 0.5 cycles, leave-one-out dispersion 2.5 sd (3 in the Cp-ratio
variant), magnitude jump 2 decades, test "ttest".
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class AnalysisConfig:
    hk_genes: tuple[str, ...] = ("RHOA",)
    bad_replicate_cp: float = 35.0      # HK Cp >= this fails the replicate; blank Cp is filled with it
    tolerance: float = 0.5              # |Cp_a - Cp_b| <= tolerance marks a technical pair "good"
    keep_slack: int = 2                 # mixed groups keep a well with >= n - keep_slack good pairs
    dispersion: float = 2.5             # leave-one-out outlier: |x - mean_others| > dispersion * sd_others
    test_type: str = "ttest"            # "ttest" (Welch) or "wilcox" (rank-sum)
    exact_limit: int = 50               # rank-sum: exact p-value when both groups have fewer values and no ties
    magnitude_jump: int = 2             # axis-break detection, decades
    drop_failed: bool = True            # False: flag failed replicates but keep them
    # scale knobs (no effect on results)
    value_chunk_width: float | None = None   # Cp units per value chunk in technical QC; default 8 * tolerance
    loo_chunk_rows: int = 4096               # rows per salted chunk in leave-one-out

    @property
    def chunk_width(self) -> float:
        return self.value_chunk_width or max(8.0 * self.tolerance, 1.0)
