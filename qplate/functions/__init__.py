from qplate.functions.numeric import (
    chan_merge,
    log2_or_null,
    normal_two_sided_p,
    round_sig,
    safe_div,
    student_t_two_sided_p,
)
from qplate.functions.wells import hk_type, pos_column, pos_row, well_index

__all__ = [
    "chan_merge", "log2_or_null", "normal_two_sided_p", "round_sig", "safe_div",
    "student_t_two_sided_p", "hk_type", "pos_column", "pos_row", "well_index",
]
