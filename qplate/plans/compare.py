"""Comparison projection shared by registered queries and their SQL oracles.

Doubles are rounded to 10 significant digits with exact power-of-ten
scaling, identically in Spark (``round_sig``) and in SQL (``sql_round_sig``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qplate.functions.numeric import round_sig

SIG_DIGITS = 10
# Differences of near-equal quantities (z-scores, delta-delta Ct) lose relative precision to
# summation order; they are compared at a fixed absolute precision instead.
ABS_DECIMALS = 9
ABSOLUTE_COLUMNS = frozenset({"zscored_value", "delta_delta_CT", "control_z", "treated_z"})


def for_compare(df: DataFrame) -> DataFrame:
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) and f.name in ABSOLUTE_COLUMNS:
            cols.append(F.round(F.col(f.name).cast("double"), ABS_DECIMALS).alias(f.name))
        elif isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(round_sig(F.col(f.name).cast("double"), SIG_DIGITS).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sql_round_sig(expr: str, digits: int = SIG_DIGITS) -> str:
    x = f"({expr})"
    e = f"floor(log10(abs({x})))"
    return (f"CASE WHEN {x} IS NULL OR isnan({x}) OR {x} = 0 THEN {x} "
            f"WHEN {e} < 0 THEN round({x} * pow(10, -{e}), {digits - 1}) / pow(10, -{e}) "
            f"ELSE round({x} / pow(10, {e}), {digits - 1}) * pow(10, {e}) END")


def sql_round_abs(expr: str, decimals: int = ABS_DECIMALS) -> str:
    return f"round(({expr}), {decimals})"
