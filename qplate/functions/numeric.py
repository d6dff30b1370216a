"""Column-level numeric helpers (all JVM-side, no Python UDFs)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def safe_div(num: Column, den: Column) -> Column:
    """Division that yields NULL for a NULL, zero or NaN operand instead of NaN/inf/error."""
    return F.try_divide(F.nanvl(num, F.lit(None).cast("double")), F.nanvl(den, F.lit(None).cast("double")))


def log2_or_null(x: Column) -> Column:
    """log2, NULL for NULL or non-positive input."""
    return F.when(x > 0, F.log2(x))


def round_sig(x: Column, digits: int = 10) -> Column:
    """Round to ``digits`` significant digits using only exact power-of-ten scaling.

    Used for the cross-engine comparison projection: floor(log10|x|) picks the decade,
    the value is scaled by an exact integer power of ten, rounded, and scaled back.
    """
    e = F.floor(F.log10(F.abs(x)))
    up = F.pow(F.lit(10.0), -e)     # exact integer power when e <= 0
    down = F.pow(F.lit(10.0), e)    # exact integer power when e >= 0
    r = F.when(e < 0, F.round(x * up, digits - 1) / up).otherwise(F.round(x / down, digits - 1) * down)
    return F.when(x.isNull() | F.isnan(x) | (x == 0), x).otherwise(r)


def chan_merge(a: tuple[Column, Column, Column], b: tuple[Column, Column, Column]) -> tuple[Column, Column, Column]:
    """Merge two (count, mean, M2) summaries of disjoint sets (Chan et al. pairwise update).

    Counts are non-null counts; an empty side has count 0 and mean/M2 ignored.
    No subtraction of large sums is involved, so leave-one-out results stay exact
    to a few ulps even when one value dominates the variance.
    """
    na, ma, qa = (F.coalesce(a[0], F.lit(0)), a[1], a[2])
    nb, mb, qb = (F.coalesce(b[0], F.lit(0)), b[1], b[2])
    n = na + nb
    delta = mb - ma
    mean = (F.when(na == 0, mb).when(nb == 0, ma)
            .otherwise(ma + delta * (nb.cast("double") / n.cast("double"))))
    m2 = (F.when(na == 0, F.coalesce(qb, F.lit(0.0))).when(nb == 0, F.coalesce(qa, F.lit(0.0)))
          .otherwise(qa + qb + delta * delta * (na.cast("double") * nb.cast("double") / n.cast("double"))))
    return n, F.when(n > 0, mean), F.when(n > 0, m2)


def student_t_two_sided_p(t: Column, df: Column) -> Column:
    """Two-sided Student-t p-value: I_{df/(df+t^2)}(df/2, 1/2), via commons-math3 on the JVM."""
    x = (df / (df + t * t)).cast("double")
    p = F.call_function(
        "reflect",
        F.lit("org.apache.commons.math3.special.Beta"),
        F.lit("regularizedBeta"),
        x,
        (df / 2.0).cast("double"),
        F.lit(0.5).cast("double"),
    ).cast("double")
    return F.when(t.isNotNull() & df.isNotNull() & (df > 0), p)


def normal_two_sided_p(z: Column) -> Column:
    """Two-sided standard-normal p-value 2*Phi(-|z|) = erfc(|z|/sqrt 2), via commons-math3."""
    p = F.call_function(
        "reflect",
        F.lit("org.apache.commons.math3.special.Erf"),
        F.lit("erfc"),
        (F.abs(z) / F.lit(2.0 ** 0.5)).cast("double"),
    ).cast("double")
    return F.when(z.isNotNull() & ~F.isnan(z), p)
