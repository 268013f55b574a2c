"""Scalar expressions; all of them stay inside generated JVM code."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Coefficients below it count as zero (fixed value).
TINY = 1e-12


def safe_div(n: Column, d: Column) -> Column:
    """n / d, 0 where d is 0 or null."""
    return F.when(d != 0, n / d).otherwise(F.lit(0.0))


def shown(x: Column, digits: int = 6) -> Column:
    """Rounded for comparison, without a negative zero."""
    return F.round(x, digits) + F.lit(0.0)


def residual(norm2: Column, s2: Column) -> Column:
    """Frobenius norm of X - Z S Z' for orthonormal Z, from the squared norms of X and S."""
    return F.sqrt(F.greatest(F.lit(0.0), F.lit(1e-9) + norm2 - s2))


def guarded(x: Column, least: float = 1e-6) -> Column:
    """x, or ``least`` where x is smaller, infinite or not a number."""
    return F.when(x.isNull() | F.isnan(x) | (x < least) | (x == float("inf")), F.lit(least)).otherwise(x)


def positive_part(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0))


def negative_part(x: Column) -> Column:
    return F.greatest(-x, F.lit(0.0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def length2(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def spectral_angle(a: Column, b: Column) -> Column:
    """Angle between two arrays after their means are removed, from 0 to 1 (a right angle and more: 0.5 and more)."""
    centred = lambda x: F.transform(x, lambda y: y.cast("double") - dot(x, F.transform(x, lambda _: F.lit(1.0))) / F.size(x))
    x, y = centred(a), centred(b)
    cosine = safe_div(dot(x, y), length2(x) * length2(y))
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))) / F.lit(3.141592653589793)


def mean_sd(mean: Column, sd: Column, digits: int = 3) -> Column:
    """``mean ± sd`` as text."""
    return F.format_string(f"%.{digits}f ± %.{digits}f", mean, sd)


def quartic_minimum(df: DataFrame, a: str, c: str, d: str) -> DataFrame:
    """Adds x and f: the least value of a/4 x^4 + c/2 x^2 + d x over x >= 0, and where.

    The stationary points are the roots of x^3 + p x + q in closed form: one by
    cube roots, three by the cosine of a third of an angle, or a repeated one.
    Without a positive root whose value is below zero, x and f are 0.
    """
    p, q = F.col("_p"), F.col("_q")
    third = 2.0943951023931953
    flat = F.abs(F.col(a)) < TINY
    out = df.withColumn("_p", F.when(~flat, F.col(c) / F.col(a))).withColumn("_q", F.when(~flat, F.col(d) / F.col(a)))
    out = out.withColumn("_delta", 4 * p * p * p + 27 * q * q)
    delta = F.col("_delta")
    out = out.withColumn("_s", F.when(delta > 0, F.sqrt(delta / 27))).withColumn("_r", F.when(p < 0, 2 * F.sqrt(-p / 3)))
    angle = F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -q / 2 * F.sqrt(-27 / (p * p * p))))) / 3
    out = out.withColumn("_t", F.when((delta < 0) & (p < 0), angle))
    same = F.abs(delta) < TINY
    zero = (F.abs(p) < TINY) & (F.abs(q) < TINY) & (p != 0)
    r1 = (
        F.when(flat, F.when(F.abs(F.col(c)) > TINY, -F.col(d) / F.col(c)))
        .when(same, F.when(p == 0, F.cbrt(-q)).when(zero, F.lit(0.0)).otherwise(3 * q / F.nullif(p, F.lit(0.0))))
        .when(delta > 0, F.cbrt((-q + F.col("_s")) / 2) + F.cbrt((-q - F.col("_s")) / 2))
        .otherwise(F.col("_r") * F.cos("_t"))
    )
    r2 = F.when(flat, None).when(same, F.when((p != 0) & ~zero, -3 * q / (2 * F.nullif(p, F.lit(0.0))))).when(delta < 0, F.col("_r") * F.cos(F.col("_t") + third))
    r3 = F.when(flat | same, None).when(delta < 0, F.col("_r") * F.cos(F.col("_t") + 2 * third))
    out = out.withColumn("_r1", r1).withColumn("_r2", r2).withColumn("_r3", r3)
    value = lambda r: F.when(r > 0, F.col(a) / 4 * r * r * r * r + F.col(c) / 2 * r * r + F.col(d) * r)
    pick = F.least(*(F.struct(F.coalesce(value(F.col(r)), F.lit(0.0)).alias("f"), F.when(value(F.col(r)) < 0, F.col(r)).otherwise(0.0).alias("x")) for r in ("_r1", "_r2", "_r3")))
    out = out.withColumn("_best", pick)
    f = F.least(F.col("_best.f"), F.lit(0.0))
    return out.withColumn("f", f).withColumn("x", F.when(F.col("_best.f") < 0, F.col("_best.x")).otherwise(0.0)).drop("_p", "_q", "_delta", "_s", "_r", "_t", "_r1", "_r2", "_r3", "_best")
