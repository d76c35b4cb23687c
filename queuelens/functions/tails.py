"""Tail probabilities as Spark column expressions (no Python worker).

Chi-square, normal and Student-t tails reduce to the regularised incomplete
gamma and beta functions. Their standard expansions (power series and
modified-Lentz continued fractions, as in Numerical Recipes) run inside
``aggregate`` over a ``sequence`` whose length follows from the parameters;
after convergence further iterations leave the value unchanged, and a value
that has not converged is null. The gamma function is only needed at
half-integers (k/2 degrees of freedom).

The ``with_*`` helpers first stage their inputs as columns so the iterated
lambdas reference plain attributes (a small expression tree for the
analyser and optimiser), then drop the staging columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Terms grow with the square root of the parameters, as convergence near the
# mean needs; a result whose last step still moved it by more is null.
BASE_TERMS, TERMS_PER_ROOT = 200, 12.0
CONVERGED = 1e-10
STIRLING_FROM = 30.0
_TINY = 1e-300
_LOG_SQRT_PI = 0.5 * math.log(math.pi)

# The staged expressions below only reference fixed staging columns, so each
# is built once per Spark context (building the iterated lambdas is the slow
# part) and reused by every query.
_BUILT: dict[tuple, Column] = {}


def _cached(name: str, build) -> Column:
    from pyspark import SparkContext
    key = (name, id(SparkContext._active_spark_context))
    col = _BUILT.get(key)
    if col is None:
        col = build()
        _BUILT[key] = col
    return col


def _guard(x: Column) -> Column:
    return F.when(F.abs(x) < F.lit(_TINY), F.lit(_TINY)).otherwise(x)


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _terms(*parameters: Column) -> Column:
    """1, 2, ... as far as an expansion with these parameters has to go."""
    largest = F.greatest(*(F.coalesce(F.abs(p), F.lit(0.0)) for p in parameters)) if len(parameters) > 1 \
        else F.coalesce(F.abs(parameters[0]), F.lit(0.0))
    return F.sequence(F.lit(1), F.lit(BASE_TERMS) + F.ceil(F.lit(TERMS_PER_ROOT) * F.sqrt(largest)).cast("int"))


def lgamma_half(a: Column) -> Column:
    """ln Gamma(a) for a = k/2, k a positive integer: an exact product below
    STIRLING_FROM, Stirling's series beyond."""
    m = F.floor(F.least(a, F.lit(STIRLING_FROM)) - F.lit(0.5)).cast("int")
    base = F.when(a - F.floor(a) == F.lit(0.5), F.lit(_LOG_SQRT_PI)).otherwise(F.lit(0.0))
    prod = F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), F.lit(0.0),
                       lambda acc, j: acc + F.when(j <= m, F.log(a - j)).otherwise(F.lit(0.0)))
    series = F.lit(1 / 12.0) / a - F.lit(1 / 360.0) / (a * a * a) + F.lit(1 / 1260.0) / (a * a * a * a * a)
    far = (a - F.lit(0.5)) * F.log(a) - a + F.lit(0.5 * math.log(2 * math.pi)) + series
    return F.when(a >= F.lit(STIRLING_FROM), far).otherwise(base + prod)


def _gamma_q(a: Column, x: Column, lg: Column) -> Column:
    """Q(a, x) given ln Gamma(a); a, x, lg should be attribute references. Null if not converged."""
    front = F.exp(-x + a * F.log(x) - lg)
    steps = _terms(a)
    series = F.aggregate(
        steps, F.struct((F.lit(1.0) / a).alias("t"), (F.lit(1.0) / a).alias("s")),
        lambda acc, n: F.struct((acc["t"] * x / (a + n)).alias("t"),
                                (acc["s"] + acc["t"] * x / (a + n)).alias("s")),
        lambda acc: F.when(acc["t"] <= acc["s"] * F.lit(CONVERGED), acc["s"]))

    def lentz(acc, i):
        an = -i * (i - a)
        b = acc["b"] + F.lit(2.0)
        d = F.lit(1.0) / _guard(an * acc["d"] + b)
        c = _guard(b + an / acc["c"])
        return F.struct(b.alias("b"), c.alias("c"), d.alias("d"), (acc["h"] * d * c).alias("h"),
                        F.abs(d * c - F.lit(1.0)).alias("e"))
    b0 = x + F.lit(1.0) - a
    cf = F.aggregate(steps, F.struct(b0.alias("b"), F.lit(1.0 / _TINY).alias("c"), (F.lit(1.0) / b0).alias("d"),
                                     (F.lit(1.0) / b0).alias("h"), F.lit(1.0).alias("e")),
                     lentz, lambda acc: F.when(acc["e"] <= F.lit(CONVERGED), acc["h"]))
    q = F.when(x < a + F.lit(1.0), F.lit(1.0) - series * front).otherwise(front * cf)
    return F.when(x.isNull() | a.isNull(), F.lit(None).cast("double")) \
            .when(x <= F.lit(0.0), F.lit(1.0)) \
            .when(q.isNotNull(), F.greatest(F.lit(0.0), q))


def _with_gamma_q(df: DataFrame, a: Column, x: Column, out: str) -> DataFrame:
    staged = df.withColumns({"_tl_a": a.cast("double"), "_tl_x": x.cast("double")})
    staged = staged.withColumn("_tl_lg", _cached("lgamma_a", lambda: lgamma_half(F.col("_tl_a"))))
    q = _cached("gamma_q", lambda: _gamma_q(F.col("_tl_a"), F.col("_tl_x"), F.col("_tl_lg")))
    return staged.withColumn(out, q).drop("_tl_a", "_tl_x", "_tl_lg")


def with_chi2_sf(df: DataFrame, stat, dof, out: str) -> DataFrame:
    """Adds ``out`` = P(X > stat) for a chi-square with ``dof`` degrees of freedom."""
    stat, dof = _c(stat), _c(dof)
    res = _with_gamma_q(df.withColumn("_tl_ok", dof > 0), dof.cast("double") / F.lit(2.0),
                        stat.cast("double") / F.lit(2.0), out)
    return res.withColumn(out, F.when(F.col("_tl_ok"), F.col(out))).drop("_tl_ok")


def with_normal_two_sided(df: DataFrame, z, out: str) -> DataFrame:
    """Adds ``out`` = 2 P(Z > |z|) = Q(1/2, z^2/2)."""
    z = _c(z).cast("double")
    return _with_gamma_q(df, F.lit(0.5), z * z / F.lit(2.0), out)


def _beta_cf(a: Column, b: Column, x: Column) -> Column:
    qab, qap, qam = a + b, a + F.lit(1.0), a - F.lit(1.0)
    d0 = F.lit(1.0) / _guard(F.lit(1.0) - qab * x / qap)

    def step(acc, m):
        m2 = m * 2
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = F.lit(1.0) / _guard(F.lit(1.0) + aa * acc["d"])
        c = _guard(F.lit(1.0) + aa / acc["c"])
        h = acc["h"] * d * c
        aa2 = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d2 = F.lit(1.0) / _guard(F.lit(1.0) + aa2 * d)
        c2 = _guard(F.lit(1.0) + aa2 / c)
        return F.struct(c2.alias("c"), d2.alias("d"), (h * d2 * c2).alias("h"),
                        F.abs(d2 * c2 - F.lit(1.0)).alias("e"))
    return F.aggregate(_terms(a, b),
                       F.struct(F.lit(1.0).alias("c"), d0.alias("d"), d0.alias("h"), F.lit(1.0).alias("e")),
                       step, lambda acc: F.when(acc["e"] <= F.lit(CONVERGED), acc["h"]))


def with_corr_two_sided(df: DataFrame, r, n, out: str) -> DataFrame:
    """Adds ``out`` = two-sided p of a correlation coefficient (t with n-2 dof);
    0 when |r| = 1, null when n < 3."""
    r, n = _c(r).cast("double"), _c(n).cast("double")
    s = df.withColumns({"_tl_r": r, "_tl_n": n})
    s = s.withColumns({
        "_tl_a": (F.col("_tl_n") - F.lit(2.0)) / F.lit(2.0),
        # x = nu / (nu + t^2), t^2 = r^2 nu / (1 - r^2); null when |r| = 1 (p = 0 then)
        "_tl_x": F.try_divide(
            F.col("_tl_n") - F.lit(2.0),
            (F.col("_tl_n") - F.lit(2.0))
            + F.try_divide(F.col("_tl_r") * F.col("_tl_r") * (F.col("_tl_n") - F.lit(2.0)),
                           F.lit(1.0) - F.col("_tl_r") * F.col("_tl_r")))})
    s = s.withColumns({"_tl_lab": _cached("lgamma_ab", lambda: lgamma_half(F.col("_tl_a") + F.lit(0.5))),
                       "_tl_la": _cached("lgamma_a", lambda: lgamma_half(F.col("_tl_a")))})

    def front_expr():
        a, b, x = F.col("_tl_a"), F.lit(0.5), F.col("_tl_x")
        return F.exp(F.col("_tl_lab") - F.col("_tl_la") - F.lit(_LOG_SQRT_PI)
                     + a * F.log(x) + b * F.log(F.lit(1.0) - x))

    def p_expr():
        a, b, x = F.col("_tl_a"), F.lit(0.5), F.col("_tl_x")
        front = F.col("_tl_front")
        lower = front * _beta_cf(a, b, x) / a
        upper = F.lit(1.0) - front * _beta_cf(b, a, F.lit(1.0) - x) / b
        inner = F.when(x < (a + F.lit(1.0)) / (a + b + F.lit(2.0)), lower).otherwise(upper)
        p = F.when(x <= F.lit(0.0), F.lit(0.0)).when(x >= F.lit(1.0), F.lit(1.0)).otherwise(inner)
        rr, nn = F.col("_tl_r"), F.col("_tl_n")
        return (F.when(rr.isNull() | nn.isNull() | (nn < 3), F.lit(None).cast("double"))
                .when(F.abs(rr) >= F.lit(1.0), F.lit(0.0)).otherwise(p))
    s = s.withColumn("_tl_front", _cached("beta_front", front_expr))
    return s.withColumn(out, _cached("beta_p", p_expr)).drop("_tl_r", "_tl_n", "_tl_a", "_tl_x", "_tl_lab", "_tl_la", "_tl_front")
