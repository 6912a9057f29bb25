"""Statistical expressions written with Spark built-ins only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_LN_SQRT_PI = 0.5723649429247001  # ln(sqrt(pi))
# Terms of the continued fraction; it converges within about sqrt(a) + 60.
_FRACTION_TERMS = 400


def ln_gamma_half_int_plus1(a: Column) -> Column:
    """ln Gamma(a + 1) for a = k/2, k a positive integer: the product
    a (a-1) ... down to 1 or 1/2, times sqrt(pi) when a is not integral."""
    terms = F.aggregate(
        F.sequence(F.lit(0), F.ceil(a).cast("int") - 1),
        F.lit(0.0),
        lambda acc, j: acc + F.ln(a - j),
    )
    return terms + F.when(a != F.floor(a), F.lit(_LN_SQRT_PI)).otherwise(F.lit(0.0))


def chi2_sf(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-square distribution, P(X >= stat), in full
    precision: with a = dof/2 and x = stat/2, for x <= a + 1 one minus the
    series of the lower tail (which is no small difference there), beyond it
    the continued fraction of the upper tail, evaluated from its far end:

        Q(a, x) = exp(-x + a ln x - ln Gamma(a)) / (x + 1 - a - 1(1 - a)/(x + 3 - a - ...))

    dof 0 (a degenerate table) or stat 0 give 1.
    """
    return _upper_tail(stat, dof)[0]


def chi2_log10_sf(stat: Column, dof: Column) -> Column:
    """log10 of the upper tail, also where the tail itself is too small for a
    double (beyond a statistic of about 1,400)."""
    return _upper_tail(stat, dof)[1]


def _upper_tail(stat: Column, dof: Column) -> tuple[Column, Column]:
    a = dof.cast("double") / 2
    x = stat.cast("double") / 2
    log_pref = a * F.ln(x) - x - ln_gamma_half_int_plus1(a)
    series = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.lit(60), (x + F.sqrt(x) * 12 + 60).cast("int"))),
        F.struct(F.lit(0.0).alias("lt"), F.exp(log_pref).alias("s")),
        lambda acc, m: F.struct(
            (acc["lt"] + F.ln(x) - F.ln(a + m)).alias("lt"),
            (acc["s"] + F.exp(log_pref + acc["lt"] + F.ln(x) - F.ln(a + m))).alias("s"),
        ),
        lambda acc: acc["s"],
    )
    fraction = F.aggregate(
        F.sequence(F.lit(_FRACTION_TERMS), F.lit(1), F.lit(-1)), F.lit(0.0),
        lambda acc, n: -n * (n - a) / (x + 2 * n + 1 - a + acc))
    log_upper = log_pref + F.ln(a) - F.ln(x + 1 - a + fraction)
    near = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - series))
    certain = (dof <= 0) | (stat <= 0)
    return (F.when(certain, F.lit(1.0)).when(x > a + 1, F.exp(log_upper)).otherwise(near),
            F.when(certain, F.lit(0.0)).when(x > a + 1, log_upper / F.ln(F.lit(10.0))).otherwise(F.log10(near)))
