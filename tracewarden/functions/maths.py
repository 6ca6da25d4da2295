"""Numeric Column helpers shared by the scorers, statistics and evaluation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Published rational approximation of the normal tail (double precision).
TAIL_NUMERATOR = (
    0.0352624965998911, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
TAIL_DENOMINATOR = (
    0.0883883476483184, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)


def _horner(x: Column, coefficients: tuple[float, ...]) -> Column:
    total = F.lit(coefficients[0])
    for c in coefficients[1:]:
        total = total * x + F.lit(c)
    return total


def normal_tail(z: Column) -> Column:
    """P(Z > z) of the standard normal, to about 1e-15; Spark has no error function."""
    a = F.abs(z)
    near = _horner(a, TAIL_NUMERATOR) / _horner(a, TAIL_DENOMINATOR)
    far = F.lit(1.0) / (a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))) / 2.506628274631
    upper = F.exp(-a * a / 2.0) * F.when(a < 7.07106781186547, near).otherwise(far)
    return F.when(z >= 0, upper).otherwise(1.0 - upper)


def two_sided(z: Column) -> Column:
    return F.least(F.lit(1.0), 2.0 * normal_tail(F.abs(z)))


def ratio(top: Column, bottom: Column) -> Column:
    """Division that answers 0 for an empty denominator."""
    return F.when(bottom > 0, top / bottom).otherwise(0.0)


def entropy_term(share: Column, guard: float) -> Column:
    """One summand of a Shannon entropy in bits, with the guard inside the logarithm."""
    return -share * F.log2(share + F.lit(guard))


def kolmogorov_tail(lam: Column, terms: int = 100) -> Column:
    """Asymptotic two-sided Kolmogorov p-value."""
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)),
        F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2.0 * k * k * lam * lam),
    )
    return F.when(lam < 0.2, 1.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), series)))


def _gamma_step(a: Column, shift: int = 24) -> Column:
    """Gamma(a + 1/2) / Gamma(a): the asymptotic series at ``a + shift``, brought back by the recurrence."""
    far = a + float(shift)
    y = 1.0 / far
    series = 1.0 - y / 8 + y * y / 128 + 5 * y * y * y / 1024 - 21 * y * y * y * y / 32768
    back = F.aggregate(F.sequence(F.lit(0), F.lit(shift - 1)), F.lit(1.0), lambda acc, i: acc * (a + i) / (a + i + 0.5))
    return F.sqrt(far) * series * back


def _beta_fraction(a: Column, b: Column, x: Column, steps: Column) -> Column:
    """Continued fraction of the incomplete beta function, two terms a step, evaluated forwards (Lentz)."""
    tiny = 1e-300
    safe = lambda v: F.when(F.abs(v) < tiny, F.lit(tiny)).otherwise(v)
    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))

    def term(s: Column, k: Column) -> Column:
        # odd k: the terms below the line that are negative; even k: the positive ones
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2.0 * m - 1.0) * (a + 2.0 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2.0 * m) * (a + 2.0 * m + 1.0))
        top = F.when(k % 2 == 0, even).otherwise(odd)
        d = 1.0 / safe(1.0 + top * s["d"])
        c = safe(1.0 + top / s["c"])
        return state(c, d, s["h"] * c * d)

    return F.aggregate(F.sequence(F.lit(1), steps), state(F.lit(1.0), F.lit(0.0), F.lit(1.0)), term, lambda s: 1.0 / s["h"])


def student_two_sided(t: Column, df: Column) -> Column:
    """P(|T| > |t|) of Student's t with ``df`` (real, above 0) degrees of freedom, as a regularised incomplete beta.

    The number of terms grows with the root of ``df``, as the fraction's convergence asks.  Null without ``t`` or
    ``df``; an infinite ``t`` gives 0.
    """
    a, b = df / 2.0, F.lit(0.5)
    share = t * t / df
    x, rest = 1.0 / (1.0 + share), share / (1.0 + share)
    front = F.exp(-a * F.log1p(share)) * F.sqrt(rest) * _gamma_step(a) / 1.7724538509055160273
    steps = (F.lit(60) + F.ceil(4.0 * F.sqrt(df))).cast("int")
    low = x < (a + 1.0) / (a + 2.5)
    # one fraction, its arguments swapped where the complement converges faster
    part = _beta_fraction(F.when(low, a).otherwise(b), F.when(low, b).otherwise(a), F.when(low, x).otherwise(rest), steps)
    p = F.when(low, front * part / a).otherwise(1.0 - front * part / b)
    whole = F.when(F.abs(t) == float("inf"), 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), p)))
    return F.when(t.isNotNull() & df.isNotNull(), whole)
