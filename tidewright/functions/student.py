"""Student's t as column expressions, for any real number of degrees of freedom.

Give each its own column (``withColumn``) and use that: Spark evaluates the same
fold over an array wrongly where one projection has it twice.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The normal quantile of 0.975.
Z_975 = 1.959963984540054


def log_gamma(x: Column) -> Column:
    """For positive x: Stirling's series eight above it, less the logarithms in between."""
    y = x + 8
    inverse = 1 / (y * y)
    series = (1 / 12 - inverse * (1 / 360 - inverse * (1 / 1260 - inverse / 1680))) / y
    product = F.lit(1.0)
    for i in range(8):
        product = product * (x + i)
    return (y - 0.5) * F.log(y) - y + 0.9189385332046727 + series - F.log(product)


def _fraction(a: Column, b: Column, x: Column, steps: int = 200) -> Column:
    """The continued fraction of the incomplete beta function from its start on, by running numerators and denominators of its convergents, scaled so that the denominator is 1."""
    one, zero = F.lit(1.0), F.lit(0.0)
    start = F.struct(one.alias("p0"), zero.alias("q0"), one.alias("p1"), one.alias("q1"))

    def term(n: Column) -> Column:
        m = F.floor(n / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(n % 2 == 0, even).otherwise(odd)

    def step(s: Column, n: Column) -> Column:
        d = term(n)
        p, q = s["p1"] + d * s["p0"], s["q1"] + d * s["q0"]
        return F.struct((s["p1"] / q).alias("p0"), (s["q1"] / q).alias("q0"), (p / q).alias("p1"), one.alias("q1"))

    done = F.aggregate(F.sequence(F.lit(1), F.lit(steps)), start, step)
    return done["q1"] / done["p1"]


def two_sided_p(t: Column, dof: Column) -> Column:
    """How likely a |t| or more is by chance; null for ``dof`` of 0 or less."""
    a, b = dof / 2, F.lit(0.5)
    x = dof / (dof + t * t)
    front = F.exp(log_gamma(a + 0.5) - log_gamma(a) - 0.5723649429247001 + a * F.log(x) + 0.5 * F.log(1 - x))
    near = front * _fraction(a, b, x) / a
    far = 1 - front * _fraction(b, a, 1 - x) / b
    return F.when(dof > 0, F.when(t == 0, 1.0).when(x < (a + 1) / (a + 2.5), near).otherwise(far))


def correlation_p(r: Column, effective: Column, tests: Column | int = 1) -> Column:
    """Two-sided p of a correlation from ``effective`` independent samples, times the number of tests and 1 at most; 1 for two samples or fewer."""
    size = F.least(F.abs(r), F.lit(1.0 - 1e-12))
    t = size * F.sqrt((effective - 2) / (1 - size * size))
    many = F.greatest(tests if isinstance(tests, Column) else F.lit(tests), F.lit(1))
    return F.when(r.isNotNull(), F.when(effective > 2, F.least(F.lit(1.0), two_sided_p(t, effective - 2) * many)).otherwise(1.0))


def coverage_95(dof: Column, rounds: int = 12) -> Column:
    """The multiple of sigma that covers 95 %: Newton steps from an expansion for many degrees of freedom; the normal one where ``dof`` is not positive or not finite.

    For less than one degree it is sought in its logarithm, as it is then very large.
    """
    z = Z_975
    start = z + (z**3 + z) / (4 * dof) + (5 * z**5 + 16 * z**3 + 3 * z) / (96 * dof * dof)
    log_density = log_gamma((dof + 1) / 2) - log_gamma(dof / 2) - 0.5 * F.log(dof * F.pi())

    def step(u: Column, _: Column) -> Column:
        t = F.exp(u)
        density = F.exp(log_density - (dof + 1) / 2 * F.log1p(t * t / dof))
        # In u = log t the tail falls by 2 t density; its logarithm is nearly straight far out.
        tail = two_sided_p(t, dof)
        return u + F.least(F.greatest(F.log(tail / 0.05) * tail / (2 * t * density), F.lit(-2.0)), F.lit(2.0))

    found = F.exp(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), F.log(start), step))
    return F.when((dof > 0) & (dof < 1e7), found).otherwise(F.lit(z))
