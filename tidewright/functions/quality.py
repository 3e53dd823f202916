"""Column expressions for grades, flags and uncertainties of measurements."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Grades from best to worst.
GRADES = ("A", "B", "C", "D", "X")


def banded(value: Column, limits: list[tuple[float, str]], rest: str | None) -> Column:
    """The label of the first limit that ``value`` lies below, else ``rest``; null for null."""
    found = F.lit(rest)
    for limit, label in reversed(limits):
        found = F.when(value < limit, label).otherwise(found)
    return F.when(value.isNotNull(), found)


def uncertainty_grade(expanded_ms: Column) -> Column:
    """A below 1 ms, B below 2, C below 3, else D."""
    return banded(expanded_ms, [(1.0, "A"), (2.0, "B"), (3.0, "C")], "D")


def measurement_grade(confidence: Column, uncertainty_ms: Column, snr_db: Column) -> Column:
    """A to D by confidence, uncertainty and signal-to-noise ratio together."""
    return (
        F.when((confidence > 0.8) & (uncertainty_ms < 2) & (snr_db > 15), "A")
        .when((confidence > 0.6) & (uncertainty_ms < 4) & (snr_db > 10), "B")
        .when((confidence > 0.4) & (uncertainty_ms < 8), "C")
        .otherwise("D")
    )


def quality_flag(grade: Column, confidence: Column, locked: Column) -> Column:
    """BAD without lock, below 0.5 confidence or for D; MARGINAL for C or below 0.7; else GOOD. MISSING without a grade."""
    return (
        F.when(grade.isNull(), "MISSING")
        .when(~F.coalesce(locked, F.lit(False)) | (F.coalesce(confidence, F.lit(0.0)) < 0.5) | (grade == "D"), "BAD")
        .when((grade == "C") | (confidence < 0.7), "MARGINAL")
        .otherwise("GOOD")
    )


def completeness_flag(n: Column, completeness: Column) -> Column:
    """GOOD from 40 observations and 0.8 completeness, MARGINAL from 20 and 0.5, else BAD."""
    return F.when((n >= 40) & (completeness >= 0.8), "GOOD").when((n >= 20) & (completeness >= 0.5), "MARGINAL").otherwise("BAD")


def grade_rank(grade: Column) -> Column:
    """0 for the best grade; unknown and null grades come last."""
    return F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, GRADES)), grade), F.lit(0)) - 1, F.lit(99)).cast("int")


def finite(value: Column) -> Column:
    """``value``, or null where it is NaN or infinite."""
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def root_sum_square(*parts: Column) -> Column:
    """Combined standard uncertainty of independent components; null components count as 0."""
    return F.sqrt(reduce(lambda a, b: a + b, [F.coalesce(p, F.lit(0.0)) * F.coalesce(p, F.lit(0.0)) for p in parts]))


def effective_dof(parts: list[tuple[Column, Column | None]]) -> Column:
    """Degrees of freedom of a combined uncertainty from (value, own degrees); None or non-positive degrees mean exactly known. Null stands for infinite."""
    total = reduce(lambda a, b: a + b, [v * v for v, _ in parts])
    known = [F.when((d > 0) & (d < float("inf")), v * v * v * v / d).otherwise(0.0) for v, d in parts if d is not None]
    return F.try_divide(total * total, F.nullif(reduce(lambda a, b: a + b, known, F.lit(0.0)), F.lit(0.0)))


def xray_class(flux: Column) -> Column:
    """Letter and one decimal of a long-wavelength flux, as in M2.5."""
    said = lambda letter, unit: F.concat(F.lit(letter), F.format_string("%.1f", flux / unit))
    out = said("A", 1e-8)
    for letter, unit in (("B", 1e-7), ("C", 1e-6), ("M", 1e-5), ("X", 1e-4)):
        out = F.when(flux >= unit, said(letter, unit)).otherwise(out)
    return out


def arrival_uncertainty_ms(snr_db: Column, duration_s: Column, bandwidth_hz: Column) -> Column:
    """The Cramer-Rao bound of a tone's time of arrival, kept between 0.01 and 50 ms; 10 ms where it is undefined."""
    spread = 2 * F.pi() * F.sqrt(2 * F.pow(F.lit(10.0), snr_db / 10) * bandwidth_hz * duration_s)
    return F.least(F.greatest(F.coalesce(F.try_divide(F.lit(1000.0), F.nullif(spread, F.lit(0.0))), F.lit(10.0)), F.lit(0.01)), F.lit(50.0))


def usable_frequency(frequency: Column, f_share: Column) -> Column:
    """Highest usable frequency by the share of F-layer modes: null under 0.3, then frequency times 1, 1.1 (over 0.5) or 1.2 (over 0.7)."""
    return F.when(f_share < 0.3, None).when(f_share > 0.7, frequency * 1.2).when(f_share > 0.5, frequency * 1.1).otherwise(frequency)


def transition(innovation: Column, sigma: Column) -> Column:
    """MODE_CHANGE beyond 5 sigma, POSSIBLE_CHANGE beyond 3, else STABLE."""
    ratio = F.coalesce(F.try_divide(F.abs(innovation), F.when(sigma > 0, sigma)), F.lit(0.0))
    return F.when(ratio > 5, "MODE_CHANGE").when(ratio > 3, "POSSIBLE_CHANGE").otherwise("STABLE")
