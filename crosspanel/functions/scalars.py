"""Scalar column expressions: null-safe arithmetic, growth, quarters, names and hashes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..operators.windows import col


def clean(x: Column | str) -> Column:
    """NULL for NaN and infinities: NULL is the only missing value."""
    x = col(x)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def safe_div(a: Column | str, b: Column | str) -> Column:
    """NULL where the divisor is 0 or missing."""
    return F.try_divide(col(a), F.nullif(col(b), F.lit(0.0)))


def strict_sum(*xs: Column | str) -> Column:
    """NULL if any part is missing."""
    out = F.lit(0.0)
    for x in xs:
        out = out + col(x)
    return out


def symmetric_growth(new: Column | str, old: Column | str) -> Column:
    """Ratio less 1 for two positive values; twice the difference over the sum of sizes where a sign is involved; within [-2, 2]."""
    a, b = col(new), col(old)
    size = F.abs(a) + F.abs(b)
    return F.when((a > 0) & (b > 0), F.least(a / b - 1, F.lit(2.0))).when(size > 0, 2 * (a - b) / size).when(a.isNotNull() & b.isNotNull(), F.lit(0.0))


def annualised(growth: Column | str, years: Column | float) -> Column:
    """Yearly growth; NULL for a loss of all or more."""
    g = col(growth) if not isinstance(growth, Column) else growth
    n = F.lit(float(years)) if not isinstance(years, Column) else years
    return F.when((1 + g > 0) & (n > 0), F.pow(1 + g, 1 / n) - 1)


def quarter_index(period: Column | str) -> Column:
    """'YYYYQn' as year * 4 + n - 1."""
    p = col(period)
    return (F.substring(p, 1, 4).cast("int") * 4 + F.substring(p, 6, 1).cast("int") - 1).cast("int")


def quarter_name(index: Column | str) -> Column:
    i = col(index)
    return F.concat(F.floor(i / 4).cast("string"), F.lit("Q"), (F.pmod(i, F.lit(4)) + 1).cast("string"))


def normal_ticker(x: Column | str) -> Column:
    """Upper case, trimmed, without an exchange suffix."""
    return F.element_at(F.split(F.upper(F.trim(col(x))), " "), 1)


def differs(a: Column | str, b: Column | str, share: float) -> Column:
    """Whether two values differ by more than a share of the larger; a missing one differs from any."""
    x, y = col(a), col(b)
    return F.when(x.isNull() & y.isNull(), False).when(x.isNull() | y.isNull(), True).otherwise(F.abs(x - y) > share * F.greatest(F.abs(x), F.abs(y)))


def fingerprint(*xs: Column | str) -> Column:
    """Sixteen hexadecimal digits of the values' hash."""
    return F.substring(F.md5(F.concat_ws("|", *(F.coalesce(col(x).cast("string"), F.lit("~")) for x in xs)).cast("binary")), 1, 16)


def business_days(start: str, end: str, step: int = 1) -> Column:
    """Array of every step-th weekday between two dates."""
    days = F.filter(F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date")), lambda d: ~F.dayofweek(d).isin(1, 7))
    return F.filter(F.transform(days, lambda d, i: F.when(i % step == 0, d)), lambda d: d.isNotNull())


def midpoint_growth(new: Column | str, old: Column | str) -> Column:
    """Change over the mean size of both values, at least -1; NULL if one is missing or both are 0."""
    a, b = col(new), col(old)
    size = (F.abs(a) + F.abs(b)) / 2
    return F.when(size > 0, F.greatest((a - b) / size, F.lit(-1.0)))


def yearly_rate(growth: Column, years: int) -> Column:
    """Growth over some years as a yearly rate: geometric for gains, an even share for losses."""
    return F.when(growth > 0, F.pow(1 + growth, F.lit(1.0 / years)) - 1).otherwise(growth / years)


def median_of(*xs: Column) -> Column:
    """Median of a row's values that are there; NULL if there are none."""
    kept = F.array_sort(F.filter(F.array(*xs), lambda x: x.isNotNull()))
    n = F.size(kept)
    middle = lambda i: F.try_element_at(kept, i.cast("int"))
    return F.when(n > 0, (middle(F.floor((n + 1) / 2)) + middle(F.floor(n / 2) + 1)) / 2)


def blended_metric(value: Column, reference: Column, income: Column, reference_income: Column, adjustment: Column, gross_up: float = 0.75, least: float = 1000.0) -> Column:
    """A pretax metric between as reported, adjusted, and adjusted before tax.

    Each candidate weighs exp of the others' distance from the reference, in units of the adjusted
    income's distance from its own (`least` at least). Weights beyond 200 are shifted to begin at 0
    and cut at 100.
    """
    candidates = [value, value + adjustment, value + adjustment / gross_up]
    unit = F.greatest(F.abs(income + adjustment - reference_income), F.lit(least))
    far = [F.abs(c - reference) for c in candidates]
    weights = [(far[(i + 1) % 3] + far[(i + 2) % 3]) / unit for i in range(3)]
    low, high = F.least(*weights), F.greatest(*weights)
    powers = [F.exp(F.when(high > 200, F.least(w - low, F.lit(100.0))).otherwise(w)) for w in weights]
    return sum((c * p for c, p in zip(candidates[1:], powers[1:], strict=True)), candidates[0] * powers[0]) / (powers[0] + powers[1] + powers[2])
