"""Windows over sessions and cross-sections, as column expressions that stay inside the JVM.

Ordered windows partition by ticker; cross-sectional ones by session. A NULL is a missing value
and never NaN.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

TICKER, SESSION = "ticker", "ix"


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def trailing(n: int, end: int = 0, keys: tuple[str, ...] = (TICKER,), order: str = SESSION) -> WindowSpec:
    """The n rows up to end rows from the current one (0: it is the last one, -1: the one before is)."""
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(end - n + 1, end)


def running(keys: tuple[str, ...] = (TICKER,), order: str = SESSION) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def across(*keys: str) -> WindowSpec:
    return Window.partitionBy(*(keys or (SESSION,)))


def rolling(fn, x: Column | str, n: int, least: int = 1, end: int = 0, keys: tuple[str, ...] = (TICKER,), order: str = SESSION) -> Column:  # noqa: ANN001
    """fn over the trailing n rows; NULL below `least` values."""
    w = trailing(n, end, keys, order)
    return F.when(F.count(col(x)).over(w) >= least, fn(col(x)).over(w))


def zscore(x: Column | str, *keys: str) -> Column:
    """Cross-sectional z-score with the sample deviation; 0 where that is 0."""
    w = across(*keys)
    sd = F.stddev_samp(col(x)).over(w)
    return F.when(col(x).isNotNull(), F.when(sd > 0, (col(x) - F.avg(col(x)).over(w)) / sd).otherwise(F.lit(0.0)))


def average_rank(x: Column | str, *keys: str) -> Column:
    """Average rank of ties from 1; NULL for NULL. keys default to the session."""
    keys = keys or (SESSION,)
    order = Window.partitionBy(*keys).orderBy(col(x).asc_nulls_last())
    peers = Window.partitionBy(*keys, col(x))
    return F.when(col(x).isNotNull(), F.rank().over(order) + (F.count(F.lit(1)).over(peers) - 1) / 2)


def percent_rank(x: Column | str, *keys: str) -> Column:
    """Average rank scaled to [0, 1]; 0.5 for a single value."""
    n = F.count(col(x)).over(across(*(keys or (SESSION,))))
    return F.when(n > 1, (average_rank(x, *keys) - 1) / (n - 1)).when(col(x).isNotNull(), F.lit(0.5))


def winsor(x: Column | str, low: float, high: float, *keys: str) -> Column:
    """Clipped to the exact quantiles of the cross-section."""
    edges = F.percentile(col(x), F.array(F.lit(low), F.lit(high))).over(across(*keys))
    return F.when(col(x).isNotNull(), F.greatest(F.least(col(x), edges[1]), edges[0]))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """Within limits; NULL stays NULL."""
    out = col(x)
    if high is not None:
        out = F.least(out, F.lit(high))
    if low is not None:
        out = F.greatest(out, F.lit(low))
    return F.when(col(x).isNotNull(), out)


def decay(half_life: float, order: str = SESSION, keys: tuple[str, ...] = (TICKER,)) -> Column:
    """Exponential weights by row position, scaled by the partition's last row so that they can't overflow."""
    return F.pow(F.lit(2.0), (F.col(order) - F.max(order).over(Window.partitionBy(*keys))) / F.lit(float(half_life)))


def weighted(x: Column, w: Column, spec: WindowSpec) -> Column:
    """Weighted mean over a frame; rows with a NULL x have no weight. NULL where all weights are too small for a double (over 1000 half-lives back)."""
    return F.try_divide(F.sum(x * w).over(spec), F.sum(F.when(x.isNotNull(), w)).over(spec))


def ewm_mean(x: Column | str, half_life: float, spec: WindowSpec | None = None, order: str = SESSION) -> Column:
    """Exponentially weighted mean (weights by position, missing rows skipped but counted)."""
    return weighted(col(x), decay(half_life, order), spec or running(order=order))


def ewm_std(x: Column | str, half_life: float, spec: WindowSpec | None = None, order: str = SESSION) -> Column:
    """Exponentially weighted deviation with the bias correction (sum w)^2 / ((sum w)^2 - sum w^2)."""
    x, w, spec = col(x), decay(half_life, order), spec or running(order=order)
    own = F.when(x.isNotNull(), w)
    s1, s2 = F.sum(own).over(spec), F.sum(own * own).over(spec)
    mean = F.try_divide(F.sum(x * w).over(spec), s1)
    var = F.greatest(F.try_divide(F.sum(x * x * w).over(spec), s1) - mean * mean, F.lit(0.0))
    return F.when(F.count(x).over(spec) >= 2, F.sqrt(F.try_divide(var * s1 * s1, s1 * s1 - s2)))


def compounded(r: Column | str, spec: WindowSpec) -> Column:
    """Product of 1 + r less 1, missing r as 0."""
    return F.exp(F.sum(F.log1p(F.coalesce(col(r), F.lit(0.0)))).over(spec)) - 1


def forward(x: Column | str, h: int) -> Column:
    """Change of x over the next h sessions."""
    return F.lead(col(x), h).over(Window.partitionBy(TICKER).orderBy(SESSION)) / col(x) - 1


def last_value(x: Column | str, spec: WindowSpec | None = None) -> Column:
    """Forward fill."""
    return F.last(col(x), ignorenulls=True).over(spec or running())


def island(same: Column, keys: tuple[str, ...] = (TICKER,), order: str = SESSION) -> Column:
    """Number of the run a row is in: a new one begins wherever `same` is not true."""
    return F.sum(F.when(same, 0).otherwise(1)).over(running(keys, order))


def rolling_fit(y: Column | str, x: Column | str, spec: WindowSpec) -> tuple[Column, Column]:
    """Correlation and slope of y on x over a frame, from moments; NULL without variation."""
    x, y = col(x), col(y)
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    mx, my = F.avg(x).over(spec), F.avg(y).over(spec)
    cov, vx, vy = F.avg(x * y).over(spec) - mx * my, F.avg(x * x).over(spec) - mx * mx, F.avg(y * y).over(spec) - my * my
    return F.when((vx > 1e-14) & (vy > 1e-14), cov / F.sqrt(vx * vy)), F.when(vx > 1e-14, cov / vx)
