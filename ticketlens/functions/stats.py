"""Aggregate-expression helpers shared by the operators.

Quantiles are the one statistic whose exact form is not partially
aggregatable in bounded memory: ``percentile`` keeps a value->count map per
group. ``exact=False`` switches every quantile of an operator to the
mergeable ``percentile_approx`` sketch, whose size is fixed by ``accuracy``
no matter how many rows a hot group holds.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

APPROX_ACCURACY = 100_000


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def quantile(col: str | Column, p: float, exact: bool = True) -> Column:
    """Linear-interpolated quantile (pandas / DuckDB quantile_cont)."""
    c = _c(col).cast("double")
    return F.percentile(c, F.lit(p)) if exact else F.percentile_approx(c, F.lit(p), APPROX_ACCURACY)


def quantiles(col: str | Column, probs: Sequence[float], exact: bool = True) -> Column:
    """array<double> of quantiles, one aggregate buffer for all probabilities."""
    c = _c(col).cast("double")
    arr = F.array(*[F.lit(float(p)) for p in probs])
    return F.percentile(c, arr) if exact else F.percentile_approx(c, arr, APPROX_ACCURACY)


def median(col: str | Column, exact: bool = True) -> Column:
    return quantile(col, 0.5, exact)


def safe_div(num: Column, den: Column, default: Column | float | None = None) -> Column:
    """num/den when den is non-zero, else ``default`` (null by default); never raises under ANSI."""
    d = F.lit(default) if not isinstance(default, Column) else default
    return F.when(den != 0, F.try_divide(num, den)).otherwise(d)


def pearson(x: str | Column, y: str | Column) -> Column:
    """Pearson correlation over rows where both sides are non-null (like pandas / DuckDB ``corr``).

    Spark's ``corr`` raises DIVIDE_BY_ZERO under ANSI mode when one side is
    constant; this form returns null instead.
    """
    xc, yc = _c(x).cast("double"), _c(y).cast("double")
    both = xc.isNotNull() & yc.isNotNull()
    xm, ym = F.when(both, xc), F.when(both, yc)
    return F.try_divide(F.covar_samp(xm, ym), F.stddev_samp(xm) * F.stddev_samp(ym))


def share_pct(cond: Column) -> Column:
    """Percentage of rows where ``cond`` holds (null counts as false)."""
    return F.avg(F.coalesce(cond, F.lit(False)).cast("double")) * F.lit(100.0)


def entropy_log2(values: Sequence[Column]) -> Column:
    """-sum p*log2(p) over the positive entries of a row of proportions."""
    arr = F.filter(F.array(*[v.cast("double") for v in values]), lambda x: x > 0)
    return -F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x * F.log2(x))


def is_finite(col: str | Column) -> Column:
    c = _c(col)
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(math.inf))


def finite_or_null(col: str | Column) -> Column:
    c = _c(col)
    return F.when(is_finite(c), c)


def group_quantiles(df, keys, col: str | Column, probs: Sequence[float], exact: bool = True,
                    out: str = "quantiles"):
    """Quantiles per group as a DataFrame (keys + array<double>).

    exact=True uses the distributed exact path (skew-safe, see
    ``functions.ranking.exact_quantiles``); exact=False the mergeable sketch.
    """
    from .ranking import exact_quantiles

    keys = list(keys)
    if exact:
        return exact_quantiles(df, keys, col, probs, out)
    return df.groupBy(*keys).agg(quantiles(col, probs, exact).alias(out))


def column_quantiles(df, cols: Sequence[str], probs: Sequence[float], exact: bool = True) -> dict:
    """Quantiles of many columns in one distributed pass: {column: [q...]} (None when a column is all null)."""
    cols = list(cols)
    if not cols:
        return {}
    long = df.select(*[F.col(f"`{c}`").cast("double").alias(c) for c in cols]).unpivot([], cols, "_column", "_value")
    rows = group_quantiles(long, ["_column"], "_value", probs, exact).collect()
    got = {r["_column"]: r["quantiles"] for r in rows}
    return {c: got.get(c) for c in cols}
