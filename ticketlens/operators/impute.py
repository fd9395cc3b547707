"""Imputation.

Fill values are aggregates: exact medians via ``percentile`` (pandas
semantics: the even-count median interpolates), modes via ``mode(c, true)``
(most frequent, smallest on ties). Whole-table fill values are one
aggregation returning one row; group fill values are a grouped aggregation
joined back on the group keys (broadcast only when the estimate is bounded).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derive import log_target
from ..functions.ranking import null_safe_join
from ..sources.tables import small_side
from .columns import column_stats, numeric_columns, q, string_columns


def typed_lit(value, dtype: T.DataType) -> Column:
    """A collected value turned back into a literal of the column's type.

    Wall-clock timestamps go through their text form, so the literal does not
    shift with the session or the Python process time zone.
    """
    if isinstance(dtype, T.TimestampNTZType) and hasattr(value, "isoformat"):
        return F.lit(value.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    return F.lit(value).cast(dtype)


def _median_values(df: DataFrame, cols: Sequence[str], exact: bool = True) -> dict:
    from ..functions.stats import column_quantiles

    return {c: (v[0] if v else None) for c, v in column_quantiles(df, cols, [0.5], exact).items()}


def _mode_values(df: DataFrame, cols: Sequence[str]) -> dict:
    return column_stats(df, {c: F.mode(q(c), True) for c in cols}) if cols else {}


def impute(df: DataFrame, numeric: str = "median", categorical: str = "constant", fill: str = "Missing",
           exact: bool = True) -> DataFrame:
    """Numeric nulls -> median (or mean), string nulls -> a constant (or the mode)."""
    num = [c for c in numeric_columns(df)]
    txt = string_columns(df)
    nulls = column_stats(df, {c: F.count_if(q(c).isNull()) for c in num + txt})
    num = [c for c in num if nulls[c]]
    txt = [c for c in txt if nulls[c]]
    if numeric == "median":
        nv = _median_values(df, num, exact)
    else:
        nv = column_stats(df, {c: F.avg(q(c)) for c in num})
    tv = _mode_values(df, txt) if categorical == "mode" else {c: fill for c in txt}
    # numeric columns with gaps become double (a median may fall between two integers)
    exprs = {c: F.coalesce(q(c).cast("double"), F.lit(v).cast("double")) for c, v in nv.items() if v is not None}
    exprs.update({c: F.coalesce(q(c), F.lit(v)) for c, v in tv.items() if v is not None})
    return df.withColumns(exprs) if exprs else df


def impute_mode(df: DataFrame, cols: Sequence[str], default: str = "Unknown") -> DataFrame:
    """Fill with the most frequent value (smallest on ties); 'Unknown' when the column is all null."""
    mv = _mode_values(df, cols)
    return df.withColumns({c: F.coalesce(q(c), F.lit(mv.get(c) if mv.get(c) is not None else default)
                                         .cast(df.schema[c].dataType)) for c in cols})


def impute_group_median(df: DataFrame, col: str, keys: Sequence[str], exact: bool = True) -> DataFrame:
    """Group median, then the overall median of the partly filled column for what is left."""
    keys = list(keys)
    from ..functions.stats import group_quantiles

    gm = group_quantiles(df, keys, col, [0.5], exact, "_gq").select(*keys, F.col("_gq")[0].alias("_gm"))
    filled = (null_safe_join(df, gm, keys, "left")
              .withColumn(col, F.coalesce(F.col(col), F.col("_gm"))).drop("_gm"))
    overall = _median_values(filled, [col], exact).get(col)
    return filled.withColumn(col, F.coalesce(F.col(col), F.lit(overall).cast(df.schema[col].dataType))) \
        if overall is not None else filled


def impute_group_mode(df: DataFrame, col: str, keys: Sequence[str], default: str = "Unknown") -> DataFrame:
    """I4: group mode, then the overall mode of the partly filled column, then ``default``."""
    keys = list(keys)
    gm = df.groupBy(*keys).agg(F.mode(col, True).alias("_gm"))
    filled = (null_safe_join(df, gm, keys, "left")
              .withColumn(col, F.coalesce(F.col(col), F.col("_gm"))).drop("_gm"))
    return impute_mode(filled, [col], default)


def impute_new_category(df: DataFrame, cols: Sequence[str], value: str = "Unknown") -> DataFrame:
    """Null -> a new category."""
    return df.na.fill(value, subset=list(cols))


MISSING_BANDS = (5.0, 15.0)


def imputation_plan(profile: DataFrame) -> DataFrame:
    """Strategy per column from (kind, missing %, action) of ``column_profile``.

    <5 %: median / mode / drop_rows; 5-15 %: median_by_group / mode_by_group /
    drop_rows; above: median_by_group, new_category (categorical, boolean),
    mode_by_group (high cardinality), drop_rows (dates, text); 'drop' action -> drop_column.
    """
    k, m = F.col("kind"), F.col("missing_pct")
    cat = k.isin("categorical", "high_cardinality", "boolean")
    low = (F.when(k == "numeric", "median").when(cat, "mode").otherwise("drop_rows"))
    mid = (F.when(k == "numeric", "median_by_group").when(cat, "mode_by_group").otherwise("drop_rows"))
    high = (F.when(k == "numeric", "median_by_group").when(k.isin("categorical", "boolean"), "new_category")
            .when(k == "high_cardinality", "mode_by_group").otherwise("drop_rows"))
    strat = (F.when(F.col("action") == "drop", "drop_column").when(m < MISSING_BANDS[0], low)
             .when(m < MISSING_BANDS[1], mid).otherwise(high))
    return profile.withColumn("imputation_strategy", strat)


def apply_plan(df: DataFrame, plan: DataFrame, group_keys: Sequence[str], required: Sequence[str] = (),
               exact: bool = True) -> DataFrame:
    """Execute an imputation plan, then drop rows still null in the required columns.

    The plan has one row per column (small); it is read on the driver and turned
    into one sequence of selects/joins over the data.
    """
    steps = {r["column"]: r["imputation_strategy"] for r in plan.select("column", "imputation_strategy").collect()}
    out = df
    drop_cols = [c for c, s in steps.items() if s == "drop_column" and c not in group_keys and c not in required]
    out = out.drop(*drop_cols)
    med = [c for c, s in steps.items() if s == "median" and c in out.columns]
    mod = [c for c, s in steps.items() if s == "mode" and c in out.columns]
    if med:
        mv = _median_values(out, med, exact)
        out = out.withColumns({c: F.coalesce(q(c), F.lit(mv[c]).cast(out.schema[c].dataType))
                               for c in med if mv.get(c) is not None})
    if mod:
        out = impute_mode(out, mod)
    gmed = [c for c, s in steps.items() if s == "median_by_group" and c in out.columns and c not in group_keys
            and isinstance(out.schema[c].dataType, T.NumericType)]
    gmod = [c for c, s in steps.items() if s == "mode_by_group" and c in out.columns and c not in group_keys]
    out = impute_by_group(out, gmed, gmod, list(group_keys), exact)
    newcat = [c for c, s in steps.items() if s == "new_category" and c in out.columns
              and isinstance(out.schema[c].dataType, T.StringType)]
    if newcat:
        out = impute_new_category(out, newcat)
    drop_rows = [c for c, s in steps.items() if s == "drop_rows" and c in out.columns]
    need = [c for c in list(required) + drop_rows if c in out.columns]
    return out.na.drop("any", subset=need) if need else out


def impute_by_group(df: DataFrame, median_cols: Sequence[str], mode_cols: Sequence[str], keys: Sequence[str],
                    exact: bool = True, default: str = "Unknown") -> DataFrame:
    """I3 + I4 for many columns at once: every group median / mode in ONE grouped aggregation and one
    join, then the overall median / mode of the partly filled columns for what is left.

    The medians of all columns are one pass over (group, column, value); a null
    group is a group.
    """
    from ..functions.stats import group_quantiles
    from ..session import reuse

    keys = list(keys)
    if not median_cols and not mode_cols:
        return df
    filled = df
    if median_cols:
        long = df.select(*keys, *[q(c).cast("double").alias(f"_gmed_{i}") for i, c in enumerate(median_cols)]).unpivot(
            keys, [f"_gmed_{i}" for i in range(len(median_cols))], "_column", "_value")
        medians = group_quantiles(long, [*keys, "_column"], "_value", [0.5], exact, "_gq").groupBy(*keys).agg(
            *[F.max(F.when(F.col("_column") == f"_gmed_{i}", F.col("_gq")[0])).alias(f"_gmed_{i}") for i in range(len(median_cols))])
        filled = null_safe_join(filled, medians, keys, "left")
    if mode_cols:
        modes = df.groupBy(*keys).agg(*[F.mode(q(c), True).alias(f"_gmod_{i}") for i, c in enumerate(mode_cols)])
        filled = null_safe_join(filled, modes, keys, "left")
    exprs = {c: F.coalesce(q(c).cast("double"), F.col(f"_gmed_{i}")) for i, c in enumerate(median_cols)}
    exprs.update({c: F.coalesce(q(c), F.col(f"_gmod_{i}")) for i, c in enumerate(mode_cols)})
    filled = reuse(filled.withColumns(exprs).drop(*[f"_gmed_{i}" for i in range(len(median_cols))],
                                                  *[f"_gmod_{i}" for i in range(len(mode_cols))]))
    med = _median_values(filled, median_cols, exact)
    mod = _mode_values(filled, mode_cols)
    rest = {c: F.coalesce(q(c), F.lit(v).cast("double")) for c, v in med.items() if v is not None}
    rest.update({c: F.coalesce(q(c), F.lit(mod.get(c) if mod.get(c) is not None else default)
                                .cast(filled.schema[c].dataType)) for c in mode_cols})
    return filled.withColumns(rest) if rest else filled


def fill_all(df: DataFrame, numeric=0, text: str = "Unknown") -> DataFrame:
    """I8: numeric nulls -> 0, strings -> 'Unknown', columns named *date* -> that column's minimum."""
    dates = [c for c in df.columns if "date" in c.lower()]
    mins = column_stats(df, {c: F.min(q(c)) for c in dates}) if dates else {}
    out = df.withColumns({c: F.coalesce(q(c), typed_lit(v, df.schema[c].dataType))
                          for c, v in mins.items() if v is not None}) if mins else df
    num = [c for c in numeric_columns(out) if c not in dates]
    txt = [c for c in string_columns(out) if c not in dates]
    return out.na.fill(numeric, subset=num).na.fill(text, subset=txt)


def iqr_bounds(df: DataFrame, cols: Sequence[str], mult: float = 1.5, exact: bool = True) -> DataFrame:
    """Per column q1, median, q3 and the IQR fences (one distributed quantile pass, long form)."""
    from ..functions.stats import group_quantiles

    long = df.select(*[q(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "column", "_value")
    out = group_quantiles(long, ["column"], "_value", [0.25, 0.5, 0.75], exact, "_q")
    iqr = F.col("_q")[2] - F.col("_q")[0]
    return out.select("column", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"),
                      (F.col("_q")[0] - mult * iqr).alias("lower"), (F.col("_q")[2] + mult * iqr).alias("upper"))


def iqr_cap(df: DataFrame, cols: Sequence[str] | None = None, mult: float = 1.5, exact: bool = True) -> DataFrame:
    """Fences from q1/q3 before filling; null -> median; values clipped to the fences."""
    cols = numeric_columns(df) if cols is None else list(cols)
    b = {r["column"]: r for r in iqr_bounds(df, cols, mult, exact).collect()}
    exprs = {}
    for c in cols:
        r = b.get(c)
        if r is None or r["median"] is None:
            continue
        v = F.coalesce(q(c).cast("double"), F.lit(r["median"]))
        exprs[c] = F.least(F.greatest(v, F.lit(r["lower"])), F.lit(r["upper"]))
    return df.withColumns(exprs) if exprs else df


def capped_counts(df: DataFrame, cols: Sequence[str], mult: float = 1.5, exact: bool = True) -> DataFrame:
    """I9 report: per column the number of values below / above the fences and nulls filled."""
    bounds = {r["column"]: r for r in iqr_bounds(df, cols, mult, exact).collect()}      # a row per column
    rows = []
    for c in cols:
        v, b = q(c).cast("double"), bounds.get(c)
        low, high = (F.lit(b[k] if b else None).cast("double") for k in ("lower", "upper"))
        rows.append(F.struct(F.lit(c).alias("column"), F.count_if(v < low).alias("below"), F.count_if(v > high).alias("above"),
                             F.count_if(v.isNull()).alias("filled")))
    # one pass with partial counts: joined to the bounds by column, each column's values would be one task's
    wide = df.agg(F.count(F.lit(1)).alias("_rows"), F.array(*rows).alias("_counts"))
    return wide.where("_rows > 0").select(F.inline("_counts"))


def impute_unresolved_hours(df: DataFrame, hours: str, keys: Sequence[str], age_days: str,
                            resolved: Column | None = None, default_hours: float = 24.0,
                            log_col: str | None = None, exact: bool = True) -> DataFrame:
    """For unresolved rows: median of resolved rows of the same group (else the global median,
    else ``default_hours``) x (1 + 0.1 * clip(age_days / 30, 0, 10)); log column recomputed."""
    keys = list(keys)
    res = F.col(hours).isNotNull() if resolved is None else resolved
    from ..functions.stats import column_quantiles, group_quantiles

    resolved_rows = df.where(res)
    gm = group_quantiles(resolved_rows, keys, hours, [0.5], exact, "_gq").select(*keys, F.col("_gq")[0].alias("_gm"))
    glob = (column_quantiles(resolved_rows, [hours], [0.5], exact).get(hours) or [None])[0]
    factor = 1.0 + 0.1 * F.least(F.greatest(F.col(age_days) / 30.0, F.lit(0.0)), F.lit(10.0))
    base = F.coalesce(F.col("_gm"), F.lit(glob if glob is not None else default_hours))
    out = (null_safe_join(df, gm, keys, "left")
           .withColumn(hours, F.when(res, F.col(hours)).otherwise(base * factor)).drop("_gm"))
    return out.withColumn(log_col, log_target(hours)) if log_col else out
