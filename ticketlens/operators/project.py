"""Project roll-ups: one feature row per project.

Every statistic that can be computed in one pass is an aggregate expression,
so ``project_features`` folds A6-A8, A10-A12 and A14 into a single
``groupBy(project)``; Spark aggregates partially on the map side, so a hot
project costs one merged buffer, not one task holding its rows. A9 (per-month
counts) and A13 (share above the project's own p75) are two-level and are
computed as two aggregations joined on the project key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import calendar_parts, resolution_time_days, resolution_time_hours, seconds_between
from ..functions.names import distinct_values, space_safe
from ..functions.ranking import null_safe_join
from ..functions.stats import entropy_log2, group_quantiles, safe_div, share_pct
from ..session import reuse
from ..sources.tables import small_side

Keys = str | Sequence[str]


def _keys(key: Keys) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def with_issue_times(df: DataFrame, created: str = "created", resolved: str = "resolutiondate") -> DataFrame:
    """Adds resolution_time_hours (F11), is_resolved (F12) and F15 parts when missing."""
    add = {}
    if "resolution_time_hours" not in df.columns:
        add["resolution_time_hours"] = resolution_time_hours(created, resolved)
    if "resolution_time_days" not in df.columns:
        add["resolution_time_days"] = resolution_time_days(created, resolved)
    if "is_resolved" not in df.columns:
        add["is_resolved"] = F.col(resolved).isNotNull().cast("int")
    out = df.withColumns(add) if add else df
    if "created_day_of_week" not in out.columns:
        out = calendar_parts(out, created, resolved)
    return out


# --------------------------------------------------------------------------
# A6 project span
# --------------------------------------------------------------------------

def _span_aggs(created: str, updated: str | None, resolved: str, name_cols: Sequence[str]) -> list[Column]:
    aggs = [F.min(c).alias(c) for c in name_cols]  # "first" without an order is arbitrary; min is stable
    aggs += [F.count(F.lit(1)).alias("total_issues"),
             F.min(created).alias("project_start_date"),
             F.max(resolved).alias("project_latest_resolved_date")]
    if updated:
        aggs.append(F.max(updated).alias("project_latest_update_date"))
    return aggs


def _span_post(updated: str | None) -> dict[str, Column]:
    end = (F.greatest("project_latest_resolved_date", "project_latest_update_date") if updated
           else F.col("project_latest_resolved_date"))
    return {"project_duration_days":
            F.floor(seconds_between("project_start_date", end) / F.lit(86400.0)).cast("long")}


def project_span(df: DataFrame, key: Keys = "project_id", created: str = "created",
                 updated: str | None = "updated", resolved: str = "resolutiondate",
                 name_cols: Sequence[str] = ("project_name",)) -> DataFrame:
    """Issue count, first/last dates and floor-days duration per project."""
    out = df.groupBy(*_keys(key)).agg(*_span_aggs(created, updated, resolved, name_cols))
    return out.withColumns(_span_post(updated))


# --------------------------------------------------------------------------
# A7 resolution statistics (resolved issues only)
# --------------------------------------------------------------------------

def _resolution_aggs(hours: str, exact: bool) -> list[Column]:
    h = F.col(hours)
    n = F.count(h)
    return [
        F.avg(h).alias("avg_resolution_hours"),
        F.min(h).alias("min_resolution_hours"),
        F.max(h).alias("max_resolution_hours"),
        F.stddev_samp(h).alias("resolution_hours_std"),
        F.sum(h).alias("total_resolution_hours"),
        F.when(n > 2, F.skewness(h)).alias("resolution_time_skewness"),
        F.when(n > 2, F.kurtosis(h)).alias("resolution_time_kurtosis"),
        F.avg(F.when(h.isNotNull(), (h <= 24).cast("double"))).alias("_w24"),
        F.avg(F.when(h.isNotNull(), (h <= 168).cast("double"))).alias("_w168"),
        F.avg(F.when(h.isNotNull(), (h <= 720).cast("double"))).alias("_w720"),
    ]


def _resolution_post() -> dict[str, Column]:
    return {
        "median_resolution_hours": F.col("_rq")[0],
        "resolution_time_p25": F.col("_rq")[1],
        "resolution_time_p75": F.col("_rq")[2],
        "resolution_time_p90": F.col("_rq")[3],
        "resolution_time_iqr": F.col("_rq")[2] - F.col("_rq")[1],
        "pct_resolved_within_24h": F.col("_w24") * 100.0,
        "pct_resolved_within_week": F.col("_w168") * 100.0,
        "pct_resolved_within_month": F.col("_w720") * 100.0,
    }


_RESOLUTION_TMP = ["_rq", "_w24", "_w168", "_w720"]
RESOLUTION_PROBS = [0.5, 0.25, 0.75, 0.9]


def _rq_agg(exact: bool) -> Column:
    from ..functions.stats import quantiles

    return quantiles("resolution_time_hours", RESOLUTION_PROBS, exact).alias("_rq")


def _with_resolution_quantiles(out: DataFrame, d: DataFrame, keys: list[str], exact: bool,
                               in_agg: bool = False) -> DataFrame:
    """Join the per-project resolution quantiles as ``_rq`` unless they were computed in the main pass."""
    if in_agg:
        return out
    rq = group_quantiles(d, keys, "resolution_time_hours", RESOLUTION_PROBS, exact, "_rq")
    return null_safe_join(out, rq, keys, "left")


def resolution_stats(df: DataFrame, key: Keys = "project_id", created: str = "created",
                     resolved: str = "resolutiondate", exact: bool = True) -> DataFrame:
    """mean/median/min/max/std/sum, biased skew+kurtosis (n>2), p25/p75/p90/IQR, % within 24h/week/month."""
    keys = _keys(key)
    d = reuse(with_issue_times(df, created, resolved).select(*keys, "resolution_time_hours"))
    in_agg = not exact
    extra = [_rq_agg(exact)] if in_agg else []
    out = d.groupBy(*keys).agg(*_resolution_aggs("resolution_time_hours", exact), *extra)
    out = _with_resolution_quantiles(out, d, keys, exact, in_agg)
    return out.withColumns(_resolution_post()).drop(*_RESOLUTION_TMP)


# --------------------------------------------------------------------------
# A8 weekend share
# --------------------------------------------------------------------------

def _weekend_aggs(resolved: str) -> list[Column]:
    res = F.col(resolved).isNotNull()
    return [
        share_pct(F.col("created_day_of_week") >= 5).alias("pct_issues_created_on_weekend"),
        F.sum((res & (F.col("resolved_day_of_week") >= 5)).cast("long")).alias("_res_we"),
        F.sum(res.cast("long")).alias("_res_n"),
    ]


def _weekend_post() -> dict[str, Column]:
    return {"pct_issues_resolved_on_weekend":
            F.when(F.col("_res_n") > 0, F.col("_res_we") / F.col("_res_n") * 100.0)}


def weekend_share(df: DataFrame, key: Keys = "project_id", created: str = "created",
                  resolved: str = "resolutiondate") -> DataFrame:
    """% created on Sat/Sun over all issues; % of resolved issues resolved on Sat/Sun."""
    d = with_issue_times(df, created, resolved)
    out = d.groupBy(*_keys(key)).agg(*_weekend_aggs(resolved))
    return out.withColumns(_weekend_post()).drop("_res_we", "_res_n")


# --------------------------------------------------------------------------
# A9 monthly activity (two-level aggregation)
# --------------------------------------------------------------------------

def monthly_activity(df: DataFrame, key: Keys = "project_id", created: str = "created") -> DataFrame:
    """Per-(year, month) counts -> max, mean, active months, volatility (std/mean, >1 month)."""
    keys = _keys(key)
    months = (df.where(F.col(created).isNotNull())
              .groupBy(*keys, F.year(created).alias("_y"), F.month(created).alias("_m"))
              .agg(F.count(F.lit(1)).alias("_n")))
    out = months.groupBy(*keys).agg(
        F.max("_n").alias("max_issues_per_month"),
        F.avg("_n").alias("avg_issues_per_month"),
        F.count(F.lit(1)).alias("months_with_activity"),
        F.stddev_samp("_n").alias("_sd"),
    )
    return out.withColumn("issue_creation_volatility",
                          F.when(F.col("months_with_activity") > 1,
                                 F.try_divide(F.col("_sd"), F.col("avg_issues_per_month")))).drop("_sd")


# --------------------------------------------------------------------------
# A10-A12 mixes (dynamic columns; the value list is fetched first)
# --------------------------------------------------------------------------

def _nz(c: Column) -> Column:
    """Count columns are null where the project has none (the project row lacks that value)."""
    return F.when(c > 0, c)


def _priority_aggs(priority: str, values: Sequence[str]) -> list[Column]:
    p = F.col(priority)
    aggs = [F.count(p).alias("_prio_n")]
    for v in values:
        aggs.append(_nz(F.count(F.when(p == v, 1))).alias(f"priority_{space_safe(v)}_count"))
    return aggs


def _priority_post(values: Sequence[str], compat: bool) -> dict[str, Column]:
    den = F.col("total_issues") if compat else F.col("_prio_n")
    return {f"priority_{space_safe(v)}_pct": F.try_divide(F.col(f"priority_{space_safe(v)}_count"), den) * 100.0
            for v in values}


def priority_mix(df: DataFrame, key: Keys = "project_id", priority: str = "priority_name",
                 values: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """A10: count and % per priority; % over issues with a priority (``compat``: over all issues)."""
    if values is None:
        df = reuse(df)
        values = distinct_values(df, priority)
    out = df.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias("total_issues"), *_priority_aggs(priority, values))
    return out.withColumns(_priority_post(values, compat)).drop("_prio_n", "total_issues")


def _type_aggs(issue_type: str, values: Sequence[str]) -> list[Column]:
    t = F.col(issue_type)
    return [_nz(F.count(F.when(t == v, 1))).alias(f"type_{space_safe(v)}_count") for v in values]


def _type_post(values: Sequence[str]) -> dict[str, Column]:
    return {f"type_{space_safe(v)}_pct": F.try_divide(F.col(f"type_{space_safe(v)}_count"), F.col("total_issues")) * 100.0
            for v in values}


def type_mix(df: DataFrame, key: Keys = "project_id", issue_type: str = "issue_type",
             values: Sequence[str] | None = None) -> DataFrame:
    """Count and % (over all issues) per issue type."""
    if values is None:
        df = reuse(df)
        values = distinct_values(df, issue_type)
    out = df.groupBy(*_keys(key)).agg(F.count(F.lit(1)).alias("total_issues"), *_type_aggs(issue_type, values))
    return out.withColumns(_type_post(values)).drop("total_issues")


def _matrix_aggs(priority: str, issue_type: str, resolved: str,
                 pvals: Sequence[str], tvals: Sequence[str]) -> list[Column]:
    aggs = []
    res = F.col(resolved).isNotNull()
    for p in pvals:
        for t in tvals:
            m = res & (F.col(priority) == p) & (F.col(issue_type) == t)
            prefix = f"priority_{space_safe(p)}_type_{space_safe(t)}"
            aggs.append(_nz(F.count(F.when(m, 1))).alias(f"{prefix}_count"))
            aggs.append(F.avg(F.when(m, F.col("resolution_time_hours"))).alias(f"{prefix}_avg_resolution_hours"))
    return aggs


def priority_type_matrix(df: DataFrame, key: Keys = "project_id", priority: str = "priority_name",
                         issue_type: str = "issue_type", created: str = "created",
                         resolved: str = "resolutiondate", pvals: Sequence[str] | None = None,
                         tvals: Sequence[str] | None = None) -> DataFrame:
    """Per (priority, type) with resolved issues: count and mean resolution hours."""
    d = reuse(with_issue_times(df, created, resolved))
    pvals = distinct_values(d, priority) if pvals is None else list(pvals)
    tvals = distinct_values(d, issue_type) if tvals is None else list(tvals)
    return d.groupBy(*_keys(key)).agg(*_matrix_aggs(priority, issue_type, resolved, pvals, tvals))


# --------------------------------------------------------------------------
# A13 dependency statistics (group-relative threshold: two aggregations)
# --------------------------------------------------------------------------

def dependency_stats(df: DataFrame, key: Keys = "project_id", inward: str = "inward_count",
                     outward: str = "outward_count", exact: bool = True) -> DataFrame:
    """Link means/totals, % issues with inward above the project's own p75, link density."""
    keys = _keys(key)
    df = reuse(df.select(*keys, inward, outward))
    thr = group_quantiles(df, keys, inward, [0.75], exact, "_q").select(*keys, F.col("_q")[0].alias("_p75"))
    d = null_safe_join(df, thr, keys)
    i, o = F.col(inward), F.col(outward)
    out = d.groupBy(*keys).agg(
        F.avg(i).alias("avg_inward_links"),
        F.avg(o).alias("avg_outward_links"),
        F.avg(i + o).alias("avg_total_links"),
        F.sum(i).alias("total_inward_links"),
        F.sum(o).alias("total_outward_links"),
        share_pct(i > F.col("_p75")).alias("pct_issues_with_high_dependencies"),
        F.count(F.lit(1)).alias("_n"),
    )
    out = out.withColumn("total_links", F.col("total_inward_links") + F.col("total_outward_links"))
    return out.withColumn("link_density", safe_div(F.col("total_links"), F.col("_n"), 0.0)).drop("_n")


# --------------------------------------------------------------------------
# A14 resolution efficiency
# --------------------------------------------------------------------------

def _efficiency_aggs(issue_type: str | None, tvals: Sequence[str]) -> list[Column]:
    aggs = [F.sum("is_resolved").alias("num_resolved_issues")]
    for t in tvals:
        aggs.append((F.avg(F.when(F.col(issue_type) == t, F.col("is_resolved").cast("double"))) * 100.0)
                    .alias(f"type_{space_safe(t)}_resolution_rate"))
    return aggs


def _efficiency_post() -> dict[str, Column]:
    return {
        "pct_resolved_issues": F.coalesce(
            safe_div(F.col("num_resolved_issues") * 100.0, F.col("total_issues")), F.lit(0.0)),
        "resolution_rate_per_day": F.coalesce(
            F.when(F.col("project_duration_days") > 0,
                   F.col("num_resolved_issues") / F.col("project_duration_days")), F.lit(0.0)),
    }


def resolution_efficiency(df: DataFrame, key: Keys = "project_id", created: str = "created",
                          updated: str | None = "updated", resolved: str = "resolutiondate",
                          issue_type: str | None = "issue_type", tvals: Sequence[str] | None = None) -> DataFrame:
    """Resolved count and %, resolved per day of duration, per-type resolved %."""
    d = with_issue_times(df, created, resolved)
    if issue_type and tvals is None:
        d = reuse(d)
        tvals = distinct_values(d, issue_type)
    tvals = list(tvals or [])
    out = d.groupBy(*_keys(key)).agg(*_span_aggs(created, updated, resolved, []),
                                     *_efficiency_aggs(issue_type, tvals))
    out = out.withColumns(_span_post(updated)).withColumns(_efficiency_post())
    keep = _keys(key) + ["num_resolved_issues", "pct_resolved_issues", "resolution_rate_per_day"] + \
        [f"type_{space_safe(t)}_resolution_rate" for t in tvals]
    return out.select(*keep)


# --------------------------------------------------------------------------
# A15 row-wise derived features over column families
# --------------------------------------------------------------------------

# The default priority tokens and weights of the derived features.
HIGH_PRIORITY_TOKENS = ("critical", "blocker", "major")
LOW_PRIORITY_TOKENS = ("minor", "trivial")
PRIORITY_WEIGHTS = {"blocker": 5, "critical": 4, "major": 3, "minor": 2, "trivial": 1}


def _family(columns: Sequence[str], tokens: Sequence[str], compat: bool, kind: str = "priority") -> list[str]:
    """Count columns of a token family. Default: only ``{kind}_<value>_count`` columns
    (each issue counted once); ``compat``: every column containing the token and '_count'."""
    out = []
    for c in columns:
        if "_count" not in c:
            continue
        for tok in tokens:
            name = f"{kind}_{tok}"
            if compat and name in c:
                out.append(c)
                break
            if not compat and c.startswith(name) and c.endswith("_count") and "_type_" not in c[len(kind) + 1:]:
                out.append(c)
                break
    return out


def _rowsum(cols: Sequence[str], skip_null: bool = True) -> Column:
    if not cols:
        return F.lit(0.0)
    parts = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if skip_null else F.col(c).cast("double") for c in cols]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return total


def project_derived(pf: DataFrame, high_tokens: Sequence[str] = HIGH_PRIORITY_TOKENS,
                    low_tokens: Sequence[str] = LOW_PRIORITY_TOKENS,
                    weights: dict[str, float] | None = None, bug_token: str = "bug",
                    compat: bool = False) -> DataFrame:
    """Derived project features computed row-wise over families of columns.

    ``compat=True`` reproduces the reference's name-substring family match
    (priority x type columns counted again; missing priorities make the
    weighted score null).
    """
    weights = PRIORITY_WEIGHTS if weights is None else weights
    cols = pf.columns
    new: dict[str, Column] = {}
    need = {"num_resolved_issues", "project_duration_days", "total_issues"}
    if need <= set(cols):
        den = F.col("project_duration_days") * F.col("total_issues")
        new["weekly_efficiency_ratio"] = F.when(den > 0, F.col("num_resolved_issues") * 7.0 / den).otherwise(0.0)
    if {"avg_resolution_hours", "avg_total_links"} <= set(cols):
        new["complexity_weighted_resolution_time"] = F.col("avg_resolution_hours") * (F.col("avg_total_links") + 1)
    high = _family(cols, high_tokens, compat)
    low = _family(cols, low_tokens, compat)
    if high and low:
        hs, ls = _rowsum(high), _rowsum(low)
        new["high_to_low_priority_ratio"] = F.when(ls > 0, hs / ls).otherwise(hs)
    bugs = _family(cols, [bug_token], compat, kind="type")
    if bugs and "total_issues" in cols:
        new["bug_ratio"] = F.try_divide(_rowsum(bugs), F.col("total_issues"))
    if {"avg_issues_per_month", "resolution_rate_per_day"} <= set(cols):
        rate = F.col("avg_issues_per_month") / 30.0
        new["creation_resolution_balance"] = F.when(rate > 0, F.col("resolution_rate_per_day") / rate).otherwise(0.0)
    wcols = _family(cols, list(weights), compat)
    if wcols and "total_issues" in cols:
        terms = []
        for c in wcols:
            w = next(weights[t] for t in weights if f"priority_{t}" in c)
            v = F.col(c).cast("double") if compat else F.coalesce(F.col(c).cast("double"), F.lit(0.0))
            terms.append(v * float(w))
        total = terms[0]
        for t in terms[1:]:
            total = total + t
        new["weighted_priority_score"] = F.try_divide(total, F.col("total_issues"))
    type_pct = [c for c in cols if c.startswith("type_") and "_pct" in c]
    if type_pct:
        new["issue_type_entropy"] = entropy_log2([F.col(c) / 100.0 for c in type_pct])
    if {"num_resolved_issues", "months_with_activity"} <= set(cols):
        new["monthly_velocity"] = F.try_divide(F.col("num_resolved_issues"), F.col("months_with_activity"))
    return pf.withColumns(new)


# --------------------------------------------------------------------------
# the composed project feature table
# --------------------------------------------------------------------------

def project_overview(df: DataFrame, key: Keys = "project_id", created: str = "created",
                     updated: str | None = "updated", resolved: str = "resolutiondate",
                     name_cols: Sequence[str] = ("project_name",), exact: bool = True) -> DataFrame:
    """A6 + A7 + A8 in one aggregation (the flagship)."""
    keys = _keys(key)
    need = [*keys, *name_cols, created, resolved, "resolution_time_hours", "created_day_of_week",
            "resolved_day_of_week"] + ([updated] if updated else [])
    d = reuse(with_issue_times(df, created, resolved).select(*dict.fromkeys(need)))
    in_agg = not exact
    extra = [_rq_agg(exact)] if in_agg else []
    out = d.groupBy(*keys).agg(*_span_aggs(created, updated, resolved, name_cols),
                               *_resolution_aggs("resolution_time_hours", exact),
                               *_weekend_aggs(resolved), *extra)
    out = _with_resolution_quantiles(out, d, keys, exact, in_agg)
    out = out.withColumns(_span_post(updated)).withColumns(_resolution_post()).withColumns(_weekend_post())
    return out.drop(*_RESOLUTION_TMP, "_res_we", "_res_n")


def project_features(df: DataFrame, key: Keys = "project_id", created: str = "created",
                     updated: str | None = "updated", resolved: str = "resolutiondate",
                     priority: str | None = "priority_name", issue_type: str | None = "issue_type",
                     name_cols: Sequence[str] = ("project_name",), links: bool = True,
                     exact: bool = True, compat: bool = False, derived_kwargs: dict | None = None) -> DataFrame:
    """Full project table: A6-A14 (one main aggregation + A9 + A13), then A15."""
    keys = _keys(key)
    d = reuse(with_issue_times(df, created, resolved))
    pvals = distinct_values(d, priority) if priority else []
    tvals = distinct_values(d, issue_type) if issue_type else []
    aggs = [*_span_aggs(created, updated, resolved, name_cols),
            *_resolution_aggs("resolution_time_hours", exact),
            *_weekend_aggs(resolved)]
    if priority:
        aggs += _priority_aggs(priority, pvals)
    if issue_type:
        aggs += _type_aggs(issue_type, tvals)
    if priority and issue_type:
        aggs += _matrix_aggs(priority, issue_type, resolved, pvals, tvals)
    aggs += _efficiency_aggs(issue_type, tvals)
    in_agg = not exact
    if in_agg:
        aggs.append(_rq_agg(exact))
    out = _with_resolution_quantiles(d.groupBy(*keys).agg(*aggs), d, keys, exact, in_agg)
    post = {**_span_post(updated), **_resolution_post(), **_weekend_post()}
    if priority:
        post.update(_priority_post(pvals, compat))
    if issue_type:
        post.update(_type_post(tvals))
    out = out.withColumns(post).withColumns(_efficiency_post())
    out = out.drop(*_RESOLUTION_TMP, "_res_we", "_res_n", "_prio_n")
    out = null_safe_join(out, monthly_activity(d, keys, created), keys, "left")
    if links:
        out = null_safe_join(out, dependency_stats(d, keys, exact=exact), keys, "left")
    return project_derived(out, compat=compat, **(derived_kwargs or {}))
