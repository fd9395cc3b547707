"""Derived per-issue columns and string predicates."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Status words that mark an issue completed (case-insensitive substring).
COMPLETED_TERMS = ("Done", "Closed", "Resolved", "Complete", "Completed", "Fixed",
                   "Finished", "Released", "Delivered", "Verified")

# Dotted source paths copied to short names when present.
ALIASES = {
    "fields.priority.name": "priority_name",
    "fields.priority.id": "priority_id",
    "fields.issuetype.name": "issue_type",
    "fields.issuetype.id": "issue_type_id",
    "fields.status.name": "status",
}

# The hour cap (six 30-day months) for the task target.
HOURS_CAP = 6 * 30 * 24


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def alias_columns(df: DataFrame, aliases: Mapping[str, str] = ALIASES) -> DataFrame:
    """copy each present source column under its short name."""
    present = {dst: F.col(f"`{src}`") for src, dst in aliases.items() if src in df.columns}
    return df.withColumns(present) if present else df


def is_completed(status: str | Column, terms: Sequence[str] = COMPLETED_TERMS) -> Column:
    """1 when the status contains any term (any case), else 0; null -> 0.

    Substring semantics are kept on purpose: 'Unresolved' and 'Incomplete' count.
    """
    pattern = "(?i)(" + "|".join(terms) + ")"
    return F.coalesce(_c(status).rlike(pattern), F.lit(False)).cast("int")


def estimation_ratio(original: str | Column, spent: str | Column) -> Column:
    """time spent / original estimate when both are > 0, else null."""
    o, s = _c(original), _c(spent)
    return F.when((o > 0) & (s > 0), s / o)


def log_target(col: str | Column) -> Column:
    """F16: log1p(max(x, 0)); null -> 0."""
    return F.log1p(F.greatest(F.coalesce(_c(col).cast("double"), F.lit(0.0)), F.lit(0.0)))


def inverse_log_target(col: str | Column) -> Column:
    return F.expm1(_c(col))


def cap_target(df: DataFrame, col: str, cap: float = HOURS_CAP, log_col: str | None = None) -> DataFrame:
    """values above ``cap`` set to the cap; the log column is recomputed."""
    out = df.withColumn(col, F.least(F.col(col), F.lit(float(cap))))
    return out.withColumn(log_col, log_target(col)) if log_col else out


def filter_target(df: DataFrame, col: str, lo: float | None = 0.0, hi: float | None = None) -> DataFrame:
    """keep rows whose target is not null and within [lo, hi]."""
    cond = F.col(col).isNotNull()
    if lo is not None:
        cond = cond & (F.col(col) >= lo)
    if hi is not None:
        cond = cond & (F.col(col) <= hi)
    return df.where(cond)


# Fixed values of the rule-based effort range (exact lower-case matches, else the default).
EFFORT_BASE_HOURS = {"bug": 8.0, "feature": 24.0, "improvement": 16.0}
EFFORT_DEFAULT_BASE = 12.0
EFFORT_PRIORITY = {"critical": 0.8, "high": 0.9, "low": 1.2}
EFFORT_DEFAULT_PRIORITY = 1.0
EFFORT_COMPLEXITY = {"high": 2.0, "low": 0.5}
EFFORT_DEFAULT_COMPLEXITY = 1.0


def _lookup(col: Column, table: Mapping[str, float], default: float) -> Column:
    return F.coalesce(F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])[F.lower(col)],
                      F.lit(default))


def rule_effort_range(issue_type: str | Column, priority: str | Column, complexity: str | Column) -> Column:
    """rule estimate as struct(min_hours, typical_hours, max_hours, work_days).

    typical = base hours by type x priority factor x complexity factor;
    min = typical x 0.7, max = typical x 1.5, work days = typical / 8.
    """
    h = (_lookup(_c(issue_type), EFFORT_BASE_HOURS, EFFORT_DEFAULT_BASE)
         * _lookup(_c(priority), EFFORT_PRIORITY, EFFORT_DEFAULT_PRIORITY)
         * _lookup(_c(complexity), EFFORT_COMPLEXITY, EFFORT_DEFAULT_COMPLEXITY))
    return F.struct((h * 0.7).alias("min_hours"), h.alias("typical_hours"),
                    (h * 1.5).alias("max_hours"), (h / 8.0).alias("work_days"))


# Feature-name groups (exact names), checked in this order.
FEATURE_GROUPS = (
    ("Issue Type", ("is_type_bug", "is_type_task", "is_type_story", "is_type_improvement",
                    "is_type_new_feature", "is_type_epic", "is_type_sub-task")),
    ("Priority", ("is_priority_blocker", "is_priority_critical", "is_priority_major",
                  "is_priority_minor", "is_priority_trivial")),
    ("Relationships", ("inward_count", "outward_count")),
    ("Temporal", ("age_days", "created_is_weekend", "created_hour", "created_month", "created_year")),
    ("Status", ("fields.creator.active", "fields.issuetype.id", "is_completed", "is_resolved")),
)


def feature_group(name: str | Column, groups=FEATURE_GROUPS, default: str = "Other") -> Column:
    """feature name -> category; the first group listing the name wins."""
    n = _c(name)
    expr = F.lit(default)
    for label, names in reversed(groups):
        expr = F.when(n.isin(*names), F.lit(label)).otherwise(expr)
    return expr


def scaler_prefix(name: str | Column) -> Column:
    """F27 variant: the prefix before ``__`` of a transformed feature name ('none' if absent)."""
    n = _c(name)
    return F.when(n.contains("__"), F.split(n, "__").getItem(0)).otherwise(F.lit("none"))
