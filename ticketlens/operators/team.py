"""Team metrics per project.

Everything is a two-level aggregation: first per (project, person), then per
project. Both levels aggregate partially on the map side, so a project or a
person holding a third of the issues costs merged buffers, not a hot task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import entropy_log2, safe_div
from ..session import reuse
from .columns import numeric_columns, q
from .stats import gini


def _std_row(cols: Sequence[Column]) -> Column:
    """Sample standard deviation across a row (nulls skipped), like pandas ``std(axis=1)``."""
    arr = F.filter(F.array(*[c.cast("double") for c in cols]), lambda x: x.isNotNull())
    n = F.size(arr)
    mean = F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / n
    ss = F.aggregate(arr, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n > 1, F.sqrt(ss / (n - 1)))


def _mean_row(cols: Sequence[Column]) -> Column:
    arr = F.filter(F.array(*[c.cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.when(F.size(arr) > 0, F.aggregate(arr, F.lit(0.0), lambda a, x: a + x) / F.size(arr))


def team_metrics(issues: DataFrame, key: str = "project_id", creator: str = "creator", assignee: str = "assignee",
                 issue_type: str = "issue_type", resolution_time: str | None = "resolution_time_hours",
                 bug_type: str = "bug", feature_type: str = "feature") -> DataFrame:
    """The 24 team metrics per project; metrics whose input column is absent are null.

    bug/feature are matched by exact value (the reference compares to 'bug' and
    'feature'); pass the tracker's spelling.
    """
    issues = reuse(issues)
    cols = set(issues.columns)
    has = lambda c: c is not None and c in cols
    is_bug = F.col(issue_type) == bug_type if has(issue_type) else F.lit(False)
    is_feat = F.col(issue_type) == feature_type if has(issue_type) else F.lit(False)

    # project level, one pass
    proj_aggs = [F.count(F.lit(1)).alias("_total"), F.count_if(is_bug).alias("_n_bug")]
    for c, name in [("complexity", "team_complexity_capacity"), ("creator_experience_days", "avg_creator_experience_days"),
                    ("creator_specialization", "avg_creator_specialization"),
                    ("creator_link_density", "creator_link_density_mean")]:
        proj_aggs.append(F.avg(c).alias(name) if has(c) else F.lit(None).cast("double").alias(name))
    for c, name in [(resolution_time, "_rt_std"), ("creator_link_density", "creator_link_density_std"),
                    ("onboarding_time", "creator_onboarding_volatility")]:
        proj_aggs.append(F.stddev_samp(c).alias(name) if has(c) else F.lit(None).cast("double").alias(name))
    if has("is_core") and has(creator):
        proj_aggs.append(F.count_distinct(F.when(F.col("is_core") == F.lit(True), F.col(creator))).alias("_core"))
    out = issues.groupBy(key).agg(*proj_aggs)

    if has(creator):
        per_c = (issues.where(F.col(creator).isNotNull()).groupBy(key, creator)
                 .agg(F.count(F.lit(1)).alias("_n"),
                      (F.count_distinct(issue_type) if has(issue_type) else F.lit(None)).alias("_types"),
                      F.count_if(is_bug).alias("_bug"), F.count_if(is_feat).alias("_feat")))
        c_aggs = per_c.groupBy(key).agg(
            F.count(F.lit(1)).alias("team_size_creators"),
            F.avg("_n").alias("avg_issues_per_creator"),
            F.max("_n").alias("_max_c"),
            F.var_samp("_n").alias("creator_activity_variance"),
            F.stddev_samp("_n").alias("creator_activity_std"),
            F.avg("_types").alias("creator_diversity"),
            F.max("_bug").alias("_bug_max_c"),
            F.sum("_bug").alias("_bug_c_rows"), F.count_if(F.col("_bug") > 0).alias("_bug_c"),
            F.sum("_feat").alias("_feat_c_rows"), F.count_if(F.col("_feat") > 0).alias("_feat_c"),
        )
        out = out.join(c_aggs, key, "left").join(gini(per_c, "_n", [key], "creator_workload_gini"), key, "left")
    if has(assignee):
        per_a = (issues.where(F.col(assignee).isNotNull()).groupBy(key, assignee)
                 .agg(F.count_if(is_bug).alias("_bug"), F.count_if(is_feat).alias("_feat")))
        a_aggs = per_a.groupBy(key).agg(
            F.count(F.lit(1)).alias("team_size_assignees"),
            F.sum("_bug").alias("_bug_a_rows"), F.count_if(F.col("_bug") > 0).alias("_bug_a"),
            F.sum("_feat").alias("_feat_a_rows"), F.count_if(F.col("_feat") > 0).alias("_feat_a"),
        )
        out = out.join(a_aggs, key, "left")
    if has(issue_type):
        per_t = issues.where(F.col(issue_type).isNotNull()).groupBy(key, issue_type).agg(F.count(F.lit(1)).alias("_n"))
        t_aggs = per_t.groupBy(key).agg((F.max("_n") / F.sum("_n")).alias("team_type_specialization_index"))
        out = out.join(t_aggs, key, "left")
    if has("creator_join_date") and has(creator):
        per_m = (issues.groupBy(key, F.date_trunc("month", F.col("creator_join_date")).alias("_m"))
                 .agg(F.count_distinct(creator).alias("_nc")))
        out = out.join(per_m.where(F.col("_m").isNotNull()).groupBy(key)
                       .agg(F.avg("_nc").alias("avg_new_creators_per_month")), key, "left")

    def col_or_null(c: str, t: str = "double") -> Column:
        return F.col(c) if c in out.columns else F.lit(None).cast(t)

    tc, ta = col_or_null("team_size_creators", "long"), col_or_null("team_size_assignees", "long")
    comb = F.coalesce(tc, F.lit(0)) + F.coalesce(ta, F.lit(0))
    avg_bug_c = safe_div(col_or_null("_bug_c_rows"), col_or_null("_bug_c"))
    avg_bug_a = safe_div(col_or_null("_bug_a_rows"), col_or_null("_bug_a"))
    avg_feat_c = safe_div(col_or_null("_feat_c_rows"), col_or_null("_feat_c"))
    avg_feat_a = safe_div(col_or_null("_feat_a_rows"), col_or_null("_feat_a"))
    metrics = {
        "team_size_creators": F.coalesce(tc, F.lit(0)),
        "team_size_assignees": F.coalesce(ta, F.lit(0)),
        "team_size_combined": comb,
        "core_team_ratio": safe_div(F.col("_core"), comb) if "_core" in out.columns else F.lit(None).cast("double"),
        "creator_workload_gini": col_or_null("creator_workload_gini"),
        "creator_diversity": col_or_null("creator_diversity"),
        "avg_issues_per_creator": col_or_null("avg_issues_per_creator"),
        "top_creator_contribution": safe_div(col_or_null("_max_c"), F.col("_total")),
        "creator_activity_variance": col_or_null("creator_activity_variance"),
        "creator_activity_std": col_or_null("creator_activity_std"),
        "team_type_specialization_index": col_or_null("team_type_specialization_index"),
        "team_complexity_capacity": F.col("team_complexity_capacity"),
        "team_resolution_predictability": safe_div(F.lit(1.0), F.col("_rt_std")),
        "bug_creator_concentration": safe_div(col_or_null("_bug_max_c"), F.col("_n_bug")),
        "bug_developer_ratio": safe_div(avg_bug_a, avg_bug_c),
        "feature_developer_ratio": safe_div(avg_feat_a, avg_feat_c),
        "avg_creator_experience_days": F.col("avg_creator_experience_days"),
        "avg_creator_issue_count": col_or_null("avg_issues_per_creator"),
        "avg_creator_specialization": F.col("avg_creator_specialization"),
        "creator_link_density_mean": F.col("creator_link_density_mean"),
        "creator_link_density_std": F.col("creator_link_density_std"),
        "creator_resolution_time_variability": F.col("_rt_std"),
        "creator_onboarding_volatility": F.col("creator_onboarding_volatility"),
        "avg_new_creators_per_month": col_or_null("avg_new_creators_per_month"),
    }
    return out.select(key, *[c.alias(n) for n, c in metrics.items()])


def activity_metrics(issues: DataFrame, key: str = "project_id", created: str = "created",
                     issue_type: str = "issue_type", bug_type: str = "bug", feature_type: str = "feature",
                     links: Sequence[str] = ("inward_count", "outward_count"), complex_links: int = 2,
                     work_start: int = 9, work_end: int = 17) -> DataFrame:
    """The team metrics that appear only in the reference's saved output, with our own definitions:

    bug_creation_ratio / feature_request_ratio: share of issues of that type;
    weekend_activity_ratio: share created on Saturday/Sunday;
    work_hour_creation_ratio: share created in [work_start, work_end) hours;
    creation_hour_entropy: log2 entropy of the created-hour distribution;
    creation_rate_stability: 1 / (1 + std/mean of monthly creation counts);
    complex_issue_distribution: share of issues with more than ``complex_links`` links.
    """
    hour = F.hour(created)
    n_links = F.lit(0)
    for c in links:
        if c in issues.columns:
            n_links = n_links + F.coalesce(F.col(c), F.lit(0))
    base = issues.groupBy(key).agg(
        F.count(F.lit(1)).alias("_n"),
        F.avg((F.col(issue_type) == bug_type).cast("double")).alias("bug_creation_ratio"),
        F.avg((F.col(issue_type) == feature_type).cast("double")).alias("feature_request_ratio"),
        F.avg((F.weekday(created) >= 5).cast("double")).alias("weekend_activity_ratio"),
        F.avg(((hour >= work_start) & (hour < work_end)).cast("double")).alias("work_hour_creation_ratio"),
        F.avg((n_links > complex_links).cast("double")).alias("complex_issue_distribution"),
        *[F.count_if(hour == h).alias(f"_h{h}") for h in range(24)],
    )
    base = base.withColumn("creation_hour_entropy",
                           entropy_log2([F.col(f"_h{h}") / F.col("_n") for h in range(24)]))
    months = (issues.where(F.col(created).isNotNull())
              .groupBy(key, F.date_trunc("month", F.col(created)).alias("_m")).agg(F.count(F.lit(1)).alias("_c"))
              .groupBy(key).agg((F.stddev_samp("_c") / F.avg("_c")).alias("_cv")))
    out = base.join(months, key, "left").withColumn(
        "creation_rate_stability", F.when(F.col("_cv").isNotNull(), 1.0 / (1.0 + F.col("_cv"))))
    return out.drop("_n", "_cv", *[f"_h{h}" for h in range(24)])


def team_size(pf: DataFrame, issue_count: str = "total_issues", hours: str = "total_resolution_hours") -> DataFrame:
    """Row max over creator / reporter / assignee column families, team size estimate (0 -> 1 as
    divisor), issues and hours per member, role diversity = row sample std / row mean."""
    num = numeric_columns(pf)
    fams = {}
    for fam in ("creator", "reporter", "assignee"):
        cols = [c for c in num if fam in c.lower()]
        if cols:
            fams[f"{fam}_count"] = F.greatest(*[q(c) for c in cols]) if len(cols) > 1 else q(cols[0])
    if not fams:
        return pf
    out = pf.withColumns(fams)
    avail = [F.col(c) for c in fams]
    out = out.withColumn("team_size_estimate", F.greatest(*avail) if len(avail) > 1 else avail[0])
    div = F.when(F.col("team_size_estimate") == 0, F.lit(1)).otherwise(F.col("team_size_estimate"))
    extra = {}
    if issue_count in pf.columns:
        extra["issues_per_team_member"] = F.col(issue_count) / div
    if hours in pf.columns:
        extra["resolution_hours_per_team_member"] = F.col(hours) / div
    if len(avail) > 1:
        m = _mean_row(avail)
        extra["team_role_diversity"] = _std_row(avail) / F.when(m == 0, F.lit(1.0)).otherwise(m)
    return out.withColumns(extra)
