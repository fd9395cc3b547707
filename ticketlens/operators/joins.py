"""Joins, lookups and unions.

All joins are equi-joins. A side is broadcast only through
``sources.tables.small_side``, which checks the optimizer's size estimate
against a fixed bound; above it the join stays a shuffle join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import small_side


def join_left_on_key(issues: DataFrame, summary: DataFrame, issue_key: str = "issue_key") -> DataFrame:
    """Issues ⟕ per-issue summary on ``key = issue_key`` (key falls back to id); right key dropped."""
    k = F.coalesce(F.col("key"), F.col("id").cast("string")) if "id" in issues.columns else F.col("key")
    left = issues.withColumn("_jk", k)
    return left.join(summary, left["_jk"] == summary[issue_key], "left").drop("_jk", issue_key)


# Candidate names of the project key on each side of J2.
TASK_KEYS = ("project_id", "fields.project.id", "project_key", "fields.project.key")
PROJECT_KEYS = ("project_id", "project_key", "id")


def _resolve(df: DataFrame, candidates: Sequence[str]) -> str:
    for c in candidates:
        if c in df.columns:
            return c
    raise KeyError(f"no project key among {list(candidates)}")


def merge_task_project(tasks: DataFrame, projects: DataFrame, features: Sequence[str] | None = None,
                       task_keys: Sequence[str] = TASK_KEYS, project_keys: Sequence[str] = PROJECT_KEYS,
                       prefix: str = "project_") -> DataFrame:
    """Inner join of tasks with project context on the resolved project key.

    The key is found from a candidate list on each side and renamed
    ``project_id``; of ``features`` only those present are kept (prefixed when
    they clash with task columns). The project table has one row per project;
    it is broadcast when its estimated size is bounded.
    """
    tk, pk = _resolve(tasks, task_keys), _resolve(projects, project_keys)
    t = tasks.withColumnRenamed(tk, "project_id") if tk != "project_id" else tasks
    feats = [c for c in (features or [c for c in projects.columns if c != pk]) if c in projects.columns and c != pk]
    p = projects.select(F.col(f"`{pk}`").alias("project_id"),
                        *[F.col(f"`{c}`").alias(prefix + c if c in t.columns else c) for c in feats])
    return t.join(small_side(p), "project_id", "inner")


def lookup(df: DataFrame, mapping: DataFrame, key: str, value: str, default=-1, out: str | None = None) -> DataFrame:
    """Dictionary lookup (e.g. project -> cluster id) with a default for unknown keys."""
    out = out or value
    m = mapping.select(F.col(key), F.col(value).alias("_v"))
    return df.join(small_side(m), key, "left").withColumn(out, F.coalesce("_v", F.lit(default))).drop("_v")


def semi_filter(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Keep rows whose key appears in another table (left semi join)."""
    return df.join(keys, on, "left_semi")


def normalise_link_types(links: DataFrame, mapping: DataFrame, raw: str = "link_type",
                         map_raw: str = "raw", map_canonical: str = "canonical", out: str = "link_type_canonical") -> DataFrame:
    """Raw link type -> canonical name; unknown names keep their raw value."""
    m = mapping.select(F.col(map_raw).alias("_raw"), F.col(map_canonical).alias("_can"))
    j = links.join(small_side(m), links[raw] == m["_raw"], "left")
    return j.withColumn(out, F.coalesce("_can", F.col(raw))).drop("_raw", "_can")


def issue_type_theme(issues: DataFrame, themes: DataFrame, repo: str = "repository", issue_type: str = "issue_type",
                     t_repo: str = "repository", t_type: str = "issue_type") -> DataFrame:
    """(tracker, issue type) -> theme and code, left join on both keys."""
    t = themes.withColumnRenamed(t_repo, "_tr").withColumnRenamed(t_type, "_tt")
    cond = (issues[repo] == t["_tr"]) & (issues[issue_type] == t["_tt"])
    return issues.join(small_side(t), cond, "left").drop("_tr", "_tt")


def union_all(dfs: Sequence[DataFrame]) -> DataFrame:
    """Bag union by name; columns missing on one side become null."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def union_distinct_count(a: DataFrame, b: DataFrame, col: str, group: Sequence[str] = ()) -> DataFrame:
    """Size of the set union of two name sets (per group)."""
    u = a.select(*group, F.col(col).alias("_v")).union(b.select(*group, F.col(col).alias("_v"))).distinct()
    return u.groupBy(*group).agg(F.count("_v").alias("n"))
