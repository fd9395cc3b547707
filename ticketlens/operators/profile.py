"""Repository profile: one summary row per tracker.

The reference runs ~10 server pipelines per tracker, one tracker after the
other. Here each count is one ``groupBy(repository)`` over all trackers at
once; the per-grain results (a handful of rows each) are joined on the
repository key.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import null_safe_join
from . import nested as N


def index_by_name(defs: DataFrame, repo: str = "repository", name: str = "name",
                  order: str = "position") -> DataFrame:
    """Definitions per tracker deduplicated by name, the last definition winning."""
    w = Window.partitionBy(repo, name).orderBy(F.col(order).desc())
    return defs.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def definitions_count(defs: DataFrame, repos: DataFrame, repo: str = "repository", name: str = "name",
                      out: str = "n") -> DataFrame:
    """S15 count: number of distinct definitions per tracker; a tracker without any gets 0."""
    counts = defs.groupBy(repo).agg(F.countDistinct(name).alias(out))
    return null_safe_join(repos, counts, [repo], "left").fillna(0, subset=[out])


def count_issues(df: DataFrame, repo: str = "repository") -> DataFrame:
    """A4: issue count per tracker."""
    return df.groupBy(repo).agg(F.count(F.lit(1)).alias("issues"))


def count_by_project(df: DataFrame, project_id: str, project_name: str) -> DataFrame:
    """A4: issues per project with one name (``min``: a stable choice of "first")."""
    return df.groupBy(project_id).agg(F.count(F.lit(1)).alias("issues"), F.min(project_name).alias("project_name"))


def distinct_values_of(df: DataFrame, col: str) -> DataFrame:
    """A5: distinct list of a column."""
    return df.select(col).distinct()


def born(df: DataFrame, created: str, repo: str = "repository",
         skip: Mapping[str, int] | None = None) -> DataFrame:
    """A3: year (first 4 characters) of the earliest ``created`` text after skipping known-bad rows.

    ``skip`` maps tracker -> number of earliest rows to ignore. Only the first
    max(skip)+1 created values per tracker are kept (a bounded top-k per
    tracker, never a sort of a whole tracker in one task); the result is one
    row per tracker.
    """
    from ..functions.ranking import first_k_per_group

    skip = dict(skip or {})
    off = F.lit(0)
    for r, n in skip.items():
        off = F.when(F.col(repo) == r, F.lit(int(n))).otherwise(off)
    c = F.col(created).cast("string")
    src = df.select(F.col(repo), c.alias("_c")).where(F.col("_c").isNotNull())
    k = max([0, *skip.values()]) + 1
    ranked = first_k_per_group(src, [repo], [F.col("_c")], k, "_rn")
    return ranked.where(F.col("_rn") == off + 1).select(repo, F.substring("_c", 1, 4).alias("born"))


def _totals(docs: DataFrame, repo: str, epic: Column | None) -> DataFrame:
    """Issues, Comments, Changes, subtasks and epic links per tracker in ONE aggregation (N16, N17, parts of N15)."""
    changes = F.aggregate(F.coalesce(F.col("changelog.histories"), F.array()), F.lit(0),
                          lambda a, h: a + F.size(h.getField("items")))
    aggs = [F.count(F.lit(1)).alias("Issues"),
            F.coalesce(F.sum(F.size("fields.comments")), F.lit(0)).cast("long").alias("Comments"),
            F.coalesce(F.sum(changes), F.lit(0)).cast("long").alias("Changes")]
    aggs.append(F.coalesce(F.sum(F.size("fields.subtasks")), F.lit(0)).cast("long").alias("_sub")
                if N._has(docs, "fields.subtasks") else F.lit(0).cast("long").alias("_sub"))
    aggs.append(F.count(epic).alias("_epic") if epic is not None else F.lit(0).cast("long").alias("_epic"))
    return docs.groupBy(repo).agg(*aggs)


def profile_projection(docs: DataFrame, repo: str = "repository") -> DataFrame:
    """The document paths the profile reads, in the same nested shape (comment bodies, change values
    and other fields dropped), so materialising the documents once stays small."""
    f = F.col("fields")
    links = F.transform(f.getField("issuelinks"), lambda l: F.struct(
        l.getField("id").alias("id"), F.struct(l.getField("type").getField("name").alias("name")).alias("type")))
    comments = F.transform(f.getField("comments"), lambda c: F.struct(c.getField("author").getField("name").alias("author")))
    hist = F.transform(F.col("changelog.histories"), lambda h: F.struct(F.transform(
        h.getField("items"), lambda i: F.struct(i.getField("field").alias("field"),
                                                i.getField("fromString").alias("fromString"))).alias("items")))
    fields = [f.getField("created").alias("created"),
              F.struct(f.getField("issuetype").getField("name").alias("name")).alias("issuetype"),
              F.struct(f.getField("project").getField("name").alias("name")).alias("project"),
              links.alias("issuelinks"), comments.alias("comments")]
    if N._has(docs, "fields.subtasks"):
        fields.append(f.getField("subtasks").alias("subtasks"))
    return docs.select(F.col(repo), F.struct(*fields).alias("fields"), F.struct(hist.alias("histories")).alias("changelog"))


def repository_profile(docs: DataFrame, issue_type_defs: DataFrame | None = None,
                       link_type_defs: DataFrame | None = None, repo: str = "repository",
                       born_skip: Mapping[str, int] | None = None, epic: Column | None = None) -> DataFrame:
    """A1: Born, Issues, DIT, UIT, Links, DLT, ULT, Changes, Ch/I, UP, Comments, Co/I per tracker.

    One aggregation gives the per-tracker totals; the distinct counts (used
    types, projects, link types, link ids) and Born are their own small
    aggregations; all are joined on the tracker (a handful of rows each).
    Ch/I and Co/I are rounded half-to-even to whole numbers, like Python ``round``.
    """
    from ..session import reuse

    # about ten aggregations read the documents: materialise the needed paths once
    docs = reuse(profile_projection(docs, repo)) if epic is None else reuse(docs)
    repos = docs.select(repo).distinct()
    link_ids = (docs.select(repo, F.explode("fields.issuelinks.id").alias("_lid"))
                .groupBy(repo).agg(F.countDistinct("_lid").alias("_links")))
    parts = [
        _totals(docs, repo, epic),
        link_ids,
        born(docs, "fields.created", repo, born_skip).withColumnRenamed("born", "Born"),
        N.distinct_types_used(docs, repo).withColumnRenamed("used_issue_types", "UIT"),
        N.distinct_link_types(docs, repo).withColumnRenamed("used_link_types", "ULT"),
        N.distinct_projects(docs, repo).withColumnRenamed("used_projects", "UP"),
    ]
    if issue_type_defs is not None:
        parts.append(definitions_count(issue_type_defs, repos, repo, out="DIT"))
    if link_type_defs is not None:
        parts.append(definitions_count(link_type_defs, repos, repo, out="DLT"))
    out = repos
    for p in parts:
        out = null_safe_join(out, p, [repo], "left")     # a null tracker is a tracker
    out = out.withColumn("Links", F.coalesce("_links", F.lit(0)) + F.col("_sub") + F.col("_epic")) \
        .drop("_links", "_sub", "_epic")
    return out.withColumns({
        "Ch/I": F.bround(F.try_divide(F.col("Changes"), F.col("Issues")), 0).cast("long"),
        "Co/I": F.bround(F.try_divide(F.col("Comments"), F.col("Issues")), 0).cast("long"),
    })


def summary_rows(profile: DataFrame, label_col: str = "repository", exact: bool = True) -> DataFrame:
    """A2: Sum / Median / Std Dev footer rows over every numeric column of a profile."""
    from ..functions.stats import median

    num = [f.name for f in profile.schema.fields
           if f.dataType.typeName() in ("long", "integer", "double", "float", "short", "decimal")]
    q = [f"`{c}`" for c in num]
    s = profile.agg(*[F.sum(F.col(c)).cast("double").alias(n) for c, n in zip(q, num)]).withColumn(label_col, F.lit("Sum"))
    m = profile.agg(*[median(F.col(c), exact).alias(n) for c, n in zip(q, num)]).withColumn(label_col, F.lit("Median"))
    d = profile.agg(*[F.stddev_samp(F.col(c)).alias(n) for c, n in zip(q, num)]).withColumn(label_col, F.lit("Std Dev"))
    return s.unionByName(m).unionByName(d).select(label_col, *q)
