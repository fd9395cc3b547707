"""Issue-document sources and sinks.

Documents live in parquet (or JSON) with ``repository`` as a partition
column, so choosing trackers prunes partitions and choosing fields prunes
nested columns at the scan.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from .tables import small_side

# The fields the feature extraction reads (projection pushdown list).
NEEDED_FIELDS = (
    "id", "key", "repository",
    "fields.issuetype.name", "fields.priority.name", "fields.status.name",
    "fields.project.id", "fields.project.key", "fields.project.name",
    "fields.created", "fields.updated", "fields.resolutiondate",
    "fields.creator.name", "fields.assignee.name",
    "fields.issuelinks", "fields.comments",
)


def select_repositories(df: DataFrame, repos: Iterable[str] | None, known: Iterable[str] | None = None,
                        repo: str = "repository") -> DataFrame:
    """Keep documents of the chosen trackers; unknown names are dropped; an empty choice is an error."""
    if repos is None:
        return df
    chosen = list(repos)
    if known is not None:
        known_set = set(known)
        chosen = [r for r in chosen if r in known_set]
    if not chosen:
        raise ValueError("no known repository selected")
    return df.where(F.col(repo).isin(chosen))


def project_fields(df: DataFrame, fields: Sequence[str] = NEEDED_FIELDS) -> DataFrame:
    """Keep only the listed (dotted) paths, named by their path; absent paths are skipped."""
    from ..operators.nested import _has

    return df.select(*[F.col(f).alias(f) for f in fields if _has(df, f)])


def filter_projects(df: DataFrame, projects: Iterable, col: str = "fields.project.id") -> DataFrame:
    """S3: ``$in`` filter on project id (pushed to the scan when it is a top-level column)."""
    return df.where(F.col(col).isin(list(projects)))


def read_issues(spark: SparkSession, path: str, repos: Iterable[str] | None = None,
                fields: Sequence[str] | None = None, projects: Iterable | None = None,
                fmt: str = "parquet", schema: T.StructType | None = None) -> DataFrame:
    """S1-S3 at the source: one scan, partition pruning by repository, nested column pruning."""
    reader = spark.read.format(fmt)
    if schema is not None:
        reader = reader.schema(schema)
    df = reader.load(path)
    if repos is not None:
        df = select_repositories(df, repos)
    if projects is not None:
        df = filter_projects(df, projects)
    if fields is not None:
        df = project_fields(df, fields)
    return df


def append_issues(df: DataFrame, path: str, partition_by: str = "repository") -> None:
    """Append a batch of documents to the issue table."""
    df.write.mode("append").partitionBy(partition_by).parquet(path)


def newest_updates(updates: DataFrame, key: str = "key", col: str = "comments", order: Sequence[str] = ()) -> DataFrame:
    """One row per key: the update that is last by ``order``, then by its content; keys that are null are dropped.

    A partial aggregation, so a key with very many updates shrinks before the shuffle.
    """
    content = F.to_json(F.struct(F.col(col)))
    last = F.max_by(F.struct(F.col(col).alias("v")), F.struct(*[F.col(o) for o in order], F.md5(content), content))
    return updates.where(F.col(key).isNotNull()).groupBy(key).agg(last.alias("_last")).select(key, F.col("_last.v").alias(col))


def upsert_comments(issues: DataFrame, comments: DataFrame, key: str = "key",
                    col: str = "comments", order: Sequence[str] = ()) -> DataFrame:
    """Set the late-arriving comment array by key; rows without an update keep their value.

    Of several updates of a key the newest wins (see :func:`newest_updates`), so
    the rows of ``issues`` are never multiplied.
    """
    upd = newest_updates(comments, key, col, order).select(F.col(key).alias("_k"), F.col(col).alias("_new"))
    joined = issues.join(upd, issues[key] == upd["_k"], "left")
    return joined.withColumn(col, F.coalesce("_new", F.col(col))).drop("_k", "_new")


def upsert_table(spark: SparkSession, path: str, comments: DataFrame, key: str = "key", col: str = "comments", order: Sequence[str] = (),
                 partition_by: str = "repository") -> list:
    """S13 on a stored table: rewrite the partitions that hold an updated key, and no other; returns their values.

    The touched partitions are read (others are pruned), merged, written aside,
    and put in place by dynamic partition overwrite, which swaps whole
    partitions when its job commits. Updates of unknown keys change nothing.
    """
    table = spark.read.parquet(path)
    news = cut_lineage(newest_updates(comments, key, col, order))
    hit = table.select(F.col(key).alias("_k"), partition_by).join(small_side(news.select(key)), F.col("_k") == F.col(key), "left_semi")
    parts = [r[0] for r in hit.select(partition_by).distinct().orderBy(partition_by).collect()]
    if parts:
        named = [p for p in parts if p is not None]
        touched = F.col(partition_by).isin(named) if named else F.lit(False)
        touched = touched | F.col(partition_by).isNull() if None in parts else touched
        merged = cut_lineage(upsert_comments(table.where(touched), news, key, col))
        (merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition_by).parquet(path))
    return parts


def pending_comment_work(docs: DataFrame, resume_at: str, created: str = "fields.created",
                         comments: str = "fields.comments") -> DataFrame:
    """Issues without comments created at or after ``resume_at`` (text compare), sorted by created."""
    return (docs.where(F.col(comments).isNull() & (F.col(created) >= F.lit(resume_at)))
            .select("id", "key", F.col(created).alias("created"))
            .orderBy("created", "id"))
