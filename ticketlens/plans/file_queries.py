"""File source/sink and incremental-ingest queries.

Each query writes the driver-table data it needs below the shared checkpoint
folder (a fresh scratch folder per call), then reads it back through the
operator under test, so the result rows can be checked against SQL.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.project import project_overview
from ..sources import files as FS
from ..sources import issues as SI
from ..sources import tables as TB
from ..streaming import ingest as ST
from .catalog import register
from .project_queries import project_overview_sql
from .sqlbase import ISSUES, with_issues
from .standin import issues_t


def _flat_issues(spark, sf_dir):
    return TB.issues(spark, sf_dir).select("id", "key", "repository", "project_name", "priority_name", "status")


def _repositories(flat):
    """The trackers there are; one batch arrives from each."""
    return sorted(r[0] for r in flat.select("repository").distinct().collect())


FLAT_SQL = "SELECT id, key, repository, project_name, priority_name, status FROM issues"


@register("S9_S5_csv_tree", with_issues("\n" + FLAT_SQL, ISSUES))
def q_csv_tree(spark, sf_dir):
    """S9 + S5: issues exported as CSV per repository folder, read back as one table tagged with folder and file."""
    base = FS.scratch_path(spark, "csv-tree")
    flat = _flat_issues(spark, sf_dir)
    flat.write.mode("overwrite").option("header", True).partitionBy("repository").csv(base)
    # partition folders are named repository=<name>; the tree reader tags each row with that folder
    back = FS.read_csv_tree(spark, base, "*.csv", group_col="_dir")
    return back.select(F.col("id").cast("long").alias("id"), "key",
                       F.regexp_replace("_dir", "^repository=", "").alias("repository"),
                       "project_name", "priority_name", "status")


ISSUE_CSV_SCHEMA = T.StructType([T.StructField("id", T.LongType()), T.StructField("key", T.StringType()),
                                 T.StructField("project_name", T.StringType()),
                                 T.StructField("priority_name", T.StringType()), T.StructField("status", T.StringType())])


@register("S8_read_csv_typed", with_issues("\nSELECT id, key, project_name, priority_name, status FROM issues", ISSUES))
def q_read_csv_typed(spark, sf_dir):
    """CSV read back with an explicit schema (id typed as long, no inference)."""
    path = FS.scratch_path(spark, "csv-typed")
    FS.write_csv(_flat_issues(spark, sf_dir).drop("repository"), path)
    return FS.read_csv_typed(spark, path, ISSUE_CSV_SCHEMA)


@register("S10_write_partitioned", with_issues("""
SELECT id, regexp_replace(project_name, '[\\\\/*?:"<>|]', '_', 'g') AS project, updated, resolutiondate FROM issues""", ISSUES))
def q_write_partitioned(spark, sf_dir):
    """One folder per project with a file-safe name, read back."""
    path = FS.scratch_path(spark, "by-project")
    d = TB.issues(spark, sf_dir).select("id", F.col("project_name").alias("project"), "updated", "resolutiondate")
    FS.write_partitioned(d, path, "project")
    return spark.read.parquet(path).select("id", "project", "updated", "resolutiondate")


@register("S11_write_json", project_overview_sql())
def q_write_json(spark, sf_dir):
    """Project overview exported as JSON lines and read back with its schema."""
    path = FS.scratch_path(spark, "json")
    ov = project_overview(issues_t(spark, sf_dir))
    FS.write_json(ov, path)
    return spark.read.schema(ov.schema).json(path)


@register("S7_read_json_dim", """
SELECT r.r_name AS key, r.r_regionkey AS regionkey, count(*) AS nations
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey GROUP BY r.r_name, r.r_regionkey""")
def q_read_json_dim(spark, sf_dir):
    """A keyed JSON object (region -> {regionkey, nations}) written as one document and read back as rows."""
    path = FS.scratch_path(spark, "dim-json")
    region, nation = TB.read_table(spark, sf_dir, "region"), TB.read_table(spark, sf_dir, "nation")
    dim = (region.join(nation, nation.n_regionkey == region.r_regionkey)
           .groupBy("r_name", "r_regionkey").agg(F.count(F.lit(1)).alias("nations"))
           .select("r_name", F.col("r_regionkey").alias("regionkey"), "nations"))
    FS.keyed_object_text(dim, "r_name", ["regionkey", "nations"]).coalesce(1).write.mode("overwrite").text(path)
    return FS.read_json_dim(spark, path, "struct<regionkey: int, nations: bigint>")


@register("S12_append_issues", with_issues("\n" + FLAT_SQL, ISSUES))
def q_append_issues(spark, sf_dir):
    """Batches of issues appended to a repository-partitioned table, read back whole."""
    path = FS.scratch_path(spark, "append")
    flat = _flat_issues(spark, sf_dir)
    for r in _repositories(flat):  # one append per arriving batch
        SI.append_issues(flat.where(F.col("repository") == r), path)
    return spark.read.parquet(path).select("id", "key", "repository", "project_name", "priority_name", "status")


COMMENTS_SQL = """
SELECT i.key, CAST(count(c.conv_id) AS INTEGER) AS n_comments
FROM issues i LEFT JOIN conversations c ON c.conv_id = i.id GROUP BY i.key"""


def _comment_arrays(spark, sf_dir):
    conv = TB.read_table(spark, sf_dir, "conversations")
    return (conv.groupBy(TB.issue_key(F.col("conv_id")).alias("key"))
            .agg(F.array_sort(F.collect_list(F.struct("turn", F.col("text").alias("body"),
                                                      F.col("role").alias("author")))).alias("comments")))


@register("S13_upsert_comments", with_issues(COMMENTS_SQL, ISSUES))
def q_upsert_comments(spark, sf_dir):
    """Late-arriving comment arrays set on the issue rows by key; issues without an update keep null."""
    base = TB.issues(spark, sf_dir).select("key", F.lit(None).cast(
        "array<struct<turn:bigint, body:string, author:string>>").alias("comments"))
    up = SI.upsert_comments(base, _comment_arrays(spark, sf_dir))
    return up.select("key", F.coalesce(F.size("comments"), F.lit(0)).alias("n_comments"))


@register("ST1_ingest_issues_stream", with_issues("\n" + FLAT_SQL, ISSUES))
def q_ingest_issues_stream(spark, sf_dir):
    """ST1: issue files landing per repository are appended by an availableNow stream with a checkpoint;
    a second run over the same folder appends nothing."""
    src, table, ckpt = (FS.scratch_path(spark, n) for n in ("st1-src", "st1-table", "st1-ckpt"))
    flat = _flat_issues(spark, sf_dir)
    for r in _repositories(flat):
        flat.where(F.col("repository") == r).write.mode("append").parquet(src)
    ST.ingest_issues_stream(spark, src, flat.schema, table, ckpt)
    ST.ingest_issues_stream(spark, src, flat.schema, table, ckpt)   # restart: nothing new, nothing twice
    return spark.read.parquet(table).select("id", "key", "repository", "project_name", "priority_name", "status")


@register("ST2_enrich_comments_stream", with_issues(COMMENTS_SQL, ISSUES))
def q_enrich_comments_stream(spark, sf_dir):
    """ST2: comment updates stream through foreachBatch into a batch-keyed log; the enriched view merges them."""
    src, log, ckpt = (FS.scratch_path(spark, n) for n in ("st2-src", "st2-log", "st2-ckpt"))
    arrays = _comment_arrays(spark, sf_dir)
    arrays.write.mode("overwrite").parquet(src)
    ST.enrich_comments_stream(spark, src, arrays.schema, log, ckpt)
    base = TB.issues(spark, sf_dir).select("key", F.lit(None).cast(arrays.schema["comments"].dataType).alias("comments"))
    out = ST.enriched_view(base, log)
    return out.select("key", F.coalesce(F.size("comments"), F.lit(0)).alias("n_comments"))


@register("S1_S3_read_issues_file", with_issues("""
SELECT CAST(id AS VARCHAR) AS id, key, repository, priority_name AS "fields.priority.name",
  CAST(project_id AS VARCHAR) AS "fields.project.id"
FROM issues WHERE repository IN ('ASIA', 'EUROPE') AND project_id IN (8, 9, 12, 6, 7)""", ISSUES))
def q_read_issues_file(spark, sf_dir):
    """S1-S3 at the source: documents stored partitioned by tracker; tracker choice prunes partitions,
    the field list prunes nested columns and the project filter runs at the scan."""
    path = FS.scratch_path(spark, "issue-docs")
    SI.append_issues(TB.issue_documents(spark, sf_dir), path)
    return SI.read_issues(spark, path, repos=["ASIA", "EUROPE"],
                          fields=["id", "key", "repository", "fields.priority.name", "fields.project.id"],
                          projects=["8", "9", "12", "6", "7"])
