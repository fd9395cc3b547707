"""Readers for the parquet tables and the issue-tracker stand-in views.

The stand-in functions only rename and nest driver-table columns into the
shapes the issue operators expect (FIXTURES.md §2); every feature, count and
statistic is computed by the operators themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()

# Broadcast bound: a side is broadcast only when the optimizer's size estimate
# (parquet file size, or a conservative upper bound after operators) is below it.
BROADCAST_MAX_BYTES = 64 * 1024 * 1024


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Plain parquet scan; column pruning and filter pushdown stay intact."""
    return spark.read.parquet(table_path(sf_dir, name))


def estimated_bytes(df: DataFrame) -> int:
    """The optimizer's size estimate of ``df`` (no job is run)."""
    stats = df._jdf.queryExecution().optimizedPlan().stats()
    return int(str(stats.sizeInBytes()))


def small_side(df: DataFrame, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """Mark ``df`` for broadcast only when its estimated size is bounded.

    Above the bound the frame is returned unchanged and the join falls back to
    a shuffle (sort-merge) join, so nothing unbounded is shipped to executors.
    """
    return F.broadcast(df) if estimated_bytes(df) <= max_bytes else df


def issue_key(id_col: Column, prefix: str = "ORD-") -> Column:
    return F.concat(F.lit(prefix), id_col.cast("string"))


# --------------------------------------------------------------------------
# stand-in views (FIXTURES.md §2)
# --------------------------------------------------------------------------

def project_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """project (nation) -> repository (region); 25 x 5 rows by definition."""
    nation = read_table(spark, sf_dir, "nation")
    region = read_table(spark, sf_dir, "region")
    return (nation.join(small_side(region), nation.n_regionkey == region.r_regionkey)
            .select(F.col("n_nationkey").alias("project_id"),
                    F.col("n_name").alias("project_name"),
                    F.col("r_name").alias("repository")))


def issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat issue table: one row per order.

    id, key, repository, project_id, project_name, created, updated,
    resolutiondate, issue_type, priority_name, status, creator, assignee.
    """
    orders = read_table(spark, sf_dir, "orders")
    customer = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", "c_mktsegment")
    lines = (read_table(spark, sf_dir, "lineitem")
             .groupBy("l_orderkey")
             .agg(F.max("l_shipdate").alias("last_ship"), F.min("l_suppkey").alias("assignee")))
    dims = small_side(project_dim(spark, sf_dir))
    return (orders
            .join(customer, orders.o_custkey == customer.c_custkey)
            .join(dims, F.col("c_nationkey") == dims.project_id)
            .join(lines, orders.o_orderkey == lines.l_orderkey, "left")
            .select(F.col("o_orderkey").alias("id"),
                    issue_key(F.col("o_orderkey")).alias("key"),
                    "repository", "project_id", "project_name",
                    F.col("o_orderdate").alias("created"),
                    F.col("last_ship").alias("updated"),
                    F.when(F.col("o_orderstatus") == "F", F.col("last_ship")).alias("resolutiondate"),
                    F.col("c_mktsegment").alias("issue_type"),
                    F.col("o_orderpriority").alias("priority_name"),
                    F.col("o_orderstatus").alias("status"),
                    F.col("o_custkey").alias("creator"),
                    "assignee"))


def issue_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat link table: one row per lineitem (issue_id, link_id, link_type, inward/outward key)."""
    li = read_table(spark, sf_dir, "lineitem")
    target = issue_key(F.col("l_partkey"), "PART-")
    link_id = F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return li.select(F.col("l_orderkey").alias("issue_id"),
                     link_id.alias("link_id"),
                     F.col("l_returnflag").alias("link_type"),
                     F.when(F.col("l_linestatus") == "F", target).alias("inward_key"),
                     F.when(F.col("l_linestatus") == "O", target).alias("outward_key"))


def changelog_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat change items: one row per event (issue = user, history = user-day)."""
    ev = read_table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("issue_id"),
                     F.date_format("ts", "yyyyMMdd").alias("history_id"),
                     F.col("event_id"),
                     F.col("ts").alias("created"),
                     F.col("event_type").alias("field"),
                     F.lit("custom").alias("fieldtype"),
                     F.col("props").alias("toString"),
                     F.col("value").cast("string").alias("to"))


def comment_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat comments: issue = conv_id, author = role, body = text."""
    conv = read_table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").alias("issue_id"), "turn",
                       F.col("role").alias("author"), F.col("text").alias("body"))


def issue_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested issue documents shaped like the tracker export (FIXTURES.md §1.1).

    Arrays are built with ``collect_list(struct)`` per issue and sorted, so each
    document is deterministic. Array length is bounded by what one issue holds
    (lines of an order, events of a user, turns of a conversation).
    """
    base = issues(spark, sf_dir)
    links = (issue_links(spark, sf_dir)
             .groupBy("issue_id")
             .agg(F.array_sort(F.collect_list(F.struct(
                 F.col("link_id").alias("id"),
                 F.struct(F.col("link_type").alias("name")).alias("type"),
                 F.when(F.col("inward_key").isNotNull(), F.struct(F.col("inward_key").alias("key"))).alias("inwardIssue"),
                 F.when(F.col("outward_key").isNotNull(), F.struct(F.col("outward_key").alias("key"))).alias("outwardIssue"),
             ))).alias("issuelinks")))
    items = changelog_items(spark, sf_dir)
    hist = (items.groupBy("issue_id", "history_id")
            .agg(F.min("created").alias("created"),
                 F.array_sort(F.collect_list(F.struct(
                     F.col("event_id"), F.col("field"), F.col("fieldtype"),
                     F.lit(None).cast("string").alias("from"), F.lit(None).cast("string").alias("fromString"),
                     F.col("to"), F.col("toString")))).alias("items"))
            .groupBy("issue_id")
            .agg(F.array_sort(F.collect_list(F.struct(
                F.col("history_id").alias("id"),
                F.struct(F.lit("system").alias("name")).alias("author"),
                F.col("created"),
                F.transform("items", lambda i: i.dropFields("event_id")).alias("items")))).alias("histories")))
    comments = (comment_rows(spark, sf_dir)
                .groupBy("issue_id")
                .agg(F.array_sort(F.collect_list(F.struct(
                    "turn", F.col("body"), F.struct(F.col("author").alias("name")).alias("author"))))
                    .alias("comments")))
    comments = comments.select("issue_id", F.transform("comments", lambda c: c.dropFields("turn")).alias("comments"))
    doc = (base
           .join(links, base.id == links.issue_id, "left").drop("issue_id")
           .join(hist, base.id == hist.issue_id, "left").drop("issue_id")
           .join(comments, base.id == comments.issue_id, "left").drop("issue_id"))
    return doc.select(
        F.col("id").cast("string").alias("id"), "key", "repository",
        F.struct(
            F.struct(F.col("issue_type").alias("name")).alias("issuetype"),
            F.struct(F.col("priority_name").alias("name")).alias("priority"),
            F.struct(F.col("status").alias("name")).alias("status"),
            F.struct(F.col("project_id").cast("string").alias("id"),
                     F.col("project_name").alias("key"),
                     F.col("project_name").alias("name")).alias("project"),
            F.date_format("created", "yyyy-MM-dd'T'HH:mm:ss.SSS+0000").alias("created"),
            F.date_format("updated", "yyyy-MM-dd'T'HH:mm:ss.SSS+0000").alias("updated"),
            F.date_format("resolutiondate", "yyyy-MM-dd'T'HH:mm:ss.SSS+0000").alias("resolutiondate"),
            F.struct(F.col("creator").cast("string").alias("name")).alias("creator"),
            F.struct(F.col("assignee").cast("string").alias("name")).alias("assignee"),
            F.col("issuelinks"),
            F.col("comments"),
        ).alias("fields"),
        F.struct(F.col("histories")).alias("changelog"),
    )
