"""Nested-document, repository-profile and issue-source queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import nested as N
from ..operators import profile as PR
from ..sources import issues as SI
from ..sources import tables as T
from .catalog import register
from .sqlbase import ISSUES, with_issues
from .standin import EVENT_TYPES

ISO = "'%Y-%m-%dT%H:%M:%S.%g+0000'"

# The stand-in tracker registry (region names) and per-tracker skips for Born.
KNOWN_REPOSITORIES = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
BORN_SKIP = {"AMERICA": 1, "ASIA": 3}
LINK_TYPES = ["a", "n", "r"]


def docs(spark, sf_dir):
    return T.issue_documents(spark, sf_dir)


def sql(body: str) -> str:
    return with_issues(body, ISSUES)


# ---- SQL fragments over the flat tables -----------------------------------

CHANGES_SQL = """,
ch AS (
  SELECT i.key AS issue_key, strftime(e.ts, '%Y%m%d') AS history_id, 'system' AS author,
         min(e.ts) OVER (PARTITION BY e.user_id, strftime(e.ts, '%Y%m%d')) AS created,
         e.event_type AS field, 'custom' AS fieldtype, CAST(NULL AS VARCHAR) AS "from",
         CAST(NULL AS VARCHAR) AS "fromString", CAST(e.value AS VARCHAR) AS "to", e.props AS "toString",
         i.repository
  FROM events e JOIN issues i ON i.id = e.user_id)"""


@register("N1_flatten_struct", sql(f"""
SELECT CAST(id AS VARCHAR) AS id, key, repository,
  issue_type AS "fields.issuetype.name", priority_name AS "fields.priority.name", status AS "fields.status.name",
  CAST(project_id AS VARCHAR) AS "fields.project.id", project_name AS "fields.project.key",
  project_name AS "fields.project.name", strftime(created, {ISO}) AS "fields.created",
  strftime(updated, {ISO}) AS "fields.updated", strftime(resolutiondate, {ISO}) AS "fields.resolutiondate",
  CAST(creator AS VARCHAR) AS "fields.creator.name", CAST(assignee AS VARCHAR) AS "fields.assignee.name"
FROM issues"""))
def q_flatten_struct(spark, sf_dir):
    """Recursive struct flattening of the issue documents (array columns then dropped)."""
    return N.drop_list_columns(N.flatten_struct(docs(spark, sf_dir)))


@register("N2_expand_struct", sql(f"""
SELECT CAST(id AS VARCHAR) AS id, key, repository, strftime(created, {ISO}) AS created,
  strftime(updated, {ISO}) AS updated, strftime(resolutiondate, {ISO}) AS resolutiondate FROM issues"""))
def q_expand_struct(spark, sf_dir):
    """One-level expansion of ``fields``; the scalar fields are kept."""
    out = N.expand_struct(docs(spark, sf_dir), "fields")
    keep = [f.name for f in out.schema.fields if f.dataType.typeName() == "string"]
    return out.select(*keep)


@register("N3_flatten_changelog", sql(CHANGES_SQL + """
SELECT * EXCLUDE (repository) FROM ch"""))
def q_flatten_changelog(spark, sf_dir):
    """Two-level unnest of changelog histories -> one row per change item."""
    return N.flatten_changelog(docs(spark, sf_dir))


@register("N4_unwind", sql("""
SELECT CAST(i.id AS VARCHAR) AS id, c.text AS body, c.role AS author
FROM conversations c JOIN issues i ON i.id = c.conv_id"""))
def q_unwind(spark, sf_dir):
    """Inner unnest of the comment arrays (issues without comments vanish)."""
    d = docs(spark, sf_dir).select("id", F.col("fields.comments").alias("comments"))
    u = N.unwind(d, "comments", "c")
    return u.select("id", F.col("c.body").alias("body"), F.col("c.author.name").alias("author"))


_ORDER = 'created, history_id, author, field, fieldtype, "from", "fromString", "to", "toString"'


@register("N5_collect_history", sql(CHANGES_SQL + f"""
SELECT issue_key, CAST(count(*) AS INTEGER) AS n_changes,
  first(field ORDER BY {_ORDER}) AS first_field, last("toString" ORDER BY {_ORDER}) AS last_value
FROM ch GROUP BY issue_key"""))
def q_collect_history(spark, sf_dir):
    """Re-nest flattened changes per issue as a sorted array; report size and both ends."""
    h = N.collect_history(N.flatten_changelog(docs(spark, sf_dir)))
    return h.select("issue_key", F.size("changes").alias("n_changes"),
                    F.col("changes")[0]["field"].alias("first_field"),
                    F.element_at("changes", -1)["toString"].alias("last_value"))


@register("N6_changelog_counts", sql(CHANGES_SQL + "\nSELECT issue_key, " + ", ".join(
    f"count(CASE WHEN field = '{v}' THEN 1 END) AS changelog_count_{v}" for v in EVENT_TYPES)
    + " FROM ch GROUP BY issue_key"))
def q_changelog_counts(spark, sf_dir):
    """Per-issue count pivot of changed fields."""
    return N.changelog_counts(N.flatten_changelog(docs(spark, sf_dir)))


def _link_counts_sql(compat: bool) -> str:
    cols = ["CAST(count(l.l_orderkey) AS INTEGER) AS issuelinks_total"]
    for t in LINK_TYPES:
        c = f"count(CASE WHEN lower(l.l_returnflag) = '{t}' THEN 1 END)"
        if compat:
            cols.append(f"CASE WHEN {c} > 0 THEN {c} END AS issuelinks_{t}_count")
            cols.append(f"CASE WHEN {c} > 0 THEN 1 END AS has_issuelinks_{t}")
        else:
            cols.append(f"CAST({c} AS INTEGER) AS issuelinks_{t}_count")
            cols.append(f"CAST({c} > 0 AS INTEGER) AS has_issuelinks_{t}")
    return sql(f"""
SELECT CAST(i.id AS VARCHAR) AS id, {', '.join(cols)}
FROM issues i LEFT JOIN lineitem l ON l.l_orderkey = i.id GROUP BY i.id""")


@register("N7_link_features", _link_counts_sql(False))
def q_link_features(spark, sf_dir):
    """Total links and per-type count/flag columns (absent type -> 0)."""
    return N.link_features(docs(spark, sf_dir))


@register("N7_link_features_compat", _link_counts_sql(True))
def q_link_features_compat(spark, sf_dir):
    """N7 with ``compat=True``: absent types stay null; case variants overwrite."""
    return N.link_features(docs(spark, sf_dir), compat=True)


LINK_DIR_SQL = sql("""
SELECT CAST(i.id AS VARCHAR) AS id,
  CAST(count(CASE WHEN l.l_linestatus = 'F' THEN 1 END) AS INTEGER) AS inward_count,
  CAST(count(CASE WHEN l.l_linestatus = 'O' THEN 1 END) AS INTEGER) AS outward_count
FROM issues i LEFT JOIN lineitem l ON l.l_orderkey = i.id GROUP BY i.id""")


@register("N8_link_direction_counts", LINK_DIR_SQL)
def q_link_direction_counts(spark, sf_dir):
    """inward/outward link counts from the nested link arrays."""
    return N.link_direction_counts(docs(spark, sf_dir)).select("id", "inward_count", "outward_count")


def _python_literal_links(col: str):
    """Render a link array as the Python-literal text the reference's CSV round trip leaves."""
    def key_text(s):
        return F.when(s.isNull(), F.lit("None")).otherwise(F.concat(F.lit("{'key': '"), s.getField("key"), F.lit("'}")))

    items = F.transform(F.col(col), lambda l: F.concat(
        F.lit("{'id': '"), l.getField("id"), F.lit("', 'type': {'name': '"), l.getField("type").getField("name"),
        F.lit("'}, 'inwardIssue': "), key_text(l.getField("inwardIssue")),
        F.lit(", 'outwardIssue': "), key_text(l.getField("outwardIssue")), F.lit("}")))
    return F.concat(F.lit("["), F.array_join(items, ", "), F.lit("]"))


@register("N9_N10_parse_links", LINK_DIR_SQL.replace("AS outward_count", "AS outward_count, "
                                                     "CAST(count(l.l_orderkey) AS INTEGER) AS link_total"))
def q_parse_links(spark, sf_dir):
    """N9 + N10: parse Python-literal link text (None/True/False rewritten), then count links and directions."""
    d = docs(spark, sf_dir).select("id", _python_literal_links("fields.issuelinks").alias("links_text"))
    parsed = d.select("id", N.parse_links("links_text").alias("links"))
    out = N.link_direction_counts(parsed, "links")
    return out.select("id", "inward_count", "outward_count", N.link_total("links").alias("link_total"))


@register("N11_comment_features", sql("""
SELECT CAST(i.id AS VARCHAR) AS id, CAST(count(c.conv_id) AS INTEGER) AS comment_count,
  coalesce(avg(length(coalesce(c.text, ''))), 0.0) AS avg_comment_length,
  CAST(coalesce(max(length(coalesce(c.text, ''))), 0) AS INTEGER) AS max_comment_length,
  CAST(count(DISTINCT c.role) AS INTEGER) AS unique_authors_count
FROM issues i LEFT JOIN conversations c ON c.conv_id = i.id GROUP BY i.id"""))
def q_comment_features(spark, sf_dir):
    """Comment count, mean/max body length, distinct non-null authors per issue."""
    out = N.comment_features(docs(spark, sf_dir))
    return out.select("id", "comment_count", "avg_comment_length", "max_comment_length", "unique_authors_count")


def _distinct_hist_sql(final_col: str, field: str, out: str) -> str:
    return sql(CHANGES_SQL + f""",
u AS (SELECT repository, {final_col} AS value FROM issues
      UNION ALL SELECT repository, "fromString" AS value FROM ch WHERE field = '{field}')
SELECT repository, count(DISTINCT value) AS {out} FROM u GROUP BY repository""")


@register("N12_distinct_types_used", _distinct_hist_sql("issue_type", "issuetype", "used_issue_types"))
def q_distinct_types(spark, sf_dir):
    """Issue types used per tracker, final state ∪ history."""
    return N.distinct_types_used(docs(spark, sf_dir))


@register("N13_distinct_projects", _distinct_hist_sql("project_name", "project", "used_projects"))
def q_distinct_projects(spark, sf_dir):
    """Projects used per tracker, final state ∪ history."""
    return N.distinct_projects(docs(spark, sf_dir))


ULT_SQL = """SELECT i.repository, count(DISTINCT l.l_returnflag) AS used_link_types
FROM issues i LEFT JOIN lineitem l ON l.l_orderkey = i.id GROUP BY i.repository"""


@register("N14_distinct_link_types", sql("\n" + ULT_SQL))
def q_distinct_link_types(spark, sf_dir):
    """Distinct link type names per tracker."""
    return N.distinct_link_types(docs(spark, sf_dir))


LINKS_SQL = """SELECT i.repository, count(DISTINCT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR)) AS links
FROM issues i LEFT JOIN lineitem l ON l.l_orderkey = i.id GROUP BY i.repository"""


@register("N15_count_links", sql("\n" + LINKS_SQL))
def q_count_links(spark, sf_dir):
    """Distinct link ids + subtasks + epic links per tracker."""
    return N.count_links(docs(spark, sf_dir))


CHANGES_COUNT_SQL = """SELECT i.repository, count(e.event_id) AS changes
FROM issues i LEFT JOIN events e ON e.user_id = i.id GROUP BY i.repository"""


@register("N16_count_changes", sql("\n" + CHANGES_COUNT_SQL))
def q_count_changes(spark, sf_dir):
    """Σ change items per tracker (no explode)."""
    return N.count_changes(docs(spark, sf_dir))


COMMENTS_COUNT_SQL = """SELECT i.repository, count(c.conv_id) AS comments
FROM issues i LEFT JOIN conversations c ON c.conv_id = i.id GROUP BY i.repository"""


@register("N17_count_comments", sql("\n" + COMMENTS_COUNT_SQL))
def q_count_comments(spark, sf_dir):
    """Σ comment-array sizes per tracker."""
    return N.count_comments(docs(spark, sf_dir))


@register("N18_embed_text")
def q_embed_text(spark, sf_dir):
    """Encode every whole document text to a unit-norm vector (hashing TF-IDF encoder)."""
    d = T.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    e = N.embed_text(d, "text", "embedding", num_features=256)
    return e.select("doc_id", F.size("embedding").alias("dim"),
                    F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("norm"))


@register("N19_expand_vector", "SELECT vec_id, label, " + ", ".join(
    f"embedding[{i + 1}] AS emb_{i}" for i in range(64)) + " FROM embeddings")
def q_expand_vector(spark, sf_dir):
    """Vector column -> one column per dimension."""
    e = T.read_table(spark, sf_dir, "embeddings")
    return N.expand_vector(e, "embedding", "emb", dim=64)


# ---- repository profile -----------------------------------------------------

def issue_type_defs(spark, sf_dir):
    """Issue-type definitions per tracker (stand-in: customer segments by region, position = custkey)."""
    c = T.read_table(spark, sf_dir, "customer")
    dims = T.small_side(T.project_dim(spark, sf_dir))
    return (c.join(dims, c.c_nationkey == dims.project_id)
            .select("repository", F.col("c_mktsegment").alias("name"), F.col("c_custkey").alias("position")))


def link_type_defs(spark, sf_dir):
    """Link-type definitions per tracker (stand-in: supplier names by region)."""
    s = T.read_table(spark, sf_dir, "supplier")
    dims = T.small_side(T.project_dim(spark, sf_dir))
    return (s.join(dims, s.s_nationkey == dims.project_id)
            .select("repository", F.col("s_name").alias("name"), F.col("s_suppkey").alias("position")))


DEFS_SQL = """,
itd AS (SELECT r.r_name AS repository, c.c_mktsegment AS name, c.c_custkey AS position
        FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey),
ltd AS (SELECT r.r_name AS repository, s.s_name AS name, s.s_suppkey AS position
        FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey)"""

BORN_SQL = f"""born AS (
  SELECT repository, substr(c, 1, 4) AS "Born" FROM (
    SELECT repository, c, row_number() OVER (PARTITION BY repository ORDER BY c) AS rn
    FROM (SELECT repository, strftime(created, {ISO}) AS c FROM issues WHERE created IS NOT NULL))
  WHERE rn = CASE repository {' '.join(f"WHEN '{k}' THEN {v}" for k, v in BORN_SKIP.items())} ELSE 0 END + 1)"""


@register("S15_index_by_name", sql(DEFS_SQL + """
SELECT repository, name, max(position) AS position FROM itd GROUP BY repository, name"""))
def q_index_by_name(spark, sf_dir):
    """Definitions deduplicated per (tracker, name); the last definition wins."""
    return PR.index_by_name(issue_type_defs(spark, sf_dir))


@register("A3_born", sql(",\n" + BORN_SQL + "\nSELECT repository, \"Born\" AS born FROM born"))
def q_born(spark, sf_dir):
    """A3: year of the earliest created date per tracker after skipping known-bad rows."""
    return PR.born(docs(spark, sf_dir), "fields.created", skip=BORN_SKIP)


@register("A4_count_by_project", sql("""
SELECT project_id, count(*) AS issues, min(project_name) AS project_name FROM issues GROUP BY project_id"""))
def q_count_by_project(spark, sf_dir):
    """A4: issue count per project with a stable project name."""
    return PR.count_by_project(T.issues(spark, sf_dir), "project_id", "project_name")


@register("A5_distinct", sql("\nSELECT DISTINCT priority_name FROM issues"))
def q_distinct(spark, sf_dir):
    """A5: distinct values of a column."""
    return PR.distinct_values_of(T.issues(spark, sf_dir), "priority_name")


PROFILE_SQL = sql(CHANGES_SQL + DEFS_SQL + ",\n" + BORN_SQL + f""",
iss AS (SELECT repository, count(*) AS "Issues" FROM issues GROUP BY repository),
uit AS (SELECT repository, count(DISTINCT value) AS "UIT" FROM (
          SELECT repository, issue_type AS value FROM issues
          UNION ALL SELECT repository, "fromString" FROM ch WHERE field = 'issuetype') GROUP BY repository),
up AS (SELECT repository, count(DISTINCT value) AS "UP" FROM (
          SELECT repository, project_name AS value FROM issues
          UNION ALL SELECT repository, "fromString" FROM ch WHERE field = 'project') GROUP BY repository),
lk AS ({LINKS_SQL}),
ult AS ({ULT_SQL}),
chg AS ({CHANGES_COUNT_SQL}),
com AS ({COMMENTS_COUNT_SQL}),
dit AS (SELECT repository, count(DISTINCT name) AS "DIT" FROM itd GROUP BY repository),
dlt AS (SELECT repository, count(DISTINCT name) AS "DLT" FROM ltd GROUP BY repository)
SELECT iss.repository, born."Born", iss."Issues", coalesce(dit."DIT", 0) AS "DIT", uit."UIT",
  lk.links AS "Links", coalesce(dlt."DLT", 0) AS "DLT", ult.used_link_types AS "ULT", chg.changes AS "Changes",
  CAST(round_even(chg.changes / iss."Issues", 0) AS BIGINT) AS "Ch/I", up."UP", com.comments AS "Comments",
  CAST(round_even(com.comments / iss."Issues", 0) AS BIGINT) AS "Co/I"
FROM iss LEFT JOIN born USING (repository) LEFT JOIN uit USING (repository) LEFT JOIN up USING (repository)
LEFT JOIN lk USING (repository) LEFT JOIN ult USING (repository) LEFT JOIN chg USING (repository)
LEFT JOIN com USING (repository) LEFT JOIN dit USING (repository) LEFT JOIN dlt USING (repository)""")


def profile(spark, sf_dir):
    return PR.repository_profile(docs(spark, sf_dir), issue_type_defs(spark, sf_dir),
                                 link_type_defs(spark, sf_dir), born_skip=BORN_SKIP)


@register("A1_repository_profile", PROFILE_SQL)
def q_repository_profile(spark, sf_dir):
    """A1: one summary row per tracker (Born, Issues, DIT, UIT, Links, DLT, ULT, Changes, Ch/I, UP, Comments, Co/I)."""
    return profile(spark, sf_dir)


_NUM = ["Issues", "DIT", "UIT", "Links", "DLT", "ULT", "Changes", "Ch/I", "UP", "Comments", "Co/I"]


@register("A2_summary_rows", PROFILE_SQL.replace("\nSELECT iss.repository,", ",\nprof AS (SELECT iss.repository,", 1)
          + ")\n" + "\nUNION ALL\n".join(
              f"SELECT '{lab}' AS repository, " + ", ".join(f'{fn}(CAST("{c}" AS DOUBLE)) AS "{c}"' for c in _NUM)
              + " FROM prof" for lab, fn in [("Sum", "sum"), ("Median", "median"), ("Std Dev", "stddev_samp")]))
def q_summary_rows(spark, sf_dir):
    """A2: Sum / Median / Std Dev footer rows of the repository profile."""
    return PR.summary_rows(profile(spark, sf_dir))


# ---- issue sources -----------------------------------------------------------

@register("S1_select_repositories", sql("""
SELECT CAST(id AS VARCHAR) AS id, key, repository FROM issues WHERE repository IN ('ASIA', 'EUROPE')"""))
def q_select_repositories(spark, sf_dir):
    """Documents of the chosen trackers; unknown names are dropped."""
    d = SI.select_repositories(docs(spark, sf_dir), ["ASIA", "EUROPE", "NOWHERE"], known=KNOWN_REPOSITORIES)
    return d.select("id", "key", "repository")


@register("S2_project_fields", sql(f"""
SELECT CAST(id AS VARCHAR) AS id, key, repository, priority_name AS "fields.priority.name",
  strftime(created, {ISO}) AS "fields.created", project_name AS "fields.project.name" FROM issues"""))
def q_project_fields(spark, sf_dir):
    """Projection of the needed dotted paths (nested column pruning); absent paths skipped."""
    return SI.project_fields(docs(spark, sf_dir), ["id", "key", "repository", "fields.priority.name",
                                                    "fields.created", "fields.project.name", "fields.no_such"])


@register("S3_filter_projects", sql("""
SELECT CAST(id AS VARCHAR) AS id, key, CAST(project_id AS VARCHAR) AS project_id FROM issues WHERE project_id IN (1, 7, 24)"""))
def q_filter_projects(spark, sf_dir):
    """S3: ``$in`` filter on project id."""
    d = SI.filter_projects(docs(spark, sf_dir), ["1", "7", "24"])
    return d.select("id", "key", F.col("fields.project.id").alias("project_id"))


@register("S14_pending_comment_work", sql(f"""
SELECT CAST(i.id AS VARCHAR) AS id, i.key, strftime(i.created, {ISO}) AS created FROM issues i
WHERE NOT EXISTS (SELECT 1 FROM conversations c WHERE c.conv_id = i.id)
  AND strftime(i.created, {ISO}) >= '1998-01-01'"""))
def q_pending_comment_work(spark, sf_dir):
    """Issues still without comments created since the resume date, oldest first."""
    return SI.pending_comment_work(docs(spark, sf_dir), "1998-01-01")


def hashing_encoder(dim: int = 64):
    """A small per-batch text encoder (token hashing + L2 norm) for the pandas-UDF path of N18."""
    import re as _re
    import zlib

    import numpy as np

    def encode(texts):
        out = []
        for t in texts:
            v = np.zeros(dim, dtype=np.float32)
            for tok in _re.findall(r"\w+", t.lower()):
                v[zlib.crc32(tok.encode("utf-8")) % dim] += 1.0  # stable across processes
            n = float(np.linalg.norm(v))
            out.append(v / n if n > 0 else v)
        return out
    return encode


@register("X5_pandas_udf_embedding")
def q_pandas_udf_embedding(spark, sf_dir):
    """A vectorised (Arrow-batched) pandas UDF, its encoder loaded once per worker, encodes every whole document text to a unit vector."""
    d = T.read_table(spark, sf_dir, "documents").select("doc_id", "text")
    e = N.embed_text(d, "text", "embedding", load=lambda: hashing_encoder(64))
    return e.select("doc_id", F.size("embedding").alias("dim"),
                    F.round(F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)), 6).alias("norm"))
