"""Column-set, join, union and profile queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import columns as C
from ..operators import joins as J
from ..operators import nested as N
from ..operators import stats as S
from ..session import reuse
from ..sources import tables as T
from .catalog import register
from .nested_queries import CHANGES_SQL
from .sqlbase import ISSUES, ISSUES_TL, with_issues
from .standin import EVENT_TYPES, issues_t, issues_tl

MATRIX_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "p_size", "p_retailprice",
               "net_price", "gross_price"]

MATRIX_SQL = """SELECT l.l_orderkey, l.l_linenumber, l.l_quantity, l.l_extendedprice, l.l_discount, l.l_tax,
  p.p_size, p.p_retailprice, l.l_extendedprice * (1 - l.l_discount) AS net_price,
  l.l_extendedprice * (1 + l.l_tax) AS gross_price
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey"""


def matrix(spark, sf_dir):
    """Numeric matrix: lineitem ⋈ part with net and gross price."""
    li = T.read_table(spark, sf_dir, "lineitem")
    part = T.read_table(spark, sf_dir, "part").select("p_partkey", "p_size", "p_retailprice")
    m = li.join(part, li.l_partkey == part.p_partkey)
    return m.select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
                    "p_size", "p_retailprice",
                    (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
                    (F.col("l_extendedprice") * (1 + F.col("l_tax"))).alias("gross_price"))


SPARSE_TYPED_SQL = """SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""
SPARSE_COLS = ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]


def sparse(spark, sf_dir):
    """documents ⟕ labels (labels cover a minority of documents, so quality/toxic are mostly null)."""
    d = T.read_table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(T.read_table(spark, sf_dir, "labels"), "doc_id", "left")


def _union(parts):
    return "\nUNION ALL\n".join(parts)


# ---- C2-C10 -------------------------------------------------------------------

@register("C2_C3_standardise_names", with_issues("""
SELECT project_id, "priority_1-urgent_count", "priority_2-high_count", "priority_3-medium_count",
  "priority_4-not_specified_count", "priority_5-low_count"
FROM (SELECT project_id, """ + ", ".join(
    f"CASE WHEN count(CASE WHEN priority_name = '{p}' THEN 1 END) > 0 THEN count(CASE WHEN priority_name = '{p}' THEN 1 END) END "
    f"AS \"priority_{p.lower().replace(' ', '_')}_count\""
    for p in ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]) + " FROM issues GROUP BY project_id)", ISSUES))
def q_standardise_names(spark, sf_dir):
    """C2 + C3: priority count columns renamed to standard spelling, variants coalesced."""
    from ..operators.project import priority_mix

    pm = priority_mix(T.issues(spark, sf_dir))
    pm = pm.select("project_id", *[c for c in pm.columns if c.endswith("_count")])
    return C.standardise_names(pm)


@register("C4_drop_high_missing", "SELECT doc_id, lang, source, n_chars FROM (" + SPARSE_TYPED_SQL + ")")
def q_drop_high_missing(spark, sf_dir):
    """C4: keep columns whose null share is at most 30 %."""
    return C.drop_high_missing(sparse(spark, sf_dir), 0.3)


@register("C5_drop_zero_dominated", with_issues(CHANGES_SQL + "\nSELECT issue_key, " + ", ".join(
    f"count(CASE WHEN field = '{v}' THEN 1 END) AS changelog_count_{v}" for v in EVENT_TYPES)
    + " FROM ch GROUP BY issue_key", ISSUES))
def q_drop_zero_dominated(spark, sf_dir):
    """Drop changelog count columns with more than 80 % zeros."""
    counts = N.changelog_counts(N.flatten_changelog(T.issue_documents(spark, sf_dir)))
    return C.drop_zero_dominated(counts, "changelog_count_", 0.8)


@register("C6_drop_constant", with_issues("SELECT id, created_month, inward_count FROM itl", ISSUES_TL))
def q_drop_constant(spark, sf_dir):
    """Drop columns with at most one distinct value (created/resolved hour are always 0 here)."""
    d = issues_tl(spark, sf_dir).select("id", "created_hour", "resolved_hour", "created_month", "inward_count")
    return C.drop_constant(d)


@register("C7_common_columns", "SELECT doc_id, lang, source, n_chars, quality, toxic FROM (" + SPARSE_TYPED_SQL + ")")
def q_common_columns(spark, sf_dir):
    """Keep columns that hold data in at least 35 % of the groups (documents by language)."""
    d = sparse(spark, sf_dir)
    return d.select(*C.common_columns(d, "lang", 0.35))


@register("C9_drop_leaky", "SELECT l_orderkey, l_linenumber, l_quantity, l_discount, p_size, p_retailprice, net_price FROM ("
          + MATRIX_SQL + ")")
def q_drop_leaky(spark, sf_dir):
    """Drop suspects, features with corr(feature, target) > 0.8 and leaking names (target net_price)."""
    return C.drop_leaky(matrix(spark, sf_dir), "net_price", 0.8, suspects=["l_tax"])


@register("C10_drop_collinear", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, "
          "p_size, p_retailprice FROM (" + MATRIX_SQL + ")")
def q_drop_collinear(spark, sf_dir):
    """Drop every feature with |corr| > 0.95 to an earlier one."""
    return C.drop_collinear(matrix(spark, sf_dir), 0.95, cols=MATRIX_COLS)


@register("J8_align_columns", with_issues("SELECT id, inward_count, 0 AS story_points, outward_count FROM itl", ISSUES_TL))
def q_align_columns(spark, sf_dir):
    """Reindex to training columns; missing -> 0, extra dropped."""
    return C.align_columns(issues_tl(spark, sf_dir), ["id", "inward_count", "story_points", "outward_count"])


@register("J8_feature_report", with_issues("""
SELECT 'inward_count' AS feature, 'available' AS status, count(inward_count) AS filled_rows FROM itl
UNION ALL SELECT 'priority_name', 'available', count(priority_name) FROM itl
UNION ALL SELECT 'story_points', 'absent', NULL FROM itl WHERE id IS NULL HAVING count(*) = 0
UNION ALL SELECT 'resolution_time_hours', 'suspicious', count(resolution_time_hours) FROM itl""", ISSUES_TL))
def q_feature_report(spark, sf_dir):
    """Which wanted features are there, absent or suspicious, and how many rows fill them."""
    return C.feature_report(issues_tl(spark, sf_dir), ["inward_count", "priority_name", "story_points"], ["resolution_time_hours", "hours_spent"])


# ---- joins and unions ------------------------------------------------------------

@register("J1_join_left_on_key", with_issues(CHANGES_SQL + """,
cc AS (SELECT issue_key, """ + ", ".join(f"count(CASE WHEN field = '{v}' THEN 1 END) AS changelog_count_{v}"
                                         for v in EVENT_TYPES) + """ FROM ch GROUP BY issue_key)
SELECT CAST(i.id AS VARCHAR) AS id, i.key, """ + ", ".join(f"cc.changelog_count_{v}" for v in EVENT_TYPES) + """
FROM issues i LEFT JOIN cc ON cc.issue_key = i.key""", ISSUES))
def q_join_left_on_key(spark, sf_dir):
    """Issues ⟕ per-issue changelog summary on key = issue_key."""
    docs = T.issue_documents(spark, sf_dir)
    summary = N.changelog_counts(N.flatten_changelog(docs))
    return J.join_left_on_key(docs.select("id", "key"), summary)


@register("J2_merge_task_project", with_issues("""
SELECT it.id, it.project_id, p.total_issues, p.avg_resolution_hours, it.resolution_time_hours
FROM it JOIN (SELECT project_id, count(*) AS total_issues, avg(resolution_time_hours) AS avg_resolution_hours
              FROM it GROUP BY project_id) p ON it.project_id = p.project_id"""))
def q_merge_task_project(spark, sf_dir):
    """Tasks ⋈ project context on the resolved project key (project side broadcast when bounded)."""
    from ..operators.project import project_overview

    tasks = issues_t(spark, sf_dir).select("id", "project_id", "resolution_time_hours")
    proj = project_overview(issues_t(spark, sf_dir))
    return J.merge_task_project(tasks, proj, ["total_issues", "avg_resolution_hours", "not_there"])


@register("J3_lookup", with_issues("""
SELECT i.id, i.project_id, coalesce(n.n_regionkey, -1) AS cluster
FROM issues i LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) n ON i.project_id = n.n_nationkey""", ISSUES))
def q_lookup(spark, sf_dir):
    """Project -> cluster lookup with -1 for projects missing from the map."""
    nat = T.read_table(spark, sf_dir, "nation").where("n_regionkey <> 2")
    mapping = nat.select(F.col("n_nationkey").alias("project_id"), F.col("n_regionkey").alias("cluster"))
    return J.lookup(T.issues(spark, sf_dir).select("id", "project_id"), mapping, "project_id", "cluster", -1)


@register("J4_semi_filter", """
SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal > 9000)""")
def q_semi_filter(spark, sf_dir):
    """Keep orders whose customer is in another table's list (left semi join)."""
    o = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    keys = T.read_table(spark, sf_dir, "customer").where("c_acctbal > 9000").select(F.col("c_custkey").alias("o_custkey"))
    return J.semi_filter(o, keys, "o_custkey")


@register("J5_normalise_link_types", """
SELECT l.l_orderkey, l.l_linenumber, p.p_type AS link_type, coalesce(m.canonical, p.p_type) AS link_type_canonical
FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey
LEFT JOIN (SELECT p_type AS raw, min(p_brand) AS canonical FROM part WHERE p_size <= 25 GROUP BY p_type) m ON m.raw = p.p_type""")
def q_normalise_link_types(spark, sf_dir):
    """Raw link type -> canonical name through a mapping table; unmapped names stay raw."""
    part = T.read_table(spark, sf_dir, "part")
    li = T.read_table(spark, sf_dir, "lineitem")
    links = li.join(part.select("p_partkey", "p_type"), li.l_partkey == part.p_partkey).select(
        "l_orderkey", "l_linenumber", F.col("p_type").alias("link_type"))
    mapping = part.where("p_size <= 25").groupBy(F.col("p_type").alias("raw")).agg(F.min("p_brand").alias("canonical"))
    return J.normalise_link_types(links, mapping)


@register("J6_issue_type_theme", with_issues("""
SELECT i.id, i.project_id, i.assignee, s.s_name AS theme
FROM issues i LEFT JOIN supplier s ON i.project_id = s.s_nationkey AND i.assignee = s.s_suppkey""", ISSUES))
def q_issue_type_theme(spark, sf_dir):
    """Two-key dimension lookup (project, assignee) -> theme."""
    sup = T.read_table(spark, sf_dir, "supplier").select(
        F.col("s_nationkey").alias("project_id"), F.col("s_suppkey").alias("assignee"), F.col("s_name").alias("theme"))
    iss = T.issues(spark, sf_dir).select("id", "project_id", "assignee")
    return J.issue_type_theme(iss, sup, "project_id", "assignee", "project_id", "assignee")


#: Columns that a tracker's table does not have; the tables of all other trackers have both.
LACKS = {"ASIA": "status", "EUROPE": "priority_name"}


@register("U1_union_all", with_issues("""
SELECT id, created, priority_name, NULL AS status FROM issues WHERE repository = 'ASIA'
UNION ALL SELECT id, created, NULL AS priority_name, status FROM issues WHERE repository = 'EUROPE'
UNION ALL SELECT id, created, priority_name, status FROM issues WHERE repository IS NULL OR repository NOT IN ('ASIA', 'EUROPE')""", ISSUES))
def q_union_all(spark, sf_dir):
    """Union by name of the issue tables of all trackers, which have different columns (missing -> null)."""
    iss = reuse(T.issues(spark, sf_dir).select("repository", "id", "created", "priority_name", "status"))
    tables = [iss.where(F.col("repository") == r).drop("repository", lacking) for r, lacking in LACKS.items()]
    others = iss.where(F.col("repository").isNull() | ~F.col("repository").isin(*LACKS)).drop("repository")
    return J.union_all([*tables, others])


@register("U2_union_distinct_count", with_issues("""
SELECT project_id, count(v) AS n FROM (SELECT project_id, creator AS v FROM issues UNION SELECT project_id, assignee FROM issues)
GROUP BY project_id""", ISSUES))
def q_union_distinct_count(spark, sf_dir):
    """Size of the union of creator and assignee sets per project."""
    iss = T.issues(spark, sf_dir)
    return J.union_distinct_count(iss.select("project_id", F.col("creator").alias("p")),
                                  iss.select("project_id", F.col("assignee").alias("p")), "p", ["project_id"])


# ---- A20-A22, A31 profiles ----------------------------------------------------------

@register("A20_missing_profile", _union([
    f"SELECT '{c}' AS \"column\", count(*) - count({c}) AS missing_count, "
    f"round((count(*) - count({c})) / count(*) * 100.0, 2) AS missing_pct FROM ({SPARSE_TYPED_SQL})" for c in SPARSE_COLS]))
def q_missing_profile(spark, sf_dir):
    """Null count and share per column, most missing first."""
    return S.missing_profile(sparse(spark, sf_dir))


@register("A21_column_profile")
def q_column_profile(spark, sf_dir):
    """Per column kind, missing %, drop/keep action, estimated distinct count, min/max (all rows read)."""
    return S.column_profile(sparse(spark, sf_dir))


@register("A22_describe", _union([
    f"SELECT '{c}' AS \"column\", count({c}) AS count, avg({c}) AS mean, stddev_samp({c}) AS std, "
    f"CAST(min({c}) AS DOUBLE) AS min, quantile_cont({c}, 0.25) AS p25, quantile_cont({c}, 0.5) AS p50, "
    f"quantile_cont({c}, 0.75) AS p75, CAST(max({c}) AS DOUBLE) AS max FROM ({MATRIX_SQL})" for c in MATRIX_COLS]))
def q_describe(spark, sf_dir):
    """Count, mean, std, min, exact quartiles, max of each numeric feature."""
    return S.describe(matrix(spark, sf_dir), MATRIX_COLS)


INV_COLS = ["id", "created", "updated", "resolutiondate", "priority_name", "inward_count"]


@register("A31_column_inventory", with_issues(_union([
    f"SELECT repository, '{c}' AS \"column\", max(CAST({c} IS NOT NULL AS INTEGER)) AS present, "
    f"'{fam}' AS family FROM itl GROUP BY repository"
    for c, fam in zip(INV_COLS, ["other", "other", "temporal", "temporal", "priority", "dependency"])]),
    ISSUES_TL))
def q_column_inventory(spark, sf_dir):
    """Which columns hold data in which repository, with the name family of each column."""
    d = issues_tl(spark, sf_dir).select("repository", *INV_COLS)
    return S.column_inventory(d, "repository")


@register("C8_feature_subsets", with_issues("""
SELECT project_id, total_issues, project_duration_days
FROM (SELECT project_id, count(*) AS total_issues,
  avg(CAST(coalesce(created_day_of_week >= 5, false) AS DOUBLE)) * 100.0 AS pct_issues_created_on_weekend,
  CASE WHEN sum(is_resolved) > 0 THEN sum(CAST(resolutiondate IS NOT NULL AND coalesce(resolved_day_of_week >= 5, false)
    AS BIGINT)) / sum(CAST(resolutiondate IS NOT NULL AS BIGINT)) * 100.0 END AS pct_issues_resolved_on_weekend,
  CAST(floor(date_diff('microsecond', min(created), greatest(max(resolutiondate), max(updated))) / 1e6 / 86400.0) AS BIGINT)
    AS project_duration_days
  FROM it GROUP BY project_id)"""))
def q_feature_subsets(spark, sf_dir):
    """The temporal subset (core + temporal family) of a project table."""
    from ..operators.project import project_span, weekend_share

    it = issues_t(spark, sf_dir)
    pf = project_span(it, name_cols=[]).join(weekend_share(it), "project_id")
    pf = pf.select("project_id", "total_issues", "pct_issues_created_on_weekend", "pct_issues_resolved_on_weekend",
                   "project_duration_days", "project_start_date")
    return S.feature_subsets(pf.drop("project_start_date"))["temporal"]
