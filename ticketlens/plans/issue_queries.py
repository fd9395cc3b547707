"""Per-issue scalar functions and predicates over the issue stand-ins."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..functions import dates as D
from ..functions import derive as V
from ..operators import columns as C
from ..operators import nested as N
from ..sources import tables as T
from .catalog import register
from .sqlbase import ISSUES, ISSUES_T, ISSUES_TL, days, hours, with_issues
from .standin import PRIORITIES, SEGMENTS, issues_t, issues_tl

AS_OF = dt.datetime(2002, 1, 1)
ISO = "'%Y-%m-%dT%H:%M:%S.%g+0000'"


def flat_docs(spark, sf_dir):
    return N.drop_list_columns(N.flatten_struct(T.issue_documents(spark, sf_dir)))


@register("F2_F3_parse_dates", with_issues("""
SELECT CAST(id AS VARCHAR) AS id, created AS created_ts, updated AS updated_ts, resolutiondate AS resolved_ts FROM issues""",
                                           ISSUES))
def q_parse_dates(spark, sf_dir):
    """F2 + F3: date text cleaned ('Missing'/blank -> null) and parsed to UTC timestamps."""
    d = flat_docs(spark, sf_dir)
    d = D.to_utc_timestamp(d, ["fields.created", "fields.updated", "fields.resolutiondate", "fields.absent"])
    return d.select("id", D.to_utc_ntz(F.col("`fields.created`")).alias("created_ts"),
                    D.to_utc_ntz(F.col("`fields.updated`")).alias("updated_ts"),
                    D.to_utc_ntz(F.col("`fields.resolutiondate`")).alias("resolved_ts"))


@register("F4_drop_invalid_dates", with_issues("""
SELECT id, created, updated, resolutiondate FROM issues
WHERE created IS NOT NULL AND updated IS NOT NULL AND resolutiondate IS NOT NULL""", ISSUES))
def q_drop_invalid_dates(spark, sf_dir):
    """drop issues where any of the date columns is null."""
    d = T.issues(spark, sf_dir).select("id", "created", "updated", "resolutiondate")
    return D.drop_invalid_dates(d, ["created", "updated", "resolutiondate"])


@register("F5_alias_columns", with_issues("""
SELECT CAST(id AS VARCHAR) AS id, priority_name, issue_type, status FROM issues""", ISSUES))
def q_alias_columns(spark, sf_dir):
    """copy dotted source fields to short names when present."""
    d = V.alias_columns(flat_docs(spark, sf_dir))
    return d.select("id", "priority_name", "issue_type", "status")


STATUS_TEXT = {"F": "Done", "O": "Open", "P": "Unresolved"}


@register("F6_is_completed", with_issues("""
SELECT id, CASE status WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Unresolved' END AS status_text,
  CAST(coalesce(regexp_matches(CASE status WHEN 'F' THEN 'Done' WHEN 'O' THEN 'Open' WHEN 'P' THEN 'Unresolved' END,
    '(?i)(Done|Closed|Resolved|Complete|Completed|Fixed|Finished|Released|Delivered|Verified)'), false) AS INTEGER)
    AS is_completed FROM issues""", ISSUES))
def q_is_completed(spark, sf_dir):
    """completed flag by case-insensitive substring over the status text (F->Done, O->Open, P->Unresolved)."""
    m = F.create_map(*[x for k, v in STATUS_TEXT.items() for x in (F.lit(k), F.lit(v))])
    d = T.issues(spark, sf_dir).select("id", m[F.col("status")].alias("status_text"))
    return d.withColumn("is_completed", V.is_completed("status_text"))


@register("F7_one_hot_values", with_issues("SELECT id, " + ", ".join(
    f"CAST(coalesce(priority_name = '{v}', false) AS INTEGER) AS \"priority_{v.lower().replace(' ', '_').replace('-', '_')}\""
    for v in PRIORITIES) + " FROM issues", ISSUES))
def q_one_hot_values(spark, sf_dir):
    """one 0/1 column per distinct priority (safe lower-case names)."""
    d = T.issues(spark, sf_dir).select("id", "priority_name")
    return C.one_hot_values(d, "priority_name", "priority_").drop("priority_name")


@register("F8_one_hot_fixed", with_issues("SELECT CAST(id AS VARCHAR) AS id, " + ", ".join(
    [f"CAST(coalesce(lower(issue_type) = '{t.lower()}', false) AS DOUBLE) AS \"is_type_{t.lower().replace(' ', '_')}\""
     for t in C.FIXED_TYPES]
    + [f"CAST(coalesce(contains(lower(priority_name), '{p.lower()}'), false) AS DOUBLE) AS \"is_priority_{p.lower()}\""
       for p in C.FIXED_PRIORITIES]) + " FROM issues", ISSUES))
def q_one_hot_fixed(spark, sf_dir):
    """F8: fixed issue-type (equality) and priority (substring) dummies as double."""
    d = C.one_hot_fixed(flat_docs(spark, sf_dir))
    return d.select("id", *[c for c in d.columns if c.startswith("is_")])


@register("F9_get_dummies", with_issues("SELECT id, " + ", ".join(
    [f"CAST(coalesce(status = '{s}', false) AS INTEGER) AS \"status_{s}\"" for s in ["O", "P"]]
    + [f"CAST(coalesce(issue_type = '{t}', false) AS INTEGER) AS \"issue_type_{t}\"" for t in SEGMENTS[1:]])
    + " FROM issues", ISSUES))
def q_get_dummies(spark, sf_dir):
    """k-1 one-hot encoding of the string columns (first sorted level dropped)."""
    d = T.issues(spark, sf_dir).select("id", "status", "issue_type")
    return C.get_dummies(d, ["status", "issue_type"])


@register("F10_F13_issue_times", with_issues(f"""
SELECT id, resolution_time_hours, resolution_time_days, is_resolved,
  {days('created', "TIMESTAMP '2002-01-01 00:00:00'")} AS age_days FROM it"""))
def q_issue_times(spark, sf_dir):
    """Resolution days (negative -> null) and hours (negatives kept), resolved flag, age at a fixed date."""
    d = D.issue_time_features(T.issues(spark, sf_dir), as_of=AS_OF)
    return d.select("id", "resolution_time_hours", "resolution_time_days", "is_resolved", "age_days")


@register("F14_estimation_ratio", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN l_quantity > 0 AND l_discount * 100 > 0 THEN (l_discount * 100) / l_quantity END AS estimation_ratio
FROM lineitem""")
def q_estimation_ratio(spark, sf_dir):
    """spent / original estimate when both are positive (stand-in: discount points over quantity)."""
    li = T.read_table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", "l_linenumber",
                     V.estimation_ratio("l_quantity", F.col("l_discount") * 100).alias("estimation_ratio"))


@register("F15_calendar_parts", """
SELECT event_id, CAST(isodow(ts) - 1 AS INTEGER) AS created_day_of_week, CAST(hour(ts) AS INTEGER) AS created_hour,
  CAST(month(ts) AS INTEGER) AS created_month, CAST(year(ts) AS INTEGER) AS created_year,
  CAST(isodow(ts) - 1 >= 5 AS INTEGER) AS created_on_weekend FROM events""")
def q_calendar_parts(spark, sf_dir):
    """Monday=0 weekday, hour, month, year and weekend flag of event timestamps."""
    ev = T.read_table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("created"))
    return D.calendar_parts(ev, "created", "no_resolved").drop("created")


@register("F16_F18_target", with_issues(f"""
SELECT id, least(resolution_time_hours, 4320.0) AS resolution_time_hours,
  ln(1 + greatest(coalesce(least(resolution_time_hours, 4320.0), 0.0), 0.0)) AS log_resolution_hours
FROM it WHERE resolution_time_hours IS NOT NULL AND resolution_time_hours >= 0 AND resolution_time_hours <= 10000"""))
def q_target(spark, sf_dir):
    """Filter the target to [0, 10000], cap at 4320 h, log1p target recomputed."""
    d = issues_t(spark, sf_dir).select("id", "resolution_time_hours")
    d = V.filter_target(d, "resolution_time_hours", 0.0, 10000.0)
    return V.cap_target(d, "resolution_time_hours", log_col="log_resolution_hours")


SPARSE_SQL = """SELECT CAST(d.doc_id AS VARCHAR) AS doc_id, d.lang, d.source, CAST(d.n_chars AS VARCHAR) AS n_chars,
  CAST(l.quality AS VARCHAR) AS quality, CAST(l.toxic AS VARCHAR) AS toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"""


def sparse_text(spark, sf_dir):
    """documents ⟕ labels with every column as text (a CSV read without a schema)."""
    d = T.read_table(spark, sf_dir, "documents")
    lab = T.read_table(spark, sf_dir, "labels")
    j = d.join(lab, "doc_id", "left")
    return j.select(*[F.col(c).cast("string").alias(c) for c in ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]])


@register("F1_type_report", "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", avg(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) AS numeric_share, "
    f"CASE WHEN avg(CASE WHEN TRY_CAST({c} AS DOUBLE) IS NOT NULL THEN 1.0 ELSE 0.0 END) >= 0.9 THEN 'double' ELSE 'string' END "
    f"AS inferred_type FROM ({SPARSE_SQL})" for c in ["doc_id", "lang", "source", "n_chars", "quality", "toxic"]))
def q_type_report(spark, sf_dir):
    """F1: share of all rows that parse as numbers per text column and the type chosen (>= 0.9 -> double)."""
    from ..operators.stats import _long_stats

    d = sparse_text(spark, sf_dir)
    rep = _long_stats(d, d.columns, {"numeric_share": lambda c: F.avg(
        C.q(c).try_cast("double").isNotNull().cast("double"))})
    typed = C.infer_types(d)
    kinds = F.create_map(*[x for f in typed.schema.fields for x in (F.lit(f.name), F.lit(f.dataType.simpleString()))])
    return rep.withColumn("inferred_type", kinds[F.col("column")])


@register("F19_coerce_numeric", f"""
SELECT TRY_CAST(doc_id AS DOUBLE) AS doc_id, TRY_CAST(lang AS DOUBLE) AS lang, TRY_CAST(source AS DOUBLE) AS source,
  TRY_CAST(n_chars AS DOUBLE) AS n_chars, TRY_CAST(quality AS DOUBLE) AS quality, TRY_CAST(toxic AS DOUBLE) AS toxic
FROM ({SPARSE_SQL})""")
def q_coerce_numeric(spark, sf_dir):
    """every column cast to double with failures -> null."""
    return C.coerce_numeric(sparse_text(spark, sf_dir))


@register("F20_bool_to_int", """
SELECT doc_id, CAST(quality = 1 AS INTEGER) AS is_quality, CAST(toxic = 1 AS INTEGER) AS is_toxic FROM labels""")
def q_bool_to_int(spark, sf_dir):
    """boolean columns cast to int."""
    lab = T.read_table(spark, sf_dir, "labels")
    return C.bool_to_int(lab.select("doc_id", (F.col("quality") == 1).alias("is_quality"),
                                    (F.col("toxic") == 1).alias("is_toxic")))


@register("F21_inf_to_null", """
SELECT l_orderkey, l_linenumber,
  CASE WHEN isinf(power(l_quantity, 200.0)) OR isnan(power(l_quantity, 200.0)) THEN NULL ELSE power(l_quantity, 200.0) END AS growth
FROM lineitem""")
def q_inf_to_null(spark, sf_dir):
    """non-finite values (overflowing powers here) become null."""
    li = T.read_table(spark, sf_dir, "lineitem")
    d = li.select("l_orderkey", "l_linenumber", F.pow("l_quantity", 200.0).alias("growth"))
    return C.inf_to_null(d)


@register("F22_clip_negative", with_issues("""
SELECT id, greatest(resolution_time_hours, 0) AS resolution_time_hours, greatest(inward_count, 0) AS inward_count,
  resolution_time_days FROM itl""", ISSUES_TL))
def q_clip_negative(spark, sf_dir):
    """negatives -> 0 in count/hours/duration columns."""
    d = issues_tl(spark, sf_dir).select("id", "resolution_time_hours", "inward_count", "resolution_time_days")
    return C.clip_negative(d)


@register("F23_clean_names", with_issues("""
SELECT CAST(id AS VARCHAR) AS id, issue_type AS "issuetype.name", priority_name AS "priority.name",
  project_name AS "project.name" FROM issues""", ISSUES))
def q_clean_names(spark, sf_dir):
    """strip the ``fields.`` prefix and clean bracket characters from column names."""
    d = flat_docs(spark, sf_dir).select("id", "`fields.issuetype.name`", "`fields.priority.name`", "`fields.project.name`")
    return C.clean_names(d)


@register("F24_drop_identifier_columns", with_issues("""
SELECT id, created, updated, resolutiondate, issue_type, status, creator, assignee FROM issues""", ISSUES))
def q_drop_identifier_columns(spark, sf_dir):
    """drop non-numeric columns whose names mark identifiers (key, project, name, repository ...)."""
    return C.drop_identifier_columns(T.issues(spark, sf_dir).drop("project_id"))


@register("F26_rule_effort_range", with_issues("""
SELECT id, b * p * c * 0.7 AS min_hours, b * p * c AS typical_hours, b * p * c * 1.5 AS max_hours, b * p * c / 8.0 AS work_days
FROM (SELECT id,
  CAST(CASE lower(issue_type) WHEN 'bug' THEN 8.0 WHEN 'feature' THEN 24.0 WHEN 'improvement' THEN 16.0 ELSE 12.0 END AS DOUBLE) AS b,
  CAST(CASE lower(priority_name) WHEN 'critical' THEN 0.8 WHEN 'high' THEN 0.9 WHEN 'low' THEN 1.2 ELSE 1.0 END AS DOUBLE) AS p,
  CAST(CASE lower(CASE WHEN inward_count + outward_count > 5 THEN 'High' WHEN inward_count + outward_count < 2 THEN 'Low'
       ELSE 'Medium' END) WHEN 'high' THEN 2.0 WHEN 'low' THEN 0.5 ELSE 1.0 END AS DOUBLE) AS c FROM itl)""", ISSUES_TL))
def q_rule_effort_range(spark, sf_dir):
    """rule-based effort range per issue (complexity from link count: >5 High, <2 Low)."""
    d = issues_tl(spark, sf_dir)
    n = F.col("inward_count") + F.col("outward_count")
    cx = F.when(n > 5, "High").when(n < 2, "Low").otherwise("Medium")
    return d.select("id", V.rule_effort_range("issue_type", "priority_name", cx).alias("r")).select("id", "r.*")


TASK_FEATURES = ["inward_count", "outward_count", "age_days", "created_month", "created_year", "is_resolved"]


def task_table_sql() -> str:
    return f""",
task AS (SELECT *, {days('created', "TIMESTAMP '2002-01-01 00:00:00'")} AS age_days FROM itl)"""


@register("F27_feature_group", with_issues(task_table_sql() + "\n" + "\nUNION ALL\n".join(
    f"SELECT '{f}' AS feature, corr(CAST({f} AS DOUBLE), resolution_time_hours) AS corr, CASE "
    + " ".join(f"WHEN '{f}' IN ({', '.join(repr(n) for n in names)}) THEN '{label}'" for label, names in V.FEATURE_GROUPS)
    + " ELSE 'Other' END AS category FROM task" for f in TASK_FEATURES), ISSUES_TL))
def q_feature_group(spark, sf_dir):
    """correlation of task features with resolution hours, each feature tagged with its category."""
    from ..operators.stats import target_corr

    d = issues_tl(spark, sf_dir).withColumn("age_days", D.age_days("created", AS_OF))
    corr = target_corr(d, "resolution_time_hours", TASK_FEATURES).drop("abs_corr")
    return corr.withColumn("category", V.feature_group("feature"))
