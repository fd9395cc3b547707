"""Shared DuckDB SQL fragments for the oracle side (FIXTURES.md §2 canonical view)."""

# The stand-in issue view, one row per order (matches sources.tables.issues).
ISSUES = """
l AS (
  SELECT l_orderkey, max(l_shipdate) AS last_ship, min(l_suppkey) AS assignee
  FROM lineitem GROUP BY l_orderkey),
issues AS (
  SELECT o.o_orderkey AS id, 'ORD-' || CAST(o.o_orderkey AS VARCHAR) AS key,
         r.r_name AS repository, n.n_nationkey AS project_id, n.n_name AS project_name,
         o.o_orderdate AS created, l.last_ship AS updated,
         CASE WHEN o.o_orderstatus = 'F' THEN l.last_ship END AS resolutiondate,
         c.c_mktsegment AS issue_type, o.o_orderpriority AS priority_name, o.o_orderstatus AS status,
         o.o_custkey AS creator, l.assignee
  FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
  JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
  LEFT JOIN l ON l.l_orderkey = o.o_orderkey)"""

# Link-direction counts per issue (N8 over the flat link table).
LINKCOUNTS = """
lc AS (
  SELECT l_orderkey AS id,
         CAST(sum(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS inward_count,
         CAST(sum(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS BIGINT) AS outward_count
  FROM lineitem GROUP BY l_orderkey)"""


def hours(a: str, b: str) -> str:
    """(b - a) in hours, same arithmetic as functions.dates.hours_between."""
    return f"(date_diff('microsecond', {a}, {b}) / 1e6 / 3600.0)"


def days(a: str, b: str) -> str:
    return f"(date_diff('microsecond', {a}, {b}) / 1e6 / 86400.0)"


# Issue view with the derived per-issue time features.
ISSUES_T = ISSUES + f""",
it AS (
  SELECT *,
    CASE WHEN resolutiondate IS NOT NULL THEN {hours('created', 'resolutiondate')} END AS resolution_time_hours,
    CASE WHEN resolutiondate IS NOT NULL AND {days('created', 'resolutiondate')} >= 0
         THEN {days('created', 'resolutiondate')} END AS resolution_time_days,
    CAST(resolutiondate IS NOT NULL AS INTEGER) AS is_resolved,
    CAST(isodow(created) - 1 AS INTEGER) AS created_day_of_week, CAST(hour(created) AS INTEGER) AS created_hour,
    CAST(month(created) AS INTEGER) AS created_month, CAST(year(created) AS INTEGER) AS created_year,
    CAST(isodow(resolutiondate) - 1 AS INTEGER) AS resolved_day_of_week,
    CAST(hour(resolutiondate) AS INTEGER) AS resolved_hour
  FROM issues)"""

ISSUES_TL = ISSUES_T + "," + LINKCOUNTS + """,
itl AS (
  SELECT it.*, coalesce(lc.inward_count, 0) AS inward_count, coalesce(lc.outward_count, 0) AS outward_count
  FROM it LEFT JOIN lc ON it.id = lc.id)"""


def with_issues(body: str, base: str = ISSUES_T) -> str:
    return f"WITH {base}\n{body}"
