"""Project roll-up queries and their DuckDB oracles."""

from __future__ import annotations

from ..functions.names import space_safe
from ..operators import project as P
from .catalog import register
from .sqlbase import ISSUES_T, ISSUES_TL, days, with_issues
from .standin import PRIORITIES, SEGMENTS, STANDIN_DERIVED, issues_t, issues_tl

H = "resolution_time_hours"


def _qi(name: str) -> str:
    return '"' + name + '"'


# ---- SQL pieces mirroring the aggregate/post split of operators.project ----

SPAN_AGG = """min(project_name) AS project_name, count(*) AS total_issues, min(created) AS project_start_date,
  max(resolutiondate) AS project_latest_resolved_date, max(updated) AS project_latest_update_date"""
SPAN_POST = ("CAST(floor(" + days("project_start_date",
                                  "greatest(project_latest_resolved_date, project_latest_update_date)")
             + ") AS BIGINT) AS project_duration_days")

RES_AGG = f"""avg({H}) AS avg_resolution_hours, min({H}) AS min_resolution_hours, max({H}) AS max_resolution_hours,
  stddev_samp({H}) AS resolution_hours_std, sum({H}) AS total_resolution_hours,
  CASE WHEN count({H}) > 2 THEN avg(power(({H} - _m) / _sp, 3)) END AS resolution_time_skewness,
  CASE WHEN count({H}) > 2 THEN avg(power(({H} - _m) / _sp, 4)) - 3 END AS resolution_time_kurtosis,
  quantile_cont({H}, 0.5) AS median_resolution_hours, quantile_cont({H}, 0.25) AS _p25,
  quantile_cont({H}, 0.75) AS _p75, quantile_cont({H}, 0.9) AS _p90,
  avg(CASE WHEN {H} IS NOT NULL THEN CAST({H} <= 24 AS DOUBLE) END) AS _w24,
  avg(CASE WHEN {H} IS NOT NULL THEN CAST({H} <= 168 AS DOUBLE) END) AS _w168,
  avg(CASE WHEN {H} IS NOT NULL THEN CAST({H} <= 720 AS DOUBLE) END) AS _w720"""
RES_POST = """_p25 AS resolution_time_p25, _p75 AS resolution_time_p75, _p90 AS resolution_time_p90,
  _p75 - _p25 AS resolution_time_iqr, _w24 * 100.0 AS pct_resolved_within_24h,
  _w168 * 100.0 AS pct_resolved_within_week, _w720 * 100.0 AS pct_resolved_within_month"""
RES_MOMENTS = f"""mo AS (SELECT project_id AS _pid, avg({H}) AS _m, stddev_pop({H}) AS _sp FROM {{src}} GROUP BY project_id)"""

WE_AGG = """avg(CAST(coalesce(created_day_of_week >= 5, false) AS DOUBLE)) * 100.0 AS pct_issues_created_on_weekend,
  sum(CAST(resolutiondate IS NOT NULL AND coalesce(resolved_day_of_week >= 5, false) AS BIGINT)) AS _res_we,
  sum(CAST(resolutiondate IS NOT NULL AS BIGINT)) AS _res_n"""
WE_POST = "CASE WHEN _res_n > 0 THEN _res_we / _res_n * 100.0 END AS pct_issues_resolved_on_weekend"

DROP_TMP = "EXCLUDE (_p25, _p75, _p90, _w24, _w168, _w720, _res_we, _res_n)"


def _prio_agg() -> str:
    parts = ["count(priority_name) AS _prio_n"]
    for v in PRIORITIES:
        c = f"count(CASE WHEN priority_name = '{v}' THEN 1 END)"
        parts.append(f"CASE WHEN {c} > 0 THEN {c} END AS {_qi(f'priority_{space_safe(v)}_count')}")
    return ",\n  ".join(parts)


def _prio_post(den: str = "_prio_n") -> str:
    return ",\n  ".join(f"{_qi(f'priority_{space_safe(v)}_count')} / {den} * 100.0 AS {_qi(f'priority_{space_safe(v)}_pct')}"
                        for v in PRIORITIES)


def _type_agg() -> str:
    parts = []
    for v in SEGMENTS:
        c = f"count(CASE WHEN issue_type = '{v}' THEN 1 END)"
        parts.append(f"CASE WHEN {c} > 0 THEN {c} END AS {_qi(f'type_{space_safe(v)}_count')}")
    return ",\n  ".join(parts)


def _type_post() -> str:
    return ",\n  ".join(f"{_qi(f'type_{space_safe(v)}_count')} / total_issues * 100.0 AS {_qi(f'type_{space_safe(v)}_pct')}"
                        for v in SEGMENTS)


def _matrix_agg() -> str:
    parts = []
    for p in PRIORITIES:
        for t in SEGMENTS:
            m = f"resolutiondate IS NOT NULL AND priority_name = '{p}' AND issue_type = '{t}'"
            pre = f"priority_{space_safe(p)}_type_{space_safe(t)}"
            c = f"count(CASE WHEN {m} THEN 1 END)"
            parts.append(f"CASE WHEN {c} > 0 THEN {c} END AS {_qi(pre + '_count')}")
            parts.append(f"avg(CASE WHEN {m} THEN {H} END) AS {_qi(pre + '_avg_resolution_hours')}")
    return ",\n  ".join(parts)


def _eff_agg() -> str:
    parts = ["CAST(sum(is_resolved) AS BIGINT) AS num_resolved_issues"]
    for t in SEGMENTS:
        parts.append(f"avg(CASE WHEN issue_type = '{t}' THEN CAST(is_resolved AS DOUBLE) END) * 100.0 "
                     f"AS {_qi(f'type_{space_safe(t)}_resolution_rate')}")
    return ",\n  ".join(parts)


EFF_POST = """coalesce(CASE WHEN total_issues <> 0 THEN num_resolved_issues * 100.0 / total_issues END, 0.0) AS pct_resolved_issues,
  coalesce(CASE WHEN project_duration_days > 0 THEN num_resolved_issues / project_duration_days END, 0.0) AS resolution_rate_per_day"""

MONTHLY = """mm AS (SELECT project_id, year(created) AS _y, month(created) AS _mo, count(*) AS _n
            FROM {src} WHERE created IS NOT NULL GROUP BY project_id, year(created), month(created)),
ma AS (SELECT project_id, max(_n) AS max_issues_per_month, avg(_n) AS avg_issues_per_month,
              count(*) AS months_with_activity,
              CASE WHEN count(*) > 1 THEN stddev_samp(_n) / avg(_n) END AS issue_creation_volatility
       FROM mm GROUP BY project_id)"""

DEPS = """thr AS (SELECT project_id, quantile_cont(inward_count, 0.75) AS _p75i FROM itl GROUP BY project_id),
dep AS (SELECT itl.project_id, avg(inward_count) AS avg_inward_links, avg(outward_count) AS avg_outward_links,
               avg(inward_count + outward_count) AS avg_total_links,
               sum(inward_count) AS total_inward_links, sum(outward_count) AS total_outward_links,
               avg(CAST(coalesce(inward_count > _p75i, false) AS DOUBLE)) * 100.0 AS pct_issues_with_high_dependencies,
               count(*) AS _n
        FROM itl JOIN thr ON itl.project_id = thr.project_id GROUP BY itl.project_id),
depf AS (SELECT project_id, avg_inward_links, avg_outward_links, avg_total_links,
                CAST(total_inward_links AS BIGINT) AS total_inward_links,
                CAST(total_outward_links AS BIGINT) AS total_outward_links, pct_issues_with_high_dependencies,
                CAST(total_inward_links + total_outward_links AS BIGINT) AS total_links,
                CASE WHEN _n <> 0 THEN (total_inward_links + total_outward_links) / _n ELSE 0.0 END AS link_density
         FROM dep)"""


# ---------------------------------------------------------------------------

def project_overview_sql() -> str:
    body = f""",
{RES_MOMENTS.format(src='it')},
agg AS (SELECT project_id, {SPAN_AGG}, {RES_AGG}, {WE_AGG}
        FROM it JOIN mo ON it.project_id = mo._pid GROUP BY project_id)
SELECT * {DROP_TMP}, {SPAN_POST}, {RES_POST}, {WE_POST} FROM agg"""
    return with_issues(body)


@register("A6_A7_A8_project_overview", project_overview_sql())
def q_project_overview(spark, sf_dir):
    """Flagship: A6 span + A7 resolution statistics + A8 weekend share, one row per project."""
    return P.project_overview(issues_t(spark, sf_dir))


@register("A6_project_span", with_issues(f"""
SELECT *, {SPAN_POST} FROM (SELECT project_id, {SPAN_AGG} FROM it GROUP BY project_id)"""))
def q_project_span(spark, sf_dir):
    """Project span (count, first/last dates, floor-day duration)."""
    return P.project_span(issues_t(spark, sf_dir))


@register("A7_resolution_stats", with_issues(f""",
{RES_MOMENTS.format(src='it')}
SELECT * EXCLUDE (_p25, _p75, _p90, _w24, _w168, _w720), {RES_POST} FROM (
  SELECT project_id, {RES_AGG} FROM it JOIN mo ON it.project_id = mo._pid GROUP BY project_id)"""))
def q_resolution_stats(spark, sf_dir):
    """Resolution-hour statistics of resolved issues per project."""
    return P.resolution_stats(issues_t(spark, sf_dir))


@register("A8_weekend_share", with_issues(f"""
SELECT * EXCLUDE (_res_we, _res_n), {WE_POST} FROM (SELECT project_id, {WE_AGG} FROM it GROUP BY project_id)"""))
def q_weekend_share(spark, sf_dir):
    """Weekend creation / resolution shares per project."""
    return P.weekend_share(issues_t(spark, sf_dir))


@register("A9_monthly_activity", with_issues(",\n" + MONTHLY.format(src="it") + "\nSELECT * FROM ma"))
def q_monthly_activity(spark, sf_dir):
    """Monthly creation counts -> max, mean, months, volatility per project."""
    return P.monthly_activity(issues_t(spark, sf_dir))


@register("A10_priority_mix", with_issues(f"""
SELECT * EXCLUDE (_prio_n, total_issues), {_prio_post()} FROM (
  SELECT project_id, count(*) AS total_issues, {_prio_agg()} FROM it GROUP BY project_id)"""))
def q_priority_mix(spark, sf_dir):
    """A10: count and share of each priority per project (dynamic columns)."""
    return P.priority_mix(issues_t(spark, sf_dir))


@register("A10_priority_mix_compat", with_issues(f"""
SELECT * EXCLUDE (_prio_n, total_issues), {_prio_post('total_issues')} FROM (
  SELECT project_id, count(*) AS total_issues, {_prio_agg()} FROM it GROUP BY project_id)"""))
def q_priority_mix_compat(spark, sf_dir):
    """A10 with ``compat=True``: shares over all issues, as the second pass of the reference does."""
    return P.priority_mix(issues_t(spark, sf_dir), compat=True)


@register("A11_type_mix", with_issues(f"""
SELECT * EXCLUDE (total_issues), {_type_post()} FROM (
  SELECT project_id, count(*) AS total_issues, {_type_agg()} FROM it GROUP BY project_id)"""))
def q_type_mix(spark, sf_dir):
    """Count and share of each issue type per project."""
    return P.type_mix(issues_t(spark, sf_dir))


@register("A12_priority_type_matrix", with_issues(f"""
SELECT project_id, {_matrix_agg()} FROM it GROUP BY project_id"""))
def q_priority_type_matrix(spark, sf_dir):
    """Per (priority, type) resolved count and mean hours per project."""
    return P.priority_type_matrix(issues_t(spark, sf_dir))


@register("A13_dependency_stats", with_issues(",\n" + DEPS + "\nSELECT * FROM depf", ISSUES_TL))
def q_dependency_stats(spark, sf_dir):
    """Link statistics and share above the project's own inward p75."""
    return P.dependency_stats(issues_tl(spark, sf_dir))


@register("A14_resolution_efficiency", with_issues(f"""
SELECT project_id, num_resolved_issues, {EFF_POST}, {', '.join(_qi(f'type_{space_safe(t)}_resolution_rate') for t in SEGMENTS)}
FROM (SELECT *, {SPAN_POST} FROM (
  SELECT project_id, count(*) AS total_issues, min(created) AS project_start_date,
         max(resolutiondate) AS project_latest_resolved_date, max(updated) AS project_latest_update_date,
         {_eff_agg()}
  FROM it GROUP BY project_id))"""))
def q_resolution_efficiency(spark, sf_dir):
    """Resolved count/share, resolved per day, per-type resolution rate."""
    return P.resolution_efficiency(issues_t(spark, sf_dir))


def _derived_sql(src: str) -> str:
    """A15 over the composed project table, stand-in token mapping (see STANDIN_DERIVED)."""
    d = STANDIN_DERIVED
    def fam(tokens):
        return [f"priority_{t}_count" for t in tokens]
    def rsum(cols):
        return " + ".join(f"coalesce(CAST({_qi(c)} AS DOUBLE), 0.0)" for c in cols)
    hs, ls = rsum(fam(d["high_tokens"])), rsum(fam(d["low_tokens"]))
    bug = rsum([f"type_{d['bug_token']}_count"])
    wsum = " + ".join(f"coalesce(CAST({_qi(f'priority_{t}_count')} AS DOUBLE), 0.0) * {float(w)}"
                      for t, w in d["weights"].items())
    pcts = [f"type_{space_safe(t)}_pct" for t in SEGMENTS]
    ent = " + ".join(f"CASE WHEN {_qi(c)} / 100.0 > 0 THEN ({_qi(c)} / 100.0) * (ln({_qi(c)} / 100.0) / ln(2)) ELSE 0.0 END"
                     for c in pcts)
    return f"""SELECT *,
  CASE WHEN project_duration_days * total_issues > 0
       THEN num_resolved_issues * 7.0 / (project_duration_days * total_issues) ELSE 0.0 END AS weekly_efficiency_ratio,
  avg_resolution_hours * (avg_total_links + 1) AS complexity_weighted_resolution_time,
  CASE WHEN ({ls}) > 0 THEN ({hs}) / ({ls}) ELSE ({hs}) END AS high_to_low_priority_ratio,
  ({bug}) / total_issues AS bug_ratio,
  CASE WHEN avg_issues_per_month / 30.0 > 0 THEN resolution_rate_per_day / (avg_issues_per_month / 30.0) ELSE 0.0 END
    AS creation_resolution_balance,
  ({wsum}) / total_issues AS weighted_priority_score,
  -(0.0 + {ent}) AS issue_type_entropy,
  num_resolved_issues / months_with_activity AS monthly_velocity
FROM {src}"""


def project_features_sql() -> str:
    body = f""",
{RES_MOMENTS.format(src='itl')},
{MONTHLY.format(src='itl')},
{DEPS},
agg AS (SELECT project_id, {SPAN_AGG}, {RES_AGG}, {WE_AGG}, {_prio_agg()}, {_type_agg()}, {_matrix_agg()}, {_eff_agg()}
        FROM itl JOIN mo ON itl.project_id = mo._pid GROUP BY project_id),
p1 AS (SELECT * {DROP_TMP}, {SPAN_POST}, {RES_POST}, {WE_POST}, {_prio_post()}, {_type_post()} FROM agg),
p2 AS (SELECT * EXCLUDE (_prio_n), {EFF_POST} FROM p1),
pf AS (SELECT p2.*, ma.* EXCLUDE (project_id), depf.* EXCLUDE (project_id)
       FROM p2 LEFT JOIN ma ON p2.project_id = ma.project_id LEFT JOIN depf ON p2.project_id = depf.project_id)
{_derived_sql('pf')}"""
    return with_issues(body, ISSUES_TL)


@register("A15_project_features", project_features_sql())
def q_project_features(spark, sf_dir):
    """The full project feature table with derived features (stand-in priority families)."""
    return P.project_features(issues_tl(spark, sf_dir), derived_kwargs=STANDIN_DERIVED)
