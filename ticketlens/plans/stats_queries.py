"""Statistics, team, ranking and sampling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.names import distinct_values
from ..operators import sampling as W
from ..operators import stats as S
from ..operators import team as TM
from ..operators.project import project_overview
from ..sources import tables as T
from .catalog import register
from .columns_queries import MATRIX_COLS, MATRIX_SQL, matrix
from .sqlbase import ISSUES, ISSUES_T, ISSUES_TL, with_issues
from .standin import issues_t, issues_tl

BUG, FEAT = "MACHINERY", "BUILDING"   # stand-in spelling of the bug and feature issue types


def _u(parts):
    return "\nUNION ALL\n".join(parts)


# ---- A16-A19 team --------------------------------------------------------------

GINI_SQL = """cc AS (SELECT project_id, creator, count(*) AS n FROM it WHERE creator IS NOT NULL GROUP BY project_id, creator),
gr AS (SELECT project_id, n + 1e-7 AS x, row_number() OVER (PARTITION BY project_id ORDER BY n) AS i,
              count(*) OVER (PARTITION BY project_id) AS cnt FROM cc),
g AS (SELECT project_id, sum((2 * i - cnt - 1) * x) / (max(cnt) * sum(x)) AS gini FROM gr GROUP BY project_id)"""


@register("A16_gini", with_issues(",\n" + GINI_SQL + "\nSELECT * FROM g"))
def q_gini(spark, sf_dir):
    """Gini index of issues per creator within each project."""
    cc = issues_t(spark, sf_dir).groupBy("project_id", "creator").agg(F.count(F.lit(1)).alias("n"))
    return S.gini(cc, "n", ["project_id"])


TEAM_SQL = with_issues(",\n" + GINI_SQL + f""",
pc AS (SELECT project_id, creator, count(*) AS n, count(DISTINCT issue_type) AS types,
         count(CASE WHEN issue_type = '{BUG}' THEN 1 END) AS bug, count(CASE WHEN issue_type = '{FEAT}' THEN 1 END) AS feat
       FROM it WHERE creator IS NOT NULL GROUP BY project_id, creator),
ca AS (SELECT project_id, count(*) AS tsc, avg(n) AS avg_n, max(n) AS max_n, var_samp(n) AS var_n, stddev_samp(n) AS std_n,
         avg(types) AS div, max(bug) AS bug_max, sum(bug) AS bug_rows, count(CASE WHEN bug > 0 THEN 1 END) AS bug_c,
         sum(feat) AS feat_rows, count(CASE WHEN feat > 0 THEN 1 END) AS feat_c FROM pc GROUP BY project_id),
pa AS (SELECT project_id, assignee, count(CASE WHEN issue_type = '{BUG}' THEN 1 END) AS bug,
         count(CASE WHEN issue_type = '{FEAT}' THEN 1 END) AS feat FROM it WHERE assignee IS NOT NULL GROUP BY project_id, assignee),
aa AS (SELECT project_id, count(*) AS tsa, sum(bug) AS bug_rows, count(CASE WHEN bug > 0 THEN 1 END) AS bug_a,
         sum(feat) AS feat_rows, count(CASE WHEN feat > 0 THEN 1 END) AS feat_a FROM pa GROUP BY project_id),
pt AS (SELECT project_id, issue_type, count(*) AS n FROM it WHERE issue_type IS NOT NULL GROUP BY project_id, issue_type),
ta AS (SELECT project_id, max(n) / sum(n) AS spec FROM pt GROUP BY project_id),
po AS (SELECT project_id, count(*) AS total, count(CASE WHEN issue_type = '{BUG}' THEN 1 END) AS n_bug,
         stddev_samp(resolution_time_hours) AS rt_std FROM it GROUP BY project_id),
tm AS (
SELECT po.project_id, coalesce(tsc, 0) AS team_size_creators, coalesce(tsa, 0) AS team_size_assignees,
  coalesce(tsc, 0) + coalesce(tsa, 0) AS team_size_combined, CAST(NULL AS DOUBLE) AS core_team_ratio,
  g.gini AS creator_workload_gini, div AS creator_diversity, avg_n AS avg_issues_per_creator,
  CASE WHEN total <> 0 THEN max_n / total END AS top_creator_contribution,
  var_n AS creator_activity_variance, std_n AS creator_activity_std, spec AS team_type_specialization_index,
  CAST(NULL AS DOUBLE) AS team_complexity_capacity,
  CASE WHEN rt_std <> 0 THEN 1.0 / rt_std END AS team_resolution_predictability,
  CASE WHEN n_bug <> 0 THEN bug_max / n_bug END AS bug_creator_concentration,
  CASE WHEN (CASE WHEN ca.bug_c <> 0 THEN ca.bug_rows / ca.bug_c END) <> 0
       THEN (CASE WHEN aa.bug_a <> 0 THEN aa.bug_rows / aa.bug_a END) / (CASE WHEN ca.bug_c <> 0 THEN ca.bug_rows / ca.bug_c END) END
    AS bug_developer_ratio,
  CASE WHEN (CASE WHEN ca.feat_c <> 0 THEN ca.feat_rows / ca.feat_c END) <> 0
       THEN (CASE WHEN aa.feat_a <> 0 THEN aa.feat_rows / aa.feat_a END) / (CASE WHEN ca.feat_c <> 0 THEN ca.feat_rows / ca.feat_c END) END
    AS feature_developer_ratio,
  CAST(NULL AS DOUBLE) AS avg_creator_experience_days, avg_n AS avg_creator_issue_count,
  CAST(NULL AS DOUBLE) AS avg_creator_specialization, CAST(NULL AS DOUBLE) AS creator_link_density_mean,
  CAST(NULL AS DOUBLE) AS creator_link_density_std, rt_std AS creator_resolution_time_variability,
  CAST(NULL AS DOUBLE) AS creator_onboarding_volatility, CAST(NULL AS DOUBLE) AS avg_new_creators_per_month
FROM po LEFT JOIN ca ON po.project_id = ca.project_id LEFT JOIN g ON po.project_id = g.project_id
LEFT JOIN aa ON po.project_id = aa.project_id LEFT JOIN ta ON po.project_id = ta.project_id)""")


def team(spark, sf_dir):
    return TM.team_metrics(issues_t(spark, sf_dir), bug_type=BUG, feature_type=FEAT)


@register("A17_team_metrics", TEAM_SQL + "\nSELECT * FROM tm")
def q_team_metrics(spark, sf_dir):
    """The 24 team metrics per project (absent inputs -> null)."""
    return team(spark, sf_dir)


@register("A18_activity_metrics", with_issues(f""",
hh AS (SELECT project_id, hour(created) AS h, count(*) AS c FROM itl GROUP BY project_id, hour(created)),
tot AS (SELECT project_id, count(*) AS n FROM itl GROUP BY project_id),
ent AS (SELECT hh.project_id, -sum((c / n) * (ln(c / n) / ln(2))) AS creation_hour_entropy
        FROM hh JOIN tot ON hh.project_id = tot.project_id WHERE c > 0 AND hh.h IS NOT NULL GROUP BY hh.project_id),
mo AS (SELECT project_id, date_trunc('month', created) AS m, count(*) AS c FROM itl WHERE created IS NOT NULL
       GROUP BY project_id, date_trunc('month', created)),
cv AS (SELECT project_id, stddev_samp(c) / avg(c) AS cv FROM mo GROUP BY project_id)
SELECT b.project_id, b.bug_creation_ratio, b.feature_request_ratio, b.weekend_activity_ratio, b.work_hour_creation_ratio,
  b.complex_issue_distribution, coalesce(ent.creation_hour_entropy, 0.0) AS creation_hour_entropy,
  CASE WHEN cv.cv IS NOT NULL THEN 1.0 / (1.0 + cv.cv) END AS creation_rate_stability
FROM (SELECT project_id, avg(CAST(issue_type = '{BUG}' AS DOUBLE)) AS bug_creation_ratio,
        avg(CAST(issue_type = '{FEAT}' AS DOUBLE)) AS feature_request_ratio,
        avg(CAST(isodow(created) - 1 >= 5 AS DOUBLE)) AS weekend_activity_ratio,
        avg(CAST(hour(created) >= 9 AND hour(created) < 17 AS DOUBLE)) AS work_hour_creation_ratio,
        avg(CAST(coalesce(inward_count, 0) + coalesce(outward_count, 0) > 2 AS DOUBLE)) AS complex_issue_distribution
      FROM itl GROUP BY project_id) b
LEFT JOIN ent ON b.project_id = ent.project_id LEFT JOIN cv ON b.project_id = cv.project_id""", ISSUES_TL))
def q_activity_metrics(spark, sf_dir):
    """Output-only team metrics with our definitions (type shares, weekend/work-hour shares, hour entropy,
    monthly stability, share of heavily linked issues)."""
    return TM.activity_metrics(issues_tl(spark, sf_dir), bug_type=BUG, feature_type=FEAT)


_CREATOR_COLS = ["team_size_creators", "creator_workload_gini", "creator_diversity", "avg_issues_per_creator",
                 "top_creator_contribution", "creator_activity_variance", "creator_activity_std",
                 "bug_creator_concentration", "avg_creator_experience_days", "avg_creator_issue_count",
                 "avg_creator_specialization", "creator_link_density_mean", "creator_link_density_std",
                 "creator_resolution_time_variability", "creator_onboarding_volatility", "avg_new_creators_per_month"]


@register("A19_team_size", TEAM_SQL + f""",
ov AS (SELECT project_id, count(*) AS total_issues, sum(resolution_time_hours) AS total_resolution_hours FROM it GROUP BY project_id),
ts AS (SELECT tm.project_id, ov.total_issues, ov.total_resolution_hours,
         greatest({', '.join('CAST(tm.' + c + ' AS DOUBLE)' for c in _CREATOR_COLS)}) AS creator_count,
         tm.team_size_assignees AS assignee_count FROM tm JOIN ov ON tm.project_id = ov.project_id),
te AS (SELECT *, greatest(creator_count, assignee_count) AS team_size_estimate FROM ts)
SELECT project_id, creator_count, assignee_count, team_size_estimate,
  total_issues / CASE WHEN team_size_estimate = 0 THEN 1 ELSE team_size_estimate END AS issues_per_team_member,
  total_resolution_hours / CASE WHEN team_size_estimate = 0 THEN 1 ELSE team_size_estimate END AS resolution_hours_per_team_member,
  sqrt(((creator_count - (creator_count + assignee_count) / 2) ^ 2 + (assignee_count - (creator_count + assignee_count) / 2) ^ 2) / 1)
    / CASE WHEN (creator_count + assignee_count) / 2 = 0 THEN 1.0 ELSE (creator_count + assignee_count) / 2 END AS team_role_diversity
FROM te""")
def q_team_size(spark, sf_dir):
    """Team size from the creator/assignee column families, per-member load, role diversity."""
    tm = team(spark, sf_dir)
    ov = issues_t(spark, sf_dir).groupBy("project_id").agg(
        F.count(F.lit(1)).alias("total_issues"), F.sum("resolution_time_hours").alias("total_resolution_hours"))
    out = TM.team_size(tm.join(ov, "project_id"))
    return out.select("project_id", "creator_count", "assignee_count", "team_size_estimate",
                      "issues_per_team_member", "resolution_hours_per_team_member", "team_role_diversity")


# ---- A23-A30, A32 -------------------------------------------------------------

@register("A23_flag_means", with_issues(_u([
    f"SELECT '{f}' AS flag, CAST({f} AS DOUBLE) AS value, avg(outward_count) AS mean_target, count(*) AS n "
    f"FROM (SELECT *, CAST(isodow(created) - 1 >= 5 AS INTEGER) AS created_on_weekend FROM itl) "
    f"WHERE {f} IS NOT NULL GROUP BY {f}" for f in ["is_resolved", "created_on_weekend"]]), ISSUES_TL))
def q_flag_means(spark, sf_dir):
    """Mean outward links where each flag is 1 vs 0."""
    return S.flag_means(issues_tl(spark, sf_dir), ["is_resolved", "created_on_weekend"], "outward_count")


TARGET = "net_price"
FEATS = [c for c in MATRIX_COLS if c != TARGET]
CORR_SQL = _u([f"SELECT '{c}' AS feature, corr({c}, {TARGET}) AS corr, abs(corr({c}, {TARGET})) AS abs_corr FROM ({MATRIX_SQL})"
               for c in FEATS])


@register("A24_target_corr", CORR_SQL)
def q_target_corr(spark, sf_dir):
    """Pearson correlation of each numeric feature with the target, sorted by absolute value."""
    return S.target_corr(matrix(spark, sf_dir), TARGET, FEATS)


@register("A25_corr_matrix", _u([
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, corr({a}, {b}) AS corr FROM ({MATRIX_SQL})"
    for i, a in enumerate(MATRIX_COLS) for b in MATRIX_COLS[i + 1:]]))
def q_corr_matrix(spark, sf_dir):
    """Pairwise correlation matrix (upper triangle, long form)."""
    return S.corr_matrix(matrix(spark, sf_dir), MATRIX_COLS)


def _cat(col):
    return F.when(col.startswith("l_"), "line").when(col.startswith("p_"), "part").otherwise("derived")


@register("A26_category_corr", f"""
SELECT CASE WHEN starts_with(feature, 'l_') THEN 'line' WHEN starts_with(feature, 'p_') THEN 'part' ELSE 'derived' END AS category,
  avg(abs(corr)) AS mean_abs_corr, count(*) AS n_features FROM ({CORR_SQL}) GROUP BY 1""")
def q_category_corr(spark, sf_dir):
    """Mean absolute target correlation per feature category."""
    corr = S.target_corr(matrix(spark, sf_dir), TARGET, FEATS)
    return S.category_corr(corr, _cat(F.col("feature")))


@register("A27_value_counts", with_issues("""
SELECT status, count(*) AS count, round(count(*) / (SELECT count(*) FROM issues) * 100.0, 1) AS pct
FROM issues GROUP BY status""", ISSUES))
def q_value_counts(spark, sf_dir):
    """Frequency and share of each status."""
    return S.value_counts(T.issues(spark, sf_dir), "status")


PF_FEATS = ["total_issues", "avg_resolution_hours", "pct_issues_created_on_weekend"]


@register("A28_cluster_profiles", with_issues(f""",
pf AS (SELECT it.project_id, min(it.project_name) AS project_name, min(it.repository) AS repository,
         CAST(count(*) AS DOUBLE) AS total_issues, sum(resolution_time_hours) AS total_hours, avg(resolution_time_hours) AS avg_resolution_hours,
         avg(CAST(coalesce(created_day_of_week >= 5, false) AS DOUBLE)) * 100.0 AS pct_issues_created_on_weekend
       FROM it GROUP BY it.project_id),
lg AS ({_u([f"SELECT repository, '{f}' AS feature, {f} AS value FROM pf" for f in PF_FEATS])}),
per AS (SELECT repository, feature, avg(value) AS mean, quantile_cont(value, 0.5) AS median, min(value) AS min, max(value) AS max
        FROM lg GROUP BY repository, feature),
ov AS (SELECT feature, avg(value) AS o FROM lg GROUP BY feature),
pd AS (SELECT per.*, CASE WHEN mean = 0 AND o = 0 THEN 0.0 WHEN o = 0 THEN 'inf'::DOUBLE ELSE (mean - o) / o * 100.0 END AS pct_diff
       FROM per JOIN ov ON per.feature = ov.feature),
rk AS (SELECT *, row_number() OVER (PARTITION BY repository ORDER BY abs(pct_diff) DESC NULLS LAST, feature) AS diff_rank FROM pd),
sz AS (SELECT repository, count(*) AS size,
         CASE WHEN avg(total_issues) > 10000 THEN 'Large' WHEN avg(total_issues) > 1000 THEN 'Medium' ELSE 'Small' END AS size_label,
         CASE WHEN avg(total_hours) > 1000000 THEN 'High-effort' WHEN avg(total_hours) > 100000 THEN 'Medium-effort' ELSE 'Low-effort' END AS effort_label, round(count(*) / (SELECT count(*) FROM pf) * 100.0, 1) AS percentage,
         list_sort(list(project_name ORDER BY project_name)[1:5]) AS sample_projects FROM pf GROUP BY repository)
SELECT rk.repository, rk.feature, rk.mean, rk.median, rk.min, rk.max, rk.pct_diff, CAST(rk.diff_rank AS INTEGER) AS diff_rank,
  rk.diff_rank <= 5 AS is_top,
  sz.size, sz.size_label, sz.effort_label, sz.percentage, sz.sample_projects
FROM rk JOIN sz ON rk.repository = sz.repository"""))
def q_cluster_profiles(spark, sf_dir):
    """Per-repository profile of project features (size, share, samples, stats, % difference, top features)."""
    it = issues_t(spark, sf_dir)
    pf = project_overview(it, name_cols=["project_name", "repository"])
    pf = pf.withColumn("total_issues", F.col("total_issues").cast("double"))
    hours = it.groupBy("project_id").agg(F.sum("resolution_time_hours").alias("total_hours"))
    return S.cluster_profiles(pf.join(hours, "project_id"), "repository", PF_FEATS, name_col="project_name", issues="total_issues", hours="total_hours")


@register("A29_importance_by_category", f"""
SELECT CASE WHEN starts_with(feature, 'l_') THEN 'line' WHEN starts_with(feature, 'p_') THEN 'part' ELSE 'derived' END AS category,
  sum(abs_corr) AS importance FROM ({CORR_SQL}) GROUP BY 1""")
def q_importance_by_category(spark, sf_dir):
    """Σ importance (absolute target correlation) per feature category."""
    imp = S.target_corr(matrix(spark, sf_dir), TARGET, FEATS).select("feature", F.col("abs_corr").alias("importance"))
    return S.importance_by_category(imp, category=_cat(F.col("feature")))


VOTE_TARGETS = ["net_price", "gross_price", "l_extendedprice"]


@register("A30_feature_vote", f"""
WITH c AS ({_u([f"SELECT '{t}' AS model, '{f}' AS feature, abs(corr({f}, {t})) AS importance FROM ({MATRIX_SQL})"
                for t in VOTE_TARGETS for f in MATRIX_COLS if f != t])}),
r AS (SELECT *, row_number() OVER (PARTITION BY model ORDER BY importance DESC, feature) AS rn FROM c)
SELECT feature, count(*) AS votes FROM r WHERE rn <= 3 GROUP BY feature HAVING count(*) >= 2""")
def q_feature_vote(spark, sf_dir):
    """Features in the top 3 of at least two 'models' (one per target, importance = |corr|)."""
    m = matrix(spark, sf_dir)
    tables = [S.target_corr(m, t, [c for c in MATRIX_COLS if c != t]).select(
        F.lit(t).alias("model"), "feature", F.col("abs_corr").alias("importance")) for t in VOTE_TARGETS]
    imp = tables[0]
    for t in tables[1:]:
        imp = imp.unionByName(t)
    return S.feature_vote(imp, top=3, min_votes=2)


LANGS = ["de", "en", "es", "fr"]


@register("A32_pivot_metric", "SELECT source, " + ", ".join(
    f"avg(CASE WHEN lang = '{lg}' THEN n_chars END) AS {lg}" for lg in LANGS) + " FROM documents GROUP BY source")
def q_pivot_metric(spark, sf_dir):
    """Mean value per row key x metric, metrics as columns (source x language mean length); the languages are those found."""
    d = T.read_table(spark, sf_dir, "documents")
    return S.pivot_metric(d, "source", "lang", "n_chars", distinct_values(d, "lang"))


# ---- W1-W10 --------------------------------------------------------------------------

@register("W1_cumulative_importance", f"""
WITH c AS ({CORR_SQL}),
t AS (SELECT *, sum(abs_corr) OVER (ORDER BY abs_corr DESC, feature ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
        / sum(abs_corr) OVER () AS cumulative,
        row_number() OVER (ORDER BY abs_corr DESC, feature) AS rank FROM c),
p AS (SELECT *, coalesce(lag(cumulative) OVER (ORDER BY rank), 0.0) AS prev FROM t)
SELECT feature, abs_corr AS importance, cumulative, CAST(rank AS INTEGER) AS rank FROM p WHERE prev < 0.9""")
def q_cumulative_importance(spark, sf_dir):
    """Running importance share; features up to 90 % plus the one crossing it."""
    imp = S.target_corr(matrix(spark, sf_dir), TARGET, FEATS).select("feature", F.col("abs_corr").alias("importance"))
    return W.cumulative_importance(imp)


@register("W2_average_rank", """
WITH m AS (SELECT lang AS model, avg(n_chars) AS mean_chars, count(*) AS docs FROM documents GROUP BY lang)
SELECT model, mean_chars, docs,
  rank() OVER (ORDER BY mean_chars ASC) + (count(*) OVER (PARTITION BY mean_chars) - 1) / 2.0 AS rank_mean_chars,
  rank() OVER (ORDER BY docs DESC) + (count(*) OVER (PARTITION BY docs) - 1) / 2.0 AS rank_docs,
  ((rank() OVER (ORDER BY mean_chars ASC) + (count(*) OVER (PARTITION BY mean_chars) - 1) / 2.0)
   + (rank() OVER (ORDER BY docs DESC) + (count(*) OVER (PARTITION BY docs) - 1) / 2.0)) / 2.0 AS average_rank
FROM m""")
def q_average_rank(spark, sf_dir):
    """Rank 'models' (languages) on each metric with mean ranks for ties, then average."""
    d = T.read_table(spark, sf_dir, "documents")
    m = d.groupBy(F.col("lang").alias("model")).agg(F.avg("n_chars").alias("mean_chars"),
                                                      F.count(F.lit(1)).alias("docs"))
    return W.average_rank_table(m, {"mean_chars": False, "docs": True})


@register("W3_qcut_bins", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM orders)
SELECT o_orderkey, o_totalprice,
  CASE WHEN o_totalprice >= q[1] AND o_totalprice <= q[11] THEN """ + " + ".join(
    f"CAST(o_totalprice > q[{i}] AS INTEGER)" for i in range(2, 11)) + """ END AS bin
FROM orders, e""")
def q_qcut_bins(spark, sf_dir):
    """Decile bins of order value from exact quantile edges."""
    o = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return W.qcut_bins(o, "o_totalprice", 10)


@register("W4_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def q_top_k(spark, sf_dir):
    """The 10 largest orders (top-k is the feature)."""
    o = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return W.top_k(o, [F.col("o_totalprice").desc(), F.col("o_orderkey")], 10)


@register("W4_best_by", "SELECT arg_max(lang, m) AS best_lang, max(m) AS best_m FROM "
          "(SELECT lang, avg(n_chars) AS m FROM documents GROUP BY lang)")
def q_best_by(spark, sf_dir):
    """The language with the longest mean document (max_by)."""
    d = T.read_table(spark, sf_dir, "documents").groupBy("lang").agg(F.avg("n_chars").alias("m"))
    return W.best_by(d, "lang", "m")


@register("W5_earliest", with_issues("SELECT id, created FROM issues ORDER BY created, id LIMIT 500", ISSUES))
def q_earliest(spark, sf_dir):
    """The 500 earliest issues (ties broken by id)."""
    return W.earliest(T.issues(spark, sf_dir), "created", 500, ["id", "created"], tie="id")


def _h(col: str, seed: int = 42) -> str:
    return W.hash_order_sql(col, seed)


def _unit(col: str, seed: int = 42) -> str:
    return f"{_h(col, seed)} / CAST({1 << 4 * W.HASH_DIGITS} AS DOUBLE)"


@register("W6_sample_exact", with_issues(f"""
SELECT id, repository FROM (
  SELECT id, repository, row_number() OVER (PARTITION BY repository ORDER BY {_h('id')}, id) AS r,
         greatest(1, floor(count(*) OVER (PARTITION BY repository) * 0.1)) AS take FROM issues)
WHERE r <= take""", ISSUES))
def q_sample_exact(spark, sf_dir):
    """Exactly max(1, int(10 % of n)) issues per repository by seeded hash order."""
    return W.sample_exact(T.issues(spark, sf_dir).select("id", "repository"), 0.1, "id", "repository", seed=42)


@register("W7_sample_frac", f"SELECT l_orderkey, l_linenumber FROM lineitem WHERE {_unit('l_orderkey')} < 0.1")
def q_sample_frac(spark, sf_dir):
    """~10 % sample of whole orders' lines by seeded hash of the order key."""
    li = T.read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber")
    return W.sample_frac(li, 0.1, seed=42, key="l_orderkey")


@register("W8_select_projects")
def q_select_projects(spark, sf_dir):
    """Greedy project mix near a target size from per-project counts, then all issues of those projects."""
    from ..operators.profile import count_by_project

    iss = T.issues(spark, sf_dir)
    counts = count_by_project(iss, "project_id", "project_name")
    total = iss.count()
    chosen = W.select_projects(counts, target=max(1, total // 10))
    return W.fetch_projects(iss.select("id", "project_id"), chosen)


@register("W9_random_split", f"""
SELECT o_orderkey, CASE WHEN {_unit('o_orderkey', 7)} < 0.6 THEN 0
                        WHEN {_unit('o_orderkey', 7)} < 0.8 THEN 1 ELSE 2 END AS split FROM orders""")
def q_random_split(spark, sf_dir):
    """60/20/20 split by seeded hash of the key."""
    o = T.read_table(spark, sf_dir, "orders").select("o_orderkey")
    return W.random_split(o, [0.6, 0.2, 0.2], "o_orderkey", seed=7)


@register("W10_stratified_split", """
WITH e AS (SELECT quantile_cont(o_totalprice, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM orders),
b AS (SELECT o_orderkey, CASE WHEN o_totalprice >= q[1] AND o_totalprice <= q[11] THEN """ + " + ".join(
    f"CAST(o_totalprice > q[{i}] AS INTEGER)" for i in range(2, 11)) + f""" END AS bin FROM orders, e)
SELECT o_orderkey, bin, CAST(row_number() OVER (PARTITION BY bin ORDER BY {_h('o_orderkey')}, o_orderkey)
  <= round(count(*) OVER (PARTITION BY bin) * 0.2) AS INTEGER) AS is_test FROM b""")
def q_stratified_split(spark, sf_dir):
    """80/20 split stratified by decile bin of the target."""
    o = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    binned = W.qcut_bins(o, "o_totalprice", 10).drop("o_totalprice")
    return W.stratified_split(binned, "bin", "o_orderkey", 0.2, seed=42)
