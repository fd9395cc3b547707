"""Imputation and scaling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as D
from ..operators import impute as I
from ..operators import scale as SC
from ..operators import stats as S
from ..sources import tables as T
from .catalog import register
from .columns_queries import MATRIX_SQL, SPARSE_TYPED_SQL, matrix, sparse
from .issue_queries import AS_OF
from .sqlbase import ISSUES_T, days, with_issues
from .standin import issues_t

SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "p_size", "net_price"]


@register("I1_impute", f"""
WITH s AS ({SPARSE_TYPED_SQL})
SELECT doc_id, lang, source, n_chars,
  coalesce(CAST(quality AS DOUBLE), (SELECT quantile_cont(quality, 0.5) FROM s)) AS quality,
  coalesce(CAST(toxic AS DOUBLE), (SELECT quantile_cont(toxic, 0.5) FROM s)) AS toxic FROM s""")
def q_impute(spark, sf_dir):
    """Numeric gaps -> exact median, text gaps -> 'Missing'."""
    return I.impute(sparse(spark, sf_dir))


def _mode_sql(col: str, src: str = "s") -> str:
    return f"(SELECT {col} FROM {src} WHERE {col} IS NOT NULL GROUP BY {col} ORDER BY count(*) DESC, {col} LIMIT 1)"


@register("I2_impute_mode", f"""
WITH s AS ({SPARSE_TYPED_SQL})
SELECT doc_id, coalesce(quality, {_mode_sql('quality')}) AS quality, coalesce(toxic, {_mode_sql('toxic')}) AS toxic FROM s""")
def q_impute_mode(spark, sf_dir):
    """Fill with the most frequent value (smallest on ties)."""
    return I.impute_mode(sparse(spark, sf_dir).select("doc_id", "quality", "toxic"), ["quality", "toxic"])


@register("I3_impute_group_median", f"""
WITH s AS ({SPARSE_TYPED_SQL}),
g AS (SELECT lang, quantile_cont(quality, 0.5) AS gm FROM s GROUP BY lang),
f AS (SELECT s.doc_id, s.lang, coalesce(CAST(s.quality AS DOUBLE), g.gm) AS quality FROM s LEFT JOIN g ON s.lang = g.lang)
SELECT doc_id, lang, coalesce(quality, (SELECT quantile_cont(quality, 0.5) FROM f)) AS quality FROM f""")
def q_impute_group_median(spark, sf_dir):
    """Quality gaps -> median of the same language, then the overall median."""
    return I.impute_group_median(sparse(spark, sf_dir).select("doc_id", "lang", "quality"), "quality", ["lang"])


@register("I4_impute_group_mode", f"""
WITH s AS ({SPARSE_TYPED_SQL}),
gc AS (SELECT source, toxic, count(*) AS n FROM s WHERE toxic IS NOT NULL GROUP BY source, toxic),
g AS (SELECT source, toxic AS gm FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, toxic) AS r FROM gc) WHERE r = 1),
f AS (SELECT s.doc_id, s.source, coalesce(s.toxic, g.gm) AS toxic FROM s LEFT JOIN g ON s.source = g.source)
SELECT doc_id, source, coalesce(toxic, {_mode_sql('toxic', 'f')}) AS toxic FROM f""")
def q_impute_group_mode(spark, sf_dir):
    """I4: toxic gaps -> mode of the same source, then the overall mode."""
    return I.impute_group_mode(sparse(spark, sf_dir).select("doc_id", "source", "toxic"), "toxic", ["source"])


@register("I5_impute_new_category", f"""
SELECT doc_id, coalesce(CAST(quality AS VARCHAR), 'Unknown') AS quality_label FROM ({SPARSE_TYPED_SQL})""")
def q_impute_new_category(spark, sf_dir):
    """Text gaps -> new category 'Unknown'."""
    d = sparse(spark, sf_dir).select("doc_id", F.col("quality").cast("string").alias("quality_label"))
    return I.impute_new_category(d, ["quality_label"])


@register("I6_imputation_plan")
def q_imputation_plan(spark, sf_dir):
    """Strategy per column from its profile (kind x missing band)."""
    return I.imputation_plan(S.column_profile(sparse(spark, sf_dir)))


def _task(spark, sf_dir):
    return issues_t(spark, sf_dir).withColumn("age_days", D.age_days("created", AS_OF))


@register("I7_apply_plan")
def q_apply_plan(spark, sf_dir):
    """Execute the I6 plan on the issue table (group fills by issue type), then drop rows missing required fields."""
    d = _task(spark, sf_dir).select("id", "issue_type", "priority_name", "created", "updated",
                                    "resolution_time_hours", "age_days")
    plan = I.imputation_plan(S.column_profile(d))
    return I.apply_plan(d, plan, ["issue_type"], required=["issue_type", "created", "id"])


@register("I8_fill_all", with_issues("""
SELECT id, coalesce(updated, (SELECT min(updated) FROM it)) AS updated,
  coalesce(resolutiondate, (SELECT min(resolutiondate) FROM it)) AS resolutiondate,
  coalesce(priority_name, 'Unknown') AS priority_name, coalesce(resolution_time_hours, 0) AS resolution_time_hours FROM it"""))
def q_fill_all(spark, sf_dir):
    """I8: numeric -> 0, text -> 'Unknown', *date* columns -> their minimum."""
    d = issues_t(spark, sf_dir).select("id", "updated", "resolutiondate", "priority_name", "resolution_time_hours")
    return I.fill_all(d)


def _iqr_sql(cols):
    qs = ", ".join(f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_md, quantile_cont({c}, 0.75) AS {c}_q3"
                   for c in cols)
    return f"m AS ({MATRIX_SQL}), b AS (SELECT {qs} FROM m)"


@register("I9_iqr_cap", f"WITH {_iqr_sql(SCALE_COLS)}\nSELECT l_orderkey, l_linenumber, " + ", ".join(
    f"least(greatest(coalesce(CAST({c} AS DOUBLE), {c}_md), {c}_q1 - 1.5 * ({c}_q3 - {c}_q1)), {c}_q3 + 1.5 * ({c}_q3 - {c}_q1)) AS {c}"
    for c in SCALE_COLS) + " FROM m, b")
def q_iqr_cap(spark, sf_dir):
    """Clip to the 1.5 x IQR fences (null -> median)."""
    return I.iqr_cap(matrix(spark, sf_dir).select("l_orderkey", "l_linenumber", *SCALE_COLS), SCALE_COLS)


@register("I9_capped_counts", f"WITH {_iqr_sql(SCALE_COLS)}\n" + "\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", count(CASE WHEN {c} < {c}_q1 - 1.5 * ({c}_q3 - {c}_q1) THEN 1 END) AS below, "
    f"count(CASE WHEN {c} > {c}_q3 + 1.5 * ({c}_q3 - {c}_q1) THEN 1 END) AS above, count(CASE WHEN {c} IS NULL THEN 1 END) AS filled "
    f"FROM m, b" for c in SCALE_COLS))
def q_capped_counts(spark, sf_dir):
    """I9 report: values below/above the fences and nulls filled, per column."""
    return I.capped_counts(matrix(spark, sf_dir), SCALE_COLS)


@register("I10_impute_unresolved_hours", with_issues(f""",
t AS (SELECT *, {days('created', "TIMESTAMP '2002-01-01 00:00:00'")} AS age_days FROM it),
g AS (SELECT issue_type, priority_name, quantile_cont(resolution_time_hours, 0.5) AS gm FROM t
      WHERE resolution_time_hours IS NOT NULL GROUP BY issue_type, priority_name)
SELECT t.id, CASE WHEN t.resolution_time_hours IS NOT NULL THEN t.resolution_time_hours
  ELSE coalesce(g.gm, (SELECT quantile_cont(resolution_time_hours, 0.5) FROM t WHERE resolution_time_hours IS NOT NULL), 24.0)
       * (1.0 + 0.1 * least(greatest(t.age_days / 30.0, 0.0), 10.0)) END AS resolution_time_hours
FROM t LEFT JOIN g ON t.issue_type = g.issue_type AND t.priority_name = g.priority_name"""))
def q_impute_unresolved_hours(spark, sf_dir):
    """Unresolved issues get the (type, priority) median of resolved ones scaled by their age."""
    d = _task(spark, sf_dir).select("id", "issue_type", "priority_name", "resolution_time_hours", "age_days")
    out = I.impute_unresolved_hours(d, "resolution_time_hours", ["issue_type", "priority_name"], "age_days")
    return out.select("id", "resolution_time_hours")


def _scaled_sql(expr_of) -> str:
    return f"WITH m AS ({MATRIX_SQL}), s AS (SELECT " + ", ".join(
        f"avg({c}) AS {c}_mean, stddev_pop({c}) AS {c}_std, min({c}) AS {c}_min, max({c}) AS {c}_max, "
        f"quantile_cont({c}, 0.25) AS {c}_q1, quantile_cont({c}, 0.5) AS {c}_md, quantile_cont({c}, 0.75) AS {c}_q3"
        for c in SCALE_COLS) + " FROM m)\nSELECT l_orderkey, l_linenumber, " + ", ".join(
        f"{expr_of(c)} AS {c}" for c in SCALE_COLS) + " FROM m, s"


@register("I11_scale_standard", _scaled_sql(
    lambda c: f"(CAST({c} AS DOUBLE) - {c}_mean) / CASE WHEN {c}_std = 0 THEN 1.0 ELSE {c}_std END"))
def q_scale_standard(spark, sf_dir):
    """(x - mean) / population std."""
    return SC.scale_standard(matrix(spark, sf_dir).select("l_orderkey", "l_linenumber", *SCALE_COLS), SCALE_COLS)


@register("I12_scale_minmax", _scaled_sql(
    lambda c: f"(CAST({c} AS DOUBLE) - {c}_min) / CASE WHEN {c}_max - {c}_min = 0 THEN 1.0 ELSE {c}_max - {c}_min END"))
def q_scale_minmax(spark, sf_dir):
    """(x - min) / (max - min)."""
    return SC.scale_minmax(matrix(spark, sf_dir).select("l_orderkey", "l_linenumber", *SCALE_COLS), SCALE_COLS)


@register("I13_scale_robust", _scaled_sql(
    lambda c: f"(CAST({c} AS DOUBLE) - {c}_md) / CASE WHEN {c}_q3 - {c}_q1 = 0 THEN 1.0 ELSE {c}_q3 - {c}_q1 END"))
def q_scale_robust(spark, sf_dir):
    """(x - median) / IQR with exact quartiles."""
    return SC.scale_robust(matrix(spark, sf_dir).select("l_orderkey", "l_linenumber", *SCALE_COLS), SCALE_COLS)


@register("I14_scale_yeo_johnson")
def q_scale_yeo_johnson(spark, sf_dir):
    """Yeo-Johnson with per-column maximum-likelihood lambda, then standardised."""
    return SC.scale_yeo_johnson(matrix(spark, sf_dir).select("l_orderkey", "l_linenumber", *SCALE_COLS), SCALE_COLS)


@register("I15_column_transformer")
def q_column_transformer(spark, sf_dir):
    """Family-wise scaling of the project feature table with prefixed names; ids and target untouched."""
    from ..operators.project import project_features
    from .standin import STANDIN_DERIVED, issues_tl

    from ..session import cut_lineage

    # the fit makes several passes over the project table: materialise it once in the checkpoint folder
    pf = cut_lineage(project_features(issues_tl(spark, sf_dir), derived_kwargs=STANDIN_DERIVED))
    target = "total_resolution_hours"
    feats = SC.numeric_features(pf, exclude=["project_id", target])
    params = SC.fit_column_transformer(pf, feats)
    return SC.apply_column_transformer(pf, params, keep=["project_id", target])
