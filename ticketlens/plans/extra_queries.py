"""Further entries: variants of operators whose main form has an entry elsewhere."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import derive as V
from ..operators import columns as C
from ..operators import stats as S
from ..sources import files as FS
from ..sources import tables as T
from .catalog import register
from .columns_queries import INV_COLS
from .sqlbase import ISSUES, ISSUES_TL, with_issues
from .standin import issues_tl


@register("F21_inf_to_median", """
WITH g AS (SELECT l_orderkey, l_linenumber, power(l_quantity, 200.0) AS growth FROM lineitem),
m AS (SELECT quantile_cont(growth, 0.5) AS m FROM g WHERE isfinite(growth))
SELECT l_orderkey, l_linenumber, CASE WHEN isfinite(growth) THEN growth ELSE m END AS growth FROM g, m""")
def q_inf_to_median(spark, sf_dir):
    """non-finite values (overflowing powers here) become the median of the finite ones."""
    li = T.read_table(spark, sf_dir, "lineitem")
    return C.inf_to_median(li.select("l_orderkey", "l_linenumber", F.pow("l_quantity", 200.0).alias("growth")))


@register("F24_drop_string_columns", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate FROM orders")
def q_drop_string_columns(spark, sf_dir):
    """every string column goes."""
    return C.drop_string_columns(T.read_table(spark, sf_dir, "orders"))


@register("F24_exclude_patterns", "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem")
def q_exclude_patterns(spark, sf_dir):
    """columns whose names contain a pattern go."""
    return C.exclude_patterns(T.read_table(spark, sf_dir, "lineitem"), ["partkey", "suppkey", "flag", "status", "ship"])


@register("F27_scaler_prefix", """
SELECT CASE WHEN contains(n, '__') THEN split_part(n, '__', 1) ELSE 'none' END AS prefix, count(*) AS features
FROM (SELECT CASE WHEN o_orderstatus = 'O' THEN 'count_std__' || o_orderpriority WHEN o_orderstatus = 'F' THEN 'pct__x__y' ELSE o_orderpriority END AS n FROM orders)
GROUP BY 1""")
def q_scaler_prefix(spark, sf_dir):
    """transformed feature names counted by the scaler prefix before the first double underscore."""
    o = T.read_table(spark, sf_dir, "orders")
    name = (F.when(F.col("o_orderstatus") == "O", F.concat(F.lit("count_std__"), "o_orderpriority"))
            .when(F.col("o_orderstatus") == "F", "pct__x__y").otherwise(F.col("o_orderpriority")))
    return o.groupBy(V.scaler_prefix(name).alias("prefix")).agg(F.count(F.lit(1)).alias("features"))


@register("S7_rough_count", "SELECT o_orderpriority, count(*) AS issues FROM orders GROUP BY o_orderpriority")
def q_rough_count(spark, sf_dir):
    """Counts written with thousands separators read back as numbers."""
    written = (T.read_table(spark, sf_dir, "orders").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n"))
               .select("o_orderpriority", F.format_number("n", 0).alias("text")))
    return written.select("o_orderpriority", FS.rough_count(F.col("text")).alias("issues"))


@register("A31_inventory_summary", with_issues("\nUNION ALL\n".join(
    f"SELECT '{c}' AS \"column\", '{fam}' AS family, string_agg(DISTINCT repository, ',' ORDER BY repository) AS repositories, "
    f"count(DISTINCT repository) AS n_repositories FROM itl WHERE {c} IS NOT NULL"
    for c, fam in zip(INV_COLS, ["other", "other", "temporal", "temporal", "priority", "dependency"])), ISSUES_TL))
def q_inventory_summary(spark, sf_dir):
    """Per column the repositories that hold it."""
    inv = S.column_inventory(issues_tl(spark, sf_dir).select("repository", *INV_COLS), "repository")
    return S.inventory_summary(inv).withColumn("repositories", F.array_join("repositories", ","))


PROJECTS = """
pf AS (SELECT o_custkey AS project_id, o_orderpriority AS repository, o_totalprice AS total_price,
              CASE WHEN o_orderpriority = '1-URGENT' THEN o_orderstatus END AS urgent_status,
              CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS closed_date FROM orders)"""


def _projects(spark, sf_dir):
    o = T.read_table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("project_id"), F.col("o_orderpriority").alias("repository"), F.col("o_totalprice").alias("total_price"),
                    F.when(F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus")).alias("urgent_status"),
                    F.when(F.col("o_orderstatus") == "F", F.col("o_orderdate")).alias("closed_date"))


@register("C8_common_subset", f"WITH {PROJECTS} SELECT project_id, repository, total_price, closed_date FROM pf")
def q_common_subset(spark, sf_dir):
    """The columns that enough repositories hold; one that a single repository fills is left out."""
    return S.common_and_filled(_projects(spark, sf_dir))["common"]


@register("C8_filled_subset", f"""WITH {PROJECTS} SELECT project_id, repository, total_price, coalesce(urgent_status, 'Unknown') AS urgent_status,
       coalesce(closed_date, (SELECT min(closed_date) FROM pf)) AS closed_date FROM pf""")
def q_filled_subset(spark, sf_dir):
    """The whole table with no value missing."""
    return S.common_and_filled(_projects(spark, sf_dir))["filled"]
