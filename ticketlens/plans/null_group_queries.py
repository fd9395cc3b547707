"""Group operators over keys that are null for many rows: customers without orders, documents without labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.stats import group_quantiles
from ..operators import sampling as W
from ..operators import stats as S
from ..sources import files as FS
from ..sources import tables as TB
from .catalog import register

BUYERS = """
WITH b AS (SELECT c_custkey, c_acctbal, coalesce(o_orderkey, -c_custkey) AS k, o_orderpriority AS p, o_totalprice, o_orderstatus
           FROM customer LEFT JOIN orders ON c_custkey = o_custkey),
l AS (SELECT d.doc_id, d.n_chars, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def _buyers(spark, sf_dir):
    c, o = TB.read_table(spark, sf_dir, "customer"), TB.read_table(spark, sf_dir, "orders")
    return (c.join(o, c.c_custkey == o.o_custkey, "left")
            .select("c_custkey", "c_acctbal", F.coalesce("o_orderkey", -F.col("c_custkey")).alias("k"), F.col("o_orderpriority").alias("p"),
                    "o_totalprice", "o_orderstatus"))


def _labelled(spark, sf_dir):
    docs, labels = TB.read_table(spark, sf_dir, "documents"), TB.read_table(spark, sf_dir, "labels")
    return docs.select("doc_id", "n_chars").join(labels.select("doc_id", "quality"), "doc_id", "left")


@register("A7_quantiles_null_group", BUYERS + """
SELECT p, quantile_cont(c_acctbal, 0.25) AS p25, quantile_cont(c_acctbal, 0.5) AS p50, quantile_cont(c_acctbal, 0.9) AS p90 FROM b GROUP BY p""")
def q_quantiles_null_group(spark, sf_dir):
    """Exact quantiles of balances by order priority; customers without orders are a group."""
    got = group_quantiles(_buyers(spark, sf_dir), ["p"], "c_acctbal", [0.25, 0.5, 0.9], True, "q")
    return got.select("p", *[F.col("q")[i].alias(n) for i, n in enumerate(("p25", "p50", "p90"))])


@register("A16_gini_null_group", BUYERS + """,
r AS (SELECT quality, n_chars + 1e-7 AS x, row_number() OVER (PARTITION BY quality ORDER BY n_chars, doc_id) AS i, count(*) OVER (PARTITION BY quality) AS n FROM l)
SELECT quality, sum((2 * i - n - 1) * x) / (max(n) * sum(x)) AS gini FROM r GROUP BY quality""")
def q_gini_null_group(spark, sf_dir):
    """Gini index of text lengths by label; documents without a label are a group."""
    return S.gini(_labelled(spark, sf_dir), "n_chars", ["quality"])


@register("W6_sample_null_group", BUYERS + f""",
r AS (SELECT doc_id, quality, row_number() OVER (PARTITION BY quality ORDER BY {W.hash_order_sql('doc_id', 5)}, doc_id) AS i,
      greatest(1, floor(count(*) OVER (PARTITION BY quality) * 0.1)) AS take FROM l)
SELECT doc_id, quality FROM r WHERE i <= take""")
def q_sample_null_group(spark, sf_dir):
    """A tenth of the documents of each label, and of those without one."""
    return W.sample_exact(_labelled(spark, sf_dir).select("doc_id", "quality"), 0.1, "doc_id", "quality", seed=5)


@register("W10_stratified_null_group", BUYERS + f"""
SELECT k, p, CAST(row_number() OVER (PARTITION BY p ORDER BY {W.hash_order_sql('k', 3)}, k) <= round(count(*) OVER (PARTITION BY p) * 0.2) AS INTEGER) AS is_test FROM b""")
def q_stratified_null_group(spark, sf_dir):
    """80/20 split stratified by order priority; customers without orders are a stratum."""
    return W.stratified_split(_buyers(spark, sf_dir).select("k", "p"), "p", "k", 0.2, seed=3)


@register("S10_null_group", BUYERS + """
SELECT k, p, o_totalprice FROM b""")
def q_write_null_group(spark, sf_dir):
    """One folder per order priority and one for null, read back."""
    path = FS.scratch_path(spark, "by-priority")
    FS.write_partitioned(_buyers(spark, sf_dir).select("k", "p", "o_totalprice"), path, "p")
    return spark.read.parquet(path).select("k", "p", "o_totalprice")


@register("S10_columns_by_group", BUYERS + """
SELECT p, concat_ws(',', CASE WHEN count(c_acctbal) > 0 THEN 'c_acctbal' END, CASE WHEN count(o_totalprice) > 0 THEN 'o_totalprice' END,
                    CASE WHEN count(o_orderstatus) > 0 THEN 'o_orderstatus' END) AS columns FROM b GROUP BY p""")
def q_columns_by_group(spark, sf_dir):
    """S10 + C4: the columns that hold data in each group; without orders there are no order columns."""
    got = FS.columns_with_data(_buyers(spark, sf_dir).select("p", "c_acctbal", "o_totalprice", "o_orderstatus"), "p")
    return got.withColumn("columns", F.array_join("columns", ","))


@register("S5_csv_ragged", BUYERS + """
SELECT k, CASE WHEN p IS NULL THEN c_acctbal END AS c_acctbal, o_totalprice, CASE WHEN p IS NULL THEN 'none' ELSE 'some' END AS folder FROM b""")
def q_csv_ragged(spark, sf_dir):
    """CSV folders of different headers and column orders read as one table by column name."""
    base = FS.scratch_path(spark, "ragged")
    rows = _buyers(spark, sf_dir)
    FS.write_csv(rows.where("p IS NULL").select("k", "c_acctbal"), f"{base}/none")
    FS.write_csv(rows.where("p IS NOT NULL").select("o_totalprice", "k"), f"{base}/some")
    back = FS.read_csv_tree(spark, base, group_col="folder")
    return back.select(F.col("k").cast("long").alias("k"), F.col("c_acctbal").cast("double").alias("c_acctbal"),
                       F.col("o_totalprice").cast("double").alias("o_totalprice"), "folder")
