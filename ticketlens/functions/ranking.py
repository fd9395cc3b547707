"""Exact ranks, running sums and quantiles inside groups without putting a whole group into one task.

A window ``partitionBy(group).orderBy(x)`` sends every row of a group to one
task, so a group holding a third of the data becomes one straggler. Here rows
are range-partitioned by (keys, order), which cuts a large group into as many
parts as its rows need, and written once together with their part number. A
part is ranked or summed by itself; the parts' totals, a row per (part, group),
are cumulated in part order and shift the local results to the global ones.
There is one path for every size, and a null key is a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from ..sources.tables import small_side


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` joined to ``right`` on equal keys, where null equals null; the key columns stay once.

    Without keys ``right`` must be one row, which every row gets.
    """
    keys = list(keys)
    if not keys:
        return left.join(F.broadcast(right), how="left")
    named = [f"_k{i}" for i in range(len(keys))]
    other = small_side(right.withColumnsRenamed(dict(zip(keys, named))))
    cond = None
    for k, n in zip(keys, named):
        one = left[f"`{k}`"].eqNullSafe(other[n])
        cond = one if cond is None else cond & one
    return left.join(other, cond, how).drop(*named)


def in_parts(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """``df`` dealt to ranges of (keys, order) and written, with its range's number in ``_part``."""
    dealt = df.repartitionByRange(*[F.col(f"`{c}`") for c in [*keys, *order]])
    return cut_lineage(dealt.withColumn("_part", F.spark_partition_id()))


def _before(parts: DataFrame, keys: list[str], total: Column) -> DataFrame:
    """Per (part, group): ``_off``, the total of the group's earlier parts."""
    sums = parts.groupBy("_part", *keys).agg(total.alias("_t"))
    earlier = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select("_part", *keys, F.coalesce(F.sum("_t").over(earlier), F.lit(0)).alias("_off"))


def row_number_in_groups(df: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str = "_rank") -> DataFrame:
    """Add ``out`` = 1-based position of each row inside its group in the given order.

    Equal to ``row_number().over(partitionBy(keys).orderBy(order))``; ``order``
    should make rows unique (add a tiebreak), else equal rows share a part.
    """
    keys = list(keys)
    names = [f"_o{i}" for i in range(len(order))]
    parts = in_parts(df.select("*", *[o.alias(n) for o, n in zip(order, names)]), keys, names)
    local = parts.withColumn("_lr", F.row_number().over(Window.partitionBy("_part", *keys).orderBy(*names)))
    joined = null_safe_join(local, _before(parts, keys, F.count(F.lit(1))), ["_part", *keys])
    return joined.withColumn(out, F.col("_off") + F.col("_lr")).drop("_part", "_lr", "_off", *names)


def cumulative_sum_in_groups(df: DataFrame, keys: Sequence[str], order_col: str, value: str, out: str) -> DataFrame:
    """Inclusive running sum of ``value`` inside each group ordered by the (unique) ``order_col``."""
    keys = list(keys)
    parts = in_parts(df, keys, [order_col])
    run = Window.partitionBy("_part", *keys).orderBy(order_col).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_ls", F.sum(value).over(run))
    joined = null_safe_join(local, _before(parts, keys, F.sum(value)), ["_part", *keys])
    return joined.withColumn(out, F.col("_off") + F.col("_ls")).drop("_part", "_ls", "_off")


def average_ranks(df: DataFrame, keys: Sequence[str], value: str, out: str = "_avg_rank") -> DataFrame:
    """Rank of ``value`` inside each group, ties given the mean of their positions (pandas 'average')."""
    keys = list(keys)
    pre = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    cum = cumulative_sum_in_groups(pre, keys, value, "_n", "_cum")
    cum = cum.withColumn(out, (F.col("_cum") - F.col("_n")) + (F.col("_n") + 1) / 2.0)
    return null_safe_join(df, cum.select(*keys, value, out), [*keys, value], "left")


def exact_quantiles(df: DataFrame, keys: Sequence[str], col: str | Column, probs: Sequence[float],
                    out: str = "quantiles") -> DataFrame:
    """Exact linear-interpolated quantiles (pandas / DuckDB ``quantile_cont``) per group, skew-safe.

    Spark's exact ``percentile`` aggregate keeps a value->count map per group
    and merges it in one task, which does not bound a hot or global group.
    Here rows are reduced to (group, value, count), running counts come from
    the running sum over parts, and each quantile reads the two values whose
    rank ranges contain floor/ceil of (n-1)·p, with conditional aggregates.
    Null and NaN values do not count; a group of them alone has null quantiles.
    Returns one row per group: keys + ``out`` (array<double>, one per prob).
    """
    keys = list(keys)
    v = (F.col(col) if isinstance(col, str) else col).cast("double")
    pre = (df.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
           .groupBy(*keys, "_v").agg(F.count("_v").alias("_n")))
    cum = cumulative_sum_in_groups(pre, keys, "_v", "_n", "_cum")
    joined = null_safe_join(cum, cum.groupBy(*keys).agg(F.sum("_n").alias("_total")), keys)
    aggs = [F.max("_total").alias("_total")]
    for i, p in enumerate(probs):
        h = (F.col("_total") - 1) * F.lit(float(p))
        for tag, r in (("lo", F.floor(h) + 1), ("hi", F.ceil(h) + 1)):
            hit = (F.col("_cum") - F.col("_n") < r) & (r <= F.col("_cum"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{tag}{i}"))
    res = joined.groupBy(*keys).agg(*aggs)
    qs = []
    for i, p in enumerate(probs):
        h = (F.col("_total") - 1) * F.lit(float(p))
        frac = h - F.floor(h)
        qs.append(F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * frac)
    return res.select(*keys, F.array(*qs).alias(out))


def first_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int, out: str = "_r") -> DataFrame:
    """The first ``k`` rows of each group in ``order`` with their 1-based position in ``out``.

    Spark limits each group to ``k`` rows per task before the shuffle, so a
    group's task gets k rows from each of the others at most.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k)
