"""Statistics and comparison tables.

Column-wise statistics are one aggregation producing a single wide row which
is then unpivoted inside Spark (``stack``), so no row-grain data leaves the
cluster. Scalar totals needed for shares are fetched as one number.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.derive import feature_group
from ..functions.ranking import cumulative_sum_in_groups, null_safe_join
from ..functions.stats import median, pearson, quantiles
from .columns import AGG_CHUNK, numeric_columns, q


def _long_stats(df: DataFrame, cols: Sequence[str], stats: dict[str, callable], label: str = "column") -> DataFrame:
    """One row per column with one field per statistic, computed in one aggregation per chunk."""
    parts = []
    per_chunk = max(1, AGG_CHUNK // max(1, len(stats)))
    for i in range(0, len(cols), per_chunk):
        chunk = cols[i:i + per_chunk]
        wide = df.agg(*[fn(c).alias(f"{j}\u0001{k}") for j, c in enumerate(chunk) for k, fn in stats.items()])
        structs = [F.struct(F.lit(c).alias(label), *[F.col(f"`{j}\u0001{k}`").alias(k) for k in stats])
                   for j, c in enumerate(chunk)]
        parts.append(wide.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


# --------------------------------------------------------------------------
# A16 gini
# --------------------------------------------------------------------------

def gini(df: DataFrame, value: str, keys: Sequence[str] = (), out: str = "gini") -> DataFrame:
    """Gini index per group: shift negatives to >= 0, add 1e-7, sort, Σ(2i-n-1)x / (nΣx).

    Rows are first reduced to (group, value, count); a value's rows occupy ranks
    L+1..L+c, so its share of the numerator is x·c·(2L+c+1-(n+1)). L is a
    running count over the distinct values (range-partitioned, skew-safe).
    """
    keys = list(keys)
    pre = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    cum = cumulative_sum_in_groups(pre, keys, value, "_c", "_cum")
    return _gini_finish(cum, keys, value, out)


def _gini_finish(cum: DataFrame, keys: list[str], value: str, out: str) -> DataFrame:
    grp = cum.groupBy(*keys).agg(F.min(value).alias("_gmin"), F.sum("_c").alias("_gtot"))
    if keys:
        per = null_safe_join(cum, grp, keys)
    else:
        row = grp.first()
        per = cum.withColumns({"_gmin": F.lit(row["_gmin"]), "_gtot": F.lit(row["_gtot"])})
    x = (F.col(value).cast("double") - F.when(F.col("_gmin") < 0, F.col("_gmin")).otherwise(F.lit(0.0))) + F.lit(1e-7)
    lower = F.col("_cum") - F.col("_c")
    per = per.withColumns({"_x": x, "_num": x * F.col("_c") * (2 * lower + F.col("_c") + 1 - (F.col("_gtot") + 1))})
    return per.groupBy(*keys).agg(
        F.try_divide(F.sum("_num"), F.first("_gtot") * F.sum(F.col("_x") * F.col("_c"))).alias(out))


# --------------------------------------------------------------------------
# A20-A22 profiles
# --------------------------------------------------------------------------

def missing_profile(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """(column, missing_count, missing_pct) sorted by count descending; pct rounded to 2."""
    cols = df.columns if cols is None else list(cols)
    n = F.count(F.lit(1))
    stats = {"missing_count": lambda c: F.count_if(q(c).isNull()),
             "missing_pct": lambda c: F.round(F.try_divide(F.count_if(q(c).isNull()), n) * 100.0, 2)}
    return _long_stats(df, cols, stats).orderBy(F.col("missing_count").desc(), "column")


def _kind(numeric_share: Column, ts_share: Column, bool_share: Column, distinct: Column) -> Column:
    return (F.when(ts_share >= 0.9, "datetime")
            .when(bool_share >= 0.9, "boolean")
            .when(numeric_share >= 0.9, "numeric")
            .when(distinct < 20, "categorical")
            .when(distinct < 100, "high_cardinality")
            .otherwise("text"))


def column_profile(df: DataFrame, drop_above_pct: float = 35.0) -> DataFrame:
    """Per column kind, missing %, action (drop above the threshold), distinct count, min/max samples.

    Reads every row (the reference looks at 20-row samples). The distinct count
    decides the kind at fixed bounds, so it is exact: values are reduced to
    (column, value) before they are counted.
    """
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    s = lambda c: q(c).cast("string")
    nn = lambda c: F.count(q(c))
    stats = {
        "missing_pct": lambda c: F.round(F.try_divide(F.count_if(q(c).isNull()), F.count(F.lit(1))) * 100.0, 2),
        "num_share": lambda c: F.try_divide(F.count_if(s(c).try_cast("double").isNotNull()), nn(c)),
        "ts_share": lambda c: F.try_divide(F.count_if(F.try_to_timestamp(s(c)).isNotNull() & s(c).rlike(r"^\d{4}-\d{2}-\d{2}")), nn(c)),
        "bool_share": lambda c: F.try_divide(F.count_if(F.lower(s(c)).isin("true", "false")), nn(c)),
        "min_value": lambda c: F.min(s(c)),
        "max_value": lambda c: F.max(s(c)),
    }
    values = df.select(*[s(c).alias(c) for c in cols]).unpivot([], cols, "column", "_value")
    distinct = values.distinct().groupBy("column").agg(F.count("_value").alias("distinct"))
    prof = _long_stats(df, cols, stats).join(distinct, "column", "left").withColumn("distinct", F.coalesce("distinct", F.lit(0).cast("long")))
    return (prof.withColumn("kind", _kind(F.coalesce("num_share", F.lit(0)), F.coalesce("ts_share", F.lit(0)),
                                          F.coalesce("bool_share", F.lit(0)), F.col("distinct")))
            .withColumn("action", F.when(F.col("missing_pct") > drop_above_pct, "drop").otherwise("keep"))
            .drop("num_share", "ts_share", "bool_share"))


def describe(df: DataFrame, cols: Sequence[str] | None = None, exact: bool = True) -> DataFrame:
    """Count, mean, sample std, min, exact quartiles, max of each numeric column (one row per column).

    Moments come from one aggregation; the quartiles of all columns from one
    distributed quantile pass over the unpivoted (column, value) table.
    """
    from ..functions.stats import group_quantiles

    from ..session import reuse

    cols = numeric_columns(df) if cols is None else list(cols)
    df = reuse(df.select(*[q(c) for c in cols]))
    stats = {
        "count": lambda c: F.count(q(c)),
        "mean": lambda c: F.avg(q(c)),
        "std": lambda c: F.stddev_samp(q(c)),
        "min": lambda c: F.min(q(c)).cast("double"),
        "max": lambda c: F.max(q(c)).cast("double"),
    }
    moments = _long_stats(df, cols, stats)
    long = df.select(*[q(c).cast("double").alias(c) for c in cols]).unpivot([], cols, "column", "_value")
    qs = group_quantiles(long, ["column"], "_value", [0.25, 0.5, 0.75], exact, "q")
    out = moments.join(qs, "column", "left")
    return out.select("column", "count", "mean", "std", "min", F.col("q")[0].alias("p25"),
                      F.col("q")[1].alias("p50"), F.col("q")[2].alias("p75"), "max")


# --------------------------------------------------------------------------
# A23-A27 correlations and frequencies
# --------------------------------------------------------------------------

def flag_means(df: DataFrame, flags: Sequence[str], target: str) -> DataFrame:
    """Mean target where each flag is 1 vs 0 (flag, value, mean_target, n)."""
    long = df.unpivot([target], [q(f).cast("double") for f in flags], "flag", "value")
    return (long.where(F.col("value").isNotNull()).groupBy("flag", "value")
            .agg(F.avg(target).alias("mean_target"), F.count(F.lit(1)).alias("n")))


def target_corr(df: DataFrame, target: str, cols: Sequence[str] | None = None, top_k: int | None = None,
                by_abs: bool = True) -> DataFrame:
    """Pearson of each numeric column with the target (pairwise complete), sorted."""
    cols = [c for c in (numeric_columns(df) if cols is None else cols) if c != target]
    stats = {"corr": lambda c: pearson(q(c), q(target))}
    out = _long_stats(df, cols, stats, "feature").withColumn("abs_corr", F.abs("corr"))
    out = out.orderBy(F.col("abs_corr" if by_abs else "corr").desc_nulls_last(), "feature")
    return out.limit(top_k) if top_k else out


def corr_matrix(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Long correlation matrix (feature_a, feature_b, corr) for a < b, null-pairwise like pandas."""
    cols = numeric_columns(df) if cols is None else list(cols)
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    if not pairs:
        return df.sparkSession.createDataFrame([], "feature_a string, feature_b string, corr double")
    key = [f"{a}\u0002{b}" for a, b in pairs]
    wide_parts = []
    for i in range(0, len(pairs), AGG_CHUNK):
        chunk = pairs[i:i + AGG_CHUNK]
        wide = df.agg(*[pearson(q(a), q(b)).alias(f"c{j}") for j, (a, b) in enumerate(chunk)])
        structs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{j}").alias("corr"))
                   for j, (a, b) in enumerate(chunk)]
        wide_parts.append(wide.select(F.explode(F.array(*structs)).alias("_r")).select("_r.*"))
    del key
    out = wide_parts[0]
    for p in wide_parts[1:]:
        out = out.unionByName(p)
    return out


def category_corr(corr: DataFrame, category: Column | None = None) -> DataFrame:
    """Mean absolute correlation and feature count per feature category."""
    cat = feature_group("feature") if category is None else category
    return (corr.withColumn("category", cat).groupBy("category")
            .agg(F.avg(F.abs("corr")).alias("mean_abs_corr"), F.count(F.lit(1)).alias("n_features")))


def value_counts(df: DataFrame, col: str, out: str = "count") -> DataFrame:
    """Frequency and share (% rounded to 1 digit) of each value."""
    total = df.count()
    return (df.groupBy(col).agg(F.count(F.lit(1)).alias(out))
            .withColumn("pct", F.round(F.col(out) / F.lit(float(total)) * 100.0, 1)))


# --------------------------------------------------------------------------
# A28 cluster profiles
# --------------------------------------------------------------------------

def cluster_profiles(df: DataFrame, cluster: str, features: Sequence[str], name_col: str | None = None,
                     n_samples: int = 5, top: int = 5, exact: bool = True, issues: str | None = None,
                     hours: str | None = None) -> DataFrame:
    """Per cluster size, %, sample names, per-feature mean/median/min/max, % difference from the
    overall mean, the top features by absolute difference, and, from the cluster's mean
    ``issues`` and mean ``hours`` where those columns are named, size and effort labels.

    Returns one row per (cluster, feature); cluster-level fields repeat.
    Sample names are the first names in sort order; each task passes on that many at most.
    """
    labels = ([label_size(F.avg(issues)).alias("size_label")] if issues else []) + ([label_effort(F.avg(hours)).alias("effort_label")] if hours else [])
    total = df.count()
    long = df.select(cluster, *[q(f).cast("double").alias(f) for f in features]).unpivot(
        [cluster], list(features), "feature", "value")
    from ..functions.stats import group_quantiles

    per = long.groupBy(cluster, "feature").agg(F.avg("value").alias("mean"), F.min("value").alias("min"),
                                               F.max("value").alias("max"))
    med = group_quantiles(long, [cluster, "feature"], "value", [0.5], exact, "_mq")
    per = per.join(med.select(cluster, "feature", F.col("_mq")[0].alias("median")), [cluster, "feature"], "left")
    overall = long.groupBy("feature").agg(F.avg("value").alias("_overall"))
    per = per.join(overall, "feature")
    m, o = F.col("mean"), F.col("_overall")
    per = per.withColumn("pct_diff", F.when((m == 0) & (o == 0), F.lit(0.0))
                         .when(o == 0, F.lit(math.inf)).otherwise(F.try_divide(m - o, o) * 100.0))
    rk = Window.partitionBy(cluster).orderBy(F.abs("pct_diff").desc_nulls_last(), "feature")
    per = per.withColumn("diff_rank", F.row_number().over(rk)).withColumn("is_top", F.col("diff_rank") <= top)
    sizes = df.groupBy(cluster).agg(F.count(F.lit(1)).alias("size"), *labels)
    sizes = sizes.withColumn("percentage", F.round(F.col("size") / F.lit(float(total)) * 100.0, 1))
    if name_col:
        from ..functions.ranking import first_k_per_group

        first = first_k_per_group(df.select(cluster, name_col), [cluster], [F.col(name_col)], n_samples, "_r")
        samples = first.groupBy(cluster).agg(F.array_sort(F.collect_list(name_col)).alias("sample_projects"))
        sizes = sizes.join(samples, cluster, "left")
    return per.drop("_overall").join(sizes, cluster)


# Labels and bounds of the cluster descriptions.
def label_size(issues: Column) -> Column:
    return F.when(issues > 10_000, "Large").when(issues > 1_000, "Medium").otherwise("Small")


def label_effort(hours: Column) -> Column:
    return F.when(hours > 1_000_000, "High-effort").when(hours > 100_000, "Medium-effort").otherwise("Low-effort")


# --------------------------------------------------------------------------
# A29-A32 importance and comparison tables
# --------------------------------------------------------------------------

def importance_by_category(imp: DataFrame, feature: str = "feature", importance: str = "importance",
                           category: Column | None = None) -> DataFrame:
    """Σ importance per feature category, largest first."""
    cat = feature_group(feature) if category is None else category
    return (imp.withColumn("category", cat).groupBy("category")
            .agg(F.sum(importance).alias("importance")).orderBy(F.col("importance").desc(), "category"))


def feature_vote(imp: DataFrame, model: str = "model", feature: str = "feature", importance: str = "importance",
                 top: int = 10, min_votes: int = 2) -> DataFrame:
    """In how many models' top-``top`` each feature appears; keep those with >= ``min_votes``."""
    w = Window.partitionBy(model).orderBy(F.col(importance).desc(), feature)
    topk = imp.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= top)
    return (topk.groupBy(feature).agg(F.count(F.lit(1)).alias("votes"))
            .where(F.col("votes") >= min_votes))


# Column families of the project table, rules tried in this order.
CORE_COLUMNS = ("project_id", "project_key", "project_name", "repository", "source_file", "total_issues")
TEMPORAL_TERMS = ("date", "duration", "days", "month", "time", "hours")
DEPENDENCY_TERMS = ("link", "inward", "outward", "dependencies")
RESOLUTION_TERMS = ("resolution", "resolved")
EFFICIENCY_TERMS = ("efficiency", "ratio", "balance", "velocity")


def family_of(name: str) -> str:
    """A31 name family of one column (driver-side, on names only)."""
    if name in CORE_COLUMNS:
        return "core"
    if any(t in name for t in TEMPORAL_TERMS):
        return "temporal"
    if name.startswith("priority_") and "_type_" not in name:
        return "priority"
    if name.startswith("type_") and "_resolution_" not in name:
        return "issue_type"
    if "_type_" in name and "priority_" in name:
        return "priority_type"
    if any(t in name for t in DEPENDENCY_TERMS):
        return "dependency"
    if any(t in name for t in RESOLUTION_TERMS):
        return "resolution"
    if any(t in name for t in EFFICIENCY_TERMS):
        return "efficiency"
    return "other"


def _any(name: Column, terms) -> Column:
    cond = F.lit(False)
    for t in terms:
        cond = cond | name.contains(t)
    return cond


def column_family(name: Column) -> Column:
    """A31 name family as a column expression (same rules as ``family_of``)."""
    return (F.when(name.isin(*CORE_COLUMNS), "core")
            .when(_any(name, TEMPORAL_TERMS), "temporal")
            .when(name.startswith("priority_") & ~name.contains("_type_"), "priority")
            .when(name.startswith("type_") & ~name.contains("_resolution_"), "issue_type")
            .when(name.contains("_type_") & name.contains("priority_"), "priority_type")
            .when(_any(name, DEPENDENCY_TERMS), "dependency")
            .when(_any(name, RESOLUTION_TERMS), "resolution")
            .when(_any(name, EFFICIENCY_TERMS), "efficiency")
            .otherwise("other"))


# The core columns of every subset, and the share of repositories that must hold a common column.
SUBSET_CORE = ("project_id", "project_key", "project_name", "repository", "total_issues", "project_start_date", "project_duration_days",
               "avg_resolution_hours", "num_resolved_issues", "pct_resolved_issues")
COMMON_SHARE = 0.35


def common_and_filled(df: DataFrame, group: str = "repository") -> dict[str, DataFrame]:
    """``common`` (columns that hold data in enough repositories) and ``filled`` (no value missing)."""
    from .columns import common_columns
    from .impute import fill_all

    return {"common": df.select(*[q(c) for c in common_columns(df, group, COMMON_SHARE)]), "filled": fill_all(df)}


def feature_subsets(df: DataFrame) -> dict[str, DataFrame]:
    """Named projections by family: core, temporal, priority, issue_type, resolution+efficiency."""
    fam = {c: family_of(c) for c in df.columns}
    core = [c for c in SUBSET_CORE if c in df.columns]
    fam |= dict.fromkeys(core, "core")

    def pick(*names):
        return df.select(*[q(c) for c in core + [c for c in df.columns if fam[c] in names]])
    return {"core": pick(), "temporal": pick("temporal"), "priority": pick("priority"),
            "issue_type": pick("issue_type"), "resolution_efficiency": pick("resolution", "efficiency")}


def column_inventory(df: DataFrame, group: str = "repository") -> DataFrame:
    """(repository, column, present, family): which columns hold data in which repository."""
    cols = [c for c in df.columns if c != group]
    wide = df.groupBy(group).agg(*[F.max(q(c).isNotNull().cast("int")).alias(c) for c in cols])
    long = wide.unpivot([group], [q(c) for c in cols], "column", "present")
    return long.withColumn("family", column_family(F.col("column")))


def inventory_summary(inv: DataFrame, group: str = "repository") -> DataFrame:
    """Per column, the repositories holding it and their count."""
    return (inv.where("present = 1").groupBy("column", "family")
            .agg(F.array_sort(F.collect_set(group)).alias("repositories"), F.count(F.lit(1)).alias("n_repositories")))


def pivot_metric(df: DataFrame, model: str = "model", metric: str = "metric", value: str = "improvement",
                 metrics: Sequence[str] | None = None) -> DataFrame:
    """Mean value per model x metric, metrics as columns."""
    g = df.groupBy(model)
    return (g.pivot(metric, list(metrics)) if metrics else g.pivot(metric)).agg(F.avg(value))
