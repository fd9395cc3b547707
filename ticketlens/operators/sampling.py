"""Ranking, top-k, bucketing, sampling and splits.

Reproducibility comes from hashing a key with a seed (md5) instead
of ``rand()``: the same row lands in the same sample or split after a retry,
on any cluster size. Per-group ranks use the range-partitioned ranking of
``functions.ranking`` so a hot group is split across tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranking import null_safe_join, row_number_in_groups
from ..functions.stats import quantiles
from ..sources.tables import small_side


def cumulative_importance(imp: DataFrame, feature: str = "feature", importance: str = "importance",
                          threshold: float = 0.9) -> DataFrame:
    """Running share of importance (largest first); keep rows up to the threshold plus the next one.

    Adds ``cumulative`` and ``rank``; the count of kept rows is the number of
    features needed to reach the threshold. The importance table has one row
    per feature, so a single ordered window is fine here.
    """
    total = imp.agg(F.sum(importance)).first()[0] or 0.0
    w = Window.orderBy(F.col(importance).desc(), feature).rowsBetween(Window.unboundedPreceding, 0)
    out = imp.withColumns({"cumulative": F.sum(importance).over(w) / F.lit(float(total)),
                           "rank": F.row_number().over(Window.orderBy(F.col(importance).desc(), feature))})
    prev = F.lag("cumulative", 1, 0.0).over(Window.orderBy("rank"))
    return out.withColumn("_prev", prev).where(F.col("_prev") < threshold).drop("_prev")


def average_rank_table(df: DataFrame, metrics: dict[str, bool], name: str = "model") -> DataFrame:
    """Rank every metric (True = higher is better), ties get the mean rank, average them, best first.

    For small result tables (one row per model).
    """
    out = df
    rank_cols = []
    for m, higher_better in metrics.items():
        o = F.col(m).desc() if higher_better else F.col(m).asc()
        r = F.rank().over(Window.orderBy(o))
        ties = F.count(F.lit(1)).over(Window.partitionBy(m))
        out = out.withColumn(f"rank_{m}", r + (ties - 1) / 2.0)
        rank_cols.append(F.col(f"rank_{m}"))
    avg = rank_cols[0]
    for c in rank_cols[1:]:
        avg = avg + c
    return out.withColumn("average_rank", avg / float(len(rank_cols))).orderBy("average_rank", name)


def qcut_edges(df: DataFrame, col: str, q: int = 10) -> list[float]:
    """Exact quantile edges 0, 1/q, ..., 1 with duplicates dropped (one aggregation)."""
    from ..functions.stats import column_quantiles

    probs = [i / q for i in range(q + 1)]
    edges = column_quantiles(df, [col], probs, True).get(col) or []
    out = []
    for e in edges:
        if not out or e != out[-1]:
            out.append(e)
    return out


def qcut_bins(df: DataFrame, col: str, q: int = 10, out: str = "bin", edges: Sequence[float] | None = None) -> DataFrame:
    """Decile bin index 0..k-1 with right-closed intervals (first includes the minimum), duplicate edges dropped."""
    edges = qcut_edges(df, col, q) if edges is None else list(edges)
    if len(edges) < 2:
        return df.withColumn(out, F.when(F.col(col).isNotNull(), F.lit(0)))
    inner = edges[1:-1]
    b = F.lit(0)
    for e in inner:
        b = b + (F.col(col) > F.lit(e)).cast("int")
    inside = (F.col(col) >= edges[0]) & (F.col(col) <= edges[-1])
    return df.withColumn(out, F.when(inside, b))


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows in the given order (TakeOrderedAndProject)."""
    return df.orderBy(*order).limit(k)


def best_by(df: DataFrame, value: str, score: str, higher_is_better: bool = True) -> DataFrame:
    """The value of the row with the best score (``max_by`` / ``min_by``)."""
    fn = F.max_by if higher_is_better else F.min_by
    return df.agg(fn(value, score).alias(f"best_{value}"), (F.max if higher_is_better else F.min)(score).alias(f"best_{score}"))


def earliest(df: DataFrame, created: str, n: int = 500, cols: Sequence[str] | None = None, tie: str | None = None) -> DataFrame:
    """The ``n`` earliest rows by ``created``, then by ``tie`` where given; null dates last."""
    src = df.select(*cols) if cols else df
    return src.orderBy(F.col(created).asc_nulls_last(), *([F.col(tie)] if tie else [])).limit(n)


HASH_DIGITS = 13   # hexadecimal digits of the hash: 52 bits, which a double holds exactly


def hash_order(key: Column, seed: int) -> Column:
    """A number of 52 bits that mixes key and seed: the first digits of md5("key:seed").

    Any SQL engine can repeat it. Two seeds order the keys independently; a
    null key hashes like the text "null".
    """
    text = F.concat(F.coalesce(key.cast("string"), F.lit("null")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text), 1, HASH_DIGITS), 16, 10).cast("long")


def hash_order_sql(key: str, seed: int) -> str:
    """:func:`hash_order` in DuckDB SQL."""
    return f"CAST(('0x' || substr(md5(coalesce(CAST({key} AS VARCHAR), 'null') || ':{seed}'), 1, {HASH_DIGITS})) AS BIGINT)"


def unit_hash(key: str, seed: int) -> Column:
    """A reproducible pseudo-uniform number in [0, 1) per key."""
    return hash_order(F.col(key), seed) / F.lit(float(1 << 4 * HASH_DIGITS))


def sample_exact(df: DataFrame, ratio: float, key: str, group: str | None = None, seed: int = 42) -> DataFrame:
    """Exactly max(1, int(n·ratio)) rows per group, without replacement, by seeded hash order."""
    keys = [group] if group else []
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumn("_take", F.greatest(F.lit(1), F.floor(F.col("_n") * F.lit(ratio))))
    ranked = row_number_in_groups(df, keys, [hash_order(F.col(key), seed), F.col(key)], "_r")
    if keys:
        joined = null_safe_join(ranked, counts.select(*keys, "_take"), keys)
    else:
        joined = ranked.withColumn("_take", F.lit(counts.first()["_take"]))
    return joined.where(F.col("_r") <= F.col("_take")).drop("_r", "_take")


def sample_frac(df: DataFrame, fraction: float, seed: int = 42, key: str | None = None) -> DataFrame:
    """Bernoulli-like sample; with ``key`` it is a seeded hash filter (stable under retries)."""
    if key is None:
        return df.sample(fraction=fraction, seed=seed)
    return df.where(unit_hash(key, seed) < fraction)


def random_split(df: DataFrame, weights: Sequence[float], key: str, seed: int = 42,
                 out: str = "split") -> DataFrame:
    """Assign each row a split index by seeded hash of its key (80/20, 60/20/20, ...)."""
    total = float(sum(weights))
    u = unit_hash(key, seed)
    expr = F.lit(len(weights) - 1)
    acc = 0.0
    bounds = []
    for w in weights[:-1]:
        acc += w / total
        bounds.append(acc)
    for i, b in reversed(list(enumerate(bounds))):
        expr = F.when(u < F.lit(b), F.lit(i)).otherwise(expr)
    return df.withColumn(out, expr)


def stratified_split(df: DataFrame, stratum: str, key: str, test_fraction: float = 0.2, seed: int = 42,
                     out: str = "is_test") -> DataFrame:
    """Per stratum, the first round(fraction·count) rows in seeded hash order go to the test split."""
    counts = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    ranked = row_number_in_groups(df, [stratum], [hash_order(F.col(key), seed), F.col(key)], "_r")
    joined = null_safe_join(ranked, counts, [stratum])
    return joined.withColumn(out, (F.col("_r") <= F.round(F.col("_n") * F.lit(test_fraction))).cast("int")) \
        .drop("_r", "_n")


def select_projects(counts: DataFrame, target: int, project: str = "project_id", n: str = "issues") -> list:
    """Greedy project mix near ``target`` issues from a per-project count table.

    Small (< 0.2·target), medium, large (>= 0.6·target) projects: the best large
    one up to 1.3·target, then mediums (smallest first) up to 0.7·target, smalls
    (largest first, each <= 1.2 of what remains) up to 0.9·target, one more if
    still < 0.8·target. The count table has one row per project, so the greedy
    step runs on the driver over that collected table; the chosen ids are then
    used in a ``left_semi`` join (``fetch_projects``).
    """
    rows = sorted(((r[project], int(r[n])) for r in counts.select(project, n).collect()), key=lambda x: (x[1], str(x[0])))
    small = [r for r in rows if r[1] < 0.2 * target]
    large = [r for r in rows if r[1] >= 0.6 * target]
    medium = [r for r in rows if 0.2 * target <= r[1] < 0.6 * target]
    chosen, total = [], 0
    fit = [r for r in large if r[1] <= 1.3 * target]
    if fit:
        best = max(fit, key=lambda r: (r[1], str(r[0])))
        chosen.append(best[0])
        total += best[1]
    for pid, c in medium:
        if total >= 0.7 * target:
            break
        chosen.append(pid)
        total += c
    for pid, c in sorted(small, key=lambda r: (-r[1], str(r[0]))):
        if total >= 0.9 * target:
            break
        if c <= 1.2 * (target - total):
            chosen.append(pid)
            total += c
    if total < 0.8 * target:
        rest = [r for r in rows if r[0] not in set(chosen)]
        if rest:
            chosen.append(rest[-1][0])
    return chosen


def fetch_projects(df: DataFrame, chosen: Sequence, project: str = "project_id", fallback_rows: int = 500,
                   key: str | None = None, seed: int = 42) -> DataFrame:
    """W8 second step: all issues of the chosen projects (semi join against the chosen ids).

    The id list comes from the per-project count table, so its size is bounded
    by the number of projects. When nothing was chosen, ``fallback_rows`` issues
    in seeded hash order of ``key`` are returned instead (the reference takes a
    random sample of that size).
    """
    if not chosen:
        k = key or df.columns[0]
        return df.orderBy(hash_order(F.col(k), seed), F.col(k)).limit(fallback_rows)
    ids = df.sparkSession.createDataFrame([(c,) for c in chosen], df.select(project).schema)
    return df.join(small_side(ids), project, "left_semi")
