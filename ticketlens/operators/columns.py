"""Schema-level operators whose column set depends on the data.

Pattern: one aggregation computes a small per-column statistic row (null
share, numeric share, zero share, min/max, correlations) over the whole
table; only that row reaches the driver, which decides the projection; the
projection itself is one ``select``. Wide tables are aggregated in chunks of
columns so generated code stays under the JVM method-size limits.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import distinct_values, dummy_safe
from ..functions.stats import pearson

AGG_CHUNK = 200
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


def q(name: str) -> Column:
    return F.col(f"`{name}`")


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, NUMERIC)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]


def column_stats(df: DataFrame, exprs: Mapping[str, Column]) -> dict[str, object]:
    """Evaluate many aggregate expressions in as few passes as the codegen limit allows."""
    items = list(exprs.items())
    out: dict[str, object] = {}
    for i in range(0, len(items), AGG_CHUNK):
        part = items[i:i + AGG_CHUNK]
        row = df.agg(*[e.alias(f"_s{j}") for j, (_, e) in enumerate(part)]).first()
        out.update({name: row[j] for j, (name, _) in enumerate(part)})
    return out


# --------------------------------------------------------------------------
# F1 type inference
# --------------------------------------------------------------------------

def numeric_share(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    """Share of ALL rows (nulls count as failures) whose text parses as a number."""
    cols = string_columns(df) if cols is None else list(cols)
    return column_stats(df, {c: F.avg(q(c).try_cast("double").isNotNull().cast("double")) for c in cols})


def infer_types(df: DataFrame, numeric_threshold: float = 0.9) -> DataFrame:
    """a text column becomes double when >= threshold of all rows parse; list/map columns untouched."""
    share = numeric_share(df)
    to_num = {c for c, s in share.items() if s is not None and s >= numeric_threshold}
    return df.select(*[q(c).try_cast("double").alias(c) if c in to_num else q(c) for c in df.columns])


def coerce_numeric(df: DataFrame, except_prefixes: Sequence[str] = ("fields.issuetype", "fields.priority")) -> DataFrame:
    """every column except the excluded prefixes cast to double; failures become null."""
    def keep(c: str) -> bool:
        return any(c.startswith(p) for p in except_prefixes)
    sel = []
    for f in df.schema.fields:
        c = f.name
        if keep(c) or isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            sel.append(q(c))
        else:
            sel.append(q(c).try_cast("double").alias(c))
    return df.select(*sel)


def bool_to_int(df: DataFrame) -> DataFrame:
    """boolean columns -> int."""
    return df.select(*[q(f.name).cast("int").alias(f.name) if isinstance(f.dataType, T.BooleanType) else q(f.name)
                       for f in df.schema.fields])


def inf_to_null(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and +-inf -> null in floating columns."""
    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cols = fl if cols is None else [c for c in cols if c in fl]
    s = set(cols)
    return df.select(*[F.when(~F.isnan(q(c)) & (F.abs(q(c)) != F.lit(float("inf"))), q(c)).alias(c) if c in s
                       else q(c) for c in df.columns])


def inf_to_median(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN and +-inf -> the exact median of the column's finite values (null where there are none); nulls stay."""
    from ..functions.stats import column_quantiles, finite_or_null

    fl = [f.name for f in df.schema.fields if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    cols = fl if cols is None else [c for c in cols if c in fl]
    medians = column_quantiles(df.select(*[finite_or_null(q(c)).alias(c) for c in cols]), cols, [0.5])
    middle = {c: (medians[c] or [None])[0] for c in cols}
    return df.select(*[F.when(q(c).isNull() | finite_or_null(q(c)).isNotNull(), q(c)).otherwise(F.lit(middle[c]).cast("double")).alias(c)
                       if c in middle else q(c) for c in df.columns])


# Keywords of the columns whose negatives are clamped to 0.
CLIP_KEYWORDS = ("count", "hours", "duration")


def clip_negative(df: DataFrame, keywords: Sequence[str] = CLIP_KEYWORDS) -> DataFrame:
    """negatives -> 0 in numeric columns whose name contains a keyword."""
    num = set(numeric_columns(df))
    hit = {c for c in num if any(k in c.lower() for k in keywords)}
    return df.select(*[F.greatest(q(c), F.lit(0)).alias(c) if c in hit else q(c) for c in df.columns])


def clean_name(name: str) -> str:
    n = name[len("fields."):] if name.startswith("fields.") else name
    n = n.replace("_<lambda>", "")
    return re.sub(r"[\[\]<>]", "_", n)


def clean_names(df: DataFrame) -> DataFrame:
    """strip ``fields.`` and ``_<lambda>``; ``[ ] < >`` -> ``_``."""
    return df.toDF(*[clean_name(c) for c in df.columns])


# Name parts that mark an identifier column.
IDENTIFIER_PARTS = ("project", "key", "name", "id", "source", "repository", "file")


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """drop the listed columns; unknown names are ignored."""
    present = [n for n in names if n in df.columns]
    return df.drop(*present) if present else df


def drop_identifier_columns(df: DataFrame, parts: Sequence[str] = IDENTIFIER_PARTS) -> DataFrame:
    """drop non-numeric columns whose name contains an identifier part."""
    num = set(numeric_columns(df))
    return drop_columns(df, [c for c in df.columns if c not in num and any(p in c.lower() for p in parts)])


def drop_string_columns(df: DataFrame) -> DataFrame:
    """drop every string column."""
    return drop_columns(df, string_columns(df))


def exclude_patterns(df: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """drop columns whose name contains any of the patterns."""
    return drop_columns(df, [c for c in df.columns if any(p in c for p in patterns)])


# --------------------------------------------------------------------------
# F7-F9 one-hot encodings
# --------------------------------------------------------------------------

def one_hot_values(df: DataFrame, col: str, prefix: str, values: Sequence[str] | None = None) -> DataFrame:
    """one int 0/1 column per distinct value named ``prefix + safe(value)``; null -> 0.

    Values whose safe names collide are merged into one column (``isin``).
    """
    if values is None:
        from ..session import reuse

        df = reuse(df)
        values = distinct_values(df, col)
    groups: dict[str, list[str]] = {}
    for v in values:
        groups.setdefault(prefix + dummy_safe(v), []).append(v)
    return df.withColumns({name: F.coalesce(q(col).isin(*vs), F.lit(False)).cast("int")
                           for name, vs in groups.items()})


# The seven issue types and five priority levels of the fixed dummies.
FIXED_TYPES = ("Bug", "Task", "Story", "Improvement", "New Feature", "Epic", "Sub-task")
FIXED_PRIORITIES = ("Blocker", "Critical", "Major", "Minor", "Trivial")


def one_hot_fixed(df: DataFrame, type_col: str = "fields.issuetype.name",
                  priority_col: str = "fields.priority.name",
                  types: Sequence[str] = FIXED_TYPES, priorities: Sequence[str] = FIXED_PRIORITIES) -> DataFrame:
    """F8: ``is_type_*`` (lower-case equality) and ``is_priority_*`` (lower-case substring) as double."""
    cols = {}
    if type_col in df.columns:
        for t in types:
            cols[f"is_type_{t.lower().replace(' ', '_')}"] = \
                F.coalesce(F.lower(q(type_col)) == t.lower(), F.lit(False)).cast("double")
    if priority_col in df.columns:
        for p in priorities:
            cols[f"is_priority_{p.lower()}"] = \
                F.coalesce(F.lower(q(priority_col)).contains(p.lower()), F.lit(False)).cast("double")
    return df.withColumns(cols) if cols else df


def get_dummies(df: DataFrame, cols: Sequence[str] | None = None, drop_first: bool = True) -> DataFrame:
    """one-hot of string columns (levels sorted, the first dropped); the source column is removed."""
    from ..session import reuse

    cols = string_columns(df) if cols is None else list(cols)
    df = reuse(df)
    out = df
    for c in cols:
        levels = distinct_values(df, c)
        if drop_first:
            levels = levels[1:]
        out = out.withColumns({f"{c}_{v}": F.coalesce(q(c) == v, F.lit(False)).cast("int") for v in levels})
    return out.drop(*cols)


# --------------------------------------------------------------------------
# C2-C3 harmonising ragged column names
# --------------------------------------------------------------------------

_SUFFIX = r"(?:_-_p\d+|___p\d+)?"


def standard_name(col: str, compat: bool = False) -> str:
    """Map a roll-up column name to its standard spelling.

    ``compat=False`` strips the ``_-_p3`` / ``___p3`` priority suffixes with a
    lazy group; ``compat=True`` keeps the greedy group, which never strips them.
    """
    g = r"([\w-]+)" if compat else r"([\w-]+?)"
    m = re.match(rf"priority_{g}{_SUFFIX}_type_([\w-]+)_(count|avg_resolution_hours)$", col)
    if m:
        return f"priority_{m.group(1)}_type_{m.group(2).replace('-', '_')}_{m.group(3)}"
    m = re.match(rf"priority_{g}{_SUFFIX}_(count|pct)$", col)
    if m:
        return f"priority_{m.group(1)}_{m.group(2)}"
    m = re.match(r"type_([\w-]+)_resolution_rate$", col)
    if m:
        return f"type_{m.group(1).replace('-', '_')}_resolution_rate"
    m = re.match(r"type_([\w-]+)_(count|pct)$", col)
    if m:
        return f"type_{m.group(1).replace('-', '_')}_{m.group(2)}"
    return col


def standardise_names(df: DataFrame, compat: bool = False) -> DataFrame:
    """C2 + C3: rename to standard names and merge variants that meet (first non-null wins)."""
    return coalesce_variants(df, {c: standard_name(c, compat) for c in df.columns}, compat)


def coalesce_variants(df: DataFrame, mapping: Mapping[str, str], compat: bool = False) -> DataFrame:
    """Columns mapped to one standard name become ``coalesce`` of the variants in column order.

    ``compat=True`` reproduces the reference's drop, which removes the merged
    column together with its duplicates.
    """
    groups: dict[str, list[str]] = {}
    for c in df.columns:
        groups.setdefault(mapping.get(c, c), []).append(c)
    sel = []
    for std, variants in groups.items():
        if len(variants) == 1:
            sel.append(q(variants[0]).alias(std))
        elif not compat:
            sel.append(F.coalesce(*[q(v) for v in variants]).alias(std))
    return df.select(*sel)


# --------------------------------------------------------------------------
# C4-C10 data-driven projections
# --------------------------------------------------------------------------

def null_shares(df: DataFrame, cols: Sequence[str] | None = None) -> dict[str, float]:
    cols = df.columns if cols is None else list(cols)
    return column_stats(df, {c: F.avg(q(c).isNull().cast("double")) for c in cols})


def drop_high_missing(df: DataFrame, threshold: float = 0.3) -> DataFrame:
    """C4: keep columns whose null share is <= threshold."""
    s = null_shares(df)
    return df.select(*[q(c) for c in df.columns if (s[c] or 0.0) <= threshold])


def zero_shares(df: DataFrame, cols: Sequence[str]) -> dict[str, float]:
    return column_stats(df, {c: F.avg(F.coalesce(q(c) == 0, F.lit(False)).cast("double")) for c in cols})


def drop_zero_dominated(df: DataFrame, prefix: str = "changelog_count_", threshold: float = 0.8) -> DataFrame:
    """Drop numeric columns of the prefix whose share of zeros exceeds the threshold (null is not zero)."""
    cand = [c for c in numeric_columns(df) if c.startswith(prefix)]
    s = zero_shares(df, cand)
    return drop_columns(df, [c for c in cand if (s[c] or 0.0) > threshold])


def constant_columns(df: DataFrame) -> list[str]:
    """Columns with at most one distinct non-null value (``min == max`` or all null)."""
    cols = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType))]
    st = column_stats(df, {f"{c}\u0000{k}": e for c in cols
                           for k, e in (("min", F.min(q(c))), ("max", F.max(q(c))))})
    return [c for c in cols if st[f"{c}\u0000min"] is None or st[f"{c}\u0000min"] == st[f"{c}\u0000max"]]


def drop_constant(df: DataFrame) -> DataFrame:
    """Drop columns with <= 1 distinct value."""
    return drop_columns(df, constant_columns(df))


def presence_by_group(df: DataFrame, group: str) -> DataFrame:
    """(group, column, present) long table: is the column non-null anywhere in the group."""
    cols = [c for c in df.columns if c != group]
    wide = df.groupBy(group).agg(*[F.max(q(c).isNotNull().cast("int")).alias(c) for c in cols])
    return wide.unpivot([group], [q(c) for c in cols], "column", "present")


def common_columns(df: DataFrame, group: str = "repository", share: float = 0.35) -> list[str]:
    """Columns non-null in at least ``share`` of the groups."""
    pres = presence_by_group(df, group)
    rows = pres.groupBy("column").agg(F.avg("present").alias("s")).collect()
    keep = {r["column"] for r in rows if r["s"] >= share}
    return [c for c in df.columns if c in keep or c == group]


def align_columns(df: DataFrame, columns: Sequence[str], fill=0) -> DataFrame:
    """Reindex to the training columns; missing -> ``fill``, extra columns dropped."""
    have = set(df.columns)
    return df.select(*[q(c) if c in have else F.lit(fill).alias(c) for c in columns])


def feature_report(df: DataFrame, wanted: Sequence[str], suspicious: Sequence[str] = ()) -> DataFrame:
    """Per wanted or suspicious feature its status (available, absent, suspicious) and its rows with a value (null if absent).

    One aggregation over the columns that are there; names in ``suspicious``
    that ``df`` does not hold are left out.
    """
    have = set(df.columns)
    names = list(dict.fromkeys([*wanted, *(s for s in suspicious if s in have)]))
    held = df.agg(*[(F.count(q(c)) if c in have else F.lit(None).cast("long")).alias(f"_f{i}") for i, c in enumerate(names)])
    status = ["suspicious" if c in suspicious else "available" if c in have else "absent" for c in names]
    rows = F.array(*[F.struct(F.lit(c).alias("feature"), F.lit(s).alias("status"), F.col(f"_f{i}").alias("filled_rows"))
                     for i, (c, s) in enumerate(zip(names, status))])
    return held.select(F.explode(rows).alias("_r")).select("_r.*")


def corr_with(df: DataFrame, target: str, cols: Sequence[str] | None = None) -> dict[str, float]:
    """Pearson correlation of each numeric column with the target (pairwise complete)."""
    cols = [c for c in (numeric_columns(df) if cols is None else cols) if c != target]
    return column_stats(df, {c: pearson(q(c), q(target)) for c in cols})


# Name parts that mark a target-leaking feature.
LEAKY_TERMS = ("resolution_hours", "resolution_time", "hours_", "time_spent")


def drop_leaky(df: DataFrame, target: str, threshold: float = 0.8, suspects: Sequence[str] = (),
               terms: Sequence[str] = LEAKY_TERMS) -> DataFrame:
    """Drop fixed suspects, features with corr(feature, target) > threshold, and leaking names."""
    corr = corr_with(df, target)
    drop = set(s for s in suspects if s in df.columns)
    drop |= {c for c, r in corr.items() if r is not None and r > threshold}
    drop |= {c for c in df.columns if c != target and any(t in c for t in terms)}
    return drop_columns(df, sorted(drop))


def corr_pairs(df: DataFrame, cols: Sequence[str]) -> dict[tuple[str, str], float]:
    """Upper-triangle pairwise Pearson correlations, pairwise complete like pandas."""
    pairs = [(a, b) for i, a in enumerate(cols) for b in cols[i + 1:]]
    st = column_stats(df, {f"{a}\u0000{b}": pearson(q(a), q(b)) for a, b in pairs})
    return {(a, b): st[f"{a}\u0000{b}"] for a, b in pairs}


def drop_collinear(df: DataFrame, threshold: float = 0.95, target: str | None = None,
                   cols: Sequence[str] | None = None) -> DataFrame:
    """For each pair with |corr| > threshold drop the later column, or with a target the one
    less correlated with it."""
    cols = [c for c in (numeric_columns(df) if cols is None else cols) if c != target]
    pc = corr_pairs(df, cols)
    tc = corr_with(df, target, cols) if target else {}
    drop: set[str] = set()
    for (a, b), r in pc.items():
        if r is None or abs(r) <= threshold:
            continue
        if not target:
            drop.add(b)  # any column highly correlated with an earlier one goes
        elif a not in drop and b not in drop:
            ra, rb = abs(tc.get(a) or 0.0), abs(tc.get(b) or 0.0)
            drop.add(b if ra >= rb else a)
    return drop_columns(df, sorted(drop))
