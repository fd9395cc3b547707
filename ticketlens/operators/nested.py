"""Nested-document operators: struct flattening, array unnesting and array features.

Array features are computed per document with higher-order functions
(``size``/``filter``/``aggregate``), so no explode or shuffle is needed for
them; where a flat child table exists (links, changes, comments as rows) the
same features come from a partial ``groupBy`` on the issue key.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.names import distinct_values
from ..functions.ranking import null_safe_join
from ..session import ship_package


def _q(name: str) -> str:
    return f"`{name}`"


# --------------------------------------------------------------------------
# N1 / N2 struct flattening
# --------------------------------------------------------------------------

def _flat_fields(schema: T.StructType, prefix: list[str]) -> list[list[str]]:
    out = []
    for f in schema.fields:
        path = prefix + [f.name]
        if isinstance(f.dataType, T.StructType) and f.dataType.fields:
            out.extend(_flat_fields(f.dataType, path))
        else:
            out.append(path)
    return out


def flatten_struct(df: DataFrame, sep: str = ".") -> DataFrame:
    """Every nested struct field becomes a column named by its path; arrays stay as they are."""
    cols = []
    for path in _flat_fields(df.schema, []):
        c = F.col(_q(path[0]))
        for p in path[1:]:
            c = c.getField(p)
        cols.append(c.alias(sep.join(path)))
    return df.select(*cols)


def expand_struct(df: DataFrame, col: str) -> DataFrame:
    """Replace one struct column by its fields (one level)."""
    fields = df.schema[col].dataType.fieldNames()
    others = [F.col(_q(c)) for c in df.columns if c != col]
    return df.select(*others, *[F.col(_q(col)).getField(f).alias(f) for f in fields])


# --------------------------------------------------------------------------
# N3-N6 changelog
# --------------------------------------------------------------------------

CHANGE_COLUMNS = ("field", "fieldtype", "from", "fromString", "to", "toString")


def flatten_changelog(df: DataFrame, histories: str = "changelog.histories") -> DataFrame:
    """One row per change item: issue_key (key, else id), history_id, author, created, item fields.

    Issues without histories produce no rows (inner unnest).
    """
    h = (df.select(F.coalesce(F.col("key"), F.col("id").cast("string")).alias("issue_key"),
                   F.explode(histories).alias("h")))
    items = h.select("issue_key",
                     F.col("h.id").alias("history_id"),
                     F.col("h.author.name").alias("author"),
                     F.col("h.created").alias("created"),
                     F.explode("h.items").alias("i"))
    return items.select("issue_key", "history_id", "author", "created",
                        *[F.col("i").getField(c).alias(c) for c in CHANGE_COLUMNS])


def unwind(df: DataFrame, array_col: str, alias: str | None = None) -> DataFrame:
    """Inner unnest; rows whose array is null or empty disappear."""
    name = alias or array_col.split(".")[-1]
    others = [F.col(_q(c)) for c in df.columns if c != array_col]
    return df.select(*others, F.explode(array_col).alias(name))


def collect_history(changes: DataFrame, key: str = "issue_key",
                    order: Sequence[str] = ("created", "history_id")) -> DataFrame:
    """Re-nest change rows per issue as one sorted array of structs (nulls kept aligned)."""
    cols = [c for c in changes.columns if c != key]
    lead = [c for c in order if c in cols]
    rest = [c for c in cols if c not in lead]
    return (changes.groupBy(key)
            .agg(F.array_sort(F.collect_list(F.struct(*[F.col(_q(c)) for c in lead + rest]))).alias("changes")))


def changelog_counts(changes: DataFrame, key: str = "issue_key", field: str = "field",
                     values: Sequence[str] | None = None) -> DataFrame:
    """One ``changelog_count_<field>`` column per field; 0 where the issue has other changes."""
    if values is None:
        from ..session import reuse

        changes = reuse(changes)
        values = distinct_values(changes, field)
    aggs = [F.count(F.when(F.col(field) == v, 1)).alias(f"changelog_count_{v}") for v in values]
    return changes.groupBy(key).agg(*aggs)


# --------------------------------------------------------------------------
# N7-N10 issue links
# --------------------------------------------------------------------------

def link_type_name(link: Column) -> Column:
    return F.lower(F.coalesce(link.getField("type").getField("name"), F.lit("Unknown")))


def link_features(df: DataFrame, links: str = "fields.issuelinks", key: str = "id",
                  values: Sequence[str] | None = None, compat: bool = False) -> DataFrame:
    """issuelinks_total and per type ``issuelinks_<t>_count`` / ``has_issuelinks_<t>``.

    Type names are lower-cased; a missing name is 'unknown'. Default: a type the
    issue lacks gets 0 and case variants are added together. ``compat=True``:
    absent types stay null and of two case variants the one seen last wins.
    """
    if values is None:
        from ..session import reuse

        # two passes (type names, then counts): materialise only the key and the link array, once
        df = reuse(df.select(F.col(_q(key)), F.col(links).alias("_links")))
        links = "_links"
    arr = F.col(links)
    if values is None:
        types = df.select(F.explode(arr).alias("l")).select(link_type_name(F.col("l")).alias("t"))
        values = distinct_values(types, "t")
    if not compat:
        cols = {"issuelinks_total": F.coalesce(F.size(arr), F.lit(0))}
        for t in values:
            n = F.coalesce(F.size(F.filter(arr, lambda x: link_type_name(x) == F.lit(t))), F.lit(0))
            cols[f"issuelinks_{t}_count"] = n
            cols[f"has_issuelinks_{t}"] = (n > 0).cast("int")
        return df.select(F.col(_q(key)), *[c.alias(n) for n, c in cols.items()])
    # compat: count per raw name, then the raw variant whose first position is last overwrites
    raw = (df.select(F.col(_q(key)).alias("_k"), F.posexplode(arr).alias("_pos", "_l"))
           .select("_k", "_pos", F.coalesce(F.col("_l.type.name"), F.lit("Unknown")).alias("_raw")))
    per_raw = raw.groupBy("_k", "_raw").agg(F.count(F.lit(1)).alias("_n"), F.min("_pos").alias("_first"))
    per_low = (per_raw.groupBy("_k", F.lower("_raw").alias("_t"))
               .agg(F.max_by("_n", "_first").alias("_n")))
    wide = per_low.groupBy("_k").agg(*[F.max(F.when(F.col("_t") == t, F.col("_n"))).alias(f"issuelinks_{t}_count")
                                       for t in values])
    wide = wide.withColumns({f"has_issuelinks_{t}": F.when(F.col(f"issuelinks_{t}_count") > 0, F.lit(1))
                             for t in values})
    base = df.select(F.col(_q(key)), F.coalesce(F.size(arr), F.lit(0)).alias("issuelinks_total"))
    return base.join(wide, base[key] == wide["_k"], "left").drop("_k")


def link_direction_counts(df: DataFrame, links: str = "fields.issuelinks") -> DataFrame:
    """inward_count / outward_count by which key is present; null array -> 0, 0."""
    arr = F.col(links)
    return df.withColumns({
        "inward_count": F.coalesce(F.size(F.filter(arr, lambda x: x.getField("inwardIssue").isNotNull())), F.lit(0)),
        "outward_count": F.coalesce(F.size(F.filter(arr, lambda x: x.getField("outwardIssue").isNotNull())), F.lit(0)),
    })


def link_direction_counts_flat(links: DataFrame, key: str = "issue_id", inward: str = "inward_key",
                               outward: str = "outward_key") -> DataFrame:
    """N8 over a flat link table: one row per issue with links (partial aggregation)."""
    return links.groupBy(key).agg(F.count(inward).alias("inward_count"), F.count(outward).alias("outward_count"))


def with_link_counts(issues: DataFrame, links: DataFrame, key: str = "id", link_key: str = "issue_id") -> DataFrame:
    """Issues with N8 counts joined on (missing links -> 0)."""
    counts = link_direction_counts_flat(links, link_key).withColumnRenamed(link_key, key)
    return (issues.join(counts, key, "left")
            .withColumns({"inward_count": F.coalesce("inward_count", F.lit(0)),
                          "outward_count": F.coalesce("outward_count", F.lit(0))}))


LINK_SCHEMA = T.ArrayType(T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StructType([T.StructField("name", T.StringType())])),
    T.StructField("inwardIssue", T.StructType([T.StructField("key", T.StringType())])),
    T.StructField("outwardIssue", T.StructType([T.StructField("key", T.StringType())])),
]))


def parse_links(col: str | Column, schema: T.DataType = LINK_SCHEMA) -> Column:
    """Python-literal list text -> array of link structs; blank or bad text -> empty array.

    Spark's JSON reader accepts single quotes, but a bare None/True/False makes
    the whole value null, so those literals are rewritten first.
    """
    c = F.col(col) if isinstance(col, str) else col
    txt = F.regexp_replace(c, r"\bNone\b", "null")
    txt = F.regexp_replace(txt, r"\bTrue\b", "true")
    txt = F.regexp_replace(txt, r"\bFalse\b", "false")
    parsed = F.from_json(txt, schema, {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.array().cast(schema))


def link_total(col: str | Column) -> Column:
    """Number of links in a parsed (or parsable text) link list; 0 when absent."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.size(c), F.lit(0))


# --------------------------------------------------------------------------
# N11 comments
# --------------------------------------------------------------------------

def comment_features(df: DataFrame, comments: str = "fields.comments") -> DataFrame:
    """comment_count, avg/max body length, unique non-null authors; empty or null -> 0."""
    arr = F.coalesce(F.col(comments), F.array())
    lengths = F.transform(arr, lambda c: F.length(F.coalesce(c.getField("body"), F.lit(""))))
    n = F.size(arr)
    authors = F.filter(F.transform(arr, lambda c: c.getField("author").getField("name")), lambda a: a.isNotNull())
    return df.withColumns({
        "comment_count": n,
        "avg_comment_length": F.when(n > 0, F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x) / n)
        .otherwise(F.lit(0.0)),
        "max_comment_length": F.coalesce(F.array_max(lengths), F.lit(0)),
        "unique_authors_count": F.size(F.array_distinct(authors)),
    })


def comment_features_flat(comments: DataFrame, key: str = "issue_id", body: str = "body",
                          author: str = "author") -> DataFrame:
    """N11 from a flat comment table (one row per comment) with partial aggregation."""
    ln = F.length(F.coalesce(F.col(body), F.lit("")))
    return comments.groupBy(key).agg(F.count(F.lit(1)).alias("comment_count"),
                                      F.avg(ln).alias("avg_comment_length"),
                                      F.max(ln).alias("max_comment_length"),
                                      F.countDistinct(author).alias("unique_authors_count"))


# --------------------------------------------------------------------------
# N12-N17 per-repository distinct counts and totals
# --------------------------------------------------------------------------

def _changes_of_field(df: DataFrame, field: str, repo: str) -> DataFrame:
    """fromString of change items on ``field``; the field filter runs on the array before explode."""
    items = F.flatten(F.transform(F.coalesce(F.col("changelog.histories"), F.array()),
                                  lambda h: F.filter(h.getField("items"), lambda i: i.getField("field") == field)))
    return (df.select(F.col(repo), F.explode(items).alias("i"))
            .select(repo, F.col("i.fromString").alias("value")))


def distinct_with_history(df: DataFrame, final_col: str, field: str, repo: str = "repository",
                          out: str = "n") -> DataFrame:
    """Per repository, count of distinct values in final state ∪ fromString of changes on ``field``.

    Null is not counted (a set accumulator in the source store would keep one null).
    """
    final = df.select(F.col(repo), F.col(final_col).alias("value"))
    both = final.unionByName(_changes_of_field(df, field, repo))
    counts = both.groupBy(repo).agg(F.countDistinct("value").alias(out))
    return null_safe_join(df.select(repo).distinct(), counts, [repo], "left").fillna(0, subset=[out])


def distinct_types_used(df: DataFrame, repo: str = "repository") -> DataFrame:
    """Issue types used (final ∪ history) per repository."""
    return distinct_with_history(df, "fields.issuetype.name", "issuetype", repo, "used_issue_types")


def distinct_projects(df: DataFrame, repo: str = "repository") -> DataFrame:
    """Projects used (final ∪ history) per repository."""
    return distinct_with_history(df, "fields.project.name", "project", repo, "used_projects")


def distinct_link_types(df: DataFrame, repo: str = "repository", links: str = "fields.issuelinks") -> DataFrame:
    """Distinct link type names over the unwound link arrays."""
    ex = df.select(repo, F.explode(links).alias("l"))
    counts = ex.groupBy(repo).agg(F.countDistinct("l.type.name").alias("used_link_types"))
    return null_safe_join(df.select(repo).distinct(), counts, [repo], "left").fillna(0, subset=["used_link_types"])


def count_links(df: DataFrame, repo: str = "repository", links: str = "fields.issuelinks",
                subtasks: str | None = "fields.subtasks", epic: Column | None = None) -> DataFrame:
    """Distinct link ids + Σ size(subtasks) + count of non-null epic links, per repository."""
    ids = (df.select(repo, F.explode(links).alias("l")).select(repo, F.col("l.id").alias("lid"))
           .groupBy(repo).agg(F.countDistinct("lid").alias("_links")))
    parts = [F.coalesce(F.sum(F.size(subtasks)), F.lit(0)).alias("_sub")] if subtasks and _has(df, subtasks) \
        else [F.lit(0).cast("long").alias("_sub")]
    parts.append(F.count(epic).alias("_epic") if epic is not None else F.lit(0).cast("long").alias("_epic"))
    other = df.groupBy(repo).agg(*parts)
    out = null_safe_join(other, ids, [repo], "left")
    return out.select(repo, (F.coalesce("_links", F.lit(0)) + F.col("_sub") + F.col("_epic")).alias("links"))


def _has(df: DataFrame, path: str) -> bool:
    """True when the dotted path exists in the schema (walks structs; no analysis error is raised)."""
    dt: T.DataType = df.schema
    for part in path.split("."):
        if not isinstance(dt, T.StructType) or part not in dt.fieldNames():
            return False
        dt = dt[part].dataType
    return True


def count_changes(df: DataFrame, repo: str = "repository") -> DataFrame:
    """Σ over issues of Σ items per history; no explode."""
    n = F.aggregate(F.coalesce(F.col("changelog.histories"), F.array()), F.lit(0),
                    lambda a, h: a + F.size(h.getField("items")))
    return df.groupBy(repo).agg(F.coalesce(F.sum(n), F.lit(0)).cast("long").alias("changes"))


def count_comments(df: DataFrame, repo: str = "repository", comments: str = "fields.comments") -> DataFrame:
    """Σ size(comments) over issues whose comment array is not null."""
    return df.groupBy(repo).agg(F.coalesce(F.sum(F.size(comments)), F.lit(0)).cast("long").alias("comments"))


# --------------------------------------------------------------------------
# N18 / N19 text vectors
# --------------------------------------------------------------------------

_LOADED: dict[str, object] = {}


def loaded_once(token: str, make):
    """What ``make()`` gives, made once in this process for ``token``; what an earlier query loaded is let go."""
    if token not in _LOADED:
        _LOADED.clear()
        _LOADED[token] = make()
    return _LOADED[token]


def embed_text(df: DataFrame, col: str = "text", out: str = "embedding", num_features: int = 256,
               idf: bool = True, encoder=None, load=None) -> DataFrame:
    """Null -> '' then encode each text to a dense float vector.

    ``encoder`` is a callable pandas.Series[str] -> list of vectors, run on Arrow
    batches. With ``load``, it is made in the worker: ``load()`` builds the
    encoder (a model from a shipped file, say) once per worker process, however
    many tasks and batches that runs. The default encoder is Spark ML's Tokenizer +
    HashingTF (+ IDF) + L2 Normalizer over the whole text, which needs no
    downloaded weights.
    """
    src = df.withColumn("_txt", F.coalesce(F.col(col).cast("string"), F.lit("")))
    if encoder is not None or load is not None:
        ship_package(df.sparkSession)
        make, token = load if load is not None else (lambda: encoder), uuid.uuid4().hex

        @F.pandas_udf(T.ArrayType(T.FloatType()))
        def _enc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            held = loaded_once(token, make)
            for s in parts:
                yield pd.Series([list(map(float, v)) for v in held(s)])

        return src.withColumn(out, _enc("_txt")).drop("_txt")
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import IDF, HashingTF, Normalizer, RegexTokenizer
    from pyspark.ml.functions import vector_to_array

    stages = [RegexTokenizer(inputCol="_txt", outputCol="_tok", pattern=r"\W+", minTokenLength=1),
              HashingTF(inputCol="_tok", outputCol="_tf", numFeatures=num_features)]
    last = "_tf"
    if idf:
        stages.append(IDF(inputCol="_tf", outputCol="_idf"))
        last = "_idf"
    stages.append(Normalizer(inputCol=last, outputCol="_vec", p=2.0))
    model = Pipeline(stages=stages).fit(src)
    res = model.transform(src).withColumn(out, vector_to_array("_vec", "float32"))
    return res.drop("_txt", "_tok", "_tf", "_idf", "_vec")


def expand_vector(df: DataFrame, col: str, prefix: str, dim: int | None = None, drop: bool = True) -> DataFrame:
    """array/vector column -> one column per dimension ``<prefix>_<i>``."""
    c = F.col(col)
    if dim is None:
        dim = df.select(F.max(F.size(c))).first()[0] or 0
    out = df.select("*", *[c[i].alias(f"{prefix}_{i}") for i in range(dim)])
    return out.drop(col) if drop else out


def drop_list_columns(df: DataFrame) -> DataFrame:
    """Drop every array/map column (type inference skips them in the reference)."""
    keep = [f.name for f in df.schema.fields if not isinstance(f.dataType, (T.ArrayType, T.MapType))]
    return df.select(*[F.col(_q(c)) for c in keep])
