"""Hand-made cases from FIXTURES.md §3 (nested traps, null rules, small-group statistics)."""

import math

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketlens.functions import dates as D
from ticketlens.functions import derive as V
from ticketlens.functions.ranking import average_ranks, row_number_in_groups
from ticketlens.operators import columns as C
from ticketlens.operators import nested as N
from ticketlens.operators import project as P
from ticketlens.operators import stats as S
from ticketlens.operators import sampling as W


def test_flatten_changelog_no_history_and_no_key(spark):
    item = "struct<field:string,fieldtype:string,from:string,fromString:string,to:string,toString:string>"
    schema = f"id string, key string, changelog struct<histories: array<struct<id:string, author:struct<name:string>, created:string, items: array<{item}>>>>"
    rows = [("1", None, {"histories": [{"id": "h", "author": {"name": "a"}, "created": "2020",
                                          "items": [{"field": "status", "fieldtype": "custom", "from": None,
                                                     "fromString": "Open", "to": None, "toString": "Done"}]}]}),
            ("2", "K-2", {"histories": []})]
    df = spark.createDataFrame(rows, schema)
    out = N.flatten_changelog(df).collect()
    assert len(out) == 1 and out[0]["issue_key"] == "1" and out[0]["toString"] == "Done"
    counts = N.changelog_counts(N.flatten_changelog(df)).collect()
    assert counts[0]["changelog_count_status"] == 1


def _links_df(spark, names):
    schema = T.StructType([T.StructField("id", T.StringType()), T.StructField("issuelinks", N.LINK_SCHEMA)])
    links = [{"id": str(i), "type": {"name": n}, "inwardIssue": {"key": "X"}, "outwardIssue": None}
             for i, n in enumerate(names)]
    return spark.createDataFrame([("1", links)], schema)


def test_link_type_null_and_case_clash(spark):
    df = _links_df(spark, [None, "Blocks", "blocks"])
    row = N.link_features(df, "issuelinks").first()
    assert row["issuelinks_unknown_count"] == 1 and row["issuelinks_blocks_count"] == 2
    row_c = N.link_features(df, "issuelinks", compat=True).first()
    assert row_c["issuelinks_blocks_count"] == 1 and row_c["issuelinks_total"] == 3


def test_parse_python_literal_links(spark):
    df = spark.createDataFrame([("[{'id': '1', 'inwardIssue': {'key': None}}]",), ("",), ("oops",), (None,)], "t string")
    out = df.select(N.link_total(N.parse_links("t")).alias("n"),
                    F.size(F.filter(N.parse_links("t"), lambda x: x["inwardIssue"].isNotNull())).alias("inw")).collect()
    assert [r["n"] for r in out] == [1, 0, 0, 0]
    assert [r["inw"] for r in out] == [1, 0, 0, 0]


def test_comment_author_null(spark):
    schema = "id string, comments array<struct<body:string, author:struct<name:string>>>"
    df = spark.createDataFrame([("1", [{"body": "ab", "author": {"name": None}}, {"body": "abcd", "author": {"name": "x"}}]),
                                ("2", None)], schema)
    out = {r["id"]: r for r in N.comment_features(df, "comments").collect()}
    assert out["1"]["comment_count"] == 2 and out["1"]["unique_authors_count"] == 1
    assert out["1"]["avg_comment_length"] == 3.0 and out["1"]["max_comment_length"] == 4
    assert out["2"]["comment_count"] == 0 and out["2"]["avg_comment_length"] == 0.0


def test_status_and_dates(spark):
    df = spark.createDataFrame([("Unresolved", "Missing"), (None, " "), ("Open", "2021-07-27T13:17:50.000+0000")],
                               "s string, d string")
    out = df.select(V.is_completed("s").alias("c"), D.parse_utc_timestamp("d").alias("t")).collect()
    assert [r["c"] for r in out] == [1, 0, 0]
    assert out[0]["t"] is None and out[1]["t"] is None and out[2]["t"] is not None


def test_type_inference_threshold(spark):
    vals90 = [str(i) for i in range(9)] + ["x"]
    vals89 = [str(i) for i in range(89)] + ["x"] * 10 + [None]
    a = spark.createDataFrame([(v,) for v in vals90], "c string")
    b = spark.createDataFrame([(v,) for v in vals89], "c string")
    assert dict(C.infer_types(a).dtypes)["c"] == "double"
    assert dict(C.infer_types(b).dtypes)["c"] == "string"


def test_small_group_statistics(spark):
    df = spark.createDataFrame([(1, 0.0), (2, 0.0), (2, 5.0)], "project_id int, h double")
    df = df.withColumn("resolution_time_hours", F.col("h")).withColumn("resolutiondate", F.lit("x")) \
        .withColumn("created", F.current_timestamp()).withColumn("is_resolved", F.lit(1)) \
        .withColumn("created_day_of_week", F.lit(0)).withColumn("resolved_day_of_week", F.lit(0))
    rows = {r["project_id"]: r for r in P.resolution_stats(df).collect()}
    assert rows[1]["resolution_hours_std"] is None and rows[1]["resolution_time_skewness"] is None
    assert rows[2]["resolution_time_skewness"] is None and rows[2]["resolution_time_kurtosis"] is None


def test_resolved_before_created(spark):
    df = spark.createDataFrame([("2020-01-01 01:00:00", "2020-01-01 00:00:00")], "c string, r string") \
        .select(F.to_timestamp("c").alias("c"), F.to_timestamp("r").alias("r"))
    row = df.select(D.resolution_time_days("c", "r").alias("d"), D.resolution_time_hours("c", "r").alias("h")).first()
    assert row["d"] is None and row["h"] == -1.0


def test_gini_properties(spark):
    eq = spark.createDataFrame([(5,)] * 4, "v int")
    assert abs(S.gini(eq, "v").first()["gini"]) < 1e-6
    one = spark.createDataFrame([(0,), (0,), (0,), (100,)], "v int")
    assert abs(S.gini(one, "v").first()["gini"] - 0.75) < 1e-6
    neg = spark.createDataFrame([(-1,), (1,)], "v int")
    x = [0 + 1e-7, 2 + 1e-7]
    expect = ((2 * 1 - 2 - 1) * x[0] + (2 * 2 - 2 - 1) * x[1]) / (2 * sum(x))
    assert abs(S.gini(neg, "v").first()["gini"] - expect) < 1e-9


@pytest.mark.parametrize("parts", [1, 16])
def test_ranking_split_and_unsplit_match_window(spark, parts):
    """A forced split of the groups and no split give the window's ranks; a null group is a group."""
    from pyspark.sql import Window

    spark.conf.set("spark.sql.shuffle.partitions", parts)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", parts == 1)
    df = spark.range(0, 3000).select(F.when(F.col("id") % 5 != 0, (F.col("id") % 3 == 0).cast("int")).alias("g"),
                                      F.col("id"), (F.col("id") * 7919 % 1000).alias("v"))
    ref = df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
    try:
        got = row_number_in_groups(df, ["g"], [F.col("v"), F.col("id")], "r")
        assert sorted(ref.select("g", "id", "r").collect(), key=repr) == sorted(got.select("g", "id", "r").collect(), key=repr)
        avg = average_ranks(spark.createDataFrame([(1,), (1,), (2,)], "v int"), [], "v", "ar")
        assert sorted(r["ar"] for r in avg.collect()) == [1.5, 1.5, 3.0]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", True)


def test_null_groups_and_empty_inputs_are_kept(spark):
    from ticketlens.functions.ranking import exact_quantiles, first_k_per_group
    from ticketlens.operators import stats as S

    df = spark.range(0, 30).select(F.when(F.col("id") % 3 != 0, F.lit("a")).alias("g"), F.col("id"), F.col("id").cast("double").alias("v"))
    assert W.stratified_split(df, "g", "id", 0.2).count() == 30
    assert W.sample_exact(df, 1.0, "id", "g").count() == 30
    assert {r.g for r in S.gini(df, "v", ["g"]).collect()} == {"a", None}
    assert {r.g: r.quantiles for r in exact_quantiles(df, ["g"], "v", [0.5]).collect()} == {"a": [15.0], None: [13.5]}
    none = df.limit(0)
    assert exact_quantiles(none, ["g"], "v", [0.5]).collect() == []
    assert exact_quantiles(none, [], "v", [0.5]).first()[0] == [None]
    assert first_k_per_group(none, ["g"], [F.col("v")], 2).collect() == []
    assert W.sample_exact(none, 0.5, "id", "g").collect() == []


def test_two_seeds_are_independent(spark):
    df = spark.range(0, 15000)
    splits = [{r.id for r in W.random_split(df, [0.8, 0.2], "id", seed).where("split = 1").collect()} for seed in (42, 43)]
    both = len(splits[0] & splits[1])
    assert all(abs(len(s) - 3000) < 250 for s in splits) and abs(both - 600) < 120
    taken = sorted(splits[0])
    near = sum(1 for i in taken if i + 5 in splits[0]) / len(taken)
    assert abs(near - 0.2) < 0.04          # membership of neighbouring keys is not correlated


def test_ragged_csv_is_read_by_name(spark, tmp_path):
    from ticketlens.sources import files as FS

    for name, text in {"one/x.csv": "id,a,b\n1,2,3\n4,,\n5\n", "one/y z.csv": "id,b\n6,7\n", "two/z.csv": "id,b,a\n8,77,55\n", "two/empty.csv": ""}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    got = FS.read_csv_tree(spark, str(tmp_path)).select("id", "a", "b", "repository", "source_file").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([("1", "2", "3", "one", "x.csv"), ("4", None, None, "one", "x.csv"), ("5", None, None, "one", "x.csv"),
                                                        ("6", None, "7", "one", "y z.csv"), ("8", "55", "77", "two", "z.csv")], key=repr)
    (tmp_path / "two" / "long.csv").write_text("id,b,a\n1,2,3,4\n")
    with pytest.raises(Exception, match="more values than the header"):
        FS.read_csv_tree(spark, str(tmp_path)).collect()


def test_mode_and_median_imputation(spark):
    from ticketlens.operators import impute as I

    df = spark.createDataFrame([("a", 1.0), ("b", 2.0), ("a", 10.0), ("b", 20.0), (None, None)], "c string, x double")
    out = I.impute(df, numeric="median", categorical="mode").collect()
    assert out[-1]["x"] == 6.0 and out[-1]["c"] == "a"


def test_unresolved_age_factor(spark):
    from ticketlens.operators import impute as I

    df = spark.createDataFrame([("Bug", "Major", 10.0, 1.0), ("Bug", "Major", None, 900.0)],
                               "t string, p string, h double, age double")
    out = I.impute_unresolved_hours(df, "h", ["t", "p"], "age").collect()
    assert out[1]["h"] == pytest.approx(20.0)


def test_priority_variants_merge(spark):
    df = spark.createDataFrame([(1.0, None), (None, 2.0)], "`priority_major_-_p3_count` double, `priority_major___p3_count` double")
    assert C.standardise_names(df).columns == ["priority_major_count"]
    assert [r[0] for r in C.standardise_names(df).collect()] == [1.0, 2.0]
    assert len(C.standardise_names(df, compat=True).columns) == 2


def test_constant_column_scaling(spark):
    from ticketlens.operators import scale as SC

    df = spark.createDataFrame([(3.0,), (3.0,)], "x double")
    for kind in ("standard", "minmax", "robust"):
        params = SC.fit_scaler(df, ["x"], kind)
        assert [r["x"] for r in SC.apply_scaler(df, params).collect()] == [0.0, 0.0]


def test_splits_are_disjoint_and_complete(spark):
    df = spark.range(0, 1000)
    s = W.random_split(df, [0.8, 0.2], "id")
    assert s.count() == 1000 and set(r[0] for r in s.select("split").distinct().collect()) == {0, 1}


def test_first_k_per_group_matches_window(spark):
    from pyspark.sql import Window

    from ticketlens.functions.ranking import first_k_per_group

    df = spark.range(0, 2000).select((F.col("id") % 7).alias("g"), ((F.col("id") * 7919) % 997).alias("v"), "id")
    ref = (df.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy("v", "id")))
           .where("r <= 3").select("g", "id", "r").collect())
    few = first_k_per_group(df, ["g"], [F.col("v"), F.col("id")], 3, "r").select("g", "id", "r").collect()
    assert sorted(ref) == sorted(few)


def test_exact_quantiles_match_percentile(spark):
    from ticketlens.functions.ranking import exact_quantiles

    df = spark.range(0, 5000).select((F.col("id") % 2).alias("g"), ((F.col("id") * 31) % 1013).cast("double").alias("x"))
    want = {r["g"]: r["q"] for r in df.groupBy("g").agg(F.percentile("x", [0.1, 0.5, 0.9]).alias("q")).collect()}
    got = {r["g"]: r["quantiles"] for r in exact_quantiles(df, ["g"], "x", [0.1, 0.5, 0.9]).collect()}
    assert all(all(abs(a - b) < 1e-9 for a, b in zip(got[k], want[k])) for k in want)


def test_batched_group_imputation_matches_single_column(spark):
    from ticketlens.operators import impute as I

    df = spark.createDataFrame([("a", 1.0, "x"), ("a", None, None), ("a", 3.0, "y"), ("b", None, None),
                                ("b", 10.0, "z"), (None, None, None)], "g string, v double, t string")
    one = I.impute_group_mode(I.impute_group_median(df, "v", ["g"]), "t", ["g"]).orderBy("g", "v", "t").collect()
    many = I.impute_by_group(df, ["v"], ["t"], ["g"]).orderBy("g", "v", "t").collect()
    assert [tuple(r) for r in one] == [tuple(r) for r in many]
    assert all(r["v"] is not None and r["t"] is not None for r in many)


def test_yeo_johnson_standardised(spark):
    from ticketlens.operators import scale as SC

    df = spark.range(1, 400).select(((F.col("id") * 37) % 101 + F.col("id") / 7.0).alias("x"))
    out = SC.scale_yeo_johnson(df, ["x"]).agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    assert abs(out["m"]) < 1e-9 and abs(out["s"] - 1.0) < 1e-6
    lam = SC.fit_yeo_johnson(df, ["x"]).first()["lam"]
    assert -2.0 <= lam <= 2.0


def test_group_without_median_uses_overall_of_partly_filled(spark):
    from ticketlens.operators import impute as I

    # group a: 1, 3 -> median 2 fills its null; group b is all null -> overall median of (1, 3, 2, 10) = 2.5
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("a", None), ("c", 10.0), ("b", None)], "g string, v double")
    out = {(r["g"], i): r["v"] for i, r in enumerate(I.impute_group_median(df, "v", ["g"]).orderBy("g", "v").collect())}
    vals = {g: v for (g, _), v in out.items()}
    assert vals["b"] == 2.5
    assert sorted(v for (g, _), v in out.items() if g == "a") == [1.0, 2.0, 3.0]


def test_average_rank_ties(spark):
    from ticketlens.operators.sampling import average_rank_table

    m = spark.createDataFrame([("m1", 1.0), ("m2", 1.0), ("m3", 2.0)], "model string, err double")
    got = {r["model"]: r["rank_err"] for r in average_rank_table(m, {"err": False}).collect()}
    assert got == {"m1": 1.5, "m2": 1.5, "m3": 3.0}


def test_pivot_metric_query_keeps_further_languages(spark, tmp_path):
    """A language that the given tables do not hold has its column too."""
    from ticketlens.plans.catalog import load_all

    rows = [("s", "en", 10), ("s", "it", 30), ("s", "it", 50), ("t", "pt", 7)]
    spark.createDataFrame(rows, "source string, lang string, n_chars long").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    got = load_all()["A32_pivot_metric"].build(spark, str(tmp_path)).orderBy("source").collect()
    assert [r.asDict() for r in got] == [{"source": "s", "en": 10.0, "it": 40.0, "pt": None}, {"source": "t", "en": None, "it": None, "pt": 7.0}]


def test_union_of_all_trackers(spark, tmp_path):
    """Every issue of every tracker enters, of a tracker without a name too; two trackers lack a column."""
    from ticketlens.plans.columns_queries import q_union_all

    names = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST", None]
    tables = {"region": ([(i, n) for i, n in enumerate(names)], "r_regionkey int, r_name string"),
              "nation": ([(i, f"n{i}", i) for i in range(6)], "n_nationkey int, n_name string, n_regionkey int"),
              "customer": ([(i, i, "BUILDING") for i in range(6)], "c_custkey long, c_nationkey int, c_mktsegment string"),
              "orders": ([(i, i % 6, "1-URGENT", "F") for i in range(12)], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderstatus string"),
              "lineitem": ([(0, 1)], "l_orderkey long, l_suppkey long")}
    for name, (rows, schema) in tables.items():
        d = spark.createDataFrame(rows, schema)
        day = F.to_timestamp_ntz(F.lit("1995-01-02 00:00:00"))
        d = d.withColumn("o_orderdate", day) if name == "orders" else d.withColumn("l_shipdate", day) if name == "lineitem" else d
        d.coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    got = q_union_all(spark, str(tmp_path))
    assert got.columns == ["id", "created", "priority_name", "status"]
    assert sorted((r["id"], r["priority_name"], r["status"]) for r in got.collect()) == [
        (i, None if i % 6 == 3 else "1-URGENT", None if i % 6 == 2 else "F") for i in range(12)]
