"""Nulls, ties, empty frames and errors, on frames of a few rows."""

import datetime

import pytest
from pyspark import StorageLevel
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumenframe import errors
from lumenframe.functions import types, udfs
from lumenframe.operators import joins, nastat, ordering, predicates, relational, reshape, setops
from lumenframe.session import Engine
from lumenframe.sources import commands, readers
from lumenframe.sources.storage_levels import parse_level
from lumenframe.streaming import streams


def test_dataset_api(spark):
    ten = Engine(spark).range(0, 10, 1, 2)
    assert ten.count() == 10 and ten.df.rdd.getNumPartitions() == 2 and not ten.df.schema["id"].nullable
    assert Engine(spark).range(0, 10, 2).count() == 5
    kept = ten.filter(F.col("id") > 7).select("id").cache()
    assert sum(b.num_rows for b in kept.collect()) == 2 and kept.df.storageLevel.useMemory
    assert "Filter" in kept.logical_plan()
    assert Engine(spark).range(5).filter("id > 9").count() == 0


def test_relations_without_input(spark):
    e = Engine(spark)
    assert e.empty().count() == 0 and e.empty(one_row=True).count() == 1 and e.empty().columns == []
    df = e.remember("k", e.local([(1, "a")], "x int, y string"))
    assert e.recall("k") is df
    import io

    import pyarrow as pa

    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, pa.schema([("x", pa.int64())])) as to:
        to.write_table(pa.table({"x": [1, 2]}))
    assert e.local(sink.getvalue()).count() == 2
    assert e.sql("SELECT ? + ? AS s", [1, 2]).first().s == 3


def test_binary_operators(spark):
    row = spark.range(1).select(
        predicates.binary("divide", F.lit(-7), F.lit(2), integral=True).alias("cut"),
        predicates.binary("divide", F.lit(7), F.lit(2)).alias("exact"),
        predicates.binary("and", F.lit(None).cast("boolean"), F.lit(False)).alias("f"),
        predicates.binary("or", F.lit(None).cast("boolean"), F.lit(True)).alias("t"),
        predicates.binary("eq", F.lit(None).cast("int"), F.lit(1)).alias("n"),
    ).first()
    assert (row.cut, row.exact, row.f, row.t, row.n) == (-3, 3.5, False, True, None)
    with pytest.raises(errors.Unsupported):
        predicates.binary("power", F.lit(1), F.lit(2))
    with pytest.raises(ValueError):
        predicates.binary("add", F.lit(1))


@pytest.mark.parametrize(
    "value, pattern, options, expected",
    [("abc", "a%", {}, True), ("a\nc", "a_c", {}, True), ("abc", "b", {}, False), ("10%", "10#%", {"escape": "#"}, True), ("10x", "10#%", {"escape": "#"}, False), ("ABC", "a(b|x)c", {"case_insensitive": True}, True), ("aXc", "a[XY]c", {}, True), ("a.c", "a.c", {}, True), ("abc", "a.c", {}, False), (None, "a", {}, None), ("abc", "abc", {"negated": True}, False)],
)
def test_similar_to(spark, value, pattern, options, expected):
    df = spark.createDataFrame([(value,)], "s string")
    assert df.select(predicates.similar_to(F.col("s"), pattern, **options)).first()[0] is expected


def test_not_in_with_null_keeps_nothing(spark):
    a, b = spark.createDataFrame([(1,), (2,), (None,)], "x int"), spark.createDataFrame([(1,), (None,)], "y int")
    assert predicates.in_subquery(a, "x", b, negated=True).count() == 0
    assert [r.x for r in predicates.in_subquery(a, "x", b).collect()] == [1]
    assert [r.x for r in predicates.in_subquery(a, "x", b.dropna(), negated=True).collect()] == [2]
    assert predicates.in_subquery(a, "x", b.limit(0), negated=True).count() == 3


def test_asof_ties_nulls_and_buckets(spark):
    t = lambda d, h=0: datetime.datetime(2024, 1, d, h)
    left = spark.createDataFrame([(1, "a", t(1)), (2, "a", t(9)), (3, "b", t(2)), (4, None, t(2)), (5, "a", None), (6, "a", t(3, 5))], "id int, k string, at timestamp_ntz")
    right = spark.createDataFrame([("a", t(1), 10), ("a", t(3, 4), None), ("a", t(4), 30), (None, t(1), 7), ("c", t(1), 5)], "k string, at timestamp_ntz, v int")
    args = {"using": ["k"], "left_time": "at", "right_time": "at", "values": ["v"]}
    assert {r.id: r.v for r in joins.asof(left, right, **args).collect()} == {1: 10, 2: 30, 3: None, 4: None, 5: None, 6: None}
    near = joins.asof(left, right, **args, tolerance="1 DAY")
    assert {r.id: r.v for r in near.collect()} == {1: 10, 2: None, 3: None, 4: None, 5: None, 6: None}
    ahead = joins.asof(left, right, **args, direction="forward")
    assert {r.id: r.v for r in ahead.collect()} == {1: 10, 2: None, 3: None, 4: None, 5: None, 6: 30}
    assert joins.asof(left.limit(0), right, **args).count() == 0


def test_join_kinds_without_criteria(spark):
    a, b = spark.range(2).toDF("x"), spark.range(3).toDF("y")
    assert joins.join(a, b).count() == 6 and joins.join(a, b, natural=True).count() == 6
    assert joins.join(a, b.limit(0), "left_outer").count() == 2
    assert joins.join(a, b, "right_anti", on=F.col("x") == F.col("y")).collect()[0].y == 2
    with pytest.raises(ValueError):
        joins.join(a, b, "sideways")


def test_by_name_set_operations(spark):
    a, b = spark.createDataFrame([(1, "x"), (1, "x"), (None, None)], "a int, b string"), spark.createDataFrame([("x", 1), (None, None)], "b string, a int")
    assert setops.set_operation(a, b, "intersect", by_name=True).count() == 2
    assert setops.set_operation(a, b, "except", all_rows=True, by_name=True).count() == 1
    with pytest.raises(ValueError):
        setops.aligned(a, b.drop("a"))
    assert setops.set_operation(a, b.drop("a"), "union", by_name=True, allow_missing=True, all_rows=True).count() == 5


def test_spearman_with_ties_equals_pandas(spark):
    import random

    rng = random.Random(1)
    rows = [(rng.randrange(9), rng.random() if i % 3 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "a int, b double")
    assert nastat.corr(df, "a", "b", "spearman").first()[0] == pytest.approx(df.toPandas().dropna().corr("spearman").iloc[0, 1])
    with pytest.raises(ValueError):
        nastat.corr(df, "a", "b", "kendall")


def test_samples(spark):
    df = spark.range(10_000)
    whole = [ordering.sample(df, hi, lo, seed=3) for lo, hi in ((0.0, 0.3), (0.3, 1.0))]
    assert abs(ordering.sample(df, 0.5, 0.2, seed=3).count() - 3000) < 300
    assert all(s.distinct().count() == s.count() for s in whole)
    assert ordering.sample(df, 2.0, with_replacement=True, seed=3).count() > 15_000
    keys = df.withColumn("k", F.col("id") % 2)
    assert ordering.sample_by(keys, "k", {0: 1.0}, seed=1).count() == 5000
    assert [r.id for r in ordering.tail(df.coalesce(1), 2).collect()] == [9998, 9999]


def test_unpivot_and_pivot_nulls(spark):
    df = spark.createDataFrame([(1, 5, None), (2, None, None)], "id int, a int, b int")
    assert reshape.unpivot(df, ["id"], {"a": ["a"], "b": ["b"]}, "k", ["v"]).count() == 1
    assert reshape.unpivot(df, None, {"a": ["a"], "b": ["b"]}, "k", ["v"], include_nulls=True).count() == 4
    out = reshape.pivot(df, ["id"], ["a", "b"], {"five": (5, None), "none": (None, None)}, F.count(F.lit(1)))
    assert {(r.id, r.five, r.none) for r in out.collect()} == {(1, 1, None), (2, None, 1)}


def test_star_options(spark):
    df = spark.createDataFrame([(1, 2, 3)], "ab int, `a.c` int, d int")
    assert relational.star(df, ilike="A%", rename={"a.c": "z"}).columns == ["ab", "z"]
    assert relational.star(df, exclude=["D"], replace={"ab": F.lit(9)}).first() == (9, 2)


def test_types():
    assert types.spark_type("uint64") == T.DecimalType(20, 0) and types.spark_type("varchar(3)") == T.VarcharType(3)
    assert types.spark_type("timestamp") == T.TimestampNTZType() and types.spark_type("timestamp", zone="UTC") == T.TimestampType()
    for bad in ("decimal(39,2)", "decimal(10,11)", "decimal(0,0)", "decimal256(77,2)"):
        with pytest.raises(ValueError):
            types.spark_type(bad)
    for none in ("decimal256(50,10)", "imaginary"):
        with pytest.raises(errors.Unsupported):
            types.spark_type(none)
    with pytest.raises(ValueError):
        types.spark_type("time32", unit="ns")
    assert types.into_schema(T.IntegerType()).names == ["value"] and types.union_of({"i": T.IntegerType()}).names == ["tag", "i"]
    assert types.is_numeric(T.DecimalType(5, 2)) and not types.is_numeric(T.BooleanType()) and types.is_nested(T.ArrayType(T.StringType()))


def test_storage_levels():
    assert parse_level(" memory_only ").useMemory and parse_level("DISK_ONLY_3").replication == 3
    assert parse_level("MEMORY_AND_DISK") == StorageLevel(True, True, False, True, 1) and parse_level("off_heap").useOffHeap
    with pytest.raises(ValueError):
        parse_level("TAPE")


def test_errors_by_condition(spark):
    from pyspark.errors import PySparkException

    for text, category in (("SELECT * FROM no_such_table", "catalog"), ("SELECT 1/0", "arithmetic"), ("SELEC 1", "parse"), ("SELECT nope FROM VALUES (1) t(x)", "analysis")):
        with pytest.raises(PySparkException) as e:
            spark.sql(text).collect()
        assert errors.classify(e.value).category == category
    assert errors.classify(ConnectionError()).retryable and errors.classify(KeyError()).category == "other"


def test_evaluation_kinds():
    assert udfs.is_table_function(300) and not udfs.is_table_function(200)
    with pytest.raises(ValueError):
        udfs.is_table_function(5)


def test_commands(spark):
    c = commands.Commands(spark)
    c.create_database("lf_db", comment="c")
    assert c.database_exists("lf_db") and any(d.name == "lf_db" for d in c.list_databases("lf_*"))
    c.drop_table("lf_db.t")
    c.create_table("lf_db.t", "a int, p int", partition_by=("p",), properties={"primary_key": "a"})
    assert c.table_exists("lf_db.t") and [x.name for x in c.list_columns("lf_db.t")] == ["a", "p"]
    spark.sql("INSERT INTO lf_db.t VALUES (1, 2)")
    c.recover_partitions("lf_db.t")
    c.cache_table("lf_db.t", level="memory_only")
    assert c.is_cached("lf_db.t")
    c.uncache_table("lf_db.t")
    c.refresh_table("lf_db.t")
    c.alter_table("lf_db.t", "SET TBLPROPERTIES ('k'='v')")
    c.create_view("lf_view", spark.table("lf_db.t"))
    assert "a" in c.show_string(spark.table("lf_view")) and "<table" in c.html_string(spark.table("lf_view"))
    assert all(c.explain(spark.table("lf_view"), m) for m in ("simple", "extended", "formatted", "cost", "codegen", "analyze"))
    c.drop_view("lf_view")
    assert c.function_exists("upper") and c.get_function("upper").name == "upper" and c.current_catalog() == "spark_catalog"
    c.set_variable("spark.sql.lumenframe.x", "1")
    c.reset_variable("spark.sql.lumenframe.x")
    c.drop_database("lf_db", cascade=True)
    assert not c.database_exists("lf_db")


def test_parse_keeps_bad_lines_as_null(spark):
    df = spark.createDataFrame([("{\"a\": 1}",), ("nonsense",), (None,)], "line string")
    assert [r.a for r in readers.parse(df, "line", "json", "a int").collect()] == [1, None, None]


def test_late_rows_are_dropped(spark, tmp_path):
    at = lambda h: datetime.datetime(2024, 1, 1, h)
    for n, hours in enumerate(([1, 2], [10], [1])):
        spark.createDataFrame([(at(h), n) for h in hours], "ts timestamp, v int").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    stream = streams.read_files(spark, f"{tmp_path}/in", "ts timestamp, v int", files_per_trigger=1)
    counts = streams.tumbling(streams.with_watermark(stream, "ts", "1 hour"), "ts", "1 hour", [], F.count("*").alias("n"))
    done = streams.run_once(counts, "late")
    assert {r.window.start.hour for r in done.collect()} <= {1, 2} and sum(r.n for r in done.collect()) <= 3


def test_merge_raises_where_rows_match_twice(spark):
    from lumenframe.sources import writers

    target = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    twice = spark.createDataFrame([(1, "x"), (1, "y"), (None, "m")], "k int, v string")
    with pytest.raises(Exception, match="several source rows"):
        writers.merge(target, twice, ["k"], update=["v"]).collect()
    new = spark.createDataFrame([(3, "x"), (3, "y"), (None, "m"), (2, "z")], "k int, v string")
    got = writers.merge(target, new, ["k"], update=["v"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a"), (2, "z"), (None, "n"), (3, "x"), (3, "y"), (None, "m")], key=str)


def test_replaced_table_may_read_itself(spark):
    from lumenframe.sources import writers

    writers.create_or_replace_table(spark, "lumenframe_self", spark.range(3))
    writers.create_or_replace_table(spark, "lumenframe_self", spark.table("lumenframe_self").selectExpr("id + 10 AS id"))
    assert sorted(r.id for r in spark.table("lumenframe_self").collect()) == [10, 11, 12]
    spark.sql("DROP TABLE lumenframe_self")


def test_shared_folder_is_needed_on_clusters():
    from lumenframe.scratch import check_shared

    check_shared("", "local[4]")
    check_shared("hdfs:///shared", "yarn")
    for master in ("yarn", "spark://host:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            check_shared("", master)


def test_interval_join_of_long_and_short_spans(spark):
    spans = spark.createDataFrame([(0.0, 1.0), (5.0, 100000.0), (-300.5, 7.25), (3.0, 3.0), (9.0, 2.0), (99.0, 99.5)], "lo double, hi double")
    points = spark.createDataFrame([(float(x),) for x in (-300.5, -1, 0, 1, 5, 7, 7.25, 99, 99.5, 99999, 100000)], "p double")
    got = sorted(map(tuple, joins.interval_join(points, spans, point="p", start="lo", end="hi", width=1.0).collect()))
    want = sorted((p.p, s.lo, s.hi) for p in points.collect() for s in spans.collect() if s.lo <= p.p < s.hi)
    assert got == want
    assert joins.interval_join(points, spans.limit(0), point="p", start="lo", end="hi", width=1.0).count() == 0


def test_asof_takes_one_of_equal_times(spark):
    left = spark.createDataFrame([("k", datetime.datetime(2024, 1, 1, 12))], "k string, t timestamp")
    right = spark.createDataFrame([("k", datetime.datetime(2024, 1, 1, 12), v) for v in (2, 9, 5)], "k string, t timestamp, v int")
    for direction, want in (("backward", 9), ("forward", 2)):
        got = joins.asof(left, right.repartition(3), using=["k"], left_time="t", right_time="t", values=["v"], direction=direction).collect()
        assert [r.v for r in got] == [want]


def test_sort_with_nulls_last(spark):
    from lumenframe.plans import catalogue

    rows = [(r.k, r.o_orderkey) for r in catalogue.QUERIES["q_sort_nulls"](spark, "/root/testdata/sf0.001").collect()]
    assert rows == sorted(rows, key=lambda r: (r[0] is None, r[0] or "", -r[1])) and rows[-1][0] is None


def test_inferred_schema_of_odd_lines(spark):
    lines = spark.createDataFrame([('{"a": 1}',), (None,), ('{"a":\n 2, "b": "x"}',), ("",)], "line string")
    assert readers.infer_json_schema(lines, "line") == "struct<a:bigint,b:string>"


def test_stream_without_rows(spark, tmp_path):
    spark.range(0).selectExpr("id", "cast(id AS timestamp) AS ts").write.parquet(str(tmp_path / "none"))
    stream = streams.read_files(spark, str(tmp_path / "none"), "id bigint, ts timestamp")
    for mode in ("complete", "update"):
        assert streams.run_once(stream.groupBy("id").count(), "none", mode).count() == 0
