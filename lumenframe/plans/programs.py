"""Queries that run Python functions, streams, sinks and commands."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import udfs
from ..scratch import shared_path, written
from ..session import Engine
from ..sources import commands, writers
from ..streaming import streams
from .registry import Tables, query


@query("SELECT c_custkey, c_custkey * 3 + 1 AS v FROM customer")
def q_udf(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", udfs.scalar(lambda x: None if x is None else x * 3 + 1, "bigint")("c_custkey").alias("v"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice * (1 - l_discount), 4) AS v FROM lineitem")
def q_pandas_udf(t: Tables) -> DataFrame:
    def net(price: pd.Series, discount: pd.Series) -> pd.Series:
        return price * (1 - discount)

    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(udfs.vectorised(net, "double")("l_extendedprice", "l_discount"), 4).alias("v"))


@query("SELECT c_nationkey, max(c_acctbal) - min(c_acctbal) AS spread FROM customer GROUP BY c_nationkey")
def q_pandas_agg(t: Tables) -> DataFrame:
    def spread(v: pd.Series) -> float:
        return float(v.max() - v.min())

    return t.customer.groupBy("c_nationkey").agg(udfs.vectorised(spread, "double")("c_acctbal").alias("spread"))


@query("SELECT n_nationkey, part FROM nation, LATERAL (SELECT unnest(string_split(n_name, 'A')) AS part)")
def q_udtf(t: Tables) -> DataFrame:
    class Pieces:
        def eval(self, text: str):
            for piece in (text or "").split("A"):
                yield (piece,)

    udfs.register_table_function(t.spark, "lumenframe_pieces", F.udtf(Pieces, returnType="part string"))
    return Engine(t.spark).sql("SELECT n_nationkey, part FROM {n}, LATERAL lumenframe_pieces(n_name)", n=t.nation)


@query("SELECT o_orderkey, o_totalprice * 2 AS twice FROM orders WHERE o_orderstatus = 'P'")
def q_map_in_pandas(t: Tables) -> DataFrame:
    def twice(batches):
        for b in batches:
            b = b[b.o_orderstatus == "P"]
            yield b.assign(twice=b.o_totalprice * 2)[["o_orderkey", "twice"]]

    return udfs.map_partitions(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice"), twice, "o_orderkey bigint, twice double", arrow=False)


@query("SELECT p_partkey, p_size + 1 AS bigger FROM part")
def q_map_in_arrow(t: Tables) -> DataFrame:
    def bigger(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pc.add(b.column(1), pa.scalar(1, pa.int32()))], names=["p_partkey", "bigger"])

    return udfs.map_partitions(t.part.select("p_partkey", "p_size"), bigger, "p_partkey bigint, bigger int")


@query("SELECT o_custkey, count(*) AS n, max(o_totalprice) - min(o_totalprice) AS spread FROM orders GROUP BY o_custkey")
def q_group_map(t: Tables) -> DataFrame:
    def spread(rows):
        import pyarrow as pa
        import pyarrow.compute as pc

        low, high = pc.min_max(rows.column("o_totalprice")).as_py().values()
        return pa.table({"o_custkey": rows.column("o_custkey")[:1], "n": pa.array([rows.num_rows], pa.int64()), "spread": pa.array([high - low], pa.float64())})

    return udfs.group_map(t.orders.select("o_custkey", "o_totalprice"), ["o_custkey"], spread, "o_custkey bigint, n bigint, spread double", arrow=True)


@query("SELECT k, count(c) AS customers, count(s) AS suppliers FROM (SELECT c_nationkey AS k, 1 AS c, NULL AS s FROM customer UNION ALL SELECT s_nationkey, NULL, 1 FROM supplier) GROUP BY k")
def q_cogroup(t: Tables) -> DataFrame:
    def sizes(key, a, b):
        return pd.DataFrame([(key[0], len(a), len(b))], columns=["k", "customers", "suppliers"])

    return udfs.cogroup_map(t.customer.select("c_nationkey"), ["c_nationkey"], t.supplier.select("s_nationkey"), ["s_nationkey"], sizes, "k int, customers bigint, suppliers bigint")


def _stream(t: Tables) -> DataFrame:
    events = streams.read_files(t.spark, f"{t.folder}/events.parquet", t.events.schema)
    return streams.with_watermark(events, "ts", "1 hour")


_SESSIONS = "SELECT user_id, min(ts) AS start, max(ts) AS last, count(*) AS n FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s"


def _zoneless(df: DataFrame) -> DataFrame:
    return df.select(F.col("window.start").cast("timestamp_ntz").alias("start"), *(c for c in df.columns if c != "window"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def q_stream_tumbling(t: Tables) -> DataFrame:
    counts = streams.tumbling(_stream(t), "ts", "1 hour", ["event_type"], F.count("*").alias("n"))
    return _zoneless(streams.run_once(counts, "tumbling", "complete"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) - to_hours(h) AS start, count(*) AS n FROM events, (SELECT range AS h FROM range(2)) GROUP BY ALL")
def q_stream_sliding(t: Tables) -> DataFrame:
    counts = streams.sliding(_stream(t), "ts", "2 hours", "1 hour", [], F.count("*").alias("n"))
    return _zoneless(streams.run_once(counts, "sliding", "complete"))


@query("SELECT start, event_type, n FROM (SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start + INTERVAL 1 DAY <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)")
def q_stream_append(t: Tables) -> DataFrame:
    counts = streams.tumbling(_stream(t), "ts", "1 day", ["event_type"], F.count("*").alias("n"))
    return _zoneless(streams.run_once(counts, "append"))


@query(f"SELECT user_id, start, n FROM ({_SESSIONS}) WHERE last + INTERVAL 30 MINUTE <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)")
def q_stream_session(t: Tables) -> DataFrame:
    found = streams.run_once(streams.sessions(_stream(t), "ts", "30 minutes", ["user_id"], F.count("*").alias("n")), "session")
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query(f"SELECT user_id, start, n FROM ({_SESSIONS})")
def q_session_batch(t: Tables) -> DataFrame:
    found = streams.sessions(t.events, "ts", "30 minutes", ["user_id"], F.count("*").alias("n"))
    return found.select("user_id", F.col("session_window.start").cast("timestamp_ntz").alias("start"), "n")


@query("SELECT DISTINCT event_type FROM events")
def q_stream_dedup(t: Tables) -> DataFrame:
    rows = _stream(t).dropDuplicates(["event_type"]).select("event_type")
    return streams.run_once(rows, "dedup")


@query("SELECT DISTINCT event_id FROM events")
def q_stream_dedup_watermark(t: Tables) -> DataFrame:
    return streams.run_once(_stream(t).dropDuplicatesWithinWatermark(["event_id"]).select("event_id"), "dedup-watermark")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_stream_stateful(t: Tables) -> DataFrame:
    def count(key, frames, state):
        n = (state.get[0] if state.exists else 0) + sum(len(f) for f in frames)
        state.update((n,))
        yield pd.DataFrame({"event_type": [key[0]], "n": [n]})

    rows = streams.with_state(_stream(t).select("event_type", "event_id"), ["event_type"], count, "event_type string, n bigint", "n bigint", "update")
    found = streams.run_once(rows, "stateful", "update")
    return found.groupBy("event_type").agg(F.max_by("n", "_batch").alias("n"))


@query("SELECT a.event_id AS purchase, b.event_id AS error FROM events a JOIN events b ON a.user_id = b.user_id AND b.ts BETWEEN a.ts AND a.ts + INTERVAL 1 HOUR WHERE a.event_type = 'purchase' AND b.event_type = 'error'")
def q_stream_join(t: Tables) -> DataFrame:
    a = _stream(t).filter("event_type = 'purchase'").select(F.col("event_id").alias("purchase"), F.col("user_id").alias("u"), F.col("ts").alias("t1"))
    b = _stream(t).filter("event_type = 'error'").select(F.col("event_id").alias("error"), F.col("user_id").alias("v"), F.col("ts").alias("t2"))
    both = a.join(b, F.expr("u = v AND t2 BETWEEN t1 AND t1 + INTERVAL 1 HOUR"))
    return streams.run_once(both.select("purchase", "error"), "stream-join")


@query("SELECT o_orderkey, o_orderstatus FROM orders")
def q_cache(t: Tables) -> DataFrame:
    from ..dataset import Dataset
    from ..sources.storage_levels import parse_level

    return Dataset(t.orders.select("o_orderkey", "o_orderstatus")).persist(parse_level("memory_and_disk")).df


@query("SELECT * FROM customer")
def q_write_read_parquet(t: Tables) -> DataFrame:
    return written(t.customer, "customer")


@query("SELECT n_nationkey, n_name FROM nation")
def q_write_read_csv(t: Tables) -> DataFrame:
    return written(t.nation.select("n_nationkey", "n_name"), "nation", "csv")


@query("SELECT n_nationkey, n_name FROM nation")
def q_write_read_json(t: Tables) -> DataFrame:
    return written(t.nation.select("n_nationkey", "n_name"), "nation", "json")


@query("SELECT * FROM supplier")
def q_write_read_orc(t: Tables) -> DataFrame:
    return written(t.supplier, "supplier", "orc")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def q_write_partitioned(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "orders")
    writers.write(t.orders.select("o_orderkey", "o_totalprice", "o_orderstatus"), path=path, partition_by=["o_orderstatus"])
    return t.spark.read.parquet(path).filter("o_orderstatus = 'F'")


def _table(t: Tables, name: str) -> str:
    import uuid

    return f"lumenframe_{name}_{uuid.uuid4().hex}"


@query("SELECT r_regionkey, r_name FROM region")
def q_ctas(t: Tables) -> DataFrame:
    name = _table(t, "region")
    writers.create_or_replace_table(t.spark, name, t.region)
    return t.spark.table(name)


@query("SELECT n_name, n_regionkey FROM nation WHERE n_regionkey <> 1 UNION ALL SELECT 'replaced', 1")
def q_insert_overwrite(t: Tables) -> DataFrame:
    name = _table(t, "nation")
    writers.write(t.nation.select("n_name", "n_regionkey"), table=name, partition_by=["n_regionkey"])
    writers.insert_into(t.spark.createDataFrame([("replaced", 1)], "n_name string, n_regionkey int"), name, overwrite=True, dynamic=True)
    return t.spark.table(name)


@query("SELECT p_partkey, p_brand, p_size FROM part")
def q_bucketed(t: Tables) -> DataFrame:
    name = _table(t, "part")
    writers.write(t.part.select("p_partkey", "p_brand", "p_size"), table=name, bucket_by=(8, ["p_partkey"]), sort_by=["p_partkey"])
    return t.spark.table(name)


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN 0.0 ELSE s_acctbal END AS s_acctbal FROM supplier WHERE s_suppkey % 10 <> 0 UNION ALL SELECT -1, 0.0")
def q_merge(t: Tables) -> DataFrame:
    target = t.supplier.select("s_suppkey", "s_acctbal")
    source = target.filter("s_suppkey % 2 = 0").select("s_suppkey", F.lit(0.0).alias("s_acctbal")).union(t.spark.createDataFrame([(-1, 0.0)], "a bigint, b double"))
    return writers.merge(target, source, ["s_suppkey"], update=["s_acctbal"], delete_when="s_suppkey % 10 = 0")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation UNION ALL SELECT r_regionkey + 100, r_name, NULL FROM region")
def q_merge_insert_only(t: Tables) -> DataFrame:
    source = t.nation.select("n_nationkey", F.lit("changed").alias("n_name")).union(t.region.select(F.col("r_regionkey") + 100, "r_name"))
    return writers.merge(t.nation, source, ["n_nationkey"])


@query("SELECT c_custkey, CASE WHEN o.n > 10 THEN -c_acctbal ELSE c_acctbal END AS c_acctbal FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL) o ON o_custkey = c_custkey WHERE n IS NOT NULL OR c_acctbal >= 0")
def q_merge_unmatched(t: Tables) -> DataFrame:
    target = t.customer.select("c_custkey", "c_acctbal")
    orders = t.orders.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    source = orders.join(target, "c_custkey", "left").withColumn("c_acctbal", -F.col("c_acctbal"))
    return writers.merge(target, source, ["c_custkey"], update=["c_acctbal"], update_when="source.n > 10", insert=False, delete_unmatched_when="c_acctbal < 0")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'P' UNION ALL SELECT 0, 'P'")
def q_overwrite_where(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "orders")
    new = t.spark.createDataFrame([(0, "P")], "o_orderkey bigint, o_orderstatus string")
    writers.overwrite_where(t.orders.select("o_orderkey", "o_orderstatus"), new, "o_orderstatus = 'P'", path)
    return t.spark.read.parquet(path)


@query("SELECT n_name FROM nation WHERE n_regionkey = 2")
def q_view(t: Tables) -> DataFrame:
    name = _table(t, "view")
    commands.Commands(t.spark).create_view(name, t.nation.filter("n_regionkey = 2").select("n_name"))
    return t.spark.table(name)


@query("SELECT p_partkey, p_size * 1.5 AS v FROM part")
def q_pandas_udf_iter(t: Tables) -> DataFrame:
    from collections.abc import Iterator

    def scale(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield b * 1.5

    scale.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return t.part.select("p_partkey", udfs.vectorised(scale, "double")("p_size").alias("v"))


@query("SELECT s_suppkey, max(s_acctbal) OVER (PARTITION BY s_nationkey) AS top FROM supplier")
def q_pandas_window_agg(t: Tables) -> DataFrame:
    from ..operators.windows import window

    def top(v: pd.Series) -> float:
        return float(v.max())

    return t.supplier.select("s_suppkey", udfs.vectorised(top, "double")("s_acctbal").over(window(["s_nationkey"])).alias("top"))


@query("SELECT n_nationkey, n_regionkey, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS place FROM nation")
def q_table_argument(t: Tables) -> DataFrame:
    class Place:
        def __init__(self):
            self.n = 0

        def eval(self, row):
            self.n += 1
            yield row["n_nationkey"], row["n_regionkey"], self.n

    place = F.udtf(Place, returnType="n_nationkey int, n_regionkey int, place int")
    return place(t.nation.asTable().partitionBy("n_regionkey").orderBy("n_nationkey"))


@query("SELECT o_custkey, arg_min(o_orderkey, (o_orderdate, o_orderkey)) AS first_order FROM orders GROUP BY o_custkey")
def q_group_map_sorted(t: Tables) -> DataFrame:
    def first(rows):
        import pyarrow as pa

        return pa.table({"o_custkey": rows.column("o_custkey")[:1], "first_order": rows.column("o_orderkey")[:1]})

    rows = t.orders.select("o_custkey", "o_orderkey", "o_orderdate")
    return udfs.group_map(rows, ["o_custkey"], first, "o_custkey bigint, first_order bigint", arrow=True, sort_by=["o_orderdate", "o_orderkey"])


@query("SELECT k, min(c) AS customer, min(s) AS supplier FROM (SELECT c_nationkey AS k, c_custkey AS c, NULL AS s FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier) GROUP BY k HAVING min(c) IS NOT NULL AND min(s) IS NOT NULL")
def q_cogroup_sorted(t: Tables) -> DataFrame:
    def firsts(key, a, b):
        rows = [(key[0], a.c_custkey[0], b.s_suppkey[0])] if len(a) and len(b) else []
        return pd.DataFrame(rows, columns=["k", "customer", "supplier"])

    a, b = t.customer.select("c_nationkey", "c_custkey"), t.supplier.select("s_nationkey", "s_suppkey")
    return udfs.cogroup_map(a, ["c_nationkey"], b, ["s_nationkey"], firsts, "k int, customer bigint, supplier bigint", left_sort=["c_custkey"], right_sort=["s_suppkey"])


@query("SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 250000)")
def q_lateral_join(t: Tables) -> DataFrame:
    dear = t.orders.alias("o").where((F.col("o.o_custkey") == F.col("c.c_custkey").outer()) & (F.col("o.o_totalprice") > 250000)).select("o_orderkey")
    return t.customer.alias("c").lateralJoin(dear).select("c_custkey", "o_orderkey")


@query("SELECT event_type, count(*) + 100 AS n FROM events GROUP BY event_type")
def q_stream_initial_state(t: Tables) -> DataFrame:
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor

    class Count(StatefulProcessor):
        def init(self, handle):
            self.seen = handle.getValueState("n", "n bigint")

        def handleInputRows(self, key, rows, timers):
            n = (self.seen.get()[0] if self.seen.exists() else 0) + sum(len(r) for r in rows)
            self.seen.update((n,))
            yield pd.DataFrame({"event_type": [key[0]], "n": [n]})

        def handleInitialState(self, key, initial, timers):
            self.seen.update((int(initial.n.iloc[0]),))

        def close(self):
            pass

    name = "spark.sql.streaming.stateStore.providerClass"
    before = t.spark.conf.get(name)
    t.spark.conf.set(name, streams.ROCKSDB)
    try:
        start = t.events.select("event_type").distinct().withColumn("n", F.lit(100).cast("bigint"))
        rows = streams.with_initial_state(_stream(t).select("event_type", "event_id"), ["event_type"], Count(), "event_type string, n bigint", start)
        found = streams.run_once(rows, "initial-state", "update")
    finally:
        t.spark.conf.set(name, before)
    return found.groupBy("event_type").agg(F.max_by("n", "_batch").alias("n"))


@query("SELECT r_name FROM region")
def q_insert_directory(t: Tables) -> DataFrame:
    path = shared_path(t.spark, "regions")
    for _ in range(2):
        writers.overwrite_directory(t.region.select("r_name"), path, "json")
    return t.spark.read.schema("r_name string").json(path)


@query("SELECT n_name FROM nation WHERE n_nationkey > 20")
def q_named_relation(t: Tables) -> DataFrame:
    e = Engine(t.spark)
    e.remember("nations", t.nation.filter("n_nationkey > 20"))
    return e.recall("nations").select("n_name")
