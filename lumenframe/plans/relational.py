"""Queries over projections, predicates, joins, groups, windows, order and sets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import aggregates, joins, ordering, predicates, relational, reshape, setops, windows
from ..session import Engine
from .registry import Tables, query

MONEY = "decimal(18,4)"


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 6) AS avg_qty, round(avg(l_discount), 6) AS avg_disc, count(*) AS count_order FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL")
def q_flagship(t: Tables) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    kept = t.lineitem.filter(F.col("l_shipdate") <= F.expr("TIMESTAMP_NTZ '1998-09-02'"))
    sums = (F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"), F.round(F.sum(price), 2).alias("sum_disc_price"), F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"))
    return aggregates.aggregate(kept, ["l_returnflag", "l_linestatus"], *sums, F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.round(F.avg("l_discount"), 6).alias("avg_disc"), F.count("*").alias("count_order")).orderBy("l_returnflag", "l_linestatus")


@query("SELECT range AS id FROM range(0, 1000, 3)")
def q_range(t: Tables) -> DataFrame:
    return Engine(t.spark).range(0, 1000, 3, 4).df


@query("SELECT range AS id FROM range(10, 0, -3)")
def q_range_desc(t: Tables) -> DataFrame:
    return Engine(t.spark).range(10, 0, -3).df


@query("SELECT range AS id FROM range(0, 100) WHERE range >= 90 AND range <> 95")
def q_range_filter_select(t: Tables) -> DataFrame:
    ten = predicates.binary("gteq", F.col("id"), F.lit(90))
    return Engine(t.spark).range(100).filter(predicates.binary("and", ten, predicates.binary("neq", F.col("id"), F.lit(95)))).select("id").df


@query("SELECT count(*) AS n FROM range(0, 10, 2)")
def q_range_count(t: Tables) -> DataFrame:
    return Engine(t.spark).range(0, 10, 2).df.agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 100000 AND o_orderstatus <> 'F' OR o_orderpriority = '1-URGENT' AND o_totalprice <= 5000")
def q_filter_cmp(t: Tables) -> DataFrame:
    b, c = predicates.binary, F.col
    dear = b("and", b("gt", c("o_totalprice"), F.lit(100000)), b("neq", c("o_orderstatus"), F.lit("F")))
    cheap = b("and", b("eq", c("o_orderpriority"), F.lit("1-URGENT")), b("lteq", c("o_totalprice"), F.lit(5000)))
    return t.orders.filter(b("or", dear, cheap)).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, (nullif(o_orderstatus, 'F') = 'O') AND (nullif(o_orderpriority, '5-LOW') < '3') AS both_true, (nullif(o_orderstatus, 'F') = 'O') OR (nullif(o_orderpriority, '5-LOW') < '3') AS any_true FROM orders WHERE NOT (nullif(o_orderstatus, 'F') = 'P')")
def q_filter_3vl(t: Tables) -> DataFrame:
    s, p = F.nullif("o_orderstatus", F.lit("F")), F.nullif("o_orderpriority", F.lit("5-LOW"))
    return t.orders.filter(~(s == "P")).select("o_orderkey", ((s == "O") & (p < "3")).alias("both_true"), ((s == "O") | (p < "3")).alias("any_true"))


@query("SELECT l_orderkey, l_linenumber, (l_orderkey - 1000) // 7 AS whole, (l_orderkey - 1000) / 7 AS exact, round(l_extendedprice / nullif(l_discount, 0), 4) AS per_discount, l_orderkey + l_partkey AS added, l_orderkey - l_partkey AS less, l_linenumber * 3 AS times FROM lineitem")
def q_arith_div(t: Tables) -> DataFrame:
    b, k = predicates.binary, F.col("l_orderkey")
    less = b("subtract", k, F.lit(1000))
    return t.lineitem.select("l_orderkey", "l_linenumber", b("divide", less, F.lit(7), integral=True).alias("whole"), b("divide", less, F.lit(7)).alias("exact"), F.round(b("divide", F.col("l_extendedprice"), F.nullif("l_discount", F.lit(0.0))), 4).alias("per_discount"), b("add", k, F.col("l_partkey")).alias("added"), b("subtract", k, F.col("l_partkey")).alias("less"), b("multiply", F.col("l_linenumber"), F.lit(3)).alias("times"))


@query("SELECT upper(c_name) AS name, c_acctbal * 2 AS twice, c_acctbal > 0 AS positive FROM customer")
def q_project_expr(t: Tables) -> DataFrame:
    return relational.project(t.customer, F.upper("c_name").alias("name"), (F.col("c_acctbal") * 2).alias("twice"), (F.col("c_acctbal") > 0).alias("positive"))


@query("SELECT 1 AS one, 'a' AS letter, CAST(NULL AS INTEGER) AS nothing")
def q_project_no_input(t: Tables) -> DataFrame:
    return Engine(t.spark).project(F.lit(1).alias("one"), F.lit("a").alias("letter"), F.lit(None).cast("int").alias("nothing"))


@query("SELECT n_nationkey, upper(n_name) AS n_name, n_regionkey, n_regionkey + 1 AS next_region FROM nation")
def q_with_columns(t: Tables) -> DataFrame:
    return relational.with_columns(t.nation, {"n_name": F.upper("n_name"), "next_region": F.col("n_regionkey") + 1}, {"n_name": {"case": "upper"}})


@query("SELECT n_nationkey AS key, n_name AS name, n_regionkey FROM nation")
def q_rename(t: Tables) -> DataFrame:
    return relational.rename(t.nation, {"n_nationkey": "key", "n_name": "name", "absent": "x"})


@query("SELECT n_name FROM nation")
def q_drop(t: Tables) -> DataFrame:
    return relational.drop(relational.drop(t.nation, F.col("n_nationkey")), "n_regionkey", "absent")


@query("SELECT r_regionkey AS a, r_name AS b FROM region")
def q_todf(t: Tables) -> DataFrame:
    return relational.to_df(t.region, "a", "b")


@query("SELECT n_name, CAST(n_nationkey AS BIGINT) AS n_nationkey FROM nation")
def q_to_schema(t: Tables) -> DataFrame:
    from pyspark.sql.types import LongType, StringType, StructType

    return relational.to_schema(t.nation, StructType().add("n_name", StringType()).add("n_nationkey", LongType()))


@query("SELECT a.n_name AS left_name, b.name AS right_name FROM nation a JOIN nation b(k, name, r) ON a.n_regionkey = b.r AND a.n_nationkey < b.k")
def q_alias(t: Tables) -> DataFrame:
    a, b = relational.alias(t.nation, "a"), relational.alias(t.nation, "b", ["k", "name", "r"])
    return joins.join(a, b, on=(F.col("a.n_regionkey") == F.col("b.r")) & (F.col("a.n_nationkey") < F.col("b.k"))).select(F.col("a.n_name").alias("left_name"), F.col("b.name").alias("right_name"))


@query("SELECT * EXCLUDE (n_regionkey) FROM nation")
def q_star_except(t: Tables) -> DataFrame:
    return relational.star(t.nation, exclude=["N_REGIONKEY"])


@query("SELECT * REPLACE (lower(n_name) AS n_name) FROM nation")
def q_star_replace(t: Tables) -> DataFrame:
    return relational.star(t.nation, replace={"n_name": F.lower("n_name")})


@query("SELECT n_nationkey AS id, n_name, n_regionkey FROM nation")
def q_star_rename(t: Tables) -> DataFrame:
    return relational.star(t.nation, rename={"n_nationkey": "id"})


@query("SELECT n_nationkey, n_regionkey FROM nation")
def q_star_ilike(t: Tables) -> DataFrame:
    return relational.star(t.nation, ilike="%KEY")


@query("SELECT o_orderkey, o_orderdate, o_orderpriority, o_orderstatus FROM orders")
def q_regex_columns(t: Tables) -> DataFrame:
    return relational.regex_columns(t.orders, "o_order.*")


@query("SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def q_hint(t: Tables) -> DataFrame:
    return t.orders.join(relational.hint(t.customer, "merge"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_name")


@query("SELECT * FROM (VALUES (1, 'a'), (2, 'b'), (3, NULL)) AS t(x, y)")
def q_values(t: Tables) -> DataFrame:
    return Engine(t.spark).values([(F.lit(1), F.lit("a")), (F.lit(2), F.lit("b")), (F.lit(3), F.lit(None).cast("string"))], ["x", "y"])


@query("SELECT c_custkey, c_name FROM customer WHERE c_acctbal > 5000 AND c_mktsegment = 'BUILDING'")
def q_params(t: Tables) -> DataFrame:
    return Engine(t.spark).sql("SELECT c_custkey, c_name FROM {c} WHERE c_acctbal > :low AND c_mktsegment = :segment", {"low": 5000, "segment": "BUILDING"}, c=t.customer)


@query("WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,4))) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 100000) SELECT c_name, CAST(total AS DOUBLE) AS total FROM top JOIN customer ON c_custkey = o_custkey")
def q_cte(t: Tables) -> DataFrame:
    text = f"WITH big AS (SELECT o_custkey, sum(CAST(o_totalprice AS {MONEY})) AS total FROM {{o}} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > 100000) SELECT c_name, CAST(total AS DOUBLE) AS total FROM top JOIN {{c}} ON c_custkey = o_custkey"
    return Engine(t.spark).sql(text, o=t.orders, c=t.customer)


@query("WITH RECURSIVE n(i, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, f * (i + 1) FROM n WHERE i < 15) SELECT i, f FROM n")
def q_recursive_cte(t: Tables) -> DataFrame:
    return Engine(t.spark).sql("WITH RECURSIVE n(i, f) AS (SELECT 1, CAST(1 AS BIGINT) UNION ALL SELECT i + 1, f * (i + 1) FROM n WHERE i < 15) SELECT i, f FROM n")


def _orders_customers(t: Tables):
    """All rows of both; finished orders and one segment's customers have no key, so that each side has rows without a match."""
    o = t.orders.withColumn("o_key", F.when(F.col("o_orderstatus") != "F", F.col("o_custkey")))
    c = t.customer.withColumn("c_key", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_custkey")))
    return o, c, F.col("o_key") == F.col("c_key")


_O = "(SELECT *, CASE WHEN o_orderstatus <> 'F' THEN o_custkey END AS o_key FROM orders)"
_C = "(SELECT *, CASE WHEN c_mktsegment <> 'BUILDING' THEN c_custkey END AS c_key FROM customer)"


@query("SELECT o_orderkey, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey")
def q_join_inner(t: Tables) -> DataFrame:
    return joins.join(t.orders, t.customer, "inner", on=F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_custkey")


@query(f"SELECT o_orderkey, c_custkey FROM {_O} JOIN {_C} ON o_key = c_key")
def q_join_inner_null_keys(t: Tables) -> DataFrame:
    o, c, on = _orders_customers(t)
    return joins.join(o, c, "inner", on=on).select("o_orderkey", "c_custkey")


@query(f"SELECT o_orderkey, c_custkey FROM {_O} LEFT JOIN {_C} ON o_key = c_key")
def q_join_left(t: Tables) -> DataFrame:
    o, c, on = _orders_customers(t)
    return joins.join(o, c, "left_outer", on=on).select("o_orderkey", "c_custkey")


@query(f"SELECT o_orderkey, c_custkey FROM {_O} RIGHT JOIN {_C} ON o_key = c_key")
def q_join_right(t: Tables) -> DataFrame:
    o, c, on = _orders_customers(t)
    return joins.join(o, c, "right_outer", on=on).select("o_orderkey", "c_custkey")


@query(f"SELECT o_orderkey, c_custkey FROM {_O} FULL JOIN {_C} ON o_key = c_key")
def q_join_full(t: Tables) -> DataFrame:
    o, c, on = _orders_customers(t)
    return joins.join(o, c, "full_outer", on=on).select("o_orderkey", "c_custkey")


@query(f"SELECT o_orderkey FROM {_O} SEMI JOIN {_C} ON o_key = c_key")
def q_join_semi(t: Tables) -> DataFrame:
    o, c, on = _orders_customers(t)
    return joins.join(o, c, "left_semi", on=on).select("o_orderkey")


@query(f"SELECT o_orderkey FROM {_O} ANTI JOIN {_C} ON o_key = c_key")
def q_join_anti(t: Tables) -> DataFrame:
    o, c, on = _orders_customers(t)
    return joins.join(o, c, "left_anti", on=on).select("o_orderkey")


@query(f"SELECT c_custkey FROM {_C} SEMI JOIN {_O} ON o_key = c_key")
def q_join_right_semi(t: Tables) -> DataFrame:
    o, c, on = _orders_customers(t)
    return joins.join(o, c, "right_semi", on=on).select("c_custkey")


@query(f"SELECT c_custkey FROM {_C} ANTI JOIN {_O} ON o_key = c_key")
def q_join_right_anti(t: Tables) -> DataFrame:
    o, c, on = _orders_customers(t)
    return joins.join(o, c, "right_anti", on=on).select("c_custkey")


@query("SELECT r_name, n_name FROM region CROSS JOIN nation")
def q_join_cross(t: Tables) -> DataFrame:
    return joins.join(t.region, t.nation, "cross").select("r_name", "n_name")


@query("SELECT k, a.n_name AS n_name, b.c_custkey AS c_custkey FROM (SELECT CASE WHEN n_regionkey <> 1 THEN n_nationkey END AS k, n_name FROM nation) a FULL JOIN (SELECT c_nationkey AS k, c_custkey FROM customer) b USING (k)")
def q_join_using(t: Tables) -> DataFrame:
    a = t.nation.select(F.when(F.col("n_regionkey") != 1, F.col("n_nationkey")).alias("k"), "n_name")
    b = t.customer.select(F.col("c_nationkey").alias("k"), "c_custkey")
    return joins.join(a, b, "full_outer", using=["k"])


@query("SELECT n_regionkey, n_name, r_name FROM nation NATURAL JOIN (SELECT r_regionkey AS n_regionkey, r_name FROM region)")
def q_join_natural(t: Tables) -> DataFrame:
    return joins.join(t.nation, t.region.withColumnRenamed("r_regionkey", "n_regionkey"), natural=True).select("n_regionkey", "n_name", "r_name")


@query("SELECT s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey < n_nationkey AND s_acctbal > n_nationkey * 100")
def q_join_theta(t: Tables) -> DataFrame:
    return joins.join(t.supplier, t.nation, on=(F.col("s_nationkey") < F.col("n_nationkey")) & (F.col("s_acctbal") > F.col("n_nationkey") * 100)).select("s_suppkey", "n_nationkey")


@query("SELECT p_partkey, CAST(lo AS DOUBLE) AS lo FROM part JOIN (SELECT range * 100.0 AS lo, range * 100.0 + 150.0 AS hi FROM range(0, 40)) ON p_retailprice >= lo AND p_retailprice < hi")
def q_join_interval(t: Tables) -> DataFrame:
    spans = t.spark.range(40).select((F.col("id") * F.lit(100.0)).alias("lo"), (F.col("id") * F.lit(100.0) + 150.0).alias("hi"))
    return joins.interval_join(t.part, spans, point="p_retailprice", start="lo", end="hi", width=150.0).select("p_partkey", "lo")


_BUYS = "(SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' GROUP BY ALL)"


@query(f"SELECT e.event_id, e.user_id, b.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN {_BUYS} b ON e.user_id = b.user_id AND e.ts >= b.ts")
def q_asof(t: Tables) -> DataFrame:
    views = t.events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("last_value"))
    return joins.asof(views, buys, using=["user_id"], left_time="ts", right_time="ts", values=["last_value"]).select("event_id", "user_id", "last_value")


@query(f"SELECT e.event_id, b.value AS next_value FROM (SELECT * FROM events WHERE event_type = 'view') e ASOF LEFT JOIN {_BUYS} b ON e.user_id = b.user_id AND e.ts <= b.ts")
def q_asof_forward(t: Tables) -> DataFrame:
    views = t.events.filter("event_type = 'view'").select("event_id", "user_id", "ts")
    buys = t.events.filter("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("next_value"))
    return joins.asof(views, buys, using=["user_id"], left_time="ts", right_time="ts", values=["next_value"], direction="forward").select("event_id", "next_value")


@query("SELECT event_id, k FROM events, LATERAL (SELECT unnest(string_split(event_type, 'e')) AS k)")
def q_lateral_view(t: Tables) -> DataFrame:
    return reshape.lateral_view(t.events, F.explode(F.split("event_type", "e")), "k").select("event_id", "k")


@query("SELECT n_nationkey, w FROM nation LEFT JOIN LATERAL (SELECT unnest(CASE WHEN n_regionkey = 0 THEN [] ELSE [n_name] END) AS w) ON true")
def q_lateral_view_outer(t: Tables) -> DataFrame:
    words = F.when(F.col("n_regionkey") == 0, F.array().cast("array<string>")).otherwise(F.array("n_name"))
    return reshape.lateral_view(t.nation, F.explode_outer(words), "w").select("n_nationkey", "w")


@query("SELECT c_mktsegment, count(*) AS n, min(c_acctbal) AS low, max(c_acctbal) AS high, CAST(sum(CAST(c_acctbal AS DECIMAL(18,4))) AS DOUBLE) AS total FROM customer GROUP BY c_mktsegment")
def q_agg_basic(t: Tables) -> DataFrame:
    return aggregates.aggregate(t.customer, ["c_mktsegment"], F.count("*").alias("n"), F.min("c_acctbal").alias("low"), F.max("c_acctbal").alias("high"), F.sum(F.col("c_acctbal").cast(MONEY)).cast("double").alias("total"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 12")
def q_having(t: Tables) -> DataFrame:
    return aggregates.aggregate(t.orders, ["o_custkey"], F.count("*").alias("n"), having=F.col("n") > 12)


@query("SELECT count(*) AS n FROM orders GROUP BY o_orderpriority")
def q_agg_without_keys(t: Tables) -> DataFrame:
    return aggregates.aggregate(t.orders, ["o_orderpriority"], F.count("*").alias("n"), with_keys=False)


@query("SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY l_returnflag")
def q_distinct_agg(t: Tables) -> DataFrame:
    return aggregates.aggregate(t.lineitem, ["l_returnflag"], F.count_distinct("l_partkey").alias("parts"), aggregates.call("count", "l_suppkey", distinct=True).alias("suppliers"))


@query("SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 150000) AS dear, count(*) FILTER (WHERE o_orderpriority = '1-URGENT') AS urgent FROM orders GROUP BY o_orderstatus")
def q_agg_filter(t: Tables) -> DataFrame:
    return aggregates.aggregate(t.orders, ["o_orderstatus"], aggregates.call("count", "*", where="o_totalprice > 150000").alias("dear"), aggregates.call("count", "*", where="o_orderpriority = '1-URGENT'").alias("urgent"))


@query("SELECT count(*) AS n, count(DISTINCT o_custkey) AS customers, min(o_orderdate) AS first_date, max(o_orderdate) AS last_date FROM orders")
def q_global_agg(t: Tables) -> DataFrame:
    return t.orders.agg(F.count("*").alias("n"), F.count_distinct("o_custkey").alias("customers"), F.min("o_orderdate").alias("first_date"), F.max("o_orderdate").alias("last_date"))


@query("SELECT count(*) AS n, max(o_orderkey) AS top FROM orders WHERE o_orderkey < 0")
def q_agg_empty(t: Tables) -> DataFrame:
    return aggregates.aggregate(t.orders.filter("o_orderkey < 0"), [], F.count("*").alias("n"), F.max("o_orderkey").alias("top"))


@query("SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS vp, round(corr(l_quantity, l_extendedprice), 6) AS r, round(covar_pop(l_quantity, l_extendedprice), 2) AS cp, bool_and(l_quantity > 0) AS all_positive, bool_or(l_discount > 0.09) AS any_deep, bit_xor(l_linenumber) AS x, max_by(l_orderkey, l_orderkey * 10 + l_linenumber) AS last_order, median(l_quantity) AS med, quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag")
def q_agg_functions(t: Tables) -> DataFrame:
    return t.lineitem.groupBy("l_returnflag").agg(F.round(F.stddev_samp("l_quantity"), 6).alias("sd"), F.round(F.var_pop("l_quantity"), 6).alias("vp"), F.round(F.corr("l_quantity", "l_extendedprice"), 6).alias("r"), F.round(F.covar_pop("l_quantity", "l_extendedprice"), 2).alias("cp"), F.bool_and(F.col("l_quantity") > 0).alias("all_positive"), F.bool_or(F.col("l_discount") > 0.09).alias("any_deep"), F.bit_xor("l_linenumber").alias("x"), F.max_by("l_orderkey", F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("last_order"), F.median("l_quantity").alias("med"), aggregates.call("percentile_cont", "0.9", order_by="l_quantity").alias("p90"))


@query("SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
def q_listagg(t: Tables) -> DataFrame:
    return t.nation.groupBy("n_regionkey").agg(aggregates.call("listagg", "n_name", "','", order_by="n_name").alias("names"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def q_rollup(t: Tables) -> DataFrame:
    return aggregates.rollup(t.orders, ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def q_cube(t: Tables) -> DataFrame:
    return aggregates.cube(t.orders, ["o_orderstatus", "o_orderpriority"], F.count("*").alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS gid FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus), ())")
def q_grouping_sets(t: Tables) -> DataFrame:
    return aggregates.grouping_sets(t.lineitem, [["l_returnflag"], ["l_linestatus"], []], ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.grouping_id().alias("gid"))


@query("SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, count(*) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY o_orderpriority")
def q_pivot(t: Tables) -> DataFrame:
    out = reshape.pivot(t.orders, ["o_orderpriority"], ["o_orderstatus"], {"open": "O", "done": "F"}, F.count(F.lit(1)))
    return out.select("o_orderpriority", F.coalesce("open", F.lit(0)).alias("open"), F.coalesce("done", F.lit(0)).alias("done"))


@query("SELECT l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'A' AND l_linestatus = 'F') AS BIGINT) AS af, CAST(sum(CAST(l_quantity AS BIGINT)) FILTER (WHERE l_returnflag = 'N' AND l_linestatus = 'O') AS BIGINT) AS no FROM lineitem GROUP BY l_linenumber")
def q_pivot_multi(t: Tables) -> DataFrame:
    return reshape.pivot(t.lineitem, ["l_linenumber"], ["l_returnflag", "l_linestatus"], {"af": ("A", "F"), "no": ("N", "O")}, F.sum(F.col("l_quantity").cast("bigint")))


_PARTS = "(SELECT p_partkey, nullif(p_size, 1) AS a, CASE WHEN p_partkey % 2 = 0 THEN p_size * 2 END AS b FROM part)"


def _parts(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.nullif("p_size", F.lit(1)).alias("a"), F.when(F.col("p_partkey") % 2 == 0, F.col("p_size") * 2).alias("b"))


@query(f"SELECT p_partkey, 'a' AS k, a AS v FROM {_PARTS} WHERE a IS NOT NULL UNION ALL SELECT p_partkey, 'b', b FROM {_PARTS} WHERE b IS NOT NULL")
def q_unpivot(t: Tables) -> DataFrame:
    return reshape.unpivot(_parts(t), ["p_partkey"], {"a": ["a"], "b": ["b"]}, "k", ["v"])


@query(f"SELECT p_partkey, 'ab' AS k, a AS x, b AS y FROM {_PARTS} UNION ALL SELECT p_partkey, 'ba', b, a FROM {_PARTS}")
def q_unpivot_nulls(t: Tables) -> DataFrame:
    return reshape.unpivot(_parts(t), ["p_partkey"], {"ab": ["a", "b"], "ba": ["b", "a"]}, "k", ["x", "y"], include_nulls=True)


@query("SELECT DISTINCT l_returnflag, l_linestatus, l_linenumber FROM lineitem")
def q_dedup(t: Tables) -> DataFrame:
    return aggregates.deduplicate(t.lineitem.select("l_returnflag", "l_linestatus", "l_linenumber"))


@query("SELECT DISTINCT o_custkey, o_orderstatus FROM orders")
def q_dedup_subset(t: Tables) -> DataFrame:
    return aggregates.deduplicate(t.orders, ["o_custkey", "o_orderstatus"]).select("o_custkey", "o_orderstatus")


@query("SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER v AS rk, dense_rank() OVER v AS dr, percent_rank() OVER v AS pr, cume_dist() OVER v AS cd FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey), v AS (PARTITION BY o_custkey ORDER BY o_orderpriority)")
def q_win_rank(t: Tables) -> DataFrame:
    w = windows.window(["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])
    v = windows.window(["o_custkey"], ["o_orderpriority"])
    return t.orders.select("o_orderkey", F.row_number().over(w).alias("rn"), F.rank().over(v).alias("rk"), F.dense_rank().over(v).alias("dr"), F.percent_rank().over(v).alias("pr"), F.cume_dist().over(v).alias("cd"))


@query("SELECT event_id, lag(event_type) OVER w AS before, lead(value, 2, -1.0) OVER w AS after FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def q_win_lag_lead(t: Tables) -> DataFrame:
    w = windows.window(["user_id"], ["ts", "event_id"])
    return t.events.select("event_id", F.lag("event_type").over(w).alias("before"), F.lead("value", 2, -1.0).over(w).alias("after"))


@query("SELECT l_orderkey, l_linenumber, CAST(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS BIGINT) AS near FROM lineitem")
def q_win_rows(t: Tables) -> DataFrame:
    w = windows.window(["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_quantity"], ("rows", -1, 1))
    return t.lineitem.select("l_orderkey", "l_linenumber", F.sum(F.col("l_quantity").cast("bigint")).over(w).alias("near"))


@query("SELECT o_orderkey, count(*) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey RANGE BETWEEN 100 PRECEDING AND CURRENT ROW) AS n FROM orders")
def q_win_range(t: Tables) -> DataFrame:
    w = windows.window(["o_orderpriority"], ["o_orderkey"], ("range", -100, windows.CURRENT_ROW))
    return t.orders.select("o_orderkey", F.count("*").over(w).alias("n"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM events")
def q_win_range_interval(t: Tables) -> DataFrame:
    return Engine(t.spark).sql("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS n FROM {e}", e=t.events)


@query("SELECT event_id, first_value(event_type) OVER w AS f, last_value(event_type) OVER w AS l, nth_value(event_type, 2) OVER w AS s, last_value(nullif(event_type, 'view') IGNORE NULLS) OVER w AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)")
def q_win_first_last(t: Tables) -> DataFrame:
    w = windows.window(["user_id"], ["ts", "event_id"], ("rows", windows.UNBOUNDED_PRECEDING, windows.CURRENT_ROW))
    return t.events.select("event_id", F.first("event_type").over(w).alias("f"), F.last("event_type").over(w).alias("l"), F.nth_value("event_type", 2).over(w).alias("s"), F.last(F.nullif("event_type", F.lit("view")), ignorenulls=True).over(w).alias("c"))


@query("SELECT c_custkey, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter FROM customer")
def q_win_ntile(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.ntile(4).over(windows.window(["c_nationkey"], ["c_acctbal", "c_custkey"])).alias("quarter"))


@query("SELECT s_suppkey, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier")
def q_win_named_cluster(t: Tables) -> DataFrame:
    return Engine(t.spark).sql("SELECT s_suppkey, count(*) OVER w AS n FROM {s} WINDOW w AS (CLUSTER BY s_nationkey)", s=t.supplier)


@query("SELECT c_nationkey, c_custkey, c_acctbal FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) <= 3")
def q_topk_per_group(t: Tables) -> DataFrame:
    return windows.top_k(t.customer, 3, ["c_nationkey"], [F.desc("c_acctbal"), F.col("c_custkey")]).select("c_nationkey", "c_custkey", "c_acctbal")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20")
def q_topk(t: Tables) -> DataFrame:
    return ordering.limit(ordering.sort(t.orders, ordering.order("o_totalprice", "desc"), "o_orderkey"), 20).select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25 OFFSET 10")
def q_offset(t: Tables) -> DataFrame:
    return ordering.limit(ordering.sort(t.orders.select("o_orderkey"), "o_orderkey"), 25, skip=10)


@query("SELECT k, o_orderkey FROM (SELECT nullif(o_orderstatus, 'F') AS k, o_orderkey FROM orders) ORDER BY k ASC NULLS LAST, o_orderkey DESC")
def q_sort_nulls(t: Tables) -> DataFrame:
    rows = t.orders.select(F.nullif("o_orderstatus", F.lit("F")).alias("k"), "o_orderkey")
    return ordering.sort(rows, ordering.order("k", "asc", "last"), F.desc("o_orderkey"))


@query("SELECT p_partkey FROM part ORDER BY p_partkey DESC LIMIT 7")
def q_tail(t: Tables) -> DataFrame:
    return ordering.tail(t.part.select("p_partkey"), 7, F.desc("p_partkey"))


@query("SELECT p_partkey, p_size FROM part")
def q_sort_within_partitions(t: Tables) -> DataFrame:
    return ordering.sort(t.part.select("p_partkey", "p_size"), "p_size", within_partitions=True)


@query("SELECT p_partkey, p_brand FROM part")
def q_repartition(t: Tables) -> DataFrame:
    return ordering.repartition(ordering.repartition(t.part.select("p_partkey", "p_brand"), 16, ["p_brand"]), 8, ["p_partkey"], by_range=True)


@query("SELECT p_partkey, p_brand FROM part")
def q_coalesce(t: Tables) -> DataFrame:
    return ordering.repartition(t.part.select("p_partkey", "p_brand"), 2, shuffle=False)


def _sets(t: Tables) -> tuple[DataFrame, DataFrame]:
    return t.customer.select(F.col("c_nationkey").alias("k")), t.supplier.select((F.col("s_nationkey") + 10).alias("k"))


_A, _B = "SELECT c_nationkey AS k FROM customer", "SELECT s_nationkey + 10 AS k FROM supplier"


@query(f"{_A} UNION ALL {_B}")
def q_union_all(t: Tables) -> DataFrame:
    return setops.set_operation(*_sets(t), "union", all_rows=True)


@query(f"{_A} UNION {_B}")
def q_union(t: Tables) -> DataFrame:
    return setops.set_operation(*_sets(t), "union")


@query("SELECT r_regionkey AS a, r_name AS b, NULL::INTEGER AS c FROM region UNION ALL SELECT n_nationkey, n_name, n_regionkey FROM nation")
def q_union_by_name(t: Tables) -> DataFrame:
    return setops.set_operation(t.region.toDF("a", "b"), t.nation.select(F.col("n_regionkey").alias("c"), F.col("n_name").alias("b"), F.col("n_nationkey").alias("a")), "union", all_rows=True, by_name=True, allow_missing=True)


@query(f"{_A} INTERSECT {_B}")
def q_intersect(t: Tables) -> DataFrame:
    return setops.set_operation(*_sets(t), "intersect")


@query(f"{_A} INTERSECT ALL {_B}")
def q_intersect_all(t: Tables) -> DataFrame:
    return setops.set_operation(*_sets(t), "intersect", all_rows=True)


@query(f"{_A} EXCEPT {_B}")
def q_except(t: Tables) -> DataFrame:
    return setops.set_operation(*_sets(t), "except")


@query(f"{_A} EXCEPT ALL {_B}")
def q_except_all(t: Tables) -> DataFrame:
    return setops.set_operation(*_sets(t), "except", all_rows=True)


@query("SELECT n_name AS b, n_regionkey AS a FROM nation EXCEPT SELECT n_name, 0 FROM nation")
def q_except_by_name(t: Tables) -> DataFrame:
    return setops.set_operation(t.nation.select(F.col("n_name").alias("b"), F.col("n_regionkey").alias("a")), t.nation.select(F.lit(0).alias("a"), F.col("n_name").alias("b")), "except", by_name=True)


@query("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 200000)")
def q_in_subquery(t: Tables) -> DataFrame:
    return predicates.in_subquery(t.customer, "c_custkey", t.orders.filter("o_totalprice > 200000").select("o_custkey")).select("c_custkey")


@query("SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def q_not_in_subquery(t: Tables) -> DataFrame:
    return predicates.in_subquery(t.nation, "n_nationkey", t.supplier.filter("s_acctbal > 5000").select("s_nationkey"), negated=True).select("n_nationkey")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def q_exists(t: Tables) -> DataFrame:
    o = t.orders.alias("o")
    return t.customer.alias("c").where(o.where((F.col("o.o_custkey") == F.col("c.c_custkey").outer()) & (F.col("o.o_orderstatus") == "P")).exists()).select("c_custkey")


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def q_not_exists(t: Tables) -> DataFrame:
    return t.customer.join(t.orders, F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > 3 * (SELECT avg(o_totalprice) FROM orders)")
def q_scalar_subquery(t: Tables) -> DataFrame:
    return t.orders.where(F.col("o_totalprice") > 3 * t.orders.select(F.avg("o_totalprice")).scalar()).select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem a WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM lineitem b WHERE b.l_orderkey = a.l_orderkey)")
def q_correlated(t: Tables) -> DataFrame:
    return Engine(t.spark).sql("SELECT l_orderkey, l_linenumber FROM {l} a WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM {l} b WHERE b.l_orderkey = a.l_orderkey)", l=t.lineitem)


@query("SELECT o_orderkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 20000 AND o_custkey NOT BETWEEN 10 AND 500")
def q_between(t: Tables) -> DataFrame:
    return t.orders.filter(predicates.between(F.col("o_totalprice"), 1000, 20000) & predicates.between(F.col("o_custkey"), 10, 500, negated=True)).select("o_orderkey")


@query("SELECT o_orderkey FROM orders WHERE o_orderstatus IN ('P', 'O') AND nullif(o_orderpriority, '5-LOW') NOT IN ('1-URGENT', '2-HIGH')")
def q_in_list(t: Tables) -> DataFrame:
    return t.orders.filter(predicates.in_list(F.col("o_orderstatus"), ["P", "O"]) & predicates.in_list(F.nullif("o_orderpriority", F.lit("5-LOW")), ["1-URGENT", "2-HIGH"], negated=True)).select("o_orderkey")


@query("SELECT p_partkey FROM part WHERE nullif(p_size, 3) IN (1, 2, NULL)")
def q_in_list_null(t: Tables) -> DataFrame:
    return t.part.filter(predicates.in_list(F.nullif("p_size", F.lit(3)), [1, 2, None])).select("p_partkey")


@query("SELECT p_partkey, nullif(p_size, 5) IS DISTINCT FROM nullif(p_size, 6) AS d, nullif(p_size, 5) IS NOT DISTINCT FROM NULL AS s FROM part")
def q_is_distinct(t: Tables) -> DataFrame:
    a, b = F.nullif("p_size", F.lit(5)), F.nullif("p_size", F.lit(6))
    return t.part.select("p_partkey", predicates.is_distinct_from(a, b).alias("d"), predicates.is_not_distinct_from(a, F.lit(None)).alias("s"))


@query("SELECT p_partkey, x IS TRUE AS t, x IS NOT TRUE AS nt, x IS FALSE AS f, x IS NOT FALSE AS nf, x IS NULL AS u, x IS NOT NULL AS nu FROM (SELECT p_partkey, nullif(p_size, 5) > 20 AS x FROM part)")
def q_bool_tests(t: Tables) -> DataFrame:
    x = F.nullif("p_size", F.lit(5)) > 20
    return t.part.select("p_partkey", predicates.is_true(x).alias("t"), predicates.is_not_true(x).alias("nt"), predicates.is_false(x).alias("f"), predicates.is_not_false(x).alias("nf"), predicates.is_unknown(x).alias("u"), predicates.is_not_unknown(x).alias("nu"))


@query("SELECT p_partkey FROM part WHERE regexp_full_match(p_brand, 'Brand#(1|2).') AND NOT regexp_full_match(p_type, '.*[Bb]rass', 's')")
def q_similar_to(t: Tables) -> DataFrame:
    return t.part.filter(predicates.similar_to(F.col("p_brand"), "Brand#(1|2)_") & predicates.similar_to(F.col("p_type"), "%[Bb]rass", negated=True)).select("p_partkey")
