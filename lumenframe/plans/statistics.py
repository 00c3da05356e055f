"""Queries over missing values, statistics, samples, functions by name, nested values and parsed text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import types
from ..operators import aggregates, nastat, ordering, relational
from ..sources import readers
from .registry import Tables, query

_SPARSE = "(SELECT d.doc_id, lang, quality, toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"


def _sparse(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "lang").join(t.labels, "doc_id", "left")


@query(f"SELECT doc_id, lang, coalesce(quality, -1) AS quality, coalesce(toxic, 0) AS toxic FROM {_SPARSE}")
def q_fillna(t: Tables) -> DataFrame:
    return nastat.fill_na(_sparse(t), {"quality": -1, "toxic": 0})


@query(f"SELECT * FROM {_SPARSE} WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def q_dropna(t: Tables) -> DataFrame:
    return nastat.drop_na(_sparse(t), ["quality", "toxic"])


@query(f"SELECT doc_id, nullif(lang, 'en') AS lang, quality FROM {_SPARSE} WHERE (nullif(lang, 'en') IS NOT NULL)::INT + (quality IS NOT NULL)::INT >= 1")
def q_dropna_thresh(t: Tables) -> DataFrame:
    return nastat.drop_na(_sparse(t).select("doc_id", F.nullif("lang", F.lit("en")).alias("lang"), "quality"), ["lang", "quality"], min_non_nulls=1)


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'de' THEN 'german' ELSE lang END AS lang FROM documents")
def q_replace(t: Tables) -> DataFrame:
    return nastat.replace(t.documents.select("doc_id", "lang"), {"en": "english", "de": "german"}, ["lang"])


@query("SELECT 'count' AS summary, CAST(count(p_size) AS VARCHAR) AS p_size FROM part UNION ALL SELECT 'min', CAST(min(p_size) AS VARCHAR) FROM part UNION ALL SELECT 'max', CAST(max(p_size) AS VARCHAR) FROM part")
def q_describe(t: Tables) -> DataFrame:
    return nastat.describe(t.part, "p_size").filter("summary IN ('count', 'min', 'max')")


@query("SELECT 'count' AS summary, CAST(count(c_nationkey) AS VARCHAR) AS c_nationkey FROM customer UNION ALL SELECT '50%', CAST(quantile_disc(c_nationkey, 0.5) AS VARCHAR) FROM customer UNION ALL SELECT 'count_distinct', CAST(count(DISTINCT c_nationkey) AS VARCHAR) FROM customer")
def q_summary(t: Tables) -> DataFrame:
    return nastat.summary(t.customer.select("c_nationkey"), "count", "50%", "count_distinct")


@query("SELECT o_orderpriority AS o_orderpriority_o_orderstatus, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY o_orderpriority")
def q_crosstab(t: Tables) -> DataFrame:
    out = nastat.crosstab(t.orders, "o_orderpriority", "o_orderstatus")
    return out.select("o_orderpriority_o_orderstatus", *(c for c in ("F", "O", "P") if c in out.columns))


@query("SELECT round(covar_samp(l_quantity, l_discount), 8) AS cov FROM lineitem")
def q_cov(t: Tables) -> DataFrame:
    return nastat.cov(t.lineitem, "l_quantity", "l_discount").select(F.round("cov", 8).alias("cov"))


@query("SELECT round(corr(l_quantity, l_extendedprice), 8) AS corr FROM lineitem")
def q_corr(t: Tables) -> DataFrame:
    return nastat.corr(t.lineitem, "l_quantity", "l_extendedprice").select(F.round("corr", 8).alias("corr"))


@query("SELECT round(corr(a, b), 8) AS corr FROM (SELECT rank() OVER (ORDER BY p_size) + (count(*) OVER (PARTITION BY p_size) - 1) / 2 AS a, rank() OVER (ORDER BY p_retailprice) + (count(*) OVER (PARTITION BY p_retailprice) - 1) / 2 AS b FROM part)")
def q_spearman(t: Tables) -> DataFrame:
    return nastat.corr(t.part, "p_size", "p_retailprice", "spearman").select(F.round("corr", 8).alias("corr"))


@query("SELECT quantile_disc(p_retailprice, 0.25) AS q1, quantile_disc(p_retailprice, 0.5) AS q2, quantile_disc(p_retailprice, 0.9) AS q3 FROM part")
def q_quantile_exact(t: Tables) -> DataFrame:
    q = F.col("p_retailprice")
    return nastat.approx_quantile(t.part, ["p_retailprice"], [0.25, 0.5, 0.9]).select(q[0].alias("q1"), q[1].alias("q2"), q[2].alias("q3"))


@query()
def q_freq_items(t: Tables) -> DataFrame:
    return nastat.freq_items(t.lineitem, ["l_returnflag", "l_linenumber"], 0.2)


@query()
def q_approx_distinct(t: Tables) -> DataFrame:
    return t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query()
def q_sample(t: Tables) -> DataFrame:
    return ordering.sample(t.orders, 0.1, seed=42)


@query()
def q_sample_slice(t: Tables) -> DataFrame:
    return ordering.sample(t.orders, 0.5, 0.2, seed=42)


@query()
def q_sample_by(t: Tables) -> DataFrame:
    return ordering.sample_by(t.orders, "o_orderstatus", {"F": 0.1, "O": 0.5}, seed=42)


_BOUNDS = "SELECT true AS within, true AS subset, true AS repeatable"


def _sampled(rows: DataFrame, draw, key: str, low: float, high: float) -> DataFrame:
    """Whether a sample has a size within bounds (shares of all rows), has only rows of the table, each once, and comes again."""
    total = rows.count()
    first, again = (draw(rows).groupBy(key).agg(F.count("*").alias("n")) for _ in range(2))
    size = F.sum("n")
    found = first.join(rows.select(key).withColumn("known", F.lit(1)), key, "left").join(again.withColumnRenamed("n", "m"), key, "full_outer")
    return found.agg(size.between(low * total, high * total).alias("within"), F.every((F.col("n") == 1) & (F.col("known") == 1)).alias("subset"), F.every(F.col("n").eqNullSafe(F.col("m"))).alias("repeatable"))


@query(_BOUNDS)
def q_sample_bounds(t: Tables) -> DataFrame:
    return _sampled(t.orders, lambda d: ordering.sample(d, 0.1, seed=42), "o_orderkey", 0.05, 0.15)


@query(_BOUNDS)
def q_sample_slice_bounds(t: Tables) -> DataFrame:
    return _sampled(t.orders, lambda d: ordering.sample(d, 0.5, 0.2, seed=42), "o_orderkey", 0.22, 0.38)


@query(_BOUNDS)
def q_sample_by_bounds(t: Tables) -> DataFrame:
    return _sampled(t.orders, lambda d: ordering.sample_by(d, "o_orderstatus", {"F": 1.0, "O": 1.0, "P": 0.0}, seed=42), "o_orderkey", 0.5, 1.0)


@query("SELECT CAST(l_returnflag AS VARCHAR) AS item FROM lineitem GROUP BY l_returnflag HAVING count(*) > 0.2 * (SELECT count(*) FROM lineitem) UNION ALL SELECT CAST(l_linenumber AS VARCHAR) FROM lineitem GROUP BY l_linenumber HAVING count(*) > 0.2 * (SELECT count(*) FROM lineitem)")
def q_freq_items_found(t: Tables) -> DataFrame:
    """The items that are frequent, of those that the sketch names: it may name others, but none may be missing."""
    names = ["l_returnflag", "l_linenumber"]
    named = nastat.freq_items(t.lineitem, names, 0.2)
    counts = t.lineitem.select(F.explode(F.array(*(F.struct(F.lit(c).alias("of"), F.col(c).cast("string").alias("item")) for c in names))).alias("x")).groupBy("x.of", "x.item").agg(F.count("*").alias("n"))
    total = t.lineitem.count()

    def tagged(c: str):
        return F.transform(f"{c}_freqItems", lambda x: F.struct(F.lit(c).alias("of"), x.cast("string").alias("item")))

    items = named.select(F.explode(F.concat(*map(tagged, names))).alias("x")).select("x.*")
    return items.join(counts.where(F.col("n") > 0.2 * total), ["of", "item"]).select("item")


@query("SELECT true AS close")
def q_approx_distinct_bounds(t: Tables) -> DataFrame:
    """Two aggregates of one row each: beside a distinct count in the same one, Spark would keep a sketch for every key."""
    a = t.lineitem.agg(F.approx_count_distinct("l_partkey", 0.02).alias("a"))
    both = a.crossJoin(t.lineitem.agg(F.count_distinct("l_partkey").alias("b")))
    return both.select((F.abs(F.col("a") - F.col("b")) <= 0.1 * F.col("b")).alias("close"))


@query("SELECT count(*) AS n, sum(CAST(l_quantity AS BIGINT))::BIGINT AS quantity FROM lineitem")
def q_collect_metrics(t: Tables) -> DataFrame:
    seen, metrics = relational.collect_metrics(t.lineitem, "seen", F.count(F.lit(1)).alias("n"), F.sum(F.col("l_quantity").cast("bigint")).alias("quantity"))
    seen.write.format("noop").mode("overwrite").save()
    return t.spark.createDataFrame([(metrics.get["n"], metrics.get["quantity"])], "n bigint, quantity bigint")


@query("SELECT c_custkey, upper(c_name) AS a, substring(c_name, 2, 4) AS b, regexp_extract(c_name, '([0-9]+)', 1) AS c, len(string_split(c_mktsegment, 'I')) AS d, levenshtein(c_mktsegment, 'BUILDING') AS e, trim('  ' || c_mktsegment) || lpad(CAST(c_nationkey AS VARCHAR), 4, '0') AS f, replace(c_name, 'a', '-') AS g, reverse(c_name) AS h FROM customer")
def q_fn_string(t: Tables) -> DataFrame:
    f = aggregates.call
    return t.customer.select("c_custkey", f("upper", "c_name").alias("a"), f("substring", "c_name", F.lit(2), F.lit(4)).alias("b"), F.regexp_extract("c_name", "([0-9]+)", 1).alias("c"), F.size(F.split("c_mktsegment", "I")).cast("bigint").alias("d"), F.levenshtein("c_mktsegment", F.lit("BUILDING")).cast("bigint").alias("e"), F.concat(F.trim(F.concat(F.lit("  "), "c_mktsegment")), F.lpad(F.col("c_nationkey").cast("string"), 4, "0")).alias("f"), F.replace("c_name", F.lit("a"), F.lit("-")).alias("g"), f("reverse", "c_name").alias("h"))


@query("SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, year(o_orderdate) AS y, quarter(o_orderdate) AS q, dayofyear(o_orderdate) AS d, CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR) AS later, date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE)) AS days, strftime(o_orderdate, '%Y/%m/%d') AS s, CAST(last_day(o_orderdate) AS VARCHAR) AS last FROM orders")
def q_fn_date(t: Tables) -> DataFrame:
    d = F.col("o_orderdate")
    return t.orders.select("o_orderkey", F.date_trunc("month", d).cast("timestamp_ntz").alias("m"), F.year(d).cast("bigint").alias("y"), F.quarter(d).cast("bigint").alias("q"), F.dayofyear(d).cast("bigint").alias("d"), F.date_add(d.cast("date"), 30).cast("string").alias("later"), F.date_diff(d.cast("date"), F.lit("1992-01-01").cast("date")).cast("bigint").alias("days"), F.date_format(d, "yyyy/MM/dd").alias("s"), F.last_day(d.cast("date")).cast("string").alias("last"))


@query("SELECT l_orderkey, l_linenumber, round(l_extendedprice, -2) AS a, round(pow(l_quantity, 1.5), 6) AS b, round(ln(l_extendedprice), 8) AS c, l_orderkey % 7 AS d, floor(l_discount * 10) AS e, ceil(l_tax * 10) AS f, abs(l_quantity - 25) AS g, sign(l_quantity - 25) AS h, greatest(l_quantity, 10.0) AS i, round(sqrt(l_quantity), 8) AS j FROM lineitem")
def q_fn_math(t: Tables) -> DataFrame:
    q, p = F.col("l_quantity"), F.col("l_extendedprice")
    return t.lineitem.select("l_orderkey", "l_linenumber", F.round(p, -2).alias("a"), F.round(F.pow(q, F.lit(1.5)), 6).alias("b"), F.round(F.ln(p), 8).alias("c"), (F.col("l_orderkey") % 7).alias("d"), F.floor(F.col("l_discount") * 10).cast("double").alias("e"), F.ceil(F.col("l_tax") * 10).cast("double").alias("f"), F.abs(q - 25).alias("g"), F.signum(q - 25).cast("tinyint").alias("h"), F.greatest(q, F.lit(10.0)).alias("i"), F.round(F.sqrt(q), 8).alias("j"))


@query("SELECT vec_id, len(embedding) AS n, round(list_max(embedding), 5) AS top, len(list_filter(embedding, lambda x: x > 0)) AS positive, len(list_distinct(embedding)) AS d, list_sort(embedding)[1] AS least, round(embedding[3] * 2, 5) AS third FROM embeddings")
def q_fn_array(t: Tables) -> DataFrame:
    e = F.col("embedding")
    return t.embeddings.select("vec_id", F.size(e).cast("bigint").alias("n"), F.round(F.array_max(e), 5).alias("top"), F.size(F.filter(e, lambda x: x > 0)).cast("bigint").alias("positive"), F.size(F.array_distinct(e)).cast("bigint").alias("d"), F.sort_array(e)[0].alias("least"), F.round(e[2] * F.lit(2).cast("float"), 5).alias("third"))


@query("SELECT n_nationkey, n_name AS v, 2 AS n, n_name || '!' AS w FROM nation")
def q_fn_map(t: Tables) -> DataFrame:
    m = F.map_from_entries(F.array(F.struct(F.lit("name").alias("k"), F.col("n_name").alias("v")), F.struct(F.lit("key").alias("k"), F.col("n_nationkey").cast("string").alias("v"))))
    t_values = F.transform_values(F.map_filter(m, lambda k, v: k == "name"), lambda k, v: F.concat(v, F.lit("!")))
    return t.nation.select("n_nationkey", F.element_at(m, "name").alias("v"), F.size(F.map_keys(m)).alias("n"), t_values["name"].alias("w"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def q_fn_json(t: Tables) -> DataFrame:
    return t.events.select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT c_custkey, md5(c_name) AS m, sha256(c_name) AS s FROM customer")
def q_fn_hash(t: Tables) -> DataFrame:
    return t.customer.select("c_custkey", F.md5("c_name").alias("m"), F.sha2("c_name", 256).alias("s"))


@query("SELECT l_orderkey, l_linenumber, list_sum(list_transform([1, 2, 3], lambda x: x * l_linenumber))::INTEGER AS s, list_contains([1, 2], l_linenumber) AS has FROM lineitem")
def q_hof(t: Tables) -> DataFrame:
    three = F.array(F.lit(1), F.lit(2), F.lit(3))
    total = F.aggregate(F.transform(three, lambda x: x * F.col("l_linenumber")), F.lit(0), lambda a, x: a + x)
    return t.lineitem.select("l_orderkey", "l_linenumber", total.alias("s"), F.exists(F.array(F.lit(1), F.lit(2)), lambda x: x == F.col("l_linenumber")).alias("has"))


@query("SELECT n_nationkey, n_name AS f, n_regionkey * 10 AS i, NULL::INTEGER AS m FROM nation")
def q_extract_value(t: Tables) -> DataFrame:
    s = F.struct(F.col("n_name").alias("name"), F.array(F.col("n_regionkey"), F.col("n_regionkey") * 10).alias("xs"))
    return t.nation.select("n_nationkey", s.getField("name").alias("f"), F.get(s["xs"], F.lit(1)).alias("i"), F.try_element_at(s["xs"], F.lit(5)).alias("m"))


@query("SELECT n_nationkey, lower(n_name) AS name, 1 AS one FROM nation")
def q_update_fields(t: Tables) -> DataFrame:
    s = F.struct(F.col("n_name").alias("name"), F.lit(9).alias("gone")).withField("one", F.lit(1)).withField("name", F.lower("n_name")).dropFields("gone")
    return t.nation.select("n_nationkey", s.alias("s")).select("n_nationkey", "s.*")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def q_parse_json(t: Tables) -> DataFrame:
    return readers.parse(t.events.select("event_id", "props"), "props", "json", "k bigint").select("event_id", "k")


@query("SELECT o_orderkey AS a, o_orderpriority AS b, o_totalprice AS c FROM orders")
def q_parse_csv(t: Tables) -> DataFrame:
    lines = t.orders.select(F.concat_ws(",", "o_orderkey", "o_orderpriority", "o_totalprice").alias("line"))
    return readers.parse(lines, "line", "csv", "a bigint, b string, c double").select("a", "b", "c")


@query("SELECT p_partkey, CAST(p_size AS VARCHAR) AS s, TRY_CAST(p_brand AS INTEGER) AS bad, CAST(CAST(p_retailprice AS DECIMAL(12,2)) AS DOUBLE) AS d, CAST(p_size AS SMALLINT) AS u, NULL::BIGINT AS n FROM part")
def q_cast(t: Tables) -> DataFrame:
    return t.part.select("p_partkey", F.col("p_size").cast("string").alias("s"), F.col("p_brand").try_cast("int").alias("bad"), F.col("p_retailprice").cast(types.spark_type("decimal(12,2)")).cast("double").alias("d"), F.col("p_size").cast(types.spark_type("uint8")).alias("u"), types.null_of(types.spark_type("int64")).alias("n"))


@query("SELECT CAST(DATE '2024-02-29' AS VARCHAR) AS d, TIMESTAMP '2024-02-29 12:30:00' AS n")
def q_dates(t: Tables) -> DataFrame:
    return t.spark.range(1).select(F.lit("2024-02-29").cast("date").cast("string").alias("d"), F.lit("2024-02-29 12:30:00").cast("timestamp_ntz").alias("n"))
