"""Queries over catalog, cache, session and display commands, and over relations that callers hold.

Each makes what it needs under a name of its own, and returns what the commands said as a table.
"""

from __future__ import annotations

import io
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import errors
from ..session import Engine
from ..sources.commands import Commands
from .registry import Tables, query


def _name(kind: str) -> str:
    return f"lumenframe_{kind}_{uuid.uuid4().hex}"


def _said(t: Tables, *rows: tuple[str, object]) -> DataFrame:
    """Rows (command, said)."""
    return t.spark.createDataFrame([(c, str(s)) for c, s in rows], "command string, said string")


def _sql(**rows: object) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"('{c}', '{s}')" for c, s in rows.items()) + ") AS v(command, said)"


@query(_sql(database_exists_before=False, database_exists=True, list_databases=True, get_database=True, set_current_database=True, table_in_it=True, dropped=False))
def q_cmd_databases(t: Tables) -> DataFrame:
    c, name = Commands(t.spark), _name("db")
    before, at_first = c.database_exists(name), c.current_database()
    c.create_database(name, comment="for a query")
    said = [("database_exists_before", before), ("database_exists", c.database_exists(name)), ("list_databases", [d.name for d in c.list_databases(f"{name}*")] == [name]), ("get_database", c.get_database(name).name == name)]
    try:
        c.set_current_database(name)
        said.append(("set_current_database", c.current_database() == name))
        c.create_table("inner_table", "k int")
        said.append(("table_in_it", c.table_exists(f"{name}.inner_table")))
    finally:
        c.set_current_database(at_first)
        c.drop_database(name, cascade=True)
    return _said(t, *said, ("dropped", c.database_exists(name)))


@query("SELECT column_name AS name, lower(CASE column_type WHEN 'INTEGER' THEN 'INT' WHEN 'VARCHAR' THEN 'STRING' ELSE column_type END) AS kind FROM (DESCRIBE customer)")
def q_cmd_list_columns(t: Tables) -> DataFrame:
    c, name = Commands(t.spark), _name("customer")
    t.customer.write.saveAsTable(name)
    found = [(x.name, x.dataType) for x in c.list_columns(name)]
    c.drop_table(name, purge=True)
    return t.spark.createDataFrame(found, "name string, kind string")


@query(_sql(created=True, get_table="MANAGED", altered="k,s,extra", list_tables=True, property="yes", if_not_exists=True, dropped=False))
def q_cmd_tables(t: Tables) -> DataFrame:
    c, name = Commands(t.spark), _name("table")
    c.create_table(name, "k int, s string", comment="a table", properties={"checked": "yes"})
    said = [("created", c.table_exists(name)), ("get_table", c.get_table(name).tableType)]
    c.create_table(name, "other int", if_not_exists=True)
    c.alter_table(name, "ADD COLUMNS (extra double)")
    said.append(("altered", ",".join(x.name for x in c.list_columns(name))))
    said.append(("list_tables", [x.name for x in c.list_tables(pattern=f"{name}*")] == [name]))
    said.append(("property", t.spark.sql(f"SHOW TBLPROPERTIES {name}('checked')").first()["value"]))
    said.append(("if_not_exists", True))
    c.drop_table(name)
    return _said(t, *said, ("dropped", c.table_exists(name)))


@query("SELECT 'temporary' AS kind, count(*) AS n FROM nation UNION ALL SELECT 'global', count(*) FROM region UNION ALL SELECT 'altered', count(*) FROM supplier UNION ALL SELECT 'left', 0")
def q_cmd_views(t: Tables) -> DataFrame:
    c, a, b, d, base = Commands(t.spark), _name("view"), _name("global"), _name("stored"), _name("supplier")
    c.create_view(a, t.nation)
    c.create_view(b, t.region, kind="global")
    t.supplier.write.saveAsTable(base)
    t.spark.sql(f"CREATE VIEW {d} AS SELECT 1 AS x")
    c.alter_view(d, f"SELECT * FROM {base}")
    n = {"temporary": t.spark.table(a).count(), "global": t.spark.table(f"global_temp.{b}").count(), "altered": t.spark.table(d).count()}
    c.drop_view(a)
    c.drop_view(b, kind="global")
    c.drop_view(d, kind="default")
    n["left"] = sum(map(c.table_exists, (a, f"global_temp.{b}", d)))
    c.drop_table(base)
    return t.spark.createDataFrame(list(n.items()), "kind string, n bigint")


@query(_sql(function_exists=True, get_function=True, list_functions=True, call=42, refresh_function=True, dropped=False, built_in=True))
def q_cmd_functions(t: Tables) -> DataFrame:
    c, temporary, stored = Commands(t.spark), _name("f"), _name("g")
    t.spark.udf.register(temporary, lambda x: x * 2, "int")
    said = [("function_exists", c.function_exists(temporary)), ("get_function", c.get_function(temporary).isTemporary), ("list_functions", [f.name for f in c.list_functions(pattern=temporary)] == [temporary])]
    said.append(("call", t.spark.sql(f"SELECT {temporary}(21)").first()[0]))
    t.spark.sql(f"CREATE FUNCTION {stored} AS 'org.apache.hadoop.hive.ql.udf.UDFMd5'")
    c.refresh_function(stored)
    said.append(("refresh_function", True))
    c.drop_function(temporary)
    c.drop_function(stored, temporary=False)
    return _said(t, *said, ("dropped", c.function_exists(temporary) or c.function_exists(stored)), ("built_in", c.function_exists("upper")))


@query(_sql(current_catalog="spark_catalog", list_catalogs=True, create_catalog="some.Implementation", option="v"))
def q_cmd_catalogs(t: Tables) -> DataFrame:
    c, name = Commands(t.spark), _name("catalog")
    c.set_current_catalog("spark_catalog")
    c.create_catalog(name, "some.Implementation", key="v")
    said = [("current_catalog", c.current_catalog()), ("list_catalogs", "spark_catalog" in [x.name for x in c.list_catalogs()])]
    for label, setting in (("create_catalog", ""), ("option", ".key")):
        said.append((label, t.spark.conf.get(f"spark.sql.catalog.{name}{setting}")))
        c.reset_variable(f"spark.sql.catalog.{name}{setting}")
    return _said(t, *said)


@query(_sql(cached=True, uncached=False, lazily=True, cleared=False) + " UNION ALL SELECT 'rows', CAST(count(*) AS VARCHAR) FROM region")
def q_cmd_cache(t: Tables) -> DataFrame:
    c, name, other = Commands(t.spark), _name("cached"), _name("lazy")
    t.region.write.saveAsTable(name)
    c.cache_table(name, level="memory_and_disk")
    said = [("cached", c.is_cached(name)), ("rows", t.spark.table(name).count())]
    c.uncache_table(name)
    said.append(("uncached", c.is_cached(name)))
    c.cache_table(other, lazy=True, query=f"SELECT * FROM {name}")
    said.append(("lazily", c.is_cached(other)))
    c.clear_cache()
    said.append(("cleared", c.is_cached(other)))
    c.drop_view(other)
    c.drop_table(name)
    return _said(t, *said)


@query("SELECT n_regionkey AS part, count(*) AS n FROM nation GROUP BY n_regionkey")
def q_cmd_recover_partitions(t: Tables) -> DataFrame:
    """A table over files that were there before it knows their partitions after recovery; refreshes see files that come later."""
    from ..scratch import shared_path

    c, name, path = Commands(t.spark), _name("nation"), shared_path(t.spark, "nation")
    part = t.nation.select("n_name", F.col("n_regionkey").alias("part"))
    part.where("part < 3").write.partitionBy("part").parquet(path)
    t.spark.sql(f"CREATE TABLE {name} (n_name string, part int) USING parquet PARTITIONED BY (part) LOCATION '{path}'")
    c.recover_partitions(name)
    part.where("part >= 3").write.partitionBy("part").mode("append").parquet(path)
    c.recover_partitions(name)
    c.refresh_table(name)
    c.refresh_by_path(path)
    return t.spark.table(name).groupBy("part").agg(F.count("*").alias("n"))


@query(_sql(set_variable=7, reset_variable=True))
def q_cmd_variables(t: Tables) -> DataFrame:
    c, name = Commands(t.spark), f"lumenframe.variable.{uuid.uuid4().hex}"
    c.set_variable(name, "7")
    said = [("set_variable", t.spark.conf.get(name))]
    c.reset_variable(name)
    return _said(t, *said, ("reset_variable", t.spark.conf.get(name, None) is None))


@query("SELECT r_name AS shown, r_name AS in_html FROM region")
def q_cmd_show(t: Tables) -> DataFrame:
    """The cells of region's names, read back from the table of text and the table of HTML."""
    c, names = Commands(t.spark), t.region.select("r_name").orderBy("r_name")
    lines = [x.strip("| ") for x in c.show_string(names, truncate=False).split("\n") if x.startswith("|")][1:]
    cells = [x.strip()[4:-5] for x in c.html_string(names).split("\n") if x.strip().startswith("<td>")]
    return t.spark.createDataFrame(list(zip(lines, cells)), "shown string, in_html string")


@query(_sql(simple=True, extended=True, codegen=True, cost=True, formatted=True, analyze=True))
def q_cmd_explain(t: Tables) -> DataFrame:
    plan = t.orders.where("o_totalprice > 10").groupBy("o_orderstatus").count()
    signs = {"simple": "Physical Plan", "extended": "Optimized Logical Plan", "codegen": "WholeStageCodegen", "cost": "sizeInBytes", "formatted": "PushedFilters", "analyze": "HashAggregate"}
    return _said(t, *((mode, sign in Commands(t.spark).explain(plan, mode)) for mode, sign in signs.items()))


@query(_sql(missing_table="catalog", missing_column="analysis", bad_syntax="parse", by_zero="arithmetic", bad_cast="conversion", no_form="unsupported", network="network"))
def q_error_classes(t: Tables) -> DataFrame:
    texts = {"missing_table": "SELECT * FROM no_such_table_here", "missing_column": "SELECT x FROM range(1)", "bad_syntax": "SELEC 1", "by_zero": "SELECT 1 / (id - id) FROM range(1)", "bad_cast": "SELECT CAST(concat('a', id) AS INT) FROM range(1)"}
    said = []
    for name, text in texts.items():
        try:
            t.spark.sql(text).collect()
            said.append((name, "none"))
        except Exception as e:  # what kind of error it is, is the result
            said.append((name, errors.classify(e).category))
    return _said(t, *said, ("no_form", errors.classify(errors.Unsupported("x")).category), ("network", errors.classify(ConnectionError()).category))


@query("SELECT n_nationkey, n_name FROM nation UNION ALL SELECT -1, 'from a table'")
def q_local_relation(t: Tables) -> DataFrame:
    """Arrow IPC bytes and an Arrow table as relations."""
    held = t.nation.select("n_nationkey", "n_name").toArrow()
    sink = io.BytesIO()
    with pa.ipc.new_stream(sink, held.schema) as to:
        to.write_table(held)
    e = Engine(t.spark)
    return e.local(sink.getvalue()).union(e.local(pa.table({"n_nationkey": pa.array([-1], pa.int32()), "n_name": ["from a table"]})))


@query("SELECT range AS id, 10 AS n FROM range(0, 10)")
def q_collect(t: Tables) -> DataFrame:
    """range(0, 10) through collect and count of the data set, as Arrow batches."""
    ten = Engine(t.spark).range(0, 10, 1, 2)
    batches = ten.collect()
    return Engine(t.spark).local(pa.Table.from_batches(batches).append_column("n", pa.array([ten.count()] * 10, pa.int64())))


@query("SELECT event_id, props AS line FROM events WHERE props IS NOT NULL")
def q_infer_json(t: Tables) -> DataFrame:
    """Lines parsed by the schema that is inferred from them, and written as JSON again, with the blank that the table's lines have."""
    from ..sources import readers

    rows = t.events.where("props IS NOT NULL").select("event_id", "props")
    schema = readers.infer_json_schema(rows, "props")
    parsed = rows.select("event_id", F.from_json("props", schema).alias("p"))
    return parsed.select("event_id", F.regexp_replace(F.to_json("p"), '":', '": ').alias("line"))
