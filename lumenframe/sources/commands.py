"""Catalog, cache, session and display commands."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import DataFrame, SparkSession

from .storage_levels import parse_level


class Commands:
    """The commands of the session's catalog; each is one call of Spark's."""

    def __init__(self, spark: SparkSession):
        self.spark, self.catalog = spark, spark.catalog

    # databases, tables, columns, functions, catalogs
    def current_database(self) -> str:
        return self.catalog.currentDatabase()

    def set_current_database(self, name: str) -> None:
        self.catalog.setCurrentDatabase(name)

    def list_databases(self, pattern: str | None = None):
        return self.catalog.listDatabases(pattern)

    def get_database(self, name: str):
        return self.catalog.getDatabase(name)

    def database_exists(self, name: str) -> bool:
        return self.catalog.databaseExists(name)

    def create_database(self, name: str, *, comment: str | None = None, location: str | None = None, if_not_exists: bool = True) -> None:
        text = f"CREATE DATABASE {'IF NOT EXISTS ' * if_not_exists}{name}"
        text += f" COMMENT '{comment}'" if comment else ""
        self.spark.sql(text + (f" LOCATION '{location}'" if location else ""))

    def drop_database(self, name: str, *, if_exists: bool = True, cascade: bool = False) -> None:
        self.spark.sql(f"DROP DATABASE {'IF EXISTS ' * if_exists}{name}{' CASCADE' * cascade}")

    def list_tables(self, database: str | None = None, pattern: str | None = None):
        return self.catalog.listTables(database, pattern)

    def get_table(self, name: str):
        return self.catalog.getTable(name)

    def table_exists(self, name: str) -> bool:
        return self.catalog.tableExists(name)

    def list_columns(self, table: str):
        return self.catalog.listColumns(table)

    def create_table(self, name: str, columns: str, *, fmt: str = "parquet", partition_by: tuple[str, ...] = (), comment: str | None = None, properties: dict[str, str] | None = None, if_not_exists: bool = False) -> None:
        """Constraints have no place in built-in tables; keep them as properties."""
        text = f"CREATE TABLE {'IF NOT EXISTS ' * if_not_exists}{name} ({columns}) USING {fmt}"
        text += f" PARTITIONED BY ({', '.join(partition_by)})" if partition_by else ""
        text += f" COMMENT '{comment}'" if comment else ""
        text += " TBLPROPERTIES (" + ", ".join(f"'{k}'='{v}'" for k, v in properties.items()) + ")" if properties else ""
        self.spark.sql(text)

    def drop_table(self, name: str, *, if_exists: bool = True, purge: bool = False) -> None:
        self.spark.sql(f"DROP TABLE {'IF EXISTS ' * if_exists}{name}{' PURGE' * purge}")

    def alter_table(self, name: str, operation: str) -> None:
        self.spark.sql(f"ALTER TABLE {name} {operation}")

    def create_view(self, name: str, df: DataFrame, *, kind: str = "temporary", replace: bool = True) -> None:
        make = {("temporary", True): df.createOrReplaceTempView, ("temporary", False): df.createTempView, ("global", True): df.createOrReplaceGlobalTempView, ("global", False): df.createGlobalTempView}
        make[kind, replace](name)

    def alter_view(self, name: str, query: str) -> None:
        self.spark.sql(f"ALTER VIEW {name} AS {query}")

    def drop_view(self, name: str, *, kind: str = "temporary") -> None:
        {"temporary": self.catalog.dropTempView, "global": self.catalog.dropGlobalTempView, "default": lambda n: self.spark.sql(f"DROP VIEW IF EXISTS {n}")}[kind](name)

    def list_functions(self, database: str | None = None, pattern: str | None = None):
        return self.catalog.listFunctions(database, pattern)

    def get_function(self, name: str):
        return self.catalog.getFunction(name)

    def function_exists(self, name: str) -> bool:
        return self.catalog.functionExists(name)

    def drop_function(self, name: str, *, if_exists: bool = True, temporary: bool = True) -> None:
        self.spark.sql(f"DROP {'TEMPORARY ' * temporary}FUNCTION {'IF EXISTS ' * if_exists}{name}")

    def refresh_function(self, name: str) -> None:
        self.spark.sql(f"REFRESH FUNCTION {name}")

    def current_catalog(self) -> str:
        return self.catalog.currentCatalog()

    def set_current_catalog(self, name: str) -> None:
        self.catalog.setCurrentCatalog(name)

    def list_catalogs(self, pattern: str | None = None):
        return self.catalog.listCatalogs(pattern)

    def create_catalog(self, name: str, implementation: str, **options: str) -> None:
        """Spark has no statement for it: a catalog is a setting."""
        self.spark.conf.set(f"spark.sql.catalog.{name}", implementation)
        for k, v in options.items():
            self.spark.conf.set(f"spark.sql.catalog.{name}.{k}", v)

    # cache
    def cache_table(self, name: str, *, level: str | None = None, lazy: bool = False, query: str | None = None) -> None:
        text = f"CACHE {'LAZY ' * lazy}TABLE {name}" + (f" OPTIONS('storageLevel'='{level.upper()}')" if level else "")
        if level:
            parse_level(level)
        self.spark.sql(text + (f" AS {query}" if query else ""))

    def is_cached(self, name: str) -> bool:
        return self.catalog.isCached(name)

    def uncache_table(self, name: str, *, if_exists: bool = True) -> None:
        self.spark.sql(f"UNCACHE TABLE {'IF EXISTS ' * if_exists}{name}")

    def clear_cache(self) -> None:
        self.catalog.clearCache()

    def refresh_table(self, name: str) -> None:
        self.catalog.refreshTable(name)

    def refresh_by_path(self, path: str) -> None:
        self.catalog.refreshByPath(path)

    def recover_partitions(self, name: str) -> None:
        self.catalog.recoverPartitions(name)

    # session
    def set_variable(self, name: str, value: str) -> None:
        self.spark.conf.set(name, value)

    def reset_variable(self, name: str | None = None) -> None:
        self.spark.conf.unset(name) if name else self.spark.sql("RESET")

    # display
    def show_string(self, df: DataFrame, rows: int = 20, truncate: int | bool = 20, vertical: bool = False) -> str:
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.show(rows, truncate, vertical)
        return out.getvalue()

    def html_string(self, df: DataFrame, rows: int = 20) -> str:
        return df.limit(rows).toPandas().to_html(index=False)

    def explain(self, df: DataFrame, mode: str = "simple") -> str:
        if mode == "analyze":
            df.write.format("noop").mode("overwrite").save()
            mode = "formatted"
        out = io.StringIO()
        with contextlib.redirect_stdout(out):
            df.explain(mode=mode)
        return out.getvalue()
