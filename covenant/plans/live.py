"""Ground truth from a database's own catalogue, by provider: which tables are read, and what they become."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.plans.config import PROVIDERS
from covenant.sources import catalogs

#: Gives a catalogue table by its name, for example over JDBC.
Read = Callable[[str], DataFrame]


def _known(provider: str) -> str:
    name = (provider or "").lower()
    if name not in PROVIDERS:
        raise ValueError(f"unknown provider '{provider}': one of {', '.join(PROVIDERS)}")
    return name


def parameters(provider: str, read: Read, schema: str | None = None, package: str | None = None) -> DataFrame:
    """(procedure_name, ord, name, data_type, direction, max_length) of the procedures' parameters. Oracle needs its owner as ``schema``."""
    name = _known(provider)
    if name == "sqlserver":
        rows = catalogs.sqlserver_parameters(read("sys.procedures"), read("sys.schemas"), read("sys.parameters"), read("sys.types"))
        rows = rows.where(F.lower("schema_name") == schema.lower()) if schema else rows
        return rows.select(F.concat_ws(".", "schema_name", "procedure_name").alias("procedure_name"), "ord", "name", "data_type", "direction", "max_length")
    if name == "oracle":
        if not schema:
            raise ValueError("Oracle's catalogue needs an owner")
        rows = catalogs.oracle_arguments(read("all_arguments"), schema, package)
        procedure = F.concat_ws(".", F.nullif("package_name", F.lit("")), "object_name")
        return rows.select(procedure.alias("procedure_name"), F.col("position").alias("ord"), "name", "data_type", "direction", F.col("data_length").alias("max_length"))
    rows = catalogs.routine_parameters(read("information_schema.routines"), read("information_schema.parameters"), schema)
    return rows.select("procedure_name", "ord", "name", "data_type", "direction", "max_length")


def columns(provider: str, read: Read, schema: str | None = None) -> DataFrame:
    """(table_name, table_ord, column_name, col_ord, data_type, max_length, char_length, char_used, is_nullable) of the tables; a table's place is that of its name."""
    name = _known(provider)
    if name == "oracle":
        if not schema:
            raise ValueError("Oracle's catalogue needs an owner")
        rows = catalogs.oracle_columns(read("all_tab_columns"), schema)
    else:
        rows = read("information_schema.columns")
        rows = rows.where(F.lower("table_schema") == schema.lower()) if schema else rows
        size = F.when(F.col("character_maximum_length").between(0, 2147483647), F.col("character_maximum_length")).cast("int")
        rows = rows.select("table_name", "column_name", "data_type", size.alias("max_length"), F.lit(None).cast("int").alias("char_length"), (F.upper("is_nullable") == "YES").alias("is_nullable"), F.lit(None).cast("string").alias("char_used"), F.col("ordinal_position").alias("col_ord"))
    places = rows.select("table_name").distinct().groupBy().agg(F.array_sort(F.collect_list("table_name")).alias("names")).select(F.posexplode("names").alias("table_ord", "table_name"))
    return rows.join(places, "table_name").select("table_name", "table_ord", "column_name", "col_ord", "data_type", "max_length", "char_length", "char_used", "is_nullable")
