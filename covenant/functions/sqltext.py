"""What statements say: tables and aliases, common table expressions, qualified and selected columns.

Each function takes ``statements(contract_id, sql_text)`` and gives a row for each finding with its place
in the statement (``ord``, from 0), since which comes first matters to the rules. Letters, digits and white
space are Unicode's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from covenant.functions.constants import ALIAS_STOP_WORDS, SHAPE_STOP_WORDS

TABLE_PATTERN = r"(?iU)\b(?:FROM|JOIN)\s+([A-Za-z_][\w]*(?:\.[A-Za-z_][\w]*)?)(?:\s+(?:AS\s+)?([A-Za-z_][\w]*))?"
CTE_PATTERN = r"(?iU)\bWITH\s+([A-Za-z_][\w]*)\s+AS\s*\("
QUALIFIED_PATTERN = r"(?iU)\b([A-Za-z_][\w]*)\.([A-Za-z_][\w]*)"
SELECT_PATTERN = r"(?isU)\bSELECT\s+(.+?)\s+FROM\b"
SHAPE_PATTERN = r"(?isU)SELECT\s+(.+?)\s+FROM"


def _all(pattern: str, group: int):
    return F.regexp_extract_all("sql_text", F.lit(pattern), F.lit(group))


def refs_of() -> Column:
    """The statement's table references, an array of (table_name, alias); names without their schema in upper case, no alias is ''."""
    pairs = F.arrays_zip(_all(TABLE_PATTERN, 1).alias("t"), _all(TABLE_PATTERN, 2).alias("a"))

    def reference(x: Column) -> Column:
        alias = F.upper(F.coalesce(x["a"], F.lit("")))
        return F.struct(F.upper(F.element_at(F.split(x["t"], r"\."), -1)).alias("table_name"), F.when(alias.isin(*ALIAS_STOP_WORDS), "").otherwise(alias).alias("alias"))

    return F.transform(pairs, reference)


def table_refs(statements: DataFrame) -> DataFrame:
    """(contract_id, ord, table_name, alias), a row for each reference."""
    return statements.select("contract_id", F.posexplode(refs_of()).alias("ord", "x")).select("contract_id", "ord", "x.*")


def cte_names(statements: DataFrame) -> DataFrame:
    return statements.select("contract_id", F.explode(_all(CTE_PATTERN, 1)).alias("n")).select("contract_id", F.upper("n").alias("name")).distinct()


def qualified_of() -> Column:
    """The statement's qualified columns, an array of (qualifier, column_name) in upper case."""
    pairs = F.arrays_zip(_all(QUALIFIED_PATTERN, 1).alias("q"), _all(QUALIFIED_PATTERN, 2).alias("c"))
    return F.transform(pairs, lambda x: F.struct(F.upper(x["q"]).alias("qualifier"), F.upper(x["c"]).alias("column_name")))


def _trimmed(part: Column) -> Column:
    return F.regexp_replace(part, r"(?U)^\s+|\s+$", "")


def _tokens(part: Column) -> Column:
    return F.filter(F.split(part, r"(?U)\s+"), lambda t: t != "")


def _plain_parts(statements: DataFrame, pattern: str) -> DataFrame:
    """Parts of the first SELECT list that are neither calls, qualified names nor arithmetic, trimmed."""
    clause = F.regexp_extract("sql_text", pattern, 1)
    parts = statements.select("contract_id", F.posexplode(F.split(clause, ",")).alias("ord", "part")).withColumn("part", _trimmed(F.col("part")))
    return parts.where((F.col("part") != "") & ~F.col("part").rlike(r"[*.(+\-/]"))


def selected_columns(statements: DataFrame) -> DataFrame:
    """(contract_id, ord, column_name) of plain columns in the first SELECT list, by what follows `` AS `` if they have it."""
    named = F.element_at(_tokens(F.regexp_replace("part", r"(?is)^.*? AS ", "")), -1)
    out = _plain_parts(statements, SELECT_PATTERN).withColumn("column_name", F.upper(named))
    return out.where(F.col("column_name").rlike(r"(?U)^[A-Z_]\w*$") & ~F.col("column_name").isin(*ALIAS_STOP_WORDS)).select("contract_id", "ord", "column_name")


def shape_columns(statements: DataFrame) -> DataFrame:
    """(contract_id, column_name) in lower case, once each, of a statement's result as far as its text tells."""
    parts = _plain_parts(statements, SHAPE_PATTERN).withColumn("tokens", _tokens(F.col("part")))
    place = F.array_position(F.transform("tokens", lambda t: F.upper(t)), F.lit("AS"))
    name = F.when((place > 0) & (place < F.size("tokens")), F.element_at("tokens", (place + 1).cast("int"))).otherwise(F.element_at("tokens", -1))
    return parts.withColumn("n", name).where(~F.upper("n").isin(*SHAPE_STOP_WORDS)).select("contract_id", F.lower("n").alias("column_name")).distinct()
