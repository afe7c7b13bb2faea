"""Sources that are files: snapshots, baselines, manual contracts, model snapshots, statements, seeds, reports.

Each gives tables of fixed columns. JSON is parsed by Spark with a declared schema; field names may begin
with a capital or not.
"""

from __future__ import annotations

import json
from functools import reduce
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructField, StructType

FINDING = "RuleId string, Message string, Severity string"
COLUMN = "Name string, DataType string, MaxLength int, CharLength int, Precision int, Scale int, IsNullable boolean, CharUsed string"
BASELINE = f"Version int, CreatedAt string, SchemaVersion string, GroundTruthMode string, DatabaseVersion string, SchemaHash string, LengthSemantics string, Violations array<struct<{FINDING.replace(' string', ':string')}>>, Schema array<struct<Name:string, Columns:array<struct<{', '.join(f'{a}:{b}' for a, b in (x.split(' ') for x in COLUMN.split(', ')))}>>>>"


def _turned(kind: DataType) -> DataType:
    """The same type with the case of every field's first letter turned."""
    if isinstance(kind, ArrayType):
        return ArrayType(_turned(kind.elementType))
    if isinstance(kind, StructType):
        return StructType([StructField(f.name[0].swapcase() + f.name[1:], _turned(f.dataType)) for f in kind])
    return kind


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A row for each file, with the fields of ``schema`` in either case."""
    wanted = StructType.fromDDL(schema)
    turned = _turned(wanted)
    rows = spark.read.text(path, wholetext=True).select(F.from_json("value", wanted).alias("a"), F.from_json("value", turned).alias("b"))
    return rows.select(*(F.coalesce(F.col(f"a.{f.name}"), F.col(f"b.{t.name}").cast(f.dataType)).alias(f.name) for f, t in zip(wanted, turned, strict=True)))


def baseline_findings(spark: SparkSession, path: str) -> DataFrame:
    """(rule_id, message, severity) of a baseline file, either version."""
    rows = _json(spark, path, BASELINE).select(F.inline("Violations"))
    return rows.select(F.col("RuleId").alias("rule_id"), F.col("Message").alias("message"), F.col("Severity").alias("severity"))


def baseline_info(spark: SparkSession, path: str) -> DataFrame:
    """What a baseline file says of itself: version, created_at, schema_version, mode, database_version, schema_hash, length_semantics; a snapshot that doesn't say counts characters."""
    names = {"version": "Version", "created_at": "CreatedAt", "schema_version": "SchemaVersion", "mode": "GroundTruthMode", "database_version": "DatabaseVersion", "schema_hash": "SchemaHash"}
    return _json(spark, path, BASELINE).select(*(F.col(n).alias(k) for k, n in names.items()), F.upper(F.coalesce("LengthSemantics", F.lit("CHAR"))).alias("length_semantics"))


def snapshot_columns(spark: SparkSession, path: str) -> DataFrame:
    """The columns of a snapshot file, with the places of tables and columns in it."""
    tables = _json(spark, path, BASELINE).select(F.posexplode("Schema").alias("table_ord", "t"))
    rows = tables.select("table_ord", F.col("t.Name").alias("table_name"), F.posexplode("t.Columns").alias("col_ord", "c"))
    names = {"column_name": "Name", "data_type": "DataType", "max_length": "MaxLength", "char_length": "CharLength", "precision": "Precision", "scale": "Scale", "is_nullable": "IsNullable", "char_used": "CharUsed"}
    return rows.select("table_name", "table_ord", "col_ord", *(F.col(f"c.{n}").alias(k) for k, n in names.items()))


def statements(spark: SparkSession, path: str) -> DataFrame:
    """(contract_id, sql_text) for each file below ``path``; the id is the file's path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("contract_id"), F.col("value").alias("sql_text"))


PARAMETER = r"@(\w+)\s+(?:AS\s+)?([A-Za-z_][\w.]*(?:\s*\(\s*(?:\d+|MAX)\s*(?:,\s*\d+\s*)?\))?)"
#: Types whose numbers are precision and scale, not a length.
NUMERIC_TYPES = ("decimal", "numeric", "money", "smallmoney", "float", "real")


def declared_parameters(found: DataFrame) -> DataFrame:
    """Parameters that a statement declares: name, type (lower case, without spaces), and length, precision and scale by the kind of type; a length or precision of 0 is none."""
    pattern = "(?iU)" + PARAMETER
    rows = found.select("contract_id", F.posexplode(F.arrays_zip(F.regexp_extract_all("sql_text", F.lit(pattern), F.lit(1)).alias("n"), F.regexp_extract_all("sql_text", F.lit(pattern), F.lit(2)).alias("t"))).alias("ord", "x"))
    kind = F.lower(F.regexp_replace("x.t", r"\s", ""))
    number = lambda k: F.nullif(F.regexp_extract(kind, r"\((\d+)(?:,(\d+))?\)", k), F.lit("")).try_cast("int")
    numeric = F.regexp_extract(kind, r"^([\w.]+)", 1).isin(*NUMERIC_TYPES)
    first = F.nullif(number(1), F.lit(0))
    return rows.select("contract_id", "ord", F.col("x.n").alias("name"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("unknown")).alias("data_type"), F.when(~numeric, first).alias("max_length"), F.when(numeric, first).alias("precision"), F.when(numeric, number(2)).alias("scale"))


MODEL = "BuildModel array<struct<Method:string, GenericArguments:array<struct<Name:string>>, ToTable:array<struct<Value:string>>, Properties:array<struct<Name:string, ClrType:string, Calls:array<struct<Method:string, Arguments:array<string>>>>>>>"


def _entity_nodes(value, inside: bool = False) -> list[dict]:
    """Nodes that set an entity up, at any depth below ``BuildModel``, in their order."""
    if isinstance(value, list):
        return [n for v in value for n in _entity_nodes(v, inside)]
    if not isinstance(value, dict):
        return []
    method = value.get("Method")
    if inside and isinstance(method, str) and (method == "Entity" or method.startswith("Entity<")):
        return [value]
    inside = inside or method == "BuildModel"
    return [n for k, v in value.items() for n in _entity_nodes(v, inside or k == "BuildModel")]


def find_model_snapshot(folder: str) -> str | None:
    """The model snapshot below a project's folder: the first by name of those that end in ``ModelSnapshot.json``, else null."""
    found = sorted(str(p) for p in Path(folder).rglob("*ModelSnapshot.json"))
    return found[0] if found else None


def locate_types(sources: DataFrame, names: DataFrame) -> DataFrame:
    """(name, path, line) of the first file of ``sources(path, text)`` that declares each class of ``names(name)``; lines count from 1."""
    pattern = r"\b(?:class|record|struct)\s+([A-Za-z_]\w*)"
    lines = sources.select("path", F.posexplode(F.split("text", "\n")).alias("line", "t"))
    declared = lines.select("path", (F.col("line") + 1).alias("line"), F.explode(F.regexp_extract_all("t", F.lit(pattern), F.lit(1))).alias("name"))
    return declared.join(names.select("name").distinct(), "name").groupBy("name").agg(F.min(F.struct("path", "line")).alias("x")).select("name", "x.*")


def _last_argument(calls: str, method: str) -> Column:
    """First argument of the last call of ``method``; '' if it had none, null if it wasn't called."""
    hits = F.filter(calls, lambda c: c["Method"] == method)
    return F.when(F.size(hits) > 0, F.coalesce(F.try_element_at(F.element_at(hits, -1)["Arguments"], F.lit(1)), F.lit("")))


def model_properties(spark: SparkSession, path: str, excluded: tuple[str, ...] = ()) -> DataFrame:
    """Entities and properties of a model snapshot, a file that the driver reads; nodes without a type are dropped, and of repeated calls the last counts."""
    kind = StructType.fromDDL(MODEL)["BuildModel"].dataType
    nodes = spark.createDataFrame([(json.dumps(_entity_nodes(json.loads(Path(path).read_text()))),)], "nodes string").select(F.posexplode(F.from_json("nodes", kind)).alias("entity_ord", "e"))
    entity = F.element_at(F.split(F.try_element_at("e.GenericArguments", F.lit(1))["Name"], r"\."), -1)
    named = nodes.withColumn("entity", entity).where(F.col("entity").isNotNull() & ~F.col("entity").isin(*excluded))
    table = F.coalesce(F.try_element_at("e.ToTable", F.lit(-1))["Value"], F.col("entity"))
    rows = named.select("entity", table.alias("table_name"), F.posexplode("e.Properties").alias("ord", "p"))
    call = lambda m: _last_argument("p.Calls", m)
    return rows.select("entity", "table_name", "ord", F.col("p.Name").alias("name"), F.col("p.ClrType").alias("clr_type"), F.coalesce(call("HasColumnName"), F.col("p.Name")).alias("column_name"), call("HasColumnType").alias("column_type"), F.coalesce(call("IsRequired").isin("", "true"), F.lit(False)).alias("is_required"), call("HasMaxLength").try_cast("int").alias("max_length"), call("IsPrimaryKey").isNotNull().alias("is_primary_key"), call("IsForeignKey").isNotNull().alias("is_foreign_key"))


MANUAL = "entities array<struct<name:string, columns:array<struct<property:string, column:string, type:string, maxLength:int, nullable:boolean>>>>, procedures array<struct<name:string, parameters:array<struct<name:string, type:string, direction:string, maxLength:int>>>>"


def manual_contracts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(properties, parameters) that a contract file declares; a length of 0 is none, and a direction that isn't a known one is Input."""
    whole = _json(spark, path, MANUAL)
    length = F.nullif(F.col("c.maxLength"), F.lit(0))
    entities = whole.select(F.inline("entities")).select(F.col("name").alias("entity"), F.posexplode("columns").alias("ord", "c"))
    properties = entities.select("entity", "ord", F.coalesce("c.property", "c.column").alias("name"), F.col("c.column").alias("column_name"), F.col("c.type").alias("data_type"), length.alias("max_length"), F.coalesce("c.nullable", F.lit(True)).alias("is_nullable"))
    procedures = whole.select(F.inline("procedures")).select(F.col("name").alias("procedure_name"), F.posexplode("parameters").alias("ord", "c"))
    known = F.when(F.col("c.direction").isin("Input", "Output", "InputOutput", "ReturnValue"), F.col("c.direction")).otherwise("Input")
    return properties, procedures.select("procedure_name", "ord", F.col("c.name").alias("name"), F.col("c.type").alias("data_type"), known.alias("direction"), length.alias("max_length"))


def corpus_columns(spark: SparkSession, path: str) -> DataFrame:
    """(table_name, table_ord, column_name, col_ord, data_type, max_length, is_nullable) of a corpus file, whose columns are names or objects."""
    tables = _json(spark, path, "tables array<struct<name:string, columns:array<string>>>").select(F.posexplode("tables").alias("table_ord", "t"))
    rows = tables.select(F.col("t.name").alias("table_name"), "table_ord", F.posexplode("t.columns").alias("col_ord", "c"))
    known = F.when(F.col("c").startswith("{"), F.from_json("c", "name string, dataType string, maxLength int, isNullable boolean"))
    return rows.withColumn("o", known).select("table_name", "table_ord", F.coalesce("o.name", "c").alias("column_name"), "col_ord", F.col("o.dataType").alias("data_type"), F.col("o.maxLength").alias("max_length"), F.coalesce("o.isNullable", F.lit(True)).alias("is_nullable"))


def texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text) of the files below ``path``, a row for each."""
    return spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def usage(found: DataFrame, orm: tuple[str, ...] = ("DbContext", "UseSqlServer", "UseOracle"), mapper: tuple[str, ...] = ("Dapper", ".Query")) -> DataFrame:
    """(path, orm, mapper): whether a file's text uses an object mapper or a query mapper."""
    has = lambda words: reduce(Column.__or__, (F.contains("text", F.lit(w)) for w in words))
    return found.select("path", has(orm).alias("orm"), has(mapper).alias("mapper"))


def context_names(found: DataFrame) -> DataFrame:
    """(path, name) of the classes that derive from a database context."""
    return found.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"class\s+(\w+)\s*(?:\([^)]*\))?\s*:\s*DbContext\b"), F.lit(1))).alias("name"))


SEED = "repositories array<struct<repo:string, ecosystem:string, category:string, downstream_dependents:bigint, maintainer_count:bigint, stale_issues_count:bigint, has_mcp_server:boolean, risk_level:string>>"


def seed_repos(spark: SparkSession, path: str, category: str | None = None) -> DataFrame:
    """Repositories of a seed file: 500 dependents, 1 maintainer and 10 stale issues where it doesn't say, 90 days, and a vulnerability where the risk is critical."""
    rows = _json(spark, path, SEED).select(F.inline("repositories"))
    if category:
        rows = rows.where(F.lower("category") == category.lower())
    return rows.select("repo", "category", F.coalesce("downstream_dependents", F.lit(500)).alias("dependents"), F.coalesce("maintainer_count", F.lit(1)).alias("maintainers"), F.coalesce("stale_issues_count", F.lit(10)).alias("stale"), F.lit(90).cast("long").alias("days"), (F.coalesce("risk_level", F.lit("")) == "CRITICAL").cast("long").alias("vulnerabilities"), F.coalesce("has_mcp_server", F.lit(False)).alias("has_mcp"))


def audit_log(spark: SparkSession, path: str) -> DataFrame:
    """(line, valid) fields of an audit log of JSON lines; a line that isn't an object counts as broken."""
    fields = "Timestamp string, EventType string, Operation string, Hash string, PreviousHash string"
    rows = spark.read.text(path).where(F.trim("value") != "")
    return rows.select("value", F.from_json("value", fields).alias("e")).select("value", "e.*", F.col("e.Hash").isNotNull().alias("valid"))


SARIF = "runs array<struct<results:array<struct<ruleId:string, level:string, message:struct<text:string>, locations:array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>, region:struct<startLine:int, startColumn:int>>>>>>>>"


def sarif_results(spark: SparkSession, path: str) -> DataFrame:
    """(uri, line, column, rule_id, level, message) of a report, by each result's first location."""
    rows = _json(spark, path, SARIF).select(F.explode("runs").alias("r")).select(F.explode("r.results").alias("x"))
    first = F.try_element_at("x.locations", F.lit(1))["physicalLocation"]
    return rows.select(first["artifactLocation"]["uri"].alias("uri"), first["region"]["startLine"].alias("line"), first["region"]["startColumn"].alias("column"), F.col("x.ruleId").alias("rule_id"), F.col("x.level").alias("level"), F.col("x.message.text").alias("message"))
