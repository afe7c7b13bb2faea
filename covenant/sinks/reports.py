"""Sinks: findings as SARIF, evidence, console lines and baselines; contracts as JSON and TypeScript.

A document of JSON is one value, so it is made of sorted pieces on the way out; the line formats are
written by all executors side by side, and are what large runs use.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.functions import text
from covenant.operators import engine
from covenant.sources import files

TYPESCRIPT = {"string": "string", "Guid": "string", "DateTime": "string", "DateTimeOffset": "string", "int": "number", "long": "number", "short": "number", "byte": "number", "decimal": "number", "double": "number", "float": "number", "bool": "boolean"}


LOCATION = "struct<path:string, start_line:bigint, start_column:bigint, end_line:bigint, end_column:bigint>"


def console_lines(found: DataFrame) -> DataFrame:
    """A line for each finding, with its place (counted from 1) where ``found`` has a ``location`` (see ``LOCATION``, counted from 0)."""
    line = F.concat(F.lit("["), F.upper("severity"), F.lit("] "), "rule_id", F.lit(": "), "message")
    if "location" in found.columns:
        place = F.concat(F.lit(" ("), text.one_based(F.col("location.start_line")).cast("string"), F.lit(":"), text.one_based(F.col("location.start_column")).cast("string"), F.lit(")"))
        line = F.concat(line, F.when(F.col("location").isNotNull(), place).otherwise(""))
    return found.select(line.alias("value"))


def sarif_line(found: DataFrame) -> DataFrame:
    """Each finding as a SARIF result, a line of JSON, with its ``location`` and the safe ones of its ``properties`` where ``found`` has these columns."""
    fields = [F.col("rule_id").alias("ruleId"), text.sarif_level(F.col("severity")).alias("level"), F.struct(text.redact_sarif(F.coalesce("message", F.lit(""))).alias("text")).alias("message")]
    if "location" in found.columns:
        at = F.col("location").cast(LOCATION)
        artifact = F.struct(F.coalesce(at["path"], F.lit("")).alias("uri"), F.lit("%SRCROOT%").alias("uriBaseId"))
        region = F.struct(*(text.one_based(at[k]).alias(n) for k, n in (("start_line", "startLine"), ("start_column", "startColumn"), ("end_line", "endLine"), ("end_column", "endColumn"))))
        one = F.struct(F.struct(artifact.alias("artifactLocation"), region.alias("region")).alias("physicalLocation"))
        fields.append(F.filter(F.array(F.when(at.isNotNull(), one)), lambda x: x.isNotNull()).alias("locations"))
    if "properties" in found.columns:
        fields.append(engine.safe_properties(F.coalesce("properties", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>")))).alias("properties"))
    return found.select(F.to_json(F.struct(*fields)).alias("value"))


def emit(found: DataFrame, sinks: list[Callable[[DataFrame], None]]) -> None:
    """Hands the findings to every sink; they are found once. What a sink raises is raised when all have had their turn."""
    held, failed = found.cache(), []
    for sink in sinks:
        try:
            sink(held)
        except Exception as e:  # the others still get theirs
            failed.append(e)
    held.unpersist()
    if failed:
        raise ExceptionGroup("sinks failed", failed)


def write_sarif(found: DataFrame, path: str, tool: str = "covenant") -> None:
    """A SARIF 2.1.0 document. Results come to the writer partition by partition, never all at once."""
    rules = [{"id": r.rule_id, "name": r.name, "shortDescription": {"text": r.description}, "defaultConfiguration": {"level": r.level}} for r in engine.sarif_rules(found).orderBy("rule_id").collect()]
    head = json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": tool, "rules": rules}}, "results": []}]})
    with Path(path).open("w") as out:
        out.write(head.removesuffix("]}]}"))
        for k, row in enumerate(sarif_line(found.orderBy("rule_id", "message", "ord")).toLocalIterator(prefetchPartitions=True)):
            out.write("," * bool(k) + row.value)
        out.write("]}]}")


def evidence_lines(found: DataFrame) -> DataFrame:
    """Redacted findings by rule, severity and message, each a line of JSON."""
    rows = found.select("rule_id", text.evidence_severity(F.col("severity")).alias("severity"), text.redact_evidence(F.col("message")).alias("message"))
    return rows.orderBy("rule_id", "severity", "message").select(F.to_json(F.struct(F.col("rule_id").alias("ruleId"), "severity", "message")).alias("value"))


def write_document(path: str, head: dict, lists: dict[str, Iterator[str]]) -> None:
    """A JSON object of ``head`` and of lists whose items come one by one, as JSON. Written beside its place and moved there, so a reader sees the old file or the new."""
    part = Path(f"{path}.part")
    with part.open("w") as out:
        out.write(json.dumps(head, indent=1).removesuffix("\n}"))
        for name, items in lists.items():
            out.write(f",\n {json.dumps(name)}: [")
            for k, item in enumerate(items):
                out.write(("," if k else "") + "\n  " + item)
            out.write("\n ]")
        out.write("\n}\n")
    part.replace(path)


def write_evidence(found: DataFrame, path: str, provider: str) -> None:
    """The evidence document: its version, the provider and all findings in order."""
    write_document(path, {"schemaVersion": "1.0", "provider": provider}, {"violations": lines(evidence_lines(found))})


def write_baseline(found: DataFrame, path: str, mode: str, created: str, columns: DataFrame | None = None, schema_version: str = "1.0", database_version: str | None = None, semantics: str | None = None) -> None:
    """A baseline of version 2: each finding once, the schema if there is one, and its hash (the findings' hash else). Rows come to the writer one by one."""
    once = found.select("rule_id", "message", "severity").distinct()
    digest = engine.schema_hash(columns) if columns is not None else engine.finding_hash(once)
    value = digest.first()[0]
    head = {"Version": 2, "CreatedAt": created, "SchemaVersion": schema_version, "GroundTruthMode": mode, "DatabaseVersion": database_version or "unknown", "SchemaHash": value}
    if semantics:
        head["LengthSemantics"] = semantics
    rows = once.orderBy("rule_id", "message", "severity").select(F.to_json(F.struct(F.col("rule_id").alias("RuleId"), F.col("message").alias("Message"), F.col("severity").alias("Severity"))).alias("value"))
    lists = {"Violations": lines(rows)}
    if columns is not None:
        names = {"Name": "column_name", "DataType": "data_type", "MaxLength": "max_length", "CharLength": "char_length", "Precision": "precision", "Scale": "scale", "IsNullable": "is_nullable", "CharUsed": "char_used"}
        one = F.struct("col_ord", F.struct(*(F.col(c).alias(n) for n, c in names.items() if c in columns.columns)).alias("c"))
        tables = columns.groupBy("table_name").agg(F.min("table_ord").alias("o"), F.transform(F.array_sort(F.collect_list(one)), lambda x: x["c"]).alias("Columns"))
        lists["Schema"] = lines(tables.orderBy("o", "table_name").select(F.to_json(F.struct(F.col("table_name").alias("Name"), "Columns")).alias("value")))
    write_document(path, head, lists)


def migrate_baseline(spark: SparkSession, path: str) -> bool:
    """Makes a baseline of version 1 one of version 2 with the findings' hash; false where there is none or it is of version 2 already."""
    if not Path(path).exists():
        return False
    info = files.baseline_info(spark, path).first()
    if info.version is None or info.version >= 2:
        return False
    write_baseline(files.baseline_findings(spark, path).cache(), path, info.mode or "Snapshot", info.created_at or "", None, info.schema_version or "1.0")
    return True


def typescript_type(clr_type: Column) -> Column:
    table = F.create_map(*(F.lit(x) for kv in TYPESCRIPT.items() for x in kv))
    return F.coalesce(F.try_element_at(table, F.regexp_replace(clr_type, r"\?$", "")), F.lit("unknown"))


def typescript(properties: DataFrame) -> DataFrame:
    """(entity, source): an interface for each entity, a property that can be null with a question mark."""
    line = F.concat(F.lit("  "), "name", F.when(F.col("is_nullable"), "?").otherwise(""), F.lit(": "), typescript_type(F.col("clr_type")), F.lit(";\n"))
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "")
    return properties.groupBy("entity").agg(F.concat(F.lit("export interface "), "entity", F.lit(" {\n"), lines, F.lit("}\n")).alias("source"))


def contract_export(properties: DataFrame) -> DataFrame:
    """(entity, json): each entity with its properties by name."""
    fields = F.array_sort(F.collect_list(F.struct("name", F.col("clr_type").alias("type"), F.col("is_nullable").alias("nullable"))))
    return properties.groupBy("entity").agg(fields.alias("properties")).select("entity", F.to_json(F.struct("entity", "properties")).alias("json"))


def write_contracts(path: str, provider: str, properties: DataFrame | None = None, parameters: DataFrame | None = None, columns: DataFrame | None = None) -> None:
    """The contracts' document: entities by name, procedures by name with their parameters in order, tables by name with their columns in order. What isn't given is an empty list."""

    def grouped(rows: DataFrame | None, key: str, items: str, place: str, fields: dict[str, str]) -> Iterator[str]:
        if rows is None:
            return iter(())
        one = F.struct(place, F.struct(*(F.col(c).alias(n) for n, c in fields.items() if c in rows.columns)).alias("x"))
        listed = F.transform(F.array_sort(F.collect_list(one)), lambda v: v["x"])
        return lines(rows.groupBy(F.col(key).alias("name")).agg(listed.alias(items)).orderBy("name").select(F.to_json(F.struct("name", items)).alias("value")))

    lists = {
        "entities": grouped(properties, "entity", "properties", "name", {"name": "name", "columnName": "column_name", "type": "clr_type", "isNullable": "is_nullable", "maxLength": "max_length"}),
        "storedProcedures": grouped(parameters, "procedure_name", "parameters", "ord", {"name": "name", "type": "data_type", "direction": "direction", "maxLength": "max_length"}),
        "tables": grouped(columns, "table_name", "columns", "col_ord", {"name": "column_name", "type": "data_type", "isNullable": "is_nullable", "maxLength": "max_length"}),
    }
    write_document(path, {"provider": provider}, lists)


def lines(df: DataFrame) -> Iterator[str]:
    return (r.value for r in df.toLocalIterator(prefetchPartitions=True))
