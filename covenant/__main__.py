"""The command line.

    python -m covenant validate --sql DIR --schema FILE [--entities FILE] [--sources DIR] [--baseline FILE] [--format text|sarif|evidence|contracts|typescript] [--output FILE]
    python -m covenant baseline --sql DIR --schema FILE --baseline FILE
    python -m covenant snapshot show|refresh|diff --snapshot FILE [--schema FILE] [--fail-on-drift]
    python -m covenant oracle-check --schema FILE
    python -m covenant migrate --baseline FILE
    python -m covenant radar --seeds FILE [--category NAME] [--limit N]

Exit 0: done, without errors found; 1: errors or drift found, or nothing to do; 2: it couldn't run.
"""

from __future__ import annotations

import argparse
import sys
from functools import partial
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.operators import engine, records, rules
from covenant.plans import live
from covenant.plans.config import Config, load_config, resolved
from covenant.plans.pipeline import Pipeline
from covenant.sinks import reports
from covenant.sources import catalogs, files

FORMATS = ("text", "sarif", "evidence", "contracts", "typescript")


def tables(spark: SparkSession, args: argparse.Namespace, config: Config) -> dict[str, DataFrame]:
    """What the mode and the arguments name: a snapshot's schema, manual contracts, a model's entities, statements, sources."""
    out: dict[str, DataFrame] = {}
    schema = args.schema or config.snapshot_file_path
    if config.ground_truth_mode == "Snapshot" and schema:
        out["columns"] = files.snapshot_columns(spark, schema)
        out["schema"] = files.baseline_info(spark, schema)
    if config.ground_truth_mode == "Full" and (config.connection_string or "").startswith("jdbc:"):
        read = partial(catalogs.table, spark, config.connection_string)
        out["columns"] = live.columns(config.provider, read, config.default_schema)
        out["procedure_parameters"] = live.parameters(config.provider, read, config.default_schema, config.default_package)
    if config.ground_truth_mode == "Manual" and config.manual_contract_path:
        properties, parameters = files.manual_contracts(spark, config.manual_contract_path)
        out["properties"], out["manual_parameters"] = _as_rules(properties), parameters
    if args.entities:
        out["properties"] = _as_rules(files.model_properties(spark, args.entities, config.excluded_entities))
    if args.sql:
        out["statements"] = files.statements(spark, args.sql)
    if args.sources:
        out["sources"] = files.texts(spark, args.sources).select(F.col("path").alias("target"), F.col("text").alias("source"))
    return out


def _as_rules(properties: DataFrame) -> DataFrame:
    """Properties as the rules take them; the contract is the entity."""
    have = properties.columns
    pick = lambda c, other: F.col(c) if c in have else other
    return properties.select(
        F.xxhash64("entity", "ord").alias("property_id"),
        F.col("entity").alias("contract_id"),
        F.col("ord").cast("long").alias("ord"),
        "entity",
        "name",
        "column_name",
        pick("table_name", F.col("entity")).alias("table_name"),
        pick("clr_type", pick("data_type", F.lit("string"))).alias("clr_type"),
        "max_length",
        pick("is_required", ~pick("is_nullable", F.lit(True))).alias("is_required"),
        pick("is_nullable", ~pick("is_required", F.lit(False))).alias("is_nullable"),
    )


def validate(spark: SparkSession, args: argparse.Namespace, config: Config) -> int:
    found_tables = tables(spark, args, config)
    if args.format == "contracts" and args.output:
        parameters = found_tables.get("procedure_parameters", found_tables.get("manual_parameters"))
        reports.write_contracts(args.output, config.provider or "oracle", found_tables.get("properties"), parameters, found_tables.get("columns"))
        return 0
    if args.format in ("contracts", "typescript"):
        make, column = (reports.contract_export, "json") if args.format == "contracts" else (reports.typescript, "source")
        _write(args.output, [r[column] for r in make(found_tables["properties"]).orderBy("entity").toLocalIterator()])
        return 0
    pipeline = Pipeline(found_tables).for_provider(config.provider or "oracle")
    if args.sources:
        pipeline = pipeline.with_rules("DG001")
    baseline = args.baseline or config.baseline_file_path
    if baseline and args.command == "validate" and config.enable_baseline:
        pipeline = pipeline.with_baseline(files.baseline_findings(spark, baseline))
    plan = pipeline.validate()
    found = plan.withColumn("ord", F.xxhash64(F.col("contract_id").cast("string"), "rule_id", "message")).cache()
    if args.command == "baseline":
        made = spark.sql("SELECT string(current_timestamp())").first()[0]
        reports.write_baseline(found, baseline, config.ground_truth_mode, made, found_tables.get("columns"))
        return 0
    shown = engine.capped(found, config.max_violation_queue_size)
    if args.format == "sarif":
        reports.write_sarif(shown, args.output)
    elif args.format == "evidence":
        reports.write_evidence(shown, args.output, config.provider or "oracle")
    else:
        _write(args.output, reports.lines(reports.console_lines(shown)))
    return int(engine.rollup(found).first().has_errors)


def _write(path: str | None, lines) -> None:
    if path:
        Path(path).write_text("\n".join(lines) + "\n")
    else:
        for line in lines:
            print(line)


def snapshot(spark: SparkSession, args: argparse.Namespace, config: Config) -> int:
    path = args.snapshot or config.snapshot_file_path
    if args.action == "refresh":
        columns = files.snapshot_columns(spark, args.schema)
        info = files.baseline_info(spark, args.schema).first()
        made = spark.sql("SELECT string(current_timestamp())").first()[0]
        none = spark.createDataFrame([], "rule_id string, message string, severity string")
        reports.write_baseline(none, path, "Snapshot", made, columns, database_version=info.database_version, semantics=info.length_semantics)
        return 0
    if not path or not Path(path).exists():
        print(f"Snapshot file not found: {path}", file=sys.stderr)
        return 1
    info, columns = files.baseline_info(spark, path).first(), files.snapshot_columns(spark, path)
    if args.action == "show":
        total = engine.schema_totals(columns).first()
        print(f"version {info.version}, created {info.created_at}, database {info.database_version}, hash {info.schema_hash}, {total.tables} tables, {total.columns} columns")
        return 0
    # What is stored must still have its hash, and the schema of now (where one is given) must have it too.
    stored = engine.schema_hash(columns).first()[0]
    now = engine.schema_hash(files.snapshot_columns(spark, args.schema)).first()[0] if args.schema else stored
    if info.schema_hash == stored == now:
        print("No differences detected - schema matches snapshot")
        return 0
    print(f"Schema differences detected:\n  Snapshot hash: {info.schema_hash}\n  Current hash:  {now if info.schema_hash == stored else stored}")
    if args.schema:
        for row in engine.drift(columns, files.snapshot_columns(spark, args.schema)).orderBy("table_name", "column_name").toLocalIterator():
            print(f"  {row.change}: {row.table_name}.{row.column_name}")
    return int(args.fail_on_drift)


def radar(spark: SparkSession, args: argparse.Namespace) -> int:
    seeds = records.filled(files.seed_repos(spark, args.seeds, args.category), args.limit)
    metrics = ("dependents", "maintainers", "stale", "days", "vulnerabilities", "has_mcp")
    scored = seeds.withColumn("score", records.eci(*map(F.col, metrics))).withColumn("tier", records.eci_tier(F.col("score")))
    told = scored.withColumn("diagnosis", records.diagnosis(*(F.col(c) for c in metrics if c != "days")))
    _write(args.output, reports.lines(records.radar_lines(records.ranked(told, args.limit))))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="covenant", description="Checks SQL statements and entities against a schema.")
    parser.add_argument("command", choices=["validate", "baseline", "snapshot", "oracle-check", "migrate", "radar"])
    parser.add_argument("action", nargs="?", choices=["show", "refresh", "diff"])
    for name in ("config", "sql", "schema", "entities", "sources", "baseline", "snapshot", "output", "seeds", "category"):
        parser.add_argument(f"--{name}")
    parser.add_argument("--provider", choices=["oracle", "mysql", "postgresql", "sqlserver"])
    parser.add_argument("--format", default="text", choices=FORMATS)
    parser.add_argument("--limit", type=int, default=10)
    parser.add_argument("--fail-on-drift", action="store_true")
    args = parser.parse_args(argv)
    spark = SparkSession.builder.appName("covenant").getOrCreate()
    try:
        config = resolved(load_config(args.config), ".")
        config = Config(**{**config.__dict__, "provider": args.provider or config.provider})
        if args.command == "snapshot":
            return snapshot(spark, args, config)
        if args.command == "migrate":
            done = reports.migrate_baseline(spark, args.baseline)
            print("migrated" if done else "nothing to migrate")
            return int(not done)
        if args.command == "radar":
            return radar(spark, args)
        if args.command == "oracle-check":
            found = rules.schema_unmapped_types(files.snapshot_columns(spark, args.schema))
            _write(args.output, reports.lines(reports.console_lines(found)))
            return 0
        return validate(spark, args, config)
    except Exception as e:  # whatever stops it, the caller sees exit code 2
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
