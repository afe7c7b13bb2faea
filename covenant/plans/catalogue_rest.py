"""Queries of the smaller predicates, functions, records and sources, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from covenant.functions import constants as C
from covenant.functions import text
from covenant.operators import engine, records, rules
from covenant.plans.catalogue import _ECI, _finding, _lit, _word, query
from covenant.sources import catalogs, files, protocols

# ---------------------------------------------------------------- predicates

query(
    "dg012_provider_mismatch",
    _finding("DG012", "concat('Oracle context detected but provider is ''', provider, '''. Expected Oracle provider.')", "FROM $contexts WHERE is_oracle AND NOT contains(lower(provider), 'oracle')"),
    "contexts",
)(rules.provider_mismatch)
query(
    "dg014_whole_schema",
    (
        "WITH one AS (SELECT string_agg(concat_ws(' ', data_type, column_name), ' ') AS t FROM (SELECT data_type, column_name FROM "
        "$columns UNION ALL SELECT 'MONEY', 'x' UNION ALL SELECT 'money', 'y')) "
    )
    + " UNION ALL ".join((
        f"SELECT '' AS contract_id, 'DG014' AS rule_id, 'Warning' AS severity, "
        f"{_lit(f'''Type '{t}' used with Oracle EF Core raw SQL but not mapped by provider''')} AS message FROM one WHERE "
        f"{_word(t).replace('sql_text', 't')}"
    ) for t in C.UNMAPPED_TYPES),
    "columns",
)(lambda c: rules.schema_unmapped_types(c.select("data_type", "column_name").unionAll(c.sparkSession.createDataFrame([("MONEY", "x"), ("money", "y")], "data_type string, column_name string"))))
query(
    "dg002_exec_prefix",
    (
        r"SELECT contract_id, 'DG002' AS rule_id, 'Warning' AS severity, 'Stored procedure call must start with EXEC or EXECUTE' AS message "
        r"FROM $statements WHERE regexp_matches(sql_text, '(?i)^\s+(exec|execute) ')"
    ),
    "statements",
)(rules.procedure_prefix)
_SITES = """(SELECT target, CASE CAST(target % 8 AS INT) WHEN 0 THEN 'FromSqlRaw' WHEN 1 THEN 'Query' WHEN 2 THEN 'ExecuteScalar' WHEN 4 THEN 'ExecuteSqlInterpolated' WHEN 5 THEN 'QueryFirst' END AS method FROM $calls WHERE target % 8 IN (0, 1, 2, 4, 5))"""
query("dg001_call_sites", (
    f"SELECT target AS contract_id, 'DG001' AS rule_id, 'Warning' AS severity, concat('SQL call ''', method, ''' not validated - run "
    f"''covenant validate'' for full validation') AS message FROM {_SITES}"
), "calls")(rules.unvalidated_calls)
query("file_hygiene", "SELECT path, 'sensitive' AS problem FROM $files WHERE " + " OR ".join(f"regexp_matches(path, {_lit(p)})" for p in rules.SENSITIVE_NAMES) + " UNION ALL SELECT path, 'large' FROM $files WHERE size > 100 * 1024 * 1024", "files")(rules.file_hygiene)
query(
    "allowed_endpoints",
    "SELECT id, CASE CAST(id % 9 AS INT) WHEN 0 THEN true WHEN 2 THEN true WHEN 3 THEN true ELSE false END AS allowed FROM $endpoints",
    "endpoints",
)(lambda e: e.select("id", text.allowed_endpoint(F.col("url")).alias("allowed")))
query(
    "trusted_dependencies",
    "SELECT id, " + " OR ".join(f"starts_with(lower(name), {_lit(p.lower())})" for p in C.TRUSTED_PREFIXES) + " AS trusted FROM $dependencies",
    "dependencies",
)(lambda d: d.select("id", text.trusted(F.col("name")).alias("trusted")))
query("supply_chain_summary", (
    "SELECT bool_and(passed) AS overall_passed, CAST(count_if(NOT passed) AS BIGINT) AS failed, concat(CAST(count_if(NOT passed) AS "
    "VARCHAR), ' of ', CAST(count(*) AS VARCHAR), ' checks failed') AS summary FROM $checks"
), "checks")(engine.all_passed)
query(
    "category_aliases",
    (
        "SELECT target AS id, CASE CAST(target % 9 AS INT) WHEN 0 THEN 'CFfi' WHEN 1 THEN 'Geospatial' WHEN 2 THEN 'Geospatial' WHEN 3 "
        "THEN 'BioMl' WHEN 4 THEN 'McpConnectors' WHEN 5 THEN 'TypingInfrastructure' WHEN 6 THEN 'HardwareEdge' ELSE 'GeneralNiche' END AS "
        "category FROM $calls"
    ),
    "calls",
)(lambda c: c.select(F.col("target").alias("id"), text.category(F.element_at(F.array(*map(F.lit, ("FFI", "geo", "Raster", "bio", "mcp-connectors", "typing", "edge", "other", ""))), (F.col("target") % 9 + 1).cast("int"))).alias("category")))
query(
    "identifier_guard",
    (
        "SELECT id, regexp_full_match(name, '[A-Za-z_][A-Za-z0-9_$#]*') AS valid, concat('[', replace(name, ']', ']]'), ']') AS quoted "
        "FROM (SELECT id, concat(name, CASE CAST(id % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN ']' WHEN 2 THEN concat(chr(36), '1') ELSE ';' "
        "END) AS name FROM (SELECT id, replace(replace(name, '#', '_'), '.', '_') AS name FROM $dependencies))"
    ),
    "dependencies",
)(
    lambda d: d.select("id", F.concat(F.replace(F.replace("name", F.lit("#"), F.lit("_")), F.lit("."), F.lit("_")), F.element_at(F.array(*map(F.lit, ("", "]", "$1", ";"))), (F.col("id") % 4 + 1).cast("int"))).alias("name")).select(
        "id", text.valid_identifier(F.col("name")).alias("valid"), text.quoted(F.col("name")).alias("quoted")
    )
)

# ---------------------------------------------------------------- functions

query(
    "version_compatible",
    "SELECT id, CASE CAST(id % 7 AS INT) WHEN 1 THEN false WHEN 3 THEN true ELSE true END AS compatible FROM $versions",
    "versions",
)(lambda v: v.select("id", text.version_at_least(F.lit("1.10"), F.when(F.col("least") == "1.10.0", "1.10").otherwise(F.col("least"))).alias("compatible")))
query("days_since_push", (
    "SELECT repo, stars, stale, days FROM (SELECT s_name AS repo, CASE s_suppkey % 4 WHEN 0 THEN s_suppkey WHEN 2 THEN 5 ELSE 0 END AS "
    "stars, CASE s_suppkey % 4 WHEN 0 THEN 7 WHEN 1 THEN 3 ELSE 0 END AS stale, CASE s_suppkey % 4 WHEN 0 THEN 86 WHEN 1 THEN 0 ELSE "
    "30 END AS days FROM supplier)"
), "payloads")(lambda p: records.repo_metrics(p, F.to_timestamp(F.lit("2024-03-31T12:00:00Z"))))
query("token_estimate", (
    "SELECT doc_id, CAST(floor(octet_length(encode(prompt)) / 4) AS BIGINT) AS prompt_tokens, CAST(384 AS BIGINT) AS "
    "completion_tokens, CAST(1000 AS BIGINT) AS thinking_tokens, CAST(floor(octet_length(encode(prompt)) / 4) + 1384 AS BIGINT) AS "
    "total_tokens FROM $prompts"
), "prompts")(
    lambda p: p.select("doc_id", text.token_estimate(F.col("prompt"), 1000).alias("t")).select("doc_id", "t.*")
)
query("location_base", "SELECT ord, ord % 50 + 1 AS shown, greatest(ord % 50 - 1, 0) AS back FROM $findings", "findings")(lambda f: f.select("ord", text.one_based(F.col("ord") % 50).alias("shown"), text.zero_based(F.col("ord") % 50).alias("back")))
query("schema_totals", "SELECT count(DISTINCT table_name) AS tables, count(*) AS columns FROM $snapshot", "snapshot")(engine.schema_totals)
query("legacy_hash", "SELECT substr(upper(sha256(string_agg(concat(rule_id, ':', message), '|' ORDER BY rule_id, message))), 1, 16) AS finding_hash FROM $baseline", "baseline")(engine.finding_hash)
query("infer_parameter_type", (
    "SELECT contract_id, ord, CASE WHEN l IS NULL THEN CASE WHEN n THEN 'NVARCHAR2(2000)' ELSE 'VARCHAR2(2000)' END WHEN l > 4000 THEN "
    "CASE WHEN n THEN 'NCLOB' ELSE 'CLOB' END ELSE concat(CASE WHEN n THEN 'NVARCHAR2(' ELSE 'VARCHAR2(' END, CAST(l AS VARCHAR), ')') "
    "END AS inferred FROM (SELECT contract_id, ord, starts_with(upper(data_type), 'N') AS n, CASE WHEN ord % 3 = 0 THEN NULL ELSE "
    "contract_id END AS l FROM $parameters)"
), "parameters")(
    lambda p: p.select("contract_id", "ord", rules.inferred_type(F.upper("data_type").startswith("N"), F.when(F.col("ord") % 3 != 0, F.col("contract_id"))).alias("inferred"))
)

# ---------------------------------------------------------------- radar

_RESEARCH = _ECI.replace("2.5::DOUBLE, 10.0", "2.0::DOUBLE, 10.0").replace("* 3.0::DOUBLE", "* 2.5::DOUBLE")
_SCORE = lambda r, model: records.eci(*(F.col(c) for c in ("dependents", "maintainers", "stale", "days", "vulnerabilities", "has_mcp")), model)
query("research_ranking", (
    f"SELECT repo, score, CASE WHEN score >= 75 THEN 'TIER_1_CRITICAL_EMERGENCY' WHEN score >= 50 THEN 'TIER_2_HIGH_URGENCY' WHEN score "
    f">= 30 THEN 'TIER_3_MODERATE' ELSE 'TIER_4_STABLE' END AS tier, row_number() OVER (ORDER BY score DESC, repo) AS place FROM "
    f"(SELECT repo, {_RESEARCH} AS score FROM $repos)"
), "repos")(
    lambda r: engine.numbered(r.select("repo", _SCORE(r, "research").alias("score")).withColumn("less", -F.col("score")), "less", "repo").select("repo", "score", records.tier_name(records.eci_tier(F.col("score"), "research")).alias("tier"), "place")
)
query(
    "eci_action",
    (
        "SELECT repo, CASE WHEN score >= 70 THEN 'Trigger autonomous Claude 3.7 Triage Swarm & Generate High-Priority Patch PR.' WHEN "
        "score >= 45 AND NOT has_mcp THEN 'Deploy FastMCP Bridge Builder to generate standardized AI connector.' WHEN score >= 45 THEN "
        "'Run TriageAgent to deconstruct stale bug threads.' WHEN score >= 25 THEN 'Monitor weekly on telemetry radar.' ELSE 'Routine "
        "periodic indexing.' END AS action FROM (SELECT repo, has_mcp, "
    ) + _ECI + " AS score FROM $repos)",
    "repos",
)(lambda r: r.select("repo", records.action(records.eci_tier(_SCORE(r, "radar")), F.col("has_mcp")).alias("action")))
query("synthetic_fill", (
    "SELECT repo, dependents FROM $repos UNION ALL SELECT concat('synthetic-', CAST(i AS VARCHAR)), 650 * i FROM range(1, 100000) t(i) "
    "WHERE i <= 3000 - (SELECT count(*) FROM $repos)"
), "repos")(lambda r: records.filled(r.select("repo", "dependents"), 3000).select("repo", "dependents"))
query("radar_lines", (
    f"SELECT printf('%-40s %6.2f  %-26s %s', repo, score, CASE WHEN score >= 70 THEN 'TIER_1_CRITICAL_EMERGENCY' WHEN score >= 45 THEN "
    f"'TIER_2_HIGH_URGENCY' WHEN score >= 25 THEN 'TIER_3_MODERATE' ELSE 'TIER_4_STABLE' END, 'x') AS value FROM (SELECT repo, {_ECI} "
    f"AS score FROM $repos)"
), "repos")(
    lambda r: records.radar_lines(r.select("repo", _SCORE(r, "radar").alias("score")).withColumn("tier", records.eci_tier(F.col("score"))).withColumn("diagnosis", F.lit("x")))
)

# ---------------------------------------------------------------- records

query("audit_configuration_change", (
    "SELECT event_id, 'ConfigurationChange' AS event_type, concat('Setting: ', setting, ', Old: ', CASE WHEN old IS NULL OR old = '' "
    "THEN '<empty>' WHEN length(old) <= 8 THEN '****' ELSE concat(left(old, 4), '****', right(old, 4)) END, ', New: ', CASE WHEN new "
    "IS NULL OR new = '' THEN '<empty>' WHEN length(new) <= 8 THEN '****' ELSE concat(left(new, 4), '****', right(new, 4)) END) AS "
    "details, true AS success FROM $changes"
), "changes")(
    lambda c: records.configuration_change(c.withColumn("ts", F.struct("event_id"))).select("ts.event_id", "event_type", "details", "success")
)
query("audit_database_operation", (
    "SELECT 'DatabaseOperation' AS event_type, setting AS operation, upper(sha256(coalesce(old, ''))) AS connection_hash, count(*) AS "
    "n FROM $changes GROUP BY ALL"
), "changes")(
    lambda c: records.database_operation(c.select("ts", F.col("setting").alias("operation"), F.lit("oracle").alias("provider"), F.coalesce("old", F.lit("")).alias("connection"), F.col("new").alias("details"), F.lit(True).alias("success"), F.lit(None).cast("string").alias("error"))).groupBy("event_type", "operation", "connection_hash").agg(F.count("*").alias("n"))
)
query("audit_credential_access", "SELECT setting AS operation, concat('Credential access: ', setting) AS details, count(*) AS n FROM $changes GROUP BY ALL", "changes")(
    lambda c: records.credential_access(c.select("ts", F.col("setting").alias("operation"), F.lit("oracle").alias("provider"), F.lit("c").alias("connection"))).groupBy("operation", "details").agg(F.count("*").alias("n"))
)
query("rule_execution_metrics", (
    "WITH t AS (SELECT concat('rule=', rule_id, ',success=', CASE WHEN success THEN 'True' ELSE 'False' END) AS tags, milliseconds "
    "FROM $runs) SELECT 'rule.executions' AS name, tags, round(count(*) * 1.0::DOUBLE, 4) AS value FROM t GROUP BY tags UNION ALL "
    "SELECT 'rule.duration', tags, round(sum(milliseconds), 4) FROM t GROUP BY tags"
), "runs")(
    lambda r: records.rule_executions(r).groupBy("name", "tags").agg(F.round(F.sum("value"), 4).alias("value"))
)
query("validation_metrics", (
    "SELECT name, value FROM (SELECT unnest(['validations.total', 'violations.total', 'violations.errors', 'violations.warnings', "
    "'validation.contracts', 'validation.duration']) AS name, unnest([1, count(*), count_if(severity = 'Error'), count_if(severity = "
    "'Warning'), 1000, 2]) * 1.0::DOUBLE AS value FROM $findings)"
), "findings")(lambda f: records.validation_summary(f, 1000, 2.0).select("name", "value"))

# ---------------------------------------------------------------- sources

query("describe_result_sets", (
    "SELECT procedure_name, string_agg(concat(name, ' ', system_type_name), ', ' ORDER BY ordinal) AS columns, count(*) AS n FROM "
    "$described WHERE error_number IS NULL GROUP BY procedure_name"
), "described")(
    lambda d: catalogs.result_columns(d).groupBy("procedure_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.concat_ws(" ", "name", "data_type").alias("t")))), lambda x: x["t"]), ", ").alias("columns"), F.count("*").alias("n"))
)
query("procedure_names", "SELECT DISTINCT object_name FROM $catalogue_arguments WHERE upper(owner) = 'APP' AND upper(package_name) = 'PKG'", "catalogue_arguments")(lambda a: catalogs.procedure_names(a, "app", "pkg"))
query(
    "oracle_arguments",
    (
        "SELECT package_name, object_name, argument_name AS name, coalesce(nullif(concat_ws('.', nullif(type_owner, ''), nullif(type_name, "
        "''), nullif(type_subname, '')), ''), data_type) AS data_type, CASE in_out WHEN 'OUT' THEN 'Output' WHEN 'IN/OUT' THEN "
        "'InputOutput' ELSE 'Input' END AS direction, data_length, position, sequence, CAST(coalesce(subprogram_id, TRY_CAST(overload AS "
        "INT), 0) AS BIGINT) AS overload_key FROM $catalogue_arguments WHERE upper(owner) = 'APP' AND position > 0 AND argument_name IS "
        "NOT NULL"
    ),
    "catalogue_arguments",
)(lambda a: catalogs.oracle_arguments(a, "app").withColumn("overload_key", F.col("overload_key").cast("long")))
query("rpc_requests", (
    "SELECT seq, CASE CAST(seq % 6 AS INT) WHEN 0 THEN 'tools/list' WHEN 1 THEN 'initialize' WHEN 4 THEN 'no/such' ELSE "
    "'notifications/initialized' END AS method, CASE WHEN seq % 6 = 5 THEN NULL ELSE CAST(seq AS VARCHAR) END AS id FROM $requests "
    "WHERE seq % 6 IN (0, 1, 4, 5)"
), "requests")(lambda r: protocols.requests(r).select("seq", "method", "id"))
query("rpc_responses", "SELECT seq, CASE CAST(seq % 6 AS INT) WHEN 4 THEN -32601 ELSE NULL END AS code FROM $requests WHERE seq % 6 IN (0, 1, 4)", "requests")(lambda r: protocols.responses(protocols.requests(r)).select("seq", F.get_json_object("value", "$.error.code").cast("int").alias("code")))
query("usage_scan", "SELECT target, source LIKE '%.Query%' AS mapper, source LIKE '%FromSqlRaw%' OR source LIKE '%ExecuteSql%' AS orm FROM $calls", "calls")(lambda c: files.usage(c.withColumnRenamed("target", "path").withColumnRenamed("source", "text"), ("FromSqlRaw", "ExecuteSql"), (".Query",)).select(F.col("path").alias("target"), "mapper", "orm"))
query("console_place", (
    "SELECT concat('[', upper(severity), '] ', rule_id, ': ', message, ' (', CAST(ord % 90 + 1 AS VARCHAR), ':', CAST(contract_id % 7 "
    "+ 1 AS VARCHAR), ')') AS value FROM $findings"
), "findings")(
    lambda f: __import__("covenant.sinks.reports", fromlist=["x"]).console_lines(f.withColumn("location", F.struct(F.lit("a.sql").alias("path"), (F.col("ord") % 90).alias("start_line"), (F.col("contract_id") % 7).alias("start_column"), F.lit(0).cast("long").alias("end_line"), F.lit(0).cast("long").alias("end_column"))))
)
