"""Every registered query of the contract engine and the SQL that checks it."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.functions import constants as C
from covenant.functions import sqltext, text
from covenant.operators import engine, graph, records, rules
from covenant.plans.views import VIEWS, duck, view

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def _sql(body: str) -> str:
    """``body`` behind the views that it names as ``$view``."""
    used = [v for v in VIEWS if re.search(rf"\$\b{v}\b", body)]
    with_ = ", ".join(f"{v} AS ({duck(v)})" for v in used)
    body = re.sub(r"\$(\w+)", r"\1", body)
    if body.startswith("WITH RECURSIVE ") and with_:
        return f"WITH RECURSIVE {with_}, " + body.removeprefix("WITH RECURSIVE ")
    if re.match(r"\s*WITH ", body) and with_:
        return f"WITH {with_}, " + re.sub(r"^\s*WITH ", "", body)
    return (f"WITH {with_} " if with_ else "") + body


def query(name: str, sql: str | None, *inputs: str):
    """Registers a plan over the named views under ``name``."""

    def register(plan):
        _QUERIES[name] = lambda spark, sf_dir: plan(*(view(spark, sf_dir, v) for v in inputs))
        if sql:
            _SQL[name] = _sql(sql)
        return plan

    return register


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _finding(rule: str, message: str, rest: str) -> str:
    return f"SELECT contract_id, '{rule}' AS rule_id, '{C.RULES[rule][0]}' AS severity, {message} AS message {rest}"


def _words(rule: str, tests: list[tuple[str, str]]) -> str:
    return " UNION ALL ".join(_finding(rule, _lit(m), f"FROM $statements WHERE {t}") for t, m in tests)


def _word(w: str) -> str:
    return f"regexp_matches(sql_text, {_lit(text.word_pattern(w))})"


def _has(w: str, column: str = "sql_text") -> str:
    return f"contains(upper({column}), {_lit(w.upper())})"


# ---------------------------------------------------------------- rules

# What .NET counts as a letter of a word; RE2's own \w is ASCII's.
_W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"


def _unicode(pattern: str) -> str:
    """A pattern of the engine for RE2, which has no flag for Unicode's classes."""
    return pattern.replace("[\\w]", _W).replace("\\w", _W).replace("U)", ")", 1)


query("dg101_exec_no_params", _finding("DG101", "'Stored procedure call appears to have no parameters detected'", rf"FROM $statements WHERE regexp_matches(sql_text, '(?i)^\s*(exec|execute) ') AND NOT regexp_matches(sql_text, '@{_W}+')"), "statements")(rules.call_without_parameters)


def _type_rows(table: dict, oracle: bool) -> str:
    return ", ".join(f"({str(oracle).lower()}, {_lit(k)}, {_lit(t.upper())})" for k, v in table.items() for t in v)


query(
    "dg002_type_mismatch",
    "WITH types AS (SELECT * FROM (VALUES " + _type_rows(C.ORACLE_TYPES, True) + ", " + _type_rows(C.SQLSERVER_TYPES, False) + (
        ") AS t(o, clr, db)), p AS (SELECT *, bool_or(contains(upper(data_type), 'NUMBER')) OVER (PARTITION BY contract_id) AS o, "
        "list_filter(regexp_split_to_array(upper(data_type), '[() \t,]+'), lambda x: x <> '') AS tokens, regexp_replace(upper(data_type), "
        "'\\s', '', 'g') AS whole FROM $parameters) "
    )
    + _finding("DG002", "concat('Parameter ''', name, ''' has CLR type ''', clr_type, ''' but database type ''', data_type, ''' is not compatible')", (
        "FROM p WHERE clr_type <> '' AND NOT EXISTS (SELECT 1 FROM types t WHERE t.o = p.o AND t.clr = p.clr_type AND "
        "(list_contains(p.tokens, t.db) OR regexp_replace(t.db, '\\s', '', 'g') = p.whole))"
    )),
    "parameters",
)(rules.parameter_types)
query("dg003_direction", _finding("DG003", "concat('Parameter ''', name, ''' is ', direction, ' but call site passes it as ', call_site, ' (out/ref required)')", "FROM $parameters WHERE direction <> 'Input' AND call_site = 'Input'"), "parameters")(rules.parameter_directions)
query("custom001_prefix", _finding("CUSTOM001", "concat('Parameter ''', name, ''' in legacy schema procedure ''', procedure_name, ''' should start with ''P_''')", "FROM $parameters WHERE starts_with(upper(schema_name), 'LEGACY_') AND NOT starts_with(upper(name), 'P_')"), "parameters")(rules.legacy_prefix)
query(
    "dg004_missing_columns",
    (
        "WITH k AS (SELECT p.contract_id, p.ord, p.name FROM $properties p WHERE EXISTS (SELECT 1 FROM $shapes s WHERE s.contract_id = "
        "p.contract_id) AND NOT EXISTS (SELECT 1 FROM $shapes s WHERE s.contract_id = p.contract_id AND s.column_name IN "
        "(lower(p.column_name), lower(p.name)))), g AS (SELECT contract_id, list_aggregate(list_slice(list(name ORDER BY ord), 1, 5), "
        "'string_agg', ', ') AS names FROM k GROUP BY contract_id) "
    )
    + _finding("DG004", "concat('Result set is missing required columns: ', names)", "FROM g"),
    "properties",
    "shapes",
)(rules.missing_columns)
query(
    "dg004_extra_columns",
    (
        "WITH n AS (SELECT contract_id, lower(name) AS c FROM $properties UNION SELECT contract_id, lower(column_name) FROM $properties), "
        "k AS (SELECT contract_id, count(*) AS known FROM n GROUP BY 1), x AS (SELECT s.contract_id, count(*) AS n FROM $shapes s WHERE "
        "NOT EXISTS (SELECT 1 FROM n WHERE n.contract_id = s.contract_id AND n.c = s.column_name) GROUP BY 1) "
    )
    + _finding("DG004", "concat('Result set has ', CAST(n AS VARCHAR), ' extra columns not mapped to entity properties')", "FROM x JOIN k USING (contract_id) WHERE n > known // 2"),
    "properties",
    "shapes",
)(rules.extra_columns)
query("last_wins_map", "SELECT upper(column_name) AS column_key, arg_max(is_nullable, table_ord * 1000 + col_ord) AS is_nullable FROM $columns GROUP BY 1", "columns")(rules.last_columns)
query(
    "dg005_nullability",
    "WITH m AS (SELECT upper(column_name) AS k, arg_max(is_nullable, table_ord * 1000 + col_ord) AS z FROM $columns GROUP BY 1) "
    + _finding("DG005", (
        "CASE WHEN is_required THEN concat('Property ''', name, ''' is required but database column ''', column_name, ''' allows NULL') "
        "ELSE concat('Property ''', name, ''' is nullable but database column ''', column_name, ''' is NOT NULL') END"
    ), "FROM $properties JOIN m ON upper(column_name) = k WHERE is_required = z"),
    "properties",
    "columns",
)(rules.nullability)
_SNAKE = "lower(concat(substr(name, 1, 1), regexp_replace(substr(name, 2), '([A-Z])', '_\\1', 'g')))"
_PASCAL = (
    "coalesce(list_aggregate(list_transform(list_filter(regexp_split_to_array(name, '[_\\-.]'), lambda x: x <> ''), lambda x: "
    "concat(upper(x[1:1]), lower(x[2:]))), 'string_agg', ''), '')"
)
query("dg006_naming", _finding("DG006", (
    f"concat('Property ''', name, ''' (PascalCase: ''', {_PASCAL}, ''', snake_case: ''', {_SNAKE}, ''') doesn''t match database column "
    f"''', column_name, '''')"
), f"FROM $properties WHERE column_name <> '' AND lower(column_name) <> {_SNAKE} AND lower(column_name) <> lower({_PASCAL})"), "properties")(rules.naming)
# From the rule's definition: the first table of the entity's name, then that table's first column of either name.
_OF_TABLE = (
    "WITH own AS (SELECT p.*, (SELECT min(c.table_ord) FROM $columns c WHERE upper(c.table_name) = upper(p.table_name)) AS t FROM "
    "$properties p WHERE p.table_name <> ''), "
)
_KEPT = (
    "own.*, c.column_name AS db_column, c.data_type, c.max_length AS db_max, c.char_length, c.char_used, row_number() OVER (PARTITION "
    "BY property_id ORDER BY c.col_ord) AS r"
)
_MATCHED = _OF_TABLE + (
    f"matched AS (SELECT * FROM (SELECT {_KEPT} FROM own JOIN $columns c ON c.table_ord = own.t AND (upper(c.column_name) = "
    f"upper(own.column_name) OR upper(c.column_name) = upper({_SNAKE.replace('name', 'own.name')}))) WHERE r = 1) "
)
_NAMED = _OF_TABLE + (
    f"matched AS (SELECT * FROM (SELECT {_KEPT} FROM own JOIN $columns c ON c.table_ord = own.t AND upper(c.column_name) = "
    f"upper(own.column_name)) WHERE r = 1) "
)


def _long(limit: str) -> str:
    return (
        f"concat('Entity property ''', name, ''' MaxLength=', CAST(max_length AS VARCHAR), ' exceeds column ''', db_column, ''' length=', "
        f"CAST({limit} AS VARCHAR))"
    )


query("dg007_length", _MATCHED + _finding("DG007", _long("coalesce(char_length, db_max)"), "FROM matched WHERE max_length > coalesce(char_length, db_max)"), "properties", "columns")(lambda p, c: rules.too_long(rules.first_match(p, c)))
for _key, _rule in (("my003_length", "MY003"), ("pg003_length", "PG003")):
    query(_key, _NAMED + _finding(_rule, _long("db_max"), "FROM matched WHERE max_length > db_max"), "properties", "columns")(lambda p, c, rule=_rule: rules.too_long(rules.first_match(p, c, by_property=False), rule))
query("first_match_join", _MATCHED + "SELECT property_id, db_column, data_type FROM matched", "properties", "columns")(lambda p, c: rules.first_match(p, c).select("property_id", "db_column", "data_type"))
query("dg008_byte_overflow", _MATCHED + _finding("DG008", "concat('Byte overflow risk: property ''', name, ''' may exceed column ''', db_column, ''' byte capacity in BYTE semantics')", (
    "FROM matched WHERE (char_used IN ('B', 'BYTE') OR coalesce(char_used, '') = '') AND max_length * CASE WHEN clr_type = 'string' "
    "THEN 4 ELSE 1 END > db_max"
)), "properties", "columns")(lambda p, c: rules.too_many_bytes(rules.first_match(p, c)))
query("dg008_char_session", _MATCHED + _finding("DG008", "concat('Byte overflow risk: property ''', name, ''' may exceed column ''', db_column, ''' byte capacity in CHAR semantics')", "FROM matched WHERE char_used IN ('B', 'BYTE') AND max_length * CASE WHEN clr_type = 'string' THEN 4 ELSE 1 END > db_max"), "properties", "columns")(lambda p, c: rules.too_many_bytes(rules.first_match(p, c), "CHAR"))
query(
    "dg009_inferred_fallback",
    _MATCHED + _finding("DG009", (
        "concat('EF Core will infer NVARCHAR2(2000) for property ''', name, ''' (no MaxLength set, Unicode=true) but Oracle column ''', "
        "db_column, ''' is ', data_type, '. If values exceed 2000 characters, ORA-12899 ''value too large for column'' will occur at "
        "runtime. Consider setting explicit MaxLength or using NCLOB column type.')"
    ), "FROM matched WHERE max_length IS NULL AND clr_type = 'string' AND data_type IN ('CLOB', 'NCLOB')"),
    "properties",
    "columns",
)(lambda p, c: rules.inferred_length(rules.first_match(p, c)))
query("infer_column_type", (
    "WITH p AS (SELECT property_id, clr_type = 'string' AS u, max_length * 12 AS m FROM $properties) SELECT property_id, CASE WHEN m "
    "IS NULL THEN CASE WHEN u THEN 'NVARCHAR2(2000)' ELSE 'VARCHAR2(2000)' END WHEN m > 4000 THEN CASE WHEN u THEN 'NCLOB' ELSE 'CLOB' "
    "END ELSE concat(CASE WHEN u THEN 'NVARCHAR2(' ELSE 'VARCHAR2(' END, CAST(m AS VARCHAR), ')') END AS inferred FROM p"
), "properties")(lambda p: p.select("property_id", rules.inferred_type(F.col("clr_type") == "string", F.col("max_length") * 12).alias("inferred")))

query("dg010_oracle_tokens", _words("DG010", [(_word(k), f"Oracle-specific keyword '{k}' used in non-Oracle context") for k in C.ORACLE_KEYWORDS] + [(_has(o), f"Oracle-specific operator '{o}' used in non-Oracle context") for o in C.ORACLE_OPERATORS]), "statements")(rules.oracle_elsewhere)
query("dg011_sqlserver_tokens", _words("DG011", [(_word(k), f"SQL Server-specific keyword '{k}' used in Oracle context") for k in C.SQLSERVER_KEYWORDS] + [(r"regexp_matches(sql_text, '(?i)(^|[^A-Za-z0-9_])TOP\s+\d+')", "SQL Server TOP clause used in Oracle context (use FETCH FIRST n ROWS ONLY)"), (r"regexp_matches(sql_text, '(?i)(^|[^A-Za-z0-9_])LIMIT\s+\d+')", "LIMIT clause not supported in Oracle, use FETCH FIRST n ROWS ONLY"), (_word("GROUP_CONCAT"), "Non-Oracle function 'GROUP_CONCAT' used in Oracle context - use LISTAGG")]), "statements")(rules.others_in_oracle)
query("dg013_exec_leak", _finding("DG013", "'SQL Server EXEC dbo.Procedure syntax used in Oracle context. Use BEGIN ... END; block or CALL.'", r"FROM $statements WHERE regexp_matches(sql_text, '(?i)(^|[^A-Za-z0-9_])EXEC\s+\w+\.')"), "statements")(rules.exec_in_oracle)
query("dg014_unmapped_types", _words("DG014", [(_word(t), f"Type '{t}' used with Oracle EF Core raw SQL but not mapped by provider") for t in C.UNMAPPED_TYPES]), "statements")(rules.unmapped_types)
for _key, _rule, _list, _text, _plan in (
    ("my001_first_match", "MY001", C.MYSQL_ONLY, ("MySQL-specific syntax '", "' used in non-MySQL context"), rules.mysql_elsewhere),
    ("my002_first_match", "MY002", C.NOT_MYSQL, ("Non-MySQL syntax '", "' used in MySQL context"), rules.others_in_mysql),
    ("pg001_first_match", "PG001", C.POSTGRES_ONLY, ("PostgreSQL-specific syntax '", "' used in non-PostgreSQL context"), rules.postgres_elsewhere),
    ("pg002_first_match", "PG002", C.NOT_POSTGRES, ("Non-PostgreSQL syntax '", "' used in PostgreSQL context"), rules.others_in_postgres),
):
    _case = "CASE " + " ".join(f"WHEN {_has(w)} THEN {_lit(w)}" for w in _list) + " END"
    query(_key, f"WITH f AS (SELECT contract_id, {_case} AS w FROM $statements) " + _finding(_rule, f"concat({_lit(_text[0])}, w, {_lit(_text[1])})", "FROM f WHERE w IS NOT NULL"), "statements")(_plan)

_STOP = "(" + ", ".join(map(_lit, C.ALIAS_STOP_WORDS)) + ")"
_REFS = rf"""refs AS (SELECT contract_id, i - 1 AS ord, upper(list_last(string_split(ts[i], '.'))) AS table_name, CASE WHEN upper(coalesce(al[i], '')) IN {_STOP} THEN '' ELSE upper(coalesce(al[i], '')) END AS alias FROM (SELECT contract_id, regexp_extract_all(sql_text, '{_unicode(sqltext.TABLE_PATTERN)}', 1) AS ts, regexp_extract_all(sql_text, '{_unicode(sqltext.TABLE_PATTERN)}', 2) AS al FROM $statements) x, unnest(range(1, len(ts) + 1)) AS u(i))"""
query("table_references", f"WITH {_REFS} SELECT contract_id, CAST(ord AS INT) AS ord, table_name, alias FROM refs", "statements")(sqltext.table_refs)
_DG015 = (
    f"WITH {_REFS}, ctes AS (SELECT contract_id, upper(unnest(regexp_extract_all(sql_text, '{_unicode(sqltext.CTE_PATTERN)}', 1))) AS n "
    f"FROM $statements) "
) + _finding("DG015", "concat('Table ''', table_name, ''' does not exist in database')", (
    "FROM refs r WHERE NOT EXISTS (SELECT 1 FROM ctes WHERE ctes.contract_id = r.contract_id AND ctes.n = r.table_name) AND table_name "
    "NOT IN (SELECT upper(table_name) FROM $columns)"
))
query("dg015_phantom_table", _DG015, "statements", "columns")(rules.phantom_tables)
_LOST = (
    " AND table_name IN (SELECT upper(table_name) FROM $columns) AND NOT EXISTS (SELECT 1 FROM $columns c WHERE upper(c.table_name) = "
    "x.table_name AND upper(c.column_name) = x.col)"
)
_COLUMN = "concat('Column ''', col, ''' does not exist in table ''', table_name, '''')"
query(
    "dg016_phantom_column",
    (
        f"WITH {_REFS}, keys AS (SELECT contract_id, q, arg_min(table_name, ord) AS table_name FROM (SELECT contract_id, ord, table_name, "
        f"alias AS q FROM refs UNION ALL SELECT contract_id, ord, table_name, table_name FROM refs) WHERE q <> '' GROUP BY 1, 2), used AS "
        f"(SELECT contract_id, upper(qs[i]) AS q, upper(cs[i]) AS col FROM (SELECT contract_id, regexp_extract_all(sql_text, "
        f"'{_unicode(sqltext.QUALIFIED_PATTERN)}', 1) AS qs, regexp_extract_all(sql_text, '{_unicode(sqltext.QUALIFIED_PATTERN)}', 2) AS cs "
        f"FROM $statements) y, unnest(range(1, len(qs) + 1)) AS u(i)), x AS (SELECT used.contract_id, table_name, col FROM used JOIN keys "
        f"USING (contract_id, q)) "
    )
    + _finding("DG016", _COLUMN, "FROM x WHERE true" + _LOST),
    "statements",
    "columns",
)(rules.phantom_qualified)
query(
    "dg016_unqualified",
    (
        f"WITH {_REFS}, parts AS (SELECT contract_id, regexp_replace(unnest(string_split(regexp_extract(sql_text, "
        f"'{_unicode(sqltext.SELECT_PATTERN)}', 1), ',')), '^\\s+|\\s+$', '', 'g') AS part FROM $statements), named AS (SELECT contract_id, "
        f"upper(list_last(list_filter(regexp_split_to_array(regexp_replace(part, '(?is)^.*? AS ', ''), '\\s+'), lambda t: t <> ''))) AS col "
        f"FROM parts WHERE part <> '' AND NOT regexp_matches(part, '[*.(+\\-/]')), x AS (SELECT n.contract_id, r.table_name, n.col FROM "
        f"named n JOIN refs r ON r.contract_id = n.contract_id AND r.ord = 0 WHERE regexp_matches(col, '^[A-Z_]{_W}*$') AND col NOT IN "
        f"{_STOP}) "
    )
    + _finding("DG016", _COLUMN, "FROM x WHERE true" + _LOST),
    "statements",
    "columns",
)(rules.phantom_selected)
query("dg098_missing_from", _finding("DG098", "'Raw SQL query missing FROM clause'", "FROM $statements WHERE contains(lower(sql_text), 'select') AND NOT contains(lower(sql_text), 'from')"), "statements")(rules.select_without_from)
query("dg099_injection", _finding("DG099", "'Potential SQL injection pattern detected'", "FROM $statements WHERE " + " OR ".join(_has(p) for p in C.INJECTION_PATTERNS)), "statements")(rules.injection)
_AUDIT = {
    "command_injection": (
        r"regexp_matches(source, '(subprocess\.run|os\.system|os\.popen|Command::new)[^\n]*shell\s*=\s*True') OR (contains(source, "
        r"'subprocess') AND contains(source, 'shell=True'))"
    ),
    "dynamic_code": r"regexp_matches(source, '(^|[^A-Za-z0-9_])(eval|exec)\s*\(')",
    "request_forgery": (
        r"regexp_matches(source, '(requests\.get|httpx\.get|reqwest::get)\s*\(\s*[a-zA-Z0-9_]+') AND NOT contains(source, 'localhost') AND "
        r"NOT contains(source, 'allowed_domains')"
    ),
    "path_traversal": r"regexp_matches(source, 'open\s*\(\s*[^\n]*(\.\./|os\.path\.join)') AND NOT contains(source, 'canonicalize') AND NOT contains(source, 'resolve')",
}
query("mcp_source_audit", "WITH f AS (SELECT target, " + ", ".join(f"CAST(({v}) AS INT) AS {k}" for k, v in _AUDIT.items()) + (
    r", CAST(greatest(1, len(regexp_extract_all(source, '@mcp\.tool'))) AS INT) AS tools FROM $sources), s AS (SELECT *, greatest(0, "
    r"100 - 40 * command_injection - 40 * dynamic_code - 20 * request_forgery - 10 * path_traversal) AS score FROM f) SELECT target, "
    r"command_injection, dynamic_code, request_forgery, path_traversal, score, score >= 70 AND command_injection + dynamic_code = 0 AS "
    r"is_safe, tools FROM s"
), "sources")(rules.audit_sources)
query("secret_scan", " UNION ALL ".join(f"SELECT target, '{k}' AS kind FROM $sources WHERE regexp_matches(source, {_lit(p)})" for k, p in rules.SECRET_PATTERNS.items()), "sources")(rules.find_secrets)
_KIND = (
    "CASE WHEN m IN ('FromSqlRaw', 'FromSqlInterpolated') THEN 'raw_query' WHEN m IN ('ExecuteSqlRaw', 'ExecuteSqlRawAsync', "
    "'ExecuteSqlInterpolated', 'ExecuteSqlInterpolatedAsync') THEN 'raw_command' WHEN starts_with(m, 'Query') THEN 'query' WHEN "
    "starts_with(m, 'Execute') THEN 'execute' END"
)
_CALLS = (
    "CASE CAST(contract_id % 6 AS INT) WHEN 0 THEN 'FromSqlRaw' WHEN 1 THEN 'ExecuteSqlRawAsync' WHEN 2 THEN 'QueryFirst' WHEN 3 THEN "
    "'ExecuteScalar' WHEN 4 THEN 'Save' ELSE 'FromSqlInterpolated' END"
)
query("call_site_classify", f"SELECT contract_id, {_KIND} AS kind FROM (SELECT contract_id, {_CALLS} AS m FROM $statements)", "statements")(lambda s: s.select("contract_id", F.expr(_CALLS).alias("m")).select("contract_id", rules.call_kind(F.col("m")).alias("kind")))

# ---------------------------------------------------------------- engine

_SEVERITIES = (
    "CAST(count_if(severity = 'Error') AS BIGINT) AS errors, CAST(count_if(severity = 'Warning') AS BIGINT) AS warnings, "
    "CAST(count_if(severity = 'Info') AS BIGINT) AS infos, count(*) AS total"
)
query("severity_rollup", f"SELECT {_SEVERITIES}, coalesce(bool_or(severity = 'Error'), false) AS has_errors FROM $findings", "findings")(engine.rollup)
query("findings_per_contract", "SELECT contract_id, count(*) AS findings, CAST(count_if(severity = 'Error') AS BIGINT) AS errors FROM $findings GROUP BY contract_id", "findings")(engine.per_contract)
query("cross_rules_rollup", f"SELECT {_SEVERITIES}, coalesce(bool_or(severity = 'Error'), false) AS has_errors FROM (" + " UNION ALL ".join((_finding("DG098", "'x'", "FROM $statements WHERE contains(lower(sql_text), 'select') AND NOT contains(lower(sql_text), 'from')"), _finding("DG099", "'x'", "FROM $statements WHERE " + " OR ".join(_has(p) for p in C.INJECTION_PATTERNS)), _words("DG014", [(_word(t), "x") for t in C.UNMAPPED_TYPES]))) + ")", "statements")(lambda s: engine.rollup(engine.united([rules.select_without_from(s), rules.injection(s), rules.unmapped_types(s)])))
query("finding_cap", "SELECT * FROM $findings ORDER BY rule_id, message, contract_id LIMIT 100", "findings")(lambda f: engine.capped(f, 100))
query("baseline_new_only", (
    "SELECT rule_id, message, ord, contract_id, severity FROM $findings f WHERE NOT EXISTS (SELECT 1 FROM $baseline b WHERE b.rule_id "
    "= f.rule_id AND b.message = f.message)"
), "findings", "baseline")(engine.new_findings)
query("finding_hash", (
    "SELECT contract_id, substr(upper(sha256(string_agg(concat(rule_id, ':', message), '|' ORDER BY rule_id, message))), 1, 16) AS "
    "finding_hash FROM $findings GROUP BY contract_id"
), "findings")(lambda f: engine.finding_hash(f, "contract_id"))
_CANON = (
    "concat_ws(',', column_name, data_type, CASE WHEN is_nullable THEN 'True' ELSE 'False' END, coalesce(CAST(max_length AS VARCHAR), "
    "'null'), coalesce(CAST(precision AS VARCHAR), 'null'), coalesce(CAST(scale AS VARCHAR), 'null'))"
)
_TABLE = f"SELECT table_name, concat(table_name, '{{', string_agg({_CANON}, ';' ORDER BY column_name), '}}') AS canonical FROM $snapshot GROUP BY table_name"
query("table_hash", _TABLE, "snapshot")(engine.table_hash)
query("schema_hash", f"SELECT upper(sha256(string_agg(canonical, '|' ORDER BY table_name))) AS schema_hash FROM ({_TABLE})", "snapshot")(engine.schema_hash)
query("schema_drift_diff", (
    "SELECT * FROM (SELECT coalesce(a.table_name, b.table_name) AS table_name, coalesce(a.column_name, b.column_name) AS column_name, "
    "CASE WHEN a.table_name IS NULL THEN 'added' WHEN b.table_name IS NULL THEN 'removed' WHEN a.data_type IS DISTINCT FROM "
    "b.data_type OR a.max_length IS DISTINCT FROM b.max_length OR a.is_nullable IS DISTINCT FROM b.is_nullable THEN 'changed' END AS "
    "change FROM $snapshot a FULL JOIN $later_snapshot b ON a.table_name = b.table_name AND a.column_name = b.column_name) WHERE "
    "change IS NOT NULL"
), "snapshot", "later_snapshot")(engine.drift)
_LEVEL = "CASE severity WHEN 'Error' THEN 'error' WHEN 'Warning' THEN 'warning' WHEN 'Info' THEN 'note' ELSE 'none' END"
_SAFE = "CASE WHEN (starts_with(message, 'eyJ') AND length(message) > 20) OR " + " OR ".join(_has(w, "message") for w in C.SARIF_SENSITIVE) + " THEN '[REDACTED]' ELSE message END"
query("sarif_rules_groupby", (
    f"SELECT rule_id, string_split({_SAFE}, ':')[1] AS name, {_SAFE} AS description, {_LEVEL} AS level FROM (SELECT rule_id, "
    f"arg_min(message, struct_pack(ord, message, severity)) AS message, arg_min(severity, struct_pack(ord, message, severity)) AS "
    f"severity FROM $findings GROUP BY rule_id)"
), "findings")(engine.sarif_rules)
query("sarif_results", f"SELECT ord, rule_id AS rule, {_LEVEL} AS level, CASE WHEN (starts_with(message, 'eyJ') AND length(message) > 20) OR " + " OR ".join(_has(w, "message") for w in C.SARIF_SENSITIVE) + " THEN '[REDACTED]' ELSE message END AS message FROM $findings", "findings")(engine.sarif_results)
query("evidence_order", "WITH s AS (SELECT ord, rule_id, lower(severity) AS severity, CASE WHEN " + " OR ".join(_has(w, "message") for w in C.EVIDENCE_SENSITIVE) + (
    " THEN '[REDACTED]' ELSE message END AS message FROM $findings) SELECT *, row_number() OVER (ORDER BY rule_id, severity, message, "
    "ord) AS place FROM s"
), "findings")(engine.evidence)
query("redact_pairs", (
    r"SELECT target, sha256(regexp_replace(source, '(?i)(password|pwd|token|secret|api[_-]?key)(\s*[=:]\s*)[^\s;,]+', '\1\2[REDACTED]', "
    r"'g')) AS shown FROM $sources"
), "sources")(lambda s: s.select("target", F.sha2(text.redact_pairs(F.col("source")), 256).alias("shown")))
query("mask_value", (
    "SELECT ord, CASE WHEN v IS NULL OR v = '' THEN '<empty>' WHEN length(v) <= 8 THEN '****' ELSE concat(left(v, 4), '****', right(v, "
    "4)) END AS masked FROM (SELECT ord, CASE CAST(ord % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN rule_id ELSE message END AS v FROM "
    "$findings)"
), "findings")(lambda f: f.select("ord", text.mask_value(F.expr("CASE CAST(ord % 3 AS INT) WHEN 0 THEN '' WHEN 1 THEN rule_id ELSE message END")).alias("masked")))
_MAP = [("column", "rule_id"), ("secret_note", "severity"), ("type", "message")]
query("safe_properties", "WITH m AS (SELECT ord, k, v FROM (" + " UNION ALL ".join(f"SELECT ord, '{k}' AS k, {c} AS v FROM $findings" for k, c in _MAP) + ")) SELECT ord, k AS key, v AS value FROM m WHERE k IN ('column', 'type') AND NOT (" + " OR ".join(_has(w, "v") for w in C.SARIF_SENSITIVE) + ")", "findings")(lambda f: f.select("ord", F.explode(engine.safe_properties(F.create_map(*(x for k, c in _MAP for x in (F.lit(k), F.col(c))))))))
query("snake_case", f"SELECT property_id, {_SNAKE} AS snake, upper({_SNAKE}) AS upper_snake FROM $properties", "properties")(lambda p: p.select("property_id", text.snake_case(F.col("name")).alias("snake"), F.upper(text.snake_case(F.col("name"))).alias("upper_snake")))
query("pascal_case", f"SELECT property_id, {_PASCAL.replace('name', 'column_name')} AS pascal FROM $properties", "properties")(lambda p: p.select("property_id", text.pascal_case(F.col("column_name")).alias("pascal")))
query(
    "shape_columns",
    (
        f"WITH c AS (SELECT contract_id, regexp_replace(unnest(string_split(regexp_extract(sql_text, '{_unicode(sqltext.SHAPE_PATTERN)}', "
        f"1), ',')), '^\\s+|\\s+$', '', 'g') AS part FROM $statements), t AS (SELECT contract_id, list_filter(regexp_split_to_array(part, "
        f"'\\s+'), lambda x: x <> '') AS tokens FROM c WHERE part <> '' AND NOT regexp_matches(part, '[*.(+\\-/]')), n AS (SELECT "
        f"contract_id, CASE WHEN p > 0 AND p < len(tokens) THEN tokens[p + 1] ELSE list_last(tokens) END AS n FROM (SELECT *, "
        f"coalesce(list_position(list_transform(tokens, lambda x: upper(x)), 'AS'), 0) AS p FROM t)) SELECT DISTINCT contract_id, lower(n) "
        f"AS column_name FROM n WHERE upper(n) NOT IN ("
    )
    + ", ".join(map(_lit, C.SHAPE_STOP_WORDS))
    + ")",
    "statements",
)(sqltext.shape_columns)

# ---------------------------------------------------------------- records

query("audit_verify_lag", (
    "WITH RECURSIVE o AS (SELECT *, row_number() OVER (PARTITION BY log_id ORDER BY seq) AS i FROM $entries), c AS (SELECT log_id, i, "
    "seq, upper(sha256(content)) AS hash FROM o WHERE i = 1 UNION ALL SELECT o.log_id, o.i, o.seq, upper(sha256(concat(c.hash, "
    "o.content))) FROM c JOIN o ON o.log_id = c.log_id AND o.i = c.i + 1) SELECT c.log_id, arg_max(hash, seq) AS last_hash, count(*) "
    "AS n, CAST(0 AS BIGINT) AS broken FROM c GROUP BY 1"
), "entries")(lambda e: _verified(e))
query("telemetry_counters", "SELECT name, tags, round(sum(value), 4) AS value, count(*) AS n FROM $events GROUP BY 1, 2", "events")(lambda e: records.counters(e).withColumn("value", F.round("value", 4)))
query("telemetry_histogram", "SELECT name, count(*) AS n, min(value) AS least, max(value) AS most, round(quantile_cont(value, 0.5), 6) AS median FROM $events GROUP BY 1", "events")(lambda e: records.histograms(e).withColumn("median", F.round("median", 6)))
query("telemetry_windows", "SELECT strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS window_start, name, count(*) AS n FROM $events GROUP BY 1, 2", "events")(records.windows)
query("breaker_islands", (
    "WITH i AS (SELECT *, sum(CAST(ok AS INT)) OVER (PARTITION BY source ORDER BY seq ROWS UNBOUNDED PRECEDING) AS g FROM $events), r "
    "AS (SELECT *, CAST(sum(CAST(NOT ok AS INT)) OVER (PARTITION BY source, g ORDER BY seq ROWS UNBOUNDED PRECEDING) AS BIGINT) AS "
    "failures FROM i) SELECT source, seq, failures, failures >= 3 AS open FROM r"
), "events")(lambda e: records.failures_in_a_row(e).select("source", "seq", "failures", "open"))
query("catalog_params_left_join", (
    "SELECT p.schema_name, p.specific_name, a.parameter_name, CASE a.mode WHEN 'OUT' THEN 'Output' WHEN 'INOUT' THEN 'InputOutput' "
    "ELSE 'Input' END AS direction, CASE WHEN a.max_length <= 2147483647 THEN a.max_length ELSE -1 END AS max_length FROM $procedures "
    "p JOIN $arguments a ON a.schema_name = p.schema_name AND a.specific_name = p.specific_name"
), "procedures", "arguments")(lambda p, a: records.routines(p, a).na.fill(-1, ["max_length"]))
query("catalog_params_keep_empty", (
    "SELECT p.schema_name, p.specific_name, a.parameter_name, CASE a.mode WHEN 'OUT' THEN 'Output' WHEN 'INOUT' THEN 'InputOutput' "
    "ELSE 'Input' END AS direction, CASE WHEN a.max_length <= 2147483647 THEN a.max_length ELSE -1 END AS max_length FROM $procedures "
    "p LEFT JOIN $arguments a ON a.schema_name = p.schema_name AND a.specific_name = p.specific_name"
), "procedures", "arguments")(lambda p, a: records.routines(p, a, keep_empty=True).na.fill(-1, ["max_length"]))
query("overload_grouping", (
    "SELECT object_name, CAST(coalesce(subprogram_id, TRY_CAST(overload AS INT), 0) AS BIGINT) AS overload_key, "
    "string_agg(argument_name, ',' ORDER BY sequence, argument_name) AS arguments, count(*) AS n FROM $overload_rows GROUP BY 1, 2"
), "overload_rows")(records.overloads)
query("nls_pivot", "SELECT session_id, " + ", ".join(f"coalesce(max(CASE WHEN parameter = '{n}' THEN value END), 'UNKNOWN') AS {n.lower()}" for n in records.NLS) + " FROM $nls WHERE parameter IN (" + ", ".join(map(_lit, records.NLS)) + ") GROUP BY session_id", "nls")(records.nls_settings)
_BANNER = (
    "concat('Oracle Database 19c ', CASE CAST(contract_id % 4 AS INT) WHEN 0 THEN 'Enterprise' WHEN 1 THEN 'Standard' WHEN 2 THEN "
    "'Express' ELSE 'Other' END, ' Edition Release ', CASE WHEN contract_id % 5 = 0 THEN '19' ELSE concat('19.', CAST(contract_id AS "
    "VARCHAR(20)), '.0.0.0') END, ' - Production')"
)
query("version_banner", (
    f"SELECT contract_id, coalesce(nullif(regexp_extract(b, 'Release (\\d+\\.\\d+\\.\\d+\\.\\d+\\.\\d+)', 1), ''), 'UNKNOWN') AS "
    f"version, nullif(regexp_extract(b, '(\\d+\\.\\d+)', 1), '') AS short_version, CASE WHEN contains(b, 'Enterprise') THEN "
    f"'Enterprise' WHEN contains(b, 'Standard') THEN 'Standard' WHEN contains(b, 'Express') THEN 'Express' ELSE 'Unknown' END AS "
    f"edition FROM (SELECT contract_id, {_BANNER} AS b FROM $statements)"
), "statements")(lambda s: s.select("contract_id", F.expr(_BANNER).alias("b")).select("contract_id", records.version_banner(F.col("b"))[0].alias("version"), text.major_minor(F.col("b")).alias("short_version"), records.version_banner(F.col("b"))[1].alias("edition")))
query("char_used_normalise", "SELECT table_name, column_name, CASE WHEN char_used = 'B' THEN 'BYTE' WHEN char_used = 'C' THEN 'CHAR' ELSE char_used END AS semantics FROM $columns", "columns")(lambda c: c.select("table_name", "column_name", text.char_used(F.col("char_used")).alias("semantics")))
query("dbms_type_codes", "SELECT ord, CASE " + " ".join(f"WHEN ord % 240 = {k} AND contract_id % 3 = 2 THEN '{v}'" for k, v in C.DBMS_NATIONAL_CODES.items()) + " " + " ".join(f"WHEN ord % 240 = {k} THEN '{v}'" for k, v in C.DBMS_TYPE_CODES.items()) + " ELSE 'UNKNOWN' END AS type_name FROM $findings", "findings")(lambda f: f.select("ord", records.dbms_type((F.col("ord") % 240).cast("int"), (F.col("contract_id") % 3).cast("int")).alias("type_name")))
query("naming_convention_vote", (
    "WITH s AS (SELECT CAST(sum(len(regexp_extract_all(source, '[a-z]+_[a-z]+'))) AS BIGINT) AS snake, "
    "CAST(sum(len(regexp_extract_all(source, '[A-Z][a-z]+[A-Z][a-z]+'))) AS BIGINT) AS pascal FROM $sources) SELECT snake, pascal, "
    "CASE WHEN snake > 2 * pascal THEN 'snake_case' WHEN pascal > 2 * snake THEN 'PascalCase' END AS convention FROM s"
), "sources")(records.naming_vote)
_ECI = (
    "floor(least(greatest(0.35::DOUBLE * least(log10(greatest(dependents, 1) + 1.0::DOUBLE) * 2.5::DOUBLE, 10.0::DOUBLE) * 10 + "
    "0.25::DOUBLE * least(stale / greatest(maintainers, 1) * 3.0::DOUBLE + days / 3.0::DOUBLE, 100.0::DOUBLE) + 0.25::DOUBLE * "
    "least(vulnerabilities * 25.0::DOUBLE, 100.0::DOUBLE) + 0.15::DOUBLE * CASE WHEN has_mcp THEN 0.0::DOUBLE ELSE 100.0::DOUBLE END, "
    "0.0::DOUBLE), 100.0::DOUBLE) * 100 + 0.5::DOUBLE) / 100"
)
_TIER = "CASE WHEN score >= 70 THEN 1 WHEN score >= 45 THEN 2 WHEN score >= 25 THEN 3 ELSE 4 END"


def _scored(r: DataFrame) -> DataFrame:
    return r.withColumn("score", records.eci(*(F.col(c) for c in ("dependents", "maintainers", "stale", "days", "vulnerabilities", "has_mcp"))))


def _verified(entries: DataFrame) -> DataFrame:
    log = records.chained(entries)
    broken = records.broken_links(log).groupBy("log_id").agg(F.count("*").alias("broken"))
    return log.groupBy("log_id").agg(F.max_by("hash", "seq").alias("last_hash"), F.count("*").alias("n")).join(broken, "log_id", "left").na.fill(0, ["broken"])


query("eci_score", f"SELECT repo, {_ECI} AS score FROM $repos", "repos")(lambda r: _scored(r).select("repo", "score"))
query("eci_tiers_topk", f"SELECT repo, score, {_TIER} AS tier FROM (SELECT repo, {_ECI} AS score FROM $repos) ORDER BY score DESC, repo LIMIT 20", "repos")(lambda r: records.ranked(_scored(r), 20).select("repo", "score", records.eci_tier(F.col("score")).alias("tier")))
query("eci_category_report", (
    f"SELECT category, count(*) AS scanned, CAST(count_if({_TIER} = 1) AS BIGINT) AS critical, CAST(count_if({_TIER} = 2) AS BIGINT) AS "
    f"high FROM (SELECT category, {_ECI} AS score FROM $repos) GROUP BY category"
), "repos")(lambda r: _scored(r).withColumn("tier", records.eci_tier(F.col("score"))).groupBy("category").agg(F.count("*").alias("scanned"), F.count_if(F.col("tier") == 1).alias("critical"), F.count_if(F.col("tier") == 2).alias("high")))
query("eci_diagnosis", (
    "SELECT repo, CASE WHEN d = '' THEN 'Healthy baseline state.' ELSE d END AS diagnosis FROM (SELECT repo, concat_ws('; ', CASE WHEN "
    "maintainers <= 1 THEN concat('Single maintainer sustaining ', CAST(dependents AS VARCHAR), ' downstream packages') END, CASE WHEN "
    "stale > 15 THEN concat('High issue backlog (', CAST(stale AS VARCHAR), ' unassigned issues)') END, CASE WHEN NOT has_mcp THEN "
    "'Missing Model Context Protocol bridge for AI integration' END, CASE WHEN vulnerabilities > 0 THEN concat('Unpatched security "
    "advisories (', CAST(vulnerabilities AS VARCHAR), ' CVEs)') END) AS d FROM $repos)"
), "repos")(lambda r: r.select("repo", records.diagnosis(*(F.col(c) for c in ("dependents", "maintainers", "stale", "vulnerabilities", "has_mcp"))).alias("diagnosis")))
query("seed_plus_synthetic", (
    "SELECT repo, dependents, stale, vulnerabilities FROM $repos UNION ALL SELECT concat('synthetic-', CAST(i AS VARCHAR)), 650 * i, "
    "10 + 3 * i, CAST(i % 2 = 0 AS BIGINT) FROM range(1, 6) t(i)"
), "repos")(lambda r: r.select("repo", "dependents", "stale", "vulnerabilities").unionByName(records.synthetic_repos(r.sparkSession, 5).select("repo", "dependents", "stale", "vulnerabilities")))
query("call_contracts_export", "SELECT procedure_name, string_agg(DISTINCT name, ',' ORDER BY name) AS parameters FROM $parameters GROUP BY 1", "parameters")(lambda p: p.groupBy("procedure_name").agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("parameters")))
_EDGES = "(VALUES " + ", ".join(f"('{r}', '{d}')" for r, ds in C.RULE_DEPENDENCIES.items() for d in ds) + ") AS e(rule_id, needs)"
_NODES = "(VALUES " + ", ".join(f"('{r}')" for r in C.RULE_DEPENDENCIES) + ") AS n(rule_id)"
_QUERIES["rule_graph_levels"] = lambda spark, sf_dir: spark.createDataFrame([(r, k) for k, level in enumerate(graph.levels(C.RULE_DEPENDENCIES)) for r in level], "rule_id string, level int")
_SQL["rule_graph_levels"] = (
    f"WITH RECURSIVE l AS (SELECT rule_id, 0 AS level FROM {_NODES} UNION ALL SELECT e.rule_id, l.level + 1 FROM l JOIN {_EDGES} ON "
    f"e.needs = l.rule_id) SELECT rule_id, max(level) AS level FROM l GROUP BY 1"
)
_QUERIES["rule_graph_closure"] = lambda spark, sf_dir: spark.createDataFrame([(r, d) for r in C.RULE_DEPENDENCIES for d in sorted(graph.closure(C.RULE_DEPENDENCIES, r))], "rule_id string, needs string")
_SQL["rule_graph_closure"] = (
    f"WITH RECURSIVE c AS (SELECT rule_id, needs FROM {_EDGES} UNION SELECT c.rule_id, e.needs FROM c JOIN {_EDGES} ON e.rule_id = "
    f"c.needs) SELECT * FROM c"
)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phantom tables and columns, dialect and security findings over all statements."""
    s, c = view(spark, sf_dir, "statements"), view(spark, sf_dir, "columns")
    return engine.united([rules.phantom_tables(s, c), rules.phantom_qualified(s, c), rules.phantom_selected(s, c), rules.oracle_elsewhere(s), rules.unmapped_types(s), rules.injection(s), rules.call_without_parameters(s)])


def queries() -> dict[str, Query]:
    from covenant.plans import catalogue_rest  # noqa: F401  registers the rest

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
