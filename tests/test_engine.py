"""Rules on single statements, sources, sinks, streams and the pipeline."""

import hashlib
import json

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from covenant.__main__ import main
from covenant.functions import constants as C
from covenant.functions import sqltext, text
from covenant.operators import engine, graph, records, rules
from covenant.plans import config, live
from covenant.plans.pipeline import Pipeline, all_rules, load_plugins, rule, rule_info, rules_for, run_tool
from covenant.sinks import reports
from covenant.sources import catalogs, declared, files, protocols
from covenant.streaming import flow


def statements(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "contract_id long, sql_text string")


COLUMNS = "table_name string, table_ord int, column_name string, col_ord int, data_type string, max_length int, char_length int, char_used string, is_nullable boolean"
PROPERTIES = "property_id long, contract_id long, table_name string, ord long, name string, column_name string, clr_type string, max_length int, is_required boolean"


@pytest.fixture(scope="module")
def columns(spark):
    return spark.createDataFrame([("CUSTOMERS", 0, "ID", 0, "NUMBER", 22, 0, None, False), ("CUSTOMERS", 0, "FULL_NAME", 1, "VARCHAR2", 50, 50, "B", True), ("ORDER_DETAILS", 1, "ID", 0, "NUMBER", 22, 0, None, False), ("CUSTOMERS", 0, "CONTENT", 2, "CLOB", 4000, 4000, None, True)], COLUMNS)


CASES = [
    ("SELECT DECODE(x, 1, 'a') FROM t", rules.oracle_elsewhere, 1),
    ("SELECT ROW_NUMBER() OVER (PARTITION BY a ORDER BY b) FROM t", rules.oracle_elsewhere, 0),
    ("SELECT ISNULL(a, 0) FROM t", rules.others_in_oracle, 1),
    ("SELECT ISNULL(a, 0) FROM t", rules.others_in_mysql, 0),
    ("SELECT ISNULL(a, 0) FROM t", rules.others_in_postgres, 0),
    ("SELECT TOPIC FROM t", rules.others_in_oracle, 0),
    ("SELECT a FROM t ORDER BY price DESC LIMIT 10", rules.others_in_oracle, 1),
    ("SELECT GROUP_CONCAT(o.id) FROM o", rules.others_in_oracle, 1),
    ("EXEC dbo.p", rules.exec_in_oracle, 1),
    ("EXEC dbo.p", rules.call_without_parameters, 1),
    ("EXEC dbo.p @a", rules.call_without_parameters, 0),
    ("SELECT MONEY FROM t", rules.unmapped_types, 1),
    ("INSERT INTO a VALUES (1) ON DUPLICATE KEY UPDATE a=1", rules.mysql_elsewhere, 1),
    ("CREATE TABLE t (id SERIAL)", rules.postgres_elsewhere, 1),
    ("select 1", rules.select_without_from, 1),
    ("select a from b where 1=1", rules.injection, 1),
]


@pytest.mark.parametrize(("sql", "plan", "n"), CASES)
def test_statement(spark, sql, plan, n):
    assert plan(statements(spark, sql)).count() == n


def test_phantoms(spark, columns):
    s = statements(spark, "SELECT * FROM NON_EXISTENT_TABLE", "SELECT c.NON_EXISTENT_COL FROM CUSTOMERS c", "WITH TempCte AS (SELECT 1) SELECT * FROM TempCte", "SELECT id, full_name, email FROM customers", "SELECT od.customer_id FROM order_details od JOIN customers p ON p.id = od.id", "")
    assert [tuple(r) for r in rules.phantom_tables(s, columns).select("contract_id", "message").collect()] == [(0, "Table 'NON_EXISTENT_TABLE' does not exist in database")]
    assert {r.message for r in rules.phantom_qualified(s, columns).collect()} == {"Column 'NON_EXISTENT_COL' does not exist in table 'CUSTOMERS'", "Column 'CUSTOMER_ID' does not exist in table 'ORDER_DETAILS'"}
    assert [r.message for r in rules.phantom_selected(s, columns).collect()] == ["Column 'EMAIL' does not exist in table 'CUSTOMERS'"]


def test_lengths(spark, columns):
    p = spark.createDataFrame([(1, 1, "customers", 0, "FullName", "FULL_NAME", "string", 50, True), (2, 1, "Customers", 1, "Content", "CONTENT", "string", None, False), (3, 1, "CUSTOMERS", 2, "FullName", "other", "string", 200, False), (4, 1, None, 2, "FullName", "FULL_NAME", "string", 200, False), (5, 1, "ORDER_DETAILS", 2, "FullName", "FULL_NAME", "string", 200, False)], PROPERTIES)
    m = rules.first_match(p, columns)
    assert [r.message for r in rules.too_long(m).collect()] == ["Entity property 'FullName' MaxLength=200 exceeds column 'FULL_NAME' length=50"]
    assert rules.too_many_bytes(m, "CHAR").count() == 2 and rules.inferred_length(m).count() == 1
    assert rules.first_match(p, columns, by_property=False).count() == 2


def test_an_entity_looks_at_its_own_table(spark):
    columns = spark.createDataFrame([("A_TABLE", 0, "EMAIL", 0, "VARCHAR2", 50, 50, "BYTE", True), ("B_TABLE", 1, "EMAIL", 0, "VARCHAR2", 500, 500, "C", True), ("b_table", 2, "EMAIL", 0, "VARCHAR2", 1, 1, "C", True)], COLUMNS)
    p = spark.createDataFrame([(1, 1, "B_TABLE", 0, "Email", "EMAIL", "string", 400, True), (2, 2, "a_table", 0, "Email", "EMAIL", "string", 40, True)], PROPERTIES)
    m = rules.first_match(p, columns)
    assert rules.too_long(m).count() == 0
    assert [r.contract_id for r in rules.too_many_bytes(m, "CHAR").collect()] == [2]  # BYTE counts bytes like B


def test_odd_white_space_and_letters(spark, columns):
    s = statements(spark, "\nEXEC dbo.GetOrders", "\tEXEC y", "EXEC p @größe", "SELECT id\n, name\n, total\nFROM customers", "SELECT x FROM Kundenübersicht", "SELECT über.ghost FROM customers über")
    assert [r.contract_id for r in rules.call_without_parameters(s).orderBy("contract_id").collect()] == [0, 1]
    assert {r.column_name for r in sqltext.shape_columns(s).where("contract_id = 3").collect()} == {"id", "name", "total"}
    assert [r.column_name for r in sqltext.selected_columns(s).where("contract_id = 3").orderBy("ord").collect()] == ["ID", "NAME", "TOTAL"]
    assert [r.table_name for r in sqltext.table_refs(s).where("contract_id = 4").collect()] == ["KUNDENÜBERSICHT"]
    assert rules.phantom_qualified(s, columns).count() == 0
    assert rules.procedure_prefix(s).count() == 2


def test_types(spark):
    rows = [(1, "a", "int", "NUMBER(10)"), (1, "b", "bool", "NUMBER (1)"), (1, "c", "string", "POINT"), (2, "d", "int", "int"), (2, "e", "string", "nvarchar(50)"), (2, "f", "string", "CHART"), (2, "g", None, "x"), (2, "h", "DateTime", "datetime2(7)")]
    got = rules.parameter_types(spark.createDataFrame(rows, "contract_id long, name string, clr_type string, data_type string"))
    assert {r.message.split("'")[1] for r in got.collect()} == {"c", "f"}


def test_names(spark):
    row = spark.range(1).select(text.snake_case(F.lit("FullName")), text.snake_case(F.lit("ID")), text.pascal_case(F.lit("full_name-x.y")), text.mask_value(F.lit("abcdefghij")), text.mask_value(F.lit("abc")), text.redact_sarif(F.lit("Password=1")), text.redact_evidence(F.lit("clean"))).first()
    assert tuple(row) == ("full_name", "i_d", "FullNameXY", "abcd****ghij", "****", "[REDACTED]", "clean")


def test_hashes(spark):
    found = spark.createDataFrame([("DG015", "a"), ("DG010", "b")], "rule_id string, message string")
    assert engine.finding_hash(found).first()[0] == "D32D768B51FC93D5"
    kind = "table_name string, column_name string, data_type string, is_nullable boolean, max_length int, precision int, scale int"
    columns = spark.createDataFrame([("CUSTOMERS", "ID", "NUMBER", False, None, 22, 0)], kind)
    assert engine.schema_hash(columns).first()[0] == "48BA8870B29EFBC60C53581ED1ECC135039EAE23E2AB952BFB8CE5B2F049CE60"
    odd = spark.createDataFrame([("T10", "B", "N", True, 1, 2, 3), ("T1", "ID#", "N", True, 1, 2, 3), ("T1", "ID", "N", False, None, None, None)], kind)
    canonical = "T1{ID,N,False,null,null,null;ID#,N,True,1,2,3}|T10{B,N,True,1,2,3}"
    assert engine.schema_hash(odd).first()[0] == hashlib.sha256(canonical.encode()).hexdigest().upper()
    found = spark.createDataFrame([("DG10", "a"), ("DG1", "b"), ("DG1", "a")], "rule_id string, message string")
    assert engine.finding_hash(found).first()[0] == hashlib.sha256(b"DG1:a|DG1:b|DG10:a").hexdigest().upper()[:16]


def test_run_hash_in_pieces(spark):
    """Over several ranges and pieces, with repeats, nulls, no rows; no operator puts all lines together."""
    lines = sorted(((f"DG{k % 7}", f"{'é' * (k % 50)}{k // 3}") for k in range(30_000)), key=lambda r: [x.encode() for x in r])
    found = spark.createDataFrame(lines[::-1], "rule_id string, message string").repartition(9)
    hashed = engine.finding_hash(found)
    assert [tuple(r) for r in hashed.collect()] == [(hashlib.sha256("|".join(map(":".join, lines)).encode()).hexdigest().upper()[:16],)]
    plan = hashed._jdf.queryExecution().executedPlan().toString()
    assert "collect_list" not in plan and "array_join" not in plan
    odd = spark.createDataFrame([("A", None), (None, "m"), ("A", "x"), ("A", "x")], found.schema)
    for rows, text_of in ((odd, b"m|A|A:x|A:x"), (odd.where("false"), b"")):
        assert engine.finding_hash(rows).first()[0] == hashlib.sha256(text_of).hexdigest().upper()[:16]


ECI = [("stable", 10, 5, 1, 7, 0, True, 9.85, 4), ("critical", 50000, 1, 200, 730, 4, False, 100.0, 1), ("tensor", 4320, 1, 48, 90, 1, False, 78.06, 1), ("raster", 1850, 1, 29, 90, 0, False, 68.59, 2), ("spatial", 620, 1, 11, 90, 0, True, 40.19, 3)]


def test_scores(spark):
    df = spark.createDataFrame([r[:7] for r in ECI], "repo string, d long, m long, s long, y long, v long, mcp boolean")
    score = records.eci(*(F.col(c) for c in ("d", "m", "s", "y", "v", "mcp")))
    got = {r.repo: (r.score, r.tier) for r in df.select("repo", score.alias("score"), records.eci_tier(score).alias("tier")).collect()}
    assert got == {r[0]: r[7:] for r in ECI}
    synthetic = records.synthetic_repos(spark, 3).select(records.eci(*(F.col(c) for c in ("dependents", "maintainers", "stale", "days", "vulnerabilities", "has_mcp"))))
    assert [r[0] for r in synthetic.collect()] == [54.37, 66.75, 50.54]


def test_source_audit(spark):
    rows = [(1, "subprocess.run(user_cmd, shell=True)\neval(user_code)"), (2, "def f(): return 1"), (3, "requests.get(url)")]
    got = {r.target: (r.score, r.is_safe) for r in rules.audit_sources(spark.createDataFrame(rows, "target long, source string")).collect()}
    assert got == {1: (20, False), 2: (100, True), 3: (80, True)}


def test_audit_log(spark):
    log = records.chained(spark.createDataFrame([(1, k, f"entry {k}") for k in range(9)], "log_id long, seq long, content string")).cache()
    assert records.broken_links(log).count() == 0
    edited = log.withColumn("content", F.when(F.col("seq") == 4, "changed").otherwise(F.col("content")))
    assert [r.seq for r in records.broken_links(edited).collect()] == [4]
    end = spark.createDataFrame([(1, log.where("seq = 8").first().hash)], "log_id long, checkpoint string")
    assert records.cut_logs(log, end).count() == 0 and records.cut_logs(log.where("seq < 8"), end).count() == 1


def test_rule_graph():
    assert graph.levels(C.RULE_DEPENDENCIES) == [["DG002", "DG015", "DG101"], ["DG003", "DG004", "DG005"], ["DG006"]]
    assert graph.closure(C.RULE_DEPENDENCIES, "DG006") == {"DG101", "DG004"}
    errors, warnings = graph.check({"a": ["b"], "b": ["a"], "c": ["d"], "e": []})
    assert len(errors) == 1 and warnings == ["Rule 'c' depends on missing rule 'd'", "Rule 'e' is isolated (no dependencies or dependents)"]
    assert graph.check(C.RULE_DEPENDENCIES) == ([], ["Rule 'DG015' is isolated (no dependencies or dependents)"])
    assert graph.dependents(C.RULE_DEPENDENCIES, "DG101") == {"DG003", "DG004", "DG006"}


def test_files(spark, tmp_path):
    base = tmp_path / "baseline.json"
    base.write_text(json.dumps({"version": 1, "violations": [{"ruleId": "DG001", "message": "old", "severity": "Error"}], "schema": [{"name": "CUSTOMERS", "columns": [{"name": "ID", "dataType": "NUMBER", "maxLength": 22, "isNullable": False}]}]}))
    assert [tuple(r)[:3] for r in files.baseline_findings(spark, str(base)).collect()] == [("DG001", "old", "Error")]
    assert files.snapshot_columns(spark, str(base)).first().column_name == "ID"
    model = tmp_path / "model.json"
    model.write_text(json.dumps({"Model": {"Method": "BuildModel", "Body": [[{"Method": "Entity<Customer>", "GenericArguments": [{"Name": "App.Customer"}], "ToTable": [{"Value": "CUSTOMERS"}], "Properties": [{"Name": "FullName", "ClrType": "string", "Calls": [{"Method": "HasMaxLength", "Arguments": ["50"]}, {"Method": "HasMaxLength", "Arguments": ["80"]}, {"Method": "IsRequired", "Arguments": []}]}]}, {"Method": "Entity", "Properties": []}]]}}))
    row = files.model_properties(spark, str(model)).first()
    assert (row.entity, row.table_name, row.name, row.max_length, row.is_required, row.column_name) == ("Customer", "CUSTOMERS", "FullName", 80, True, "FullName")
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "a.sql").write_text("CREATE PROCEDURE dbo.PlaceOrder(@OrderId INT, @Note VARCHAR(50), @Amount DECIMAL(10, 2), @Body VARCHAR(MAX), @Rate FLOAT(53), @Kind dbo.Kind)")
    got = [tuple(r)[2:] for r in files.declared_parameters(files.statements(spark, str(tmp_path / "sql"))).orderBy("ord").collect()]
    assert got == [("OrderId", "int", None, None, None), ("Note", "varchar(50)", 50, None, None), ("Amount", "decimal(10,2)", None, 10, 2), ("Body", "varchar(max)", None, None, None), ("Rate", "float(53)", None, 53, None), ("Kind", "dbo.kind", None, None, None)]
    manual = tmp_path / "manual.json"
    manual.write_text(json.dumps({"entities": [{"name": "Customer", "columns": [{"property": "PhoneNo", "column": "PHONE", "type": "string", "maxLength": 0}]}], "procedures": [{"name": "Get", "parameters": [{"name": "p", "type": "NUMBER", "direction": "IN", "maxLength": 5}]}]}))
    properties, parameters = files.manual_contracts(spark, str(manual))
    assert properties.first().max_length is None and parameters.first().direction == "Input"
    seed = tmp_path / "seed.json"
    seed.write_text(json.dumps({"repositories": [{"repo": "a/b", "category": "X", "risk_level": "CRITICAL"}, {"repo": "c/d", "category": "Y"}]}))
    assert [tuple(r)[2:7] for r in files.seed_repos(spark, str(seed), "x").collect()] == [(500, 1, 10, 90, 1)]


def test_catalogs(spark):
    routines = spark.createDataFrame([("p", "app", "app", "p_1", "PROCEDURE"), ("q", "app", "app", "q_1", "PROCEDURE"), ("f", "app", "app", "f_1", "FUNCTION")], "routine_name string, routine_schema string, specific_schema string, specific_name string, routine_type string")
    parameters = spark.createDataFrame([("app", "p_1", "a", "text", "INOUT", 1, 4294967295)], "specific_schema string, specific_name string, parameter_name string, data_type string, parameter_mode string, ordinal_position int, character_maximum_length long")
    got = {r.procedure_name: (r.name, r.direction, r.max_length) for r in catalogs.routine_parameters(routines, parameters, "APP").collect()}
    assert got == {"app.p": ("a", "InputOutput", None)}
    got = {r.procedure_name: r.name for r in catalogs.routine_parameters(routines, parameters, "APP", keep_empty=True).collect()}
    assert got == {"app.p": "a", "app.q": None}
    described = spark.createDataFrame([("p", 1, "id", "int", False, None), ("q", 1, None, None, None, 11512)], "procedure_name string, ordinal int, name string, system_type_name string, is_nullable boolean, error_number int")
    assert [r.name for r in catalogs.result_columns(described).collect()] == ["id"]
    with pytest.raises(Exception, match="description failed"):
        catalogs.result_columns(described.withColumn("error_number", F.lit(7))).collect()
    frame = catalogs.frame_properties(described, "Described")
    assert [r.clr_type for r in frame.orderBy("ord").collect()][:2] == ["string", "int"]
    assert catalogs.length_semantics(spark.createDataFrame([("NLS_LENGTH_SEMANTICS", "char")], "parameter string, value string")) == "CHAR"


def test_sinks(spark, tmp_path):
    found = spark.createDataFrame([(1, 1, "DG002", "token=abc", "Error"), (2, 1, "DG001", "plain: text", "Warning"), (3, 2, "DG001", "other", "Info")], "ord long, contract_id long, rule_id string, message string, severity string")
    path = tmp_path / "out.sarif"
    reports.write_sarif(found, str(path))
    run = json.loads(path.read_text())["runs"][0]
    assert [r["ruleId"] for r in run["results"]] == ["DG001", "DG001", "DG002"] and run["results"][2]["message"]["text"] == "[REDACTED]"
    assert [(r["name"], r["shortDescription"]["text"]) for r in run["tool"]["driver"]["rules"]] == [("plain", "plain: text"), ("[REDACTED]", "[REDACTED]")]
    assert "abc" not in path.read_text()
    place = F.when(F.col("ord") == 2, F.struct(F.lit("a.sql").alias("path"), *(F.lit(k).cast("long").alias(n) for n, k in (("start_line", 0), ("start_column", 4), ("end_line", 0), ("end_column", 9)))))
    placed = found.withColumn("location", place).withColumn("properties", F.create_map(F.lit("table"), F.lit("T"), F.lit("odd"), F.lit("x")))
    lines = [json.loads(x) for x in reports.lines(reports.sarif_line(placed.orderBy("ord")))]
    assert lines[0]["locations"] == [] and lines[1]["locations"][0]["physicalLocation"]["region"] == {"startLine": 1, "startColumn": 5, "endLine": 1, "endColumn": 10}
    assert lines[1]["properties"] == {"table": "T"}
    assert "[WARNING] DG001: plain: text (1:5)" in list(reports.lines(reports.console_lines(placed)))
    assert [tuple(r) for r in files.sarif_results(spark, str(path)).select("rule_id", "level").collect()] == [("DG001", "note"), ("DG001", "warning"), ("DG002", "error")]
    assert "token=abc" not in "".join(reports.lines(reports.evidence_lines(found)))
    assert "[ERROR] DG002: token=abc" in list(reports.lines(reports.console_lines(found)))
    reports.write_baseline(found, str(tmp_path / "b.json"), "Manual", "now")
    document = json.loads((tmp_path / "b.json").read_text())
    assert document["Version"] == 2 and len(document["Violations"]) == 3 and len(document["SchemaHash"]) == 16
    reports.write_evidence(found, str(tmp_path / "e.json"), "oracle")
    assert [v["severity"] for v in json.loads((tmp_path / "e.json").read_text())["violations"]] == ["info", "warning", "error"]
    got = []
    with pytest.raises(ExceptionGroup):
        reports.emit(found, [lambda df: got.append(df.count()), lambda df: 1 / 0, lambda df: got.append(df.count())])
    assert got == [3, 3]
    assert engine.new_findings(found, files.baseline_findings(spark, str(tmp_path / "b.json"))).count() == 0
    entity = spark.createDataFrame([("Customer", 0, "Id", "Guid", False), ("Customer", 1, "Name", "string?", True), ("Customer", 2, "Odd", "Thing", False)], "entity string, ord int, name string, clr_type string, is_nullable boolean")
    assert reports.typescript(entity).first().source == "export interface Customer {\n  Id: string;\n  Name?: string;\n  Odd: unknown;\n}\n"
    assert json.loads(reports.contract_export(entity).first().json)["properties"][0] == {"name": "Id", "type": "Guid", "nullable": False}


def test_streams(spark, tmp_path):
    rows = [("a", k, k not in (2, 3, 4, 6)) for k in range(8)] + [("b", k, False) for k in range(3)]
    batch = spark.createDataFrame(rows, "source string, seq long, ok boolean")
    batch.repartition(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    q = flow.breaker(stream).writeStream.format("memory").queryName("breaker").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.source, r.seq): (r.failures, r.open) for r in spark.table("breaker").collect()}
    assert got == {(r.source, r.seq): (r.failures, r.open) for r in records.failures_in_a_row(batch).collect()}
    sent = []
    flow.flushed(stream, lambda df, k: sent.append(df.count()), str(tmp_path / "check")).awaitTermination(120)
    assert sum(sent) == len(rows)


def test_windowed_stream(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").selectExpr("CAST(ts AS TIMESTAMP) AS ts", "event_type AS name")
    events.repartition(1).write.parquet(str(tmp_path / "e"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "e"))
    q = flow.windowed_counts(stream).writeStream.format("memory").queryName("counts").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("counts").count() == records.windows(events).count()


def test_pipeline(spark, columns):
    tables = {"statements": statements(spark, "SELECT * FROM NOWHERE", "EXEC p", "SELECT id FROM customers"), "columns": columns}
    p = Pipeline(tables).for_provider("oracle")
    assert p.summary() == {"errors": 2, "warnings": 0, "infos": 0, "total": 2, "has_errors": True}
    assert p.with_baseline(p.validate()).validate().count() == 0
    assert set(rules_for("mysql")) >= {"MY001", "DG015"}
    assert load_plugins(["no.such.module"])

    @rule("TEST001", "Info", "statements")
    def short(t):
        return t["statements"].where(F.length("sql_text") < 8).selectExpr("contract_id", "'TEST001' AS rule_id", "'Info' AS severity", "'short' AS message")

    assert Pipeline(tables).with_rules("TEST001").validate().count() == 1


def test_named_rules_need_their_tables(spark, columns):
    tables = {"statements": statements(spark, "SELECT 1")}
    with pytest.raises(ValueError, match="DG002 needs parameters; rule DG015 needs columns"):
        Pipeline(tables).with_rules("DG098", "DG002", "DG015").validate()
    assert "DG015" in Pipeline(tables).for_provider("mysql").skipped()
    assert rule_info("DG015").needs == ("statements", "columns") and rule_info("NOPE").description == "unknown rule"
    assert {r.rule_id for r in all_rules()} >= {"DG001", "DG012"}
    result = run_tool("lint", lambda t: (t["statements"], t["statements"]), tables)
    assert result.tool == "lint" and result.seconds >= 0


def test_numbers_through_very_many_ranges(spark):
    rows = spark.range(400_000).select((F.col("id") % 7).alias("a"), F.xxhash64("id").cast("string").alias("b"), "id")
    places = engine.numbered(rows, "a", "b", "id", parts=700).withColumn("true", F.row_number().over(Window.orderBy("a", "b", "id")))
    assert tuple(places.agg(F.count("*"), F.count_if(F.col("place") != F.col("true"))).first()) == (400_000, 0)


def test_evidence_counts_through_all(spark):
    rows = [(k, "DG001" if k % 3 else "DG002", "same" if k < 60 else f"m{k % 7}", "Error" if k % 2 else "Odd") for k in range(200)]
    found = spark.createDataFrame(rows, "ord long, rule_id string, message string, severity string")
    want = sorted((r, "error" if s == "Error" else "hidden", m, o) for o, r, m, s in rows)
    got = sorted((r.place, r.rule_id, r.severity, r.message, r.ord) for r in engine.evidence(found).collect())
    assert [g[0] for g in got] == list(range(1, 201)) and [g[1:] for g in got] == want
    assert engine.evidence(found.where("false")).count() == 0


def test_failures_across_segments(spark):
    import random

    rng = random.Random(3)
    rows = [(s, k, rng.random() < p) for s, p in (("a", 0.3), ("b", 0.02), ("c", 0.9)) for k in range(-20, 300) if rng.random() < 0.8]
    got = {(r.source, r.seq): r.failures for r in records.failures_in_a_row(spark.createDataFrame(rows, "source string, seq long, ok boolean"), segment=10).collect()}
    want, run = {}, {}
    for s, k, ok in rows:
        run[s] = 0 if ok else run.get(s, 0) + 1
        want[s, k] = run[s]
    assert got == want


def test_call_sites(spark):
    source = 'var a = db.FromSqlRaw("SELECT * FROM t");\n// covenant: known\nconn.Query<T>("x");\nlist.Select(q);\nconn.ExecuteScalar(sql);\ndb.ExecuteSqlRaw("nothing");\n'
    got = rules.call_sites(spark.createDataFrame([(1, source)], "target long, source string")).orderBy("ord").collect()
    assert [(r.method, r.sql_text) for r in got] == [("FromSqlRaw", "SELECT * FROM t"), ("ExecuteScalar", "")]
    skipped = "using X;\n[SkipContractCheck(\"known\")]\nclass A { void F() { " + source + " } }"
    assert rules.call_sites(spark.createDataFrame([(1, skipped)], "target long, source string")).count() == 0


def test_protocol_and_breaker(spark):
    lines = spark.createDataFrame([(1, '{"jsonrpc":"2.0","id":"a","method":"ping"}'), (2, '{"id":3,"method":"no\\"pe"}'), (3, "x"), (4, " ")], "seq int, value string")
    got = [json.loads(r.value) for r in protocols.responses(protocols.requests(lines)).orderBy("seq").collect()]
    assert got[0]["result"] == {} and got[1]["id"] == 3 and got[1]["error"] == {"code": -32601, "message": 'Method not found: no"pe'}
    calls = []

    def send(df, k):
        calls.append(k)
        if len(calls) in (1, 2, 4, 5, 6):
            raise OSError

    guard = flow.Breaker(send)
    guard(lines, 0)
    with pytest.raises(flow.Breaker.Open):
        guard(lines, 1)
    with pytest.raises(flow.Breaker.Open):
        guard(lines, 2)
    assert calls == [0, 0, 0, 1, 1, 1]


def test_config(tmp_path):
    made = config.parse_config("# c\nGroundTruthMode: Manual  # note\nEnableBaseline: false\nExcludedEntities:\n  - Audit\n  - 'Log'\nOracle:\n  Owner: X\nMaxViolationQueueSize: 7\nDefaultSchema: \"a: b\"\n")
    assert (made.ground_truth_mode, made.enable_baseline, made.excluded_entities, made.max_violation_queue_size, made.default_schema) == ("Manual", False, ("Audit", "Log"), 7, "a: b")
    assert config.parse_config(config.dump_config(made)) == made
    with pytest.raises(ValueError, match="GroundTruthMode"):
        config.parse_config("GroundTruthMode: Odd")
    (tmp_path / "appsettings.json").write_text(json.dumps({"ConnectionStrings": {"A": "x", "Default": "Data Source=orcl;User Id=a;Password=b"}}))
    assert config.detect_connection(str(tmp_path), {}) == "Data Source=orcl;User Id=a;Password=b"
    assert config.detect_provider(str(tmp_path), {}) is None and config.detect_provider(str(tmp_path), {"COVENANT_PROVIDER": "MySQL"}) == "mysql"
    assert config.resolved(config.Config(), str(tmp_path), {}).provider == "oracle"
    assert config.provider_of_connection("Server=x;Database=y") == "sqlserver" and config.provider_of_settings('{"Logging": "UseOracle"}') == "oracle"
    assert config.contained_path(str(tmp_path), "a/../b.yml").name == "b.yml"
    for bad in ("../x", "/etc/x"):
        with pytest.raises(ValueError):
            config.contained_path(str(tmp_path), bad)


def test_live_catalogues(spark):
    make = spark.createDataFrame
    tables = {
        "sys.procedures": make([(1, 9, "Get", 0), (2, 9, "Own", 1)], "object_id int, schema_id int, name string, is_ms_shipped int"),
        "sys.schemas": make([(9, "dbo")], "schema_id int, name string"),
        "sys.parameters": make([(1, 1, "@id", 5, -1, 0, 0, True), (2, 1, "@x", 5, 4, 0, 0, False)], "object_id int, parameter_id int, name string, user_type_id int, max_length int, precision int, scale int, is_output boolean"),
        "sys.types": make([(5, "nvarchar")], "user_type_id int, name string"),
        "all_arguments": make([("APP", "PKG", "GET", "P_ID", 1, 1, "IN/OUT", "NUMBER", None, None, None, 22, None, None), ("APP", "PKG", "GET", None, 0, 0, "OUT", "NUMBER", None, None, None, 22, None, None)], "owner string, package_name string, object_name string, argument_name string, position int, sequence int, in_out string, data_type string, type_owner string, type_name string, type_subname string, data_length int, subprogram_id int, overload string"),
        "all_tab_columns": make([("APP", "B", "ID", "NUMBER", 22, 0, 10, 0, "N", None, 1), ("APP", "A", "N", "VARCHAR2", 40, 10, None, None, "Y", "C", 1), ("OTHER", "C", "X", "DATE", 7, 0, None, None, "Y", None, 1)], "owner string, table_name string, column_name string, data_type string, data_length int, char_length int, data_precision int, data_scale int, nullable string, char_used string, column_id int"),
        "information_schema.columns": make([("app", "t", "c", "varchar", 4294967295, "YES", 1)], "table_schema string, table_name string, column_name string, data_type string, character_maximum_length long, is_nullable string, ordinal_position int"),
    }
    assert [tuple(r) for r in live.parameters("SqlServer", tables.__getitem__).collect()] == [("dbo.Get", 1, "@id", "nvarchar", "InputOutput", None)]
    assert [tuple(r) for r in live.parameters("oracle", tables.__getitem__, "app", "pkg").collect()] == [("PKG.GET", 1, "P_ID", "NUMBER", "InputOutput", 22)]
    got = live.columns("oracle", tables.__getitem__, "app").orderBy("table_ord").collect()
    assert [(r.table_name, r.table_ord, r.char_length, r.is_nullable) for r in got] == [("A", 0, 10, True), ("B", 1, 0, False)]
    row = live.columns("mysql", tables.__getitem__, "APP").first()
    assert (row.table_name, row.max_length, row.is_nullable) == ("t", None, True)
    for bad in (("odd", None), ("oracle", None)):
        with pytest.raises(ValueError):
            live.columns(bad[0], tables.__getitem__, bad[1])


def test_declared_contracts(spark):
    @declared.expected_column("Id", "ID", "int", nullable=False)
    @declared.expected_column("Name", max_length=50)
    @declared.expected_parameter("Get", "p_id", "NUMBER")
    class Customer: ...

    @declared.skip_contract_check
    @declared.expected_column("X")
    class Skipped: ...

    properties, parameters = declared.declared(spark, [Customer, Skipped])
    assert [(r.name, r.column_name, r.max_length) for r in properties.orderBy("ord").collect()] == [("Id", "ID", None), ("Name", "Name", 50)]
    assert parameters.first().direction == "Input"


def test_more_files(spark, tmp_path):
    (tmp_path / "A.cs").write_text("namespace X;\npublic class Customer { }\nclass Shop : DbContext { }\n")
    (tmp_path / "B.cs").write_text("class Customer { }  using Dapper;")
    sources = files.texts(spark, str(tmp_path))
    assert [(r.name, r.path[-4:], r.line) for r in files.locate_types(sources, spark.createDataFrame([("Customer",), ("None",)], "name string")).collect()] == [("Customer", "A.cs", 2)]
    assert {(r.path[-4:], r.orm, r.mapper) for r in files.usage(sources).collect()} == {("A.cs", True, False), ("B.cs", False, True)}
    assert [r.name for r in files.context_names(sources).collect()] == ["Shop"]
    (tmp_path / "corpus.json").write_text(json.dumps({"tables": [{"name": "T", "columns": ["ID", {"name": "N", "dataType": "CHAR", "maxLength": 3, "isNullable": False}]}]}))
    assert [(r.column_name, r.data_type, r.is_nullable) for r in files.corpus_columns(spark, str(tmp_path / "corpus.json")).orderBy("col_ord").collect()] == [("ID", None, True), ("N", "CHAR", False)]
    (tmp_path / "AppModelSnapshot.json").write_text("{}")
    assert files.find_model_snapshot(str(tmp_path)).endswith("AppModelSnapshot.json")
    old = tmp_path / "old.json"
    old.write_text(json.dumps({"version": 1, "createdAt": "then", "violations": [{"ruleId": "DG1", "message": "b", "severity": "Error"}]}))
    assert reports.migrate_baseline(spark, str(old)) and not reports.migrate_baseline(spark, str(old))
    assert json.loads(old.read_text())["SchemaHash"] == hashlib.sha256(b"DG1:b").hexdigest().upper()[:16]
    assert not reports.migrate_baseline(spark, str(tmp_path / "none.json"))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    monkeypatch.setattr(type(spark), "stop", lambda self: None)
    schema = tmp_path / "schema.json"
    schema.write_text(json.dumps({"Version": 2, "DatabaseVersion": "19.3", "LengthSemantics": "byte", "Schema": [{"Name": "PEOPLE", "Columns": [{"Name": "FULL_NAME", "DataType": "VARCHAR2", "MaxLength": 20, "CharLength": 20, "IsNullable": True}]}]}))
    (tmp_path / "sql").mkdir()
    (tmp_path / "sql" / "a.sql").write_text("SELECT x FROM nowhere")
    model = tmp_path / "model.json"
    model.write_text(json.dumps({"BuildModel": [{"Method": "Entity", "GenericArguments": [{"Name": "App.Person"}], "ToTable": [{"Value": "people"}], "Properties": [{"Name": "FullName", "ClrType": "string", "Calls": [{"Method": "HasMaxLength", "Arguments": ["50"]}, {"Method": "HasColumnName", "Arguments": ["FULL_NAME"]}]}]}]}))
    out = tmp_path / "out.txt"
    common = ["--sql", str(tmp_path / "sql"), "--schema", str(schema), "--entities", str(model), "--provider", "oracle"]
    assert main(["validate", *common, "--output", str(out)]) == 1
    text_out = out.read_text()
    assert "DG015: Table 'NOWHERE'" in text_out and "DG007" in text_out and "BYTE semantics" in text_out
    assert main(["baseline", *common, "--baseline", str(tmp_path / "base.json")]) == 0
    assert json.loads((tmp_path / "base.json").read_text())["Schema"][0]["Name"] == "PEOPLE"
    assert main(["validate", *common, "--baseline", str(tmp_path / "base.json")]) == 0
    assert main(["validate", *common, "--format", "contracts", "--output", str(out)]) == 0
    document = json.loads(out.read_text())
    assert document["entities"][0]["properties"][0]["maxLength"] == 50 and document["tables"][0]["name"] == "PEOPLE" and document["storedProcedures"] == []
    assert main(["validate", *common, "--format", "typescript", "--output", str(out)]) == 0 and "interface Person" in out.read_text()
    snap = str(tmp_path / "snap.json")
    assert main(["snapshot", "refresh", "--schema", str(schema), "--snapshot", snap]) == 0
    assert main(["snapshot", "diff", "--snapshot", snap, "--schema", str(schema), "--fail-on-drift"]) == 0
    schema.write_text(schema.read_text().replace("20", "30"))
    assert main(["snapshot", "diff", "--snapshot", snap, "--schema", str(schema), "--fail-on-drift"]) == 1
    assert "changed: PEOPLE.FULL_NAME" in capsys.readouterr().out
    assert main(["snapshot", "show", "--snapshot", snap]) == 0 and "1 tables, 1 columns" in capsys.readouterr().out
    assert main(["oracle-check", "--schema", str(schema)]) == 0 and main(["validate", "--schema", "nowhere.json"]) == 2
    seeds = tmp_path / "seeds.json"
    seeds.write_text(json.dumps({"repositories": [{"repo": "a/b", "category": "X"}]}))
    assert main(["radar", "--seeds", str(seeds), "--limit", "3", "--output", str(out)]) == 0 and len(out.read_text().splitlines()) == 3


def test_the_engine_stands_alone():
    """Nothing outside the subpackage imports it."""
    from pathlib import Path

    root = Path(__file__).parent.parent / "covenant"
    assert not [p for p in root.rglob("*.py") if "llm" not in p.parts and "covenant.llm" in p.read_text()]
