"""Rules as set-based plans: each takes DataFrames and returns findings (contract_id, rule_id, severity, message).

No rule calls Python for a row, and rules are never crossed with contracts: each is one plan, and the
engine unites the plans. The schema side of a join is a catalogue of table and column names; Spark
broadcasts it when its size allows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.functions import constants as C
from covenant.functions import sqltext, text


def findings(rows: DataFrame, rule: str, message: Column, *more: str) -> DataFrame:
    return rows.select("contract_id", F.lit(rule).alias("rule_id"), F.lit(C.RULES[rule][0]).alias("severity"), message.alias("message"), *more)


# ---------------------------------------------------------------- parameters


def _types(table: dict[str, tuple[str, ...]]) -> Column:
    return F.create_map(*(x for k, v in table.items() for x in (F.lit(k), F.array(*(F.lit(t.upper()) for t in v)))))


def parameter_types(parameters: DataFrame) -> DataFrame:
    """``parameters(contract_id, name, clr_type, data_type)``: types that don't go together, in the dialect that the contract's parameters show."""
    oracle = F.max(F.upper("data_type").contains("NUMBER").cast("int")).over(Window.partitionBy("contract_id")) == 1
    known = parameters.withColumn("fits", F.when(oracle, F.element_at(_types(C.ORACLE_TYPES), F.col("clr_type"))).otherwise(F.element_at(_types(C.SQLSERVER_TYPES), F.col("clr_type"))))
    tokens = text.type_tokens(F.upper("data_type"))
    whole = text.without_spaces(F.upper("data_type"))
    fits = F.arrays_overlap(tokens, "fits") | F.exists("fits", lambda t: text.without_spaces(t) == whole)
    wrong = known.where((F.coalesce("clr_type", F.lit("")) != "") & ~F.coalesce(fits, F.lit(False)))
    return findings(wrong, "DG002", F.concat(F.lit("Parameter '"), "name", F.lit("' has CLR type '"), "clr_type", F.lit("' but database type '"), "data_type", F.lit("' is not compatible")))


def parameter_directions(parameters: DataFrame) -> DataFrame:
    wrong = parameters.where(F.col("direction").isin("Output", "InputOutput", "ReturnValue") & (F.col("call_site") == "Input"))
    return findings(wrong, "DG003", F.concat(F.lit("Parameter '"), "name", F.lit("' is "), "direction", F.lit(" but call site passes it as "), "call_site", F.lit(" (out/ref required)")))


def legacy_prefix(parameters: DataFrame) -> DataFrame:
    wrong = parameters.where(F.upper("schema_name").startswith("LEGACY_") & ~F.upper("name").startswith("P_"))
    return findings(wrong, "CUSTOM001", F.concat(F.lit("Parameter '"), "name", F.lit("' in legacy schema procedure '"), "procedure_name", F.lit("' should start with 'P_'")))


# ---------------------------------------------------------------- shape, nullability, names


def missing_columns(properties: DataFrame, shape: DataFrame) -> DataFrame:
    """``properties(contract_id, ord, name, column_name)`` that a result ``shape(contract_id, column_name)`` lacks; the first five by ord are named."""
    wanted = properties.select("contract_id", "ord", "name", F.lower("column_name").alias("c"), F.lower("name").alias("n"))
    have = shape.select("contract_id", F.col("column_name").alias("c"))
    known = wanted.join(have.select("contract_id").distinct(), "contract_id", "left_semi")
    lacking = known.join(have, ["contract_id", "c"], "left_anti").join(have.withColumnRenamed("c", "n"), ["contract_id", "n"], "left_anti")
    names = F.transform(F.slice(F.sort_array(F.collect_list(F.struct("ord", "name"))), 1, 5), lambda x: x["name"])
    grouped = lacking.groupBy("contract_id").agg(F.array_join(names, ", ").alias("names"))
    return findings(grouped, "DG004", F.concat(F.lit("Result set is missing required columns: "), "names"))


def extra_columns(properties: DataFrame, shape: DataFrame) -> DataFrame:
    """More result columns without a property than half (whole numbers) of the properties' and columns' names together."""
    names = properties.select("contract_id", F.explode(F.array(F.lower("name"), F.lower("column_name"))).alias("column_name")).distinct()
    sizes = names.groupBy("contract_id").agg(F.count("*").alias("known"))
    extra = shape.join(names, ["contract_id", "column_name"], "left_anti").groupBy("contract_id").agg(F.count("*").alias("n"))
    wrong = extra.join(sizes, "contract_id").where(F.col("n") > F.expr("known div 2"))
    return findings(wrong, "DG004", F.concat(F.lit("Result set has "), F.col("n").cast("string"), F.lit(" extra columns not mapped to entity properties")))


def last_columns(columns: DataFrame) -> DataFrame:
    """Of columns of the same name in any table the last one counts: (column_key, is_nullable)."""
    return columns.groupBy(F.upper("column_name").alias("column_key")).agg(F.max_by("is_nullable", F.struct("table_ord", "col_ord")).alias("is_nullable"))


def nullability(properties: DataFrame, columns: DataFrame) -> DataFrame:
    """``properties(contract_id, name, column_name, is_required)`` against the last column of each name."""
    both = properties.join(last_columns(columns).withColumnRenamed("is_nullable", "db_nullable"), F.upper(properties["column_name"]) == F.col("column_key"))
    wrong = both.where(F.col("is_required") == F.col("db_nullable"))
    message = F.when(F.col("is_required"), F.concat(F.lit("Property '"), "name", F.lit("' is required but database column '"), "column_name", F.lit("' allows NULL"))).otherwise(F.concat(F.lit("Property '"), "name", F.lit("' is nullable but database column '"), "column_name", F.lit("' is NOT NULL")))
    return findings(wrong, "DG005", message)


def naming(properties: DataFrame) -> DataFrame:
    snake, pascal = text.snake_case(F.col("name")), text.pascal_case(F.col("name"))
    wrong = properties.where((F.col("column_name") != "") & (F.lower("column_name") != F.lower(snake)) & (F.lower("column_name") != F.lower(pascal)))
    return findings(wrong, "DG006", F.concat(F.lit("Property '"), "name", F.lit("' (PascalCase: '"), pascal, F.lit("', snake_case: '"), snake, F.lit("') doesn't match database column '"), "column_name", F.lit("'")))


# ---------------------------------------------------------------- lengths


def first_match(properties: DataFrame, columns: DataFrame, by_property: bool = True) -> DataFrame:
    """Each of ``properties(property_id, table_name, ...)`` with its entity's first column that has its column name or, ``by_property``, its name in upper snake case.

    The table is the first of the entity's table name, whatever the case; entities without a table have no columns.
    The catalogue becomes one map of columns to a table, so properties aren't shuffled when it is small enough to be sent.
    """
    # A struct's first field orders it: of the columns that match, the least place is the first.
    kept = F.struct("col_ord", F.col("column_name").alias("db_column"), "data_type", F.col("max_length").alias("db_max_length"), "char_length", "char_used")
    keyed = columns.where(F.col("column_name").isNotNull()).groupBy(F.upper("table_name").alias("table_key"), "table_ord", F.upper("column_name").alias("k")).agg(F.min_by(kept, "col_ord").alias("c"))
    tables = keyed.groupBy("table_key", "table_ord").agg(F.map_from_entries(F.collect_list(F.struct("k", "c"))).alias("by_name"))
    first = tables.groupBy("table_key").agg(F.min_by("by_name", "table_ord").alias("by_name"))
    both = properties.join(first, F.upper("table_name") == F.col("table_key"))
    found = F.try_element_at("by_name", F.upper("column_name"))
    if by_property:
        found = F.array_min(F.filter(F.array(found, F.try_element_at("by_name", F.upper(text.snake_case(F.col("name"))))), lambda c: c.isNotNull()))
    return both.withColumn("c", found).where("c is not null").select(*properties.columns, "c.db_column", "c.data_type", "c.db_max_length", "c.char_length", "c.char_used")


def too_long(matched: DataFrame, rule: str = "DG007") -> DataFrame:
    """Longer than the column's characters, or its bytes where it doesn't say; other rules than DG007 know one length only."""
    limit = F.coalesce("char_length", "db_max_length") if rule == "DG007" else F.col("db_max_length")
    wrong = matched.where(F.col("max_length") > limit)
    return findings(wrong, rule, F.concat(F.lit("Entity property '"), "name", F.lit("' MaxLength="), F.col("max_length").cast("string"), F.lit(" exceeds column '"), "db_column", F.lit("' length="), limit.cast("string")))


def too_many_bytes(matched: DataFrame, session: str = "BYTE") -> DataFrame:
    """Where the column counts bytes (or says nothing and the session does), four bytes for each character of a text."""
    in_bytes = F.col("char_used").isin("B", "BYTE") | ((F.coalesce("char_used", F.lit("")) == "") & F.lit(session == "BYTE"))
    wide = F.col("max_length") * F.when(F.col("clr_type").isin("string", "System.String"), 4).otherwise(1)
    wrong = matched.where(in_bytes & (wide > F.col("db_max_length")))
    return findings(wrong, "DG008", F.concat(F.lit("Byte overflow risk: property '"), "name", F.lit("' may exceed column '"), "db_column", F.lit(f"' byte capacity in {session} semantics")))


def inferred_length(matched: DataFrame) -> DataFrame:
    wrong = matched.where(F.col("max_length").isNull() & F.col("clr_type").isin("string", "System.String") & F.upper("data_type").isin("CLOB", "NCLOB"))
    return findings(
        wrong,
        "DG009",
        F.concat(F.lit("EF Core will infer NVARCHAR2(2000) for property '"), "name", F.lit("' (no MaxLength set, Unicode=true) but Oracle column '"), "db_column", F.lit("' is "), "data_type", F.lit(". If values exceed 2000 characters, ORA-12899 'value too large for column' will occur at runtime. Consider setting explicit MaxLength or using NCLOB column type.")),
    )


def inferred_type(unicode: Column, max_length: Column) -> Column:
    """The column type that the provider infers: 2000 without a length, a large object beyond 4000."""
    kind = F.when(unicode, "NVARCHAR2").otherwise("VARCHAR2")
    large = F.when(unicode, "NCLOB").otherwise("CLOB")
    return F.when(max_length.isNull(), F.concat(kind, F.lit("(2000)"))).when(max_length > 4000, large).otherwise(F.concat(kind, F.lit("("), max_length.cast("string"), F.lit(")")))


# ---------------------------------------------------------------- dialects


Tests = list[tuple[Column, Column]]


def _with_upper(statements: DataFrame) -> DataFrame:
    """``upper_text``, made once for all tests."""
    return statements.withColumn("upper_text", F.upper("sql_text"))


def _each(statements: DataFrame, tests: Tests, rule: str) -> DataFrame:
    """A finding for every test that holds; one pass over the statements."""
    found = F.filter(F.array(*(F.when(test, message) for test, message in tests)), lambda m: m.isNotNull())
    return findings(_with_upper(statements).withColumn("m", F.explode(found)), rule, F.col("m"))


def _word(word: str) -> Column:
    """Whether a statement has a word; the pattern is tried where the letters are there at all."""
    return F.contains("upper_text", F.lit(word)) & F.col("sql_text").rlike(text.word_pattern(word))


def _oracle_elsewhere() -> Tests:
    words = [(_word(k), F.lit(f"Oracle-specific keyword '{k}' used in non-Oracle context")) for k in C.ORACLE_KEYWORDS]
    return words + [(F.contains("upper_text", F.lit(o)), F.lit(f"Oracle-specific operator '{o}' used in non-Oracle context")) for o in C.ORACLE_OPERATORS]


def _others_in_oracle() -> Tests:
    clause = lambda w: F.contains("upper_text", F.lit(w)) & F.col("sql_text").rlike(rf"(?i)(^|[^A-Za-z0-9_]){w}\s+\d+")
    return [(_word(k), F.lit(f"SQL Server-specific keyword '{k}' used in Oracle context")) for k in C.SQLSERVER_KEYWORDS] + [
        (clause("TOP"), F.lit("SQL Server TOP clause used in Oracle context (use FETCH FIRST n ROWS ONLY)")),
        (clause("LIMIT"), F.lit("LIMIT clause not supported in Oracle, use FETCH FIRST n ROWS ONLY")),
        (_word("GROUP_CONCAT"), F.lit("Non-Oracle function 'GROUP_CONCAT' used in Oracle context - use LISTAGG")),
    ]


def _exec_in_oracle() -> Tests:
    leak = F.contains("upper_text", F.lit("EXEC")) & F.col("sql_text").rlike(r"(?i)(^|[^A-Za-z0-9_])EXEC\s+\w+\.")
    return [(leak, F.lit("SQL Server EXEC dbo.Procedure syntax used in Oracle context. Use BEGIN ... END; block or CALL."))]


def _unmapped_types() -> Tests:
    return [(_word(t), F.lit(f"Type '{t}' used with Oracle EF Core raw SQL but not mapped by provider")) for t in C.UNMAPPED_TYPES]


def _first_foreign(words: tuple[str, ...], message: str) -> Tests:
    """The first of ``words`` that a statement holds; ``message`` has ``{}`` for it."""
    before, after = message.split("{}")
    found = text.first_of(F.col("upper_text"), words)
    return [(found.isNotNull(), F.concat(F.lit(before), found, F.lit(after)))]


#: Rules that look at one statement alone -> their tests.
STATEMENT_RULES = {
    "DG010": _oracle_elsewhere,
    "DG011": _others_in_oracle,
    "DG013": _exec_in_oracle,
    "DG014": _unmapped_types,
    "MY001": lambda: _first_foreign(C.MYSQL_ONLY, "MySQL-specific syntax '{}' used in non-MySQL context"),
    "MY002": lambda: _first_foreign(C.NOT_MYSQL, "Non-MySQL syntax '{}' used in MySQL context"),
    "PG001": lambda: _first_foreign(C.POSTGRES_ONLY, "PostgreSQL-specific syntax '{}' used in non-PostgreSQL context"),
    "PG002": lambda: _first_foreign(C.NOT_POSTGRES, "Non-PostgreSQL syntax '{}' used in PostgreSQL context"),
    "DG098": lambda: [(F.contains("upper_text", F.lit("SELECT")) & ~F.contains("upper_text", F.lit("FROM")), F.lit("Raw SQL query missing FROM clause"))],
    "DG099": lambda: [(text.contains_any(F.col("upper_text"), C.INJECTION_PATTERNS), F.lit("Potential SQL injection pattern detected"))],
    "DG101": lambda: [(F.col("sql_text").rlike(r"(?iU)^\s*(exec|execute) ") & (F.regexp_count("sql_text", F.lit(r"(?U)@\w+")) == 0), F.lit("Stored procedure call appears to have no parameters detected"))],
}


def statement_rules(statements: DataFrame, ids: tuple[str, ...]) -> DataFrame:
    """All findings of rules in ``STATEMENT_RULES``, in one pass over the statements."""
    tests = [(i, test, message) for i in ids for test, message in STATEMENT_RULES[i]()]
    made = F.array(*(F.when(test, F.struct(F.lit(i).alias("rule_id"), F.lit(C.RULES[i][0]).alias("severity"), message.alias("message"))) for i, test, message in tests))
    return _with_upper(statements).select("contract_id", F.explode(F.filter(made, lambda m: m.isNotNull())).alias("m")).select("contract_id", "m.*")


def _alone(rule: str):
    return lambda statements: _each(statements, STATEMENT_RULES[rule](), rule)


oracle_elsewhere = _alone("DG010")
others_in_oracle = _alone("DG011")
exec_in_oracle = _alone("DG013")
unmapped_types = _alone("DG014")
mysql_elsewhere = _alone("MY001")
others_in_mysql = _alone("MY002")
postgres_elsewhere = _alone("PG001")
others_in_postgres = _alone("PG002")
select_without_from = _alone("DG098")
injection = _alone("DG099")
call_without_parameters = _alone("DG101")


# ---------------------------------------------------------------- phantom names


def phantom_tables(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """Every reference to a table that neither the schema nor a common table expression knows."""
    known = columns.select(F.upper("table_name").alias("table_name")).distinct()
    ctes = sqltext.cte_names(statements).withColumnRenamed("name", "table_name")
    lost = sqltext.table_refs(statements).join(ctes, ["contract_id", "table_name"], "left_anti").join(known, "table_name", "left_anti")
    return findings(lost, "DG015", F.concat(F.lit("Table '"), "table_name", F.lit("' does not exist in database")))


def _unknown_columns(used: DataFrame, columns: DataFrame) -> DataFrame:
    """Of ``used(contract_id, table_name, column_name)`` what a table of the schema lacks: one join, with each table's set of columns."""
    sets = columns.groupBy(F.upper("table_name").alias("table_name")).agg(F.collect_set(F.upper("column_name")).alias("known"))
    lost = used.join(sets, "table_name").where(~F.array_contains("known", F.col("column_name")))
    return findings(lost, "DG016", F.concat(F.lit("Column '"), "column_name", F.lit("' does not exist in table '"), "table_name", F.lit("'")))


def phantom_qualified(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """``alias.column`` whose first table of that alias or name has no such column. Aliases are resolved inside each statement."""
    # One array of one struct: what it holds is parsed once, and the lambdas look at that.
    parsed = F.array(F.struct(sqltext.refs_of().alias("refs"), sqltext.qualified_of().alias("used")))

    def resolved(refs: Column, x: Column) -> Column:
        own = F.filter(refs, lambda r: (r["alias"] == x["qualifier"]) | (r["table_name"] == x["qualifier"]))
        return F.struct(F.try_element_at(own, F.lit(1))["table_name"].alias("table_name"), x["column_name"].alias("column_name"))

    found = F.flatten(F.transform(parsed, lambda s: F.transform(s["used"], lambda x: resolved(s["refs"], x))))
    used = statements.select("contract_id", F.explode(found).alias("x")).select("contract_id", "x.*").where("table_name is not null")
    return _unknown_columns(used, columns)


def phantom_selected(statements: DataFrame, columns: DataFrame) -> DataFrame:
    """Plain columns of the SELECT list that the statement's first table lacks."""
    first = statements.select(F.struct("contract_id", F.try_element_at(sqltext.refs_of(), F.lit(1))["table_name"].alias("table_name")).alias("contract_id"), "sql_text")
    used = sqltext.selected_columns(first.where("contract_id.table_name is not null")).select("contract_id.*", "column_name")
    return _unknown_columns(used, columns)


# ---------------------------------------------------------------- security


def audit_sources(sources: DataFrame) -> DataFrame:
    """``sources(target, source)``: how many issues of each kind, the score (100 less the penalties) and whether it is safe to deploy."""
    has = lambda s: F.contains("source", F.lit(s))
    like = lambda p: F.col("source").rlike(p)
    shell = like(r"(subprocess\.run|os\.system|os\.popen|Command::new)[^\n]*shell\s*=\s*True") | (has("subprocess") & has("shell=True"))
    dynamic = like(r"(^|[^A-Za-z0-9_])(eval|exec)\s*\(")
    request = like(r"(requests\.get|httpx\.get|reqwest::get)\s*\(\s*[a-zA-Z0-9_]+") & ~has("localhost") & ~has("allowed_domains")
    path = like(r"open\s*\(\s*[^\n]*(\.\./|os\.path\.join)") & ~has("canonicalize") & ~has("resolve")
    flag = lambda c: c.cast("int")
    score = F.greatest(F.lit(0), 100 - 40 * flag(shell) - 40 * flag(dynamic) - 20 * flag(request) - 10 * flag(path))
    tools = F.greatest(F.lit(1), F.regexp_count("source", F.lit("@mcp\\.tool")))
    return sources.select("target", flag(shell).alias("command_injection"), flag(dynamic).alias("dynamic_code"), flag(request).alias("request_forgery"), flag(path).alias("path_traversal"), score.alias("score"), ((score >= 70) & ~shell & ~dynamic).alias("is_safe"), tools.alias("tools"))


# What a line holds that looks like a secret.
SECRET_PATTERNS = {
    "github_token": r"ghp_[A-Za-z0-9]{20,}",
    "github_fine_token": r"github_pat_[A-Za-z0-9_]{20,}",
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "sk_key": r"sk-[A-Za-z0-9]{20,}",
    "slack_token": r"xox[baprs]-[A-Za-z0-9-]{10,}",
    "google_key": r"AIza[0-9A-Za-z_-]{35}",
    "private_key": r"-----BEGIN (RSA|OPENSSH|EC|PGP) PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    "quoted_value": r"""(api[_-]?key|secret|password|passwd|token)[ \t\r\f\v]*[:=][ \t\r\f\v]*["'][^"'\n]{8,}["']""",
    "plain_value": r"(api[_-]?key|secret|password|passwd|token)[ \t\r\f\v]*[:=][ \t\r\f\v]*[A-Za-z0-9+/]{16,}",
}
# Names of files that hold keys or settings.
SENSITIVE_NAMES = (r"\.env$", r"\.env\.", r"\.pem$", r"\.key$", r"\.p12$", r"\.pfx$", r"id_rsa$", r"id_ed25519$", r"\.p8$", r"\.ppk$", r"appsettings\.json$", r"appsettings\..*\.json$", r"\.crt$", r"\.cer$")
LARGE_FILE = 104857600


def find_secrets(sources: DataFrame) -> DataFrame:
    """(target, kind) for each kind of secret that a source shows. Patterns stay inside a line."""
    kinds = F.filter(F.array(*(F.when(F.col("source").rlike(p), F.lit(k)) for k, p in SECRET_PATTERNS.items())), lambda k: k.isNotNull())
    return sources.select("target", F.explode(kinds).alias("kind"))


def file_hygiene(files: DataFrame) -> DataFrame:
    """(path, problem) of ``files(path, size)``: names that hold secrets, and files beyond 100 MB."""
    sensitive = F.col("path").rlike("|".join(SENSITIVE_NAMES))
    found = F.filter(F.array(F.when(sensitive, "sensitive"), F.when(F.col("size") > LARGE_FILE, "large")), lambda p: p.isNotNull())
    return files.select("path", F.explode(found).alias("problem"))


CALL_KINDS = {"raw_query": ("FromSqlRaw", "FromSqlInterpolated"), "raw_command": ("ExecuteSqlRaw", "ExecuteSqlRawAsync", "ExecuteSqlInterpolated", "ExecuteSqlInterpolatedAsync")}


def call_kind(method: Column) -> Column:
    """What a call does with SQL, by its name; null if nothing."""
    exact = F.when(method.isin(*CALL_KINDS["raw_query"]), "raw_query").when(method.isin(*CALL_KINDS["raw_command"]), "raw_command")
    return exact.when(method.startswith("Query"), "query").when(method.startswith("Execute"), "execute")


#: Words that make a text a statement.
SQL_KEYWORDS = ("SELECT", "INSERT", "UPDATE", "DELETE", "EXEC", "BEGIN", "WITH", "MERGE")
_CALL = r'(?s)((?://[^\n]*\n\s*)*)[^\n;{}]*?\.(FromSqlRaw|FromSqlInterpolated|ExecuteSqlRaw|ExecuteSqlRawAsync|ExecuteSqlInterpolated|ExecuteSqlInterpolatedAsync|Query\w*|Execute\w*)(?:<[^>\n]*>)?\(\s*(?:[$@]*"((?:[^"\\]|\\.)*)")?'


def call_sites(sources: DataFrame, marker: str = "covenant:") -> DataFrame:
    """(target, ord, method, kind, sql_text) of calls in C# ``sources(target, source)`` that hand SQL over.

    A call counts if its first argument is a text with a word of SQL, or if its name is a query's or a command's of a mapper.
    A line comment before the statement that holds ``marker`` says that the call is known, and it is passed over; so are
    files whose namespace or first type has the attribute ``SkipContractCheck``.
    """
    sources = sources.where(~F.coalesce(F.col("source").rlike(r"(?s)\A[^{]*\[SkipContractCheck(Attribute)?(\(|\])"), F.lit(False)))
    group = lambda k: F.regexp_extract_all("source", F.lit(_CALL), F.lit(k))
    rows = sources.select("target", F.posexplode(F.arrays_zip(group(1).alias("note"), group(2).alias("method"), group(3).alias("sql"))).alias("ord", "x"))
    rows = rows.select("target", "ord", F.col("x.note").alias("note"), F.col("x.method").alias("method"), call_kind(F.col("x.method")).alias("kind"), F.coalesce("x.sql", F.lit("")).alias("sql_text"))
    says_sql = text.contains_any(F.col("sql_text"), SQL_KEYWORDS) | F.col("kind").isin("query", "execute")
    return rows.where(says_sql & ~F.contains("note", F.lit(marker))).drop("note")


def unvalidated_calls(sources: DataFrame, marker: str = "covenant:") -> DataFrame:
    """DG001 for every call site: (contract_id, rule_id, severity, message), the contract being the source."""
    return findings(call_sites(sources, marker).withColumnRenamed("target", "contract_id"), "DG001", F.concat(F.lit("SQL call '"), "method", F.lit("' not validated - run 'covenant validate' for full validation")))


def procedure_prefix(statements: DataFrame) -> DataFrame:
    """Calls of procedures, as far as leading white space hides it, must begin with EXEC or EXECUTE themselves."""
    call = F.col("sql_text").rlike(r"(?iU)^\s*(exec|execute) ")
    wrong = statements.where(call & ~F.col("sql_text").rlike(r"(?i)^(exec|execute) "))
    return wrong.select("contract_id", F.lit("DG002").alias("rule_id"), F.lit("Warning").alias("severity"), F.lit("Stored procedure call must start with EXEC or EXECUTE").alias("message"))


def provider_mismatch(contexts: DataFrame) -> DataFrame:
    """``contexts(contract_id, is_oracle, provider)``: DG012 where Oracle is used through another provider."""
    wrong = contexts.where(F.col("is_oracle") & ~F.contains(F.lower("provider"), F.lit("oracle")))
    return findings(wrong, "DG012", F.concat(F.lit("Oracle context detected but provider is '"), "provider", F.lit("'. Expected Oracle provider.")))


def schema_unmapped_types(columns: DataFrame) -> DataFrame:
    """DG014 of a whole schema, as one text of its types and names: one finding for each type at most, with the contract ''."""
    one = columns.select(F.concat_ws(" ", "data_type", "column_name").alias("t"))
    tests = F.array(*(F.struct(F.lit(t).alias("type"), F.max(F.coalesce(F.col("t").rlike(text.word_pattern(t)), F.lit(False)).cast("int")).alias("n")) for t in C.UNMAPPED_TYPES))
    hit = one.agg(F.filter(tests, lambda x: x["n"] == 1).alias("x")).select(F.explode("x").alias("x")).select(F.lit("").alias("contract_id"), F.col("x.type").alias("type"))
    return findings(hit, "DG014", F.concat(F.lit("Type '"), "type", F.lit("' used with Oracle EF Core raw SQL but not mapped by provider")))
