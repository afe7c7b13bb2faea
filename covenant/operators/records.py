"""Logs, telemetry, catalogues and scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from covenant.functions import text
from covenant.functions.constants import DBMS_NATIONAL_CODES, DBMS_TYPE_CODES

# ---------------------------------------------------------------- audit log


def chained(entries: DataFrame) -> DataFrame:
    """``entries(log_id, seq, content)`` with ``hash`` and ``previous_hash``: each hash covers the one before.

    A chain is sequential by its nature: logs go side by side, and a task passes through its logs in order
    with one hash in hand. A null content counts as empty.
    """
    import hashlib

    import pyarrow as pa

    def run(batches):
        log, last = None, None
        for batch in batches:
            hashes, before = [], []
            for log_id, content in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if log_id != log:
                    log, last = log_id, None
                before.append(last)
                last = hashlib.sha256(((last or "") + (content or "")).encode()).hexdigest().upper()
                hashes.append(last)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(before, pa.string()), pa.array(hashes, pa.string())], names=["log_id", "seq", "content", "previous_hash", "hash"])

    rows = entries.select(F.col("log_id").cast("long").alias("log_id"), F.col("seq").cast("long").alias("seq"), "content")
    return rows.repartition("log_id").sortWithinPartitions("log_id", "seq").mapInArrow(run, "log_id long, seq long, content string, previous_hash string, hash string")


def broken_links(log: DataFrame) -> DataFrame:
    """Entries of ``log(log_id, seq, content, hash)`` whose hash isn't that of the entry before and their content. Checking, unlike building, needs the neighbour alone."""
    before = F.coalesce(F.lag("hash").over(Window.partitionBy("log_id").orderBy("seq")), F.lit(""))
    return log.withColumn("expected", text.sha256_upper(F.concat(before, "content"))).where("hash <> expected").select("log_id", "seq")


def cut_logs(log: DataFrame, checkpoints: DataFrame) -> DataFrame:
    """Logs whose last hash isn't the checkpoint's."""
    last = log.groupBy("log_id").agg(F.max_by("hash", "seq").alias("hash"))
    return checkpoints.join(last, "log_id", "left").where(~F.col("checkpoint").eqNullSafe(F.col("hash"))).select("log_id")


def database_operation(rows: DataFrame) -> DataFrame:
    """Audit entries of ``rows(ts, operation, provider, connection, details, success, error)``; the connection goes in as a hash."""
    return _entries(rows, "DatabaseOperation", F.col("operation"), F.col("provider"), text.sha256_upper(F.col("connection")), F.col("details"), F.col("success"), F.col("error"))


def credential_access(rows: DataFrame) -> DataFrame:
    """Audit entries of ``rows(ts, operation, provider, connection)``."""
    return _entries(rows, "CredentialAccess", F.col("operation"), F.col("provider"), text.sha256_upper(F.col("connection")), F.concat(F.lit("Credential access: "), "operation"))


def configuration_change(rows: DataFrame, application: str = "covenant") -> DataFrame:
    """Audit entries of ``rows(ts, setting, old, new)``; values are masked."""
    details = F.concat(F.lit("Setting: "), "setting", F.lit(", Old: "), text.mask_value(F.col("old")), F.lit(", New: "), text.mask_value(F.col("new")))
    return _entries(rows, "ConfigurationChange", F.lit("SettingChanged"), F.lit(application), F.lit(""), details)


def _entries(rows: DataFrame, kind: str, operation: Column, provider: Column, connection: Column, details: Column, success: Column | None = None, error: Column | None = None) -> DataFrame:
    return rows.select(
        "ts",
        F.lit(kind).alias("event_type"),
        operation.alias("operation"),
        provider.alias("provider"),
        connection.alias("connection_hash"),
        details.alias("details"),
        (F.lit(True) if success is None else success).alias("success"),
        (F.lit(None).cast("string") if error is None else error).alias("error"),
    )


# ---------------------------------------------------------------- telemetry


def counters(events: DataFrame) -> DataFrame:
    return events.groupBy("name", "tags").agg(F.sum("value").alias("value"), F.count("*").alias("n"))


def histograms(events: DataFrame) -> DataFrame:
    return events.groupBy("name").agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"), F.percentile("value", F.lit(0.5)).alias("median"))


def rule_executions(runs: DataFrame) -> DataFrame:
    """Metrics (name, tags, value) of ``runs(rule_id, success, milliseconds)``: an execution counted and timed for each."""
    tags = F.concat(F.lit("rule="), "rule_id", F.lit(",success="), F.initcap(F.col("success").cast("string")))
    made = F.array(F.struct(F.lit("rule.executions").alias("name"), F.lit(1.0).alias("value")), F.struct(F.lit("rule.duration").alias("name"), F.col("milliseconds").cast("double").alias("value")))
    return runs.select(tags.alias("tags"), F.explode(made).alias("m")).select("m.name", "tags", "m.value")


def validation_summary(found: DataFrame, contracts: int, milliseconds: float) -> DataFrame:
    """Metrics (name, tags, value) of one run."""
    count = lambda s: F.count_if(F.col("severity") == s).cast("double")
    values = (("validations.total", F.lit(1.0)), ("violations.total", F.count("*").cast("double")), ("violations.errors", count("Error")), ("violations.warnings", count("Warning")), ("validation.contracts", F.lit(float(contracts))), ("validation.duration", F.lit(float(milliseconds))))
    row = found.agg(F.array(*(F.struct(F.lit(n).alias("name"), F.lit("").alias("tags"), v.alias("value")) for n, v in values)).alias("m"))
    return row.select(F.inline("m"))


def windows(events: DataFrame, width: str = "1 hour") -> DataFrame:
    return events.groupBy(F.window("ts", width).alias("w"), "name").agg(F.count("*").alias("n")).select(F.col("w.start").cast("string").alias("window_start"), "name", "n")


def failures_in_a_row(events: DataFrame, by: str = "source", segment: int = 100_000) -> DataFrame:
    """Each event with how many failures end with it in a row; a success starts anew. ``open`` says three or more.

    A source's events are cut into segments of ``segment`` numbers, which tasks count side by side. A segment's
    outcome is two numbers, failures behind its last success and whether it has one; what it takes over from those
    before it comes from these alone, so one busy source isn't one task's work.
    """
    cut = events.withColumn("__segment", F.floor(F.col("seq") / segment))
    order = Window.partitionBy(by, "__segment").orderBy("seq")
    place = F.row_number().over(order)
    marked = cut.withColumn("__n", place).withColumn("__last", F.max(F.when(F.col("ok"), F.col("__n"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    outcome = cut.groupBy(by, "__segment").agg(F.bool_or("ok").alias("any_ok"), F.count("*").alias("n"), F.max_by(F.col("seq"), F.when(F.col("ok"), F.col("seq"))).alias("last_ok"))
    behind = cut.join(outcome.select(by, "__segment", "last_ok"), [by, "__segment"]).groupBy(by, "__segment").agg(F.count_if(F.col("last_ok").isNull() | (F.col("seq") > F.col("last_ok"))).alias("behind"))
    by_source = Window.partitionBy(by).orderBy("__segment")
    runs = outcome.join(behind, [by, "__segment"]).withColumn("run", F.sum(F.col("any_ok").cast("int")).over(by_source.rowsBetween(Window.unboundedPreceding, 0)))
    ended = runs.withColumn("ended", F.sum("behind").over(Window.partitionBy(by, "run").orderBy("__segment").rowsBetween(Window.unboundedPreceding, 0)))
    taken = ended.select(by, "__segment", F.coalesce(F.lag("ended").over(by_source), F.lit(0)).alias("__taken"))
    failures = F.when(F.col("__last").isNull(), F.col("__n") + F.col("__taken")).otherwise(F.col("__n") - F.col("__last")).cast("long")
    return marked.join(taken, [by, "__segment"]).withColumn("failures", failures).withColumn("open", F.col("failures") >= 3).drop("__segment", "__n", "__last", "__taken")


# ---------------------------------------------------------------- catalogues


def routines(procedures: DataFrame, parameters: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Every routine with its parameters; those without any only if ``keep_empty``. Lengths beyond 32 bits are unknown."""
    size = F.when(F.col("max_length") <= 2147483647, F.col("max_length"))
    joined = procedures.join(parameters, ["schema_name", "specific_name"], "left" if keep_empty else "inner")
    return joined.select("schema_name", "specific_name", "parameter_name", text.direction(F.col("mode")).alias("direction"), size.cast("long").alias("max_length"))


def overloads(arguments: DataFrame) -> DataFrame:
    """Arguments by overload (the subprogram id, else the overload number), their names in order of sequence."""
    key = F.coalesce(F.col("subprogram_id"), F.col("overload").try_cast("int"), F.lit(0))
    names = F.transform(F.array_sort(F.collect_list(F.struct("sequence", "argument_name"))), lambda x: x["argument_name"])
    return arguments.groupBy("object_name", key.cast("long").alias("overload_key")).agg(F.array_join(names, ",").alias("arguments"), F.count("*").alias("n"))


NLS = ("NLS_LENGTH_SEMANTICS", "NLS_CHARACTERSET", "NLS_NCHAR_CHARACTERSET", "NLS_DATE_FORMAT", "NLS_TERRITORY")


def nls_settings(parameters: DataFrame) -> DataFrame:
    """One row for each session: a column for each setting, UNKNOWN if it isn't there."""
    wide = parameters.where(F.col("parameter").isin(*NLS)).groupBy("session_id").pivot("parameter", list(NLS)).agg(F.first("value"))
    return wide.select("session_id", *(F.coalesce(n, F.lit("UNKNOWN")).alias(n.lower()) for n in NLS))


def version_banner(banner: Column) -> tuple[Column, Column]:
    """Version and edition of a database's banner."""
    version = F.coalesce(F.nullif(F.regexp_extract(banner, r"Release (\d+\.\d+\.\d+\.\d+\.\d+)", 1), F.lit("")), F.lit("UNKNOWN"))
    edition = F.when(banner.contains("Enterprise"), "Enterprise").when(banner.contains("Standard"), "Standard").when(banner.contains("Express"), "Express").otherwise("Unknown")
    return version, edition


def dbms_type(code: Column, charset_form: Column) -> Column:
    table = lambda t: F.create_map(*(F.lit(x) for kv in t.items() for x in kv))
    national = F.when(charset_form == 2, F.try_element_at(table(DBMS_NATIONAL_CODES), code))
    return F.coalesce(national, F.try_element_at(table(DBMS_TYPE_CODES), code), F.lit("UNKNOWN"))


def naming_vote(sources: DataFrame) -> DataFrame:
    """The naming convention of a whole corpus: one form must be seen more than twice as often as the other."""
    seen = sources.agg(F.sum(F.regexp_count("source", F.lit(r"[a-z]+_[a-z]+"))).alias("snake"), F.sum(F.regexp_count("source", F.lit(r"[A-Z][a-z]+[A-Z][a-z]+"))).alias("pascal"))
    return seen.select("snake", "pascal", F.when(F.col("snake") > 2 * F.col("pascal"), "snake_case").when(F.col("pascal") > 2 * F.col("snake"), "PascalCase").alias("convention"))


# ---------------------------------------------------------------- criticality of repositories


#: The two models of the index: factor of the dependents' logarithm, factor of stale issues, and where the tiers begin.
MODELS = {"radar": (2.5, 3.0, (70, 45, 25)), "research": (2.0, 2.5, (75, 50, 30))}
TIERS = ("TIER_1_CRITICAL_EMERGENCY", "TIER_2_HIGH_URGENCY", "TIER_3_MODERATE", "TIER_4_STABLE")


def eci(dependents: Column, maintainers: Column, stale: Column, days: Column, vulnerabilities: Column, has_mcp: Column, model: str = "radar") -> Column:
    """The criticality index, 0 to 100, of two decimals."""
    wide, old, _ = MODELS[model]
    reach = F.least(F.log10(F.greatest(dependents, F.lit(1)) + F.lit(1.0)) * wide, F.lit(10.0)) * 10
    decay = F.least(stale / F.greatest(maintainers, F.lit(1)) * old + days / F.lit(3.0), F.lit(100.0))
    holes = F.least(vulnerabilities * F.lit(25.0), F.lit(100.0))
    gap = F.when(has_mcp, 0.0).otherwise(100.0)
    total = F.least(F.greatest(0.35 * reach + 0.25 * decay + 0.25 * holes + 0.15 * gap, F.lit(0.0)), F.lit(100.0))
    return F.floor(total * 100 + 0.5) / 100


def eci_tier(score: Column, model: str = "radar") -> Column:
    first, second, third = MODELS[model][2]
    return F.when(score >= first, 1).when(score >= second, 2).when(score >= third, 3).otherwise(4)


def action(tier: Column, has_mcp: Column) -> Column:
    """What a tier calls for."""
    urgent = F.when(~has_mcp, "Deploy FastMCP Bridge Builder to generate standardized AI connector.").otherwise("Run TriageAgent to deconstruct stale bug threads.")
    return F.when(tier == 1, "Trigger autonomous Claude 3.7 Triage Swarm & Generate High-Priority Patch PR.").when(tier == 2, urgent).when(tier == 3, "Monitor weekly on telemetry radar.").otherwise("Routine periodic indexing.")


def tier_name(tier: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, TIERS)), tier)


def diagnosis(dependents: Column, maintainers: Column, stale: Column, vulnerabilities: Column, has_mcp: Column) -> Column:
    parts = F.concat_ws(
        "; ",
        F.when(maintainers <= 1, F.concat(F.lit("Single maintainer sustaining "), dependents.cast("string"), F.lit(" downstream packages"))),
        F.when(stale > 15, F.concat(F.lit("High issue backlog ("), stale.cast("string"), F.lit(" unassigned issues)"))),
        F.when(~has_mcp, F.lit("Missing Model Context Protocol bridge for AI integration")),
        F.when(vulnerabilities > 0, F.concat(F.lit("Unpatched security advisories ("), vulnerabilities.cast("string"), F.lit(" CVEs)"))),
    )
    return F.when(parts == "", "Healthy baseline state.").otherwise(parts)


def ranked(repos: DataFrame, most: int) -> DataFrame:
    """The ``most`` repositories of greatest score, of equals the first by ``ord`` (their place in the input) or else by name."""
    return repos.orderBy(F.desc("score"), "ord" if "ord" in repos.columns else "repo").limit(most)


def filled(seeds: DataFrame, limit: int) -> DataFrame:
    """``seeds`` and, if they are fewer than ``limit``, made-up rows up to it."""
    missing = limit - seeds.limit(limit).count()
    return seeds if missing <= 0 else seeds.unionByName(synthetic_repos(seeds.sparkSession, missing), allowMissingColumns=True)


def repo_metrics(payloads: DataFrame, now: Column) -> DataFrame:
    """``payloads(repo, body)``, answers of a repository service as JSON: stars, open issues and days since the last push; a body that can't be read gives 0, 0 and 30."""
    fields = F.from_json("body", "stargazers_count bigint, open_issues_count bigint, pushed_at string")
    rows = payloads.select("repo", fields.alias("b"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    return rows.select("repo", zero("b.stargazers_count").alias("stars"), zero("b.open_issues_count").alias("stale"), text.days_since(F.col("b.pushed_at"), now).alias("days"))


def radar_lines(repos: DataFrame) -> DataFrame:
    """A line for each of ``repos(repo, score, tier, diagnosis)``."""
    return repos.select(F.format_string("%-40s %6.2f  %-26s %s", "repo", F.col("score").cast("double"), tier_name(F.col("tier")), "diagnosis").alias("value"))


def synthetic_repos(spark, needed: int) -> DataFrame:
    """Rows that fill a category up: i from 1 to ``needed``."""
    i = F.col("i")
    return spark.range(1, needed + 1).withColumnRenamed("id", "i").select(F.concat(F.lit("synthetic-"), i.cast("string")).alias("repo"), (650 * i).alias("dependents"), F.lit(1).cast("long").alias("maintainers"), (10 + 3 * i).alias("stale"), (45 + 15 * i).alias("days"), (i % 2 == 0).cast("long").alias("vulnerabilities"), (i == 3).alias("has_mcp"))
