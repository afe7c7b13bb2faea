"""The engine: rules' findings united, counted, compared with a baseline, hashed and ordered."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from covenant.functions import text
from covenant.functions.constants import SAFE_PROPERTIES


def united(plans: list[DataFrame]) -> DataFrame:
    """All findings, repeats too."""
    return reduce(DataFrame.unionByName, plans)


def rollup(found: DataFrame) -> DataFrame:
    """Findings by severity, in all, and whether any is an error."""
    count = lambda s: F.count_if(F.col("severity") == s)
    return found.agg(count("Error").alias("errors"), count("Warning").alias("warnings"), count("Info").alias("infos"), F.count("*").alias("total"), F.coalesce(F.bool_or(F.col("severity") == "Error"), F.lit(False)).alias("has_errors"))


def per_contract(found: DataFrame) -> DataFrame:
    return found.groupBy("contract_id").agg(F.count("*").alias("findings"), F.count_if(F.col("severity") == "Error").alias("errors"))


def capped(found: DataFrame, most: int) -> DataFrame:
    """The first ``most`` findings by rule, message and contract: a top-k, which no executor holds whole."""
    return found.orderBy("rule_id", "message", "contract_id").limit(most)


def new_findings(found: DataFrame, baseline: DataFrame) -> DataFrame:
    """Findings whose rule and message the baseline lacks, each as often as found."""
    return found.join(baseline.select("rule_id", "message").distinct(), ["rule_id", "message"], "left_anti")


def _joined(key: Column, parts: Column, between: str) -> Column:
    """``parts`` in the order of ``key``, then their own."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key.alias("key"), parts.alias("part")))), lambda x: x["part"]), between)


def finding_hash(found: DataFrame, *by: str) -> DataFrame:
    """The first 16 hex digits of the SHA-256 of all ``rule:message``, by rule and then message, for each group of ``by`` (one contract, one run).

    The digest of a whole run is taken of its lines in order as they pass, whatever their number: ranges of the order are sorted apart, and one task,
    which holds a few pieces of text, reads them one after the other. A contract's digest covers one text, which must fit into a string (2 GB).
    Baselines of version 1 carry the same hash.
    """
    line = F.concat_ws(":", "rule_id", "message")
    if by:
        return found.groupBy(*by).agg(F.substring(text.sha256_upper(_joined(F.struct("rule_id", "message"), line, "|")), 1, 16).alias("finding_hash"))
    lines = found.select("rule_id", "message", line.alias("line")).sort("rule_id", "message", "line").select("line")
    pieces = lines.mapInArrow(_pieces, "part int, place int, piece binary")
    digest = pieces.repartition(1).sortWithinPartitions("part", "place").mapInArrow(_digest, "digest string").agg(F.max("digest"))
    return digest.select(F.coalesce(F.substring("max(digest)", 1, 16), F.substring(text.sha256_upper(F.lit("")), 1, 16)).alias("finding_hash"))


#: Bytes in a piece of a digest's text; the last line goes beyond it.
PIECE = 64 << 10


def _pieces(batches):
    """(part, place, piece): a sorted partition's lines, each with a ``|`` before it, put together to some ``PIECE`` bytes."""
    import pyarrow as pa
    from pyspark import TaskContext

    part, place, held, size = TaskContext.get().partitionId(), 0, [], 0

    def out():
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([place], pa.int32()), pa.array([b"".join(held)], pa.binary())], names=["part", "place", "piece"])

    for batch in batches:
        for line in batch.column(0).cast(pa.large_binary()).to_pylist():
            held += (b"|", line)
            size += 1 + len(line)
            if size >= PIECE:
                yield out()
                place, held, size = place + 1, [], 0
    if held:
        yield out()


def _digest(batches):
    """The SHA-256 of all pieces in order, without the first ``|``; no row without pieces."""
    import pyarrow as pa

    whole, first = hashlib.sha256(), 1
    for batch in batches:
        for piece in batch.column(2):
            whole.update(memoryview(piece.as_buffer())[first:])
            first = 0
    if not first:
        yield pa.RecordBatch.from_arrays([pa.array([whole.hexdigest().upper()])], names=["digest"])


def table_hash(columns: DataFrame) -> DataFrame:
    """(table_name, canonical): ``name{column;column}``, columns by name, each with type, nullability, length, precision and scale."""
    show = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null"))
    line = F.concat_ws(",", "column_name", "data_type", F.initcap(F.col("is_nullable").cast("string")), show("max_length"), show("precision"), show("scale"))
    return columns.groupBy("table_name").agg(F.concat("table_name", F.lit("{"), _joined(F.col("column_name"), line, ";"), F.lit("}")).alias("canonical"))


def schema_hash(columns: DataFrame) -> DataFrame:
    """One digest of all tables by name: one text of the whole schema, which is a catalogue, not data."""
    return table_hash(columns).agg(text.sha256_upper(_joined(F.col("table_name"), F.col("canonical"), "|")).alias("schema_hash"))


def schema_totals(columns: DataFrame) -> DataFrame:
    """How many tables and columns a schema has."""
    return columns.agg(F.count_distinct("table_name").alias("tables"), F.count("*").alias("columns"))


def drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that came, went or changed type, length or nullability between two snapshots."""
    keys = ["table_name", "column_name"]
    shape = ["data_type", "max_length", "is_nullable"]
    a = before.select(*keys, F.struct(*shape).alias("was"))
    b = after.select(*keys, F.struct(*shape).alias("is"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("is").isNull(), "removed").when(~F.col("was").eqNullSafe(F.col("is")), "changed")
    return a.join(b, keys, "full").withColumn("change", change).where("change is not null").select(*keys, "change")


def sarif_rules(found: DataFrame) -> DataFrame:
    """Each rule with its first message, redacted, as description, what stands before a colon in that as name, and its first severity's level; first by ``ord``."""
    place = F.struct("ord", "message", "severity")
    first = found.groupBy("rule_id").agg(F.min_by("message", place).alias("message"), F.min_by("severity", place).alias("severity"))
    shown = text.redact_sarif(F.coalesce("message", F.lit("")))
    return first.select("rule_id", F.split(shown, ":")[0].alias("name"), shown.alias("description"), text.sarif_level(F.col("severity")).alias("level"))


def sarif_results(found: DataFrame) -> DataFrame:
    return found.select("ord", F.col("rule_id").alias("rule"), text.sarif_level(F.col("severity")).alias("level"), text.redact_sarif(F.col("message")).alias("message"))


def safe_properties(properties: Column) -> Column:
    """Entries of a map whose key is allowed and whose value is null or shows no secret."""
    return F.map_filter(properties, lambda k, v: k.isin(*SAFE_PROPERTIES) & F.coalesce(text.redact_sarif(v) == v, F.lit(True)))


def numbered(rows: DataFrame, *order: str, name: str = "place", parts: int | None = None) -> DataFrame:
    """``rows`` with their place (from 1) in the order of all, in column ``name``.

    Rows go into ranges of the order, whose bounds are taken from a sample by hash, of some 32 rows to a range (which changes the work, not the places); a
    task numbers a range's rows, and each range is moved on by the sizes of those before it. So no task holds all rows of a value, however common.
    ``order`` must tell all rows apart.
    """
    parts = parts or 2 * int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key = F.struct(*order)
    each = max(1, rows.count() // (32 * parts))
    sample = sorted(map(tuple, rows.select(*order).where(F.pmod(F.xxhash64(*order), F.lit(each)) == 0).na.drop().collect()))
    bounds = sample[:: max(1, len(sample) // parts)][1:parts]
    # How many bounds a row reaches: a binary search in one literal, so that the expression is as deep for a thousand bounds as for one.
    part = F.lit(0)
    if bounds:
        listed = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(b, order, strict=True))) for b in bounds)).cast(ArrayType(rows.select(*order).schema))
        strides = F.array(*(F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))))
        search = lambda k: F.aggregate(strides, F.lit(0), lambda at, stride: F.when(F.get(listed, at + stride - 1) <= k, at + stride).otherwise(at))
        part = F.get(F.transform(F.array(key), search), 0)  # the key is made once for a row, not at each step
    inside = rows.withColumn("__part", part).withColumn("__in", F.row_number().over(Window.partitionBy("__part").orderBy(*order)))
    sizes = rows.select(part.alias("__part")).groupBy("__part").agg(F.count("*").alias("n"))
    before = sizes.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("__before"))
    return inside.join(F.broadcast(before), "__part").withColumn(name, F.col("__in") + F.col("__before")).drop("__part", "__in", "__before")


def evidence(found: DataFrame) -> DataFrame:
    """Redacted findings with their place in the total order (rule, severity, message, ord)."""
    shown = found.select("ord", "rule_id", text.evidence_severity(F.col("severity")).alias("severity"), text.redact_evidence(F.col("message")).alias("message"))
    return numbered(shown, "rule_id", "severity", "message", "ord")


def all_passed(checks: DataFrame) -> DataFrame:
    """``checks(name, passed)``: whether all passed (none is all), how many failed, and a line that says so."""
    failed = F.count_if(~F.col("passed"))
    summary = F.when(failed == 0, F.concat(F.lit("All "), F.count("*").cast("string"), F.lit(" checks passed"))).otherwise(F.concat(failed.cast("string"), F.lit(" of "), F.count("*").cast("string"), F.lit(" checks failed")))
    return checks.agg((failed == 0).alias("overall_passed"), failed.alias("failed"), summary.alias("summary"))


def first_in(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__r = 1").drop("__r")
