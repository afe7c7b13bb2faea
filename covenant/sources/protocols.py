"""Line protocols: JSON-RPC requests, a line of JSON each, read from a table or a stream and answered line by line."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VERSION = "2024-11-05"
#: Methods that are answered -> the result, as JSON. Tools are what the engine offers to a client.
RESULTS = {
    "initialize": f'{{"protocolVersion":"{VERSION}","capabilities":{{"tools":{{}}}},"serverInfo":{{"name":"covenant"}}}}',
    "ping": "{}",
    "tools/list": '{"tools":[{"name":"scan_category"},{"name":"audit_source"}]}',
}


def requests(lines: DataFrame) -> DataFrame:
    """``lines(value, ...)`` that are requests or notifications, with ``method``, ``id`` (its JSON; null for a notification) and ``params``. Blank lines and what can't be read are dropped."""
    rest = [c for c in lines.columns if c != "value"]
    rows = lines.where(F.trim("value") != "").select(*rest, F.try_parse_json("value").alias("v"))
    part = lambda k: F.to_json(F.try_variant_get("v", f"$.{k}", "variant"))
    return rows.select(*rest, F.try_variant_get("v", "$.method", "string").alias("method"), part("id").alias("id"), part("params").alias("params")).where("method is not null")


def responses(rows: DataFrame) -> DataFrame:
    """A line for each request of ``requests``; notifications get none, unknown methods an error. Each line stands alone, so a stream needs no state."""
    known = F.create_map(*(F.lit(x) for kv in RESULTS.items() for x in kv))
    result = F.try_element_at(known, F.col("method"))
    error = F.to_json(F.struct(F.lit(-32601).alias("code"), F.concat(F.lit("Method not found: "), "method").alias("message")))
    body = F.when(result.isNotNull(), F.concat(F.lit('"result":'), result)).otherwise(F.concat(F.lit('"error":'), error))
    line = F.concat(F.lit('{"jsonrpc":"2.0","id":'), "id", F.lit(","), body, F.lit("}"))
    return rows.where("id is not null").withColumn("value", line).drop("method", "id", "params")
