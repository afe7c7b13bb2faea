"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import sys
import time

os.environ.setdefault("PYSPARK_PYTHON", sys.executable)

from pyspark.sql import DataFrame, SparkSession  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from covenant.operators import engine, rules  # noqa: E402
from covenant.plans import catalogue  # noqa: E402
from covenant.plans.views import view  # noqa: E402

HEADLINE = (
    "dg101_exec_no_params",
    "dg002_type_mismatch",
    "dg003_direction",
    "dg007_length",
    "dg010_oracle_tokens",
    "dg015_phantom_table",
    "dg016_phantom_column",
    "baseline_new_only",
    "finding_hash",
    "schema_hash",
    "sarif_results",
    "evidence_order",
    "audit_verify_lag",
    "breaker_islands",
    "eci_tiers_topk",
    "secret_scan",
)
#: Contracts of the fixed small workload.
SMALL = 1000


def noop(df: DataFrame) -> None:
    df.write.format("noop").mode("overwrite").save()


def timed(df: DataFrame, runs: int = 3) -> float:
    """Seconds of the best of some runs after a first one."""
    noop(df)
    best = float("inf")
    for _ in range(runs):
        began = time.time()
        noop(df)
        best = min(best, time.time() - began)
    return round(best, 3)


def two_rules(statements: DataFrame, parameters: DataFrame) -> DataFrame:
    """The mix that is compared with: a rule on every call and a rule on every parameter."""
    return engine.united([rules.call_without_parameters(statements), rules.parameter_types(parameters)])


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    noop(catalogue.flagship(spark, sf_dir))  # starts the session
    taken = {}
    for name in HEADLINE:
        began = time.time()
        noop(catalogue.queries()[name](spark, sf_dir))
        taken[name] = round(time.time() - began, 3)
    # Rows at hand, as an in-process engine has them: one small file would be one task.
    statements = view(spark, sf_dir, "statements").repartition(int(cpus)).cache()
    parameters = view(spark, sf_dir, "parameters").repartition(int(cpus), "contract_id").cache()
    contracts, rows = statements.count(), parameters.count()
    ids = tuple(rules.STATEMENT_RULES)
    taken["all_statement_rules"] = timed(rules.statement_rules(statements, ids))
    mix = timed(two_rules(statements, parameters))
    few = statements.limit(SMALL).coalesce(1).cache()
    few_parameters = parameters.join(F.broadcast(few.select("contract_id")), "contract_id", "left_semi").coalesce(1).cache()
    few.count(), few_parameters.count()
    taken["two_rules"], taken["two_rules_1000_contracts"] = mix, timed(two_rules(few, few_parameters))
    out = {"metric": "sum of headline queries", "value": round(sum(taken[k] for k in (*HEADLINE, "all_statement_rules")), 3), "unit": "sec", "queries": taken, "sf": sf_dir}
    out |= {"rule_evaluations_per_second": round(contracts * len(ids) / taken["all_statement_rules"]), "two_rule_evaluations_per_second": round((contracts + rows) / mix)}
    print(json.dumps(out))


if __name__ == "__main__":
    main()
