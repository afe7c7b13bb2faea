"""Contracts that classes declare by decorators, as tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

DIRECTIONS = ("Input", "Output", "InputOutput", "ReturnValue")


def skip_contract_check(target):
    """Leaves a class or function out of all checks."""
    target.__contract_skip__ = True
    return target


def expected_column(name: str, column: str | None = None, kind: str = "string", max_length: int = 0, nullable: bool = True, table: str | None = None) -> Callable[[type], type]:
    """Declares a property of a class and its column; decorators that stand first come first."""

    def declare(cls: type) -> type:
        cls.__contract_columns__ = [(name, column or name, kind, max_length or None, nullable, table), *cls.__dict__.get("__contract_columns__", [])]
        return cls

    return declare


def expected_parameter(procedure: str, name: str, kind: str, direction: str = "Input", max_length: int = 0) -> Callable[[type], type]:
    """Declares a parameter of a stored procedure."""
    if direction not in DIRECTIONS:
        raise ValueError(f"direction: one of {', '.join(DIRECTIONS)}")

    def declare(cls: type) -> type:
        cls.__contract_parameters__ = [(procedure, name, kind, direction, max_length or None), *cls.__dict__.get("__contract_parameters__", [])]
        return cls

    return declare


def declared(spark: SparkSession, classes: list[type]) -> tuple[DataFrame, DataFrame]:
    """(properties, parameters) that ``classes`` declare, but for those that are skipped; a length of 0 is none."""
    kept = [c for c in classes if not getattr(c, "__contract_skip__", False)]
    columns = [(c.__name__, k, *row) for c in kept for k, row in enumerate(c.__dict__.get("__contract_columns__", []))]
    parameters = [(row[0], k, *row[1:]) for c in kept for k, row in enumerate(c.__dict__.get("__contract_parameters__", []))]
    properties = spark.createDataFrame(columns, "entity string, ord int, name string, column_name string, clr_type string, max_length int, is_nullable boolean, table_name string")
    return properties, spark.createDataFrame(parameters, "procedure_name string, ord int, name string, data_type string, direction string, max_length int")
