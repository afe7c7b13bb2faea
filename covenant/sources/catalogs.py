"""Sources that are databases' catalogues: exported tables or JDBC, read as DataFrames and joined by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from covenant.functions import text


def table(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] | None = None, parts: int = 8) -> DataFrame:
    """A catalogue table over JDBC, in ``parts`` ranges of a numeric key if one is named; filters go to the database."""
    reader = spark.read.format("jdbc").option("url", url).option("dbtable", name)
    if key and bounds:
        reader = reader.option("partitionColumn", key).option("lowerBound", bounds[0]).option("upperBound", bounds[1]).option("numPartitions", parts)
    return reader.load()


def sqlserver_parameters(procedures: DataFrame, schemas: DataFrame, parameters: DataFrame, types: DataFrame) -> DataFrame:
    """Parameters of users' procedures in one set of joins: -1 is no length, and an output parameter can be read too."""
    own = procedures.where("is_ms_shipped = 0").join(schemas.select("schema_id", F.col("name").alias("schema_name")), "schema_id")
    rows = own.select("object_id", "schema_name", F.col("name").alias("procedure_name")).join(parameters.withColumnRenamed("name", "parameter_name"), "object_id").join(types.select("user_type_id", F.col("name").alias("data_type")), "user_type_id")
    return rows.select("schema_name", "procedure_name", F.col("parameter_id").alias("ord"), F.col("parameter_name").alias("name"), "data_type", F.when(F.col("max_length") != -1, F.col("max_length")).alias("max_length"), "precision", "scale", F.when(F.col("is_output"), "InputOutput").otherwise("Input").alias("direction"))


def oracle_arguments(arguments: DataFrame, owner: str, package: str | None = None) -> DataFrame:
    """Arguments of an owner's (and package's) procedures: named, of a place above 0; an object type goes by its full name."""
    rows = arguments.where((F.upper("owner") == owner.upper()) & (F.col("position") > 0) & F.col("argument_name").isNotNull())
    if package:
        rows = rows.where(F.upper("package_name") == package.upper())
    custom = F.concat_ws(".", F.nullif("type_owner", F.lit("")), F.nullif("type_name", F.lit("")), F.nullif("type_subname", F.lit("")))
    return rows.select("package_name", "object_name", F.col("argument_name").alias("name"), F.coalesce(F.nullif(custom, F.lit("")), F.col("data_type")).alias("data_type"), text.direction(F.col("in_out")).alias("direction"), "data_length", "position", "sequence", F.coalesce(F.col("subprogram_id"), F.col("overload").try_cast("int"), F.lit(0)).alias("overload_key"))


def procedure_names(arguments: DataFrame, owner: str, package: str | None = None) -> DataFrame:
    """The names of an owner's (and package's) procedures, once each and in order."""
    rows = arguments.where(F.upper("owner") == owner.upper())
    if package:
        rows = rows.where(F.upper("package_name") == package.upper())
    return rows.select("object_name").distinct().orderBy("object_name")


#: Errors of a description that say a procedure gives no rows of one known shape.
NO_RESULT_SET = (11512, 11513)


def result_columns(described: DataFrame) -> DataFrame:
    """Columns of procedures' first result sets from ``described(procedure_name, ordinal, name, system_type_name, is_nullable, error_number)``; a procedure without one has none, any other error is raised."""
    known = described.where(F.col("error_number").isNull() | ~F.col("error_number").isin(*NO_RESULT_SET))
    checked = F.when(F.col("error_number").isNull(), F.col("name")).otherwise(F.raise_error(F.concat(F.lit("description failed: "), F.col("error_number").cast("string"))))
    return known.select("procedure_name", F.col("ordinal").alias("ord"), checked.alias("name"), F.col("system_type_name").alias("data_type"), "is_nullable")


def oracle_columns(columns: DataFrame, owner: str) -> DataFrame:
    """Columns of an owner's tables, with their places."""
    own = columns.where(F.upper("owner") == owner.upper())
    return own.select("table_name", "column_name", "data_type", F.col("data_length").alias("max_length"), "char_length", F.col("data_precision").alias("precision"), F.col("data_scale").alias("scale"), (F.col("nullable") == "Y").alias("is_nullable"), "char_used", F.col("column_id").alias("col_ord"))


def routine_parameters(routines: DataFrame, parameters: DataFrame, schema: str | None = None, keep_empty: bool = False) -> DataFrame:
    """Routines of an information schema with their parameters; routines without any stay only if ``keep_empty``, and an overload is its specific name's."""
    own = routines.where(F.upper("routine_type") == "PROCEDURE")
    if schema:
        own = own.where(F.lower("routine_schema") == schema.lower())
    joined = own.join(parameters, ["specific_schema", "specific_name"], "left" if keep_empty else "inner")
    return joined.select(text.full_name(F.col("routine_schema"), F.col("routine_name")).alias("procedure_name"), "specific_name", F.col("ordinal_position").alias("ord"), F.col("parameter_name").alias("name"), "data_type", text.direction(F.coalesce("parameter_mode", F.lit("IN"))).alias("direction"), F.when(F.col("character_maximum_length") <= 2147483647, F.col("character_maximum_length")).cast("int").alias("max_length"))


def length_semantics(parameters: DataFrame) -> str:
    """CHAR if the session says so, else BYTE."""
    row = parameters.where("parameter = 'NLS_LENGTH_SEMANTICS'").select(F.upper("value")).first()
    return "CHAR" if row and row[0] == "CHAR" else "BYTE"


def frame_properties(df: DataFrame, entity: str) -> DataFrame:
    """The properties of an entity whose model is a DataFrame: its columns, their types, and ``max_length`` where a field's metadata names one."""
    rows = [(entity, k, f.name, f.metadata.get("column", f.name), f.dataType.simpleString(), f.nullable, f.metadata.get("max_length")) for k, f in enumerate(df.schema)]
    return df.sparkSession.createDataFrame(rows, "entity string, ord int, name string, column_name string, clr_type string, is_nullable boolean, max_length int")


def spark_columns(spark: SparkSession, database: str = "default") -> DataFrame:
    """The columns of a Spark catalogue's tables: as many rows as its schema has columns."""
    rows = [(t.name.upper(), i, c.name.upper(), j, c.dataType, bool(c.nullable)) for i, t in enumerate(spark.catalog.listTables(database)) for j, c in enumerate(spark.catalog.listColumns(t.name, database))]
    return spark.createDataFrame(rows, "table_name string, table_ord int, column_name string, col_ord int, data_type string, is_nullable boolean")
