"""Names, lists and texts that results must carry exactly."""

ORACLE_KEYWORDS = ("DECODE", "NVL", "NVL2", "DUAL", "ROWNUM", "CONNECT BY", "START WITH", "SYSDATE", "SYSTIMESTAMP", "NEXTVAL", "CURRVAL", "ROWID", "LISTAGG", "WM_CONCAT", "XMLAGG", "XMLFOREST", "XMLELEMENT", "REGEXP_LIKE", "REGEXP_REPLACE", "REGEXP_SUBSTR", "REGEXP_INSTR")
ORACLE_OPERATORS = ("(+)", "||", "**", "CONCAT")
SQLSERVER_KEYWORDS = ("ISNULL", "GETDATE", "GETUTCDATE", "DATEADD", "DATEDIFF", "DATEPART", "DATENAME", "IDENTITY", "NEWID", "NEWSEQUENTIALID", "IIF", "CHOOSE", "FORMAT", "TRY_CAST", "TRY_CONVERT", "TRY_PARSE")
UNMAPPED_TYPES = ("UNIQUEIDENTIFIER", "MONEY", "SMALLMONEY", "DATETIME2", "DATETIMEOFFSET", "GEOGRAPHY", "GEOMETRY", "HIERARCHYID", "SQL_VARIANT")
MYSQL_ONLY = ("ON DUPLICATE KEY", "REPLACE INTO", "`", "ENGINE=InnoDB", "AUTO_INCREMENT")
NOT_MYSQL = ("NVL", "TOP ", "ROWNUM", "GETDATE", "FETCH FIRST")
POSTGRES_ONLY = ("SERIAL", "BIGSERIAL", "ILIKE", "::")
NOT_POSTGRES = ("NVL", "TOP ", "ROWNUM", "GETDATE", "CONVERT(", "DATEPART")
ALIAS_STOP_WORDS = ("SELECT", "FROM", "WHERE", "JOIN", "INNER", "LEFT", "RIGHT", "OUTER", "ON", "AND", "OR", "NOT", "NULL", "AS", "ORDER", "GROUP", "BY", "HAVING", "LIMIT", "OFFSET", "FETCH", "UNION", "DISTINCT", "INTO", "VALUES", "SET", "CASE", "WHEN", "THEN", "ELSE", "END", "EXISTS", "BETWEEN", "LIKE", "IN", "IS")
SHAPE_STOP_WORDS = ("SELECT", "FROM", "WHERE", "AS", "SUM", "COUNT", "MAX", "MIN", "AVG", "DISTINCT", "CASE", "WHEN", "THEN", "ELSE", "END", "NULL")
INJECTION_PATTERNS = (";--", "';--", "1=1", "1=1--", "' or '1'='1", "union select", "drop table", "drop database", "truncate table", "xp_cmdshell", "sp_executesql", "execute immediate")
SARIF_SENSITIVE = ("password=", "pwd=", "connectionstring=", "connection string=", "access_token=", "token=", "token:", "secret=", "secret:", "authorization: bearer", "api_key=", "api-key:", "api key=")
EVIDENCE_SENSITIVE = ("password=", "token=", "authorization: bearer")
SAFE_PROPERTIES = ("column", "columnMaxBytes", "columnMaxLength", "dbColumnType", "entityMaxBytes", "entityMaxLength", "function", "inferredType", "keyword", "operator", "property", "referencedIssue", "semantics", "suggestion", "syntax", "table", "type")

SQLSERVER_TYPES = {
    "int": ("int",),
    "long": ("bigint",),
    "short": ("smallint",),
    "byte": ("tinyint",),
    "bool": ("bit",),
    "decimal": ("decimal", "numeric", "money", "smallmoney"),
    "double": ("float",),
    "float": ("real",),
    "string": ("nvarchar", "varchar", "nchar", "char", "ntext", "text"),
    "DateTime": ("datetime", "datetime2", "smalldatetime", "date", "time"),
    "DateTimeOffset": ("datetimeoffset",),
    "Guid": ("uniqueidentifier",),
    "byte[]": ("varbinary", "binary", "image"),
    "TimeSpan": ("time",),
}
ORACLE_TYPES = {
    "int": ("NUMBER", "INTEGER", "INT"),
    "long": ("NUMBER", "BIGINT"),
    "short": ("NUMBER", "SMALLINT"),
    "byte": ("NUMBER",),
    "bool": ("NUMBER(1)",),
    "decimal": ("NUMBER", "DECIMAL", "NUMERIC"),
    "double": ("BINARY_DOUBLE", "FLOAT"),
    "float": ("BINARY_FLOAT",),
    "string": ("VARCHAR2", "NVARCHAR2", "CHAR", "NCHAR", "CLOB", "NCLOB"),
    "DateTime": ("DATE", "TIMESTAMP", "TIMESTAMP WITH TIME ZONE"),
    "DateTimeOffset": ("TIMESTAMP WITH TIME ZONE",),
    "Guid": ("RAW(16)",),
    "byte[]": ("RAW", "BLOB"),
}

#: Rule id -> (severity, what it finds).
RULES = {
    "DG001": ("Warning", "call that isn't validated"),
    "DG101": ("Error", "call without parameters"),
    "DG002": ("Error", "type of a parameter"),
    "DG003": ("Error", "direction of a parameter"),
    "DG004": ("Error", "shape of a result"),
    "DG005": ("Warning", "nullability"),
    "DG006": ("Info", "naming of a column"),
    "DG007": ("Error", "length"),
    "DG008": ("Warning", "length in bytes"),
    "DG009": ("Warning", "inferred length"),
    "DG010": ("Warning", "Oracle syntax elsewhere"),
    "DG011": ("Warning", "other syntax in Oracle"),
    "DG012": ("Error", "provider"),
    "DG013": ("Warning", "EXEC in Oracle"),
    "DG014": ("Warning", "unmapped types"),
    "DG015": ("Error", "phantom table"),
    "DG016": ("Error", "phantom column"),
    "MY001": ("Warning", "MySQL syntax elsewhere"),
    "MY002": ("Warning", "other syntax in MySQL"),
    "MY003": ("Error", "length"),
    "PG001": ("Warning", "PostgreSQL syntax elsewhere"),
    "PG002": ("Warning", "other syntax in PostgreSQL"),
    "PG003": ("Error", "length"),
    "DG098": ("Warning", "SELECT without FROM"),
    "DG099": ("Warning", "injection pattern"),
    "CUSTOM001": ("Warning", "prefix in legacy schemas"),
}
RULE_DEPENDENCIES = {"DG101": (), "DG002": (), "DG015": (), "DG003": ("DG101",), "DG004": ("DG101",), "DG005": ("DG002",), "DG006": ("DG101", "DG004")}
COMMON_RULES = ("DG101", "DG002", "DG003", "DG004", "DG005", "DG006", "DG015")
PROVIDER_RULES = {"oracle": ("DG010", "DG011", "DG013", "DG014", "DG007", "DG008", "DG009"), "mysql": ("MY001", "MY002", "MY003"), "postgresql": ("PG001", "PG002", "PG003"), "sqlserver": ()}

DBMS_TYPE_CODES = {1: "VARCHAR2", 2: "NUMBER", 8: "LONG", 12: "DATE", 23: "RAW", 24: "LONG RAW", 96: "CHAR", 100: "BINARY_FLOAT", 101: "BINARY_DOUBLE", 112: "CLOB", 113: "BLOB", 114: "BFILE", 180: "TIMESTAMP", 181: "TIMESTAMP WITH TIME ZONE", 182: "INTERVAL YEAR TO MONTH", 183: "INTERVAL DAY TO SECOND", 231: "TIMESTAMP WITH LOCAL TIME ZONE"}
DBMS_NATIONAL_CODES = {1: "NVARCHAR2", 96: "NCHAR", 112: "NCLOB"}

# Names of the categories.
CATEGORY_NAMES = {"CFfi": ("c-ffi", "cffi", "ffi"), "Geospatial": ("geospatial", "geo", "raster"), "BioMl": ("bio-ml", "bio"), "McpConnectors": ("mcp-connectors", "mcp"), "TypingInfrastructure": ("typing-infrastructure", "typing"), "HardwareEdge": ("hardware-edge", "edge")}

# Beginnings of names of dependencies that are trusted.
TRUSTED_PREFIXES = ("System.", "Microsoft.", "NuGet.", "runtime.", "NETStandard.Library", "Microsoft.NETCore.", "Microsoft.AspNetCore.", "Microsoft.EntityFrameworkCore", "Microsoft.Extensions.", "System.Text.Json", "System.Text.RegularExpressions", "System.Collections.Immutable", "System.Diagnostics.DiagnosticSource", "System.Memory", "System.Runtime.", "System.Threading.", "System.Linq", "System.ComponentModel", "System.Reflection", "System.IO", "System.Security.Cryptography", "System.Diagnostics", "System.Globalization", "System.Resources", "System.Numerics", "System.Xml", "System.Configuration", "System.Data", "System.Drawing", "System.Windows", "PresentationCore", "PresentationFramework", "WindowsBase", "Microsoft.CodeAnalysis", "Microsoft.CodeAnalysis.CSharp", "Microsoft.CodeAnalysis.CSharp.Scripting", "Microsoft.SqlServer.TransactSql.ScriptDom", "Oracle.ManagedDataAccess", "Npgsql", "MySqlConnector", "AWSSDK.", "Dapper", "Newtonsoft.Json", "YamlDotNet", "Spectre.Console", "CommandLineParser", "Polly", "Serilog", "MediatR", "AutoMapper", "FluentValidation", "xunit", "Moq", "FluentAssertions", "Bogus", "Testcontainers", "Testcontainers.Oracle", "Coverlet.Collector")
