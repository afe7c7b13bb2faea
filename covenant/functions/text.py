"""Column functions on names, types and values; all of them run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from covenant.functions.constants import CATEGORY_NAMES, EVIDENCE_SENSITIVE, SARIF_SENSITIVE, TRUSTED_PREFIXES


def snake_case(name: Column) -> Column:
    """An underscore before every capital but the first letter, then lower case: ``FullName`` is ``full_name``, ``ID`` is ``i_d``."""
    return F.lower(F.concat(F.substring(name, 1, 1), F.regexp_replace(F.substring(name, 2, 1 << 30), "([A-Z])", "_$1")))


def pascal_case(name: Column) -> Column:
    """Parts between ``_``, ``-`` and ``.``, each with a capital and the rest lower; empty parts go."""
    parts = F.filter(F.split(name, r"[_\-.]"), lambda p: p != "")
    return F.array_join(F.transform(parts, lambda p: F.concat(F.upper(F.substring(p, 1, 1)), F.lower(F.substring(p, 2, 1 << 30)))), "")


def without_spaces(text: Column) -> Column:
    return F.regexp_replace(text, r"\s", "")


def type_tokens(db_type: Column) -> Column:
    return F.filter(F.split(db_type, r"[() \t,]+"), lambda t: t != "")


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    """Whether ``text`` holds one of ``words``, whatever the case."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.upper(text), F.lit(w.upper()))
    return out


def first_of(text: Column, words: tuple[str, ...]) -> Column:
    """The first of ``words``, in their order, that ``text`` holds, else null."""
    return F.coalesce(*(F.when(F.contains(F.upper(text), F.lit(w.upper())), F.lit(w)) for w in words))


def word_pattern(word: str) -> str:
    """A pattern for a whole word, the same in Java's and RE2's dialect whatever letters stand around."""
    return f"(?i)(^|[^A-Za-z0-9_]){word}([^A-Za-z0-9_]|$)"


def redact_sarif(value: Column) -> Column:
    secret = (value.startswith("eyJ") & (F.length(value) > 20)) | contains_any(value, SARIF_SENSITIVE)
    return F.when(secret, "[REDACTED]").otherwise(value)


def redact_evidence(value: Column) -> Column:
    return F.when(contains_any(value, EVIDENCE_SENSITIVE), "[REDACTED]").otherwise(value)


def redact_pairs(value: Column) -> Column:
    """Keeps the key of ``password=...``, ``token: ...`` and the like, and hides what follows."""
    return F.regexp_replace(value, r"(?i)(password|pwd|token|secret|api[_-]?key)(\s*[=:]\s*)[^\s;,]+", "$1$2[REDACTED]")


def mask_value(value: Column) -> Column:
    """Empty says so, up to eight characters are hidden, else the first and last four stay."""
    return F.when(value.isNull() | (value == ""), "<empty>").when(F.length(value) <= 8, "****").otherwise(F.concat(F.left(value, F.lit(4)), F.lit("****"), F.right(value, F.lit(4))))


def sha256_upper(value: Column) -> Column:
    return F.upper(F.sha2(value, 256))


def major_minor(version: Column) -> Column:
    return F.nullif(F.regexp_extract(version, r"(\d+\.\d+)", 1), F.lit(""))


def sarif_level(severity: Column) -> Column:
    return F.when(severity == "Error", "error").when(severity == "Warning", "warning").when(severity == "Info", "note").otherwise("none")


def char_used(flag: Column) -> Column:
    return F.when(F.upper(flag) == "B", "BYTE").when(F.upper(flag) == "C", "CHAR").otherwise(flag)


def direction(mode: Column) -> Column:
    return F.when(F.upper(mode) == "OUT", "Output").when(F.upper(mode).isin("INOUT", "IN OUT", "IN/OUT"), "InputOutput").otherwise("Input")


def full_name(schema: Column, name: Column) -> Column:
    return F.concat_ws(".", F.nullif(schema, F.lit("")), name)


def evidence_severity(severity: Column) -> Column:
    return F.when(severity.isin("Error", "Warning", "Info"), F.lower(severity)).otherwise("hidden")


def valid_identifier(name: Column) -> Column:
    """Whether a name can go into a catalogue query as it is."""
    return F.coalesce(name.rlike(r"\A[A-Za-z_][A-Za-z0-9_$#]*\z"), F.lit(False))


def quoted(name: Column) -> Column:
    """A name in brackets, closing ones doubled."""
    return F.concat(F.lit("["), F.replace(name, F.lit("]"), F.lit("]]")), F.lit("]"))


def days_since(pushed_at: Column, now: Column) -> Column:
    """Whole days between a timestamp of RFC 3339 and now, 0 at least; 30 if it can't be read."""
    ago = F.floor((F.unix_seconds(now) - F.unix_seconds(F.try_to_timestamp(pushed_at))) / 86400)
    return F.when(ago.isNull(), 30).otherwise(F.greatest(ago, F.lit(0))).cast("long")


def one_based(place: Column) -> Column:
    return place + 1


def zero_based(place: Column) -> Column:
    return F.greatest(place - 1, F.lit(0))


def token_estimate(prompt: Column, budget: int = 0) -> Column:
    """Tokens of a request as its offline client counts them: a quarter of the prompt's bytes, 384 for the answer, and the budget for thinking."""
    prompt_tokens = F.floor(F.octet_length(prompt) / 4).cast("long")
    return F.struct(prompt_tokens.alias("prompt_tokens"), F.lit(384).cast("long").alias("completion_tokens"), F.lit(budget).cast("long").alias("thinking_tokens"), (prompt_tokens + 384 + budget).alias("total_tokens"))


def version_at_least(current: Column, least: Column) -> Column:
    """Whether a version of two to four numbers reaches another; what isn't a version counts as 1.0.0."""

    def numbers(v: Column) -> Column:
        known = F.when(v.rlike(r"^\s*\d+(\.\d+){1,3}\s*$"), F.trim(v)).otherwise("1.0.0")
        return F.transform(F.split(known, r"\."), lambda x: x.cast("int"))

    return numbers(current) >= numbers(least)


def allowed_endpoint(url: Column) -> Column:
    """Whether telemetry may go there: HTTPS, or HTTP to this machine."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*)://[^/?#\s]+", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:]+)", 1))
    local = host.isin("localhost", "[::1]") | host.rlike(r"^127\.\d+\.\d+\.\d+$")
    return F.coalesce((scheme == "https") | ((scheme == "http") & local), F.lit(False))


def trusted(name: Column) -> Column:
    """Whether a dependency's name begins with a prefix that is trusted, whatever the case."""
    low = F.lower(name)
    return F.coalesce(F.exists(F.array(*(F.lit(p.lower()) for p in TRUSTED_PREFIXES)), lambda p: low.startswith(p)), F.lit(False))


def category(name: Column) -> Column:
    """A category by any of its names; all others are the general one."""
    out = F.lit("GeneralNiche")
    for kind, names in CATEGORY_NAMES.items():
        out = F.when(F.lower(name).isin(*names), kind).otherwise(out)
    return out
