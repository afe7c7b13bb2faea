"""Chat formatting: records of many layouts become canonical turns, and turns one marked text with a loss mask.

A record is a JSON object. Of its nested field paths, with the kinds of values that stand there, those that a
mapping knows are hashed to a fingerprint, and the fingerprint selects the declarative mapping; other fields are
passed over. A record that no mapping fits stays as a row with the reason. The template marks turns with control
strings; what looks like one inside a text is escaped, so the turns can be read back exactly.
"""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from covenant.llm.cluster import prepare, tidy

Turn = tuple[str, str]

# ---------------------------------------------------------------- layouts


@dataclass(frozen=True)
class Mapping:
    """How a layout becomes turns.

    ``turns`` names a list of messages with the fields of role and text; ``single`` are (field, role) in the order of
    their turns; ``joined`` names a field that is set below another's text, a blank line between; ``optional`` fields may be absent or null.
    """

    name: str
    turns: tuple[str, str, str] | None = None
    single: tuple[tuple[str, str], ...] = ()
    joined: tuple[str, str] | None = None
    optional: tuple[str, ...] = ()


MAPPINGS = (
    Mapping("messages", turns=("messages", "role", "content"), single=(("system", "system"),), optional=("system",)),
    Mapping("conversations", turns=("conversations", "from", "value"), single=(("system", "system"),), optional=("system",)),
    Mapping("prompt-response", single=(("system", "system"), ("prompt", "user"), ("response", "assistant")), optional=("system",)),
    Mapping("prompt-completion", single=(("system", "system"), ("prompt", "user"), ("completion", "assistant")), optional=("system",)),
    Mapping("instruction", single=(("system", "system"), ("instruction", "user"), ("output", "assistant")), joined=("instruction", "input"), optional=("system", "input")),
    Mapping("question-answer", single=(("system", "system"), ("question", "user"), ("answer", "assistant")), optional=("system",)),
)
#: Names of roles in lists whose field is ``from``; ``role`` is taken as it is.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def field_paths(value, at: str = "$") -> set[str]:
    """Every path to a value with its kind; list items share one path, null has none of its own."""
    if isinstance(value, dict):
        return set().union(*(field_paths(v, f"{at}.{k}") for k, v in value.items())) if value else {f"{at}:object"}
    if isinstance(value, list):
        return {f"{at}[]:list"}.union(*(field_paths(v, f"{at}[]") for v in value))
    kind = "text" if isinstance(value, str) else "null" if value is None else "number"
    return {f"{at}:{kind}"} if kind != "null" else {f"{at}:text"}


def fingerprint(paths: set[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def _forms(m: Mapping) -> tuple[frozenset[str], frozenset[str]]:
    """The paths, without kinds, that a mapping knows, and the fingerprint of every form that it allows."""
    fields = [f for f, _ in m.single] + ([m.joined[1]] if m.joined else [])
    needed = [f for f in fields if f not in m.optional]
    known, found = {f"$.{f}" for f in fields}, set()
    for size in range(len(m.optional) + 1):
        for extra in combinations(m.optional, size):
            paths = {f"$.{f}:text" for f in (*needed, *extra)}
            if m.turns:
                items, role, text = m.turns
                known |= {f"$.{items}", f"$.{items}[]", f"$.{items}[].{role}", f"$.{items}[].{text}"}
                found.add(fingerprint(paths | {f"$.{items}[]:list"}))  # no turns
                paths |= {f"$.{items}[]:list", f"$.{items}[].{role}:text", f"$.{items}[].{text}:text"}
            found.add(fingerprint(paths))
    return frozenset(known), frozenset(found)


#: In the order in which they are tried: a record with the fields of several goes by the first.
FORMS = tuple((m, *_forms(m)) for m in MAPPINGS)


def select(value: dict) -> Mapping | None:
    """The first mapping that has the fingerprint of those of the record's paths that it knows; each item of a list of messages must have both its fields."""
    paths = field_paths(value)
    for m, known, forms in FORMS:
        if fingerprint({p for p in paths if p.rpartition(":")[0] in known}) in forms:
            if not m.turns or all(isinstance(t, dict) and m.turns[1] in t and m.turns[2] in t for t in value[m.turns[0]]):
                return m
    return None


def canonical(record: str | None) -> tuple[str | None, list[Turn], str | None]:
    """The mapping's name, the turns and, of a record that no mapping fits, the reason. Fields that no mapping knows are passed over; null texts and roles are empty."""
    try:
        value = json.loads(record) if record is not None else None
    except ValueError:
        return None, [], "not JSON"
    if not isinstance(value, dict):
        return None, [], "no record" if value is None else "not an object"
    mapping = select(value)
    if mapping is None:
        return None, [], f"unknown layout {fingerprint(field_paths(value))}"
    out = []
    for name, role in mapping.single:
        if name in mapping.optional and value.get(name) is None:
            continue
        text = value[name] or ""
        if mapping.joined and mapping.joined[0] == name and value.get(mapping.joined[1]):
            text = f"{text}\n\n{value[mapping.joined[1]]}"
        out.append((role, text))
    if mapping.turns:
        items, role, text = mapping.turns
        names = ROLES if role == "from" else {}
        out += [(names.get(t[role], t[role]) or "", t[text] or "") for t in value[items]]
    return mapping.name, out, None


# ---------------------------------------------------------------- template

BEGIN, MIDDLE, FINISH = "<|turn|>", "<|text|>", "<|end|>\n"
TRAINED = "assistant"
# Control strings of this and of other common templates: after its first character each gets a backslash, and one that has backslashes there gets one more.
_HIDE = re.compile(r"(<)(?=\\*(?:\||/?s>|<SYS>>|</SYS>>))|(\[)(?=\\*/?INST\])")
_SHOW = re.compile(r"(?:(<)\\(?=\\*(?:\||/?s>|<SYS>>|</SYS>>)))|(?:(\[)\\(?=\\*/?INST\]))")
_TURN = re.compile(r"<\|turn\|>(.*?)<\|text\|>(.*?)<\|end\|>\n", re.S)


def escape(text: str) -> str:
    return _HIDE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _SHOW.sub(lambda m: m[1] or m[2], text)


def format_turns(turns: list[Turn]) -> tuple[str, list[tuple[int, int]]]:
    """The marked text, and the places [start, end) of the assistant's texts in it."""
    parts, mask, at = [], [], 0
    for role, text in turns:
        head, body = f"{BEGIN}{escape(role)}{MIDDLE}", escape(text)
        if role == TRAINED:
            mask.append((at + len(head), at + len(head) + len(body)))
        parts += (head, body, FINISH)
        at += len(head) + len(body) + len(FINISH)
    return "".join(parts), mask


def parse_turns(formatted: str) -> list[Turn]:
    """The turns of a marked text; anything between or behind them is an error."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        out.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def loss_text(formatted: str, mask: list[tuple[int, int]]) -> str:
    return "".join(unescape(formatted[a:b]) for a, b in mask)


# ---------------------------------------------------------------- Spark


def records_from_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, record) from ``rows(conv_id, turn, role, text)``, a JSON object for each conversation.

    Turns go by number (nulls first), equal numbers by role and text, and rows that repeat all stay. A
    null role or text is empty. Conversations of one prompt and one answer, with or without a system
    text before, become prompt and response; all others are lists of messages. A row with a null conv_id
    is a conversation by itself, so rows without an id don't come together in one task. An empty table gives no
    rows, and other columns play no part. A conversation is one record, however long: its rows come together.
    """
    alone = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    turns = rows.select("conv_id", alone.alias("__alone"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    grouped = turns.groupBy("conv_id", "__alone").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    roles = F.transform("t", lambda t: t["role"])
    text = lambda k: F.col("t")[k]["text"]
    two = roles == F.array(F.lit("user"), F.lit("assistant"))
    three = roles == F.array(F.lit("system"), F.lit("user"), F.lit("assistant"))
    short = F.to_json(F.struct(text(0).alias("prompt"), text(1).alias("response")))
    headed = F.to_json(F.struct(text(0).alias("system"), text(1).alias("prompt"), text(2).alias("response")))
    listed = F.to_json(F.struct(F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))).alias("messages")))
    return grouped.select("conv_id", F.when(two, short).when(three, headed).otherwise(listed).alias("record"))


OUT = pa.schema([("conv_id", pa.int64()), ("layout", pa.string()), ("formatted", pa.string()), ("mask", pa.list_(pa.list_(pa.int64()))), ("reason", pa.string()), ("record", pa.string())])


def format_records(records: DataFrame) -> DataFrame:
    """(conv_id, layout, formatted, mask, reason, record) for each of ``records(conv_id, record)``.

    A record that no mapping fits (null, no JSON, no object, or an unknown layout) has null layout, an empty text, the reason
    and the record as it came; else both are null. Rows that repeat stay.
    """
    prepare(records.sparkSession)

    def run(batches):
        for batch in batches:
            rows = []
            for record in batch.column(1).to_pylist():
                name, turns, reason = canonical(record)
                text, mask = format_turns(turns)
                rows.append((name, text, [list(m) for m in mask], reason, record if reason else None))
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), OUT.types[1:], strict=True))], schema=OUT)

    return records.select(F.col("conv_id").cast("long").alias("conv_id"), "record").mapInArrow(tidy(run), "conv_id long, layout string, formatted string, mask array<array<long>>, reason string, record string")


DIGEST = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])


def read_back(formatted: DataFrame) -> DataFrame:
    """What the marked texts of ``formatted(conv_id, formatted, mask)`` say: turns and trained text, counted and hashed. A null text has no turns."""

    def run(batches):
        for batch in batches:
            rows = []
            for conv_id, text, mask in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                text, mask = text or "", mask or []
                turns, loss = parse_turns(text), loss_text(text, mask)
                whole = "".join(f"{role}\n{body}\n" for role, body in turns)
                rows.append((conv_id, len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), DIGEST, strict=True)], schema=DIGEST)

    return formatted.select("conv_id", "formatted", "mask").mapInArrow(tidy(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
