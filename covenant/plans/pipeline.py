"""The engine's front: sources in, rules chosen, a baseline taken off, a summary out."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace
from importlib import import_module

from pyspark.sql import DataFrame

from covenant.functions import constants as C
from covenant.functions import sqltext
from covenant.operators import engine, graph, rules

Tables = Mapping[str, DataFrame]
Plan = Callable[[Tables], DataFrame]


def _matched(t: Tables, by_property: bool = True) -> DataFrame:
    return rules.first_match(t["properties"], t["columns"], by_property)


def _semantics(t: Tables) -> str:
    """Of the schema (a table of one row, ``length_semantics``), or BYTE where there is none."""
    return t["schema"].first()["length_semantics"] if "schema" in t else "BYTE"


#: Rule id -> (tables it needs, plan).
PLANS: dict[str, tuple[tuple[str, ...], Plan]] = {
    **{r: (("statements",), lambda t, r=r: rules.statement_rules(t["statements"], (r,))) for r in rules.STATEMENT_RULES},
    "DG002": (("parameters",), lambda t: rules.parameter_types(t["parameters"])),
    "DG003": (("parameters",), lambda t: rules.parameter_directions(t["parameters"])),
    "DG004": (("properties", "statements"), lambda t: engine.united([f(t["properties"], sqltext.shape_columns(t["statements"])) for f in (rules.missing_columns, rules.extra_columns)])),
    "DG005": (("properties", "columns"), lambda t: rules.nullability(t["properties"], t["columns"])),
    "DG006": (("properties",), lambda t: rules.naming(t["properties"])),
    "DG007": (("properties", "columns"), lambda t: rules.too_long(_matched(t))),
    "DG008": (("properties", "columns"), lambda t: rules.too_many_bytes(_matched(t), _semantics(t))),
    "DG009": (("properties", "columns"), lambda t: rules.inferred_length(_matched(t))),
    "DG001": (("sources",), lambda t: rules.unvalidated_calls(t["sources"])),
    "DG012": (("contexts",), lambda t: rules.provider_mismatch(t["contexts"])),
    "DG015": (("statements", "columns"), lambda t: rules.phantom_tables(t["statements"], t["columns"])),
    "DG016": (("statements", "columns"), lambda t: engine.united([rules.phantom_qualified(t["statements"], t["columns"]), rules.phantom_selected(t["statements"], t["columns"])])),
    "MY003": (("properties", "columns"), lambda t: rules.too_long(_matched(t, False), "MY003")),
    "PG003": (("properties", "columns"), lambda t: rules.too_long(_matched(t, False), "PG003")),
    "CUSTOM001": (("parameters",), lambda t: rules.legacy_prefix(t["parameters"])),
}


def rule(rule_id: str, severity: str, *needs: str) -> Callable[[Plan], Plan]:
    """Registers a plug-in's rule; a built-in rule of that id stays."""

    def register(plan: Plan) -> Plan:
        if rule_id not in PLANS:
            PLANS[rule_id] = (needs, plan)
            C.RULES[rule_id] = (severity, plan.__doc__ or "")
        return plan

    return register


def load_plugins(modules: list[str]) -> dict[str, str]:
    """Imports modules that register rules; what fails is told, not raised."""
    failed = {}
    for name in modules:
        try:
            import_module(name)
        except Exception as e:  # a plug-in can fail in any way
            failed[name] = str(e)
    return failed


@dataclass(frozen=True)
class RuleInfo:
    rule_id: str
    severity: str
    description: str
    needs: tuple[str, ...]


def rule_info(rule_id: str) -> RuleInfo:
    """What is known of a rule; of an unknown one that it is unknown."""
    severity, description = C.RULES.get(rule_id, ("Warning", "unknown rule"))
    return RuleInfo(rule_id, severity, description, PLANS[rule_id][0] if rule_id in PLANS else ())


def all_rules() -> tuple[RuleInfo, ...]:
    """Built-in rules and then plug-ins', each in order of registration."""
    return tuple(rule_info(r) for r in PLANS)


@dataclass(frozen=True)
class ToolResult:
    """What an outside tool says: findings, metrics (name, value, unit, description), and the seconds it took."""

    tool: str
    findings: DataFrame
    metrics: DataFrame
    seconds: float


def run_tool(tool: str, analyse: Callable[[Tables], tuple[DataFrame, DataFrame]], tables: Tables) -> ToolResult:
    """Calls an outside tool's adapter, which gives its findings and metrics."""
    began = time.monotonic()
    found, metrics = analyse(tables)
    return ToolResult(tool, found, metrics, time.monotonic() - began)


def rules_for(provider: str) -> tuple[str, ...]:
    return (*C.COMMON_RULES, "DG016", *C.PROVIDER_RULES[provider.lower()])


@dataclass(frozen=True)
class Pipeline:
    """``Pipeline(tables).with_rules("DG015").with_baseline(df).validate()``; each step gives a new pipeline."""

    tables: Tables
    chosen: tuple[str, ...] = ()
    baseline: DataFrame | None = None
    forgiving: frozenset[str] = field(default=frozenset())

    def with_rules(self, *ids: str) -> Pipeline:
        return replace(self, chosen=(*self.chosen, *ids))

    def for_provider(self, provider: str) -> Pipeline:
        """A provider's rules, as far as there are tables for them."""
        ids = rules_for(provider)
        return replace(self.with_rules(*ids), forgiving=self.forgiving | set(ids))

    def skipped(self) -> dict[str, list[str]]:
        """Chosen rules that can't run, with the tables that they lack."""
        wanted = self.chosen or tuple(PLANS)
        return {r: lacks for r in wanted if (lacks := [t for t in PLANS[r][0] if t not in self.tables])}

    def with_baseline(self, baseline: DataFrame) -> Pipeline:
        return replace(self, baseline=baseline)

    def validate(self) -> DataFrame:
        """All findings of the chosen rules, less the baseline's; one plan, which Spark runs as one job.

        Rules that were named must have their tables. Of a provider's rules, or of all where none is chosen, those without
        tables are left out (see ``skipped``).
        """
        wanted = self.chosen or tuple(PLANS)
        named = {r: t for r, t in self.skipped().items() if r in self.chosen and r not in self.forgiving}
        if named:
            raise ValueError("; ".join(f"rule {r} needs {', '.join(t)}" for r, t in named.items()))
        needs = {r: [d for d in C.RULE_DEPENDENCIES.get(r, ()) if d in wanted] for r in dict.fromkeys(wanted)}
        able = [r for r in graph.order(needs) if all(t in self.tables for t in PLANS[r][0])]
        single = tuple(r for r in able if r in rules.STATEMENT_RULES)  # these share one pass
        plans = [rules.statement_rules(self.tables["statements"], single)] if single else []
        plans += [PLANS[r][1](self.tables) for r in able if r not in single]
        if not plans:
            raise ValueError("no chosen rule has its tables")
        found = engine.united(plans)
        return found if self.baseline is None else engine.new_findings(found, self.baseline)

    def summary(self) -> dict:
        return engine.rollup(self.validate()).first().asDict()

    def has_drifted(self, before: DataFrame, after: DataFrame) -> bool:
        return engine.schema_hash(before).first()[0] != engine.schema_hash(after).first()[0]
