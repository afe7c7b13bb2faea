"""The graph of rules that need other rules; a handful of names, kept on the driver."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

Needs = Mapping[str, Sequence[str]]


def check(needs: Needs) -> tuple[list[str], list[str]]:
    """Errors (cycles) and warnings (rules that are needed but unknown, and rules that neither need nor are needed)."""
    errors = []
    try:
        levels(needs)
    except ValueError as e:
        errors.append(str(e))
    warnings = [f"Rule '{r}' depends on missing rule '{d}'" for r, ds in sorted(needs.items()) for d in ds if d not in needs]
    needed = {d for ds in needs.values() for d in ds}
    return errors, warnings + [f"Rule '{r}' is isolated (no dependencies or dependents)" for r, ds in sorted(needs.items()) if not ds and r not in needed]


def dependents(needs: Needs, rule: str) -> set[str]:
    """All that need ``rule``, directly or not."""
    back: dict[str, list[str]] = {}
    for r, ds in needs.items():
        for d in ds:
            back.setdefault(d, []).append(r)
    return closure(back, rule)


def levels(needs: Needs) -> list[list[str]]:
    """Groups that can run side by side: each rule stands behind all that it needs."""
    left, done, out = set(needs), set(), []
    while left:
        ready = sorted(r for r in left if all(d in done or d not in needs for d in needs[r]))
        if not ready:
            raise ValueError(f"Rules need each other: {', '.join(sorted(left))}")
        out.append(ready)
        done.update(ready)
        left.difference_update(ready)
    return out


def order(needs: Needs) -> list[str]:
    """Every rule behind those it needs, by name where that leaves a choice."""
    return [r for level in levels(needs) for r in level]


def closure(needs: Needs, rule: str) -> set[str]:
    """All that ``rule`` needs, directly or not."""
    found, ahead = set(), list(needs.get(rule, ()))
    while ahead:
        d = ahead.pop()
        if d not in found:
            found.add(d)
            ahead.extend(needs.get(d, ()))
    return found
