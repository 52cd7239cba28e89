"""Where plans come from: hints from names and memory, and providers of plans."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable
from difflib import SequenceMatcher, get_close_matches
from pathlib import Path
from typing import Any, Protocol

from .operators.registry import OPERATORS
from .plans.document import Plan, read_plan

HINT_CUTOFF = 0.8
#: Words of formulas that are functions, not columns.
FUNCTION_WORDS = {"abs", "sum", "mean", "min", "max", "sqrt", "exp", "log", "floor", "ceil", "and", "or", "not", "in"}


def name_hints(columns: Iterable[str], targets: Iterable[str], cutoff: float = HINT_CUTOFF) -> dict[str, str]:
    """target: the column whose name is closest, if close enough."""
    columns = list(columns)
    return {t: m[0] for t in targets if (m := get_close_matches(t, columns, n=1, cutoff=cutoff))}


class MappingMemory:
    """Past mappings by domain, from a JSON file {"registry": [...]}; a missing or bad file is an empty memory."""

    def __init__(self, path: str | Path):
        try:
            records = json.loads(Path(path).read_text(encoding="utf-8")).get("registry", [])
        except (FileNotFoundError, json.JSONDecodeError):
            records = []
        self.domains: dict[str, list[dict]] = {}
        for r in records:
            self.domains.setdefault(r.get("domain", "default"), []).append(r)

    def recall(self, field: str, domain: str = "default", top_k: int = 3, threshold: float = 0.6) -> list[dict[str, Any]]:
        first: dict[str, dict] = {}
        for r in self.domains.get(domain, ()):
            first.setdefault(r["source_pattern"], r)
        found = get_close_matches(field, list(first), n=top_k, cutoff=threshold)
        return [
            {
                "historical_source": p, "mapped_target": first[p]["target_field"], "similarity_score": round(SequenceMatcher(None, field, p).ratio(), 2),
                "confidence": first[p].get("confidence", 0.0), "hint": first[p].get("description", ""),
            }
            for p in found
        ]


class PlanProvider(Protocol):
    """Gives a plan for a profile and a model; ``feedback`` tells what failed before."""

    def __call__(self, profile: dict, model: dict, feedback: dict | None) -> str | dict: ...


def from_files(paths: Iterable[str | Path]) -> PlanProvider:
    """The plans of these files in turn, one an attempt; the last one again."""
    paths = [Path(p) for p in paths]
    at = iter(paths)
    last = [paths[0]]

    def give(profile, model, feedback):
        last[0] = next(at, last[0])
        return last[0].read_text(encoding="utf-8")

    return give


def heuristic(profile: dict, model: dict, feedback: dict | None = None) -> dict:
    """A plan by column names alone, with the cleaning operator of each target type."""
    hints = name_hints(profile["fields"], model["fields"], 0.6)
    ops = {"float": "CLEAN_CURRENCY", "int": "TO_INT", "date": "PARSE_DATE"}
    return {
        "intermediate_steps": {},
        "output_mappings": {
            t: {"operation": ops.get(spec["type"], "COPY"), "inputs": [{"type": "COLUMN_REF", "value": hints[t]}], "target_type": spec["type"], "options": {}}
            for t, spec in model["fields"].items() if t in hints
        },
    }


def catalogue() -> str:
    """What a plan's author may use, from the operator table."""
    lines = [f"- {name}: at least {o.least} inputs" + (f"; options {', '.join(o.required)}" if o.required else "") for name, o in OPERATORS.items()]
    return "Operators:\n" + "\n".join(lines)


def build_prompt(profile: dict, model: dict, hints: dict[str, str], feedback: dict | None = None) -> str:
    """A text from which a person or a service can write a plan."""
    parts = [catalogue(), "Answer with one JSON object: intermediate_steps, output_mappings.", f"Target: {json.dumps(model, default=str)}", f"Profile: {json.dumps(profile, default=str)}", f"Name hints: {json.dumps(hints)}"]
    if feedback:
        parts.append(f"What failed last time: {json.dumps(feedback, default=str)}")
    return "\n\n".join(parts)


def generate_plan(provider: Callable, profile: dict, model: dict, feedback: dict | None = None) -> Plan:
    """Ask and read; RuntimeError tells a failed provider from a bad plan."""
    try:
        raw = provider(profile, model, feedback)
    except Exception as e:
        raise RuntimeError(f"the plan provider failed: {e}") from e
    try:
        return read_plan(raw)
    except ValueError as e:
        raise RuntimeError(f"the plan breaks the format: {e}") from e


def lineage(plan: Plan) -> dict[str, str]:
    """source column: target field that uses it (the last one named)."""
    out: dict[str, str] = {}

    def sources(node, seen: set[str]) -> set[str]:
        found = set()
        for a in node.inputs:
            if a.type == "COLUMN_REF":
                found.add(a.value)
            elif a.type == "STEP_REF" and a.value in plan.steps and a.value not in seen:
                seen.add(a.value)
                found |= sources(plan.steps[a.value], seen)
        for f in node.formulas():
            for name in re.findall(r"[A-Za-z_]\w*", re.sub(r"'[^']*'|\"[^\"]*\"", "", f)):
                if name in plan.steps and name not in seen:
                    seen.add(name)
                    found |= sources(plan.steps[name], seen)
                elif name not in FUNCTION_WORDS and name not in plan.steps:
                    found.add(name)
        return found

    for target, node in plan.outputs.items():
        for s in sorted(sources(node, set())):
            out[s] = target
    return out
