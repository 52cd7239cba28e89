"""Plan documents: strict JSON, and validation of their graph.

    {"target_dataset": ..., "sub_plans": {name: sub-plan}, "intermediate_steps": {name: node}, "output_mappings": {target: node}}
    node: {"operation", "inputs": [{"type", "value"}], "target_type", "options"}

A sub-plan is a plan of its own over ``source`` (a table's or another sub-plan's name, default: the plan's own
source); its outputs are a table under its name, lowered once, and written once if ``materialise`` is true.
Input types: COLUMN_REF (of the source), STEP_REF, LITERAL, TABLE_REF.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping
from dataclasses import dataclass, field
from typing import Any

from ..functions.expressions import ExpressionError, identifiers
from ..operators.registry import OPERATORS

INPUT_TYPES = ("COLUMN_REF", "STEP_REF", "LITERAL", "TABLE_REF")


class PlanError(ValueError):
    """A document that breaks the format or the graph; ``errors`` lists all findings."""

    def __init__(self, errors: list[str]):
        super().__init__("; ".join(errors))
        self.errors = errors


@dataclass(frozen=True)
class Argument:
    type: str
    value: Any


@dataclass(frozen=True)
class Node:
    operation: str
    inputs: tuple[Argument, ...] = ()
    target_type: str = "string"
    options: dict[str, Any] = field(default_factory=dict)

    def formulas(self) -> list[str]:
        """Expressions in which steps may be named."""
        if self.operation == "COMPUTE_EXPR":
            return [str(self.options.get("formula", ""))]
        if self.operation == "CASE_WHEN":
            return [str(c.get("condition", "")) for c in self.options.get("cases", ()) if isinstance(c, dict)]
        return []


@dataclass(frozen=True)
class Plan:
    steps: dict[str, Node]
    outputs: dict[str, Node]
    target_dataset: str = ""
    sub_plans: dict[str, Plan] = field(default_factory=dict)
    source: str = "source"
    materialise: bool = False


def _node(where: str, raw: Any, errors: list[str]) -> Node | None:
    if not isinstance(raw, dict):
        errors.append(f"{where}: a node must be an object")
        return None
    if extra := set(raw) - {"operation", "inputs", "target_type", "options"}:
        errors.append(f"{where}: unknown keys {sorted(extra)}")
    op = raw.get("operation")
    if op not in OPERATORS:
        errors.append(f"{where}: unknown operation {op!r}")
    args = []
    for a in raw.get("inputs", ()):
        if not isinstance(a, dict) or set(a) != {"type", "value"} or a["type"] not in INPUT_TYPES:
            errors.append(f"{where}: bad input {a!r}")
        else:
            args.append(Argument(a["type"], a["value"]))
    options = raw.get("options") or {}
    if not isinstance(options, dict):
        errors.append(f"{where}: options must be an object")
        options = {}
    return Node(str(op), tuple(args), raw.get("target_type") or "string", options)


def read_plan(source: str | dict) -> Plan:
    """A plan of a JSON text or its object; code fences around the text are ignored."""
    if isinstance(source, str):
        text = source.strip()
        if text.startswith("```"):
            text = text.split("\n", 1)[-1].rsplit("```", 1)[0]
        try:
            source = json.loads(text)
        except json.JSONDecodeError as e:
            raise PlanError([f"not JSON: {e}"]) from e
    errors: list[str] = []
    plan = _plan(source, "", errors)
    if errors:
        raise PlanError(errors)
    return plan


def _plan(source: Any, where: str, errors: list[str]) -> Plan | None:
    if not isinstance(source, dict):
        errors.append(f"{where}a plan must be an object")
        return None
    known = {"target_dataset", "intermediate_steps", "output_mappings", "sub_plans"} | ({"source", "materialise"} if where else set())
    if extra := set(source) - known:
        errors.append(f"{where}unknown keys {sorted(extra)}")
    parts = []
    for key in ("intermediate_steps", "output_mappings"):
        nodes = {name: _node(f"{where}{key}.{name}", raw, errors) for name, raw in (source.get(key) or {}).items()}
        parts.append({k: n for k, n in nodes.items() if n})
    subs = {name: _plan(raw, f"sub_plans.{name}: ", errors) for name, raw in (source.get("sub_plans") or {}).items()}
    if where and subs:
        errors.append(f"{where}sub-plans have no sub-plans of their own; name them beside it")
    return Plan(*parts, str(source.get("target_dataset", "")), {k: p for k, p in subs.items() if p}, str(source.get("source", "source")), bool(source.get("materialise")))


def sub_order(plan: Plan) -> list[str]:
    """The sub-plans, each after those whose tables it reads; a cycle is an error."""
    needs = {n: {p.source, *(a.value for x in (*p.steps.values(), *p.outputs.values()) for a in x.inputs if a.type == "TABLE_REF")} & set(plan.sub_plans) for n, p in plan.sub_plans.items()}
    done: list[str] = []
    while len(done) < len(needs):
        ready = sorted(n for n, d in needs.items() if n not in done and d <= set(done))
        if not ready:
            raise PlanError([f"cycle of sub-plans: {', '.join(sorted(set(needs) - set(done)))}"])
        done += ready
    return done


def dependencies(node: Node, steps: Iterable[str]) -> set[str]:
    """Steps that a node needs: by reference, or named in its formulas."""
    found = {a.value for a in node.inputs if a.type == "STEP_REF"}
    for f in node.formulas():
        try:
            found |= identifiers(f) & set(steps)
        except ExpressionError:
            pass  # validate() reports it
    return found


def order(plan: Plan) -> list[str]:
    """The steps that outputs need, each after its own; a cycle is an error."""
    done: list[str] = []
    state: dict[str, int] = {}

    def visit(name: str, path: tuple[str, ...]) -> None:
        if state.get(name) == 2:
            return
        if state.get(name) == 1:
            raise PlanError([f"cycle: {' -> '.join((*path, name))}"])
        if name not in plan.steps:
            raise PlanError([f"unknown step {name}"])
        state[name] = 1
        for d in sorted(dependencies(plan.steps[name], plan.steps)):
            visit(d, (*path, name))
        state[name] = 2
        done.append(name)

    for node in plan.outputs.values():
        for d in sorted(dependencies(node, plan.steps)):
            visit(d, ())
    return done


def validate(plan: Plan, source_columns: Iterable[str], target_fields: Iterable[str] | None = None, tables: Iterable[str] = ()) -> list[str]:
    """All findings about the graph; empty if it can be lowered."""
    errors: list[str] = []
    found = {"source": set(source_columns), **{n: set(getattr(tables[n], "columns", ())) or None if isinstance(tables, Mapping) else None for n in tables}}
    if clash := set(plan.sub_plans) & set(found):
        errors.append(f"sub-plans {sorted(clash)} bear the names of tables")
    try:
        for name in sub_order(plan):
            sub = plan.sub_plans[name]
            if sub.source not in found:
                errors.append(f"sub-plan {name}: unknown source {sub.source}")
            else:
                errors += [f"sub-plan {name}: {e}" for e in _graph(sub, found[sub.source], set(found))]
            found[name] = set(sub.outputs)
    except PlanError as e:
        return [*errors, *e.errors]
    errors += _graph(plan, set(source_columns), set(found))
    if target_fields is not None:
        errors += [f"output {k}: not a field of the target" for k in plan.outputs if k not in set(target_fields)]
    return errors


def _graph(plan: Plan, columns: set[str] | None, tables: set[str]) -> list[str]:
    """Findings about one plan's nodes; ``columns`` None: not known."""
    errors: list[str] = []
    for where, node in [*((f"step {k}", n) for k, n in plan.steps.items()), *((f"output {k}", n) for k, n in plan.outputs.items())]:
        spec = OPERATORS[node.operation]
        if len(node.inputs) < spec.least:
            errors.append(f"{where}: {node.operation} needs {spec.least} inputs, has {len(node.inputs)}")
        for name in spec.required:
            if node.options.get(name) in (None, "", [], {}):
                errors.append(f"{where}: {node.operation} needs option {name}")
        if spec.check:
            errors += [f"{where}: {e}" for e in spec.check(node.options)]
        for a in node.inputs:
            if a.type == "STEP_REF" and a.value not in plan.steps:
                errors.append(f"{where}: unknown step {a.value}")
            elif a.type == "COLUMN_REF" and columns is not None and a.value not in columns:
                errors.append(f"{where}: unknown column {a.value}")
            elif a.type == "TABLE_REF" and a.value not in tables:
                errors.append(f"{where}: unknown table {a.value}")
        for f in node.formulas():
            try:
                if columns is not None and (unknown := identifiers(f) - columns - set(plan.steps) - {"_temp"}):
                    errors.append(f"{where}: unknown names {sorted(unknown)} in {f!r}")
            except ExpressionError as e:
                errors.append(f"{where}: {e}")
    try:
        order(Plan(plan.steps, {k: Node("COPY", (Argument("STEP_REF", k),)) for k in plan.steps}))
    except PlanError as e:
        errors += [x for x in e.errors if x not in errors and not x.startswith("unknown step")]
    return errors
