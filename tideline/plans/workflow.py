"""Declarative workflows: meta, spec and steps; a step names a function, its parameters and its output.

A parameter that equals a key of ``meta`` takes that value; one that names a
data object takes the object; anything else is itself.  Steps of chart and
report modules are registered by those modules, which this one imports.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

import yaml
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.validate import ValidationError
from tideline.plans import charts as _charts  # noqa: F401
from tideline.plans import registry
from tideline.plans import report as _report  # noqa: F401
from tideline.sources.io import ColumnSpec, apply_spec


@dataclass
class Step:
    output: str
    name: str
    params: dict = field(default_factory=dict)


@dataclass
class Workflow:
    meta: dict
    steps: list[Step]
    spec: dict[str, list[ColumnSpec]] = field(default_factory=dict)

    @property
    def id(self) -> str:
        return f"{self.meta.get('Type', 'Workflow')}_{self.meta.get('ID', '')}"


def parse_spec(spec: dict | None) -> dict[str, list[ColumnSpec]]:
    out = {}
    for domain, columns in (spec or {}).items():
        out[domain] = [ColumnSpec(c, (d or {}).get("type"), (d or {}).get("source_col")) for c, d in columns.items() if c != "_all"]
    return out


def parse_workflow(data: dict) -> Workflow:
    return Workflow(data.get("meta", {}), [Step(s["output"], s["name"], s.get("params") or {}) for s in data.get("steps", [])], parse_spec(data.get("spec")))


class _Loader(yaml.SafeLoader):
    """A lone ``=`` is text, not YAML's key of a default value."""


_Loader.yaml_implicit_resolvers = {k: v for k, v in yaml.SafeLoader.yaml_implicit_resolvers.items() if k != "="}


def load_workflows(path: str | Path, names: list[str] | None = None) -> list[Workflow]:
    """All workflows of the YAML files in a folder, in the order of their priority and then of their id."""
    found = [parse_workflow(d) for p in sorted(Path(path).rglob("*.yaml")) for d in yaml.load_all(p.read_text(), _Loader) if d]
    chosen = [w for w in found if names is None or w.meta.get("ID") in names]
    return sorted(chosen, key=lambda w: (w.meta.get("Priority", 0), str(w.meta.get("ID"))))


def run_query(sql: str, df: DataFrame) -> DataFrame:
    """SQL over one table, called ``df`` in the text."""
    import re

    return df.sparkSession.sql(re.sub(r"(?i)\b(from|join)\s+df\b", r"\1 {df}", sql).replace("array_to_string(array_agg(", "array_join(array_agg("), df=df)


def make_long_meta(data: DataFrame, group_level: str, id_col: str = "GroupID") -> DataFrame:
    """GroupID, GroupLevel, Param, Value: every other column as text, one row each."""
    rest = [c for c in data.columns if c != id_col]
    cast = data.select(F.col(id_col).alias("GroupID"), *[F.col(c).cast("string").alias(c) for c in rest])
    return cast.unpivot("GroupID", rest, "Param", "Value").select("GroupID", F.lit(group_level).alias("GroupLevel"), "Param", "Value")


def calculate_percentage(data: DataFrame, current_col: str, target_col: str, perc_val: str, perc_str_val: str) -> DataFrame:
    """current / target in percent, and as text: "12 / 34 (35.3%)"; null without a target."""
    share = F.round(F.try_divide(F.col(current_col) * 100.0, F.col(target_col)), 1)
    text = F.format_string("%s / %s (%s%%)", F.col(current_col).cast("string"), F.col(target_col).cast("string"), share.cast("string"))
    return data.withColumn(perc_val, share).withColumn(perc_str_val, F.when(share.isNotNull(), text))


def left_join(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Left join; of columns on both sides the left one stays."""
    return left.join(right.select(*by, *[c for c in right.columns if c not in left.columns]), by, "left")


def bind_rows(*tables: DataFrame) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def make_metric(workflows: list[Workflow]) -> DataFrame:
    """One row for each metric workflow, from its meta; MetricID is its published name."""
    rows = [{"MetricID": w.id, **w.meta} for w in workflows]
    if not rows:
        raise ValidationError("lWorkflows must be a non-empty list")
    columns = list(dict.fromkeys(c for r in rows for c in r))
    kind = lambda c: "double" if all(r.get(c) is None or isinstance(r[c], (int, float)) and not isinstance(r[c], bool) for r in rows) else "string"
    kinds = {c: kind(c) for c in columns}
    made = [tuple(None if r.get(c) is None else float(r[c]) if kinds[c] == "double" else str(r[c]) for c in columns) for r in rows]
    return SparkSession.active().createDataFrame(made, ", ".join(f"`{c}` {kinds[c]}" for c in columns))


def select(data: DataFrame, columns: list[str] | None = None, **renamed: str) -> DataFrame:
    """Columns by name, or ``new name = column``; the table may be called ``.data``."""
    return data.select(*(columns or []), *[F.col(f"`{old}`").alias(new) for new, old in renamed.items()])


def map_over(items: dict, function: str | Callable, **params) -> dict:
    """A function over the values of a named list."""
    known = registry.parse_function(function)
    return {k: registry.call(known, {"dfInput": v, **params}) for k, v in items.items()}


def _select(**params) -> DataFrame:
    data = params.pop(".data") if ".data" in params else params.pop("data")
    return select(data, **params)


def _map(**params) -> dict:
    items = params.pop(".x") if ".x" in params else params.pop("lItems")
    function = params.pop(".f") if ".f" in params else params.pop("strFunction")
    return map_over(items, function, **params)


registry.register("RunQuery", lambda strQuery, df: run_query(strQuery, df))
registry.register("=", lambda rhs, lhs=None: rhs)
registry.register("ParseFunction", lambda strFunction: registry.parse_function(strFunction))
registry.register("MakeLongMeta", lambda data, strGroupLevel: make_long_meta(data, strGroupLevel))
registry.register("CalculatePercentage", lambda data, strCurrentCol, strTargetCol, strPercVal, strPercStrVal: calculate_percentage(data, strCurrentCol, strTargetCol, strPercVal, strPercStrVal))
registry.register("left_join", lambda x, y, by: left_join(x, y, [by] if isinstance(by, str) else by))
registry.register("bind_rows", lambda **tables: bind_rows(*tables.values()))
registry.register("select", _select)
registry.register("distinct", lambda **params: next(iter(params.values())).distinct())
registry.register("list", lambda **parts: parts)
registry.register("MakeMetric", lambda lWorkflows: make_metric(lWorkflows))
registry.register("map", _map)


#: Parameters that name something else than a table, a function or a value of the data.
_LITERAL = {"=": ("lhs",)}


def _resolve(value, meta: dict, data: dict):
    if isinstance(value, str):
        return meta[value] if value in meta else data.get(value, value)
    if isinstance(value, list):
        return [_resolve(v, meta, data) for v in value]
    if isinstance(value, dict):
        return {k: _resolve(v, meta, data) for k, v in value.items()}
    return value


def run_workflow(workflow: Workflow, data: dict, check_spec: bool = True, aliases: dict[str, str] | None = None) -> object:
    """The last step's output; ``data`` is not changed.  Tables with a spec are renamed and cast on the way in.

    ``aliases`` gives the registered name of functions that steps call by another.
    """
    local = dict(data)
    if check_spec:
        for domain, spec in workflow.spec.items():
            if isinstance(local.get(domain), DataFrame) and spec:
                local[domain] = apply_spec(local[domain], spec, domain, keep_all=True)
    out = None
    for step in workflow.steps:
        params = {k: v if k in _LITERAL.get(step.name, ()) else _resolve(v, workflow.meta, local) for k, v in step.params.items()}
        if step.name.rpartition("::")[2] == "ParseFunction":
            params = {k: registry.parse_function(v, aliases) for k, v in params.items()}
        out = local[step.output] = registry.call(step.name, params, aliases)
    return out


def run_workflows(workflows: list[Workflow], data: dict, check_spec: bool = True, aliases: dict[str, str] | None = None) -> dict:
    """Each workflow's result under its published name and its last step's, later ones seeing the earlier ones' results."""
    known, out = dict(data), {}
    for w in workflows:
        out[w.id] = known[w.id] = run_workflow(w, known, check_spec, aliases)
        if w.steps and w.meta.get("Type") == "Mapped":
            known[w.steps[-1].output] = out[w.id]
    return out
