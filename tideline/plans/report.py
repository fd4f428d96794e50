"""Per-study HTML reports: latest values, charts as SVG, the table of metrics."""

from __future__ import annotations

import html
import math
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.plans import registry

PAGE = '<!DOCTYPE html><html><head><meta charset="utf-8"><title>{title}</title></head><body>{body}</body></html>'


def latest_metrics(results: DataFrame) -> DataFrame:
    """StudyID, MetricID, StudyMonth, Metric of each series' last month."""
    return results.groupBy("StudyID", "MetricID").agg(F.max("StudyMonth").alias("StudyMonth"), F.max_by("Metric", "StudyMonth").alias("Metric"))


def output_name(output_file: str, study: str) -> str:
    path = Path(output_file)
    return str(path.with_name(f"{path.stem}_{study}{path.suffix or '.html'}"))


def svg(chart: dict, width: int = 640, height: int = 320) -> str:
    """The chart's layers in one picture."""
    log = chart["y_scale"] == "log10"
    scale = lambda v: None if v is None or log and v <= 0 else math.log10(v) if log else v
    points = [(r["StudyMonth"], scale(r[k])) for layer in chart["layers"] for r in layer["rows"] for k in ("Metric", "Lower", "Upper") if k in r]
    points = [p for p in points if p[1] is not None]
    if not points:
        return ""
    xs, ys = [p[0] for p in points], [p[1] for p in points]
    at = lambda x, y: f"{40 + (x - min(xs)) / (max(xs) - min(xs) or 1) * (width - 60):.1f},{height - 30 - (y - min(ys)) / (max(ys) - min(ys) or 1) * (height - 60):.1f}"
    path = lambda rows, k: [at(r["StudyMonth"], scale(r[k])) for r in rows if scale(r[k]) is not None]
    parts = []
    for layer in chart["layers"]:
        colour = "#888888" if layer["of"] == "reference" else "#1f77b4"
        if layer["type"] == "ribbon":
            parts.append(f'<polygon points="{" ".join(path(layer["rows"], "Upper") + path(layer["rows"], "Lower")[::-1])}" fill="{colour}" fill-opacity="{layer["alpha"]}"/>')
        elif layer["type"] == "line":
            parts.append(f'<polyline points="{" ".join(path(layer["rows"], layer["y"]))}" fill="none" stroke="{colour}"{" stroke-dasharray=" + chr(34) + "4" + chr(34) if layer.get("dashed") else ""}/>')
        else:
            parts += [f'<circle cx="{p.split(",")[0]}" cy="{p.split(",")[1]}" r="2" fill="{colour}"/>' for p in path(layer["rows"], layer["y"])]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="40" y="18">{html.escape(chart["y"])}</text>{"".join(parts)}</svg>'


def _html_table(rows: list[dict]) -> str:
    if not rows:
        return "<p>None</p>"
    cell = lambda v: html.escape("" if v is None else f"{v:.4g}" if isinstance(v, float) else str(v))
    head = "".join(f"<th>{html.escape(c)}</th>" for c in rows[0])
    return f"<table><tr>{head}</tr>" + "".join("<tr>" + "".join(f"<td>{cell(v)}</td>" for v in r.values()) + "</tr>" for r in rows) + "</table>"


def report_study(charts: list[tuple[str, dict]] | dict[str, dict], results: DataFrame, groups: DataFrame | None = None, metrics: DataFrame | list[dict] | None = None, output_file: str = "report.html", input_path: str | None = None) -> dict[str, str]:
    """A file for each study that has charts: its study id to the file's path.  Nothing comes of no charts.

    ``input_path`` is an HTML file to fill in: ``{title}`` and ``{body}`` in it
    are replaced.
    """
    page = PAGE if input_path is None else Path(input_path).read_text(encoding="utf-8")
    items = list(charts.items()) if isinstance(charts, dict) else charts if isinstance(charts, list) else []
    by_study: dict[str, list[dict]] = {}
    for name, chart in items:
        if "study" in chart or "_" in (name or ""):
            by_study.setdefault(chart.get("study") or name.split("_", 1)[0], []).append(chart)
    if not by_study:
        return {}
    studies = list(by_study)
    latest: dict[str, list[dict]] = {}
    for r in latest_metrics(results.filter(F.col("StudyID").isin(studies))).orderBy("StudyID", "MetricID").collect():
        latest.setdefault(r["StudyID"], []).append(r.asDict())
    facts: dict[str, list[dict]] = {}
    if groups is not None:
        for r in groups.filter((F.col("GroupLevel") == "Study") & F.col("GroupID").isin(studies)).orderBy("GroupID", "Param").collect():
            facts.setdefault(r["GroupID"], []).append({"Param": r["Param"], "Value": r["Value"]})
    records = [r.asDict() for r in metrics.collect()] if isinstance(metrics, DataFrame) else metrics or []
    out = {}
    for study, own in by_study.items():
        body = [f"<h1>Study {html.escape(study)}</h1>", _html_table(facts.get(study, [])), "<h2>Latest values</h2>", _html_table(latest.get(study, []))]
        body += [f"<h3>{html.escape(c['title'])}</h3><p>{html.escape(c['subtitle'])}</p>{svg(c)}" for c in own]
        body += ["<h2>Metrics</h2>", _html_table(records)]
        out[study] = output_name(output_file, study)
        Path(out[study]).write_text(page.replace("{title}", html.escape(study)).replace("{body}", "".join(body)), encoding="utf-8")
    return out


registry.register("Report", report_study)
