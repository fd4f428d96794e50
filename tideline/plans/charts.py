"""Charts as data: layers of rows with their texts and scales, ready for any plotting library."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators import validate
from tideline.operators.validate import ValidationError
from tideline.plans import registry

BOUNDS = ["StudyMonth", "Median", "Lower", "Upper"]


def _points(rows: list[dict], columns: list[str], max_month: float | None) -> list[dict]:
    kept = [{c: r[c] for c in columns} for r in rows if max_month is None or r["StudyMonth"] is not None and r["StudyMonth"] <= max_month]
    return sorted(kept, key=lambda r: (r["StudyMonth"] is not None, r["StudyMonth"]))


def layers(line: list[dict], ref: list[dict] | None, own: list[dict] | None, study_id: str, max_month: float | None = None, y_label: str = "Metric", x_label: str = "Study Month", log_y: bool = False) -> dict:
    """The chart of one study's rows, from back to front: reference ribbon and dashed median, study ribbon, line and points."""
    line = _points(line, ["StudyMonth", "Metric"], max_month)
    if not line:
        raise ValidationError("No data available for study_kri after filtering")
    found, subtitle = [], ""
    if ref is not None:
        count = ["StudyCount"] if ref and "StudyCount" in ref[0] else []
        ref = _points(ref, [*BOUNDS, *count], max_month)
        if not ref:
            raise ValidationError("No data available for dfBoundsRef after filtering")
        found += [{"type": "ribbon", "of": "reference", "alpha": 0.5, "rows": ref}, {"type": "line", "of": "reference", "y": "Median", "dashed": True, "rows": ref}]
        subtitle = f"Comparison Portfolio: {max(r['StudyCount'] for r in ref)} studies" if count else "Comparison Portfolio Envelope"
    if own and (own := _points(own, BOUNDS, max_month)):
        found.append({"type": "ribbon", "of": "study", "alpha": 0.4, "rows": own})
    found += [{"type": kind, "of": "study", "y": "Metric", "rows": line} for kind in ("line", "points")]
    return {"title": f"Study {study_id} KRI Comparison", "subtitle": subtitle, "x": x_label, "y": y_label + " (log scale)" * log_y, "y_scale": "log10" if log_y else "linear", "layers": found}


def _checked(study_kri: DataFrame, bounds_ref: DataFrame | None, bounds: DataFrame | None, max_month: float | None) -> None:
    for name, df, columns in (("study_kri", study_kri, ["StudyMonth", "Metric"]), ("dfBoundsRef", bounds_ref, BOUNDS), ("dfBounds", bounds, BOUNDS)):
        if df is None and name != "study_kri":
            continue
        validate.table(df, name, "data.frame" if name == "study_kri" else "data.frame or NULL")
        validate.has_columns(df, name, columns)
    if max_month is not None and (isinstance(max_month, bool) or not isinstance(max_month, (int, float)) or max_month <= 0):
        raise ValidationError("nMaxMonth must be NULL or a positive number")


def visualize_study(study_kri: DataFrame, bounds_ref: DataFrame | None = None, bounds: DataFrame | None = None, study_id: str | None = None, max_month: float | None = None, y_label: str = "Metric", x_label: str = "Study Month", log_y: bool = False) -> dict:
    """The layers of one study's chart; see ``layers``."""
    if not isinstance(study_id, str):
        _checked(study_kri, bounds_ref, bounds, None)
        raise ValidationError("strStudyID must be a single character string")
    _checked(study_kri, bounds_ref, bounds, max_month)

    def rows(df: DataFrame | None) -> list[dict] | None:
        if df is None:
            return None
        own = df.filter(F.col("StudyID") == study_id) if "StudyID" in df.columns else df
        return [r.asDict() for r in (own if max_month is None else own.filter(F.col("StudyMonth") <= max_month)).collect()]

    return layers(rows(study_kri), rows(bounds_ref), rows(bounds), study_id, max_month, y_label, x_label, log_y)


def chart_pairs(results: DataFrame, bounds_ref: DataFrame) -> DataFrame:
    """StudyID, MetricID pairs of results that have reference bounds."""
    return results.select("StudyID", "MetricID").distinct().join(bounds_ref.select("StudyID", "MetricID").distinct(), ["StudyID", "MetricID"], "left_semi")


def make_charts(results: DataFrame, bounds: DataFrame | None, bounds_ref: DataFrame, metrics: DataFrame | list[dict] | None = None, max_month: float | None = None, log_y: bool = False) -> list[tuple[str, dict]]:
    """(<StudyID>_<MetricID>, chart) of every pair with reference bounds, from one collect a table; a chart that fails is a warning."""
    if not isinstance(results, DataFrame):
        raise ValidationError("dfResults must be a non-empty data frame")
    validate.has_columns(results, "dfResults", ["StudyID", "MetricID", "StudyMonth", "Metric"], "columns")
    _checked(results, bounds_ref, bounds, max_month)
    records = [r.asDict() for r in metrics.collect()] if isinstance(metrics, DataFrame) else metrics or []
    labels = {r["MetricID"]: r.get("Metric") for r in records}
    pairs = chart_pairs(results, bounds_ref)

    def by_pair(df: DataFrame | None) -> dict[tuple, list[dict]]:
        found: dict[tuple, list[dict]] = {}
        if df is not None:
            own = df.join(pairs, ["StudyID", "MetricID"], "left_semi")
            for r in (own if max_month is None else own.filter(F.col("StudyMonth") <= max_month)).collect():
                found.setdefault((r["StudyID"], r["MetricID"]), []).append(r.asDict())
        return found

    lines, refs, own = by_pair(results), by_pair(bounds_ref), by_pair(bounds)
    out = []
    for study, metric in sorted({*lines, *refs}):
        try:
            chart = layers(lines.get((study, metric), []), refs.get((study, metric), []), own.get((study, metric)), study, max_month, labels.get(metric) or metric, log_y=log_y)
            out.append((f"{study}_{metric}", chart | {"study": study, "metric": metric}))
        except ValidationError as e:
            warnings.warn(f"Failed to create chart for {study}_{metric}: {e}", stacklevel=2)
    return out


registry.register("Visualize", visualize_study)
registry.register("MakeCharts", make_charts)
