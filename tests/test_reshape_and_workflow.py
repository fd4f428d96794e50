import datetime as dt
import warnings

import pytest

from tideline.operators import reshape, simulate
from tideline.operators.validate import ValidationError
from tideline.plans import charts, definitions, registry, report, workflow
from tideline.sources.io import ColumnSpec, apply_spec

KRI = "MetricID string, GroupID string, GroupLevel string, Numerator double, Denominator double, StudyID string, MonthYYYYMM int, DenominatorType string"
ROWS = [("k1", "A", "Site", 5.0, 100.0, "S1", 202301, "Visits"), ("k1", "B", "Site", 3.0, 80.0, "S1", 202301, "Visits"), ("k3", "A", "Site", 2.0, 100.0, "S1", 202301, "Visits"), ("k3", "B", "Site", 1.0, 80.0, "S1", 202301, "Visits")]


@pytest.fixture(scope="module")
def metrics(spark):
    return spark.createDataFrame([("k1", "Visits", 5.0), ("k3", "Visits", 5.0)], "MetricID string, Denominator string, AccrualThreshold double")


def test_join(spark, metrics):
    wide = reshape.join_kri_by_denominator(spark.createDataFrame(ROWS, KRI), metrics)["Visits"]
    assert sorted((r["Denominator"], r["Numerator_k1"], r["Numerator_k3"]) for r in wide.collect()) == [(80.0, 3.0, 1.0), (100.0, 5.0, 2.0)]


@pytest.mark.parametrize(("change", "text"), [({4: 99.0}, "different Denominator"), ({2: "Country"}, "different GroupLevel"), ({2: None}, "missing or empty")])
def test_join_errors(spark, metrics, change, text):
    bad = [*ROWS[:3], tuple(change.get(k, v) for k, v in enumerate(ROWS[3]))]
    with pytest.raises(ValidationError, match=text):
        reshape.join_kri_by_denominator(spark.createDataFrame(bad, KRI), metrics)


def test_join_threshold_error(spark, metrics):
    other = spark.createDataFrame([("k1", "Visits", 5.0), ("k3", "Visits", 9.0)], metrics.schema)
    with pytest.raises(ValidationError, match="AccrualThreshold"):
        reshape.join_kri_by_denominator(spark.createDataFrame(ROWS, KRI), other)
    with pytest.raises(ValidationError, match="DenominatorType"):
        reshape.join_kri_by_denominator(spark.createDataFrame(ROWS, KRI).drop("DenominatorType"), metrics)


def test_long(spark):
    wide = spark.createDataFrame([("S1", 1, 0.1, 0.2, 0.3, 0.4, 9), ("S2", 1, 0.5, 0.6, 0.7, 0.8, 9)], "StudyID string, StudyMonth int, Median_k1 double, Lower_k1 double, Median_my_id double, Lower_my_id double, BootstrapCount int")
    out = reshape.transform_long({"Visits": wide})
    assert out.columns[:2] == ["MetricID", "DenominatorType"]
    assert sorted((r["MetricID"], r["StudyID"], r["Median"], r["Lower"]) for r in out.collect()) == [("k1", "S1", 0.1, 0.2), ("k1", "S2", 0.5, 0.6), ("my_id", "S1", 0.3, 0.4), ("my_id", "S2", 0.7, 0.8)]
    assert reshape.transform_long({"Visits": wide.limit(0)}).columns == out.columns
    for bad, text in (({}, "non-empty"), ({"": wide}, "named elements"), ({"x": 1}, "Element 'x'")):
        with pytest.raises(ValidationError, match=text):
            reshape.transform_long(bad)


def test_bind(spark):
    a, b = spark.createDataFrame([(1, "x"), (2, "y")], "a int, b string"), spark.createDataFrame([(4, "z")], "a int, b string")
    out = reshape.bind_results({"m1": {"T": a}, "m2": {"lData": {"T": b}, "T": b}}, "T", "2024-01-31", "S1", True)
    assert out.columns == ["a", "b", "MetricID", "SnapshotDate", "StudyID"] and out.count() == 3
    assert out.first()["SnapshotDate"] == dt.date(2024, 1, 31)
    assert reshape.bind_lists({"a": 1}, x={"a": 2}) == [("a", 1), ("a", 2)]


def test_registry():
    assert registry.parse_function("pkg::Transform_CumCount") is registry.parse_function("Transform_CumCount")
    for bad in ("1 + 1", "nope", 3):
        with pytest.raises(ValidationError):
            registry.parse_function(bad)
    assert [registry.plain_name(n) for n in ("strStudyCol", "dfInput", "nBootstrapReps", "vBy", "lWide", "bMixStudies", "dSnapshotDate")] == ["study_col", "input", "bootstrap_reps", "by", "wide", "mix_studies", "snapshot_date"]


def test_spec(spark):
    df = spark.createDataFrame([("1", "2024-01-05", "x"), ("z", "never", "y")], "subj string, day string, extra string")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = apply_spec(df, [ColumnSpec("n", "integer", "subj"), ColumnSpec("day", "Date")], "AE", report_unparsable=True)
    assert out.collect() == [(1, dt.date(2024, 1, 5)), (None, None)]
    assert len([w for w in seen if "could not be parsed" in str(w.message)]) == 2
    with pytest.raises(ValidationError, match="missing required columns: nope"):
        apply_spec(df, [ColumnSpec("nope")])


SUBJ = "subjid string, enrollyn string, invid string, siteid string, studyid string"


@pytest.fixture(scope="module")
def raw(spark):
    subj = [(f"p{k}", "N" if k % 10 == 0 else "Y", f"i{k % 5}", f"s{k % 5}", "OLD") for k in range(50)]
    ae = [(f"p{k % 50}", f"i{k % 5}", f"e{k}") for k in range(200)]
    return {"Raw_SUBJ": spark.createDataFrame(subj, SUBJ), "Raw_AE": spark.createDataFrame(ae, "subjid string, invid string, aedesc string"), "Raw_STUDY": spark.createDataFrame([("OLD", "t")], "studyid string, name string")}


def test_resample(raw):
    out = simulate.resample_study(raw, "NEW", 30, seed=4)
    subj = out["Raw_SUBJ"].collect()
    assert 0 < len(subj) <= 30 and {r["studyid"] for r in subj} == {"NEW"} and all(r["subjid"].startswith("NEW_") and r["enrollyn"] == "Y" for r in subj)
    assert {r["subjid"] for r in out["Raw_AE"].collect()} <= {r["subjid"] for r in subj}
    assert out["Raw_AE"].columns == ["subjid", "invid", "aedesc", "studyid"]
    assert [r["studyid"] for r in out["Raw_STUDY"].collect()] == ["NEW"]
    assert sorted(map(tuple, subj)) == sorted(map(tuple, simulate.resample_study(raw, "NEW", 30, seed=4)["Raw_SUBJ"].collect()))
    exact = simulate.resample_study(raw, "NEW", 20, replacement=False)["Raw_SUBJ"]
    assert exact.count() == 20
    sites = simulate.resample_study(raw, "T1", 30, target_site_count=3)["Raw_SUBJ"].select("invid").distinct().collect()
    assert {r[0] for r in sites} <= {"T1_1", "T1_2", "T1_3"}
    site = raw["Raw_SUBJ"].sparkSession.createDataFrame([(f"i{k}", "OLD", f"City {k}", str(k)) for k in range(5)], "invid string, studyid string, city string, site_num string")
    both = simulate.resample_study({**raw, "Raw_SITE": site}, "T1", 30, target_site_count=3)
    assert {r["invid"] for r in both["Raw_SITE"].collect()} == {r["invid"] for r in both["Raw_SUBJ"].collect()} <= {"T1_1", "T1_2", "T1_3"}
    assert all(r["studyid"] == "T1" and r["city"].startswith("City ") and r["invid"] == f"T1_{r['site_num']}" for r in both["Raw_SITE"].collect())
    kept = simulate.resample_study({**raw, "Raw_SITE": site}, "T2", 30)
    assert {r["invid"] for r in kept["Raw_SUBJ"].collect()} <= {r["invid"] for r in kept["Raw_SITE"].collect()} <= {f"T2_i{k}" for k in range(5)}
    with pytest.raises(ValidationError, match="Cannot sample 99 subjects without replacement from 45 available subjects"):
        simulate.resample_study(raw, "NEW", 99, replacement=False)


def test_portfolio(raw):
    out = simulate.simulate_portfolio(raw, [{"studyid": "A", "nSubjects": 10, "other": 1}, {"studyid": "B", "nSubjects": 5}])
    assert {r["studyid"] for r in out["Raw_SUBJ"].collect()} == {"A", "B"}
    for bad, text in (([{"studyid": "A"}], "must contain columns"), ([{"studyid": "A", "nSubjects": 1}] * 2, "duplicate")):
        with pytest.raises(ValidationError, match=text):
            simulate.simulate_portfolio(raw, bad)


def test_screening_failures(spark):
    enrolled = spark.createDataFrame([(f"s{k}", f"ST{k % 7 // 4}", f"site{k % 7}", "Y") for k in range(70)], "subjid string, studyid string, siteid string, enrollyn string")
    source = spark.createDataFrame([(f"q{k}", "X", "src", "N" if k < 2 else "Y") for k in range(10)], enrolled.schema)
    out = simulate.add_screening_failures(enrolled, source)
    assert {(r["enrollyn"], r["count"]) for r in out.groupBy("enrollyn").count().collect()} == {("Y", 70), ("N", 14)}


def test_workflows(spark):
    day = dt.date
    raw = {
        "Raw_SUBJ": spark.createDataFrame([("S1", f"i{k % 3}", "US", f"p{k}", f"n{k}", "Y", "10", "2023-01-01", "2023-06-30", None, "1", "3", "F", "x") for k in range(12)], "studyid string, invid string, country string, subjid string, subject_nsv string, enrollyn string, timeonstudy string, firstparticipantdate string, lastparticipantdate string, firstdosedate string, timeontreatment string, agerep string, sex string, race string"),
        "Raw_AE": spark.createDataFrame([(f"p{k % 12}", "Y" if k % 4 == 0 else "N", f"2023-0{1 + k % 6}-15", None, "a", "b", "1", "S1") for k in range(40)], "subjid string, aeser string, aest_dt string, aeen_dt string, mdrpt_nsv string, mdrsoc_nsv string, aetoxgr string, studyid string"),
    }
    chosen = [w for w in definitions.mapping_workflows() if w.meta["ID"] in ("AE", "SUBJ", "COUNTRY")]
    mapped = workflow.run_workflows(chosen, raw)
    assert {(r["Param"], r["Value"]) for r in mapped["Mapped_COUNTRY"].collect()} == {("ParticipantCount", "12"), ("SiteCount", "3")}
    flows = definitions.metric_workflows(["kri0001", "kri0002"])
    analyzed = workflow.run_workflows(flows, mapped)
    last = analyzed["Analysis_kri0002"]["Analysis_Transformed"].orderBy("StudyMonth").collect()[-1]
    assert last["Numerator"] == 10 and last["Denominator"] == 12 * 181
    refs = {"Mapped_StudyRef": spark.createDataFrame([("S1", "S1")], "study string, studyref string")}
    metrics = workflow.make_metric(flows)
    assert [(r["MetricID"], r["Metric"], r["AccrualThreshold"]) for r in metrics.collect()] == [("Analysis_kri0001", "Adverse Event Rate per Days on Study", 5.0), ("Analysis_kri0002", "Serious Adverse Event Rate per Days on Study", 5.0)]
    reporting = [w for w in definitions.reporting_workflows(bootstrap_reps=5) if w.meta["ID"] != "Groups"]
    out = workflow.run_workflows(reporting, {**mapped, **refs, "lAnalyzed": analyzed, "lWorkflows": flows})
    assert {r["MetricID"] for r in out["Reporting_Bounds"].select("MetricID").distinct().collect()} == {"Analysis_kri0001", "Analysis_kri0002"}
    made = charts.make_charts(out["Reporting_Results"], out["Reporting_Bounds"], out["Reporting_BoundsRef"], metrics, max_month=6)
    assert [n for n, _ in made] == ["S1_Analysis_kri0001", "S1_Analysis_kri0002"]
    assert made[0][1]["title"] == "Study S1 KRI Comparison" and made[0][1]["subtitle"] == "Comparison Portfolio: 1 studies"
    assert len(definitions.mapping_workflows()) == 18 and len(definitions.metric_workflows()) == 14 and day


def test_charts_and_report(spark, tmp_path):
    lines = spark.createDataFrame([("S_1", "k1", m, m / 10) for m in range(1, 6)], "StudyID string, MetricID string, StudyMonth int, Metric double")
    band = spark.createDataFrame([("S_1", "k1", m, 0.2, 0.1, 0.3) for m in range(1, 6)], "StudyID string, MetricID string, StudyMonth int, Median double, Lower double, Upper double")
    made = charts.make_charts(lines, None, band, log_y=True)
    assert made[0][0] == "S_1_k1" and made[0][1]["y"] == "k1 (log scale)" and made[0][1]["subtitle"] == "Comparison Portfolio Envelope"
    files = report.report_study(made, lines, output_file=str(tmp_path / "out.html"))
    assert list(files) == ["S_1"] and "<svg" in open(files["S_1"]).read() and files["S_1"].endswith("out_S_1.html")
    assert report.report_study([], lines) == {}
    with pytest.raises(ValidationError, match="No data available for study_kri"):
        charts.visualize_study(lines, study_id="none")
    with pytest.raises(ValidationError, match="nMaxMonth must be NULL or a positive number"):
        charts.visualize_study(lines, study_id="S_1", max_month=-1)
