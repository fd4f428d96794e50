import warnings

import pytest

from tideline.operators import bootstrap, bounds, timeline
from tideline.operators.validate import ValidationError

SITE = "StudyID string, GroupID string, MonthYYYYMM int, Numerator double, Denominator double"


def site(spark, rows, study="S1"):
    return spark.createDataFrame([(study, *r) for r in rows], SITE)


def test_cumulative(spark):
    months = (202301, 202302, 202303)
    rows = [("A", m, n, d) for m, n, d in zip(months, (5.0, 10.0, 15.0), (10.0, 20.0, 30.0))] + [("B", m, n, d) for m, n, d in zip(months, (3.0, 8.0, 12.0), (10.0, 20.0, 30.0))]
    out = timeline.cumulative_timeline(site(spark, rows), "StudyID").orderBy("StudyMonth").collect()
    assert [(r["StudyMonth"], r["Numerator"], r["Denominator"], r["Metric"]) for r in out] == [(1, 8, 20, 8 / 20), (2, 26, 60, 26 / 60), (3, 53, 120, 53 / 120)]
    assert out[0]["GroupCount"] == 2


def test_gaps_and_cut(spark):
    rows = [(g, m, n, 10.0) for g, ns in (("A", (5.0, 10.0, 15.0)), ("B", (3.0, 8.0, 12.0))) for m, n in zip((202301, 202303, 202305), ns)]
    df = site(spark, rows)
    out = timeline.cumulative_timeline(df, "StudyID").orderBy("StudyMonth").collect()
    assert [(r["StudyMonth"], r["Numerator"]) for r in out] == [(1, 8), (2, 8), (3, 26), (4, 26), (5, 53)]
    cut = timeline.cumulative_timeline(df, "StudyID", as_of="2023-04-15").orderBy("StudyMonth").collect()
    assert [(r["MonthYYYYMM"], r["Numerator"]) for r in cut] == [(202301, 8), (202302, 8), (202303, 26), (202304, 26)]
    assert timeline.cumulative_timeline(df, "StudyID", as_of="2022-01-01").collect() == []
    months = spark.createDataFrame([(202302,), (202303,)], "MonthYYYYMM int")
    few = timeline.cumulative_timeline(df, "StudyID", months).orderBy("StudyMonth").collect()
    assert [(r["StudyMonth"], r["MonthYYYYMM"]) for r in few] == [(1, 202302), (2, 202303)]


def test_two_numerators_and_zero_denominator(spark):
    df = spark.createDataFrame([("S1", "A", 202301, 5, 2, 50), ("S1", "B", 202301, 3, 1, 50), ("S1", "A", 202302, None, 7, 100), ("S2", "A", 202301, 1, 1, 0), ("S2", "A", None, 1, 1, 9)], "StudyID string, GroupID string, MonthYYYYMM int, Numerator_a int, Numerator_b int, Denominator int")
    out = {(r["StudyID"], r["StudyMonth"]): r for r in timeline.cumulative_timeline(df, "StudyID").collect()}
    assert (out["S1", 2]["Numerator_a"], out["S1", 2]["Numerator_b"]) == (8, 10)
    assert out["S1", 1]["Metric_a"] == 8 / 100 and out["S2", 1]["Metric_a"] is None
    with pytest.raises(ValidationError, match="vBy columns not found in dfInput: nope"):
        timeline.cumulative_timeline(df, "nope")
    with pytest.raises(ValidationError, match="at least one Numerator column"):
        timeline.cumulative_timeline(df.drop("Numerator_a", "Numerator_b"), "StudyID")


def test_bootstrap_draws(spark):
    rows = [(g, m, float(n), 10.0) for g, n in (("A", 1), ("B", 2), ("C", 3)) for m in (202301, 202302)]
    df = site(spark, rows).unionByName(site(spark, rows[:2], "S2"))
    weights = bootstrap.bootstrap_weights(df, 50, seed=3).collect()
    total = {}
    for r in weights:
        total[r["StudyID"], r["BootstrapRep"]] = total.get((r["StudyID"], r["BootstrapRep"]), 0) + r["Weight"]
    assert set(total) == {(s, k) for s in ("S1", "S2") for k in range(1, 51)}
    assert {n for (s, _), n in total.items() if s == "S1"} == {3} and {n for (s, _), n in total.items() if s == "S2"} == {1}
    again = bootstrap.bootstrap_weights(df.repartition(7), 50, seed=3).collect()
    assert sorted(map(tuple, weights)) == sorted(map(tuple, again))
    assert bootstrap.bootstrap_study(df.filter("StudyID = 'S1'"), 10, 5).groupBy("BootstrapRep").count().select("count").distinct().collect() == [(10,)]
    with pytest.raises(ValidationError, match="nBootstrapReps must be a single positive integer"):
        bootstrap.bootstrap_weights(df, 0)


def test_weights_equal_rows(spark):
    rows = [(g, m, float(n + m % 7), 10.0) for n, g in enumerate("ABCDE") for m in (202301 + n, 202302 + n, 202305)]
    df = site(spark, rows)
    lines = bounds.bootstrap_timeline(df, 8, None, "StudyID", "GroupID", None, 5, "md5", None)
    drawn = bootstrap.bootstrap_study(df, 8, seed=5, method="md5")
    plain = timeline.cumulative_timeline(drawn, ["BootstrapRep", "StudyID"])
    pick = lambda d: sorted((r["BootstrapRep"], r["StudyMonth"], r["MonthYYYYMM"], r["Numerator"], r["GroupCount"]) for r in d.collect())
    assert pick(lines) == pick(plain)


def test_bounds_values(spark):
    df = spark.createDataFrame([("S1", 1, k, k / 10) for k in range(1, 11)] + [("S1", 2, 1, None), ("S1", 2, 12, 0.5)], "StudyID string, StudyMonth int, BootstrapRep int, Metric double")
    out = bootstrap.study_bounds(df)
    assert out.columns == ["StudyID", "StudyMonth", "Median", "Lower", "Upper", "BootstrapCount"]
    one, two = out.orderBy("StudyMonth").collect()
    assert one["Median"] == pytest.approx(0.55) and one["Lower"] == pytest.approx(0.1225) and one["BootstrapCount"] == 10
    assert two["Median"] == 0.5 and two["BootstrapCount"] == 12
    with pytest.raises(ValidationError, match="between 0 and 1"):
        bootstrap.study_bounds(df, conf_level=1.5)


@pytest.fixture(scope="module")
def three(spark):
    parts = [site(spark, [(f"{s}{g}", 202301 + m, float(m + 1), float(10 + m)) for g in range(n) for m in range(6)], s) for s, n in (("A", 10), ("B", 8), ("C", 12))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@pytest.mark.parametrize("mix", [False, True])
def test_reference_set(three, mix):
    out = bounds.predict_bounds_ref_set(three, ["A", "B", "C"], 20, mix_studies=mix).orderBy("StudyMonth").collect()
    assert [r["StudyMonth"] for r in out] == [1, 2, 3, 4, 5, 6]
    assert all(r["Lower"] <= r["Median"] <= r["Upper"] and r["GroupCount"] == 8 and r["StudyCount"] == 3 for r in out)


def test_carry_forward(spark):
    lines = spark.createDataFrame([("t", "a", 1, 1, 0.1), ("t", "a", 1, 2, 0.2), ("t", "b", 1, 1, 0.5)], "_target string, _ref string, BootstrapRep int, StudyMonth long, Metric double")
    out = bounds.carry_forward(lines, ["_target", "_ref", "BootstrapRep"], ["_target", "BootstrapRep"]).collect()
    assert sorted((r["_ref"], r["StudyMonth"], r["Metric"]) for r in out) == [("a", 1, 0.1), ("a", 2, 0.2), ("b", 1, 0.5), ("b", 2, 0.5)]


def test_reference_targets(spark, three):
    ref = spark.createDataFrame([("X", "B"), ("X", "A"), ("X", "NONE"), ("Y", "NONE")], "study string, studyref string")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        out = bounds.predict_bounds_ref(three, ref, 10).collect()
    assert any("Skipping study 'Y': none of its reference studies found in data." in str(w.message) for w in seen)
    assert {(r["StudyID"], r["StudyRefID"], r["StudyCount"], r["GroupCount"]) for r in out} == {("X", "B, A", 2, 8)}
    fixed = spark.createDataFrame([("X", "A", 3), ("X", "B", 3)], "study string, studyref string, MinGroups int")
    assert {r["GroupCount"] for r in bounds.predict_bounds_ref(three, fixed, 5).collect()} == {3}
    uneven = spark.createDataFrame([("X", "A", 3), ("X", "B", 4)], "study string, studyref string, MinGroups int")
    with pytest.raises(ValidationError, match="nMinGroups must be a single positive integer"):
        bounds.predict_bounds_ref(three, uneven, 5)
    reps = spark.createDataFrame([(k,) for k in range(1, 8)], "BootstrapRep int")
    assert {r["BootstrapCount"] for r in bounds.predict_bounds(three, None, 100, bootstrap_table=reps).collect()} == {7}
    with pytest.raises(ValidationError, match="funCompute is not a function"):
        bounds.predict_bounds_ref(three, ref, 5, compute=3)


def test_what_a_warning_names(spark, three):
    kinds = spark.createDataFrame([(f"type {k:02d}", 1) for k in range(30)], "DenominatorType string, Numerator_k1 int")
    text = bounds.input_context(kinds)
    assert text.startswith(" KRI: k1. DenominatorType: type 00, ") and "type 29." in text
    ref = spark.createDataFrame([(f"T{k:03d}", "NONE") for k in range(120)], "study string, studyref string")
    with warnings.catch_warnings(record=True) as seen:
        warnings.simplefilter("always")
        assert bounds.predict_bounds_ref(three, ref, 2).collect() == []
    texts = [str(w.message) for w in seen]
    assert sum(t.startswith("Skipping study") for t in texts) == 120
    assert any(t.startswith("No results produced: no reference studies found in data for any target study.") for t in texts)


def test_messages_with_counts(three, caplog):
    with caplog.at_level("INFO", logger="tideline.operators.bounds"):
        bounds.predict_bounds(three, None, 2)
        bounds.predict_bounds_ref_set(three, None, 2)
        bounds.predict_bounds_ref_set(three, ["A", "B"], 2, min_groups=4)
    assert [r.getMessage() for r in caplog.records] == [
        "Using all 3 studies found in dfInput",
        "No vStudyFilter specified. Using all 3 studies.",
        "Calculated minimum group count: 8",
        "Using provided minimum group count: 4",
    ]


def test_default_draws(three):
    """Draws by the default hash: as many as groups in every replicate, the same each time, no group favoured."""
    weights = bootstrap.bootstrap_weights(three, 400, seed=3)
    rows = weights.collect()
    per_rep = {}
    for r in rows:
        per_rep[r["StudyID"], r["BootstrapRep"]] = per_rep.get((r["StudyID"], r["BootstrapRep"]), 0) + r["Weight"]
    assert set(per_rep.values()) == {8, 10, 12} and len(per_rep) == 3 * 400
    assert sorted(map(tuple, rows)) == sorted(map(tuple, bootstrap.bootstrap_weights(three.repartition(7), 400, seed=3).collect()))
    total = {}
    for r in rows:
        total[r["StudyID"], r["GroupID"]] = total.get((r["StudyID"], r["GroupID"]), 0) + r["Weight"]
    assert all(330 < n < 470 for n in total.values())
