"""All standard workflows on small domains with values worked out by hand, and workflows read from YAML."""

import datetime as dt

import pytest

from tideline.operators.validate import ValidationError
from tideline.plans import definitions, workflow

MONTHS = ["2023-01-10", "2023-02-10", "2023-03-10"]


@pytest.fixture(scope="module")
def raw(spark):
    """Two studies of 20 subjects on two sites each; every fourth subject of S1 wasn't enrolled."""
    subj, enroll, facts = [], [], {k: [] for k in ("AE", "LB", "PD", "SDRGCOMP", "STUDCOMP", "VISIT", "IE", "QUERY", "DATAENT", "DATACHG", "Randomization")}
    for study in ("S1", "S2"):
        for k in range(20):
            i, site, yes = f"{study}-{k}", f"{study}-site{k % 2}", "N" if study == "S1" and k % 4 == 3 else "Y"
            subj.append((study, site, "US" if k % 2 else "DE", i, f"n{i}", yes, "60", "2023-01-01", "2023-03-01", "2023-01-02", "50", "40", "F", "x"))
            enroll.append((study, site, "US", i, f"e{i}", yes, "2023-01-05"))
            for m, day in enumerate(MONTHS):
                facts["AE"].append((i, "Y" if m == 0 else "N", day, None, "t", "s", "3", study))
                facts["LB"] += [(i, str(g), day, study) for g in range(6)]
                facts["PD"].append((i, "Yes" if m else "No", day, "ELIGIBILITY CRITERIA" if m == 0 and k % 5 == 0 else "OTHER", study))
                facts["VISIT"].append((i, day, f"v{m}", site, "Y" if m == 1 else "N", study))
                facts["QUERY"] += [(f"n{i}", "Open", "40", day, None, study), (f"n{i}", "Closed", "3", day, day, study), (f"n{i}", "Cancelled", "90", day, None, study)]
                facts["DATAENT"].append((f"n{i}", str(12 if m == 2 else 1), day, study, f"v{m}", "f1"))
                facts["DATACHG"] += [(study, f"n{i}", str(c), day, f"v{m}", "f1") for c in range(30)]
            facts["SDRGCOMP"].append((i, "N" if k % 2 else "Y", "1", "2023-02-01", study))
            facts["STUDCOMP"].append((i, "N" if k < 5 else "Y", None, "2023-02-01", study))
            facts["IE"] += [(study, i, "INCL", "1", "EXCL" if k % 10 == 0 else "INCL"), (study, i, "EXCL", "0" if k % 10 == 1 else "1", "INCL")]
            facts["Randomization"].append((study, site, None if k == 0 else i, "2023-01-06", "Screen Failed" if k == 1 else None, "US"))
    text = lambda names: ", ".join(f"{n} string" for n in names.split())
    schemas = {
        "SUBJ": "studyid invid country subjid subject_nsv enrollyn timeonstudy firstparticipantdate lastparticipantdate firstdosedate timeontreatment agerep sex race",
        "ENROLL": "studyid invid country subjid subjectid enrollyn enroll_dt",
        "AE": "subjid aeser aest_dt aeen_dt mdrpt_nsv mdrsoc_nsv aetoxgr studyid",
        "LB": "subjid toxgrg_nsv lb_dt studyid",
        "PD": "subjectenrollmentnumber deemedimportant deviationdate companycategory studyid",
        "SDRGCOMP": "subjid sdrgyn phase mincreated_dts studyid",
        "STUDCOMP": "subjid compyn compreas mincreated_dts studyid",
        "VISIT": "subjid visit_dt foldername invid peperf studyid",
        "IE": "studyid subjid tiver ieorres iecat",
        "QUERY": "subjectname querystatus queryage created resolved studyid",
        "DATAENT": "subjectname data_entry_lag min_entereddate studyid visit formoid",
        "DATACHG": "studyid subjectname n_changes visit_date visit formoid",
        "Randomization": "studyid invid subjid rand_dt status country",
        "StudyRef": "studyid studyrefid",
        "SITE": "protocol pi_number pi_first_name pi_last_name site_status city state country",
        "STUDY": "protocol_number nickname protocol_title status num_plan_site num_plan_subj act_fpfv est_fpfv est_lplv est_lpfv therapeutic_area protocol_indication phase product",
    }
    rows = {
        **facts,
        "SUBJ": subj,
        "ENROLL": enroll,
        "StudyRef": [("S1", "S2"), ("S2", "S1")],
        "SITE": [(s, f"{s}-site{k}", "Ann", "Lee", "Active", "Bonn", "NW", "DE") for s in ("S1", "S2") for k in (0, 1)],
        "STUDY": [(s, f"nick{s}", "title", "Active", "4", "30", "2023-01-01", None, None, None, "Onc", "ind", "3", "drug") for s in ("S1", "S2")],
    }
    return {f"Raw_{k}": spark.createDataFrame(rows[k], text(schemas[k])) for k in schemas}


@pytest.fixture(scope="module")
def mapped(raw):
    flows = sorted(definitions.mapping_workflows(), key=lambda w: w.meta["Priority"])
    assert len(flows) == 18
    return {**raw, **workflow.run_workflows(flows, raw)}


def test_mappings(mapped):
    count = {k: df.count() for k, df in mapped.items() if k.startswith("Mapped_")}
    assert count["Mapped_SUBJ"] == 35 and count["Mapped_ENROLL"] == 40 and count["Mapped_AE"] == 120 and count["Mapped_Visit"] == 120
    assert count["Mapped_Randomization"] == 36 and count["Mapped_StudyRef"] == 2 and count["Mapped_QUERY"] == 360 and count["Mapped_DATACHG"] == 3600
    ie = {(r["subjid"], r["iecat"], r["ie_violation"]) for r in mapped["Mapped_IE"].collect()}
    assert ie == {(f"{s}-{k}", "EXCL", "Y") for s in ("S1", "S2") for k in (0, 10)} | {(f"{s}-{k}", "INCL", "Y") for s in ("S1", "S2") for k in (1, 11)}
    source = {}
    for r in mapped["Mapped_EXCLUSION"].collect():
        source[r["Source"]] = source.get(r["Source"], 0) + 1
    # S1 lacks 3, 7, 11, 15 and 19; 0 and 10 have both, 1 and 11 criteria only, 5 and 15 deviations only
    assert source == {"Ineligible, Both Criteria": 4, "EDC I/E": 3, "Eligibility IPD": 3, "Neither": 25}
    country = {(r["GroupID"], r["Param"], r["Value"]) for r in mapped["Mapped_COUNTRY"].collect()}
    assert country == {("DE", "ParticipantCount", "20"), ("US", "ParticipantCount", "15"), ("DE", "SiteCount", "2"), ("US", "SiteCount", "2")}
    site = {(r["Param"], r["Value"]) for r in mapped["Mapped_SITE"].filter("GroupID = 'S1-site1'").collect()}
    assert {("InvestigatorLastName", "Lee"), ("City", "Bonn"), ("site_status", "Active"), ("studyid", "S1"), ("invid", "S1-site1"), ("ParticipantCount", "5"), ("SiteCount", "1")} == site - {("InvestigatorFirstName", "Ann"), ("State", "NW"), ("Country", "DE")}
    study = {r["Param"]: r["Value"] for r in mapped["Mapped_STUDY"].filter("GroupID = 'S1'").collect()}
    assert study["product"] == "drug" and study["therapeutic_area"] == "Onc" and study["ParticipantCount"] == "15" and study["SiteCount"] == "2" and study["PercentParticipantsEnrolled"] == "50.0" and study["SiteActivation"].startswith("2 / 4")
    assert mapped["Mapped_DATACHG"].filter("subjid is null").select("subject_nsv").distinct().count() == 5
    assert mapped["Mapped_DATACHG"].filter("min_entereddate is null").isEmpty()


#: Last cumulated numerator and denominator of S2, whose 20 subjects are all enrolled, with a least denominator of 0.
WANT = {
    "kri0001": (60, 20 * 60),
    "kri0002": (20, 20 * 60),
    "kri0003": (20, 20 * 60),
    "kri0004": (40, 20 * 60),
    "kri0005": (120, 300),
    "kri0006": (5, 20),
    "kri0007": (10, 20),
    "kri0008": (120, 1800),
    "kri0009": (60, 120),
    "kri0010": (20, 60),
    "kri0011": (20 * 3 * 29, 1800),
    "kri0012": (0, 20),
    "kri0013": (20, 60),
    "kri0014": (6, 20),
}


@pytest.fixture(scope="module")
def analyzed(mapped):
    flows = definitions.metric_workflows()
    for w in flows:
        w.meta["AccrualThreshold"] = 0
    return workflow.run_workflows(flows, mapped)


@pytest.mark.parametrize("name", sorted(WANT))
def test_metrics(analyzed, name):
    last = {r["StudyID"]: r for r in analyzed[f"Analysis_{name}"]["Analysis_Transformed"].orderBy("StudyMonth").collect()}["S2"]
    assert (last["Numerator"], last["Denominator"]) == WANT[name]


def test_screen_failures(analyzed):
    last = {r["StudyID"]: r for r in analyzed["Analysis_kri0012"]["Analysis_Transformed"].orderBy("StudyMonth").collect()}["S1"]
    assert (last["Numerator"], last["Denominator"]) == (5, 20)


def test_meta():
    flows = {w.meta["ID"]: w.meta for w in definitions.metric_workflows()}
    assert len(flows) == 14 and {m["AccrualMetric"] for m in flows.values()} == {"Denominator"} and {m["Model"] for m in flows.values()} == {"Bootstrap CI"}
    assert flows["kri0010"]["Metric"] == "Delayed Data Entry Rate" and flows["kri0010"]["Abbreviation"] == "ODAT" and flows["kri0014"]["Numerator"] == "Number of subjects ineligible"
    steps = {s.output: s.params for s in definitions.module_workflow().steps}
    assert "kri0006" not in steps["Log"]["strQuery"] and all(m in steps["Log"]["strQuery"] for m in ("kri0001", "kri0008", "kri0011"))


def test_reports(mapped, analyzed, tmp_path):
    chosen = ("Analysis_kri0001", "Analysis_kri0005", "Analysis_kri0008")
    flows = definitions.metric_workflows(["kri0001", "kri0005", "kri0008"])
    for w in flows:
        w.meta["AccrualThreshold"] = 0
    reporting = definitions.reporting_workflows(bootstrap_reps=5)
    assert len(reporting) == 7
    out = workflow.run_workflows(reporting, {**mapped, "lAnalyzed": {k: analyzed[k] for k in chosen}, "lWorkflows": flows})
    assert out["Reporting_Groups"].select("GroupLevel").distinct().count() == 3
    template = tmp_path / "page.html"
    template.write_text("<html>{title}|{body}</html>")
    files = workflow.run_workflow(definitions.module_workflow(), {**mapped, **out, "strOutputFile": str(tmp_path / "r.html"), "strInputPath": str(template)})
    assert sorted(files) == ["S1", "S2"]
    text = open(files["S1"]).read()
    # kri0001 and kri0005 are drawn on the log scale only, kri0008 on both
    assert text.startswith("<html>S1|") and text.count("<svg") == 4 and text.count("(log scale)") == 3 and "Adverse Event Rate per Days on Study" in text


YAML = """
meta:
  Type: Analysis
  ID: y1
  GroupLevel: Site
  Reps: 3
spec:
  Raw_A:
    subjid:
      type: character
      source_col: subject
    day:
      type: Date
steps:
  - output: Mapped_A
    name: =
    params:
      lhs: Mapped_A
      rhs: Raw_A
  - output: Kept
    name: other::RunQuery
    params:
      df: Mapped_A
      strQuery: "SELECT * FROM df WHERE site == 'x'"
  - output: Named
    name: dplyr::select
    params:
      .data: Kept
      who: subjid
      date: day
  - output: Wide
    name: dplyr::left_join
    params:
      x: Named
      'y': Other
      by: who
  - output: Func
    name: pkg::ParseFunction
    params:
      strFunction: pkg::TheirName
  - output: Counted
    name: purrr::map
    params:
      .x: lTables
      .f: Func
      strBy: Reps
  - output: Out
    name: list
    params:
      Wide: Wide
      Counted: Counted
      Nothing: null
"""


def test_yaml(spark, tmp_path):
    from tideline.plans import registry

    (tmp_path / "b.yaml").write_text(YAML)
    (tmp_path / "a.yaml").write_text("meta: {Type: Mapped, ID: first, Priority: 2}\nsteps: [{output: Mapped_first, name: '=', params: {lhs: Mapped_first, rhs: Raw_A}}]\n")
    flows = workflow.load_workflows(tmp_path)
    assert [w.meta["ID"] for w in flows] == ["y1", "first"] and [w.meta["ID"] for w in workflow.load_workflows(tmp_path, ["first"])] == ["first"]
    registry.register("CountRows", lambda input, by: (input.count(), by))
    data = {"Raw_A": spark.createDataFrame([("1", "2024-01-05", "x"), ("2", "2024-02-05", "y")], "subject string, day string, site string"), "Other": spark.createDataFrame([("1", 7)], "who string, n int")}
    data["lTables"] = {"a": data["Raw_A"], "b": data["Other"]}
    out = workflow.run_workflow(flows[0], data, aliases={"TheirName": "CountRows"})
    assert [tuple(r) for r in out["Wide"].collect()] == [("1", dt.date(2024, 1, 5), 7)]
    assert out["Counted"] == {"a": (2, 3), "b": (1, 3)} and out["Nothing"] is None
    with pytest.raises(ValidationError, match="Failed to parse 'pkg::TheirName' as a function"):
        workflow.run_workflow(flows[0], data)
