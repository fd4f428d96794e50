"""The standard workflows: mappings of raw domains, metrics, reporting tables, the study module.

Mappings and metrics are built from the tables below; the text of a filter is
Spark SQL over the table ``df``.
"""

from __future__ import annotations

from tideline.plans.workflow import Step, Workflow
from tideline.sources.io import ColumnSpec

BOOTSTRAP_REPS = 1000
THRESHOLD = 0.95

#: Columns of the raw domains; "name:type" or "name:type:source".
DOMAINS = {
    "AE": "subjid:character aeser:character aest_dt:Date aeen_dt:Date mdrpt_nsv:character mdrsoc_nsv:character aetoxgr:character studyid:character",
    "ENROLL": "studyid:character invid:character country:character subjid:character subjectid:character enrollyn:character enroll_dt:Date",
    "LB": "subjid:character toxgrg_nsv:character lb_dt:Date studyid:character",
    "PD": "subjid:character:subjectenrollmentnumber deemedimportant:character deviationdate:Date companycategory:character studyid:character",
    "SDRGCOMP": "subjid:character sdrgyn:character phase:character mincreated_dts:Date studyid:character",
    "STUDCOMP": "subjid:character compyn:character compreas:character mincreated_dts:Date studyid:character",
    "VISIT": "subjid:character visit_dt:Date visit_folder:character:foldername invid:character peperf:character studyid:character",
    "SUBJ": "studyid:character invid:character country:character subjid:character subject_nsv:character enrollyn:character timeonstudy:integer firstparticipantdate:Date lastparticipantdate:Date firstdosedate:Date timeontreatment:numeric agerep:character sex:character race:character",
    "IE": "studyid:character subjid:character tiver:character ieorres:character iecat:character",
    "Randomization": "studyid:character invid:character subjid:character rand_dt:Date status:character country:character",
    "StudyRef": "studyid:character studyrefid:character",
    "QUERY": "subject_nsv:character:subjectname querystatus:character queryage:integer created:Date resolved:Date studyid:character",
    "DATAENT": "subject_nsv:character:subjectname data_entry_lag:integer min_entereddate:Date studyid:character",
    "DATACHG": "studyid:character subject_nsv:character:subjectname n_changes:integer visit_date:Date visit:character formoid:character",
    "SITE": "studyid:character:protocol invid:character:pi_number InvestigatorFirstName:character:pi_first_name InvestigatorLastName:character:pi_last_name site_status:character City:character:city State:character:state Country:character:country",
    "STUDY": "studyid:character:protocol_number nickname:character protocol_title:character status:character num_plan_site:integer num_plan_subj:integer act_fpfv:Date est_fpfv:Date est_lplv:Date est_lpfv:Date therapeutic_area:character protocol_indication:character phase:character product:character",
}

#: Of two domains, what one mapping alone reads of them.
ENTRIES_OF_CHANGES = "studyid:character subject_nsv:character:subjectname formoid:character min_entereddate:Date visit:character"
SUBJECTS_OF_STUDIES = "studyid:character invid:character subjid:character enrollyn:character"

#: Mappings that take a domain as it is, and that domain's name.
ALIASED = {"AE": "AE", "ENROLL": "ENROLL", "LB": "LB", "PD": "PD", "SDRGCOMP": "SDRGCOMP", "STUDCOMP": "STUDCOMP", "Visit": "VISIT"}

#: Abbreviation, label, numerator's label, domain, filter and date; denominator's label, domain, filter, date and end date; least events, subject key.
METRICS = {
    "kri0001": ("AE", "Adverse Event Rate per Days on Study", "Adverse Events", "AE", None, "aest_dt", "Days on Study", "SUBJ", None, "firstparticipantdate", "lastparticipantdate", 5, "subjid"),
    "kri0002": ("SAE", "Serious Adverse Event Rate per Days on Study", "Serious Adverse Events", "AE", "aeser = 'Y'", "aest_dt", "Days on Study", "SUBJ", None, "firstparticipantdate", "lastparticipantdate", 5, "subjid"),
    "kri0003": ("PD", "Non-Important Protocol Deviation Rate", "Non-Important Protocol Deviations", "PD", "deemedimportant = 'No'", "deviationdate", "Days on Study", "SUBJ", None, "firstparticipantdate", "lastparticipantdate", 5, "subjid"),
    "kri0004": ("IPD", "Important Protocol Deviation Rate", "Important Protocol Deviations", "PD", "deemedimportant = 'Yes'", "deviationdate", "Days on Study", "SUBJ", None, "firstparticipantdate", "lastparticipantdate", 5, "subjid"),
    "kri0005": ("LB", "Grade 3+ Lab Abnormality Rate", "Grade 3+ Abnormal Labs Samples", "LB", "toxgrg_nsv IN ('3', '4')", "lb_dt", "Total Lab Samples", "LB", "toxgrg_nsv IN ('0', '1', '2', '3', '4')", "lb_dt", None, 100, "subjid"),
    "kri0006": ("SDSC", "Study Discontinuation Rate", "Subjects Discontinued - Study", "STUDCOMP", "compyn = 'N'", "mincreated_dts", "Enrolled Subjects", "SUBJ", None, "firstparticipantdate", None, 5, "subjid"),
    "kri0007": ("TDSC", "Treatment Discontinuation Rate", "Subjects Discontinued - Treatment", "SDRGCOMP", "sdrgyn = 'N'", "mincreated_dts", "Enrolled Subjects", "SUBJ", None, "firstparticipantdate", None, 5, "subjid"),
    "kri0008": ("QRY", "Query Rate", "Queries", "QUERY", "querystatus IN ('Open', 'Answered', 'Closed')", "created", "Total Data Points", "DATACHG", None, "min_entereddate", None, 500, "subjid"),
    "kri0009": ("OQRY", "Delayed Query Resolution Rate", "Queries That Were Open > 30 Days", "QUERY", "querystatus IN ('Open', 'Answered', 'Closed') AND queryage > 30", "created", "Total Queries", "QUERY", "querystatus IN ('Open', 'Answered', 'Closed')", "created", None, 100, "subjid"),
    "kri0010": ("ODAT", "Delayed Data Entry Rate", "Data Pages Entered > 10 Days", "DATAENT", "data_entry_lag > 10", "min_entereddate", "Total Data Pages", "DATAENT", None, "min_entereddate", None, 100, "subjid"),
    "kri0011": ("CDAT", "Data Change Rate", "Data Points with 1+ Change", "DATACHG", "n_changes > 0", "min_entereddate", "Total Data Points", "DATACHG", None, "min_entereddate", None, 500, "subjid"),
    "kri0012": ("SF", "Screen Failure Rate", "Screen Failures", "ENROLL", "enrollyn = 'N'", "enroll_dt", "Screened Subjects", "ENROLL", None, "enroll_dt", None, 5, "subjectid"),
    "kri0013": ("PK", "PK Collection Compliance Rate", "PK Samples Collected", "Visit", "peperf = 'Y'", "visit_dt", "PK Samples Expected", "Visit", None, "visit_dt", None, 100, "subjid"),
    "kri0014": ("IE", "Inclusion/Exclusion Violation Rate", "Number of subjects ineligible", "EXCLUSION", "Source != 'Neither'", "enroll_dt", "Enrolled Subjects", "SUBJ", None, "firstparticipantdate", None, 5, "subjid"),
}

#: Metrics drawn on a log scale, and those not drawn on a normal one; kri0008 is drawn on both.
LOG_SCALE = ("kri0001", "kri0002", "kri0003", "kri0004", "kri0005", "kri0007", "kri0008", "kri0011")
NOT_NORMAL = ("kri0001", "kri0002", "kri0003", "kri0004", "kri0005", "kri0007", "kri0011")

#: What a violated criterion is, and how enrolled subjects are labelled.
VIOLATION = "CASE WHEN iecat = 'EXCL' AND ieorres = '1' THEN 'Y' WHEN iecat = 'INCL' AND ieorres = '0' THEN 'Y' END"
ELIGIBILITY = "ELIGIBILITY CRITERIA"
EXCLUSION_SOURCE = (
    "CASE WHEN ie_violation = 'Y' AND companycategory IS NULL THEN 'EDC I/E' WHEN ie_violation IS NULL AND companycategory IS NOT NULL THEN 'Eligibility IPD' "
    "WHEN ie_violation = 'Y' AND companycategory IS NOT NULL THEN 'Ineligible, Both Criteria' ELSE 'Neither' END"
)


def _spec(columns: str) -> list[ColumnSpec]:
    return [ColumnSpec(*c.split(":")) for c in columns.split()]


def _query(output: str, table: str, sql: str) -> Step:
    return Step(output, "RunQuery", {"df": table, "strQuery": sql})


def _join(output: str, x: str, y: str, by: list[str]) -> Step:
    return Step(output, "left_join", {"x": x, "y": y, "by": by})


def _long(output: str, data: str, level: str) -> Step:
    return Step(output, "MakeLongMeta", {"data": data, "strGroupLevel": level})


def _share(output: str, data: str, current: str, target: str, value: str, text: str) -> Step:
    return Step(output, "CalculatePercentage", {"data": data, "strCurrentCol": current, "strTargetCol": target, "strPercVal": value, "strPercStrVal": text})


def _mapping(name: str, steps: list[Step], priority: int = 1, **raw: str) -> Workflow:
    return Workflow({"Type": "Mapped", "ID": name, "Priority": priority}, steps, {f"Raw_{d}": _spec(c) for d, c in raw.items()})


def mapping_workflows() -> list[Workflow]:
    """The 18 mappings of raw domains (Raw_X) to mapped ones (Mapped_X)."""
    plain = [_mapping(name, [Step(f"Mapped_{domain}", "=", {"lhs": f"Mapped_{domain}", "rhs": f"Raw_{domain}"})], **{domain: DOMAINS[domain]}) for name, domain in ALIASED.items()]
    own = lambda *names: {d: DOMAINS[d] for d in names}
    lookup = _query("Subjects", "Mapped_SUBJ", "SELECT subjid, subject_nsv FROM df")
    counts = "count(DISTINCT subjid) AS ParticipantCount, count(DISTINCT invid) AS SiteCount"
    criteria = "SELECT studyid, subjid, array_join(sort_array(array_agg(iecat)), ',') AS iecat_concat, ie_violation FROM df GROUP BY studyid, subjid, ie_violation"
    return [
        *plain,
        _mapping("SUBJ", [_query("Mapped_SUBJ", "Raw_SUBJ", "SELECT * FROM df WHERE enrollyn = 'Y'")], **own("SUBJ")),
        _mapping("IE", [_query("Flagged", "Raw_IE", f"SELECT *, {VIOLATION} AS ie_violation FROM df"), _query("Mapped_IE", "Flagged", "SELECT * FROM df WHERE subjid IS NOT NULL AND ie_violation = 'Y'")], **own("IE")),
        _mapping("Randomization", [_query("Mapped_Randomization", "Raw_Randomization", "SELECT studyid, invid, subjid, rand_dt, status, country FROM df WHERE subjid IS NOT NULL AND (status != 'Screen Failed' OR status IS NULL)")], **own("Randomization")),
        _mapping("StudyRef", [_query("Mapped_StudyRef", "Raw_StudyRef", "SELECT studyid AS study, studyrefid AS studyref FROM df")], **own("StudyRef")),
        _mapping("DATAENT", [lookup, _join("Mapped_DATAENT", "Raw_DATAENT", "Subjects", ["subject_nsv"])], 2, **own("DATAENT")),
        _mapping("QUERY", [lookup, _join("Mapped_QUERY", "Raw_QUERY", "Subjects", ["subject_nsv"])], 2, **own("QUERY")),
        _mapping("DATACHG", [_query("Subjects", "Mapped_SUBJ", "SELECT subjid, subject_nsv, studyid FROM df"), _join("Changes", "Raw_DATACHG", "Subjects", ["subject_nsv", "studyid"]), _join("Mapped_DATACHG", "Changes", "Raw_DATAENT", ["formoid", "visit", "subject_nsv", "studyid"])], 2, **own("DATACHG"), DATAENT=ENTRIES_OF_CHANGES),
        _mapping("EXCLUSION", [_query("Criteria", "Mapped_IE", criteria), _join("WithCriteria", "Mapped_ENROLL", "Criteria", ["subjid", "studyid"]), _query("Deviations", "Mapped_PD", f"SELECT DISTINCT studyid, subjid, companycategory FROM df WHERE companycategory = '{ELIGIBILITY}'"), _join("Both", "WithCriteria", "Deviations", ["subjid", "studyid"]), _query("Mapped_EXCLUSION", "Both", f"SELECT *, {EXCLUSION_SOURCE} AS Source FROM df WHERE enrollyn = 'Y'")], 2),
        _mapping("COUNTRY", [_query("Counts", "Mapped_SUBJ", f"SELECT country AS GroupID, {counts} FROM df GROUP BY country"), _long("Mapped_COUNTRY", "Counts", "Country")], 3),
        _mapping("SITE", [_query("Attributes", "Raw_SITE", "SELECT invid AS GroupID, * FROM df"), _long("LongAttributes", "Attributes", "Site"), _query("Counts", "Mapped_SUBJ", f"SELECT invid AS GroupID, {counts} FROM df GROUP BY invid"), _long("LongCounts", "Counts", "Site"), Step("Mapped_SITE", "bind_rows", {"a": "LongAttributes", "b": "LongCounts"})], 3, **own("SITE")),
        _mapping(
            "STUDY",
            [
                _query("Attributes", "Raw_STUDY", "SELECT studyid AS GroupID, * FROM df"),
                _long("LongAttributes", "Attributes", "Study"),
                _query("Targets", "Raw_STUDY", "SELECT studyid AS GroupID, num_plan_site AS SiteTarget, num_plan_subj AS ParticipantTarget FROM df"),
                _query("Counts", "Raw_SUBJ", f"SELECT studyid AS GroupID, {counts} FROM df WHERE enrollyn = 'Y' GROUP BY studyid"),
                _join("Both", "Targets", "Counts", ["GroupID"]),
                _share("Sites", "Both", "SiteCount", "SiteTarget", "PercentSitesActivated", "SiteActivation"),
                _share("Participants", "Sites", "ParticipantCount", "ParticipantTarget", "PercentParticipantsEnrolled", "ParticipantEnrollment"),
                _long("LongCounts", "Participants", "Study"),
                Step("Mapped_STUDY", "bind_rows", {"a": "LongAttributes", "b": "LongCounts"}),
            ],
            3,
            **own("STUDY"),
            SUBJ=SUBJECTS_OF_STUDIES,
        ),
    ]


def metric_workflows(names: list[str] | None = None) -> list[Workflow]:
    """Per metric: filters, site-month counts, study timeline; published as Analysis_<id>."""
    out = []
    for metric, (short, label, events, num, num_filter, num_date, kind, den, den_filter, den_date, den_end, least, subject) in METRICS.items():
        if names and metric not in names:
            continue
        meta = {"Type": "Analysis", "ID": metric, "GroupLevel": "Site", "Abbreviation": short, "Metric": label, "Numerator": events, "Denominator": kind, "Model": "Bootstrap CI", "Score": "Bootstrap CI", "AnalysisType": "rate"}
        meta |= {"Threshold": THRESHOLD, "AccrualThreshold": least, "AccrualMetric": "Denominator", "BootstrapReps": BOOTSTRAP_REPS}
        steps, numerator, denominator = [], f"Mapped_{num}", f"Mapped_{den}"
        if num_filter:
            steps.append(_query("Events", numerator, f"SELECT * FROM df WHERE {num_filter}"))
            numerator = "Events"
        if den_filter:
            steps.append(_query("Base", denominator, f"SELECT * FROM df WHERE {den_filter}"))
            denominator = "Base"
        subjects = "Mapped_ENROLL" if num == den == "ENROLL" else "Mapped_SUBJ"
        params = {"dfSubjects": subjects, "dfNumerator": numerator, "dfDenominator": denominator, "strStudyCol": "studyid", "strGroupCol": "invid", "strGroupLevel": "GroupLevel", "strSubjectCol": subject, "strNumeratorDateCol": num_date, "strDenominatorDateCol": den_date, "strDenominatorType": "Denominator", "nMinDenominator": "AccrualThreshold"}
        if den_end:
            params["strDenominatorEndDateCol"] = den_end
        steps += [Step("Analysis_Input", "Input_CountSiteByMonth", params), Step("Analysis_Transformed", "Transform_CumCount", {"dfInput": "Analysis_Input", "vBy": ["StudyID"]}), Step("lAnalysis", "list", {"ID": "ID", "Analysis_Input": "Analysis_Input", "Analysis_Transformed": "Analysis_Transformed"})]
        out.append(Workflow(meta, steps))
    return out


def reporting_workflows(bootstrap_reps: int = BOOTSTRAP_REPS, threshold: float = THRESHOLD, mix_studies: bool = False) -> list[Workflow]:
    """Input, Results, Metrics, Groups, Join, Bounds and BoundsRef; the data hold lAnalyzed, lWorkflows and the mapped domains.

    They are given in an order in which each finds what it needs.
    """
    meta = lambda name, priority, **more: {"Type": "Reporting", "ID": name, "Priority": priority, **more}
    boot = {"BootstrapReps": bootstrap_reps, "Threshold": threshold, "bMixStudies": mix_studies}
    return [
        Workflow(meta("Input", 1), [Step("lInput", "BindResults", {"lAnalysis": "lAnalyzed", "strName": "Analysis_Input"})]),
        Workflow(meta("Results", 1), [Step("lResults", "BindResults", {"lAnalysis": "lAnalyzed", "strName": "Analysis_Transformed"})]),
        Workflow(meta("Metrics", 1), [Step("lMetrics", "MakeMetric", {"lWorkflows": "lWorkflows"})]),
        Workflow(meta("Groups", 1), [Step("lGroups", "bind_rows", {"a": "Mapped_STUDY", "b": "Mapped_SITE", "c": "Mapped_COUNTRY"})]),
        Workflow(meta("Join", 2), [Step("lJoined", "JoinKRIByDenominator", {"dfInput": "Reporting_Input", "dfMetrics": "Reporting_Metrics"})]),
        Workflow(meta("Bounds", 3, **boot), [Step("Predict", "ParseFunction", {"strFunction": "Analyze_PredictBounds"}), Step("lBounds", "map", {".x": "Reporting_Join", ".f": "Predict", "dfStudyRef": "Mapped_StudyRef", "nBootstrapReps": "BootstrapReps", "nConfLevel": "Threshold"}), Step("lLong", "Transform_Long", {"lWide": "lBounds"})]),
        Workflow(meta("BoundsRef", 3, **boot), [Step("Predict", "ParseFunction", {"strFunction": "Analyze_PredictBoundsRef"}), Step("lBounds", "map", {".x": "Reporting_Join", ".f": "Predict", "dfStudyRef": "Mapped_StudyRef", "nBootstrapReps": "BootstrapReps", "nConfLevel": "Threshold", "bMixStudies": "bMixStudies"}), Step("lLong", "Transform_Long", {"lWide": "lBounds"})]),
    ]


def module_workflow() -> Workflow:
    """Charts on both scales and a report for each study; see charts and report."""
    pick = lambda ids: ", ".join(f"'Analysis_{i}'" for i in ids)
    common = {"dfBounds": "Reporting_Bounds", "dfBoundsRef": "Reporting_BoundsRef", "dfMetrics": "Reporting_Metrics", "nMaxMonth": None}
    return Workflow(
        {"Type": "Module", "ID": "Study"},
        [
            _query("Log", "Reporting_Results", f"SELECT * FROM df WHERE MetricID IN ({pick(LOG_SCALE)})"),
            _query("Normal", "Reporting_Results", f"SELECT * FROM df WHERE MetricID NOT IN ({pick(NOT_NORMAL)})"),
            Step("lLog", "MakeCharts", {"dfResults": "Log", **common, "bLogY": True}),
            Step("lNormal", "MakeCharts", {"dfResults": "Normal", **common}),
            Step("lCharts", "BindLists", {"a": "lLog", "b": "lNormal"}),
            Step("lReport", "Report", {"lCharts": "lCharts", "dfResults": "Reporting_Results", "dfGroups": "Reporting_Groups", "dfMetrics": "Reporting_Metrics", "strOutputFile": "strOutputFile", "strInputPath": "strInputPath"}),
        ],
    )
