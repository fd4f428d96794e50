"""The registered analytics queries and their SQL, over the star-schema tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.calendar import month_sequence
from tideline.functions.draws import draw_index, uniform
from tideline.operators import bootstrap, bounds, counts, reshape, simulate, timeline
from tideline.plans import charts, definitions, report, workflow
from tideline.plans.adapter import exposure, orders, read, shipments, study_ref, subjects
from tideline.sources.io import ColumnSpec, apply_spec

AS_OF = "2026-01-01"
REPS = 20
SEED = 7

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql.replace(", 6)", " + 1e-9, 6)")
        return f

    return put


def rounded(df: DataFrame) -> DataFrame:
    """Doubles to six places, moved off the ties first: last bits and the rounding of ties differ between engines."""
    return df.select(*[F.round(F.col(c) + 1e-9, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---------------------------------------------------------------- SQL parts

ORD = """ord AS (
    SELECT c_mktsegment AS studyid, n_name AS invid, c_custkey AS subjid, CAST(o_orderdate AS DATE) AS odate,
           o_orderkey, o_orderstatus, o_orderpriority, o_totalprice
    FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

URGENT = "o_orderpriority = '1-URGENT'"
FINISHED = "o_orderstatus = 'F'"


def ym(date: str) -> str:
    return f"CAST(year({date}) * 100 + month({date}) AS INTEGER)"


def first_of(month: str) -> str:
    return f"make_date(CAST({month} // 100 AS INTEGER), CAST({month} % 100 AS INTEGER), 1)"


def inp(**numerators: str) -> str:
    sums = ", ".join(f"CAST(sum(CASE WHEN {cond} THEN 1 ELSE 0 END) AS BIGINT) AS {name}" for name, cond in numerators.items())
    return f"inp AS (SELECT invid AS GroupID, studyid AS StudyID, {ym('odate')} AS MonthYYYYMM, {sums}, count(*) AS Denominator FROM ord GROUP BY 1, 2, 3)"


def timeline_sql(source: str, by: list[str], nums: list[str], out: str = "cum", grouped: bool = True) -> str:
    """CTEs from monthly rows (by, MonthYYYYMM, nums, Denominator[, GroupCount]) or group rows to a cumulative timeline."""
    keys = ", ".join(by)
    sums = ", ".join(f"sum({n}) AS {n}" for n in [*nums, "Denominator"])
    count = "count(DISTINCT GroupID)" if grouped else "max(GroupCount)"
    same = " AND ".join(f"s.{k} = m.{k}" for k in by)
    zero = ", ".join(f"CAST(coalesce(m.{n}, 0) AS BIGINT) AS {n}" for n in [*nums, "Denominator", "GroupCount"])
    s_keys = ", ".join(f"s.{k}" for k in by)
    run = f"OVER (PARTITION BY {keys} ORDER BY StudyMonth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    cums = ", ".join(f"CAST(sum({n}) {run} AS BIGINT) AS {n}" for n in [*nums, "Denominator"])
    rates = ", ".join(f"CASE WHEN Denominator > 0 THEN round(CAST({n} AS DOUBLE) / Denominator, 6) END AS Metric{n.removeprefix('Numerator')}" for n in nums)
    raw = ", ".join(f"CASE WHEN Denominator > 0 THEN CAST({n} AS DOUBLE) / Denominator END AS Metric{n.removeprefix('Numerator')}" for n in nums)
    return f"""
    {out}_m AS (SELECT {keys}, MonthYYYYMM, {sums}, {count} AS GroupCount FROM {source} GROUP BY {keys}, MonthYYYYMM),
    {out}_r AS (SELECT {keys}, {first_of("min(MonthYYYYMM)")} AS lo, {first_of("max(MonthYYYYMM)")} AS hi FROM {out}_m GROUP BY {keys}),
    {out}_s AS (SELECT {keys}, unnest(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL 1 MONTH)) AS md FROM {out}_r),
    {out}_f AS (SELECT {s_keys}, {ym("s.md")} AS MonthYYYYMM,
        CAST(row_number() OVER (PARTITION BY {s_keys} ORDER BY s.md) AS BIGINT) AS StudyMonth, {zero}
        FROM {out}_s s LEFT JOIN {out}_m m ON {same} AND m.MonthYYYYMM = {ym("s.md")}),
    {out}_c AS (SELECT {keys}, MonthYYYYMM, StudyMonth, {cums}, GroupCount FROM {out}_f),
    {out}_x AS (SELECT *, {raw} FROM {out}_c),
    {out} AS (SELECT *, {rates} FROM {out}_c)"""


def uniform_sql(*keys: str, seed: int = SEED) -> str:
    text = " || '|' || ".join(["'%d'" % seed, *[f"CAST({k} AS VARCHAR)" for k in keys]])
    return f"(CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0)"


def reps_sql(n: int) -> str:
    return f"reps AS (SELECT CAST(unnest(generate_series(1, {n})) AS INTEGER) AS BootstrapRep)"


def weights_sql(groups: str | None = None, reps: int = REPS) -> str:
    """CTEs grp, reps, w: how often each group is drawn in each replicate of each study."""
    draws = groups or "cnt"
    return f"""
    grp AS (SELECT StudyID, GroupID, dense_rank() OVER (PARTITION BY StudyID ORDER BY GroupID) AS gn,
            count(*) OVER (PARTITION BY StudyID) AS cnt FROM (SELECT DISTINCT StudyID, GroupID FROM inp)),
    {reps_sql(reps)},
    d AS (SELECT StudyID, BootstrapRep, cnt, unnest(generate_series(1, CAST({draws} AS BIGINT))) AS pos FROM (SELECT DISTINCT StudyID, cnt FROM grp), reps),
    w AS (SELECT StudyID, BootstrapRep, CAST(floor({uniform_sql("StudyID", "BootstrapRep", "pos")} * cnt) AS BIGINT) + 1 AS gn, count(*) AS Weight FROM d GROUP BY 1, 2, 3)"""


def weighted_sql(nums: list[str]) -> str:
    sums = ", ".join(f"sum(w.Weight * i.{n}) AS {n}" for n in [*nums, "Denominator"])
    return f"""wm AS (SELECT w.BootstrapRep, w.StudyID, i.MonthYYYYMM, {sums}, count(DISTINCT i.GroupID) AS GroupCount
        FROM w JOIN grp ON grp.StudyID = w.StudyID AND grp.gn = w.gn JOIN inp i ON i.StudyID = grp.StudyID AND i.GroupID = grp.GroupID GROUP BY 1, 2, 3)"""


def bounds_sql(source: str, by: str, metrics: list[str], conf: float = 0.95) -> str:
    lo = (1 - conf) / 2
    cols = ", ".join(f"round(quantile_cont({m}, {p}), 6) AS {name}{m.removeprefix('Metric')}" for m in metrics for name, p in (("Median", 0.5), ("Lower", lo), ("Upper", 1 - lo)))
    return f"SELECT {by}StudyMonth, {cols}, max(BootstrapRep) AS BootstrapCount FROM {source} GROUP BY {by}StudyMonth"


# ---------------------------------------------------------------- inputs


def site_months(spark: SparkSession, sf_dir: str, condition: str = URGENT, **kw) -> DataFrame:
    facts = orders(spark, sf_dir)
    return counts.count_site_by_month(subjects(spark, sf_dir), facts.filter(condition), facts, numerator_date_col="order_date", denominator_date_col="order_date", **kw)


def two_kris(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = [site_months(spark, sf_dir, c, denominator_type="Orders").withColumn("MetricID", F.lit(m)) for m, c in (("kriA", URGENT), ("kriB", FINISHED))]
    return parts[0].unionByName(parts[1])


def wide_kris(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.wide_numerators(two_kris(spark, sf_dir), ["kriA", "kriB"])


MONTHLY = f"WITH {ORD}, {inp(Numerator=URGENT)}"
MONTHLY2 = f"WITH {ORD}, {inp(Numerator_kriA=URGENT, Numerator_kriB=FINISHED)}"

# ---------------------------------------------------------------- counts


@query(f"{MONTHLY} SELECT GroupID, 'Site' AS GroupLevel, Numerator, Denominator, round(CAST(Numerator AS DOUBLE) / Denominator, 6) AS Metric, StudyID, MonthYYYYMM FROM inp")
def site_month_counts(spark, sf_dir):
    return rounded(site_months(spark, sf_dir))


DAYS = """SELECT {keys}, {month} AS MonthYYYYMM, CAST(sum(date_diff('day', greatest(s, CAST(md AS DATE)), least(e, last_day(CAST(md AS DATE)))) + 1) AS BIGINT) AS {name}
    FROM (SELECT *, unnest(generate_series(date_trunc('month', CAST(s AS TIMESTAMP)), date_trunc('month', CAST(e AS TIMESTAMP)), INTERVAL 1 MONTH)) AS md FROM {source} WHERE date_trunc('month', s) <= date_trunc('month', e)) GROUP BY {keys}, MonthYYYYMM"""
SPANS = "spans AS (SELECT studyid, invid, subjid, min(odate) AS s, max(odate) AS e FROM ord GROUP BY 1, 2, 3)"
FULL = """SELECT coalesce(n.invid, d.invid) AS GroupID, 'Site' AS GroupLevel, coalesce(n.c, 0) AS Numerator, coalesce(d.c, 0) AS Denominator,
    CASE WHEN coalesce(d.c, 0) <> 0 THEN round(CAST(coalesce(n.c, 0) AS DOUBLE) / d.c, 6) END AS Metric,
    coalesce(n.studyid, d.studyid) AS StudyID, coalesce(n.MonthYYYYMM, d.MonthYYYYMM) AS MonthYYYYMM{more}
    FROM n FULL JOIN d ON n.studyid = d.studyid AND n.invid = d.invid AND n.MonthYYYYMM = d.MonthYYYYMM"""
NUM = "n AS (SELECT studyid, invid, " + ym("odate") + " AS MonthYYYYMM, count(*) AS c FROM {source} GROUP BY 1, 2, 3)"


@query(f"WITH {ORD}, {SPANS}, {NUM.format(source='ord WHERE ' + URGENT)}, d AS ({DAYS.format(keys='studyid, invid', month=ym('md'), name='c', source='spans')}) {FULL.format(more=', ' + chr(39) + 'Days' + chr(39) + ' AS DenominatorType')}")
def site_month_days(spark, sf_dir):
    out = counts.count_site_by_month(subjects(spark, sf_dir), orders(spark, sf_dir).filter(URGENT), exposure(spark, sf_dir), numerator_date_col="order_date", denominator_date_col="first_date", denominator_end_date_col="last_date", denominator_type="Days")
    return rounded(out)


LINES = "lines AS (SELECT studyid, odate AS s, CAST(l_shipdate AS DATE) AS e FROM ord JOIN lineitem ON l_orderkey = o_orderkey)"


@query(f"WITH {ORD}, {LINES} {DAYS.format(keys='studyid', month=ym('md'), name='Days', source='lines')}")
def days_reversed_ranges(spark, sf_dir):
    return counts.days_by_month(shipments(spark, sf_dir), "order_date", "ship_date", ["studyid"])


THRESHOLDS = "lim AS (SELECT studyid, max({col}) AS t FROM (SELECT studyid, {col}, row_number() OVER (PARTITION BY studyid ORDER BY {col}) AS r FROM {source}) WHERE r <= {n} GROUP BY studyid)"


@query(f"WITH {ORD}, {THRESHOLDS.format(col='odate', source='ord', n=200)} SELECT studyid, t AS Threshold FROM lim")
def min_denominator_thresholds(spark, sf_dir):
    return counts.start_thresholds(orders(spark, sf_dir), "studyid", "order_date", 200)


MOVED = "moved AS (SELECT ord.* REPLACE (greatest(odate, t) AS odate) FROM ord JOIN lim ON lim.studyid = ord.studyid)"


@query(f"WITH {ORD}, {THRESHOLDS.format(col='odate', source='ord', n=200)}, {MOVED}, {NUM.format(source='moved WHERE ' + URGENT)}, d AS (SELECT studyid, invid, {ym('odate')} AS MonthYYYYMM, count(*) AS c FROM moved GROUP BY 1, 2, 3) {FULL.format(more='')}")
def min_denominator_shift(spark, sf_dir):
    return rounded(site_months(spark, sf_dir, min_denominator=200))


MOVED_SPANS = "ms AS (SELECT spans.studyid, invid, greatest(s, t) AS s, CAST(e + CAST(date_diff('day', s, greatest(s, t)) AS INTEGER) AS DATE) AS e FROM spans JOIN lim ON lim.studyid = spans.studyid)"


@query(f"WITH {ORD}, {SPANS}, {THRESHOLDS.format(col='s', source='spans', n=50)}, {MOVED}, {MOVED_SPANS}, {NUM.format(source='moved WHERE ' + URGENT)}, d AS ({DAYS.format(keys='studyid, invid', month=ym('md'), name='c', source='ms')}) {FULL.format(more='')}")
def min_denominator_days(spark, sf_dir):
    out = counts.count_site_by_month(subjects(spark, sf_dir), orders(spark, sf_dir).filter(URGENT), exposure(spark, sf_dir), numerator_date_col="order_date", denominator_date_col="first_date", denominator_end_date_col="last_date", min_denominator=50)
    return rounded(out)


@query(f"WITH ev AS (SELECT 'E' AS studyid, event_type AS invid, user_id AS subjid, CAST(ts AS DATE) AS odate FROM events), {NUM.format(source='ev WHERE invid = ' + chr(39) + 'error' + chr(39))}, d AS (SELECT studyid, invid, {ym('odate')} AS MonthYYYYMM, count(*) AS c FROM ev GROUP BY 1, 2, 3) {FULL.format(more='')}")
def counts_without_subjects(spark, sf_dir):
    ev = read(spark, sf_dir, "events").select(F.lit("E").alias("studyid"), F.col("event_type").alias("invid"), F.col("user_id").alias("subjid"), F.to_date("ts").alias("day"))
    return rounded(counts.count_site_by_month(None, ev.filter("invid = 'error'"), ev, numerator_date_col="day", denominator_date_col="day"))


# ---------------------------------------------------------------- timelines

CUM_COLUMNS = "MonthYYYYMM, StudyMonth, {nums}, Denominator, {metrics}, GroupCount"


@query(f"{MONTHLY}, {timeline_sql('inp', ['StudyID'], ['Numerator'])} SELECT StudyID, {CUM_COLUMNS.format(nums='Numerator', metrics='Metric')} FROM cum")
def cum_count_study(spark, sf_dir):
    return rounded(timeline.cumulative_timeline(site_months(spark, sf_dir), "StudyID", as_of=AS_OF))


@query(f"{MONTHLY2}, {timeline_sql('inp', ['StudyID'], ['Numerator_kriA', 'Numerator_kriB'])} SELECT StudyID, {CUM_COLUMNS.format(nums='Numerator_kriA, Numerator_kriB', metrics='Metric_kriA, Metric_kriB')} FROM cum")
def cum_count_multi_numerator(spark, sf_dir):
    return rounded(timeline.cumulative_timeline(wide_kris(spark, sf_dir), "StudyID", as_of=AS_OF))


@query(f"{MONTHLY}, {timeline_sql('inp', ['StudyID', 'GroupID'], ['Numerator'])} SELECT StudyID, GroupID, {CUM_COLUMNS.format(nums='Numerator', metrics='Metric')} FROM cum")
def cum_count_group_by_two(spark, sf_dir):
    return rounded(timeline.cumulative_timeline(site_months(spark, sf_dir), ["StudyID", "GroupID"], as_of=AS_OF))


SPARSE = "MonthYYYYMM % 3 <> 1"


@query(f"{MONTHLY}, sparse AS (SELECT * FROM inp WHERE {SPARSE}), {timeline_sql('sparse', ['StudyID'], ['Numerator'])} SELECT StudyID, MonthYYYYMM, StudyMonth, Numerator, Denominator, GroupCount FROM cum_f")
def study_month_spine(spark, sf_dir):
    return timeline.aggregate_study_month(site_months(spark, sf_dir).filter(SPARSE), ["StudyID"], ["Numerator"], as_of=AS_OF)


@query(f"{MONTHLY}, {timeline_sql('inp', ['StudyID'], ['Numerator'])}, cut AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY StudyID ORDER BY MonthYYYYMM) AS BIGINT) AS sm FROM cum_f WHERE MonthYYYYMM BETWEEN 199601 AND 199712) SELECT StudyID, MonthYYYYMM, sm AS StudyMonth, Numerator, Denominator, GroupCount FROM cut")
def study_month_table(spark, sf_dir):
    months = month_sequence(spark, 199601, 199712)
    return timeline.aggregate_study_month(site_months(spark, sf_dir), ["StudyID"], ["Numerator"], months, as_of=AS_OF)


@query(f"{MONTHLY}, {timeline_sql('inp', ['StudyID'], ['Numerator'])} SELECT StudyID, MonthYYYYMM, StudyMonth, Numerator, Denominator FROM cum_f WHERE MonthYYYYMM <= 199906")
def current_month_cut(spark, sf_dir):
    return timeline.aggregate_study_month(site_months(spark, sf_dir), ["StudyID"], ["Numerator"], as_of="1999-06-15").drop("GroupCount")


@query("SELECT CAST(year(m) * 100 + month(m) AS INTEGER) AS MonthYYYYMM FROM (SELECT unnest(generate_series(TIMESTAMP '2019-11-01', TIMESTAMP '2021-02-01', INTERVAL 1 MONTH)) AS m)")
def month_generator(spark, sf_dir):
    return month_sequence(spark, 201911, 202102)


# ---------------------------------------------------------------- bootstrap


@query(f"{MONTHLY}, {weights_sql()} SELECT StudyID, GroupID, CAST(gn AS BIGINT) AS GroupNumber, cnt AS ActualGroupCount FROM grp")
def group_numbers(spark, sf_dir):
    return bootstrap.group_numbers(site_months(spark, sf_dir))


@query(f"{MONTHLY}, {weights_sql()} SELECT StudyID, BootstrapRep, pos AS Position, round({uniform_sql('StudyID', 'BootstrapRep', 'pos')}, 6) AS Draw, CAST(floor({uniform_sql('StudyID', 'BootstrapRep', 'pos')} * cnt) AS BIGINT) + 1 AS GroupNumber FROM d")
def bootstrap_draws_md5(spark, sf_dir):
    strata = bootstrap.group_numbers(site_months(spark, sf_dir)).select("StudyID", "ActualGroupCount").distinct()
    at = bootstrap.with_replicates(strata, REPS, None).withColumn("Position", F.explode(F.sequence(F.lit(1).cast("long"), "ActualGroupCount")))
    u = uniform(SEED, F.col("StudyID"), F.col("BootstrapRep"), F.col("Position"), method="md5")
    return rounded(at.select("StudyID", "BootstrapRep", "Position", u.alias("Draw"), draw_index(u, F.col("ActualGroupCount")).alias("GroupNumber")))


WEIGHTS = "SELECT w.StudyID, BootstrapRep, GroupID, Weight FROM w JOIN grp ON grp.StudyID = w.StudyID AND grp.gn = w.gn"


@query(f"{MONTHLY}, {weights_sql()} {WEIGHTS}")
def bootstrap_weights(spark, sf_dir):
    return bootstrap.bootstrap_weights(site_months(spark, sf_dir), REPS, seed=SEED, method="md5")


@query(f"{MONTHLY}, {weights_sql('40')} {WEIGHTS}")
def bootstrap_ngroups_up(spark, sf_dir):
    return bootstrap.bootstrap_weights(site_months(spark, sf_dir), REPS, 40, seed=SEED, method="md5")


@query(f"{MONTHLY}, {weights_sql('6')} {WEIGHTS}")
def bootstrap_ngroups_down(spark, sf_dir):
    return bootstrap.bootstrap_weights(site_months(spark, sf_dir), REPS, 6, seed=SEED, method="md5")


@query(f"{MONTHLY}, {weights_sql('6', 5)}, r AS (SELECT grp.StudyID, BootstrapRep, grp.GroupID, MonthYYYYMM, Numerator, Denominator, unnest(generate_series(1, Weight)) AS k FROM w JOIN grp ON grp.StudyID = w.StudyID AND grp.gn = w.gn JOIN inp ON inp.StudyID = grp.StudyID AND inp.GroupID = grp.GroupID) SELECT StudyID, BootstrapRep, GroupID, MonthYYYYMM, Numerator, Denominator FROM r")
def bootstrap_rows(spark, sf_dir):
    months = site_months(spark, sf_dir).select("StudyID", "GroupID", "MonthYYYYMM", "Numerator", "Denominator")
    return bootstrap.bootstrap_study(months, 5, 6, seed=SEED, method="md5")


ONE = f"{MONTHLY}, {weights_sql()}, {weighted_sql(['Numerator'])}, {timeline_sql('wm', ['BootstrapRep', 'StudyID'], ['Numerator'], grouped=False)}"


@query(f"{ONE} {bounds_sql('cum_x', 'StudyID, ', ['Metric'])}")
def study_bounds(spark, sf_dir):
    return rounded(bounds.predict_bounds(site_months(spark, sf_dir), bootstrap_reps=REPS, seed=SEED, method="md5", as_of=AS_OF))


@query(f"{ONE} {bounds_sql('cum_x', 'StudyID, ', ['Metric'], 0.9)}")
def study_bounds_90(spark, sf_dir):
    return rounded(bounds.predict_bounds(site_months(spark, sf_dir), bootstrap_reps=REPS, conf_level=0.9, seed=SEED, method="md5", as_of=AS_OF))


@query(f"{ONE} SELECT * FROM ({bounds_sql('cum_x', 'StudyID, ', ['Metric'])}) WHERE StudyID IN ('BUILDING', 'FURNITURE')")
def study_bounds_targets(spark, sf_dir):
    return rounded(bounds.predict_bounds(site_months(spark, sf_dir), study_ref(spark), REPS, seed=SEED, method="md5", as_of=AS_OF))


TWO = f"{MONTHLY2}, {weights_sql()}, {weighted_sql(['Numerator_kriA', 'Numerator_kriB'])}, {timeline_sql('wm', ['BootstrapRep', 'StudyID'], ['Numerator_kriA', 'Numerator_kriB'], grouped=False)}"


@query(f"{TWO} {bounds_sql('cum_x', 'StudyID, ', ['Metric_kriA', 'Metric_kriB'])}")
def study_bounds_two_kris(spark, sf_dir):
    return rounded(bounds.predict_bounds(wide_kris(spark, sf_dir), bootstrap_reps=REPS, seed=SEED, method="md5", as_of=AS_OF))


# ---------------------------------------------------------------- reference bounds


def pairs_sql(rows: list[tuple]) -> str:
    return "ref AS (SELECT * FROM (VALUES " + ", ".join(f"('{t}', '{r}', {g if g else 'CAST(NULL AS BIGINT)'}, {k})" for k, (t, r, g) in enumerate(rows)) + ") v(target, ref, given, place))"


def reference_sql(rows: list[tuple], mix: bool = False, conf: float = 0.95, filter: str = "true") -> str:
    start = f"""{MONTHLY}, src AS (SELECT * FROM inp WHERE {filter}), {pairs_sql(rows)},
    grp AS (SELECT StudyID, GroupID, dense_rank() OVER (PARTITION BY StudyID ORDER BY GroupID) AS gn, count(*) OVER (PARTITION BY StudyID) AS cnt FROM (SELECT DISTINCT StudyID, GroupID FROM src)),
    pr AS (SELECT target, ref, given, cnt, min(place) AS place FROM ref JOIN grp ON grp.StudyID = ref.ref GROUP BY ALL),
    p AS (SELECT *, coalesce(given, min(cnt) OVER (PARTITION BY target)) AS n FROM pr),
    {reps_sql(REPS)},
    d AS (SELECT target, ref, BootstrapRep, cnt, unnest(generate_series(1, CAST(n AS BIGINT))) AS pos FROM p, reps),
    w AS (SELECT target, ref, BootstrapRep, CAST(floor({uniform_sql("target", "ref", "BootstrapRep", "pos")} * cnt) AS BIGINT) + 1 AS gn, count(*) AS Weight FROM d GROUP BY 1, 2, 3, 4),
    wm AS (SELECT w.target, w.ref, w.BootstrapRep, i.MonthYYYYMM, sum(w.Weight * i.Numerator) AS Numerator, sum(w.Weight * i.Denominator) AS Denominator, count(DISTINCT i.GroupID) AS GroupCount
        FROM w JOIN grp ON grp.StudyID = w.ref AND grp.gn = w.gn JOIN src i ON i.StudyID = grp.StudyID AND i.GroupID = grp.GroupID GROUP BY 1, 2, 3, 4),
    {timeline_sql('wm', ['target', 'ref', 'BootstrapRep'], ['Numerator'], grouped=False)},"""
    if mix:
        body = """ s AS (SELECT target, BootstrapRep, StudyMonth, sum(Numerator) AS Numerator, sum(Denominator) AS Denominator FROM cum_f GROUP BY 1, 2, 3),
        c AS (SELECT target, BootstrapRep, StudyMonth, sum(Numerator) OVER q AS Numerator, sum(Denominator) OVER q AS Denominator FROM s WINDOW q AS (PARTITION BY target, BootstrapRep ORDER BY StudyMonth ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
        x AS (SELECT *, CASE WHEN Denominator > 0 THEN CAST(Numerator AS DOUBLE) / Denominator END AS Metric FROM c)"""
    else:
        body = """ e AS (SELECT *, max(StudyMonth) OVER (PARTITION BY target, ref, BootstrapRep) AS own, max(StudyMonth) OVER (PARTITION BY target, BootstrapRep) AS longest FROM cum_x),
        x AS (SELECT target, BootstrapRep, Metric, unnest(generate_series(StudyMonth, CASE WHEN StudyMonth = own THEN longest ELSE StudyMonth END)) AS StudyMonth FROM e)"""
    facts = "f AS (SELECT target, CAST(max(n) AS BIGINT) AS GroupCount, count(*) AS StudyCount, string_agg(ref, ', ' ORDER BY place) AS StudyRefID FROM p GROUP BY target)"
    return f"{start}{body}, {facts}, b AS ({bounds_sql('x', 'target, ', ['Metric'], conf)}) SELECT b.* EXCLUDE (target), GroupCount, StudyCount, b.target AS StudyID, StudyRefID FROM b JOIN f ON f.target = b.target"


PAIRS = [("BUILDING", "AUTOMOBILE", 0), ("BUILDING", "MACHINERY", 0), ("FURNITURE", "HOUSEHOLD", 0), ("FURNITURE", "MACHINERY", 0), ("FURNITURE", "AUTOMOBILE", 0)]
SET = [("", s, 0) for s in ("AUTOMOBILE", "MACHINERY", "HOUSEHOLD")]
UNEVEN = "(StudyID <> 'MACHINERY' OR GroupID < 'J') AND (StudyID <> 'AUTOMOBILE' OR MonthYYYYMM < 200001)"


def set_sql(mix: bool, filter: str = "true") -> str:
    return f"SELECT * EXCLUDE (StudyID, StudyRefID) REPLACE (CAST({len(SET)} AS BIGINT) AS StudyCount) FROM ({reference_sql(SET, mix, filter=filter)})"


def reference_set(spark: SparkSession, sf_dir: str, mix: bool = False, filter: str = "true") -> DataFrame:
    return rounded(bounds.predict_bounds_ref_set(site_months(spark, sf_dir).filter(filter), ["AUTOMOBILE", "MACHINERY", "HOUSEHOLD"], REPS, mix_studies=mix, seed=SEED, method="md5", as_of=AS_OF))


@query(set_sql(False))
def ref_set_bounds(spark, sf_dir):
    return reference_set(spark, sf_dir)


@query(set_sql(True))
def ref_set_bounds_mixed(spark, sf_dir):
    return reference_set(spark, sf_dir, True)


@query(set_sql(False, UNEVEN))
def ref_carry_forward(spark, sf_dir):
    return reference_set(spark, sf_dir, False, UNEVEN)


def reference(spark: SparkSession, sf_dir: str, rows: list[tuple] | None = None, **kw) -> DataFrame:
    return rounded(bounds.predict_bounds_ref(site_months(spark, sf_dir), study_ref(spark, rows), REPS, seed=SEED, method="md5", as_of=AS_OF, warn=False, **kw))


@query(reference_sql(PAIRS))
def ref_bounds_per_target(spark, sf_dir):
    return reference(spark, sf_dir)


@query(reference_sql(PAIRS, True, 0.8))
def ref_bounds_mixed_80(spark, sf_dir):
    return reference(spark, sf_dir, mix_studies=True, conf_level=0.8)


@query(reference_sql([("BUILDING", "AUTOMOBILE", 4), ("BUILDING", "MACHINERY", 4)]))
def ref_bounds_min_groups(spark, sf_dir):
    return reference(spark, sf_dir, [("BUILDING", "AUTOMOBILE", 4), ("BUILDING", "MACHINERY", 4)])


@query(reference_sql([("BUILDING", "AUTOMOBILE", 0), ("BUILDING", "NOWHERE", 0), ("FURNITURE", "NOWHERE", 0)]))
def ref_missing_refs(spark, sf_dir):
    return reference(spark, sf_dir, [("BUILDING", "AUTOMOBILE"), ("BUILDING", "NOWHERE"), ("FURNITURE", "NOWHERE")])


# ---------------------------------------------------------------- reshaping


@query(f"{MONTHLY2} SELECT GroupID, 'Site' AS GroupLevel, Denominator, StudyID, MonthYYYYMM, Numerator_kriA, Numerator_kriB FROM inp")
def join_kri_wide(spark, sf_dir):
    metrics = spark.createDataFrame([("kriA", "Orders", 5.0), ("kriB", "Orders", 5.0)], "MetricID string, Denominator string, AccrualThreshold double")
    return reshape.join_kri_by_denominator(two_kris(spark, sf_dir), metrics)["Orders"]


MISMATCH = f"{MONTHLY2}, k AS (SELECT 'Orders' AS DenominatorType, 'kriA' AS MetricID, GroupID, StudyID, MonthYYYYMM, Denominator FROM inp UNION ALL SELECT 'Orders', 'kriB', GroupID, StudyID, MonthYYYYMM, Denominator + CASE WHEN Denominator % 7 = 0 THEN 1 ELSE 0 END FROM inp), mm AS (SELECT DenominatorType, StudyID, GroupID, MonthYYYYMM, count(DISTINCT Denominator) AS n FROM k GROUP BY 1, 2, 3, 4 HAVING count(DISTINCT Denominator) > 1)"


def mismatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    wrong = (F.col("MetricID") == "kriB") & (F.col("Denominator") % 7 == 0)
    return two_kris(spark, sf_dir).withColumn("Denominator", F.col("Denominator") + wrong.cast("int"))


@query(f"{MISMATCH} SELECT * FROM mm")
def denominator_mismatch(spark, sf_dir):
    return reshape.denominator_mismatch(mismatched(spark, sf_dir))


@query(f"{MISMATCH} SELECT k.DenominatorType, k.StudyID, k.GroupID, k.MonthYYYYMM, MetricID, Denominator FROM k SEMI JOIN mm ON k.StudyID = mm.StudyID AND k.GroupID = mm.GroupID AND k.MonthYYYYMM = mm.MonthYYYYMM")
def semi_join_mismatch_rows(spark, sf_dir):
    return reshape.mismatch_rows(mismatched(spark, sf_dir)).select("DenominatorType", "StudyID", "GroupID", "MonthYYYYMM", "MetricID", "Denominator")


@query(f"{TWO}, b AS ({bounds_sql('cum_x', 'StudyID, ', ['Metric_kriA', 'Metric_kriB'])}) " + " UNION ALL ".join(f"SELECT '{m}' AS MetricID, 'Orders' AS DenominatorType, StudyID, StudyMonth, BootstrapCount, Median_{m} AS Median, Lower_{m} AS Lower, Upper_{m} AS Upper FROM b" for m in ("kriA", "kriB")))
def bounds_long(spark, sf_dir):
    wide = bounds.predict_bounds(wide_kris(spark, sf_dir), bootstrap_reps=REPS, seed=SEED, method="md5", as_of=AS_OF)
    return rounded(reshape.transform_long({"Orders": wide}))


@query(f"{MONTHLY2} SELECT GroupID, StudyID, MonthYYYYMM, Numerator_kriA AS Numerator, Denominator, 'kriA' AS MetricID, DATE '2024-05-31' AS SnapshotDate FROM inp UNION ALL SELECT GroupID, StudyID, MonthYYYYMM, Numerator_kriB, Denominator, 'kriB', DATE '2024-05-31' FROM inp")
def bind_results(spark, sf_dir):
    parts = {m: {"Analysis_Input": site_months(spark, sf_dir, c).select("GroupID", "StudyID", "MonthYYYYMM", "Numerator", "Denominator")} for m, c in (("kriA", URGENT), ("kriB", FINISHED))}
    return reshape.bind_results(parts, "Analysis_Input", "2024-05-31")


# ---------------------------------------------------------------- mappings


@query("SELECT c_custkey AS subjid, c_mktsegment AS studyid, c_acctbal FROM customer WHERE c_acctbal > 0")
def map_subject_filter(spark, sf_dir):
    df = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("subjid"), F.col("c_mktsegment").alias("studyid"), "c_acctbal")
    return workflow.run_query("SELECT * FROM df WHERE c_acctbal > 0", df)


RAW_IE = """ie AS (SELECT c_mktsegment AS studyid, CAST(o_custkey AS VARCHAR) AS subjid, CASE o_orderstatus WHEN 'F' THEN 'EXCL' WHEN 'O' THEN 'INCL' ELSE 'OTHER' END AS iecat,
    CASE WHEN o_orderpriority = '1-URGENT' THEN '1' WHEN o_orderpriority = '5-LOW' THEN '0' END AS ieorres FROM orders JOIN customer ON o_custkey = c_custkey),
    violated AS (SELECT *, 'Y' AS ie_violation FROM ie WHERE iecat = 'EXCL' AND ieorres = '1' OR iecat = 'INCL' AND ieorres = '0')"""


def raw_criteria(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = orders(spark, sf_dir)
    category = F.when(F.col("o_orderstatus") == "F", "EXCL").when(F.col("o_orderstatus") == "O", "INCL").otherwise("OTHER")
    answer = F.when(F.col("o_orderpriority") == "1-URGENT", "1").when(F.col("o_orderpriority") == "5-LOW", "0")
    return facts.select("studyid", F.col("subjid").cast("string").alias("subjid"), F.lit("t").alias("tiver"), answer.alias("ieorres"), category.alias("iecat"))


def mapping(name: str, data: dict[str, DataFrame]) -> DataFrame:
    return workflow.run_workflow(next(w for w in definitions.mapping_workflows() if w.meta["ID"] == name), data)


@query(f"WITH {RAW_IE} SELECT studyid, subjid, 't' AS tiver, ieorres, iecat, ie_violation FROM violated")
def map_ie_flag(spark, sf_dir):
    return mapping("IE", {"Raw_IE": raw_criteria(spark, sf_dir)})


@query(f"""WITH {RAW_IE}, criteria AS (SELECT studyid, subjid, string_agg(iecat, ',' ORDER BY iecat) AS iecat_concat, ie_violation FROM violated GROUP BY studyid, subjid, ie_violation),
    pd AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS subjid, 'ELIGIBILITY CRITERIA' AS companycategory FROM orders WHERE o_totalprice > 300000)
    SELECT c_mktsegment AS studyid, CAST(c_custkey AS VARCHAR) AS subjid, 'Y' AS enrollyn, iecat_concat, ie_violation, companycategory,
        CASE WHEN ie_violation = 'Y' AND companycategory IS NULL THEN 'EDC I/E' WHEN ie_violation IS NULL AND companycategory IS NOT NULL THEN 'Eligibility IPD'
             WHEN ie_violation = 'Y' AND companycategory IS NOT NULL THEN 'Ineligible, Both Criteria' ELSE 'Neither' END AS Source
    FROM customer LEFT JOIN criteria ON criteria.subjid = CAST(c_custkey AS VARCHAR) AND criteria.studyid = c_mktsegment LEFT JOIN pd ON pd.subjid = CAST(c_custkey AS VARCHAR) WHERE c_acctbal > 0""")
def map_exclusion_source(spark, sf_dir):
    enrolled = read(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("studyid"), F.col("c_custkey").cast("string").alias("subjid"), F.when(F.col("c_acctbal") > 0, "Y").otherwise("N").alias("enrollyn"))
    category = F.when(F.col("o_totalprice") > 300000, "ELIGIBILITY CRITERIA").otherwise("OTHER")
    deviations = orders(spark, sf_dir).select("studyid", F.col("subjid").cast("string").alias("subjid"), category.alias("companycategory"))
    return mapping("EXCLUSION", {"Mapped_IE": mapping("IE", {"Raw_IE": raw_criteria(spark, sf_dir)}), "Mapped_ENROLL": enrolled, "Mapped_PD": deviations})


def metric_input(name: str, data: dict[str, DataFrame]) -> DataFrame:
    flow = definitions.metric_workflows([name])[0]
    flow.meta["AccrualThreshold"] = 0
    found = workflow.run_workflow(flow, data)["Analysis_Input"]
    return rounded(found)


def mapped_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = exposure(spark, sf_dir).select("studyid", "subjid", F.col("first_date").alias("firstparticipantdate"), F.col("last_date").alias("lastparticipantdate"))
    return subjects(spark, sf_dir).join(own, ["studyid", "subjid"], "left")


LABS = f"""WITH {ORD}, n AS (SELECT studyid, invid, {ym("odate")} AS MonthYYYYMM, count(*) AS c FROM ord WHERE substr(o_orderpriority, 1, 1) IN ('3', '4') GROUP BY 1, 2, 3),
    d AS (SELECT studyid, invid, {ym("odate")} AS MonthYYYYMM, count(*) AS c FROM ord WHERE substr(o_orderpriority, 1, 1) IN ('1', '2', '3', '4') GROUP BY 1, 2, 3) """


@query(LABS + FULL.format(more=", 'Total Lab Samples' AS DenominatorType"))
def metric_kri0005(spark, sf_dir):
    labs = orders(spark, sf_dir).select("studyid", "subjid", F.col("order_date").alias("lb_dt"), F.substring("o_orderpriority", 1, 1).alias("toxgrg_nsv"))
    return metric_input("kri0005", {"Mapped_SUBJ": mapped_subjects(spark, sf_dir), "Mapped_LB": labs})


@query(f"WITH {ORD}, {SPANS}, {NUM.format(source='ord WHERE ' + URGENT)}, d AS ({DAYS.format(keys='studyid, invid', month=ym('md'), name='c', source='spans')}) {FULL.format(more=', ' + chr(39) + 'Days on Study' + chr(39) + ' AS DenominatorType')}")
def metric_kri0002(spark, sf_dir):
    events = orders(spark, sf_dir).select("studyid", "subjid", F.col("order_date").alias("aest_dt"), F.when(F.expr(URGENT), "Y").otherwise("N").alias("aeser"))
    return metric_input("kri0002", {"Mapped_SUBJ": mapped_subjects(spark, sf_dir), "Mapped_AE": events})


@query("SELECT o_custkey AS subjid, string_agg(o_orderstatus, ',' ORDER BY o_orderstatus) AS statuses FROM orders GROUP BY 1")
def map_string_agg(spark, sf_dir):
    return workflow.run_query("SELECT o_custkey AS subjid, array_join(sort_array(array_agg(o_orderstatus)), ',') AS statuses FROM df GROUP BY o_custkey", read(spark, sf_dir, "orders"))


@query("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_custkey IS NOT NULL AND (nullif(o_orderstatus, 'P') <> 'O' OR nullif(o_orderstatus, 'P') IS NULL)")
def map_randomization_filter(spark, sf_dir):
    return workflow.run_query("SELECT o_orderkey, o_custkey, o_orderstatus FROM df WHERE o_custkey IS NOT NULL AND (nullif(o_orderstatus, 'P') != 'O' OR nullif(o_orderstatus, 'P') IS NULL)", read(spark, sf_dir, "orders"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_quantity, m FROM lineitem l LEFT JOIN (SELECT l_orderkey AS ok, l_partkey AS pk, l_suppkey AS sk, min(l_shipdate) AS m FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1, 2, 3) e ON ok = l_orderkey AND pk = l_partkey AND sk = l_suppkey")
def map_three_key_left_join(spark, sf_dir):
    line, keys = read(spark, sf_dir, "lineitem"), ["l_orderkey", "l_partkey", "l_suppkey"]
    entered = line.filter("l_returnflag = 'R'").groupBy(*keys).agg(F.min("l_shipdate").alias("m"))
    return workflow.left_join(line.select(*keys, "l_quantity"), entered, keys)


@query("""WITH c AS (SELECT r_name AS GroupID, CAST(count(DISTINCT c_custkey) AS VARCHAR) AS ParticipantCount, CAST(count(DISTINCT n_nationkey) AS VARCHAR) AS SiteCount
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY 1)
    SELECT GroupID, 'Country' AS GroupLevel, 'ParticipantCount' AS Param, ParticipantCount AS Value FROM c UNION ALL SELECT GroupID, 'Country', 'SiteCount', SiteCount FROM c""")
def long_meta(spark, sf_dir):
    customer, nation, region = (read(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    placed = customer.join(nation, customer.c_nationkey == nation.n_nationkey).join(region, nation.n_regionkey == region.r_regionkey)
    found = workflow.run_query("SELECT r_name AS GroupID, count(DISTINCT c_custkey) AS ParticipantCount, count(DISTINCT n_nationkey) AS SiteCount FROM df GROUP BY r_name", placed)
    return workflow.make_long_meta(found, "Country")


@query("WITH c AS (SELECT c_mktsegment AS GroupID, count(*) AS n, count(CASE WHEN c_acctbal > 0 THEN 1 END) AS active FROM customer GROUP BY 1) SELECT GroupID, active, n, round(active * 100.0 / n, 1) AS PercentActive FROM c")
def study_percentages(spark, sf_dir):
    found = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("GroupID")).agg(F.count_if(F.col("c_acctbal") > 0).alias("active"), F.count(F.lit(1)).alias("n"))
    return workflow.calculate_percentage(found, "active", "n", "PercentActive", "Activation").drop("Activation")


@query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'closed' ELSE 'open' END AS state FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') AND o_totalprice > 1000")
def kri_case_in_filters(spark, sf_dir):
    return workflow.run_query("SELECT o_orderkey, CASE WHEN o_orderstatus IN ('F', 'P') THEN 'closed' ELSE 'open' END AS state FROM df WHERE o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_orderstatus NOT IN ('P') AND o_totalprice > 1000", read(spark, sf_dir, "orders"))


@query("SELECT o_custkey AS subjid, TRY_CAST(o_orderstatus AS INTEGER) AS grade, CAST(o_orderdate AS DATE) AS day, o_totalprice FROM orders")
def ingest_spec(spark, sf_dir):
    spec = [ColumnSpec("subjid", None, "o_custkey"), ColumnSpec("grade", "integer", "o_orderstatus"), ColumnSpec("day", "Date", "o_orderdate"), ColumnSpec("o_totalprice", "numeric")]
    return apply_spec(read(spark, sf_dir, "orders"), spec)


# ---------------------------------------------------------------- simulation


def raw_domains(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    who = subjects(spark, sf_dir).withColumn("enrollyn", F.when(F.col("subjid") % 5 == 0, "N").otherwise("Y")).withColumn("siteid", F.concat(F.lit("s-"), "invid")).withColumn("subjid", F.col("subjid").cast("string"))
    facts = orders(spark, sf_dir).select(F.col("subjid").cast("string").alias("subjid"), F.col("o_orderkey").alias("aeid"), "studyid")
    return {"Raw_SUBJ": who, "Raw_AE": facts}


@query("""WITH s AS (SELECT c_custkey AS subjid FROM customer WHERE c_custkey % 5 <> 0),
    c AS (SELECT subjid, count(*) AS n FROM orders JOIN s ON o_custkey = subjid GROUP BY 1),
    q AS (SELECT quantile_cont(n, 0.25) AS lo, quantile_cont(n, 0.75) AS hi FROM c)
    SELECT CAST(subjid AS VARCHAR) AS subjid FROM c, q WHERE n >= lo AND n <= hi""")
def resample_eligible_subjects(spark, sf_dir):
    return simulate.eligible_subjects(raw_domains(spark, sf_dir), "Raw_AE", (0.25, 0.75)).select("subjid")


def drawn_sql(study: str, n: int, seed: int = SEED) -> str:
    """CTEs pool, size, drawn (k, subjid, invid, siteid) and held (a subject's first draw) of a study's subjects, drawn with replacement."""
    label = lambda what: f"'{study}/{what}'"
    return f"""
    {study}_pool AS (SELECT CAST(c_custkey AS VARCHAR) AS subjid, n_name AS invid, 's-' || n_name AS siteid,
        row_number() OVER (ORDER BY {uniform_sql(label("subjects/pool"), "c_custkey", seed=seed)}, CAST(c_custkey AS VARCHAR)) AS i
        FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0),
    {study}_size AS (SELECT count(*) AS n FROM {study}_pool),
    {study}_x AS (SELECT k, CAST(floor({uniform_sql(label("subjects"), "k", seed=seed)} * n) AS BIGINT) + 1 AS i FROM (SELECT unnest(generate_series(1, {n})) AS k), {study}_size),
    {study}_drawn AS (SELECT k, subjid, invid, siteid FROM {study}_x JOIN {study}_pool p ON p.i = {study}_x.i),
    {study}_held AS (SELECT subjid, min(k) AS k, '{study}_' || lpad(CAST(min(k) AS VARCHAR), 4, '0') AS newid FROM {study}_drawn GROUP BY 1)"""


def shuffled_sql(study: str, seed: int) -> str:
    """CTE sites (k, invid, siteid): sites permuted among the drawn subjects."""
    return f"""{study}_sites AS (SELECT row_number() OVER (ORDER BY {uniform_sql(f"'{study}/shuffle'", "k", seed=seed)}, k) AS k, '{study}_' || invid AS invid, siteid FROM {study}_drawn)"""


def seated_sql(study: str, target: int, seed: int) -> str:
    """CTE sites (k, invid, siteid): drawn subjects on new sites."""
    return f"""
    {study}_o AS (SELECT invid, n, row_number() OVER (ORDER BY {uniform_sql(f"'{study}/sites/pool'", "invid", seed=seed)}, invid) AS i FROM (SELECT invid, count(*) AS n FROM {study}_drawn GROUP BY 1)),
    {study}_t AS (SELECT t, CAST(floor({uniform_sql(f"'{study}/sites'", "t", seed=seed)} * (SELECT count(*) FROM {study}_o)) AS BIGINT) + 1 AS i FROM (SELECT unnest(generate_series(1, {target})) AS t)),
    {study}_e AS (SELECT t, n, sum(n) OVER (ORDER BY t) AS stop FROM {study}_t JOIN {study}_o o ON o.i = {study}_t.i),
    {study}_s AS (SELECT k, CAST(floor({uniform_sql(f"'{study}/seats'", "k", seed=seed)} * (SELECT sum(n) FROM {study}_e)) AS BIGINT) + 1 AS seat FROM {study}_drawn),
    {study}_sites AS (SELECT k, '{study}_' || CAST(t AS VARCHAR) AS invid, CAST(t AS VARCHAR) AS siteid FROM {study}_s JOIN {study}_e ON seat > stop - n AND seat <= stop)"""


@query(f"""WITH {drawn_sql("NEW", 200)} SELECT k AS "_draw", subjid FROM NEW_drawn""")
def resample_subject_ids(spark, sf_dir):
    pool = raw_domains(spark, sf_dir)["Raw_SUBJ"].filter("enrollyn = 'Y'")
    return simulate.draw_rows(pool, 200, SEED, "NEW/subjects", ["subjid"], True, "md5").select("_draw", "subjid")


@query(f"WITH {drawn_sql('NEW', 300)} SELECT newid AS subjid, o_orderkey AS aeid, 'NEW' AS studyid FROM orders JOIN NEW_held ON CAST(o_custkey AS VARCHAR) = subjid")
def resample_study(spark, sf_dir):
    return simulate.resample_study(raw_domains(spark, sf_dir), "NEW", 300, seed=SEED, method="md5")["Raw_AE"]


@query("""WITH p1 AS (WITH {} SELECT 'P1' AS studyid, invid, newid AS subjid, 'Y' AS enrollyn, siteid FROM P1_held JOIN P1_sites ON P1_sites.k = P1_held.k),
    p2 AS (WITH {} SELECT 'P2' AS studyid, invid, newid AS subjid, 'Y' AS enrollyn, siteid FROM P2_held JOIN P2_sites ON P2_sites.k = P2_held.k)
    SELECT * FROM p1 UNION ALL SELECT * FROM p2""".format(drawn_sql("P1", 100) + ", " + shuffled_sql("P1", SEED), drawn_sql("P2", 60, SEED + 1) + ", " + seated_sql("P2", 5, SEED + 1)))
def simulate_portfolio(spark, sf_dir):
    config = [{"studyid": "P1", "nSubjects": 100}, {"studyid": "P2", "nSubjects": 60, "TargetSiteCount": 5}]
    return simulate.simulate_portfolio(raw_domains(spark, sf_dir), config, seed=SEED, method="md5")["Raw_SUBJ"]


@query("""WITH {}, site AS (SELECT n_name AS invid, n_regionkey AS region, row_number() OVER (ORDER BY {}, n_name) AS i, count(*) OVER () AS n FROM nation)
    SELECT 'P2_' || CAST(t AS VARCHAR) AS invid, region, 'P2' AS studyid FROM (SELECT t, CAST(floor({} * (SELECT max(n) FROM site)) AS BIGINT) + 1 AS i FROM (SELECT unnest(generate_series(1, 40)) AS t)) x
    JOIN site ON site.i = x.i WHERE CAST(t AS VARCHAR) IN (SELECT siteid FROM P2_sites)""".format(
        drawn_sql("P2", 60) + ", " + seated_sql("P2", 40, SEED), uniform_sql("'P2/site-rows/pool'", "n_name", "n_regionkey", "'OLD'"), uniform_sql("'P2/site-rows'", "t")
    )
)
def resample_site_rows(spark, sf_dir):
    site = read(spark, sf_dir, "nation").select(F.col("n_name").alias("invid"), F.col("n_regionkey").alias("region"), F.lit("OLD").alias("studyid"))
    return simulate.resample_study({**raw_domains(spark, sf_dir), "Raw_SITE": site}, "P2", 60, 40, seed=SEED, method="md5")["Raw_SITE"]


RATIOS = "r AS (SELECT 's-' || n_name AS siteid, CAST(count(CASE WHEN c_custkey % 5 <> 0 THEN 1 END) AS DOUBLE) / count(*) AS Ratio FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 HAVING count(CASE WHEN c_custkey % 5 <> 0 THEN 1 END) > 0)"


@query(f"WITH {RATIOS} SELECT siteid, round(Ratio, 6) AS Ratio FROM r")
def screening_ratios(spark, sf_dir):
    return rounded(simulate.screening_ratios(raw_domains(spark, sf_dir)["Raw_SUBJ"]))


@query(f"""WITH {RATIOS}, p AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql("'ratio/pool'", "siteid")}, siteid) AS i FROM r), z AS (SELECT count(*) AS n FROM p),
    e AS (SELECT c_mktsegment AS studyid, 's-' || n_name AS siteid, count(*) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey % 5 <> 0 GROUP BY 1, 2),
    d AS (SELECT studyid, e.siteid, k, CAST(floor({uniform_sql("'ratio'", "studyid", "e.siteid")} * n) AS BIGINT) + 1 AS i FROM e, z),
    f AS (SELECT studyid, d.siteid, k * (1 - Ratio) / Ratio AS x FROM d JOIN p ON p.i = d.i)
    SELECT studyid, siteid, CAST(round_even(x, 0) AS BIGINT) AS Failures FROM f WHERE round_even(x, 0) > 0""")
def screening_failures_md5(spark, sf_dir):
    source = raw_domains(spark, sf_dir)["Raw_SUBJ"]
    return simulate.screening_failure_counts(source.filter("enrollyn = 'Y'"), source, seed=SEED, method="md5")


FAILURES = f"""{RATIOS}, p AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql("'ratio/pool'", "siteid")}, siteid) AS i FROM r), z AS (SELECT count(*) AS n FROM p),
    who AS (SELECT c_mktsegment AS studyid, n_name AS invid, CAST(c_custkey AS VARCHAR) AS subjid, CASE WHEN c_custkey % 5 = 0 THEN 'N' ELSE 'Y' END AS enrollyn, 's-' || n_name AS siteid FROM customer JOIN nation ON c_nationkey = n_nationkey),
    e AS (SELECT studyid, siteid, count(*) AS k FROM who WHERE enrollyn = 'Y' GROUP BY 1, 2),
    d AS (SELECT studyid, e.siteid, k, CAST(floor({uniform_sql("'ratio'", "studyid", "e.siteid")} * n) AS BIGINT) + 1 AS i FROM e, z),
    f AS (SELECT studyid, d.siteid, CAST(round_even(k * (1 - Ratio) / Ratio, 0) AS BIGINT) AS x FROM d JOIN p ON p.i = d.i)"""


@query(f"""WITH {FAILURES}, lost AS (SELECT *, row_number() OVER (ORDER BY {uniform_sql("'row/pool'", "studyid", "siteid", "subjid")}, studyid, siteid, subjid) AS i, count(*) OVER () AS n FROM who WHERE enrollyn = 'N'),
    seats AS (SELECT studyid, siteid, unnest(generate_series(1, x)) AS k FROM f WHERE x > 0),
    placed AS (SELECT studyid, siteid, CAST(floor({uniform_sql("'row'", "studyid", "siteid", "k")} * (SELECT max(n) FROM lost)) AS BIGINT) + 1 AS i FROM seats)
    SELECT * FROM who WHERE enrollyn = 'Y' UNION ALL SELECT placed.studyid, invid, subjid, enrollyn, placed.siteid FROM placed JOIN lost ON lost.i = placed.i""")
def screening_failures_rows(spark, sf_dir):
    source = raw_domains(spark, sf_dir)["Raw_SUBJ"]
    return simulate.add_screening_failures(source.filter("enrollyn = 'Y'"), source, seed=SEED, order=["studyid", "siteid", "subjid"], method="md5")


# ---------------------------------------------------------------- charts and reports


@query(f"{MONTHLY}, {timeline_sql('inp', ['StudyID'], ['Numerator'])} SELECT StudyID, 'kriA' AS MetricID, max(StudyMonth) AS StudyMonth, arg_max(Metric, StudyMonth) AS Metric FROM cum GROUP BY 1")
def latest_metric_per_group(spark, sf_dir):
    lines = timeline.cumulative_timeline(site_months(spark, sf_dir), "StudyID", as_of=AS_OF).withColumn("MetricID", F.lit("kriA"))
    return rounded(report.latest_metrics(lines))


@query("SELECT DISTINCT c_mktsegment AS StudyID, 'kriA' AS MetricID FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def chart_pairs(spark, sf_dir):
    lines = timeline.cumulative_timeline(site_months(spark, sf_dir), "StudyID", as_of=AS_OF).withColumn("MetricID", F.lit("kriA"))
    targets = study_ref(spark).select(F.col("study").alias("StudyID"), F.lit("kriA").alias("MetricID"))
    return charts.chart_pairs(lines, targets)


@query(f"{MONTHLY}, {timeline_sql('inp', ['StudyID'], ['Numerator'])} SELECT StudyID, StudyMonth, Metric FROM cum WHERE StudyID = 'BUILDING' AND StudyMonth <= 24")
def chart_lines(spark, sf_dir):
    lines = timeline.cumulative_timeline(site_months(spark, sf_dir), "StudyID", as_of=AS_OF)
    chart = charts.visualize_study(lines, study_id="BUILDING", max_month=24)
    rows = [("BUILDING", r["StudyMonth"], r["Metric"]) for r in chart["layers"][-1]["rows"]]
    return rounded(spark.createDataFrame(rows, "StudyID string, StudyMonth long, Metric double"))


