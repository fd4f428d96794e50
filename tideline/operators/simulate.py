"""Simulated portfolios: resampled studies and screening failures.

All draws come from hashes of (seed, study, position), so a portfolio is the
same on any cluster.  Pools are numbered in the order of a hash of their key, by
ranges of the hash, so no task orders a whole pool.
"""

from __future__ import annotations

import logging
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.draws import draw_index, uniform
from tideline.operators.validate import ValidationError

log = logging.getLogger(__name__)

#: Ranges of the hash by which a pool is numbered.
RANGES = 1024

SUBJECT_IDS = ["subjid", "subjectid", "subjectenrollmentnumber", "subject_nsv", "subjectname"]
SITE_IDS = ["invid", "siteid", "site_num"]


def has_column(df: DataFrame, column: str) -> bool:
    return column in df.columns


def find_id_column(df: DataFrame, ids: list[str]) -> str | None:
    return next((c for c in ids if c in df.columns), None)


def numbered(df: DataFrame, order: Column, ties: list[str], name: str = "_index") -> DataFrame:
    """The rows with their number, 1 and on, in the order of ``order`` (in [0, 1)) and then ``ties``.

    Ranges of ``order`` are counted, and rows numbered within theirs.
    """
    rows = df.withColumn("_order", order).withColumn("_range", F.floor(F.col("_order") * RANGES).cast("int"))
    counts = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))  # RANGES rows at most
    within = Window.partitionBy("_range").orderBy("_order", *ties)
    placed = rows.withColumn("_within", F.row_number().over(within)).join(F.broadcast(before), "_range")
    return placed.withColumn(name, (F.col("_before") + F.col("_within")).cast("long")).select(*df.columns, name)


def eligible_subjects(raw: dict[str, DataFrame], oversample_domain: str | None = None, quantile_range: tuple[float, float] = (0, 1), subject_ids: list[str] | None = None) -> DataFrame:
    """Enrolled subjects; with a domain, those whose number of its records lies within the quantile range (none: not eligible)."""
    subjects = raw["Raw_SUBJ"].filter("enrollyn = 'Y'")
    if oversample_domain is None:
        return subjects
    domain = raw[oversample_domain]
    ids = subject_ids or SUBJECT_IDS
    key = find_id_column(domain, [c for c in ids if c in subjects.columns])
    if key is None:
        raise ValidationError(f"strOversampleDomain must have a subject identifier column: {', '.join(ids)}")
    counts = domain.join(subjects.select(key).distinct(), key, "left_semi").groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    at = counts.agg(F.percentile("_n", F.array(F.lit(float(quantile_range[0])), F.lit(float(quantile_range[1])))).alias("_q"))
    chosen = counts.crossJoin(F.broadcast(at)).filter((F.col("_n") >= F.col("_q")[0]) & (F.col("_n") <= F.col("_q")[1])).select(key)
    found = subjects.join(chosen, key, "left_semi")
    if log.isEnabledFor(logging.INFO):
        low, high = at.first()[0] or (float("nan"), float("nan"))
        log.info("Filtered to %d subjects with %s records in %.2f-%.2f quantile range (%.0f-%.0f records)", found.count(), oversample_domain, *quantile_range, low, high)
    return found


def draw_rows(pool: DataFrame, n: int, seed: int, label: str, order: list[str], replacement: bool, method: str = "xxhash64") -> DataFrame:
    """``n`` rows of the pool with their position _draw (1 .. n); without replacement a permutation's first n.

    ``order`` names columns that tell the pool's rows apart.
    """
    key = [F.col(c) for c in order]
    if not replacement:
        return numbered(pool, uniform(seed, F.lit(label), *key, method=method), order, "_draw").filter(F.col("_draw") <= n)
    pooled = numbered(pool, uniform(seed, F.lit(f"{label}/pool"), *key, method=method), order)
    size = pool.agg(F.count(F.lit(1)).alias("_size"))
    draws = pool.sparkSession.range(1, n + 1).select(F.col("id").alias("_draw")).crossJoin(F.broadcast(size))
    draws = draws.select("_draw", draw_index(uniform(seed, F.lit(label), F.col("_draw"), method=method), F.col("_size")).alias("_index"))
    return draws.join(pooled, "_index").drop("_index")


def seat_subjects(drawn: DataFrame, study: str, target_sites: int, seed: int, method: str = "xxhash64") -> DataFrame:
    """_draw, invid, siteid: drawn subjects on at most ``target_sites`` new sites <study>_<k>, sized like the ones they come from."""
    counted = drawn.groupBy("invid").agg(F.count(F.lit(1)).alias("_n"))
    observed = numbered(counted, uniform(seed, F.lit(f"{study}/sites/pool"), F.col("invid"), method=method), ["invid"])
    size = counted.agg(F.count(F.lit(1)).alias("_size"))
    sites = drawn.sparkSession.range(1, target_sites + 1).select(F.col("id").alias("_k")).crossJoin(F.broadcast(size))
    sites = sites.withColumn("_index", draw_index(uniform(seed, F.lit(f"{study}/sites"), F.col("_k"), method=method), F.col("_size"))).join(observed.select("_index", "_n"), "_index")
    run = Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, Window.currentRow)  # target_sites rows
    ends = sites.select("_k", F.sum("_n").over(run).alias("_end"), "_n")
    places = ends.select("_k", F.explode(F.sequence(F.col("_end") - F.col("_n") + 1, F.col("_end"))).alias("_seat"))
    total = sites.agg(F.sum("_n").alias("_total"))
    seated = drawn.select("_draw").crossJoin(F.broadcast(total)).withColumn("_seat", draw_index(uniform(seed, F.lit(f"{study}/seats"), F.col("_draw"), method=method), F.col("_total")))
    number = F.col("_k").cast("string")
    return seated.join(places, "_seat").select("_draw", F.concat(F.lit(f"{study}_"), number).alias("invid"), number.alias("siteid"))


def generate_sites(raw_site: DataFrame, seated: DataFrame, study: str, target_sites: int, seed: int, method: str = "xxhash64") -> DataFrame:
    """Rows of the site domain for the new sites that have subjects, each with the attributes of a drawn site."""
    taken = draw_rows(raw_site, target_sites, seed, f"{study}/site-rows", raw_site.columns, True, method)
    number = F.col("_draw").cast("string")
    new = {"invid": F.concat(F.lit(f"{study}_"), number), "studyid": F.lit(study), "site_num": number}
    named = taken.select(*[new.get(c, F.col(f"`{c}`")).alias(c) for c in raw_site.columns], *([] if "invid" in raw_site.columns else [new["invid"].alias("invid")]))
    return named.join(seated.select("invid").distinct(), "invid", "left_semi").select(*dict.fromkeys([*raw_site.columns, "invid"]))


def resample_study(raw: dict[str, DataFrame], new_study_id: str, subjects: int | None = None, target_site_count: int | None = None, replacement: bool = True, oversample_domain: str | None = None, oversample_quantile_range: tuple[float, float] = (0, 1), seed: int = 0, subject_ids: list[str] | None = None, site_ids: list[str] | None = None, method: str = "xxhash64") -> dict[str, DataFrame]:
    """A new study drawn from the enrolled subjects, with every domain rewritten to the new ids.

    A subject drawn twice keeps the id of its first draw, and its records occur
    once.  Sites are permuted among the drawn subjects, and the site domain keeps
    those that occur, under their new ids; with ``target_site_count`` sites are
    generated anew, with attributes of drawn rows of Raw_SITE.
    """
    if not isinstance(raw, dict):
        raise ValidationError("lRaw must be a named list")
    if "Raw_SUBJ" not in raw:
        raise ValidationError("lRaw must contain Raw_SUBJ (demographics/subject data)")
    if not isinstance(new_study_id, str) or not new_study_id:
        raise ValidationError("strNewStudyID must be a single character string")
    base = raw["Raw_SUBJ"]
    ids = [c for c in (subject_ids or SUBJECT_IDS) if c in base.columns]
    if subject_ids and len(ids) < len(subject_ids):
        raise ValidationError(f"vSubjectIDs validation failed: The following columns are in vSubjectIDs but missing from Raw_SUBJ: {', '.join(c for c in subject_ids if c not in ids)}")
    if not isinstance(replacement, bool):
        raise ValidationError("replacement must be a single logical value")
    if subjects is not None and (isinstance(subjects, bool) or not isinstance(subjects, (int, float)) or subjects != int(subjects) or subjects < 1):
        raise ValidationError("nSubjects must be NULL or a positive integer")
    if target_site_count is not None and (isinstance(target_site_count, bool) or target_site_count < 1):
        raise ValidationError("TargetSiteCount must be a single positive number")
    if len(oversample_quantile_range) != 2:
        raise ValidationError("vOversamplQuantileRange must be a numeric vector of length 2")
    low, high = oversample_quantile_range
    if not (0 <= low <= 1 and 0 <= high <= 1):
        raise ValidationError("vOversamplQuantileRange values must be between 0 and 1")
    if low > high:
        raise ValidationError("vOversamplQuantileRange[1] must be <= vOversamplQuantileRange[2]")
    if oversample_domain is not None and oversample_domain not in raw:
        raise ValidationError(f"strOversampleDomain '{oversample_domain}' not found in lRaw")
    pool = eligible_subjects(raw, oversample_domain, oversample_quantile_range, ids)
    available = pool.count()
    if not available:
        raise ValidationError("No enrolled subjects found in Raw_SUBJ (enrollyn == 'Y')")
    n = int(subjects or available)
    if not replacement and n > available:
        raise ValidationError(f"Cannot sample {n} subjects without replacement from {available} available subjects")
    drawn = draw_rows(pool, n, seed, f"{new_study_id}/subjects", ["subjid"], replacement, method)
    old = drawn.select("_draw", F.col("subjid").alias("_old"), *[F.col(c).alias(f"_{c}") for c in ids if c != "subjid"], *[F.col(c).alias(f"_old_{c}") for c in ("invid", "siteid") if c in base.columns])
    target = int(target_site_count or 0) if "invid" in base.columns else 0
    if target:
        sites = seat_subjects(drawn, new_study_id, target, seed, method)
    elif "invid" in base.columns:
        has_site = "siteid" in base.columns
        giver = numbered(drawn.select(F.col("_draw").alias("_from"), "invid", *(["siteid"] if has_site else [])), uniform(seed, F.lit(f"{new_study_id}/shuffle"), F.col("_from"), method=method), ["_from"], "_draw")
        prefix = lambda c: F.when(F.startswith(F.col(c), F.lit(f"{new_study_id}_")), F.col(c)).otherwise(F.concat(F.lit(f"{new_study_id}_"), c))
        sites = giver.select("_draw", prefix("invid").alias("invid"), (F.col("siteid") if has_site else F.lit(None).cast("string")).alias("siteid"))
    else:
        sites = drawn.select("_draw", F.lit(None).cast("string").alias("invid"), F.lit(None).cast("string").alias("siteid"))
    first = Window.partitionBy("_old").orderBy("_draw")
    seated = old.join(sites, "_draw")
    mapped = seated.withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").drop("_nth")
    mapped = mapped.withColumn("_new", F.format_string(f"{new_study_id}_%04d", F.col("_draw")))
    generated = generate_sites(raw["Raw_SITE"], seated, new_study_id, target, seed, method) if target and "Raw_SITE" in raw else None
    out = {}
    for name, df in raw.items():
        out[name] = _rewrite(df, mapped, seated, generated, new_study_id, ids, site_ids or SITE_IDS)
    return out


def _rewrite(df: DataFrame, mapped: DataFrame, seated: DataFrame, generated: DataFrame | None, study: str, ids: list[str], site_ids: list[str]) -> DataFrame:
    """A domain of the new study: by subjects if it has a subject id, by sites if it has a site id, else with a new studyid only."""
    columns = df.columns if "studyid" in df.columns else [*df.columns, "studyid"]
    key = find_id_column(df, ids)
    if key is not None:
        old = "_old" if key == "subjid" else f"_{key}"
        lookup = mapped.select(F.col(old).alias(key), "_new", F.col("invid").alias("_invid"), F.col("siteid").alias("_siteid")).dropDuplicates([key])
        rows = df.join(lookup, key)

        def value(c: str) -> Column:
            if c == "studyid":
                return F.lit(study)
            if c == "subjid":
                return F.col("_new")
            if c in ids:
                return F.concat(F.lit(f"{study}_"), F.col(c))
            if c == "invid":
                return F.coalesce(F.col("_invid"), F.col(c))
            if c == "siteid":
                return F.coalesce(F.col("_siteid"), F.col(c))
            return F.col(c)

        return rows.select(*[value(c).alias(c) for c in columns])
    site = find_id_column(df, site_ids)
    if site is None:
        return df.withColumn("studyid", F.lit(study)).select(*columns)
    if generated is not None:
        return generated
    known = seated.select(F.col("siteid").alias(site))
    if site == "invid" and "_old_invid" in seated.columns:
        known = known.union(seated.select("_old_invid"))
    elif site != "invid":
        known = known.union(seated.select("invid"))
    rows = df.join(known.distinct(), site, "left_semi").withColumn("studyid", F.lit(study))
    if site == "invid":
        rows = rows.withColumn("invid", F.concat(F.lit(f"{study}_"), F.col("invid")))
    return rows.select(*columns)


def default_config(raw: dict[str, DataFrame], studies: int = 5, seed: int = 0) -> list[dict]:
    """PORTFOLIO001 .. with 20 to min(100, n) subjects each."""
    top = max(20, min(100, raw["Raw_SUBJ"].count()))
    ids = raw["Raw_SUBJ"].sparkSession.range(1, studies + 1)
    rows = ids.select("id", (F.floor(uniform(seed, F.col("id")) * (top - 19)) + 20).cast("int").alias("n")).orderBy("id").collect()
    return [{"studyid": f"PORTFOLIO{r['id']:03d}", "nSubjects": r["n"]} for r in rows]


def simulate_portfolio(raw: dict[str, DataFrame], config: list[dict] | DataFrame | None = None, studies: int = 5, seed: int = 0, subject_ids: list[str] | None = None, site_ids: list[str] | None = None, method: str = "xxhash64") -> dict[str, DataFrame]:
    """Every configured study, resampled and bound by domain.  Unknown config columns are ignored."""
    if not isinstance(raw, dict) or "Raw_SUBJ" not in raw:
        raise ValidationError("lRaw must be a list containing at least Raw_SUBJ")
    rows = default_config(raw, studies, seed) if config is None else [r.asDict() for r in config.collect()] if isinstance(config, DataFrame) else list(config)
    if any("studyid" not in r or "nSubjects" not in r for r in rows) or not rows:
        raise ValidationError("dfConfig must contain columns: studyid, nSubjects")
    if len({r["studyid"] for r in rows}) < len(rows):
        raise ValidationError("dfConfig contains duplicate study IDs")
    unset = lambda x, other: other if x is None or x != x else x
    made = []
    for k, r in enumerate(rows):
        low, high = unset(r.get("vOversamplQuantileRange_min"), 0), unset(r.get("vOversamplQuantileRange_max"), 1)
        made.append(resample_study(raw, r["studyid"], r["nSubjects"], unset(r.get("TargetSiteCount"), None), unset(r.get("replacement"), True), unset(r.get("strOversampleDomain"), None), (low, high), seed + k, subject_ids, site_ids, method))
    return {name: reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [m[name] for m in made]) for name in raw}


def screening_ratios(source: DataFrame, site_col: str = "siteid") -> DataFrame:
    """site, Ratio = Y / (Y + N) of each source site with at least one Y."""
    counts = source.groupBy(site_col).agg(F.count_if(F.col("enrollyn") == "Y").alias("_y"), F.count_if(F.col("enrollyn") == "N").alias("_n"))
    return counts.filter("_y > 0").select(site_col, (F.col("_y") / (F.col("_y") + F.col("_n"))).alias("Ratio"))


def screening_failure_counts(enrolled: DataFrame, source: DataFrame, site_col: str = "siteid", study_col: str = "studyid", seed: int = 0, method: str = "xxhash64") -> DataFrame:
    """study, site, Failures: round(n (1 - r) / r), half to even, with a ratio drawn from the source sites."""
    ratios = screening_ratios(source, site_col).select(F.col(site_col).alias("_site"), "Ratio")
    pool = numbered(ratios, uniform(seed, F.lit("ratio/pool"), F.col("_site"), method=method), ["_site"])
    size = pool.agg(F.count(F.lit(1)).alias("_size"))
    pairs = enrolled.groupBy(study_col, site_col).agg(F.count(F.lit(1)).alias("_enrolled")).crossJoin(F.broadcast(size))
    drawn = pairs.withColumn("_index", draw_index(uniform(seed, F.lit("ratio"), F.col(study_col), F.col(site_col), method=method), F.col("_size")))
    with_ratio = drawn.join(pool.select("_index", "Ratio"), "_index")
    n = F.bround(F.col("_enrolled") * (1 - F.col("Ratio")) / F.col("Ratio"), 0).cast("long")
    return with_ratio.select(study_col, site_col, n.alias("Failures")).filter("Failures > 0")


def add_screening_failures(enrolled: DataFrame, source: DataFrame, site_col: str = "siteid", study_col: str = "studyid", seed: int = 0, order: list[str] | None = None, method: str = "xxhash64") -> DataFrame:
    """The enrolled rows, and for each study and site a drawn number of the source's ``N`` rows under its ids."""
    for df, name in ((enrolled, "dfEnrolled"), (source, "dfSource")):
        if not isinstance(df, DataFrame):
            raise ValidationError(f"{name} must be a data.frame")
        missing = [c for c in ("enrollyn", site_col) if c not in df.columns]
        if missing:
            raise ValidationError(f"{name} missing required columns: {', '.join(missing)}")
    failed = source.filter("enrollyn = 'N'")
    key = order or failed.columns
    pool = numbered(failed, uniform(seed, F.lit("row/pool"), *[F.col(c) for c in key], method=method), key)
    size = failed.agg(F.count(F.lit(1)).alias("_size"))
    counts = screening_failure_counts(enrolled, source, site_col, study_col, seed, method)
    seats = counts.withColumn("_k", F.explode(F.sequence(F.lit(1), F.col("Failures").cast("int")))).crossJoin(F.broadcast(size)).filter("_size > 0")
    seats = seats.withColumn("_index", draw_index(uniform(seed, F.lit("row"), F.col(study_col), F.col(site_col), F.col("_k"), method=method), F.col("_size")))
    added = seats.select("_index", F.col(study_col).alias("_study"), F.col(site_col).alias("_site_new")).join(pool, "_index")
    added = added.withColumn(study_col, F.col("_study")).withColumn(site_col, F.col("_site_new")).select(*dict.fromkeys([*failed.columns, study_col]))
    return enrolled.unionByName(added, allowMissingColumns=True)
