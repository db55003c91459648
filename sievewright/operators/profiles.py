"""Profiles rendered to text and taken apart to facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import fields, skills

# Modules, in order, and their headings.
MODULES = {"personal_info": "PERSONAL INFORMATION", "education": "EDUCATION", "internship": "INTERNSHIP AND WORK EXPERIENCE", "projects": "PROJECTS"}
PERSONAL = {"full_name": "Full name", "email": "Email", "phone": "Phone", "linkedin": "LinkedIn", "github": "GitHub", "portfolio": "Portfolio", "location": "Location"}
HANDLED = (
    "title", "degree", "name", "employer", "company", "school", "organisation", "start", "start_date", "end", "end_date",
    "summary", "detail", "description", "role", "highlights", "major", "gpa",
)


def _get(r: Column, *keys: str) -> Column:
    return F.coalesce(*[F.nullif(F.trim(r[k]), F.lit("")) for k in keys])


def _title(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def render_personal(m: Column) -> Column:
    labels = F.create_map(*[F.lit(x) for kv in PERSONAL.items() for x in kv])
    kept = F.filter(F.map_entries(m), lambda e: F.coalesce(F.length(F.trim(e["value"])) > 0, F.lit(False)))
    return F.array_join(F.transform(kept, lambda e: F.concat(F.coalesce(labels[e["key"]], _title(e["key"])), F.lit(": "), F.trim(e["value"]))), "\n")


def render_record(r: Column) -> Column:
    """A record (a map) as a bullet with its details; education as one line of prose."""
    head = F.concat_ws(" at ", _get(r, "title", "degree", "name"), _get(r, "employer", "company", "school", "organisation"))
    start, end = _get(r, "start", "start_date"), _get(r, "end", "end_date")
    period = F.when(start.isNotNull() | end.isNotNull(), F.concat_ws(" - ", start, end))
    head = F.when(period.isNotNull(), F.trim(F.concat(head, F.lit(" ("), period, F.lit(")")))).otherwise(head)
    study = _get(r, "degree").isNotNull() | _get(r, "school").isNotNull() | _get(r, "major").isNotNull()
    prose = F.concat_ws(", ", F.concat_ws(" in ", _get(r, "degree"), _get(r, "major")), _get(r, "school"), period, F.concat(F.lit("GPA "), _get(r, "gpa")))
    prose = F.regexp_replace(prose, "^, ", "")
    line = F.when(study, F.concat(F.lit("- "), prose)).when(F.length(head) > 0, F.concat(F.lit("- "), head))
    more = F.filter(F.map_entries(r), lambda e: ~e["key"].isin(*HANDLED) & F.coalesce(F.length(F.trim(e["value"])) > 0, F.lit(False)))
    others = F.transform(more, lambda e: F.concat(F.lit("  "), _title(e["key"]), F.lit(": "), F.trim(e["value"])))
    details = [F.concat(F.lit("  "), _get(r, k)) for k in ("summary", "detail", "description", "role")]
    return F.array_join(F.concat(F.array_compact(F.array(line, *details)), others), "\n")


def render_profile(profiles: DataFrame, *carry: str) -> DataFrame:
    """Text of the authorised modules only: ``profile_id, text, used, dropped, empty``, and the columns to carry.

    ``profiles``: profile_id, authorised_modules, personal_info (map), education, internship, projects (arrays of maps).
    """
    c = F.col
    body = {"personal_info": render_personal(c("personal_info"))}
    for m in list(MODULES)[1:]:
        body[m] = F.array_join(F.filter(F.transform(F.coalesce(m, F.array().cast("array<map<string,string>>")), render_record), lambda x: F.length(x) > 0), "\n")
    df = profiles.select("profile_id", "authorised_modules", *carry, *[F.coalesce(b, F.lit("")).alias(f"_{m}") for m, b in body.items()])
    allowed = {m: F.array_contains("authorised_modules", m) for m in MODULES}
    filled = {m: F.length(f"_{m}") > 0 for m in MODULES}
    pick = lambda test: F.array_compact(F.array(*[F.when(test(m), F.lit(m)) for m in MODULES]))
    return df.select(
        "profile_id", *carry,
        F.concat_ws("\n\n", *[F.when(allowed[m] & filled[m], F.concat(F.lit(h + "\n"), c(f"_{m}"))) for m, h in MODULES.items()]).alias("text"),
        pick(lambda m: allowed[m] & filled[m]).alias("used"), pick(lambda m: ~allowed[m] & filled[m]).alias("dropped"), pick(lambda m: allowed[m] & ~filled[m]).alias("empty"),
    )


def extract_facts(rendered: DataFrame) -> DataFrame:
    """Facts in long form, ``profile_id, key, value, confidence``: what the rules read from a rendered profile."""
    none = F.array().cast("array<string>")
    got, conf = fields.extract_fields(F.col("text"), none)
    keys = [k for k in fields.FIELDS if k != "top_skills"]
    rows = F.array(*[F.struct(F.lit(k).alias("key"), F.col("_f")[k].alias("value"), F.col("_c")[k].alias("confidence")) for k in keys])
    df = rendered.select("profile_id", got.alias("_f"), conf.alias("_c"))
    return df.select("profile_id", F.explode(rows).alias("r")).select("profile_id", "r.*").where("value IS NOT NULL")


# The module that each fact belongs to; confidences of facts read from records; patterns of labelled ones.
OWNER = {
    "full_name": "personal_info", "email": "personal_info", "phone": "personal_info", "education_school": "education",
    "education_degree": "education", "education_major": "education", "graduation_year": "education",
}
CONFIDENCE = {
    "location": 0.70, "linkedin": 0.80, "github": 0.80, "portfolio": 0.70, "gpa": 0.75, "internship_employer": 0.80, "internship_title": 0.80,
    "internship_dates": 0.70, "internship_summary": 0.55, "project_name": 0.75, "project_summary": 0.55,
}
LABELLED = {
    "linkedin": r"(?i)\blinked ?in\b\s*[:\-]?\s*(\S[^\n]*)",
    "github": r"(?i)\bgit ?hub\b\s*[:\-]?\s*(\S[^\n]*)",
    "portfolio": r"(?i)\b(?:portfolio|personal web ?site|homepage)\b\s*[:\-]?\s*(\S[^\n]*)",
    "location": r"(?i)\blocation\b\s*[:\-]?\s*([^\n]+)",
}
GPA = r"(?i)\bgpa\b\s*[:\-]?\s*([0-9]+(?:\.[0-9]+)?(?:\s*/\s*[0-9]+(?:\.[0-9]+)?)?)"


def facts_of(profiles: DataFrame) -> DataFrame:
    """All facts of the authorised modules, ``profile_id, key, value, confidence``, one per key.

    Names, contacts and studies are what the rules read from the rendered text, links, place and grade what stands behind their label, the
    others what the first record of internship and projects says; the three best skills count whatever module names them. Blank values are no facts.
    """
    c = F.col
    df = render_profile(profiles, "personal_info", "education", "internship", "projects")
    df = df.withColumn("_skills", skills.match_skills(c("text")))
    got, conf = fields.extract_fields(c("text"), skills.rank_skills(c("_skills"), F.array().cast("array<string>")))
    study = F.array_join(F.transform(F.coalesce("education", F.array().cast("array<map<string,string>>")), render_record), "\n")
    df = df.withColumns({"_f": got, "_c": conf, "_me": render_personal(c("personal_info")), "_study": study, "_job": F.get("internship", F.lit(0)), "_work": F.get("projects", F.lit(0))})
    job, work = c("_job"), c("_work")
    period = F.concat(F.coalesce(_get(job, "start", "start_date"), F.lit("")), F.lit(" - "), F.coalesce(_get(job, "end", "end_date"), F.lit("")))
    rows = [(k, m, c("_f")[k], c("_c")[k]) for k, m in OWNER.items()]
    rows.append(("top_skills", None, F.array_join(F.slice(c("_f.top_skills"), 1, 3), ", "), c("_c.top_skills")))
    rows += [(k, "personal_info", F.regexp_replace(F.regexp_extract("_me", p, 1), r"^[\s,;]+|[\s,;]+$", ""), None) for k, p in LABELLED.items()]
    rows += [
        ("gpa", "education", F.regexp_extract("_study", GPA, 1), None),
        ("internship_employer", "internship", _get(job, "employer", "company", "organisation"), None),
        ("internship_title", "internship", _get(job, "title", "role", "position"), None),
        ("internship_dates", "internship", F.regexp_replace(period, "^[ -]+|[ -]+$", ""), None),
        ("internship_summary", "internship", _get(job, "summary", "description", "detail"), None),
        ("project_name", "projects", _get(work, "name", "title"), None),
        ("project_summary", "projects", _get(work, "summary", "description", "detail"), None),
    ]
    fact = lambda k, m, v, p: F.when(
        (F.lit(True) if m is None else F.array_contains("used", m)) & (F.length(F.trim(v)) > 0),
        F.struct(F.lit(k).alias("key"), F.trim(v).alias("value"), (F.lit(CONFIDENCE[k]) if p is None else p).alias("confidence")),
    )
    listed = df.select("profile_id", F.explode(F.array_compact(F.array(*[fact(*r) for r in rows]))).alias("r"))
    return listed.select("profile_id", "r.*")


def profile_from_text(texts: DataFrame, text: str = "text") -> DataFrame:
    """Fields read from free text, by their place in a profile: ``profile_id, filled, uncertain`` (confidence under 0.7)."""
    place = {"full_name": "personal_info", "email": "personal_info", "phone": "personal_info"}
    facts = extract_facts(texts.select("profile_id", F.col(text).alias("text")))
    module = F.lit("education")
    for k, m in place.items():
        module = F.when(F.col("key") == k, m).otherwise(module)
    path = F.concat(module, F.lit("."), F.regexp_replace("key", "^education_", ""))
    return facts.groupBy("profile_id").agg(  # a profile has at most seven such facts
        F.array_sort(F.collect_list(path)).alias("filled"), F.array_sort(F.collect_list(F.when(F.col("confidence") < 0.7, path))).alias("uncertain")
    )


def checked_modules(modules: Column) -> Column:
    """Authorised modules, each once, in order; raises on one that doesn't exist."""
    unknown = F.array_except(modules, F.array(*map(F.lit, MODULES)))
    return F.when(F.size(unknown) > 0, F.raise_error(F.concat(F.lit("unknown module: "), F.array_join(unknown, ", "))).cast("array<string>")).otherwise(F.array_distinct(modules))


def facts_as_list(facts: DataFrame) -> DataFrame:
    """A profile's facts as one array of structs (there are few per profile), by key."""
    return facts.groupBy("profile_id").agg(F.array_sort(F.collect_list(F.struct("key", "value", "confidence"))).alias("facts"))
