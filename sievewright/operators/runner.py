"""Whole cases under three conditions: rules alone (A), a model (B), a model with retrieved notes (C).

No model is at hand, so B and C use deterministic responders made of column expressions; their
numbers check the wiring and say nothing about a model's quality.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import confidence, fields, guards, similarity, skills, text

# Characters that a text is cut to, and the cap of a model's confidence once a claim was struck out.
MAX_CHARS = 20_000
FABRICATION_CAP = 0.35
# Fixed values: (words of a posting, its seniority), in order.
SENIORITY = ((("intern",), "intern"), (("entry level", "graduate", "junior"), "entry"), (("senior", "lead"), "senior"))


def _lines(t: Column) -> Column:
    bare = F.transform(fields.lines(t), lambda x: F.regexp_replace(x, r"^[ \-*\t]+|[ \-*\t]+$", ""))
    return F.filter(bare, lambda x: F.length(x) > 0)


def _sentences(t: Column) -> Column:
    words = lambda x: F.size(F.filter(F.split(x, r"\s+"), lambda w: F.length(w) > 0))
    return F.filter(_lines(t), lambda x: x.rlike(r"^\p{Lu}") & (words(x) >= 3))


def parse_posting(t: Column, found: Column) -> Column:
    """What a posting asks for: skills, up to five duties, seniority, years."""
    low = F.lower(F.coalesce(t, F.lit("")))
    level = F.lit(None).cast("string")
    for signs, name in reversed(SENIORITY):
        hit = F.lit(False)
        for s in signs:
            hit = hit | F.contains(low, F.lit(s))
        level = F.when(hit, name).otherwise(F.coalesce(level, F.lit("unspecified")))
    years = F.nullif(F.regexp_extract(low, r"(\d+)\+?\s*(?:-\s*\d+\s*)?years?", 1), F.lit("")).try_cast("int")
    duties = F.slice(F.transform(_sentences(t), lambda x: F.substring(x, 1, 120)), 1, 5)
    return F.struct(found.alias("required_skills"), duties.alias("responsibilities"), level.alias("seniority"), years.alias("years_experience"))


def analyse_posting(t: Column, found: Column, own: Column) -> Column:
    """Title, company, place, duties, requirements, nice-to-haves, and what a profile lacks."""
    lines = _lines(t)
    pick = lambda p, n: F.substring(F.trim(F.regexp_extract(F.coalesce(t, F.lit("")), p, 1)), 1, n)
    duties = F.filter(_sentences(t), lambda x: ~F.lower(x).rlike("requirement|qualification"))
    return F.struct(
        F.substring(F.coalesce(F.get(lines, F.lit(0)), F.lit("")), 1, 120).alias("job_title"),
        pick(r"(?i)(?:company|employer|organisation|organization)\s*[:\-]\s*(.+)", 80).alias("company"),
        pick(r"(?i)(?:location|based in|office)\s*[:\-]?\s*([A-Za-z][A-Za-z ,\-]{2,40})", 60).alias("location"),
        F.slice(F.transform(duties, lambda x: F.substring(x, 1, 120)), 1, 5).alias("responsibilities"),
        found.alias("requirements"),
        F.slice(F.transform(F.filter(lines, lambda x: x.rlike("(?i)nice to have|preferred|advantageous|a plus|bonus")), lambda x: F.substring(x, 1, 120)), 1, 4).alias("bonus_points"),
        F.array_except(found, own).alias("missing"),
    )


def retrieval_query(t: Column, found: Column) -> Column:
    return F.concat(F.lit("Job requirements: "), F.array_join(F.slice(found, 1, 12), ", "), F.lit(". Job description excerpt: "), F.substring(t, 1, 400))


def first_facts(facts: DataFrame) -> DataFrame:
    """The first fact of each profile and key: by ``position`` if the table has one, else the surest, then the smallest value."""
    order = [F.col("position").asc_nulls_last()] if "position" in facts.columns else []
    order += [F.col("confidence").desc_nulls_last(), F.col("value").asc_nulls_last()]
    rank = F.row_number().over(Window.partitionBy("profile_id", "key").orderBy(*order))
    return facts.withColumn("_first", rank).where("_first = 1").drop("_first")


def draft_fields(controls: DataFrame, facts: DataFrame, relevance: str = "") -> DataFrame:
    """The responder for forms: a control's fact, copied, or nothing. ``controls``: page_id, field_id, profile_id, fact_key; ``facts``: profile_id, key, value, confidence."""
    f = first_facts(facts).select("profile_id", F.col("key").alias("fact_key"), "value", F.col("confidence").alias("_c"))
    df = controls.join(f, ["profile_id", "fact_key"], "left")
    got = F.col("value").isNotNull() & (F.col("value") != "")
    return df.select(
        "page_id", "field_id", F.when(got, F.col("value")).alias("suggested_value"), F.when(got, F.col("_c")).otherwise(0.0).alias("confidence"),
        F.when(got, F.lit("profile")).otherwise("none").alias("source"), F.when(got, F.lit(relevance)).otherwise("").alias("jd_relevance"),
        F.when(got, "offline stub: copied verbatim from the authorised profile").otherwise("offline stub: no deterministic value for this field").alias("message"),
    )


def run_cases(cases: DataFrame) -> DataFrame:
    """Run every case under A, B and C.

    ``cases``: case_id, jd_text, resume_text, retrieval (the best retrieved note's calibrated score, or null). Returns per case and condition what a run log
    keeps: skills, claims, score, components, confidence, abstention, fields, notes of the cleaning.
    """
    c = F.col
    df = cases
    for side in ("jd", "resume"):
        clean, hits = text.neutralise(c(f"{side}_text"))
        df = df.withColumns({f"_{side}": text.collapse_whitespace(clean), f"_{side}_hits": hits})
        df = df.withColumn(f"_{side}", text.cap_length(c(f"_{side}"), MAX_CHARS)[0]).withColumn(f"_{side}_skills", skills.match_skills(c(f"_{side}")))
    df = similarity.with_term_counts(similarity.with_term_counts(df, "_jd", "_jt"), "_resume", "_rt")
    df = df.withColumns(
        {
            "_overlap": skills.skill_overlap(c("_resume_skills"), c("_jd_skills")),
            "_cos": similarity.pair_cosine(c("_rt"), c("_jt")),
            "_matched": F.array_sort(F.array_intersect("_resume_skills", "_jd_skills")),
            "_plain": guards.plain(c("_resume")),
        }
    ).drop("_jt", "_rt")
    df = df.withColumn("_own", confidence.heuristic_confidence(c("_resume"), c("_jd"), c("_overlap")))
    df = df.withColumn("_claims", F.transform("_matched", skills.canonicalise))
    df = df.withColumn("_struck", F.filter("_claims", lambda s: ~skills.has_lexical_support(s, c("_resume"), c("_resume_skills"))))
    got, conf = fields.extract_fields(c("_resume"), skills.rank_skills(c("_resume_skills"), c("_jd_skills")))
    df = df.withColumns({"_fields": got, "_conf": conf})
    # guarded values of the model's way: what the text doesn't support is dropped with its confidence
    ok = {k: guards.supports(c(f"_fields.{k}"), c("_plain")) for k in ("full_name", "email", "phone", "education_school", "education_major")}
    df = df.withColumn("condition", F.explode(F.array(F.lit("A"), F.lit("B"), F.lit("C"))))
    model = c("condition") != "A"
    own = F.when(F.size("_struck") > 0, F.least(c("_own"), F.lit(FABRICATION_CAP))).otherwise(c("_own"))
    retrieval = F.when(c("condition") == "A", c("_overlap")).when(c("condition") == "C", c("retrieval"))
    df = df.withColumn("_as", confidence.assess(retrieval, F.when(model, own)))
    zero = model & c("_as.abstain")
    names = [k for k in fields.FIELDS if k != "top_skills"]
    value = {k: F.when(~model | ok[k], c(f"_fields.{k}")) if k in ok else c(f"_fields.{k}") for k in names}
    df = df.withColumns({f"_v_{k}": v for k, v in value.items()})
    return df.select(
        "case_id", "condition", c("_jd_skills").alias("jd_skills"),
        F.when(model, F.array_except("_claims", "_struck")).otherwise(c("_matched")).alias("matched"),
        F.array_sort(F.array_except("_jd_skills", "_resume_skills")).alias("missing"), F.when(model, c("_struck")).otherwise(F.array().cast("array<string>")).alias("stripped_claims"),
        F.when(model, F.bround(100 * c("_overlap"))).otherwise(F.bround(100 * (0.5 * c("_cos") + 0.5 * c("_overlap")))).cast("int").alias("match_score"),
        F.bround("_as.combined", 4).alias("confidence"), c("_as.abstain").alias("abstained"), c("_as.components_present").alias("components_present"), c("_as.reasons").alias("reasons"),
        *[c(f"_v_{k}").alias(k) for k in names], c("_fields.top_skills").alias("top_skills"),
        F.create_map(*[x for k in fields.FIELDS for x in (F.lit(k), F.when(zero | (c(f"_v_{k}").isNull() if k != "top_skills" else F.lit(False)), F.lit(0.0)).otherwise(c(f"_conf.{k}")))]).alias("field_confidence"),
        F.concat(F.when(model, F.array_except("_claims", "_struck")).otherwise(c("_matched")), F.when(model, c("_fields.top_skills")).otherwise(F.array().cast("array<string>"))).alias("claimed_items"),
        c("_jd_hits").alias("jd_injections"), c("_resume_hits").alias("resume_injections"),
    )
