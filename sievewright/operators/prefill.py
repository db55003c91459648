"""Prefill values from a model's answer, of which only what the source text supports is kept."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import fields, guards, text

# Where each field stands in an answer, and whether it must be grounded (degrees and years are reworded legitimately).
PLACES = {
    "full_name": ("personal_info", "full_name", True), "email": ("personal_info", "email", True), "phone": ("personal_info", "phone", True), "education_school": ("education", "school", True),
    "education_degree": ("education", "degree", False), "education_major": ("education", "major", True), "graduation_year": ("education", "graduation_year", False),
}
TOP_SKILLS = 3


def _quoted(value: Column) -> Column:
    """As a literal is written: in single quotes, in double ones if it holds a single one only."""
    mark = F.when(F.contains(value, F.lit("'")) & ~F.contains(value, F.lit('"')), F.lit('"')).otherwise(F.lit("'"))
    return F.concat(mark, value, mark)


def extract_prefill(answers: DataFrame) -> DataFrame:
    """``case_id``, the fields, ``top_skills``, ``field_confidence`` and ``dropped`` of ``answers(case_id, resume_text, answer)``.

    ``answer`` is a model's text with a JSON object of personal_info, education, top_skills and field_confidence. Values that must be grounded and that the source
    doesn't support are dropped, named in order, and lose their confidence, as do fields without a value. An answer without an object gives no fields. The first three
    supported skills stay.
    """
    c = F.col
    df = answers.select("case_id", guards.plain(c("resume_text")).alias("_hay"), text.extract_json(c("answer")).alias("_a"))
    said = {name: F.nullif(F.try_variant_get("_a", f"$.{part}.{key}", "string"), F.lit("")) for name, (part, key, _) in PLACES.items()}
    skills = F.filter(F.coalesce(F.try_variant_get("_a", "$.top_skills", "array<string>"), F.array().cast("array<string>")), lambda s: F.coalesce(F.length(s) > 0, F.lit(False)))
    confidence = F.coalesce(F.try_variant_get("_a", "$.field_confidence", "map<string,double>"), F.create_map().cast("map<string,double>"))
    df = df.select("case_id", "_hay", *[v.alias(f"_{k}") for k, v in said.items()], skills.alias("_said"), confidence.alias("_sure"))
    checked = {k: guards.supports(c(f"_{k}"), c("_hay")) for k, (*_, must) in PLACES.items() if must}
    df = df.withColumns({f"_ok_{k}": v for k, v in checked.items()} | {"_grounded": F.filter("_said", lambda s: guards.supports(s, c("_hay")))})
    gone = [
        F.when(c(f"_{k}").isNotNull() & ~c(f"_ok_{k}"), F.concat(F.lit(f"{part}.{key}="), _quoted(c(f"_{k}")))) for k, (part, key, must) in PLACES.items() if must
    ]
    lost = F.transform(F.filter("_said", lambda s: ~F.array_contains("_grounded", s)), lambda s: F.concat(F.lit("top_skills="), _quoted(s)))
    value = {k: F.when(c(f"_ok_{k}"), c(f"_{k}")) if must else c(f"_{k}") for k, (*_, must) in PLACES.items()}
    df = df.select("case_id", *[v.alias(k) for k, v in value.items()], F.slice("_grounded", 1, TOP_SKILLS).alias("top_skills"), "_sure", F.concat(F.array_compact(F.array(*gone)), lost).alias("dropped"))
    known = {k: c(k).isNotNull() for k in value} | {"top_skills": F.size("top_skills") > 0}
    sure = F.create_map(*[x for k in fields.FIELDS for x in (F.lit(k), F.when(known[k], F.coalesce(F.element_at("_sure", k), F.lit(0.0))).otherwise(0.0))])
    return df.select("case_id", *value, "top_skills", sure.alias("field_confidence"), "dropped")
