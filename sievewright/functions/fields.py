"""Rules that read the fields of a person's document."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns of the fields.
EMAIL = r"[\w.\-+]+@[\w\-]+\.[\w.\-]+"
PHONE = r"(?:\+\d{1,3}[\s\-]?)?(?:\(?\d{2,4}\)?[\s\-]?)?\d{3,4}[\s\-]?\d{4}"
SCHOOL = r"([A-Z][A-Za-z&.\-']*(?:[ \t]+[A-Z][A-Za-z&.\-']*)*[ \t]+(?:University|Institute of Technology|College|Polytechnic))"
DEGREE = r"(?i)\b(Bachelor(?:'s)?(?:\s+of\s+[A-Za-z]+)?|Master(?:'s)?(?:\s+of\s+[A-Za-z]+)?|B\.?Sc|M\.?Sc|B\.?Eng|M\.?Eng|PhD|Doctorate)\b"
MAJOR = (
    r"(?i)\b(?:in|of)\s+((?:Artificial Intelligence|Computer Science|Software Engineering|Data Science|Data Analytics|"
    r"Information Systems|Business Analytics|Product Management|Machine Learning|Computer Engineering|Statistics))\b"
)
YEAR = r"\b(20\d{2})\b"
NAME_LABELS = ("full name", "name", "candidate")
# Confidence of each rule when it finds something.
CONFIDENCE = {
    "full_name": 0.85, "email": 0.95, "education_school": 0.70, "phone": 0.75,
    "education_degree": 0.80, "education_major": 0.80, "graduation_year": 0.55,
}
FIELDS = ("full_name", "email", "phone", "education_school", "education_degree", "education_major", "graduation_year", "top_skills")


def _first(text: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.trim(F.regexp_extract(F.coalesce(text, F.lit("")), pattern, group)), F.lit(""))


def email(text: Column) -> Column:
    return _first(text, EMAIL, 0)


def phone(text: Column) -> Column:
    return _first(text, PHONE, 0)


def school(text: Column) -> Column:
    return _first(text, SCHOOL, 1)


def degree(text: Column) -> Column:
    return _first(text, DEGREE, 1)


def major(text: Column) -> Column:
    return _first(text, MAJOR, 1)


def graduation_year(text: Column) -> Column:
    """The largest year of this century in the text."""
    return F.array_max(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(YEAR), F.lit(1)))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\r\n|\n|\r")


def _strip(line: Column, chars: str) -> Column:
    return F.regexp_replace(line, f"^[{chars}]+|[{chars}]+$", "")


def first_line(text: Column) -> Column:
    """The first line that isn't blank once bullets are stripped; empty if there is none."""
    kept = F.filter(F.transform(lines(text), lambda x: _strip(x, r" \-*\t")), lambda x: F.length(x) > 0)
    return F.coalesce(F.get(kept, F.lit(0)), F.lit(""))


def full_name(text: Column) -> Column:
    """What follows a name label in the earliest line that has one, else a first line that looks like a name."""
    labelled = F.filter(
        F.flatten(
            F.transform(
                lines(text),
                lambda x: F.array(
                    *[
                        F.when(
                            F.instr(F.lower(x), label + ":") > 0,
                            _strip(F.substring(x, F.instr(F.lower(x), label + ":") + F.lit(len(label) + 1), F.length(x)), r" \t\-|"),
                        )
                        for label in NAME_LABELS
                    ]
                ),
            )
        ),
        lambda v: v.isNotNull() & (F.length(v) > 0),
    )
    head = first_line(text)
    words = F.filter(F.split(head, r"(?U)\s+"), lambda w: F.length(w) > 0)
    proper = F.forall(words, lambda w: ~w.rlike(r"^\p{L}") | w.rlike(r"^\p{Lu}"))
    looks = F.size(words).between(2, 4) & ~head.rlike(r"\d") & proper
    return F.coalesce(F.get(labelled, F.lit(0)), F.when(looks, head))


def extract_fields(text: Column, top_skills: Column) -> tuple[Column, Column]:
    """A struct of the eight fields and one of their confidences."""
    got = {
        "full_name": full_name(text), "email": email(text), "phone": phone(text), "education_school": school(text),
        "education_degree": degree(text), "education_major": major(text), "graduation_year": graduation_year(text),
    }
    conf = [F.when(v.isNotNull(), F.lit(CONFIDENCE[k])).otherwise(F.lit(0.0)).alias(k) for k, v in got.items()]
    n = F.size(top_skills)
    conf.append(F.when(n >= 3, F.lit(0.60)).when(n > 0, F.lit(0.35)).otherwise(F.lit(0.0)).alias("top_skills"))
    return (
        F.struct(*[v.alias(k) for k, v in got.items()], top_skills.alias("top_skills")),
        F.struct(*conf),
    )
