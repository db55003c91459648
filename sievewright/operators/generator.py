"""Cases generated with a contract: what is rendered is exactly what is declared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.functions import skills
from sievewright.operators.quantiles import with_quantiles
from sievewright.operators.sampling import SEED, priority

#: How many skills a posting requires, and how many a candidate has besides.
REQUIRED, OTHERS = (3, 8), 3


def display(skill: str) -> str:
    """How a skill is written in a text: its first alias that names nothing else."""
    ok = [a for a in skills.SKILLS[skill] if len(a) >= skills.MIN_ALIAS and skills.IMPLIED[a] == [skill]]
    return (ok or list(skills.SKILLS[skill]))[0]


def _drawn(case: Column, side: str, size: Column | int) -> Column:
    """The ``size`` skills of least priority for a case, in that order."""
    names = F.array(*[F.lit(x) for x in sorted(skills.SKILLS)])
    ranked = F.array_sort(F.transform(names, lambda s: F.concat(priority(SEED, case, F.lit(side), s), s)))
    return F.transform(F.slice(ranked, 1, size), lambda x: F.substring(x, 33, 1000))


def _between(case: Column, side: str, low: int, span: Column | int) -> Column:
    return (low + F.conv(F.substring(priority(SEED, case, F.lit(side)), 1, 8), 16, 10).cast("long") % span).cast("int")


def draw_cases(ids: DataFrame) -> DataFrame:
    """A case for each of ``ids(case_id, job_family)``, drawn by seed where its row is, and rendered to texts.

    A posting requires ``REQUIRED`` skills; a candidate has the first few of them and ``OTHERS`` drawn apart.
    """
    c = F.col
    df = ids.withColumn("required_skills", _drawn(c("case_id"), "required", _between(c("case_id"), "required", REQUIRED[0], REQUIRED[1] - REQUIRED[0] + 1)))
    kept = F.slice("required_skills", 1, _between(c("case_id"), "kept", 0, F.size("required_skills") + 1))
    df = df.withColumn("candidate_skills", F.array_sort(F.array_distinct(F.concat(kept, _drawn(c("case_id"), "own", OTHERS)))))
    df = df.withColumns({"full_name": F.concat(F.lit("Candidate "), "case_id", F.lit(" Example")), "required_skills": F.array_sort("required_skills")})
    names = sorted(skills.SKILLS)
    shown = F.create_map(*[F.lit(x) for s in names for x in (s, display(s))])
    bullets = lambda col: F.array_join(F.transform(col, lambda s: F.concat(F.lit("- "), shown[s])), "\n")
    return df.select(
        "*",
        F.concat(F.lit("About the role\n\nYou bring\n"), bullets(c("required_skills")), F.lit("\n")).alias("jd_text"),
        F.concat(c("full_name"), F.lit("\n\nWhat I use\n"), bullets(c("candidate_skills")), F.lit("\n")).alias("resume_text"),
    )


# Fixed value: below this overlap a case is hard.
HARD_OVERLAP = 0.5


def ground_truth(cases: DataFrame) -> DataFrame:
    """What a right answer to each case is: overlap, whether it is hard, the person's name, the skills that count and how many of them."""
    c = F.col
    o = skills.skill_overlap(c("candidate_skills"), c("required_skills"))
    pool = F.array_sort(F.array_intersect("candidate_skills", "required_skills"))
    hard = (o < HARD_OVERLAP).cast("int")
    return cases.select(
        "case_id", "job_family", F.array_join("required_skills", "|").alias("jd_required_skills"), F.array_join("candidate_skills", "|").alias("candidate_skills"), F.bround(o, 4).alias("skill_overlap"),
        hard.alias("hard_case"), hard.alias("should_abstain"), F.lit(f"skill_overlap < {HARD_OVERLAP}").alias("hard_case_definition"), c("full_name").alias("expected_full_name"),
        F.array_join(pool, "|").alias("expected_top_skills"), F.least(F.lit(3), F.size(pool)).alias("expected_top_skills_n"),
    )


def build_cases(spark: SparkSession, families: list[str], per_family: int) -> DataFrame:
    """``per_family`` cases of each family, drawn and rendered."""
    ids = spark.range(per_family).select(F.explode(F.array(*map(F.lit, families))).alias("job_family"), "id")
    return draw_cases(ids.select(F.format_string("%s-%02d", "job_family", "id").alias("case_id"), "job_family"))


def contract_violations(cases: DataFrame) -> DataFrame:
    """Cases whose rendered skills differ from the declared ones: ``case_id, side, extra, missing``."""
    out = None
    for side, text, declared in (("jd", "jd_text", "required_skills"), ("resume", "resume_text", "candidate_skills")):
        found = skills.match_skills(F.col(text))
        part = cases.select("case_id", F.lit(side).alias("side"), F.array_except(found, declared).alias("extra"), F.array_except(declared, found).alias("missing"))
        out = part if out is None else out.union(part)
    return out.where((F.size("extra") > 0) | (F.size("missing") > 0))


def case_summary(cases: DataFrame) -> DataFrame:
    """Per family: cases, hard cases, smallest, median and largest overlap."""
    o = skills.skill_overlap(F.col("candidate_skills"), F.col("required_skills"))
    scored = cases.select("job_family", o.alias("_o"))
    out = scored.groupBy("job_family").agg(F.count("*").alias("cases"), F.count_if(F.col("_o") < 0.5).alias("hard"), F.min("_o").alias("min_overlap"), F.max("_o").alias("max_overlap"))
    return with_quantiles(out, scored, ["job_family"], "_o", {"median_overlap": ("linear", 0.5)})
