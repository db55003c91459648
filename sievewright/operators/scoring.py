"""Scoring of answers against ground truth, and count-first metrics of conditions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievewright.functions import skills

PREFILL = ("full_name", "email", "education_school", "top_skills")


def _norm(value: Column) -> Column:
    return F.coalesce(skills.normalise_skill(value), F.lit(""))


def score_cases(records: DataFrame, truth: DataFrame) -> DataFrame:
    """Score each record against its case; records without ground truth drop out.

    ``records``: case_id, condition, jd_skills, claimed_items, top_skills (arrays), prefill (map), abstained, match_score,
    confidence. ``truth``: case_id, job_family, jd_required_skills, candidate_skills (strings, lists split at ; , |),
    expected_* fields, expected_top_skills_n, hard_case, should_abstain.
    """
    c = F.col
    gt = truth.select(
        "case_id", "job_family",
        skills.skill_set(c("jd_required_skills")).alias("_required"),
        skills.skill_set(c("candidate_skills")).alias("_candidate"),
        *[_norm(c(f"expected_{k}")).alias(f"_x_{k}") for k in PREFILL[:3]],
        skills.skill_set(c("expected_top_skills")).alias("_pool"),
        c("expected_top_skills_n").alias("_n"), "hard_case", "should_abstain",
    )
    canon = lambda items: F.transform(
        F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0), skills.canonicalise
    )
    df = records.join(gt, "case_id").withColumns(
        {
            "_extracted": F.array_distinct(F.transform(canon(c("jd_skills")), skills.normalise_skill)),
            "_claims": canon(F.concat(F.coalesce("claimed_items", F.array().cast("array<string>")), F.coalesce("top_skills", F.array().cast("array<string>")))),
        }
    )
    first = skills.first_spellings(c("_claims"))
    df = df.withColumns(
        {
            "fabricated": F.array_sort(F.filter(first, lambda x: ~F.array_contains(c("_candidate"), skills.normalise_skill(x)))),
            "coverage": F.when(F.size("_required") == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect("_extracted", "_required")) / F.size("_required")),
            "complete_coverage": (F.size("_required") > 0) & (F.size(F.array_except("_required", "_extracted")) == 0),
            "_got": skills.skill_set(c("prefill")["top_skills"]),
        }
    )
    exact = {f"prefill_{k}": (c(f"_x_{k}") != "") & (c(f"_x_{k}") == _norm(c("prefill")[k])) for k in PREFILL[:3]}
    exact["prefill_top_skills"] = (c("_n") > 0) & (F.size("_got") == c("_n")) & (F.size(F.array_except("_got", "_pool")) == 0)
    df = df.withColumns(exact).withColumns(
        {
            "zero_fabrication": F.size("fabricated") == 0,
            "prefill_all_match": F.forall(F.array(*exact), lambda x: x),
        }
    )
    return df.select(
        "case_id", "condition", "job_family", "coverage", "complete_coverage", "fabricated", "zero_fabrication", *exact, "prefill_all_match",
        F.coalesce("abstained", F.lit(False)).alias("abstained"), "should_abstain", "hard_case",
        (c("zero_fabrication") & c("prefill_all_match") & ~F.coalesce("abstained", F.lit(False))).alias("passed"),
        F.coalesce("match_score", F.lit(0)).alias("match_score"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
    )


def rate(part: Column, whole: Column) -> Column:
    """A share; 0 of nothing is 0."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def condition_metrics(scores: DataFrame, bar: float = 0.80, digits: int = 1) -> DataFrame:
    """Counts, denominators and means per condition, as text cells where a count needs its denominator; the mean score is rounded to ``digits``."""
    c = F.col
    of = lambda name: F.count_if(c(name))
    flags = ["complete_coverage", "zero_fabrication", "prefill_full_name", "prefill_email", "prefill_education_school", "prefill_top_skills", "prefill_all_match", "abstained"]
    agg = scores.groupBy("condition").agg(
        F.count("*").alias("n_cases"), of("passed").alias("passed_cases"), *[of(f).alias(f) for f in flags],
        F.count_if(c("hard_case")).alias("n_hard"), F.count_if(~c("hard_case")).alias("n_easy"),
        F.count_if(c("hard_case") & c("abstained")).alias("abstained_on_hard"), F.count_if(~c("hard_case") & c("abstained")).alias("abstained_on_easy"),
        F.sum(F.size("fabricated")).alias("total_fabrications"),
        F.bround(F.avg("coverage"), 3).alias("mean_coverage"), F.bround(F.avg("match_score"), digits).alias("mean_match_score"), F.bround(F.avg("confidence"), 3).alias("mean_confidence"),
    )
    cell = lambda n, d: F.concat_ws("/", c(n).cast("string"), c(d).cast("string"))
    return agg.select(
        "condition", "n_cases", "passed_cases", (c("passed_cases") >= F.bround(bar * c("n_cases"))).alias("meets_pass_bar"),
        *[cell(f, "n_cases").alias(f) for f in flags],
        cell("abstained_on_hard", "n_hard").alias("abstained_on_hard"), cell("abstained_on_easy", "n_easy").alias("abstained_on_easy"),
        "total_fabrications", "mean_coverage", "mean_match_score", "mean_confidence",
    )


def metric_examples(scores: DataFrame, limit: int = 20) -> DataFrame:
    """The first cases (by id) behind a count: ``condition, kind, case_id, rank``; bounded by top-k, never by collecting a group."""
    from sievewright.operators.matching import top_k

    c = F.col
    kinds = F.array_compact(
        F.array(
            F.when(F.size("fabricated") > 0, "fabricated"), F.when(~c("hard_case") & c("abstained"), "abstained_on_easy"),
            F.when(c("hard_case") & ~c("abstained"), "missed_hard"), F.when(~c("prefill_all_match"), "prefill_missed"),
        )
    )
    rows = scores.select("condition", "case_id", F.explode(kinds).alias("kind"))
    return top_k(rows, ["condition", "kind"], ["case_id"], limit)


def passed_by_family(scores: DataFrame, families: list[str] | None = None) -> DataFrame:
    """Cross-tab of passed cases, conditions by families."""
    return scores.groupBy("condition").pivot("job_family", families).agg(F.count_if(F.col("passed")))


def build_prefill(case_fields: DataFrame, schema: DataFrame, threshold: float = 0.40) -> DataFrame:
    """Every field of the form schema for each case: empty, abstained (below the threshold) or suggested.

    ``case_fields``: case_id, name, value, confidence; ``schema``: name, label, ordinal. The schema is small and fixed.
    """
    c = F.col
    cases = case_fields.select("case_id").distinct()
    grid = cases.crossJoin(F.broadcast(schema))
    df = grid.join(case_fields, ["case_id", "name"], "left")
    value = F.coalesce(F.trim("value"), F.lit(""))
    conf = F.coalesce("confidence", F.lit(0.0))
    status = F.when(value == "", "empty").when(conf < threshold, "abstained").otherwise("suggested")
    return df.select(
        "case_id", "ordinal", "name", "label", status.alias("status"),
        F.when(status == "suggested", value).otherwise("").alias("value"),
        F.when(status == "empty", 0.0).otherwise(conf).alias("confidence"),
    )


def prefill_bundles(fields: DataFrame) -> DataFrame:
    """Per case: offered, withheld, and the mean confidence of what is offered."""
    c = F.col
    return fields.groupBy("case_id").agg(
        F.count_if(c("status") == "suggested").alias("offered"),
        F.count_if(c("status") == "abstained").alias("withheld"),
        F.coalesce(F.avg(F.when(c("status") == "suggested", c("confidence"))), F.lit(0.0)).alias("overall_confidence"),
    )
