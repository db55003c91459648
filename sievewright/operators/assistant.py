"""Suggestions for the forms of many pages: scan, facts, drafts, evidence, decisions, counts and risks in one plan."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievewright.functions import confidence, forms, guards, skills
from sievewright.operators import profiles as people
from sievewright.operators import runner

#: Most requirements that a risk names.
NAMED = 6
CONDITIONS = ("A", "B", "C")


def suggest(controls: DataFrame, requests: DataFrame, profiles: DataFrame, drafts: DataFrame | None = None, threshold: float = confidence.THRESHOLD) -> DataFrame:
    """One row per control of each requested page, with its suggestion and decision; controls that may not be filled are kept.

    ``controls``: as ``pages.scan_controls`` gives them. ``requests``: one per page: page_id, profile_id, condition (A: rules alone, B: drafts,
    C: drafts and retrieval), posting, retrieval (calibrated score of the best note or null), overwrite. ``profiles``: as
    ``render_profile`` takes them; only authorised modules are seen, and an unknown profile has no facts. ``drafts``: page_id, field_id, proposed,
    model_confidence of a model; by default the offline responder's. A draft counts under B and C only, its confidence only beside a value.
    """
    c = F.col
    rendered = people.render_profile(profiles).select("profile_id", c("text").alias("source_text"), "used", "dropped")
    facts = runner.first_facts(people.facts_of(profiles)).select("profile_id", c("key").alias("fact_key"), c("value").alias("fact_value"), c("confidence").alias("fact_confidence"))
    ask = requests.select("page_id", "profile_id", F.upper("condition").alias("condition"), "retrieval", "overwrite")
    ask = ask.withColumn("retrieval", F.when(c("condition") == "C", c("retrieval")))
    df = forms.normalise_fields(controls).join(ask, "page_id").join(rendered.select("profile_id", "source_text"), "profile_id", "left")
    df = df.withColumn("source_text", F.coalesce("source_text", F.lit(""))).join(facts, ["profile_id", "fact_key"], "left")
    if drafts is None:
        df = df.withColumns({"proposed": c("fact_value"), "model_confidence": c("fact_confidence")})
    else:
        df = df.join(drafts.select("page_id", "field_id", "proposed", "model_confidence"), ["page_id", "field_id"], "left")
    # a model sees neither locked nor sensitive controls
    draft = F.when((c("condition") != "A") & c("fillable") & ~c("sensitive"), F.nullif(F.trim("proposed"), F.lit("")))
    df = df.withColumn("proposed", draft).withColumn("model_confidence", F.when(c("proposed").isNotNull(), c("model_confidence")))
    told = F.when(c("category") == "narrative", c("proposed"))
    df = df.withColumn("_names", guards.entities(F.coalesce(told, F.lit(""))))
    loose = F.concat(guards.unsupported_names(c("_names"), guards.even(c("source_text"))), guards.unsupported_numbers(told, c("source_text")))
    df = df.withColumn("unsupported", F.coalesce(loose, F.array().cast("array<string>"))).drop("_names")
    out = forms.decide(df, threshold)
    locked = ~c("fillable")
    return out.withColumns(
        {
            "confidence": F.when(locked, 0.0).otherwise(c("confidence")),
            "message": F.when(locked, c("skip_reason")).otherwise(c("message_kind")),
            "needs_confirmation": locked | c("needs_confirmation"),
        }
    )


def summarise(suggestions: DataFrame, requests: DataFrame, profiles: DataFrame) -> DataFrame:
    """One row per request: counts, what the posting asks for beyond the profile (the first ``NAMED`` by name), modules used and dropped, notes.

    A request whose page has no control has counts of zero.
    """
    c = F.col
    of = lambda d: F.count_if(c("decision") == d)
    counts = suggestions.groupBy("page_id").agg(
        F.count("*").alias("total"), of("offered").alias("offered"), of("abstained").alias("withheld"), of("missing").alias("missing"), of("sensitive_skipped").alias("sensitive_skipped"),
        of("already_filled").alias("already_filled"), F.count_if("needs_confirmation").alias("needs_confirmation"), of("not_fillable").alias("not_fillable"),
        F.count_if(c("fillable") & ~c("sensitive") & ~c("already_filled")).alias("_open"),
    )
    names = [x for x in counts.columns if x != "page_id"]
    people_ = people.render_profile(profiles).select("profile_id", skills.match_skills(c("text")).alias("_own"), "used", "dropped")
    none = F.array().cast("array<string>")
    df = requests.select("page_id", "profile_id", F.upper("condition").alias("condition"), skills.match_skills(c("posting")).alias("_asked"))
    df = df.join(counts, "page_id", "left").join(people_, "profile_id", "left")
    df = df.withColumns({n: F.coalesce(n, F.lit(0)) for n in names} | {n: F.coalesce(n, none) for n in ("_own", "_asked", "used", "dropped")})
    seen = c("total") > c("not_fillable")
    notes = F.array_compact(
        F.array(
            F.when(c("condition") == "B", "no retrieved notes were used"),
            F.when(~seen, "no control may be filled").when(c("_open") == 0, "every control is sensitive or already answered"),
            F.when(c("condition") != "A", "drafts are the offline responder's"),
        )
    )
    lacking = F.slice(F.array_sort(F.array_except("_asked", "_own")), 1, NAMED)
    return df.select("page_id", "condition", *[n for n in names if n != "_open"], lacking.alias("lacking"), "used", "dropped", notes.alias("notes"))
