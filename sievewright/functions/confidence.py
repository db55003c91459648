"""Evidence combined into a confidence, with an abstention rule."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Weights of retrieval and of the model's own confidence, thresholds, calibration band.
WEIGHTS = (0.6, 0.4)
THRESHOLD = 0.40
HARD_CASE = 0.5
BAND = (0.3663, 0.5633)


def clip(x: Column) -> Column:
    """Between 0 and 1; null stays null."""
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x.cast("double"))))


def assess(retrieval: Column, own: Column, threshold: float = THRESHOLD, either: bool = True) -> Column:
    """A struct of ``combined, abstain, components_present, reasons``.

    The mean of the components that are present, by renormalised weights. Abstains below the threshold (equal isn't
    below), if ``either`` component is below it, or if there is none.
    """
    r, o = clip(retrieval), clip(own)
    w = F.when(r.isNotNull(), F.lit(WEIGHTS[0])).otherwise(0.0) + F.when(o.isNotNull(), F.lit(WEIGHTS[1])).otherwise(0.0)
    total = F.coalesce(r * WEIGHTS[0], F.lit(0.0)) + F.coalesce(o * WEIGHTS[1], F.lit(0.0))
    both = r.isNotNull() & o.isNotNull()
    none = r.isNull() & o.isNull()
    combined = F.when(none, F.lit(0.0)).when(both, total / w).otherwise(F.coalesce(r, o))
    t = F.lit(threshold)
    weak_r, weak_o = F.coalesce(r < t, F.lit(False)), F.coalesce(o < t, F.lit(False))
    abstain = none | (combined < t) | (F.lit(either) & (weak_r | weak_o))
    only = F.when(r.isNotNull(), F.lit("retrieval")).otherwise(F.lit("llm_self"))
    # The wording of the reasons.
    two = lambda x: F.format_string("%.2f", x)
    reasons = F.when(none, F.array(F.lit("no confidence component was available; declining"))).otherwise(
        F.array_compact(
            F.array(
                F.when(~both, F.concat(F.lit("only the "), only, F.lit(" component exists for this condition; confidence equals that component"))),
                F.when(combined < t, F.concat(F.lit("combined confidence "), two(combined), F.lit(f" < threshold {threshold:.2f}"))),
                F.when(F.lit(either) & weak_r, F.concat(F.lit("retrieval similarity "), two(r), F.lit(f" < threshold {threshold:.2f} (retrieval looked weak, so the answer is not trusted)"))),
                F.when(F.lit(either) & weak_o, F.concat(F.lit("model self-confidence "), two(o), F.lit(f" < threshold {threshold:.2f} (model reported it could not ground the answer)"))),
            )
        )
    )
    present = F.array_compact(F.array(F.when(o.isNotNull(), F.lit("llm_self")), F.when(r.isNotNull(), F.lit("retrieval"))))
    return F.struct(combined.alias("combined"), abstain.alias("abstain"), present.alias("components_present"), reasons.alias("reasons"))


def calibrate(raw: Column, floor: float = BAND[0], ceiling: float = BAND[1]) -> Column:
    """A raw similarity's place in the band; a band without width leaves it."""
    return clip(raw) if ceiling <= floor else clip((raw - floor) / (ceiling - floor))


def is_hard_case(overlap: Column) -> Column:
    return overlap < HARD_CASE


def heuristic_confidence(candidate: Column, posting: Column, overlap: Column, digits: int = 3) -> Column:
    """A deterministic stand-in for a model's confidence: overlap and detail raise it, vague wording lowers it."""
    # Vague wording.
    vague = ("various", "etc", "some experience", "familiar with", "exposure to")
    n_words = F.size(F.filter(F.split(F.coalesce(candidate, F.lit("")), r"(?U)\s+"), lambda w: F.length(w) > 0))
    detail = F.least(F.lit(1.0), n_words / 180.0)
    hits = sum((F.contains(F.lower(F.coalesce(posting, F.lit(""))), F.lit(m)).cast("int") for m in vague), F.lit(0))
    return F.bround(clip(0.25 + 0.5 * overlap + 0.25 * detail - F.least(F.lit(0.3), 0.1 * hits)), digits)
