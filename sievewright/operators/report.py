"""Markdown reports from small frames (a row per condition), counts first."""

from __future__ import annotations

from pyspark.sql import DataFrame


def _table(rows: list[list[object]], head: list[str]) -> str:
    lines = ["| " + " | ".join(head) + " |", "|" + "---|" * len(head)]
    return "\n".join(lines + ["| " + " | ".join("" if x is None else str(x) for x in r) + " |" for r in rows])


def markdown(metrics: DataFrame, examples: DataFrame, timing: DataFrame | None = None, shown: int = 6) -> str:
    """Headline, abstention, prefill, examples and timing of a run. ``metrics`` has a row per condition, ``examples`` are capped already."""
    m = sorted(metrics.collect(), key=lambda r: r["condition"])
    parts = ["# Run report", "## Headline", _table([[r["condition"], f"{r['passed_cases']}/{r['n_cases']}", "yes" if r["meets_pass_bar"] else "no", r["zero_fabrication"], r["prefill_all_match"]] for r in m],
                                                   ["condition", "passed", "meets the bar", "no fabrication", "prefill"])]
    parts += ["## Abstention", _table([[r["condition"], r["abstained"], r["abstained_on_hard"], r["abstained_on_easy"]] for r in m], ["condition", "all", "hard", "easy"])]
    parts += ["## Prefill", _table([[r["condition"], r["prefill_full_name"], r["prefill_email"], r["prefill_education_school"], r["prefill_top_skills"]] for r in m], ["condition", "name", "email", "school", "skills"])]
    found: dict[tuple[str, str], list[str]] = {}
    for r in examples.where(f"rank <= {shown}").orderBy("condition", "kind", "rank").collect():
        found.setdefault((r["condition"], r["kind"]), []).append(r["case_id"])
    parts += ["## Examples", _table([[k, kind, ", ".join(v)] for (k, kind), v in found.items()], ["condition", "kind", "cases"])]
    if timing is not None:
        t = timing.first()
        said = f"mean reduction {t['mean_reduction']}, {t['hits']}/{t['n_paired']} reach the target" if t["status"] == "reported" else "no number is reported"
        parts += ["## Timing", f"{t['status']}: {t['n_timers']} timers, {t['n_paired']} pairs; {said}"]
    return "\n\n".join(parts) + "\n"
