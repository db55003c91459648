"""Cleaning of untrusted text, fingerprints and label normalisation, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

REDACTION = "[removed-untrusted-instruction]"
# What an instruction hidden in data looks like, in the order of replacement.
INJECTIONS = (
    r"ignore\s+(all\s+)?(the\s+)?(previous|prior|above)\s+instructions?",
    r"disregard\s+(all\s+)?(the\s+)?(previous|prior|above)\s+.*?(instructions?|rules?)",
    r"forget\s+(everything|all)\s+(you|previously)",
    r"you\s+are\s+now\s+(a|an)\s+\w+",
    r"new\s+(system\s+)?instructions?\s*:",
    r"system\s*(prompt|message)\s*:",
    r"(?<![A-Za-z])(system|assistant|developer)\s*:",
    r"<\|?(im_start|im_end|system|endoftext)\|?>",
    r"\[\s*(system|assistant|inst)\s*\]",
    r"###\s*(system|instruction)",
    r"jailbreak",
    r"pretend\s+(to\s+be|you\s+are)",
)
# Zero-width and direction characters; the fence around untrusted text; keys whose values are never logged.
INVISIBLE = r"[\u200b-\u200f\u202a-\u202e\u2060-\u2064\ufeff]"
FENCE = ("<<<UNTRUSTED_DATA_START>>>", "<<<UNTRUSTED_DATA_END>>>")


def strip_invisible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def neutralise(text: Column) -> tuple[Column, Column]:
    """Cleaned text and number of replacements; every pattern sees what the ones before it left."""
    clean, hits = strip_invisible(text), F.lit(0)
    for p in INJECTIONS:
        pattern = "(?iU)" + p
        hits = hits + F.regexp_count(clean, F.lit(pattern))
        clean = F.regexp_replace(clean, pattern, REDACTION.replace("[", r"\[").replace("]", r"\]"))
    return clean, hits


def collapse_whitespace(text: Column) -> Column:
    """Line ends made LF, blanks collapsed, at most one empty line, ends trimmed."""
    t = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "[ \t]+", " ")
    t = F.regexp_replace(t, "\n{3,}", "\n\n")
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def cap_length(text: Column, most: int) -> tuple[Column, Column]:
    """The text cut to ``most`` characters and whether it was cut; no limit if that isn't positive."""
    if most <= 0:
        return text, F.lit(False)
    return F.substring(text, 1, most), F.char_length(text) > most


def hash8(text: Column) -> Column:
    return F.substring(F.sha2(text, 256), 1, 8)


def fingerprint(text: Column) -> Column:
    """Length and hash, which may be logged where the text may not."""
    return F.struct(F.char_length(text).alias("chars"), hash8(text).alias("sha256_8"))


def wrap_untrusted(text: Column, label: str = "JOB_DESCRIPTION") -> Column:
    return F.concat(F.lit(f"{FENCE[0]} ({label})\n"), text, F.lit(f"\n{FENCE[1]}"))


def normalise_label(text: Column) -> Column:
    """Words of a label or attribute: camel case and acronyms split, separators made spaces, lower case."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), "(?<=[a-z0-9])(?=[A-Z])", " ")
    t = F.regexp_replace(t, "(?<=[A-Z])(?=[A-Z][a-z])", " ")
    t = F.regexp_replace(t, r"[_\-.\[\]()/|,;:]+", " ")
    return F.lower(F.trim(F.regexp_replace(t, r"(?U)\s+", " ")))


def tidy(text: Column) -> Column:
    """Blanks collapsed in lines, empty lines dropped to one, ends trimmed."""
    return collapse_whitespace(text)


# What a message says -> its kind.
MESSAGE_KINDS = (
    ("extremely sensitive", "sensitive"), ("already entered something", "already_filled"), ("withheld rather than guessed", "abstained"),
    ("not one of this control's options", "option_mismatch"), ("cannot be expressed in", "length_unanswerable"), ("shortened to fit", "trimmed"),
    ("so your profile's own wording was used instead", "draft_replaced"), ("was not supported", "unsupported_claim"),
    ("offline stub: copied verbatim", "copied_from_profile"), ("offline stub: no deterministic value", "stub_no_value"),
    ("no information for this field", "no_fact"), ("nothing in your authorised profile answers", "no_fact"), ("no fact in the authorised profile", "no_fact"),
    ("hidden input", "not_fillable"), ("submit control", "not_fillable"), ("button control", "not_fillable"), ("reset control", "not_fillable"),
    ("image submit control", "not_fillable"), ("file upload", "not_fillable"), ("password field", "not_fillable"), ("readonly control", "not_fillable"),
    ("disabled control", "not_fillable"), ("unsupported control", "not_fillable"),
)


def message_kinds(message: Column) -> Column:
    """Every kind whose sign a message has, in order."""
    low = F.lower(F.coalesce(message, F.lit("")))
    return F.array_compact(F.array(*[F.when(F.contains(low, F.lit(sign)), kind) for sign, kind in MESSAGE_KINDS]))


def redact(text: Column, secrets: list[str], mark: str = "[redacted]") -> Column:
    """The text with every secret replaced."""
    for s in secrets:
        text = F.replace(text, F.lit(s), F.lit(mark))
    return text


def extract_json(text: Column) -> Column:
    """The JSON object of a model's answer as a variant: fences dropped, cut to the braces, trailing commas mended; else null."""
    bare = F.regexp_replace(F.trim(text), r"(?s)^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    mended = F.regexp_replace(inner, r",\s*([}\]])", "$1")
    found = F.coalesce(F.try_parse_json(F.when(F.startswith(bare, F.lit("{")), bare)), F.try_parse_json(F.nullif(inner, F.lit(""))), F.try_parse_json(F.nullif(mended, F.lit(""))))
    return F.when(F.schema_of_variant(found).startswith("OBJECT"), found)


def estimate_cost(tokens_in: Column, tokens_out: Column, price_in: float = 0.15, price_out: float = 0.60) -> Column:
    return F.bround((tokens_in * price_in + tokens_out * price_out) / 1e6, 6)
