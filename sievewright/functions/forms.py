"""Form controls: ids, classification, sensitivity, options, lengths and the decision ladder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sievewright.functions import confidence, guards
from sievewright.functions.text import normalise_label

# Control types that are never filled, and why.
SKIPPED_TYPES = {
    "hidden": "hidden input - not a visible form field",
    "submit": "submit control - the assistant never submits",
    "button": "button control - not a data field",
    "reset": "reset control - would clear the form",
    "image": "image submit control - the assistant never submits",
    "file": "file upload - no file can be synthesised",
    "password": "password field - never filled",
}
SKIPPED_ATTRIBUTES = {
    "readonly": "readonly control - the page locked it, so a value written here could not be edited or confirmed",
    "disabled": "disabled control - the page switched it off, so a value written here would neither be editable nor submitted",
}
# Labels of document numbers (kind, pattern), and ids that are none.
SENSITIVE = (
    ("passport number", r"\bpassport\b"),
    ("national identity number", r"\bnational\s+(id|identification|identity)\b|\bidentification\s+(number|no)\b|\bidentity\s+(card|number|no)\b|\bid\s+(card|number|no|num)\b"),
    ("national identity number", r"\bnric\b|\bmy\s*kad\b|\baadhaar\b|\baadhar\b|\bpan\s+card\b"),
    ("social security number", r"\b(ssn|social\s+security)\b"),
    ("residence permit number", r"\b(residence|resident)\s+permit\b"),
    ("tax identification number", r"\btax\s+(id|identification|file\s+number)\b|\btin\b"),
    ("driving licence number", r"\b(driving|driver'?s?)\s+licen[cs]e\b"),
    ("national identity number", "身份证|护照|证件号|證件號"),
)
SAFE_ID = r"\b(student|matriculation|matric|enrol?ment|application|candidate|reference|requisition|posting|order|ticket|employee|staff)\s*(id|no|number|ref)\b"
# Fixed values: (category, module, fact key, pattern of the label); the first that matches classifies a control.
RULES = (
    ("personal", "personal_info", "email", r"\be ?mail\b"),
    ("personal", "personal_info", "phone", r"\b(phone|mobile|telephone|contact number|cell(ular)?|contact no)\b"),
    ("personal", "personal_info", "linkedin", r"\blinked ?in\b"),
    ("personal", "personal_info", "github", r"\bgit ?hub\b"),
    ("personal", "personal_info", "portfolio", r"\b(portfolio|personal (web ?site|site|page)|homepage)\b"),
    ("personal", "personal_info", "location", r"\b(location|city|country|address|residence|based in|where are you based)\b"),
    ("personal", "personal_info", "full_name", r"\b(full ?name|applicant name|your name|candidate name|given name|first name|last name|surname|family name)\b"),
    ("education", "education", "education_school", r"\b(university|institution|school|college|alma mater)\b"),
    ("education", "education", "graduation_year", r"\b(graduation|graduating|class of|expected (graduation|completion)|completion year)\b"),
    ("education", "education", "gpa", r"\b(gpa|grade point average|grade average)\b"),
    ("education", "education", "education_degree", r"\b(degree|qualification|level of study)\b"),
    ("education", "education", "education_major", r"\b(major|discipline|programme|program of study|field of study|speciali[sz]ation)\b"),
    ("experience_fact", "internship", "internship_employer", r"\b(employer|company( name)?|organi[sz]ation|firm)\b"),
    ("experience_fact", "internship", "internship_title", r"\b(job title|position|role title|designation|current (title|role))\b"),
    ("experience_fact", "internship", "internship_dates", r"\b(internship|employment|work)\s+(start|end|period|dates?)\b"),
    ("experience", "internship", "internship_summary", r"\b(work experience|employment history|internship experience|describe your (work|role|internship))\b"),
    ("project_fact", "projects", "project_name", r"\bproject (name|title)\b"),
    ("project", "projects", "project_summary", r"\b(project (description|summary|details)|describe (a )?project|portfolio project)\b"),
    ("skills", None, "top_skills", r"\b(skills|technical skills|key skills|competenc(y|ies)|areas of expertise|core strengths)\b"),
    ("narrative", None, None, r"\b(cover letter|motivation|why (do you|you) want|why this (role|company|position|team)|tell us about yourself|introduce yourself|personal statement|additional information|anything else|message to|statement of purpose|self introduction)\b"),
)
NAME = r"\bname\b"
NOT_A_PERSON = r"\b(company|employer|school|university|college|project|reference|user|file|nick|host|first|last|given|family|surname)\b"
# Spellings of one qualification.
QUALIFICATIONS = (
    ("bachelor", "bachelors", "bachelor of science", "bachelor of engineering", "bachelor of arts", "bsc", "bs", "b eng", "beng", "b a", "ba", "undergraduate"),
    ("master", "masters", "master of science", "master of engineering", "master of arts", "msc", "ms", "m eng", "meng", "m a", "ma", "postgraduate"),
    ("phd", "ph d", "doctorate", "doctoral", "doctor of philosophy", "dphil"),
    ("mba", "master of business administration"),
)
TAILORED = ("narrative", "experience", "project", "skills")
FACTS = ("personal", "education", "experience_fact", "project_fact")


def _text(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def labelish(label: Column, placeholder: Column, aria: Column, help_: Column, name: Column, id_: Column) -> Column:
    """What a control is judged by; the heading of its section isn't part of it."""
    return normalise_label(F.concat_ws(" ", *[_text(x) for x in (label, placeholder, aria, help_, name, id_)]))


def field_id(name: Column, id_: Column, label: Column, placeholder: Column, index: Column) -> Column:
    basis = F.concat_ws("|", *[F.trim(_text(x)) for x in (name, id_, label, placeholder)])
    empty = F.length(F.trim(F.replace(basis, F.lit("|"), F.lit("")))) == 0
    return F.when(empty, F.format_string("wf_anon_%03d", index)).otherwise(F.concat(F.lit("wf_"), F.substring(F.sha1(basis), 1, 12)))


def sensitive_kind(text: Column) -> Column:
    """The kind of document number that a label asks for, else null; safe ids come first."""
    out = F.when(F.length(text) == 0, F.lit(None).cast("string")).when(text.rlike("(?i)" + SAFE_ID), F.lit(None).cast("string"))
    for kind, pattern in SENSITIVE:
        out = out.when(text.rlike("(?i)" + pattern), F.lit(kind))
    return out


def classify(text: Column, section: Column) -> Column:
    """A struct of ``category, module, fact_key``: the first rule that matches."""

    def made(*cells: str | None) -> Column:
        return F.struct(*[F.lit(x).cast("string").alias(n) for x, n in zip(cells, ("category", "module", "fact_key"), strict=True)])

    unknown = made("unknown", None, None)
    out = F.when(F.length(text) == 0, unknown)
    for category, module, key, pattern in RULES:
        out = out.when(text.rlike("(?i)" + pattern), made(category, module, key))
    named = text.rlike("(?i)" + NAME) & ~text.rlike("(?i)" + NOT_A_PERSON)
    elsewhere = normalise_label(section).rlike("(?i)" + NOT_A_PERSON)
    return out.when(named & ~elsewhere, made("personal", "personal_info", "full_name")).otherwise(unknown)


def normalise_fields(raw: DataFrame) -> DataFrame:
    """Controls of pages (``page_id, idx, ...``) with id, class, sensitivity and whether they may be filled.

    Controls that may not are kept, with the reason. Repeated ids of a page get the suffixes -2, -3, ...
    """
    c = F.col
    text = labelish(c("label"), c("placeholder"), c("aria_label"), c("help_text"), c("name"), c("id"))
    tag = F.lower(F.trim(F.coalesce(F.nullif(c("tag"), F.lit("")), F.lit("input"))))
    kind = F.coalesce(F.nullif(F.replace(normalise_label(c("type")), F.lit(" "), F.lit("")), F.lit("")), F.lit("text"))
    df = raw.withColumns({"text": text, "tag": tag, "type": kind})
    skip = F.when((c("tag") == "input") & c("type").isin(*SKIPPED_TYPES), F.element_at(F.create_map(*[F.lit(x) for kv in SKIPPED_TYPES.items() for x in kv]), c("type")))
    skip = skip.when(~c("tag").isin("input", "textarea", "select", "contenteditable"), F.concat(F.lit("unsupported control <"), c("tag"), F.lit(">")))
    skip = skip.when(c("tag").isin("input", "textarea") & F.coalesce(c("readonly"), F.lit(False)), F.lit(SKIPPED_ATTRIBUTES["readonly"]))
    skip = skip.when(c("tag").isin("input", "textarea", "select") & F.coalesce(c("disabled"), F.lit(False)), F.lit(SKIPPED_ATTRIBUTES["disabled"])).otherwise("")
    given = F.nullif(F.trim(_text(c("field_id"))), F.lit(""))
    df = df.withColumns(
        {
            "skip_reason": skip,
            "_class": classify(c("text"), c("section_context")),
            "_kind": sensitive_kind(c("text")),
            "_id": F.coalesce(given, field_id(c("name"), c("id"), c("label"), c("placeholder"), c("idx"))),
        }
    )
    n = F.row_number().over(Window.partitionBy("page_id", "_id").orderBy("idx"))
    locked = c("skip_reason").isin(*SKIPPED_ATTRIBUTES.values())
    label = F.trim(F.coalesce(*[F.nullif(_text(c(x)), F.lit("")) for x in ("label", "aria_label", "placeholder", "name")], F.lit("")))
    return df.withColumn("_n", n).select(
        "page_id", "idx",
        F.when(c("_n") == 1, c("_id")).otherwise(F.concat("_id", F.lit("-"), "_n")).alias("field_id"),
        label.alias("label"), "tag", "type", "required", "max_length",
        F.coalesce("options", F.array().cast("array<string>")).alias("options"),
        F.when(c("_kind").isNotNull() | locked, F.lit("")).otherwise(_text(c("current_value"))).alias("current_value"),
        ((F.length(F.trim(_text(c("current_value")))) > 0) & (c("skip_reason") == "")).alias("already_filled"),
        (c("skip_reason") == "").alias("fillable"), "skip_reason",
        c("_class.category").alias("category"), c("_class.module").alias("module"), c("_class.fact_key").alias("fact_key"),
        c("_kind").isNotNull().alias("sensitive"), c("_kind").alias("sensitive_kind"),
    )


def qualification_group(text: Column) -> Column:
    norm = F.trim(F.regexp_replace(F.lower(_text(text)), "[^a-z0-9]+", " "))
    out = F.when(F.length(norm) == 0, F.lit(None).cast("int"))
    for i, group in enumerate(QUALIFICATIONS):
        out = out.when(norm.rlike("^(" + "|".join(sorted(group, key=len, reverse=True)) + ")( |$)"), F.lit(i))
    return out


def match_option(value: Column, options: Column) -> Column:
    """The option that a value means: equal, equal but for punctuation, or another spelling of the qualification.

    The value itself if there are no options; null if none fits. Of several the first wins.
    """
    squeeze = lambda t: F.regexp_replace(F.trim(F.lower(t)), r"\s+", " ")
    bare = lambda t: F.regexp_replace(F.lower(t), "[^a-z0-9 ]+", "")
    wanted = squeeze(value)
    group = qualification_group(wanted)
    passes = [
        F.filter(options, lambda o: squeeze(o) == wanted),
        F.filter(options, lambda o: bare(o) == bare(wanted)),
        F.filter(options, lambda o: qualification_group(o) == group),
    ]
    found = F.coalesce(*[F.get(p, F.lit(0)) for p in passes])
    return F.when(F.coalesce(F.size(options), F.lit(0)) <= 0, value).when(F.length(wanted) > 0, found)


def fit_to_length(value: Column, most: Column) -> Column:
    """A struct of ``value, trimmed``: the longest start in whole words; null if under three characters stay."""
    edges = r" \t\n,;:\-–—/|"
    head = F.rtrim(F.substring(value, F.lit(1), most))
    after = F.substring(value, F.length(head) + 1, F.lit(1))
    whole = (F.length(head) > 0) & after.rlike(f"^[{edges}]")
    shorter = F.when(F.instr(head, " ") > 0, F.regexp_replace(head, r"(?s)\s+\S*$", "")).otherwise("")
    cut = F.regexp_replace(F.when(whole, head).otherwise(shorter), r"^[ \t,;:\-–—/|]+|[ \t,;:\-–—/|]+$", "")
    fits = most.isNull() | (most <= 0) | (F.length(value) <= most)
    return F.struct(
        F.when(value.isNull() | fits, value).when(F.length(cut) >= 3, cut).alias("value"),
        (value.isNotNull() & ~fits).alias("trimmed"),
    )


def evidence(category: Column, condition: Column, retrieval: Column, fact_confidence: Column) -> Column:
    """What stands for retrieval in a control's confidence."""
    return (
        F.when(F.upper(condition) == "A", fact_confidence)
        .when(category.isin(*TAILORED), retrieval)
        .when(fact_confidence.isNotNull(), fact_confidence)
        .when(category.isin(*FACTS), F.lit(None).cast("double"))
        .otherwise(retrieval)
    )


def decide(fields: DataFrame, threshold: float = confidence.THRESHOLD) -> DataFrame:
    """The decision ladder for each control.

    Needs the columns of ``normalise_fields`` and ``condition, proposed, model_confidence, fact_value,
    fact_confidence, retrieval, source_text, unsupported`` (array: unsupported claims of a narrative draft),
    ``overwrite``. Adds ``suggested_value, decision, confidence, needs_confirmation, message_kind``.
    """
    c = F.col
    df = fields.withColumn("_ev", evidence(c("category"), c("condition"), c("retrieval"), c("fact_confidence")))
    df = df.withColumn("_as", confidence.assess(c("_ev"), c("model_confidence"), threshold))
    draft = F.nullif(F.trim(_text(c("proposed"))), F.lit(""))
    df = df.withColumns({"_draft": draft, "_has_options": F.size("options") > 0, "_hay": guards.plain(c("source_text"))})
    df = df.withColumns(
        {
            "_draft_ok": ~c("_has_options") | match_option(c("_draft"), c("options")).isNotNull(),
            "_fact_ok": ~c("_has_options") | match_option(c("fact_value"), c("options")).isNotNull(),
            "_grounded": guards.supports(c("_draft"), c("_hay")),
        }
    )
    fact = c("fact_value").isNotNull()
    # which value is on offer, or why none is
    route = (
        F.when(c("sensitive"), "sensitive")
        .when(c("already_filled") & ~F.coalesce(c("overwrite"), F.lit(False)), "already_filled")
        .when(c("_draft").isNotNull() & ~c("_draft_ok"), "option_mismatch")
        .when(c("_draft").isNotNull() & (c("category") == "narrative") & (F.size("unsupported") > 0), "unsupported")
        .when(c("_draft").isNotNull() & ((c("category") == "narrative") | c("_grounded")), "draft")
        .when(c("_draft").isNotNull() & fact & ~c("_fact_ok"), "option_mismatch")
        .when(c("_draft").isNotNull() & fact, "fact_for_draft")
        .when(c("_draft").isNotNull(), "unsupported")
        .when(fact & ~c("_fact_ok"), "option_mismatch")
        .when(fact, "fact")
        .otherwise("nothing")
    )
    df = df.withColumn("_route", route)
    chosen = F.when(c("_route") == "draft", c("_draft")).when(c("_route").isin("fact", "fact_for_draft"), c("fact_value"))
    df = df.withColumn("_value", F.when(c("_has_options"), F.coalesce(match_option(chosen, c("options")), chosen)).otherwise(chosen))
    df = df.withColumn("_fit", fit_to_length(c("_value"), c("max_length")))
    decision = (
        F.when(~c("fillable"), "not_fillable")
        .when(c("_route") == "sensitive", "sensitive_skipped")
        .when(c("_route") == "already_filled", "already_filled")
        .when(c("_value").isNull(), "missing")
        .when(c("_as.abstain"), "abstained")
        .when(c("_fit.value").isNull(), "missing")
        .otherwise("offered")
    )
    kind = (
        F.when(c("_route").isin("sensitive", "already_filled", "option_mismatch", "unsupported", "nothing"), c("_route"))
        .when(c("_as.abstain"), "withheld")
        .when(c("_fit.value").isNull(), "too_long")
        .when(c("_fit.trimmed"), "shortened")
        .otherwise(c("_route"))
    )
    df = df.withColumn("decision", decision)
    offered = c("decision") == "offered"
    conf = F.when(c("sensitive"), F.lit(0.0)).otherwise(F.bround("_as.combined", 4))
    sure = ~c("_fit.trimmed") & c("category").isin("personal", "education") & (conf >= 0.7)
    return df.select(
        *[x for x in fields.columns if x not in ("source_text", "unsupported")],
        F.when(offered, c("_fit.value")).alias("suggested_value"),
        "decision",
        conf.alias("confidence"),
        (~(offered & sure)).alias("needs_confirmation"),
        kind.alias("message_kind"),
    )


# In which order a control's signs are judged, by a run over all forms and by a check of a live service.
DECISION_ORDERS = {
    "matrix": ("not_fillable", "sensitive_skipped", "offered", "abstained", "missing", "already_filled"),
    "live": ("sensitive_skipped", "not_fillable", "offered", "already_filled", "abstained", "missing"),
}


def classify_decision(fillable: Column, sensitive: Column, value: Column, abstained: Column, missing: Column, filled: Column, order: str = "matrix") -> Column:
    """One of six states, by precedence."""
    yes = lambda x: F.coalesce(x, F.lit(False))
    signs = {
        "not_fillable": ~F.coalesce(fillable, F.lit(True)), "sensitive_skipped": yes(sensitive), "offered": value.isNotNull(), "abstained": yes(abstained), "missing": yes(missing), "already_filled": yes(filled),
    }
    return F.coalesce(*[F.when(signs[state], state) for state in DECISION_ORDERS[order]], F.lit("unclassified"))


def field_list(fields: DataFrame) -> DataFrame:
    """Per page one text line for each control that may be filled and isn't sensitive, in order. A page has at most 400 controls."""
    c = F.col
    parts = F.concat_ws(
        " | ", F.concat(F.lit("- "), "field_id"), F.nullif(c("label"), F.lit("")), c("type"), F.when(c("required"), "required"),
        F.when(c("max_length").isNotNull(), F.concat(F.lit("max "), c("max_length").cast("string"))),
        F.when(F.size("options") > 0, F.concat(F.lit("options: "), F.array_join(F.slice("options", 1, 20), ", "))),
    )
    rows = fields.where(c("fillable") & ~c("sensitive")).select("page_id", F.struct("idx", parts.alias("line")).alias("r"))
    return rows.groupBy("page_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["line"]), "\n").alias("block"))
