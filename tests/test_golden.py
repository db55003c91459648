"""Small inputs with known answers for functions that the registered queries apply to whole tables."""

import duckdb
import pytest
from pyspark.sql import functions as F

from sievewright.functions import forms, guards, skills
from sievewright.functions import text as texts
from sievewright.operators import audit, generator, matching, profiles
from sievewright.plans.catalogue import _PROFILE_SCHEMA, _PROFILES, _joined, _sql, _values, c
from sievewright.sources import fetched, pdf
from tests.test_catalogue import close, rows

GOLDEN = {}


def query(sql):
    def keep(f):
        GOLDEN[f.__name__] = (f, sql)
        return f

    return keep


_GOLD_CANON = [
    ("sklearn", "scikit-learn"), ("  Rust  ", "Rust"), ("natural language processing (NLP)", "NLP"), ("net", "C#"), ("JS", "JavaScript"),
    ("Machine Learning and Deep Learning", "Machine Learning and Deep Learning"), ("GOLANG", "Go"), ("r and d team", "r and d team"),
]

@query(_sql(_GOLD_CANON, "value, canonical"))
def canonical_names(spark, d):
    return _values(spark, [(v,) for v, _ in _GOLD_CANON], "value string").select("value", skills.canonicalise(c("value")).alias("canonical"))


_GOLD_SUPPORT = [
    ("Java", "Python, JavaScript, Git", False), ("machine learning", "I use Machine Learning daily", True), ("Rust", "some rust code", True),
    ("TensorFlow", "no such thing", False), ("", "anything", False), ("Go", "we go to market", True), ("K8s", "Kubernetes clusters", True),
]

@query(_sql(_GOLD_SUPPORT, "claim, source, supported"))
def lexical_support(spark, d):
    df = _values(spark, [r[:2] for r in _GOLD_SUPPORT], "claim string, source string").withColumn("s", skills.match_skills(c("source")))
    return df.select("claim", "source", skills.has_lexical_support(c("claim"), c("source"), c("s")).alias("supported"))


_GOLD_RESUME = [
    (1, "Full Name: Ada Example | x\nada@example.org\n+65 9123 4567\nNanyang Technological University - Master of Science in Data Science, 2026\nPython, SQL, Docker",
     "Ada Example | x", "ada@example.org", "+65 9123 4567", "Nanyang Technological University", "Master of Science", "Data Science", "2026", 0.85, 0.6),
    (2, "Bob Sample\nBSc in Statistics, class of 2019 to 2023", "Bob Sample", None, None, None, "BSc", "Statistics", "2023", 0.85, 0.35),
    (3, "- plain text with nothing", None, None, None, None, None, None, None, 0.0, 0.0),
    (4, "Username: zed\nGit", "zed", None, None, None, None, None, None, 0.85, 0.35),
]

@query(_sql([(i, *r) for i, _, *r in _GOLD_RESUME], "id, full_name, email, phone, school, degree, major, year, conf_name, conf_skills"))
def extract_resume_fields(spark, d):
    df = matching.extract(_values(spark, [r[:2] for r in _GOLD_RESUME], "id int, text string"), "id", "text")
    return df.select("id", "full_name", "email", "phone", c("education_school").alias("school"), c("education_degree").alias("degree"),
                     c("education_major").alias("major"), c("graduation_year").alias("year"), c("conf_full_name").alias("conf_name"), c("conf_top_skills").alias("conf_skills"))


_GOLD_LABEL = [("PassportNo", "passport no"), ("NRICNumber", "nric number"), ("idNumber", "id number"), ("student_id", "student id"), ("E-mail (work)", "e mail work"), (None, "")]

@query(_sql(_GOLD_LABEL, "label, words"))
def normalised_labels(spark, d):
    return _values(spark, [(a,) for a, _ in _GOLD_LABEL], "label string").select("label", texts.normalise_label(c("label")).alias("words"))


_GOLD_JSON = [("```json\n{\"a\": 1}\n```", "1"), ("text {\"a\": 2} more", "2"), ("{\"a\": 3,}", "3"), ("[1]", None), ("no", None), (None, None)]

@query(_sql(_GOLD_JSON, "answer, a"))
def extract_json_objects(spark, d):
    df = _values(spark, [(a,) for a, _ in _GOLD_JSON], "answer string")
    return df.select("answer", F.try_variant_get(texts.extract_json(c("answer")), "$.a", "string").alias("a"))


_GOLD_GUARD = [
    (1, "I led dashboards at Acme Corp. My team grew 40%", "Acme Corp intern, grew sales 40%", "", True),
    (2, "At Beta Labs I used 3 tools", "Acme Corp", "Beta Labs I|3", True),
    (3, "Worked at Acme Pte. Ltd. in Singapore", "acme  pte-ltd", "", False),
]

@query(_sql([(i, x, s) for i, _, _, x, s in _GOLD_GUARD], "id, unsupported, supported"))
def narrative_guard(spark, d):
    df = _values(spark, [r[:3] for r in _GOLD_GUARD], "id int, draft string, source string").withColumns(
        {"names": guards.entities("draft"), "plain": guards.plain(c("source")), "even": guards.even(c("source"))}
    )
    claims = F.concat(guards.unsupported_names(c("names"), c("even")), guards.unsupported_numbers(c("draft"), c("source")))
    return df.select("id", F.array_join(claims, "|").alias("unsupported"), guards.supports(F.lit("corp acme"), c("plain")).alias("supported"))


_LABELS = [
    "Company name", "Email address", "PassportNo", "NRICNumber", "idNumber", "studentId", "Mobile phone", "Name", "University", "GPA", "Why do you want to join", "Project title",
    "Technical skills", "Job title", "Date of birth", "Driver's licence", "Tax ID", "Full name", "Company logo", "Employment start", "",
]

def _class_sql() -> str:
    esc = lambda p: p.replace("'", "''")
    case = " ".join(f"WHEN regexp_matches(t, '{esc(p)}') THEN '{cat}/' || {repr(key) if key else repr('-')}" for cat, _, key, p in forms.RULES)
    sens = " ".join(f"WHEN regexp_matches(t, '{esc(p)}') THEN '{kind}'" for kind, p in forms.SENSITIVE)
    rows = ", ".join(f"({i}, '{esc(x)}')" for i, x in enumerate(_LABELS))
    norm = r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '[_\-.\[\]()/|,;:]+', ' ', 'g'), '\s+', ' ', 'g')))"
    return (
        f"WITH l(idx, label) AS (VALUES {rows}), n AS (SELECT idx, label, {norm} AS t FROM l) SELECT idx, label, CASE WHEN t = '' THEN 'unknown/-' {case} "
        f"WHEN regexp_matches(t, '{forms.NAME}') AND NOT regexp_matches(t, '{forms.NOT_A_PERSON}') THEN 'personal/full_name' ELSE 'unknown/-' END AS class, "
        f"CASE WHEN regexp_matches(t, '{forms.SAFE_ID}') THEN '' {sens} ELSE '' END AS sensitive_kind FROM n"
    )


@query(_class_sql())
def classify_controls(spark, d):
    df = _values(spark, list(enumerate(_LABELS)), "idx int, label string")
    nul = F.lit("")
    text = forms.labelish(c("label"), nul, nul, nul, nul, nul)
    k = forms.classify(text, nul)
    return df.select("idx", "label", F.concat_ws("/", k["category"], F.coalesce(k["fact_key"], F.lit("-"))).alias("class"), F.coalesce(forms.sensitive_kind(text), nul).alias("sensitive_kind"))


_GOLD_OPTION = [
    ("Master of Science", ["BSc", "MSc", "PhD"], "MSc"), ("m.sc", ["MSc", "M.Sc"], "M.Sc"), ("yes", ["No", " YES "], " YES "), ("MBA", ["MSc"], None), ("x", [], "x"), ("", ["a"], None), (None, ["a"], None),
]

@query(_sql([(v, "|".join(o), g) for v, o, g in _GOLD_OPTION], "value, options, chosen"))
def match_options(spark, d):
    df = _values(spark, [(v, o) for v, o, _ in _GOLD_OPTION], "value string, options array<string>")
    return df.select("value", _joined("options").alias("options"), forms.match_option(c("value"), c("options")).alias("chosen"))


_GOLD_FIT = [("Zhang Wei", 3, None, True), ("Python, PyTorch", 12, "Python", True), ("Python, PyTorch", 7, "Python", True), ("short", 10, "short", False), ("any", 0, "any", False), ("ab cdef", 4, None, True), (None, 5, None, False)]

@query(_sql(_GOLD_FIT, "value, most, fitted, trimmed"))
def fit_lengths(spark, d):
    df = _values(spark, [r[:2] for r in _GOLD_FIT], "value string, most int")
    f = forms.fit_to_length(c("value"), c("most"))
    return df.select("value", "most", f["value"].alias("fitted"), f["trimmed"].alias("trimmed"))


_FIELD_COLS = (
    "page_id bigint, idx int, field_id string, label string, tag string, type string, required boolean, max_length int, options array<string>, current_value string, already_filled boolean, "
    "fillable boolean, skip_reason string, category string, module string, fact_key string, sensitive boolean, sensitive_kind string, condition string, proposed string, model_confidence double, "
    "fact_value string, fact_confidence double, retrieval double, source_text string, unsupported array<string>, overwrite boolean"
)

def _field(i, category, sensitive=False, filled=False, fillable=True, options=(), most=None, proposed=None, mc=None, fact=None, fc=None, r=0.8, bad=(), cond="C", source="Ada Example, Master of Science, Acme Corp"):
    return (1, i, f"f{i}", f"l{i}", "input", "text", False, most, list(options), "", filled, fillable, "", category, None, None, sensitive, None, cond, proposed, mc, fact, fc, r, source, list(bad), False)


_DECIDE = [
    (_field(0, "personal", sensitive=True, fact="X1", fc=0.9), None, "sensitive_skipped", 0.0, True, "sensitive"),
    (_field(1, "personal", filled=True, fact="Ada", fc=0.9), None, "already_filled", 0.9, True, "already_filled"),
    (_field(2, "personal", proposed="Ada Example", mc=0.9, fact="Ada Example", fc=0.85), "Ada Example", "offered", 0.87, False, "draft"),
    (_field(3, "education", proposed="Master of Science", mc=0.9, options=["BSc", "MSc"], fact="Master of Science", fc=0.8), "MSc", "offered", 0.84, False, "draft"),
    (_field(4, "education", proposed="Diploma", mc=0.9, options=["BSc", "MSc"], fact=None), None, "missing", 0.9, True, "option_mismatch"),
    (_field(5, "narrative", proposed="I was at Beta Labs", mc=0.9, bad=["Beta Labs"]), None, "missing", 0.84, True, "unsupported"),
    (_field(6, "narrative", proposed="I was at Acme Corp", mc=0.9), "I was at Acme Corp", "offered", 0.84, True, "draft"),
    (_field(7, "experience_fact", proposed="Beta Labs", mc=0.9, fact="Acme Corp", fc=0.7), "Acme Corp", "offered", 0.78, True, "fact_for_draft"),
    (_field(8, "personal"), None, "missing", 0.0, True, "nothing"),
    (_field(9, "skills", fact="Python", fc=0.6, r=0.1, mc=0.9), None, "abstained", 0.42, True, "withheld"),
    (_field(10, "personal", fact="Ada Example", fc=0.85, most=2), None, "missing", 0.85, True, "too_long"),
    (_field(11, "personal", fact="Ada Example", fc=0.85, most=5, cond="A"), "Ada", "offered", 0.85, True, "shortened"),
    (_field(12, "personal", fillable=False, fact="Ada", fc=0.9), None, "not_fillable", 0.9, True, "fact"),
]

@query(_sql([(r[1], v, dec, conf, need, kind) for r, v, dec, conf, need, kind in _DECIDE], "idx, suggested_value, decision, confidence, needs_confirmation, message_kind"))
def decide_fields(spark, d):
    out = forms.decide(_values(spark, [r[0] for r in _DECIDE], _FIELD_COLS))
    value = F.when(c("decision") == "offered", c("suggested_value"))
    return out.select("idx", value.alias("suggested_value"), "decision", "confidence", "needs_confirmation", "message_kind")


_RENDERED = [
    ("p1", "PERSONAL INFORMATION\nFull name: Ada Example\nEmail: ada@example.org\n\nEDUCATION\n- Master of Science in Data Science, Example University, 2024 - 2026, GPA 4.5", "personal_info|education", "internship", ""),
    ("p2", "INTERNSHIP AND WORK EXPERIENCE\n- Intern at Acme Corp (May)\n  Did things\n  Team Size: 4", "internship", "personal_info", "projects"),
]

@query(_sql(_RENDERED, "profile_id, text, used, dropped, empty"))
def render_profiles(spark, d):
    df = profiles.render_profile(_values(spark, _PROFILES, _PROFILE_SCHEMA))
    return df.select("profile_id", "text", *[_joined(x).alias(x) for x in ("used", "dropped", "empty")])


@query(_sql([("full_name", "Ada Example", 0.85), ("email", "ada@example.org", 0.95), ("education_degree", "Master of Science", 0.8), ("education_major", "Data Science", 0.8),
             ("education_school", "Example University", 0.7), ("graduation_year", "2026", 0.55)], "key, value, confidence"))
def profile_facts(spark, d):
    rendered = profiles.render_profile(_values(spark, _PROFILES[:1], _PROFILE_SCHEMA))
    return profiles.extract_facts(rendered).select("key", "value", "confidence")


@query("SELECT 0 AS violations, 20 AS cases")
def generated_cases(spark, d):
    cases = generator.build_cases(spark, ["AI", "Data", "Product", "Software"], 5)
    bad = generator.contract_violations(cases).agg(F.count("*").cast("int").alias("violations"))
    return bad.crossJoin(cases.agg(F.count("*").cast("int").alias("cases")))


_LONG = "<html><head><title>Data <b>role</b></title></head><body><p>" + "We use Python. " * 20 + "</p></body></html>"

_FETCHED = [
    ("https://a.org/1", 200, "text/html", _LONG, ["93.184.216.34"], 0, True, "ok"), ("ftp://a.org/2", 200, "text/html", _LONG, ["93.184.216.34"], 0, True, "unsupported_scheme"),
    ("https://a.org/3", 200, "text/html", _LONG, ["10.0.0.1"], 0, True, "private_host"), ("https://a.org/4", 200, "text/html", _LONG, ["93.184.216.34"], 9, True, "http_error"),
    ("https://a.org/5", 404, "text/html", _LONG, ["93.184.216.34"], 0, True, "http_error"), ("https://a.org/6", 200, "image/png", "x", ["93.184.216.34"], 0, True, "not_html"),
    ("https://a.org/7", 200, "text/html", "<p>Sign in to continue</p>", ["93.184.216.34"], 0, True, "login_required"), ("https://a.org/8", 200, "text/html", _LONG, ["93.184.216.34"], 0, False, "robots_disallowed"),
    ("https://a.org/9", 200, "text/html", "<p> </p>", ["93.184.216.34"], 0, True, "not_html"),
    ("https://a.org/10", 402, "text/html", _LONG, ["93.184.216.34"], 0, True, "paywall"),
]

@query(_sql([(r[0], r[-1]) for r in _FETCHED], "url, reason"))
def judge_fetched_pages(spark, d):
    rows = [(u, s, t, b.encode(), ips, n, rob, None) for u, s, t, b, ips, n, rob, _ in _FETCHED]
    df = _values(spark, rows, "url string, status int, content_type string, body binary, resolved_ips array<string>, redirects int, robots_allowed boolean, failure string")
    return fetched.judge_responses(df).select("url", "reason")


_PDF = b"%PDF-1.4\n1 0 obj << /Type /Page >>\nstream\nBT (Ada Example, Data \\(Science\\)) Tj (writes Python and SQL) Tj ET\nendstream\n%%EOF"

@query(_sql([("a.pdf", "Ada Example, Data (Science) writes Python and SQL", True), ("b.pdf", "", False)], "path, text, ok"))
def pdf_text(spark, d):
    return pdf.read_pdf(_values(spark, [("a.pdf", _PDF), ("b.pdf", b"not one")], "path string, content binary")).select("path", "text", "ok")


_MESSAGES = [("Withheld rather than guessed: x", "abstained"), ("readonly control - and SHORTENED to fit", "trimmed|not_fillable"), ("fine", ""), (None, "")]

@query(_sql(_MESSAGES, "message, kinds"))
def message_kinds(spark, d):
    return _values(spark, [(m,) for m, _ in _MESSAGES], "message string").select("message", F.array_join(texts.message_kinds(c("message")), "|").alias("kinds"))


_KEYS = [("passport_no", True), ("student_id", False), ("NRIC", True), ("id-number", True), ("email", False), ("taxId", True), ("candidate reference no", False)]

@query(_sql(_KEYS, "name, forbidden"))
def forbidden_keys(spark, d):
    return _values(spark, [(k,) for k, _ in _KEYS], "name string").select("name", audit.key_forbidden(c("name")).alias("forbidden"))



@pytest.mark.parametrize("name", sorted(GOLDEN))
def test_golden(spark, name):
    f, sql = GOLDEN[name]
    got, want = f(spark, None).toPandas(), duckdb.sql(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = rows(got), rows(want)
    assert len(a) == len(b) and all(map(close, a, b)), [(x, y) for x, y in zip(a, b) if not close(x, y)]


def test_cases_written_and_read(spark, tmp_path):
    from sievewright.sources import files

    cases = generator.build_cases(spark, ["AI", "Data"], 4)
    files.write_cases(cases, str(tmp_path / "cases"))
    back = files.read_case_lines(spark, str(tmp_path / "cases"))
    same = lambda df: sorted(map(str, df.select("case_id", "jd_text", "resume_text", "required_skills", "candidate_skills").collect()))
    assert same(back) == same(cases)
    files.write_truth(generator.ground_truth(cases), str(tmp_path / "truth"))
    truth = {r.case_id: r for r in files.read_ground_truth(spark, str(tmp_path / "truth")).collect()}
    for r in cases.collect():
        pool = set(r.required_skills) & set(r.candidate_skills)
        t = truth[r.case_id]
        assert t.hard_case == (len(pool) / len(r.required_skills) < 0.5) == t.should_abstain and t.expected_top_skills_n == min(3, len(pool))
        assert (t.expected_full_name, t.expected_email) == (f"Candidate {r.case_id} Example", None)
    files.write_samples(cases, str(tmp_path / "samples"), 2)
    got = files.read_written_samples(spark, str(tmp_path / "samples"))
    assert sorted((r.case_id, r.jd_text, r.resume_text) for r in got.collect()) == sorted((r.case_id, r.jd_text, r.resume_text) for r in cases.collect())[:2]
