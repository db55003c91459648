"""Registered queries of single functions, over inputs that are made from every row of the tables. The SQL works the answers out again.

Inputs are put together from the rows' own texts and numbers and from short lists, by turns of the id, the same in both engines.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sievewright.functions import fields, forms, guards, records, skills
from sievewright.functions import text as texts
from sievewright.operators import assistant, audit, generator, matching, prefill, profiles
from sievewright.plans import catalogue
from sievewright.plans.registry import query
from sievewright.session import spread, table
from sievewright.sources import fetched, pages, pdf

c = F.col


def _list(xs: list[str]) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''").replace("\n", "' || chr(10) || '") + "'" for x in xs) + "]"


def _turn(xs: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, xs)), (F.pmod(n, F.lit(len(xs))) + 1).cast("int"))


def _turn_sql(xs: list[str], n: str) -> str:
    return f"{_list(xs)}[({n}) % {len(xs)} + 1]"


def _id() -> Column:
    return c("doc_id")

# --- skills -------------------------------------------------------------------

_CLAIMS = ["sklearn", "  Rust  ", "natural language processing (NLP)", "net", "JS", "Machine Learning and Deep Learning", "GOLANG", "r and d team", "TensorFlow", " ", "CI/CD pipelines", "the", "of", "R programming"]
_NAMED_SQL = (f"CASE doc_id % 3 WHEN 0 THEN {_turn_sql(_CLAIMS, 'doc_id // 3')} WHEN 1 THEN upper({_turn_sql(catalogue.PLANT, 'doc_id // 3')}) "
              f"ELSE {_turn_sql(catalogue.PLANT, 'doc_id // 3')} || ' and ' || {_turn_sql(catalogue.PLANT, 'doc_id * 7 + 1')} END")
_EXACT = ", ".join("('" + a.replace("'", "''") + "', '" + k + "')" for a, k in skills._exact().items())
_CANON = f"""{catalogue._LEX}, ex(alias, canon) AS (VALUES {_EXACT}), u AS (SELECT DISTINCT value FROM v),
m AS (SELECT value, count(DISTINCT canon) AS n, min(canon) AS one FROM u JOIN (SELECT * FROM pat WHERE p NOT LIKE '%/-])c#($%') ON regexp_matches(value, p) GROUP BY 1),
k AS (SELECT u.value, coalesce(ex.canon, CASE WHEN m.n = 1 THEN m.one END, trim(u.value)) AS canonical, trim(regexp_replace(lower(u.value), '[^a-z0-9+#]+', ' ', 'g')) AS norm
  FROM u LEFT JOIN ex ON ex.alias = trim(regexp_replace(lower(u.value), '[^a-z0-9+#]+', ' ', 'g')) LEFT JOIN m ON m.value = u.value)"""


def _named() -> Column:
    third = F.floor(_id() / 3)
    kind = _id() % 3
    return (F.when(kind == 0, _turn(_CLAIMS, third)).when(kind == 1, F.upper(_turn(catalogue.PLANT, third)))
            .otherwise(F.concat(_turn(catalogue.PLANT, third), F.lit(" and "), _turn(catalogue.PLANT, _id() * 7 + 1))))


@query(f"WITH v AS (SELECT doc_id, {_NAMED_SQL} AS value FROM documents), {_CANON} SELECT doc_id, v.value, canonical FROM v JOIN k USING (value)")
def canonical_names(spark, d):
    return table(spark, d, "documents").select("doc_id", _named().alias("value")).select("doc_id", "value", skills.canonicalise(c("value")).alias("canonical"))


@query(f"""WITH {catalogue._DOCS}, v AS (SELECT doc_id, {_NAMED_SQL} AS value, trim(regexp_replace(lower(text), '[^a-z0-9+#]+', ' ', 'g')) AS hay FROM pd), {_CANON}, {catalogue._DS}
SELECT v.doc_id, v.value AS claim, trim(v.value) <> '' AND (ds.canon IS NOT NULL OR (k.norm <> '' AND regexp_matches(v.hay, '(^|[^a-z0-9])' || regexp_escape(k.norm) || '($|[^a-z0-9])'))) AS supported
FROM v JOIN k USING (value) LEFT JOIN ds ON ds.doc_id = v.doc_id AND ds.canon = k.canonical""")
def lexical_support(spark, d):
    """A claim about each document, against its whole text."""
    df = catalogue.planted_documents(spark, d).select("doc_id", _named().alias("claim"), "text", skills.match_skills(c("text")).alias("s"))
    return df.select("doc_id", "claim", skills.has_lexical_support(c("claim"), c("text"), c("s")).alias("supported"))


# --- fields of a person's document ----------------------------------------------

_NAMES, _SCHOOLS = ["Ada Example", "Bob Sample", "Cleo van Test", "Dan O. Trial"], ["Nanyang Technological University", "Example College", "North Polytechnic"]
_DEGREES, _MAJORS = ["Master of Science", "BSc", "Bachelor of Engineering", "PhD"], ["Data Science", "Statistics", "Computer Science"]


def _resume(n: Column, say, join) -> Column:
    """The head of a document; ``say`` gives an element of a list by turns, ``join`` a text of parts."""
    name, degree, major = say(_NAMES, n, 1), say(_DEGREES, n, 3), say(_MAJORS, n, 5)
    return [
        join("Full Name: ", name, " | x\n", n, "@example.org\n+65 9123 4567\n", say(_SCHOOLS, n, 7), " - ", degree, " in ", major, ", 2026"),
        join(name, "\n", degree, " in ", major, ", class of 2019 to 2023"), join("- plain text with nothing"), join("Username: zed", n, "\nGit"),
    ]


def _head() -> Column:
    join = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in p])
    parts = _resume(_id(), lambda xs, n, k: _turn(xs, F.floor(n / k)), join)
    return F.when(_id() % 4 == 0, parts[0]).when(_id() % 4 == 1, parts[1]).when(_id() % 4 == 2, parts[2]).otherwise(parts[3])


def _head_sql() -> str:
    class Raw(str):
        pass

    join = lambda *p: " || ".join(x if isinstance(x, Raw) else "'" + x.replace("\n", "' || chr(10) || '") + "'" for x in p)
    parts = _resume(Raw("doc_id"), lambda xs, n, k: Raw(_turn_sql(xs, f"{n} // {k}")), join)
    return "CASE doc_id % 4 " + " ".join(f"WHEN {i} THEN {p}" for i, p in enumerate(parts)) + " END"


_RX = {k: p.replace("'", "''") for k, p in (("email", fields.EMAIL), ("phone", fields.PHONE), ("school", fields.SCHOOL), ("degree", fields.DEGREE), ("major", fields.MAJOR), ("year", fields.YEAR))}
_READ = ", ".join([*[f"nullif(trim(regexp_extract(text, '{_RX[k]}')), '') AS {k}" for k in ("email", "phone")], *[f"nullif(trim(regexp_extract(text, '{_RX[k]}', 1)), '') AS {k}" for k in ("school", "degree", "major")],
                   f"list_max(regexp_extract_all(text, '{_RX['year']}', 1)) AS year"])


@query(f"""WITH {catalogue._DOCS}, r AS (SELECT doc_id, ({_head_sql()}) || chr(10) || text AS text FROM pd),
l AS (SELECT doc_id, unnest(regexp_split_to_array(text, '\\r\\n|\\n|\\r')) AS line, generate_subscripts(regexp_split_to_array(text, '\\r\\n|\\n|\\r'), 1) AS k FROM r),
t AS (SELECT doc_id, k, j, trim(substr(line, instr(lower(line), lab || ':') + length(lab) + 1), ' |-' || chr(9)) AS v FROM l, (VALUES (1, 'full name'), (2, 'name'), (3, 'candidate')) n(j, lab) WHERE instr(lower(line), lab || ':') > 0),
named AS (SELECT doc_id, arg_min(v, k * 10 + j) AS v FROM t WHERE v <> '' GROUP BY 1),
h AS (SELECT doc_id, arg_min(trim(line, ' -*' || chr(9)), k) AS head FROM l WHERE trim(line, ' -*' || chr(9)) <> '' GROUP BY 1),
w AS (SELECT doc_id, head, list_filter(regexp_split_to_array(head, '\\s+'), lambda x : x <> '') AS ws FROM h),
g AS (SELECT doc_id, CASE WHEN len(ws) BETWEEN 2 AND 4 AND NOT regexp_matches(head, '\\d') AND list_bool_and(list_transform(ws, lambda x : NOT regexp_matches(x, '^\\p{{L}}') OR regexp_matches(x, '^\\p{{Lu}}'))) THEN head END AS head FROM w),
{catalogue._LEX}, ps AS (SELECT doc_id, count(DISTINCT canon) AS n FROM r JOIN pat ON regexp_matches(text, p) GROUP BY 1)
SELECT r.doc_id, coalesce(named.v, g.head) AS full_name, {_READ}, CASE WHEN coalesce(named.v, g.head) IS NULL THEN 0.0 ELSE 0.85 END::DOUBLE AS conf_name,
 CASE WHEN coalesce(ps.n, 0) >= 3 THEN 0.6 WHEN ps.n > 0 THEN 0.35 ELSE 0.0 END::DOUBLE AS conf_skills FROM r LEFT JOIN named USING (doc_id) LEFT JOIN g USING (doc_id) LEFT JOIN ps USING (doc_id)""")
def extract_resume_fields(spark, d):
    """The fields of documents that begin like a person's, in four ways; what the head lacks may stand anywhere in the text."""
    df = catalogue.planted_documents(spark, d).select("doc_id", F.concat(_head(), F.lit("\n"), c("text")).alias("text"))
    got = matching.extract(df, "doc_id", "text")
    return got.select("doc_id", "full_name", "email", "phone", c("education_school").alias("school"), c("education_degree").alias("degree"), c("education_major").alias("major"),
                      c("graduation_year").alias("year"), c("conf_full_name").alias("conf_name"), c("conf_top_skills").alias("conf_skills"))


_PEOPLE_SQL = f"""p AS (SELECT doc_id, {_turn_sql(_NAMES, 'doc_id')} AS name, doc_id || '@example.org' AS mail, {_turn_sql(_DEGREES, 'doc_id // 3')} AS degree, {_turn_sql(_MAJORS, 'doc_id // 5')} AS major,
 {_turn_sql(_SCHOOLS, 'doc_id // 7')} AS school, (2015 + doc_id % 12)::VARCHAR AS year, source FROM documents),
t AS (SELECT *, 'PERSONAL INFORMATION' || chr(10) || 'Full name: ' || name || chr(10) || 'Email: ' || mail AS me,
 'EDUCATION' || chr(10) || '- ' || degree || ' in ' || major || ', ' || school || ', 2014 - ' || year || ', GPA 4.5' AS study,
 'INTERNSHIP AND WORK EXPERIENCE' || chr(10) || '- Intern at ' || source || ' Corp (May)' || chr(10) || '  Did things' || chr(10) || '  Team Size: ' || doc_id % 9 AS job FROM p),
r AS (SELECT doc_id, me || chr(10) || chr(10) || CASE doc_id % 3 WHEN 0 THEN study WHEN 1 THEN job ELSE study || chr(10) || chr(10) || job END AS text, name, doc_id % 3 AS k FROM t)"""


def _people(spark, d):
    n = _id()
    entry = lambda **kv: F.create_map(*[x for k, v in kv.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))])
    ours = F.when(n % 3 == 0, F.array(F.lit("personal_info"), F.lit("education"))).when(n % 3 == 1, F.array(F.lit("personal_info"), F.lit("internship"))).otherwise(F.array(*map(F.lit, profiles.MODULES)))
    study = entry(degree=_turn(_DEGREES, F.floor(n / 3)), major=_turn(_MAJORS, F.floor(n / 5)), school=_turn(_SCHOOLS, F.floor(n / 7)), start="2014", end=(2015 + n % 12).cast("string"), gpa="4.5")
    job = entry(title="Intern", company=F.concat("source", F.lit(" Corp")), start="May", summary="Did things", team_size=(n % 9).cast("string"))
    return table(spark, d, "documents").select(
        n.alias("profile_id"), ours.alias("authorised_modules"), entry(full_name=_turn(_NAMES, n), email=F.concat(n, F.lit("@example.org")), github="").alias("personal_info"),
        F.array(study).alias("education"), F.array(job).alias("internship"), F.array().cast("array<map<string,string>>").alias("projects"),
    )


@query(f"""WITH {_PEOPLE_SQL} SELECT doc_id AS profile_id, text, CASE k WHEN 0 THEN 'personal_info|education' WHEN 1 THEN 'personal_info|internship' ELSE 'personal_info|education|internship' END AS used,
 CASE k WHEN 0 THEN 'internship' WHEN 1 THEN 'education' ELSE '' END AS dropped, CASE k WHEN 2 THEN 'projects' ELSE '' END AS empty FROM r""")
def render_profiles(spark, d):
    """A profile for each document, in the words of its authorised modules."""
    df = profiles.render_profile(_people(spark, d))
    return df.select("profile_id", "text", *[F.array_join(x, "|").alias(x) for x in ("used", "dropped", "empty")])


@query(f"""WITH {_PEOPLE_SQL}, f AS (SELECT doc_id, name, {_READ} FROM r), g AS (SELECT doc_id, unnest([('full_name', name, 0.85), ('email', email, 0.95), ('phone', phone, 0.75), ('education_school', school, 0.7),
 ('education_degree', degree, 0.8), ('education_major', major, 0.8), ('graduation_year', year, 0.55)]) AS x FROM f)
SELECT doc_id AS profile_id, x[1] AS key, x[2] AS value, x[3]::DOUBLE AS confidence FROM g WHERE x[2] IS NOT NULL""")
def profile_facts(spark, d):
    return profiles.extract_facts(profiles.render_profile(_people(spark, d))).select("profile_id", "key", "value", "confidence")


# --- labels, answers, messages, keys ----------------------------------------------

_SEPARATORS = ["_", "-", ".", "No ", ", ", " (x) "]
_PLAIN_LABEL = (r"lower(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(label, '([a-z0-9])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), "
                r"'[_\-.\[\]()/|,;:]+', ' ', 'g'), '\s+', ' ', 'g')))")


@query(f"""WITH l AS (SELECT doc_id, replace(array_to_string(regexp_extract_all(text, '[A-Za-z]+')[1:4], chr(1)), chr(1), {_turn_sql(_SEPARATORS, 'doc_id')}) || ' NRICNumber' AS label FROM documents) SELECT doc_id, label, {_PLAIN_LABEL} AS words FROM l""")
def normalised_labels(spark, d):
    """Labels made of a document's first words."""
    words = F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), 1, 4)
    joined = F.array_join(words, "\x00")
    label = F.concat(F.replace(joined, F.lit("\x00"), _turn(_SEPARATORS, _id())), F.lit(" NRICNumber"))
    return table(spark, d, "documents").select("doc_id", label.alias("label")).select("doc_id", "label", texts.normalise_label(c("label")).alias("words"))


@query("""SELECT event_id, CASE WHEN event_id % 7 < 4 THEN json_extract_string(props, '$.k') WHEN event_id % 7 = 4 THEN event_type END AS found FROM events""")
def extract_json_objects(spark, d):
    """Answers of a model around the props of events: fenced, in prose, with a comma too many, nested, lists, no JSON at all."""
    p, k = c("props"), c("event_id") % 7
    answer = (
        F.when(k == 0, p).when(k == 1, F.concat(F.lit("```json\n"), p, F.lit("\n```"))).when(k == 2, F.concat(F.lit("Here it is: "), p, F.lit(" as asked")))
        .when(k == 3, F.concat(F.regexp_replace(p, r"\}$", ",}"))).when(k == 4, F.concat(F.lit('{"k": "'), c("event_type"), F.lit('", "more": [{"k": 1},]}'))).when(k == 5, F.concat(F.lit("["), p, F.lit("]")))
    )
    df = table(spark, d, "events").select("event_id", F.when(k == 6, F.lit("none")).otherwise(answer).alias("answer"))
    return df.select("event_id", F.when(c("event_id") % 7 != 5, F.try_variant_get(texts.extract_json(c("answer")), "$.k", "string")).alias("found"))


_SIGNS = [s for s, _ in texts.MESSAGE_KINDS]
_KINDS = ", ".join(f"CASE WHEN contains(m, '{s.replace(chr(39), chr(39) * 2)}') THEN '{k}' END" for s, k in texts.MESSAGE_KINDS)


@query(f"""WITH m AS (SELECT doc_id, lower(CASE WHEN doc_id % 5 = 0 THEN text ELSE upper({_turn_sql(_SIGNS, 'doc_id')}) || ': ' || text || ' ' || {_turn_sql(_SIGNS, 'doc_id * 7 + 3')} END) AS m FROM documents)
SELECT doc_id, array_to_string(list_filter([{_KINDS}], lambda x : x IS NOT NULL), '|') AS kinds FROM m""")
def message_kinds(spark, d):
    """Messages of two signs with a document's text between them."""
    t = F.when(_id() % 5 == 0, c("text")).otherwise(F.concat(F.upper(_turn(_SIGNS, _id())), F.lit(": "), c("text"), F.lit(" "), _turn(_SIGNS, _id() * 7 + 3)))
    return table(spark, d, "documents").select("doc_id", F.array_join(texts.message_kinds(t), "|").alias("kinds"))


_STEMS = ["passport", "national-id", "NRIC", "student.id", "id_number", "tax id", "licence_no", "reference number", "email", "social_security", "candidateNo", "mykad"]
_STEM_SQL = f"regexp_extract(text, '[A-Za-z]+') || {_turn_sql(['_', ' ', '.', '-'], 'doc_id // 3')} || {_turn_sql(_STEMS, 'doc_id')}"


@query(f"""WITH k AS (SELECT doc_id, {_STEM_SQL} AS name FROM documents), f AS (SELECT *, trim(regexp_replace(name, '[_\\-.]+', ' ', 'g')) AS flat FROM k)
SELECT doc_id, name, NOT regexp_matches(flat, '(?i){records.SAFE}') AND regexp_matches(flat, '(?i){records.FORBIDDEN}') AS forbidden FROM f""")
def forbidden_keys(spark, d):
    name = F.concat(F.regexp_extract("text", "[A-Za-z]+", 0), _turn(["_", " ", ".", "-"], F.floor(_id() / 3)), _turn(_STEMS, _id()))
    return table(spark, d, "documents").select("doc_id", name.alias("name")).select("doc_id", "name", audit.key_forbidden(c("name")).alias("forbidden"))


# --- guards ---------------------------------------------------------------------

_FIRMS = ["Acme Corp", "Beta Labs", "Gamma Works"]


@query(f"""WITH f AS (SELECT doc_id, {_turn_sql(_FIRMS, 'doc_id')} AS firm, (10 + doc_id % 90)::VARCHAR AS share, text FROM documents),
s AS (SELECT *, text || CASE WHEN doc_id % 2 = 0 THEN ' ' || upper(firm) || ' intern' ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN ' grew sales ' || share || '%' ELSE '' END AS src FROM f),
p AS (SELECT *, regexp_matches(lower(src), '(^|[^a-z0-9])' || replace(lower(firm), ' ', '[^a-z0-9]+') || '($|[^a-z0-9])') AS has_firm, trim(regexp_replace(regexp_replace(lower(src), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS hay FROM s)
SELECT doc_id, concat_ws('|', CASE WHEN NOT has_firm THEN firm END, CASE WHEN NOT contains(src, share) THEN share END) AS unsupported,
 list_bool_and(list_transform(string_split(lower(firm), ' '), lambda w : regexp_matches(hay, '(^|[^a-z0-9])' || w || '($|[^a-z0-9])'))) AS supported FROM p""")
def narrative_guard(spark, d):
    """A draft about each document's person, against the whole text."""
    firm, share = _turn(_FIRMS, _id()), (10 + _id() % 90).cast("string")
    src = F.concat("text", F.when(_id() % 2 == 0, F.concat(F.lit(" "), F.upper(firm), F.lit(" intern"))).otherwise(""), F.when(_id() % 3 == 0, F.concat(F.lit(" grew sales "), share, F.lit("%"))).otherwise(""))
    df = table(spark, d, "documents").select("doc_id", firm.alias("firm"), F.concat(F.lit("I led dashboards at "), firm, F.lit(". My team grew "), share, F.lit("%")).alias("draft"), src.alias("src"))
    df = df.withColumns({"names": guards.entities("draft"), "plain": guards.plain(c("src")), "even": guards.even(c("src"))})
    claims = F.concat(guards.unsupported_names(c("names"), c("even")), guards.unsupported_numbers(c("draft"), c("src")))
    backwards = F.array_join(F.reverse(F.split("firm", " ")), " ")
    return df.select("doc_id", F.array_join(claims, "|").alias("unsupported"), guards.supports(backwards, c("plain")).alias("supported"))


# --- forms ----------------------------------------------------------------------

_LABELS = [
    "Company name", "Email address", "PassportNo", "NRICNumber", "idNumber", "studentId", "Mobile phone", "Name", "University", "GPA", "Why do you want to join", "Project title",
    "Technical skills", "Job title", "Date of birth", "Driver's licence", "Tax ID", "Full name", "Company logo", "Employment start", "",
]
_ENDS = ["", " *", " (optional)", "_details", " of your school"]


def _class_sql() -> str:
    esc = lambda p: p.replace("'", "''")
    case = " ".join(f"WHEN regexp_matches(t, '{esc(p)}') THEN '{cat}/' || {repr(key) if key else repr('-')}" for cat, _, key, p in forms.RULES)
    sens = " ".join(f"WHEN regexp_matches(t, '{esc(p)}') THEN '{kind}'" for kind, p in forms.SENSITIVE)
    return (
        f"WITH l AS (SELECT page_id, {_turn_sql(_LABELS, 'page_id')} || {_turn_sql(_ENDS, 'page_id // 21')} AS label FROM pages), n AS (SELECT page_id, label, {_PLAIN_LABEL} AS t FROM l) "
        f"SELECT page_id, label, CASE WHEN t = '' THEN 'unknown/-' {case} WHEN regexp_matches(t, '{forms.NAME}') AND NOT regexp_matches(t, '{forms.NOT_A_PERSON}') THEN 'personal/full_name' ELSE 'unknown/-' END AS class, "
        f"CASE WHEN regexp_matches(t, '{forms.SAFE_ID}') THEN '' {sens} ELSE '' END AS sensitive_kind FROM n"
    )


@query(_class_sql())
def classify_controls(spark, d):
    """A control of each page, judged by its label."""
    n, nul = c("page_id"), F.lit("")
    df = table(spark, d, "pages").select("page_id", F.concat(_turn(_LABELS, n), _turn(_ENDS, F.floor(n / 21))).alias("label"))
    text = forms.labelish(c("label"), nul, nul, nul, nul, nul)
    k = forms.classify(text, nul)
    return df.select("page_id", "label", F.concat_ws("/", k["category"], F.coalesce(k["fact_key"], F.lit("-"))).alias("class"), F.coalesce(forms.sensitive_kind(text), nul).alias("sensitive_kind"))


_VALUES = ["Master of Science", "m.sc", "yes", "MBA", "x", "", "Bachelor", " bsc ", "PHD", "b eng", "Diploma!"]
_OPTIONS = [["BSc", "MSc", "PhD"], ["MSc", "M.Sc"], ["No", " YES ", "X"], ["diploma", "Bachelor of Arts"], []]
_GROUP = lambda t: "CASE " + " ".join(
    f"WHEN regexp_matches(trim(regexp_replace(lower({t}), '[^a-z0-9]+', ' ', 'g')), '^({'|'.join(sorted(g, key=len, reverse=True))})( |$)') THEN {i}" for i, g in enumerate(forms.QUALIFICATIONS)) + " END"
_SQUEEZE = lambda t: f"regexp_replace(trim(lower({t})), '\\s+', ' ', 'g')"
_BARE = lambda t: f"regexp_replace(lower({t}), '[^a-z0-9 ]+', '', 'g')"


@query(f"""WITH v AS (SELECT doc_id, {_turn_sql(_VALUES, 'doc_id')} AS value, [{', '.join(_list(o) + '::VARCHAR[]' for o in _OPTIONS)}][doc_id // 11 % {len(_OPTIONS)} + 1] AS options FROM documents),
o AS (SELECT doc_id, value, unnest(options) AS o, generate_subscripts(options, 1) AS k, {_SQUEEZE('value')} AS w FROM v),
f AS (SELECT doc_id, arg_min(o, k + CASE WHEN {_SQUEEZE('o')} = w THEN 0 WHEN {_BARE('o')} = {_BARE('w')} THEN 100 ELSE 200 END) AS o FROM o
 WHERE w <> '' AND ({_SQUEEZE('o')} = w OR {_BARE('o')} = {_BARE('w')} OR ({_GROUP('o')}) = ({_GROUP('w')})) GROUP BY 1)
SELECT doc_id, value, array_to_string(options, '|') AS options, CASE WHEN len(options) = 0 THEN value ELSE f.o END AS chosen FROM v LEFT JOIN f USING (doc_id)""")
def match_options(spark, d):
    sets = F.array(*[F.array(*map(F.lit, o)).cast("array<string>") for o in _OPTIONS])
    df = table(spark, d, "documents").select("doc_id", _turn(_VALUES, _id()).alias("value"), F.element_at(sets, (F.floor(_id() / 11) % len(_OPTIONS) + 1).cast("int")).alias("options"))
    return df.select("doc_id", "value", F.array_join("options", "|").alias("options"), forms.match_option(c("value"), c("options")).alias("chosen"))


def _fit_sql(source: str, v: str, most: str) -> str:
    """CTEs that add ``fitted`` and ``trimmed`` to ``source`` as ``fit``."""
    return f"""fh AS (SELECT *, rtrim(substr({v}, 1, {most})) AS fhead FROM {source}),
fw AS (SELECT *, CASE WHEN fhead <> '' AND regexp_matches(substr({v}, length(fhead) + 1, 1), '^[ \\t\\n,;:\\-–—/|]') THEN fhead WHEN contains(fhead, ' ') THEN regexp_replace(fhead, '(?s)\\s+\\S*$', '') ELSE '' END AS fcut,
 {most} IS NULL OR {most} <= 0 OR length({v}) <= {most} AS fits FROM fh),
fe AS (SELECT *, regexp_replace(fcut, '^[ \\t,;:\\-–—/|]+|[ \\t,;:\\-–—/|]+$', '', 'g') AS fbare FROM fw),
fit AS (SELECT *, CASE WHEN {v} IS NULL OR fits THEN {v} WHEN length(fbare) >= 3 THEN fbare END AS fitted, {v} IS NOT NULL AND NOT fits AS trimmed FROM fe)"""


@query(f"WITH a AS (SELECT doc_id, split_part(text, chr(10), 1) AS value, (doc_id % 60)::INTEGER AS most FROM documents), {_fit_sql('a', 'value', 'most')} SELECT doc_id, most, fitted, trimmed FROM fit")
def fit_lengths(spark, d):
    """First lines cut to controls of 0 to 59 characters."""
    df = table(spark, d, "documents").select("doc_id", F.split_part("text", F.lit("\n"), F.lit(1)).alias("value"), (_id() % 60).cast("int").alias("most"))
    f = forms.fit_to_length(c("value"), c("most"))
    return df.select("doc_id", "most", f["value"].alias("fitted"), f["trimmed"].alias("trimmed"))


_CATEGORIES = ["personal", "education", "narrative", "experience_fact", "skills"]
_GROUNDS = " Ada Example, Master of Science, Acme Corp"
_OPT = "CASE WHEN lower(x) = 'bsc' THEN 'BSc' WHEN x = 'Master of Science' THEN 'MSc' END"


@query(f"""WITH a AS (SELECT doc_id, {_turn_sql(_CATEGORIES, 'doc_id')} AS category, ['A', 'B', 'C'][doc_id // 5 % 3 + 1] AS cond, doc_id % 11 = 0 AS sensitive, doc_id % 7 = 3 AS filled, doc_id % 2 = 0 AS overwrite, doc_id % 13 <> 5 AS fillable,
 doc_id % 15 = 1 AS opts, CASE doc_id % 4 WHEN 1 THEN CASE WHEN doc_id % 15 = 1 THEN 'Master of Science' ELSE 'Ada Example' END WHEN 2 THEN CASE WHEN doc_id % 15 = 1 THEN 'Diploma' ELSE 'Beta Labs' END
  WHEN 3 THEN CASE WHEN doc_id % 15 = 1 THEN 'BSc' ELSE 'I was at Acme Corp' END END AS draft, CASE WHEN doc_id % 6 > 0 THEN CASE WHEN doc_id % 15 = 1 THEN 'Master of Science' ELSE 'Ada Example' END END AS fact,
 CASE WHEN doc_id % 9 > 0 THEN (doc_id % 10) / 10.0 END AS mc, CASE WHEN doc_id % 6 > 0 THEN (doc_id % 8 + 2) / 10.0 END AS fc, CASE WHEN doc_id % 10 <> 1 THEN (doc_id % 21) / 20.0 END AS r,
 CASE doc_id % 12 WHEN 0 THEN 2 WHEN 1 THEN 5 END AS most, doc_id % 5 = 2 AND doc_id % 3 = 1 AS bad, trim(regexp_replace(regexp_replace(lower(text || '{_GROUNDS}'), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g')) AS hay FROM documents),
b AS (SELECT *, CASE WHEN cond = 'A' THEN fc WHEN category IN ('narrative', 'skills') THEN r WHEN fc IS NOT NULL THEN fc ELSE NULL END AS ev,
 list_bool_and(list_transform(list_filter(string_split(lower(draft), ' '), lambda x : length(x) > 2), lambda x : regexp_matches(hay, '(^|[^a-z0-9])' || x || '($|[^a-z0-9])'))) AS grounded,
 {_OPT.replace('x', 'draft')} AS draft_opt, {_OPT.replace('x', 'fact')} AS fact_opt FROM a),
e AS (SELECT *, CASE WHEN ev IS NULL AND mc IS NULL THEN 0 WHEN ev IS NULL THEN mc WHEN mc IS NULL THEN ev ELSE (0.6 * ev + 0.4 * mc) / (0.6 + 0.4) END AS k, CASE WHEN sensitive THEN 'sensitive' WHEN filled AND NOT overwrite THEN 'already_filled'
 WHEN draft IS NOT NULL AND opts AND draft_opt IS NULL THEN 'option_mismatch' WHEN draft IS NOT NULL AND category = 'narrative' AND bad THEN 'unsupported' WHEN draft IS NOT NULL AND (category = 'narrative' OR grounded) THEN 'draft'
 WHEN draft IS NOT NULL AND fact IS NOT NULL AND opts AND fact_opt IS NULL THEN 'option_mismatch' WHEN draft IS NOT NULL AND fact IS NOT NULL THEN 'fact_for_draft' WHEN draft IS NOT NULL THEN 'unsupported'
 WHEN fact IS NOT NULL AND opts AND fact_opt IS NULL THEN 'option_mismatch' WHEN fact IS NOT NULL THEN 'fact' ELSE 'nothing' END AS route FROM b),
g AS (SELECT *, (ev IS NULL AND mc IS NULL) OR k < 0.4 OR coalesce(ev < 0.4, false) OR coalesce(mc < 0.4, false) AS abstain, CASE WHEN route = 'draft' THEN CASE WHEN opts THEN draft_opt ELSE draft END
 WHEN route IN ('fact', 'fact_for_draft') THEN CASE WHEN opts THEN fact_opt ELSE fact END END AS v FROM e), {_fit_sql('g', 'v', 'most')},
h AS (SELECT *, CASE WHEN NOT fillable THEN 'not_fillable' WHEN route = 'sensitive' THEN 'sensitive_skipped' WHEN route = 'already_filled' THEN 'already_filled' WHEN v IS NULL THEN 'missing' WHEN abstain THEN 'abstained' WHEN fitted IS NULL THEN 'missing' ELSE 'offered' END AS decision,
 CASE WHEN sensitive THEN 0 ELSE round_even(k, 4) END AS confidence FROM fit)
SELECT doc_id, CASE WHEN decision = 'offered' THEN fitted END AS suggested_value, decision, confidence::DOUBLE AS confidence, NOT (decision = 'offered' AND NOT trimmed AND category IN ('personal', 'education') AND confidence >= 0.7) AS needs_confirmation,
 CASE WHEN route IN ('sensitive', 'already_filled', 'option_mismatch', 'unsupported', 'nothing') THEN route WHEN abstain THEN 'withheld' WHEN fitted IS NULL THEN 'too_long' WHEN trimmed THEN 'shortened' ELSE route END AS message_kind FROM h""")
def decide_fields(spark, d):
    """A control for each document, decided on its text, in every combination of what may be known."""
    n = _id()
    opts = n % 15 == 1
    either = lambda a, b: F.when(opts, a).otherwise(b)
    none = F.array().cast("array<string>")
    asked = table(spark, d, "documents").select(
        n.alias("page_id"), F.lit(0).alias("idx"), _turn(_CATEGORIES, n).alias("category"), _turn(["A", "B", "C"], F.floor(n / 5)).alias("condition"), (n % 11 == 0).alias("sensitive"), (n % 7 == 3).alias("already_filled"),
        (n % 2 == 0).alias("overwrite"), (n % 13 != 5).alias("fillable"), F.when(opts, F.array(F.lit("BSc"), F.lit("MSc"))).otherwise(none).alias("options"),
        F.when(n % 4 == 1, either("Master of Science", "Ada Example")).when(n % 4 == 2, either("Diploma", "Beta Labs")).when(n % 4 == 3, either("BSc", "I was at Acme Corp")).alias("proposed"),
        F.when(n % 6 > 0, either("Master of Science", "Ada Example")).alias("fact_value"), F.when(n % 9 > 0, (n % 10) / 10.0).alias("model_confidence"), F.when(n % 6 > 0, (n % 8 + 2) / 10.0).alias("fact_confidence"),
        F.when(n % 10 != 1, (n % 21) / 20.0).alias("retrieval"), F.when(n % 12 == 0, 2).when(n % 12 == 1, 5).alias("max_length"),
        F.when((n % 5 == 2) & (n % 3 == 1), F.array(F.lit("Beta Labs"))).otherwise(none).alias("unsupported"), F.concat("text", F.lit(_GROUNDS)).alias("source_text"),
    )
    return forms.decide(asked).select(c("page_id").alias("doc_id"), "suggested_value", "decision", "confidence", "needs_confirmation", "message_kind")


# --- cases, responses, files --------------------------------------------------------

_ALL_SKILLS = _list(sorted(skills.SKILLS))


def _drawn_sql(side: str, size: str) -> str:
    return f"list_transform(list_sort(list_transform({_ALL_SKILLS}, lambda s : md5('{generator.SEED}:' || case_id || ':{side}:' || s) || s))[1:{size}], lambda x : x[33:])"


_SIZE = lambda side, low, span: f"({low} + ('0x' || md5('{generator.SEED}:' || case_id || ':{side}')[1:8])::BIGINT % ({span}))"


@query(f"""WITH i AS (SELECT doc_id::VARCHAR AS case_id, lang AS family FROM documents), r AS (SELECT *, {_drawn_sql('required', _SIZE('required', generator.REQUIRED[0], generator.REQUIRED[1] - generator.REQUIRED[0] + 1))} AS req FROM i),
o AS (SELECT family, len(list_filter(own, lambda x : list_contains(req, x))) / len(req) AS o FROM (SELECT *, list_concat(req[1:{_SIZE('kept', 0, 'len(req) + 1')}], {_drawn_sql('own', generator.OTHERS)}) AS own FROM r))
SELECT family AS job_family, 0 AS violations, count(*) AS cases, count(*) FILTER (o < 0.5) AS hard, round(min(o), 6) AS min_overlap, round(median(o), 6) AS median_overlap, round(max(o), 6) AS max_overlap FROM o GROUP BY 1""".replace("len(list_filter(own, lambda x : list_contains(req, x)))", "len(list_filter(req, lambda x : list_contains(own, x)))"))
def generated_cases(spark, d):
    """A case for each document, drawn and rendered; what is rendered is what is declared."""
    cases = generator.draw_cases(table(spark, d, "documents").select(_id().cast("string").alias("case_id"), c("lang").alias("job_family")))
    bad = generator.contract_violations(cases).agg(F.count("*").cast("int").alias("violations"))
    got = generator.case_summary(cases).crossJoin(F.broadcast(bad))  # one row
    return got.select("job_family", "violations", "cases", "hard", *[F.round(x, 6).alias(x) for x in ("min_overlap", "median_overlap", "max_overlap")])


_GATE_SQL = " ".join(f"WHEN regexp_matches(lower(t), '{p}') THEN '{reason}'" for reason, p in fetched.GATES)
_SIGN_IN = ["Sign in to continue", "Subscribe to read: members only", "Verify you are human", "Access denied", "Tiny", "A page of a few words that is neither a gate nor a posting, I say"]


@query(f"""WITH b AS (SELECT doc_id, translate(CASE WHEN doc_id % 4 = 0 THEN {_turn_sql(_SIGN_IN, 'doc_id // 4')} ELSE text END, '<>&', '   ') AS body FROM documents),
s AS (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(' ' || body || chr(10), '[ \\t\\x{{a0}}]+', ' ', 'g'), ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g') AS t FROM b)
SELECT doc_id, CASE doc_id % 31 WHEN 1 THEN 'unsupported_scheme' WHEN 2 THEN 'private_host' WHEN 3 THEN 'robots_disallowed' WHEN 4 THEN 'timeout' WHEN 5 THEN 'network_error' WHEN 6 THEN 'http_error' WHEN 7 THEN 'login_required' WHEN 8 THEN 'paywall'
 WHEN 9 THEN 'blocked' WHEN 10 THEN 'http_error' WHEN 11 THEN 'not_html' ELSE CASE WHEN length(t) >= {fetched.MIN_CHARS} THEN 'ok' {_GATE_SQL} WHEN length(t) < {fetched.LEAST_CHARS} THEN 'not_html' ELSE 'ok' END END AS reason FROM s""")
def judge_fetched_pages(spark, d):
    """Documents as fetched pages, with every kind of failure, and gates in place of some texts."""
    k = _id() % 31
    body = F.translate(F.when(_id() % 4 == 0, _turn(_SIGN_IN, F.floor(_id() / 4))).otherwise(c("text")), "<>&", "   ")
    df = table(spark, d, "documents").select(
        F.concat(F.when(k == 1, "ftp").otherwise("https"), F.lit("://a.org/"), _id()).alias("url"), F.when(k == 7, 401).when(k == 8, 402).when(k == 9, 429).when(k == 10, 503).otherwise(200).alias("status"),
        F.when(k == 11, "image/png").otherwise("text/html; charset=utf-8").alias("content_type"), F.concat(F.lit("<p>"), body, F.lit("</p>")).cast("binary").alias("body"),
        F.when(k == 2, F.array(F.lit("10.0.0.1"))).otherwise(F.array(F.lit("93.184.216.34"))).alias("resolved_ips"), F.when(k == 6, 9).otherwise(1).alias("redirects"), (k != 3).alias("robots_allowed"),
        F.when(k == 4, "ReadTimeout").when(k == 5, "ConnectError").alias("failure"),
    )
    return fetched.judge_responses(df).select(F.split_part("url", F.lit("/"), F.lit(4)).cast("bigint").alias("doc_id"), "reason")


@query(f"""WITH t AS (SELECT doc_id, trim(regexp_replace(regexp_replace(text, '[^ -~]+', ' ', 'g'), ' +', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN '' ELSE t END AS text, doc_id % 9 > 0 AND length(t) >= {pdf.MIN_CHARS} AS ok FROM t WHERE length(t) >= {pdf.MIN_CHARS} OR doc_id % 9 = 0
UNION ALL SELECT doc_id, t, false FROM t WHERE length(t) < {pdf.MIN_CHARS} AND doc_id % 9 > 0""")
def pdf_text(spark, d):
    """Documents as files of one page whose text is shown in pieces; every ninth isn't a PDF."""
    plain = F.regexp_replace("text", "[^ -~]+", " ")
    shown = F.array_join(F.transform(F.split(F.regexp_replace(plain, r"([()\\\\])", r"\\$1"), " "), lambda w: F.concat(F.lit("("), w, F.lit(") Tj"))), "\n")
    stream = F.concat(F.lit("%PDF-1.4\n1 0 obj << /Type /Page /Contents 2 0 R >> endobj\n2 0 obj << >>\nstream\nBT "), shown, F.lit(" ET\nendstream\nendobj\n%%EOF"))
    content = F.when(_id() % 9 == 0, c("text")).otherwise(stream).cast("binary")
    files = spread(table(spark, d, "documents")).select(_id().cast("string").alias("path"), content.alias("content"))
    return pdf.read_pdf(files).select(c("path").cast("bigint").alias("doc_id"), "text", "ok")


# --- forms end to end ---------------------------------------------------------------

#: The controls of a form: what they are called here, the pages that have them (as SQL of both engines), their markup.
_CONTROLS = [
    ("name", "page_id % 2 = 0", "<p><label>Full name <input name='a'></label></p>"),
    ("mail", "page_id % 3 = 0", "<p><label>Email address <input type='email' name='b' value='x@y.org'></label></p>"),
    ("mail2", "page_id % 3 > 0", "<p><label>Email address <input type='email' name='b'></label></p>"),
    ("passport", "page_id % 5 < 2", "<p><label>Passport number <input name='c'></label></p>"),
    ("degree", "page_id % 4 <> 1", "<p><label>Degree <select name='d'><option value=''></option><option>BSc</option><option>MSc</option><option>PhD</option></select></label></p>"),
    ("school", "page_id % 3 <> 2", "<p><label>University <input name='u'></label></p>"),
    ("gpa", "page_id % 8 < 4", "<p><label>GPA <input name='g'></label></p>"),
    ("gpa2", "page_id % 8 >= 6", "<p><label>GPA <input name='g' maxlength='2'></label></p>"),
    ("links", "true", "<p><label>Portfolio <input name='e'></label></p>"),
    ("why", "page_id % 4 = 2", "<p><label>Why do you want this role? <textarea name='f'></textarea></label></p>"),
    ("file", "page_id % 6 = 0", "<input type='file' name='cv'>"),
]
_OPTION_OF = {"Master of Science": "MSc", "BSc": "BSc", "Bachelor of Engineering": "BSc", "PhD": "PhD"}
_FORMS_SQL = f"""{_PEOPLE_SQL}, q AS (SELECT page_id, ['A', 'B', 'C'][page_id // 2 % 3 + 1] AS condition, contains(html, '</body>') AS f FROM pages),
x AS (SELECT page_id, unnest(list_filter([{', '.join(f"CASE WHEN {when} THEN '{name}' END" for name, when, _ in _CONTROLS)}], lambda x : x IS NOT NULL)) AS control FROM q WHERE f),
n AS (SELECT page_id, control, row_number() OVER (PARTITION BY page_id ORDER BY list_position({_list([n for n, *_ in _CONTROLS])}, control)) - 1 AS idx FROM x),
s AS (SELECT n.page_id, idx, condition, CASE WHEN control IN ('name', 'mail', 'mail2', 'links') THEN 'personal' WHEN control IN ('degree', 'school', 'gpa', 'gpa2') THEN 'education' WHEN control = 'why' THEN 'narrative' ELSE 'unknown' END AS category,
 CASE control WHEN 'name' THEN p.name WHEN 'mail2' THEN p.mail WHEN 'degree' THEN CASE WHEN p.doc_id % 3 <> 1 THEN CASE p.degree {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in _OPTION_OF.items())} END END
  WHEN 'school' THEN CASE WHEN p.doc_id % 3 <> 1 THEN p.school END WHEN 'gpa' THEN CASE WHEN p.doc_id % 3 <> 1 THEN '4.5' END END AS value, control FROM n JOIN q USING (page_id) LEFT JOIN p ON p.doc_id = n.page_id),
z AS (SELECT *, CASE control WHEN 'mail' THEN 'already_filled' WHEN 'passport' THEN 'sensitive_skipped' WHEN 'file' THEN 'not_fillable' ELSE CASE WHEN value IS NULL THEN 'missing' ELSE 'offered' END END AS decision FROM s)"""


def form_requests(spark, d):
    """A form of its own in every page, a request for it, and the profiles of the documents' people; that of the page's number is asked for."""
    web = table(spark, d, "pages")
    form = F.concat(F.lit("<form>"), *[F.when(F.expr(when), html).otherwise("") for _, when, html in _CONTROLS], F.lit("</form></body>"))
    df = web.select("page_id", F.replace("html", F.lit("</body>"), form).alias("html"))
    turn = _turn(list(assistant.CONDITIONS), F.floor(c("page_id") / 2))
    asks = web.select("page_id", c("page_id").alias("profile_id"), turn.alias("condition"), F.lit("We need Python and SQL").alias("posting"), F.lit(0.8).alias("retrieval"), F.lit(False).alias("overwrite"))
    return pages.scan_controls(spread(df)), asks, _people(spark, d)


@query(f"WITH {_FORMS_SQL} SELECT page_id, idx, condition, category, value AS suggested_value, decision FROM z")
def suggest_fields(spark, d):
    out = assistant.suggest(*form_requests(spark, d))
    return out.select("page_id", "idx", "condition", "category", "suggested_value", "decision")


@query(f"""WITH {_FORMS_SQL}, k AS (SELECT page_id, count(*) AS total, count(*) FILTER (decision = 'offered') AS offered, count(*) FILTER (decision = 'missing') AS missing, count(*) FILTER (decision = 'sensitive_skipped') AS sensitive_skipped,
 count(*) FILTER (decision = 'already_filled') AS already_filled, count(*) FILTER (decision = 'not_fillable') AS not_fillable, count(*) FILTER (decision <> 'offered') AS needs_confirmation FROM z GROUP BY 1)
SELECT q.page_id, q.condition, coalesce(total, 0) AS total, coalesce(offered, 0) AS offered, 0 AS withheld, coalesce(missing, 0) AS missing, coalesce(sensitive_skipped, 0) AS sensitive_skipped, coalesce(already_filled, 0) AS already_filled,
 coalesce(needs_confirmation, 0) AS needs_confirmation, coalesce(not_fillable, 0) AS not_fillable, 'Python|SQL' AS lacking_text,
 CASE p.doc_id % 3 WHEN 0 THEN 'personal_info|education' WHEN 1 THEN 'personal_info|internship' WHEN 2 THEN 'personal_info|education|internship' ELSE '' END AS used_text, CASE p.doc_id % 3 WHEN 0 THEN 'internship' WHEN 1 THEN 'education' ELSE '' END AS dropped_text,
 concat_ws('|', CASE WHEN q.condition = 'B' THEN 'no retrieved notes were used' END, CASE WHEN NOT q.f THEN 'no control may be filled' END, CASE WHEN q.condition <> 'A' THEN 'drafts are the offline responder''s' END) AS notes_text
FROM q LEFT JOIN k USING (page_id) LEFT JOIN p ON p.doc_id = q.page_id""")
def generate_forms(spark, d):
    controls, asks, people = form_requests(spark, d)
    out = assistant.summarise(assistant.suggest(controls, asks, people), asks, people)
    return out.select("*", *[F.array_join(x, "|").alias(f"{x}_text") for x in ("lacking", "used", "dropped", "notes")]).drop("lacking", "used", "dropped", "notes")


# --- prefill ------------------------------------------------------------------------

_PLAIN_SQL = lambda t: f"trim(regexp_replace(regexp_replace(lower({t}), '[^\\p{{L}}\\p{{N}}\\s]', '', 'g'), '\\s+', ' ', 'g'))"


def _supports_sql(v: str) -> str:
    word = lambda w: f"regexp_matches(hay, '(^|[^a-z0-9])' || {w} || '($|[^a-z0-9])')"
    tokens = f"list_filter(string_split({_PLAIN_SQL(v)}, ' '), lambda t : length(t) > 2)"
    return f"coalesce({_PLAIN_SQL(v)} <> '' AND ({word(_PLAIN_SQL(v))} OR (len({tokens}) > 0 AND list_bool_and(list_transform({tokens}, lambda t : {word('t')})))), false)"


_TWO = "array_to_string(regexp_extract_all(text, '[A-Za-z]{3,}')[1:2], ' ')"
_MAIL = "CASE doc_id % 3 WHEN 0 THEN regexp_extract(text, '[A-Za-z]{3,}') || '@none.org' WHEN 1 THEN regexp_extract(text, '[A-Za-z]{3,}') END"


@query(f"""WITH {catalogue._DOCS}, a AS (SELECT doc_id, {_PLAIN_SQL('text')} AS hay, CASE WHEN doc_id % 5 > 0 THEN {_TWO} ELSE 'Nobody Named' END AS full_name, {_MAIL} AS email, {_turn_sql(_SCHOOLS, 'doc_id')} AS school,
 'MSc' AS degree, {_turn_sql(catalogue.PLANT, 'doc_id * 3')} AS s1, {_turn_sql(catalogue.PLANT, 'doc_id * 7')} AS s2, {_turn_sql(catalogue.PLANT, 'doc_id * 3 + 1')} AS s3 FROM pd),
o AS (SELECT *, {_supports_sql('full_name')} AS ok_name, {_supports_sql('email')} AS ok_mail, {_supports_sql('school')} AS ok_school, {_supports_sql('s1')} AS ok1, {_supports_sql('s2')} AS ok2, {_supports_sql('s3')} AS ok3 FROM a)
SELECT doc_id, CASE WHEN ok_name THEN full_name END AS full_name, CASE WHEN ok_mail THEN email END AS email, CASE WHEN ok_school THEN school END AS school, degree,
 concat_ws('|', CASE WHEN ok1 THEN s1 END, CASE WHEN ok2 THEN s2 END, CASE WHEN ok3 THEN s3 END) AS top_skills, CASE WHEN ok_name THEN 0.9 ELSE 0.0 END::DOUBLE AS sure_name, 0.8::DOUBLE AS sure_degree,
 concat_ws('|', CASE WHEN NOT ok_name THEN 'personal_info.full_name=''' || full_name || '''' END, CASE WHEN email IS NOT NULL AND NOT ok_mail THEN 'personal_info.email=''' || email || '''' END,
  CASE WHEN NOT ok_school THEN 'education.school=''' || school || '''' END, CASE WHEN NOT ok1 THEN 'top_skills=''' || s1 || '''' END, CASE WHEN NOT ok2 THEN 'top_skills=''' || s2 || '''' END, CASE WHEN NOT ok3 THEN 'top_skills=''' || s3 || '''' END) AS dropped FROM o""")
def prefill_answers(spark, d):
    """A model's answer about each document, partly made up, held against the whole text."""
    word = F.regexp_extract("text", "[A-Za-z]{3,}", 0)
    two = F.array_join(F.slice(F.regexp_extract_all("text", F.lit("[A-Za-z]{3,}"), F.lit(0)), 1, 2), " ")
    mail = F.when(_id() % 3 == 0, F.concat(word, F.lit("@none.org"))).when(_id() % 3 == 1, word)
    info = F.struct(F.when(_id() % 5 > 0, two).otherwise("Nobody Named").alias("full_name"), mail.alias("email"))
    study = F.struct(_turn(_SCHOOLS, _id()).alias("school"), F.lit("MSc").alias("degree"))
    named = F.array(*[_turn(catalogue.PLANT, _id() * k + b) for k, b in ((3, 0), (7, 0), (3, 1))])
    sure = F.create_map(F.lit("full_name"), F.lit(0.9), F.lit("education_degree"), F.lit(0.8))
    answer = F.concat(F.lit("```json\n"), F.to_json(F.struct(info.alias("personal_info"), study.alias("education"), named.alias("top_skills"), sure.alias("field_confidence"))), F.lit("\n```"))
    got = prefill.extract_prefill(catalogue.planted_documents(spark, d).select(_id().alias("case_id"), c("text").alias("resume_text"), answer.alias("answer")))
    return got.select(c("case_id").alias("doc_id"), "full_name", "email", c("education_school").alias("school"), c("education_degree").alias("degree"), F.array_join("top_skills", "|").alias("top_skills"),
                      c("field_confidence")["full_name"].alias("sure_name"), c("field_confidence")["education_degree"].alias("sure_degree"), F.array_join("dropped", "|").alias("dropped"))


# --- truth of cases, states of controls ----------------------------------------------


@query(f"""WITH i AS (SELECT doc_id::VARCHAR AS case_id, lang AS family FROM documents), r AS (SELECT *, {_drawn_sql('required', _SIZE('required', generator.REQUIRED[0], generator.REQUIRED[1] - generator.REQUIRED[0] + 1))} AS req FROM i),
o AS (SELECT *, list_concat(req[1:{_SIZE('kept', 0, 'len(req) + 1')}], {_drawn_sql('own', generator.OTHERS)}) AS own FROM r),
p AS (SELECT *, list_sort(list_filter(req, lambda x : list_contains(own, x))) AS pool FROM o)
SELECT case_id, array_to_string(list_sort(req), '|') AS jd_required_skills, array_to_string(list_sort(list_distinct(own)), '|') AS candidate_skills, round_even(len(pool) / len(req), 4) AS skill_overlap,
 (len(pool) / len(req) < 0.5)::INTEGER AS hard_case, array_to_string(pool, '|') AS expected_top_skills, least(3, len(pool))::INTEGER AS expected_top_skills_n, 'Candidate ' || case_id || ' Example' AS expected_full_name FROM p""")
def case_truth(spark, d):
    """The ground truth of a case drawn for each document."""
    cases = generator.draw_cases(table(spark, d, "documents").select(_id().cast("string").alias("case_id"), c("lang").alias("job_family")))
    return generator.ground_truth(cases).select("case_id", "jd_required_skills", "candidate_skills", "skill_overlap", "hard_case", "expected_top_skills", "expected_top_skills_n", "expected_full_name")


@query("""WITH s AS (SELECT event_id, event_id % 2 = 0 AS fillable, event_id % 3 = 0 AS sensitive, event_id % 5 = 0 AS offered, user_id % 2 = 0 AS abstained, user_id % 3 = 0 AS missing, event_type = 'view' AS filled FROM events)
SELECT CASE WHEN NOT fillable THEN 'not_fillable' WHEN sensitive THEN 'sensitive_skipped' WHEN offered THEN 'offered' WHEN abstained THEN 'abstained' WHEN missing THEN 'missing' WHEN filled THEN 'already_filled' ELSE 'unclassified' END AS matrix,
 CASE WHEN sensitive THEN 'sensitive_skipped' WHEN NOT fillable THEN 'not_fillable' WHEN offered THEN 'offered' WHEN filled THEN 'already_filled' WHEN abstained THEN 'abstained' WHEN missing THEN 'missing' ELSE 'unclassified' END AS live,
 count(*) AS n FROM s GROUP BY 1, 2""")
def decision_orders(spark, d):
    """States of controls with every combination of signs, in both orders."""
    e, u = c("event_id"), c("user_id")
    signs = (e % 2 == 0, e % 3 == 0, F.when(e % 5 == 0, "x"), u % 2 == 0, u % 3 == 0, c("event_type") == "view")
    df = table(spark, d, "events").select(*[forms.classify_decision(*signs, order=o).alias(o) for o in forms.DECISION_ORDERS])
    return df.groupBy(*forms.DECISION_ORDERS).agg(F.count("*").alias("n"))
