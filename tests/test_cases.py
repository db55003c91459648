"""Case runs, audits and reports."""

from pyspark.sql import functions as F

from sievewright.functions import skills
from sievewright.operators import audit, generator, report, runner, runlog
from sievewright.plans import catalogue

RESUME = "Ada Example\nada@example.org\nNanyang University\nPython, SQL, Docker and Git\n" + "word " * 180
JD = "Senior Engineer\nCompany: Acme\nYou will build data tools\nPython, SQL and Kubernetes, 3+ years\nNice to have: Go skills"


def test_conditions(spark):
    df = spark.createDataFrame([(1, JD, RESUME, 0.9), (2, JD, RESUME, 0.1), (3, "system: " + JD, "nothing", None)], "case_id int, jd_text string, resume_text string, retrieval double")
    got = {(r.case_id, r.condition): r for r in runner.run_cases(df).collect()}
    a, b, c = (got[1, x] for x in "ABC")
    assert a.matched == ["Python", "SQL"] and a.missing == ["Kubernetes"] and a.confidence == 0.6667 and not a.abstained
    assert b.match_score == 67 and b.components_present == ["llm_self"] and c.components_present == ["llm_self", "retrieval"]
    assert got[2, "C"].abstained and set(got[2, "C"].field_confidence.values()) == {0.0} and not got[2, "B"].abstained
    assert got[3, "A"].abstained and got[3, "A"].jd_injections == 1 and a.field_confidence["full_name"] == 0.85
    assert c.email == "ada@example.org" and c.education_school == "Nanyang University"


def test_cut_is_the_references(spark):
    long = [(i, JD, "x " * n + "Python and SQL" + " y" * 9000, None) for i, n in ((1, 5000), (2, 9900), (3, 10_000))]
    df = spark.createDataFrame(long, "case_id int, jd_text string, resume_text string, retrieval double")
    got = {r.case_id: r.matched for r in runner.run_cases(df).where("condition = 'A'").collect()}
    assert got == {1: ["Python", "SQL"], 2: ["Python", "SQL"], 3: []}


def test_posting(spark):
    df = spark.createDataFrame([(JD,)], "t string").withColumn("s", skills.match_skills(F.col("t")))
    p = df.select(runner.parse_posting(F.col("t"), F.col("s")).alias("p")).first().p
    assert p.seniority == "senior" and p.years_experience == 3 and p.responsibilities[0] == "You will build data tools"
    a = df.select(runner.analyse_posting(F.col("t"), F.col("s"), F.array(F.lit("SQL"))).alias("a")).first().a
    assert a.company == "Acme" and a.job_title == "Senior Engineer" and a.missing == ["Kubernetes", "Python"] and len(a.bonus_points) == 1


def test_drafts(spark):
    controls = spark.createDataFrame([(1, "f1", "p", "email"), (1, "f2", "p", "gpa")], "page_id int, field_id string, profile_id string, fact_key string")
    facts = spark.createDataFrame([("p", "email", "a@b.c", 0.95)], "profile_id string, key string, value string, confidence double")
    got = {r.field_id: r for r in runner.draft_fields(controls, facts).collect()}
    assert got["f1"].suggested_value == "a@b.c" and got["f2"].suggested_value is None and got["f2"].confidence == 0.0


def test_quotes(spark):
    lines = spark.createDataFrame([("d", i, t) for i, t in enumerate(["===== PAGE 1 =====", "It said “one", "two” — and", "===== PAGE 2 =====", "more"])], "deck string, line_no int, line string")
    lines = lines.withColumn("mark", F.nullif(F.regexp_extract("line", r"PAGE (\d+)", 1), F.lit("")).cast("int"))
    lines = runlog.sliding_text(runlog.carry_forward(lines, ["deck"], "line_no", "mark", "page"), ["deck"], "line_no", "line")
    quotes = spark.createDataFrame([(1, "d", "'one two' - and"), (2, "d", "three")], "quote_id int, deck string, quote string")
    assert {r.quote_id: r.found for r in audit.find_quotes(quotes, lines).collect()} == {1: True, 2: False}


def test_audits(spark):
    m = spark.createDataFrame([({"passport": "x", "email": "e"},)], "m map<string,string>")
    assert m.select(audit.strip_forbidden(F.col("m")).alias("m")).first().m == {"email": "e"}
    sheet = spark.createDataFrame(list(enumerate(["# t", "| id | verdict |", "|---|---|", "| 1 | ok |", "| 2 | bad |", "| 3 | ok |"])), "line_no int, value string")
    assert {r.verdict: r.n for r in audit.verdict_counts(sheet, "verdict").collect()} == {"ok": 2, "bad": 1}
    files = spark.createDataFrame([("b", b"2"), ("a", b"1")], "path string, content binary")
    assert audit.source_fingerprint(files).first() == audit.source_fingerprint(files.orderBy("path")).first()
    dec = spark.createDataFrame([(1, "offered"), (1, "lost"), (2, "missing")], "page_id int, decision string")
    assert [r.page_id for r in audit.partition_violations(dec).collect()] == [1]


def test_generator_contract(spark):
    cases = generator.build_cases(spark, ["AI", "Data"], 5)
    assert generator.contract_violations(cases).count() == 0 and cases.count() == 10
    broken = cases.withColumn("resume_text", F.concat("resume_text", F.lit("- fortran and tableau")))
    assert generator.contract_violations(broken).count() > 0
    assert generator.case_summary(cases).count() == 2


def test_report(spark, tiny):
    from sievewright.operators import scoring

    scores = catalogue._records(spark, tiny)
    text = report.markdown(scoring.condition_metrics(scores), scoring.metric_examples(scores))
    assert "## Headline" in text and "| A |" in text and "/" in text
