"""File sources and sinks, pages, PDF, streams and the entry module."""

import json
import os
import subprocess
import sys
import zlib

import pytest
from pyspark.sql import functions as F

from sievewright.functions import forms
from sievewright.operators import runlog
from sievewright.plans import catalogue
from sievewright.sources import files, pages, pdf
from sievewright.streaming import runs

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_cases_and_chunks(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"cases": [{"case_id": "a", "jd_text": "x"}, {"case_id": "b"}]}))
    (tmp_path / "l.json").write_text(json.dumps([{"case_id": "z"}]))
    assert [r.case_id for r in files.read_cases(spark, str(tmp_path / "c.json"), 1).collect()] == ["a"]
    assert [r.case_id for r in files.read_cases(spark, str(tmp_path / "l.json")).collect()] == ["z"]
    (tmp_path / "k.json").write_text(json.dumps({"chunks": [{"id": "k1", "source": "s", "text": " hello "}, {"text": "short"}]}))
    got = files.read_chunks(spark, str(tmp_path / "k.json"))
    assert [(r.id, r.text) for r in got.collect()] == [("k1", "hello"), ("chunk_001", "short")]
    assert {r.problem for r in files.validate_chunks(got).collect()} == {"too short", "no source"}
    (tmp_path / "k2.json").write_text(json.dumps([{"text": "x" * 501}]))
    with pytest.raises(Exception, match="longer than 500"):
        files.read_chunks(spark, str(tmp_path / "k2.json")).collect()


def test_ground_truth_and_timers(spark, tmp_path):
    head = files.GROUND_TRUTH.split(", ")
    names = [h.split()[0] for h in head]
    row = lambda **k: ",".join(str(k.get(n, "")) for n in names)
    (tmp_path / "g.csv").write_text("\n".join([",".join(names), row(case_id="a", hard_case=0), row(case_id="a", hard_case=1, skill_overlap=0.5)]))
    got = files.read_ground_truth(spark, str(tmp_path / "g.csv")).collect()
    assert [(r.case_id, r.hard_case, r.skill_overlap) for r in got] == [("a", True, 0.5)]
    assert files.read_timers(spark, str(tmp_path / "none.csv")).count() == 0
    assert files.read_form_schema(spark, str(tmp_path / "none.json")).count() == 0
    assert files.read_snapshot(spark, str(tmp_path / "none.json"), "a int") is None


def timers(spark, rows):
    return spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], files.TIMERS + ", ordinal bigint")


def test_timing_gate(spark):
    gate = lambda rows: runlog.timing_gate(timers(spark, rows)).first()
    assert gate([]).status == "no_data"
    two = [(t, "c", p, m, "baseline_first") for t in ("a", "b") for p, m in (("baseline", "10"), ("assisted", "5"))]
    got = gate(two)
    assert got.status == "insufficient" and got.mean_reduction is None and got.n_timers == 2
    bad = [("c", "c", "baseline", "x", ""), ("c", "c", "other", "5", ""), ("", "c", "baseline", "5", ""), ("c", "c", "assisted", "-1", "")]
    three = [*two, *bad, ("c", "c", " Baseline", "10", "assisted_first"), ("c", "c", "assisted", "5", "assisted_first")]
    got = gate(three)
    assert (got.status, got.mean_reduction, got.n_paired, got.hits) == ("reported", 0.5, 3, 3)
    assert [r.timer_id for r in runlog.order_warnings(timers(spark, three)).collect()] == ["c"]


def test_run_log_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("r1", "A", "c1", "secret text", 1.0)], "run_id string, condition string, case_id string, jd_text string, timestamp double")
    files.append_run_log(df, str(tmp_path / "log"))
    raw = spark.read.text(str(tmp_path / "log")).first()[0]
    assert "secret" not in raw and "sha256_8" in raw
    files.append_run_log(df, str(tmp_path / "log"))
    assert files.read_run_log(spark, str(tmp_path / "log")).count() == 2
    stream = runs.run_log_stream(spark, str(tmp_path / "log"), files.RUN_LOG)
    q = runs.condition_counts(stream).writeStream.outputMode("update").format("memory").queryName("counts_test").trigger(availableNow=True).start()
    q.awaitTermination()
    assert max(r.n for r in spark.table("counts_test").collect()) == 1


def test_stream_equals_batch(spark, tiny):
    got = {(r.event_type, str(r.day)[:10]): (r.n, r.total) for r in catalogue.events_stream_window(spark, tiny).collect()}
    want = {(r.event_type, str(r.day)[:10]): (r.n, r.total) for r in catalogue.events_per_day(spark, tiny).collect()}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}


HTML = """<html><head><title>T &amp; <b>x</b></title><script>bad()</script></head><body><nav><a>menu</a></nav><main><h1>Job</h1><p>We  use Python.</p></main>
<form><fieldset><legend>Employer details</legend><label for="n">Name</label><input id="n" name="nm"></fieldset>
<label>Email <input type="email" name="em" maxlength="40" required value="a@b"></label><input type="hidden" name="h"><input name="lk" readonly value="z">
<select name="d"><option>BSc<option selected>MSc</select><textarea placeholder="Why"></textarea><input type="password" name="pw" value="p">
<input type="radio" name="r" value="1" aria-label="Yes"><input type="radio" name="r" value="2" checked aria-label="No"></form></body></html>"""


def test_pages(spark):
    assert pages.readable_text(HTML) == "Job\nWe  use Python." and pages.readable_text(None) == ""
    rows = pages.controls(HTML)
    assert [(r["name"], r["label"], r["current_value"]) for r in rows] == [
        ("nm", "Name", ""), ("em", "Email", "a@b"), ("lk", "", ""), ("d", "", "MSc"), ("", "", ""), ("pw", "", ""), ("r", "Yes", ""), ("r", "No", "2"),
    ]
    assert rows[0]["section_context"] == "Employer details" and rows[1]["max_length"] == 40 and rows[6]["options"] == ["Yes", "No"] and rows[0]["selector"] == "#n"
    df = spark.createDataFrame([(1, HTML), (2, None), (3, "<p>none</p>")], "page_id long, html string")
    got = {r.idx: r for r in forms.normalise_fields(pages.scan_controls(df)).collect()}
    assert len(got) == 8 and got[0].category == "unknown" and got[1].fact_key == "email" and got[1].already_filled
    assert "readonly" in got[2].skip_reason and "password" in got[5].skip_reason and got[6].field_id != got[7].field_id
    assert df.select(pages.plain_text(F.col("html")).alias("t")).first().t.startswith("T &amp;")


def test_pdf():
    body = zlib.compress(b"BT (Hello \\(world\\) this is) Tj (a longer text \\101) Tj ET")
    data = b"%PDF-1.4 /Type /Page \nstream\n" + body + b"\nendstream"
    assert pdf.extract(data)[:3] == ("Hello (world) this is a longer text A", 1, True)
    assert pdf.extract(b"nothing")[2] is False and pdf.literal(rb"a\q\061") == "a1"
    assert pdf.extract(b"%PDF\nPlain readable words that stand in the file itself")[2] is True


def test_pdf_operators():
    show = lambda s: pdf.shown(s)
    assert show(b"BT [(He) -10 (llo) -300 (there)] TJ ET (not shown) Tj") == ["Hello there"]
    assert show(b"BT (nested (one) \\) two) Tj <48 69> Tj <FEFF00e9> ' T* (% no comment) Tj % comment (x) Tj\nET") == ["nested (one) ) two", "Hi", "\u00e9", "% no comment"]
    assert show(b"BI /W 1 ID (x) Tj BT (y) Tj EI BT (z) Tj ET") == ["z"]
    assert show(b"BT (open") == [] and show(b"") == []


def test_pdf_pages(spark):
    def stream(n, body, extra=b""):
        return b"%d 0 obj\n<< /Length %d %s>>\nstream\n%s\nendstream\nendobj\n" % (n, len(body), extra, body)

    second = zlib.compress(b"BT (second page) Tj ET")
    data = (
        b"%PDF-1.4\n" + stream(7, second, b"/Filter /FlateDecode ") + stream(5, b"BT (first endstream page) Tj ET") + stream(6, b"4254202861293e".hex().encode() + b">", b"/Filter /DCTDecode ")
        + b"1 0 obj\n<< /Type /Pages /Kids [2 0 R 3 0 R] >>\nendobj\n2 0 obj\n<< /Type /Page /Contents [5 0 R 9 0 R] >>\nendobj\n3 0 obj\n<< /Type /Page /Contents 7 0 R >>\nendobj\n"
    )
    assert pdf.page_texts(data) == ["first endstream page", "second page"]
    assert pdf.extract(data)[:3] == ("first endstream page second page", 2, True)
    rows = spark.createDataFrame([("a", data), ("b", b"no"), ("c", None)], "path string, content binary")
    assert [tuple(r) for r in pdf.read_pdf_pages(rows).orderBy("page_no").collect()] == [("a", 1, "first endstream page"), ("a", 2, "second page")]
    assert pdf.read_pdf(rows).where("ok").count() == 1


def test_scan_text(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one\n中文 here\nthree")
    (tmp_path / "b.txt").write_text("中文 allowed")
    excuse = spark.createDataFrame([("b.txt", "allowed")], "file string, excerpt string")
    got = files.scan_text(spark, str(tmp_path), r"[\x{4e00}-\x{9fff}]", allowed=excuse).collect()
    assert [(os.path.basename(r.file), r.line_no) for r in got] == [("a.txt", 2)]
    files.write_csv(spark.range(2), str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out"), header=True).count() == 2


def test_entry_without_the_optional_part(tmp_path):
    code = (
        "import sys, importlib.abc\n"
        "class No(importlib.abc.MetaPathFinder):\n"
        "    def find_spec(self, name, path, target=None):\n"
        "        if name.startswith('sievewright.llm'): raise ModuleNotFoundError(name)\n"
        "sys.meta_path.insert(0, No())\n"
        "import __spark_entry__ as e\n"
        "q = e.queries(); assert 'match_documents' in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q)\n"
    )
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True, timeout=120)


def test_samples_and_descriptor(spark, tmp_path):
    for n, t in (("a_jd", "x"), ("a_resume", "y"), ("b_jd", "z")):
        (tmp_path / f"{n}.txt").write_text(t)
    assert [tuple(r) for r in files.read_samples(spark, str(tmp_path)).collect()] == [("a", "x", "y")]
    k = spark.createDataFrame([("1", "f", "t"), ("2", "f", "u")], "id string, family string, text string")
    assert files.chunk_descriptor(k)["families"] == {"f": 2} and files.chunk_descriptor(k) == files.chunk_descriptor(k.orderBy("text"))


def test_profiles_and_field_lists(spark):
    from sievewright.operators import profiles

    t = spark.createDataFrame([("p", "Ada Example\nada@example.org\nBSc in Statistics 2021")], "profile_id string, text string")
    got = profiles.profile_from_text(t).first()
    assert got.filled == ["education.degree", "education.graduation_year", "education.major", "personal_info.email", "personal_info.full_name"]
    assert got.uncertain == ["education.graduation_year"]
    assert profiles.facts_as_list(profiles.extract_facts(t)).first().facts[0].key == "education_degree"
    m = spark.createDataFrame([(["projects", "projects"],)], "m array<string>")
    assert m.select(profiles.checked_modules(F.col("m")).alias("m")).first().m == ["projects"]
    with pytest.raises(Exception, match="unknown module"):
        m.select(profiles.checked_modules(F.array(F.lit("secrets")))).collect()
    df = spark.createDataFrame([(1, HTML)], "page_id long, html string")
    block = forms.field_list(forms.normalise_fields(pages.scan_controls(df))).first().block
    assert "options: BSc, MSc" in block and "pw" not in block and block.count("\n") >= 4
