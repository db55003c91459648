"""File sources and sinks: cases, knowledge base, ground truth, run logs, timers, form schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sievewright.functions import records
from sievewright.operators import containment
from sievewright.operators.quantiles import with_quantiles
from sievewright.session import cut

CASES = (
    "case_id string, job_family string, variant string, profile_id string, company string, title string, jd_text string, resume_text string, "
    "named_skills array<string>, implied_skills array<string>, required_skills array<string>, candidate_skills array<string>"
)
GROUND_TRUTH = (
    "case_id string, named_set_adjusted string, job_family string, variant string, profile_id string, jd_named_skills string, jd_implied_skills string, "
    "jd_required_skills string, candidate_skills string, skill_overlap double, hard_case int, should_abstain int, hard_case_definition string, "
    "expected_full_name string, expected_email string, expected_education_school string, expected_top_skills string, expected_top_skills_n int, "
    "expected_education_degree string, expected_education_major string"
)
CHUNKS = "id string, source string, family string, tags array<string>, text string"
RUN_LOG = (
    "run_id string, condition string, case_id string, job_family string, variant string, mode string, model string, retrieved_chunk_ids array<string>, "
    "retrieval_similarity double, retrieval_mean_similarity double, llm_self_confidence double, confidence double, components_present array<string>, abstained boolean, abstention_reason string, match_score int, "
    "jd_skills array<string>, top_skills array<string>, prefill map<string,string>, suggestions array<string>, claimed_items array<string>, stripped_claims array<string>, "
    "input_report map<string,string>, usage struct<prompt_tokens:bigint,completion_tokens:bigint,est_cost_usd:double,calls:int>, latency_ms bigint, errors array<string>, notes array<string>, timestamp double"
)
TIMERS = "timer_id string, case_id string, phase string, minutes string, first_exposure string"
FORM_SCHEMA = "name string, label string, type string, is_list boolean, required boolean"
# Bounds of a chunk.
CHUNK_CHARS = (40, 500)


#: Where a row stands in a folder of files.
PLACE = "struct<changed:timestamp,file:string,block:bigint,row:bigint>"


def place() -> Column:
    """Where a row of a file source stands: files by time of change and name, then the block, then the row in it.

    Splits are packed into tasks by size, so that row numbers alone don't follow the files; within a block they do.
    """
    meta = F.col("_metadata")
    return F.struct(
        meta["file_modification_time"].cast("timestamp").alias("changed"), meta["file_path"].alias("file"), meta["file_block_start"].alias("block"), F.monotonically_increasing_id().alias("row")
    )


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_cases(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """Cases of a JSON document, either a list or an object with the list ``cases``; the first ``limit`` in file order."""
    inner = T._parse_datatype_string(f"array<struct<{', '.join(x.replace(' ', ':', 1) for x in CASES.split(', '))}>>")
    text = spark.read.text(path, wholetext=True)
    listed = F.from_json("value", inner)
    nested = F.from_json("value", T.StructType([T.StructField("cases", inner)]))["cases"]
    rows = text.select(F.posexplode(F.when(F.trim("value").startswith("["), listed).otherwise(nested)).alias("ordinal", "c")).select("ordinal", "c.*")
    return rows if limit is None else rows.where(F.col("ordinal") < limit)


def write_cases(cases: DataFrame, path: str) -> None:
    """Cases as JSON Lines, from as many tasks as there are."""
    cases.write.mode("overwrite").json(path)


def read_case_lines(spark: SparkSession, path: str) -> DataFrame:
    """Cases of JSON Lines."""
    return spark.read.schema(CASES).json(path)


def write_truth(truth: DataFrame, path: str) -> None:
    """Ground truth as CSV with all columns that readers expect; what ``truth`` lacks stays empty."""
    names = [x.split(" ")[0] for x in GROUND_TRUTH.split(", ")]
    truth.select(*[F.col(n) if n in truth.columns else F.lit(None).cast("string").alias(n) for n in names]).write.mode("overwrite").csv(path, header=True)


def write_samples(cases: DataFrame, path: str, n: int = 3) -> None:
    """The texts of the first ``n`` cases by id, a folder for each case and side."""
    few = cases.orderBy("case_id").limit(n)
    sides = F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(f"{s}_text").alias("text")) for s in ("jd", "resume")])).alias("s")
    few.select("case_id", sides).select("case_id", "s.side", "s.text").write.mode("overwrite").partitionBy("case_id", "side").text(path)


def read_written_samples(spark: SparkSession, path: str) -> DataFrame:
    """``case_id, jd_text, resume_text`` of written samples, without the line end that each file closes with."""
    rows = spark.read.text(path, wholetext=True).withColumn("value", F.expr("left(value, char_length(value) - 1)"))
    one = lambda side: rows.where(F.col("side") == side).select("case_id", F.col("value").alias(f"{side}_text"))
    return one("jd").join(one("resume"), "case_id")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """Knowledge base chunks, trimmed, ids filled in by position; a chunk over the upper bound raises on use."""
    inner = T._parse_datatype_string("array<struct<" + ",".join(x.replace(" ", ":", 1) for x in CHUNKS.split(", ")) + ">>")
    text = spark.read.text(path, wholetext=True)
    listed, nested = F.from_json("value", inner), F.from_json("value", T.StructType([T.StructField("chunks", inner)]))["chunks"]
    rows = text.select(F.posexplode(F.when(F.trim("value").startswith("["), listed).otherwise(nested)).alias("ordinal", "c"))
    body = F.trim("c.text")
    most = CHUNK_CHARS[1]
    return rows.select(
        F.coalesce("c.id", F.format_string("chunk_%03d", F.col("ordinal"))).alias("id"), "c.source", "c.family", "c.tags",
        F.when(F.char_length(body) > most, F.raise_error(F.lit(f"a chunk is longer than {most} characters")).cast("string")).otherwise(body).alias("text"),
    )


def validate_chunks(chunks: DataFrame) -> DataFrame:
    """Problems of a knowledge base: ``id, problem``."""
    n = F.char_length("text")
    repeated = chunks.groupBy("id").count().where("count > 1").select("id", F.lit("duplicate id").alias("problem"))
    own = chunks.select("id", F.explode(F.array_compact(F.array(
        F.when(n < CHUNK_CHARS[0], "too short"), F.when(n > CHUNK_CHARS[1], "too long"), F.when(F.coalesce(F.trim("source"), F.lit("")) == "", "no source"),
    ))).alias("problem"))
    return own.union(repeated)


def chunk_stats(chunks: DataFrame) -> DataFrame:
    """Per family: count and smallest, median (upper) and largest length."""
    sized = chunks.withColumn("_n", F.char_length("text"))
    stats = sized.groupBy("family").agg(F.count("*").alias("chunks"), F.min("_n").alias("shortest"), F.max("_n").alias("longest"))
    return with_quantiles(stats, sized, ["family"], "_n", {"median": ("upper", 0.5)}).withColumn("median", F.col("median").cast("int"))


def read_ground_truth(spark: SparkSession, path: str) -> DataFrame:
    """Ground truth of a CSV; of several rows of a case the last wins."""
    rows = spark.read.csv(path, schema=GROUND_TRUTH, header=True).select("*", place().alias("_n"))
    last = rows.groupBy("case_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("case_id", "_n")]), "_n").alias("r")).select("case_id", "r.*")
    return last.withColumns({"hard_case": F.col("hard_case") == 1, "should_abstain": F.col("should_abstain") == 1})


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """JSON Lines of runs with their place as ``ordinal``, later appended ones last; blank lines are skipped, malformed ones give null fields."""
    return spark.read.schema(RUN_LOG).json(path).select("*", place().alias("ordinal"))


def append_run_log(df: DataFrame, path: str) -> None:
    """Append records as JSON Lines; texts under text-like keys, at any depth, are kept only as fingerprints."""
    df.select(*[records.scrub(df[f"`{f.name}`"], f.dataType, f.name).alias(f.name) for f in df.schema]).write.mode("append").json(path)


def read_timers(spark: SparkSession, path: str) -> DataFrame:
    """Timer rows in file order; a missing file is an empty table."""
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{TIMERS}, ordinal {PLACE}")
    return spark.read.csv(path, schema=TIMERS, header=True).select("*", place().alias("ordinal"))


def read_form_schema(spark: SparkSession, path: str) -> DataFrame:
    """Fields of a form schema in order; a missing file has none."""
    if not _exists(spark, path):
        return spark.createDataFrame([], FORM_SCHEMA + ", ordinal int")
    inner = T._parse_datatype_string("fields array<struct<" + ",".join(x.replace(" ", ":", 1) for x in FORM_SCHEMA.split(", ")) + ">>")
    text = spark.read.text(path, wholetext=True).select(F.from_json("value", inner).alias("v"))
    return text.select(F.posexplode("v.fields").alias("ordinal", "f")).select("f.*", "ordinal")


def read_snapshot(spark: SparkSession, path: str, schema: str) -> DataFrame | None:
    """A JSON snapshot; None if it is missing or holds nothing readable."""
    if not _exists(spark, path):
        return None
    rows = spark.read.schema(schema + ", _corrupt string").option("columnNameOfCorruptRecord", "_corrupt").json(path, multiLine=True)
    good = rows.where("_corrupt IS NULL").drop("_corrupt")
    return None if good.isEmpty() else good


def write_csv(df: DataFrame, path: str) -> None:
    """A small result as one CSV with a header."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True)


def scan_text(spark: SparkSession, path: str, pattern: str, skip: str = r"/\.git/", allowed: DataFrame | None = None) -> DataFrame:
    """``file, line_no, line`` of the lines that match; lines containing an ``allowed(file, excerpt)`` excuse drop out."""
    files = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value").where(~F.col("file").rlike(skip))
    hits = files.select("file", F.posexplode(F.split("value", "\r?\n")).alias("line_no", "line")).where(F.col("line").rlike(pattern))
    hits = hits.withColumn("line_no", F.col("line_no") + 1)
    if allowed is None:
        return hits
    marked = cut(hits)
    line = marked.withColumn("_at", F.struct("file", "line_no"))
    excuses = allowed.select(F.col("file").alias("_f"), F.col("excerpt").alias("needle"))
    excused = containment.find(line, excuses, "_at", "line").join(excuses, "needle").where(F.endswith(F.col("_at.file"), F.col("_f")))
    return marked.join(excused.select("_at.file", "_at.line_no").distinct(), ["file", "line_no"], "left_anti")


def read_samples(spark: SparkSession, path: str) -> DataFrame:
    """Sample texts paired by file name, ``<case>_jd.txt`` with ``<case>_resume.txt``: ``case_id, jd_text, resume_text``."""
    rows = spark.read.text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)_(jd|resume)\.txt$", 1).alias("case_id"),
                                                        F.regexp_extract("_metadata.file_name", r"^(.*)_(jd|resume)\.txt$", 2).alias("side"), "value")
    one = lambda side: rows.where(F.col("side") == side).select("case_id", F.col("value").alias(f"{side}_text"))
    return one("jd").join(one("resume"), "case_id")


def chunk_descriptor(chunks: DataFrame) -> dict:
    """What a knowledge base holds, for a run's record: counts per family and a hash over its (few) chunks."""
    stats = {r["family"]: r["chunks"] for r in chunk_stats(chunks).collect()}
    h = chunks.agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.sha2(F.concat_ws("|", "id", "text"), 256))), ""), 256).alias("h")).first()["h"]
    return {"chunks": sum(stats.values()), "families": stats, "sha256": h}
