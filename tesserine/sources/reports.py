"""Test reports in four formats -> (file, case_id, status); status is passed, failed, errored or skipped.

Lines are parsed where they are read and totals are checked per file by one aggregate, so
that many files are one job. A report that cannot be trusted is an error when it is read:
unknown records or states, no cases, no summary where the format has one, or totals that differ from
the cases. A file with several summaries is held to their sum.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed words of the formats.
CARGO = {"ok": "passed", "failed": "failed", "ignored": "skipped"}
PYTEST = {"PASSED": "passed", "XPASS": "passed", "FAILED": "failed", "XFAIL": "failed", "ERROR": "errored", "SKIPPED": "skipped"}
GO, GO_OTHER = {"pass": "passed", "fail": "failed", "skip": "skipped"}, ("run", "pause", "cont", "output", "start", "bench")
VITEST = {"passed": "passed", "failed": "failed", "skipped": "skipped", "pending": "skipped", "todo": "skipped"}


def _lines(spark: SparkSession, path: str, whole: bool = False) -> DataFrame:
    return spark.read.text(path, wholetext=whole).select(F.col("_metadata.file_path").alias("file"), F.trim("value").alias("line")).where("line <> ''")


def _word(c: Column, words: dict[str, str]) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), c)


def _refused(message: str, *parts: Column | str) -> Column:
    return F.raise_error(F.concat_ws(" ", F.lit(message), *[F.col(p) if isinstance(p, str) else p for p in parts]))


def _checked(cases: DataFrame, summaries: DataFrame | None, files: DataFrame) -> DataFrame:
    """Cases of files whose totals agree with ``summaries`` (file, passed, failed, errored, skipped; null counts are not given)."""
    states = ("passed", "failed", "errored", "skipped")
    got = cases.groupBy("file").agg(*[F.count_if(F.col("status") == s).alias(f"got_{s}") for s in states])
    j = files.distinct().join(got, "file", "left")
    fault = F.when(F.col("got_passed").isNull(), "no cases")
    if summaries is not None:
        told = summaries.groupBy("file").agg(*[F.sum(s).alias(s) for s in states], F.lit(True).alias("told"))
        j = j.join(told, "file", "left")
        fault = fault.when(F.col("told").isNull(), "no summary")
        for s in states:
            fault = fault.when(F.col(s).isNotNull() & (F.col(s) != F.col(f"got_{s}")), f"the summary disagrees on {s}")
    bad = j.withColumn("fault", fault).where("fault IS NOT NULL").select("file", "fault").first()
    if bad is not None:
        raise ValueError(f"test report {bad['file']}: {bad['fault']}")
    return cases.select("file", "case_id", "status")


def cargo_json(spark: SparkSession, path: str) -> DataFrame:
    """libtest's JSON lines."""
    lines = _lines(spark, path)
    r = lines.select("file", "line", F.from_json("line", "type string, event string, name string, passed long, failed long, ignored long").alias("r")).select("file", "line", "r.*")
    r = r.withColumn("type", F.when(F.coalesce("type", F.lit("")).isin("suite", "test", "bench"), F.col("type")).otherwise(_refused("unknown record:", "line")))
    tests = r.where("type = 'test' AND coalesce(event, '') <> 'started'")
    status = F.coalesce(F.when(F.col("name").isNotNull(), _word(F.col("event"), CARGO)), _refused("unknown test event:", "line"))
    cases = tests.select("file", F.col("name").alias("case_id"), status.alias("status"))
    none = F.lit(None).cast("long")
    sums = r.where("type = 'suite' AND event IN ('ok', 'failed')").select("file", *[F.coalesce(c, F.lit(0)).alias(n) for c, n in (("passed", "passed"), ("failed", "failed"), ("ignored", "skipped"))], none.alias("errored"))
    return _checked(cases, sums, lines.select("file"))


def pytest_text(spark: SparkSession, path: str) -> DataFrame:
    """The terminal output of pytest -v."""
    lines = _lines(spark, path)
    parts = F.split("line", r"\s+")
    cases = lines.select("file", F.get(parts, 0).alias("case_id"), _word(F.get(parts, 1), PYTEST).alias("status")).where(F.col("case_id").contains("::") & F.col("status").isNotNull())
    sums = lines.where(F.col("line").startswith("==") & F.col("line").endswith("==") & F.col("line").contains(" in "))
    count = lambda word: F.coalesce(F.nullif(F.regexp_extract("line", rf"(?:^|[,= ])(\d+) {word}\b", 1), F.lit("")).cast("long"), F.lit(0))
    sums = sums.select("file", count("passed").alias("passed"), count("failed").alias("failed"), count("errors?").alias("errored"), count("skipped").alias("skipped"))
    return _checked(cases, sums, lines.select("file"))


def go_json(spark: SparkSession, path: str) -> DataFrame:
    """Events of go test -json; those of a package as a whole are no cases."""
    lines = _lines(spark, path)
    r = lines.select("file", "line", F.from_json("line", "Action string, Test string, Package string").alias("r")).select("file", "line", "r.*")
    action = F.when(F.col("Action").isNull(), _refused("no action:", "line")).when(F.col("Test").isNull() | F.col("Action").isin(*GO, *GO_OTHER), F.col("Action")).otherwise(_refused("unknown action:", "line"))
    r = r.withColumn("Action", action).withColumn("status", _word(F.col("Action"), GO)).where("Test IS NOT NULL AND status IS NOT NULL")
    name = F.when(F.coalesce("Package", F.lit("")) == "", F.col("Test")).otherwise(F.concat_ws("::", "Package", "Test"))
    return _checked(r.select("file", name.alias("case_id"), "status"), None, lines.select("file"))


def vitest_json(spark: SparkSession, path: str) -> DataFrame:
    """One JSON document per file, as vitest and jest write it."""
    docs = _lines(spark, path, whole=True)
    one = "array<struct<fullName:string,title:string,status:string>>"
    d = docs.select("file", F.from_json("line", f"numPassedTests long, numFailedTests long, testResults array<struct<name:string,assertionResults:{one}>>").alias("d")).select("file", "d.*")
    f = d.select("file", F.explode(F.coalesce("testResults", _refused("no testResults:", "file").cast(f"array<struct<name:string,assertionResults:{one}>>"))).alias("t"))
    a = f.select("file", F.col("t.name").alias("name"), F.explode(F.coalesce("t.assertionResults", _refused("no assertionResults:", "file").cast(one))).alias("a"))
    title = F.coalesce("a.fullName", "a.title", _refused("assertion without a title:", "file"))
    status = F.coalesce(_word(F.col("a.status"), VITEST), _refused("unknown state:", F.col("a.status")))
    cases = a.select("file", F.when(F.coalesce("name", F.lit("")) == "", title).otherwise(F.concat_ws("::", F.col("name"), title)).alias("case_id"), status.alias("status"))
    none = F.lit(None).cast("long")
    told = lambda c: F.coalesce(c, _refused(f"no {c}:", "file").cast("long"))
    sums = d.select("file", told("numPassedTests").alias("passed"), told("numFailedTests").alias("failed"), none.alias("errored"), none.alias("skipped"))
    return _checked(cases, sums, docs.select("file"))
