"""Readers: test reports, vector files, spans and blobs."""

import hashlib
import json

import numpy as np
import pytest

from tesserine.sources import readers, reports

CARGO = [
    {"type": "suite", "event": "started", "test_count": 3}, {"type": "test", "event": "started", "name": "a::one"}, {"type": "test", "event": "ok", "name": "a::one"},
    {"type": "test", "event": "failed", "name": "a::two"}, {"type": "test", "event": "ignored", "name": "a::three"}, {"type": "suite", "event": "failed", "passed": 1, "failed": 1, "ignored": 1},
]
PYTEST = """== test session starts ==
t/x.py::a PASSED  [ 10%]
t/x.py::b[1] FAILED
t/x.py::c ERROR
t/x.py::d SKIPPED (why)
t/x.py::e XPASS
t/x.py::f XFAIL
t/x.py::g something
== 2 failed, 2 passed, 1 skipped, 1 error in 0.1s ==
"""
GO = [{"Action": "start", "Package": "p"}, {"Action": "run", "Package": "p", "Test": "A"}, {"Action": "pass", "Package": "p", "Test": "A"}, {"Action": "fail", "Test": "B"}, {"Action": "skip", "Package": "p", "Test": "C"}, {"Action": "fail", "Package": "p"}]
VITEST = {"numPassedTests": 1, "numFailedTests": 1, "testResults": [{"name": "a.ts", "assertionResults": [{"fullName": "s one", "status": "passed"}, {"title": "two", "status": "failed"}]}, {"assertionResults": [{"title": "three", "status": "todo"}]}]}


def lines(rows):
    return "\n".join(map(json.dumps, rows)) + "\n"


def read(spark, reader, tmp_path, *texts):
    for k, t in enumerate(texts):
        (tmp_path / f"r{k}.txt").write_text(t)
    return sorted((r.file.rsplit("/", 1)[1], r.case_id, r.status) for r in reader(spark, str(tmp_path)).collect())


def test_cargo(spark, tmp_path):
    got = read(spark, reports.cargo_json, tmp_path, lines(CARGO), lines([CARGO[2], {**CARGO[5], "failed": 0, "ignored": 0}]))
    assert got == [("r0.txt", "a::one", "passed"), ("r0.txt", "a::three", "skipped"), ("r0.txt", "a::two", "failed"), ("r1.txt", "a::one", "passed")]


@pytest.mark.parametrize(
    "rows, fault",
    [
        (CARGO[:-1], "no summary"), (CARGO[:3] + CARGO[-1:], "disagrees"), ([CARGO[0]], "no cases"), ([{"type": "odd"}, *CARGO], "unknown record"),
        ([{"type": "test", "event": "maybe", "name": "x"}, *CARGO], "unknown test event"), ([{"type": "test", "event": "ok"}, *CARGO], "unknown test event"),
    ],
)
def test_cargo_refuses(spark, tmp_path, rows, fault):
    with pytest.raises(Exception, match=fault):
        read(spark, reports.cargo_json, tmp_path, lines(rows))


def test_pytest(spark, tmp_path):
    got = read(spark, reports.pytest_text, tmp_path, PYTEST)
    assert [(c[-1] if c[-1] != "]" else "b", s) for _, c, s in got] == [("a", "passed"), ("b", "failed"), ("c", "errored"), ("d", "skipped"), ("e", "passed"), ("f", "failed")]
    with pytest.raises(Exception, match="disagrees on errored"):
        read(spark, reports.pytest_text, tmp_path, PYTEST.replace("1 error in", "4 errors in"))


def test_go(spark, tmp_path):
    assert [x[1:] for x in read(spark, reports.go_json, tmp_path, lines(GO))] == [("B", "failed"), ("p::A", "passed"), ("p::C", "skipped")]
    with pytest.raises(Exception, match="unknown action"):
        read(spark, reports.go_json, tmp_path, lines([*GO, {"Action": "odd", "Test": "x"}]))


def test_vitest(spark, tmp_path):
    assert [x[1:] for x in read(spark, reports.vitest_json, tmp_path, json.dumps(VITEST, indent=1))] == [("a.ts::s one", "passed"), ("a.ts::two", "failed"), ("three", "skipped")]
    for bad, fault in (({**VITEST, "numPassedTests": 2}, "disagrees on passed"), ({k: v for k, v in VITEST.items() if k != "numFailedTests"}, "no numFailedTests"), ({"numPassedTests": 0, "numFailedTests": 0}, "no testResults")):
        with pytest.raises(Exception, match=fault):
            read(spark, reports.vitest_json, tmp_path, json.dumps(bad))


def test_junit(spark, tmp_path):
    (tmp_path / "j.xml").write_text('<testsuite><testcase classname="c" name="a" time="0.5"/><testcase classname="c" name="b" time="1"><failure>no</failure></testcase></testsuite>')
    assert sorted(map(tuple, readers.junit(spark, str(tmp_path)).collect())) == [("c", "a", 0.5, False), ("c", "b", 1.0, True)]


def test_vector_files(spark, tmp_path):
    m = np.arange(12, dtype="<f4").reshape(4, 3) / 2
    (tmp_path / "v.bin").write_bytes(m.tobytes())
    got = readers.vector_files(spark, str(tmp_path), "f32", 3).orderBy("row").collect()
    assert [r.vector for r in got] == m.tolist() and [r.row for r in got] == [0, 1, 2, 3]
    with pytest.raises(Exception, match="multiple of a row"):
        readers.vector_files(spark, str(tmp_path), "f32", 5).collect()


def test_spans(spark):
    span = {"name": "GET", "startTimeUnixNano": "1000000", "endTimeUnixNano": "3500000", "attributes": [{"key": "http.url", "value": {"stringValue": "http://h/a/b?c=1"}}, {"key": "http.status_code", "value": {"intValue": "503"}}]}
    line = json.dumps({"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "shop"}}]}, "scopeSpans": [{"spans": [span]}]}]})
    assert [tuple(r) for r in readers.spans(spark.createDataFrame([(line,)], "l string"), "l").collect()] == [("shop", "GET", "/a/b", 503, 2.5)]


def test_blob(spark):
    parts = [(1, 1, b"cd"), (1, 0, b"ab"), (2, 0, b"")]
    got = {r.blob_id: (r.n, r["size"], r.sha256) for r in readers.blob(spark.createDataFrame(parts, "blob_id long, idx long, bytes binary")).collect()}
    assert got == {1: (2, 4, hashlib.sha256(b"abcd").hexdigest()), 2: (1, 0, hashlib.sha256(b"").hexdigest())}
