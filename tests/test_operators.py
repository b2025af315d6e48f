import pytest
from pyspark.sql import functions as F

from tesserine import registry
from tesserine.functions import predicates as P
from tesserine.functions import vectors as V
from tesserine.operators import estimators, graph, guard, layers, recurrence
from tesserine.plans.cypher import Cypher
from tesserine.plans.universal import UniversalQuery


def ids(df, col="id"):
    return sorted(r[col] for r in df.select(col).collect())


@pytest.fixture(scope="module")
def records(spark):
    return spark.createDataFrame([(1, 1.0, "ab", True), (2, None, "b", False), (3, 3.0, None, None)], "id long, a double, b string, c boolean")


def test_missing_field_fails_every_predicate(records):
    for op in P.OPS:
        assert ids(P.where_all(records, [("zz", op, "x")])) == []


def test_ne_passes_null_and_incomparable(records):
    assert ids(P.where_all(records, [("a", "ne", 1)])) == [2, 3]
    assert ids(P.where_all(records, [("a", "ne", "text")])) == [1, 2, 3]
    assert ids(P.where_all(records, [("c", "eq", True)])) == []
    assert ids(P.where_all(records, [("c", "ne", True)])) == [1, 2, 3]


def test_contains_and_range(records):
    assert ids(P.where_all(records, [("b", "contains", "b")])) == [1, 2]
    assert ids(layers.range_scan(records, "id", 1, 3, 10)) == [1, 2]
    assert ids(layers.range_scan(records, "id", 1, 3, 0)) == []


def test_non_finite_value_is_refused(records):
    with pytest.raises(ValueError):
        P.field_predicate(records, "a", "eq", float("nan"))


def test_ttl(spark):
    kv = spark.createDataFrame([(1, 0), (2, 10), (3, 11)], "id long, expires_at long")
    assert ids(kv.where(P.live(10))) == [1, 3]


def test_rollup_counts_rewrites_and_points_keep_the_last(spark):
    p = spark.createDataFrame([(1, 5, 1.0, 1), (1, 5, 3.0, 2), (1, 65, 2.0, 3)], "series long, t long, val double, seq long")
    assert sorted((r.window_start, r.n, r.total) for r in layers.rollup(p, "1m").collect()) == [(0, 2, 4.0), (60, 1, 2.0)]
    assert sorted((r.t, r.val) for r in layers.latest(p, ["series", "t"], "seq").collect()) == [(5, 3.0), (65, 2.0)]


def test_cosine_of_zero_and_other_length_is_null(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([1.0],), ([3.0, 4.0],)], "v array<double>")
    got = [r[0] for r in df.select(V.cosine(F.col("v"), V.literal([3.0, 4.0]))).collect()]
    assert got[:2] == [None, None] and abs(got[2] - 1) < 1e-12


def test_series(spark):
    occ = spark.createDataFrame([("a", 0), ("a", 10), ("a", 30), ("b", 5), ("c", 1), ("c", 3)], "key string, t long")
    assert {r.key: r.cadence for r in recurrence.cadence(occ).collect()} == {"a": 15.0, "b": None, "c": 2.0}
    assert {r.key: r.novelty for r in recurrence.novelty(occ, 1000).collect()} == {"a": "Overdue", "b": "NonRecurring", "c": "Recurring"}
    assert [(r.key, r.next_t, r.mad) for r in recurrence.next_occurrence(occ).collect()] == [("a", 45, 5.0)]


def test_band_join_is_strict(spark):
    a = spark.createDataFrame([(0, 100)], "id long, t long")
    b = spark.createDataFrame([(1, 110), (2, 109), (3, 91), (4, 90)], "id long, t long")
    assert ids(recurrence.co_occurrence(a, b, 10), "idb") == [2, 3]


def test_bfs_cap_and_cycle(spark):
    e = spark.createDataFrame([("a", "b", 1.0), ("b", "a", 0.5), ("b", "c", 0.5), ("c", "c", 1.0)], "src string, dst string, weight double")
    assert sorted((r.node, r.hop) for r in graph.bfs(e, ["a"], 3).collect()) == [("b", 1), ("c", 2)]
    with pytest.raises(RuntimeError):
        graph.bfs(e, ["a"], 3, cap=1)
    with pytest.raises(ValueError):
        graph.bfs(e, ["a"], 11)
    assert {r.node: round(r.score, 6) for r in graph.scored_traverse(e, "a", 2).collect()} == {"b": 0.9, "c": 0.405}


def test_chain_breaks(spark):
    import hashlib

    def h(p, x):
        return hashlib.sha256(f"{p}|{x}".encode()).hexdigest()

    a = h("0", "a")
    b = h(a, "b")
    good = [(0, "0", a, "a"), (1, a, b, "b")]
    schema = "seq long, prev_hash string, entry_hash string, payload string"
    assert guard.verify_chain(spark.createDataFrame(good, schema)).count() == 0
    bad = spark.createDataFrame([good[0], (1, a, b, "x"), (4, b, h(b, "c"), "c")], schema)
    assert [(r.seq, r.state) for r in guard.verify_chain(bad).orderBy("seq").collect()] == [(1, "broken"), (4, "corrupt")]


def test_estimators_refuse_small_samples(spark):
    df = spark.range(10).select(F.col("id").cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    with pytest.raises(Exception, match="needs 50"):
        estimators.ksg_mi(df, "x", "y").collect()
    assert abs(estimators.distance_correlation(df, "x", "y").first().dcor - 1) < 1e-9


def test_universal_query_cap(spark, records):
    with pytest.raises(RuntimeError):
        UniversalQuery(relational=(records, []), cap_ms=1).run()
    assert UniversalQuery(relational=(records, [("a", "gte", 0)]), aggregate=("avg", "a")).run().first().value == 2.0


def test_cypher_refuses_writes(spark):
    n = spark.createDataFrame([("1", "A", "x")], "id string, label string, name string")
    e = spark.createDataFrame([("1", "1", "T")], "src string, dst string, type string")
    c = Cypher(n, e)
    with pytest.raises(ValueError):
        c.run("CREATE (a) RETURN a.name")
    assert c.run('MATCH (a:A {name: "x"})-[:T]->(b) RETURN b.name AS n').collect()[0].n == "x"


def test_streaming_rollup_equals_batch(spark, tmp_path):
    from tesserine.streaming import ingest

    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select("user_id", "ts", "value")
    ev.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed(ingest.read(spark, str(tmp_path / "in"), ev.schema, 1), "ts", "user_id", "value", delay="60 days")
    q = stream.writeStream.outputMode("complete").format("memory").queryName("roll").start()
    q.processAllAvailable()
    q.stop()
    from tesserine.functions.temporal import epoch

    batch = layers.rollup(ev.select(F.col("user_id").alias("series"), epoch("ts").alias("t"), F.col("value").alias("val")), "1h")
    cols = ["series", "window_start", "n", F.round("total", 6).alias("total"), "low", "high"]
    assert spark.table("roll").select(*cols).exceptAll(batch.select(*cols)).count() == 0
    assert spark.table("roll").count() == batch.count()


def test_ingest_is_idempotent(spark, tmp_path):
    from tesserine.streaming import ingest

    df = spark.range(20).toDF("id")
    df.write.parquet(str(tmp_path / "in"))
    for _ in range(2):
        ingest.ingest(ingest.read(spark, str(tmp_path / "in"), df.schema), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 20


def test_ledger_queries_find_planted_faults(spark, monkeypatch):
    """Payload, link and gap faults in real chains, all through verify_chain."""
    calls, real = [], guard.verify_chain
    monkeypatch.setattr(guard, "verify_chain", lambda *a: calls.append(a) or real(*a))
    sf = "/root/testdata/sf0.001"
    assert {r.seq % 97 for r in registry.queries()["ledger_verify"](spark, sf).collect()} == {96}
    got = {(r.user_id, r.seq): r.state for r in registry.queries()["ledger_faults"](spark, sf).collect()}
    assert len(calls) == 2
    users, expected = {}, {}
    for r in spark.read.parquet(f"{sf}/events.parquet").select("user_id", "event_id").orderBy("event_id").collect():
        users.setdefault(r.user_id, []).append(r.event_id)
    for user, ids in users.items():
        before = None
        for seq, i in enumerate(ids):
            if i % 83 == 82:
                continue
            if before is not None and seq - before != 1:
                expected[user, seq] = "corrupt"
            elif i % 97 == 96 or before is not None and (i % 89 == 88 or ids[before] % 89 == 88) or i % 89 == 88 and i % 97 == 96:
                expected[user, seq] = "broken"
            before = seq
    assert got == expected and set(got.values()) == {"broken", "corrupt"}


def test_cypher_caps_raise(spark):
    from tesserine.plans.cypher import MAX_ROWS

    n = spark.createDataFrame([(f"{i}", "A", f"x{i}") for i in range(14)], "id string, label string, name string")
    path = spark.createDataFrame([(f"{i}", f"{i + 1}", "T") for i in range(13)], "src string, dst string, type string")
    c = Cypher(n, path)
    for span in ("*", "*2.."):
        with pytest.raises(RuntimeError, match="paths go on"):
            c.run(f"MATCH (a)-[:T{span}]->(b) RETURN b.name AS n")
    for span in ("*1..20", "*12"):
        with pytest.raises(ValueError, match="hops"):
            c.run(f"MATCH (a)-[:T{span}]->(b) RETURN b.name AS n")
    with pytest.raises(ValueError, match="LIMIT"):
        c.run(f"MATCH (a)-[:T]->(b) RETURN b.name AS n LIMIT {MAX_ROWS + 1}")
    short = Cypher(n, path.where("int(src) < 3"))
    assert short.run("MATCH (a)-[:T*]->(b) RETURN a.name AS a, b.name AS b").count() == 6
