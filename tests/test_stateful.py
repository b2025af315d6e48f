"""Keyed state over streams equals the batch forms, also after a restart in the middle; batch forms equal plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.streaming import ingest, stateful

WINDOW, BOUND, LEAST, QUIET, CAPACITY = 8, 0.4, 25, 5, 10
KINDS = {
    "drift": (lambda: stateful.DriftAlarm(WINDOW, BOUND), lambda r: stateful.drift_alarms(r, WINDOW, BOUND)),
    "recurs": (lambda: stateful.Recurs(LEAST), lambda r: stateful.recurrences(r, LEAST)),
    "incident": (lambda: stateful.Incident(QUIET), lambda r: stateful.incidents(r, QUIET)),
    "queue": (lambda: stateful.Queue(CAPACITY), lambda r: stateful.lost(r, CAPACITY)),
}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    data = [(f"k{k}", 100 * k + i, bool(rng.random() < (0.5 if (i // 15) % 2 else 0.1))) for k in range(6) for i in range([60, 60, 25, 24, 7, 1][k])]
    return spark.createDataFrame(data, "key string, seq long, failed boolean").orderBy(F.rand(1)).cache()


@pytest.mark.parametrize("kind", KINDS)
def test_stream_with_a_restart_equals_batch(spark, rows, kind, tmp_path):
    stateful.use_rocks(spark)
    processor, batch = KINDS[kind]
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        stream = stateful.told(ingest.read(spark, source, rows.schema, 1), processor())
        q = stream.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start(sink)
        q.awaitTermination(300)
        assert q.exception() is None

    part = F.pmod("seq", F.lit(100))
    # Each write is one later stretch of every key's rows; the query is stopped after the second one.
    for k, (lo, hi) in enumerate([(0, 9), (9, 22), (22, 41), (41, 100)]):
        rows.where((part >= lo) & (part < hi)).coalesce(1).write.mode("append").parquet(source)
        if k in (1, 3):
            run()
    want = sorted(map(tuple, batch(rows).collect()))
    assert want and sorted(map(tuple, spark.read.parquet(sink).select(*batch(rows).columns).collect())) == want


def test_batch_forms_against_plain_loops(rows):
    by: dict[str, list] = {}
    for r in sorted(rows.collect(), key=lambda r: r.seq):
        by.setdefault(r.key, []).append((r.seq, r.failed))
    for kind, (processor, batch) in KINDS.items():
        p, want = processor(), []
        for key, seen in by.items():
            at = p.start
            for seq, failed in seen:
                at, more = p.step(at, type("Row", (), {"seq": seq, "failed": failed}))
                want += [(key, *m.values()) for m in more]
        assert sorted(want) == sorted(map(tuple, batch(rows).collect())), kind


def test_drift_is_silent_until_its_window_is_full():
    p, at = stateful.DriftAlarm(4, 0.25), ("", False)
    told = []
    for seq, failed in enumerate([1, 1, 1, 0, 0, 0, 0, 0, 1, 1, 1, 1]):
        at, more = p.step(at, type("Row", (), {"seq": seq, "failed": bool(failed)}))
        told += [m["seq"] for m in more]
    assert told == [3, 9]


def test_queue_capacity():
    with pytest.raises(ValueError):
        stateful.Queue(0)
