"""Queries of the batch forms in streaming/stateful.py: an event of type ``error`` is a failure."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..registry import query, r6, read
from ..streaming import stateful as X

_ROWS = "r AS (SELECT user_id AS key, event_id AS seq, event_type = 'error' AS failed FROM events)"


def _rows(s, d):
    return read(s, d, "events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), (F.col("event_type") == "error").alias("failed"))


@query(
    "drift_alarms",
    f"""WITH {_ROWS}, w AS (SELECT *, avg(CAST(failed AS DOUBLE)) OVER x AS rate, count(*) OVER x = 20 AS whole FROM r WINDOW x AS (PARTITION BY key ORDER BY seq ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
    a AS (SELECT *, whole AND rate > 0.3 AS above FROM w), p AS (SELECT *, coalesce(lag(above) OVER (PARTITION BY key ORDER BY seq), false) AS was FROM a)
    SELECT key, seq, round(rate, 6) AS rate FROM p WHERE above AND NOT was""",
)
def _(s, d):
    return X.drift_alarms(_rows(s, d), 20, 0.3).withColumn("rate", r6("rate"))


@query("recurrence_crossings", f"WITH {_ROWS} SELECT key, seq, n FROM (SELECT key, seq, row_number() OVER (PARTITION BY key ORDER BY seq) AS n FROM r) WHERE n = 40")
def _(s, d):
    return X.recurrences(_rows(s, d), 40)


@query(
    "incidents",
    f"""WITH {_ROWS}, k AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY seq) AS k FROM r),
    l AS (SELECT *, max(CASE WHEN failed THEN k END) OVER (PARTITION BY key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last FROM k)
    SELECT key, seq, CASE WHEN failed THEN 'open' ELSE 'close' END AS event FROM l WHERE (failed AND (last IS NULL OR k - last > 5)) OR (NOT failed AND k - last = 5)""",
)
def _(s, d):
    return X.incidents(_rows(s, d), 5)


@query("queue_losses", f"WITH {_ROWS} SELECT key, seq, lost_at FROM (SELECT key, seq, lead(seq, 30) OVER (PARTITION BY key ORDER BY seq) AS lost_at FROM r) WHERE lost_at IS NOT NULL")
def _(s, d):
    return X.lost(_rows(s, d), 30)
