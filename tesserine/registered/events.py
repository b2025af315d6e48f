"""Queries of operators/events.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import temporal as T
from ..operators import events as X
from ..registry import _CAD, _DAY, _HOUR, _OCC, _RANKED, _SLOTS, EPOCH, NOW, _occ, _ranked, _slots, query, r6, read

_GAPS = f"(SELECT key, t, t - lag(t) OVER (PARTITION BY key ORDER BY t) AS gap FROM {_OCC})"


@query(
    "cusum",
    f"""WITH g AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t, gap) AS i, count(*) OVER (PARTITION BY key) AS n FROM {_GAPS} WHERE gap IS NOT NULL),
    b AS (SELECT *, avg(CASE WHEN i <= greatest(n // 2, 2) THEN gap END) OVER (PARTITION BY key) AS mu, stddev_pop(CASE WHEN i <= greatest(n // 2, 2) THEN gap END) OVER (PARTITION BY key) AS sd FROM g WHERE n >= 4),
    z AS (SELECT *, (gap - mu) / greatest(sd, 0.001::DOUBLE * mu) AS z FROM b),
    s AS (SELECT *, sum(z - 0.5::DOUBLE) OVER w AS a, sum(-z - 0.5::DOUBLE) OVER w AS d FROM z WINDOW w AS (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING)),
    c AS (SELECT *, a - least(min(a) OVER w, 0) AS up, d - least(min(d) OVER w, 0) AS down FROM s WINDOW w AS (PARTITION BY key ORDER BY i ROWS UNBOUNDED PRECEDING))
    SELECT key, max(n) AS n_gaps, round(max(up), 6) AS max_up, round(max(down), 6) AS max_down, CAST(min(i) FILTER (WHERE up > 5 OR down > 5) AS INTEGER) AS change_gap,
           arg_min(CASE WHEN up > 5 THEN 'slow_down' ELSE 'speed_up' END, i) FILTER (WHERE up > 5 OR down > 5) AS shift FROM c GROUP BY key""",
)
def _(s, d):
    return X.cusum(_occ(s, d)).withColumns({"max_up": r6("max_up"), "max_down": r6("max_down")})


@query(
    "renewal_moments",
    f"""WITH l AS (SELECT key, max(t) AS last_t FROM {_OCC} GROUP BY key), g AS (SELECT g.*, last_t, {NOW} - last_t AS elapsed FROM {_GAPS} g JOIN l USING (key) WHERE gap IS NOT NULL)
    SELECT key, n_gaps, round(mean, 4) AS mean_gap, round(sqrt(var) / mean, 6) AS cv, round(mean * mean / var, 6) AS shape, elapsed, round(emp, 6) AS empirical_survival, round(last_t + mean, 3) AS expected_next
    FROM (SELECT key, last_t, elapsed, count(*) AS n_gaps, avg(gap) AS mean, var_pop(gap) AS var, avg(CASE WHEN gap >= elapsed THEN 1.0::DOUBLE ELSE 0 END) AS emp FROM g GROUP BY 1, 2, 3) WHERE n_gaps >= 3 AND mean > 0""",
)
def _(s, d):
    h = X.hazard(_occ(s, d), NOW)
    return h.select("key", "n_gaps", F.round("mean_gap", 4).alias("mean_gap"), r6("cv").alias("cv"), r6("shape").alias("shape"), "elapsed", r6("empirical_survival").alias("empirical_survival"), F.round("expected_next", 3).alias("expected_next"))


query("renewal_hazard")(lambda s, d: X.hazard(_occ(s, d), NOW))


@query(
    "predicted_interval",
    f"""WITH g AS (SELECT * FROM {_GAPS}), m AS (SELECT g.key, quantile_cont(abs(gap - cadence), 0.5) AS mad FROM g JOIN {_CAD} c ON g.key = c.key WHERE gap IS NOT NULL GROUP BY g.key),
    o AS (SELECT key, t % 86400 // 3600 AS h, (t // 86400 + 3) % 7 AS w FROM {_OCC}),
    sh AS (SELECT key, max(c) AS h FROM (SELECT key, h, count(*) AS c FROM o GROUP BY 1, 2) GROUP BY key), sw AS (SELECT key, max(c) AS w FROM (SELECT key, w, count(*) AS c FROM o GROUP BY 1, 2) GROUP BY key),
    b AS (SELECT key, max(c) AS hw FROM (SELECT key, h, w, count(*) AS c FROM o GROUP BY 1, 2, 3) GROUP BY key),
    p AS (SELECT c.key, last_t + CAST(round(cadence) AS BIGINT) AS next_t, mad, cadence, greatest(0, least(1, 1 - mad / cadence)) * least(n / 12.0::DOUBLE, 1) * (greatest(h, w, hw) / CAST(n AS DOUBLE)) AS conf
          FROM {_CAD} c JOIN m USING (key) JOIN sh USING (key) JOIN sw USING (key) JOIN b USING (key) WHERE n >= 3 AND cadence > 0)
    SELECT key, next_t, round(conf, 6) AS confidence, next_t - CAST(round(greatest(mad, cadence * (1 - conf))) AS BIGINT) AS low_t, next_t + CAST(round(greatest(mad, cadence * (1 - conf))) AS BIGINT) AS high_t FROM p""",
)
def _(s, d):
    return X.predicted(_occ(s, d)).withColumn("confidence", r6("confidence"))


@query(
    "periodic_recall",
    f"""WITH c AS (SELECT key, t % 86400 // 3600 AS h, count(*) AS c FROM {_OCC} GROUP BY 1, 2), m AS (SELECT key, sum(c) AS n, max(c) AS top, arg_max(h, c) AS h, list(c) AS cs FROM c GROUP BY key)
    SELECT key, CAST(n AS BIGINT) AS n FROM m WHERE n >= 2 AND h = 14 AND len([x FOR x IN cs IF x = top]) = 1""",
)
def _(s, d):
    return X.periodic_recall(_occ(s, d), hour=14)


@query(
    "occurrence_rollup",
    f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY t DESC) > 5 OR t < {NOW} - 1728000 AS old FROM {_OCC})
    SELECT key, count(*) FILTER (WHERE NOT old) AS active, count(*) FILTER (WHERE old) AS rolled, min(t) FILTER (WHERE old) AS rolled_first, max(t) FILTER (WHERE old) AS rolled_last FROM r GROUP BY key""",
)
def _(s, d):
    return X.rolled_up(_occ(s, d), NOW, keep=5, max_age=20 * 86_400)


@query("trigger_recurs", f"SELECT * FROM (SELECT key, count(*) FILTER (WHERE t < {NOW - 432000}) AS before, count(*) AS now FROM {_OCC} GROUP BY key) WHERE before < 3 AND now >= 3")
def _(s, d):
    return X.recurs(_occ(s, d), NOW - 432_000, 3)


@query("trigger_drift", f"SELECT slot, round(b, 6) AS before, round(a, 6) AS after, round(a - b, 6) AS delta FROM (SELECT slot, avg(score) FILTER (WHERE cx_id % 2 = 0) AS b, avg(score) FILTER (WHERE cx_id % 2 = 1) AS a FROM {_SLOTS} GROUP BY slot) WHERE abs(a - b) >= 0.001")
def _(s, d):
    out = X.drifted(_slots(s, d), F.col("cx_id") % 2 == 1, 0.001)
    return out.select("slot", *[r6(c).alias(c) for c in ("before", "after", "delta")])


@query("trigger_new_region", f"SELECT cx_id, max(score) AS nearest FROM {_SLOTS} GROUP BY cx_id HAVING max(score) < 0.3")
def _(s, d):
    near = _slots(s, d).groupBy("cx_id").agg(F.max("score").alias("nearest"))
    return X.new_region(near, "nearest", 0.3)


@query("trace_promotion", "SELECT path, weight, round(rate, 6) AS error_rate, rate >= 0.2 AS incident FROM (SELECT '/' || event_type AS path, count(*) AS weight, avg(CASE WHEN event_id % 5 = 0 THEN 1.0::DOUBLE ELSE 0 END) AS rate FROM events WHERE event_type <> 'signup' GROUP BY 1)")
def _(s, d):
    e = read(s, d, "events")
    spans = e.select(F.col("event_id").alias("span_id"), F.concat(F.lit("/"), F.col("event_type")).alias("path"), F.when(F.col("event_id") % 5 == 0, 503).otherwise(200).alias("status"))
    routes = spans.select("path").distinct().where("path <> '/signup'")
    return X.promoted(spans.unionByName(spans.where("span_id % 3 = 0")), routes, 0.2).withColumn("error_rate", r6("error_rate"))


@query(
    "window_boost_gate",
    f"""WITH h AS (SELECT cx_id, score, rank, {NOW} - cx_id * 3600 AS t FROM {_RANKED} WHERE slot = 0),
    b AS (SELECT *, CASE WHEN score > 0 THEN score + score * 0.1::DOUBLE * exp(-({NOW} - t) * 0.693::DOUBLE / 86400) ELSE score END AS s1 FROM h WHERE t BETWEEN {NOW - 1_000_000} AND {NOW}),
    r AS (SELECT *, row_number() OVER (ORDER BY s1 DESC, rank, cx_id) AS r1 FROM b),
    g AS (SELECT cx_id, s1 * CASE WHEN cx_id % 3 = 0 THEN 1.10::DOUBLE WHEN cx_id % 3 = 1 THEN 0.85::DOUBLE ELSE 1 END AS s2, r1 FROM r)
    SELECT cx_id, round(s2, 6) AS score, CAST(row_number() OVER (ORDER BY s2 DESC, r1, cx_id) AS INTEGER) AS rank FROM g""",
)
def _(s, d):
    hits = _ranked(s, d).where("slot = 0").withColumn("t", F.lit(NOW) - F.col("cx_id") * 3600)
    gate = F.when(F.col("cx_id") % 3 == 0, T.CAUSAL_HIGH).when(F.col("cx_id") % 3 == 1, T.CAUSAL_LOW).otherwise(1.0)
    out = X.boosted_order(hits, NOW - 1_000_000, NOW, T.exponential_decay(F.lit(NOW) - F.col("t"), 86400), F.lit(0.0), gate)
    return out.withColumn("score", r6("score"))


@query("integer_boost", f"SELECT cx_id, score * (1000 + (80 * (CASE WHEN cx_id % 2 = 0 THEN cx_id % 1001 ELSE 0 END)) // 1000) // 1000 AS score FROM (SELECT cx_id, CAST(sum(1000000000 // (60 + rank)) AS BIGINT) AS score FROM {_RANKED} GROUP BY cx_id)")
def _(s, d):
    from ..operators import search as S

    scores = S.integer_rrf(_ranked(s, d))
    recency = scores.where("cx_id % 2 = 0").select("cx_id", (F.col("cx_id") % 1001).cast("long").alias("recency"))
    return X.integer_boost(scores, recency, 80)
