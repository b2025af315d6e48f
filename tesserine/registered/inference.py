"""Queries of operators/inference.py."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import guard as U
from ..operators import inference as X
from ..registry import _SLOTS, _slots, query, r6, read


@query("pearson_test", "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS r, CAST(count(*) AS DOUBLE) AS n FROM lineitem) SELECT round(r, 6) AS r, CAST(n AS BIGINT) AS n, round(r * sqrt((n - 2) / (1 - r * r)), 3) AS t, round(tanh(atanh(r) - 1.959963984540054::DOUBLE / sqrt(n - 3)), 6) AS low, round(tanh(atanh(r) + 1.959963984540054::DOUBLE / sqrt(n - 3)), 6) AS high FROM c")
def _(s, d):
    t = X.pearson_test(read(s, d, "lineitem"), "l_quantity", "l_extendedprice")
    return t.select(r6("r").alias("r"), "n", F.round("t", 3).alias("t"), r6("low").alias("low"), r6("high").alias("high"))


_PART = "(({xy} - {xz} * {yz}) / sqrt((1 - {xz} * {xz}) * (1 - {yz} * {yz})))"
_COLS = ["l_quantity", "l_extendedprice", "l_tax"]


@query(
    "partial_network",
    "WITH c AS (SELECT corr(l_quantity, l_extendedprice) AS qe, corr(l_quantity, l_tax) AS qt, corr(l_extendedprice, l_tax) AS et FROM lineitem) "
    + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round({_PART.format(xy=xy, xz=xz, yz=yz)}, 6) AS r FROM c" for a, b, xy, xz, yz in (("l_quantity", "l_extendedprice", "qe", "qt", "et"), ("l_quantity", "l_tax", "qt", "qe", "et"), ("l_extendedprice", "l_tax", "et", "qe", "qt"))),
)
def _(s, d):
    return X.partial_network(read(s, d, "lineitem"), _COLS).withColumn("r", r6("r"))


query("pc_skeleton")(lambda s, d: X.skeleton(read(s, d, "lineitem"), [*_COLS, "l_discount"]))


@query(
    "theil_both",
    """WITH c AS (SELECT event_type AS x, user_id % 7 AS y, CAST(count(*) AS DOUBLE) AS o FROM events GROUP BY 1, 2), n AS (SELECT sum(o) AS n FROM c),
    h AS (SELECT (SELECT -sum(o / n * log2(o / n)) FROM c, n) AS hxy, (SELECT -sum(o / n * log2(o / n)) FROM (SELECT sum(o) AS o FROM c GROUP BY x), n) AS hx, (SELECT -sum(o / n * log2(o / n)) FROM (SELECT sum(o) AS o FROM c GROUP BY y), n) AS hy)
    SELECT round(greatest(hx + hy - hxy, 0) / hx, 6) AS u_xy, round(greatest(hx + hy - hxy, 0) / hy, 6) AS u_yx FROM h""",
)
def _(s, d):
    return X.theil(read(s, d, "events").withColumn("y", F.col("user_id") % 7), "event_type", "y").select(r6("u_xy").alias("u_xy"), r6("u_yx").alias("u_yx"))


@query("gini_gamma", "WITH r AS (SELECT rank() OVER (ORDER BY o_totalprice) AS p, rank() OVER (ORDER BY o_orderdate) AS q, count(*) OVER () AS n FROM orders) SELECT round(sum(abs(p + q - (n + 1)) - abs(p - q)) / CAST(max(n) * max(n) // 2 AS DOUBLE), 6) AS gamma FROM r")
def _(s, d):
    o = read(s, d, "orders").select("o_totalprice", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("day"))
    return X.gini_gamma(o, "o_totalprice", "day").select(r6("gamma").alias("gamma"))


@query("posterior_moments", "WITH c AS (SELECT user_id, CAST(count(*) AS DOUBLE) AS n, CAST(count(*) FILTER (WHERE event_type = 'error') AS DOUBLE) AS k FROM events GROUP BY 1) SELECT user_id, round((k + 1) / (n + 2), 6) AS p_mean, round((k + 1) * (n - k + 1) / ((n + 2) * (n + 2) * (n + 3)), 9) AS p_var, round((n + 1) / 31.0::DOUBLE, 6) AS rate_mean, round((n + 1) / (31.0::DOUBLE * 31.0::DOUBLE), 9) AS rate_var FROM c")
def _(s, d):
    c = read(s, d, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "error").alias("k"))
    (pm, pv), (rm, rv) = X.beta_moments(F.col("k"), F.col("n")), X.gamma_moments(F.col("n"), F.lit(30.0))
    return c.select("user_id", r6(pm).alias("p_mean"), F.round(pv, 9).alias("p_var"), r6(rm).alias("rate_mean"), F.round(rv, 9).alias("rate_var"))


@query(
    "strata_allocation",
    """WITH s AS (SELECT source, count(*) AS n FROM documents GROUP BY 1), t AS (SELECT *, sum(n) OVER () AS total, least(97, sum(n) OVER ()) AS target FROM s),
    b AS (SELECT *, CAST(target * n // total AS BIGINT) AS base, (target * n) % total AS rest FROM t), k AS (SELECT *, row_number() OVER (ORDER BY rest DESC, source) AS k, target - sum(base) OVER () AS remain FROM b)
    SELECT source, n, base + CASE WHEN k <= remain THEN 1 ELSE 0 END AS seats FROM k""",
)
def _(s, d):
    return X.apportioned(read(s, d, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")), "source", "n", 97)


_MI = "SELECT {by} greatest(sum(o / n * log2(o * n / (r * c))), 0) AS bits, -sum(o / n * log2(c / n)) AS target_bits FROM (SELECT *, sum(o) OVER ({pn}) AS n, sum(o) OVER (PARTITION BY {p} x) AS r, sum(o) OVER (PARTITION BY {p} y) AS c FROM (SELECT {by} x, y, CAST(count(*) AS DOUBLE) AS o FROM {t} GROUP BY ALL)) {g}"


@query(
    "lens_admission",
    f"""WITH s AS (SELECT slot, cx_id, score FROM {_SLOTS}), l AS (SELECT slot, CAST(floor(score * 4) AS BIGINT) AS x, label AS y FROM s JOIN embeddings ON vec_id = cx_id),
    b AS ({_MI.format(by="slot,", pn="PARTITION BY slot", p="slot,", t="l", g="GROUP BY slot")}),
    c AS (SELECT a.slot AS a, z.slot AS b, abs(corr(a.score, z.score)) AS c FROM s a JOIN s z ON a.cx_id = z.cx_id AND a.slot < z.slot GROUP BY 1, 2),
    m AS (SELECT slot, max(c) AS max_corr FROM (SELECT a AS slot, c FROM c UNION ALL SELECT b, c FROM c) GROUP BY 1)
    SELECT b.slot, round(bits, 6) AS bits, round(max_corr, 6) AS max_corr, bits >= 0.05 AND coalesce(max_corr, 0) <= 0.6 AS admitted FROM b LEFT JOIN m ON b.slot = m.slot""",
)
def _(s, d):
    sc = _slots(s, d)
    labelled = sc.join(read(s, d, "embeddings").select(F.col("vec_id").alias("cx_id"), "label"), "cx_id")
    bits = X.mutual_bits(labelled, F.floor(F.col("score") * 4), F.col("label"), ["slot"]).select("slot", "bits")
    a = sc.select(F.col("slot").alias("a"), "cx_id", F.col("score").alias("x")).join(sc.select(F.col("slot").alias("b"), "cx_id", F.col("score").alias("y")), "cx_id").where("a < b")
    return X.admitted(bits, a.groupBy("a", "b").agg(F.corr("x", "y").alias("corr"))).select("slot", r6("bits").alias("bits"), r6("max_corr").alias("max_corr"), "admitted")


@query(
    "panel_sufficiency",
    f"""WITH l AS (SELECT (CASE WHEN embedding[1] > 0 THEN 1 ELSE 0 END) + (CASE WHEN embedding[17] > 0 THEN 2 ELSE 0 END) + (CASE WHEN embedding[33] > 0 THEN 4 ELSE 0 END) + (CASE WHEN embedding[49] > 0 THEN 8 ELSE 0 END) AS x, label AS y FROM embeddings),
    m AS ({_MI.format(by="", pn="", p="", t="l", g="")}) SELECT round(bits, 6) AS bits, round(target_bits, 6) AS target_bits, round(greatest(target_bits - bits, 0), 6) AS deficit, round(least(1, bits / target_bits), 6) AS ceiling, least(1, bits / target_bits) >= 0.9 AS sufficient FROM m""",
)
def _(s, d):
    e = read(s, d, "embeddings")
    code = sum((F.when(F.col("embedding")[16 * k] > 0, 2**k).otherwise(0) for k in range(4)), F.lit(0))
    out = X.sufficiency(X.mutual_bits(e, code, F.col("label")))
    return out.select(*[r6(c).alias(c) for c in ("bits", "target_bits", "deficit", "ceiling")], "sufficient")


@query("signal_yield", "SELECT n_lenses, CAST(n_lenses * (n_lenses - 1) // 2 AS BIGINT) AS cross_terms, CAST((SELECT count(*) FROM embeddings) * (n_lenses + n_lenses * (n_lenses - 1) // 2 + 1) AS BIGINT) AS signals FROM (SELECT unnest(range(1, 9)) AS n_lenses)")
def _(s, d):
    n = read(s, d, "embeddings").count()
    return s.createDataFrame([(k, *X.signal_yield(n, k)) for k in range(1, 9)], "n_lenses long, cross_terms long, signals long")


_FORECAST = "(SELECT doc_id, (doc_id % 21) / 20.0::DOUBLE AS p, quality AS y FROM labels)"


@query("forecast_scores", f"SELECT doc_id, round((p - y) * (p - y), 6) AS brier, round(CASE WHEN p > 0 AND p < 1 THEN -(y * ln(p) + (1 - y) * ln(1 - p)) END, 6) AS log_loss FROM (SELECT doc_id, p, y, CASE WHEN p > 0 AND p < 1 THEN p ELSE 0.5 END AS q FROM {_FORECAST})".replace("ln(p)", "ln(q)").replace("ln(1 - p)", "ln(1 - q)"))
def _(s, d):
    f = read(s, d, "labels").select("doc_id", ((F.col("doc_id") % 21) / 20.0).alias("p"), F.col("quality").alias("y"))
    return X.forecast_scores(f, "p", "y").select("doc_id", r6("brier").alias("brier"), r6("log_loss").alias("log_loss"))


@query("calibration_bins", f"SELECT least(CAST(floor(p * 10) AS BIGINT), 9) AS bin, count(*) AS n, round(avg(p), 6) AS confidence, round(avg(y), 6) AS accuracy, round(abs(avg(p) - avg(y)), 6) AS gap FROM {_FORECAST} GROUP BY 1")
def _(s, d):
    f = read(s, d, "labels").select(((F.col("doc_id") % 21) / 20.0).alias("p"), F.col("quality").alias("y"))
    return X.calibration(f, "p", "y").select("bin", "n", *[r6(c).alias(c) for c in ("confidence", "accuracy", "gap")])


_PARTIES = "(SELECT m, count(*) AS parties, sum(v) AS volume, max(v) / sum(v) AS top_share, sum(v * v) / (sum(v) * sum(v)) AS herfindahl FROM (SELECT o_custkey % 12 AS m, o_custkey AS c, sum(o_totalprice) AS v FROM orders GROUP BY 1, 2) GROUP BY m)"


def _parties(s, d):
    return X.counterparties(read(s, d, "orders").withColumn("m", F.col("o_custkey") % 12), "m", "o_custkey", "o_totalprice")


@query("market_integrity", f"SELECT m, parties, round(top_share, 6) AS top_share, round(herfindahl, 6) AS herfindahl FROM {_PARTIES}")
def _(s, d):
    return _parties(s, d).select("m", "parties", r6("top_share").alias("top_share"), r6("herfindahl").alias("herfindahl"))


@query(
    "wash_screen",
    f"""WITH r AS (SELECT m, CASE WHEN m = 1 THEN 0 ELSE t * (0.9::DOUBLE + m / 20.0::DOUBLE) END AS raw_volume FROM (SELECT o_custkey % 12 AS m, sum(o_totalprice) AS t FROM orders GROUP BY 1))
    SELECT r.m, round(CASE WHEN raw_volume > 0 THEN volume / raw_volume END, 6) AS ratio, CASE WHEN raw_volume <= 0 THEN 'missing_raw_volume' WHEN volume / raw_volume > 1.000001 THEN 'volume_exceeds_raw' WHEN parties < 5 THEN 'few_counterparties' WHEN volume / raw_volume < 0.8::DOUBLE THEN 'low_ratio' WHEN top_share > 0.5 THEN 'one_counterparty' ELSE 'ok' END AS code
    FROM r LEFT JOIN {_PARTIES} p ON r.m = p.m""",
)
def _(s, d):
    o = read(s, d, "orders").groupBy((F.col("o_custkey") % 12).alias("m")).agg(F.sum("o_totalprice").alias("t"))
    raw = o.select("m", F.when(F.col("m") == 1, 0.0).otherwise(F.col("t") * (0.9 + F.col("m") / 20.0)).alias("raw_volume"))
    return X.wash_screen(_parties(s, d), raw, "m", 5, 0.8, 0.5).select("m", r6("ratio").alias("ratio"), "code")


@query(
    "mispricing",
    """WITH r AS (SELECT p_brand, avg(CASE WHEN p_size > 25 THEN 1.0::DOUBLE ELSE 0 END) AS p, least(count(*) / 20.0::DOUBLE, 1) AS reliability, (max(p_retailprice) - avg(p_retailprice)) / (max(p_retailprice) - min(p_retailprice)) AS price FROM part GROUP BY 1)
    SELECT p_brand, round(abs(price - p), 6) AS divergence, CASE WHEN abs(price - p) <= 0.05::DOUBLE THEN 'aligned' WHEN price > p THEN 'overpriced' ELSE 'underpriced' END AS direction, abs(price - p) > 0.05::DOUBLE AND reliability >= 0.5 AS flagged FROM r""",
)
def _(s, d):
    price = (F.max("p_retailprice") - F.avg("p_retailprice")) / (F.max("p_retailprice") - F.min("p_retailprice"))
    r = read(s, d, "part").groupBy("p_brand").agg(F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.0)).alias("p"), F.least(F.count(F.lit(1)) / 20.0, F.lit(1.0)).alias("reliability"), price.alias("price"))
    return X.mispriced(r, "price", "p", "reliability", 0.05).select("p_brand", r6("divergence").alias("divergence"), "direction", "flagged")


@query("softmax_weights", f"WITH e AS (SELECT slot, cx_id, exp(4 * score) AS e FROM {_SLOTS}) SELECT slot, cx_id, round(e / sum(e) OVER (PARTITION BY slot), 9) AS weight FROM e")
def _(s, d):
    return X.softmax_weights(_slots(s, d), "slot", "score", 4.0).select("slot", "cx_id", F.round("weight", 9).alias("weight"))


@query("capped_prediction", "WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY c DESC, event_type) AS k, sum(c) OVER (PARTITION BY user_id) AS n FROM c) SELECT user_id, CASE WHEN least(c / n, 0.35::DOUBLE, 0.32::DOUBLE) >= 0.25::DOUBLE THEN event_type END AS prediction, round(least(c / n, 0.35::DOUBLE, 0.32::DOUBLE), 6) AS confidence FROM r WHERE k = 1")
def _(s, d):
    p = U.predict_mode(read(s, d, "events"), ["user_id"], "event_type")
    return X.capped_prediction(p, 0.35, 0.32, 0.25).select("user_id", "prediction", r6("confidence").alias("confidence"))


@query("guard_required", f"SELECT cx_id, count(*) FILTER (WHERE score >= 0) AS passed, count(*) FILTER (WHERE score >= 0) = 2 AS pass FROM {_SLOTS} WHERE slot IN (1, 3) GROUP BY 1")
def _(s, d):
    return U.verdict(_slots(s, d), 0.0, required=[1, 3])
