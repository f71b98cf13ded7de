"""Boundaries of actions, spectral correlations, integrated rotations and matched vectors over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import actions, align, contacts, orientation, scenes, spectra
from .history_queries import EVENTS, HOUR, events

QUERIES, ORACLES = {}, {}
MINUTE = 60_000
LIMITS = actions.Limits(smooth=720 * MINUTE, still_speed=1.0, least_still=300 * MINUTE, valley_speed=8.0, valley_ratio=0.7, valley_window=1440 * MINUTE, valley_apart=900 * MINUTE, merge=420 * MINUTE, second=60.0 * MINUTE)
LEAST = 960 * MINUTE


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _track(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Values of users as a track, an hour as the unit of its speed, and an hour of contact after each purchase."""
    rows = events(spark, d).withColumn("t", F.expr("us div 1000"))
    track = rows.groupBy("user_id", "t").agg(F.avg("value").alias("x")).withColumn("y", F.lit(0.0))
    return track, rows.where("event_type = 'purchase'").select("user_id", F.col("t").alias("start"), (F.col("t") + 60 * MINUTE).alias("end")).distinct()


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    return actions.boundary_candidates(*_track(spark, d), ["user_id"], "t", "x", "y", F.lit(1.0), LIMITS, 360 * MINUTE)


_BOUNDARIES = f"""WITH RECURSIVE g AS (SELECT user_id, epoch_us(ts) // 1000 AS t, avg(value) AS x FROM events GROUP BY 1, 2),
con AS (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS s, epoch_us(ts) // 1000 + {60 * MINUTE} AS e FROM events WHERE event_type = 'purchase'),
d AS (SELECT *, t - lag(t) OVER w AS tb, lead(t) OVER w - t AS ta, x - lag(x) OVER w AS lo, lead(x) OVER w - x AS hi FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)),
v AS (SELECT *, abs(coalesce((tb * tb * hi + ta * ta * lo) / (1.0 * ta * tb * (ta + tb)), hi / ta, lo / tb, 0)) * {LIMITS.second} AS v FROM d),
l AS (SELECT user_id, list(t ORDER BY t) AS ts, list(v ORDER BY t) AS vs, len(list(t)) AS n, CAST(greatest(1, coalesce(round_even({LIMITS.smooth} / median(tb), 0), 1)) AS BIGINT) AS k FROM v GROUP BY 1),
i AS (SELECT *, unnest(range(1, n + 1)) AS i FROM l),
sp AS (SELECT user_id, ts[i] AS t, list_avg(list_transform(range(i - k // 2, i + k - k // 2), lambda j: vs[greatest(1, least(n, j))])) AS v FROM i),
r AS (SELECT *, v < {LIMITS.still_speed} AS slow, sum(CASE WHEN v < {LIMITS.still_speed} THEN 0 ELSE 1 END) OVER w AS run, lag(v) OVER w AS vb, lead(v) OVER w AS va,
  max(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN {LIMITS.valley_window} PRECEDING AND 1 PRECEDING) AS mb, max(v) OVER (PARTITION BY user_id ORDER BY t RANGE BETWEEN 1 FOLLOWING AND {LIMITS.valley_window} FOLLOWING) AS ma FROM sp WINDOW w AS (PARTITION BY user_id ORDER BY t)),
q AS (SELECT *, slow AND max(t) OVER z - min(t) OVER z >= {LIMITS.least_still} AS still, min(t) OVER z AS t0, max(t) OVER z AS t1 FROM r WINDOW z AS (PARTITION BY user_id, run, slow)),
va0 AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS k FROM q WHERE NOT still AND v < {LIMITS.valley_speed} AND v <= {LIMITS.valley_ratio} * mb AND v <= {LIMITS.valley_ratio} * ma AND v <= vb AND v < va
  AND NOT EXISTS (SELECT 1 FROM con WHERE con.user_id = q.user_id AND con.s < q.t AND q.t < con.e)),
va1(user_id, k, t, last, taken) AS (SELECT user_id, k, t, t, true FROM va0 WHERE k = 1 UNION ALL SELECT n.user_id, n.k, n.t, CASE WHEN n.t - p.last >= {LIMITS.valley_apart} THEN n.t ELSE p.last END, n.t - p.last >= {LIMITS.valley_apart} FROM va1 p JOIN va0 n ON n.user_id = p.user_id AND n.k = p.k + 1),
al AS (SELECT user_id, s AS t, 'contact_start' AS reason, 0 AS p FROM con UNION ALL SELECT user_id, e, 'contact_end', 0 FROM con UNION ALL SELECT user_id, t, 'still_start', 1 FROM q WHERE still AND t = t0 AND vb IS NOT NULL UNION ALL SELECT user_id, t, 'still_end', 1 FROM q WHERE still AND t = t1 AND va IS NOT NULL UNION ALL SELECT user_id, t, 'valley', 2 FROM va1 WHERE taken),
o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY t, p, reason) AS k FROM al),
m(user_id, k, t, reason, p, fresh) AS (SELECT user_id, k, t, reason, p, true FROM o WHERE k = 1 UNION ALL SELECT n.user_id, n.k, CASE WHEN n.t - c.t > {LIMITS.merge} OR n.p < c.p THEN n.t ELSE c.t END, CASE WHEN n.t - c.t > {LIMITS.merge} OR n.p < c.p THEN n.reason ELSE c.reason END, CASE WHEN n.t - c.t > {LIMITS.merge} OR n.p < c.p THEN n.p ELSE c.p END, n.t - c.t > {LIMITS.merge} FROM m c JOIN o n ON n.user_id = c.user_id AND n.k = c.k + 1),
cand AS (SELECT a.user_id, a.t, a.reason FROM m a LEFT JOIN m b ON b.user_id = a.user_id AND b.k = a.k + 1 WHERE coalesce(b.fresh, true))"""


@query(f"{_BOUNDARIES} SELECT user_id, t, reason FROM cand")
def action_boundaries(spark: SparkSession, d: str) -> DataFrame:
    """Where a user's activity turns: purchases, rests, and valleys of the speed of values."""
    return _candidates(spark, d).select("user_id", "t", "reason")


@query(f"""{_BOUNDARIES}, span AS (SELECT user_id, min(t) AS s, max(t) + 1 AS e FROM g GROUP BY 1), cuts AS (SELECT user_id, s AS a FROM span UNION SELECT c.user_id, c.t FROM cand c JOIN span USING (user_id) WHERE c.t > s AND c.t < e),
pc AS (SELECT c.user_id, c.a, coalesce(lead(c.a) OVER w, s.e) AS b, row_number() OVER w AS k FROM cuts c JOIN span s USING (user_id) WINDOW w AS (PARTITION BY c.user_id ORDER BY c.a)),
sg(user_id, k, a, b, fresh) AS (SELECT user_id, k, a, b, true FROM pc WHERE k = 1 UNION ALL SELECT n.user_id, n.k, CASE WHEN n.b - n.a < {LEAST} OR c.b - c.a < {LEAST} THEN c.a ELSE n.a END, n.b, NOT (n.b - n.a < {LEAST} OR c.b - c.a < {LEAST}) FROM sg c JOIN pc n ON n.user_id = c.user_id AND n.k = c.k + 1)
SELECT x.user_id, x.a AS "start", x.b AS "end" FROM sg x LEFT JOIN sg y ON y.user_id = x.user_id AND y.k = x.k + 1 WHERE coalesce(y.fresh, true)""")
def action_spans(spark: SparkSession, d: str) -> DataFrame:
    """A user's time without gaps, cut where the activity turns; short pieces join the one before."""
    spans = _track(spark, d)[0].groupBy("user_id").agg(F.min("t").alias("start"), (F.max("t") + 1).alias("end"))
    return actions.action_segments(spans, _candidates(spark, d), ["user_id"], "t", LEAST)


def _lags(spark: SparkSession, d: str) -> DataFrame:
    rows = align.binned(events(spark, d), ["event_type", "user_id"], "us", "value", float(12 * HOUR))
    side = lambda kind: rows.where(F.col("event_type") == kind).select("user_id", "slot", "mean")
    return spectra.correlations(side("view"), side("click"), ["user_id"], "slot", "mean", 24, 64)


_LAGS = f"""{EVENTS}, b AS (SELECT user_id, event_type, us // {12 * HOUR} AS slot, avg(value) AS m FROM e0 WHERE event_type IN ('view', 'click') GROUP BY 1, 2, 3),
c AS (SELECT x.user_id, y.slot - x.slot AS lag, corr(x.m, y.m) AS correlation, count(*) AS n FROM b x JOIN b y ON y.user_id = x.user_id AND x.event_type = 'view' AND y.event_type = 'click' AND abs(y.slot - x.slot) <= 24 GROUP BY 1, 2)"""


@query(f"WITH {_LAGS} SELECT user_id, CAST(lag AS BIGINT) AS lag, round(correlation, 5) AS correlation, n FROM c WHERE n >= 3")
def spectral_correlations(spark: SparkSession, d: str) -> DataFrame:
    """How a user's clicks follow the views, for each shift of up to twelve days."""
    return _lags(spark, d).where("n >= 3").select("user_id", "lag", F.round("correlation", 5).alias("correlation"), "n")


@query(f"""WITH {_LAGS}, k AS (SELECT * FROM c WHERE n >= 5), t AS (SELECT user_id, arg_max(lag, (correlation, -lag)) AS best, max(correlation) AS top FROM k GROUP BY 1),
p AS (SELECT t.user_id, best, top, max(correlation) FILTER (lag = best - 1) AS a, max(correlation) FILTER (lag = best + 1) AS z, count(*) FILTER (abs(lag - best) > 2) AS n, avg(correlation) FILTER (abs(lag - best) > 2) AS mean, stddev_pop(correlation) FILTER (abs(lag - best) > 2) AS dev FROM k JOIN t USING (user_id) GROUP BY 1, 2, 3)
SELECT user_id, round(best + coalesce(CASE WHEN a - 2 * top + z <> 0 THEN 0.5 * (a - z) / (a - 2 * top + z) END, 0), 4) AS lag, round(top, 5) AS correlation, round(CASE WHEN n >= 11 THEN (top - mean) / dev ELSE 0 END, 4) AS psr FROM p""")
def correlation_peaks(spark: SparkSession, d: str) -> DataFrame:
    """The best shift of each user, between slots, and how far it stands out."""
    rows = spectra.peak(_lags(spark, d).where("n >= 5"), ["user_id"], 2)
    return rows.select("user_id", F.round("lag", 4).alias("lag"), F.round("correlation", 5).alias("correlation"), F.round("psr", 4).alias("psr"))


REST = orientation.Rest(window=360.0 * MINUTE, acc_spread=0.1, turn_spread=1.0, turn_mean=1e-12, gravity=9.81, tolerance=0.5)


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) / 1000.0 AS t, value / 50 AS g FROM events),
d AS (SELECT *, t - lag(t) OVER w AS dt, lag(t) OVER w AS tb, (g + lag(g) OVER w) / 2 * (t - lag(t) OVER w) / {60.0 * MINUTE} AS da, min(t) OVER (PARTITION BY user_id) AS t0 FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
k AS (SELECT user_id, count(*) FILTER (t <= t0 + {360 * MINUTE}) AS n, min(CASE WHEN dt > {1440 * MINUTE} THEN tb END) AS edge, min(t0) AS t0 FROM d GROUP BY 1),
a AS (SELECT d.*, sum(coalesce(da, 0)) OVER (PARTITION BY user_id ORDER BY t, event_id) AS turn FROM d)
SELECT user_id, event_id, round(abs(cos(turn / 2)), 6) AS w, round(sin(turn / 2) * cos(turn / 2), 6) AS wz FROM a JOIN k USING (user_id) WHERE n > 1 AND (edge IS NULL OR edge >= k.t0 + {360 * MINUTE}) AND (edge IS NULL OR t <= edge)""")
def integrated_turns(spark: SparkSession, d: str) -> DataFrame:
    """Values of users as turn rates about the upright axis, integrated until the first day without an event."""
    rows = events(spark, d).select("user_id", "event_id", (F.col("us") / 1000.0).alias("t"), (F.col("value") / 50).alias("gz"), *(F.lit(0.0).alias(c) for c in ("ax", "ay", "gx", "gy")), F.lit(9.81).alias("az"))
    out = orientation.integrated(rows, ["user_id"], "t", "event_id", ["ax", "ay", "az"], ["gx", "gy", "gz"], REST, 1440.0 * MINUTE, 2880.0 * MINUTE, second=60.0 * MINUTE)
    w, z = F.element_at("q", 1), F.element_at("q", 4)
    return out.select("user_id", "event_id", F.round(F.abs(w), 6).alias("w"), F.round(w * z, 6).alias("wz"))


@query("""WITH a AS (SELECT * FROM embeddings WHERE vec_id % 2 = 0), b AS (SELECT * FROM embeddings WHERE vec_id % 2 = 1),
p AS (SELECT label, a.vec_id AS a_id, b.vec_id AS b_id, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM a JOIN b USING (label)),
r AS (SELECT *, row_number() OVER (PARTITION BY label, a_id ORDER BY d, b_id) AS ra, lead(d) OVER (PARTITION BY label, a_id ORDER BY d, b_id) AS d2, row_number() OVER (PARTITION BY label, b_id ORDER BY d, a_id) AS rb, count(*) OVER (PARTITION BY label, a_id) AS nb, count(*) OVER (PARTITION BY label, b_id) AS na FROM p)
SELECT label, a_id, b_id, round(d, 5) AS distance FROM r WHERE ra = 1 AND rb = 1 AND d < 0.97 * d2 AND na > 1 AND nb > 1""")
def descriptor_matches(spark: SparkSession, d: str) -> DataFrame:
    """Vectors of even and odd ids that are each other's nearest within their label, clearly nearer than the second."""
    rows = spark.read.parquet(f"{d}/embeddings.parquet")
    out = scenes.match_descriptors(rows.where("vec_id % 2 = 0"), rows.where("vec_id % 2 = 1"), ["label"], "vec_id", "embedding", 0.97, 256)
    return out.select("label", "a_id", "b_id", F.round("distance", 5).alias("distance"))


@query("""SELECT l_suppkey, count(*) AS matches, count(*) FILTER (l_linenumber <= 4) AS inliers, CAST(2 AS DOUBLE) AS scale, CAST(3 AS DOUBLE) AS height FROM lineitem GROUP BY 1 HAVING count(*) >= 3""")
def moved_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of a supplier as points, turned, doubled and shifted; lines past the fourth went elsewhere and must not sway the fit."""
    rows = spark.read.parquet(f"{d}/lineitem.parquet").withColumn("id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    x, y, z = F.col("l_quantity"), F.col("l_extendedprice") / 1000, F.col("l_discount") * 300
    stray = lambda k: F.when(F.col("l_linenumber") > 4, 50.0 + F.pmod(F.xxhash64("id", F.lit(k)), F.lit(1000))).otherwise(0.0)
    target = F.array(-2 * y + 1 + stray(1), 2 * x + 2 + stray(2), 2 * z + 3 + stray(3))
    pairs = rows.select("l_suppkey", "id", F.array(x, y, z).alias("source"), target.alias("target"))
    out = scenes.ransac_similarity(pairs, ["l_suppkey"], "id", "source", "target", 0.01, 60)
    return out.select("l_suppkey", "matches", "inliers", F.round("scale", 4).alias("scale"), F.round(F.element_at("p", 3), 2).alias("height"))


K = "CAST(json_extract(props, '$.k') AS INT)"


def _with_k(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).withColumn("t", F.expr("us div 1000")).withColumn("k", F.get_json_object("props", "$.k").cast("int"))


@query(f"""WITH e AS (SELECT user_id, event_id, epoch_us(ts) // 1000 AS t, value, {K} AS k FROM events), h AS (SELECT *, k % 10 <> 0 AND value <= 40 AS holds, lag(t) OVER w AS tb FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t, event_id)),
c AS (SELECT *, sum(CASE WHEN NOT holds OR t - tb > {1440 * MINUTE} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY t, event_id) AS c FROM h), r AS (SELECT user_id, c, min(t) FILTER (value <= 20) AS s, max(t) FILTER (value <= 20) AS e FROM c WHERE holds GROUP BY 1, 2),
i AS (SELECT *, CASE WHEN lag(e) OVER w IS NULL OR s - max(e) OVER (PARTITION BY user_id ORDER BY s, c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) > {720 * MINUTE} THEN 1 ELSE 0 END AS fresh FROM r WHERE s IS NOT NULL WINDOW w AS (PARTITION BY user_id ORDER BY s, c)), j AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY s, c) AS g FROM i)
SELECT user_id, min(s) AS "start", max(e) AS "end" FROM j GROUP BY user_id, g HAVING max(e) - min(s) >= {60 * MINUTE}""")
def gated_contacts(spark: SparkSession, d: str) -> DataFrame:
    """Times of low values of a user, from 20 or less until above 40, where every tenth key is a gate that ends them."""
    return contacts.surface_contacts(_with_k(spark, d), ["user_id"], "t", "event_id", "value", F.col("k") % 10 != 0, 20, 40, 1440 * MINUTE, 720 * MINUTE, 60 * MINUTE)


@query(f"""WITH e AS (SELECT user_id, event_id, ts, epoch_us(ts) // {24 * HOUR} AS day, value / 60 AS a, {K} / 100.0 AS b FROM events), p AS (SELECT *, 2.0 * a AS x, 1.0 * b AS y, lag(2.0 * a) OVER w AS x0, lag(1.0 * b) OVER w AS y0, count(*) OVER (PARTITION BY user_id, day) AS n FROM e WINDOW w AS (PARTITION BY user_id, day ORDER BY ts, event_id)),
s AS (SELECT user_id, coalesce(x0, x) AS x0, coalesce(y0, y) AS y0, x, y, x - coalesce(x0, x) AS dx, y - coalesce(y0, y) AS dy FROM p WHERE x0 IS NOT NULL OR n = 1), g AS (SELECT i, j, (i + 0.5) * 0.1 AS gx, (j + 0.5) * 0.1 AS gy FROM range(20) r(i), range(10) q(j)),
c AS (SELECT DISTINCT user_id, i, j FROM s JOIN g ON gx >= least(x0, x) - 0.15 AND gx <= greatest(x0, x) + 0.15 AND gy >= least(y0, y) - 0.15 AND gy <= greatest(y0, y) + 0.15
  WHERE sqrt(power(gx - x0 - dx * greatest(0, least(1, coalesce(((gx - x0) * dx + (gy - y0) * dy) / nullif(dx * dx + dy * dy, 0), 0))), 2) + power(gy - y0 - dy * greatest(0, least(1, coalesce(((gx - x0) * dx + (gy - y0) * dy) / nullif(dx * dx + dy * dy, 0), 0))), 2)) <= 0.15)
SELECT u.user_id, round(count(c.i) / 200.0, 6) AS ratio FROM (SELECT DISTINCT user_id FROM events) u LEFT JOIN c USING (user_id) GROUP BY 1""")
def swept_coverage(spark: SparkSession, d: str) -> DataFrame:
    """The share of a two by one table that a user's events, a path a day, pass within 0.15 of."""
    path = _with_k(spark, d).select("user_id", "event_id", "us", F.expr(f"us div {24 * HOUR}").alias("day"), (F.col("value") / 60).alias("a"), (F.col("k") / 100).alias("b"), F.lit(2.0).alias("width"), F.lit(1.0).alias("height"))
    return contacts.coverage(path, ["user_id"], "day", "us", "event_id", 0.15, 0.1).select("user_id", F.round("ratio", 6).alias("ratio"))


@query(f"""WITH e AS (SELECT user_id, event_type, epoch_us(ts) // 1000 AS t, value, {K} AS k FROM events),
b AS (SELECT user_id, 'e' || k % 3 AS entity, t, min(value) AS x, min(k) AS y, bool_or(k % 11 = 0) AS o FROM e WHERE event_type = 'view' GROUP BY 1, 2, 3), h AS (SELECT DISTINCT user_id, t FROM e WHERE event_type <> 'view'),
s AS (SELECT user_id, entity, min(t) AS t0, max(t) AS t1 FROM b GROUP BY 1, 2), q AS (SELECT h.user_id, h.t, s.entity FROM h JOIN s ON s.user_id = h.user_id AND h.t BETWEEN t0 AND t1),
m AS (SELECT q.*, p.t AS ta, p.x AS xa, p.y AS ya, p.o AS oa FROM q ASOF JOIN b p ON q.user_id = p.user_id AND q.entity = p.entity AND q.t >= p.t), n AS (SELECT m.*, f.t AS tb, f.x AS xb, f.y AS yb, f.o AS ob FROM m ASOF JOIN b f ON m.user_id = f.user_id AND m.entity = f.entity AND m.t <= f.t),
a AS (SELECT user_id, t, entity, xa + (xb - xa) * coalesce((t - ta) / nullif(tb - ta, 0), 0) AS x, ya + (yb - ya) * coalesce((t - ta) / nullif(tb - ta, 0), 0) AS y FROM n WHERE NOT oa AND NOT ob AND tb - ta <= {4320 * MINUTE}),
d AS (SELECT a.user_id, a.t, a.entity, min(sqrt(power(greatest(x - e.value, 0, e.value - (x + 20)), 2) + power(greatest(y - e.k, 0, e.k - (y + 30)), 2))) AS d FROM a JOIN e ON e.user_id = a.user_id AND e.t = a.t AND e.event_type <> 'view' GROUP BY 1, 2, 3),
g AS (SELECT user_id, t, arg_min(entity, (d, entity)) AS entity FROM d WHERE d <= 15 GROUP BY 1, 2), r AS (SELECT *, CASE WHEN lag(entity) OVER w IS NULL OR lag(entity) OVER w <> entity OR t - lag(t) OVER w > {2880 * MINUTE} THEN 1 ELSE 0 END AS fresh FROM g WINDOW w AS (PARTITION BY user_id ORDER BY t)), z AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t) AS i FROM r)
SELECT user_id, entity, min(t) AS "start", max(t) AS "end" FROM z GROUP BY user_id, i, entity HAVING max(t) - min(t) >= {30 * MINUTE}""")
def touched_targets(spark: SparkSession, d: str) -> DataFrame:
    """Views as boxes of three entities, other events as fingers: which entity a user's fingers stay at."""
    rows = _with_k(spark, d)
    boxes = rows.where("event_type = 'view'").withColumn("entity", F.concat(F.lit("e"), F.col("k") % 3)).groupBy("user_id", "entity", "t").agg(F.min("value").alias("x"), F.min("k").alias("y"), F.lit(20.0).alias("w"), F.lit(30.0).alias("h"), F.max(F.col("k") % 11 == 0).alias("outside"))
    points = rows.where("event_type <> 'view'").select("user_id", "t", F.col("value").alias("px"), F.col("k").alias("py"))
    return contacts.video_contacts(points, boxes, ["user_id"], "t", 15, 4320 * MINUTE, 2880 * MINUTE, 30 * MINUTE, 7200 * MINUTE).select("user_id", "entity", "start", "end")
