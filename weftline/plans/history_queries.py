"""Sequences, joins in time and histories over the test tables, each with the SQL that says the same.

Users of ``events`` stand for streams, events for samples, for intervals up to the next one, or for
records that correct the one before.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..operators import history, joins, temporal

HOUR = 3_600_000_000


def events(spark: SparkSession, d: str) -> DataFrame:
    """Events with ``us``, microseconds since 1970."""
    df = spark.read.parquet(f"{d}/events.parquet")
    return df.withColumn("us", F.expr("timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts as timestamp_ntz))"))


def intervals(spark: SparkSession, d: str) -> DataFrame:
    """Each event as an interval of at most two hours, up to the user's next."""
    following = F.lead("us").over(W.Window.partitionBy("user_id").orderBy("us", "event_id"))
    return events(spark, d).select("event_id", "user_id", "event_type", "value", "us", F.least(following, F.col("us") + 2 * HOUR).alias("e")).withColumn("e", F.coalesce("e", F.col("us") + HOUR))


EVENTS = "e0 AS (SELECT *, epoch_us(ts) AS us FROM events)"
SPANS = EVENTS + f", iv AS (SELECT event_id, user_id, event_type, value, us, coalesce(least(lead(us) OVER (PARTITION BY user_id ORDER BY us, event_id), us + {2 * HOUR}), us + {HOUR}) AS e FROM e0)"
QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {EVENTS}, m AS (SELECT *, max(us) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e0),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM m),
s AS (SELECT user_id, island, min(us) AS us, min(ts) AS t, count(*) AS n, sum(value) AS total FROM i GROUP BY 1, 2)
SELECT strftime(t, '%G-W%V') AS week, count(*) AS sessions, CAST(sum(n) AS BIGINT) AS n_events, round(sum(total), 4) AS total FROM s GROUP BY 1""")
def sessions_by_week(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of each user by gaps over six hours, rolled up by the ISO week they start in."""
    from ..operators.rollups import weekly

    rows = events(spark, d).withColumn("stop", F.col("us"))
    whole = temporal.merged(rows, ["user_id"], "us", "stop", "event_id", 6 * HOUR, total=F.sum("value"), t=F.min("ts"))
    out = weekly(whole, "t", [], sessions=F.count("*"), n_events=F.sum("n"), total=F.sum("total"))
    return out.withColumn("total", F.round("total", 4))


@query(f"""WITH {SPANS}, o AS (SELECT *, max(e) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM iv),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > {HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY us, event_id) AS island FROM o)
SELECT user_id, event_type, CAST(island AS BIGINT) AS island, min(us) AS us, max(e) AS e, count(*) AS n, min(value) AS least_value FROM i GROUP BY 1, 2, 3""")
def merged_intervals(spark: SparkSession, d: str) -> DataFrame:
    return temporal.merged(intervals(spark, d), ["user_id", "event_type"], "us", "e", "event_id", HOUR, least_value=F.min("value"))


@query(f"""WITH {EVENTS}, g AS (SELECT *, us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) AS gap FROM e0),
m AS (SELECT *, quantile_cont(gap, 0.5) OVER (PARTITION BY user_id) AS med FROM g),
r AS (SELECT *, sum(CASE WHEN gap > 4 * med THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS run FROM m)
SELECT user_id, CAST(run AS BIGINT) AS run, min(us) AS first, max(us) AS last, count(*) AS n FROM r GROUP BY 1, 2""")
def runs_by_median_gap(spark: SparkSession, d: str) -> DataFrame:
    return temporal.runs(events(spark, d).withColumn("us", F.col("us").cast("double")), ["user_id"], "us", "event_id", 4).withColumn("first", F.col("first").cast("long")).withColumn("last", F.col("last").cast("long"))


@query(f"""WITH {EVENTS}, l AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY us, event_id) AS before FROM e0)
SELECT * FROM l WHERE before IS NOT NULL AND before <> event_type""")
def state_transitions(spark: SparkSession, d: str) -> DataFrame:
    return temporal.transitions(events(spark, d), ["user_id"], "us", "event_id", "event_type").select("event_id", "user_id", "event_type", "before")


@query(f"""WITH {SPANS}, c AS (SELECT user_id, greatest(us, 1704067200000000) AS us, least(e, 1704672000000000) AS e, event_id FROM iv), k AS (SELECT * FROM c WHERE e > us),
o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR us > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS island FROM o),
s AS (SELECT user_id, island, min(us) AS us, max(e) AS e FROM i GROUP BY 1, 2),
h AS (SELECT user_id, coalesce(lag(e) OVER (PARTITION BY user_id ORDER BY us), 1704067200000000) AS hole_start, us AS hole_end FROM s UNION ALL SELECT user_id, max(e), 1704672000000000 FROM s GROUP BY 1)
SELECT * FROM h WHERE hole_end > hole_start""")
def uncovered_holes(spark: SparkSession, d: str) -> DataFrame:
    return temporal.holes(intervals(spark, d), ["user_id"], "us", "e", "event_id", 1704067200000000, 1704672000000000)


@query(f"""WITH {SPANS}, w AS (SELECT min(us) AS low, max(us) AS high FROM iv), c AS (SELECT user_id, us, least(e, high) AS e, event_id FROM iv, w), k AS (SELECT * FROM c WHERE e > us),
o AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM k),
h AS (SELECT user_id, coalesce(p, low) AS hole_start, us AS hole_end FROM o, w UNION ALL SELECT user_id, coalesce(max(e) FILTER (e > us), any_value(low)), any_value(high) FROM c, w GROUP BY 1)
SELECT * FROM h WHERE hole_end > hole_start""")
def uncovered_holes_whole(spark: SparkSession, d: str) -> DataFrame:
    """Holes of every user between the first and the last event of all."""
    low, high = events(spark, d).agg(F.min("us"), F.max("us")).first()
    return temporal.holes(intervals(spark, d), ["user_id"], "us", "e", "event_id", low, high)


@query(f"""WITH {SPANS}, sp AS (SELECT event_id, user_id, us, us + {4 * HOUR} AS e FROM iv WHERE event_type = 'view'), cu AS (SELECT event_id AS cid, user_id, us AS cs, us + {HOUR // 2} AS ce FROM iv WHERE event_type = 'click'),
hit AS (SELECT s.user_id, s.event_id, s.us, s.e, cid, cs, ce FROM sp s JOIN cu c USING (user_id) WHERE cs < e AND ce > us),
o AS (SELECT *, max(ce) OVER (PARTITION BY user_id, event_id ORDER BY cs, cid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM hit),
i AS (SELECT *, sum(CASE WHEN p IS NULL OR cs > p THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_id ORDER BY cs, cid) AS island FROM o),
m AS (SELECT user_id, event_id, us, e, island, min(cs) AS cs, max(ce) AS ce FROM i GROUP BY ALL),
p AS (SELECT user_id, event_id, coalesce(lag(ce) OVER (PARTITION BY user_id, event_id ORDER BY cs), us) AS part_start, cs AS part_end FROM m
UNION ALL SELECT user_id, event_id, max(ce), max(e) FROM m GROUP BY 1, 2
UNION ALL SELECT user_id, event_id, us, e FROM sp WHERE event_id NOT IN (SELECT event_id FROM m))
SELECT * FROM p WHERE part_end > part_start""")
def subtracted_intervals(spark: SparkSession, d: str) -> DataFrame:
    rows = intervals(spark, d)
    views = rows.where("event_type = 'view'").select("event_id", "user_id", "us", (F.col("us") + 4 * HOUR).alias("e"))
    clicks = rows.where("event_type = 'click'").select("event_id", "user_id", "us", (F.col("us") + HOUR // 2).alias("e"))
    return temporal.subtracted(views, clicks, ["user_id"], "event_id", "us", "e", "event_id", 4 * HOUR)


@query(f"""WITH {EVENTS}, s AS (SELECT *, sum(CASE WHEN value < 4 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us, event_id) AS st FROM e0), h AS (SELECT * FROM s WHERE value >= 4),
p AS (SELECT *, min(CASE WHEN value > 15 THEN us END) OVER (PARTITION BY user_id, st) AS pk FROM h), q AS (SELECT *, max(CASE WHEN value <= 4 AND us < pk THEN us END) OVER (PARTITION BY user_id, st) AS ed FROM p WHERE pk IS NOT NULL)
SELECT user_id, min(us) AS start, max(us) AS "end", max(value) AS peak, count(*) AS n FROM q WHERE ed IS NULL OR us > ed GROUP BY user_id, st""")
def contact_intervals(spark: SparkSession, d: str) -> DataFrame:
    """Two-threshold intervals of the values: begin above 15, hold down to 4."""
    return temporal.hysteresis(events(spark, d), ["user_id"], "us", "event_id", "value", 15, 4)


@query(f"""WITH {EVENTS}, l AS (SELECT *, (us - lag(us) OVER w) / 1e6 AS step, lag(value) OVER w AS v FROM e0 WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id)),
s AS (SELECT *, CASE WHEN step > 0 AND step <= 36000 THEN step END AS st FROM l), q AS (SELECT *, (value - v) / st AS speed FROM s)
SELECT event_id, round(speed, 6) AS speed, round((speed - lag(speed) OVER (PARTITION BY user_id ORDER BY us, event_id)) / st, 9) AS acceleration FROM q""")
def speeds(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("sec", F.col("us") / 1e6)
    order = W.Window.partitionBy("user_id").orderBy("us", "event_id")
    # Steps come from whole microseconds, so that both engines divide the same numbers.
    step = (F.col("us") - F.lag("us").over(order)) / 1e6
    rows = rows.withColumn("st", F.when((step > 0) & (step <= 36000), step)).withColumn("speed", (F.col("value") - F.lag("value").over(order)) / F.col("st"))
    return rows.select("event_id", F.round("speed", 6).alias("speed"), F.round((F.col("speed") - F.lag("speed").over(order)) / F.col("st"), 9).alias("acceleration"))


@query(f"""WITH {EVENTS} SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS smooth FROM e0""")
def moving_average(spark: SparkSession, d: str) -> DataFrame:
    return temporal.moving_average(events(spark, d), ["user_id"], "us", "event_id", "value", 2).select("event_id", F.round("smooth", 6).alias("smooth"))


_SIDES = f"{EVENTS}, p AS (SELECT event_id, user_id, us FROM e0 WHERE event_type = 'purchase'), k AS (SELECT event_id AS cid, user_id, us AS cus, value FROM e0 WHERE event_type = 'click')"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, d)
    return rows.where("event_type = 'purchase'").select("event_id", "user_id", "us"), rows.where("event_type = 'click'").select("event_id", "user_id", "us", "value")


def _picked(order: str, where: str) -> str:
    return f"""WITH {_SIDES}, j AS (SELECT p.event_id, p.us, cid, cus, k.value, row_number() OVER (PARTITION BY p.event_id ORDER BY {order}) AS r FROM p LEFT JOIN k ON p.user_id = k.user_id AND {where})
SELECT event_id, cid AS match_id, cus AS match_time, value FROM j WHERE r = 1"""


@query(_picked("cus DESC, cid DESC", "cus <= p.us"))
def asof_backward(spark: SparkSession, d: str) -> DataFrame:
    """Each purchase with the user's latest click before it."""
    a, b = _sides(spark, d)
    return joins.asof(a, b, ["user_id"], "us", "event_id", "event_id", ["value"]).select("event_id", "match_id", "match_time", "value")


@query(_picked("cus, cid", f"cus >= p.us AND cus - p.us <= {12 * HOUR}"))
def asof_forward(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return joins.asof(a, b, ["user_id"], "us", "event_id", "event_id", ["value"], "forward", float(12 * HOUR)).select("event_id", "match_id", "match_time", "value")


@query(_picked("abs(cus - p.us), cus, CASE WHEN cus <= p.us THEN -cid ELSE cid END", "true"))
def asof_nearest(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return joins.asof(a, b, ["user_id"], "us", "event_id", "event_id", ["value"], "nearest").select("event_id", "match_id", "match_time", "value")


@query(f"""WITH {_SIDES}, b AS (SELECT p.event_id, max(cus) FILTER (cus <= p.us) AS pt, min(cus) FILTER (cus >= p.us) AS ft, max_by(value, cus) FILTER (cus <= p.us) AS pv, min_by(value, cus) FILTER (cus >= p.us) AS fv, any_value(p.us) AS us
FROM p LEFT JOIN k ON p.user_id = k.user_id GROUP BY 1)
SELECT event_id, round(CASE WHEN pt = us THEN pv WHEN ft = us THEN fv WHEN ft - pt <= {48 * HOUR} THEN pv + (fv - pv) * (us - pt)::DOUBLE / (ft - pt)::DOUBLE END, 6) AS value FROM b""")
def interpolated_values(spark: SparkSession, d: str) -> DataFrame:
    a, b = _sides(spark, d)
    return joins.interpolated(a, b, ["user_id"], "us", "event_id", "event_id", "value", float(48 * HOUR)).select("event_id", F.round("value", 6).alias("value"))


_PAIRS = f"{SPANS}, a AS (SELECT event_id AS aid, user_id, us AS a_s, us + {3 * HOUR} AS a_e FROM iv WHERE event_type = 'view'), b AS (SELECT event_id AS bid, user_id, us AS b_s, us + {2 * HOUR} AS b_e FROM iv WHERE event_type = 'error')"


def _spans(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = intervals(spark, d)
    a = rows.where("event_type = 'view'").select(F.col("event_id").alias("aid"), "user_id", F.col("us").alias("a_s"), (F.col("us") + 3 * HOUR).alias("a_e"))
    return a, rows.where("event_type = 'error'").select(F.col("event_id").alias("bid"), "user_id", F.col("us").alias("b_s"), (F.col("us") + 2 * HOUR).alias("b_e"))


@query(f"WITH {_PAIRS} SELECT aid, bid, least(a_e, b_e) - greatest(a_s, b_s) AS overlap FROM a JOIN b USING (user_id) WHERE a_s < b_e AND b_s < a_e")
def interval_overlaps(spark: SparkSession, d: str) -> DataFrame:
    a, b = _spans(spark, d)
    return joins.overlaps(a, b, ["user_id"], ("a_s", "a_e"), ("b_s", "b_e"), 3 * HOUR).select("aid", "bid", "overlap")


@query(f"""WITH {_PAIRS}, j AS (SELECT aid, user_id, bid, least(a_e, b_e) - greatest(a_s, b_s) AS overlap FROM a JOIN b USING (user_id) WHERE a_s < b_e AND b_s < a_e),
r AS (SELECT *, row_number() OVER (PARTITION BY aid ORDER BY overlap DESC, bid DESC) AS r FROM j) SELECT user_id, aid, bid, overlap FROM r WHERE r = 1""")
def longest_overlaps(spark: SparkSession, d: str) -> DataFrame:
    a, b = _spans(spark, d)
    return joins.longest_overlap(a, b, ["user_id"], "aid", ("a_s", "a_e"), "bid", ("b_s", "b_e"), 3 * HOUR)


def records(spark: SparkSession, d: str) -> DataFrame:
    """Events as records: every third corrects the user's event before it, errors are retractions, some are seeded."""
    before = F.lag("event_id").over(W.Window.partitionBy("user_id").orderBy("us", "event_id"))
    return events(spark, d).select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, before).alias("parent"), "value", (F.col("event_type") == "error").alias("retracted"), (F.col("event_id") % 50 == 0).alias("seeded"))


_RECORDS = f"""{EVENTS}, rec AS (SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) END AS parent, value, event_type = 'error' AS retracted, event_id % 50 = 0 AS seeded FROM e0)"""
_CLOSED = f"WITH RECURSIVE {_RECORDS}, ban(id) AS (SELECT id FROM rec WHERE seeded UNION SELECT rec.id FROM rec JOIN ban ON rec.parent = ban.id)"


@query(f"{_CLOSED} SELECT id, value FROM rec WHERE id NOT IN (SELECT parent FROM rec WHERE parent IS NOT NULL) AND NOT retracted AND id NOT IN (SELECT id FROM ban)")
def current_view(spark: SparkSession, d: str) -> DataFrame:
    """Records in force."""
    return history.current(records(spark, d), "id", "parent", F.col("retracted"), F.col("seeded")).select("id", "value")


@query(f"{_CLOSED} SELECT DISTINCT id FROM ban")
def descendants(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    return history.closure(rows, rows.where("seeded").select("id"), "id", "parent")


@query(f"WITH RECURSIVE {_RECORDS}, c(id, root, depth) AS (SELECT id, id, 0 FROM rec WHERE parent IS NULL UNION ALL SELECT rec.id, c.root, c.depth + 1 FROM rec JOIN c ON rec.parent = c.id) SELECT id, root, CAST(depth AS BIGINT) AS depth FROM c")
def chain_roots(spark: SparkSession, d: str) -> DataFrame:
    return history.chain_roots(records(spark, d), "id", "parent")


@query(f"""WITH {_RECORDS}, a AS (SELECT id, value AS q FROM rec WHERE id % 7 <> 0), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN value + 1 ELSE value END AS q FROM rec WHERE id % 11 <> 0)
SELECT id, CASE WHEN a.q IS NULL THEN 'added' WHEN b.q IS NULL THEN 'deleted' WHEN a.q = b.q THEN 'accepted' ELSE 'corrected' END AS outcome FROM a FULL JOIN b USING (id)""")
def reconciled(spark: SparkSession, d: str) -> DataFrame:
    """What review made of each record that was sent."""
    rows = records(spark, d)
    back = rows.where("id % 11 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("q"))
    return joins.compared(rows.where("id % 7 <> 0").select("id", F.col("value").alias("q")), back, ["id"], ["q"]).select("id", "outcome")


@query(f"""WITH {_RECORDS}, a AS (SELECT id, value AS q, seeded AS pr FROM rec WHERE id % 7 <> 0), b AS (SELECT id, CASE WHEN id % 5 = 0 THEN value + 1 ELSE value END AS q FROM rec WHERE id % 11 <> 0)
SELECT id, CASE WHEN pr THEN 'keep' WHEN a.q IS NULL THEN 'insert' WHEN b.q IS NULL THEN 'retract' WHEN a.q = b.q THEN 'keep' ELSE 'replace' END AS action FROM a FULL JOIN b USING (id)""")
def upsert_plan(spark: SparkSession, d: str) -> DataFrame:
    rows = records(spark, d)
    back = rows.where("id % 11 <> 0").select("id", F.when(F.col("id") % 5 == 0, F.col("value") + 1).otherwise(F.col("value")).alias("q"))
    return joins.upserts(rows.where("id % 7 <> 0").select("id", F.col("value").alias("q"), "seeded"), back, ["id"], ["q"], F.col("seeded"))


@query("""WITH ev AS (SELECT *, epoch_us(ts) AS us FROM events), l AS (SELECT event_id, user_id, event_type AS after, coalesce(lag(event_type) OVER w, 'view') AS before, us FROM ev WINDOW w AS (PARTITION BY user_id ORDER BY us, event_id))
SELECT event_id FROM l WHERE NOT (before = after OR (before <> 'error' AND (after = 'error' OR list_position(['view', 'click', 'signup', 'purchase', 'error'], after) = list_position(['view', 'click', 'signup', 'purchase', 'error'], before) + 1)))""")
def lifecycle_faults(spark: SparkSession, d: str) -> DataFrame:
    """Moves between event types that the order view, click, signup, purchase forbids; error ends all."""
    order = W.Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events(spark, d).withColumn("before", F.coalesce(F.lag("event_type").over(order), F.lit("view"))).withColumnRenamed("event_type", "after")
    return history.lifecycle_faults(rows, ["user_id"], ["us", "event_id"], "before", "after", ["view", "click", "signup", "purchase", "error"], "error").select("event_id")
