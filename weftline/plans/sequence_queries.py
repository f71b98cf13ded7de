"""Frames, registrations, alerts, vocabularies and matches over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import bounds, times
from ..operators import frames, matching, smoothing
from .history_queries import EVENTS, events

QUERIES, ORACLES = {}, {}
SQL_LINE = "OVER (PARTITION BY user_id ORDER BY us, event_id)"


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"WITH {EVENTS} SELECT event_id, value AS state, coalesce(lead(value) {SQL_LINE}, value) AS action FROM e0")
def next_actions(spark: SparkSession, d: str) -> DataFrame:
    """Each frame's action is the next frame's state; the last repeats its own."""
    rows = frames.next_values(events(spark, d), ["user_id"], ["us", "event_id"], "value")
    return rows.select("event_id", F.col("value").alias("state"), "action")


@query("""WITH w AS (SELECT event_type, strftime(ts, '%G-W%V') AS week, count(*) AS n FROM events GROUP BY 1, 2)
SELECT event_type, week, n, n - lag(n) OVER o AS change, coalesce(n <= lag(n, 2) OVER o, false) AS stagnant FROM w WINDOW o AS (PARTITION BY event_type ORDER BY week)""")
def week_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Change from the week before, and no growth over two weeks; a missing week raises no alert."""
    order = W.Window.partitionBy("event_type").orderBy("week")
    weeks = events(spark, d).groupBy("event_type", times.iso_week(F.col("ts")).alias("week")).agg(F.count("*").alias("n"))
    return weeks.select("event_type", "week", "n", (F.col("n") - F.lag("n").over(order)).alias("change"), F.coalesce(F.col("n") <= F.lag("n", 2).over(order), F.lit(False)).alias("stagnant"))


@query("""WITH r AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END DESC, o_orderdate DESC, o_orderkey DESC) AS k FROM orders)
SELECT o_custkey, o_orderkey FROM r WHERE k = 1""")
def effective_registrations(spark: SparkSession, d: str) -> DataFrame:
    """The registration in force: those with a start first, then the latest start, then the latest made."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    return frames.in_force(orders, ["o_custkey"], "o_orderkey", F.col("o_orderstatus") == "F", "o_orderdate")


@query(f"""WITH {EVENTS}, v AS (SELECT event_id, value, value - lag(value) {SQL_LINE} AS a, us - lag(us) {SQL_LINE} AS ta, lead(value) {SQL_LINE} - value AS b, lead(us) {SQL_LINE} - us AS tb FROM e0)
SELECT event_id FROM v WHERE ta > 0 AND tb > 0 AND abs(a) * 3600000000.0 > 2.0 * ta AND abs(b) * 3600000000.0 > 2.0 * tb""")
def speed_spikes(spark: SparkSession, d: str) -> DataFrame:
    """Samples that both neighbours are too fast for: more than two units an hour on either side."""
    return frames.spikes(events(spark, d), ["user_id"], "us", "event_id", "value", 2.0, 3.6e9).select("event_id")


@query("""WITH p AS (SELECT o_orderpriority, o_custkey, count(*) AS n FROM orders GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY n DESC, o_custkey) AS k FROM p)
SELECT o_orderpriority, o_custkey, n FROM r WHERE k = 1""")
def knee_points(spark: SparkSession, d: str) -> DataFrame:
    """The point of most throughput; of equals the one of least load."""
    points = spark.read.parquet(f"{d}/orders.parquet").groupBy("o_orderpriority", "o_custkey").agg(F.count("*").alias("n"))
    return frames.knee(points, ["o_orderpriority"], "o_custkey", "n").drop("over")


@query("WITH f AS (SELECT event_type, min(event_id) AS first_id FROM events GROUP BY 1) SELECT event_type, CAST(row_number() OVER (ORDER BY first_id) - 1 AS INT) AS code FROM f")
def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    """Dense numbers of the values, in the order they were first seen."""
    return frames.vocabulary(events(spark, d), "event_type", "event_id")


@query(f"""WITH {EVENTS}, r AS (SELECT event_id, row_number() {SQL_LINE} - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM e0)
SELECT event_id FROM r WHERE k = 0 OR (k * 5) // n > ((k - 1) * 5) // n""")
def evenly_picked(spark: SparkSession, d: str) -> DataFrame:
    """Five frames of each stream, evenly spread; all where there are fewer."""
    return frames.evenly(events(spark, d), ["user_id"], ["us", "event_id"], 5).select("event_id")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, min(us) FILTER (value >= 20) AS start FROM e0 GROUP BY 1)
SELECT user_id, count(*) AS frames, max(us) - min(us) AS span FROM e0 JOIN s USING (user_id) WHERE us >= start GROUP BY 1 HAVING count(*) >= 3 AND max(us) - min(us) >= 3600000000""")
def confident_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Tracks from their first confident frame on; those of few frames or a short span go."""
    return frames.confident(events(spark, d), ["user_id"], "us", F.col("value") >= 20, 3, 3_600_000_000)


@query("""SELECT lang, count(*) AS n, round(avg(abs(quality - CASE WHEN n_chars > 500 THEN 1 ELSE 0 END)), 9) AS error
FROM documents JOIN (SELECT doc_id, max(quality) AS quality FROM labels WHERE quality IS NOT NULL GROUP BY 1) USING (doc_id) GROUP BY 1""")
def coverage_errors(spark: SparkSession, d: str) -> DataFrame:
    """Mean distance from the truth; what was not predicted counts as 0."""
    truth = spark.read.parquet(f"{d}/labels.parquet").where("quality is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    pairs = spark.read.parquet(f"{d}/documents.parquet").join(truth, "doc_id").withColumn("guess", (F.col("n_chars") > 500).cast("int"))
    return frames.absolute_error(pairs, ["lang"], "quality", "guess").select("lang", "n", F.round("error", 9).alias("error"))


@query(f"""WITH RECURSIVE {EVENTS}, t AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS i FROM e0 WHERE event_type = 'purchase'), f AS (SELECT user_id, us, row_number() OVER (PARTITION BY user_id ORDER BY us) AS j FROM e0 WHERE event_type = 'click'),
n AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'purchase') AS t, count(*) FILTER (WHERE event_type = 'click') AS f FROM e0 WHERE event_type IN ('purchase', 'click') GROUP BY 1),
r(user_id, i, j, hits) AS (SELECT user_id, 1, 1, 0 FROM n UNION ALL SELECT r.user_id, CASE WHEN f.us - t.us > 21600000000 OR abs(f.us - t.us) <= 21600000000 THEN r.i + 1 ELSE r.i END, CASE WHEN t.us - f.us > 21600000000 OR abs(f.us - t.us) <= 21600000000 THEN r.j + 1 ELSE r.j END,
  r.hits + CASE WHEN abs(f.us - t.us) <= 21600000000 THEN 1 ELSE 0 END FROM r JOIN t ON t.user_id = r.user_id AND t.i = r.i JOIN f ON f.user_id = r.user_id AND f.j = r.j),
h AS (SELECT user_id, max(hits) AS hits FROM r GROUP BY 1) SELECT user_id, CAST(hits AS BIGINT) AS hits, t - hits AS misses, f - hits AS false_alarms FROM n JOIN h USING (user_id)""")
def event_matching(spark: SparkSession, d: str) -> DataFrame:
    """Clicks against purchases of a user, matched one to one within six hours."""
    df = events(spark, d)
    return matching.event_matches(df.where("event_type = 'purchase'"), df.where("event_type = 'click'"), ["user_id"], "us", 6 * 3_600_000_000)


@query(f"""WITH RECURSIVE {EVENTS}, o AS (SELECT user_id, event_id, us / 1000.0 AS ms, value, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e0),
r(user_id, event_id, i, ms, value, smooth, speed) AS (SELECT user_id, event_id, i, ms, value, value, CAST(0 AS DOUBLE) FROM o WHERE i = 1 UNION ALL
 SELECT user_id, event_id, i, ms, value, CASE WHEN dt <= 0 THEN value ELSE last + (value - last) / (1 + 1 / (2 * pi() * (0.00001 + 0.01 * abs(sp)) * dt)) END, CASE WHEN dt <= 0 THEN 0 ELSE sp END FROM (
  SELECT o.*, r.smooth AS last, (o.ms - r.ms) / 1000 AS dt, CASE WHEN o.ms > r.ms THEN r.speed + ((o.value - r.smooth) / ((o.ms - r.ms) / 1000) - r.speed) / (1 + 1 / (2 * pi() * 1.0 * ((o.ms - r.ms) / 1000))) END AS sp FROM r JOIN o ON o.user_id = r.user_id AND o.i = r.i + 1))
SELECT user_id, event_id, value, round(smooth, 6) AS smooth FROM r""")
def smoothed_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Values of each user through the speed-dependent low-pass filter."""
    df = events(spark, d).select("user_id", "event_id", (F.col("us") / 1000).alias("ms"), "value")
    return smoothing.one_euro(df, ["user_id"], "ms", "value", least_cutoff=1e-5).select("user_id", "event_id", "value", F.round("smooth", 6).alias("smooth"))


@query(f"""WITH RECURSIVE {EVENTS}, c AS (SELECT user_id, CAST(count(*) FILTER (WHERE event_type = 'error') AS BIGINT) AS hits, count(*) AS n FROM e0 GROUP BY 1),
b(user_id, hits, n, low, high, round) AS (SELECT user_id, hits, n, CAST(0 AS DOUBLE), CAST(1 AS DOUBLE), 0 FROM c WHERE hits < n UNION ALL
 SELECT user_id, hits, n, CASE WHEN few > 0.05 THEN mid ELSE low END, CASE WHEN few > 0.05 THEN high ELSE mid END, round + 1 FROM (SELECT *, (low + high) / 2 AS mid, list_sum(list_transform(range(0, hits + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln((low + high) / 2) + (n - i) * ln(1 - (low + high) / 2)))) AS few FROM b WHERE round < 45))
SELECT user_id, hits, n, round((low + high) / 2, 9) AS upper FROM b WHERE round = 45 UNION ALL SELECT user_id, hits, n, 1.0 FROM c WHERE hits = n""")
def error_bounds(spark: SparkSession, d: str) -> DataFrame:
    """Exact 95% upper bound of each user's share of errors."""
    counts = events(spark, d).groupBy("user_id").agg(F.sum((F.col("event_type") == "error").cast("long")).alias("hits"), F.count("*").alias("n"))
    return counts.withColumn("upper", F.round(bounds.exact_upper(F.col("hits"), F.col("n")), 9))
