"""Payload contracts, scores by terms and embedded sensor packets over the test tables."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, terms
from ..sources import episodes, klv
from .history_queries import EVENTS, events
from .report_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _ontology(spark: SparkSession, d: str) -> DataFrame:
    """Brands as objects, market segments as verbs (those of an even length are primitive), regions as events (odd ones with a severity), nations as gaps."""
    entry = lambda df, name, key, value=None, flags=None: df.select(F.lit(name).alias("dictionary"), key.alias("key"), (value if value is not None else F.lit(None).cast("string")).alias("value"), (flags if flags is not None else F.array().cast("array<string>")).alias("flags")).distinct()
    segment = F.col("c_mktsegment")
    return (
        entry(table(spark, d, "part"), "objects", F.col("p_brand"))
        .unionByName(entry(table(spark, d, "customer"), "verbs", segment, F.when(F.length(segment) % 2 == 0, "primitive").otherwise("skill")))
        .unionByName(entry(table(spark, d, "region"), "events", F.col("r_name"), F.lit("interval"), F.when(F.col("r_regionkey") % 2 == 1, F.array(F.lit("severity"))).otherwise(F.array().cast("array<string>"))))
        .unionByName(entry(table(spark, d, "nation"), "gap_types", F.col("n_name")))
    )


def _records(spark: SparkSession, d: str) -> DataFrame:
    """Events as label records, with a payload by their type; some name nothing that there is."""
    k = F.get_json_object("props", "$.k").cast("int")
    rows = events(spark, d).withColumn("k", k).withColumn("i", (F.col("event_id") % 6).cast("int"))
    regions = table(spark, d, "region").select(F.col("r_regionkey").alias("i"), "r_name")
    nations = table(spark, d, "nation").select((F.col("n_nationkey") * 2).alias("k"), "n_name")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_mktsegment")
    rows = rows.join(regions, "i", "left").join(nations, "k", "left").join(customers, "user_id", "left")
    brand = F.concat(F.lit("Brand#"), (F.col("k") % 7).cast("string"), (F.col("k") % 6).cast("string"))
    payload = lambda *fields: F.to_json(F.struct(*fields))
    text = (
        F.when(F.col("event_type") == "view", payload(F.concat(F.lit("e"), F.col("k")).alias("entity_id"), brand.alias("class_id"), F.array(F.lit(1)).alias("keyframes")))
        .when(F.col("event_type") == "click", payload(F.when(F.col("k") % 9 != 0, "s").alias("surface_id"), (F.col("value") / 50).alias("ratio")))
        .when(F.col("event_type") == "purchase", payload(F.lit("a").alias("action_id"), F.lit("left").alias("hand"), F.col("c_mktsegment").alias("verb"), F.col("k").alias("t_approach_ms"), F.lit(50).alias("t_end_ms")))
        .when(F.col("event_type") == "signup", payload(F.coalesce("r_name", F.lit("NOWHERE")).alias("event_type"), F.when(F.col("k") % 3 == 0, 1).alias("severity")))
        .otherwise(payload(F.coalesce("n_name", F.lit("ATLANTIS")).alias("gap_type")))
    )
    kind = F.coalesce(*(F.when(F.col("event_type") == e, n) for e, n in (("view", "box_track"), ("click", "coverage"), ("purchase", "action"), ("signup", "event"), ("error", "gap"))))
    version = F.when(F.col("event_id") % 50 == 0, "v0").otherwise("v1")
    return rows.select(F.col("event_id").cast("string").alias("label_id"), F.col("user_id").cast("string").alias("session_id"), kind.alias("kind"), version.alias("ontology_version"), F.col("us").alias("t_start_ms"), F.col("us").alias("t_end_ms"), F.parse_json(text).alias("payload"))


@query("""WITH e AS (SELECT *, CAST(json_extract(props, '$.k') AS INT) AS k FROM events), x AS (SELECT e.*, r_name, r_regionkey, n_name, c_mktsegment FROM e LEFT JOIN region ON r_regionkey = event_id % 6 LEFT JOIN nation ON n_nationkey * 2 = k LEFT JOIN customer ON c_custkey = user_id),
f AS (SELECT 'box_track' AS kind, 'objects unknown' AS fault FROM x WHERE event_type = 'view' AND 'Brand#' || k % 7 || k % 6 NOT IN (SELECT p_brand FROM part)
UNION ALL SELECT 'coverage', 'coverage lacks surface_id' FROM x WHERE event_type = 'click' AND k % 9 = 0 UNION ALL SELECT 'coverage', 'coverage beyond 0 to 1' FROM x WHERE event_type = 'click' AND NOT value / 50 BETWEEN 0 AND 1
UNION ALL SELECT 'action', 'action lacks verb' FROM x WHERE event_type = 'purchase' AND c_mktsegment IS NULL UNION ALL SELECT 'action', 'primitive_verbs unknown' FROM x WHERE event_type = 'purchase' AND length(c_mktsegment) % 2 = 1
UNION ALL SELECT 'action', 'action ends before it begins' FROM x WHERE event_type = 'purchase' AND k > 50
UNION ALL SELECT 'event', 'events unknown' FROM x WHERE event_type = 'signup' AND r_name IS NULL UNION ALL SELECT 'event', 'event lacks severity' FROM x WHERE event_type = 'signup' AND r_regionkey % 2 = 1 AND k % 3 <> 0
UNION ALL SELECT 'gap', 'gap_types unknown' FROM x WHERE event_type = 'error' AND n_name IS NULL
UNION ALL SELECT CASE event_type WHEN 'view' THEN 'box_track' WHEN 'click' THEN 'coverage' WHEN 'purchase' THEN 'action' WHEN 'signup' THEN 'event' ELSE 'gap' END, 'ontology version' FROM x WHERE event_id % 50 = 0)
SELECT kind, fault, count(*) AS n FROM f GROUP BY 1, 2""")
def payload_faults(spark: SparkSession, d: str) -> DataFrame:
    """Faults of all events as label records, by kind."""
    labels = _records(spark, d)
    found = contracts.label_faults(labels, _ontology(spark, d), "v1")
    return found.join(labels.select("label_id", "kind"), "label_id").groupBy("kind", "fault").agg(F.count("*").alias("n"))


WEIGHTS = {"correction_rate": 2.0, "uncertainty": 1.0, "novelty": 0.5}
_PARTS = """p AS (SELECT user_id, event_type, 2.0 * coalesce(n_rate, 0.05) + 1 - least(value, 100) / 100 + 0.5 * power(0.5, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) AS v,
  coalesce(n_rate, 0.05) AS a, 1 - least(value, 100) / 100 AS b, power(0.5, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) - 1) AS c
  FROM events LEFT JOIN (SELECT event_type, count(*) FILTER (value > 30) / count(*) AS n_rate FROM events WHERE event_type <> 'error' GROUP BY 1) USING (event_type))"""


def _contributions(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", "event_id", "us", F.col("event_type").alias("class"), "value", (F.least("value", F.lit(100.0)) / 100).alias("confidence"))
    rates = rows.where("class <> 'error'").groupBy("class").agg(F.avg((F.col("value") > 30).cast("double")).alias("rate"))
    return terms.contributions(rows.drop("value"), rates, "user_id", ["us", "event_id"], WEIGHTS, {"default_rate": 0.05})


@query(f"WITH {_PARTS} SELECT user_id, round(sum(a), 5) AS correction_rate, round(sum(b), 5) AS uncertainty, round(sum(c), 5) AS novelty, round(sum(v), 5) AS score FROM p GROUP BY 1")
def term_scores(spark: SparkSession, d: str) -> DataFrame:
    """Users by expected corrections, doubt and novelty of their events."""
    out = terms.session_scores(_contributions(spark, d), "user_id", WEIGHTS)
    return out.select("user_id", *(F.round(c, 5).alias(c) for c in (*WEIGHTS, "score")))


@query(f"WITH {_PARTS}, s AS (SELECT user_id, event_type, round(sum(v), 5) AS value FROM p GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_type) AS place FROM s) SELECT user_id, event_type AS class, value, place FROM r WHERE place <= 2")
def term_reasons(spark: SparkSession, d: str) -> DataFrame:
    """The two kinds of events that add most to each user's score."""
    out = terms.explained(_contributions(spark, d), "user_id", WEIGHTS, 2)
    return out.select("user_id", "class", F.round("value", 5).alias("value"), "place")


DAY_MS = 86_400_000


def _packet(events: list) -> bytes:
    """A packet of a day's events: hundredths of the value, and two parts of the id, as z, x and y turned round."""
    body = b"".join(v.to_bytes(4, "big", signed=True) for e in events for v in (round(e["value"] * 100), int(e["event_id"]) // 1000, int(e["event_id"]) % 1000))
    scale = klv.item("SCAL", "l", 4, 3, b"".join(v.to_bytes(4, "big") for v in (100, 1, 1)))
    return klv.nested("DEVC", klv.nested("STRM", scale + klv.item("ORIN", "c", 1, 3, b"ZXy") + klv.item("ACCL", "l", 12, len(events), body)))


@query(f"""WITH {EVENTS}, d AS (SELECT *, us // {DAY_MS * 1000} AS day FROM e0), n AS (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY us, event_id) - 1 AS i, count(*) OVER (PARTITION BY user_id, day) AS n FROM d),
p AS (SELECT DISTINCT user_id, day FROM d), l AS (SELECT *, lead(day) OVER (PARTITION BY user_id ORDER BY day) - day AS ahead FROM p), m AS (SELECT user_id, median(ahead) AS mid FROM l GROUP BY 1)
SELECT user_id, round(day * {DAY_MS}.0 + i * (coalesce(ahead, mid) * {DAY_MS}.0 / n), 2) AS t, CAST(event_id // 1000 AS DOUBLE) AS x, CAST(-(event_id % 1000) AS DOUBLE) AS y, round(value, 2) AS z FROM n JOIN l USING (user_id, day) JOIN m USING (user_id) WHERE mid IS NOT NULL""")
def embedded_readings(spark: SparkSession, d: str) -> DataFrame:
    """A day's events of a user packed as a sensor's packet, and read from it again; packets last until the next."""
    rows = events(spark, d).withColumn("day", F.expr(f"us div {DAY_MS * 1000}"))

    @F.pandas_udf("binary")
    def encoded(rows: pd.Series) -> pd.Series:
        return rows.map(_packet)

    days = rows.groupBy("user_id", "day").agg(F.sort_array(F.collect_list(F.struct("us", "event_id", "value"))).alias("e"))
    packets = days.select("user_id", (F.col("day") * DAY_MS).cast("double").alias("start"), F.lit(0.0).alias("duration"), encoded(F.transform("e", lambda e: F.struct(e["event_id"].alias("event_id"), e["value"].alias("value")))).alias("payload"))
    out = klv.sensor_samples(klv.with_durations(packets, "user_id", "start", "duration"), "user_id", "start", "duration", "payload", "ACCL")
    return out.select("user_id", F.round("t", 2).alias("t"), "x", "y", "z")


HOUR_MS = 3_600_000


@query(f"""WITH e AS (SELECT user_id, epoch_us(ts) / 1000.0 AS t, value FROM events), s AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY 1),
g AS (SELECT user_id, a, unnest(range(0, CAST(ceil((b - a) / {12 * HOUR_MS}.0 - 1e-9) AS BIGINT))) AS frame FROM s), q AS (SELECT user_id, frame, a + frame * {12 * HOUR_MS}.0 AS t FROM g),
p AS (SELECT q.*, x.t AS t0, x.value AS v0 FROM q ASOF JOIN e x ON x.user_id = q.user_id AND q.t >= x.t), n AS (SELECT p.*, y.t AS t1, y.value AS v1 FROM p ASOF JOIN e y ON y.user_id = p.user_id AND p.t <= y.t),
v AS (SELECT user_id, frame, CASE WHEN t0 = t THEN v0 WHEN t1 = t THEN v1 WHEN t1 - t0 <= {48 * HOUR_MS} THEN v0 + (v1 - v0) * (t - t0) / (t1 - t0) END AS v FROM n)
SELECT user_id, frame, round(coalesce(v, 0), 6) AS state, v IS NOT NULL AS valid, round(coalesce(lead(coalesce(v, 0)) OVER (PARTITION BY user_id ORDER BY frame), coalesce(v, 0)), 6) AS action FROM v""")
def episode_frames(spark: SparkSession, d: str) -> DataFrame:
    """A user's values on a grid of half days, with the state of the next frame as the action."""
    rows = events(spark, d).select("user_id", "event_id", (F.col("us") / 1000.0).alias("t"), "value")
    sessions = rows.groupBy("user_id").agg(F.min("t").alias("start"), F.max("t").alias("end"))
    grid = episodes.frame_grid(sessions, "user_id", "start", "end", 1 / 12, float(HOUR_MS))
    out = episodes.episode_rows(episodes.with_series(grid, "user_id", "v", rows, "event_id", "value", 48.0 * HOUR_MS), "user_id", ["v"])
    first = lambda c: F.element_at(c, 1)
    return out.select("user_id", "frame", F.round(first("state"), 6).alias("state"), first("valid").alias("valid"), F.round(first("action"), 6).alias("action"))
