"""Operational tables and weekly figures over the test tables, each with the SQL that says the same. Orders stand for assignments and work, lines for audits and judged units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import kpis
from ..sources import records
from .history_queries import EVENTS, HOUR, events

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


_WEEK = "strftime({}, '%G-W%V')"
_WORK = f"""w AS (SELECT {_WEEK.format("o_orderdate")} AS week, CASE WHEN o_orderstatus = 'F' THEN 'privacy' ELSE 'label' END AS stage, CAST(floor(o_totalprice / 10) AS BIGINT) AS seconds, CAST(o_orderkey % 7 * 60000 AS DOUBLE) AS video_ms FROM orders),
effort AS (SELECT week, sum(seconds) FILTER (stage <> 'privacy') / 60 / nullif(sum(video_ms) FILTER (stage <> 'privacy') / 3600000, 0) AS review_minutes_per_video_hour, sum(seconds) FILTER (stage = 'privacy') / 60 / nullif(sum(video_ms) FILTER (stage = 'privacy') / 3600000, 0) AS privacy_minutes_per_video_hour, sum(seconds) / 3600 AS review_hours FROM w GROUP BY 1)"""


def _work(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(F.col("o_orderdate").alias("recorded_at"), F.when(F.col("o_orderstatus") == "F", "privacy").otherwise("label").alias("stage"), F.floor(F.col("o_totalprice") / 10).alias("seconds"), (F.col("o_orderkey") % 7 * 60_000).cast("double").alias("video_ms"))


def _changes(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("o_orderstatus") == "F", "accepted").when(F.col("o_orderstatus") == "O", "corrected").when(F.col("o_orderkey") % 2 == 0, "deleted").otherwise("added")
    return table(spark, d, "orders").select(F.col("o_orderdate").alias("at"), outcome.alias("outcome"))


@query(f"""WITH {_WORK}, c AS (SELECT {_WEEK.format("o_orderdate")} AS week, CASE WHEN o_orderstatus = 'F' THEN 'accepted' WHEN o_orderstatus = 'O' THEN 'corrected' WHEN o_orderkey % 2 = 0 THEN 'deleted' ELSE 'added' END AS outcome FROM orders),
k AS (SELECT week, count(*) FILTER (outcome = 'accepted') AS accepted, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'deleted') AS deleted, count(*) FILTER (outcome = 'added') AS added FROM c GROUP BY 1),
s AS (SELECT {_WEEK.format("l_shipdate")} AS week, count(*) AS seeded_errors, count(*) FILTER (l_returnflag = 'R') AS seeded_found FROM lineitem GROUP BY 1), m AS (SELECT {_WEEK.format("l_shipdate")} AS week, count(*) AS privacy_audits, sum(l_linenumber) / nullif(sum(l_quantity * 60000) / 3600000, 0) AS misses_per_hour FROM lineitem GROUP BY 1),
d AS (SELECT week, count(*) AS finished FROM (SELECT {_WEEK.format("max(l_shipdate)")} AS week FROM lineitem GROUP BY l_orderkey) GROUP BY 1)
SELECT week, review_minutes_per_video_hour AS review_minutes_per_video_hour, privacy_minutes_per_video_hour AS privacy_minutes_per_video_hour, review_hours AS review_hours, accepted, corrected, deleted, added, (corrected + deleted + added) / nullif(accepted + corrected + deleted + added, 0) AS correction_rate, accepted / nullif(accepted + corrected + deleted, 0) AS auto_approval_rate,
seeded_errors, seeded_found, seeded_found / seeded_errors AS detection_rate, privacy_audits, misses_per_hour AS misses_per_hour, coalesce(finished, 0) AS finished_sessions, review_hours * 30 / nullif(coalesce(finished, 0), 0) AS cost_per_session FROM effort LEFT JOIN k USING (week) LEFT JOIN s USING (week) LEFT JOIN m USING (week) LEFT JOIN d USING (week)""")
def weekly_figures(spark: SparkSession, d: str) -> DataFrame:
    """Eight figures of each week, over work, changes, planted errors, audits and finished sessions."""
    lines = table(spark, d, "lineitem")
    effort = kpis.review_effort(_work(spark, d))
    parts = {
        "effort": effort, "changes": kpis.change_rates(_changes(spark, d)), "seeded": kpis.detection_rate(lines.select(F.col("l_shipdate").alias("completed_at"), (F.col("l_returnflag") == "R").alias("found"))),
        "audits": kpis.miss_rate(lines.select(F.col("l_shipdate").alias("audited_at"), F.col("l_linenumber").alias("misses"), (F.col("l_quantity") * 60_000).alias("duration_ms"), F.lit("a").alias("auditor"), F.lit("b").alias("blur_reviewer"))),
    }
    return kpis.weekly(effort, parts, 30.0, lines.groupBy("l_orderkey").agg(F.max("l_shipdate").alias("at")))


_JUDGED = "j AS (SELECT l_shipdate AS ts, l_returnflag, l_linestatus, l_discount > 0.05 AS flagged, l_discount > 0.03 AS later, CASE WHEN l_linenumber <> 3 THEN l_tax > 0.04 END AS wrong FROM lineitem)"


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(F.col("l_shipdate").alias("at"), "l_returnflag", "l_linestatus", (F.col("l_discount") > 0.05).alias("flagged"), (F.col("l_discount") > 0.03).alias("later"), F.when(F.col("l_linenumber") != 3, F.col("l_tax") > 0.04).alias("wrong"))


@query(f"""WITH {_JUDGED} SELECT {_WEEK.format("ts")} AS week, count(*) AS units, count(*) FILTER (flagged) / count(*) AS flagged_share, count(*) FILTER (flagged AND wrong) / nullif(count(*) FILTER (flagged AND wrong IS NOT NULL), 0) AS precision, count(*) FILTER (flagged AND wrong) / nullif(count(*) FILTER (wrong), 0) AS recall FROM j GROUP BY 1""")
def judge_weeks(spark: SparkSession, d: str) -> DataFrame:
    """A judge's flags by week."""
    return kpis.judge_figures(_judged(spark, d))


@query(f"""WITH {_JUDGED}, s AS (SELECT * FROM j WHERE wrong IS NOT NULL) SELECT l_linestatus, count(*) FILTER (flagged AND wrong) / nullif(count(*) FILTER (flagged), 0) AS precision_before, count(*) FILTER (flagged AND wrong) / nullif(count(*) FILTER (wrong), 0) AS recall_before, count(*) FILTER (later AND wrong) / nullif(count(*) FILTER (later), 0) AS precision_after, count(*) FILTER (later AND wrong) / nullif(count(*) FILTER (wrong), 0) AS recall_after FROM s GROUP BY 1""")
def calibration_effects(spark: SparkSession, d: str) -> DataFrame:
    return kpis.calibration_effect(_judged(spark, d), ["l_linestatus"], "flagged", "later", "wrong")


@query(f"""WITH {_JUDGED}, s AS (SELECT unnest(['all', 'l_returnflag=' || l_returnflag, 'l_linestatus=' || l_linestatus]) AS subgroup, * FROM j) SELECT subgroup, count(*) AS n, avg(CASE WHEN flagged THEN 1.0 ELSE 0.0 END) AS flagged_share FROM s GROUP BY 1""")
def subgroup_shares(spark: SparkSession, d: str) -> DataFrame:
    """Flags over all and by subgroup."""
    return kpis.subgroups(_judged(spark, d), [], ["l_returnflag", "l_linestatus"], F.count("*").alias("n"), F.avg(F.col("flagged").cast("double")).alias("flagged_share"))


@query("""SELECT p_type, count(*) AS units, round(sum(p_retailprice), 4) AS seconds, CAST(ceil(count(*) * 1.1 / (0.001 * 8 * 3600)) AS BIGINT) AS machines FROM part GROUP BY 1""")
def machine_load(spark: SparkSession, d: str) -> DataFrame:
    """Work by kind, and the machines it takes."""
    return kpis.load(table(spark, d, "part"), "p_type", F.col("p_retailprice"), 0.001, 8, 0.1).withColumn("seconds", F.round("seconds", 4))


@query(f"""WITH {EVENTS} SELECT user_id, round(quantile_cont(value, 0.5) FILTER (event_type <> 'error'), 6) AS p50, round(quantile_cont(value, 0.95) FILTER (event_type <> 'error'), 6) AS p95, count(*) FILTER (event_type <> 'error') / 60.0 AS per_second, avg(CASE WHEN event_type = 'error' THEN 1.0 ELSE 0.0 END) AS error_share, avg(CASE WHEN event_type = 'view' THEN 1.0 ELSE 0.0 END) AS cache_share FROM e0 GROUP BY 1""")
def call_latencies(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).select("user_id", F.col("value").alias("latency"), (F.col("event_type") != "error").alias("ok"), (F.col("event_type") == "view").alias("cached"))
    return kpis.latencies(rows, ["user_id"], F.lit(60.0)).withColumn("p50", F.round("p50", 6)).withColumn("p95", F.round("p95", 6))


@query(f"""WITH {EVENTS}, t AS (SELECT event_type, us // 1000 AS s, us // 1000 + (event_id % 9) * 1000 AS e, event_id % 5 AS k FROM e0) SELECT event_type, count(*) AS tracks, count(*) / 600.0 AS per_minute, quantile_cont(CAST(e - s AS DOUBLE), 0.5) AS median_ms, round(quantile_cont(CAST(e - s AS DOUBLE), 0.9), 3) AS p90_ms, quantile_cont(CAST(k AS DOUBLE), 0.5) AS median_keyframes, avg(CASE WHEN e - s < 2000 THEN 1.0 ELSE 0.0 END) AS short_share FROM t GROUP BY 1""")
def track_figures(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of tracks by kind."""
    start = F.floor(F.col("us") / 1000)
    rows = events(spark, d).select("event_type", start.alias("t_start_ms"), (start + F.col("event_id") % 9 * 1000).alias("t_end_ms"), (F.col("event_id") % 5).alias("keyframes"))
    return kpis.track_figures(rows, ["event_type"], F.lit(600.0), 2000).withColumn("p90_ms", F.round("p90_ms", 3))


@query(f"""WITH {EVENTS}, f AS (SELECT user_id, us // {HOUR} AS h, count(*) AS n FROM e0 GROUP BY 1, 2), g AS (SELECT *, CASE WHEN h - lag(h) OVER (PARTITION BY user_id ORDER BY h) <= 12 THEN 0 ELSE 1 END AS fresh FROM f)
SELECT user_id, count(*) AS frames, avg(n) AS per_frame, CAST(sum(fresh) AS BIGINT) AS runs, sum(fresh) / 600.0 AS flicker FROM g GROUP BY 1""")
def presence_figures(spark: SparkSession, d: str) -> DataFrame:
    """Runs of each user's hours with events."""
    return kpis.presence_figures(events(spark, d).withColumn("h", F.floor(F.col("us") / HOUR)), ["user_id"], "h", 12, F.lit(600.0))


@query("""SELECT o_orderpriority, count(*) AS tasks, round(avg(CASE WHEN o_orderkey % 5 <> 0 THEN (o_orderkey % 3) / (o_orderkey % 5) END), 9) AS coverage FROM orders GROUP BY 1""")
def exposures(spark: SparkSession, d: str) -> DataFrame:
    return kpis.exposure(table(spark, d, "orders").withColumn("shown", F.col("o_orderkey") % 3).withColumn("units", F.col("o_orderkey") % 5), ["o_orderpriority"]).withColumn("coverage", F.round("coverage", 9))


@query("SELECT p_brand, count(*) AS n FROM part GROUP BY 1 HAVING count(*) < (SELECT count(*) FROM part) / 25")
def under_sampled(spark: SparkSession, d: str) -> DataFrame:
    """Brands with less than their share of the parts."""
    parts = table(spark, d, "part")
    return kpis.under_sampled(parts, "p_brand", parts.count() / 25)


@query("""WITH f AS (SELECT doc_id, lang, unnest(list_filter([CASE WHEN n_chars < 300 THEN 'short' END, CASE WHEN contains(text, '!') THEN 'loud' END, CASE WHEN source IS NULL THEN 'homeless' END], lambda x: x IS NOT NULL)) AS flag FROM documents) SELECT lang, flag, count(*) AS n FROM f GROUP BY 1, 2""")
def flag_counts(spark: SparkSession, d: str) -> DataFrame:
    """Flags of documents by language."""
    flags = F.array_compact(F.array(F.when(F.col("n_chars") < 300, "short"), F.when(F.contains("text", F.lit("!")), "loud"), F.when(F.col("source").isNull(), "homeless")))
    return kpis.flag_counts(table(spark, d, "documents").withColumn("flags", flags), ["lang"], "flags")


@query("""SELECT o_custkey, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderkey, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS o_orderstatus, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1""")
def latest_states(spark: SparkSession, d: str) -> DataFrame:
    """The last row of each customer's log of orders."""
    return records.latest(table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("""SELECT o_orderkey, o_custkey, o_orderstatus, o_orderdate FROM orders WHERE o_orderstatus IN ('F', 'P') AND o_orderdate >= TIMESTAMP '1994-01-01' AND o_orderdate < TIMESTAMP '1996-01-01'""")
def scanned_between(spark: SparkSession, d: str) -> DataFrame:
    """A scan by value and time; both conditions reach the files."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")
    return records.where(rows, {"o_orderstatus": ["F", "P"], "o_custkey": None}, "o_orderdate", F.lit("1994-01-01").cast("timestamp"), F.lit("1996-01-01").cast("timestamp"))


@query("""WITH o AS (SELECT o_custkey, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT c_custkey AS o_custkey, coalesce(n, 0) AS n FROM customer LEFT JOIN o ON o_custkey = c_custkey""")
def open_counts(spark: SparkSession, d: str) -> DataFrame:
    """Open orders of each customer, none included."""
    return records.open_counts(table(spark, d, "orders"), "o_custkey", "o_orderstatus", ["F"], table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey")))


@query("""WITH c AS (SELECT l_orderkey, struct_pack(a := l_linenumber, b := l_partkey, c := l_suppkey, d := l_extendedprice) AS o, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS flag, CASE WHEN l_linenumber % 2 = 0 THEN l_linestatus END AS st FROM lineitem),
f AS (SELECT l_orderkey, arg_max(flag, o) FILTER (flag IS NOT NULL) AS flag, arg_max(st, o) FILTER (st IS NOT NULL) AS st FROM c GROUP BY 1) SELECT o_orderkey, coalesce(flag, o_orderpriority) AS o_orderpriority, coalesce(st, o_orderstatus) AS o_orderstatus FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def revised_orders(spark: SparkSession, d: str) -> DataFrame:
    """Orders as the changes of their lines leave them."""
    changes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("o_orderpriority"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linestatus")).alias("o_orderstatus"))
    return records.revised(table(spark, d, "orders").select("o_orderkey", "o_orderpriority", "o_orderstatus"), changes, ["o_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["o_orderpriority", "o_orderstatus"])


_REG = f"{EVENTS}, reg AS (SELECT event_id AS record_id, user_id, us, value FROM e0 WHERE event_type = 'purchase'), inv AS (SELECT user_id, us, CASE WHEN event_id % 2 = 0 THEN lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) END AS record_id, event_type FROM e0)"


@query(f"""WITH {_REG}, i AS (SELECT * FROM inv WHERE event_type = 'error'), w AS (SELECT user_id, max(us) AS until FROM i WHERE record_id IS NULL GROUP BY 1), r AS (SELECT reg.* FROM reg LEFT JOIN w USING (user_id) WHERE record_id NOT IN (SELECT record_id FROM i WHERE record_id IS NOT NULL) AND (until IS NULL OR us > until))
SELECT user_id, arg_max(record_id, struct_pack(us := us, id := record_id)) AS record_id, max(us) AS us, arg_max(value, struct_pack(us := us, id := record_id)) AS value FROM r GROUP BY 1""")
def effective_records(spark: SparkSession, d: str) -> DataFrame:
    """The last purchase of each user that no error takes away: one names the event before it, or all before."""
    from pyspark.sql import window as W

    rows = events(spark, d)
    before = F.lag("event_id").over(W.Window.partitionBy("user_id").orderBy("us", "event_id"))
    named = rows.select("user_id", "us", F.when(F.col("event_id") % 2 == 0, before).alias("record_id"), "event_type").where("event_type = 'error'").drop("event_type")
    return records.effective(rows.where("event_type = 'purchase'").select("user_id", "us", F.col("event_id").alias("record_id"), "value"), named, ["user_id"], "record_id", "us")


@query(f"""WITH {EVENTS}, h AS (SELECT user_id, us, CASE WHEN event_type IN ('error', 'signup') THEN 'hold' ELSE 'release' END AS action FROM e0 WHERE event_type <> 'view') SELECT user_id FROM h GROUP BY 1 HAVING arg_max(action, us) = 'hold'""")
def held_users(spark: SparkSession, d: str) -> DataFrame:
    """Users whose last event but views holds them."""
    rows = events(spark, d).where("event_type <> 'view'").select("user_id", "us", F.when(F.col("event_type").isin("error", "signup"), "hold").otherwise("release").alias("action"))
    return records.held(rows, ["user_id"], "us", "action")


@query("""WITH l AS (SELECT o_custkey, arg_max(o_orderstatus, struct_pack(d := o_orderdate, k := o_orderkey)) AS s, arg_max(o_orderkey, struct_pack(d := o_orderdate, k := o_orderkey)) AS k FROM orders GROUP BY 1), f AS (SELECT o_custkey, CAST(max(o_orderdate) AS DATE) AS finished_on FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)
SELECT c_custkey AS session_id, finished_on + 365 AS due_on, CASE WHEN s = 'P' THEN 'deleted' WHEN s = 'O' AND k % 2 = 0 THEN 'kept' WHEN finished_on IS NULL THEN 'waiting' WHEN finished_on + 365 <= DATE '1996-01-01' THEN 'due' WHEN finished_on + 365 - 90 <= DATE '1996-01-01' THEN 'soon' ELSE 'waiting' END AS status FROM customer LEFT JOIN l ON l.o_custkey = c_custkey LEFT JOIN f ON f.o_custkey = c_custkey""")
def retention(spark: SparkSession, d: str) -> DataFrame:
    """Retention of customers: their last order decides, a finished one starts the clock."""
    orders = table(spark, d, "orders")
    log = records.latest(orders.select("o_custkey", "o_orderkey", "o_orderstatus", "o_orderdate"), ["o_custkey"], "o_orderdate", "o_orderkey")
    decision = F.when(F.col("o_orderstatus") == "P", "delete").when((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0), "keep").otherwise("none")
    decisions = log.select(F.col("o_custkey").alias("session_id"), F.col("o_orderdate").alias("decided_at"), decision.alias("decision"), F.lit(None).cast("date").alias("until"))
    finished = orders.where("o_orderstatus = 'F'").groupBy(F.col("o_custkey").alias("session_id")).agg(F.to_date(F.max("o_orderdate")).alias("finished_on"))
    return records.due(table(spark, d, "customer").select(F.col("c_custkey").alias("session_id")), decisions, finished, F.lit("1996-01-01").cast("date"), 365, 90)
