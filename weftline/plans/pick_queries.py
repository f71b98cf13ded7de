"""Choices, plans, sets, signals and scalars over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry, rotations, runlength, text, times
from ..operators import picks, poses, signals
from .history_queries import EVENTS, HOUR, events
from .label_queries import RECORDS, records
from .shop_queries import table

QUERIES, ORACLES = {}, {}
DAY = 24 * HOUR


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


_GRADE = "CASE WHEN source = 'human' OR state = 'human_corrected' THEN 3 WHEN state = 'human_approved' THEN 2 WHEN state = 'sample_verified' THEN 1 ELSE 0 END"


@query(f"""WITH {RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY session_id, entity_id ORDER BY (source = 'human' OR state <> 'unreviewed') DESC, created_at DESC, t_end_ms - t_start_ms DESC, label_id DESC) AS place FROM rec WHERE kind = 'box_track') SELECT session_id, entity_id, label_id FROM r WHERE place = 1""")
def best_tracks(spark: SparkSession, d: str) -> DataFrame:
    """The track of each entity that counts."""
    return picks.best(records(spark, d).where("kind = 'box_track'"), ["session_id", "entity_id"], picks.rank()).select("session_id", "entity_id", "label_id")


@query(f"""WITH {RECORDS}, r AS (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY (source = 'human' OR state <> 'unreviewed') DESC, created_at DESC, t_end_ms - t_start_ms DESC, label_id DESC) AS place FROM rec WHERE kind = 'hand_state') SELECT label_id, kind FROM r WHERE place = 1 UNION ALL SELECT label_id, kind FROM rec WHERE kind <> 'hand_state'""")
def lifted_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Hand states by their best record, all else whole."""
    return picks.best_of_kinds(records(spark, d), ["hand_state"], "entity_id", picks.rank()).select("label_id", "kind")


@query(f"""WITH {RECORDS}, t AS (SELECT *, CASE WHEN source = 'sensor' THEN 'ko' ELSE 'en' END AS language FROM rec), r AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY {_GRADE} DESC, created_at DESC, label_id) AS place FROM t WHERE language = 'en' AND (parent_label_id IS NULL OR parent_label_id IN (SELECT label_id FROM t))) SELECT session_id, label_id FROM r WHERE place = 1""")
def preferred_descriptions(spark: SparkSession, d: str) -> DataFrame:
    """The description of each session in one language."""
    rows = records(spark, d).withColumn("language", F.when(F.col("source") == "sensor", "ko").otherwise("en"))
    return picks.translations(rows, "session_id", "en", "parent_label_id").select("session_id", "label_id")


@query(f"""WITH {EVENTS} SELECT event_id, (row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) - 1) // 4 AS chunk FROM e0""")
def target_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Targets of each user in requests of four."""
    return picks.chunks(events(spark, d), ["user_id"], ["us", "event_id"], 4).select("event_id", "chunk")


@query(f"""WITH {EVENTS}, s AS (SELECT user_id, min(us) AS a, max(us) AS b FROM e0 GROUP BY 1), k AS (SELECT *, unnest(range(0, greatest(CAST(ceil((b - a) / {3 * DAY}.0) AS BIGINT), 1))) AS w FROM s) SELECT user_id, w AS "window", a + w * {3 * DAY} AS "from", least(a + (w + 1) * {3 * DAY}, b) AS "to" FROM k""")
def plan_windows(spark: SparkSession, d: str) -> DataFrame:
    """Three-day windows over each user's events."""
    spans = events(spark, d).groupBy("user_id").agg(F.min("us").alias("a"), F.max("us").alias("b"))
    return picks.windows(spans, ["user_id"], "a", "b", 3 * DAY)


@query(f"""WITH RECURSIVE {EVENTS}, s AS (SELECT user_id, us AS a, us + (1 + event_id % 4) * {6 * HOUR} AS b FROM e0), r(user_id, us) AS (SELECT user_id, min(b) FROM s GROUP BY 1 UNION ALL SELECT r.user_id, (SELECT min(b) FROM s WHERE s.user_id = r.user_id AND s.a > r.us) FROM r WHERE EXISTS (SELECT 1 FROM s WHERE s.user_id = r.user_id AND s.a > r.us)) SELECT user_id, us AS "at" FROM r""")
def covering_moments(spark: SparkSession, d: str) -> DataFrame:
    """The fewest moments that meet all of a user's intervals."""
    spans = events(spark, d).select("user_id", F.col("us").alias("a"), (F.col("us") + (1 + F.col("event_id") % 4) * 6 * HOUR).alias("b"))
    return picks.covering_moments(spans, ["user_id"], "a", "b")


@query("""WITH o AS (SELECT o_orderkey, o_custkey, o_orderpriority AS site FROM orders), t AS (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P'), r AS (SELECT * FROM o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM t)), c AS (SELECT o_custkey, site, count(*) AS n FROM r GROUP BY 1, 2), w AS (SELECT site, sum(n) AS whole FROM c GROUP BY 1),
k AS (SELECT o_custkey, sum(whole - n) AS shared, sum(n) AS own FROM c JOIN w USING (site) GROUP BY 1), b AS (SELECT *, coalesce(sum(own) OVER (ORDER BY shared, o_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM k) SELECT o_orderkey FROM r WHERE o_custkey IN (SELECT o_custkey FROM b WHERE before < 100)""")
def golden_proposal(spark: SparkSession, d: str) -> DataFrame:
    """Orders of whole customers for a golden set."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderpriority").alias("site"))
    return picks.golden(orders, "o_orderkey", "o_custkey", "site", 100, table(spark, d, "orders").where("o_orderstatus = 'P'"))


@query("""WITH c AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS site FROM orders), m AS (SELECT l_orderkey AS o_orderkey, l_returnflag AS v FROM lineitem WHERE l_quantity >= 50 AND l_discount > 0.09), g AS (SELECT DISTINCT c.* FROM c JOIN m USING (o_orderkey) WHERE v = 'A'), o AS (SELECT DISTINCT c.* FROM c JOIN m USING (o_orderkey) WHERE v <> 'A')
SELECT o_orderkey, CASE WHEN o_orderkey IN (SELECT o_orderkey FROM g) THEN 'golden' WHEN o_custkey IN (SELECT o_custkey FROM g UNION ALL SELECT o_custkey FROM o) OR site IN (SELECT site FROM g UNION ALL SELECT site FROM o) THEN 'holdout' ELSE 'pool' END AS side FROM c""")
def golden_sides(spark: SparkSession, d: str) -> DataFrame:
    """Sides of orders when every golden set blocks its customers and days."""
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.col("o_orderdate").cast("date").alias("site"))
    sets = table(spark, d, "lineitem").where("l_quantity >= 50 and l_discount > 0.09").groupBy(F.col("l_returnflag").alias("golden_version")).agg(F.collect_set("l_orderkey").alias("session_ids"))
    return picks.golden_sides(orders, "o_orderkey", "o_custkey", "site", sets, "A").select("o_orderkey", "side")


@query("""SELECT year(o_orderdate) AS version_id, count(DISTINCT o_custkey) AS sessions FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) GROUP BY 1""")
def withdrawn_versions(spark: SparkSession, d: str) -> DataFrame:
    """Years that hold customers who have withdrawn."""
    versions = table(spark, d, "orders").select(F.year("o_orderdate").alias("version_id"), F.col("o_custkey").alias("session_id"))
    return picks.withdrawn(versions, table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("session_id")))


@query("""SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)""")
def uncovered_targets(spark: SparkSession, d: str) -> DataFrame:
    """Customers that no order has reached."""
    return picks.without(table(spark, d, "customer").select("c_custkey"), table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")), ["c_custkey"])


_GUARD = f"{EVENTS}, n AS (SELECT user_id, event_id, us AS s, us + {HOUR} AS e FROM e0 WHERE event_type <> 'purchase'), g AS (SELECT user_id, us AS gs, us + {2 * HOUR} AS ge FROM e0 WHERE event_type = 'purchase')"


def _guarded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = events(spark, d).select("user_id", "event_id", "event_type", F.col("us").alias("s"))
    new, guards = rows.where("event_type <> 'purchase'"), rows.where("event_type = 'purchase'")
    return new.select("user_id", "event_id", "s", (F.col("s") + HOUR).alias("e")), guards.select("user_id", "s", (F.col("s") + 2 * HOUR).alias("e"))


@query(f"WITH {_GUARD} SELECT user_id, event_id, s, e FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = n.user_id AND s < ge AND gs < e)")
def unprotected_spans(spark: SparkSession, d: str) -> DataFrame:
    """Intervals that no purchase guards."""
    new, guards = _guarded(spark, d)
    return picks.unprotected(new, guards, ["user_id"], "event_id", ("s", "e"), 2 * HOUR).select("user_id", "event_id", "s", "e")


_LOW, _HIGH = 1_704_067_200_000_000, 1_706_745_600_000_000


@query(f"""WITH {_GUARD}, k AS (SELECT user_id, event_id, s, e FROM n WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.user_id = n.user_id AND s < ge AND gs < e)), c AS (SELECT user_id, greatest(s, {_LOW}) AS s, least(e, {_HIGH}) AS e FROM k), f AS (SELECT *, max(e) OVER (PARTITION BY user_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM c WHERE e > s),
h AS (SELECT user_id, coalesce(before, {_LOW}) AS s, s AS e FROM f WHERE s > coalesce(before, {_LOW}) UNION ALL SELECT user_id, max(e), {_HIGH} FROM f GROUP BY 1 HAVING max(e) < {_HIGH}) SELECT user_id, event_id, s, e FROM k UNION ALL SELECT user_id, NULL, s, e FROM h""")
def gapless_spans(spark: SparkSession, d: str) -> DataFrame:
    """A timeline without gaps of what is left beside protected spans."""
    new, guards = _guarded(spark, d)
    kept = picks.unprotected(new, guards, ["user_id"], "event_id", ("s", "e"), 2 * HOUR)
    return picks.gapless(kept, ["user_id"], "event_id", ("s", "e"), _LOW, _HIGH)


@query("""WITH a AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS i FROM orders WHERE o_orderdate < TIMESTAMP '1996-01-01'), b AS (SELECT DISTINCT o_custkey AS k, o_orderpriority AS i FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01'),
m AS (SELECT k, count(*) AS missing FROM (SELECT * FROM a EXCEPT SELECT * FROM b) GROUP BY 1), x AS (SELECT k, count(*) AS extra FROM (SELECT * FROM b EXCEPT SELECT * FROM a) GROUP BY 1) SELECT k, coalesce(missing, 0) AS missing, coalesce(extra, 0) AS extra FROM m FULL JOIN x USING (k)""")
def truth_lag(spark: SparkSession, d: str) -> DataFrame:
    """How each customer's set of priorities has aged."""
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderpriority").alias("i"), "o_orderdate")
    return picks.lag(rows.where("o_orderdate < timestamp'1996-01-01'"), rows.where("o_orderdate >= timestamp'1996-01-01'"), ["k"], "i")


@query(f"""WITH {RECORDS}, a AS (SELECT user_id AS session_id, 'a' || user_id AS assignment_id, CASE user_id % 4 WHEN 0 THEN 'standard' WHEN 1 THEN 'blind' WHEN 2 THEN 'only' ELSE 'withheld' END AS mode, list('l' || event_id) FILTER (event_type = 'click') AS ids FROM events GROUP BY user_id)
SELECT assignment_id, label_id FROM rec JOIN a USING (session_id) WHERE mode = 'standard' OR (mode = 'only' AND coalesce(list_contains(ids, label_id), false)) OR (mode = 'withheld' AND NOT coalesce(list_contains(ids, label_id), false))""")
def shown_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that each assignment shows."""
    mode = F.when(F.col("user_id") % 4 == 0, "standard").when(F.col("user_id") % 4 == 1, "blind").when(F.col("user_id") % 4 == 2, "only").otherwise("withheld")
    ids = F.collect_list(F.when(F.col("event_type") == "click", F.concat(F.lit("l"), F.col("event_id").cast("string"))))
    plan = events(spark, d).groupBy("user_id").agg(ids.alias("ids")).select(F.col("user_id").alias("session_id"), F.concat(F.lit("a"), F.col("user_id").cast("string")).alias("assignment_id"), mode.alias("mode"), "ids")
    return picks.shown(records(spark, d), plan)


@query("""WITH n AS (SELECT p_brand AS old, CASE WHEN p_size > 25 THEN 'big ' || p_brand WHEN p_size > 1 THEN p_type END AS new FROM part WHERE p_partkey < 40), o AS (SELECT old, count(new) AS n, min(new) AS new FROM n GROUP BY 1)
SELECT p_partkey, CASE WHEN n <> 1 OR new IS NULL THEN p_brand ELSE new END AS p_brand, coalesce(n <> 1, false) AS needs_review FROM part LEFT JOIN o ON old = p_brand""")
def migrated_brands(spark: SparkSession, d: str) -> DataFrame:
    """Parts under a new vocabulary of brands, which the first forty name."""
    parts = table(spark, d, "part")
    names = parts.where("p_partkey < 40").select(F.col("p_brand").alias("old"), F.when(F.col("p_size") > 25, F.concat(F.lit("big "), "p_brand")).when(F.col("p_size") > 1, F.col("p_type")).alias("new"))
    return picks.migrated(parts.select("p_partkey", "p_brand"), "p_brand", names)


_DRAW = "CAST(('0x' || substr(sha256('7:' || label_id || ':{}'), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0"


@query(f"""WITH {RECORDS}, r AS (SELECT *, {_DRAW.format("edit")} AS u, row_number() OVER (PARTITION BY session_id ORDER BY {_DRAW.format("seed")}, label_id) AS place FROM rec), x AS (SELECT *, CASE CAST(floor(u * 3) AS INT) WHEN 0 THEN 'shifted' WHEN 1 THEN 'renamed' ELSE 'cut' END AS error FROM r WHERE place <= 2)
SELECT label_id, CASE WHEN error = 'shifted' THEN t_start_ms + 500 ELSE t_start_ms END AS t_start_ms, CASE WHEN error = 'cut' THEN t_start_ms ELSE t_end_ms END AS t_end_ms, CASE WHEN error = 'renamed' THEN 'e0' ELSE entity_id END AS entity_id, error FROM x""")
def seeded_errors(spark: SparkSession, d: str) -> DataFrame:
    """Two planted errors in each session."""
    edits = {"shifted": {"t_start_ms": F.col("t_start_ms") + 500}, "renamed": {"entity_id": F.lit("e0")}, "cut": {"t_end_ms": F.col("t_start_ms")}}
    return picks.seeded_errors(records(spark, d), ["session_id"], "label_id", 7, 2, edits).select("label_id", "t_start_ms", "t_end_ms", "entity_id", "error")


@query(None)
def balanced_assignments(spark: SparkSession, d: str) -> DataFrame:
    """Orders, dearest first, to the clerk with least to do."""
    loads = spark.createDataFrame([("ada", 3), ("ben", 0), ("cy", 40)], "reviewer string, load long")
    return picks.least_loaded(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", [F.desc("o_totalprice"), F.asc("o_orderkey")], loads, "reviewer", "load")


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, us / 1000.0 AS ms, us / 1000.0 - lag(us / 1000.0) OVER (PARTITION BY user_id ORDER BY us) AS gap FROM e0), a AS (SELECT user_id, count(*) AS n, quantile_cont(gap, 0.5) AS m, min(gap) AS lo, max(gap) AS hi, max(ms) AS last FROM g GROUP BY 1)
SELECT user_id, n, round(1000 / nullif(m, 0), 12) AS rate, round(last + coalesce(m, 0), 3) AS duration, coalesce(n >= 3 AND hi - lo > greatest(1.0, floor(lo / 100)), false) AS varies FROM a""")
def sampling_figures(spark: SparkSession, d: str) -> DataFrame:
    """Rates and gaps of each user's events."""
    out = signals.sampling(events(spark, d).withColumn("ms", F.col("us") / 1000), ["user_id"], "ms")
    return out.withColumn("rate", F.round("rate", 12)).withColumn("duration", F.round("duration", 3))


@query(f"""WITH {EVENTS}, p AS (SELECT event_id, user_id, us, value, event_id % 100 AS y FROM e0) SELECT event_id, CASE WHEN us - lag(us) OVER w <= {2 * DAY} AND lead(us) OVER w - us <= {2 * DAY} THEN round(sqrt(pow(lead(value) OVER w - 2 * value + lag(value) OVER w, 2) + pow(lead(y) OVER w - 2 * y + lag(y) OVER w, 2)) / 10, 6) END AS jitter FROM p WINDOW w AS (PARTITION BY user_id ORDER BY us)""")
def wrist_jitter(spark: SparkSession, d: str) -> DataFrame:
    """Second differences of each user's values."""
    rows = events(spark, d).withColumn("y", F.col("event_id") % 100).withColumn("scale", F.lit(10.0))
    return signals.jitter(rows, ["user_id"], "us", "value", "y", "scale", 2 * DAY).select("event_id", F.round("jitter", 6).alias("jitter"))


@query(f"""WITH {EVENTS}, s AS (SELECT *, sqrt(value * value + (event_id % 7) * (event_id % 7)) AS size FROM e0), m AS (SELECT user_id, quantile_cont(size, 0.5) AS m FROM s GROUP BY 1) SELECT event_id, round(abs(size - m), 6) AS motion FROM s JOIN m USING (user_id)""")
def motion_sizes(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("b", (F.col("event_id") % 7).cast("double"))
    return signals.motion(rows, ["user_id"], ["value", "b"]).select("event_id", F.round("motion", 6).alias("motion"))


@query(f"""WITH {EVENTS}, m AS (SELECT user_id, quantile_cont(value, 0.5) AS m FROM e0 GROUP BY 1), v AS (SELECT user_id, m, quantile_cont(abs(value - m), 0.5) AS dv FROM e0 JOIN m USING (user_id) GROUP BY 1, 2), a AS (SELECT e0.user_id, us, value, value > m + 1.2 * dv AS above, sum(CASE WHEN value > m + 1.2 * dv THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY us) AS stretch FROM e0 JOIN v USING (user_id))
SELECT user_id, min(us) AS start, max(us) AS "end", arg_min(us, struct_pack(v := -value, t := us)) AS "at" FROM a WHERE above GROUP BY user_id, stretch HAVING max(us) - min(us) <= {2 * DAY}""")
def pulses(spark: SparkSession, d: str) -> DataFrame:
    """Short stretches in which a user's values stand out."""
    return signals.pulses(events(spark, d), ["user_id"], "us", "value", 1.2, 2 * DAY)


@query(f"""WITH {EVENTS}, c AS (SELECT user_id, us, lead(us) OVER w AS nxt, coalesce(lead(us) OVER w - us BETWEEN {HOUR} AND {18 * HOUR}, false) AS near FROM e0 WINDOW w AS (PARTITION BY user_id ORDER BY us)), r AS (SELECT *, sum(CASE WHEN lag(near, 1, false) OVER w2 THEN 0 ELSE 1 END) OVER w2 AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n FROM c) WINDOW w2 AS (PARTITION BY user_id ORDER BY us))
SELECT user_id, us AS first, nxt AS second FROM (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY us) AS place FROM r) WHERE near AND place % 2 = 1""".replace("sum(CASE WHEN lag(near, 1, false) OVER w2 THEN 0 ELSE 1 END) OVER w2 AS run FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY us) AS n FROM c) WINDOW w2 AS (PARTITION BY user_id ORDER BY us)", "sum(fresh) OVER (PARTITION BY user_id ORDER BY us) AS run FROM (SELECT *, CASE WHEN lag(near, 1, false) OVER (PARTITION BY user_id ORDER BY us) THEN 0 ELSE 1 END AS fresh FROM c)"))
def double_taps(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of events one to eighteen hours apart."""
    return signals.double_taps(events(spark, d).select("user_id", F.col("us").alias("at")), ["user_id"], HOUR, 18 * HOUR)


@query(f"""WITH {EVENTS}, s AS (SELECT *, sum(CASE WHEN event_type <> 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY us) AS g FROM e0), l AS (SELECT event_id, us, first_value(us) OVER (PARTITION BY user_id, g ORDER BY us) AS t, first_value(value) OVER (PARTITION BY user_id, g ORDER BY us) AS v, g FROM s) SELECT event_id, CASE WHEN g > 0 AND us - t <= {DAY} THEN v END AS filled FROM l""")
def held_values(spark: SparkSession, d: str) -> DataFrame:
    """Errors filled with the value before them, if it is at most a day old."""
    return signals.held(events(spark, d), ["user_id"], "us", F.col("value"), F.col("event_type") == "error", DAY).select("event_id", "filled")


@query(f"""WITH {EVENTS}, g AS (SELECT user_id, min(us) AS lo, max(us) AS hi FROM e0 GROUP BY 1), k AS (SELECT user_id, unnest(range(0, (hi - lo) // {2 * DAY} + 1)) AS place, lo FROM g), t AS (SELECT user_id, place, lo + place * {2 * DAY} AS us FROM k),
b AS (SELECT t.user_id, place, t.us, (SELECT max(us) FROM e0 WHERE e0.user_id = t.user_id AND e0.us <= t.us) AS t0, (SELECT min(us) FROM e0 WHERE e0.user_id = t.user_id AND e0.us >= t.us) AS t1 FROM t)
SELECT b.user_id, place, round(CASE WHEN t0 = t1 THEN x.value ELSE x.value + (y.value - x.value) * (b.us - t0) / (t1 - t0) END, 6) AS value FROM b JOIN e0 x ON x.user_id = b.user_id AND x.us = t0 JOIN e0 y ON y.user_id = b.user_id AND y.us = t1""")
def resampled_values(spark: SparkSession, d: str) -> DataFrame:
    """Values of each user on a two-day grid."""
    return signals.resampled(events(spark, d).select("user_id", "event_id", "us", "value"), ["user_id"], "us", "value", "event_id", 2 * DAY).select("user_id", F.col("place").cast("long").alias("place"), F.round("value", 6).alias("value"))


@query("""WITH w AS (SELECT o_orderkey, o_orderdate, strftime(o_orderdate, '%G-W%V') AS week FROM orders) SELECT o_orderkey, date_trunc('week', o_orderdate)::TIMESTAMP AS low, date_trunc('week', o_orderdate)::TIMESTAMP + INTERVAL 7 DAY AS high, strftime(o_orderdate - INTERVAL 14 DAY, '%G-W%V') || ',' || strftime(o_orderdate - INTERVAL 7 DAY, '%G-W%V') || ',' || week AS weeks FROM w""")
def week_bounds(spark: SparkSession, d: str) -> DataFrame:
    """The week of each order from its name, and the weeks up to it."""
    week = times.iso_week(F.col("o_orderdate"))
    rows = table(spark, d, "orders").select("o_orderkey", week.alias("week"))
    low, high = times.week_bounds(F.col("week"))
    return rows.select("o_orderkey", low.alias("low"), high.alias("high"), F.array_join(times.weeks_before(F.col("week"), 3), ",").alias("weeks"))


@query("""SELECT conv_id, turn, CASE WHEN length(text) > 0 AND length(text) <= 120 AND NOT contains(text, '?') THEN text END AS reply, concat_ws(',', CASE WHEN text IS NULL OR trim(text) = '' THEN 'missing' END, CASE WHEN length(text) > 120 THEN 'long' END, CASE WHEN contains(text, '?') THEN 'script' END) AS faults FROM conversations WHERE text IS NOT NULL""")
def reply_faults(spark: SparkSession, d: str) -> DataFrame:
    """Turns as JSON replies of at most 120 characters without question marks."""
    raw = F.to_json(F.struct(F.col("text").alias("answer")))
    value, faults = text.reply_faults(raw, "answer", 120, r"\?")
    return table(spark, d, "conversations").where("text is not null").select("conv_id", "turn", value.alias("reply"), F.array_join(faults, ",").alias("faults"))


@query("""SELECT event_id, concat_ws(',', CASE WHEN event_type NOT IN ('view', 'click') THEN 'kind' END, 'k') AS wrong FROM events""")
def closed_answers(spark: SparkSession, d: str) -> DataFrame:
    """Events as answers in a closed vocabulary; the second field is never there."""
    raw = F.to_json(F.struct(F.col("event_type").alias("kind")))
    return events(spark, d).select("event_id", F.array_join(text.closed_answer(raw, {"kind": ["view", "click"], "k": ["1"]})[1], ",").alias("wrong"))


@query("""SELECT doc_id, concat_ws(',', CASE WHEN contains(text, 'the') THEN 'the' END, CASE WHEN contains(text, 'ing') THEN 'ing' END) AS inside, concat_ws(',', CASE WHEN regexp_matches(text, '(^|[^\\p{L}\\p{N}])the([^\\p{L}\\p{N}]|$)') THEN 'the' END, CASE WHEN regexp_matches(text, '(^|[^\\p{L}\\p{N}])ing([^\\p{L}\\p{N}]|$)') THEN 'ing' END) AS words FROM documents""")
def glossary_terms(spark: SparkSession, d: str) -> DataFrame:
    """Terms that occur in each document, and as whole words."""
    terms = ["the", "ing"]
    return table(spark, d, "documents").select("doc_id", F.coalesce(F.array_join(text.glossary_terms(F.col("text"), terms), ","), F.lit("")).alias("inside"), F.coalesce(F.array_join(text.glossary_terms(F.col("text"), terms, "word"), ","), F.lit("")).alias("words"))


@query("""SELECT page_id, regexp_replace(regexp_replace(url || '?token=abc&x=1 password: hunter2', '(?i)\\b(token|password)(\\s*[=:]\\s*)\\S+', '\\1\\2***', 'g'), '(://[^/\\s:@]+:)[^/\\s@]+@', '\\1***@', 'g') AS clean FROM pages""")
def redacted_logs(spark: SparkSession, d: str) -> DataFrame:
    """Addresses with their secrets starred."""
    return table(spark, d, "pages").select("page_id", text.redacted(F.concat("url", F.lit("?token=abc&x=1 password: hunter2")), ["token", "password"]).alias("clean"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(0.0, least(l_quantity + l_partkey % 7, 40.0) - greatest(l_quantity - (l_partkey % 7) * 0.5, 0.0)), 6) AS width, l_quantity >= 10 AND l_quantity < 30 AS inside FROM lineitem""")
def padded_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Widths of boxes grown by a half and cut to their frame."""
    size = (F.col("l_partkey") % 7).cast("double")
    zero, frame = F.lit(0.0), F.lit(40.0)
    # Grown by half its size on each side, a box that is as wide as high.
    grown = geometry.box_padded((F.col("l_quantity"), zero, size, size), 0.5, frame, frame)
    to_right = F.greatest(F.lit(0.0), F.least(F.col("l_quantity") + size, frame) - grown[0])
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(to_right, 6).alias("width"), geometry.box_contains((F.lit(10.0), zero, F.lit(20.0), F.lit(1.0)), F.col("l_quantity"), zero).alias("inside"))


def _turn(seconds: F.Column) -> F.Column:
    """A slow turn about the z axis."""
    half = seconds / 2
    return F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))


@query(f"""WITH {EVENTS}, o AS (SELECT user_id, event_id, us, us / {DAY}.0 - 19723 AS day, row_number() OVER (PARTITION BY user_id ORDER BY us, event_id) AS i FROM e0), m AS (SELECT * FROM o WHERE i % 2 = 0), p AS (SELECT * FROM o WHERE i % 2 = 1),
j AS (SELECT m.user_id, m.event_id, m.us, m.day, a.us AS t0, a.day AS d0, b.us AS t1, b.day AS d1 FROM m JOIN p a ON a.user_id = m.user_id AND a.i = m.i - 1 LEFT JOIN p b ON b.user_id = m.user_id AND b.i = m.i + 1), s AS (SELECT *, t1 - t0 <= {4 * DAY} AND t1 > t0 AS near, d0 / 10 + (d1 - d0) / 10 * (us - t0) / nullif(t1 - t0, 0) AS turn, d0 + (d1 - d0) * (us - t0) / nullif(t1 - t0, 0) AS x FROM j)
SELECT user_id, event_id, CASE WHEN near THEN round(cos(turn / 2), 6) END AS w, CASE WHEN near THEN round(x, 6) END AS x FROM s WHERE us > t0""")
def poses_between(spark: SparkSession, d: str) -> DataFrame:
    """Every second event as a pose; those between, by the shortest turn and in a straight line."""
    rows = events(spark, d).withColumn("i", F.row_number().over(W.Window.partitionBy("user_id").orderBy("us", "event_id"))).withColumn("t", F.col("us").cast("double")).withColumn("day", F.col("us") / DAY - 19723)
    given = rows.where("i % 2 = 1").select("user_id", "event_id", "t", _turn(F.col("day") / 10).alias("q"), F.array(F.col("day"), F.lit(0.0), F.lit(0.0)).alias("p"))
    asked = rows.where("i % 2 = 0").select("user_id", "event_id", "t")
    return poses.pose_at(asked, given, ["user_id"], "t", "event_id", "event_id", 4.0 * DAY).select("user_id", "event_id", F.round(F.element_at("q", 1), 6).alias("w"), F.round(F.element_at("p", 1), 6).alias("x"))


@query("""SELECT l_suppkey, round(sqrt(avg(pow(l_discount * 100 - l_tax * 100, 2) + pow(l_linenumber, 2))), 6) AS rmse, count(*) AS n FROM lineitem GROUP BY 1""")
def trajectory_errors(spark: SparkSession, d: str) -> DataFrame:
    """Root mean square distance of two places by supplier."""
    rows = table(spark, d, "lineitem").select("l_suppkey", F.array(F.col("l_discount") * 100, F.col("l_linenumber").cast("double"), F.lit(0.0)).alias("a"), F.array(F.col("l_tax") * 100, F.lit(0.0), F.lit(0.0)).alias("b"))
    return poses.trajectory_error(rows, ["l_suppkey"], "a", "b").withColumn("rmse", F.round("rmse", 6))


@query("""SELECT p_partkey % 5 AS k, CAST(2 AS DOUBLE) AS scale, round(cos(0.25), 6) AS w, CAST(3 AS DOUBLE) AS x, count(*) AS n FROM part GROUP BY 1""")
def fitted_similarities(spark: SparkSession, d: str) -> DataFrame:
    """The similarity between parts and their images: doubled, turned by half a radian and moved by three."""
    rows = table(spark, d, "part").select((F.col("p_partkey") % 5).alias("k"), F.array(F.col("p_size").cast("double"), F.col("p_retailprice") / 100, F.length("p_name").cast("double")).alias("a"))
    turned = rotations.rotated(_turn(F.lit(0.5)), F.col("a"))
    rows = rows.withColumn("b", F.zip_with(turned, F.array(F.lit(3.0), F.lit(0.0), F.lit(0.0)), lambda v, s: 2 * v + s))
    return poses.similarity(rows, ["k"], "a", "b").select("k", F.round("scale", 6).alias("scale"), F.round(F.element_at("q", 1), 6).alias("w"), F.round(F.element_at("p", 1), 5).alias("x"), "n")


@query("""SELECT p_partkey, CAST(p_size % 6 * (p_partkey % 5) AS BIGINT) AS area, CASE WHEN p_size % 6 * (p_partkey % 5) > 0 THEN 2 ELSE 0 END AS x, CAST(CASE WHEN p_size % 6 * (p_partkey % 5) > 0 THEN p_partkey % 5 ELSE 0 END AS BIGINT) AS w, CAST(CASE WHEN p_size % 6 * (p_partkey % 5) > 0 THEN p_size % 6 ELSE 0 END AS BIGINT) AS h FROM part""")
def mask_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Masks of rectangles as run lengths, and what these say of area and box."""
    high, wide = F.col("p_size") % 6, F.col("p_partkey") % 5
    grid = F.array(*(F.array(*((F.lit(r) < high) & F.lit(c >= 2) & (F.lit(c) < wide + 2) for c in range(9))) for r in range(8)))
    rows = table(spark, d, "part").select("p_partkey", runlength.encode(grid).alias("t"))
    return rows.withColumn("b", runlength.area_and_box(F.col("t"), F.lit(8))).select("p_partkey", "b.area", "b.x", "b.w", "b.h")
