"""Verdicts, gates and reviews over the test tables, each with the SQL that says the same. Lines stand for verdicts, parts for the labels they are on, ship modes of orders for runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import verdicts
from .history_queries import EVENTS, HOUR, events
from .label_queries import IN_FORCE, RECORDS, in_force, records
from .shop_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


#: Columns of a verdict in words that Spark and the SQL share.
_VERDICT = (
    "l_partkey AS label_id", "CASE WHEN l_suppkey % 3 = 0 THEN 'judge-a' WHEN l_suppkey % 3 = 1 THEN 'judge-b' ELSE 'judge-c' END AS version", "CASE l_returnflag WHEN 'R' THEN CASE WHEN l_linenumber > 3 THEN 'wrong' ELSE 'suspect' END WHEN 'A' THEN 'unknown' ELSE 'ok' END AS verdict",
    "l_discount AS confidence", "l_linenumber % 2 AS label_digest", "l_quantity < 40 AS render_hash", "l_shipdate AS judged_at",
)
_ROWS = f"v AS (SELECT {', '.join(_VERDICT)} FROM lineitem), cur AS (SELECT p_partkey AS label_id, p_size % 2 AS label_digest, p_retailprice < 1500 AS render_hash FROM part)"
_SEV = "CASE verdict WHEN 'wrong' THEN 1 WHEN 'suspect' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END"
_VALID = f"{_ROWS}, valid AS (SELECT * FROM (SELECT v.*, row_number() OVER (PARTITION BY label_id, version ORDER BY judged_at DESC, {_SEV}, confidence DESC) AS place FROM v JOIN cur USING (label_id, label_digest, render_hash) WHERE version IN ('judge-a', 'judge-b')) WHERE place = 1)"


def _valid(spark: SparkSession, d: str) -> DataFrame:
    current = table(spark, d, "part").selectExpr("p_partkey AS label_id", "p_size % 2 AS label_digest", "p_retailprice < 1500 AS render_hash")
    return verdicts.valid(table(spark, d, "lineitem").selectExpr(*_VERDICT), current, ["judge-a", "judge-b"])


@query(f"WITH {_VALID} SELECT label_id, version, verdict, confidence FROM valid")
def valid_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Verdicts that still hold."""
    return _valid(spark, d).select("label_id", "version", "verdict", "confidence")


@query(f"WITH {_VALID}, r AS (SELECT *, row_number() OVER (PARTITION BY label_id ORDER BY {_SEV}, confidence DESC, version) AS p2 FROM valid) SELECT label_id, version, verdict FROM r WHERE p2 = 1")
def worst_verdicts(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.worst(_valid(spark, d), ["label_id"]).select("label_id", "version", "verdict")


_SPLIT = "sp AS (SELECT label_id, count(DISTINCT version) AS judges FROM valid GROUP BY 1 HAVING count(DISTINCT version) > 1 AND bool_or(verdict = 'ok') AND bool_or(verdict <> 'ok'))"


@query(f"WITH {_VALID}, {_SPLIT} SELECT * FROM sp")
def split_verdicts(spark: SparkSession, d: str) -> DataFrame:
    """Labels that judges disagree on."""
    return verdicts.split(_valid(spark, d))


@query(f"WITH {_VALID}, {_SPLIT} SELECT label_id FROM valid WHERE (verdict = 'wrong' AND confidence >= 0.02) OR (verdict = 'suspect' AND confidence >= 0.06) UNION SELECT label_id FROM sp")
def escalated_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels that must be looked at."""
    rows = _valid(spark, d)
    return verdicts.escalated(rows, {"wrong": 0.02, "suspect": 0.06}, verdicts.split(rows))


@query(f"WITH {_VALID}, o AS (SELECT p_partkey AS label_id, CASE p_size % 3 WHEN 0 THEN 'approved' WHEN 1 THEN 'corrected' ELSE 'retracted' END AS outcome FROM part WHERE p_size > 5) SELECT label_id, verdict, CASE WHEN outcome IS NULL THEN 'open' WHEN verdict IN ('wrong', 'suspect') AND outcome <> 'approved' THEN 'agreed' WHEN verdict IN ('wrong', 'suspect') THEN 'ignored' WHEN outcome <> 'approved' THEN 'overruled' ELSE 'agreed' END AS action FROM valid LEFT JOIN o USING (label_id)")
def human_actions(spark: SparkSession, d: str) -> DataFrame:
    """What reviewers did with verdicts."""
    outcome = F.when(F.col("p_size") % 3 == 0, "approved").when(F.col("p_size") % 3 == 1, "corrected").otherwise("retracted")
    return verdicts.human_actions(_valid(spark, d), table(spark, d, "part").where("p_size > 5").select(F.col("p_partkey").alias("label_id"), outcome.alias("outcome")))


_ARM = "CASE WHEN CAST(('0x' || substr(sha256('3|' || o_orderkey), 1, 8)) AS UBIGINT)::DOUBLE / 4294967296.0 < 0.25 THEN 'control' ELSE 'shown' END"


@query(f"""WITH t AS (SELECT o_orderkey AS task_key, {_ARM} AS arm FROM orders), u AS (SELECT l_orderkey AS task_key, count(*) AS units, count(*) FILTER (l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20)) AS n FROM lineitem GROUP BY 1)
SELECT task_key, arm, coalesce(units, 0) AS units, CASE WHEN arm = 'shown' THEN coalesce(n, 0) ELSE 0 END AS shown, CASE WHEN arm = 'control' THEN coalesce(n, 0) ELSE 0 END AS hidden FROM t LEFT JOIN u USING (task_key)""")
def task_exposures(spark: SparkSession, d: str) -> DataFrame:
    """Arms of tasks, and the verdicts each shows and hides."""
    tasks = verdicts.arms(table(spark, d, "orders").select(F.col("o_orderkey").alias("task_key")), "task_key", 3, 0.25)
    sent = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_key"), F.col("l_partkey").alias("label_id"))
    return verdicts.exposures(tasks, sent, table(spark, d, "part").where("p_size < 20").select(F.col("p_partkey").alias("label_id")))


_RUNS = f"{EVENTS}, runs AS (SELECT user_id AS session_id, us, CASE event_type WHEN 'purchase' THEN 'finished' WHEN 'error' THEN 'failed' ELSE 'started' END AS state, event_id % 2 = 0 AS complete, event_id AS run_id FROM e0 WHERE event_type <> 'signup'), s AS (SELECT user_id AS session_id, min(us) AS made FROM e0 GROUP BY 1)"


def _runs(spark: SparkSession, d: str) -> DataFrame:
    state = F.when(F.col("event_type") == "purchase", "finished").when(F.col("event_type") == "error", "failed").otherwise("started")
    return events(spark, d).where("event_type <> 'signup'").select(F.col("user_id").alias("session_id"), F.col("us").alias("at"), state.alias("state"), (F.col("event_id") % 2 == 0).alias("complete"), F.col("event_id").alias("run_id"))


@query(f"""WITH {_RUNS}, l AS (SELECT session_id, arg_max(state, us) AS state, arg_max(complete, us) AS complete FROM runs GROUP BY 1) SELECT session_id, CASE WHEN state = 'finished' AND complete THEN 'open' WHEN state = 'failed' THEN 'failed' WHEN 1706745600000000 - made > {600 * HOUR} THEN 'late' ELSE 'wait' END AS gate FROM s LEFT JOIN l USING (session_id)""")
def review_gates(spark: SparkSession, d: str) -> DataFrame:
    """Whether review of each session may start."""
    sessions = events(spark, d).groupBy(F.col("user_id").alias("session_id")).agg(F.min("us").alias("prelabeled_at"))
    return verdicts.gate(sessions, _runs(spark, d), F.lit(1_706_745_600_000_000), 600 * HOUR)


@query(f"WITH {_RUNS}, l AS (SELECT session_id, arg_max(state, us) AS state, arg_max(run_id, us) AS run_id FROM runs GROUP BY 1) SELECT session_id, run_id FROM l WHERE state NOT IN ('finished', 'failed')")
def unfinished_runs(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.unfinished(_runs(spark, d), ["finished", "failed"])


@query("""WITH v AS (SELECT l_partkey AS label_id, CASE WHEN l_returnflag = 'R' THEN 'no' ELSE 'yes' END AS verdict, l_quantity AS confidence FROM lineitem) SELECT label_id, count(*) FILTER (verdict = 'no' AND confidence >= 20) / count(*) * avg(confidence) FILTER (verdict = 'no' AND confidence >= 20) AS doubt FROM v GROUP BY 1 HAVING count(*) FILTER (verdict = 'no' AND confidence >= 20) > 0""")
def label_doubts(spark: SparkSession, d: str) -> DataFrame:
    """Doubt on each label from many looks."""
    rows = table(spark, d, "lineitem").select(F.col("l_partkey").alias("label_id"), F.when(F.col("l_returnflag") == "R", "no").otherwise("yes").alias("verdict"), F.col("l_quantity").alias("confidence"))
    return verdicts.doubts(rows, 20)


@query(f"""WITH {RECORDS}, p AS (SELECT parent_label_id AS label_id, 'r' || (event_id % 6) AS reviewer, t_start_ms - (event_id % 3) * 400 AS t FROM rec JOIN e0 ON label_id = 'l' || event_id WHERE parent_label_id IS NOT NULL), c AS (SELECT parent_label_id AS label_id, reviewer_id AS reviewer, t_start_ms AS s, retracted FROM rec WHERE source = 'human')
SELECT label_id, reviewer, bool_or(coalesce(retracted OR abs(s - t) > 500, false)) AS found FROM p LEFT JOIN c USING (label_id, reviewer) GROUP BY 1, 2""")
def planted_errors_found(spark: SparkSession, d: str) -> DataFrame:
    """Planted errors, and whether their reviewers found them."""
    rows = records(spark, d)
    number = F.substring("label_id", 2, 20).cast("long")
    planted = rows.where("parent_label_id is not null").select(F.col("parent_label_id").alias("label_id"), F.concat(F.lit("r"), (number % 6).cast("string")).alias("reviewer"), (F.col("t_start_ms") - (number % 3) * 400).alias("t_start_ms"))
    return verdicts.found(planted, rows, 500)


@query(f"""{IN_FORCE}, g AS (SELECT session_id, count(*) FILTER (source <> 'human' AND state = 'unreviewed' AND kind <> 'event') AS unreviewed, bool_or(kind = 'action') AS a, bool_or(kind = 'segment') AS s FROM cur GROUP BY 1) SELECT session_id, unreviewed, concat_ws(',', CASE WHEN NOT a THEN 'action' END, CASE WHEN NOT s THEN 'segment' END) AS missing FROM g""")
def verification_gaps(spark: SparkSession, d: str) -> DataFrame:
    """What keeps each session from being done."""
    return verdicts.verification_gaps(in_force(spark, d), F.col("kind") == "event", ["action", "segment"])


@query("""WITH n AS (SELECT l_orderkey, l_suppkey % 4 AS stream_id, max(l_shipdate) AS generation FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2), s AS (SELECT DISTINCT l_orderkey, l_suppkey % 4 AS stream_id FROM lineitem), r AS (SELECT DISTINCT l_orderkey, l_suppkey % 4 AS stream_id, l_shipdate AS generation FROM lineitem WHERE l_linestatus = 'F')
SELECT l_orderkey AS session_id, stream_id, generation FROM s LEFT JOIN n USING (l_orderkey, stream_id) WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.l_orderkey = s.l_orderkey AND r.stream_id = s.stream_id AND r.generation = n.generation)""")
def missing_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Streams whose newest detection no review has seen."""
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_suppkey") % 4).alias("stream_id"), F.col("l_shipdate").alias("at"), "l_returnflag", "l_linestatus")
    reviews = rows.where("l_linestatus = 'F'").withColumnRenamed("at", "generation")
    return verdicts.missing_reviews(rows.select("session_id", "stream_id").distinct(), rows.where("l_returnflag <> 'N'"), reviews)


@query("""WITH w AS (SELECT strftime(o_orderdate, '%G-W%V') AS week, avg(CASE WHEN o_orderstatus = 'P' THEN 1.0 ELSE 0.0 END) AS rate FROM orders GROUP BY 1), l AS (SELECT * FROM w ORDER BY week DESC LIMIT 4) SELECT CASE WHEN count(*) = 4 AND bool_and(rate < 0.5) THEN 'sampled' ELSE 'full' END AS mode FROM l""")
def review_mode(spark: SparkSession, d: str) -> DataFrame:
    """Whether the last weeks let review go over to samples."""
    from ..functions.times import iso_week

    weeks = table(spark, d, "orders").groupBy(iso_week(F.col("o_orderdate")).alias("week")).agg(F.avg((F.col("o_orderstatus") == "P").cast("double")).alias("rate"))
    return verdicts.review_mode(weeks, 0.5, 4)


@query("""WITH m AS (SELECT p_brand AS task, p_partkey AS model_version, CASE WHEN p_size % 4 = 0 THEN 'deployed' ELSE 'candidate' END AS status, p_retailprice AS created_at FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY created_at DESC, model_version DESC) AS place FROM m WHERE status = 'deployed') SELECT task, model_version FROM r WHERE place = 1""")
def deployed_models(spark: SparkSession, d: str) -> DataFrame:
    """The model in service for each task."""
    models = table(spark, d, "part").select(F.col("p_brand").alias("task"), F.col("p_partkey").alias("model_version"), F.when(F.col("p_size") % 4 == 0, "deployed").otherwise("candidate").alias("status"), F.col("p_retailprice").alias("created_at"))
    return verdicts.deployed(models).select("task", "model_version")


@query(f"""{IN_FORCE}, sp AS (SELECT DISTINCT user_id AS session_id, CASE user_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM events), x AS (SELECT label_id, session_id, split, sha256(kind || '|' || entity_id) AS fingerprint FROM cur JOIN sp USING (session_id) WHERE split <> 'test' AND state <> 'unreviewed'), r AS (SELECT *, row_number() OVER (PARTITION BY split, fingerprint ORDER BY label_id) AS place FROM x) SELECT label_id, session_id, split, fingerprint FROM r WHERE place = 1""")
def training_examples(spark: SparkSession, d: str) -> DataFrame:
    """Examples of reviewed labels, one of each content."""
    sides = events(spark, d).select(F.col("user_id").alias("session_id")).distinct()
    sides = sides.withColumn("split", F.when(F.col("session_id") % 3 == 0, "train").when(F.col("session_id") % 3 == 1, "val").otherwise("test"))
    return verdicts.examples(in_force(spark, d), sides, F.col("state") != "unreviewed", F.sha2(F.concat_ws("|", "kind", "entity_id").cast("binary"), 256))


@query(f"WITH {EVENTS}, r AS (SELECT event_id, event_type, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS place FROM e0) SELECT event_id, CASE WHEN place = 1 THEN event_type ELSE event_type || '#' || place END AS slot FROM r")
def distinct_slots(spark: SparkSession, d: str) -> DataFrame:
    return verdicts.slots(events(spark, d), ["user_id"], "event_type", "event_id").select("event_id", "slot")


@query(f"WITH {EVENTS}, m AS (SELECT event_id, us, max(us) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM e0) SELECT event_id FROM m WHERE p IS NULL OR us > p")
def increasing_times(spark: SparkSession, d: str) -> DataFrame:
    """Events, by their ids, that come after all before them."""
    return verdicts.increasing(events(spark, d), ["user_id"], "event_id", "us").select("event_id")


@query(f"""WITH {EVENTS}, f AS (SELECT user_id, avg(CASE WHEN event_type IN ('view', 'click') THEN 1.0 ELSE 0.0 END) AS share FROM e0 GROUP BY 1) SELECT event_id FROM e0 WHERE user_id NOT IN (SELECT user_id FROM f WHERE share >= 0.6)""")
def suppressed_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Events of users who don't mostly look on."""
    rows = events(spark, d)
    return verdicts.mostly_inside(rows, rows, ["user_id"], F.col("event_type").isin("view", "click"), 0.6).select("event_id")


@query(f"""WITH {EVENTS} SELECT a.event_id, EXISTS (SELECT 1 FROM e0 b WHERE b.user_id = a.user_id AND b.event_type = 'click' AND abs(a.us - b.us) <= {6 * HOUR} AND abs(a.value - b.value) < 40) AS support FROM e0 a WHERE a.event_type = 'purchase'""")
def supported_purchases(spark: SparkSession, d: str) -> DataFrame:
    """Purchases with a click of like value close to them."""
    rows = events(spark, d).select("user_id", "event_id", "event_type", "us", "value")
    return verdicts.supported(rows.where("event_type = 'purchase'"), rows.where("event_type = 'click'"), ["user_id"], "us", "event_id", F.abs(F.col("value") - F.col("o_value")) < 40, 6 * HOUR).select("event_id", "support")


@query("""SELECT o_custkey AS session_id, o_orderkey AS stream_id, unnest(['boxes', 'masks']) AS "group" FROM orders UNION ALL SELECT c_custkey, NULL, 'actions' FROM customer""")
def review_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of review of customers and their orders."""
    streams = table(spark, d, "orders").select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("stream_id"))
    return verdicts.units(table(spark, d, "customer").select(F.col("c_custkey").alias("session_id")), streams, ["boxes", "masks"], ["actions"])
