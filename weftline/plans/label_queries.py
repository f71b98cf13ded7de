"""Label histories, segments and tracks over the test tables, each with the SQL that says the same.

Events stand for label records: their ids give sources, states and retractions, every third corrects the
user's event before it. The same expressions build the records here and in the SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import labels, segments, tracker, tracking
from .history_queries import EVENTS, HOUR, events

QUERIES, ORACLES = {}, {}
#: Columns of a label record, in words that Spark and the SQL share.
RECORD = (
    "'l' || CAST(event_id AS VARCHAR(20)) AS label_id", "user_id AS session_id",
    "CASE event_type WHEN 'view' THEN 'box_track' WHEN 'click' THEN 'hand_state' WHEN 'purchase' THEN 'action' WHEN 'signup' THEN 'segment' ELSE 'event' END AS kind",
    "CASE event_id % 5 WHEN 0 THEN 'human' WHEN 1 THEN 'sensor' ELSE 'model' END AS source",
    "CASE WHEN event_id % 5 > 1 THEN 'det-' || CAST(event_id % 3 AS VARCHAR(20)) || '.1' END AS model_version",
    "CASE event_id % 7 WHEN 0 THEN 'human_approved' WHEN 1 THEN 'human_corrected' WHEN 2 THEN 'sample_verified' ELSE 'unreviewed' END AS state",
    "CASE WHEN event_id % 3 = 0 THEN 'l' || CAST(lag(event_id) OVER (PARTITION BY user_id ORDER BY us, event_id) AS VARCHAR(20)) END AS parent_label_id",
    "event_id % 11 = 0 AS retracted", "event_id % 29 = 0 AS seeded_error", "us AS created_at",
    "CASE WHEN event_id % 7 < 3 THEN us + 3600000000 * (event_id % 48) END AS reviewed_at",
    "CASE WHEN event_id % 7 < 3 THEN 'r' || CAST(event_id % 6 AS VARCHAR(20)) END AS reviewer_id",
    "CAST(floor(us / 1000) AS BIGINT) AS t_start_ms", "CAST(floor(us / 1000) AS BIGINT) + (event_id % 4) * 1800000 AS t_end_ms",
    "'e' || CAST(event_id % 13 AS VARCHAR(20)) AS entity_id", "CASE WHEN event_id % 2 = 0 THEN 't' || CAST(event_id % 9 AS VARCHAR(20)) END AS target_id", "CASE WHEN event_id % 4 = 0 THEN 'knife' END AS tool_id",
)
RECORDS = f"{EVENTS}, rec AS (SELECT {', '.join(RECORD)} FROM e0)"
#: Records under a seeded one, and those in force.
BANNED = "ban(label_id) AS (SELECT label_id FROM rec WHERE seeded_error UNION SELECT rec.label_id FROM rec JOIN ban ON rec.parent_label_id = ban.label_id)"
CURRENT = "cur AS (SELECT * FROM rec WHERE label_id NOT IN (SELECT parent_label_id FROM rec WHERE parent_label_id IS NOT NULL) AND NOT retracted AND label_id NOT IN (SELECT label_id FROM ban))"
ROOTS = "roots(id, root) AS (SELECT label_id, label_id FROM rec WHERE parent_label_id IS NULL UNION ALL SELECT rec.label_id, roots.root FROM rec JOIN roots ON rec.parent_label_id = roots.id)"
IN_FORCE = f"WITH RECURSIVE {RECORDS}, {BANNED}, {CURRENT}"
REVIEWED = "('sample_verified', 'human_approved', 'human_corrected')"


def records(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).selectExpr(*(x.replace("VARCHAR(20)", "STRING") for x in RECORD))


def in_force(spark: SparkSession, d: str) -> DataFrame:
    from ..operators.history import current

    return current(records(spark, d), "label_id", "parent_label_id", F.col("retracted"), F.col("seeded_error"))


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query(f"""WITH {RECORDS} SELECT label_id, source = 'human' OR state <> 'unreviewed' AS protected, source = 'human' OR state IN ('human_approved', 'human_corrected') AS truth,
source = 'model' AND state = 'unreviewed' AND kind IN ('box_track', 'action', 'segment') AND kind <> 'segment' AS pending, kind <> 'event' AND (source = 'human' OR state IN ('human_approved', 'unreviewed')) AS exported,
coalesce((kind = 'box_track' AND starts_with(model_version, 'det-1')) OR (kind = 'action' AND starts_with(model_version, 'det-')), false) AS automatic,
state = 'unreviewed' AND kind IN ('action', 'hand_state') AND source IN ('model', 'sensor') AND t_end_ms - t_start_ms <= 3600000 AND coalesce(tool_id <> 'knife', true) AS judged FROM rec""")
def label_predicates(spark: SparkSession, d: str) -> DataFrame:
    """What each record counts as."""
    states = labels.allowed_states(["human_approved"], True)
    return records(spark, d).select(
        "label_id", labels.protected().alias("protected"), labels.truth().alias("truth"), labels.pending(["box_track", "action", "segment"], ["segment"]).alias("pending"),
        labels.exported(states, ["event"]).alias("exported"), labels.automatic([("box_track", "det-1"), ("action", "det-")]).alias("automatic"),
        labels.judged(["action", "hand_state"], ["model", "sensor"], 3_600_000, F.col("tool_id") == "knife").alias("judged"),
    )


@query(f"""WITH {RECORDS}, r AS (SELECT label_id, CASE kind WHEN 'box_track' THEN [entity_id] WHEN 'action' THEN [target_id, tool_id] WHEN 'hand_state' THEN [target_id] ELSE [] END AS refs, CASE WHEN kind = 'box_track' THEN 'box_track:' || entity_id WHEN kind = 'action' AND target_id IS NOT NULL THEN 'action:' || target_id ELSE kind END AS class_key FROM rec)
SELECT label_id, array_to_string(list_filter(refs, lambda x: x IS NOT NULL), ',') AS refs, class_key FROM r""")
def label_references(spark: SparkSession, d: str) -> DataFrame:
    """Entities that each record names, and its class."""
    refs = labels.references({"box_track": [F.col("entity_id")], "action": [F.col("target_id"), F.col("tool_id")], "hand_state": [F.col("target_id")]})
    return records(spark, d).select("label_id", F.array_join(refs, ",").alias("refs"), labels.class_key({"box_track": F.col("entity_id"), "action": F.col("target_id")}).alias("class_key"))


@query(f"""{IN_FORCE} SELECT label_id || ':x' || substr(sha256('det-9'), 1, 8) AS label_id, label_id AS parent_label_id, true AS retracted, 'model' AS source, 'det-9' AS model_version, 'unreviewed' AS state, created_at + 1 AS created_at FROM cur WHERE source = 'model' AND state = 'unreviewed' AND model_version = 'det-1.1'""")
def label_tombstones(spark: SparkSession, d: str) -> DataFrame:
    """Retractions of an old version's unreviewed labels."""
    stale = in_force(spark, d).where(~labels.protected() & (F.col("model_version") == "det-1.1"))
    return labels.tombstones(stale, "det-9", F.col("created_at") + 1).select("label_id", "parent_label_id", "retracted", "source", "model_version", "state", "created_at")


@query(f"""WITH {RECORDS}, m AS (SELECT user_id AS session_id, CAST(floor(us / 1000) AS BIGINT) AS ms, event_id FROM e0) SELECT label_id, event_id FROM rec JOIN m USING (session_id) WHERE t_start_ms <= ms AND (ms < t_end_ms OR (t_start_ms = t_end_ms AND ms = t_start_ms))""")
def covering_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels with the events of their session that they cover."""
    moments = events(spark, d).select(F.col("user_id").alias("session_id"), F.floor(F.col("us") / 1000).alias("at"), "event_id")
    return labels.covering(records(spark, d).select("label_id", "session_id", "t_start_ms", "t_end_ms"), moments, ["session_id"], "t_start_ms", "t_end_ms", "at", 3_600_000).select("label_id", "event_id")


CHANGES = f"""kept AS (SELECT CASE WHEN c.source = 'model' THEN 'accepted' WHEN o.source = 'model' THEN 'corrected' ELSE 'added' END AS outcome, c.label_id, CASE WHEN c.source = 'model' THEN c.label_id WHEN o.source = 'model' THEN o.label_id END AS root_id, coalesce(c.reviewed_at, c.created_at) AS at, c.reviewer_id AS who
 FROM cur c JOIN roots ON roots.id = c.label_id JOIN rec o ON o.label_id = roots.root WHERE c.source = 'human' OR (c.source = 'model' AND c.state IN {REVIEWED})),
gone AS (SELECT 'deleted' AS outcome, r.parent_label_id AS label_id, o.label_id AS root_id, coalesce(r.reviewed_at, r.created_at) AS at, r.reviewer_id AS who FROM rec r JOIN roots ON roots.id = r.parent_label_id JOIN rec o ON o.label_id = roots.root WHERE r.retracted AND r.source = 'human' AND o.source = 'model' AND r.label_id NOT IN (SELECT label_id FROM ban)),
changes AS (SELECT * FROM kept UNION ALL SELECT * FROM gone)"""


@query(f"{IN_FORCE}, {ROOTS}, {CHANGES} SELECT * FROM changes")
def review_changes(spark: SparkSession, d: str) -> DataFrame:
    """What review did to each label."""
    return labels.review_changes(records(spark, d))


@query(f"{IN_FORCE}, {ROOTS}, {CHANGES} SELECT * FROM changes WHERE label_id NOT IN (SELECT label_id FROM rec WHERE kind = 'segment')")
def reviewer_changes(spark: SparkSession, d: str) -> DataFrame:
    """Changes without those of labels that follow another."""
    rows = records(spark, d)
    return labels.without_inherited(labels.review_changes(rows), rows.where("kind = 'segment'"))


@query(f"""WITH {RECORDS}, s AS (SELECT label_id, kind, t_start_ms FROM rec WHERE source = 'model'), b AS (SELECT label_id AS item_id, CASE WHEN source = 'model' AND NOT tool_id IS NULL THEN label_id WHEN source = 'human' AND target_id IS NULL THEN parent_label_id END AS origin_label_id, kind, t_start_ms FROM rec WHERE source = 'human' OR (source = 'model' AND tool_id IS NOT NULL)),
j AS (SELECT s.label_id AS origin, b.item_id, s.kind IS NOT DISTINCT FROM b.kind AND s.t_start_ms IS NOT DISTINCT FROM b.t_start_ms AS same, count(b.item_id) OVER (PARTITION BY s.label_id) AS times FROM s LEFT JOIN b ON b.origin_label_id = s.label_id)
SELECT origin AS origin_label_id, item_id, CASE WHEN item_id IS NULL THEN 'retracted' WHEN times > 1 THEN 'duplicate' WHEN same THEN 'approved' ELSE 'corrected' END AS outcome FROM j UNION ALL
SELECT NULL, item_id, 'added' FROM b WHERE origin_label_id IS NULL OR origin_label_id NOT IN (SELECT label_id FROM s)""")
def reconciled_labels(spark: SparkSession, d: str) -> DataFrame:
    """Labels sent to review against what came back."""
    rows = records(spark, d)
    sent = rows.where("source = 'model'")
    origin = F.when((F.col("source") == "model") & F.col("tool_id").isNotNull(), F.col("label_id")).when((F.col("source") == "human") & F.col("target_id").isNull(), F.col("parent_label_id"))
    back = rows.where("source = 'human' or (source = 'model' and tool_id is not null)").select(F.col("label_id").alias("item_id"), origin.alias("origin_label_id"), "kind", "t_start_ms")
    return labels.reconciled(sent, back, ["kind", "t_start_ms"], "r1").select("origin_label_id", "item_id", "outcome")


@query(f"""WITH {RECORDS} SELECT label_id AS origin_label_id, state AS outcome FROM rec r WHERE NOT EXISTS (SELECT 1 FROM rec c WHERE c.parent_label_id = r.label_id)""")
def unforked_outcomes(spark: SparkSession, d: str) -> DataFrame:
    """Outcomes whose label nothing has touched since."""
    rows = records(spark, d)
    return labels.unforked(rows.select(F.col("label_id").alias("origin_label_id"), F.col("state").alias("outcome")), rows)


@query(f"{IN_FORCE} SELECT DISTINCT entity_id FROM cur WHERE source = 'human' OR state IN {REVIEWED}")
def verified_classes(spark: SparkSession, d: str) -> DataFrame:
    """Entities that review has passed."""
    return labels.verified_classes(records(spark, d), "entity_id")


@query(f"WITH {RECORDS} SELECT kind, source, state, count(*) AS n FROM rec WHERE label_id NOT IN (SELECT parent_label_id FROM rec WHERE parent_label_id IS NOT NULL) AND NOT retracted AND NOT seeded_error GROUP BY 1, 2, 3")
def label_counts(spark: SparkSession, d: str) -> DataFrame:
    return labels.counts(records(spark, d), ["kind", "source", "state"])


@query(f"""WITH RECURSIVE {RECORDS}, {BANNED}, ops AS (SELECT *, CASE WHEN source = 'human' THEN created_at WHEN state IN {REVIEWED} THEN reviewed_at END AS own FROM rec WHERE label_id NOT IN (SELECT label_id FROM ban)),
up(label_id, above, own) AS (SELECT label_id, parent_label_id, own FROM ops UNION ALL SELECT up.label_id, ops.parent_label_id, ops.own FROM up JOIN ops ON ops.label_id = up.above), first AS (SELECT label_id, min(own) AS earliest FROM up GROUP BY 1),
cur AS (SELECT * FROM ops WHERE label_id NOT IN (SELECT parent_label_id FROM ops WHERE parent_label_id IS NOT NULL) AND NOT retracted),
items AS (SELECT label_id, session_id FROM cur WHERE NOT (source = 'model' AND own IS NULL) UNION ALL SELECT label_id, session_id FROM ops WHERE source = 'human' AND retracted),
done AS (SELECT session_id, max(earliest) AS verified_at FROM items JOIN first USING (label_id) GROUP BY 1 HAVING max(earliest) IS NOT NULL)
SELECT * FROM done d WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.session_id = d.session_id AND source = 'model' AND own IS NULL AND created_at <= verified_at)""")
def verified_sessions(spark: SparkSession, d: str) -> DataFrame:
    """When review of each session was complete."""
    return labels.verified_at(records(spark, d))


@query(f"""WITH RECURSIVE {RECORDS}, under(label_id) AS (SELECT label_id FROM rec WHERE source = 'human' OR state <> 'unreviewed' UNION SELECT rec.label_id FROM rec JOIN under ON rec.parent_label_id = under.label_id)
SELECT label_id FROM rec WHERE source = 'model' AND retracted AND parent_label_id IN (SELECT label_id FROM under)""")
def forbidden_retractions(spark: SparkSession, d: str) -> DataFrame:
    """Models' retractions of what review has touched."""
    rows = records(spark, d)
    return labels.protected_ancestors(rows, rows.where("source = 'model' and retracted"))


@query(f"""WITH {RECORDS}, names AS (SELECT label_id AS old, 'v2-' || label_id AS new FROM rec WHERE retracted) SELECT label_id, coalesce(new, parent_label_id) AS parent_label_id FROM rec LEFT JOIN names ON old = parent_label_id""")
def relinked_parents(spark: SparkSession, d: str) -> DataFrame:
    """Parents under the names that a migration gave them."""
    rows = records(spark, d).select("label_id", "parent_label_id", "retracted")
    names = rows.where("retracted").select(F.col("label_id").alias("old"), F.concat(F.lit("v2-"), "label_id").alias("new"))
    return labels.relinked(rows.drop("retracted"), names, "parent_label_id")


@query(f"""WITH {RECORDS}, o AS (SELECT label_id AS owner_id, retracted, state FROM rec WHERE kind IN ('view', 'box_track', 'action')), j AS (SELECT r.*, o.retracted AS gone, o.state AS ostate, CASE WHEN r.source = 'human' THEN 'keep' WHEN o.retracted IS NULL THEN 'orphan' WHEN o.retracted THEN 'retract' WHEN r.state = 'unreviewed' AND o.state IN {REVIEWED} THEN 'inherit' ELSE 'keep' END AS action
FROM rec r LEFT JOIN o ON o.owner_id = r.parent_label_id WHERE r.parent_label_id IS NOT NULL) SELECT label_id, parent_label_id AS owner_id, action, CASE WHEN action = 'inherit' THEN ostate END AS new_state FROM j""")
def description_follow(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of descriptions when their owners change."""
    rows = records(spark, d)
    owners = rows.where("kind in ('view', 'box_track', 'action')").select(F.col("label_id").alias("owner_id"), "retracted", "state")
    return labels.description_follow(rows.where("parent_label_id is not null").withColumn("owner_id", F.col("parent_label_id")).select("label_id", "owner_id", "source", "state"), owners)


@query(f"""WITH {RECORDS}, t AS (SELECT entity_id || session_id AS track_id, created_at AS version, state, retracted FROM rec WHERE kind = 'box_track'), l AS (SELECT track_id, max(version) AS v, arg_max(state, version) AS s, arg_max(retracted, version) AS r FROM t GROUP BY 1)
SELECT label_id, entity_id || session_id AS track_id, CASE WHEN v IS NULL OR r THEN 'lapse' WHEN v > created_at THEN 'supersede' WHEN state = 'unreviewed' AND s IN {REVIEWED} THEN 'inherit' ELSE 'keep' END AS action FROM rec LEFT JOIN l ON l.track_id = entity_id || session_id WHERE kind IN ('box_track', 'hand_state')""")
def trajectory_follow(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of trajectories when their tracks change."""
    rows = records(spark, d).withColumn("track_id", F.concat("entity_id", F.col("session_id").cast("string"))).withColumn("version", F.col("created_at"))
    return labels.trajectory_follow(rows.where("kind in ('box_track', 'hand_state')").select("label_id", "track_id", "version", "state"), rows.where("kind = 'box_track'"))


@query(f"{IN_FORCE}, sp AS (SELECT DISTINCT user_id AS session_id, CASE WHEN user_id % 10 < 8 THEN 'train' ELSE 'val' END AS split FROM events) SELECT split, kind, state, count(*) AS n FROM cur JOIN sp USING (session_id) GROUP BY 1, 2, 3")
def dataset_counts(spark: SparkSession, d: str) -> DataFrame:
    """Labels of a dataset version by split, kind and state."""
    sides = events(spark, d).select(F.col("user_id").alias("session_id")).distinct().withColumn("split", F.when(F.col("session_id") % 10 < 8, "train").otherwise("val"))
    return labels.dataset_counts(records(spark, d), sides)


@query("""WITH g AS (SELECT o_orderstatus AS v, list(DISTINCT o_custkey) AS ids FROM orders GROUP BY 1), v AS (SELECT DISTINCT year(o_orderdate) AS version_id, o_custkey AS session_id, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split FROM orders),
r AS (SELECT DISTINCT 'run-' || year(o_orderdate) AS run_id, year(o_orderdate) AS version_id FROM orders), x AS (SELECT o_orderpriority AS export_id, list(DISTINCT o_custkey) AS ids FROM orders GROUP BY 1)
SELECT DISTINCT * FROM (SELECT unnest(ids) AS session_id, 'golden' AS relation, v AS target FROM g UNION ALL SELECT session_id, 'version', CAST(version_id AS VARCHAR) FROM v UNION ALL SELECT session_id, 'training', run_id FROM v JOIN r USING (version_id) WHERE split IN ('train', 'val') UNION ALL SELECT unnest(ids), 'export', export_id FROM x) WHERE session_id IN (SELECT c_custkey FROM customer)""")
def session_lineage(spark: SparkSession, d: str) -> DataFrame:
    """Where each customer's orders went, by status, year and priority."""
    orders = spark.read.parquet(f"{d}/orders.parquet").withColumn("version_id", F.year("o_orderdate"))
    ids = F.collect_set("o_custkey").alias("session_ids")
    split = F.when(F.col("o_orderstatus") == "F", "train").when(F.col("o_orderstatus") == "O", "val").otherwise("test")
    versions = orders.select("version_id", F.col("o_custkey").alias("session_id"), split.alias("split")).distinct()
    runs = orders.select(F.concat(F.lit("run-"), F.col("version_id").cast("string")).alias("run_id"), "version_id").distinct()
    sessions = spark.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("session_id"))
    return labels.lineage(sessions, orders.groupBy(F.col("o_orderstatus").alias("golden_version")).agg(ids), versions, runs, orders.groupBy(F.col("o_orderpriority").alias("export_id")).agg(ids))


SEGMENTS = f"""{EVENTS}, a AS (SELECT user_id AS k, event_id AS id, us AS s, us + (1 + event_id % 3) * {HOUR} AS e, event_type AS c FROM e0), b AS (SELECT user_id AS k, event_id AS id, us + (event_id % 5) * 900000000 AS s, us + (event_id % 5) * 900000000 + (1 + event_id % 2) * {HOUR} AS e, CASE WHEN event_id % 6 = 0 THEN 'view' ELSE event_type END AS c, value AS score FROM e0)"""


def _segments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """True intervals of each user's events, and finds that come later, end sooner and are of another class now and then."""
    rows = events(spark, d).select(F.col("user_id").alias("k"), F.col("event_id").alias("id"), "us", "event_type", "value")
    truth = rows.select("k", "id", F.col("us").alias("start"), (F.col("us") + (1 + F.col("id") % 3) * HOUR).alias("end"), F.col("event_type").alias("class"))
    start = F.col("us") + (F.col("id") % 5) * 900_000_000
    found = rows.select("k", "id", start.alias("start"), (start + (1 + F.col("id") % 2) * HOUR).alias("end"), F.when(F.col("id") % 6 == 0, "view").otherwise(F.col("event_type")).alias("class"), F.col("value").alias("score"))
    return truth, found


_PAIRS = "pr AS (SELECT a.k, a.c, a.id AS t, b.id AS p, a.s AS ts, a.e AS te, (least(a.e, b.e) - greatest(a.s, b.s)) / (greatest(a.e, b.e) - least(a.s, b.s)) AS iou FROM a JOIN b ON a.k = b.k AND a.c = b.c AND a.s < b.e AND b.s < a.e)"


@query(f"""WITH {SEGMENTS}, {_PAIRS}, best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY k, c, p ORDER BY iou DESC, ts, te, t) AS r FROM pr) WHERE r = 1 AND iou >= 0.3),
h AS (SELECT k, c, count(DISTINCT t) AS tp FROM best GROUP BY 1, 2), n AS (SELECT k, c, count(*) FILTER (WHERE x = 0) AS t, count(*) FILTER (WHERE x = 1) AS p FROM (SELECT k, c, 0 AS x FROM a UNION ALL SELECT k, c, 1 FROM b) GROUP BY 1, 2)
SELECT k, c AS class, coalesce(tp, 0) AS tp, p - coalesce(tp, 0) AS fp, t - coalesce(tp, 0) AS fn, 2.0 * coalesce(tp, 0) / (t + p) AS f1 FROM n LEFT JOIN h USING (k, c)""")
def segment_scores(spark: SparkSession, d: str) -> DataFrame:
    """Segment F1 of finds against truth by user and class."""
    truth, found = _segments(spark, d)
    return segments.segment_f1(truth, found.drop("score"), ["k", "class"], 0.3, 3 * HOUR)


@query(f"""WITH RECURSIVE {SEGMENTS}, x AS (SELECT DISTINCT k, us FROM (SELECT k, s AS us FROM a UNION ALL SELECT k, e AS us FROM a)), y AS (SELECT DISTINCT k, us FROM (SELECT k, s AS us FROM b UNION ALL SELECT k, e AS us FROM b)),
z AS (SELECT k, min(us) AS lo, max(us) AS hi FROM (SELECT * FROM x UNION ALL SELECT * FROM y) GROUP BY 1), t AS (SELECT k, us, row_number() OVER (PARTITION BY k ORDER BY us) AS i FROM x JOIN z USING (k) WHERE us > lo AND us < hi), f AS (SELECT k, us, row_number() OVER (PARTITION BY k ORDER BY us) AS j FROM y JOIN z USING (k) WHERE us > lo AND us < hi),
n AS (SELECT k, count(*) FILTER (WHERE x = 0) AS t, count(*) FILTER (WHERE x = 1) AS f FROM (SELECT k, 0 AS x FROM t UNION ALL SELECT k, 1 FROM f) GROUP BY 1),
r(k, i, j, hits) AS (SELECT k, 1, 1, 0 FROM n UNION ALL SELECT r.k, CASE WHEN f.us - t.us >= -600000000 THEN r.i + 1 ELSE r.i END, CASE WHEN t.us - f.us >= -600000000 THEN r.j + 1 ELSE r.j END, r.hits + CASE WHEN abs(f.us - t.us) <= 600000000 THEN 1 ELSE 0 END FROM r JOIN t ON t.k = r.k AND t.i = r.i JOIN f ON f.k = r.k AND f.j = r.j),
h AS (SELECT k, max(hits) AS hits FROM r GROUP BY 1) SELECT k, CAST(hits AS BIGINT) AS hits, t - hits AS misses, f - hits AS false_alarms, 2.0 * hits / (t + f) AS f1 FROM n JOIN h USING (k)""")
def boundary_scores(spark: SparkSession, d: str) -> DataFrame:
    """Boundaries of finds against those of truth within ten minutes, the outermost left out."""
    truth, found = _segments(spark, d)
    return segments.boundary_agreement(truth, found, ["k"], 600_000_000, exclude_ends=True)


@query(None)
def segment_precision(spark: SparkSession, d: str) -> DataFrame:
    """Temporal average precision of finds by class, and over classes."""
    truth, found = _segments(spark, d)
    rows = segments.temporal_precision(truth, found, "k", "class", [0.3, 0.5, 0.7], 3 * HOUR)
    return segments.temporal_map(rows, "class")


@query(None)
def annotator_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two annotators by user."""
    truth, found = _segments(spark, d)
    return segments.agreement(truth, found.drop("score"), ["k"], 600_000_000, 0.3, 3 * HOUR)


def boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """A box for each user, day and type of event, and finds that are shifted, lost now and then, and swap their tracks."""
    from pyspark.sql import window as W

    first = W.Window.partitionBy("sequence", "frame", "event_type").orderBy("us", "event_id")
    rows = events(spark, d).select(F.col("user_id").alias("sequence"), F.floor(F.col("us") / (24 * HOUR)).alias("frame"), "event_type", "us", "event_id", "value").withColumn("place", F.row_number().over(first)).where("place = 1")
    number = F.array_position(F.array(*map(F.lit, ("view", "click", "purchase", "signup", "error"))), F.col("event_type"))
    x = number * 4.0
    truth = rows.select("sequence", "frame", number.alias("id"), x.alias("x"), F.lit(0.0).alias("y"), F.lit(6.0).alias("w"), F.lit(6.0).alias("h"), F.lit("box").alias("class"))
    found = rows.where("event_id % 8 <> 0").select(
        "sequence", "frame", F.when(F.col("frame") % 4 == 0, 6 - number).otherwise(number).alias("id"), (x + (F.col("event_id") % 5) * 0.7).alias("x"), F.lit(0.5).alias("y"), F.lit(6.0).alias("w"), F.lit(6.0).alias("h"), F.lit("box").alias("class"), F.col("value").alias("score"))
    return truth, found


@query(None)
def tracking_hota(spark: SparkSession, d: str) -> DataFrame:
    return tracking.hota(*boxes(spark, d))


@query(None)
def tracking_identity(spark: SparkSession, d: str) -> DataFrame:
    return tracking.identity(*boxes(spark, d))


@query(None)
def tracking_clear(spark: SparkSession, d: str) -> DataFrame:
    return tracking.clear(*boxes(spark, d))


@query(None)
def detection_precision(spark: SparkSession, d: str) -> DataFrame:
    return tracking.detection_precision(*boxes(spark, d))


@query(None)
def linked_tracks(spark: SparkSession, d: str) -> DataFrame:
    """Finds of each user linked to tracks, day by day."""
    found = boxes(spark, d)[1]
    return tracker.tracks(found.withColumn("frame", F.col("frame") * 1000), 0.3, 3000)


@query(None)
def merged_detections(spark: SparkSession, d: str) -> DataFrame:
    """Finds of one day that share a third of their area, as one."""
    return tracker.fused(boxes(spark, d)[1], 0.33)
