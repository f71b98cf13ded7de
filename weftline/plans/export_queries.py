"""Relations brought into line, and exports, over the test tables, each with the SQL that says the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import natural_key
from ..operators import relations
from ..operators.numbering import numbered
from ..operators.rules import Rule
from ..sources import exports
from .history_queries import EVENTS, HOUR, events
from .shop_queries import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


RULES = [
    Rule("buys", {"event_type": ["purchase"]}, "grasp", "user_{user_id}", "item"),
    Rule("looks", {"event_type": ["view", "click"]}, "contact", "user_{user_id}", "item"),
    Rule("fails", {"event_type": ["error"], "odd": [None]}, "support", "user_{user_id}", "help"),
]
_DRAFTS = f"""f AS (SELECT user_id, event_id, us, us + {HOUR} AS e, 0.5 + (event_id % 50) / 100.0 AS confidence, CASE WHEN event_type = 'purchase' THEN 'grasp' WHEN event_type IN ('view', 'click') THEN 'contact' WHEN event_type = 'error' AND event_id % 2 = 0 THEN 'support' END AS predicate FROM e0),
o AS (SELECT *, max(e) OVER (PARTITION BY user_id, predicate ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p FROM f WHERE predicate IS NOT NULL), i AS (SELECT *, sum(CASE WHEN p IS NULL OR us - p > {6 * HOUR} THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, predicate ORDER BY us, event_id) AS island FROM o),
d AS (SELECT user_id, 'user_' || user_id AS subject, predicate, CASE WHEN predicate = 'support' THEN 'help' ELSE 'item' END AS object, min(us) AS us, max(e) AS e, min(confidence) AS confidence FROM i GROUP BY user_id, predicate, island),
drafts AS (SELECT *, 'rel-' || substr(sha256(concat_ws('|', user_id, subject, predicate, object, us, e)), 1, 16) AS base_id FROM d)"""


def _drafts(spark: SparkSession, d: str) -> DataFrame:
    facts = events(spark, d).select("user_id", "event_id", "event_type", "us", (F.col("us") + HOUR).alias("e"), (0.5 + (F.col("event_id") % 50) / 100).alias("confidence"), F.when(F.col("event_id") % 2 == 1, "odd").alias("odd"))
    return relations.drafted(facts, RULES, "user_id", "us", "e", "event_id", 6 * HOUR)


@query(f"WITH {EVENTS}, {_DRAFTS} SELECT base_id, user_id, subject, predicate, object, us, e, round(confidence, 6) AS confidence FROM drafts")
def relation_drafts(spark: SparkSession, d: str) -> DataFrame:
    """Relations of users to items from their events."""
    return _drafts(spark, d).withColumn("confidence", F.round("confidence", 6))


_ON_RECORD = """r0 AS (SELECT base_id, (us // 1000000) % 6 AS k, (us // 1000000) % 10 AS m FROM drafts), rec AS (
 SELECT base_id AS label_id, NULL AS parent_label_id, 'model' AS source, 'unreviewed' AS state, false AS retracted, 'rel-1' AS model_version FROM r0 WHERE k < 4 UNION ALL
 SELECT base_id || 'h', base_id, 'human', 'human_corrected', false, NULL FROM r0 WHERE k = 1 UNION ALL
 SELECT base_id || 'x', base_id, 'model', 'unreviewed', true, 'rel-1' FROM r0 WHERE k = 2 UNION ALL
 SELECT 'rel-' || substr(sha256(base_id), 1, 16), NULL, 'model', CASE WHEN m < 5 THEN 'unreviewed' ELSE 'human_approved' END, false, 'rel-1' FROM r0 WHERE k = 5)"""


@query(f"""WITH {EVENTS}, {_DRAFTS}, {_ON_RECORD} SELECT CASE WHEN k IN (0, 3) THEN 'keep' WHEN k = 1 THEN 'skip' ELSE 'insert' END AS action, CASE WHEN k = 2 THEN base_id || '-1' ELSE base_id END AS label_id FROM r0 UNION ALL SELECT 'retract', 'rel-' || substr(sha256(base_id), 1, 16) FROM r0 WHERE k = 5 AND m < 5""")
def relations_aligned(spark: SparkSession, d: str) -> DataFrame:
    """What brings records into line with the drafts: some are there, some were corrected by a human or taken away, and some are of drafts that are no more."""
    drafts = _drafts(spark, d)
    rows = drafts.select("base_id", (F.floor(F.col("us") / 1_000_000) % 6).alias("k"), (F.floor(F.col("us") / 1_000_000) % 10).alias("m"))
    none, text = F.lit(None).cast("string"), F.lit
    part = lambda where, *columns: rows.where(where).select(*(c.alias(n) for c, n in zip(columns, ("label_id", "parent_label_id", "source", "state", "retracted", "model_version"), strict=True)))
    gone = F.concat(text("rel-"), F.substring(F.sha2(F.col("base_id").cast("binary"), 256), 1, 16))
    record = part("k < 4", F.col("base_id"), none, text("model"), text("unreviewed"), text(False), text("rel-1"))
    record = record.unionByName(part("k = 1", F.concat("base_id", text("h")), F.col("base_id"), text("human"), text("human_corrected"), text(False), none))
    record = record.unionByName(part("k = 2", F.concat("base_id", text("x")), F.col("base_id"), text("model"), text("unreviewed"), text(True), text("rel-1")))
    record = record.unionByName(part("k = 5", gone, none, text("model"), F.when(F.col("m") < 5, "unreviewed").otherwise("human_approved"), text(False), text("rel-1")))
    return relations.aligned(drafts, record, "rel-")


@query("""WITH n AS (SELECT DISTINCT p_brand AS name FROM part UNION SELECT 'person') SELECT CAST(row_number() OVER (ORDER BY CASE WHEN name = 'person' THEN 2 WHEN name = 'Brand#3' THEN 0 ELSE 1 END, name) AS INT) AS category_id, name FROM n""")
def export_categories(spark: SparkSession, d: str) -> DataFrame:
    """Numbered categories of parts."""
    return exports.categories(table(spark, d, "part"), "p_brand", ["Brand#3"], ["person"])


@query("""WITH b AS (SELECT l_suppkey AS video, CAST(l_shipdate AS DATE) AS frame, row_number() OVER (ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS id, l_quantity AS x, l_linenumber - 2.0 AS w, l_returnflag AS kind FROM lineitem), i AS (SELECT video, frame, row_number() OVER (ORDER BY video, frame) AS image_id FROM (SELECT DISTINCT video, frame FROM b)), c AS (SELECT name, row_number() OVER (ORDER BY name) AS category_id FROM (SELECT DISTINCT l_returnflag AS name FROM lineitem WHERE l_returnflag <> 'N'))
SELECT row_number() OVER (ORDER BY image_id, id) AS annotation_id, CAST(image_id AS INT) AS image_id, CAST(category_id AS INT) AS category_id, x, CAST(w * 3.0 AS DOUBLE) AS area FROM b JOIN i USING (video, frame) JOIN c ON name = kind WHERE w > 0""")
def export_annotations(spark: SparkSession, d: str) -> DataFrame:
    """Lines as boxes in the pictures of their supplier and day."""
    lines = table(spark, d, "lineitem")
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    # Numbering writes the rows, so columns that nobody asks for go before it.
    rows = numbered(lines.select(*order, "l_shipdate", "l_quantity", "l_returnflag"), order, "id")
    boxes = rows.select(F.col("l_suppkey").alias("video"), F.col("l_shipdate").cast("date").alias("frame"), "id", F.col("l_quantity").alias("x"), F.lit(0.0).alias("y"), (F.col("l_linenumber") - 2.0).alias("w"), F.lit(3.0).alias("h"), F.col("l_returnflag").alias("kind"))
    ids = exports.categories(lines.where("l_returnflag <> 'N'"), "l_returnflag")
    return exports.annotations(boxes, ["video", "frame"], "kind", ids)[1].select("annotation_id", "image_id", "category_id", F.element_at("bbox", 1).alias("x"), "area")


@query("""SELECT row_number() OVER (ORDER BY CAST(regexp_extract(c_name, '(\\d+)', 1) AS BIGINT)) AS place, c_name FROM customer""")
def natural_order(spark: SparkSession, d: str) -> DataFrame:
    """Customers in natural order of their names."""
    return numbered(table(spark, d, "customer"), [natural_key(F.col("c_name"))], "place").select("place", "c_name")
