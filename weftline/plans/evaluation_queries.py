"""Reports by subgroups and dataset versions over the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import evaluation
from .history_queries import HOUR, intervals
from .report_queries import table

QUERIES, ORACLES = {}, {}
TYPES = ("view", "click", "purchase", "signup", "error")


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _report(spark: SparkSession, d: str) -> DataFrame:
    """Users as sessions with segment and a third of the nations as axes; types guessed from a key; views against times of high values; errors among low values."""
    rows = intervals(spark, d).join(table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k")), "event_id")
    guess = F.element_at(F.array(*map(F.lit, TYPES)), F.col("k") % 5 + 1)
    pairs = rows.select(F.col("user_id").alias("session"), F.col("event_type").alias("truth"), F.when(F.col("k") < 60, F.col("event_type")).otherwise(guess).alias("guess"), (F.col("k") / 100).alias("sure"))
    people = table(spark, d, "customer").select(F.col("c_custkey").alias("session"), F.col("c_mktsegment").alias("segment"), (F.col("c_nationkey") % 3).alias("third"))
    sessions = rows.select(F.col("user_id").alias("session")).distinct().join(people, "session", "left")
    span = lambda df: df.select(F.col("user_id").alias("session"), F.col("us").alias("start"), F.col("e").alias("end"), F.col("event_id").alias("id"))
    tasks = {
        "types": evaluation.classification(pairs, confidence="sure", bins=10),
        "views": evaluation.intervals(span(rows.where("event_type = 'view'")), span(rows.where("value > 12 and k < 70")), [], 0.5, 60_000_000, 2 * HOUR),
        "errors": evaluation.ranking(rows.select(F.col("user_id").alias("session"), "event_id", (1 / (1 + F.col("value"))).alias("score"), (F.col("event_type") == "error").alias("hit")), "score", "event_id", F.col("hit")),
    }
    return evaluation.evaluate(sessions, ["segment", "third"], tasks)


@query("""WITH x AS (SELECT user_id AS session, event_type AS truth, CAST(json_extract(props, '$.k') AS INT) AS k, value, event_id FROM events), p AS (SELECT *, CASE WHEN k < 60 THEN truth ELSE ['view', 'click', 'purchase', 'signup', 'error'][k % 5 + 1] END AS guess FROM x),
s AS (SELECT DISTINCT session, c_mktsegment AS segment, c_nationkey % 3 AS third FROM x LEFT JOIN customer ON c_custkey = session), g AS (SELECT session, unnest(['overall', 'segment=' || coalesce(segment, 'unknown'), 'third=' || coalesce(CAST(third AS VARCHAR), 'unknown')]) AS "group" FROM s),
j AS (SELECT g."group", p.* FROM p JOIN g USING (session)), t AS (SELECT "group", truth AS class, count(*) AS t FROM j GROUP BY 1, 2), q AS (SELECT "group", guess AS class, count(*) AS g FROM j GROUP BY 1, 2), h AS (SELECT "group", truth AS class, count(*) AS h FROM j WHERE truth = guess GROUP BY 1, 2),
c AS (SELECT "group", class, coalesce(t, 0) AS t, coalesce(q.g, 0) AS g, coalesce(h, 0) AS h FROM t FULL JOIN q USING ("group", class) LEFT JOIN h USING ("group", class)), f AS (SELECT *, 2.0 * h / (t + g) AS f1 FROM c),
m AS (SELECT "group", sum(h) AS h, sum(t) AS n, avg(f1) AS macro, sum(t * g) AS ch FROM f GROUP BY 1), b AS (SELECT "group", least(k // 10, 9) AS bin, sum(k / 100.0) AS c, sum(CASE WHEN truth = guess THEN 1 ELSE 0 END) AS h, count(*) AS n FROM j GROUP BY 1, 2),
r AS (SELECT "group", event_id, truth = 'error' AS hit, 1 / (1 + value) AS score FROM j), o AS (SELECT *, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER w AS rt, row_number() OVER w AS seen, sum(CASE WHEN hit THEN 1 ELSE 0 END) OVER (PARTITION BY "group") AS al FROM r WINDOW w AS (PARTITION BY "group" ORDER BY score DESC, event_id)),
z AS (SELECT *, max(rt / seen) OVER (PARTITION BY "group" ORDER BY seen DESC) AS best FROM o), ap AS (SELECT "group", sum(CASE WHEN hit THEN best * (floor(rt * 100 / al) - floor((rt - 1) * 100 / al) + CASE WHEN rt = 1 THEN 1 ELSE 0 END) ELSE 0 END) / 101 AS ap, max(al) AS al FROM z GROUP BY 1)
SELECT 'types' AS task, "group", 'f1/' || class AS metric, round(f1, 6) AS value FROM f UNION ALL SELECT 'types', "group", 'accuracy', round(h / n, 6) FROM m UNION ALL SELECT 'types', "group", 'macro_f1', round(macro, 6) FROM m UNION ALL SELECT 'types', "group", 'kappa', round((h / n - ch / (n * n)) / (1 - ch / (n * n)), 6) FROM m
UNION ALL SELECT 'types', "group", 'rows', CAST(n AS DOUBLE) FROM m UNION ALL SELECT 'types', "group", 'calibration_error', round(sum(abs(c - h)) / sum(n), 6) FROM b GROUP BY "group" UNION ALL SELECT 'errors', "group", 'average_precision', round(ap, 6) FROM ap WHERE al > 0""")
def group_reports(spark: SparkSession, d: str) -> DataFrame:
    """All figures of two tasks, overall and by subgroup."""
    return _report(spark, d).where("task <> 'views'").select("task", "group", "metric", F.round("value", 6).alias("value"))


@query(None)
def interval_reports(spark: SparkSession, d: str) -> DataFrame:
    """Figures of intervals, overall and by subgroup; tests compare them with plain loops."""
    return _report(spark, d).where("task = 'views'").select("task", "group", "metric", F.round("value", 6).alias("value"))


def _version(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    """Orders as sessions of customers at places that few share, lines as labels."""
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("worker"), (F.col("o_custkey") % 997 - F.col("o_custkey") % 997 % 3).alias("site"))
    labels = table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("label_id"), F.col("l_orderkey").alias("session"), F.col("l_linestatus").alias("kind"), F.col("l_returnflag").alias("state"))
    return evaluation.dataset_version(labels, orders, F.col("state").isin("A", "R"), "v1", 7, {"train": 0.8, "val": 0.1, "test": 0.1})


_ITEMS = """i AS (SELECT l_orderkey AS session, o_custkey % 997 - o_custkey % 997 % 3 AS site, l_linestatus AS kind, l_returnflag AS state, o_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R'))"""


@query(f"WITH {_ITEMS} SELECT 'v1' AS version, 7 AS seed, count(*) AS labels, count(DISTINCT session) AS sessions FROM i")
def dataset_manifest(spark: SparkSession, d: str) -> DataFrame:
    """What a version of the dataset holds."""
    return _version(spark, d)["manifest"].drop("digest")


@query(f"WITH {_ITEMS} SELECT kind, state, count(*) AS n FROM i GROUP BY 1, 2")
def dataset_kinds(spark: SparkSession, d: str) -> DataFrame:
    """Labels of the version by kind and state, over all splits; a label in two splits or none would show."""
    return _version(spark, d)["counts"].groupBy("kind", "state").agg(F.sum("n").alias("n"))
