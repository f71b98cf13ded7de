"""Reports, draws, quality, rules, clocks and scalar functions over the test tables, with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, hashing, text, times
from ..operators import align, metrics, rollups, rules, sampling, splits
from ..sources.tables import faults, table
from .history_queries import EVENTS, HOUR, events

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


@query("SELECT strftime(ts, '%G-W%V') AS week, event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def weekly_kpis(spark: SparkSession, d: str) -> DataFrame:
    return rollups.weekly(events(spark, d), "ts", ["event_type"], n=F.count("*"), users=F.count_distinct("user_id"), total=F.round(F.sum("value"), 4))


@query("""WITH w AS (SELECT unnest(generate_series(TIMESTAMP '2023-12-18', TIMESTAMP '2024-02-12', INTERVAL 7 DAY)) AS s), e AS (SELECT date_trunc('week', ts) AS s, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE event_type = 'error' GROUP BY 1)
SELECT strftime(w.s, '%G-W%V') AS week, n, mean FROM w LEFT JOIN e ON w.s = e.s""")
def weeks_with_gaps(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).where("event_type = 'error'").withColumn("ts", F.col("ts").cast("timestamp"))
    return rollups.with_empty_weeks(rows, "ts", "2023-12-18", "2024-02-12", n=F.count("*"), mean=F.round(F.avg("value"), 6))


@query("""SELECT 'o_orderstatus' AS dimension, o_orderstatus AS member, count(*) AS n, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*), count(DISTINCT o_custkey) FROM orders GROUP BY 2 UNION ALL SELECT 'all', NULL, count(*), count(DISTINCT o_custkey) FROM orders""")
def access_audit(spark: SparkSession, d: str) -> DataFrame:
    return rollups.audit(table(spark, d, "orders"), ["o_orderstatus", "o_orderpriority"], n=F.count("*"), customers=F.count_distinct("o_custkey"))


@query("SELECT l_returnflag, l_linestatus, CAST(grouping_id(l_returnflag, l_linestatus) AS BIGINT) AS level, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def quantity_cube(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.grouping_id().alias("level"), F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT o_custkey, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, max(o_orderdate) AS o_orderdate FROM orders GROUP BY 1")
def latest_event(spark: SparkSession, d: str) -> DataFrame:
    return rollups.latest(table(spark, d, "orders").select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], ["o_orderdate", "o_orderkey"])


@query("""WITH o AS (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderdate END AS f, CASE o_orderkey % 10 WHEN 1 THEN 'delete' WHEN 2 THEN 'keep' END AS de FROM orders), p AS (SELECT *, CAST(f AS DATE) + 365 AS due FROM o)
SELECT o_orderkey, CASE WHEN de = 'delete' THEN 'delete' WHEN de = 'keep' THEN 'kept' WHEN f IS NULL THEN 'open' WHEN due < DATE '1997-01-01' THEN 'overdue' WHEN due <= DATE '1997-01-01' + 60 THEN 'soon' ELSE 'ok' END AS status FROM p""")
def retention_status(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderdate")).alias("f"), F.when(F.col("o_orderkey") % 10 == 1, "delete").when(F.col("o_orderkey") % 10 == 2, "keep").alias("de"), F.lit(None).cast("date").alias("until"))
    return rollups.retention(rows, "f", "de", "until", F.lit("1997-01-01").cast("date"), 365, 60).select("o_orderkey", "status")


@query("""WITH c AS (SELECT p_brand, count(*) AS n, CAST(sum(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS BIGINT) AS changed FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1), o AS (SELECT sum(changed) / sum(n) AS overall FROM c)
SELECT p_brand, n, changed, round((changed + 20.0 * overall) / (n + 20.0), 9) AS rate FROM c, o""")
def smoothed_rates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select("l_partkey", "l_returnflag").join(table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand"), "l_partkey")
    return metrics.smoothed_rates(rows, "p_brand", F.col("l_returnflag") == "R", 20.0).withColumn("rate", F.round("rate", 9))


_FINE = """x AS (SELECT event_type, user_id % 5 AS arm, value > 10 AS hit FROM events), c AS (SELECT event_type, arm, count(*) AS n, CAST(sum(hit::INT) AS BIGINT) AS hits FROM x GROUP BY 1, 2),
a AS (SELECT *, sum(hits) OVER () / sum(n) OVER () AS r0 FROM c), b AS (SELECT *, (sum(hits) OVER (PARTITION BY event_type) + 10 * r0) / (sum(n) OVER (PARTITION BY event_type) + 10) AS r1 FROM a)"""


@query(f"WITH {_FINE} SELECT event_type, arm, n, hits, round((hits + 10 * r1) / (n + 10), 9) AS rate FROM b")
def calibration_cells(spark: SparkSession, d: str) -> DataFrame:
    rows = events(spark, d).withColumn("arm", F.col("user_id") % 5)
    return rollups.coarse_to_fine(rows, [[], ["event_type"], ["event_type", "arm"]], F.col("value") > 10, 10).withColumn("rate", F.round("rate", 9))


@query("SELECT user_id, round(sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END) * 2.0 + sum(value) * 0.1, 6) AS score FROM events GROUP BY 1")
def review_priority(spark: SparkSession, d: str) -> DataFrame:
    terms = {"errors": ((F.col("event_type") == "error").cast("int"), 2.0), "worth": (F.col("value"), 0.1)}
    return rollups.scored(events(spark, d), ["user_id"], terms).select("user_id", F.round("score", 6).alias("score"))


_DRAW = "CAST(('0x' || substr(sha256('7:' || CAST(doc_id AS VARCHAR) || ':audit'), 1, {0})) AS UBIGINT)::DOUBLE / {1}"


@query(f"SELECT doc_id FROM documents WHERE {_DRAW.format(16, '18446744073709551616.0')} < 0.25")
def hash_sample(spark: SparkSession, d: str) -> DataFrame:
    """A quarter of the documents, by draw."""
    return sampling.drawn(table(spark, d, "documents").select("doc_id"), "doc_id", "audit", 7, 0.25)


@query(f"SELECT doc_id, round({_DRAW.format(8, '4294967296.0')}, 9) AS short_draw FROM documents")
def short_draws(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.round(hashing.draw(hashing.seeded(7, F.col("doc_id"), F.lit("audit")), 8), 9).alias("short_draw"))


@query("""WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('w7:' || doc_id), 'w7:' || doc_id) AS r, count(*) OVER (PARTITION BY source) AS n FROM documents)
SELECT source, doc_id FROM r WHERE r <= greatest(ceil(n * 0.1), 1)""")
def audit_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.audit_sample(table(spark, d, "documents").select("source", "doc_id"), ["source"], F.concat(F.lit("w7:"), F.col("doc_id").cast("string")), 0.1)


@query("""WITH r AS (SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM supplier) SELECT * FROM r WHERE rank <= 3""")
def top_per_group(spark: SparkSession, d: str) -> DataFrame:
    rows = sampling.top_rows(table(spark, d, "supplier"), ["s_nationkey"], [F.desc("s_acctbal"), F.asc("s_suppkey")], 3)
    return rows.select("s_nationkey", "s_suppkey", F.col("rank").cast("long").alias("rank"))


@query("""WITH r AS (SELECT o_orderstatus, o_orderpriority, o_totalprice > 250000 AS bad, row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY CAST(('0x' || substr(sha256('3:' || o_orderkey || ':lot'), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0, o_orderkey) AS r,
count(*) OVER (PARTITION BY o_orderstatus, o_orderpriority) AS n FROM orders), s AS (SELECT * FROM r WHERE r <= least(n, greatest(20, ceil(n * 0.05))))
SELECT o_orderstatus, o_orderpriority, n, count(*) AS sampled, CAST(sum(bad::INT) AS BIGINT) AS defects, sum(bad::INT) <= 0.1 * count(*) AS accepted FROM s GROUP BY 1, 2, 3""")
def acceptance_lots(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select("o_orderstatus", "o_orderpriority", "o_totalprice", "o_orderkey")
    return sampling.lots(rows, ["o_orderstatus", "o_orderpriority"], "o_orderkey", 3, 20, 0.05, F.col("o_totalprice") > 250000, 0.1)


@query("""WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY floor(o_totalprice) DESC, o_totalprice DESC, o_orderkey) - 1 AS p FROM orders)
SELECT o_orderkey, ['ana', 'bo', 'cy'][CAST(CASE WHEN p % 6 < 3 THEN p % 6 ELSE 5 - p % 6 END + 1 AS INT)] AS reviewer FROM o""")
def review_plan(spark: SparkSession, d: str) -> DataFrame:
    return sampling.plan(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", F.col("o_totalprice"), ["ana", "bo", "cy"]).select("o_orderkey", "reviewer")


_PRED = "x AS (SELECT l.doc_id, l.quality AS truth, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS guess, d.lang, least(1.0, d.n_chars / 5000.0) AS conf FROM labels l JOIN documents d USING (doc_id))"


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("truth"), F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("guess"), "lang", F.least(F.lit(1.0), F.col("n_chars") / 5000.0).alias("conf"))


_SCORES = f"""{_PRED}, c AS (SELECT lang, truth, guess, count(*) AS n FROM x GROUP BY 1, 2, 3), s AS (SELECT lang, truth AS class, n AS t, 0 AS g, CASE WHEN truth = guess THEN n ELSE 0 END AS h FROM c UNION ALL SELECT lang, guess, 0, n, 0 FROM c),
f AS (SELECT lang, class, CAST(sum(h) AS BIGINT) AS hits, sum(t) AS tt, sum(g) AS gg FROM s GROUP BY 1, 2)"""


@query(f"WITH {_SCORES} SELECT lang, class, hits, round(CASE WHEN gg > 0 THEN hits / gg ELSE 0 END, 9) AS precision, round(CASE WHEN tt > 0 THEN hits / tt ELSE 0 END, 9) AS recall, round(CASE WHEN tt + gg > 0 THEN 2 * hits / (tt + gg) ELSE 0 END, 9) AS f1 FROM f")
def class_scores(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.class_scores(_predictions(spark, d), ["lang"], "truth", "guess")
    return out.select("lang", "class", "hits", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


@query(f"WITH {_SCORES} SELECT lang, round(avg(CASE WHEN tt + gg > 0 THEN 2 * hits / (tt + gg) ELSE 0 END), 9) AS macro_f1, count(*) AS classes FROM f GROUP BY 1")
def macro_f1(spark: SparkSession, d: str) -> DataFrame:
    return metrics.macro_f1(_predictions(spark, d), ["lang"], "truth", "guess").withColumn("macro_f1", F.round("macro_f1", 9))


@query(f"""WITH {_PRED}, n AS (SELECT lang, count(*) AS n, sum((truth = guess)::INT) AS same FROM x GROUP BY 1), a AS (SELECT lang, truth AS c, count(*) AS wa FROM x GROUP BY 1, 2), b AS (SELECT lang, guess AS c, count(*) AS wb FROM x GROUP BY 1, 2),
e AS (SELECT lang, sum(wa * wb) AS ch FROM a JOIN b USING (lang, c) GROUP BY 1), k AS (SELECT lang, n, same / n AS p, coalesce(ch, 0) / (n * n) AS e FROM n LEFT JOIN e USING (lang))
SELECT lang, CAST(n AS DOUBLE) AS n, round(CASE WHEN e < 1 THEN (p - e) / (1 - e) END, 9) AS kappa FROM k""")
def kappa(spark: SparkSession, d: str) -> DataFrame:
    return metrics.kappa(_predictions(spark, d), ["lang"], "truth", "guess").withColumn("kappa", F.round("kappa", 9))


@query(f"""WITH {_PRED}, b AS (SELECT lang, least(greatest(ceil(conf * 15) - 1, 0), 14) AS bin, count(*) AS n, avg(conf) AS c, avg((truth = 1)::INT) AS a FROM x GROUP BY 1, 2) SELECT lang, round(sum(n * abs(c - a)) / sum(n), 9) AS ece FROM b GROUP BY 1""")
def calibration_error(spark: SparkSession, d: str) -> DataFrame:
    return metrics.calibration_error(_predictions(spark, d), ["lang"], "conf", F.col("truth") == 1).withColumn("ece", F.round("ece", 9))


@query(f"""WITH {_PRED}, s AS (SELECT lang, conf, count(*) AS n, sum((truth = 1)::INT) AS h FROM x GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER w AS kept, sum(h) OVER w AS rt FROM s WINDOW w AS (PARTITION BY lang ORDER BY conf DESC)),
g AS (SELECT * FROM r WHERE rt >= 0.9 * kept) SELECT lang, round(min(conf), 9) AS floor, CAST(arg_min(kept, conf) AS BIGINT) AS kept, CAST(arg_min(rt, conf) AS BIGINT) AS "right" FROM g GROUP BY 1""")
def confidence_floors(spark: SparkSession, d: str) -> DataFrame:
    return metrics.confidence_floor(_predictions(spark, d), ["lang"], "conf", F.col("truth") == 1, 0.9).withColumn("floor", F.round("floor", 9))


@query("SELECT event_type, count(value) AS n, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.1), 6) AS p10, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90, round(quantile_cont(value, 0.95), 6) AS p95, max(value) AS largest FROM events GROUP BY 1")
def distributions(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.distribution(events(spark, d), ["event_type"], "value")
    return out.select("event_type", "n", *(F.round(c, 6).alias(c) for c in ("mean", "p10", "p50", "p90", "p95")), "largest")


@query("""SELECT event_type, round(sum((value > 10)::INT * (1 + user_id % 4)) / sum(1 + user_id % 4), 9) AS rate, round(pow(sum(1 + user_id % 4), 2) / sum(pow(1 + user_id % 4, 2)), 6) AS n_effective FROM events GROUP BY 1""")
def weighted_rates(spark: SparkSession, d: str) -> DataFrame:
    out = metrics.weighted_rate(events(spark, d), ["event_type"], F.col("value") > 10, (1 + F.col("user_id") % 4).cast("double"))
    return out.select("event_type", F.round("rate", 9).alias("rate"), F.round("n_effective", 6).alias("n_effective"))


@query(f"""WITH {_PRED}, r AS (SELECT *, sum(truth) OVER (PARTITION BY lang ORDER BY conf DESC, doc_id ROWS UNBOUNDED PRECEDING) AS rt, row_number() OVER (PARTITION BY lang ORDER BY conf DESC, doc_id) AS sn, sum(truth) OVER (PARTITION BY lang) AS al FROM x),
m AS (SELECT *, max(rt / sn) OVER (PARTITION BY lang ORDER BY conf DESC, doc_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS best FROM r), g AS (SELECT unnest(range(101)) AS i), l AS (SELECT DISTINCT lang, al FROM r),
p AS (SELECT l.lang, g.i, (SELECT max(best) FROM m WHERE m.lang = l.lang AND m.rt * 100 >= g.i * m.al) AS pr FROM l, g WHERE al > 0) SELECT lang, round(sum(pr) / 101, 6) AS ap FROM p GROUP BY 1""")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return metrics.average_precision(_predictions(spark, d), ["lang"], "conf", "doc_id", F.col("truth") == 1).withColumn("ap", F.round("ap", 6))


@query(f"""WITH {_PRED}, a AS (SELECT lang, avg((truth = guess)::INT) AS acc FROM x GROUP BY 1), b AS (SELECT lang, avg((truth = guess)::INT) AS acc FROM x WHERE doc_id % 2 = 0 GROUP BY 1)
SELECT a.lang, coalesce(a.acc >= b.acc - 0.02, true) AS passed FROM a LEFT JOIN b USING (lang)""")
def deployment_gate(spark: SparkSession, d: str) -> DataFrame:
    rows = _predictions(spark, d).withColumn("ok", (F.col("truth") == F.col("guess")).cast("int"))
    return metrics.gate(rows.groupBy("lang").agg(F.avg("ok").alias("acc")), rows.where("doc_id % 2 = 0").groupBy("lang").agg(F.avg("ok").alias("acc")), ["lang"], "acc", 0.02).select("lang", "passed")


@query("""WITH h AS (SELECT o_orderkey, CAST(('0x' || substr(sha256('11:' || o_custkey), 1, 16)) AS UBIGINT)::DOUBLE / 18446744073709551616.0 AS d FROM orders)
SELECT o_orderkey, CASE WHEN d < 0.8 THEN 'train' WHEN d < 0.8 + 0.1 THEN 'val' ELSE 'test' END AS split FROM h""")
def group_split(spark: SparkSession, d: str) -> DataFrame:
    return splits.assigned(table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey", 11, {"train": 0.8, "val": 0.1, "test": 0.1}).select("o_orderkey", "split")


@query("""WITH RECURSIVE p AS (SELECT DISTINCT l_suppkey AS w, l_partkey AS s FROM lineitem), e AS (SELECT DISTINCT a.w AS w, b.w AS v FROM p a JOIN p b USING (s)),
r(w, v) AS (SELECT w, v FROM e UNION SELECT r.w, e.v FROM r JOIN e ON r.v = e.w) SELECT w, min(v) AS "group" FROM r GROUP BY 1""")
def linked_groups(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers linked through parts, directly or not, over all lines."""
    rows = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("w"), F.col("l_partkey").alias("s"))
    return splits.worker_groups(rows, "w", "s").select("w", "group")


linked_groups_whole = linked_groups


@query("""SELECT c_nationkey, count(DISTINCT CASE WHEN o_custkey % 10 < 8 THEN 'train' ELSE 'val' END) AS splits FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1 HAVING splits > 1""")
def split_leaks(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey")).join(table(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    return splits.shared_across(rows.withColumn("split", F.when(F.col("c_custkey") % 10 < 8, "train").otherwise("val")), "c_nationkey", "split")


RULES = (
    rules.Rule("buys", {"event_type": ["purchase"]}, "contact", "user-{user_id}", "item-{k}"),
    rules.Rule("looks", {"event_type": ["view", "click"], "big": [None]}, "support", "user-{user_id}", "{event_type}"),
    rules.Rule("fails", {"event_type": ["error"], "big": ["yes"]}, "contain", "user-{user_id}", "error-{k}"),
)


@query("""WITH f AS (SELECT event_id, user_id, event_type, json_extract_string(props, '$.k') AS k, CASE WHEN value > 10 THEN 'yes' END AS big FROM events)
SELECT event_id, 'buys' AS rule, 'user-' || user_id AS subject, 'contact' AS predicate, 'item-' || k AS object FROM f WHERE event_type = 'purchase' AND k IS NOT NULL
UNION ALL SELECT event_id, 'looks', 'user-' || user_id, 'support', event_type FROM f WHERE event_type IN ('view', 'click') AND big IS NULL
UNION ALL SELECT event_id, 'fails', 'user-' || user_id, 'contain', 'error-' || k FROM f WHERE event_type = 'error' AND big = 'yes' AND k IS NOT NULL""")
def derived_relations(spark: SparkSession, d: str) -> DataFrame:
    facts = events(spark, d).select("event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("k"), F.when(F.col("value") > 10, "yes").alias("big"))
    return rules.derived(facts, RULES, ["event_id"])


@query("""SELECT l_suppkey, count(DISTINCT floor(l_discount / (0.1 / 5)) * 5 + floor(l_quantity / (50.0 / 5))) / 25.0 AS coverage FROM lineitem WHERE l_quantity < 50 AND l_discount < 0.1 GROUP BY 1""")
def surface_coverage(spark: SparkSession, d: str) -> DataFrame:
    return rules.coverage(table(spark, d, "lineitem"), ["l_suppkey"], "l_quantity", "l_discount", 50.0, 0.1, 5)


@query(f"""WITH {EVENTS}, a AS (SELECT user_id, (us - 1704067200000000) / 1e6 AS own, (us - 1704067200000000) / 1e6 * 1.0001 + 5 + value / 100 AS mas FROM e0), f AS (SELECT user_id, count(*) AS anchors, regr_slope(mas, own) AS s, regr_intercept(mas, own) AS i FROM a GROUP BY 1)
SELECT user_id, anchors, round(s, 9) AS scale, round(i, 4) AS "offset", abs(s - 1) * 1e6 <= 101 AS ok FROM f WHERE anchors > 2""")
def clock_fits(spark: SparkSession, d: str) -> DataFrame:
    own = (F.col("us") - 1704067200000000) / 1e6
    rows = events(spark, d).select("user_id", own.alias("own"), (own * 1.0001 + 5 + F.col("value") / 100).alias("mas"))
    return align.clock_fit(rows, ["user_id"], "own", "mas", 1.0, 101).where("anchors > 2").select("user_id", "anchors", F.round("scale", 9).alias("scale"), F.round("offset", 4).alias("offset"), "ok")


@query("""WITH m AS (SELECT *, quantile_cont(value, 0.5) OVER (PARTITION BY user_id) AS med FROM events), v AS (SELECT *, quantile_cont(abs(value - med), 0.5) OVER (PARTITION BY user_id) AS mad FROM m) SELECT event_id FROM v WHERE abs(value - med) > 3 * mad""")
def outliers(spark: SparkSession, d: str) -> DataFrame:
    return align.outliers(events(spark, d), ["user_id"], "value", 3).select("event_id")


@query(f"""WITH {EVENTS}, b AS (SELECT event_type, us // {24 * HOUR} AS slot, avg(value) AS m FROM e0 GROUP BY 1, 2), a AS (SELECT slot, m FROM b WHERE event_type = 'view'), c AS (SELECT slot, m FROM b WHERE event_type = 'click'), l AS (SELECT unnest(range(-3, 4)) AS lag)
SELECT lag, round(corr(a.m, c.m), 6) AS correlation, count(*) AS n FROM a, l JOIN c ON c.slot = a.slot + l.lag GROUP BY 1""")
def lagged_correlations(spark: SparkSession, d: str) -> DataFrame:
    rows = align.binned(events(spark, d), ["event_type"], "us", "value", float(24 * HOUR)).withColumn("k", F.lit(0))
    out = align.correlations(rows.where("event_type = 'view'"), rows.where("event_type = 'click'"), ["k"], "slot", "mean", 3)
    return out.select(F.col("lag").cast("long").alias("lag"), F.round("correlation", 6).alias("correlation"), "n")


@query("""SELECT page_id, nullif(regexp_extract(url, '^[a-z0-9+.-]+://([^/]+)', 1), '') AS host, regexp_replace(regexp_replace('ov_' || split_part(url, '/', 4) || '_' || page_id, '^ov_', ''), '_\\d+$', '') AS class, substr(sha256(url), 1, 12) AS digest FROM pages""")
def page_keys(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "pages")
    entity = F.concat(F.lit("ov_"), F.split_part("url", F.lit("/"), F.lit(4)), F.lit("_"), F.col("page_id").cast("string"))
    return rows.select("page_id", text.host_of(F.col("url")).alias("host"), text.class_of(entity).alias("class"), hashing.short_digest(F.col("url"), 12).alias("digest"))


@query("""SELECT o_custkey, sha256(string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY CAST(o_orderkey AS VARCHAR))) AS digest FROM orders GROUP BY 1""")
def input_digests(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").groupBy("o_custkey").agg(hashing.set_digest(F.col("o_orderkey")).alias("digest"))


_KEY = hashing.export_key("k1", "export-1")
_PADS = ["".join(f"{b ^ pad:02x}" for b in _KEY.ljust(64, b"\0")) for pad in (0x36, 0x5C)]


@query(f"""SELECT c_custkey, 'worker-' || substr(sha256(from_hex('{_PADS[1]}') || from_hex(sha256(from_hex('{_PADS[0]}') || encode('worker:' || c_name)))), 1, 16) AS pseudonym FROM customer""")
def pseudonyms(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", hashing.pseudonym("worker", F.col("c_name"), _KEY).alias("pseudonym"))


@query("""SELECT event_id, strftime(ts, '%G-W%V') AS week, CASE WHEN ms // 3600000 > 0 THEN (ms // 3600000) || ':' ELSE '' END || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || '.' || (ms // 100 % 10) AS clock
FROM (SELECT *, CAST(epoch_us(ts) // 1000 % 86400000 AS BIGINT) AS ms FROM events)""")
def clock_texts(spark: SparkSession, d: str) -> DataFrame:
    ms = F.expr("(us div 1000) % 86400000")
    return events(spark, d).withColumn("ms", ms).select("event_id", times.iso_week(F.col("ts")).alias("week"), times.clock_text(F.col("ms")).alias("clock"))


@query("""SELECT conv_id, turn, replace(replace(text, 'the', 'THE'), 'an', 'AN') AS replaced, CASE WHEN regexp_matches(text, 'https?://|@|[0-9]{4}') OR length(text) > 400 THEN '(removed)' ELSE text END AS guarded FROM conversations""")
def guarded_texts(spark: SparkSession, d: str) -> DataFrame:
    safe, _ = text.guarded(F.col("text"), 400, "(removed)")
    return table(spark, d, "conversations").select("conv_id", "turn", text.with_terms(F.col("text"), {"an": "AN", "the": "THE"}).alias("replaced"), safe.alias("guarded"))


@query("""SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) / (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 6) AS cosine,
round(list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS distance FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def neighbour_distances(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "embeddings").select("vec_id", "embedding")
    other = rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("vec_id").alias("other"), F.col("embedding").alias("e2"))
    return rows.join(other, "vec_id").select("vec_id", "other", F.round(geometry.cosine(F.col("embedding"), F.col("e2")), 6).alias("cosine"), F.round(geometry.distance(F.col("embedding"), F.col("e2")), 6).alias("distance"))


@query(f"""WITH {EVENTS}, i AS (SELECT event_id, us // {HOUR} AS s, CAST(floor(value) AS BIGINT) AS w, lead(us // {HOUR}) OVER v AS s2, lead(CAST(floor(value) AS BIGINT)) OVER v AS w2 FROM e0 WINDOW v AS (PARTITION BY user_id ORDER BY us, event_id)),
o AS (SELECT *, greatest(least(s + w, s2 + w2) - greatest(s, s2), 0) AS sh FROM i WHERE s2 IS NOT NULL) SELECT event_id, round(CASE WHEN w + w2 - sh > 0 THEN sh / (w + w2 - sh) WHEN s = s2 AND w = w2 THEN 1 ELSE 0 END, 9) AS iou FROM o""")
def interval_ious(spark: SparkSession, d: str) -> DataFrame:
    """Each event's hours, as many as its value, against those of the user's next."""
    from pyspark.sql import window as W

    order = W.Window.partitionBy("user_id").orderBy("us", "event_id")
    rows = events(spark, d).withColumn("s", F.expr(f"us div {HOUR}")).withColumn("w", F.floor("value").cast("long"))
    rows = rows.withColumn("s2", F.lead("s").over(order)).withColumn("w2", F.lead("w").over(order)).where("s2 is not null")
    c = F.col
    return rows.select("event_id", F.round(geometry.interval_iou(c("s"), c("s") + c("w"), c("s2"), c("s2") + c("w2")), 9).alias("iou"))


@query("""SELECT o_orderkey, 'price' AS fault FROM orders WHERE NOT coalesce(o_totalprice < 300000, false) UNION ALL SELECT o_orderkey, 'status' FROM orders WHERE NOT coalesce(o_orderstatus IN ('O', 'F'), false)""")
def contract_faults(spark: SparkSession, d: str) -> DataFrame:
    checks = {"price": F.col("o_totalprice") < 300000, "status": F.col("o_orderstatus").isin("O", "F")}
    return faults(table(spark, d, "orders"), checks).select("o_orderkey", "fault")
