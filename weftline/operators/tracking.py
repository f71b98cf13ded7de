"""Scores of tracked boxes: HOTA, IDF1, CLEAR, and average precision of detections.

Boxes are rows of ``sequence``, ``frame``, ``id``, ``x``, ``y``, ``w``, ``h``, unique per frame and id. Pairs meet frame
by frame; sums over a sequence are aggregations. Only the assignments of one frame, or of the tracks
of one sequence, are solved in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.geometry import box_iou
from . import metrics
from .matching import assigned, least_cost
from .segments import greedy_levels
from .streamed import streamed

#: Thresholds of similarity that HOTA is a mean over, and the slack of comparisons with them.
ALPHAS, SLACK = tuple(round(0.05 * i, 2) for i in range(1, 20)), 2.220446049250313e-16
FRAME = ["sequence", "frame"]
#: Thresholds of the average precision of boxes.
LEVELS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))


def similar(truth: DataFrame, found: DataFrame) -> DataFrame:
    """Pairs of one frame whose boxes share an area: ``t``, ``p`` and ``iou``."""
    side = lambda df, x: df.select(*FRAME, F.col("id").alias(x), *(F.col(c).alias(f"{x}{c}") for c in "xywh"))
    box = lambda x: tuple(F.col(f"{x}{c}") for c in "xywh")
    return side(truth, "t").join(side(found, "p"), FRAME).withColumn("iou", box_iou(box("t"), box("p"))).where("iou > 0").select(*FRAME, "t", "p", "iou")


def _sizes(df: DataFrame, name: str, key: str) -> DataFrame:
    return df.groupBy("sequence", F.col("id").alias(key)).agg(F.count("*").alias(name))


def _totals(truth: DataFrame, found: DataFrame) -> DataFrame:
    both = truth.select("sequence", F.lit(1).alias("t"), F.lit(0).alias("p")).unionAll(found.select("sequence", F.lit(0).alias("t"), F.lit(1).alias("p")))
    return both.groupBy("sequence").agg(F.sum("t").alias("truths"), F.sum("p").alias("finds"))


def hota(truth: DataFrame, found: DataFrame) -> DataFrame:
    """``hota``, ``det_a``, ``ass_a``, ``det_re``, ``det_pr`` and ``loc_a`` of each sequence, means over ``ALPHAS``; without truths or finds all are 0 and ``loc_a`` is 1."""
    pairs = similar(truth, found)
    of = lambda k: F.sum("iou").over(W.Window.partitionBy(*FRAME, k))
    shares = pairs.withColumn("share", F.col("iou") / (of("t") + of("p") - F.col("iou")))
    met = shares.groupBy("sequence", "t", "p").agg(F.sum("share").alias("met"))
    sizes = met.join(_sizes(truth, "nt", "t"), ["sequence", "t"]).join(_sizes(found, "np", "p"), ["sequence", "p"])
    whole = sizes.select("sequence", "t", "p", "nt", "np", (F.col("met") / (F.col("nt") + F.col("np") - F.col("met"))).alias("global"))
    scored = pairs.join(whole, ["sequence", "t", "p"]).withColumn("cost", -F.col("global") * F.col("iou"))
    chosen = assigned(scored, FRAME, "t", "p", "cost", optional=True).join(pairs, [*FRAME, "t", "p"])
    hits = chosen.withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS)))).where(F.col("iou") >= F.col("alpha") - SLACK)
    linked = hits.groupBy("sequence", "alpha", "t", "p").agg(F.count("*").alias("m"), F.sum("iou").alias("loc"))
    linked = linked.join(whole.select("sequence", "t", "p", "nt", "np"), ["sequence", "t", "p"])
    n = F.col("m")
    by_alpha = linked.groupBy("sequence", "alpha").agg(F.sum("m").alias("tp"), F.sum("loc").alias("loc"), F.sum(n * n / F.greatest(F.lit(1), F.col("nt") + F.col("np") - n)).alias("links"))
    every = _totals(truth, found).withColumn("alpha", F.explode(F.array(*map(F.lit, ALPHAS)))).join(by_alpha, ["sequence", "alpha"], "left").fillna(0, ["tp", "loc", "links"])
    tp = F.col("tp")
    det, ass = tp / (F.col("truths") + F.col("finds") - tp), F.col("links") / F.greatest(F.lit(1), tp)
    empty = (F.col("truths") == 0) | (F.col("finds") == 0)
    value = lambda c, none=0.0: F.avg(F.when(empty, none).otherwise(c))
    return every.groupBy("sequence").agg(
        value(F.sqrt(det * ass)).alias("hota"), value(det).alias("det_a"), value(ass).alias("ass_a"), value(tp / F.greatest(F.lit(1), F.col("truths"))).alias("det_re"),
        value(tp / F.greatest(F.lit(1), F.col("finds"))).alias("det_pr"), value(F.when(tp > 0, F.col("loc") / tp).otherwise(1.0), 1.0).alias("loc_a"),
    )


def identity(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``idf1`` of each sequence: true and found tracks are paired one to one for the whole sequence, so that most boxes agree."""
    met = similar(truth, found).where(F.col("iou") >= threshold).groupBy("sequence", "t", "p").agg((-F.count("*")).alias("cost"))
    hits = assigned(met, ["sequence"], "t", "p", "cost", optional=True).groupBy("sequence").agg((-F.sum("cost")).alias("hits"))
    rows = _totals(truth, found).join(hits, "sequence", "left").fillna({"hits": 0})
    idtp = F.col("hits").cast("long")
    return rows.select("sequence", F.when(F.col("truths") + F.col("finds") > 0, 2.0 * idtp / (F.col("truths") + F.col("finds"))).otherwise(0.0).alias("idf1"), idtp.alias("idtp"), (F.col("finds") - idtp).alias("idfp"), (F.col("truths") - idtp).alias("idfn"))


def clear(truth: DataFrame, found: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``mota``, ``motp``, hits, false alarms, misses and identity switches of each sequence.

    Frame by frame, pairs that reach the threshold are matched for most similarity, pairs of the frame
    before first. A sequence streams through its task, a frame's pairs at a time.
    """
    import numpy as np

    both = truth.select(*FRAME).distinct().join(found.select(*FRAME).distinct(), FRAME)
    near = similar(truth, found).where(F.col("iou") >= threshold - SLACK)
    frames = both.join(near.groupBy(*FRAME).agg(F.collect_list(F.struct("t", "p", "iou")).alias("pairs")), FRAME, "left")

    def step(state: dict | None, row: dict) -> tuple[dict, list[dict]]:
        state = state or {"sequence": row["sequence"], "last": {}, "before": {}, "hits": 0, "switches": 0, "sum": 0.0}
        pairs = row["pairs"] or []
        ts, ps = sorted({x["t"] for x in pairs}), sorted({x["p"] for x in pairs})
        score = np.zeros((len(ts), len(ps)))
        for x in pairs:
            score[ts.index(x["t"]), ps.index(x["p"])] = x["iou"] + 1000 * (state["before"].get(x["t"]) == x["p"])
        chosen = [(ts[r], ps[c], score[r, c] % 1000) for r, c in least_cost(-score) if score[r, c] > SLACK] if pairs else []
        state["before"] = {t: p for t, p, _ in chosen}
        for t, p, s in chosen:
            state["switches"] += state["last"].get(t, p) != p
            state["last"][t] = p
            state["hits"] += 1
            state["sum"] += s
        return state, []

    schema = StructType([frames.schema["sequence"], StructField("hits", LongType()), StructField("switches", LongType()), StructField("sum", DoubleType())])
    sums = streamed(frames, ["sequence"], ["frame"], step, schema, end=lambda s: [{k: s[k] for k in ("sequence", "hits", "switches", "sum")}])
    rows = _totals(truth, found).join(sums, "sequence", "left").fillna(0, ["hits", "switches", "sum"])
    tp, fp, fn = F.col("hits"), F.col("finds") - F.col("hits"), F.col("truths") - F.col("hits")
    mota = F.when(F.col("finds") == 0, 0.0).otherwise((tp - fp - F.col("switches")) / F.greatest(F.lit(1), F.col("truths")))
    return rows.select("sequence", mota.alias("mota"), (F.col("sum") / F.greatest(F.lit(1), tp)).alias("motp"), tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), F.col("switches").alias("idsw"))


def detection_precision(truth: DataFrame, found: DataFrame, most: int = 100, points: int = 101) -> DataFrame:
    """Average precision of boxes by ``class`` and IoU ``threshold`` (0.5 to 0.95), at ``points`` recalls; -1 for a class without truths.

    Of each image and class the ``most`` finds of best score count. They take, best score first, the
    free truth they share most with. ``sequence`` and ``frame`` name an image; finds have ``score``.
    """
    cuts = F.explode(F.array(*map(F.lit, LEVELS)))
    best = W.Window.partitionBy(*FRAME, "class").orderBy(F.desc("score"), "id")
    kept = found.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)
    side = lambda df, x, *more: df.select(*FRAME, "class", F.col("id").alias(x), *(F.col(c).alias(f"{x}{c}") for c in (*"xywh", *more)))
    box = lambda x: tuple(F.col(f"{x}{c}") for c in "xywh")
    pairs = side(truth, "t").join(side(kept, "p", "score"), [*FRAME, "class"]).withColumn("iou", box_iou(box("t"), box("p")))
    hits = greedy_levels(pairs, [*FRAME, "class"], "iou", LEVELS, ["worse", "p", "apart", "later"], "p", "t", 1e-10, worse=-F.col("pscore"), apart=-F.col("iou"), later=-F.col("t"))
    hits = hits.select(*FRAME, "class", "threshold", F.col("p").alias("id"), F.lit(1).alias("hit"))
    rows = kept.select(*FRAME, "class", "id", "score").withColumn("threshold", cuts).join(hits, [*FRAME, "class", "threshold", "id"], "left").fillna({"hit": 0})
    rows = metrics.ranked(rows, ["class", "threshold"], "score", [*FRAME, "id"], "hit")
    totals = truth.groupBy("class").agg(F.count("*").alias("n"))
    # A hit carries the recalls that it is the first to reach.
    reached = lambda k: F.floor(k * (points - 1) / F.col("n"))
    steps = reached(F.col("right")) - reached(F.col("right") - 1) + F.when(F.col("right") == 1, 1).otherwise(0)
    sums = rows.where("hit = 1").join(totals, "class").groupBy("class", "threshold").agg((F.sum(F.col("best") * steps) / points).alias("ap"))
    classes = truth.select("class").unionAll(found.select("class")).distinct().withColumn("threshold", cuts).join(totals, "class", "left")
    return classes.join(sums, ["class", "threshold"], "left").select("class", "threshold", F.when(F.col("n").isNull(), -1.0).otherwise(F.coalesce("ap", F.lit(0.0))).alias("ap"))


def keypoint_share(pairs: DataFrame, keys: list[str], truth: Column, guess: Column, scale: Column, alpha: float) -> DataFrame:
    """Share of key points within ``alpha`` times the scale of their truth, over arrays of x, y structs; points without a guess are wrong."""
    points = pairs.withColumn("_s", scale).withColumn("_p", F.explode(F.arrays_zip(truth.alias("t"), F.coalesce(guess, F.array().cast(pairs.select(truth.alias("t")).schema["t"].dataType)).alias("g"))))
    near = F.coalesce(F.hypot(F.col("_p.t.x") - F.col("_p.g.x"), F.col("_p.t.y") - F.col("_p.g.y")) <= alpha * F.col("_s"), F.lit(False))
    return points.groupBy(*keys).agg(F.count("*").alias("points"), F.avg(near.cast("double")).alias("pck"))
