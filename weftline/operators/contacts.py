"""Contacts: of hands with boxes in the picture, of tools with surfaces, and the area that a tool has swept.

Streams meet by as-of joins, runs are islands, and a swept path is a row for each step, dealt to the grid cells near it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions import geometry
from . import joins, temporal

Keys = Sequence[str]


def boxes_at(moments: DataFrame, boxes: DataFrame, keys: Keys, time: str, moment_id: str, most_gap: float, width: int) -> DataFrame:
    """Moments with every box track (``entity``; ``x``, ``y``, ``w``, ``h``, ``outside`` by time) that is there at their time: at a key frame, or straight between two that are at most ``most_gap`` apart and both in the picture.

    ``width`` is that of the bins in which moments meet the tracks' spans.
    """
    spans = boxes.groupBy(*keys, "entity").agg(F.min(time).alias("_s"), (F.max(time) + 1).alias("_e"))
    points = moments.select(*keys, moment_id, F.col(time).alias("_t0"), (F.col(time) + 1).alias("_t1"))
    asked = joins.overlaps(points, spans, keys, ("_t0", "_t1"), ("_s", "_e"), width).select(*keys, "entity", moment_id, F.col("_t0").alias(time))
    own = [*keys, "entity"]
    framed = boxes.withColumn("_id", F.col(time)).select(*own, time, "_id", F.struct(*"xywh", F.coalesce("outside", F.lit(False)).alias("outside")).alias("box"))
    side = lambda way, name: joins.asof(asked, framed, own, time, moment_id, "_id", ["box"], way).select(*own, moment_id, time, F.col("match_time").alias(f"_{name}t"), F.col("box").alias(f"_{name}"))
    both = side("backward", "a").join(side("forward", "b").drop(time), [*own, moment_id])
    share = F.coalesce((F.col(time) - F.col("_at")) / F.nullif((F.col("_bt") - F.col("_at")).cast("double"), F.lit(0.0)), F.lit(0.0))
    corner = lambda n: tuple(F.col(f"_{n}.{c}").cast("double") for c in "xywh")
    there = ~F.col("_a.outside") & ~F.col("_b.outside") & (F.col("_bt") - F.col("_at") <= most_gap)
    exact = (F.col("_at") == F.col("_bt")) & ~F.col("_a.outside")
    return both.where(exact | there).select(*own, moment_id, time, *(c.alias(n) for n, c in zip("xywh", geometry.box_between(corner("a"), corner("b"), share), strict=True)))


def box_distance(x: Column, y: Column, box: geometry.Box) -> Column:
    """How far a point is from a box; 0 inside."""
    bx, by, bw, bh = box
    return F.hypot(F.greatest(bx - x, F.lit(0.0), x - (bx + bw)), F.greatest(by - y, F.lit(0.0), y - (by + bh)))


def video_contacts(points: DataFrame, boxes: DataFrame, keys: Keys, time: str, most_distance: float, most_gap: float, merge: float, least: float, width: int) -> DataFrame:
    """Intervals ``start`` to ``end`` in which a hand touches the same ``entity``: at each time the box nearest to any of the hand's ``points`` (``px``, ``py``; several a time), if within ``most_distance``, the least entity of equals.

    A target that comes back within ``merge``, no other between, goes on; intervals shorter than ``least`` go.
    """
    moments = points.select(*keys, time).distinct().withColumn("_m", F.col(time))
    at = boxes_at(moments, boxes, keys, time, "_m", most_gap, width)
    near = at.join(points.select(*keys, time, "px", "py"), [*keys, time])
    distance = box_distance(F.col("px").cast("double"), F.col("py").cast("double"), tuple(F.col(c) for c in "xywh"))
    near = near.groupBy(*keys, time, "entity").agg(F.min(distance).alias("_d")).where(F.col("_d") <= most_distance)
    target = near.groupBy(*keys, time).agg(F.min(F.struct("_d", "entity")).getField("entity").alias("entity"))
    line = W.Window.partitionBy(*keys).orderBy(time)
    fresh = F.lag("entity").over(line).isNull() | (F.lag("entity").over(line) != F.col("entity")) | (F.col(time) - F.lag(time).over(line) > merge)
    rows = target.withColumn("_run", F.sum(F.when(fresh, 1).otherwise(0)).over(line.rowsBetween(W.Window.unboundedPreceding, 0)))
    out = rows.groupBy(*keys, "_run", "entity").agg(F.min(time).alias("start"), F.max(time).alias("end")).drop("_run")
    return out.where(F.col("end") - F.col("start") >= least)


def surface_samples(tool: DataFrame, corners: DataFrame, keys: Keys, time: str, sample_id: str, most_gap: float) -> DataFrame:
    """A tool's points (``p``, array of three) in a surface's terms: ``a``, ``b`` (shares of its sides), ``distance`` and its size ``width``, ``height`` at the time; null without corners there.

    ``corners`` have ``corner`` (0 the origin, 1 the end of its first side, 2 that of its second), ``v`` (array of three) by time.
    """
    rows = tool
    for i in range(3):
        track = corners.where(F.col("corner") == i).withColumn("_id", F.col(time)).select(*keys, time, "_id", F.col("v"))
        one = joins.asof(rows.select(*keys, time, sample_id), track, keys, time, sample_id, "_id", ["v"]).select(*keys, sample_id, F.col("match_time").alias("_t0"), F.col("v").alias("_v0"))
        two = joins.asof(tool.select(*keys, time, sample_id), track, keys, time, sample_id, "_id", ["v"], "forward").select(*keys, sample_id, F.col("match_time").alias("_t1"), F.col("v").alias("_v1"))
        share = F.coalesce((F.col(time) - F.col("_t0")) / F.nullif((F.col("_t1") - F.col("_t0")).cast("double"), F.lit(0.0)), F.lit(0.0))
        place = F.when(F.col("_t1") - F.col("_t0") <= most_gap, F.zip_with("_v0", "_v1", lambda a, b: a + (b - a) * share))
        rows = rows.join(one, [*keys, sample_id]).join(two, [*keys, sample_id]).withColumn(f"_c{i}", place).drop("_t0", "_t1", "_v0", "_v1")
    at = lambda c: tuple(F.element_at(c, j).cast("double") for j in (1, 2, 3))
    origin, right, down = (at(f"_c{i}") for i in range(3))
    sides = geometry.minus(right, origin), geometry.minus(down, origin)
    a, b, d = geometry.surface_place(origin, right, down, at("p"))
    size = [F.sqrt(geometry.inner(s, s)) for s in sides]
    return rows.withColumns({"a": a, "b": b, "distance": d, "width": size[0], "height": size[1]}).drop("_c0", "_c1", "_c2")


def gated_runs(samples: DataFrame, keys: Keys, time: str, sample_id: str, distance: str, inside: Column, on: float, off: float, most_gap: float) -> DataFrame:
    """Samples of contacts with ``contact``, a number: from the first sample at most ``on`` away to the last one, as long as all between are ``inside`` and at most ``off`` away and no step is longer than ``most_gap``.

    A sample that is outside, null or beyond ``off`` ends a contact, so contacts lie between such samples and need no state.
    """
    line = W.Window.partitionBy(*keys).orderBy(time, sample_id)
    holds = F.coalesce(inside & (F.col(distance) <= off), F.lit(False))
    broken = ~holds | F.coalesce(F.col(time) - F.lag(time).over(line) > most_gap, F.lit(False))
    rows = samples.withColumn("_holds", holds).withColumn("_break", F.when(broken, 1).otherwise(0)).withColumn("contact", F.sum("_break").over(line.rowsBetween(W.Window.unboundedPreceding, 0))).where("_holds")
    own = W.Window.partitionBy(*keys, "contact")
    touch = F.when(F.col(distance) <= on, F.col(time))
    rows = rows.withColumns({"_s": F.min(touch).over(own), "_e": F.max(touch).over(own)})
    return rows.where((F.col(time) >= F.col("_s")) & (F.col(time) <= F.col("_e"))).drop("_holds", "_break", "_s", "_e")


def surface_contacts(samples: DataFrame, keys: Keys, time: str, sample_id: str, distance: str, inside: Column, on: float, off: float, most_gap: float, merge: float, least: float) -> DataFrame:
    """``start`` and ``end`` of contacts of :func:`gated_runs`, those at most ``merge`` apart as one, those shorter than ``least`` gone."""
    runs = gated_runs(samples, keys, time, sample_id, distance, inside, on, off, most_gap).groupBy(*keys, "contact").agg(F.min(time).alias("start"), F.max(time).alias("end"))
    return temporal.merged(runs, keys, "start", "end", "contact", merge).where(F.col("end") - F.col("start") >= least).select(*keys, "start", "end")


def swept_cells(path: DataFrame, keys: Keys, contact: str, time: str, sample_id: str, radius: float, grid: float) -> DataFrame:
    """``ix``, ``iy`` of every cell that a round tool has passed over, once each, with ``nx``, ``ny``, the cells of the whole surface.

    The path has ``a``, ``b`` (shares of the sides) and ``width``, ``height``, of which the medians count. Consecutive samples of a contact are a
    capsule, a lone one is a circle; a cell counts if its middle is at most ``radius`` from one.
    """
    sizes = path.groupBy(*keys).agg(F.percentile("width", F.lit(0.5)).alias("_w"), F.percentile("height", F.lit(0.5)).alias("_h"))
    cells = lambda c: F.greatest(F.lit(1), F.ceil(F.col(c) / grid)).cast("long")
    sizes = sizes.withColumn("nx", cells("_w")).withColumn("ny", cells("_h"))
    line = W.Window.partitionBy(*keys, contact).orderBy(time, sample_id)
    rows = path.select(*keys, contact, time, sample_id, "a", "b").withColumns({"_a0": F.lag("a").over(line), "_b0": F.lag("b").over(line), "_n": F.count(F.lit(1)).over(W.Window.partitionBy(*keys, contact))})
    rows = rows.where("_a0 is not null or _n = 1").join(sizes, list(keys))
    x1, y1 = F.col("a") * F.col("_w"), F.col("b") * F.col("_h")
    rows = rows.select(*keys, "nx", "ny", "_w", "_h", (F.col("_w") / F.col("nx")).alias("_cw"), (F.col("_h") / F.col("ny")).alias("_ch"), F.coalesce(F.col("_a0") * F.col("_w"), x1).alias("x0"), F.coalesce(F.col("_b0") * F.col("_h"), y1).alias("y0"), x1.alias("x1"), y1.alias("y1"))

    def reach(low: str, high: str, size: str, whole: str, n: str) -> Column:
        """Numbers and middles of the cells whose middles may be near; (2i + 1) w / 2n is rounded once."""
        first = F.greatest(F.lit(0), F.floor((F.least(low, high) - radius) / F.col(size) - 0.5)).cast("long")
        last = F.least(F.col(n) - 1, F.ceil((F.greatest(low, high) + radius) / F.col(size) - 0.5)).cast("long")
        cells = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(cells, lambda i: F.struct(i.alias("i"), ((2 * i + 1) * F.col(whole) / (2 * F.col(n))).alias("g")))

    boxed = lambda g, a, b: (g >= F.least(a, b) - radius) & (g <= F.greatest(a, b) + radius)
    rows = rows.distinct().withColumn("_x", F.explode(reach("x0", "x1", "_cw", "_w", "nx"))).where(boxed(F.col("_x.g"), "x0", "x1"))
    rows = rows.withColumn("_y", F.explode(reach("y0", "y1", "_ch", "_h", "ny"))).where(boxed(F.col("_y.g"), "y0", "y1"))
    dx, dy = F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0")
    # A middle that is exactly the radius away counts: all is taken from the middle, which moves no such distance past it.
    from_x, from_y = F.col("_x.g") - F.col("x0"), F.col("_y.g") - F.col("y0")
    along = (from_x * dx + from_y * dy) / F.nullif(dx * dx + dy * dy, F.lit(0.0))
    # Exploded, so that each is computed once, not wherever it is named.
    rows = rows.withColumn("_u", F.explode(F.array(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(along, F.lit(0.0)))))))
    off_x, off_y = from_x - dx * F.col("_u"), from_y - dy * F.col("_u")
    return rows.where(F.sqrt(off_x * off_x + off_y * off_y) <= radius).select(*keys, "nx", "ny", F.col("_x.i").alias("ix"), F.col("_y.i").alias("iy")).distinct()


def coverage(path: DataFrame, keys: Keys, contact: str, time: str, sample_id: str, radius: float, grid: float) -> DataFrame:
    """``ratio``: the share of the surface's cells that the path has swept; 0 where it is all beside the surface."""
    swept = swept_cells(path, keys, contact, time, sample_id, radius, grid).groupBy(*keys).agg((F.count(F.lit(1)) / F.max(F.col("nx") * F.col("ny"))).alias("_r"))
    return path.select(*keys).distinct().join(swept, list(keys), "left").select(*keys, F.coalesce("_r", F.lit(0.0)).alias("ratio"))
