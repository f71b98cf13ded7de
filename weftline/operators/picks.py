"""Choosing records: the best of a kind, what a plan still lacks, samples, seeds and replacements."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.hashing import draw, seeded
from . import joins, temporal
from .labels import protected
from .numbering import numbered_by
from .splits import held_apart

Keys = Sequence[str]
#: Levels of a person in one block of seats.
LEVELS = 4096


def rank() -> list[Column]:
    """Order of tracks for one target: protected first, then the newest, the longest, the greatest id."""
    return [F.desc(protected()), F.desc("created_at"), F.desc(F.col("t_end_ms") - F.col("t_start_ms")), F.desc("label_id")]


def grade() -> Column:
    """How far review has gone: 3 human or corrected, 2 approved, 1 sampled, 0 not at all."""
    return F.when((F.col("source") == "human") | (F.col("state") == "human_corrected"), 3).when(F.col("state") == "human_approved", 2).when(F.col("state") == "sample_verified", 1).otherwise(0)


def preferred() -> list[Column]:
    """Order of labels that say the same: best reviewed, newest, least id."""
    return [F.desc(grade()), F.desc("created_at"), F.asc("label_id")]


def best(rows: DataFrame, keys: Keys, order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_place", F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def best_of_kinds(rows: DataFrame, kinds: Sequence[str], target: str, order: Sequence[Column]) -> DataFrame:
    """The best record of each target among ``kinds``; records of other kinds all stay."""
    ranked = F.col("kind").isin(*kinds)
    return best(rows.where(ranked), [target], order).unionByName(rows.where(~ranked))


def translations(rows: DataFrame, segment: str, language: str, source: str) -> DataFrame:
    """The preferred description of each segment in a language; one translated from another counts only if that one is here too."""
    here = rows.select(F.col("label_id").alias(source)).distinct()
    own, made = rows.where(F.col(source).isNull()), rows.where(F.col(source).isNotNull()).join(here, source, "left_semi")
    return best(own.unionByName(made).where(F.col("language") == language), [segment], preferred())


def chunks(rows: DataFrame, keys: Keys, order: Keys, most: int) -> DataFrame:
    """Adds ``chunk``: runs of ``most`` rows in order, within a key."""
    place = F.row_number().over(W.Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("chunk", F.floor((place - 1) / most).cast("long"))


def windows(spans: DataFrame, keys: Keys, start: str, end: str, length: int) -> DataFrame:
    """Windows of a fixed length that cover each span, the last one cut at its end: ``window``, ``from`` and ``to``."""
    n = F.greatest(F.ceil((F.col(end) - F.col(start)) / length), F.lit(1)).cast("int")
    rows = spans.select(*keys, start, end, F.posexplode(F.sequence(F.lit(0), n - 1)).alias("window", "_k"))
    begin = F.col(start) + F.col("_k") * length
    return rows.select(*keys, "window", begin.alias("from"), F.least(begin + length, F.col(end)).alias("to"))


def covering_moments(spans: DataFrame, keys: Keys, start: str, end: str) -> DataFrame:
    """The fewest moments so that every span holds one: the end of the first to end, then of the first to end among those that start after it, and so on. ``at`` per key, by one sorted pass."""
    from pyspark.sql.types import StructField, StructType

    from .streamed import streamed

    rows = spans.select(*keys, start, end)

    def step(state: object, row: dict) -> tuple[object, list[dict]]:
        if state is not None and row[start] <= state:
            return state, []
        return row[end], [{k: row[k] for k in keys} | {"at": row[end]}]

    return streamed(rows, keys, [end, start], step, StructType([*(rows.schema[k] for k in keys), StructField("at", rows.schema[end].dataType)]))


def golden(sessions: DataFrame, session: str, worker: str, site: str, target: int, taken: DataFrame) -> DataFrame:
    """Whole workers for a golden set of about ``target`` sessions: those whose sites they share with the fewest sessions of others come first, then the least; a worker comes in while the set is below target. Sessions in ``taken`` don't count.

    Workers are ranked on their totals; sums run over one row a worker.
    """
    rows = sessions.join(taken.select(session).distinct(), session, "left_anti")
    cells = rows.groupBy(worker, site).agg(F.count("*").alias("n"))
    whole = cells.groupBy(site).agg(F.sum("n").alias("_all"))
    cost = cells.join(whole, site).groupBy(worker).agg(F.sum(F.col("_all") - F.col("n")).alias("shared"), F.sum("n").alias("own"))
    before = W.Window.orderBy("shared", worker).rowsBetween(W.Window.unboundedPreceding, -1)
    chosen = cost.withColumn("_before", F.coalesce(F.sum("own").over(before), F.lit(0))).where(F.col("_before") < target)
    return rows.join(chosen.select(worker), worker, "left_semi").select(session)


def golden_sides(candidates: DataFrame, session: str, worker: str, site: str, golden_sets: DataFrame, version: str) -> DataFrame:
    """``side`` of each candidate: ``golden`` for members of the chosen version; workers and sites of every golden set block the rest."""
    members = golden_sets.select(F.explode("session_ids").alias(session), "golden_version")
    other = members.where(F.col("golden_version") != version).select(session).distinct()
    known = candidates.join(other, session, "left_semi").select(worker, site)
    rows = held_apart(candidates, session, worker, site, members.where(F.col("golden_version") == version).select(session))
    workers, sites = known.select(worker, F.lit(True).alias("_w")).distinct(), known.select(site, F.lit(True).alias("_s")).distinct()
    blocked = F.col("_w").isNotNull() | F.col("_s").isNotNull()
    rows = rows.join(workers, worker, "left").join(sites, site, "left")
    return rows.withColumn("side", F.when((F.col("side") == "pool") & blocked, "holdout").otherwise(F.col("side"))).drop("_w", "_s")


def without(rows: DataFrame, gone: DataFrame, keys: Keys) -> DataFrame:
    """Rows whose key isn't among ``gone``: what a plan still lacks, sessions that were not withdrawn."""
    return rows.join(gone.select(*keys).distinct(), list(keys), "left_anti")


def among(rows: DataFrame, known: DataFrame, keys: Keys) -> DataFrame:
    """Rows whose key is among ``known``."""
    return rows.join(known.select(*keys).distinct(), list(keys), "left_semi")


def withdrawn(versions: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """Dataset versions that hold withdrawn sessions, with how many."""
    return among(versions, withdrawals, ["session_id"]).groupBy("version_id").agg(F.count_distinct("session_id").alias("sessions"))


def unprotected(found: DataFrame, guarded: DataFrame, keys: Keys, row_id: str, span: tuple[str, str], width: int) -> DataFrame:
    """New intervals that share no more than a point with a protected one of their key."""
    start, end = span
    guards = guarded.select(*keys, F.col(start).alias("_gs"), F.col(end).alias("_ge"))
    hit = joins.overlaps(found, guards, keys, span, ("_gs", "_ge"), width).select(*keys, row_id).distinct()
    return found.join(hit, [*keys, row_id], "left_anti")


def gapless(kept: DataFrame, keys: Keys, row_id: str, span: tuple[str, str], low: int, high: int) -> DataFrame:
    """Intervals with what they leave of ``[low, high)`` filled in: rows of a null id are gaps."""
    start, end = span
    holes = temporal.holes(kept, keys, start, end, row_id, low, high)
    return kept.select(*keys, row_id, start, end).unionByName(holes.select(*keys, F.lit(None).cast(kept.schema[row_id].dataType).alias(row_id), F.col("hole_start").alias(start), F.col("hole_end").alias(end)))


def lag(frozen: DataFrame, now: DataFrame, keys: Keys, item: str) -> DataFrame:
    """Per key how a frozen set has aged: items that are gone, and items that came since."""
    a, b = frozen.select(*keys, item).distinct(), now.select(*keys, item).distinct()
    missing = a.join(b, [*keys, item], "left_anti").groupBy(*keys).agg(F.count("*").alias("missing"))
    extra = b.join(a, [*keys, item], "left_anti").groupBy(*keys).agg(F.count("*").alias("extra"))
    return missing.join(extra, list(keys), "full_outer").fillna(0, ["missing", "extra"])


def shown(labels: DataFrame, assignments: DataFrame) -> DataFrame:
    """Labels that an assignment shows, by ``mode``: standard all of its session, blind and double none, only those in ``ids``, withheld all but those."""
    rows = labels.join(assignments, "session_id")
    listed = F.coalesce(F.array_contains("ids", F.col("label_id")), F.lit(False))
    hit = F.when(F.col("mode") == "standard", True).when(F.col("mode") == "only", listed).when(F.col("mode") == "withheld", ~listed).otherwise(False)
    return rows.where(hit).select("assignment_id", "label_id")


def migrated(rows: DataFrame, column: str, names: DataFrame) -> DataFrame:
    """Records under a new vocabulary. ``names`` has ``old`` and ``new``: one new name is taken over; several, or none, need a review (``needs_review``); a name that isn't in the table stays as it is."""
    options = names.groupBy(F.col("old").alias(column)).agg(F.count("new").alias("_n"), F.min("new").alias("_new"))
    out = rows.join(options, column, "left")
    needs = F.coalesce(F.col("_n") != 1, F.lit(False))
    return out.select(*(F.when(needs | F.col("_new").isNull(), F.col(c)).otherwise(F.col("_new")).alias(c) if c == column else F.col(f"`{c}`") for c in rows.columns), needs.alias("needs_review"))


def seeded_errors(rows: DataFrame, groups: Keys, row_id: str, seed: int, most: int, edits: Mapping[str, Mapping[str, Column]]) -> DataFrame:
    """Copies of ``most`` records of each group, drawn by hash, each with one of ``edits`` (a name and the columns it changes): the same seed plants the same errors. ``error`` names the edit."""
    order = W.Window.partitionBy(*groups).orderBy(draw(seeded(seed, F.col(row_id), F.lit("seed"))), row_id)
    names = list(edits)
    pick = F.element_at(F.array(*map(F.lit, names)), (F.floor(draw(seeded(seed, F.col(row_id), F.lit("edit"))) * len(names)) + 1).cast("int"))
    drawn = rows.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= most).withColumn("error", pick)

    def edited(c: str) -> Column:
        out = F.col(f"`{c}`")
        for name, columns in edits.items():
            if c in columns:
                out = F.when(F.col("error") == name, columns[c]).otherwise(out)
        return out.alias(c)

    return drawn.select(*(edited(c) for c in rows.columns), "error")


def least_loaded(units: DataFrame, unit: str, order: Sequence[Column], loads: DataFrame, who: str, load: str) -> DataFrame:
    """Units in order, each to whoever has least by then (ties by name), for loads that start unequal.

    Giving one at a time to the least loaded fills loads up level by level. So a person's k-th new
    unit is taken at level load + k, and the order of all (level, name) is the order of the units: both
    sides are numbered by ranges and meet, without a loop over units. Seats end at the level where the
    units do: about as many as units, and two more a person.
    """
    total = units.count()
    # Nobody gets beyond the level at which the people below it would have taken every unit; each round leaves out people who start above the last one.
    top = (loads.agg(F.min(load)).first()[0] or 0) + total
    while True:
        n, sum_of_loads = loads.where(F.col(load) <= top).agg(F.count(F.lit(1)), F.sum(load)).first()
        lower = (total + sum_of_loads) // n + 1 if n else top
        if lower >= top:
            break
        top = lower
    # A person's levels come in blocks, so that neither one row nor one task holds them all.
    blocks = loads.where(F.col(load) <= top).select(who, F.col(load).cast("long").alias("_from"), F.explode(F.sequence(F.col(load).cast("long"), F.lit(top).cast("long"), F.lit(LEVELS).cast("long"))).alias("_low"))
    seats = blocks.repartition(who, "_low").select(who, F.explode(F.sequence(F.col("_low"), F.least(F.col("_low") + (LEVELS - 1), F.lit(top).cast("long")))).alias("_level"))
    seats = numbered_by(seats, [F.asc("_level"), F.asc(who)], "_place").where(F.col("_place") <= total)
    return numbered_by(units, order, "_place").join(seats, "_place").select(*units.columns, who)
