"""Label histories: which records count, what they refer to, what review made of them.

Records are append-only rows with ``label_id``, ``session_id``, ``kind``, ``source`` (human, model or
sensor), ``state`` (unreviewed, sample_verified, human_approved, human_corrected),
``parent_label_id``, ``retracted``, ``seeded_error`` and times; predicates are column expressions.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from ..functions.hashing import fitted_id, short_digest
from . import history

APPROVED = ("human_approved", "human_corrected")
REVIEWED = ("sample_verified", *APPROVED)


def protected() -> Column:
    """Human, or touched by review: a new model version may not replace it."""
    return (F.col("source") == "human") | (F.col("state") != "unreviewed")


def truth() -> Column:
    """Counts as truth in evaluation: human, or approved or corrected by a human."""
    return (F.col("source") == "human") | F.col("state").isin(*APPROVED)


def pending(reviewable: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """A model's label that nobody has looked at, of a kind that has a way to review."""
    return (F.col("source") == "model") & (F.col("state") == "unreviewed") & F.col("kind").isin(*reviewable) & ~F.col("kind").isin(*excluded)


def allowed_states(policy: Sequence[str], include_unreviewed: bool) -> tuple[str, ...]:
    """States that an export takes."""
    return tuple(policy) + (("unreviewed",) if include_unreviewed and "unreviewed" not in policy else ())


def exported(states: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """Human labels and those in a state that the export takes, of kinds it doesn't leave out."""
    return ~F.col("kind").isin(*excluded) & ((F.col("source") == "human") | F.col("state").isin(*states))


def automatic(rules: Sequence[tuple[str, str]]) -> Column:
    """Matches one of (kind, start of the model's version)."""
    hit = F.lit(False)
    for kind, prefix in rules:
        hit = hit | ((F.col("kind") == kind) & F.coalesce(F.col("model_version").startswith(prefix), F.lit(False)))
    return hit


def judged(kinds: Sequence[str], sources: Sequence[str], longest_ms: int, sensors: Column | None = None) -> Column:
    """Unreviewed automatic labels for a judge: of its kinds and sources, not made from a sensor, not too long."""
    length = F.col("t_end_ms") - F.col("t_start_ms")
    hit = (F.col("state") == "unreviewed") & F.col("kind").isin(*kinds) & F.col("source").isin(*sources) & (length <= longest_ms)
    return hit if sensors is None else hit & ~F.coalesce(sensors, F.lit(False))


def references(fields: Mapping[str, Sequence[Column]]) -> Column:
    """The entities a label names: per kind, those of its fields that are set, in order."""
    out = F.array().cast("array<string>")
    for kind, columns in fields.items():
        out = F.when(F.col("kind") == kind, F.array_compact(F.array(*(c.cast("string") for c in columns)))).otherwise(out)
    return out


def class_key(fields: Mapping[str, Column]) -> Column:
    """What a label is called in counts: per kind ``kind:value``, or the kind alone."""
    out = F.col("kind")
    for kind, column in fields.items():
        out = F.when((F.col("kind") == kind) & column.isNotNull(), F.concat(F.lit(f"{kind}:"), column.cast("string"))).otherwise(out)
    return out


def tombstones(stale: DataFrame, model_version: str, now: Column) -> DataFrame:
    """Retractions of ``stale`` records by a model's version: a new id, the old record as parent, unreviewed."""
    suffix = F.concat(F.lit("x"), short_digest(F.lit(model_version), 8))
    changed = {"label_id": fitted_id(F.col("label_id"), suffix), "parent_label_id": F.col("label_id"), "retracted": F.lit(True), "source": F.lit("model"), "model_version": F.lit(model_version), "state": F.lit("unreviewed"), "created_at": now}
    return stale.select(*(changed.get(c, F.col(f"`{c}`")).alias(c) for c in stale.columns))


def covering(labels: DataFrame, moments: DataFrame, keys: Sequence[str], start: str, end: str, time: str, width: int) -> DataFrame:
    """Labels with the moments they cover: ``start <= t < end``, and a label without length only its own moment. They meet in bins of ``width``."""
    a = labels.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    b = moments.withColumn("_bin", F.floor(F.col(time) / width))
    inside = (F.col(start) <= F.col(time)) & ((F.col(time) < F.col(end)) | ((F.col(start) == F.col(end)) & (F.col(time) == F.col(start))))
    return a.join(b, [*keys, "_bin"]).where(inside).drop("_bin")


def review_changes(records: DataFrame, states: Sequence[str] = REVIEWED) -> DataFrame:
    """``outcome``, ``label_id``, ``root_id`` (the model's original), ``at`` and ``who`` of each thing review did.

    Of records in force, a model's is accepted in one of ``states``; a human's is corrected if its
    chain starts with a model's record, else added; sensors' don't count. A human's retraction
    whose parent's chain starts with a model's record is deleted, under the parent's id. What descends
    from seeded records never counts.
    """
    roots = history.chain_roots(records, "label_id", "parent_label_id").select(F.col("id").alias("_id"), F.col("root").alias("_root"))
    sources = records.select(F.col("label_id").alias("_root"), F.col("source").alias("_root_source"))
    origin = roots.join(sources, "_root")
    at = F.coalesce("reviewed_at", "created_at")
    now = history.current(records, "label_id", "parent_label_id", F.col("retracted"), F.col("seeded_error"))
    now = now.where((F.col("source") == "human") | ((F.col("source") == "model") & F.col("state").isin(*states)))
    now = now.join(origin, now["label_id"] == origin["_id"])
    from_model = F.col("_root_source") == "model"
    outcome = F.when(F.col("source") == "model", "accepted").when(from_model, "corrected").otherwise("added")
    root = F.when(F.col("source") == "model", F.col("label_id")).when(from_model, F.col("_root"))
    kept = now.select(outcome.alias("outcome"), "label_id", root.alias("root_id"), at.alias("at"), F.col("reviewer_id").alias("who"))
    banned = history.closure(records, records.where("seeded_error").select(F.col("label_id").alias("id")), "label_id", "parent_label_id")
    gone = records.where((F.col("source") == "human") & F.col("retracted")).join(banned.withColumnRenamed("id", "label_id"), "label_id", "left_anti")
    gone = gone.join(origin.where(from_model), gone["parent_label_id"] == origin["_id"])
    return kept.unionByName(gone.select(F.lit("deleted").alias("outcome"), F.col("parent_label_id").alias("label_id"), F.col("_root").alias("root_id"), at.alias("at"), F.col("reviewer_id").alias("who")))


def without_inherited(changes: DataFrame, inherited: DataFrame) -> DataFrame:
    """Changes but for those that a label only took over from the one it belongs to."""
    return changes.join(inherited.select("label_id").distinct(), "label_id", "left_anti")


def reconciled(sent: DataFrame, returned: DataFrame, values: Sequence[str], reviewer: str) -> DataFrame:
    """What review returned against what was sent: ``outcome`` approved, corrected, retracted or added, and the ``label_id`` of the new human record (null where none is needed).

    ``returned`` has ``origin_label_id``, null for what was drawn anew; an origin that wasn't sent counts as
    none. An origin that returns twice gives ``duplicate`` rows: such a task must not be applied.
    """
    a = sent.select(F.col("label_id").alias("_origin"), F.struct(*values).alias("_sent"), F.lit(True).alias("_was_sent"))
    b = returned.select(F.col("origin_label_id").alias("_origin"), F.struct(*values).alias("_back"), F.col("item_id"))
    both = a.join(b, "_origin", "full_outer")
    drawn = F.col("_was_sent").isNull()
    times = F.count(F.when(F.col("_back").isNotNull() & ~drawn, 1)).over(W.Window.partitionBy("_origin"))
    outcome = F.when(drawn, "added").when(F.col("_back").isNull(), "retracted").when(times > 1, "duplicate").when(F.col("_sent").eqNullSafe(F.col("_back")), "approved").otherwise("corrected")
    content = F.concat_ws("|", F.lit(reviewer), F.to_json(F.coalesce("_back", "_sent")), F.when(drawn, F.col("item_id").cast("string")).otherwise(""), F.col("_back").isNull().cast("string"))
    rows = both.withColumn("outcome", outcome)
    new = F.when(F.col("outcome").isin("added", "corrected", "retracted"), fitted_id(F.when(drawn, F.lit("new")).otherwise(F.col("_origin")), short_digest(content, 12)))
    return rows.select(F.when(~drawn, F.col("_origin")).alias("origin_label_id"), "item_id", "outcome", new.alias("label_id"))


def unforked(outcomes: DataFrame, records: DataFrame) -> DataFrame:
    """Outcomes whose origin nothing has corrected or retracted since it was sent."""
    children = records.where(F.col("parent_label_id").isNotNull()).select(F.col("parent_label_id").alias("origin_label_id")).distinct()
    return outcomes.join(children, "origin_label_id", "left_anti")


def verified_classes(records: DataFrame, value: str, states: Sequence[str] = REVIEWED) -> DataFrame:
    """Distinct values of records in force that review has passed: classes known to other sessions."""
    now = history.current(records, "label_id", "parent_label_id", F.col("retracted"), F.col("seeded_error"))
    return now.where((F.col("source") == "human") | F.col("state").isin(*states)).where(F.col(value).isNotNull()).select(value).distinct()


def counts(records: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Labels that nothing corrects, by ``keys``: a quick count, which doesn't follow descent from seeded records."""
    return history.current(records, "label_id", "parent_label_id", F.col("retracted")).where(~F.col("seeded_error")).groupBy(*keys).agg(F.count("*").alias("n"))


def verified_at(records: DataFrame) -> DataFrame:
    """``session_id`` and ``verified_at``: when review was done with each session, for sessions that have been reviewed whole.

    An item is a record in force, or a human's retraction; it was first reviewed at the earliest review
    on its chain, a human's record when it was made. The session is done at the latest of these,
    unless a model's record in force, not reviewed itself, was there by then.
    """
    banned = history.closure(records, records.where("seeded_error").select(F.col("label_id").alias("id")), "label_id", "parent_label_id")
    rows = records.join(banned.withColumnRenamed("id", "label_id"), "label_id", "left_anti")
    own = F.when(F.col("source") == "human", F.col("created_at")).when(F.col("state").isin(*REVIEWED), F.col("reviewed_at"))
    rows = rows.withColumn("own_review", own)
    first = earliest_on_chain(rows, "label_id", "parent_label_id", "own_review")
    now = history.current(rows, "label_id", "parent_label_id", F.col("retracted"))
    waits = (F.col("source") == "model") & F.col("own_review").isNull()
    items = now.where(~waits).select("label_id", "session_id").unionAll(rows.where((F.col("source") == "human") & F.col("retracted")).select("label_id", "session_id"))
    done = items.join(first, "label_id").groupBy("session_id").agg(F.max("earliest").alias("verified_at")).where("verified_at is not null")
    early = now.where(waits).groupBy("session_id").agg(F.min("created_at").alias("_waiting"))
    return done.join(early, "session_id", "left").where(F.col("_waiting").isNull() | (F.col("_waiting") > F.col("verified_at"))).select("session_id", "verified_at")


def earliest_on_chain(records: DataFrame, record_id: str, parent: str, value: str) -> DataFrame:
    """``label_id`` and ``earliest``, the least value on the way from a record to the start of its chain; by doubling, as roots are found."""
    from .settled import settled

    known = records.select(F.col(record_id).alias("up"), F.lit(True).alias("_known")).distinct()
    now = records.select(F.col(record_id).alias("label_id"), F.col(parent).alias("up"), F.col(value).alias("earliest")).join(known, "up", "left")
    now = settled(now.select("label_id", F.when(F.col("_known"), F.col("up")).alias("up"), "earliest"))
    for _ in range(now.count().bit_length() + 1):
        if now.where("up is not null").isEmpty():
            break
        above = now.select(F.col("label_id").alias("up"), F.col("up").alias("_up"), F.col("earliest").alias("_earlier"))
        now = settled(now.join(above, "up", "left").select("label_id", F.col("_up").alias("up"), F.least("earliest", "_earlier").alias("earliest")))
    return now.select("label_id", "earliest")


def protected_ancestors(records: DataFrame, incoming: DataFrame) -> DataFrame:
    """Ids of ``incoming`` records that have a protected ancestor: a model may not retract or replace them."""
    marked = records.where(protected()).select(F.col("label_id").alias("id"))
    under = history.closure(records, marked, "label_id", "parent_label_id")
    return incoming.join(under.withColumnRenamed("id", "parent_label_id"), "parent_label_id", "left_semi").select("label_id")


def relinked(records: DataFrame, renamed: DataFrame, column: str) -> DataFrame:
    """``column`` of each record rewritten by ``renamed`` (``old``, ``new``); ids that aren't renamed stay."""
    names = renamed.select(F.col("old").alias(column), F.col("new").alias("_new"))
    return records.join(names, column, "left").select(*(F.coalesce("_new", column).alias(c) if c == column else F.col(f"`{c}`") for c in records.columns))


def description_follow(descriptions: DataFrame, owners: DataFrame) -> DataFrame:
    """What becomes of each description in force when its owner changes: ``action`` keep, inherit, retract or orphan.

    ``owners`` are the owning labels' latest records: ``owner_id``, ``retracted``, ``state``. A human's description is kept. One whose owner is gone
    is an orphan; of a retracted owner it is retracted; a reviewed owner hands its review on to an unreviewed description.
    """
    rows = descriptions.join(owners.select("owner_id", F.col("retracted").alias("_gone"), F.col("state").alias("_state")), "owner_id", "left")
    action = F.when(F.col("source") == "human", "keep").when(F.col("_gone").isNull(), "orphan").when(F.col("_gone"), "retract")
    action = action.when((F.col("state") == "unreviewed") & F.col("_state").isin(*REVIEWED), "inherit").otherwise("keep")
    return rows.select("label_id", "owner_id", action.alias("action"), F.when(action == "inherit", F.col("_state")).alias("new_state"))


def trajectory_follow(trajectories: DataFrame, tracks: DataFrame) -> DataFrame:
    """What becomes of each 3-D trajectory derived from a 2-D track: ``action`` keep, inherit, lapse or supersede.

    ``tracks`` are the tracks' records: ``track_id``, ``version`` (grows), ``state``, ``retracted``. A trajectory of an older version of its track is
    superseded, of a retracted one it lapses; it takes over the review of the version it was made from.
    """
    latest = tracks.groupBy("track_id").agg(F.max_by(F.struct("version", "state", "retracted"), "version").alias("_last"))
    rows = trajectories.join(latest, "track_id", "left")
    action = F.when(F.col("_last").isNull() | F.col("_last.retracted"), "lapse").when(F.col("_last.version") > F.col("version"), "supersede")
    action = action.when((F.col("state") == "unreviewed") & F.col("_last.state").isin(*REVIEWED), "inherit").otherwise("keep")
    return rows.select("label_id", "track_id", action.alias("action"))


def dataset_counts(records: DataFrame, splits: DataFrame) -> DataFrame:
    """Labels of a dataset version by split, kind and state."""
    now = history.current(records, "label_id", "parent_label_id", F.col("retracted"), F.col("seeded_error"))
    return now.join(splits.select("session_id", "split"), "session_id").groupBy("split", "kind", "state").agg(F.count("*").alias("n"))


def lineage(sessions: DataFrame, golden: DataFrame, versions: DataFrame, runs: DataFrame, exports: DataFrame) -> DataFrame:
    """Where each session went: ``relation`` (golden, version, training, export) and ``target``.

    ``golden`` has ``golden_version`` and ``session_ids``; ``versions`` ``version_id``, ``session_id`` and ``split``; ``runs`` ``run_id`` and
    ``version_id``: a run used a session only where that was in train or val; ``exports`` ``export_id`` and ``session_ids``.
    """
    known = sessions.select("session_id").distinct()
    in_golden = golden.select(F.explode("session_ids").alias("session_id"), F.lit("golden").alias("relation"), F.col("golden_version").cast("string").alias("target"))
    in_version = versions.select("session_id", F.lit("version").alias("relation"), F.col("version_id").cast("string").alias("target"))
    used = versions.where(F.col("split").isin("train", "val")).join(runs, "version_id").select("session_id", F.lit("training").alias("relation"), F.col("run_id").cast("string").alias("target"))
    out = exports.select(F.explode("session_ids").alias("session_id"), F.lit("export").alias("relation"), F.col("export_id").cast("string").alias("target"))
    return in_golden.unionAll(in_version).unionAll(used).unionAll(out).distinct().join(known, "session_id", "left_semi")
