"""Label payloads held against their kind's contract and against an ontology.

A payload is a VARIANT; :data:`FIELDS` says what each kind must or may have, and which of its fields name an
entry of an ontology's dictionary. The ontology is a table of entries, so that all names of all labels are
looked up in one join. Every check gives rows of one form, ``label_id`` and ``fault``, and a label may have several.

The ontology has ``dictionary`` and ``key``, and for some entries ``value`` (the level of a verb, the task of a substep, the form of
an event) and ``flags`` (contactless, severity, action, object, surface). Keys of two parts are joined by ``/``.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ENTRY = "dictionary string, key string, value string, flags array<string>"


@dataclass(frozen=True)
class Field:
    path: str
    kind: str
    required: bool = True
    dictionary: str | None = None
    one_of: tuple[str, ...] = ()


def _f(path: str, kind: str = "string", dictionary: str | None = None) -> Field:
    return Field(path.rstrip("?"), kind, not path.endswith("?"), dictionary)


#: Fixed values of the data model: the fields of each kind of payload.
FIELDS: dict[str, tuple[Field, ...]] = {
    "box_track": (_f("entity_id"), _f("class_id", dictionary="objects"), _f("keyframes", "array<variant>")),
    "mask_track": (_f("entity_id"), _f("class_id", dictionary="objects"), _f("part?"), _f("keyframes", "array<variant>")),
    "keypoint_track": (_f("entity_id"), Field("skeleton", "string", one_of=("hand21", "coco17", "wholebody133", "arm3")), _f("hand?"), _f("keyframes", "array<variant>")),
    "blur_track": (_f("target", dictionary="privacy_targets"), _f("keyframes", "array<variant>")),
    "trajectory3d": (_f("entity_id"), _f("part?", dictionary="parts"), Field("frame", "string", one_of=("camera", "body", "world")), _f("samples", "array<variant>")),
    "hand_state": (_f("hand"), _f("contact_target_kind", dictionary="contact_target_kinds"), _f("body_part?", dictionary="body_parts"), _f("grasp_type?", dictionary="grasp_types"), _f("role", dictionary="hand_roles")),
    "action": (_f("action_id"), _f("hand"), _f("verb", dictionary="verbs"), _f("target_body_part?", dictionary="body_parts"), _f("t_approach_ms", "bigint"), _f("t_contact_start_ms?", "bigint"), _f("t_end_ms", "bigint")),
    "segment": (_f("segment_id"), Field("level", "string", one_of=("skill", "substep", "task")), _f("ref_id")),
    "gap": (_f("gap_type", dictionary="gap_types"),),
    "object_state": (_f("entity_id"), _f("class_id", dictionary="objects"), _f("attribute", dictionary="state_attributes"), _f("value")),
    "coverage": (_f("surface_id"), _f("ratio", "double")),
    "event": (_f("event_type", dictionary="events"), _f("severity?", "bigint"), _f("related_action_id?"), _f("related_entity_id?")),
    "relation": (_f("subject_id"), _f("subject_part?", dictionary="parts"), Field("predicate", "string", one_of=("grasp", "contact", "support", "contain")), _f("object_id"), _f("object_part?", dictionary="parts")),
    "description": (_f("segment_id"), _f("text"), _f("language")),
}
#: Key points of each skeleton, and the skeletons that belong to a hand.
SKELETONS = {"hand21": 21, "coco17": 17, "wholebody133": 133, "arm3": 3}
HANDED = ("hand21", "arm3")


def ontology_table(spark: SparkSession, entries: Iterable[tuple[str, str, str | None, Sequence[str]]]) -> DataFrame:
    """An ontology from a configuration's entries. An object's tool parts are ``tool_parts`` entries ``class/part``, its attributes ``object_states`` entries ``class/attribute``, values ``state_values`` entries ``attribute/value``."""
    return spark.createDataFrame([(d, k, v, list(f)) for d, k, v, f in entries], ENTRY)


def got(path: str, kind: str = "string") -> Column:
    """A payload's field; null where it is missing or of another type."""
    return F.try_variant_get("payload", f"$.{path}", kind)


def of_kind(*kinds: str) -> Column:
    return F.col("kind").isin(*kinds)


def field_checks() -> dict[str, Column]:
    """Fields that are missing or of another type, or none of the values that they may have; a column that is true where the fault is."""
    out = {"kind unknown": ~of_kind(*FIELDS)}
    by_field: dict[Field, list[str]] = {}
    for kind, fields in FIELDS.items():
        for f in fields:
            by_field.setdefault(f, []).append(kind)
    for f, kinds in by_field.items():
        raw, value = got(f.path, "variant"), got(f.path, f.kind)
        there = raw.isNotNull() & ~F.coalesce(F.is_variant_null(raw), F.lit(True))
        name = "/".join(kinds)
        if f.required:
            out[f"{name} lacks {f.path}"] = of_kind(*kinds) & ~there
        out[f"{name} has a wrong {f.path}"] = of_kind(*kinds) & there & (value.isNull() if not f.one_of else ~F.coalesce(value.isin(*f.one_of), F.lit(False)))
    ratio, skeleton = got("ratio", "double"), got("skeleton")
    out["coverage beyond 0 to 1"] = of_kind("coverage") & ~ratio.between(0, 1)
    out["keypoint_track lacks hand"] = of_kind("keypoint_track") & skeleton.isin(*HANDED) & got("hand").isNull()
    size = F.coalesce(*(F.when(skeleton == k, n) for k, n in SKELETONS.items()))
    frames = F.transform(got("keyframes", "array<variant>"), lambda k: F.size(F.try_variant_get(k, "$.points", "array<variant>")))
    out["keypoint_track has wrong points"] = of_kind("keypoint_track") & F.exists(frames, lambda n: ~n.eqNullSafe(size))
    out["action ends before it begins"] = of_kind("action") & (got("t_end_ms", "bigint") < got("t_approach_ms", "bigint"))
    return out


def field_faults(labels: DataFrame, checks: Mapping[str, Column] | None = None) -> DataFrame:
    checks = field_checks() if checks is None else checks
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(False)), F.lit(n)) for n, c in checks.items())))
    return labels.select("label_id", F.explode(broken).alias("fault"))


def references(labels: DataFrame) -> DataFrame:
    """Names that must be in the ontology: ``label_id``, ``dictionary``, ``key``, the ``fault`` if it is not, and ``given``: an entry without which the question doesn't arise."""
    kind = "array<struct<dictionary:string,key:string,fault:string,given:string>>"

    def ref(when: Column, dictionary: str, key: Column, given: Column | None = None) -> Column:
        given = F.lit(None).cast("string") if given is None else given
        return F.when(when & key.isNotNull(), F.struct(F.lit(dictionary).alias("dictionary"), key.alias("key"), F.lit(f"{dictionary} unknown").alias("fault"), given.alias("given")))

    refs = [ref(of_kind(k), f.dictionary, got(f.path)) for k, fields in FIELDS.items() for f in fields if f.dictionary]
    level, class_id = got("level"), got("class_id")
    verb = F.concat(F.lit("verbs/"), got("verb"))
    refs += [
        ref(of_kind("mask_track"), "tool_parts", F.concat_ws("/", class_id, got("part")), F.when(got("part").isNull(), "never")),
        ref(of_kind("action"), "primitive_verbs", got("verb"), verb),
        ref(of_kind("segment") & (level == "skill"), "skill_verbs", got("ref_id")),
        ref(of_kind("segment") & (level == "task"), "tasks", got("ref_id")),
        ref(of_kind("segment") & (level == "substep"), "substeps", got("ref_id")),
        ref(of_kind("object_state"), "object_states", F.concat_ws("/", class_id, got("attribute")), F.concat(F.lit("objects/"), class_id)),
        ref(of_kind("object_state"), "state_values", F.concat_ws("/", got("attribute"), got("value")), F.concat(F.lit("state_attributes/"), got("attribute"))),
    ]
    lists = [F.array_compact(F.array(*refs)).cast(kind)]
    for path in ("pre_state", "post_state"):
        states = F.map_entries(F.coalesce(F.when(of_kind("action"), got(path, "map<string,string>")), F.create_map().cast("map<string,string>")))
        none = F.lit(None).cast("string")
        make = lambda d, k, g: F.struct(F.lit(d).alias("dictionary"), k.alias("key"), F.lit(f"{d} unknown").alias("fault"), g.alias("given"))
        lists.append(F.transform(states, lambda s: make("state_attributes", s["key"], none)).cast(kind))
        lists.append(F.transform(states, lambda s: make("state_values", F.concat_ws("/", s["key"], s["value"]), F.concat(F.lit("state_attributes/"), s["key"]))).cast(kind))
    return labels.select("label_id", F.explode(F.concat(*lists)).alias("_r")).select("label_id", "_r.*").where("given is null or given <> 'never'")


def with_levels(ontology: DataFrame) -> DataFrame:
    """The ontology and its verbs once more, as primitive ones and as skills."""
    verbs = ontology.where("dictionary = 'verbs'").withColumn("dictionary", F.when(F.col("value") == "primitive", "primitive_verbs").otherwise("skill_verbs"))
    return ontology.unionByName(verbs)


def reference_faults(labels: DataFrame, ontology: DataFrame) -> DataFrame:
    """Labels whose names the ontology lacks."""
    entries = with_levels(ontology).select("dictionary", "key").distinct()
    lost = references(labels).join(entries, ["dictionary", "key"], "left_anti")
    known = entries.select(F.concat_ws("/", "dictionary", "key").alias("given"))
    return lost.where("given is null").select("label_id", "fault").unionAll(lost.where("given is not null").join(known, "given", "left_semi").select("label_id", "fault"))


def rule_faults(labels: DataFrame, ontology: DataFrame, version: str) -> DataFrame:
    """Labels of another ontology version, contactless verbs with a contact, and events that lack what their type asks for."""
    rows = labels.withColumn("_key", F.when(of_kind("action"), F.concat(F.lit("verbs/"), got("verb"))).when(of_kind("event"), F.concat(F.lit("events/"), got("event_type"))))
    entries = ontology.where("dictionary in ('verbs', 'events')").select(F.concat_ws("/", "dictionary", "key").alias("_key"), F.col("value").alias("_value"), F.coalesce("flags", F.array().cast("array<string>")).alias("_flags"))
    has = lambda f: F.coalesce(F.array_contains("_flags", f), F.lit(False))
    checks = {
        "ontology version": ~F.col("ontology_version").eqNullSafe(F.lit(version)),
        "contactless verb with a contact": of_kind("action") & has("contactless") & got("t_contact_start_ms", "bigint").isNotNull(),
        "event lacks severity": of_kind("event") & has("severity") & got("severity", "bigint").isNull(),
        "event lacks an action": of_kind("event") & has("action") & got("related_action_id").isNull(),
        "event lacks an object": of_kind("event") & has("object") & got("related_entity_id").isNull(),
        "point event with a length": of_kind("event") & (F.col("_value") == "point") & (F.col("t_start_ms") != F.col("t_end_ms")),
    }
    return field_faults(rows.join(entries, "_key", "left"), checks)


def entity_classes(labels: DataFrame) -> DataFrame:
    """The class of each entity of a session that a box, mask or state names; of several the latest label's."""
    named = labels.where(of_kind("box_track", "mask_track", "object_state")).select("session_id", got("entity_id").alias("entity_id"), got("class_id").alias("class_id"), "label_id").where("entity_id is not null and class_id is not null")
    return named.groupBy("session_id", "entity_id").agg(F.max_by("class_id", "label_id").alias("class_id"))


def entity_part_faults(labels: DataFrame, classes: DataFrame, ontology: DataFrame, hands: DataFrame | None = None) -> DataFrame:
    """Parts that their entity hasn't: a tool's parts by its class, surfaces' also those of any surface, hands' joints. Entities of unknown class are no fault."""
    pair = lambda e, p: F.struct(got(e).alias("entity_id"), got(p).alias("part"))
    refs = F.when(of_kind("trajectory3d"), F.array(pair("entity_id", "part"))).when(of_kind("relation"), F.array(pair("subject_id", "subject_part"), pair("object_id", "object_part")))
    rows = labels.select("label_id", "session_id", F.explode(refs).alias("_p")).select("label_id", "session_id", "_p.*").where("part is not null and entity_id is not null")
    if hands is not None:
        rows = rows.join(hands.select("session_id", "entity_id", F.lit(True).alias("_hand")), ["session_id", "entity_id"], "left")
    else:
        rows = rows.withColumn("_hand", F.lit(None).cast("boolean"))
    rows = rows.join(classes, ["session_id", "entity_id"], "left").where("_hand or class_id is not null")
    entries = ontology.select("dictionary", "key", "flags")
    surfaces = entries.where("dictionary = 'objects' and array_contains(flags, 'surface')").select(F.col("key").alias("class_id"), F.lit(True).alias("_surface"))
    own = F.when(F.col("_hand"), F.concat(F.lit("hand_joints/"), F.col("part"))).otherwise(F.concat_ws("/", F.lit("tool_parts"), "class_id", "part"))
    rows = rows.join(surfaces, "class_id", "left").withColumn("_own", own).withColumn("_any", F.when(F.col("_surface") & F.col("_hand").isNull(), F.concat(F.lit("surface_parts/"), F.col("part"))))
    names = entries.where("dictionary in ('hand_joints', 'tool_parts', 'surface_parts')").select(F.concat_ws("/", "dictionary", "key").alias("_k")).distinct()
    left = rows.join(names, F.col("_own") == F.col("_k"), "left_anti").join(names.withColumnRenamed("_k", "_k2"), F.col("_any") == F.col("_k2"), "left_anti")
    return left.select("label_id", F.lit("part of another entity").alias("fault"))


def substep_faults(labels: DataFrame, ontology: DataFrame) -> DataFrame:
    """Task segments with a child that is a substep of another task."""
    segments = labels.where(of_kind("segment")).select("label_id", "session_id", got("segment_id").alias("segment_id"), got("level").alias("level"), got("ref_id").alias("ref_id"), got("child_ids", "array<string>").alias("child_ids"))
    children = segments.where("level = 'task'").select("label_id", "session_id", F.col("ref_id").alias("task"), F.explode("child_ids").alias("segment_id"))
    steps = segments.where("level = 'substep'").select("session_id", "segment_id", F.col("ref_id").alias("key"))
    of = ontology.where("dictionary = 'substeps'").select("key", F.col("value").alias("of_task"))
    met = children.join(steps, ["session_id", "segment_id"]).join(of, "key", "left").where(~F.col("of_task").eqNullSafe(F.col("task")))
    return met.select("label_id", F.lit("substep of another task").alias("fault"))


def label_faults(labels: DataFrame, ontology: DataFrame, version: str, classes: DataFrame | None = None, hands: DataFrame | None = None) -> DataFrame:
    """All faults of labels (``label_id``, ``session_id``, ``kind``, ``ontology_version``, ``t_start_ms``, ``t_end_ms``, ``payload``), a row each."""
    classes = entity_classes(labels) if classes is None else classes
    parts = (field_faults(labels), reference_faults(labels, ontology), rule_faults(labels, ontology, version), entity_part_faults(labels, classes, ontology, hands), substep_faults(labels, ontology))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()


def episode_faults(labels: DataFrame, entities: DataFrame, ontology: DataFrame, version: str) -> DataFrame:
    """Faults of labels whose entities are listed (``session_id``, ``entity_id``, ``kind``, ``class_id``); listed classes that the ontology lacks stand with the entity in place of a label."""
    objects = ontology.where("dictionary = 'objects'").select(F.col("key").alias("class_id"))
    unknown = entities.where("class_id is not null").join(objects, "class_id", "left_anti").select(F.col("entity_id").alias("label_id"), F.lit("class unknown").alias("fault"))
    classes, hands = entities.where("class_id is not null").select("session_id", "entity_id", "class_id"), entities.where("kind = 'hand'").select("session_id", "entity_id")
    return label_faults(labels, ontology, version, classes, hands).unionByName(unknown)
