"""Every kind of label with a good and a bad payload."""

import json

import pytest
from pyspark.sql import functions as F

from weftline.operators import contracts

ENTRIES = [
    ("objects", "cup", None, []), ("objects", "knife", None, []), ("objects", "table", None, ["surface"]), ("tool_parts", "knife/blade", None, []), ("surface_parts", "edge", None, []), ("hand_joints", "wrist", None, []),
    ("parts", "blade", None, []), ("parts", "edge", None, []), ("parts", "wrist", None, []), ("privacy_targets", "face", None, []), ("contact_target_kinds", "object", None, []), ("body_parts", "arm", None, []), ("grasp_types", "pinch", None, []),
    ("hand_roles", "main", None, []), ("verbs", "wipe", "primitive", []), ("verbs", "point", "primitive", ["contactless"]), ("verbs", "clean", "skill", []), ("tasks", "dishes", None, []), ("tasks", "floor", None, []), ("substeps", "rinse", "dishes", []),
    ("gap_types", "idle", None, []), ("state_attributes", "fill", None, []), ("state_values", "fill/full", None, []), ("object_states", "cup/fill", None, []), ("events", "drop", "point", ["severity", "object"]), ("events", "pause", "interval", ["action"]),
]
POINTS = {"points": [{"x": 0, "y": 0}] * 21}
ROWS = [
    ("box_track", {"entity_id": "c1", "class_id": "cup", "keyframes": []}, []),
    ("box_track", {"entity_id": "c9", "class_id": "jug", "keyframes": []}, ["objects unknown"]),
    ("box_track", {"class_id": "cup", "keyframes": 3}, ["box_track/mask_track/keypoint_track/trajectory3d/object_state lacks entity_id", "box_track/mask_track/keypoint_track/blur_track has a wrong keyframes"]),
    ("mask_track", {"entity_id": "k1", "class_id": "knife", "part": "blade", "keyframes": []}, []),
    ("mask_track", {"entity_id": "c1", "class_id": "cup", "part": "blade", "keyframes": []}, ["tool_parts unknown"]),
    ("keypoint_track", {"entity_id": "h1", "skeleton": "hand21", "hand": "left", "keyframes": [POINTS]}, []),
    ("keypoint_track", {"entity_id": "h1", "skeleton": "arm3", "keyframes": [POINTS]}, ["keypoint_track lacks hand", "keypoint_track has wrong points"]),
    ("blur_track", {"target": "face", "keyframes": []}, []),
    ("blur_track", {"target": "shoe", "keyframes": []}, ["privacy_targets unknown"]),
    ("trajectory3d", {"entity_id": "k1", "part": "blade", "frame": "world", "samples": []}, []),
    ("trajectory3d", {"entity_id": "k1", "part": "edge", "frame": "moon", "samples": []}, ["trajectory3d has a wrong frame", "part of another entity"]),
    ("hand_state", {"hand": "left", "contact_target_kind": "object", "grasp_type": None, "role": "main"}, []),
    ("hand_state", {"hand": "left", "contact_target_kind": "object", "grasp_type": "fist", "body_part": "leg", "role": "main"}, ["grasp_types unknown", "body_parts unknown"]),
    ("action", {"action_id": "a", "hand": "left", "verb": "wipe", "t_approach_ms": 0, "t_contact_start_ms": 2, "t_end_ms": 5, "pre_state": {"fill": "full"}}, []),
    ("action", {"action_id": "a", "hand": "left", "verb": "point", "t_approach_ms": 9, "t_contact_start_ms": 2, "t_end_ms": 5, "pre_state": {"fill": "odd"}, "post_state": {"heat": "hot"}}, ["contactless verb with a contact", "action ends before it begins", "state_values unknown", "state_attributes unknown"]),
    ("action", {"action_id": "a", "hand": "left", "verb": "clean", "t_approach_ms": 0, "t_end_ms": 5}, ["primitive_verbs unknown"]),
    ("action", {"action_id": "a", "hand": "left", "verb": "fly", "t_approach_ms": 0, "t_end_ms": 5}, ["verbs unknown"]),
    ("segment", {"segment_id": "s1", "level": "task", "ref_id": "dishes", "child_ids": ["s2"]}, []),
    ("segment", {"segment_id": "s2", "level": "substep", "ref_id": "rinse"}, []),
    ("segment", {"segment_id": "s3", "level": "task", "ref_id": "floor", "child_ids": ["s2", "s9"]}, ["substep of another task"]),
    ("segment", {"segment_id": "s4", "level": "skill", "ref_id": "wipe"}, ["skill_verbs unknown"]),
    ("gap", {"gap_type": "idle"}, []),
    ("gap", {"gap_type": 5}, ["gap_types unknown"]),
    ("object_state", {"entity_id": "c1", "class_id": "cup", "attribute": "fill", "value": "full"}, []),
    ("object_state", {"entity_id": "t1", "class_id": "table", "attribute": "fill", "value": "half"}, ["object_states unknown", "state_values unknown"]),
    ("coverage", {"surface_id": "t1", "ratio": 0.5}, []),
    ("coverage", {"surface_id": "t1", "ratio": 1.5}, ["coverage beyond 0 to 1"]),
    ("event", {"event_type": "drop", "severity": 2, "related_entity_id": "c1"}, []),
    ("event", {"event_type": "drop"}, ["event lacks severity", "event lacks an object"]),
    ("event", {"event_type": "pause"}, ["event lacks an action"]),
    ("relation", {"subject_id": "h1", "predicate": "grasp", "object_id": "t1", "object_part": "edge"}, []),
    ("relation", {"subject_id": "c1", "subject_part": "blade", "predicate": "near", "object_id": "u", "object_part": "blade"}, ["relation has a wrong predicate", "part of another entity"]),
    ("description", {"segment_id": "s1", "text": "so", "language": "en"}, []),
    ("description", {"segment_id": "s1"}, ["description lacks text", "description lacks language"]),
    ("dance", {}, ["kind unknown"]),
]


@pytest.fixture(scope="module")
def tables(spark):
    rows = [(f"l{i:02d}", "one", k, "v1", 7, 7 if k == "event" else 9, json.dumps(p)) for i, (k, p, _) in enumerate(ROWS)]
    rows += [("late", "two", "gap", "v0", 0, 1, '{"gap_type": "idle"}'), ("long", "two", "event", "v1", 0, 1, '{"event_type": "drop", "severity": 1, "related_entity_id": "x"}'), ("null", "two", "gap", "v1", 0, 1, None)]
    labels = spark.createDataFrame(rows, "label_id string, session_id string, kind string, ontology_version string, t_start_ms long, t_end_ms long, payload string").withColumn("payload", F.parse_json("payload"))
    return labels, contracts.ontology_table(spark, ENTRIES)


def test_each_kind_has_its_faults(tables):
    got = {}
    for r in contracts.label_faults(*tables, "v1").collect():
        got.setdefault(r.label_id, set()).add(r.fault)
    want = {f"l{i:02d}": set(f) for i, (_, _, f) in enumerate(ROWS) if f}
    want |= {"late": {"ontology version"}, "long": {"point event with a length"}, "null": {"gap lacks gap_type"}}
    assert got == want


def test_episodes_list_their_entities(spark, tables):
    labels, ontology = tables
    entities = spark.createDataFrame([("one", "k1", "object", "table"), ("one", "h1", "hand", None), ("one", "zz", "object", "ghost")], "session_id string, entity_id string, kind string, class_id string")
    got = {(r.label_id, r.fault) for r in contracts.episode_faults(labels, entities, ontology, "v1").collect()}
    assert ("zz", "class unknown") in got
    parts = {i for i, f in got if f == "part of another entity"}
    names = [f"l{i:02d}" for i, (k, p, _) in enumerate(ROWS) if k == "trajectory3d" and p["part"] == "blade"]
    assert parts == set(names)


def test_no_labels_no_faults(tables):
    labels, ontology = tables
    assert contracts.label_faults(labels.limit(0), ontology, "v1").collect() == []
