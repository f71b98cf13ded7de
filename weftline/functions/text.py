"""Strings: parts of keys and addresses, templates, glossaries, guards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def path_part(key: Column, prefix: str) -> Column:
    """The part of an object key after ``prefix/``, null if the key is elsewhere."""
    found = F.regexp_extract(key, f"^{prefix}/([^/]+)/", 1)
    return F.when(found != "", found)


def host_of(uri: Column) -> Column:
    """Bucket or host of an address with a scheme, else null."""
    found = F.regexp_extract(uri, "^[a-z0-9+.-]+://([^/]+)", 1)
    return F.when(found != "", found)


def family(version: Column) -> Column:
    """First token of a version name."""
    return F.split(version, "-")[0]


def class_of(entity: Column) -> Column:
    """Class of an entity id: without the prefix ``ov_`` and a final number."""
    return F.regexp_replace(F.regexp_replace(entity, "^ov_", ""), r"_\d+$", "")


def filled(template: str, fields: Mapping[str, Column]) -> Column:
    """A template with ``{name}`` filled in; null if any field it names is null."""
    out, rest = [], template
    while "{" in rest:
        head, _, tail = rest.partition("{")
        name, _, rest = tail.partition("}")
        out += [F.lit(head), fields[name].cast("string")]
    return F.concat(*out, F.lit(rest))


def with_terms(text: Column, glossary: Mapping[str, str]) -> Column:
    """Terms replaced, longest first, equal lengths in order of the alphabet."""
    for term in sorted(glossary, key=lambda t: (-len(t), t)):
        text = F.replace(text, F.lit(term), F.lit(glossary[term]))
    return text


def guarded(text: Column, longest: int, instead: str) -> tuple[Column, Column]:
    """The text, or ``instead`` where it holds an address, ``@``, four digits in a row, or is too long; and whether it was replaced."""
    bad = F.coalesce(F.rlike(text, F.lit(r"https?://|@|\d{4}")) | (F.length(text) > longest), F.lit(False))
    return F.when(bad, F.lit(instead)).otherwise(text), bad


def glossary_terms(text: Column, terms: Sequence[str], mode: str = "contains") -> Column:
    """Terms of a glossary that occur in the text, in order; ``mode`` word asks for whole words."""
    hit = (lambda t: F.contains(text, t)) if mode == "contains" else (lambda t: F.contains(F.concat(F.lit(" "), F.regexp_replace(text, r"[^\p{L}\p{N}]+", " "), F.lit(" ")), F.concat(F.lit(" "), t, F.lit(" "))))
    return F.filter(F.array(*map(F.lit, terms)), hit)


def reply_faults(raw: Column, field: str, most: int, forbidden: str | None = None) -> tuple[Column, Column]:
    """``field`` of a JSON reply, null if the reply is no good, and why not: ``json``, ``missing``, ``long``, ``script`` (holds what ``forbidden``, a pattern, matches)."""
    whole, value = F.try_parse_json(raw), F.get_json_object(raw, f"$.{field}")
    bad_script = F.rlike(value, F.lit(forbidden)) if forbidden else F.lit(False)
    faults = F.array_compact(F.array(
        F.when(raw.isNull() | whole.isNull(), "json"), F.when(whole.isNotNull() & (value.isNull() | (F.trim(value) == "")), "missing"),
        F.when(F.length(value) > most, "long"), F.when(F.coalesce(bad_script, F.lit(False)), "script"),
    ))
    return F.when(F.size(faults) == 0, value), faults


def closed_answer(raw: Column, vocabulary: Mapping[str, Sequence[str]]) -> tuple[Column, Column]:
    """Fields of a JSON answer as a map, and the names of those that are missing or not in their vocabulary."""
    got = {k: F.get_json_object(raw, f"$.{k}") for k in vocabulary}
    wrong = F.array_compact(F.array(*(F.when(~F.coalesce(got[k].isin(*v), F.lit(False)), F.lit(k)) for k, v in vocabulary.items())))
    return F.create_map(*(x for k in vocabulary for x in (F.lit(k), got[k]))), wrong


def redacted(text: Column, names: Sequence[str]) -> Column:
    """``name=value`` and ``name: value`` of secret names with the value starred, and passwords inside addresses."""
    keyed = F.regexp_replace(text, r"(?i)\b(" + "|".join(names) + r")(\s*[=:]\s*)\S+", "$1$2***")
    return F.regexp_replace(keyed, r"(://[^/\s:@]+:)[^/\s@]+@", "$1***@")


def model_of(version: Column) -> Column:
    """The model's name in a version ``name@digest+settings``."""
    found = F.regexp_extract(version, r"^([^@+]+)", 1)
    return F.when(found != "", found)


def natural_key(name: Column, width: int = 12) -> Column:
    """Sorts ``a2`` before ``a10``: every number is padded with zeros."""
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda p: F.when(F.rlike(p, F.lit(r"^\d+$")), F.lpad(p, width, "0")).otherwise(p)), "")
