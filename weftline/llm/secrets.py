"""Secret scans by a trigram index, in DataFrame functions alone.

Each rule's regular expression gives a Boolean query over trigrams: an OR of ANDs of
trigrams that every match holds. Documents are posted under the queries' trigrams, the
postings of a clause are intersected by counting, and the documents left are verified
with the regular expression. Rules without mandatory trigrams scan all documents.

Positions are code points, ends exclusive. Matches of a kind are leftmost and don't
overlap; those whose measured group is too short are dropped after matching. Null texts
count as empty. Repeated ids share postings, which only adds candidates, and rows without an id
are all candidates; each row is verified by itself. Very long texts are searched whole. An empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MOST_SENT, staged

#: Clauses of a query, and trigrams of a clause: a few of them tell nearly as much as all.
MOST_CLAUSES, MOST_TRIGRAMS = 64, 4


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


BASE_RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]{16,}"),
)
MORE_RULES = (
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
)
RULES = BASE_RULES + MORE_RULES


def _crossed(heads: set[str], tails: set[str]) -> set[str] | None:
    return {a + b for a in heads for b in tails} if len(heads) * len(tails) <= MOST_CLAUSES else None


def _exact(nodes) -> set[str] | None:
    """All texts that the nodes match, in lower case, if these are few; else None."""
    texts = {""}
    for kind, arg in nodes:
        kind = str(kind)
        if kind == "LITERAL":
            more = {chr(arg).lower()}
        elif kind == "IN" and all(str(k) == "LITERAL" for k, _ in arg):
            more = {chr(c).lower() for _, c in arg}
        elif kind == "SUBPATTERN":
            more = _exact(arg[3])
        elif kind == "BRANCH":
            parts = [_exact(x) for x in arg[1]]
            more = None if None in parts else set().union(*parts)
        elif kind == "MAX_REPEAT" and arg[1] == 1:
            more = _exact(arg[2])
            more = more and (more | {""} if arg[0] == 0 else more)
        else:
            more = None
        if more is None or (texts := _crossed(texts, more)) is None:
            return None
    return texts


def trigram_query(pattern: str) -> list[frozenset[str]]:
    """Clauses of trigrams, in lower case; each match of the pattern holds all trigrams of some clause. No clause: no trigram is mandatory."""
    clauses: list[frozenset[str]] = [frozenset()]
    run: set[str] = {""}

    def close() -> None:
        nonlocal clauses, run
        options = {frozenset(t[i : i + 3] for i in range(len(t) - 2)) for t in run}
        wider = {c | o for c in clauses for o in options}
        if len(wider) <= MOST_CLAUSES:
            clauses = [c for c in wider if not any(o < c for o in wider)]
        run = {""}

    for node in _parser.parse(pattern):
        texts = _exact([node])
        longer = texts and _crossed(run, texts)
        if longer:
            run = longer
            continue
        close()
        if texts:
            run = texts
    close()
    return [] if frozenset() in clauses else sorted(clauses, key=sorted)


def candidates(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id`` and, as bits, the ``rules`` whose trigram query the document meets; documents that meet none are left out."""
    spark = docs.sparkSession
    queries = {i: [sorted(c)[:: max(1, -(-len(c) // MOST_TRIGRAMS))] for c in trigram_query(r.pattern)] for i, r in enumerate(rules)}
    clauses = [(1 << i, k, t, len(c)) for i, q in queries.items() for k, c in enumerate(q) for t in c]
    grams = sorted({t for _, _, t, _ in clauses})
    named = [dict(zip(("bit", "clause", "trigram", "size"), c, strict=True)) for c in clauses]
    asked = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(named)), "array<struct<bit:int,clause:int,trigram:string,size:int>>")))
    # The text is put in lower case once, as the start of a fold over the trigrams.
    start = F.struct(F.lower("text").alias("low"), F.array().cast("array<string>").alias("found"))
    step = lambda acc, t: F.struct(acc["low"].alias("low"), F.when(F.contains(acc["low"], t), F.array_append(acc["found"], t)).otherwise(acc["found"]).alias("found"))
    found = F.aggregate(F.split(F.lit("\n".join(grams)), "\n"), start, step, lambda acc: acc["found"])
    postings = docs.where("text is not null").select("doc_id", F.explode(found).alias("trigram"))
    # The clauses are fixed by the rules, a few hundred rows at most.
    met = postings.distinct().join(F.broadcast(asked), "trigram").groupBy("doc_id", "bit", "clause", "size").count().where("count = size")
    return met.groupBy("doc_id").agg(F.bit_or("bit").alias("rules"))


def _spans(text: Column, rule: Rule) -> Column:
    """Spans of a rule's matches in code points: what lies between matches gives the distance from one to the next."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    measured = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(found))
    pieces = F.zip_with(F.zip_with(between, found, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"))), measured, lambda p, g: F.struct(p["gap"].alias("gap"), p["size"].alias("size"), F.length(g).alias("measure")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,measure:int>>").alias("spans"))

    def step(acc: Column, p: Column) -> Column:
        begin = acc["at"] + p["gap"]
        span = F.struct(begin.alias("start"), (begin + p["size"]).alias("end"), p["measure"].alias("measure"))
        return F.struct((begin + p["size"]).alias("at"), F.array_append(acc["spans"], span).alias("spans"))

    all_spans = F.aggregate(pieces, start, step, lambda acc: acc["spans"])
    return F.filter(all_spans, lambda s: s["measure"] >= rule.least)


def _tagged(place: int, kind: str):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(place).alias("place"), F.lit(kind).alias("kind"), s["end"].alias("end"))


def scanned(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs``, which has no columns named ``_id`` or ``_rules``, with ``secret_spans``: structs of start, place of the kind in ``rules``, kind and end, in that order."""
    must = [bool(trigram_query(r.pattern)) for r in rules]
    named = docs.where("doc_id is not null")
    found = staged(candidates(named, rules).select(F.col("doc_id").alias("_id"), F.col("rules").alias("_rules")), "candidates")
    # Few enough, they go to the documents, and no text is shuffled; else both meet by a shuffle.
    found = F.broadcast(found) if found.count() <= MOST_SENT else found
    # Rows without an id can't be looked up: they are verified for every rule, where they lie.
    rest = docs.where("doc_id is null").withColumn("_rules", F.lit((1 << len(rules)) - 1).cast("int"))
    rows = named.join(found, named["doc_id"] == found["_id"], "left").drop("_id").unionByName(rest)
    text = F.coalesce(F.col("text"), F.lit(""))
    parts = []
    nothing = F.array().cast("array<struct<start:int,place:int,kind:string,end:int>>")
    for i, r in enumerate(rules):
        asked = F.col("_rules").bitwiseAND(F.lit(1 << i)) != 0 if must[i] else F.lit(True)
        spans = F.transform(_spans(text, r), _tagged(i, r.kind))
        parts.append(F.when(asked & F.rlike(text, F.lit(r.pattern)), spans).otherwise(nothing))
    return rows.withColumn("secret_spans", F.array_sort(F.concat(*parts))).drop("_rules")


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def secret_digests(docs: DataFrame) -> DataFrame:
    """One row per document: matches of each base kind, a digest of the base spans, and all spans."""
    rows = scanned(docs.select("doc_id", "text")).select("doc_id", "secret_spans")
    number = lambda k: F.size(F.filter("secret_spans", lambda s: s["kind"] == k)).cast("long")
    base = F.filter("secret_spans", lambda s: s["place"] < len(BASE_RULES))
    return rows.select("doc_id", *(number(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES), F.sha2(_joined(base).cast("binary"), 256).alias("base_sha256"), _joined(F.col("secret_spans")).alias("spans"))


def redacted(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, same columns, with each secret in ``text`` replaced by ``[kind]``; overlapping secrets become one. Null texts stay null."""
    text = F.col("text")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        apart = s["start"] >= acc["at"]
        head = F.substr(text, acc["at"] + 1, s["start"] - acc["at"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(apart, F.concat(acc["out"], head, F.lit("["), s["kind"], F.lit("]"))).otherwise(acc["out"]).alias("out"))

    clean = F.aggregate(F.col("secret_spans"), start, step, lambda acc: F.concat(acc["out"], F.substr(text, acc["at"] + 1, F.length(text))))
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    packed = docs.select("doc_id", "text", *([F.struct(*(F.col(f"`{c}`") for c in rest)).alias("_rest")] if rest else []))
    cleaned = F.when(F.size("secret_spans") > 0, clean).otherwise(text)
    return scanned(packed, rules).select(*(cleaned.alias(c) if c == "text" else F.col(c) if c == "doc_id" else F.col(f"_rest.`{c}`") for c in docs.columns))
