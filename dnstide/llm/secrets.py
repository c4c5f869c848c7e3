"""Secret scan with a trigram inverted index, in DataFrame functions alone.

From each rule's regular expression a Boolean query over trigrams is derived: what every match must contain. The
postings (trigram, document) of the trigrams asked for are a written table; they are intersected rule by rule, without
a text, and only then the texts of the documents that a rule is left with are read and its expression run on them.
Rules without mandatory trigrams run on every text where it is read first.
"""

from __future__ import annotations

import re._constants as sre
import re._parser as sre_parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dnstide.llm.shared import ascii_lower, settle, spread


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern``, leftmost and not overlapping; those whose ``group`` has under ``least`` characters go."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: Fixed patterns; the first three are the base kinds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("github", r"gh[oprsu]_[A-Za-z0-9]{36,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]+"),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}"),
)
BASE = 3
#: Strings that a stretch of a pattern may stand for before it is left open.
MOST = 32
#: Steps added up in one go by running().
CHUNK = 256

#: A query: clauses that all hold; a clause: sets of trigrams of which one is all there.
Query = list[frozenset[frozenset[str]]]


def trigram_query(pattern: str) -> Query:
    """What each match of ``pattern`` contains, A-Z lower-cased; empty if nothing is sure."""
    clauses: Query = []

    def close(strings: set[str] | None) -> None:
        sets = {frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings or ()}
        if sets and all(sets):
            clauses.append(frozenset(x for x in sets if not any(y < x for y in sets)))

    def walk(nodes, strings: set[str]) -> set[str]:
        for op, arg in nodes:
            more = exact(op, arg)
            if more is not None and len(strings) * len(more) <= MOST:
                strings = {a + b for a in strings for b in more}
                continue
            close(strings)
            if op is sre.SUBPATTERN:
                strings = walk(arg[3], {""})
            elif op is sre.MAX_REPEAT and arg[0] >= 1:
                close(walk(arg[2], {""}))
                strings = {""}
            else:
                strings = more if more is not None else {""}
        return strings

    close(walk(sre_parser.parse(pattern), {""}))
    return clauses


def exact(op, arg) -> set[str] | None:
    """All strings that a node matches, if they are few."""
    if op is sre.LITERAL:
        return {chr(arg).lower()}
    if op is sre.IN and all(kind is sre.LITERAL for kind, _ in arg):
        return {chr(c).lower() for _, c in arg}
    if op is sre.SUBPATTERN:
        return _exact_run(arg[3])
    if op is sre.BRANCH:
        parts = [_exact_run(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op is sre.MAX_REPEAT and arg[1] is not sre.MAXREPEAT and arg[1] <= 4:
        one = _exact_run(arg[2])
        if one is not None and sum(len(one) ** n for n in range(arg[0], arg[1] + 1)) <= MOST:
            runs = [{""}]
            for _ in range(arg[1]):
                runs.append({a + b for a in runs[-1] for b in one})
            return set().union(*runs[arg[0] :])
    return None


def _exact_run(nodes) -> set[str] | None:
    out = {""}
    for op, arg in nodes:
        more = exact(op, arg)
        if more is None or len(out) * len(more) > MOST:
            return None
        out = {a + b for a in out for b in more}
    return out


def _keyed(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.xxhash64(text).alias("text_hash"), text.alias("text"))


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """The inverted index ``(trigram, doc_id, text_hash)`` of the trigrams given, by their numbers: a row for each text
    that has one."""
    low = _keyed(docs).select("doc_id", "text_hash", ascii_lower(F.col("text")).alias("low"))
    held = F.filter(F.array(*(F.when(F.contains("low", F.lit(t)), i) for i, t in enumerate(trigrams))), lambda x: x.isNotNull())
    return low.select(F.explode(held).alias("trigram"), "doc_id", "text_hash")


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``(doc_id, text_hash, rules array<int>)``: numbers of the rules with mandatory trigrams whose query a text meets.

    A rule's clauses all hold, a clause holds by one of its sets of trigrams, a set by all its postings; each is an
    intersection or union of postings, and one shuffle by document serves all.
    """
    asked = {i: q for i, r in enumerate(rules) if (q := trigram_query(r.pattern))}
    names = sorted({t for q in asked.values() for clause in q for terms in clause for t in terms})
    number = {t: i for i, t in enumerate(names)}
    terms = [(number[t], i, c, s, len(own)) for i, q in asked.items() for c, clause in enumerate(q) for s, own in enumerate(sorted(clause, key=sorted)) for t in own]
    spark = docs.sparkSession
    plan = spark.createDataFrame(terms, "trigram int, rule int, clause int, terms int, size int")
    clauses = spark.createDataFrame([(i, len(q)) for i, q in asked.items()], "rule int, clauses int")
    index = settle(postings(docs, names)).repartition("doc_id", "text_hash")
    key = ["doc_id", "text_hash"]
    met = index.distinct().join(F.broadcast(plan), "trigram").groupBy(*key, "rule", "clause", "terms", "size").count().where("count = size")
    held = met.select(*key, "rule", "clause").distinct().groupBy(*key, "rule").agg(F.count("*").alias("n"))
    return held.join(F.broadcast(clauses), "rule").where("n = clauses").groupBy(*key).agg(F.collect_set("rule").alias("rules"))


def running(steps: Column) -> Column:
    """Running totals of an array of numbers, in chunks, so that long arrays stay cheap."""

    def totals(values: Column, start: Column) -> Column:
        last = lambda acc: F.coalesce(F.try_element_at(acc, F.lit(-1)), start)
        return F.aggregate(values, F.array().cast("array<bigint>"), lambda acc, x: F.concat(acc, F.array(last(acc) + x)))

    zero = F.lit(0).cast("bigint")
    chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / CHUNK).cast("int")), lambda i: F.slice(steps, i * CHUNK + 1, CHUNK))
    sums = F.transform(chunks, lambda c: F.aggregate(c, zero, lambda a, x: a + x))
    before = F.concat(F.array(zero), totals(sums, zero))
    return F.flatten(F.transform(chunks, lambda c, i: totals(c, F.get(before, i))))


def _spans(rows: DataFrame, rules: tuple[Rule, ...], run: dict[int, Column]) -> DataFrame:
    """``(doc_id, text_hash, spans)`` of ``rows(doc_id, text_hash, text)``: the matches of the rules with these numbers,
    each where its column holds."""
    none = F.array().cast("array<string>")
    key = ["doc_id", "text_hash"]
    rows = rows.select(*key, "text", *(F.when(on, F.regexp_extract_all("text", F.lit(rules[i].pattern), F.lit(0))).otherwise(none).alias(f"m{i}") for i, on in run.items()))
    rows = rows.select(
        *key,
        *(f"m{i}" for i in run),
        *(F.when(F.size(f"m{i}") > 0, F.split("text", rules[i].pattern)).otherwise(none).alias(f"g{i}") for i in run),
        *(F.when(F.size(f"m{i}") > 0, F.regexp_extract_all("text", F.lit(rules[i].pattern), F.lit(rules[i].group))).otherwise(none).alias(f"x{i}") for i in run if rules[i].group),
    )
    size = lambda c: F.char_length(c).cast("bigint")

    def step(i: int) -> Column:
        return F.transform(F.col(f"m{i}"), lambda _, k: size(F.get(f"g{i}", k)) + F.when(k > 0, size(F.get(f"m{i}", k - 1))).otherwise(0))

    rows = rows.select("*", *(F.when(F.size(f"m{i}") > 0, running(step(i))).otherwise(F.array().cast("array<bigint>")).alias(f"s{i}") for i in run))

    def spans(i: int) -> Column:
        r = rules[i]
        all_of = F.transform(
            F.col(f"s{i}"),
            lambda s, k: F.struct(s.alias("start"), F.lit(i).alias("rule"), (s + size(F.get(f"m{i}", k))).alias("end"), (F.char_length(F.get(f"x{i}" if r.group else f"m{i}", k)) >= r.least).alias("good")),
        )
        return F.transform(F.filter(all_of, lambda x: x["good"]), lambda x: F.struct(x["start"].alias("start"), x["rule"].alias("rule"), x["end"].alias("end")))

    return rows.select(*key, F.concat(*map(spans, run)).alias("spans"))


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``(doc_id, spans array<struct<start, rule, end>>)`` for each row of ``docs(doc_id, text, ...)``: all matches of
    all rules by start, then rule number; positions in code points, ends exclusive.

    A null or empty text has none. Spans of different rules may overlap; of one rule the leftmost comes first. Rows that
    repeat a doc_id are each scanned; a null doc_id is a document like any other. Long texts are scanned whole. Extra
    columns aren't read, whatever their names. An empty table gives an empty one.
    """
    rows, key = _keyed(docs), ["doc_id", "text_hash"]
    indexed = [i for i, r in enumerate(rules) if trigram_query(r.pattern)]
    found = []
    if len(indexed) < len(rules):
        found.append(_spans(rows, rules, {i: F.lit(True) for i in range(len(rules)) if i not in indexed}))
    if indexed:
        left = settle(candidates(docs, rules)).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
        read = rows.join(left, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")))
        found.append(_spans(read, rules, {i: F.array_contains("rules", i) for i in indexed}))
    # no filter before this: it would be pushed down to the texts and take the expressions along, place by place
    spans = reduce(DataFrame.union, found).groupBy(*key).agg(F.flatten(F.collect_set("spans")).alias("spans")).where(F.size("spans") > 0)
    spans = settle(spans).withColumnsRenamed({"doc_id": "found_id", "text_hash": "found_hash"})
    joined = rows.select(*key).join(spread(spans), F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("text_hash") == F.col("found_hash")), "left")
    none = F.array().cast("array<struct<start:bigint,rule:int,end:bigint>>")
    return joined.select("doc_id", F.sort_array(F.coalesce("spans", none)).alias("spans"))


def spelled(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """``kind:start:end``, comma-joined."""
    kinds = F.array(*(F.lit(r.kind) for r in rules))
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.get(kinds, x["rule"]), x["start"], x["end"])), ",")
