"""Secret scans by a trigram inverted index, in DataFrame functions only.

Each rule's regex gives a Boolean query, derived from its parse tree: any of several
clauses, each a set of trigrams that a match must hold. Only trigrams that queries
name are indexed.
Postings are lists of row keys by (trigram, block of rows), so a trigram that most
documents hold is still many bounded rows. Clauses intersect their postings within
a block, and the candidates of a rule are the union of its clauses. Rules without a
mandatory trigram scan every text. Candidates are verified with the full regex.

The kinds after the first three are added rules. Spans are half-open, in code
points, of leftmost non-overlapping matches of each kind.

Defined cases: null is the empty text and has no span; repeated rows and ids each
get their own result row; extra columns are ignored; an empty table gives none; a
very long text with very many matches takes time near their number.
"""

from __future__ import annotations

from re import _parser as re_parser
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

from .common import ready


class Rule(NamedTuple):
    kind: str
    pattern: str
    #: A match counts if this group has so many characters at least.
    group: int = 0
    least: int = 0


#: The patterns and lengths of the base kinds, then the added kinds.
RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]{16,}"),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("pem", r"-----BEGIN [A-Z ]{0,40}PRIVATE KEY-----"),
    Rule("repo", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
BASE_KINDS = 3
_EXPAND = 8


def _walk(parts, states: list[tuple[frozenset, str]]) -> list[tuple[frozenset, str]]:
    """The ways through a regex's parse tree, each with its finished literal runs and the open one."""
    for op, arg in parts:
        name = str(op)
        if name == "LITERAL":
            states = [(done, run + chr(arg).lower()) for done, run in states]
        elif name == "SUBPATTERN":
            states = _walk(arg[-1], states)
        elif name == "BRANCH":
            states = [s for way in arg[1] for s in _walk(way, states)]
        elif name == "IN" and len(arg) <= _EXPAND and all(str(o) == "LITERAL" for o, _ in arg):
            states = [(done, run + chr(c).lower()) for done, run in states for _, c in arg]
        elif name == "MAX_REPEAT" and arg[1] == 1 and [str(o) for o, _ in arg[2]] == ["LITERAL"]:
            states = states + _walk(arg[2], states)
        else:
            states = [(done | {run}, "") for done, run in states]
        states = list(dict.fromkeys(states))
    return states


def query(rule: Rule) -> list[list[str]]:
    """The regex as a Boolean query: clauses of trigrams, of which a match's text holds all of one at least.

    Empty where some way through the regex needs no trigram; such a rule scans fully.
    """
    clauses = []
    for done, run in _walk(re_parser.parse(rule.pattern), [(frozenset(), "")]):
        clauses.append(sorted({x[i : i + 3] for x in (*done, run) for i in range(len(x) - 2)}))
    return [list(c) for c in dict.fromkeys(map(tuple, clauses))] if all(clauses) else []


def postings(docs: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """(block, trigram, keys) for the named trigrams."""
    low = docs.select("key", F.pmod("key", F.lit(blocks)).alias("block"), F.lower("text").alias("low"))
    held = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select("key", "block", F.explode(held).alias("trigram")).groupBy("block", "trigram").agg(F.collect_set("key").alias("keys"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...], blocks: int) -> DataFrame:
    """(key, kinds) of the rows that rules with trigrams may match."""
    clauses = [(r.kind, i, c) for r in rules for i, c in enumerate(query(r))]
    index = postings(docs, sorted({t for _, _, c in clauses for t in c}), blocks)
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("p"))
    none = F.array().cast("array<bigint>")

    def meet(clause: list[str]) -> Column:
        out = F.coalesce(F.col("p")[clause[0]], none)
        for t in clause[1:]:
            out = F.array_intersect(out, F.coalesce(F.col("p")[t], none))
        return out

    found = F.array(*[F.struct(F.lit(kind).alias("kind"), meet(c).alias("keys")) for kind, _, c in clauses])
    rows = by_block.select(F.explode(found).alias("f")).select("f.kind", F.explode("f.keys").alias("key"))
    return rows.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def steps(rule: Rule, text: Column) -> Column:
    """array<struct<g, w, c>> of the matches: the characters before each, in it, and in its counted group."""
    whole = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    counted = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else whole
    gaps = F.split(text, rule.pattern, -1)
    sizes = F.zip_with(whole, counted, lambda w, c: F.struct(F.length(w).alias("w"), F.length(c).alias("c")))
    return F.zip_with(F.slice(gaps, F.lit(1), F.size(whole)), sizes, lambda g, m: F.struct(F.length(g).alias("g"), m.w.alias("w"), m.c.alias("c")))


def spans(rule: Rule, found: Column) -> Column:
    """array<struct<start, order, end>> of the matches that count, from `steps`.

    Offsets are sums of lengths, taken in blocks of the root of the number of
    matches: what a block copies is its own, so long texts with very many matches
    cost m to the power of 1.5 at most.
    """
    order = next(i for i, r in enumerate(RULES) if r.kind == rule.kind)
    width = F.ceil(F.sqrt(F.size(found))).cast("int")
    none = F.array().cast("array<array<struct<g:int,w:int,c:int>>>")
    blocks = F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / width).cast("int")), lambda b: F.slice(found, b * width + 1, width))).otherwise(none)
    first = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

    def base(acc, block):
        after = acc.at + F.aggregate(block, F.lit(0), lambda at, x: at + x.g + x.w)
        return F.struct(after.alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))

    def inside(block, at):
        empty = F.array().cast("array<struct<start:int,order:int,end:int,c:int>>")

        def step(acc, x):
            start, end = acc.at + x.g, acc.at + x.g + x.w
            return F.struct(end.alias("at"), F.concat(acc.out, F.array(F.struct(start.alias("start"), F.lit(order).alias("order"), end.alias("end"), x.c.alias("c")))).alias("out"))

        return F.aggregate(block, F.struct(at.alias("at"), empty.alias("out")), step, lambda acc: acc.out)

    made = F.flatten(F.zip_with(blocks, F.aggregate(blocks, first, base, lambda acc: acc.out), inside))
    return F.transform(F.filter(made, lambda s: s.c >= rule.least), lambda s: F.struct(s.start.alias("start"), s.order.alias("order"), s.end.alias("end")))


def joined(found: Column) -> Column:
    names = F.array(*[F.lit(r.kind) for r in RULES])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.element_at(names, s.order + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def scan(documents: DataFrame, rules: tuple[Rule, ...] = RULES, block_rows: int = 4096) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    ready(documents.sparkSession)
    docs = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    rows = documents.select(F.count("*").alias("n")).first().n
    indexed = [r for r in rules if query(r)]
    full = [r for r in rules if not query(r)]
    kinds = candidates(docs, tuple(indexed), max(1, rows // block_rows))
    none = F.array().cast("array<struct<g:int,w:int,c:int>>")
    hit = docs.join(kinds, "key", "left")
    tests = {r.kind: F.array_contains("kinds", r.kind) for r in indexed} | {r.kind: F.rlike("text", F.lit(r.pattern)) for r in full}
    found = hit.select("doc_id", *[F.when(tests[r.kind], steps(r, F.col("text"))).otherwise(none).alias(r.kind) for r in rules])
    out = found.select("doc_id", F.array_sort(F.concat(*[spans(r, F.col(r.kind)) for r in rules])).alias("s"))
    base = F.filter("s", lambda s: s.order < BASE_KINDS)

    def count(i: int) -> Column:
        return F.size(F.filter("s", lambda s: s.order == i)).cast("long").alias(f"n_{RULES[i].kind}")

    return out.select("doc_id", *map(count, range(BASE_KINDS)), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("s")).alias("spans"))
