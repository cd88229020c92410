"""Secrets found through a trigram index: postings propose documents, regular expressions verify them.

Each rule's expression gives a Boolean query over trigrams that any match must hold. The index lists,
by shard, which documents hold which of the asked trigrams; intersected and united postings are the
rule's candidates, and only those are searched with its expression. A rule without mandatory
trigrams searches every text. All of it is DataFrame functions; the driver reads expressions alone.
"""

from __future__ import annotations

import re._constants as op
import re._parser as parser
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import let

#: Documents of a shard of the index, about.
SHARD = 4096
#: Strings that a part of an expression may stand for before it counts as anything.
EXACT = 32

#: A Boolean query: any of these sets of trigrams, all of the set. The empty set asks for nothing.
Query = frozenset[frozenset[str]]
EVERYTHING: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    """`pattern` (in the syntax that Java and Python share) finds spans; group `group` needs `least` characters at least."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1


#: The base kinds in the order in which equal starts are listed.
BASE_RULES = [
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{32,}"),
]
#: What the method adds: keys, tokens and passwords of well-known shapes.
MORE_RULES = [
    Rule("session", r"(?<![A-Z0-9])ASIA[A-Z0-9]{16}(?![A-Z0-9])"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ ){0,3}PRIVATE KEY-----"),
    Rule("forge", r"(?<![A-Za-z0-9_])(?:gh[opsur]_[A-Za-z0-9]{36}|github_pat_[A-Za-z0-9_]{22,}|glpat-[A-Za-z0-9_-]{20,})"),
    Rule("chat", r"(?<![A-Za-z0-9])xox[abeoprs]-[A-Za-z0-9-]{10,}"),
    Rule("payment", r"(?<![A-Za-z0-9])[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("maps", r"(?<![A-Za-z0-9_-])AIza[A-Za-z0-9_-]{35}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]*"),
    Rule("bearer", r"(?i:authorization)\x20*:\x20*(?i:bearer)\x20+([A-Za-z0-9._~+/=-]{16,})"),
    Rule("url_login", r"[a-z]{2,12}://[A-Za-z0-9._%+-]{1,64}:[^\s:/@]{3,64}@[A-Za-z0-9]"),
]
RULES = BASE_RULES + MORE_RULES


def _grams(exact: set[str]) -> Query:
    """What a text that holds one of these strings must hold. Only ASCII trigrams are asked: others fold case in more ways."""
    return frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2) if s[i : i + 3].isascii()) for s in exact)


def _both(a: Query, b: Query) -> Query:
    """Both queries; where that has too many alternatives, the one with fewer, which asks for less."""
    return frozenset(x | y for x in a for y in b) if len(a) * len(b) <= EXACT else min(a, b, key=len)


def _strings(a: set[str], b: set[str]) -> set[str] | None:
    return {x + y for x in a for y in b} if len(a) * len(b) <= EXACT else None


def _walk(items) -> tuple[set[str] | None, Query]:
    """(lower-cased strings that the parsed items stand for, or None; trigram query of a text that holds a match)."""
    query, exact, whole = EVERYTHING, {""}, True
    for kind, what in items:
        asked, piece, ends = EVERYTHING, None, False  # of this item: its own query, its strings, whether more may follow it
        if kind is op.LITERAL:
            piece = {chr(what).lower()}
        elif kind is op.IN and all(k is op.LITERAL for k, _ in what):
            piece = {chr(c).lower() for _, c in what}
        elif kind is op.SUBPATTERN:
            piece, asked = _walk(what[3])
        elif kind is op.ATOMIC_GROUP:
            piece, asked = _walk(what)
        elif kind is op.BRANCH:
            branches = [_walk(b) for b in what[1]]
            if all(strings is not None for strings, _ in branches):
                piece = set().union(*[strings for strings, _ in branches])
            else:
                asked = frozenset().union(*[_both(_grams(s), q) if s is not None else q for s, q in branches])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT, op.POSSESSIVE_REPEAT):
            low, high, inner = what
            strings, q = _walk(inner)
            if (low, high) == (0, 1) and strings is not None:
                piece = strings | {""}
            elif low:
                asked, ends = q, high != low
                if strings is not None:
                    piece = reduce(lambda a, _: a and _strings(a, strings), range(min(low, 8)), {""})
                    ends |= low > 8
        elif kind in (op.AT, op.ASSERT, op.ASSERT_NOT):
            continue  # they match no characters, so neighbours stay neighbours
        joined = _strings(exact, piece) if piece is not None else None
        if joined is not None and len(joined) <= EXACT:
            exact = joined
        else:
            query, whole = _both(query, _grams(exact)), False
            exact = piece if piece is not None and len(piece) <= EXACT else {""}
        query = _both(query, asked)
        if ends:
            query, exact, whole = _both(query, _grams(exact)), {""}, False
    return (exact if whole else None), (query if whole else _both(query, _grams(exact)))


def trigram_query(pattern: str) -> Query:
    """Sets of lower-case trigrams, one of which any text with a match of the pattern holds whole. EVERYTHING if it asks for none."""
    strings, query = _walk(parser.parse(pattern))
    query = _both(query, _grams(strings)) if strings is not None else query
    if frozenset() in query:
        return EVERYTHING
    return frozenset(a for a in query if not any(b < a for b in query))


def trigram_index(docs: DataFrame, key: str, text: str, trigrams: list[str], shards: int) -> DataFrame:
    """shard, gram, postings (sorted distinct keys): which texts hold which of the trigrams, A-Z folded.

    A shard holds the keys that leave its number as remainder, so a frequent trigram is split by shards.
    """
    asked = F.array(*[F.lit(g) for g in trigrams])
    held = let(F.lower(text), lambda low: F.filter(asked, lambda g: F.contains(low, g)))
    rows = docs.select(F.col(key).alias("key"), F.explode(held).alias("gram"))
    return rows.groupBy(F.pmod("key", F.lit(shards)).alias("shard"), "gram").agg(F.sort_array(F.collect_set("key")).alias("postings"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key, kinds: for each text that some query may match, the names of those queries. Postings are intersected within each shard."""
    alternatives = F.array(*[F.struct(F.lit(kind).alias("kind"), F.array(*[F.lit(g) for g in sorted(grams)]).alias("grams")) for kind, q in sorted(queries.items()) for grams in sorted(q, key=sorted)])
    shard = index.groupBy("shard").agg(F.map_from_entries(F.collect_list(F.struct("gram", "postings"))).alias("lists"))
    listed = lambda gram: F.coalesce(F.try_element_at("lists", gram), F.array().cast("array<bigint>"))
    every = lambda grams: F.aggregate(F.slice(grams, 2, F.size(grams)), listed(F.get(grams, F.lit(0))), lambda keys, g: F.array_intersect(keys, listed(g)))
    found = F.transform(alternatives, lambda a: F.struct(a["kind"].alias("kind"), every(a["grams"]).alias("keys")))
    rows = shard.select(F.explode(found).alias("r")).select("r.kind", F.explode("r.keys").alias("key"))
    return rows.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, number: int) -> Column:
    """(start, number, end) of the rule's matches: leftmost, non-overlapping, those with too short a group left out.

    Places follow from what lies between matches and what matches. A text without a match is searched
    once, others three or four times; spans are appended to an array, which is copied for each.
    """
    pattern = F.lit(rule.pattern)
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint>>")
    start = F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans"))
    whole = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)), F.length)
    tested = F.transform(F.regexp_extract_all(text, pattern, F.lit(rule.group)), F.length) if rule.group else whole
    sizes = F.arrays_zip(F.transform(F.split(text, rule.pattern, -1), F.length).alias("gap"), whole.alias("all"), tested.alias("part"))

    def step(acc, m):
        begin = acc["at"] + m["gap"]
        span = F.struct(begin.alias("start"), F.lit(number).alias("number"), (begin + m["all"]).alias("end"))
        return F.struct((begin + m["all"]).alias("at"), F.when(m["part"] >= rule.least, F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"))

    return F.when(F.rlike(text, pattern), F.aggregate(sizes, start, step)["spans"]).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: list[Rule] | None = None, carry: list[str] | None = None) -> DataFrame:
    """id_col, spans (array of kind, start, end by start, then rule, then end) of every whole text, and the columns in `carry`.

    Offsets are code points, end exclusive. Spans of one rule do not overlap; of different rules they may.

    Null text: no spans. Null, tied or repeated ids and repeated rows: each row by itself. An empty
    table gives an empty one. Columns that are not carried are ignored, whatever their names. Rows meet
    their candidates by a hash of id and text, so copies under other ids do not share a key; a hash
    that two texts share only makes both be searched. A text is held whole.
    """
    rules, carry = rules or RULES, carry or []
    queries = {r.kind: q for r in rules if (q := trigram_query(r.pattern)) != EVERYTHING}
    source = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"),
        F.xxhash64(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).alias("key"), *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(carry)],
    )
    if queries:
        shards = max(1, -(-docs.count() // SHARD))
        asked = sorted(set().union(*[a for q in queries.values() for a in q]))
        proposed = candidates(trigram_index(source, "key", "text", asked, shards), queries)
        source = source.join(proposed.hint("shuffle_hash"), "key", "left")
    else:
        source = source.withColumn("kinds", F.lit(None).cast("array<string>"))
    none = F.array().cast("array<struct<start:bigint,number:int,end:bigint>>")
    every = [F.when(F.array_contains("kinds", r.kind), _spans(F.col("text"), r, i)).otherwise(none) if r.kind in queries else _spans(F.col("text"), r, i) for i, r in enumerate(rules)]
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    listed = F.transform(F.sort_array(F.concat(*every)), lambda s: F.struct(F.get(kinds, s["number"]).alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return source.select(F.col("id").alias(id_col), listed.alias("spans"), *[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)])
