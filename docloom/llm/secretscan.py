"""Secret scans over a trigram inverted index, by DataFrame functions alone.

Each rule is a regular expression. From its syntax tree a Boolean trigram query is derived, in
disjunctive form: sets of lower-case trigrams one of which lies whole in any text that matches.
The index posts, for each trigram that some rule asks for and each block of documents, the sorted
keys of the documents that hold it. A rule's postings are intersected within each set and united
over the sets; only these candidates are verified with the expression. A rule without mandatory
trigrams (a run of hex digits) has no such query and scans every document.

Postings are grouped by block of about ``BLOCK`` documents, so a trigram that a third of all
documents hold makes no large group. Candidates are narrow rows; they are broadcast while there
are at most ``MOST_BROADCAST`` and joined by shuffle beyond.

Only some trigrams of a literal run are posted, one after the other without overlap, which keeps the
index small and loses no candidate.

Defined results: null texts count as empty; null ids are kept; rows with equal ids are scanned
each for itself; an empty table gives no rows; other columns pass through or are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from functools import reduce
from itertools import product
from re import _constants as sre
from re import _parser as sre_parse

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docloom.functions.arrays import bind, spans
from docloom.llm.common import broadcast_if_small, parts_for, written

BLOCK = 8192
MOST_BROADCAST = 2_000_000
#: Above so many alternatives a literal run is cut into the trigrams it has so far.
MOST_STRINGS = 64
MOST_MEMBERS = 6
MOST_A_CLAUSE = 3


@dataclass(frozen=True)
class Rule:
    """Matches of ``pattern`` are secrets if ``group`` has at least ``least`` characters."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0


def _either_case(words: str) -> str:
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


BASE_RULES = (
    Rule("assign", "(" + _either_case("password|passwd|secret|token|api_?key") + r""")["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2),
    Rule("access", "AKIA[A-Z0-9]{16,}"),
    Rule("hex", "[0-9a-f]{24,}"),
)
#: Forms of published tokens, keys and connection strings, fixed values.
MORE_RULES = (
    Rule("private_key", "-----BEGIN (?:RSA |EC |DSA |OPENSSH |ENCRYPTED )?PRIVATE KEY-----"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("git_token", "gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("map_key", "AIza[A-Za-z0-9_-]{35}"),
    Rule("pay_key", "[rs]k_live_[A-Za-z0-9]{24,}"),
    Rule("login_url", r"[a-z][a-z0-9+.-]{1,20}://[^\x20\x09-\x0D:/@]{1,64}:[^\x20\x09-\x0D:/@]{1,64}@[A-Za-z0-9]"),
)
RULES = BASE_RULES + MORE_RULES

Clauses = frozenset  # of frozensets of trigrams; the clause without trigrams is always true
ALWAYS: Clauses = frozenset([frozenset()])


def _either(a: Clauses, b: Clauses) -> Clauses:
    found = a | b
    return frozenset(c for c in found if not any(other < c for other in found))


def _both(a: Clauses, b: Clauses) -> Clauses:
    if len(a) * len(b) > MOST_STRINGS:
        return a if len(a) <= len(b) and a != ALWAYS else b
    return reduce(_either, (frozenset([x | y]) for x, y in product(a, b)))


def _trigrams(strings: frozenset[str]) -> Clauses:
    return reduce(_either, (frozenset([frozenset(s[i : i + 3] for i in {*range(0, len(s) - 2, 3), max(0, len(s) - 3)} if len(s) > 2)]) for s in strings))


def _set_members(items: list) -> frozenset[str] | None:
    """The lower-case members of a character class of at most MOST_MEMBERS, or None."""
    found: set[str] = set()
    for kind, value in items:
        if kind is sre.LITERAL:
            found.add(chr(value).lower())
        elif kind is sre.RANGE and value[1] - value[0] < MOST_MEMBERS:
            found |= {chr(c).lower() for c in range(value[0], value[1] + 1)}
        else:
            return None
    return frozenset(found) if len(found) <= MOST_MEMBERS else None


def _query(items: list) -> tuple[frozenset[str] | None, Clauses]:
    """(all strings that a sequence matches, if few; what must hold besides)."""
    run, exact, query = frozenset([""]), True, ALWAYS

    def cut() -> None:
        nonlocal run, query, exact
        query, run, exact = _both(query, _trigrams(run)), frozenset([""]), False

    for kind, value in items:
        strings: frozenset[str] | None = None
        inner = ALWAYS
        if kind is sre.LITERAL:
            strings = frozenset([chr(value).lower()])
        elif kind is sre.IN:
            strings = _set_members(value)
        elif kind is sre.SUBPATTERN:
            strings, inner = _query(list(value[-1]))
        elif kind is sre.BRANCH:
            options = [_query(list(branch)) for branch in value[1]]
            if all(s is not None for s, _ in options):
                strings = frozenset().union(*(s for s, _ in options))
            else:
                inner = reduce(_either, (q if s is None else _trigrams(s) for s, q in options))
        elif kind in (sre.MAX_REPEAT, sre.MIN_REPEAT):
            least, most, body = value
            strings, inner = _query(list(body))
            if least == 0:
                strings, inner = (strings | {""} if strings is not None and most == 1 else None), ALWAYS
            elif strings is not None and (least, most) != (1, 1):
                inner, strings = _both(inner, _trigrams(strings)), None
        elif kind is sre.AT:
            strings = frozenset([""])
        if strings is not None and len(run) * len(strings) <= MOST_STRINGS:
            run = frozenset(a + b for a, b in product(run, strings))
        else:
            cut()
            query = _both(query, inner)
    if exact:
        return run, ALWAYS
    cut()
    return None, query


def trigram_query(pattern: str) -> Clauses:
    """Sets of trigrams; every matching text, in lower case, holds all of some set. ``ALWAYS``: none are mandatory.

    Of each set the ``MOST_A_CLAUSE`` trigrams that most sets have are enough; fewer trigrams leave more candidates and lose none.
    """
    strings, query = _query(list(sre_parse.parse(pattern)))
    query = _trigrams(strings) if strings is not None else query
    shared = Counter(t for clause in query for t in clause)
    thinned = (frozenset(sorted(clause, key=lambda t: (-shared[t], t))[:MOST_A_CLAUSE]) for clause in query)
    return reduce(_either, (frozenset([clause]) for clause in thinned))


def postings(docs: DataFrame, trigrams: list[str], blocks: int) -> DataFrame:
    """(block, trigram, keys): the inverted index of ``docs`` (key, text) over the given trigrams."""
    lowered = docs.select(F.pmod("key", F.lit(blocks)).alias("block"), "key", F.lower("text").alias("lower"))  # once for all trigrams
    held = F.array_compact(F.array(*[F.when(F.contains("lower", F.lit(t)), F.lit(t)) for t in trigrams]))
    posted = lowered.select("block", "key", F.explode(held).alias("trigram"))
    return posted.groupBy("block", "trigram").agg(F.sort_array(F.collect_set("key")).alias("keys"))


def candidates(index: DataFrame, queries: dict[str, Clauses]) -> DataFrame:
    """(key, kinds): the documents whose postings satisfy each rule's query, rule by rule."""
    by_block = index.groupBy("block").agg(F.map_from_entries(F.collect_list(F.struct("trigram", "keys"))).alias("lists"))
    none = F.array().cast("array<bigint>")

    def listed(trigram: str) -> Column:
        return F.coalesce(F.element_at("lists", F.lit(trigram)), none)

    def satisfied(query: Clauses) -> Column:
        clauses = [reduce(F.array_intersect, [listed(t) for t in sorted(c)]) for c in sorted(query, key=sorted)]
        return reduce(F.array_union, clauses)

    found = None
    for kind, query in queries.items():
        keys = by_block.select(F.explode(satisfied(query)).alias("key"), F.lit(kind).alias("kind"))
        found = keys if found is None else found.unionByName(keys)
    return found.groupBy("key").agg(F.collect_set("kind").alias("kinds"))


def _spans(text: Column, rule: Rule, rank: int) -> Column:
    """Structs (start, rank, kind, end) of the matches of one rule, in code points."""
    whole, group = (F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(g)) for g in (0, rule.group))
    parts = F.struct(whole.alias("whole"), F.split(text, rule.pattern, -1).alias("pieces"), group.alias("group"))

    def kept(p: Column) -> Column:
        found = F.zip_with(spans(p.pieces, p.whole), p.group, lambda s, g: F.struct(s.start.alias("start"), F.lit(rank).alias("rank"), F.lit(rule.kind).alias("kind"), s.end.alias("end"), F.length(g).alias("size")))
        return F.transform(F.filter(found, lambda s: s["size"] >= rule.least), lambda s: F.struct(s.start.alias("start"), s["rank"].alias("rank"), s.kind.alias("kind"), s.end.alias("end")))

    return bind(parts, kept)


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``docs`` (doc_id, text, ...) as doc_id and ``spans``: structs (start, rank, kind, end) of all secrets by start, then rule."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id"))
    queries = {rule.kind: trigram_query(rule.pattern) for rule in rules}
    indexed = {kind: query for kind, query in queries.items() if query != ALWAYS}
    if indexed:
        trigrams = sorted({t for query in indexed.values() for clause in query for t in clause})
        blocks = parts_for(docs.count(), BLOCK)
        found = written(candidates(postings(rows.select("key", "text"), trigrams, blocks), indexed), "secret-candidates")
        rows = rows.join(broadcast_if_small(found, MOST_BROADCAST), "key", "left")
    else:
        rows = rows.withColumn("kinds", F.lit(None).cast("array<string>"))
    text, empty = F.col("text"), F.array().cast("array<struct<start:int,rank:int,kind:string,end:int>>")
    parts = []
    for rank, rule in enumerate(rules):
        due = F.array_contains("kinds", rule.kind) if rule.kind in indexed else text.rlike(rule.pattern)
        parts.append(F.when(due, _spans(text, rule, rank)).otherwise(empty))
    return rows.select("doc_id", F.array_sort(F.flatten(F.array(*parts))).alias("spans"))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, the count of each base kind, base_sha256 and all spans as text."""
    base = {rule.kind for rule in BASE_RULES}

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")

    def number(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(rule.kind) for rule in BASE_RULES]
    base_spans = F.filter("spans", lambda s: s.kind.isin(*base))
    return scanned.select("doc_id", *counts, F.sha2(joined(base_spans), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def _sql_matches(rank: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    return (
        f"SELECT doc_id, {rank} AS rank, '{rule.kind}' AS kind, regexp_extract_all(t, '{pattern}', 0) AS w, "
        f"regexp_extract_all(t, '{pattern}', {rule.group}) AS g, string_split_regex(t, '{pattern}') AS s, {rule.least} AS least FROM d"
    )


ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(_sql_matches(i, r) for i, r in enumerate(RULES))}),
k AS (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM m WHERE len(w) > 0),
p AS (SELECT doc_id, rank, kind, length(w[i]) AS n,
  CAST(list_sum([length(x) for x in s[1:i]]) + coalesce(list_sum([length(x) for x in w[1:i-1]]), 0) AS BIGINT) AS start
  FROM k WHERE length(g[i]) >= least),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
  count(*) FILTER (kind = 'hex') AS n_hex, string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) AS spans,
  string_agg(kind || ':' || start || ':' || (start + n), ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}) AS base
  FROM p GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a ON d.doc_id = a.doc_id
"""
