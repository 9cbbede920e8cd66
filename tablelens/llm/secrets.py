"""Secrets in texts by a trigram inverted index.

Each rule's regular expression is read for the strings that every match must contain; their trigrams make a Boolean query, an OR of
ANDs. Postings list the texts that have each trigram of these queries; intersecting them leaves candidates, which the rule
then verifies. A rule without mandatory trigrams scans every text. All on DataFrame expressions, joins and aggregates.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.spans import joined, located, matches_sql, proposed
from tablelens.llm.spread import read, written

_parse = re._parser.parse  # the standard library's own reader of regular expressions
#: Strings and branches a query may have before it is made weaker instead of longer.
_MOST = 64
Query = frozenset  # of frozensets of trigrams, any of which is enough; one empty set: no restriction
ALL: Query = frozenset([frozenset()])


@dataclass(frozen=True)
class Rule:
    name: str
    regex: str
    group: int = 0  # the part whose length counts
    least: int = 0
    base: bool = True


# ---- fixed values: the rules, in the order that breaks ties of start; base ones have given patterns
RULES = [
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", base=False),
]


def _shortest(branches) -> Query:
    """Without branches that ask for more than another one does, as these add nothing."""
    return frozenset(b for b in branches if not any(o < b for o in branches))


def _and(a: Query, b: Query) -> Query:
    both = _shortest({x | y for x in a for y in b})
    return both if len(both) <= _MOST else a


def _of_strings(strings: frozenset[str]) -> Query:
    return _shortest({frozenset(s[i:i + 3] for i in range(len(s) - 2)) for s in strings})


def _facts(node) -> tuple[frozenset[str] | None, Query]:
    """The strings that a part of an expression matches, if they are few, and else what its matches must contain."""
    kind, value = str(node[0]), node[1]
    if kind == "LITERAL":
        return frozenset([chr(value).lower()]), ALL
    if kind == "IN":
        if all(str(k) == "LITERAL" for k, _ in value) and len(value) <= 8:
            return frozenset(chr(c).lower() for _, c in value), ALL
        return None, ALL
    if kind == "SUBPATTERN":
        return _sequence(value[-1])
    if kind == "BRANCH":
        parts = [_sequence(p) for p in value[1]]
        if all(s is not None for s, _ in parts):
            return frozenset().union(*(s for s, _ in parts)), ALL
        return None, _shortest(set().union(*(q if s is None else _of_strings(s) for s, q in parts)))
    if kind in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
        low, high, inner = value
        strings, query = _sequence(inner)
        if (low, high) == (0, 1) and strings is not None:
            return strings | {""}, ALL
        if low == 0:
            return None, ALL
        return None, query if strings is None else _of_strings(strings)
    return None, ALL


def _sequence(nodes) -> tuple[frozenset[str] | None, Query]:
    strings, query, whole = frozenset([""]), ALL, True
    for node in nodes:
        more, asked = _facts(node)
        if more is not None and len(strings) * len(more) <= _MOST:
            strings = frozenset(a + b for a in strings for b in more)
            continue
        query, whole = _and(query, _of_strings(strings)), False
        strings = frozenset([""]) if more is None else more
        query = _and(query, asked)
    return (strings, ALL) if whole else (None, _and(query, _of_strings(strings)))


def trigram_query(regex: str) -> Query:
    """What a text in lower case must contain for the expression to match somewhere in the text."""
    strings, query = _sequence(_parse(regex))
    return query if strings is None else _of_strings(strings)


def _spans(rule: Rule, order: int) -> Column:
    found = located(rule.name, rule.regex, rule.group, (lambda m: F.length(m["part"]) >= rule.least) if rule.least else None)
    return F.transform(found, lambda s: F.struct(
        s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(rule.name).alias("kind"), s["end"].alias("end")))


def _key(id_: Column, text: Column) -> Column:
    """Names a text in the index: rows that share an id and a text share it, which is right, as their spans are the same."""
    return F.concat_ws(":", F.coalesce(id_.cast("string"), F.lit("-")), F.length(text).cast("string"), F.xxhash64(text).cast("string"))


def postings(texts: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, key: the texts that have each of these trigrams, whatever the case."""
    # the array of one binds the text in lower case, which would be made anew for each trigram
    has = F.transform(F.array(F.lower("text")), lambda low: F.filter(F.array(*map(F.lit, trigrams)), lambda t: F.contains(low, t)))[0]
    return texts.select("key", F.explode(has).alias("trigram"))


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """key, rules: for each text the rules of which some branch has all its trigrams there."""
    asked = [(rule, n, t, len(branch)) for rule, query in queries.items() for n, branch in enumerate(sorted(map(sorted, query)))
             for t in branch]
    table = index.sparkSession.createDataFrame(asked, "rule string, branch int, trigram string, asked int")
    return (index.join(F.broadcast(table), "trigram").groupBy("key", "rule", "branch")
            .agg(F.count(F.lit(1)).alias("has"), F.first("asked").alias("asked")).where("has >= asked")
            .groupBy("key").agg(F.collect_set("rule").alias("rules")))


def find(docs: DataFrame, rules: list[Rule] = RULES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_<rule> for each base rule, base_sha256, spans.

    spans joins kind:start:end of all spans by start and then rule; base_sha256 digests the same of the base rules. Null and empty
    texts have no spans, repeated rows and null ids are rows of their own, an empty table gives no rows, other columns are not read.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), _key(F.col(id_col), text).alias("key"))
    order = {r.name: i for i, r in enumerate(rules)}
    queries = {r.name: trigram_query(r.regex) for r in rules}
    indexed = [r for r in rules if queries[r.name] != ALL]
    full = [r for r in rules if r not in indexed]
    scanned = proposed(rows, {r.name: (r.regex, r.group, None) for r in full}).select(
        "key", "doc_id", *[_spans(r, order[r.name]).alias(r.name) for r in full])
    none = F.array().cast("array<struct<start: int, ord: int, kind: string, end: int>>")
    found = scanned
    if indexed:
        trigrams = sorted({t for r in indexed for branch in queries[r.name] for t in branch})
        index = written(postings(rows, trigrams).distinct())
        chosen = candidates(index, {r.name: queries[r.name] for r in indexed})
        asked = {r.name: (r.regex, r.group, F.array_contains("rules", r.name)) for r in indexed}
        verified = proposed(rows.select("key", "text").join(chosen, "key"), asked).select(
            "key", F.struct(*[_spans(r, order[r.name]).alias(r.name) for r in indexed]).alias("v"))
        one = verified.where(" OR ".join(f"size(v.{r.name}) > 0" for r in indexed)).groupBy("key").agg(F.first("v").alias("v"))
        found = scanned.join(one, "key", "left").select(
            *scanned.columns, *[F.coalesce(F.col(f"v.{r.name}"), none).alias(r.name) for r in indexed])
    base = [r.name for r in rules if r.base]
    ordered = found.select(
        "doc_id", *[F.size(n).cast("long").alias(f"n_{n}") for n in base],
        F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*[r.name for r in rules])).alias("every"))
    return ordered.select("doc_id", *[f"n_{n}" for n in base], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
                          joined(F.col("every")).alias("spans"))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


def _rule_sql(r: Rule, order: int) -> str:
    keep = f"length(x.p) >= {r.least}" if r.least else "true"
    return (f"list_transform(list_filter({matches_sql('t', r.regex, r.group)}, lambda x: {keep}), lambda x: "
            f"struct_pack(s := x.s, o := {order}, k := '{r.name}', e := x.e)) AS {r.name}")


_JOIN_SQL = "coalesce(list_aggregate(list_transform({0}, lambda x: concat(x.k, ':', x.s, ':', x.e)), 'string_agg', ','), '')"
OP8_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, {', '.join(_rule_sql(r, i) for i, r in enumerate(RULES))} FROM d),
o AS (SELECT doc_id, {', '.join(f'len({r.name})::BIGINT AS n_{r.name}' for r in RULES if r.base)},
  list_sort(flatten([{', '.join(r.name for r in RULES if r.base)}])) AS base,
  list_sort(flatten([{', '.join(r.name for r in RULES)}])) AS every FROM k)
SELECT doc_id, n_assign, n_access, n_hex, sha256({_JOIN_SQL.format('base')}) AS base_sha256, {_JOIN_SQL.format('every')} AS spans FROM o
"""
