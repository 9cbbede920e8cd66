"""Personal data in texts: regular expressions propose spans, checksums confirm them, words nearby adjust their scores.

All of it is DataFrame expressions over one row at a time: no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.spans import joined, located, matches_sql, proposed
from tablelens.llm.spread import read

#: Characters before a span in which context words count, and what they add to its score.
NEARBY, BONUS = 40, 0.3


def digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether the digits sum to a multiple of ten, every second from the right doubled."""
    n = F.length(number)

    def worth(i: Column) -> Column:
        d = F.substring(number, i, F.lit(1)).cast("int")
        twice = F.pmod(n - i, F.lit(2)) == 1
        return F.when(twice, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)

    return F.pmod(F.aggregate(F.transform(F.sequence(F.lit(1), n), worth), F.lit(0), lambda a, x: a + x), F.lit(10)) == 0


def mod97(account: Column) -> Column:
    """Whether an account number leaves 1: its first four characters last, letters as 10 to 35."""
    plain = F.regexp_replace(account, " ", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def add(rest: Column, i: Column) -> Column:
        c = F.substring(turned, i, F.lit(1))
        return F.when(c >= "A", (rest * 100 + F.ascii(c) - 55) % 97).otherwise((rest * 10 + c.cast("int")) % 97)

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), add) == 1


@dataclass(frozen=True)
class Kind:
    name: str
    #: Equal to the plain form in its matches, but linear: runs are entered at their start only, groups do not nest calls.
    regex: str
    plain: str
    confirm: Callable[[Column], Column]
    confirm_sql: str
    score: float
    words: str
    base: bool = True


# ---- fixed values: the kinds, in the order that breaks ties of start; base ones have given patterns
_OCTETS = r"^0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])(\.0*([0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])){3}$"
_DIGITS_SQL = "regexp_replace(x.m, '[^0-9]', '', 'g')"
_LUHN_SQL = (f"list_sum(list_transform(range(1, length({_DIGITS_SQL}) + 1), lambda k: CASE WHEN (length({_DIGITS_SQL}) - k) % 2 = 1 "
             f"THEN {_DIGITS_SQL}[k]::INT * 2 - CASE WHEN {_DIGITS_SQL}[k]::INT > 4 THEN 9 ELSE 0 END "
             f"ELSE {_DIGITS_SQL}[k]::INT END)) % 10 = 0")
_TURNED_SQL = "(regexp_replace(x.m, ' ', '', 'g')[5:] || regexp_replace(x.m, ' ', '', 'g')[1:4])"
_MOD97_SQL = (f"list_reduce(list_prepend(0::BIGINT, list_transform(range(1, length({_TURNED_SQL}) + 1), lambda k: "
              f"CASE WHEN {_TURNED_SQL}[k] >= 'A' THEN 1000 + ascii({_TURNED_SQL}[k]) - 55 ELSE {_TURNED_SQL}[k]::BIGINT END)), "
              "lambda a, d: CASE WHEN d >= 1000 THEN (a * 100 + d - 1000) % 97 ELSE (a * 10 + d) % 97 END) = 1")
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: F.lit(True), "true", 0.9, "mail|contact|write"),
    Kind("ip", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
         lambda m: m.rlike(_OCTETS), f"regexp_matches(x.m, '{_OCTETS}')", 0.6, "address|host|server|ip"),
    Kind("card", r"(?<![0-9])[0-9](?:[ -]?[0-9])++", r"[0-9]([\x20-]?[0-9])+",
         lambda m: F.length(digits(m)).between(14, 19) & luhn(digits(m)),
         f"length({_DIGITS_SQL}) BETWEEN 14 AND 19 AND {_LUHN_SQL}", 0.7, "card|visa|credit|pay"),
    Kind("phone", r"\+[0-9][ ().0-9-]+[0-9]", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda m: F.length(digits(m)).between(10, 15), f"length({_DIGITS_SQL}) BETWEEN 10 AND 15", 0.6, "phone|call|tel|mobile"),
    Kind("iban", r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})",
         r"[A-Z]{2}[0-9]{2}(?:(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?|[A-Z0-9]{11,30})", mod97, _MOD97_SQL, 0.8, "iban|account|bank", False),
    Kind("ssn", r"[0-9]{3}-[0-9]{2}-[0-9]{4}", r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
         lambda m: ~m.rlike("^(000|666|9)|-00-|0000$"), "NOT regexp_matches(x.m, '^(000|666|9)|-00-|0000$')", 0.4, "ssn|social", False),
]
#: What every text with a span of the kind has, tested before the pattern runs.
_MARK = {"email": "@", "phone": "+"}
#: Spans of kinds beyond the base count from this score on.
LEAST = 0.5


def _spans(kind: Kind, order: int) -> Column:
    found = located(kind.name, kind.regex, confirm=lambda m: kind.confirm(m["match"]), nearby=NEARBY)

    def scored(s: Column) -> Column:
        near = F.lower(s["before"]).rlike(kind.words)
        return F.struct(s["start"].alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), s["end"].alias("end"),
                        F.round(F.least(F.lit(1.0), F.lit(kind.score) + F.when(near, BONUS).otherwise(0.0)), 2).alias("score"))

    spans = F.transform(found, scored)
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= LEAST)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, scores.

    spans joins kind:start:end of all spans by start and then kind; base_sha256 digests the same of the base kinds; scores joins
    the scores of all spans in that order. Null and empty texts have no spans, repeated rows and null ids are rows of their own, an
    empty table gives no rows, other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    marked = {k: F.col("text").contains(m) for k, m in _MARK.items()}
    rows = proposed(rows, {k.name: (k.regex, 0, marked.get(k.name)) for k in KINDS})
    kinds = rows.select("doc_id", *[_spans(k, i).alias(k.name) for i, k in enumerate(KINDS)])
    base = [k.name for k in KINDS if k.base]
    ordered = kinds.select(
        "doc_id", *[F.size(n).cast("long").alias(f"n_{n}") for n in base],
        F.array_sort(F.concat(*base)).alias("base"), F.array_sort(F.concat(*[k.name for k in KINDS])).alias("every"))
    return ordered.select(
        "doc_id", *[f"n_{n}" for n in base], F.sha2(joined(F.col("base")), 256).alias("base_sha256"),
        joined(F.col("every")).alias("spans"),
        F.array_join(F.transform("every", lambda s: s["score"].cast("string")), ",").alias("scores"))


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(read(spark, sf_dir, "documents"))


def _kind_sql(k: Kind, order: int) -> str:
    near = f"regexp_matches(lower(t[greatest(1, x.s - {NEARBY - 1}):x.s]), '{k.words}')"
    score = f"round(least(1.0, {k.score} + CASE WHEN {near} THEN {BONUS} ELSE 0 END), 2)"
    keep = f"({k.confirm_sql})" + ("" if k.base else f" AND {score} >= {LEAST}")
    return (f"list_transform(list_filter({matches_sql('t', k.plain)}, lambda x: {keep}), lambda x: "
            f"struct_pack(s := x.s, o := {order}, k := '{k.name}', e := x.e, sc := ({score})::DOUBLE)) AS {k.name}")


_JOIN_SQL = "coalesce(list_aggregate(list_transform({0}, lambda x: concat(x.k, ':', x.s, ':', x.e)), 'string_agg', ','), '')"
OP4_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
k AS (SELECT doc_id, {', '.join(_kind_sql(k, i) for i, k in enumerate(KINDS))} FROM d),
o AS (SELECT doc_id, {', '.join(f'len({k.name})::BIGINT AS n_{k.name}' for k in KINDS if k.base)},
  list_sort(flatten([{', '.join(k.name for k in KINDS if k.base)}])) AS base,
  list_sort(flatten([{', '.join(k.name for k in KINDS)}])) AS every FROM k)
SELECT doc_id, n_email, n_ip, n_card, n_phone, sha256({_JOIN_SQL.format('base')}) AS base_sha256, {_JOIN_SQL.format('every')} AS spans,
  coalesce(list_aggregate(list_transform(every, lambda x: x.sc::VARCHAR), 'string_agg', ','), '') AS scores
FROM o
"""
