"""Spans of regular expressions as DataFrame expressions: where matches begin and end, checked, ordered and joined."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Matches whose spans are gathered in one array before it is joined to the others.
RUN = 64


def proposed(rows: DataFrame, regexes: dict[str, tuple[str, int, Column | None]]) -> DataFrame:
    """Adds for each name the matches of its expression in ``text`` and a group of each, as columns that located() reads.

    They are columns of their own because they are used several times; the expression runs once per text, and not at all where the
    given condition does not hold.
    """
    columns = []
    for name, (regex, group, where) in regexes.items():
        for part, number in ((f"{name}_hits", 0), *([(f"{name}_parts", group)] if group else [])):
            found = F.regexp_extract_all("text", F.lit(regex), F.lit(number))
            columns.append((found if where is None else F.when(where, found)).alias(part))
    return rows.select("*", *columns)


def located(name: str, regex: str, group: int = 0, confirm: Callable[[Column], Column] | None = None, nearby: int = 0) -> Column:
    """Array of (start, end, match, part, before) for the leftmost non-overlapping matches that ``confirm`` (match, part) accepts.

    Code points, end exclusive; part is the group, before holds up to ``nearby`` characters in front of the match. The text between matches
    tells where they stand; texts without any are not split. Matches go in runs of RUN, each with where it begins, so that only short
    arrays are appended to and the work grows with the number of matches.
    """
    hits = F.col(f"{name}_hits")
    parts = F.col(f"{name}_parts") if group else hits
    gaps = F.split("text", regex, -1)
    zipped = F.arrays_zip(F.slice(gaps, 1, F.size(hits)).alias("gap"), hits.alias("match"), parts.alias("part"))
    span = "struct<start: int, end: int, match: string, part: string, before: string>"

    def last(*texts: Column) -> Column:
        return F.right(F.concat(*texts), F.lit(nearby)) if nearby else F.lit("")

    def add(so_far: Column, row: Column) -> Column:
        start = so_far["at"] + F.length(row["gap"])
        end = start + F.length(row["match"])
        one = F.struct(start.alias("start"), end.alias("end"), row["match"].alias("match"), row["part"].alias("part"),
                       last(so_far["tail"], row["gap"]).alias("before"))
        more = F.concat(so_far["found"], F.array(one))
        return F.struct(end.alias("at"), last(so_far["tail"], row["gap"], row["match"]).alias("tail"),
                        (more if confirm is None else F.when(confirm(row), more).otherwise(so_far["found"])).alias("found"))

    def add_run(so_far: Column, run: Column) -> Column:
        none = F.struct(so_far["at"].alias("at"), so_far["tail"].alias("tail"), F.array().cast(f"array<{span}>").alias("found"))
        # an array of one binds what would be worked out anew for each use
        return F.transform(F.array(F.aggregate(run, none, add)), lambda got: F.struct(
            got["at"].alias("at"), got["tail"].alias("tail"), F.concat(so_far["found"], F.array(got["found"])).alias("found")))[0]

    def runs(rows: Column) -> Column:
        each = F.sequence(F.lit(0), F.floor((F.size(rows) - 1) / RUN).cast("int"))
        return F.transform(each, lambda k: F.slice(rows, k * RUN + 1, RUN))

    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("tail"), F.array().cast(f"array<array<{span}>>").alias("found"))
    found = F.transform(F.array(zipped), lambda rows: F.aggregate(runs(rows), start, add_run, lambda x: F.flatten(x["found"])))[0]
    return F.when(F.size(hits) > 0, found).otherwise(F.array().cast(f"array<{span}>"))


def joined(spans: Column) -> Column:
    """kind:start:end for each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


# ---------------------------------------------------------------- the same in the SQL engine


def matches_sql(text: str, regex: str, group: int = 0, options: str = "") -> str:
    """List of structs s, e, m, p like matches()."""
    r = "'" + regex.replace("'", "''") + "'"
    if options:
        r = "'(?" + options + ")" + regex.replace("'", "''") + "'"
    hits, parts, gaps = f"regexp_extract_all({text}, {r})", f"regexp_extract_all({text}, {r}, {group})", f"string_split_regex({text}, {r})"
    upto = f"(list_sum(list_transform({gaps}[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform({hits}[1:i-1], lambda h: length(h))), 0))::BIGINT"
    return (f"list_transform(range(1, len({hits}) + 1), lambda i: struct_pack(s := {upto}, e := {upto} + length({hits}[i]), "
            f"m := {hits}[i], p := {parts}[i]))")
