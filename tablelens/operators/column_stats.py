"""Per-column statistics of a whole table from one wide aggregate, returned as one row per column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablelens import fixed_values as fv
from tablelens.config import DEFAULT, LensConfig
from tablelens.functions import text as tx
from tablelens.functions.stats import approx_distinct, finite, sample_skewness
from tablelens.operators.quantiles import exact_quantiles
from tablelens.sources.tables import pin_small

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
REAL_TYPES = (T.FloatType, T.DoubleType, T.DecimalType)
DATE_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)
NUMERIC_KINDS = ("integer", "real")

DATE_FORMAT_NAMES = [f for f, _, _ in fv.DATE_FORMATS]

# one row of column statistics: name and type
STATS_FIELDS = {
    "ord": "INT", "column": "STRING", "type": "STRING", "kind": "STRING",
    "rows": "BIGINT", "nulls": "BIGINT", "approx_distinct": "BIGINT", "single_value": "BOOLEAN",
    "min_num": "DOUBLE", "max_num": "DOUBLE", "mean": "DOUBLE", "std": "DOUBLE", "skewness": "DOUBLE",
    "q1": "DOUBLE", "median": "DOUBLE", "q3": "DOUBLE",
    "min_text": "STRING", "max_text": "STRING", "span_days": "BIGINT", "avg_length": "DOUBLE",
    "sentinels": "BIGINT", "currency_like": "BIGINT", "currency_cast": "BIGINT", "currency_cast_kept": "BIGINT",
    "number_like": "BIGINT", "number_like_kept": "BIGINT", "not_boolean": "BIGINT",
    "any_date": "BIGINT", "best_date": "BIGINT", "date_format": "STRING",
}


def kind_of(dtype: T.DataType) -> str:
    """integer, real, datetime, boolean, string or other; decided by type class, so nested types are 'other'."""
    if isinstance(dtype, INTEGER_TYPES):
        return "integer"
    if isinstance(dtype, REAL_TYPES):
        return "real"
    if isinstance(dtype, DATE_TYPES):
        return "datetime"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    if isinstance(dtype, (T.StringType, T.CharType, T.VarcharType)):
        return "string"
    return "other"


def _holds_map(dtype: T.DataType) -> bool:
    if isinstance(dtype, T.ArrayType):
        return _holds_map(dtype.elementType)
    if isinstance(dtype, T.StructType):
        return any(_holds_map(f.dataType) for f in dtype.fields)
    return isinstance(dtype, (T.MapType, T.VariantType))


def comparable(c: str, dtype: T.DataType) -> str:
    """Maps have no order and no equality in Spark; compare their JSON instead."""
    return f"to_json(named_struct('v', {c}))" if _holds_map(dtype) else c


def hash_parts(c: str, dtype: T.DataType, depth: int = 0) -> list[str]:
    """Expressions whose common hash differs where the values differ; hashing alone skips nulls at every level of a value."""
    missing = f"{c} IS NULL"
    if _holds_map(dtype):
        return [comparable(c, dtype), missing]
    if isinstance(dtype, T.StructType):
        fields = [p for f in dtype.fields for p in hash_parts(f"{c}.{tx.ident(f.name)}", f.dataType, depth)]
        return [missing, *fields]
    if isinstance(dtype, T.ArrayType):
        x = f"x{depth}"
        if isinstance(dtype.elementType, (T.ArrayType, T.StructType)):
            return [missing, f"transform({c}, {x} -> xxhash64({', '.join(hash_parts(x, dtype.elementType, depth + 1))}))"]
        return [missing, c, f"transform({c}, {x} -> {x} IS NULL)"]
    return [c, missing]


# bits of the per-value flag word behind the text cleaning rules; date formats follow from bit 5 on
SENTINEL, CURRENCY, CAST, NUMBER, BOOLEAN = 1, 2, 4, 8, 16
DATES = [32 << i for i in range(len(DATE_FORMAT_NAMES))]


# what the first characters and one pattern tell of a text, so that it meets few further patterns
NO_FIGURE, PLAIN, YEAR_FIRST, YEAR_LAST, FIGURE = range(5)


def _look(c: str) -> str:
    return (f"CASE WHEN {c} IS NULL THEN NULL WHEN NOT ({tx.may_be_number_or_date(c)}) THEN {NO_FIGURE} WHEN {tx.is_plain_number(c)} THEN {PLAIN} "
            f"WHEN {tx.starts_like_date(c)} THEN CASE WHEN {tx.year_first(c)} THEN {YEAR_FIRST} ELSE {YEAR_LAST} END ELSE {FIGURE} END")


def _flag_word(c: str, look: str) -> str:
    """All flags of a value in one integer, so that each value is examined once however many counts use it; null for a null.

    Each test stands here once: generated code of more than 8,000 bytes would not be compiled but interpreted.
    """
    def bit(test: str, value: int) -> str:
        return f"CASE WHEN {test} THEN {value} ELSE 0 END"

    def dates(*which: str) -> str:
        return " + ".join(bit(tx.is_date(c, f), DATES[DATE_FORMAT_NAMES.index(f)]) for f in which)

    marked = [f for f in DATE_FORMAT_NAMES if any(m in f for m in "/-")]
    # of plain numbers only single digits are listed words, and a listed word is a sentinel or a boolean; a sign excludes an amount, a currency symbol a number
    words = (f"CASE WHEN ({look} IN ({NO_FIGURE}, {FIGURE}) OR length({c}) = 1) AND {tx.could_be_listed_word(c)} AND {tx.is_listed_word(c)} "
             f"THEN CASE WHEN {tx.is_boolean_word(c)} THEN {BOOLEAN} ELSE {SENTINEL} END ELSE 0 END")
    figure = (f"CASE {look} WHEN {PLAIN} THEN CASE WHEN ascii({c}) BETWEEN 48 AND 57 THEN {CURRENCY + CAST + NUMBER} "
              f"WHEN ascii({c}) IN (43, 45) THEN {CAST + NUMBER} ELSE {CURRENCY + CAST} END "
              f"WHEN {FIGURE} THEN {bit(tx.looks_like_currency(c), CURRENCY)} + CASE WHEN {tx.casts_as_currency(c)} "
              f"THEN {CAST} + {bit(tx.casts_as_number(c), NUMBER)} ELSE 0 END "
              f"WHEN {YEAR_FIRST} THEN {dates(*[f for f in marked if f.startswith('yyyy')])} "
              f"WHEN {YEAR_LAST} THEN {dates(*[f for f in marked if not f.startswith('yyyy')])} ELSE 0 END")
    digits = f"CASE WHEN {look} IN ({PLAIN}, {FIGURE}) AND length({c}) >= 8 THEN {dates(*[f for f in DATE_FORMAT_NAMES if f not in marked])} ELSE 0 END"
    return f"CASE WHEN {look} IS NOT NULL THEN {words} + {figure} + {digits} END"


def _text_aggs() -> dict[str, str]:
    """Counts of texts from rows (f: flag word, null for a null; n: values that have it; chars: their length in all)."""
    def having(bits: int, without: int = 0) -> str:
        test = f"f & {bits} <> 0" + (f" AND f & {without} = 0" if without else "")
        return f"sum(CASE WHEN {test} THEN n ELSE 0 END)"

    out = {
        "sentinels": having(SENTINEL),
        "currency_like": having(CURRENCY),
        "currency_cast": having(CAST),
        "currency_cast_kept": having(CAST, without=SENTINEL),
        "number_like": having(NUMBER),
        "number_like_kept": having(NUMBER, without=SENTINEL),
        "not_boolean": f"sum(CASE WHEN f & {BOOLEAN} = 0 THEN n ELSE 0 END)",
        "any_date": having(sum(DATES)),
    }
    return out | {f"date_{i}": having(v) for i, v in enumerate(DATES)}


def _long(df: DataFrame, structs: list[str]) -> DataFrame:
    return df.selectExpr(f"inline(array({', '.join(structs)}))")


def _named(aggs: dict[str, str]) -> list:
    return [F.expr(f"{e} AS {n}") for n, e in aggs.items()]


def _by_column(plain: DataFrame, sketched: DataFrame, sketches: dict[str, str]) -> DataFrame:
    """Two aggregates of (column, value) rows, one row per column each, side by side.

    Counts and moments alone run in generated code; together with sketches or text extremes, which cannot, they
    would all be interpreted. The branches run at the same time.
    """
    return plain.join(sketched.groupBy("ord").agg(*_named(sketches)), "ord")


def text_ends(df: DataFrame, columns: dict[int, T.StructField]) -> DataFrame:
    """ord, single_value, min_text, max_text: extremes of texts side by side, in generated code; by column they would be interpreted or sorted."""
    ends = df.agg(*[F.expr(f"{m}({tx.ident(f.name)}) AS {m}{i}") for i, f in columns.items() for m in ("min", "max")])
    return _long(ends, [f"struct({i} AS ord, min{i} = max{i} AS single_value, min{i} AS min_text, max{i} AS max_text)" for i in columns])


def _text_stats(df: DataFrame, columns: dict[int, T.StructField], text_rules: bool, sketches: bool, ends: bool) -> DataFrame:
    """Values are counted by column and flag word, of which there are few, and every count is a sum over these rows."""
    hashed = not (sketches or ends)
    values = _long(df, [f"struct({i} AS ord, {tx.ident(f.name)} AS t)" for i, f in columns.items()])
    extremes = {"approx_distinct": approx_distinct("t"), "single_value": "min(t) = max(t)", "min_text": "min(t)", "max_text": "max(t)"}
    looked = values.selectExpr("ord", "t", f"{_look('t')} AS look") if text_rules else values
    flags = _flag_word("t", "look") if text_rules else "CASE WHEN t IS NOT NULL THEN 0 END"
    mark, spread = (["xxhash64(t) AS h"], [F.min("h").alias("lo"), F.max("h").alias("hi")]) if hashed else ([], [])
    histogram = looked.selectExpr("ord", f"{flags} AS f", "length(t) AS size", *mark).groupBy("ord", "f").agg(
        F.count(F.lit(1)).alias("n"), F.sum("size").alias("chars"), *spread)
    counts = {"rows": "sum(n)", "nulls": "sum(CASE WHEN f IS NULL THEN n ELSE 0 END)",
              "avg_length": "try_divide(CAST(sum(chars) AS DOUBLE), sum(CASE WHEN f IS NOT NULL THEN n END))"}
    counts |= _text_aggs() if text_rules else {}
    if hashed:
        counts["single_value"] = "min(CASE WHEN f IS NOT NULL THEN lo END) = max(CASE WHEN f IS NOT NULL THEN hi END)"
    plain = histogram.groupBy("ord").agg(*_named(counts))
    if hashed:
        return plain
    return _by_column(plain, values, extremes) if sketches else plain.join(text_ends(df, columns), "ord")


def _value_stats(df: DataFrame, columns: dict[int, T.StructField], quartiles: bool, sketches: bool, cfg: LensConfig) -> DataFrame:
    """Everything but text: numbers and booleans as double, dates as timestamp, and a hash for all types."""
    structs, marks, apart = [], [], quartiles or sketches
    for i, f in columns.items():
        kind = kind_of(f.dataType)
        c = finite(tx.ident(f.name), f.dataType)
        num = f"CAST({c} AS DOUBLE)" if kind in NUMERIC_KINDS or kind == "boolean" else "CAST(NULL AS DOUBLE)"
        ts = f"CAST({c} AS TIMESTAMP_NTZ)" if kind == "datetime" else "CAST(NULL AS TIMESTAMP_NTZ)"
        mark = f"CASE WHEN {c} IS NOT NULL THEN xxhash64({', '.join(hash_parts(c, f.dataType))}) END"
        structs.append(f"struct({i} AS ord, {num} AS num, {ts} AS ts, {c} IS NULL AS missing"
                       + (")" if apart else f", {mark} AS h)"))
        marks.append(f"struct({i} AS ord, {mark} AS h" + (f", {num} AS num)" if quartiles else ")"))
    plain = {
        "rows": "count(1)", "nulls": "count_if(missing)",
        "min_num": "min(num)", "max_num": "max(num)", "mean": "avg(num)", "std": "stddev_samp(num)",
        "skewness": sample_skewness("num"), "min_ts": "min(ts)", "max_ts": "max(ts)",
    }
    single = {"single_value": "min(h) = max(h)"}
    moments = _long(df, structs).groupBy("ord").agg(*_named(plain if apart else plain | single))
    if apart:
        found = single | ({"approx_distinct": approx_distinct("h")} if sketches else {})
        if quartiles:
            found["q"] = f"percentile_approx(num, array(0.25, 0.5, 0.75), {cfg.quantile_accuracy})"
        moments = _by_column(moments, _long(df, marks), found)
    if not quartiles:
        moments = moments.withColumn("q", F.lit(None).cast("array<double>"))
    return moments.selectExpr(
        "*", "q[0] AS q1", "q[1] AS median", "q[2] AS q3", "timestampdiff(DAY, min_ts, max_ts) AS span_days")


def _as_stats(stats: DataFrame, schema: DataFrame) -> DataFrame:
    """The aggregates as rows with all STATS_FIELDS, one for every column of the schema, also of an empty table."""
    have = set(stats.columns) | {"type", "kind", "column"}
    known = {"rows": "coalesce(rows, 0)", "nulls": "coalesce(nulls, 0)",
             "single_value": "coalesce(single_value, false)"}
    if "approx_distinct" in have:
        known["approx_distinct"] = "coalesce(approx_distinct, 0)"
    if "num" in have or "min_num" in have:
        known |= {n: f"CASE WHEN kind <> 'boolean' THEN {n} END"
                  for n in ("min_num", "max_num", "mean", "std", "skewness", "q1", "median", "q3")}
        known |= {f"{m}_text": f"CASE kind WHEN 'boolean' THEN CAST(CAST({m}_num AS BOOLEAN) AS STRING) "
                               f"WHEN 'datetime' THEN CASE WHEN type = 'date' THEN CAST(CAST({m}_ts AS DATE) AS STRING) "
                               f"ELSE CAST({m}_ts AS STRING) END END" for m in ("min", "max")}
    if "date_0" in have:
        counts = [f"date_{j}" for j in range(len(DATE_FORMAT_NAMES))]
        known["best_date"] = f"greatest({', '.join(counts)})"
        # ties go to the earlier format
        picks = " ".join(f"WHEN {c} = {known['best_date']} THEN {tx.literal(n)}"
                         for c, n in zip(counts, DATE_FORMAT_NAMES))
        known["date_format"] = f"CASE {picks} END"
    return schema.join(stats, "ord", "left").selectExpr(*[
        f"CAST({known.get(n) or (n if n in have or n == 'ord' else 'NULL')} AS {t}) AS `{n}`"
        for n, t in STATS_FIELDS.items()])


def column_stats(df: DataFrame, cfg: LensConfig = DEFAULT, text_rules: bool = True, quartiles: bool = True,
                 sketches: bool = True, ends: bool = True) -> DataFrame:
    """One row per column. Counts, moments and extremes are exact; distinct counts and quartiles are sketches
    (without ``sketches`` and ``quartiles`` they stay empty, for callers that compute exact ones or need none; generated code then does all).
    Without ``ends`` and ``sketches`` texts have no extremes either, and single_value says of them that all have one 64-bit hash.

    Values are turned into (column, value) rows inside the scan and aggregated by column before the shuffle, so the
    generated code does not grow with the width of the table. Text and other columns, and blocks of columns in a
    wide table, are aggregated apart; each part scans only its own columns.
    """
    fields = dict(enumerate(df.schema.fields))
    text = [i for i, f in fields.items() if kind_of(f.dataType) == "string"]
    other = [i for i in fields if i not in text]
    parts = []
    for group, is_text in ((other, False), (text, True)):
        for start in range(0, len(group), cfg.columns_per_pass):
            block = {i: fields[i] for i in group[start:start + cfg.columns_per_pass]}
            stats = _text_stats(df, block, text_rules, sketches, ends) if is_text else _value_stats(df, block, quartiles, sketches, cfg)
            names = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in block.items()]
            schema = df.sparkSession.createDataFrame(names, "ord int, column string, type string, kind string")
            parts.append(_as_stats(stats, schema))
    return reduce(DataFrame.unionByName, parts)


# types of at most eight bytes, which the 64-bit hash maps one to one
SHORT_TYPES = (*INTEGER_TYPES, T.FloatType, T.DoubleType, T.BooleanType, *DATE_TYPES)


def distinct_counts(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """Exact distinct non-null values per column: (column, 128-bit fingerprint) rows, made distinct once and counted.

    Nulls have no first hash and are left out after the rows unfold: a filter within the array would be interpreted for every value.
    """
    if not columns:
        return {}
    types = {f.name: f.dataType for f in df.schema}
    marks = []
    for i, name in enumerate(columns):
        c = finite(tx.ident(name), types[name])
        short = isinstance(types[name], SHORT_TYPES)
        parts = c if short else ", ".join(hash_parts(c, types[name]))
        second = "0L" if short else f"xxhash64(23, {parts})"
        marks.append(f"struct({i} AS ord, CASE WHEN {c} IS NOT NULL THEN xxhash64(11, {parts}) END AS h1, {second} AS h2)")
    values = _long(df, marks).where("h1 IS NOT NULL").distinct()
    found = {r["ord"]: r["n"] for r in values.groupBy("ord").agg(F.count(F.lit(1)).alias("n")).collect()}
    return {c: found.get(i, 0) for i, c in enumerate(columns)}


def with_distinct(df: DataFrame, stats: DataFrame, mode: str = "exact", cfg: LensConfig = DEFAULT) -> DataFrame:
    """Add n_distinct: 'exact' counts every column, 'approx' keeps the sketch of every column."""
    if mode == "approx":
        return stats.withColumn("n_distinct", F.least("approx_distinct", F.col("rows") - F.col("nulls")))
    exact = distinct_counts(df, [r["column"] for r in stats.select("column").collect()])
    return _with_values(stats, {c: (n,) for c, n in exact.items()}, "n_distinct bigint")


def _with_values(stats: DataFrame, values: dict[str, tuple], schema: str) -> DataFrame:
    """Join driver-known figures to the statistics; both sides have one row per column of the schema."""
    known = stats.sparkSession.createDataFrame([(c, *v) for c, v in values.items()], f"column string, {schema}")
    return stats.join(F.broadcast(known), "column", "left")


def with_exact_quartiles(df: DataFrame, stats: DataFrame, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Replace the sketched quartiles of numeric columns by exact ones."""
    numeric = {f.name: finite(tx.ident(f.name), f.dataType) for f in df.schema if kind_of(f.dataType) in NUMERIC_KINDS}
    found = exact_quantiles(df, numeric, [0.25, 0.5, 0.75], cfg)
    return _with_values(stats.drop("q1", "median", "q3"), {c: tuple(q) for c, q in found.items() if q},
                        "q1 double, median double, q3 double")


def count_outside(df: DataFrame, bounds: dict[str, tuple[float, float]]) -> dict[str, int]:
    """Rows outside a pair of bounds, for many columns in one pass."""
    if not bounds:
        return {}
    row = df.agg(*[F.count_if((tx.col(c) < F.lit(lo)) | (tx.col(c) > F.lit(hi))).alias(f"o{i}")
                   for i, (c, (lo, hi)) in enumerate(bounds.items())]).first()
    return {c: row[i] for i, c in enumerate(bounds)}


def fences(quartiles: dict[str, tuple[float, float]], k: float) -> dict[str, tuple[float, float]]:
    """q1 - k*IQR and q3 + k*IQR per column."""
    return {c: (q1 - k * (q3 - q1), q3 + k * (q3 - q1)) for c, (q1, q3) in quartiles.items()}


def with_outliers(df: DataFrame, stats: DataFrame, k: float, cfg: LensConfig = DEFAULT) -> DataFrame:
    """Add lower, upper and n_outside for numeric columns (null where there are no values)."""
    quartiles = {r["column"]: (r["q1"], r["q3"]) for r in stats.select("column", "q1", "q3").collect()
                 if r["q1"] is not None}
    edges = fences(quartiles, k)
    counts = count_outside(df, edges)
    return _with_values(stats, {c: (lo, hi, counts[c]) for c, (lo, hi) in edges.items()},
                        "lower double, upper double, n_outside bigint")


def pinned_stats(df: DataFrame, cfg: LensConfig = DEFAULT, distinct: str = "exact", exact_quartiles: bool | None = True,
                 text_rules: bool = True, outlier_k: float | None = None) -> DataFrame:
    """column_stats with the chosen refinements, run once and kept as a small local table.

    Quartiles are exact, sketched (False) or, for callers that need none, empty (None).
    """
    stats = pin_small(column_stats(df, cfg, text_rules, quartiles=exact_quartiles is False, sketches=distinct == "approx"))
    stats = with_distinct(df, stats, distinct, cfg)
    if exact_quartiles:
        stats = with_exact_quartiles(df, stats, cfg)
    if outlier_k is not None:
        stats = with_outliers(df, stats, outlier_k, cfg)
    return pin_small(stats)
