"""SQL expressions over text: emptiness words, currency, numbers, booleans and dates.

Every function takes and returns SQL text, so that a table with hundreds of columns needs one parse per column
and not thousands of driver calls. ``col`` and ``sql`` turn names and expressions into Columns.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablelens import fixed_values as fv


def ident(name: str) -> str:
    """A column name as a quoted identifier, whatever characters it holds."""
    return "`" + name.replace("`", "``") + "`"


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def col(name: str) -> Column:
    return F.col(ident(name))


def sql(expression: str) -> Column:
    return F.expr(expression)


def _in_words(c: str, words: tuple[str, ...]) -> str:
    return f"lower(trim({c})) IN ({', '.join(literal(w) for w in words)})"


def is_sentinel(c: str) -> str:
    return _in_words(c, fv.SENTINEL_WORDS)


def blank_sentinels(c: str) -> str:
    return f"CASE WHEN NOT ({is_sentinel(c)}) THEN {c} END"


def is_boolean_word(c: str) -> str:
    return _in_words(c, fv.BOOLEAN_WORDS)


def looks_like_currency(c: str) -> str:
    return f"{c} RLIKE {literal(fv.CURRENCY_SHAPE)}"


def without_currency_noise(c: str) -> str:
    return f"translate({c}, {literal(fv.CURRENCY_NOISE_CHARS)}, '')"


def _number_among(noise: str) -> str:
    """A number with the given characters allowed anywhere in it: what removing them first would accept."""
    n, d = f"[{noise}]*", f"[{noise}\\d]*"
    return rf"{n}([+-]{n})?(\d{d}(\.{d})?|\.{n}\d{d})([eE]{n}([+-]{n})?\d{d})?"


def casts_as_currency(c: str) -> str:
    """parse_currency gives a number, tested on the text as it is."""
    return f"{c} RLIKE {literal('^' + _number_among(fv.CURRENCY_NOISE) + '$')}"


def casts_as_number(c: str) -> str:
    """parse_grouped_number gives a number, tested on the text as it is."""
    return f"{c} RLIKE {literal('^[,' + chr(92) + 's]*' + _number_among(',') + '[,' + chr(92) + 's]*$')}"


def could_be_listed_word(c: str) -> str:
    """Cheap first test: no longer than the longest listed word."""
    return f"length(trim({c})) <= {max(map(len, fv.SENTINEL_WORDS + fv.BOOLEAN_WORDS))}"


def is_listed_word(c: str) -> str:
    return _in_words(c, fv.SENTINEL_WORDS + fv.BOOLEAN_WORDS)


def may_be_number_or_date(c: str) -> str:
    """Cheap first test: numbers, amounts and dates never start with an ASCII letter."""
    return f"ascii(ltrim({c})) NOT BETWEEN 58 AND 127"


def is_plain_number(c: str) -> str:
    """Digits with an optional point, after a sign or a currency symbol or neither: by far the most frequent shapes, told by one pattern."""
    return f"{c} RLIKE '^[-+€$£¥₹]?[0-9]{{1,15}}([.][0-9]{{1,15}})?$'"


def starts_like_date(c: str) -> str:
    """Up to four digits and a mark between parts of a date; no amount or number has that."""
    return f"{c} RLIKE {literal(chr(94) + chr(92) + 's*[0-9]{1,4}[-/]')}"


def year_first(c: str) -> str:
    return f"ltrim({c}) RLIKE '^[0-9]{{4}}'"


def parse_number(c: str) -> str:
    """Text to double; anything that is not a plain number is null."""
    return f"CASE WHEN {c} RLIKE {literal(fv.NUMBER_SHAPE)} THEN try_cast(trim({c}) AS DOUBLE) END"


def parse_currency(c: str) -> str:
    return parse_number(without_currency_noise(c))


def parse_grouped_number(c: str) -> str:
    return parse_number(f"replace({c}, ',', '')")


def parse_date(c: str, fmt: str) -> str:
    """Text to timestamp (without zone) in one of the fixed formats; anything else is null.

    The text is rewritten to ISO and cast, so the conversion stays in generated code.
    """
    shape, rewrite = next((s, r) for f, s, r in fv.DATE_FORMATS if f == fmt)
    t = f"trim({c})"
    iso = t if rewrite is None else f"regexp_replace({t}, {literal(shape)}, {literal(rewrite)})"
    mark = next((m for m in "/-" if m in fmt), None)
    cheap = f"contains({c}, '{mark}')" if mark else f"length({t}) = 8"
    return f"CASE WHEN {cheap} AND {t} RLIKE {literal(shape)} THEN try_cast({iso} AS TIMESTAMP_NTZ) END"


def is_date(c: str, fmt: str) -> str:
    """parse_date gives a date; of formats without a time told by a pattern alone, as rewriting and casting take several times as long."""
    shape = fv.EXISTING_DATES.get(fmt)
    return f"trim({c}) RLIKE {literal(shape)}" if shape else f"{parse_date(c, fmt)} IS NOT NULL"


def parse_any_date(c: str) -> str:
    return "coalesce(" + ", ".join(parse_date(c, f) for f, _, _ in fv.DATE_FORMATS) + ")"
