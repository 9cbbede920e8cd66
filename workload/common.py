"""Helpers shared by the registered queries: tables, derived dirty columns, and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query; ``sql`` states the same result for the SQL engine."""
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def union(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def union_sql(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


def rounded(df: DataFrame, *names: str, digits: int = 4) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


# ---------------------------------------------------------------- dirty lineitem: the same expressions in both engines
# name -> (Spark expression, SQL expression)

def _money(c: str) -> tuple[str, str]:
    return f"CAST(CAST({c} AS DECIMAL(18,2)) AS STRING)", f"CAST(CAST({c} AS DECIMAL(18,2)) AS VARCHAR)"


def _both(template: str, *columns: str) -> tuple[str, str]:
    spark, sql = zip(*[_money(c) for c in columns]) if columns else ((), ())
    return template.format(*spark), template.format(*sql)


LINEITEM_DIRTY: dict[str, tuple[str, str]] = {
    "price_txt": _both("concat('$', {0})", "l_extendedprice"),
    "price_sparse": _both("CASE WHEN l_linenumber = 7 THEN 'N/A' ELSE concat('$', {0}) END", "l_extendedprice"),
    "price_few_na": _both("CASE WHEN l_quantity = 50 THEN 'N/A' ELSE concat('$', {0}) END", "l_extendedprice"),
    "delta_txt": _both("concat('-', {0})", "l_quantity"),
    "mixed_txt": _both("CASE WHEN l_linenumber <= 4 THEN concat('-', {0}) ELSE l_returnflag END", "l_quantity"),
    "flag_pad": _both("concat('  ', l_returnflag, ' ')"),
    "date_us": ("date_format(l_shipdate, 'MM/dd/yyyy')", "strftime(l_shipdate, '%m/%d/%Y')"),
    "empty_col": ("CAST(NULL AS STRING)", "CAST(NULL AS VARCHAR)"),
    "const_col": _both("'NYC'"),
    "const_some": _both("CASE WHEN l_linestatus = 'F' THEN 'NYC' END"),
    "l_quantity.1": _both("l_quantity"),
}
ORDERS_DIRTY: dict[str, tuple[str, str]] = {
    "date_iso": ("date_format(o_orderdate, 'yyyy-MM-dd')", "strftime(o_orderdate, '%Y-%m-%d')"),
    "date_us": ("date_format(o_orderdate, 'MM/dd/yyyy')", "strftime(o_orderdate, '%m/%d/%Y')"),
    "date_mixed": (
        "CASE WHEN o_orderpriority <> '5-LOW' THEN date_format(o_orderdate, 'yyyy-MM-dd') ELSE o_orderpriority END",
        "CASE WHEN o_orderpriority <> '5-LOW' THEN strftime(o_orderdate, '%Y-%m-%d') ELSE o_orderpriority END"),
}


def with_dirty(df: DataFrame, dirty: dict[str, tuple[str, str]]) -> DataFrame:
    return df.selectExpr("*", *[f"{e[0]} AS `{n}`" for n, e in dirty.items()])


def dirty_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_dirty(table(spark, sf_dir, "lineitem"), LINEITEM_DIRTY)


def dirty_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_dirty(table(spark, sf_dir, "orders"), ORDERS_DIRTY)


def _dirty_sql(base: str, dirty: dict[str, tuple[str, str]]) -> str:
    return f"(SELECT *, {', '.join(f'{e[1]} AS \"{n}\"' for n, e in dirty.items())} FROM {base})"


LINEITEM_SQL = _dirty_sql("lineitem", LINEITEM_DIRTY)
ORDERS_SQL = _dirty_sql("orders", ORDERS_DIRTY)


def labelled_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their labels where there are any; lang_some is known for labelled documents only."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return docs.join(labels, "doc_id", "left").withColumn("lang_some", F.when(F.col("quality").isNotNull(), F.col("lang")))


DOCS_SQL = ("(SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, l.quality, l.toxic, "
            "CASE WHEN l.quality IS NOT NULL THEN d.lang END AS lang_some "
            "FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)")


def priced_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with two derived prices that move together."""
    return table(spark, sf_dir, "lineitem").selectExpr(
        "*", "l_extendedprice * (1 - l_discount) AS net", "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross")


PRICED_SQL = ("(SELECT *, l_extendedprice * (1 - l_discount) AS net, "
              "l_extendedprice * (1 - l_discount) * (1 + l_tax) AS gross FROM lineitem)")

SENTINELS_SQL = ("('n/a','na','none','null','nil','nan','unknown','undefined','-','--','?','missing',"
                 "'not available','not applicable','n.a.')")
NUMBER_SQL = r"'^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$'"
CURRENCY_SQL = r"'^\s*[€$£¥₹]?\s*[\d,]+\.?\d*\s*[€$£¥₹]?\s*$'"


def number_sql(c: str) -> str:
    """Text to number in the SQL engine: plain notation only."""
    return f"CASE WHEN regexp_matches({c}, {NUMBER_SQL}) THEN TRY_CAST(trim({c}) AS DOUBLE) END"


def skewness_sql(c: str) -> str:
    return f"round(CASE WHEN NOT isnan(skewness({c})) THEN skewness({c}) END, 4)"
