"""Exact deduplication by skew-safe combining.

Copies are combined inside each task first, then across tasks within salted digest groups, then over the salts. Every one of
these stages groups by the whole text besides its digest, so that it is the texts that are compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.spread import attach, read, written

#: Parts into which the copies of one text are dealt before their winners meet.
SALTS = 16


def plain_spaces(text: Column) -> Column:
    """Each run of white space as one space; single spaces, by far the most, are not touched."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), "[\t-\r ][\t-\r ]+|[\t-\r]", " ")


def sha256(body: Column) -> Column:
    return F.sha2(body, 256)


def _combine(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.min("keep_id").alias("keep_id"), F.sum("n").alias("n"))


def _winners(base: DataFrame) -> DataFrame:
    """One row per distinct text: digest, body, keep_id, n."""
    local = base.select("digest", "body", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("n"),
                        F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    salted = _combine(local, "digest", "salt", "body")  # Spark combines within tasks before it deals by digest and salt
    return _combine(salted.repartition("digest"), "digest", "body")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest=sha256) -> DataFrame:
    """One row per document with the group of its equal texts: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when they are after each run of white space is made one space; null counts as empty. Of a group the row with
    the smallest doc_id is kept; if rows repeat that doc_id, one of them; null ids come last. Other columns are not read. An
    empty table gives no rows.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), plain_spaces(F.col(text_col)).alias("body"))
    base = base.select("doc_id", "body", digest(F.col("body")).alias("digest"))
    per_digest = written(_winners(base).groupBy("digest").agg(
        F.count(F.lit(1)).alias("texts"), F.min("keep_id").alias("keep_id"), F.sum("n").alias("group_size")))
    shape = per_digest.agg(F.coalesce(F.sum("group_size"), F.lit(0)).alias("rows"), F.max("texts").alias("texts")).first()
    one = per_digest.where("texts = 1").drop("texts")
    found = attach(base.select("doc_id", "digest"), one, "digest", "group_size", shape["rows"])
    if (shape["texts"] or 0) > 1:  # different texts share a digest: they are told apart by content once more
        shared = per_digest.where("texts > 1").select(F.col("digest").alias("d"))
        theirs = base.join(shared, F.col("digest") == F.col("d"), "left_semi")
        groups = _winners(theirs).select(F.col("digest").alias("d"), F.col("body").alias("b"), "keep_id",
                                         F.col("n").alias("group_size"))
        apart = theirs.join(groups, (F.col("digest") == F.col("d")) & (F.col("body") == F.col("b")))
        found = (found.where(F.col("group_size").isNotNull())
                 .unionByName(apart.select("doc_id", "digest", "keep_id", "group_size")))
    same = Window.partitionBy("digest", "doc_id").orderBy("keep_id")
    return found.select("doc_id", "keep_id", "group_size",
                        (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.row_number().over(same) == 1)).alias("kept"),
                        F.col("digest").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, of which exact_groups keeps one of each group.

    Null and empty texts are equal, so one row of these stays. Of rows that repeat the kept id with an equal text one stays; a row with that id
    and another text is of another group. Null ids stay only where a group has no other. An empty table stays empty.
    """
    text, own = _free("_llm_text", docs.columns), _free("_llm_id", docs.columns)
    kept = exact_groups(docs, id_col, text_col).where("kept").select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).alias(own), F.col("text_sha256").alias(text))
    rows = docs.withColumn(text, sha256(plain_spaces(F.col(text_col)))).withColumn(own, F.coalesce(F.col(id_col).cast("string"), F.lit("-")))
    return rows.join(kept, [own, text], "left_semi").dropDuplicates([own, text]).select(*[F.col(f"`{c}`") for c in docs.columns])


def _free(name: str, taken: list[str]) -> str:
    """A column name that is not taken yet, whatever its case."""
    while name.lower() in map(str.lower, taken):
        name = f"_{name}"
    return name


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(read(spark, sf_dir, "documents"))


OP3_SQL = """
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[ \\t\\n\\v\\f\\r]+', ' ', 'g')) AS h FROM documents),
g AS (SELECT h, min(doc_id) AS keep_id, count(*) AS group_size FROM t GROUP BY h)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, t.h AS text_sha256 FROM t JOIN g ON t.h = g.h
"""
