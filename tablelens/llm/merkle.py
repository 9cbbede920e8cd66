"""Merkle manifest of a dataset by slot pivot: digests of rows, of groups and of all, and what proves that a row belongs to them.

Nodes of one level are numbered without gaps in each group. Conditional aggregates spread the children of a parent into one column for
each slot; the columns one after another are hashed to the parent, and without a child's own column they are its siblings. Going up, a
level has an eighth of the rows of the one below; going down, each parent hands its path to its children once.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.spread import read, written

#: The columns of documents that make a leaf, in this order.
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_STEP = "array<struct<before: string, after: string>>"


@dataclass(frozen=True)
class Manifest:
    """rows: one per input row with doc_id, leaf, other, subroot and path; root is None for an empty table."""

    rows: DataFrame
    groups: DataFrame
    root: str | None


def leaf(values: list[Column]) -> Column:
    """The digest of a row: of each value its count of UTF-8 bytes, a colon and itself, or - for null."""
    texts = [v.cast("string") for v in values]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.sha2(F.concat(*parts), 256)


def ranked(nodes: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Adds pos, the place of a row in its group from 0, and members, the size of the group, without a group in one task.

    Spark sorts the whole table by ranges, so a task holds some of a group's rows in order; how many rows of the group the tasks before
    it hold is counted by task and group. ``order`` must tell rows apart, so that ranges can cut groups of any size.
    """
    cut = written(nodes.orderBy(group, *order).withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftrightunsigned("_at", 33)
    pieces = cut.groupBy(F.col(group).alias("_g"), part.alias("_part")).agg(F.min("_at").alias("_low"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("_g").orderBy("_part")
    pieces = written(pieces).select("_g", "_part", "_low", F.sum("_n").over(Window.partitionBy("_g")).alias("members"),
                                    (F.sum("_n").over(before) - F.col("_n")).alias("_first"))
    placed = cut.withColumn("_p", part).join(pieces, (F.col(group) == F.col("_g")) & (F.col("_p") == F.col("_part")))
    return placed.withColumn("pos", F.col("_at") - F.col("_low") + F.col("_first")).drop("_at", "_p", "_g", "_part", "_low", "_first")


def _families(nodes: DataFrame, fanout: int) -> DataFrame:
    """g, pos, members of the parents of ``nodes``, with their children in the columns s0, s1, ... and their digest."""
    slot = F.pmod("pos", F.lit(fanout))
    inner = [c for c in nodes.columns if c not in ("g", "pos", "members")]
    spread = [F.max(F.when(slot == k, F.struct(*inner))).alias(f"s{k}") for k in range(fanout)]
    parent = F.expr(f"pos div {fanout}")
    up = nodes.groupBy("g", parent.alias("pos")).agg(F.max("members").alias("of"), *spread)
    children = [F.coalesce(F.col(f"s{k}.hash"), F.lit("")) for k in range(fanout)]
    return up.withColumn("members", F.expr(f"(of + {fanout - 1}) div {fanout}")).drop("of").withColumn("hash", F.sha2(F.concat(*children), 256))


def _children(families: DataFrame, fanout: int) -> DataFrame:
    """The children of families that know their own path, each with the path from itself to the root."""
    text = [F.coalesce(F.col(f"s{k}.hash"), F.lit("")) for k in range(fanout)]
    rows = []
    for k in range(fanout):
        step = F.struct(F.concat(F.lit(""), *text[:k]).alias("before"), F.concat(F.lit(""), *text[k + 1:]).alias("after"))
        rows.append(F.struct((F.col("pos") * fanout + k).alias("pos"), F.col(f"s{k}").alias("node"),
                             F.concat(F.array(step), F.col("path")).alias("path")))
    each = families.select("g", "top", F.explode(F.filter(F.array(*rows), lambda r: r["node"].isNotNull())).alias("c"))
    return each.select("g", "top", "c.pos", "c.node.*", "c.path")


def _climb(nodes: DataFrame, most: int, fanout: int) -> tuple[list[DataFrame], DataFrame]:
    """Families of every level, and the last node (g, hash, height) of every group; ``most`` is the size of the largest group."""
    levels, tops, height = [], [], 0
    while True:
        tops.append(nodes.where("members = 1").select("g", "hash", F.lit(height).alias("height")))
        if most <= 1:
            break
        families = written(_families(nodes.where("members > 1"), fanout))
        levels.append(families)
        nodes = families.select("g", "pos", "members", "hash")
        most, height = math.ceil(most / fanout), height + 1
    top = tops[0]
    for t in tops[1:]:
        top = top.unionByName(t)
    return levels, written(top)


def _descend(leaves: DataFrame, levels: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame:
    """The leaves with their path; ``tops`` has each group's last node with its own path (g, top, height, path)."""
    def last(height: int) -> DataFrame:
        return tops.where(F.col("height") == height).select("g", F.lit(0).cast("long").alias("pos"), "top", "path")

    above = last(len(levels))
    for height in range(len(levels) - 1, -1, -1):
        known = levels[height].drop("hash", "members").join(above, ["g", "pos"])
        above = _children(known, fanout)
        if height:
            above = written(above.select("g", "pos", "top", "path").unionByName(last(height)))
    alone = leaves.where("members = 1").drop("members", "pos").join(last(0).drop("pos"), "g")
    return alone if not levels else alone.unionByName(above.drop("pos").select(*alone.columns))


def manifest(docs: DataFrame, fields: tuple[str, ...] = FIELDS, id_col: str = "doc_id", group_col: str = "lang", fanout: int = 8,
             other: Column | None = None) -> Manifest:
    """Digests of all rows, groups and the table, and of every row the path that leads from it to the root.

    ``rows`` has doc_id, leaf, subroot, path (an array from the leaf up, of the digests that stand before and after the node among its
    siblings) and other, the digest that the columns in ``other`` (a struct like the fields) make, or null. ``groups`` has lang,
    subroot, members. In a group, leaves ascend by id (null first) and then by digest, so repeated ids and rows have a fixed order and
    are leaves of their own. Null groups are a group, before all others. Nulls and empty texts have digests that differ. Texts are
    hashed whole where they are read and no more is shuffled than digests. An empty table has no rows and no root; other columns
    are not read.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))  # in the order of the bytes, null first
    changed = F.lit(None).cast("string") if other is None else F.when(other.isNotNull(), leaf([other.getField(f) for f in fields]))
    leaves = docs.select(group.alias("g"), F.col(id_col).alias("doc_id"), leaf([F.col(f) for f in fields]).alias("hash"), changed.alias("other"),
                         F.monotonically_increasing_id().alias("_tie"))
    leaves = written(ranked(written(leaves), "g", ["doc_id", "hash", "_tie"]).drop("_tie"))
    most = leaves.agg(F.max("members")).first()[0] or 0
    levels, subroots = _climb(leaves, most, fanout)

    over = ranked(subroots.select(F.lit("").alias("all"), "g", "hash"), "all", ["g"])  # the groups are the leaves of one more tree
    over = written(over.select(F.col("all").alias("g"), "pos", "members", "hash", F.col("g").alias("own")))
    upper, last = _climb(over, over.count(), fanout)
    ends = last.withColumn("top", F.col("hash")).withColumn("path", F.array().cast(_STEP)).drop("hash")
    of_group = written(_descend(over, upper, ends, fanout).select(F.col("own").alias("g"), F.col("hash").alias("top"), "path"))

    tops = written(subroots.select("g", "height").join(of_group, "g"))
    rows = _descend(leaves, levels, tops, fanout)
    root = last.first()
    names = leaves.groupBy("g").agg(F.max("members").alias("members")).join(of_group.select("g", "top"), "g")
    groups = names.select(F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias("lang"), F.col("top").alias("subroot"), "members")
    return Manifest(rows.select("doc_id", F.col("hash").alias("leaf"), "other", F.col("top").alias("subroot"), "path"), groups,
                    root and root["hash"])


def proof(path: Column) -> Column:
    """The siblings of a row, level by level from left to right, as one text."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["before"], s["after"])), "")


def folded(digest: Column, path: Column) -> Column:
    """The root that a leaf's digest leads to along a path."""
    return F.aggregate(path, digest, lambda below, s: F.sha2(F.concat(s["before"], below, s["after"]), 256))


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    tampered = [F.translate("text", upper, lower).alias("text") if f == "text" else F.col(f) for f in FIELDS]
    struck = F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 0, F.struct(*tampered))
    made = manifest(docs, other=struck)
    seen = made.rows.select("doc_id", "leaf", "subroot", F.lit(made.root).alias("root"), F.sha2(proof(F.col("path")), 256).alias("proof_sha256"),
                            folded(F.coalesce("other", "leaf"), F.col("path")).alias("folded_root"))
    return seen.withColumn("verified", F.col("folded_root") == F.col("root"))


def _crc32_sql(text: str) -> str:
    """crc32 of ASCII text: for each character one step that adds it and eight that shift."""
    steps = (f"flatten(list_transform(range(1, length({text}) + 1), lambda i: "
             f"list_concat([ord(substr({text}, i, 1))::BIGINT], [-1, -1, -1, -1, -1, -1, -1, -1]::BIGINT[])))")
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    return f"xor(list_reduce(list_concat([4294967295]::BIGINT[], {steps}), lambda c, x: {step}), 4294967295)"


def _leaf_sql(text: str) -> str:
    fields = [f"coalesce(octet_length(encode({v}::VARCHAR)) || ':' || {v}::VARCHAR, '-')"
              for v in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(fields)})"


OP11_SQL = f"""
WITH RECURSIVE d AS (SELECT doc_id, lang, {_leaf_sql('text')} AS leaf,
    CASE WHEN {_crc32_sql("doc_id::VARCHAR")} % 3 = 0
    THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS members,
    dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS g FROM d),
lv AS (SELECT 0 AS height, g, pos, leaf AS hash, members FROM r
    UNION ALL SELECT height + 1, g, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (members + 7) // 8 FROM lv
    WHERE members > 1 GROUP BY height, g, pos // 8, members),
s AS (SELECT g, hash AS subroot FROM lv WHERE members = 1),
up AS (SELECT 0 AS height, g AS pos, subroot AS hash, count(*) OVER () AS members FROM s
    UNION ALL SELECT height + 1, pos // 8, sha256(string_agg(hash, '' ORDER BY pos)), (members + 7) // 8 FROM up
    WHERE members > 1 GROUP BY height, pos // 8, members),
steps AS (SELECT a.height, a.g, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM lv a JOIN lv b ON a.height = b.height AND a.g = b.g AND a.pos // 8 = b.pos // 8 WHERE a.members > 1 GROUP BY 1, 2, 3),
usteps AS (SELECT a.height, a.pos, coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos < a.pos), '') AS l,
    coalesce(string_agg(b.hash, '' ORDER BY b.pos) FILTER (b.pos > a.pos), '') AS r
    FROM up a JOIN up b ON a.height = b.height AND a.pos // 8 = b.pos // 8 WHERE a.members > 1 GROUP BY 1, 2),
walk AS (SELECT r.*, 0 AS height, pos AS own, coalesce(other, leaf) AS fold, '' AS proof FROM r
    UNION ALL SELECT w.* EXCLUDE (height, own, fold, proof), w.height + 1, w.own // 8, sha256(t.l || w.fold || t.r), w.proof || t.l || t.r
    FROM walk w JOIN steps t ON t.height = w.height AND t.g = w.g AND t.pos = w.own),
ends AS (SELECT * FROM walk QUALIFY height = max(height) OVER (PARTITION BY g)),
walk2 AS (SELECT doc_id, leaf, g, row_number() OVER () AS n, 0 AS height, g AS own, fold, proof FROM ends
    UNION ALL SELECT w.doc_id, w.leaf, w.g, w.n, w.height + 1, w.own // 8, sha256(t.l || w.fold || t.r), w.proof || t.l || t.r
    FROM walk2 w JOIN usteps t ON t.height = w.height AND t.pos = w.own)
SELECT doc_id, leaf, subroot, top.hash AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = top.hash AS verified
FROM (SELECT * FROM walk2 QUALIFY height = max(height) OVER ()) e JOIN s ON s.g = e.g, (SELECT hash FROM up WHERE members = 1) top
"""
