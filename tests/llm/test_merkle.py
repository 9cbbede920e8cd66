import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tablelens.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, g string, pos long, hash string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf(row, lower=False):
    doc, source, lang, n, text = row
    if lower and text is not None:
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc, source, lang, n, text)))


def tree(digests, fanout=8):
    """The root of a list, and of each element the lists of runs that it goes through with its place in each."""
    paths, level, owners = [[] for _ in digests], list(digests), [[i] for i in range(len(digests))]
    while len(level) > 1:
        up, up_owners = [], []
        for at in range(0, len(level), fanout):
            run = level[at:at + fanout]
            for k in range(len(run)):
                for i in owners[at + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1:])))
            up.append(sha("".join(run)))
            up_owners.append([i for part in owners[at:at + fanout] for i in part])
        level, owners = up, up_owners
    return level[0], paths


def brute(rows):
    groups = defaultdict(list)
    for row in rows:
        groups[row[2]].append(row)
    langs = sorted(groups, key=lambda v: (v is not None, (v or "").encode()))
    roots, found = [], []
    for lang in langs:
        mine = sorted(groups[lang], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        root, paths = tree([leaf(r) for r in mine])
        roots.append(root)
        found.append((mine, paths))
    root, over = tree(roots)
    for (mine, paths), subroot, more in zip(found, roots, over):
        for row, path in zip(mine, paths):
            path, tampered = path + more, row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            fold = leaf(row, tampered)
            for before, after in path:
                fold = sha(before + fold + after)
            yield row[0], leaf(row), subroot, root, sha("".join(b + a for b, a in path)), fold, fold == root


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    text = lambda: rng.choice([None, "", "Ab c", "éT\n", "plain", "X" * 3000])
    out = [(i, "s", "en", i % 5, text()) for i in range(150)] + [(i, None, None, None, text()) for i in range(65)]
    out += [(i, "s1", f"l{i}", 2, "Tt") for i in range(11)] + [(i, "s", "ñ", 1, text()) for i in range(8)]
    out += [(1, "s", "en", 1, "Same"), (1, "s", "en", 1, "Same"), (1, "s", "en", 1, "Other"), (None, None, "en", None, None), (3, "s", "", 3, "T")]
    rng.shuffle(out)
    return out


def test_manifest_matches_brute_force(spark, rows, tmp_path):
    docs = spark.createDataFrame([(*r, "x", 0, "y") for r in rows], SCHEMA).repartition(4)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in merkle.op11(spark, str(tmp_path)).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


def test_other_fanouts_groups_and_fields(spark, rows):
    docs = spark.createDataFrame([(r[0], r[2], r[4]) for r in rows], "name long, kind string, body string")
    made = merkle.manifest(docs, ("name", "body"), "name", "kind", fanout=3)
    seen = made.rows.select(merkle.folded(F.col("leaf"), F.col("path")).alias("root"), "other").distinct().collect()
    assert [tuple(r) for r in seen] == [(made.root, None)] and made.rows.count() == len(rows)
    sizes = {r.lang: r.members for r in made.groups.collect()}
    assert sizes["en"] == 154 and sizes[None] == 65 and sizes[""] == 1 and len(sizes) == 15


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(7, None, None, None, "t", None, None, None)], SCHEMA)
    made = merkle.manifest(one)
    row = made.rows.first()
    assert row.leaf == row.subroot == made.root == leaf((7, None, None, None, "t")) and row.path == []
    none = merkle.manifest(one.limit(0))
    assert none.root is None and none.rows.count() == 0 and none.groups.count() == 0
