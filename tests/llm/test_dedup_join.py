import random
from collections import defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import exact_dedup, graph, ngram_join, spread
from llm_rows import ROWS, blank_words


def brute_groups(rows):
    """doc -> (set size, smallest linked doc), all pairs compared."""
    sets = {}
    for doc, text in rows:
        w = blank_words(text)
        sets[doc] = {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    root = {d: d for d in sets}

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            a, b = sorted((top(a), top(b)))
            root[b] = a
    return {d: (len(sets[d]), top(d)) for d in sets}


def test_exact_groups_of_odd_rows(odd, empty):
    out = [tuple(r) for r in exact_dedup.exact_groups(odd).collect()]
    assert len(out) == len(ROWS)
    by_text = defaultdict(list)
    for doc, keep, size, kept, digest in out:
        by_text[digest].append((doc, keep, size, kept))
    for group in by_text.values():
        ids = [d for d, *_ in group if d is not None]
        assert {(k, s) for _, k, s, _ in group} == {(min(ids) if ids else None, len(group))}
        assert [d for d, *_, kept in group if kept] == [min(ids) if ids else None]
    assert sorted(len(g) for g in by_text.values()) == [1, 1, 1, 2, 3, 4]
    assert exact_dedup.exact_groups(empty).count() == 0


def test_texts_under_one_digest_are_told_apart(odd):
    want = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_groups(odd).collect()}
    same = exact_dedup.exact_groups(odd, digest=lambda b: F.substring(F.sha2(b, 256), 1, 0))
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in same.collect()} == want


def test_drop_copies_keeps_one_whole_row_of_each(odd, empty):
    out = exact_dedup.drop_copies(odd)
    assert out.columns == odd.columns and out.count() == 6
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 5, 6, 8, 9]
    assert exact_dedup.drop_copies(empty).count() == 0


def test_clashing_columns_stay(spark):
    rows = [(1, "a b", "x", "y"), (2, "a  b", "z", "w"), (2, "other", "u", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _llm_text string, _LLM_ID string")
    out = exact_dedup.drop_copies(docs)
    assert out.columns == docs.columns and sorted(tuple(r) for r in out.collect()) == [rows[0], rows[2]]


def test_hot_copies(spark):
    docs = spark.range(9000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("t"), F.col("id"))).alias("text"))
    kept = exact_dedup.exact_groups(docs).where("kept")
    assert kept.count() == 6001 and kept.where("group_size = 3000").first().keep_id == 0


@pytest.mark.parametrize("plain", [20_000, 0])
def test_components_match_union_find(spark, monkeypatch, plain):
    monkeypatch.setattr(spread, "PLAIN_ROWS", plain)
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(20)] + [(1000, 1000 + i) for i in range(1, 200)]
    links += [(rng.randrange(2000, 2600), rng.randrange(2000, 2600)) for _ in range(300)]
    root = {n: n for link in links for n in link}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        root[b] = a
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: top(n) for link in links if link[0] != link[1] for n in link}


def mutated(words, rng, share):
    return " ".join(rng.choice("uvwxyz") * 3 if rng.random() < share else w for w in words)


def test_similar_groups_match_all_pairs(spark):
    rng = random.Random(7)
    fresh = lambda n: ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(n)]
    passage, base = fresh(60), fresh(90)
    texts = [" ".join(fresh(rng.randrange(1, 80))) for _ in range(40)]
    texts += [" ".join(fresh(rng.randrange(0, 40)) + passage + fresh(rng.randrange(0, 40))) for _ in range(60)]  # a shared passage
    texts += [mutated(base, rng, 0.004 * i) for i in range(12)] * 3  # near and exact copies
    texts += [" ".join(base[:n]) for n in (66, 67, 68, 69, 70, 88)]  # sizes at the limit
    texts += ["one two", "ONE two", "one two three four five", "", None, "  "]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == brute_groups(rows)


def test_similar_groups_of_odd_rows(odd, empty):
    out = sorted((tuple(r) for r in ngram_join.similar_groups(odd).collect()), key=str)
    assert len(out) == len(ROWS) and ngram_join.similar_groups(empty).count() == 0
    assert (6, 2, 6) in out and (7, 2, 6) in out and (2, 1, 1) in out and (None, 1, 1) in out and (3, 0, 3) in out
    kept = ngram_join.one_of_each_group(odd)
    assert kept.columns == odd.columns and {2, 7}.isdisjoint(r.doc_id for r in kept.collect())


def test_bounds_never_exclude_alike_sets():
    rng, like = np.random.default_rng(1), ngram_join.Likeness()
    for _ in range(300):
        n = int(rng.integers(1, 200))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        cut = a[rng.random(len(a)) > rng.uniform(0, 0.3)]
        b = np.unique(np.concatenate([cut, rng.integers(0, 1 << 60, int(rng.integers(0, 20))).astype(np.uint64)]))
        if not len(b):
            continue
        both, width = len(np.intersect1d(a, b)), 256
        alike = 100 * both >= 75 * (len(a) + len(b) - both)
        assert ngram_join.alike(a, b, ngram_join.bitmap(a, width), ngram_join.bitmap(b, width), like) == alike
        if alike:  # prefixes by value share as many as the lemma says, and bands touch
            x, y = a[:like.prefix(np.int64(len(a)))], b[:like.prefix(np.int64(len(b)))]
            assert len(np.intersect1d(x, y)) >= like.shared(np.int64(len(a)), np.int64(len(b))) >= 1
            assert abs(int(like.band(np.array([len(a)]))[0]) - int(like.band(np.array([len(b)]))[0])) <= 1
