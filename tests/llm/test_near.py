"""The n-gram join on families of near copies: no rows per pair, tasks of a bounded size, and rows told apart by id and text."""

import random

import numpy as np
import pytest

from tablelens.llm import ngram_join, spread
from test_dedup_join import blank_words, brute_groups, mutated


def family(rng, size, words=120, changed=3):
    base = ["".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(words)]
    out = []
    for _ in range(size):
        copy = list(base)
        for at in rng.sample(range(words), changed):
            copy[at] = "".join(rng.choice("uvwxyz") for _ in range(6))
        out.append(" ".join(copy))
    return base, out


def counted_links(monkeypatch):
    seen = []
    real = ngram_join.remaining_links

    def spy(*args):
        links = real(*args)
        seen.append(links.count())
        return links

    monkeypatch.setattr(ngram_join, "remaining_links", spy)
    return seen


@pytest.mark.parametrize("base_at", ["last", "none"])
def test_a_large_family_leaves_no_rows_per_pair(spark, monkeypatch, base_at):
    rng = random.Random(4)
    base, copies = family(rng, 700)
    texts = {"first": [" ".join(base), *copies], "last": [*copies, " ".join(base)], "none": copies}[base_at]
    seen = counted_links(monkeypatch)
    pairs = []
    real = ngram_join.first_pairs
    monkeypatch.setattr(ngram_join, "first_pairs", lambda *a: pairs.append(real(*a)) or pairs[-1])
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    out = ngram_join.similar_groups(docs).collect()
    assert pairs[0].count() <= 3 * len(texts) and seen[0] <= len(texts)
    if base_at != "none":
        assert {r.component_id for r in out} == {0}
    else:
        assert {r.doc_id: (r.n_shingles, r.component_id) for r in out} == brute_groups(list(enumerate(texts)))


@pytest.mark.parametrize("blocks", [(4096, 16 << 20), (7, 4000)])
def test_links_found_in_tasks_alone(spark, monkeypatch, blocks):
    """Without first pairs, all links come from the tasks; with small blocks, from many of them."""
    monkeypatch.setattr(ngram_join, "BLOCK_ROWS", blocks[0])
    monkeypatch.setattr(ngram_join, "TILE_BYTES", blocks[1])
    real = ngram_join.first_pairs
    monkeypatch.setattr(ngram_join, "first_pairs", lambda *a: real(*a).limit(0))
    seen = counted_links(monkeypatch)
    rng = random.Random(9)
    texts = []
    for k in range(4):
        base, copies = family(rng, 25, 60 + 10 * k, 1 + k)
        texts += [*copies, " ".join(base), " ".join(base[:50 + 5 * k])]
    texts += [mutated(base, rng, 0.01 * i) for i in range(30)]
    texts += [" ".join("".join(rng.choice("abcd") for _ in range(3)) for _ in range(rng.randrange(90))) for _ in range(40)]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == brute_groups(rows) and seen[0] > 20


@pytest.mark.parametrize("limit", [1, 10**9])  # every shingle by its counts, and none
def test_hot_shingles(spark, monkeypatch, limit):
    monkeypatch.setattr(spread, "PLAIN_ROWS", 0)
    real = ngram_join.postings
    monkeypatch.setattr(ngram_join, "postings", lambda cards, counts, _: real(cards, counts, limit))
    rng = random.Random(8)
    rows = list(enumerate([t for k in range(3) for t in family(rng, 20, 50 + k)[1]] + ["the same few words here again"] * 30))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(docs).collect()}
    assert got == brute_groups(rows)


def test_a_tile_joins_what_is_alike():
    rng, like = np.random.default_rng(2), ngram_join.Likeness()
    base = np.unique(rng.integers(0, 1 << 60, 90).astype(np.uint64))
    sets = [np.sort(base[rng.random(len(base)) > 0.09]) for _ in range(60)] + [np.unique(rng.integers(0, 1 << 60, 70).astype(np.uint64))]
    sizes = np.array([len(s) for s in sets])
    bits = [ngram_join.bitmap(s, ngram_join._width(len(s))) for s in sets]
    tile = ngram_join.Tile(np.arange(61) + 100, sizes, bits, np.arange(61), like, sets)
    tile.run(np.arange(61), sizes, None)
    marked = ngram_join.Tile(np.arange(61) + 100, sizes, bits, np.arange(61), like, None)
    marked.run(np.arange(61), sizes, None)
    want = list(range(61))
    for a in range(61):
        for b in range(a):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both) and want[a] != want[b]:
                want = [want[a] if g == want[b] else g for g in want]
    assert len(np.unique(tile.group)) == len(set(want)) == 61 - len(tile.links)
    assert all(len({want[x - 100], want[y - 100]}) == 1 for x, y in tile.links)
    assert all(marked.maybe[x - 100] and marked.maybe[y - 100] for x, y in tile.links) and not marked.maybe[60]


def test_one_row_of_each_group_stays(spark):
    a, near = " ".join(f"w{i}" for i in range(40)), " ".join(f"w{i}" for i in range(41))
    other, far = " ".join(f"v{i}" for i in range(40)), " ".join(f"u{i}" for i in range(40))
    rows = [(1, a, 0, "x"), (5, a, 1, "x"), (5, other, 2, "x"), (7, near, 3, "x"), (2, far, 4, "x"), (2, far, 5, "x"), (None, a, 6, "x"),
            (None, "z y x", 7, "x"), (None, "z y x", 8, "x"), (None, None, 9, "x"), (3, "", 10, "x"), (3, "", 11, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node long, m1 string").repartition(3)
    kept = ngram_join.one_of_each_group(docs)
    assert kept.columns == docs.columns
    out = sorted((r.doc_id is None, r.doc_id, blank_words(r.text)[:1]) for r in kept.collect() if r.doc_id is not None)
    assert out == [(False, 1, ["w0"]), (False, 2, ["u0"]), (False, 3, []), (False, 3, []), (False, 5, ["v0"])]
    assert sorted((r.text or "") for r in kept.where("doc_id IS NULL").collect()) == ["", "z y x"]
