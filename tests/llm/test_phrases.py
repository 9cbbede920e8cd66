import random
from collections import Counter, defaultdict
from dataclasses import replace

import numpy as np
import pytest

from tablelens.llm import phrases, spread


def pieces(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for end in ".,;:!?\n\v\f\r":
        text = text.replace(end, ".")
    return [[w for w in p.replace("\t", " ").split(" ") if w] for p in text.split(".")]


def brute(rows, rules):
    """Counting, cutting and covering straight from the definition, in whole numbers."""
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for p in pieces(text):
            n[lang] += len(p)
            f[lang].update(tuple(p[i:i + k]) for k in range(1, rules.max_words + 1) for i in range(len(p) - k + 1))
    out = set()
    for lang, counts in f.items():
        cand = {g: a for g, a in counts.items() if len(g) > 1 and a >= rules.min_count}
        inside = lambda g, h: any(h[i:i + len(g)] == g for i in range(len(h) - len(g) + 1))
        best = []
        for g, a in cand.items():
            if any(len(h) > len(g) and 100 * b >= rules.covered_percent * a and inside(g, h) for h, b in cand.items()):
                continue
            cuts = [(1000000 * a * a // (counts[g[:k]] * counts[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            best.append((-score, -a, " ".join(g).encode(), a, counts[g[:k]], counts[g[k:]], score))
        for rank, (_, _, phrase, a, l, r, score) in enumerate(sorted(best)[:rules.keep], 1):
            out.add((lang, rank, phrase.decode(), a, l, r, n[lang], score))
    return out


def corpus(seed, n):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{i}" for i in range(40)] + ["The", "the", "é", "🤖", "x\x00y", "non break"]
    for _ in range(n):
        words = []
        while len(words) < rng.randrange(60):
            words += rng.choice([["New", "York", "City", "Hall"], ["new", "york"], ["a", "a", "a"], ["hot", "dog"]]) if rng.random() < .3 else [
                rng.choice(vocabulary)]
        text = "".join(w + rng.choice([" "] * 8 + ["  ", "\t", ", ", ". ", "\n", "!?"]) for w in words)
        rows.append((rng.choice(["en", "en", "fr", "und", None, ""]), text))
    return rows + [("en", None), (None, ""), ("de", " \t\n.,"), ("en", "hot dog " * 3000), ("en", "hot dog " * 3000)]


@pytest.mark.parametrize("rules", [phrases.Rules(filter_bits=20), phrases.Rules(max_words=4, min_count=4, keep=25, shard_words=300, filter_bits=20),
                                   phrases.Rules(max_words=2, covered_percent=0, shard_words=50, filter_bits=3)])
def test_mined_phrases_match_brute_force(spark, rules):
    rows = corpus(3, 250)
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, a long, phrase string").repartition(3)
    got = [tuple(r) for r in phrases.mine(docs, rules).collect()]
    assert len(got) > 20 and len(set(got)) == len(got) and set(got) == brute(rows, rules)


def test_a_full_filter_and_hot_words_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(spread, "PLAIN_ROWS", 0)
    rows, rules = corpus(4, 150), phrases.Rules(filter_bits=1)
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(2)
    assert {tuple(r) for r in phrases.mine(docs, rules).collect()} == brute(rows, rules)


def test_index_extends_to_both_sides():
    rng = np.random.default_rng(5)
    for depth in (1, 2, 3, 5):
        ids = np.concatenate([[0], rng.integers(0, 4, 200), [0]])
        index, text = phrases.Index(ids, max(1, depth - 1)), ids.tolist()
        found = index.words()
        for n in range(1, depth + 1):
            want = Counter(tuple(text[i:i + n]) for i in range(len(text) - n + 1) if 0 not in text[i:i + n])
            assert {tuple(g): c for g, c in zip(found.ids.tolist(), found.count.tolist())} == want
            if n < depth:
                found = index.extended(found, bool(rng.integers(2)))


def test_tables_without_phrases(spark, odd, empty):
    small = replace(phrases.Rules(), filter_bits=20)
    assert phrases.mine(empty, small).count() == 0
    assert {(r.lang, r.phrase) for r in phrases.mine(odd, small).collect()} == {("en", "lorem ipsum lorem"), ("en", "ipsum lorem ipsum")}
