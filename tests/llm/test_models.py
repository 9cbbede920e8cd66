import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tablelens.llm import context_tree, toxicity
from llm_rows import ROWS, blank_words


def held(doc, parts):
    return zlib.crc32(str(doc).encode()) % parts


def events(text, depth):
    data = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode()
    s = [256] * depth + list(data) + [256]
    for i in range(depth, len(s)):
        for turn in range(9 if s[i] < 256 else 1):
            yield tuple(s[i - depth:i][::-1]), (1 << turn) | (s[i] >> (9 - turn)), (s[i] >> (8 - turn)) & 1


def brute_tree(rows, depth):
    """log10 probabilities by dictionaries of nodes and the recursive definition of the weighted probability."""
    seen, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for doc, text in rows:
        if held(doc, 7) != 2:
            for context, node, bit in events(text, depth):
                for k in range(depth + 1):
                    seen[context[:k], node][bit] += 1
                    if k < depth:
                        children[context[:k], node].add(context[:k + 1])
    known = {}

    def kt(a, b):
        return math.lgamma(a + .5) + math.lgamma(b + .5) - math.lgamma(a + b + 1) - math.log(math.pi)

    def weighted(context, node):
        if (context, node) not in known:
            own = kt(*seen.get((context, node), (0, 0)))
            if len(context) < depth:
                below = sum(weighted(c, node) for c in children.get((context, node), ()))
                top = max(own, below)
                own = top + math.log(math.exp(own - top) + math.exp(below - top)) - math.log(2)
            known[context, node] = own
        return known[context, node]

    out = {}
    for doc, text in rows:
        total = 0.0
        for context, node, bit in events(text, depth):
            p, left = 0.0, 1.0
            for k in range(depth + 1):
                a, b = seen.get((context[:k], node), (0, 0))
                share = 1.0 if k == depth else math.exp(kt(a, b) - math.log(2) - weighted(context[:k], node))
                p, left = p + left * share * (b + .5) / (a + b + 1), left * (1 - share)
            total += math.log10(p if bit else 1 - p)
        out[doc] = total
    return out


def brute_base(rows):
    tokens = {d: blank_words(t) for d, t in rows}
    train = [d for d in tokens if held(d, 7) != 2]
    count = Counter(w for d in train for w in tokens[d])
    n, v = sum(count.values()) + len(train), len(count) + 1
    score = lambda c: math.log10((c + 1) / (n + v + 1))
    return {d: (len(w) + 1, sum(x in count for x in w) + 1, n, sum(score(count[x]) for x in w) + score(len(train))) for d, w in tokens.items()}


@pytest.mark.parametrize("most", [(1 << 21, 1 << 20), (60, 5)])  # all carried, and most joined
def test_context_tree_matches_its_definition(spark, monkeypatch, most):
    monkeypatch.setattr(context_tree, "CARRIED_SYMBOLS", most[0])
    monkeypatch.setattr(context_tree, "CARRIED_WORDS", most[1])
    rng = random.Random(5)
    words = ["the", "The", "cat", "sät", "on", "mat", "🤖", "x1"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(25)))) for i in range(18)] + [(40, None), (41, ""), (42, "zq" * 20)]
    got = {r.doc_id: r for r in context_tree.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    tree, base = brute_tree(rows, context_tree.DEPTH), brute_base(rows)
    for d, _ in rows:
        assert got[d].score == pytest.approx(tree[d], abs=1e-6)
        assert (got[d].n_tokens, got[d].n_known, got[d].train_tokens) == base[d][:3]
        assert got[d].base_score == pytest.approx(base[d][3], abs=1e-9)
        assert got[d].held_out == (held(d, 7) == 2)


def test_symbol_probabilities_sum_to_one(spark):
    docs = spark.createDataFrame([(1, "abracadabra")], "doc_id long, text string")
    counts, _ = context_tree.gather(context_tree._rows(docs, "doc_id", "text"))
    key = [(ctx << 9) | s for ctx in {r.key >> 9 for r in counts.collect()} for s in range(257)]
    every = spark.createDataFrame([(k, 0, 0) for k in key], "key long, n long, every long").unionByName(counts)
    total = context_tree.weigh(every.groupBy("key").agg(F.sum("n").alias("n"), F.sum("every").alias("every")))
    sums = total.groupBy(F.shiftrightunsigned("key", 9)).agg(F.sum(F.pow(F.lit(10.0), "value")).alias("p")).collect()
    assert len(sums) > 8 and all(s.p == pytest.approx(1, abs=1e-9) for s in sums)


def test_scores_of_odd_rows(odd, empty):
    assert context_tree.score(odd).count() == len(ROWS) and context_tree.score(empty).count() == 0


CLEAN, RUDE = ["table", "house", "river", "green", "walk", "read", "the", "of"], ["idiot", "moron", "scum"]


def labelled(n, seed, rude):
    rng, rows = random.Random(seed), []
    for i in range(n):
        text = [rng.choice(CLEAN) + rng.choice(["", "s", "ing", "ly"]) for _ in range(rng.randrange(5, 120))]
        if i % 3 == 0:
            for _ in range(rng.randrange(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(rude))
        rows.append((seed * 10_000 + i, " ".join(text), int(i % 3 == 0)))
    return rows


def test_toxicity_on_held_out_rows_and_misspellings(spark):
    rows = labelled(400, 1, RUDE)
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(docs, docs.select("doc_id", "toxic"), toxicity.Shape(bits=12, steps=40))
    truth = {d: t for d, _, t in rows}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    fresh = [d for d in truth if held(d, 5) == 0]
    assert sum((got[d] >= 0.5) == truth[d] for d in fresh) >= 0.95 * len(fresh)
    odd_words = spark.createDataFrame(labelled(150, 2, ["idiott", "mooron", "scumm"]), "doc_id long, text string, toxic int")
    right = toxicity.score(odd_words, model).join(odd_words, "doc_id").where((F.col("score") >= 0.5) == (F.col("toxic") == 1)).count()
    assert right >= 0.9 * 150
    kept = toxicity.drop_toxic(odd_words, model)
    assert kept.columns == odd_words.columns and 0 < kept.count() < 120


def test_labels_of_held_out_rows_are_not_learnt(spark):
    rows = [(i, f"t{i} word", 1 if held(i, 5) == 0 else 0) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    assert toxicity.fit(docs, docs) is None  # all toxic rows are held out
    assert {r.score for r in toxicity.score(docs, None).collect()} == {0.0} and toxicity.drop_toxic(docs, None).count() == 60


def test_toxicity_of_odd_rows(odd, empty, spark):
    known = spark.createDataFrame(labelled(60, 3, RUDE), "doc_id long, text string, toxic int")
    model = toxicity.fit(known, known, toxicity.Shape(bits=10, steps=5))
    assert toxicity.score(odd, model).where("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert toxicity.score(empty, model).count() == 0 and toxicity.drop_toxic(odd, model).columns == odd.columns


def test_toxicity_scores_match_loops():
    """Words, windows and their averages by loops; only the buckets of a word's n-grams are taken from the code under test."""
    import numpy as np
    import pyarrow as pa

    shape = toxicity.Shape(bits=10, steps=12)
    rows = labelled(60, 4, RUDE)
    model = toxicity.train([t for _, t, _ in rows], np.array([k for *_, k in rows]), shape)
    weight = model.vectors @ (model.layer[1] - model.layer[0])

    def of_word(word):
        raw = np.frombuffer(word.encode(), np.uint8)
        buckets, _ = toxicity.features(raw, np.array([0]), np.array([len(raw)]), shape)
        return float(np.mean([weight[b] for b in buckets]))

    def score(text):
        words, word = [], ""
        for c in (text or "") + " ":
            c = chr(ord(c) + 32) if "A" <= c <= "Z" else c
            if ord(c) < 128 and not c.isalpha():
                words, word = words + ([word] if word else []), ""
            else:
                word += c
        windows = [[of_word(w) for w in words[i:i + shape.window]] for i in range(0, len(words), shape.window)]
        chosen = [x for window in sorted(windows, key=lambda s: -sum(s))[:shape.windows] for x in window]
        logit = float(model.bias[1] - model.bias[0]) + (sum(chosen) / len(chosen) if chosen else 0.0)
        return 1 / (1 + math.exp(-logit))

    texts = [t for _, t, _ in labelled(20, 5, RUDE + ["idiott"])] + ["", None, "One!two,THREE", "été straße idiot"]
    assert toxicity.Scorer(model)(pa.array(texts)).tolist() == pytest.approx([score(t) for t in texts], abs=1e-4)
