import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm_rows import ROWS
from tablelens.llm import quality

WORDS = ["table", "house", "river", "green", "walk", "read", "the", "of", "straße", "été"]
SMALL = quality.Shape(shapes=256, words=126, size=12, neighbours=5)


def held(doc):
    return zlib.crc32(str(doc).encode()) % 5 == 0


def labelled(n, seed):
    rng, rows = random.Random(seed), []
    for i in range(n):
        words = [rng.choice(WORDS) + rng.choice(["", "s", "ing"]) for _ in range(rng.randrange(4, 80))]
        junk = i % 3 == 0
        if junk:
            words = rng.choice([[w.upper() + "!!" for w in words], [w + " |" for w in words], [w for w in words for _ in range(9)],
                                [w + rng.choice(["***", "$$$"]) for w in words]])
        rows.append((i, " ".join(words), int(not junk)))
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(labelled(300, 1), "doc_id long, text string, quality int").repartition(3)


def test_held_out_documents(docs):
    model = quality.fit(docs.drop("quality"), docs.select("doc_id", "quality"))
    got = {r.doc_id: (r.score, r.quality) for r in quality.score(docs, model).join(docs, "doc_id").collect()}
    fresh = [v for d, v in got.items() if held(d)]
    assert len(fresh) > 40 and sum((s >= 0.3) == q for s, q in fresh) >= 0.95 * len(fresh)
    known = [v for d, v in got.items() if not held(d)]
    assert sum((s >= 0.3) == q for s, q in known) >= 0.98 * len(known)


def test_scores_match_loops(docs, monkeypatch):
    monkeypatch.setattr(quality, "_BLOCK", 17)
    model = quality.fit(docs, docs, SMALL)
    texts = [t for _, t, _ in labelled(40, 2)] + ["", "the", None]
    got = quality.Scorer(model)(pa.array(texts))
    for text, score in zip(texts, got):
        data, words = list((text or "").encode()), (text or "").lower().split()
        row = brute_terms(data, words, SMALL) * model.weight
        v = row @ model.basis
        v = v / (np.linalg.norm(v) or 1)
        near = sorted(((max(0.0, float(v @ u)), k) for u, k in zip(model.vectors, model.labels)), key=lambda x: -x[0])[:5]
        total = sum(s for s, _ in near)
        assert score == pytest.approx(sum(s * k for s, k in near) / total if total else model.labels.mean(), abs=1e-3)


def brute_terms(data, words, shape):
    """The row of one text by dictionaries of its n-grams; only the buckets are taken from the code under test."""
    kind = lambda b: 97 if 97 <= b <= 122 or b > 127 else 65 if 65 <= b <= 90 else 48 if 48 <= b <= 57 else 32 if b in (32, *range(9, 14)) else b
    a, b, c = np.zeros(shape.shapes), np.zeros(shape.words), np.zeros(2)
    for n in shape.grams:
        for i in range(len(data) - n + 1):
            gram = 0
            for x in data[i:i + n]:
                gram = gram * 128 + kind(x)
            a[int(quality.mixed(np.array([gram + (n << 40)], np.uint64))[0]) % shape.shapes] += 1
    for i, w in enumerate(words):
        raw = np.frombuffer(w.encode(), np.uint8)
        b[int(quality.span_hashes(raw, np.array([0]), np.array([len(raw)]), 11)[0]) % shape.words] += 1
        c[int(i > 0 and words[i - 1] == w)] += 1
    return np.concatenate([np.sqrt(x / max(1, x.sum())) for x in (a, b, c)])


def test_only_rows_that_are_not_held_out_are_learnt_from(spark):
    rows = [(i, f"t{i} word", 1) for i in range(60) if held(i)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    assert quality.fit(frame, frame) is None
    assert {r.score for r in quality.score(frame, None).collect()} == {0.0}


def test_samples_are_bounded_whatever_repeats(spark, docs):
    many = docs.unionByName(docs).unionByName(docs.withColumn("text", F.lit(None).cast("string")))
    model = quality.fit(many, docs, quality.Shape(per_class=20, shapes=64, words=30, size=4))
    assert len(model.vectors) == 40 and model.labels.sum() == 20


def test_odd_rows(spark, docs, odd, empty):
    model = quality.fit(docs, docs, SMALL)
    out = quality.score(odd, model)
    assert out.count() == len(ROWS) and out.where("score BETWEEN 0 AND 1").count() == len(ROWS)
    assert {round(r.score, 6) for r in out.where("doc_id IN (3, 4)").collect()} == {round(float(model.labels.mean()), 6)}
    assert quality.score(empty, model).count() == 0 and quality.fit(empty, docs) is None
    odd_labels = spark.createDataFrame([(1, None), (2, 1), (2, 0), (None, 1), (8, 7), (9, 0)], "doc_id long, quality int")
    learnt = quality.fit(odd, odd_labels, SMALL)
    assert (0 if learnt is None else len(learnt.vectors)) == sum(not held(d) for d in (2, 9))
