"""Toxicity by subword bags: vectors of character n-grams, averaged over a bag of words, into a linear softmax.

Vectors and softmax are trained jointly in numpy on a bounded sample of labelled documents. A document's bag is its few most toxic
windows, so that a few words in a long text count. As the last layer is linear, a trained model scores a word by one number.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.bytes import LOWER, U64, mixed, slices, span_hashes, text_bytes, words
from tablelens.llm.spread import read

#: Words end at ASCII bytes that are no letters.
_OUTSIDE = np.array([b < 128 and not chr(b).isalpha() for b in range(256)])


@dataclass(frozen=True)
class Shape:
    """per_class: the most labelled documents of either class that training takes, those with the smallest hash of their id."""

    per_class: int = 2000
    bits: int = 17
    size: int = 8
    grams: tuple[int, ...] = (3, 4, 5, 6)
    window: int = 2  # words
    windows: int = 4  # in a bag
    warm_steps: int = 8
    steps: int = 60
    refresh: int = 4  # steps between choices of the windows
    rate: float = 0.3
    seed: int = 5


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray  # a row for each bucket of n-grams
    layer: np.ndarray  # 2 x size
    bias: np.ndarray  # 2
    shape: Shape

    def scores(self) -> tuple[np.ndarray, float]:
        """What each bucket adds to the difference of the two classes, and the bias."""
        return (self.vectors @ (self.layer[1] - self.layer[0])).astype(np.float32), float(self.bias[1] - self.bias[0])


#: Words whose hashes or features are made at once.
_AT_ONCE = 1 << 15


def features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of each word's n-grams, with marks for its ends, and of the whole word; with the first feature of each word."""
    parts = [_features(data, starts[i:i + _AT_ONCE], ends[i:i + _AT_ONCE], shape) for i in range(0, len(starts), _AT_ONCE)]
    sizes = np.concatenate([n for _, n in parts] or [np.zeros(0, np.int64)])
    return np.concatenate([b for b, _ in parts] or [np.zeros(0, np.int32)]), np.concatenate([[0], np.cumsum(sizes)])


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """span_hashes of words in the order of the text, over a part of it at a time."""
    out = np.empty(len(starts), U64)
    for i in range(0, len(starts), _AT_ONCE):
        part = slice(i, i + _AT_ONCE)
        low, high = starts[part][0], ends[part][-1]
        out[part] = span_hashes(data[low:high], starts[part] - low, ends[part] - low, seed)
    return out


def _features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    sizes = ends - starts + 2
    first = np.concatenate([[0], np.cumsum(sizes)])
    marked = np.empty(first[-1], U64)
    marked[first[:-1]] = 256
    marked[first[1:] - 1] = 257
    inner = np.ones(first[-1], bool)
    inner[first[:-1]] = inner[first[1:] - 1] = False
    marked[inner] = data[np.repeat(starts - np.concatenate([[0], np.cumsum(ends - starts)[:-1]]), ends - starts)
                         + np.arange((ends - starts).sum())]
    word = np.repeat(np.arange(len(starts)), sizes)
    left = first[1:][word] - np.arange(first[-1])  # places from here to the end of the word
    letters = np.concatenate([[0], np.cumsum(ends - starts)])
    owner, bucket = [np.arange(len(starts))], [span_hashes(marked[inner].astype(np.uint8), letters[:-1], letters[1:], 3)]
    gram = np.zeros(len(marked), U64)
    for n in range(1, max(shape.grams) + 1):
        shifted = np.zeros(len(marked), U64)
        shifted[:max(0, len(marked) - n + 1)] = marked[n - 1:]
        gram = gram * U64(1_000_003) + shifted + U64(1)
        if n in shape.grams:
            at = np.flatnonzero(left >= n)
            owner.append(word[at])
            bucket.append(mixed(gram[at] + U64(n)))
    owner, bucket = np.concatenate(owner), np.concatenate(bucket) >> U64(64 - shape.bits)
    order = np.argsort(owner, kind="stable")
    return bucket[order].astype(np.int32), np.bincount(owner, minlength=len(starts))


def distinct_words(data: np.ndarray, offsets: np.ndarray):
    """Words of all texts: bytes in lower case, starts and ends of the distinct ones, which one each word is, words before each text."""
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets, _OUTSIDE)
    _, one, which = np.unique(_word_hashes(data, starts, ends, 1), return_index=True, return_inverse=True)
    return data, starts[one], ends[one], which, bounds


def top_windows(scores: np.ndarray, bounds: np.ndarray, shape: Shape) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text's highest windows, as places of words and the texts they belong to."""
    n = np.diff(bounds)
    many = -(-n // shape.window)
    first = np.concatenate([[0], np.cumsum(many)])
    text = np.repeat(np.arange(len(n)), many)
    begin = bounds[:-1][text] + (np.arange(first[-1]) - first[text]) * shape.window
    if not len(begin):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.lexsort((-np.add.reduceat(scores, begin), text))
    best = order[np.arange(first[-1]) - first[text] < shape.windows]
    size = np.minimum(begin[best] + shape.window, bounds[1:][text[best]]) - begin[best]
    place = np.repeat(begin[best] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())
    return place, np.repeat(text[best], size)


def spans(of_word: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Places of the features of the chosen words, one word after another."""
    size = np.diff(of_word)[chosen]
    return np.repeat(of_word[:-1][chosen] - np.concatenate([[0], np.cumsum(size)[:-1]]), size) + np.arange(size.sum())


def train(texts: list[str], labels: np.ndarray, shape: Shape = Shape()) -> Model:
    """A few steps on whole documents, then on each document's most toxic windows as the model sees them meanwhile."""
    rng = np.random.default_rng(shape.seed)
    buckets = 1 << shape.bits
    vectors = rng.uniform(-1 / shape.size, 1 / shape.size, (buckets, shape.size))
    layer, bias = rng.uniform(-0.1, 0.1, (2, shape.size)), np.zeros(2)
    data, offsets = text_bytes(pa.array(texts, pa.large_string()))
    data, starts, ends, which, bounds = distinct_words(data, offsets)
    feature, of_word = features(data, starts, ends, shape)
    per_word = np.diff(of_word)
    n, text = np.diff(bounds), np.repeat(np.arange(len(texts)), np.diff(bounds))
    weight = np.where(labels == 1, 0.5 / max(1, (labels == 1).sum()), 0.5 / max(1, (labels == 0).sum()))
    seen_v, seen_l, seen_b = np.full((buckets, shape.size), 1e-8), np.full(layer.shape, 1e-8), np.full(2, 1e-8)

    def step(word_of: np.ndarray, doc_of: np.ndarray) -> None:
        """One step of Adagrad on bags; word_of and doc_of pair distinct words with documents."""
        nonlocal vectors, layer, bias
        used, word_of = np.unique(word_of, return_inverse=True)
        grams = feature[spans(of_word, used)]
        size = per_word[used]
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        share = 1.0 / np.maximum(np.bincount(doc_of, minlength=len(texts)), 1)
        means = np.stack([np.add.reduceat(vectors[grams, k], first) / size for k in range(shape.size)], 1)
        bags = np.stack([np.bincount(doc_of, means[word_of, k], len(texts)) for k in range(shape.size)], 1) * share[:, None]
        logit = bags @ layer.T + bias
        p = np.exp(logit - logit.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        wrong = (p - np.eye(2)[labels]) * weight[:, None]
        grad_l, grad_b, pull = wrong.T @ bags, wrong.sum(0), wrong @ layer
        for k in range(shape.size):
            on_word = np.bincount(word_of, (pull[:, k] * share)[doc_of], len(used)) / size
            grad = np.bincount(grams, np.repeat(on_word, size), buckets)
            seen_v[:, k] += grad ** 2
            vectors[:, k] -= shape.rate * grad / np.sqrt(seen_v[:, k])
        for value, grad, seen in ((layer, grad_l, seen_l), (bias, grad_b, seen_b)):
            seen += grad ** 2
            value -= shape.rate * grad / np.sqrt(seen)

    if not len(which):
        return Model(vectors, layer, bias, shape)
    for _ in range(shape.warm_steps):
        step(which, text)
    for turn in range(shape.steps):
        if turn % shape.refresh == 0:
            by_bucket = (vectors @ (layer[1] - layer[0])).astype(np.float32)
            place, doc_of = top_windows((np.add.reduceat(by_bucket[feature], of_word[:-1]) / per_word)[which], bounds, shape)
        step(which[place], doc_of)
    return Model(vectors, layer, bias, shape)


def held_out(id_: Column, parts: int = 5) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % parts == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from labelled rows that are not held out; None without rows of both classes.

    Null texts and labels other than 0 and 1 are not learnt from; an id that repeats in docs is learnt from once for each of its texts.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("toxic").alias("_toxic")).where(~held_out(F.col("_id")))
    chosen = None
    for kind in (0, 1):  # at most per_class rows each
        part = known.where(F.col("_toxic") == kind).orderBy(F.xxhash64("_id"), "_id").limit(shape.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.sparkSession.createDataFrame(chosen.toArrow())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")
    rows = rows.where(F.col("_text").isNotNull()).select("_text", "_toxic").toArrow()
    kinds = rows.column(1).to_numpy().astype(int)
    if len(set(kinds.tolist())) < 2:
        return None
    order = np.argsort([hash_of for hash_of in map(_order, rows.column(0).to_pylist())], kind="stable")
    texts = rows.column(0).to_pylist()
    return train([texts[i] for i in order], kinds[order], shape)


def _order(text: str) -> int:
    import zlib

    return zlib.crc32(text.encode())


class Scorer:
    """Scores of the texts of a batch; small enough to travel with the tasks (4 bytes a bucket)."""

    def __init__(self, model: Model):
        self.by_bucket, self.bias = model.scores()
        self.shape = model.shape

    def __call__(self, column: pa.Array) -> np.ndarray:
        data, starts, ends, which, bounds = distinct_words(*text_bytes(column))
        logit = np.full(len(column), self.bias)
        if len(which):
            feature, of_word = features(data, starts, ends, self.shape)
            scores = (np.add.reduceat(self.by_bucket[feature], of_word[:-1]) / np.diff(of_word))[which]
            place, doc_of = top_windows(scores, bounds, self.shape)
            n = np.bincount(doc_of, minlength=len(column))
            logit += np.bincount(doc_of, scores[place], len(column)) / np.maximum(n, 1)
        return 1 / (1 + np.exp(-np.clip(logit, -50, 50)))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row: 0 to 1 by the most toxic windows of the whole text.

    Null and empty texts, and texts without words, score by the bias alone. Without a model (no labelled rows of both classes)
    every score is 0. Repeated rows and null ids are scored as rows of their own; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    scorer = Scorer(model)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer(part.column(1)))], ["doc_id", "score"])

    return rows.mapInArrow(scored, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def drop_toxic(docs: DataFrame, model: Model | None, limit: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs that score under ``limit``, with all their columns; decided where they are read, without a shuffle.

    Null and empty texts score by the bias alone; repeated rows and ids are judged by their own texts. Without a model all rows stay.
    """
    if model is None:
        return docs
    scorer, at = Scorer(model), docs.columns.index(text_col)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                yield part.filter(pa.array(scorer(part.column(at)) < limit))

    return docs.mapInArrow(clean, docs.schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
