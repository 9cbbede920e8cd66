"""Quality by nearest-neighbour voting: labelled documents in a latent-semantic space vote by cosine similarity.

A document's terms are n-grams of the kinds of its characters, its words, and whether words repeat the one before, counted over the
whole text. A truncated singular value decomposition of a bounded labelled sample gives the space. The labelled vectors, whose size is
bounded by parameters, travel with the tasks, and every document is compared with all of them in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.bytes import LOWER, U64, mixed, slices, span_hashes, text_bytes, words
from tablelens.llm.spread import read
from tablelens.llm.toxicity import held_out

#: Kinds of characters: small and large letters, digits, white space; other bytes are kinds of their own.
_KIND = np.arange(256, dtype=np.int64)
_KIND[[*range(97, 123), *range(128, 256)]] = 97
_KIND[65:91], _KIND[48:58], _KIND[[32, *range(9, 14)]] = 65, 48, 32
#: Documents whose terms are held at once, and labelled documents that one product compares them with.
_ROWS, _BLOCK = 512, 1024


@dataclass(frozen=True)
class Shape:
    """per_class: the most labelled documents of either class that are learnt from, those with the smallest hash of their id."""

    per_class: int = 2000
    shapes: int = 1024  # buckets of n-grams of kinds
    words: int = 1022
    grams: tuple[int, ...] = (2, 3, 4)
    size: int = 48  # dimensions of the space
    neighbours: int = 15
    rounds: int = 4  # of the subspace iteration
    seed: int = 7

    @property
    def terms(self) -> int:
        return self.shapes + self.words + 2


@dataclass(frozen=True)
class Model:
    weight: np.ndarray  # of each term
    basis: np.ndarray  # terms x size
    vectors: np.ndarray  # labelled documents x size, of length 1
    labels: np.ndarray
    shape: Shape


def terms(column: pa.Array, shape: Shape) -> np.ndarray:
    """A row per text: the square roots of the shares of its n-grams, of its words, and of repeated and other words."""
    data, offsets = text_bytes(column)
    n, out = len(column), []
    text = np.repeat(np.arange(n), np.diff(offsets))
    kinds, counted = _KIND[data], np.zeros(n * shape.shapes)
    gram = np.zeros(len(data), np.int64)
    for k in range(1, max(shape.grams) + 1):
        on = np.zeros(len(data), np.int64)
        on[:max(0, len(data) - k + 1)] = kinds[k - 1:]
        gram = (gram << 7) + on
        if k in shape.grams:
            whole = offsets[1:][text] - np.arange(len(data)) >= k
            bucket = mixed(gram[whole].astype(U64) + U64(k << 40)) % U64(shape.shapes)
            counted += np.bincount(text[whole] * shape.shapes + bucket.astype(np.int64), minlength=len(counted))
    out.append(counted.reshape(n, shape.shapes))
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    own = np.repeat(np.arange(n), np.diff(bounds))
    h = span_hashes(data, starts, ends, 11)
    out.append(np.bincount(own * shape.words + (h % U64(shape.words)).astype(np.int64), minlength=n * shape.words).reshape(n, shape.words))
    again = np.zeros(len(h), np.int64)
    again[1:] = (h[1:] == h[:-1]) & (own[1:] == own[:-1])
    out.append(np.bincount(own * 2 + again, minlength=n * 2).reshape(n, 2))
    return np.hstack([np.sqrt(c / np.maximum(c.sum(1, keepdims=True), 1)) for c in out]).astype(np.float32)


def _normed(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(size > 0, size, 1)


def train(counts: np.ndarray, labels: np.ndarray, shape: Shape = Shape()) -> Model:
    """The space of the weighted terms by subspace iteration, and the labelled documents in it."""
    seen = (counts > 0).sum(0)
    weight = (np.log((1 + len(counts)) / (1 + seen)) + 0.1).astype(np.float32)
    x = counts * weight
    basis = np.random.default_rng(shape.seed).standard_normal((x.shape[1], min(shape.size, *x.shape))).astype(np.float32)
    for _ in range(shape.rounds):
        basis, _ = np.linalg.qr(x.T @ (x @ basis))
    return Model(weight, basis, _normed(x @ basis), labels.astype(np.float32), shape)


class Scorer:
    """Votes for the texts of a batch; what travels with the tasks is terms x size and 2 x per_class x size numbers."""

    def __init__(self, model: Model):
        self.model = model

    def __call__(self, column: pa.Array) -> np.ndarray:
        m = self.model
        return self.vote(_normed((terms(column, m.shape) * m.weight) @ m.basis))

    def vote(self, vectors: np.ndarray) -> np.ndarray:
        """The mean label of the nearest neighbours, weighted by similarity; of all labelled rows where nothing is similar."""
        m = self.model
        best, kind = np.zeros((len(vectors), 0), np.float32), np.zeros((len(vectors), 0), np.float32)
        for low in range(0, len(m.vectors), _BLOCK):
            near = vectors @ m.vectors[low:low + _BLOCK].T
            best = np.hstack([best, near])
            kind = np.hstack([kind, np.broadcast_to(m.labels[low:low + _BLOCK], near.shape)])
            if best.shape[1] > m.shape.neighbours:
                at = np.argpartition(-best, m.shape.neighbours - 1, axis=1)[:, :m.shape.neighbours]
                best, kind = np.take_along_axis(best, at, 1), np.take_along_axis(kind, at, 1)
        best = np.maximum(best, 0).astype(float)
        total = best.sum(1)
        return np.where(total > 0, np.minimum((best * kind).sum(1) / np.where(total > 0, total, 1), 1), m.labels.mean())


def fit(docs: DataFrame, labels: DataFrame, shape: Shape = Shape(), id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """A model from labelled rows that are not held out; None without any of them.

    Labels other than 0 and 1 and null ids are not learnt from; of repeated ids one row is, the one with the smallest label and terms.
    Null and empty texts are learnt from as texts without terms. Terms are made where the texts are; the driver gets the terms of at
    most twice per_class documents.
    """
    known = labels.select(F.col("doc_id").alias("_id"), F.col("quality").alias("_label")).where("_id IS NOT NULL AND _label IN (0, 1)")
    known = known.where(~held_out(F.col("_id"))).groupBy("_id").agg(F.min("_label").cast("int").alias("_label"))
    chosen = None
    for kind in (0, 1):  # at most per_class rows each
        part = known.where(F.col("_label") == kind).orderBy(F.xxhash64("_id"), "_id").limit(shape.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = docs.sparkSession.createDataFrame(chosen.toArrow())
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).join(F.broadcast(sample), "_id")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 2, rows=_ROWS):
                made = terms(part.column(2), shape)
                sparse = []
                for row in made:
                    at = np.flatnonzero(row)
                    sparse.append(at.astype(np.uint16).tobytes() + row[at].tobytes())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sparse, pa.binary())], ["_id", "_label", "terms"])

    id_type = docs.schema[id_col].dataType.simpleString()
    seen = rows.select("_id", "_label", "_text").mapInArrow(count, f"_id {id_type}, _label int, terms binary")
    seen = seen.groupBy("_id").agg(F.min(F.struct("_label", "terms")).alias("row")).orderBy("_id").select("row.*").toArrow()
    if not seen.num_rows:
        return None
    counts = np.zeros((seen.num_rows, shape.terms), np.float32)
    for i, row in enumerate(seen.column(1)):
        raw = row.as_buffer()
        n = len(raw) // 6
        counts[i, np.frombuffer(raw, np.uint16, n)] = np.frombuffer(raw, np.float32, n, 2 * n)
    return train(counts, seen.column(0).to_numpy(), shape)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score for every row: the weighted share of good documents among the nearest labelled ones, by the whole text.

    Null and empty texts have no terms and are similar to none: they get the share of good rows among all labelled ones. Without a
    model every score is 0. Repeated rows and null ids are scored as rows of their own; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    if model is None:
        return rows.select("doc_id", F.lit(0.0).alias("score"))
    scorer = docs.sparkSession.sparkContext.broadcast(Scorer(model))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1, rows=_ROWS):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(scorer.value(part.column(1)))], ["doc_id", "score"])

    return rows.mapInArrow(scored, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    scored = score(docs, fit(docs, read(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score",
                         F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))
