"""LM scoring by context-tree weighting over bytes.

A symbol is a byte or the text's end, written as nine binary decisions. For each decision and each context of up to ``DEPTH`` symbols
before it, a Krichevsky-Trofimov estimate counts both outcomes; weighting mixes the estimates of all depths, so that each depth
counts as far as it has coded the training texts well. All of this follows from the counts of symbols in their longest contexts:
these are gathered over all documents, the trees are weighted group by group of the two nearest context symbols, and each symbol in
its context gets one probability. A text's code length is the sum over its symbols.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.bytes import LOWER, U64, slices, span_hashes, text_bytes, words
from tablelens.llm.spread import read, written

DEPTH, BITS, END = 5, 9, 256
#: Symbols in context and words that travel with the tasks: the most frequent ones, at most so many. All others are joined.
CARRIED_SYMBOLS, CARRIED_WORDS = 1 << 21, 1 << 20
#: Distinct keys a task gathers before it merges them.
_GATHERED = 1 << 22
_NODES = 1 << BITS


def symbols(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key for each symbol in its context, and its text: nearest context symbol first, the symbol itself in the lowest bits."""
    n = np.diff(offsets)
    size = n + DEPTH + 1  # ends before the first byte, and one after the last
    first = np.cumsum(size) - size
    stream = np.full(int(size.sum()), END, U64)
    stream[np.repeat(first + DEPTH - offsets[:-1], n) + np.arange(len(data))] = data
    at = np.repeat(first + DEPTH - (np.cumsum(n + 1) - (n + 1)), n + 1) + np.arange(int((n + 1).sum()))
    key = np.zeros(len(stream), U64)
    for d in range(1, DEPTH + 1):
        key[d:] |= stream[:-d] << U64(BITS * (DEPTH + 1 - d))
    return (key | stream)[at], np.repeat(np.arange(len(n)), n + 1)


class Counter:
    """Sums of several columns by key, merged as they come so that only distinct keys are held."""

    def __init__(self, columns: int):
        self.keys, self.values, self.size, self.merged = [np.zeros(0, U64)], [np.zeros((columns, 0), np.int64)], 0, 0

    def add(self, keys: np.ndarray, values: np.ndarray) -> None:
        order = np.argsort(keys)
        self._append(keys[order], values[:, order])
        if self.size > max(_GATHERED, 2 * self.merged):
            self.merge()

    def _append(self, keys: np.ndarray, values: np.ndarray) -> None:
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
        self.keys.append(keys[first])
        self.values.append(np.add.reduceat(values, first, axis=1) if len(keys) else values)
        self.size += len(first)

    def merge(self) -> tuple[np.ndarray, np.ndarray]:
        keys, values = np.concatenate(self.keys), np.concatenate(self.values, axis=1)
        order = np.argsort(keys, kind="stable")
        self.keys, self.values, self.size = [], [], 0
        self._append(keys[order], values[:, order])
        self.merged = self.size
        return self.keys[0], self.values[0]


def held_out(id_: Column) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % 7 == 2, F.lit(False))


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(F.col(id_col)).alias("held_out"))


def gather(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Symbols in context and words over all documents: key, n (in training texts), every (in all texts). Words are hashed to 64 bits."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {"s": Counter(2), "w": Counter(2)}
        for batch in batches:
            for part in slices(batch, 0, rows=1024):
                data, offsets = text_bytes(part.column(0))
                data = LOWER[data]
                train = ~part.column(1).to_numpy(zero_copy_only=False)
                key, text = symbols(data, offsets)
                combined = np.sort(key << U64(1) | train[text].astype(U64))  # the flag rides in the lowest bit
                held["s"].add(combined >> U64(1), np.stack([(combined & U64(1)).astype(np.int64), np.ones(len(key), np.int64)]))
                starts, ends, bounds = words(data, offsets)
                text = np.repeat(np.arange(len(train)), np.diff(bounds))
                held["w"].add(span_hashes(data, starts, ends), np.stack([train[text].astype(np.int64), np.ones(len(text), np.int64)]))
        for kind, counter in held.items():
            key, value = counter.merge()
            for low in range(0, len(key), 1 << 18):
                part = slice(low, low + (1 << 18))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([kind] * len(key[part])), pa.array(key[part].view(np.int64)), pa.array(value[0, part]),
                     pa.array(value[1, part])], ["kind", "key", "n", "every"])

    counted = rows.select("text", "held_out").mapInArrow(count, "kind string, key long, n long, every long")
    summed = written(counted.groupBy("kind", "key").agg(F.sum("n").alias("n"), F.sum("every").alias("every")))
    return summed.where("kind = 's'").drop("kind"), summed.where("kind = 'w'").drop("kind")


def lgamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for positive values: Stirling's series after eight steps up."""
    x = np.asarray(x, float)
    low = np.zeros_like(x)
    for k in range(8):
        low += np.log(x + k)
    y = x + 8
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + 1 / (12 * y) - 1 / (360 * y ** 3) + 1 / (1260 * y ** 5) - 1 / (1680 * y ** 7) - low


def kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """ln of the Krichevsky-Trofimov probability of any sequence with so many zeros and ones."""
    return lgamma(zeros + 0.5) + lgamma(ones + 0.5) - lgamma(zeros + ones + 1) - np.log(np.pi)


def kt_one(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return (ones + 0.5) / (zeros + ones + 1)


def mix(zeros: np.ndarray, ones: np.ndarray, below: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """ln of the weighted probability of inner nodes, and the weight of their own estimate; below: the sum over their children."""
    own = kt(zeros, ones)
    weighted = np.logaddexp(own, below) - np.log(2)
    return weighted, np.exp(own - np.log(2) - weighted)


class Levels:
    """For one binary decision, the nodes at depth DEPTH down to 2 of all contexts in a group, from the symbol counts."""

    def __init__(self, key: np.ndarray, n: np.ndarray, turn: int):
        symbol = key & U64(_NODES - 1)
        self.rows = np.flatnonzero((symbol < END) | (turn == 0))
        symbol, n = symbol[self.rows], n[self.rows]
        node = (U64(1) << U64(turn)) | (symbol >> U64(BITS - turn))
        self.one = ((symbol >> U64(BITS - 1 - turn)) & U64(1)).astype(bool)
        at, self.parent = (key[self.rows] >> U64(BITS) << U64(BITS)) | node, []
        zeros, ones, below = np.where(self.one, 0, n), np.where(self.one, n, 0), None
        self.zeros, self.ones, self.below, self.weighted = [], [], [], []
        for depth in range(DEPTH, 1, -1):
            at, up = np.unique(at, return_inverse=True)
            zeros, ones = np.bincount(up, zeros, len(at)), np.bincount(up, ones, len(at))
            below = None if below is None else np.bincount(up, below, len(at))
            self.parent.append(up)
            self.zeros.append(zeros)
            self.ones.append(ones)
            self.below.append(below)
            below = kt(zeros, ones) if depth == DEPTH else mix(zeros, ones, below)[0]
            self.node = (at & U64(_NODES - 1)).astype(np.int64)
            drop = U64(BITS * (DEPTH + 2 - depth))  # the farthest context symbol that is left goes
            at = (at >> drop << drop) | (at & U64(_NODES - 1))
        self.top = below

    def probabilities(self, so_far: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Of the decision that each row took, given what depths 0 and 1 add and the weight that they leave, by node."""
        so_far, left = so_far[self.node], left[self.node]
        for i in range(len(self.zeros) - 1, -1, -1):
            weight = 1.0 if i == 0 else mix(self.zeros[i], self.ones[i], self.below[i])[1]
            so_far = so_far + left * weight * kt_one(self.zeros[i], self.ones[i])
            left = left * (1 - weight)
            so_far, left = so_far[self.parent[i]], left[self.parent[i]]
        return np.where(self.one, so_far, 1 - so_far)


def weigh(counts: DataFrame) -> DataFrame:
    """key, every, value: log10 of each symbol's probability in its context, from counts over all training texts."""
    grouped = counts.withColumn("near", F.shiftrightunsigned("key", BITS * (DEPTH - 1)))  # the two nearest context symbols

    def group(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return table.column("key").to_numpy().view(U64), table.column("n").to_numpy()

    def up(table: pa.Table) -> pa.Table:
        key, n = group(table)
        parts = []
        for turn in range(BITS):
            levels = Levels(key, n, turn)
            if len(levels.rows):
                parts.append((levels.node, levels.zeros[-1], levels.ones[-1], levels.top))
        node, zeros, ones, top = (np.concatenate(x) for x in zip(*parts))
        nearest = np.full(len(node), table.column("near")[0].as_py() >> BITS)
        return pa.table({"nearest": nearest, "node": node, "zeros": zeros, "ones": ones, "below": top})

    # at most 257 contexts of one symbol by 511 decisions: a table of fixed bound, whatever the input
    one_deep = (grouped.groupBy("near").applyInArrow(up, "nearest long, node long, zeros double, ones double, below double")
                .groupBy("nearest", "node").agg(*[F.sum(c).alias(c) for c in ("zeros", "ones", "below")])).toArrow()
    nearest, node, zeros, ones, below = (one_deep.column(c).to_numpy() for c in ("nearest", "node", "zeros", "ones", "below"))
    weighted, weight = mix(zeros, ones, below)
    root = [np.bincount(node, x, _NODES) for x in (zeros, ones, weighted)]
    root_weight = mix(*root)[1]
    so_far = np.zeros((END + 1, _NODES))
    left = np.zeros((END + 1, _NODES))
    rest = (1 - root_weight)[node]
    so_far[nearest, node] = (root_weight * kt_one(root[0], root[1]))[node] + rest * weight * kt_one(zeros, ones)
    left[nearest, node] = rest * (1 - weight)
    above = counts.sparkSession.sparkContext.broadcast((so_far, left))

    def down(table: pa.Table) -> pa.Table:
        key, n = group(table)
        nearest_ = table.column("near")[0].as_py() >> BITS
        value = np.zeros(len(key))
        for turn in range(BITS):
            levels = Levels(key, n, turn)
            if len(levels.rows):
                value[levels.rows] += np.log10(levels.probabilities(above.value[0][nearest_], above.value[1][nearest_]))
        return pa.table({"key": table.column("key"), "every": table.column("every"), "value": value})

    return grouped.groupBy("near").applyInArrow(down, "key long, every long, value double")


def carried(table: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Keys and values of the most frequent entries, at most ``most``, sorted by key; entries with ``every`` under the bound are not."""
    sizes = (table.groupBy(F.ceil(F.log2("every") * 8).cast("int").alias("size")).agg(F.count(F.lit(1)).alias("n"), F.min("every").alias("low"))
             .orderBy(F.desc("size")).collect())  # a row for each eighth of a doubling
    total, bound = 0, 1 << 62
    for s in sizes:
        total += s["n"]
        if total > most:
            break
        bound = s["low"]
    rows = table.where(F.col("every") >= bound).select("key", "value").toArrow()
    order = np.argsort(rows.column("key").to_numpy())
    return rows.column("key").to_numpy()[order], rows.column("value").to_numpy()[order], bound


def _look_up(table: tuple[np.ndarray, np.ndarray], key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, values = table
    if not len(keys):
        return np.zeros(len(key), bool), np.zeros(len(key))
    at = np.searchsorted(keys, key)
    at[at == len(keys)] = 0
    return keys[at] == key, values[at]


def _by_text(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs of key and text, sorted by key, and how often each occurs."""
    order = np.lexsort((text, key))
    key, text = key[order], text[order]
    first = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (text[1:] != text[:-1])])) if len(key) else order
    return key[first], text[first], np.diff(np.append(first, len(key)))


def _symbols_by_text(key: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same for symbols, whose keys leave ten bits for the text."""
    both = np.sort(key << U64(10) | text.astype(U64))
    first = np.flatnonzero(np.concatenate([[True], both[1:] != both[:-1]])) if len(both) else np.zeros(0, np.int64)
    both = both[first]
    return (both >> U64(10)).view(np.int64), (both & U64(1023)).astype(np.int64), np.diff(np.append(first, len(key)))


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: its code under the weighted context tree, and under a unigram model of words with add-one smoothing.

    Both learn from the documents that are not held out (crc32 of the id mod 7 is 2) and score all, over whole texts with A-Z in
    lower case. Returns doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the probability of the text
    with its end), n_bytes, bits_per_byte (null for no bytes). Null counts as empty: one token, the end. Rows without an id are
    trained on; repeated rows count and score as rows of their own. An empty table gives no rows; other columns are not read.
    """
    rows = _rows(docs, id_col, text_col)
    counts, vocabulary = gather(rows)
    values = written(weigh(counts))
    vocabulary = vocabulary.withColumn("value", F.log10(F.col("n") + 1.0))
    ends = rows.where("NOT held_out").count()
    total = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.when(F.col("n") > 0, 1)).alias("v")).first()
    n_train, n_distinct = total["n"] + ends, total["v"] + (ends > 0)
    symbol_keys, symbol_values, _ = carried(values, CARRIED_SYMBOLS)
    word_keys, word_values, _ = carried(vocabulary, CARRIED_WORDS)
    known = docs.sparkSession.sparkContext.broadcast(((symbol_keys, symbol_values), (word_keys, word_values)))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = ["row", "doc_id", "held_out", "n_tokens", "n_known", "base", "score", "n_bytes", "symbol", "word", "n"]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            for part in slices(batch, 1, rows=1024):
                data, offsets = text_bytes(part.column(1))
                data, many = LOWER[data], part.num_rows
                key, text, n = _symbols_by_text(*symbols(data, offsets))
                found, value = _look_up(known.value[0], key)
                code = np.bincount(text[found], (n * value)[found], many)
                rare = [(key[~found], text[~found], n[~found])]
                starts, ends_, bounds = words(data, offsets)
                key, text, n = _by_text(span_hashes(data, starts, ends_).view(np.int64), np.repeat(np.arange(many), np.diff(bounds)))
                found, value = _look_up(known.value[1], key)
                base = np.bincount(text[found], (n * value)[found], many)
                seen = np.bincount(text[found], n[found] * (value[found] > 0), many).astype(np.int64)
                rare.append((key[~found], text[~found], n[~found]))
                of_rare = [sum(len(r[0]) for r in rare), np.concatenate([r[1] for r in rare])]
                none = lambda kind, k: pa.nulls(k, kind)
                whole = [pa.array(np.arange(row, row + many)), part.column(0), part.column(2), pa.array(np.diff(bounds) + 1),
                         pa.array(seen), pa.array(base, pa.float64()), pa.array(code, pa.float64()), pa.array(np.diff(offsets)), none(pa.int64(), many),
                         none(pa.int64(), many), none(pa.int64(), many)]
                yield pa.RecordBatch.from_arrays(whole, names)
                k = of_rare[0]
                if k:
                    s, w = len(rare[0][0]), len(rare[1][0])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(row + of_rare[1]), part.column(0).take(pa.array(of_rare[1])), none(pa.bool_(), k),
                         none(pa.int64(), k), none(pa.int64(), k), none(pa.float64(), k), none(pa.float64(), k), none(pa.int64(), k),
                         pa.concat_arrays([pa.array(rare[0][0]), none(pa.int64(), w)]),
                         pa.concat_arrays([none(pa.int64(), s), pa.array(rare[1][0])]),
                         pa.array(np.concatenate([r[2] for r in rare]))], names)
                row += many

    parts = written(rows.select("doc_id", "text", "held_out").mapInArrow(
        add, f"row long, doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base double, score double, n_bytes long, "
             "symbol long, word long, n long"))
    # what no task carried: joined by key, summed by document; frequent keys were all carried, so no key is hot here
    zero = F.lit(0.0)
    symbols_ = (parts.where("symbol IS NOT NULL").select("row", F.col("symbol").alias("key"), F.col("n").alias("times"))
                .join(values.select("key", "value"), "key")
                .select("row", (F.col("times") * F.col("value")).alias("score"), zero.alias("base"), F.lit(0).cast("long").alias("n_known")))
    words_ = (parts.where("word IS NOT NULL").select("row", F.col("word").alias("key"), F.col("n").alias("times"))
              .join(vocabulary.select("key", "value"), "key")
              .select("row", zero.alias("score"), (F.col("times") * F.col("value")).alias("base"),
                      F.when(F.col("value") > 0, F.col("times")).otherwise(0).alias("n_known")))
    whole = parts.where("n_tokens IS NOT NULL")
    sums = (whole.select("row", "score", "base", "n_known").unionByName(symbols_).unionByName(words_)
            .groupBy("row").agg(*[F.sum(c).alias(c) for c in ("score", "base", "n_known")]))
    facts = whole.select("row", "doc_id", "held_out", "n_tokens", "n_bytes")
    return facts.join(sums, "row").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.lit(int(ends > 0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("base") + F.log10(F.lit(ends + 1.0)) - F.col("n_tokens") * F.log10(F.lit(float(n_train + n_distinct + 1)))).alias("base_score"),
        "score", "n_bytes", F.when(F.col("n_bytes") > 0, -F.col("score") * F.log2(F.lit(10.0)) / F.col("n_bytes")).alias("bits_per_byte"))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(read(spark, sf_dir, "documents"))
