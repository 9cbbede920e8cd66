"""Phrase mining: an FM-index per shard over word ids enumerates n-grams by extending intervals to either side; shards are summed.

A shard is a bounded run of words of a task with its own word ids; separators stand between pieces. Two orders of its places, by the
words that follow and by the words that precede, are kept only as deep as they are used. An interval in both stands for a phrase; the
words next to its places, counted in one pass over all intervals of a length, give every longer phrase with its interval and count.

Lengths are mined one after another: a phrase is frequent only if the two that are one word shorter are, so the next pass extends only
what fixed-size bitmaps of the frequent ones let through. A full bitmap lets more through and changes no result. Across shards a word is
the 64-bit hash of its language and itself; the first pass, which counts all words by their texts, makes sure that no two words share one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.bytes import LOWER, U64, mixed, slices, text_bytes, words
from tablelens.llm.spread import attach, read, written

#: Bits of one block of a bitmap.
BLOCK_BITS = 20
#: Parts of a language that are ranked apart before their best phrases meet.
SALTS = 64
_ENDS = np.zeros(256, bool)  # what ends a piece
_ENDS[[*b".,;:!?", *range(10, 14)]] = True
_OUTSIDE = _ENDS.copy()
_OUTSIDE[[32, 9]] = True


@dataclass(frozen=True)
class Rules:
    max_words: int = 3
    min_count: int = 10
    covered_percent: int = 50  # a phrase goes if a longer one around it has this share of its occurrences
    keep: int = 2000  # of each language
    shard_words: int = 1 << 18  # about; one longer text is a shard of its own
    filter_bits: int = 27  # 2^27 bits in the bitmap of each length's frequent phrases


# ---------------------------------------------------------------- index


class Side:
    """One direction of the index: the symbol beyond each place of an order, and how often each occurs before any place."""

    def __init__(self, symbols: np.ndarray, first: np.ndarray):
        self.symbols, self.first, self.n, self.keys = symbols, first, len(symbols), None

    def rank(self, symbol: np.ndarray, place: np.ndarray) -> np.ndarray:
        if self.keys is None:
            self.keys = np.sort(self.symbols * self.n + np.arange(self.n))
        return np.searchsorted(self.keys, symbol * self.n + place) - self.first[symbol]


@dataclass
class Intervals:
    """Phrases as rows of word ids, with their places [low, low + count) in the order by what follows, and those by what precedes."""

    ids: np.ndarray
    low: np.ndarray
    back: np.ndarray
    count: np.ndarray

    def where(self, kept: np.ndarray) -> Intervals:
        return Intervals(self.ids[kept], self.low[kept], self.back[kept], self.count[kept])


def ordered(ids: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of the ``depth`` symbols from each on; the end is followed by the beginning."""
    n, rank, span = len(ids), ids, 1
    while span < depth:
        step = min(span, depth - span)
        key = rank * (int(rank.max()) + 1) + np.roll(rank, -step)
        span += step
        _, rank = np.unique(key, return_inverse=True)
    return np.sort(rank * n + np.arange(n)) % n


class Index:
    """The FM-index in both directions of symbols from 0 on, of which 0 is the separator and no part of phrases.

    ``depth`` is the length of the longest phrases whose intervals are asked for; they can be extended by one more word.
    """

    def __init__(self, ids: np.ndarray, depth: int):
        self.ids, self.depth, self.of = ids, depth, int(ids.max()) + 1
        self.first = np.concatenate([[0], np.cumsum(np.bincount(ids, minlength=self.of))])
        self.sides: dict[bool, Side] = {}

    def side(self, to_right: bool) -> Side:
        if to_right not in self.sides:
            ids = self.ids[::-1] if to_right else self.ids
            self.sides[to_right] = Side(ids[ordered(ids, self.depth) - 1], self.first)
        return self.sides[to_right]

    def words(self) -> Intervals:
        ids = np.arange(1, self.of)
        return Intervals(ids[:, None], self.first[1:-1].copy(), self.first[1:-1].copy(), np.diff(self.first)[1:])

    def extended(self, found: Intervals, to_right: bool) -> Intervals:
        """All phrases that are one word longer on that side."""
        side = self.side(to_right)
        own, other = (found.back, found.low) if to_right else (found.low, found.back)
        parent = np.repeat(np.arange(len(own)), found.count)
        place = np.arange(len(parent)) - np.repeat(np.cumsum(found.count) - found.count - own, found.count)
        key, count = np.unique(parent * self.of + side.symbols[place], return_counts=True)
        parent, symbol = key // self.of, key % self.of
        word = symbol > 0
        moved = shifted = count  # of phrases that are extended no further
        if found.ids.shape[1] < self.depth:
            before = np.cumsum(count) - count
            shifted = other[parent] + before - before[np.searchsorted(parent, parent, "left")]  # places of the parent with a smaller symbol
            moved = self.first[symbol] + side.rank(symbol, own[parent])
        parent, symbol = parent[word], symbol[word][:, None]
        ids = np.hstack([found.ids[parent], symbol] if to_right else [symbol, found.ids[parent]])
        low, back = (shifted, moved) if to_right else (moved, shifted)
        return Intervals(ids, low[word], back[word], count[word])


# ---------------------------------------------------------------- shards


class Filters:
    """Bitmaps by phrase length; a length without one lets every phrase through."""

    def __init__(self, bits: int):
        self.bits, self.maps = bits, {}

    def has(self, h: np.ndarray, size: int) -> np.ndarray:
        bits = self.maps.get(size)
        if bits is None:
            return np.ones(len(h), bool)
        slot = (h >> U64(64 - self.bits)).astype(np.int64)
        return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def phrase_hash(columns: list[np.ndarray]) -> np.ndarray:
    """A hash of the hashes of a phrase's words, of which there is a column each."""
    h = np.full(len(columns[0]), len(columns), U64)
    for word in columns:
        h = mixed(h * U64(0x9FB21C651E98DF25) + word)
    return h


def _numbered(values: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """The values below ``top`` that occur, and each value's number among them."""
    there = np.zeros(top, bool)
    there[values] = True
    return np.flatnonzero(there), (np.cumsum(there) - 1)[values]


class Shard:
    """Words of texts as they are gathered: their bytes, lengths, pieces and languages."""

    def __init__(self):
        self.parts, self.n = [], 0

    def add(self, text: pa.Array, lang: pa.Array) -> None:
        data, offsets = text_bytes(text)
        data = LOWER[data]
        starts, ends, bounds = words(data, offsets, _OUTSIDE)
        own = np.repeat(np.arange(len(text)), np.diff(bounds))
        piece = np.concatenate([[0], np.cumsum(_ENDS[data])])[starts] + own  # changes with the text and after each end
        names = lang.dictionary_encode()
        inside = data[~_OUTSIDE[data]]
        self.parts.append((inside, ends - starts, piece, names.indices.to_numpy(zero_copy_only=False)[own].astype(np.int64), names.dictionary))
        self.n += len(starts)

    def mined(self, size: int, filters: Filters, seed: int) -> Iterator[pa.RecordBatch]:
        """The phrases of ``size`` words: the hashes of their words and their count in the shard; for single words, texts as well."""
        if not self.n:
            return
        langs, lang_of, low, piece = {}, [], 0, []
        for _, _, pieces, lang, names in self.parts:
            table = np.array([langs.setdefault(name, len(langs)) for name in names.to_pylist()] or [0], np.int64)
            lang_of.append(table[lang])
            piece.append(pieces + low)
            low += int(pieces[-1]) + 1 if len(pieces) else 0
        lang_of, piece = np.concatenate(lang_of), np.concatenate(piece)
        data = np.concatenate([p[0] for p in self.parts])
        ends = np.concatenate([[0], np.cumsum(np.concatenate([p[1] for p in self.parts]))])
        whole = pa.LargeBinaryArray.from_buffers(pa.large_binary(), self.n, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(data)])
        coded = whole.dictionary_encode()  # ids are given by the words themselves, not by hashes
        texts, ids = coded.dictionary, coded.indices.to_numpy().astype(np.int64)
        key, ids = _numbered(ids * len(langs) + lang_of, len(texts) * len(langs))  # the same word in two languages is two
        text_of, lang_of = key // len(langs), key % len(langs)
        marks = [f"{len(name)}:{name}".encode() for name in langs]
        texts_ = texts.to_pylist()
        h = np.array([xxhash.xxh64_intdigest(marks[a] + texts_[b], seed) for a, b in zip(lang_of.tolist(), text_of.tolist())], U64)
        if size == 1:
            yield pa.RecordBatch.from_arrays(
                [pa.array(list(langs), pa.string()).take(pa.array(lang_of)), texts.take(pa.array(text_of)).cast(pa.large_string()).cast(pa.string()),
                 pa.array(h.view(np.int64)), pa.array(np.bincount(ids, minlength=len(key)))], ["lang", "phrase", "h", "c"])
            return
        ids = np.where(filters.has(phrase_hash([h]), 1)[ids], ids + 1, 0)
        cut = np.concatenate([[True], piece[1:] != piece[:-1]])  # a separator where the piece changes; rare words are separators too
        spaced = np.zeros(len(ids) + int(cut.sum()), np.int64)
        spaced[np.arange(len(ids)) + np.cumsum(cut)] = ids
        spaced = spaced[(spaced > 0) | (np.concatenate([[1], spaced[:-1]]) > 0)]
        used, spaced = _numbered(spaced, len(key) + 1)  # frequent words alone, close together
        if len(used) < 2:
            return
        h = np.concatenate([np.zeros(1, U64), h])[used]
        index = Index(spaced, size - 1)
        found = index.words()
        for n in range(2, size + 1):
            to_right = n % 2 == 0
            found = index.extended(found, to_right)
            columns = [h[found.ids[:, k]] for k in range(n)]
            kept = np.ones(len(found.ids), bool)
            if n > 2:  # the phrase without the word at the other end
                kept &= filters.has(phrase_hash(columns[1:] if to_right else columns[:-1]), n - 1)
            if n < size:
                kept &= filters.has(phrase_hash(columns), n)
            found = found.where(kept)
        names = [f"w{k}" for k in range(size)]
        for low in range(0, len(found.ids), 1 << 16):
            part = slice(low, low + (1 << 16))
            yield pa.RecordBatch.from_arrays([*[pa.array(h[found.ids[part, k]].view(np.int64)) for k in range(size)],
                                              pa.array(found.count[part])], [*names, "c"])


def counted(rows: DataFrame, size: int, filters: Filters, rules: Rules, seed: int) -> DataFrame:
    """f for the phrases of ``size`` words that the filters let through, by w0, w1, ..., or by lang, phrase with h for words."""
    carried = rows.sparkSession.sparkContext.broadcast(filters)

    def mine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = Shard()
        for batch in batches:
            for part in slices(batch, 1):
                shard.add(part.column(1), part.column(0))
                if shard.n >= rules.shard_words:
                    yield from shard.mined(size, carried.value, seed)
                    shard = Shard()
        yield from shard.mined(size, carried.value, seed)

    if size == 1:
        made = rows.mapInArrow(mine, "lang string, phrase string, h long, c long")
        return made.groupBy("lang", "phrase").agg(F.sum("c").alias("f"), F.first("h").alias("w0"))
    names = [f"w{k}" for k in range(size)]
    return rows.mapInArrow(mine, ", ".join(f"{c} long" for c in [*names, "c"])).groupBy(*names).agg(F.sum("c").alias("f"))


def bitmap(grams: DataFrame, size: int, width: int) -> np.ndarray:
    """One bit for the hash of every phrase, in blocks that tasks make; its size is fixed."""
    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = np.unique(phrase_hash([c.to_numpy().view(U64) for c in batch.columns]) >> U64(64 - width)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((slot >> BLOCK_BITS).astype(np.int32)),
                                              pa.array((slot & ((1 << BLOCK_BITS) - 1)).astype(np.int32))], ["block", "bit"])

    def block(table: pa.Table) -> pa.Table:
        bits = np.zeros(1 << BLOCK_BITS, bool)
        bits[table.column("bit").to_numpy()] = True
        return pa.table({"block": table.column("block")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = grams.select(*[f"w{k}" for k in range(size)]).mapInArrow(slots, "block int, bit int").distinct()
    made = parts.groupBy("block").applyInArrow(block, "block int, bits binary").toArrow()
    out = np.zeros((1 << max(0, width - BLOCK_BITS), 1 << BLOCK_BITS - 3), np.uint8)
    for at, bits in zip(made.column("block").to_pylist(), made.column("bits")):
        out[at] = np.frombuffer(bits.as_buffer(), np.uint8)
    return out.reshape(-1)


# ---------------------------------------------------------------- phrases


def _looked_up(rows: DataFrame, base: DataFrame, count: int, at: list[str], grams: DataFrame, values: dict[str, str]) -> DataFrame:
    """Adds values of the phrases that stand in the columns ``at``; a frequent word stands in a large share of all rows.

    ``base`` is the written table, of ``count`` rows, that the rows come from.
    """
    uses = base.groupBy(*at).agg(F.count(F.lit(1)).alias("_uses"))
    side = grams.select(*[F.col(f"w{k}").alias(c) for k, c in enumerate(at)], *[F.col(v).alias(name) for v, name in values.items()])
    side = side.join(uses, at).select(F.struct(*at).alias("_key"), *values.values(), "_uses")
    return attach(rows.withColumn("_key", F.struct(*at)), written(side), "_key", "_uses", count).drop("_key", "_uses")


def _scored(found: list[DataFrame], size: int) -> DataFrame:
    """lang, phrase, w0, w1, ..., a, l, r, score of the candidates of a size by their lowest cut."""
    names, base = [f"w{k}" for k in range(size)], found[size - 1]
    rows, count = base.withColumnRenamed("f", "a"), base.count()
    for k in range(1, size):
        for part, name in ((names[:k], f"l{k}"), (names[k:], f"r{k}")):
            if len(part) > 1:
                rows = _looked_up(rows, base, count, part, found[len(part) - 1], {"f": name})
    for k, name in enumerate(names):  # words bring their texts, and their counts where they are a part of a cut
        values = {"phrase": f"t{k}"} | ({"f": "l1" if k == 0 else f"r{size - 1}"} if k in (0, size - 1) else {}) | ({"lang": "lang"} if k == 0 else {})
        rows = _looked_up(rows, base, count, [name], found[0], values)
    number = lambda c: f"cast({c} AS decimal(14, 0))"
    cuts = [F.struct(F.expr(f"(cast(1000000 AS decimal(7, 0)) * {number('a')} * {number('a')}) div ({number(f'l{k}')} * {number(f'r{k}')})")
                     .alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")) for k in range(1, size)]
    best = rows.withColumn("cut", F.array_min(F.array(*cuts)))
    return best.select("lang", F.concat_ws(" ", *[f"t{k}" for k in range(size)]).alias("phrase"), *names, "a", "cut.l", "cut.r", "cut.score")


def _uncovered(scored: DataFrame, longer: DataFrame, size: int, rules: Rules) -> DataFrame:
    """Candidates without one a word longer around them that is frequent enough.

    Candidates that are longer still are no more frequent than one of these, so they need not be looked at.
    """
    names = [f"w{k}" for k in range(size)]
    inner = [longer.select(*[F.col(f"w{k + low}").alias(f"w{k}") for k in range(size)], "f") for low in (0, 1)]
    most = inner[0].unionByName(inner[1]).groupBy(*names).agg(F.max("f").alias("most"))
    return scored.join(most, names, "left").where(
        F.coalesce(100 * F.col("most") < rules.covered_percent * F.col("a"), F.lit(True))).drop("most")


def mine(docs: DataFrame, rules: Rules = Rules(), text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The best phrases of every language: lang, rank, phrase, a, l, r, n, score.

    Words are runs of bytes other than space and tab, A-Z in lower case, within pieces that end at . , ; : ! ? and line ends; null
    languages are ``und``, null and empty texts have no words. n counts all words of the language, a the phrase, l and r the two parts
    of the cut that scores least; score is floor(1000000 a a / (l r)). Repeated rows count each time. Texts without phrases and an
    empty table give no rows. A piece is never split, so memory grows with the longest text. Other columns are not read.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    filters, seed = Filters(rules.filter_bits), 0
    while True:
        every = written(counted(rows, 1, filters, rules, seed))
        if every.groupBy("w0").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
            break
        seed += 1  # two words share a hash: another one for all
    sizes = every.groupBy("lang").agg(F.sum("f").alias("n"))
    found = [written(every.where(F.col("f") >= rules.min_count))]
    for size in range(2, rules.max_words + 1):
        filters.maps[size - 1] = bitmap(found[-1], size - 1, rules.filter_bits)
        found.append(written(counted(rows, size, filters, rules, seed).where(F.col("f") >= rules.min_count)))
    best = None
    for size in range(2, rules.max_words + 1):
        part = _scored(found, size)
        if size < rules.max_words:
            part = _uncovered(part, found[size], size, rules)
        part = part.select("lang", "phrase", "a", "l", "r", "score")
        best = part if best is None else best.unionByName(part)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    best = best.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    for part in (["lang", "_salt"], ["lang"]):  # of each salt as many as of the whole, then of these
        best = best.withColumn("rank", F.row_number().over(Window.partitionBy(*part).orderBy(*order))).where(F.col("rank") <= rules.keep)
    return best.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(read(spark, sf_dir, "documents"))


OP13_SQL = """
WITH p AS (SELECT lang, list_filter(string_split_regex(p, '[ \\t]+'), lambda x: x <> '') AS w FROM (SELECT coalesce(lang, 'und') AS lang,
    unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\\n\\v\\f\\r]')) AS p FROM documents)),
t AS (SELECT lang, w[i] AS x, w[i + 1] AS y, w[i + 2] AS z FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM p)),
n AS (SELECT lang, count(*) AS n FROM t GROUP BY lang),
f1 AS (SELECT lang, x, count(*) AS f FROM t GROUP BY ALL HAVING count(*) >= 10),
f2 AS (SELECT lang, x, y, count(*) AS f FROM t WHERE y IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
f3 AS (SELECT lang, x, y, z, count(*) AS f FROM t WHERE z IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
cuts AS (SELECT f2.lang, f2.x || ' ' || f2.y AS phrase, f2.f AS a, 1 AS k, u.f AS l, v.f AS r
    FROM f2 JOIN f1 u ON u.lang = f2.lang AND u.x = f2.x JOIN f1 v ON v.lang = f2.lang AND v.x = f2.y
    WHERE NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.x = f2.x AND f3.y = f2.y AND 100 * f3.f >= 50 * f2.f)
    AND NOT EXISTS (SELECT 1 FROM f3 WHERE f3.lang = f2.lang AND f3.y = f2.x AND f3.z = f2.y AND 100 * f3.f >= 50 * f2.f)
    UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 1, u.f, v.f
    FROM f3 JOIN f1 u ON u.lang = f3.lang AND u.x = f3.x JOIN f2 v ON v.lang = f3.lang AND v.x = f3.y AND v.y = f3.z
    UNION ALL SELECT f3.lang, f3.x || ' ' || f3.y || ' ' || f3.z, f3.f, 2, u.f, v.f
    FROM f3 JOIN f2 u ON u.lang = f3.lang AND u.x = f3.x AND u.y = f3.y JOIN f1 v ON v.lang = f3.lang AND v.x = f3.z),
s AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cuts),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1)
SELECT lang, rank, phrase, a, l, r, n, score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM b) JOIN n USING (lang) WHERE rank <= 2000
"""
