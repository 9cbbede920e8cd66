"""N-gram Jaccard join: documents whose sets of word shingles are alike, exactly, and the groups they form.

Tiles. Two sets with a Jaccard similarity of at least t share one of the first n - ceil(t n) + 1 shingles of any order that is the same
for all documents. Shingles are ordered by a sketch of how frequent they are, rare ones first, so passages that many documents
share stay out of these prefixes. Documents with such a shingle in common and sizes in the same or the next band form a tile.

Links. Each document is first compared with the heads of its tiles, the documents that share most of their prefix with others; that settles
almost every tile. Shingles whose documents are still in different groups are then dealt to tasks of a counted size. The bits that two hashed bitmaps
differ in bound the overlap of a pair from above; over whole blocks of pairs, this leaves the documents that may have a partner. Tasks that
hold the sets of these once intersect the sorted arrays of such pairs. They know the groups so far and join them as they go, so that pairs
within a group are not compared; only links that join two groups leave a task.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablelens.llm.bytes import LOWER, U64, mixed, slices, span_hashes, text_bytes, words
from tablelens.llm.graph import components
from tablelens.llm.spread import HOT_SHARE, attach, read, written

#: Counters of the sketch of frequencies, in blocks of a row each; bits of the filter for candidates.
SKETCH_BITS, SKETCH_BLOCK, FILTER_BITS = 22, 1 << 17, 22
#: Bytes of shingle arrays that one comparing task group holds on average.
TILE_BYTES = 16 << 20
#: Documents of one block of a tile that is dealt to several tasks, and of a run whose pairs are formed together with those of other runs.
BLOCK_ROWS, FEW = 4096, 32
#: Nodes that are sent to all tasks at most; a longer list is joined by shuffle.
SENT_NODES = 1 << 20
#: Pairs, and bytes of their bitmaps, that are compared at once.
PAIRS, PAIR_BYTES = 1 << 17, 16 << 20


@dataclass(frozen=True)
class Likeness:
    words: int = 5
    percent: int = 75

    def needed(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The overlap that sets of these sizes need."""
        return -(-self.percent * (a + b) // (100 + self.percent))

    def prefix(self, n: np.ndarray) -> np.ndarray:
        return n - -(-self.percent * n // 100) + 1

    def shared(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many shingles the prefixes of two sets of these sizes share at least if the sets are alike.

        The k-th of their common shingles in order has needed - k common ones after it, so it stands among the first
        n - needed + k of either set.
        """
        return self.needed(a, b) + np.minimum(self.prefix(a) - a, self.prefix(b) - b)

    def fits(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return 100 * np.minimum(a, b) >= self.percent * np.maximum(a, b)

    def band(self, n: np.ndarray) -> np.ndarray:
        """Sizes that fit each other are in the same band or in neighbouring ones."""
        return np.floor(np.log(n) / math.log(100 / self.percent) + 1e-9).astype(np.int64)


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of all texts one after another, and each text's first (one more at the end).

    Words are runs of bytes other than white space, A-Z in lower case. A text of fewer words has one shingle, all of them.
    """
    data, offsets = text_bytes(column)
    data = LOWER[data]
    starts, ends, bounds = words(data, offsets)
    word = span_hashes(data, starts, ends)
    n = np.diff(bounds)
    text = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(word)) - bounds[:-1][text]
    taken = np.minimum(size, n)[text]  # words of the shingle that starts here
    h = taken.astype(U64)
    for k in range(size):
        on = np.zeros(len(word), U64)
        on[:max(0, len(word) - k)] = word[k:]
        h = np.where(k < taken, mixed(h * U64(0x9FB21C651E98DF25) + on), h)
    first = place <= n[text] - taken
    text, h = text[first], h[first]
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (text[1:] != text[:-1]) | (h[1:] != h[:-1])
    return h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def _sums(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(h, dtype=U64)])
    return sums[bounds[1:]] - sums[bounds[:-1]]


def digests(h: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that are the same for the same set."""
    return _sums(mixed(h), bounds).view(np.int64), _sums(mixed(h ^ U64(0x5851F42D4C957F2D)), bounds).view(np.int64)


def sketch(docs: DataFrame, like: Likeness) -> np.ndarray:
    """Counts of the documents' shingles by hash, of a fixed size whatever the input."""
    blocks = (1 << SKETCH_BITS) // SKETCH_BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, np.uint32)
        for batch in batches:
            for part in slices(batch, 0):
                h, _ = shingles(part.column(0), like.words)
                np.add.at(counts, (h >> U64(64 - SKETCH_BITS)).astype(np.int64), np.uint32(1))
        counts = np.minimum(counts, 255).astype(np.uint8)  # a task's share of a count; only the order of shingles depends on it
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(blocks), pa.int32()),
                                          pa.array([c.tobytes() for c in counts.reshape(blocks, -1)], pa.binary())], ["block", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(SKETCH_BLOCK, np.uint32)
        for c in table.column("counts"):
            total += np.frombuffer(c.as_buffer(), np.uint8)
        return pa.table({"block": table.column("block")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    summed = (docs.select("text").mapInArrow(count, "block int, counts binary")
              .groupBy("block").applyInArrow(add, "block int, counts binary").toArrow().sort_by("block"))
    return np.concatenate([np.frombuffer(c.as_buffer(), np.uint32) for c in summed.column("counts")] or
                          [np.zeros(1 << SKETCH_BITS, np.uint32)])


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, text, and two hashes of the text: rows that have all of these in common are copies of each other."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text).alias("m1"),
                       F.xxhash64(F.lit(7), text).alias("m2"))


def cards(docs: DataFrame, like: Likeness) -> tuple[DataFrame, np.ndarray]:
    """A row per document: node (a number of its own), doc_id, n, digest, and prefix and bitmap (null for a copy seen before in the same task).

    Also the sketch of how frequent shingles are.
    """
    sketched = sketch(docs, like)
    counts = docs.sparkSession.sparkContext.broadcast(sketched)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, seen = TaskContext.get().partitionId() << 40, set()
        for batch in batches:
            for part in slices(batch, 1):
                h, bounds = shingles(part.column(1), like.words)
                d1, d2 = digests(h, bounds)
                n = np.diff(bounds)
                text = np.repeat(np.arange(len(n)), n)
                h = h[np.lexsort((h, counts.value[(h >> U64(64 - SKETCH_BITS)).astype(np.int64)], text))]
                prefixes, maps = [], []
                for i, key in enumerate(zip(d1.tolist(), d2.tolist())):
                    known = n[i] == 0 or key in seen
                    prefixes.append(None if known else h[bounds[i]:bounds[i] + like.prefix(n[i])].tobytes())
                    maps.append(None if known else bitmap(h[bounds[i]:bounds[i + 1]], _width(int(n[i]))).tobytes())
                    seen.add(key)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(node, node + len(n))), part.column(0), part.column(2), part.column(3), pa.array(n), pa.array(d1),
                     pa.array(d2), pa.array(prefixes, pa.binary()), pa.array(maps, pa.binary())],
                    ["node", "doc_id", "m1", "m2", "n", "d1", "d2", "prefix", "bits"])
                node += len(n)

    return docs.mapInArrow(
        describe, f"node long, doc_id {id_type}, m1 long, m2 long, n long, d1 long, d2 long, prefix binary, bits binary"), sketched


def postings(cards_: DataFrame, sketched: np.ndarray, limit: int) -> DataFrame:
    """h, node, n, left (shingles of the document from this one on) and hot (of more than ``limit`` documents, by the sketch) for prefixes."""
    often = cards_.sparkSession.sparkContext.broadcast(np.packbits(sketched > limit))

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_slots = np.unpackbits(often.value).view(bool)
        for batch in batches:
            for part in slices(batch, 2):
                size = np.array([len(x.as_buffer()) // 8 for x in part.column(2)], np.int64)
                h = np.frombuffer(b"".join(x.as_buffer() for x in part.column(2)), np.int64)
                n = np.repeat(part.column(1).to_numpy(), size)
                left = n - (np.arange(len(h)) - np.repeat(np.cumsum(size) - size, size))
                hot = hot_slots[(h.view(U64) >> U64(64 - SKETCH_BITS)).astype(np.int64)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h), pa.array(np.repeat(part.column(0).to_numpy(), size)), pa.array(n.astype(np.int32)),
                     pa.array(left.astype(np.int32)), pa.array(hot)], ["h", "node", "n", "left", "hot"])

    return cards_.where("prefix IS NOT NULL").select("node", "n", "prefix").mapInArrow(spread, "h long, node long, n int, left int, hot boolean")


def shared_postings(posts: DataFrame, rows: int) -> DataFrame:
    """The postings of shingles that several documents have, with their number c; hot shingles are counted before they are shuffled."""
    alone = F.count(F.lit(1)).over(Window.partitionBy("h"))
    cold = posts.where(~F.col("hot")).drop("hot").withColumn("c", alone).where("c > 1")
    hot = posts.where("hot").drop("hot")
    counts = hot.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where("c > 1")
    return cold.unionByName(attach(hot, written(counts.withColumn("uses", F.col("c"))), "h", "uses", rows).where("c IS NOT NULL").drop("uses"))


def _least(like: Likeness) -> Column:
    """like.shared as a column expression over n_a and n_b."""
    a, b, percent = F.col("n_a").cast("long"), F.col("n_b").cast("long"), like.percent
    return (F.ceil(percent * (a + b) / (100 + percent))
            + F.least(1 - F.ceil(percent * a / 100), 1 - F.ceil(percent * b / 100)))


def _band(like: Likeness) -> Column:
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / like.percent) + 1e-9).cast("int")


def first_pairs(shared: DataFrame, rows: int, like: Likeness) -> DataFrame:
    """Each document with the heads of its tiles: a, b, n_a, n_b.

    Head of a tile is the document with the smallest share of prefix shingles of its own, as other versions of a text have more of these
    than the text that they come from. Only pairs that meet in as many tiles as alike sets must are compared; what this leaves out,
    remaining_links finds.
    """
    prefix = F.col("n") - F.ceil(like.percent * F.col("n") / 100) + 1
    own = shared.groupBy("node", "n").agg(F.count(F.lit(1)).alias("uses")).select("node", (1 - F.col("uses") / prefix).alias("own"))
    tiled = shared.select("h", "node", "n", _band(like).alias("band"))
    heads = tiled.join(own, "node").groupBy("h", "band").agg(F.min(F.struct("own", "node", "n")).alias("head"), F.count(F.lit(1)).alias("uses"))
    heads = written(heads)
    bands = F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)
    near = heads.select("h", F.explode(bands).alias("band"), "head").groupBy("h", "band").agg(F.collect_list("head").alias("heads"))
    side = heads.select("h", "band", "uses").join(near, ["h", "band"]).select(F.struct("h", "band").alias("tile"), "heads", "uses")
    met = attach(tiled.select("node", "n", F.struct("h", "band").alias("tile")), written(side), "tile", "uses", rows)
    pairs = met.select("node", "n", F.explode("heads").alias("head")).where("node <> head.node")
    swap = F.col("node") > F.col("head.node")
    end = lambda first, c: F.when(swap if first else ~swap, F.col(c)).otherwise(F.col(f"head.{c}"))
    pairs = pairs.select(end(True, "node").alias("a"), end(False, "node").alias("b"), end(True, "n").alias("n_a"), end(False, "n").alias("n_b"))
    pairs = pairs.where(100 * F.least("n_a", "n_b") >= like.percent * F.greatest("n_a", "n_b"))
    # a document that is met as a head and meets its head back is counted twice in a tile
    met = pairs.groupBy("a", "b", "n_a", "n_b").agg(F.count(F.lit(1)).alias("times"))
    return met.where(F.col("times") >= _least(like)).drop("times")


def _width(n: int) -> int:
    return 1 << max(6, int(4 * n - 1).bit_length() - 1)


def bitmap(h: np.ndarray, width: int) -> np.ndarray:
    """Of each bit, whether an odd number of the shingles have its hash; so sets differ in no fewer shingles than their bitmaps in bits."""
    return np.packbits(np.bincount((h & U64(width - 1)).astype(np.int64), minlength=width) & 1, bitorder="little").view(U64)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Common elements of two sorted arrays, neither of them empty."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())


def alike(a: np.ndarray, b: np.ndarray, bits_a: np.ndarray, bits_b: np.ndarray, like: Likeness) -> bool:
    """Each bit that differs stands for a shingle that only one of the sets has: that bounds the overlap before it is counted."""
    needed = int(like.needed(len(a), len(b)))
    if len(a) + len(b) - int(np.bitwise_count(bits_a ^ bits_b).sum()) < 2 * needed:
        return False
    return overlap(a, b) >= needed


def _tiled(pairs: DataFrame, spread: int) -> tuple[DataFrame, DataFrame]:
    """Pairs with their task group, and the nodes that each group needs; a group holds about TILE_BYTES of arrays."""
    size = pairs.agg(F.coalesce(F.sum(F.col("n_a") + F.col("n_b")), F.lit(0)).alias("n")).first()["n"]
    groups = max(1, math.ceil(size * 8 / TILE_BYTES))
    tiled = pairs.withColumn("tile", F.pmod(F.xxhash64("a", F.pmod("b", F.lit(spread))), F.lit(groups)))
    return tiled, tiled.select("tile", F.col("a").alias("node")).union(tiled.select("tile", "b")).distinct()


def _arrays_by_node(sets: pa.Table) -> dict[int, np.ndarray]:
    return {k: np.frombuffer(v.as_buffer(), U64) for k, v in zip(sets.column("node").to_pylist(), sets.column("h"))}


def sets_of(wanted: DataFrame, cards_: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Adds h, the sorted shingles of each row's node; arrays are made anew from the texts of the documents in question."""
    wanted = written(wanted.join(cards_.select("node", "d1", "d2"), "node"))
    slots = wanted.select(F.shiftrightunsigned("d1", 64 - FILTER_BITS).cast("int").alias("slot")).distinct().toArrow()
    filter_ = np.zeros(1 << FILTER_BITS, bool)
    filter_[slots.column(0).to_numpy()] = True
    filter_ = docs.sparkSession.sparkContext.broadcast(np.packbits(filter_))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, seen = np.unpackbits(filter_.value).view(bool), set()
        for batch in batches:
            for part in slices(batch, 0):
                h, bounds = shingles(part.column(0), like.words)
                d1, d2 = digests(h, bounds)
                hit = np.flatnonzero(bits[(d1.view(U64) >> U64(64 - FILTER_BITS)).astype(np.int64)] & (np.diff(bounds) > 0))
                hit = [i for i in hit if (d1[i], d2[i]) not in seen]
                seen.update((d1[i], d2[i]) for i in hit)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d1[hit]), pa.array(d2[hit]),
                     pa.array([h[bounds[i]:bounds[i + 1]].tobytes() for i in hit], pa.binary())], ["d1", "d2", "h"])

    made = docs.select("text").mapInArrow(arrays, "d1 long, d2 long, h binary").dropDuplicates(["d1", "d2"])
    return wanted.join(made, ["d1", "d2"]).drop("d1", "d2")


def compare(pairs: DataFrame, cards_: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """The pairs a, b that are alike."""
    tiled, wanted = _tiled(pairs, 1)
    sets = sets_of(wanted, cards_, docs, like).select("tile", "node", "h")

    def check(pairs_: pa.Table, sets_: pa.Table) -> pa.Table:
        set_of, bits, found = _arrays_by_node(sets_), {}, []

        def bits_of(node: int, width: int) -> np.ndarray:
            if (node, width) not in bits:
                bits[node, width] = bitmap(set_of[node], width)
            return bits[node, width]

        for a, b in zip(pairs_.column("a").to_pylist(), pairs_.column("b").to_pylist()):
            width = _width(max(len(set_of[a]), len(set_of[b])))
            found.append(alike(set_of[a], set_of[b], bits_of(a, width), bits_of(b, width), like))
        return pairs_.select(["a", "b"]).filter(pa.array(found, pa.bool_()))

    return tiled.select("tile", "a", "b").groupBy("tile").cogroup(sets.groupBy("tile")).applyInArrow(check, "a long, b long")


class Tile:
    """The documents of a task, with their bitmaps and groups so far.

    With their sets, it links documents that are alike and joins their groups as it goes; without, it marks those that may have a partner.
    """

    def __init__(self, nodes: np.ndarray, n: np.ndarray, bits: list[np.ndarray], roots: np.ndarray, like: Likeness, sets: list[np.ndarray] | None):
        self.nodes, self.n, self.own, self.sets, self.like, self.links, self.unlike = nodes, n, bits, sets, like, [], set()
        _, self.group = np.unique(roots, return_inverse=True)
        self.maybe = np.zeros(len(n), bool)
        self.width = np.array([64 * len(b) for b in bits], np.int64)
        self.bits: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def bits_at(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Bitmaps of this width, of the documents that may be compared at it, and each document's row among them."""
        if width not in self.bits:
            mine = np.flatnonzero((self.width == width) | (self.width == 2 * width))
            row = np.full(len(self.n), -1, np.int64)
            row[mine] = np.arange(len(mine))
            words = width // 64  # a bitmap of twice the width is folded
            self.bits[width] = np.stack([b if len(b) == words else b[:words] ^ b[words:] for b in map(self.own.__getitem__, mine.tolist())]), row
        return self.bits[width]

    def join(self, i: np.ndarray, j: np.ndarray) -> None:
        """Compare pairs of documents of different groups."""
        apart = (self.group[i] != self.group[j]) & self.like.fits(self.n[i], self.n[j]) & ~(self.maybe[i] & self.maybe[j])
        i, j = i[apart], j[apart]
        if not len(i):
            return
        both = np.unique(np.minimum(i, j) * len(self.n) + np.maximum(i, j))
        i, j = both // len(self.n), both % len(self.n)
        width = np.minimum(self.width[i], self.width[j])
        most = self.n[i] + self.n[j] - 2 * self.like.needed(self.n[i], self.n[j])  # shingles that one set alone may have
        for w in np.unique(width).tolist():
            at = np.flatnonzero(width == w)
            bits, row = self.bits_at(w)
            step = max(1, PAIR_BYTES // (w // 8))
            for low in range(0, len(at), step):
                part = at[low:low + step]
                part = part[self.group[i[part]] != self.group[j[part]]]
                differ = np.bitwise_count(bits[row[i[part]]] ^ bits[row[j[part]]]).sum(1, dtype=np.int64)
                part = part[differ <= most[part]]
                if self.sets is None:
                    self.maybe[i[part]] = self.maybe[j[part]] = True
                else:
                    for a, b in zip(i[part].tolist(), j[part].tolist()):
                        self.link(a, b)

    def link(self, a: int, b: int) -> None:
        x, y = self.group[a], self.group[b]
        if x == y or (a, b) in self.unlike:
            return
        if overlap(self.sets[a], self.sets[b]) < int(self.like.needed(self.n[a], self.n[b])):
            self.unlike.add((a, b))
            return
        self.group[self.group == y] = x
        self.links.append((self.nodes[a], self.nodes[b]))

    def run(self, members: np.ndarray, left: np.ndarray, side: np.ndarray | None) -> None:
        """The documents of one shingle; pairs of which one has too few shingles left from it on meet at another, or are not alike.

        With ``side`` given, only pairs of different sides are wanted.
        """
        size = len(members)
        done = np.zeros(size, bool)
        while True:
            group = self.group[members]
            value, count = np.unique(group, return_counts=True)
            rest = np.flatnonzero((group != value[np.argmax(count)]) & ~done)
            if not len(rest):
                # the others have met everyone; those of the largest group need not meet each other
                return
            rest = rest[:max(1, PAIRS // size)]
            i, j = np.repeat(rest, size), np.tile(np.arange(size), len(rest))
            self.join(*self._wanted(members, left, side, i, j))
            done[rest] = True

    def _wanted(self, members, left, side, i, j):
        ok = (members[i] != members[j]) & (np.minimum(left[i], left[j]) >= self.like.needed(self.n[members[i]], self.n[members[j]]))
        if side is not None:
            ok &= side[i] != side[j]
        return members[i[ok]], members[j[ok]]


def _dealt(mixed: DataFrame, bytes_: float) -> DataFrame:
    """The rows of mixed (h, node, n, left, root, lead) with the task group (slot) and the pair of blocks (i, j) that they go to.

    Shingles of the same lead stay together, as versions of a text share many, so that few tasks need a document, of which ``bytes_`` are
    held for each shingle. Where the documents of a lead are too much for a task, they are cut into blocks, and each pair of blocks is
    a task; so a task group holds about TILE_BYTES.
    """
    count = mixed.count()
    held = mixed.groupBy("lead", "node", "n").agg(F.count(F.lit(1)).alias("posts"))
    leads = held.groupBy("lead").agg((F.sum("n") * bytes_).alias("bytes"), F.count(F.lit(1)).alias("nodes"), F.sum("posts").alias("uses"))
    blocks = F.greatest(F.ceil(2 * F.col("bytes") / TILE_BYTES), F.ceil(F.col("nodes") / BLOCK_ROWS), F.lit(1)).cast("long")
    leads = written(leads.select("lead", blocks.alias("blocks"), "bytes", "uses"))
    load = leads.agg(F.sum(F.col("bytes") * F.col("blocks")).alias("bytes"), F.sum(F.col("uses") * F.col("blocks")).alias("rows")).first()
    slots = max(1, math.ceil((load["bytes"] or 0) / TILE_BYTES), math.ceil((load["rows"] or 0) * 64 / TILE_BYTES))
    cut = attach(mixed, leads.drop("bytes"), "lead", "uses", count).withColumn("block", F.pmod(F.xxhash64("node"), "blocks"))
    each = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    each = each.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    return written(each.select(F.pmod(F.xxhash64("lead", "i", "j"), F.lit(slots)).alias("slot"), "h", "i", "j", "block", "node", "n", "left", "root"))


def _compared(posts: pa.Table, nodes: np.ndarray, bits: list[np.ndarray], sets: list[np.ndarray] | None, like: Likeness) -> Tile:
    """A task's documents after all pairs that share a shingle have been looked at."""
    h, i, j, block, node, n, left, root = (posts.column(c).to_numpy().astype(np.int64)
                                           for c in ("h", "i", "j", "block", "node", "n", "left", "root"))
    member = np.searchsorted(nodes, node)
    roots, sizes = np.zeros(len(nodes), np.int64), np.zeros(len(nodes), np.int64)
    roots[member], sizes[member] = root, n
    tile = Tile(nodes, sizes, bits, roots, like, sets)
    rank = np.lexsort((n, j, i, h))
    h, i, j, block, member, left = h[rank], i[rank], j[rank], block[rank], member[rank], left[rank]
    first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
    size = np.diff(np.concatenate([first, [len(h)]]))
    for low, many in zip(first[size > FEW].tolist(), size[size > FEW].tolist()):
        part = slice(low, low + many)
        tile.run(member[part], left[part], block[part] if i[low] != j[low] else None)
    small, many = first[size <= FEW], size[size <= FEW]
    at_once = max(1, 2 * PAIRS // FEW ** 2)
    for low in range(0, len(small), at_once):  # all pairs of a number of small runs
        start, k = small[low:low + at_once], many[low:low + at_once]
        row = np.repeat(start, k) + np.arange(k.sum()) - np.repeat(np.cumsum(k) - k, k)
        after = np.repeat(start + k, k) - row - 1
        a = np.repeat(row, after)
        b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(after) - after, after)
        ok = (np.minimum(left[a], left[b]) >= like.needed(tile.n[member[a]], tile.n[member[b]])) & ((i[a] == j[a]) | (block[a] != block[b]))
        tile.join(member[a[ok]], member[b[ok]])
    return tile


def _held(table: pa.Table, column: str) -> tuple[np.ndarray, list[np.ndarray]]:
    """Nodes in order, with an array of each."""
    nodes = table.column("node").to_numpy()
    order, arrays = np.argsort(nodes), [np.frombuffer(x.as_buffer(), U64) for x in table.column(column)]
    return nodes[order], [arrays[k] for k in order]


def remaining_links(shared: DataFrame, rows: int, labels: DataFrame, cards_: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Links a, b that join all documents in different groups so far which are alike, directly or through others.

    Shingles whose documents are all in one group are done. For the others, bitmaps tell which documents may have a partner in another
    group; the sets of these are then compared. A task hands on its documents, or fewer links than it has documents, never pairs.
    """
    known = written(shared.select("h", "node", "n", "left").join(labels, "node", "left").withColumn("root", F.coalesce("root", "node")))
    runs = known.groupBy("h").agg(F.min("root").alias("lead"), F.max("root").alias("top"), F.count(F.lit(1)).alias("uses")).where("lead <> top")
    mixed = written(attach(known, written(runs.drop("top")), "h", "uses", rows).where("lead IS NOT NULL").drop("uses"))
    dealt = _dealt(mixed, 0.5)
    bits = written(dealt.select("slot", "node").distinct().join(cards_.select("node", "bits"), "node"))

    def mark(posts: pa.Table, maps: pa.Table) -> pa.Table:
        tile = _compared(posts, *_held(maps, "bits"), None, like)
        return pa.table({"node": pa.array(tile.nodes[tile.maybe], pa.int64())})

    maybe = written(dealt.groupBy("slot").cogroup(bits.groupBy("slot")).applyInArrow(mark, "node long").distinct())
    dealt = _dealt(written(mixed.join(maybe, "node", "left_semi")), 8)
    sets = sets_of(dealt.select("slot", "node").distinct(), cards_, docs, like).select("slot", "node", F.col("h").alias("set"))

    def link(posts: pa.Table, sets_: pa.Table) -> pa.Table:
        nodes, arrays = _held(sets_, "set")
        links = _compared(posts, nodes, [bitmap(a, _width(len(a))) for a in arrays], arrays, like).links
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    return dealt.groupBy("slot").cogroup(sets.groupBy("slot")).applyInArrow(link, "a long, b long")


def one_of_equal(cards_: DataFrame) -> DataFrame:
    """The cards with a prefix, one of each set: the smallest node. Tasks leave out the copies that they see; this leaves out those of other tasks.

    A set has no more such cards than there are tasks, so no group is large.
    """
    firsts = cards_.where("prefix IS NOT NULL")
    place = F.row_number().over(Window.partitionBy("d1", "d2").orderBy("node"))
    again = written(firsts.select("node", place.alias("place")).where("place > 1").select("node"))
    n = again.count()
    if not n:
        return firsts
    return firsts.join(F.broadcast(again) if n <= SENT_NODES else again, "node", "left_anti")


def grouped(docs: DataFrame, like: Likeness) -> tuple[DataFrame, int]:
    """node, doc_id, m1, m2, n, root for every row of marked documents, and their number; root is the same for rows of one group."""
    made, sketched = cards(docs, like)
    all_ = written(made)
    rows = all_.count()
    shared = written(shared_postings(postings(one_of_equal(all_), sketched, max(1, rows // HOT_SHARE)), rows))
    posts = shared.count()
    pairs = written(first_pairs(shared, posts, like))
    links = written(compare(pairs, all_, docs, like))
    labels = components(links)
    more = written(remaining_links(shared, posts, labels, all_, docs, like))
    if not more.isEmpty():
        labels = components(links.union(more))
    # equal sets are one node: the smallest
    sets = written(all_.where("n > 0").groupBy("d1", "d2").agg(F.min("node").alias("node"), F.count(F.lit(1)).alias("copies")))
    keyed = sets.join(labels, "node", "left").select("d1", "d2", F.coalesce("root", "node").alias("root"), "copies")
    # documents to their set: this join is safe for hot keys
    key = F.struct("d1", "d2")
    named = attach(all_.select("node", "doc_id", "m1", "m2", "n", key.alias("key")),
                   keyed.select(key.alias("key"), "root", "copies"), "key", "copies", rows)
    return written(named.select("node", "doc_id", "m1", "m2", "n", F.coalesce("root", "node").alias("root"))), rows


def similar_groups(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_shingles (size of its set), component_id (smallest doc_id of its group, itself included).

    Two documents are linked if 100 * intersection >= percent * union of their sets; equal sets are one node throughout. Null and
    empty texts, and texts without words, have no shingles and stay alone. Repeated rows are linked as equal texts are, and rows that
    repeat an id with another text are documents of their own; a group whose ids are all null has a null component_id. An empty table
    gives no rows; other columns are not read.
    """
    named, rows = grouped(marked(docs, id_col, text_col), like)
    groups = named.groupBy("root").agg(F.min("doc_id").alias("component_id"), F.count(F.lit(1)).alias("members"))
    return attach(named.select("doc_id", F.col("n").alias("n_shingles"), "root"), written(groups), "root", "members", rows).select(
        "doc_id", "n_shingles", "component_id")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(read(spark, sf_dir, "documents"))


OP6_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[ \\t\\n\\v\\f\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 75 * (a.n + b.n - i)),
r(doc_id, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.reached = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id
JOIN (SELECT doc_id, min(reached) AS component_id FROM r GROUP BY doc_id) c ON d.doc_id = c.doc_id
"""


def one_of_each_group(docs: DataFrame, like: Likeness = Likeness(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group of docs, with all its columns: the one with the smallest id (null ids come last).

    Rows are told apart by id and text: if an id stands on rows with different texts, each is judged by its own. Of rows that have both in
    common one stays. Texts without words are in no group, so all of them stay, repeated ones too.
    """
    named, _ = grouped(marked(docs, id_col, text_col), like)
    first = named.where("n > 0").groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "node")).alias("first"))
    stays = first.select(F.col("first.node").alias("node"), F.lit(True).alias("stays"))
    judged = named.where("n > 0").join(stays, "node", "left").groupBy("doc_id", "m1", "m2").agg(
        F.coalesce(F.bool_or("stays"), F.lit(False)).alias("stays"), F.count(F.lit(1)).alias("copies"))
    judged = written(judged.select(F.col("doc_id").alias("k0"), F.col("m1").alias("k1"), F.col("m2").alias("k2"), "stays", "copies"))
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).alias("doc_id"),
                        F.xxhash64(text).alias("m1"), F.xxhash64(F.lit(7), text).alias("m2"))
    same = [keyed["doc_id"].eqNullSafe(F.col("k0")), keyed["m1"] == F.col("k1"), keyed["m2"] == F.col("k2")]
    kept = keyed.join(judged.where("NOT stays OR copies > 1"), same, "left_anti").select("row")
    repeated = judged.where("stays AND copies > 1")
    if not repeated.isEmpty():
        once = keyed.join(repeated, same, "left_semi").groupBy("doc_id", "m1", "m2").agg(F.first("row").alias("row"))
        kept = kept.unionByName(once.select("row"))
    return kept.select("row.*")
