"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping segments: short ones that begin so close together that any passage a little longer holds one
whole, wherever it begins, and long ones, which may hold more edits. A segment of w characters that stands in a text with at most e edits shares at
least w + 1 - q (e + 1) of its q-grams with it, on diagonals no more than e apart. So shared q-grams are counted in overlapping
bands of diagonals, regions that reach this bound are retained, and a banded alignment verifies them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.bytes import U64, mixed, slices
from tablelens.llm.spread import read

#: Bits of the first, cheap test of a q-gram; characters of benchmark text that one index holds.
TEST_BITS, BLOCK_CHARS = 22, 1 << 22
#: Shared q-grams, counted once for each segment they stand in, that are sorted at once (one segment with more is taken whole).
REGION_HITS = 1 << 20
_SPACE, _OUTSIDE = np.uint32(32), np.uint32(0xFFFFFFFF)
_PLAIN = np.array([c if chr(c).isalnum() else 32 for c in range(128)], np.uint32)


@dataclass(frozen=True)
class Bounds:
    q: int = 10
    segment: int = 160
    edits: float = 0.075
    passage: int = 60

    def budget(self, width: int) -> int:
        """Edits allowed; few enough for the lemma to ask for a shared q-gram at least."""
        return min(int(self.edits * width), width // self.q - 1)

    def lengths(self, n: int) -> list[tuple[int, int]]:
        """Lengths of the segments of an item of n characters, and from one start to the next; an item no longer is one segment."""
        if n < self.q:
            return []
        short = [(self.passage, self.budget(self.passage) + 1)]
        return short + ([(self.segment, max(1, self.segment // 2))] if n >= self.segment else [(n, n)] if n > self.passage else [])


def characters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points in lower case, each run of other ASCII than letters and digits as one space, and where each text begins."""
    parts = [(t or "").lower().encode("utf-32-le", "surrogatepass") for t in texts]
    at = np.concatenate([[0], np.cumsum([len(p) // 4 for p in parts])]).astype(np.int64)
    codes = np.frombuffer(b"".join(parts), np.uint32)
    codes = np.where(codes < 128, _PLAIN[np.minimum(codes, 127)], codes)
    space = codes == _SPACE
    follows = np.concatenate([[True], space[:-1]])
    follows[at[:-1][at[:-1] < len(codes)]] = True
    keep = ~(space & follows)
    return codes[keep], np.concatenate([[0], np.cumsum(keep)])[at]


def gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of the q characters from each place on, by doubling the width."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    h, width = codes.astype(U64) + U64(1), 1
    done, covered = np.zeros(n, U64), 0
    while True:
        if q & width:
            done = done * U64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + h[covered:covered + n]
            covered += width
        if covered == q:
            return mixed(done)
        h = h[:-width] * U64(pow(0x9E3779B97F4A7C15, width, 1 << 64)) + h[width:]
        width *= 2


class Index:
    """Segments of a block of benchmark items, and where the q-grams of the items stand.

    Short segments begin at every (edits + 1)th character and at the last place; long ones, with more edits in all, every half.
    """

    def __init__(self, items: list[tuple[object, str]], bounds: Bounds):
        self.bounds, self.items = bounds, [i for i, _ in items]
        self.codes, at = characters([t for _, t in items])
        ends = at[1:] - ((at[1:] > at[:-1]) & (self.codes[at[1:] - 1] == _SPACE) if len(self.codes) else 0)
        begin, width, owner = [], [], []
        for number, n in enumerate((ends - at[:-1]).tolist()):
            for most, step in bounds.lengths(n):
                w = min(most, n)
                starts = sorted({*range(0, n - w, step), n - w})
                begin.append(int(at[number]) + np.array(starts, np.int64))
                width.append(np.full(len(starts), w))
                owner.append(np.full(len(starts), number))
        self.begin, self.width, self.owner = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (begin, width, owner))
        self.edits = np.array([bounds.budget(w) for w in self.width.tolist()], np.int64)
        self.least = self.width + 1 - bounds.q * (self.edits + 1)
        h = gram_hashes(self.codes, bounds.q)
        spot = np.flatnonzero(np.arange(len(h)) + bounds.q <= np.repeat(ends, np.diff(at))[:len(h)])
        order = spot[np.argsort(h[spot], kind="stable")]
        self.spot_of = order.astype(np.int32)
        self.gram, self.first = np.unique(h[order], return_index=True)
        self.first = np.append(self.first, len(order))
        self.test = np.zeros(1 << TEST_BITS, bool)
        self.test[(self.gram >> U64(64 - TEST_BITS)).astype(np.int64)] = True

    @property
    def segments(self) -> list[np.ndarray]:
        return [self.codes[b:b + w] for b, w in zip(self.begin.tolist(), self.width.tolist())]

    def matches(self, texts: list[str | None]) -> list[tuple[int, int, int, int]]:
        """text number, item number, segments found, edits of the best, for each text and item that share a segment."""
        codes, at = characters(texts)
        h = gram_hashes(codes, self.bounds.q)
        place = np.flatnonzero(self.test[(h >> U64(64 - TEST_BITS)).astype(np.int64)]) if len(self.gram) else np.zeros(0, np.int64)
        number = np.searchsorted(self.gram, h[place])
        number[number == len(self.gram)] = 0
        text = np.searchsorted(at, place, "right") - 1
        ok = (self.gram[number] == h[place]) & (place + self.bounds.q <= at[text + 1]) if len(place) else np.zeros(0, bool)
        place, number, text = place[ok], number[ok], text[ok]
        if not len(place):
            return []
        many = self.first[number + 1] - self.first[number]
        hit = np.repeat(self.first[number] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        spot, place, text = self.spot_of[hit].astype(np.int64), np.repeat(place, many), np.repeat(text, many)
        order = np.argsort(spot, kind="stable")
        spot, place, text = spot[order], place[order], text[order]
        low = np.searchsorted(spot, self.begin)
        many = np.searchsorted(spot, self.begin + self.width - self.bounds.q, "right") - low
        rich = np.flatnonzero(many >= self.least)
        best: dict[tuple[int, int], tuple[set, int]] = {}
        for part in np.split(rich, np.flatnonzero(np.diff(np.cumsum(many[rich]) // REGION_HITS)) + 1):
            segment, n = np.repeat(part, many[part]), many[part]
            hit = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            segment, of_text, band = self._regions(segment, text[hit], place[hit] - spot[hit] + self.begin[segment])
            edits = self.align(codes, at, segment, of_text, band)
            for s, t, e in zip(segment.tolist(), of_text.tolist(), edits.tolist()):
                if e <= self.edits[s]:
                    found, least = best.get((t, int(self.owner[s])), (set(), e))
                    found.add(s)
                    best[t, int(self.owner[s])] = (found, min(e, least))
        return [(t, i, len(found), e) for (t, i), (found, e) in sorted(best.items())]

    def _regions(self, segment: np.ndarray, text: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
        """segment, text and band of the bands that hold enough shared q-grams."""
        if not len(segment):
            return np.zeros((3, 0), np.int64)
        band = diagonal // (self.edits[segment] + 1)  # band b holds the diagonals from b * step to (b + 2) * step
        least, bands, texts = band.min() - 1, int(band.max() - band.min()) + 2, int(text.max()) + 1
        key = (segment * texts + text) * bands + (band - least)
        key = np.sort(np.concatenate([key, key - 1]))
        new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        shared, key = np.diff(np.append(new, len(key))), key[new]
        owner = key // bands
        region = np.stack([owner // texts, owner % texts, key % bands + least])
        return region[:, shared >= self.least[region[0]]]

    def align(self, codes: np.ndarray, at: np.ndarray, segment: np.ndarray, text: np.ndarray, band: np.ndarray) -> np.ndarray:
        """Least edits of each whole segment within its band; the text around it is free. All regions advance together."""
        if not len(segment):
            return np.zeros(0, np.int64)
        out = np.empty(len(segment), np.int64)
        order = np.argsort(self.width[segment], kind="stable")
        for low in range(0, len(segment), 4096):
            part = order[low:low + 4096]
            out[part] = self._align(codes, at, segment[part], text[part], band[part])
        return out

    def _align(self, codes, at, segment, text, band) -> np.ndarray:
        edits, width = self.edits[segment], self.width[segment]
        first = band * (edits + 1) - edits  # lowest diagonal, with room for the edits
        columns, rows = int((4 * edits + 2).max()), int(width.max())
        chars = self.codes[np.minimum(self.begin[segment] + np.arange(rows)[:, None], len(self.codes) - 1)]
        place = first + np.arange(rows + columns)[:, None]
        inside = (place >= at[text]) & (place < at[text + 1])
        around = np.where(inside, codes[np.where(inside, place, 0)], _OUTSIDE)
        slope = np.arange(columns, dtype=np.int32)[:, None]
        cost = np.zeros((columns, len(segment)), np.int32)
        for row in range(rows):
            step = cost + (around[row:row + columns] != chars[row])
            step[:-1] = np.minimum(step[:-1], cost[1:] + 1)
            step = np.minimum.accumulate(step - slope, axis=0) + slope
            cost = step if row < width.min() else np.where(row < width, step, cost)
        return cost.min(axis=0)


def blocks(benchmark: DataFrame, bounds: Bounds, id_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes over all items in turn, each over a bounded amount of text (one longer item is a block of its own)."""
    held, size = [], 0
    rows = benchmark.where(F.col(text_col).isNotNull()).select(id_col, text_col)
    for item, text in rows.toLocalIterator():
        if held and size + len(text) > BLOCK_CHARS:
            yield Index(held, bounds)
            held, size = [], 0
        held.append((item, text))
        size += len(text)
    if held:
        yield Index(held, bounds)


def contaminated(docs: DataFrame, benchmark: DataFrame, bounds: Bounds = Bounds(), id_col: str = "doc_id",
                 text_col: str = "text") -> DataFrame:
    """doc_id, item_id, segments, edits: one row for each document and item that share a segment within the edit budget.

    Case, punctuation and spacing do not count. Null and empty texts match nothing, nor do items under q characters; repeated rows
    and null ids are searched as rows of their own; without documents or items there are no rows; other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    item_type = benchmark.schema["item_id"].dataType
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {item_type.simpleString()}, segments long, edits long"
    found = docs.sparkSession.createDataFrame([], schema)
    for index in blocks(benchmark, bounds):
        found = found.unionByName(rows.mapInArrow(_finder(index), schema))
    return found


def _finder(index: Index):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                hits = index.matches(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array([h[0] for h in hits], pa.int32())),
                     pa.array(index.items).take(pa.array([h[1] for h in hits], pa.int32())),
                     pa.array([h[2] for h in hits], pa.int64()), pa.array([h[3] for h in hits], pa.int64())],
                    ["doc_id", "item_id", "segments", "edits"])

    return find


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, bounds: Bounds = Bounds(), text_col: str = "text") -> DataFrame:
    """The rows of docs, with all their columns, that share no segment with the benchmark; decided where they are read.

    Null and empty texts share none and stay; repeated rows and ids are judged by their own texts. Without items all rows stay.
    """
    at = docs.columns.index(text_col)
    for index in blocks(benchmark, bounds):
        docs = docs.mapInArrow(_cleaner(index, at), docs.schema)
    return docs


def _cleaner(index: Index, at: int):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                keep = np.ones(part.num_rows, bool)
                keep[[h[0] for h in index.matches(part.column(at).to_pylist())]] = False
                yield part.filter(pa.array(keep))

    return clean


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
