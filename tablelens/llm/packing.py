"""Best-fit packing: documents as token pieces in as few sequences as the rule can reach.

Only the counts of pieces by length reach the driver. Pieces of one length are the same item, so the best-fit-decreasing plan over
the counts is the plan over all pieces; each piece then finds its place by its number among the pieces of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.llm.spread import numbered, read, written

END_ID = 2
#: Chunks of text whose ids one worker remembers.
REMEMBERED = 1 << 19
#: White space before a space: there, cutting the text at its spaces could cut a piece of the tokenizer's own split.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] ")


@dataclass(frozen=True)
class Capacity:
    """What one sequence may hold; the cost of attention is the sum of squared lengths of its pieces."""

    tokens: int = 1024
    documents: int = 1024
    cost: int = 1024 * 1024
    weights: tuple[float, float, float] = (1.0, 1e-3, 1e-3)
    rule: str = "norm"  # or "dot"


class Tokens(dict):
    """Ids of text chunks as little-endian bytes; a chunk starts at a space, which the key leaves out."""

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, chunk: str) -> bytes:
        ids = np.array(self.plain(" " + chunk), "<u4").tobytes()
        if "\n" not in chunk:
            if len(self) >= REMEMBERED:
                self.clear()
            self[chunk] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """The tokenizer's ids of a whole text. Words recur, so most chunks are remembered."""
        if any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if any(s in text for s in ("  ", "\n ", "\t ", "\r ", "\v ", "\f ")) or not text.isascii() and _OTHER_SPACE.search(text):
            return np.array(self.plain(text), "<u4").tobytes()
        first, *rest = text.split(" ")
        return np.array(self.plain(first), "<u4").tobytes() + b"".join(map(self.__getitem__, rest))


def token_pieces(docs: DataFrame, max_tokens: int = 1024, id_col: str = "doc_id", text_col: str = "text",
                 keep_ids: bool = False) -> DataFrame:
    """Cuts each document into pieces of max_tokens ids, the first of which may be shorter.

    A document is the ids of its text and one end id, so a null or empty text is one piece of one id. ids come along as bytes
    if keep_ids is set.
    """
    import public_tokenizers

    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {id_type}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(*paths)
        end, size = END_ID.to_bytes(4, "little"), 4 * max_tokens
        for batch in batches:
            at, number, start, length, crc, kept = [], [], [], [], [], []
            for row, text in enumerate(batch.column(1)):
                ids = tokens.ids(text.as_py() or "") + end
                low, high, n = 0, len(ids) % size or size, 0
                while low < len(ids):
                    part = ids[low:high]
                    at.append(row)
                    number.append(n)
                    start.append(low // 4)
                    length.append(len(part) // 4)
                    crc.append(zlib.crc32(part))
                    if keep_ids:
                        kept.append(part)
                    low, high, n = high, high + size, n + 1
            columns = [batch.column(0).take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                       pa.array(length, pa.int64()), pa.array(crc, pa.int64())] + [pa.array(kept, pa.binary())] * keep_ids
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(cut, schema)


def plan(counts: dict[int, int], cap: Capacity = Capacity()) -> list[tuple[int, int, int, int, int, int]]:
    """Vector best fit, longest pieces first, over counts of equal pieces.

    Sequences of equal content form one class with an interval of numbers. Of the classes with room under every capacity, a
    length takes the one with the least weighted norm of what would be left ("norm"), or the largest weighted product of piece
    and room ("dot"). Returns runs: length, number of the first piece, pieces, first sequence, pieces in a sequence, offset.
    """
    full = np.array([cap.tokens, cap.documents, cap.cost], float)
    weights = np.array(cap.weights)
    room, first, many = np.zeros((0, 3)), [], []
    runs, opened = [], 0
    for length in sorted(counts, reverse=True):
        item = np.array([length, 1, length * length], float)
        if (item > full).any():
            raise ValueError(f"a piece of {length} tokens is over a capacity")
        number, left = 0, counts[length]
        while left:
            fits = np.flatnonzero((room >= item).all(axis=1))
            if not len(fits):
                each = int((full // item).min()) if cap.rule == "norm" else 1
                need = -(-left // each)
                room = np.vstack([room, full])
                first.append(opened)
                many.append(need)
                opened += need
                continue
            if cap.rule == "norm":
                best = fits[np.argmin(((weights * (room[fits] - item) / full) ** 2).sum(axis=1))]
            else:
                best = fits[np.argmax((weights * room[fits] * item / full ** 2).sum(axis=1))]
            each = int((room[best] // item).min()) if cap.rule == "norm" else 1
            each = min(each, left)
            used = min(many[best], left // each)
            runs.append((length, number, used * each, first[best], each, int(full[0] - room[best][0])))
            number, left = number + used * each, left - used * each
            after = room[best] - each * item
            if used == many[best]:
                room[best] = after
            else:
                room = np.vstack([room, after])
                first.append(first[best])
                many.append(used)
                first[best] += used
                many[best] -= used
        open_ = room[:, 0] >= 1
        if not open_.all():
            first = [x for x, o in zip(first, open_) if o]
            many = [x for x, o in zip(many, open_) if o]
            room = room[open_]
    return runs


def pack(docs: DataFrame, cap: Capacity = Capacity(), id_col: str = "doc_id", text_col: str = "text",
         keep_ids: bool = False) -> DataFrame:
    """Packs all documents: one row per piece with its sequence and its place there.

    Null and empty texts are pieces of the end id alone; repeated rows and null ids are packed as rows of their own; an empty
    table gives no rows; other columns are not read. Places in a sequence have no gaps.
    """
    pieces = written(token_pieces(docs, cap.tokens, id_col, text_col, keep_ids))
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = docs.sparkSession.createDataFrame(
        plan(counts, cap), "run_length long, run_first long, run_n long, run_sequence long, run_each long, run_offset long")
    placed = numbered(pieces, "length", ["doc_id", "piece", "ids_crc32"], sum(counts.values()))
    into = F.col("rank") - F.col("run_first")
    return (placed.join(F.broadcast(runs), (F.col("length") == F.col("run_length")) & (into >= 0) & (into < F.col("run_n")))
            .select(*pieces.columns,
                    (F.col("run_sequence") + F.floor(into / F.col("run_each"))).alias("sequence_id"),
                    (F.col("run_offset") + F.pmod(into, F.col("run_each")) * F.col("length")).alias("offset")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read(spark, sf_dir, "documents"))
