"""Records of CSV files whose quoted fields hold line breaks, found in parallel: files stay splittable.

Whether a line break ends a record depends on all quotes before it. So each split first tells how it would turn either state, inside
or outside of quotes, into a state at its end. These few rows, put together in file order, give the state in which each split begins. Then
every split cuts its own lines into records, and what a split's end leaves open is joined with the beginnings of the next ones.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablelens.functions.text import literal

#: Characters that stand for a line break within a record while each record is a line of text; one that the files do not use is taken.
STAND_INS = [chr(c) for c in (*range(1, 9), *range(14, 32))]


def file_lines(spark: SparkSession, path: str, sep: str) -> DataFrame:
    """file, start (of the split), line, and the state after the line if it begins outside (out) or inside (inn) of quotes.

    A quote opens a field only where the field begins; within quotes, two quotes are one of the text.
    """
    s = re.escape(sep)
    body = '[^"]*+(?:""[^"]*+)*+'
    # whole fields up to a last one that opens and does not close
    opens = f'(?:(?:"{body}"[^{s}]*+|[^"{s}][^{s}]*+)?{s})*+"{body}'
    rows = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.col("value").alias("line"))
    quoted = F.contains("line", F.lit('"'))
    again = f'{body}"[^{s}]*+{s}{opens}'  # closes, and opens another field
    test = lambda regex: F.expr(f"line RLIKE {literal(rf'\A(?:{regex})\z')}")
    return rows.select("*", (quoted & test(opens)).alias("out"), (~quoted | test(body) | test(again)).alias("inn"))


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple[str, int], pa.RecordBatch]]:
    """Rows of the same file and split, which follow each other."""
    starts = batch.column(1).to_numpy()
    files = batch.column(0).dictionary_encode().indices.to_numpy()
    cuts = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1]) | (files[1:] != files[:-1]), [True]])) if len(starts) else []
    for low, high in zip(cuts[:-1], cuts[1:]):
        yield (batch.column(0)[int(low)].as_py(), int(starts[low])), batch.slice(int(low), int(high - low))


def states(out: np.ndarray, inn: np.ndarray, inside: bool) -> np.ndarray:
    """The state after each line, if the first begins in the given one."""
    # lines either fix the state, keep it, or turn it round; after the last fixing one, only the number of turns counts
    fixed = out == inn
    turns = np.cumsum(out & ~inn)
    last = np.maximum.accumulate(np.where(fixed, np.arange(len(out)), -1))
    base = np.where(last >= 0, out[np.maximum(last, 0)], inside)
    since = turns - np.where(last >= 0, turns[np.maximum(last, 0)], 0)
    return base ^ (since % 2 == 1)


def split_effects(lines: DataFrame) -> DataFrame:
    """file, start, out, inn: the state after each whole split if it begins outside or inside of quotes; closes: whether a split that begins
    inside ends that record; used: the stand-ins that occur.
    """
    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[str, int], tuple[bool, bool, bool]] = {}
        used: set[str] = set()
        for batch in batches:
            for key, part in _runs(batch):
                out, inn = (part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4))
                from_out, from_in, closes = seen.get(key, (False, True, False))
                after = states(out, inn, from_in)
                seen[key] = bool(states(out, inn, from_out)[-1]), bool(after[-1]), closes or not after.all()
            used |= {c for c in STAND_INS if c not in used and pc.any(pc.match_substring(batch.column(2), c)).as_py()}
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([f for f, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.int64()), pa.array([seen[k][0] for k in keys]),
             pa.array([seen[k][1] for k in keys]), pa.array([seen[k][2] for k in keys]),
             pa.array(["".join(sorted(used))] * len(keys), pa.string())], ["file", "start", "out", "inn", "closes", "used"])

    return lines.mapInArrow(fold, "file string, start bigint, out boolean, inn boolean, closes boolean, used string")


class OpenQuotes(Exception):
    """A file ends within quotes."""


def record_lines(spark: SparkSession, path: str, sep: str) -> tuple[DataFrame, str] | None:
    """One row per record: first (whether it is the first of its file) and line, in which line breaks are stand-ins; and the stand-in.

    None if no record holds a line break, so that any reader of lines will do. Only figures of splits pass the driver, as file listings do.
    """
    lines = file_lines(spark, path, sep)
    if lines.where("out").isEmpty():
        return None
    effects = sorted(split_effects(lines).collect(), key=lambda r: (r["file"], r["start"]))
    used = set("".join(r["used"] for r in effects))
    mark = next((c for c in STAND_INS if c not in used), None)
    if mark is None:
        raise PySparkException("every control character occurs in the file")
    begins, file, inside = {}, None, False
    for r in effects:
        if r["file"] != file:
            if inside:
                raise OpenQuotes(file)
            file, inside = r["file"], False
        begins[r["file"], r["start"]] = inside
        inside = r["inn"] if inside else r["out"]
    if inside:
        raise OpenQuotes(file)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole records of a split (part 0), its end (part 1) and, where it begins inside, what belongs to records before it (part -1)."""
        key, held, inside, leading, first = None, [], False, False, False
        out: list[tuple[str, int, int, bool, str]] = []

        def close(part: int) -> None:
            nonlocal first
            out.append((*key, part, first and part >= 0, mark.join(held)))
            first = False
            held.clear()

        for batch in batches:
            for own, part in _runs(batch):
                if own != key:
                    if key is not None and (held or inside):
                        close(1 if not leading else 2)
                    key, inside = own, begins[own]
                    leading, first = inside, own[1] == 0
                after = states(*(part.column(c).to_numpy(zero_copy_only=False) for c in (3, 4)), inside)
                for line, open_ in zip(part.column(2).to_pylist(), after.tolist()):
                    held.append(line[:-1] if line.endswith("\r") else line)
                    if not open_:
                        close(-1 if leading else 0)
                        leading = False
                inside = bool(after[-1])
            if len(out) > 10_000:
                yield _rows(out)
                out.clear()
        if key is not None and held:
            close(1 if not leading else 2)
        yield _rows(out)

    made = lines.mapInArrow(cut, "file string, start bigint, part int, first boolean, line string")
    # parts of one record: the end of a split (1), whole splits within it (2), the beginning of a later split (-1)
    pieces = made.where("part <> 0")
    owner = _owners(effects, begins)
    known = spark.createDataFrame([(f, s, *owner[f, s]) for f, s in owner], "file string, start bigint, tail bigint, lead bigint")
    keyed = pieces.join(known, ["file", "start"]).withColumn("record", F.when(F.col("part") == 1, F.col("tail")).otherwise(F.col("lead")))
    joined = keyed.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("start", "part", "first", "line"))).alias("parts"))
    across = joined.select(F.exists("parts", lambda p: p["first"]).alias("first"),
                           F.array_join(F.transform("parts", lambda p: p["line"]), mark).alias("line"))
    return made.where("part = 0").select("first", "line").unionByName(across), mark


def _rows(out: list[tuple[str, int, int, bool, str]]) -> pa.RecordBatch:
    columns = list(zip(*out)) or [[], [], [], [], []]
    types = [pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types)], ["file", "start", "part", "first", "line"])


def _owners(effects: list, begins: dict) -> dict[tuple[str, int], tuple[int, int]]:
    """Of each split: the split in which the record that its end leaves open begins, and that of the record that it begins within."""
    owner, open_from, file = {}, 0, None
    for r in effects:
        key = (r["file"], r["start"])
        if r["file"] != file:
            file, open_from = r["file"], 0
        owner[key] = (r["start"], open_from)
        if not begins[key] or r["closes"]:  # else the whole split is a part of one record
            open_from = r["start"]
    return owner
