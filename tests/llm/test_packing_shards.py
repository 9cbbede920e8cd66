import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablelens.llm import decontamination, packing, sharding
from llm_rows import ROWS


def check_packed(out, cap):
    """Every sequence is gapless from 0 and within each capacity."""
    by = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= cap.tokens and len(pieces) <= cap.documents and sum(n * n for _, n in pieces) <= cap.cost
    return len(by)


def test_packing_round_trip_with_the_tokenizer(spark, sf_dir, odd, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").unionByName(
        odd.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"]).select((F.col("doc_id") + 10 ** 6).alias("doc_id"), "text")).unionByName(
        spark.createDataFrame([(2 * 10 ** 6, "a <|endoftext|> b  c"), (2 * 10 ** 6 + 1, "x \n y  z\n\n  w"), (2 * 10 ** 6 + 2, " lead  and trail ")],
                              "doc_id long, text string"))
    out = packing.pack(docs, keep_ids=True).collect()
    pieces = {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
    for doc, text in docs.collect():
        ids = whole.encode(text or "", add_special_tokens=False).ids + [packing.END_ID]
        own = sorted(pieces[doc], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(len(own))) and all(r.length == 1024 for r in own[1:])
        assert np.frombuffer(b"".join(r.ids for r in own), "<u4").tolist() == ids
        assert all(r.ids_crc32 == zlib.crc32(r.ids) and r.start == sum(x.length for x in own[:r.piece]) for r in own)
    total = sum(r.length for r in out)
    assert check_packed(out, packing.Capacity()) <= -(-total // 1024) + 2
    assert packing.pack(empty).count() == 0 and packing.pack(odd).count() >= len(ROWS)


def best_fit(items, cap):
    """Best fit decreasing, one item at a time."""
    bins = []
    for n in sorted(items, reverse=True):
        item, room = np.array([n, 1, n * n]), None
        for b in bins:
            if (b >= item).all() and (room is None or b[0] < room[0]):
                room = b
        if room is None:
            room = np.array([cap.tokens, cap.documents, cap.cost])
            bins.append(room)
        room -= item
    return len(bins)


@pytest.mark.parametrize("cap", [packing.Capacity(), packing.Capacity(documents=3), packing.Capacity(cost=300_000), packing.Capacity(rule="dot"),
                                 packing.Capacity(documents=4, cost=500_000, rule="dot")])
def test_plan_over_counts_is_a_packing(cap):
    rng = random.Random(2)
    top = int(cap.cost ** 0.5)
    items = [min(top, rng.choice([rng.randrange(1, 1025), rng.randrange(1, 60), 512])) for _ in range(3000)]
    counts = {n: items.count(n) for n in set(items)}
    bins, placed = {}, dict.fromkeys(counts, 0)
    for length, number, n, first, each, offset in packing.plan(counts, cap):
        assert number == placed[length]
        placed[length] += n
        for i in range(n):
            bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
    assert placed == counts

    class Row:
        def __init__(self, s, o, n):
            self.sequence_id, self.offset, self.length = s, o, n

    used = check_packed([Row(s, o, n) for s, b in bins.items() for o, n in b], cap)
    if cap == packing.Capacity():
        assert used <= best_fit(items, cap) * 1.002 + 1


def test_a_piece_over_a_capacity_is_refused():
    with pytest.raises(ValueError):
        packing.plan({600: 1}, packing.Capacity(cost=1000))


def check_shards(rows, shards):
    sizes = [0] * shards
    slots = [[] for _ in range(shards)]
    for r in rows:
        sizes[r.shard] += 1
        slots[r.shard].append(r.slot)
        assert r.law == "rows" and r.grown_shard is None
    assert max(sizes) - min(sizes) <= 1 and all(sorted(s) == list(range(len(s))) for s in slots)


def test_shards_are_even_and_keep_groups_together(spark):
    text = F.expr("CASE WHEN id < 700 THEN 'hot' WHEN id < 1400 THEN concat('g', id % 200) ELSE concat('u', id) END")
    rows = sharding.assign(spark.range(2100).select(F.col("id").alias("doc_id"), text.alias("text"))).collect()
    check_shards(rows, 8)
    where = {}
    for r in rows:
        if 700 <= r.doc_id < 1400:
            where.setdefault(r.doc_id % 200, set()).add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) <= 10  # the hot group must be cut, nearly no other
    one = next(r for r in rows if r.doc_id == 0)
    assert (one.size, one.text_crc32) == (4, zlib.crc32(b"hot"))


@pytest.mark.parametrize("n", [0, 1, 3, 17])
def test_few_rows_over_many_shards(spark, n):
    check_shards(sharding.assign(spark.range(n).selectExpr("id AS doc_id", "'same' AS text")).collect(), 8)


def test_shards_of_odd_rows(odd):
    rows = sharding.assign(odd, 3).collect()
    assert len(rows) == len(ROWS)
    check_shards(rows, 3)


def fitting(segment, text):
    """Least edits of the segment anywhere in the text."""
    before = [0] * (len(text) + 1)
    for i, a in enumerate(segment):
        now = [i + 1]
        for j, b in enumerate(text):
            now.append(min(before[j] + (a != b), before[j + 1] + 1, now[j] + 1))
        before = now
    return min(before)


def test_decontamination_matches_full_alignment(spark):
    rng = random.Random(4)
    fresh = lambda n: " ".join("".join(rng.choice("etaoin") for _ in range(rng.randrange(2, 8))) for _ in range(n))
    items = [(i, fresh(rng.randrange(8, 60))) for i in range(6)] + [(6, "short"), (7, ""), (8, None)]
    docs = []
    for i in range(60):
        body = list(items[i % 6][1])
        for _ in range(int(len(body) * rng.choice([0, 0.02, 0.05, 0.08, 0.12]))):
            body[rng.randrange(len(body))] = rng.choice(["", "e", "xy", ", "])
        docs.append((i, fresh(4) + " ~ " + "".join(body).upper() + "\n" + fresh(4)))
    docs += [(100, None), (101, ""), (102, fresh(300))]
    index = decontamination.Index([(i, t) for i, t in items if t is not None], decontamination.Bounds())
    want = set()
    for doc, text in docs:
        codes = decontamination.characters([text])[0].tolist()
        want |= {(doc, index.items[o]) for s, o, e in zip(index.segments, index.owner, index.edits) if fitting(s.tolist(), codes) <= e}
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontamination.contaminated(frame, bench).collect()}
    assert got == want and 20 < len(got) < 60
    kept = decontamination.drop_contaminated(frame, bench)
    assert {r.doc_id for r in kept.collect()} == {d for d, _ in docs} - {d for d, _ in want}


def test_partial_quotes_are_found_at_every_offset(spark):
    rng = random.Random(8)
    fresh = lambda n: "".join(rng.choice("etaoin") for _ in range(n))
    item = " ".join(fresh(rng.randrange(2, 8)) for _ in range(50))
    around = lambda quote: f"{fresh(30)} # {quote} # {fresh(30)}"
    docs = [around(item[s:s + 66]) for s in range(len(item) - 65)]  # 64 without the blanks at the ends
    verbatim = len(docs)
    for _ in range(24):
        start = rng.randrange(len(item) - 75)
        body = list(item[start:start + rng.randrange(50, 75)])
        for at in rng.sample(range(len(body)), rng.randrange(7)):
            body[at] = rng.choice(["", "z", body[at] + "q"])
        docs.append(around("".join(body)))
    bench = spark.createDataFrame([(5, item)], "item_id long, text string")
    frame = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    got = {r.doc_id for r in decontamination.contaminated(frame, bench).collect()}
    assert set(range(verbatim)) <= got
    letters, kinds = [ord(c) for c in item], set()
    for doc in range(verbatim, len(docs)):
        codes = decontamination.characters([docs[doc]])[0].tolist()
        must, may = (any(fitting(letters[s:s + n], codes) <= 4 for s in range(len(letters) - n + 1)) for n in (64, 60))
        assert must <= (doc in got) <= may, docs[doc]
        kinds.add((must, may))
    assert {(True, True), (False, False)} <= kinds
    assert {r.doc_id for r in decontamination.drop_contaminated(frame, bench).collect()} == set(range(len(docs))) - got


def test_benchmark_blocks_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_CHARS", 100)
    bench = spark.createDataFrame([(i, f"item {i} " + "abcdefgh " * 6) for i in range(5)], "item_id long, text string")
    assert len(list(decontamination.blocks(bench, decontamination.Bounds()))) == 5
    docs = spark.createDataFrame([(1, "item 3 " + "abcdefgh " * 6)], "doc_id long, text string")
    assert (1, 3) in {(r.doc_id, r.item_id) for r in decontamination.contaminated(docs, bench).collect()}


def test_decontamination_of_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "lorem ipsum " * 5)], "item_id long, text string")
    hits = decontamination.contaminated(odd, bench).collect()
    assert {r.doc_id for r in hits} == {6, 7} and all(r.edits == 0 for r in hits)
    assert decontamination.contaminated(empty, bench).count() == 0 and decontamination.contaminated(odd, bench.limit(0)).count() == 0
    assert decontamination.drop_contaminated(odd, bench).columns == odd.columns


def cut_edges(shard_of, texts):
    """Pairs of equal texts in different shards."""
    return sum(shard_of[a] != shard_of[b] for a in texts for b in texts if a < b and texts[a] == texts[b])


def test_cut_edges_against_all_ways_to_shard(spark):
    """Small groups on two shards: the best of all assignments of whole groups that keep counts one apart, and drawing rows at random."""
    sizes = [5, 4, 4, 3, 3, 3, 2, 2, 2, 2, 1, 1]
    texts = {i: f"text {g}" for i, g in enumerate(g for g, n in enumerate(sizes) for _ in range(n))}
    edges = sum(n * (n - 1) // 2 for n in sizes)
    best = min(cut_edges({i: (way >> int(t.split()[1])) & 1 for i, t in texts.items()}, texts) for way in range(1 << len(sizes))
               if abs(2 * sum(n for g, n in enumerate(sizes) if (way >> g) & 1) - len(texts)) <= 1)
    assert best == 0
    rows = sharding.assign(spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3), 2).collect()
    check_shards(rows, 2)
    cut = cut_edges({r.doc_id: r.shard for r in rows}, texts)
    assert cut <= 0.25 * edges  # at random about half of all edges are cut
