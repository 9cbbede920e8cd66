"""The pipeline against a brute-force version of every stage, on rows with planted cases."""

import random
import zlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from llm_rows import LONG
from tablelens.llm import packing

CLEAN = ["tables", "houses", "rivers", "greenly", "walking", "reads", "the", "of", "stones", "morning"]


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    rng = random.Random(11)
    fresh = lambda n: " ".join(rng.choice(CLEAN) + str(rng.randrange(1000)) for _ in range(n))
    bench = [(i, fresh(25)) for i in range(4)]
    docs = [(i, fresh(rng.randrange(3, 90))) for i in range(80)]
    kinds = {d: "clean" for d, _ in docs}

    def plant(kind, text):
        docs.append((len(docs), text))
        kinds[docs[-1][0]] = kind

    for i in range(60):
        plant("toxic", fresh(6) + f" idiot scum {rng.choice(['moron', 'scum'])} " + fresh(6))
    for i in range(10):
        plant("copy", docs[i][1].replace(" ", "  \n"))
    for i in range(10, 20):
        words = docs[60 + i][1].split()
        if len(words) > 40:
            plant("near", " ".join(words[:-1] + ["other"]))
    for i in range(6):
        plant("leak", fresh(20) + " " + bench[i % 4][1].upper() + ". " + fresh(20))
    plant("clean", LONG)
    path = tmp_path_factory.mktemp("sf")
    frame = spark.createDataFrame(docs, "doc_id long, text string").select(
        "doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.length("text").cast("long").alias("n_chars"))
    frame.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(d, 1, int(k == "toxic")) for d, k in kinds.items()], "doc_id long, quality int, toxic int").write.parquet(
        f"{path}/labels.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path), dict(docs), kinds


def test_stages_drop_what_was_planted_and_keep_clean_rows(spark, planted):
    path, docs, kinds = planted
    frame = spark.read.parquet(f"{path}/documents.parquet")
    kept = frame
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, kept, path)
        assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.select("doc_id").collect()} == {d for d, k in kinds.items() if k == "clean"}
    packed = corpus_pipeline.run(spark, path).collect()
    assert {r.doc_id for r in packed} == {d for d, k in kinds.items() if k == "clean"}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "decontamination", "packing"]
    import public_tokenizers
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in packed:
        ids = whole.encode(docs[r.doc_id], add_special_tokens=False).ids + [packing.END_ID]
        own = ids[r.start:r.start + r.length]
        assert zlib.crc32(b"".join(i.to_bytes(4, "little") for i in own)) == r.ids_crc32


def test_pipeline_of_odd_rows(spark, odd, empty, planted):
    path, _, _ = planted
    for frame in (odd, empty):
        kept = frame
        for _, stage in corpus_pipeline.STAGES[:-1]:
            kept = stage(spark, kept, path)
            assert kept.columns == frame.columns
        out = corpus_pipeline.STAGES[-1][1](spark, kept, path)
        assert out.count() >= (6 if frame is odd else 0)
