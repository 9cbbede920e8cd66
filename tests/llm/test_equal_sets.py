"""Equal sets of different tasks are one node before their shingles are shuffled."""

import pytest
from pyspark.sql import functions as F

from tablelens.llm import ngram_join as nj


@pytest.mark.parametrize("sent", [1 << 20, 0])
def test_copies_of_other_tasks_have_no_postings(spark, monkeypatch, sent):
    monkeypatch.setattr(nj, "SENT_NODES", sent)
    texts = [" ".join(f"w{(k * 31 + i) % 97}x{k}" for i in range(20)) for k in range(5)]
    docs = spark.createDataFrame([(i, texts[i % 5] if i % 11 else None) for i in range(60)], "doc_id long, text string").repartition(6, F.col("doc_id"))
    kept, posted = [], nj.postings

    def seen(cards, *rest):
        kept.append(cards.count())
        return posted(cards, *rest)

    monkeypatch.setattr(nj, "postings", seen)
    rows = {r["doc_id"]: r["component_id"] for r in nj.similar_groups(docs).collect()}
    assert kept == [5]
    first = {k: min(i for i in range(60) if i % 11 and i % 5 == k) for k in range(5)}
    assert rows == {i: first[i % 5] if i % 11 else i for i in range(60)}
