"""The registered queries of this subpackage and the SQL that states their results where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablelens.llm import context_tree, decontamination, exact_dedup, licences, merkle, ngram_join, packing, phrases, pii, quality, secrets, sharding, toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": decontamination.op1,
    "op2_context_tree_weighting": context_tree.op2,
    "op3_exact_dedup": exact_dedup.op3,
    "op4_pii": pii.op4,
    "op5_label_propagation": sharding.op5,
    "op6_ngram_jaccard_join": ngram_join.op6,
    "op7_licence_scan": licences.op7,
    "op8_secret_scan": secrets.op8,
    "op9_toxicity": toxicity.op9,
    "op10_best_fit_packing": packing.op10,
    "op11_merkle_manifest": merkle.op11,
    "op12_quality_neighbours": quality.op12,
    "op13_phrase_mining": phrases.op13,
}
SQL: dict[str, str] = {
    "op3_exact_dedup": exact_dedup.OP3_SQL,
    "op4_pii": pii.OP4_SQL,
    "op6_ngram_jaccard_join": ngram_join.OP6_SQL,
    "op7_licence_scan": licences.OP7_SQL,
    "op8_secret_scan": secrets.OP8_SQL,
    "op11_merkle_manifest": merkle.OP11_SQL,
    "op13_phrase_mining": phrases.OP13_SQL,
}
