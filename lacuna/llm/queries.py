"""One query per operator, with production parameters over whole tables, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import brown, cotraining, mixing, neighbours, packing, periods, rules, simhash, substrings, tokenbin, toxicity, treap, wordpiece
from .common import Scratch


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def byte_bpe() -> str:
    return public_tokenizers.path("byte_bpe_50k.json")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.count_tokens(table(spark, sf_dir, "documents"), byte_bpe())


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.digests(packing.pack_documents(table(spark, sf_dir, "documents"), byte_bpe()))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "op3").path("tokens")
    tokenbin.write_tokens(table(spark, sf_dir, "documents"), path, byte_bpe())
    return tokenbin.digests(spark, path)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = cotraining.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op4"))
    scored = cotraining.score(docs, model)
    return scored.select("doc_id", toxicity.held_out().alias("held_out"), "text_score", "page_score", "score", "predicted")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(table(spark, sf_dir, "embeddings"), Scratch(spark, "op5"), F.col("id") % 20 == 0, k=20)


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"), Scratch(spark, "op6"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "op7"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", "predicted")


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.digests(*substrings.find_repeats(table(spark, sf_dir, "documents"), Scratch(spark, "op8")))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), Scratch(spark, "op9"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.apply_rules(table(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return brown.score(docs, brown.fit(docs, Scratch(spark, "op11")))


def op12_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.digests(periods.collapse_runs(table(spark, sf_dir, "documents"), prepare=periods.repeat_tail))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "op13")
    return treap.search(treap.build(table(spark, sf_dir, "documents"), scratch), table(spark, sf_dir, "benchmark"), scratch)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_packing": op2_packing,
    "op3_token_output": op3_token_output,
    "op4_quality": op4_quality,
    "op5_neighbours": op5_neighbours,
    "op6_simhash": op6_simhash,
    "op7_toxicity": op7_toxicity,
    "op8_substrings": op8_substrings,
    "op9_mixing": op9_mixing,
    "op10_quality_rules": op10_quality_rules,
    "op11_lm_score": op11_lm_score,
    "op12_runs": op12_runs,
    "op13_search": op13_search,
}

ORACLES: dict[str, str] = {"op9_mixing": mixing.SQL, "op10_quality_rules": rules.SQL, "op13_search": treap.SQL}
