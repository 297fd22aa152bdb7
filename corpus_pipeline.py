"""From raw documents to packed training sequences: toxicity, near-duplicates, repeated strings, mixing, packing.

All stages but the last return the columns of the documents they get, whatever their names; an empty table stays empty. Rows with equal ids
are separate rows but for the near-duplicate stage, which keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import mixing, packing, similar, substrings, toxicity
from lacuna.llm.common import Scratch
from lacuna.llm.queries import byte_bpe, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier calls toxic go. Null and empty texts stay, as does everything if there are no labels."""
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), Scratch(spark, "stage-toxicity"))
    return toxicity.drop_toxic(docs, model)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of texts whose five-word shingles are at least 0.8 similar, the document with the smallest id stays.

    Texts without words are one group; documents without an id are no group's and stay.
    """
    return similar.keep_one(docs, Scratch(spark, "stage-simhash"))


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Strings of ``substrings.PASSAGE`` bytes that are found anywhere else too are cut out of the texts; documents without a word left go.

    Null, empty and wordless texts have nothing to lose and stay.
    """
    return substrings.remove_repeats(docs, Scratch(spark, "stage-substrings"), substrings.PASSAGE, substrings.PASSAGE_GRAM)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document is there as often as the mix takes it, twice at most. A null source is a source of its own."""
    return mixing.take_mix(docs, Scratch(spark, "stage-mixing"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences, with their ids and checksums. Null and empty texts are a piece of just the end id."""
    return packing.pack_documents(docs, byte_bpe()).withColumn("ids_crc32", F.crc32("ids"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", toxicity_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("suffix-array dedup", substring_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: SQL can express neither the classifier nor the fingerprints; tests compare the stages with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = scratch.table(stage(spark, docs, sf_dir), f"stage{number}")
        scratch.drop(f"stage{number - 1}")  # no later stage reads it
    return docs
