"""Writers. All of them leave the writing to Spark, so that lost tasks leave no half files."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lacuna.operators.trees import PLACES, SENT, Lists, with_lists
from lacuna.sources.files import META

HEADER = "\t".join([*META, "features"])


def feature_lines(meta: DataFrame, cells: DataFrame, blanks: DataFrame, preds: DataFrame, fallback: DataFrame) -> DataFrame:
    """(entity, line): metadata and features in order, joined by pipes. Blanked cells get the prediction, else the feature's fallback,
    else 1, each followed by `` -``; a cell that is also blank counts as blank."""
    filled = blanks.join(preds.select("entity", "feature", F.col("value").alias("_p")), ["entity", "feature"], "left").join(fallback.select("feature", F.col("value").alias("_f")), "feature", "left")
    filled = filled.select("entity", "feature", F.concat(F.coalesce("_p", "_f", F.lit("1")), F.lit(" -")).alias("raw"))
    kept = cells.join(blanks, ["entity", "feature"], "left_anti").select("entity", "feature", "raw").unionByName(filled)
    joined = kept.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("feature", "raw"))).alias("_l"))
    text = F.array_join(F.transform("_l", lambda s: F.concat(s["feature"], F.lit("="), s["raw"])), "|")
    rows = meta.join(joined.select("entity", text.alias("_t")), "entity", "left")
    return rows.select("entity", F.concat_ws("\t", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in META), F.coalesce("_t", F.lit(""))).alias("line"))


def write_feature_tsv(lines: DataFrame, path: str) -> None:
    """Text files with one line per entity, in order; the header is a line of its own in the first one."""
    head = lines.sparkSession.createDataFrame([(0, "", HEADER)], "_o int, entity string, line string")
    rows = head.unionByName(lines.select(F.lit(1).alias("_o"), F.col("entity").cast("string").alias("entity"), "line"))
    rows.repartitionByRange("_o", "entity").sortWithinPartitions("_o", "entity").select("line").write.mode("overwrite").text(path)


def wide_table(cells: DataFrame, features: Sequence[str]) -> DataFrame:
    """One column per given feature; a missing cell is null."""
    return cells.groupBy("entity").pivot("feature", list(features)).agg(F.first("value"))


def write_wide(cells: DataFrame, features: Sequence[str], path: str) -> None:
    wide_table(cells, features).write.mode("overwrite").csv(path, header=True)


def corpus_with_manifest(texts: DataFrame, most: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(texts, manifest): texts (lang, text) cut at ``most`` characters, and their sizes."""
    from lacuna.operators.prep import token_count

    cut = texts.select("lang", F.substring("text", 1, most).alias("text"))
    return cut, cut.select("lang", F.length("text").alias("n_chars"), token_count("text").alias("n_tokens"))


def write_corpus_with_manifest(texts: DataFrame, path: str, most: int = 1_000_000) -> None:
    cut, manifest = corpus_with_manifest(texts, most)
    cut.write.mode("overwrite").partitionBy("lang").text(f"{path}/texts")
    manifest.write.mode("overwrite").csv(f"{path}/manifest", header=True)


def write_vectors(vectors: DataFrame, path: str, allowed: Sequence[str], dims: dict[str, int]) -> None:
    """Vectors with null ones zero-filled; any column that is not allowed is an error, before anything is written."""
    extra = sorted(set(vectors.columns) - set(allowed))
    if extra:
        raise ValueError(f"columns that are not allowed: {extra}")
    filled = vectors.withColumns({c: F.coalesce(c, F.array_repeat(F.lit(0.0).cast("float"), n)) for c, n in dims.items()})
    filled.write.mode("overwrite").parquet(path)


def conllu_sentences(treebank: DataFrame) -> DataFrame:
    """(lang, split, sent, text): sentences (lang, split, sent, tokens, order, or the lists of these) with ids and heads renumbered by position; an unknown head is 0. A batch of sentences is written at a time."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, heads, order, position = (Lists(batch.column(c)) for c in PLACES)
            held = np.flatnonzero(ids.known)
            asked, own = order.find(ids.row[held], ids.values[held])
            token = held[asked]
            asked, other = order.find(ids.row[token], heads.values[token])
            asked, first = np.unique(asked, return_index=True)
            asked, other = (x[heads.known[token[asked]] & position.known[other[first]]] for x in (asked, other[first]))
            head = np.zeros(len(token), np.int64)
            head[asked] = position.values[other]
            at = pa.array(position.values[own], mask=~position.known[own])
            forms, tags, deprels = (batch.column(c).flatten().take(pa.array(token)) for c in ("forms", "tags", "deprels"))
            lines = pc.binary_join_element_wise(at.cast(pa.string()), forms, "_", tags, "_", "_", pa.array(head).cast(pa.string()), deprels, "_", "_", "\t", null_handling="skip")
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in SENT), pc.binary_join_element_wise(joined(lines, at, ids.row[token], batch.num_rows, "\n"), "\n", "")], [*SENT, "text"])

    types = dict(treebank.dtypes)
    rows = with_lists(treebank, *PLACES, "forms", "tags", "deprels", whole=False)
    return rows.mapInArrow(write, ", ".join([*(f"{c} {types[c]}" for c in SENT), "text string"]))


def joined(texts: pa.Array, at: pa.Array, row: np.ndarray, n: int, between: str) -> pa.Array:
    """The texts of each of ``n`` rows, in the order of their places and of the texts, unknown places first."""
    place = np.where(at.is_valid().to_numpy(zero_copy_only=False), at.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64), np.iinfo(np.int64).min)
    order = np.lexsort((place, row))
    if len(order) and ((np.diff(row[order]) == 0) & (np.diff(place[order]) == 0)).any():
        order = np.lexsort((pc.rank(texts, tiebreaker="first").to_numpy(), place, row))
    ends = np.cumsum(np.bincount(row, minlength=n))
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(np.append(0, ends).astype(np.int32)), texts.take(pa.array(order))), between)


def write_conllu(treebank: DataFrame, path: str) -> None:
    """Text files by language and split, each of a range of sentences (lang, split, sent, tokens, order); sentences are in order within a file and from file to file."""
    rows = conllu_sentences(treebank).repartitionByRange("lang", "split", "sent").sortWithinPartitions("lang", "split", "sent")
    rows.select("lang", "split", "text").write.mode("overwrite").partitionBy("lang", "split").text(path)


def pending(grid: DataFrame, ledger: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Points of a grid that the ledger lacks."""
    return grid.join(ledger.select(*keys), list(keys), "left_anti")


def run_pending(grid: DataFrame, ledger_path: str, keys: Sequence[str], run: Callable[[DataFrame], DataFrame], schema: str) -> DataFrame:
    """Runs what the ledger (a folder of Parquet files, maybe none yet) lacks, appends the results, and returns the whole ledger."""
    spark = grid.sparkSession
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(ledger_path)
    if place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place):
        grid = pending(grid, spark.read.schema(schema).parquet(ledger_path), keys)
    run(grid).write.mode("append").parquet(ledger_path)
    return spark.read.schema(schema).parquet(ledger_path)
