"""Readers. Each gives the library's long tables; nothing is inferred, so one pass reads a file."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text): the records of CSV files, numbered from 1 in each file; quoted fields may span lines, and large files are read in splits.

    A line begins a record if an even number of quotes stands before it in its file. Splits are counted first; a running sum of their quotes and of the records that begin in
    them then tells each line its record, whichever split it lies in, and lines of one record are put together again. Quotes inside unquoted fields are not CSV and not known here.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))
    lines = lines.withColumn("no", F.monotonically_increasing_id()).withColumn("quotes", F.length("value") - F.length(F.replace("value", F.lit('"'))))
    inside = Window.partitionBy("file", "block").orderBy("no")
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # splits, not lines
    odd = lines.groupBy("file", "block").agg(F.sum("quotes").alias("quotes"))
    odd = odd.select("file", "block", (F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2).alias("open"))
    placed = lines.withColumn("so_far", F.sum("quotes").over(inside) - F.col("quotes")).join(odd, ["file", "block"])
    placed = placed.withColumn("begins", ((F.col("open") + F.col("so_far")) % 2 == 0).cast("int"))
    starts = placed.groupBy("file", "block").agg(F.sum("begins").alias("n"))
    starts = starts.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("earlier"))
    numbered = placed.withColumn("own", F.sum("begins").over(inside)).join(starts, ["file", "block"]).withColumn("record", F.col("earlier") + F.col("own"))
    whole = numbered.groupBy("file", "record").agg(F.array_sort(F.collect_list(F.struct("block", "no", "value"))).alias("lines"))
    return whole.select("file", "record", F.array_join(F.transform("lines", lambda x: x["value"]), "\n").alias("text"))


def read_categorical_csv(spark: SparkSession, path: str, number: str | None = None) -> DataFrame:
    """A CSV table with trimmed headers, everything a string; every file begins with the header, empty records are left out, and line ends inside fields are ``\\n``.

    ``number`` names a column for the order of the records, by file and record.
    """
    schema = spark.read.csv(path, header=True, inferSchema=False, multiLine=True, escape='"').schema  # reads the first record
    records = csv_records(spark, path).filter("record > 1").withColumn("text", F.regexp_replace(F.regexp_replace("text", r"\r\n", "\n"), r"\r$", "")).filter("text <> ''")
    ddl = ", ".join(f"`c{i}` string" for i in range(len(schema)))
    rows = records.select("file", "record", F.from_csv("text", ddl, {"escape": '"'}).alias("row"))
    columns = [F.col(f"row.c{i}").alias(f.name.strip()) for i, f in enumerate(schema)]
    if number is None:
        return rows.select(*columns)
    files = rows.select("file").distinct().agg(F.sort_array(F.collect_list("file")).alias("files"))  # names of files
    place = (F.array_position("files", F.col("file")) - 1) * F.lit(1 << 40) + F.col("record")
    return rows.crossJoin(F.broadcast(files)).select(*columns, place.alias(number))


def read_codebook_dataset(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """languages, values, codes and parameters of a folder. ``values`` gets its line order as ``no``."""
    return {t: read_categorical_csv(spark, f"{folder}/{t}.csv", "no" if t == "values" else None) for t in ("languages", "values", "codes", "parameters")}


#: Slips in feature fields and what they stand for.
REPAIRS = (
    ("double negationPosition_of_negative", "double negation|Position_of_negative"),
    ("double negationSVONeg_Order", "double negation|SVONeg_Order"),
    ("double negationSNegVO_Order", "double negation|SNegVO_Order"),
    ("double negationPreverbal_Negative", "double negation|Preverbal_Negative"),
    ("1 Separate word, no double negation|Word&NoDoubleNeg", "1 Separate word, no double negation"),
    ("2 Prefix, no double negation|Prefix&NoDoubleNeg", "2 Prefix, no double negation"),
    (" (= ", " (EQUALS "),
)
META = ("entity", "name", "latitude", "longitude", "genus", "family", "countrycodes")


def read_feature_tsv(spark: SparkSession, path: str, repairs: tuple[tuple[str, str], ...] = REPAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(meta, cells, blanks) of a table whose eighth field is a pipe-joined list of ``feature=value``.

    The header, whose eighth field is ``features``, and lines with fewer than eight fields are left out; further tabs belong to the list. ``?`` is a blank; other values
    must start with a number, which is the value, and the whole is ``raw``. Names are lower-cased, the last of equal ones counts.
    """
    lines = spark.read.text(path).select(F.split("value", "\t").alias("f")).filter(F.size("f") >= 8)
    lines = lines.filter(F.lower(F.trim(F.col("f")[7])) != "features")
    meta = lines.select(*(F.col("f")[i].alias(c) for i, c in enumerate(META)))
    meta = meta.withColumns({c: F.expr(f"try_cast({c} AS DOUBLE)") for c in ("latitude", "longitude")})
    field = F.array_join(F.slice("f", 8, 1_000_000), "\t")
    for old, new in repairs:
        field = F.replace(field, F.lit(old), F.lit(new))
    pieces = lines.select(F.col("f")[0].alias("entity"), F.posexplode(F.split(field, r"\|")).alias("pos", "piece")).withColumn("piece", F.trim("piece"))
    cut = F.instr("piece", "=")
    pieces = pieces.filter(cut > 0).select("entity", "pos", F.lower(F.expr("substr(piece, 1, instr(piece, '=') - 1)")).alias("feature"), F.expr("substr(piece, instr(piece, '=') + 1)").alias("raw"))
    blanks = pieces.filter(F.trim("raw") == "?").select("entity", "feature").distinct()
    held = pieces.filter(F.trim("raw") != "?").withColumn("value", F.regexp_extract("raw", r"^\s*([+-]?\d+)(?:\s|$)", 1)).filter("value <> ''")
    cells = held.groupBy("entity", "feature").agg(F.max_by("value", "pos").alias("value"), F.max_by("raw", "pos").alias("raw"))
    return meta, cells, blanks


def read_verse_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """(folder, file, text): one row per text file, in all folders below; reference and manifest files are left out, unreadable ones skipped.

    ``folder`` is the name of the one that the file lies in.
    """
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.txt").option("ignoreCorruptFiles", True).text(folder, wholetext=True)
    place = F.split(F.col("_metadata.file_path"), "/")
    rows = files.select(F.try_element_at(place, F.lit(-2)).alias("folder"), F.element_at(place, -1).alias("file"), F.col("value").alias("text"))
    return rows.filter(~F.lower("file").rlike("^(vref|manifest)"))


def parse_conllu(texts: DataFrame, min_cols: int = 8) -> DataFrame:
    """Tokens of texts (lang, split, text): sentences are set apart by blank lines, comments and split or empty tokens are skipped,
    subtypes of relations are cut. With ten columns, tokens without a tag are dropped too. ``sent`` numbers the sentences of a text."""
    sentences = texts.select("lang", "split", F.posexplode(F.split("text", BLANK_LINES)).alias("sent", "s"))
    return parse_sentences(sentences.withColumn("sent", F.col("sent").cast("long")), min_cols).select("lang", "split", "sent", F.inline("tokens"))


#: What stands between sentences.
BLANK_LINES = r"\r?\n[ \t]*\r?\n\s*"


def parse_sentences(sentences: DataFrame, min_cols: int, lists: bool = False) -> DataFrame:
    """(lang, split, sent, tokens) of sentences (lang, split, sent, s): their tokens as a list of structs in the order of the lines, or with ``lists`` the fields of ``trees.LISTS``, which cost less.

    The lines of a batch of sentences are parsed at a time.
    """
    fields = {"ids": "int", "forms": "string", "tags": "string", "heads": "int", "deprels": "string"}

    def parse(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cut = pc.split_pattern(pc.replace_substring(batch.column("s").fill_null(""), "\r\n", "\n"), "\n")
            row = np.repeat(np.arange(batch.num_rows), pc.list_value_length(cut).to_numpy(zero_copy_only=False))
            lines = pc.utf8_trim(cut.flatten(), " ")
            plain = pc.and_(pc.not_equal(lines, ""), pc.invert(pc.starts_with(lines, "#")))
            row, parts = row[plain.to_numpy(zero_copy_only=False)], pc.split_pattern(lines.filter(plain), "\t")
            size, flat = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64), parts.flatten()
            start = np.cumsum(size) - size
            whole = size >= min_cols
            row, start = row[whole], start[whole]
            raw, form, upos, head, deprel = (flat.take(pa.array(start + at)) for at in (0, 1, 3, 6, 7))
            number, up = whole_numbers(raw), whole_numbers(head)
            kept = pc.and_(pc.and_(number.is_valid(), up.is_valid()), pc.invert(pc.match_substring_regex(raw, "[-.]")))
            if min_cols >= 10:
                kept = pc.and_(kept, pc.not_equal(upos, "_"))
            values = [x.filter(kept) for x in (number, form, upos, up, pc.replace_substring_regex(deprel, "(?s):.*", ""))]
            n = np.bincount(row[kept.to_numpy(zero_copy_only=False)], minlength=batch.num_rows)
            held, offsets = pa.array(np.flatnonzero(n)), pa.array(np.append(0, np.cumsum(n[n > 0])).astype(np.int32))
            flats = dict(zip(fields, values, strict=True)) if lists else {"tokens": pa.StructArray.from_arrays(values, ["id", "form", "upos", "head", "deprel"])}
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(held) for c in ("lang", "split", "sent")), *(pa.ListArray.from_arrays(offsets, x) for x in flats.values())], ["lang", "split", "sent", *flats])

    made = ", ".join(f"{f} array<{t}>" for f, t in fields.items()) if lists else "tokens array<struct<id: int, form: string, upos: string, head: int, deprel: string>>"
    return sentences.select("lang", "split", "sent", "s").mapInArrow(parse, f"lang string, split string, sent bigint, {made}")


def whole_numbers(texts: pa.Array) -> pa.Array:
    """What a cast to int makes of texts, null where it makes nothing; different texts are few."""
    known = texts.dictionary_encode()
    found = [re.fullmatch(r"[\x00-\x20\x7f]*([+-]?[0-9]+)[\x00-\x20\x7f]*", t) for t in known.dictionary.to_pylist()]
    numbers = [int(m[1]) if m and -(1 << 31) <= int(m[1]) < 1 << 31 else None for m in found]
    return pa.array(numbers, pa.int32()).take(known.indices)


def read_conllu(spark: SparkSession, path: str, min_cols: int = 8) -> DataFrame:
    """The tokens of ``read_treebank``, a row each."""
    return read_treebank(spark, path, min_cols).select("lang", "split", "sent", F.inline("tokens"))


def read_treebank(spark: SparkSession, path: str, min_cols: int = 8, lists: bool = False) -> DataFrame:
    """Sentences (lang, split, sent, tokens, or lists of the fields) of treebank files named ``<lang>-<split>.conllu``, or of those that ``sinks.write_conllu`` writes.

    A row is read for each sentence, so a large file is read by many tasks; ``sent`` tells sentences apart but does not count them.
    Files with other line ends or with spaces in blank lines are cut at those afterwards.
    """
    files = spark.read.option("pathGlobFilter", "*.{conllu,txt}").option("recursiveFileLookup", True).option("lineSep", "\n\n").text(path)
    place = F.col("_metadata.file_path")
    stem = F.regexp_replace(F.element_at(F.split(place, "/"), -1), r"\.(conllu|txt)$", "")
    folder = lambda name: F.nullif(F.regexp_extract(place, f"/{name}=([^/]+)/", 1), F.lit(""))
    lang = F.coalesce(folder("lang"), F.substring_index(stem, "-", 1))
    split = F.coalesce(folder("split"), F.nullif(F.regexp_extract(stem, "-(.*)$", 1), F.lit("")), F.lit("all"))
    sentences = files.select(lang.alias("lang"), split.alias("split"), F.explode(F.split("value", BLANK_LINES)).alias("s"))
    return parse_sentences(sentences.withColumn("sent", F.monotonically_increasing_id()), min_cols, lists)


def read_vectors(spark: SparkSession, path: str, entities: DataFrame, flag: str) -> tuple[DataFrame, DataFrame]:
    """(vectors of the entities, coverage): one row with the share of entities whose flag is true."""
    vectors = spark.read.parquet(path)
    coverage = entities.join(vectors.select("entity", flag), "entity", "left").agg(F.avg(F.coalesce(F.col(flag), F.lit(False)).cast("double")).alias("coverage"))
    return vectors.join(entities, "entity", "left_semi"), coverage


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(source, target, d) of a square CSV with row labels; empty cells have no row."""
    wide = spark.read.csv(path, header=True, inferSchema=False)
    first, *others = wide.columns
    long = wide.unpivot(first, others, "target", "d").withColumnRenamed(first, "source")
    return long.select("source", "target", F.expr("try_cast(d AS DOUBLE)").alias("d")).filter("d IS NOT NULL")


def read_formulas(spark: SparkSession, path: str, id_column: str, formula_column: str) -> DataFrame:
    """Parsed formulas of a tab file; blank ones are left out, untestable ones marked."""
    from lacuna.operators.universals import parse_formula

    rows = spark.read.csv(path, sep="\t", header=True, inferSchema=False).select(F.col(id_column).alias("id"), F.col(formula_column).alias("formula"))
    return parse_formula(rows.filter(F.trim("formula") != ""))


def read_crosswalk(spark: SparkSession, path: str, skip: list[str] = ()) -> DataFrame:
    """(query, target, source, confidence) of a JSON file with nested pairs; keys that are known to be bad are left out."""
    rows = spark.read.json(path, multiLine=True, schema="pairs array<struct<query: string, targets: array<string>, source: string, confidence: string>>")
    pairs = rows.select(F.explode("pairs").alias("p")).select("p.query", F.explode("p.targets").alias("target"), "p.source", "p.confidence")
    return pairs.filter(~F.col("query").isin(list(skip))) if skip else pairs


def read_run_ledger(spark: SparkSession, path: str, model: str | None = None) -> DataFrame:
    """(branch, frac, repeat, model, f1) of earlier results; fractions are rounded to six places, so that they serve as keys."""
    rows = spark.read.csv(path, header=True, schema="branch string, frac double, repeat int, model string, f1 double").withColumn("frac", F.round("frac", 6))
    return rows.filter(F.col("model") == model) if model else rows
