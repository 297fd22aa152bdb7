"""Queries of sources and sinks: files that Spark writes from the given tables, and reads back."""

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F

from lacuna.functions.scratch import scratch_path
from lacuna.operators import impute, trees
from lacuna.plans.q_trees import REVERSED, TOK, reversed_lists, treebank_lists
from lacuna.plans.registry import query
from lacuna.sources import files, sinks


@query("SELECT p_partkey::VARCHAR AS Language_ID, p_name AS Value, 'a \"' || p_type || '\",' || chr(10) || p_size AS Comment FROM part")
def s1_read_categorical_csv(i):
    path = scratch_path(i.spark, "csv")
    rows = i.table("part").select(F.col("p_partkey").cast("string").alias(" Language_ID"), F.col("p_name").alias("Value "), F.concat(F.lit('a "'), "p_type", F.lit('",\n'), "p_size").alias("Comment"))
    rows.write.csv(path, header=True, escape='"', quoteAll=True)
    return files.read_categorical_csv(i.spark, path)


@query("SELECT p_partkey::VARCHAR AS entity, p_type AS family, 'feature ' || (p_size % 3) AS feature, 'value ' || p_brand AS label FROM part")
def s2b_read_codebook_dataset(i):
    """Languages, values, codes and parameters, written and joined again."""
    folder, part = scratch_path(i.spark, "codebook"), i.table("part")
    feature = F.concat(F.lit("F"), F.col("p_size") % 3)
    tables = {
        "languages": part.select(F.col("p_partkey").alias("ID"), F.col("p_type").alias("Family")),
        "parameters": part.select(feature.alias("ID"), F.concat(F.lit("feature "), F.col("p_size") % 3).alias("Name")).distinct(),
        "codes": part.select(F.col("p_brand").alias("ID"), F.concat(F.lit("value "), "p_brand").alias("Name")).distinct(),
        "values": part.select(F.col("p_partkey").alias("Language_ID"), feature.alias("Parameter_ID"), F.col("p_brand").alias("Code_ID")),
    }
    for name, rows in tables.items():
        rows.write.csv(f"{folder}/{name}.csv", header=True)
    t = files.read_codebook_dataset(i.spark, folder)
    joined = t["values"].join(t["languages"].select(F.col("ID").alias("Language_ID"), "Family"), "Language_ID")
    joined = joined.join(t["parameters"].select(F.col("ID").alias("Parameter_ID"), F.col("Name").alias("feature")), "Parameter_ID")
    joined = joined.join(t["codes"].select(F.col("ID").alias("Code_ID"), F.col("Name").alias("label")), "Code_ID")
    return joined.select(F.col("Language_ID").alias("entity"), F.col("Family").alias("family"), "feature", "label")


def feature_file(i):
    """Parts as a feature table; each cell is ``number label``, blanked ones are ``?``."""
    path = scratch_path(i.spark, "tsv")
    number = F.concat(F.length("value").cast("string"), F.lit(" "), "value")
    raw = i.all_cells.select("entity", "feature", F.expr("CASE WHEN (entity * 31 + fno * 17) % 5 = 0 THEN '?' END").alias("q"), number.alias("n"))
    joined = raw.groupBy("entity").agg(F.array_sort(F.collect_list(F.concat(F.upper("feature"), F.lit("="), F.coalesce("q", "n")))).alias("l"))
    lines = i.meta.join(joined, "entity").select(F.concat_ws("\t", F.col("entity").cast("string"), F.lit("name"), F.col("latitude").cast("string"), F.col("longitude").cast("string"), "genus", "family", F.lit("XX"), F.array_join("l", "|")).alias("line"))
    head = i.spark.createDataFrame([("code\tname\tlatitude\tlongitude\tgenus\tfamily\tcountrycodes\tfeatures",)], "line string")
    head.union(lines).write.text(path)
    return path


@query("SELECT entity::VARCHAR AS entity, feature, length(value)::VARCHAR AS value, length(value) || ' ' || value AS raw FROM cells")
def s3_read_feature_tsv(i):
    return files.read_feature_tsv(i.spark, feature_file(i))[1]


@query("SELECT entity::VARCHAR AS entity, feature FROM blanks")
def s3b_feature_tsv_blanks(i):
    return files.read_feature_tsv(i.spark, feature_file(i))[2]


@query("SELECT 'lang=' || lang AS folder, count(*) AS n, sum(length(text))::BIGINT AS chars FROM documents GROUP BY lang")
def s4_read_verse_corpus(i):
    path = scratch_path(i.spark, "verses")
    docs = i.table("documents").select(F.regexp_replace("text", "[\r\f]", "\n").alias("text"), "lang")
    docs.write.partitionBy("lang").option("lineSep", "\f").text(path)
    read = files.read_verse_corpus(i.spark, path)
    each = read.select("folder", F.explode(F.split(F.regexp_replace("text", "\f$", ""), "\f")).alias("text"))
    return each.groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.length("text")).cast("long").alias("chars"))


SENTENCES = "SELECT lang, split, string_agg({id} || '/' || form || '/' || upos || '/' || {head} || '/' || deprel, ' ' ORDER BY {id}) AS tokens FROM {t} GROUP BY lang, split, sent"


def sentences(treebank):
    """(lang, split, tokens): tokens in order as one text, a batch of sentences at a time."""

    def list_tokens(batches):
        for batch in batches:
            ids, flat = trees.Lists(batch.column("ids")), {c: batch.column(c).flatten() for c in ("ids", "forms", "tags", "heads", "deprels")}
            texts = pc.binary_join_element_wise(flat["ids"].cast(pa.string()), flat["forms"], flat["tags"], flat["heads"].cast(pa.string()), flat["deprels"], "/", null_handling="skip")
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("split"), sinks.joined(texts, flat["ids"], ids.row, batch.num_rows, " ")], ["lang", "split", "tokens"])

    return trees.with_lists(treebank, "ids", "forms", "tags", "heads", "deprels", whole=False).mapInArrow(list_tokens, "lang string, split string, tokens string")


@query(TOK + SENTENCES.format(id="id", head="head", t="tok"))
def s5_read_conllu(i):
    """Sentences with comments, split tokens and subtypes of relations, in one file for each language."""
    path = scratch_path(i.spark, "treebank")
    same = {"order_ids": F.col("ids"), "positions": F.col("ids")}
    text = sinks.conllu_sentences(treebank_lists(i, "ids", "forms", "tags", "heads", "deprels").withColumns(same))
    noisy = F.concat(F.lit("# a comment\n1-2\tsplit\t_\t_\t_\t_\t0\troot\t_\t_\n"), F.regexp_replace("text", "\tobj\t", "\tobj:sub\t"))
    noisy = F.when(F.col("sent") % 2 == 0, F.regexp_replace(noisy, "\n", "\r\n")).otherwise(noisy)
    text.select("lang", "split", noisy.alias("text")).write.partitionBy("lang", "split").text(path)
    return sentences(files.read_treebank(i.spark, path, lists=True))


@query("SELECT round(avg((e.vec_id IS NOT NULL AND e.vec_id % 2 = 0)::INT), 8) AS coverage FROM part LEFT JOIN embeddings e ON e.vec_id = p_partkey")
def s6_read_vectors(i):
    path = scratch_path(i.spark, "vectors")
    i.vecs.select(F.col("id").alias("entity"), "vec", (F.col("id") % 2 == 0).alias("has")).write.parquet(path)
    return files.read_vectors(i.spark, path, i.meta.select("entity"), "has")[1].withColumn("coverage", F.round("coverage", 8))


@query("SELECT s.n_name AS source, t.n_name AS target, ((s.n_nationkey * 7 + t.n_nationkey * 11) % 17)::DOUBLE AS d FROM nation s CROSS JOIN nation t WHERE (s.n_nationkey + t.n_nationkey) % 5 <> 0")
def s7_read_matrix(i):
    path, n = scratch_path(i.spark, "matrix"), i.table("nation")
    names = [f"NATION_{k}" for k in range(25)]
    pairs = n.select(F.col("n_name").alias("source"), F.col("n_nationkey").alias("s")).crossJoin(n.select(F.col("n_name").alias("target"), F.col("n_nationkey").alias("t"))).filter("(s + t) % 5 <> 0")
    pairs.groupBy("source").pivot("target", names).agg(F.first(F.expr("CAST((s * 7 + t * 11) % 17 AS DOUBLE)"))).write.csv(path, header=True)
    return files.read_matrix(i.spark, path)


@query("SELECT s_suppkey::VARCHAR AS id, CASE WHEN s_suppkey % 3 = 0 THEN 'ok' ELSE 'untestable' END AS status FROM supplier WHERE s_suppkey % 3 <> 2")
def s8_read_formulas(i):
    path = scratch_path(i.spark, "formulas")
    formula = F.expr("CASE s_suppkey % 3 WHEN 0 THEN 'GB1:1 > GB2:0' WHEN 1 THEN 'sum(GB1:1) > 2' ELSE ' ' END")
    i.table("supplier").select(F.col("s_suppkey").alias("row"), formula.alias("formal")).write.csv(path, sep="\t", header=True)
    return files.read_formulas(i.spark, path, "row", "formal").select("id", "status")


@query("SELECT n_name AS query, t AS target, r_name AS source, 'high' AS confidence FROM nation JOIN region ON n_regionkey = r_regionkey CROSS JOIN (SELECT unnest(['x', 'y']) AS t) WHERE n_name <> 'NATION_3'")
def s9_read_crosswalk(i):
    path = scratch_path(i.spark, "crosswalk")
    pair = F.struct(F.col("n_name").alias("query"), F.array(F.lit("x"), F.lit("y")).alias("targets"), F.col("r_name").alias("source"), F.lit("high").alias("confidence"))
    rows = i.table("nation").join(i.table("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows.groupBy("r_name").agg(F.collect_list(pair).alias("pairs")).select("pairs").repartition(5).write.json(path)
    lines = i.spark.read.text(path)
    assert lines.columns == ["value"]
    return files.read_crosswalk(i.spark, path, ["NATION_3"])


RUN_ROWS = "SELECT l_returnflag AS branch, round(l_discount + 0.0000001, 6) AS frac, (l_linenumber % 4)::INT AS repeat, CASE l_linestatus WHEN 'O' THEN 'full' ELSE 'base' END AS model, l_tax AS f1 FROM lineitem"


@query(f"SELECT * FROM ({RUN_ROWS}) WHERE model = 'full'")
def s10_read_run_ledger(i):
    path = scratch_path(i.spark, "ledger")
    i.table("lineitem").selectExpr("l_returnflag AS branch", "l_discount + 0.0000001D AS frac", "CAST(l_linenumber % 4 AS INT) AS repeat", "CASE l_linestatus WHEN 'O' THEN 'full' ELSE 'base' END AS model", "l_tax AS f1").write.csv(path, header=True)
    return files.read_run_ledger(i.spark, path, "full")


@query("""SELECT 'l' || m.entity AS entity, concat_ws(chr(9), m.entity, 'n', '1.0', '2.0', genus, family, 'XX', list) AS line FROM meta m JOIN (SELECT entity, string_agg(feature || '=' || raw, '|' ORDER BY feature) AS list FROM
    (SELECT entity, feature, '1 ' || value AS raw FROM cells UNION ALL SELECT b.entity, b.feature, coalesce(p.value, f.value, '1') || ' -' FROM blanks b LEFT JOIN (SELECT * FROM preds WHERE system = 'genus' AND entity % 2 = 0) p USING (entity, feature) LEFT JOIN (SELECT * FROM freq WHERE feature <> 'size') f USING (feature)) GROUP BY entity) USING (entity)""")
def w1_write_feature_tsv(i):
    meta = i.meta.select("entity", F.lit("n").alias("name"), F.lit(1.0).alias("latitude"), F.lit(2.0).alias("longitude"), "genus", "family", F.lit("XX").alias("countrycodes"))
    cells = i.cells.withColumn("raw", F.concat(F.lit("1 "), "value"))
    preds = i.preds.filter("system = 'genus' AND entity % 2 = 0")
    fallback = impute.modes(i.cells, "feature").filter("feature <> 'size'")
    path = scratch_path(i.spark, "submission")
    sinks.write_feature_tsv(sinks.feature_lines(meta, cells, i.blanks, preds, fallback), path)
    lines = i.spark.read.text(path).filter("value NOT LIKE 'entity%'")
    return lines.select(F.concat(F.lit("l"), F.substring_index("value", "\t", 1)).alias("entity"), F.col("value").alias("line"))


@query("SELECT entity::VARCHAR AS entity, max(value) FILTER (feature = 'adj') AS adj, max(value) FILTER (feature = 'size') AS size FROM cells GROUP BY entity")
def w2_write_wide(i):
    path = scratch_path(i.spark, "wide")
    sinks.write_wide(i.cells, ["adj", "size"], path)
    return i.spark.read.csv(path, header=True)


@query(r"""SELECT lang, least(length(text), 500)::INT AS n_chars, CASE WHEN trim(regexp_replace(substr(text, 1, 500), '\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(substr(text, 1, 500), '\s+', ' ', 'g')), ' ')) END::INT AS n_tokens FROM documents
    UNION ALL SELECT 'file ' || lang, sum(least(length(text), 500) + 1)::INT, NULL FROM documents GROUP BY lang""")
def w3_corpus_with_manifest(i):
    path = scratch_path(i.spark, "corpus")
    sinks.write_corpus_with_manifest(i.table("documents").select("lang", "text"), path, 500)
    manifest = i.spark.read.csv(f"{path}/manifest", header=True, schema="lang string, n_chars int, n_tokens int")
    lines = i.spark.read.text(f"{path}/texts")  # as many line ends as lines
    files_ = lines.groupBy("lang").agg(F.sum(F.length("value") + 1).cast("int").alias("n_chars"))
    return manifest.unionByName(files_.select(F.concat(F.lit("file "), "lang").alias("lang"), "n_chars", F.lit(None).cast("int").alias("n_tokens")))


@query("SELECT p_partkey AS entity, e.vec_id IS NOT NULL AS has, coalesce(len(e.embedding), 64)::INT AS dim FROM part LEFT JOIN embeddings e ON vec_id = p_partkey")
def w4_write_vectors(i):
    path = scratch_path(i.spark, "vectors")
    rows = i.meta.select("entity").join(i.vecs.select(F.col("id").alias("entity"), "vec"), "entity", "left").withColumn("has", F.col("vec").isNotNull())
    sinks.write_vectors(rows, path, ["entity", "vec", "has"], {"vec": 64})
    return i.spark.read.parquet(path).select("entity", "has", F.size("vec").alias("dim"))


@query(REVERSED + ", rv AS (SELECT t.lang, t.split, t.sent, o.position AS id, t.form, t.upos, coalesce(h.position, 0) AS head, t.deprel FROM tok t JOIN ord o USING (lang, split, sent, id) LEFT JOIN ord h ON h.lang = t.lang AND h.sent = t.sent AND h.id = t.head) " + SENTENCES.format(id="id", head="head", t="rv"))
def w5_write_conllu(i):
    path = scratch_path(i.spark, "treebank")
    sinks.write_conllu(reversed_lists(i, "forms", "tags", "heads", "deprels"), path)
    return sentences(files.read_treebank(i.spark, path, lists=True))


@query("SELECT n_nationkey AS k, n_nationkey * 2 AS y FROM nation")
def w6_run_pending(i):
    path, grid = scratch_path(i.spark, "ledger"), i.table("nation").selectExpr("n_nationkey AS k")
    run = lambda points: points.selectExpr("k", "k * 2 AS y")
    sinks.run_pending(grid.filter("k < 10"), path, ["k"], run, "k int, y int")
    return sinks.run_pending(grid, path, ["k"], run, "k int, y int")
