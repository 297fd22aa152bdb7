"""Queries of preparation."""

from pyspark.sql import functions as F

from lacuna.operators import prep
from lacuna.plans.registry import query

VALUES = "SELECT p_partkey AS id, p_type AS code, p_size::VARCHAR AS value FROM part"
CODES = "SELECT p_type AS code, lower(p_type) AS name FROM part WHERE p_type <> 'ECONOMY' GROUP BY p_type"
TOKENS = "CASE WHEN trim(regexp_replace({t}, '\\s+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace({t}, '\\s+', ' ', 'g')), ' ')) END"


@query("SELECT p_partkey AS entity, p_type AS family, NULL::VARCHAR AS genus FROM part")
def s2_resolve_column(i):
    return prep.resolve_column(i.table("part").withColumnRenamed("p_type", "Family_Name").withColumnRenamed("p_partkey", "Language_ID"), {"entity": ["id", "language_id"], "family": ["family_name"], "genus": ["genus_name"]})


@query(f"SELECT id, v.code, value, coalesce(name, 'value_' || value) AS label FROM ({VALUES}) v LEFT JOIN ({CODES}) c USING (code)")
def p1_label_values(i):
    values = i.table("part").selectExpr("p_partkey AS id", "p_type AS code", "CAST(p_size AS STRING) AS value")
    codes = i.table("part").filter("p_type <> 'ECONOMY'").selectExpr("p_type AS code", "lower(p_type) AS name").distinct()
    return prep.label_values(values, codes).select("id", "code", "value", "label")


@query(f"SELECT DISTINCT 'value_' || value AS label FROM ({VALUES}) WHERE code = 'ECONOMY'")
def p2_label_fallback(i):
    values = i.table("part").filter("p_type = 'ECONOMY'").selectExpr("p_type AS code", "CAST(p_size AS STRING) AS value")
    return prep.label_values(values, i.table("part").limit(0).selectExpr("p_type AS code", "p_name AS name")).select("label").distinct()


@query("SELECT entity, feature, value FROM cells WHERE NOT (feature = 'size' AND value IN ('s0', 's1', 's2'))")
def p3_drop_uncertain(i):
    spoilt = F.expr("CASE WHEN feature = 'size' AND value = 's0' THEN '?' WHEN feature = 'size' AND value = 's1' THEN ' Not  known ' WHEN feature = 'size' AND value = 's2' THEN NULL ELSE value END")
    return prep.drop_uncertain(i.cells.withColumn("value", spoilt))


@query("SELECT entity, 'any' AS feature, arg_min(value, fno) AS value FROM gold0 WHERE fno > 1 GROUP BY entity")
def p4_first_value_per_cell(i):
    cells = i.all_cells.select("entity", F.lit("any").alias("feature"), F.when(F.col("fno") > 1, F.col("value")).alias("value"), "fno")
    return prep.first_value_per_cell(cells, "fno")


@query("SELECT c.entity, c.feature, c.value, m.genus FROM cells c JOIN (SELECT l_partkey AS entity, arg_min(concat('g', l_suppkey), l_orderkey * 10 + l_linenumber) AS genus FROM lineitem GROUP BY l_partkey) m USING (entity)")
def p5_attach_meta(i):
    # of lines with one number SQL takes the one that the table has first; those without a number don't count
    place = ["_metadata.file_path AS file", "_metadata.row_index AS row"]
    meta = i.table("lineitem").selectExpr("l_partkey AS entity", "concat_ws('', 'g', l_suppkey) AS genus", "l_orderkey * 10 + l_linenumber AS no", *place)
    return prep.attach_meta(i.cells, meta, "no", "file", "row").select("entity", "feature", "value", "genus")


@query("SELECT * FROM cells WHERE entity IN (SELECT entity FROM cells GROUP BY entity HAVING count(*) >= 5)")
def p6_min_features_per_entity(i):
    return prep.min_features_per_entity(i.cells, 5)


@query(", x AS (SELECT * FROM cells WHERE entity IN (SELECT entity FROM cells GROUP BY entity HAVING count(*) >= 5)) SELECT * FROM x WHERE (feature, value) IN (SELECT (feature, value) FROM x GROUP BY feature, value HAVING count(DISTINCT entity) >= 300)")
def p7_null_rare_values(i):
    return prep.null_rare_values(prep.min_features_per_entity(i.cells, 5), 300)


@query(", x AS (SELECT * FROM cells WHERE (feature, value) IN (SELECT (feature, value) FROM cells GROUP BY feature, value HAVING count(DISTINCT entity) >= 300)) SELECT feature, count(DISTINCT value) AS n_values, count(*) AS n_cells FROM x GROUP BY feature")
def p8_feature_catalogue(i):
    return prep.feature_catalogue(prep.null_rare_values(i.cells, 300))


@query("SELECT entity, list_filter([family, genus], lambda x: x <> '')[2] AS node FROM meta")
def p9_classification_level(i):
    return i.meta.select("entity", F.concat_ws("/", F.lit(" "), "family", F.lit(""), "genus").alias("path")).select("entity", prep.classification_level("path").alias("node"))


TREE = """, tree AS (SELECT 'r' || r_regionkey AS id, r_name AS name, CASE WHEN r_regionkey = 0 THEN 'n0' END AS parent FROM region UNION ALL SELECT 'n' || n_nationkey, n_name, 'r' || n_regionkey FROM nation
    UNION ALL SELECT 'c' || c_custkey, c_name, 'n' || c_nationkey FROM customer)"""


@query(TREE + """, paths AS (SELECT c.id, concat_ws('/', CASE WHEN r.parent IS NOT NULL AND c.parent <> 'n0' AND c.id <> 'n0' THEN 'NATION_0' END, r.name, n.name, c.name) AS path FROM tree c JOIN tree n ON c.parent = n.id JOIN tree r ON n.parent = r.id WHERE c.id LIKE 'c%')
SELECT id, path FROM paths""")
def p10_ancestor_path(i):
    tree = i.table("region").selectExpr("'r' || r_regionkey AS id", "r_name AS name", "CASE WHEN r_regionkey = 0 THEN 'n0' END AS parent")
    tree = tree.union(i.table("nation").selectExpr("'n' || n_nationkey", "n_name", "'r' || n_regionkey")).union(i.table("customer").selectExpr("'c' || c_custkey", "c_name", "'n' || c_nationkey"))
    return prep.ancestor_path(tree).filter("id LIKE 'c%'").select("id", "path")


@query("SELECT entity, CASE WHEN entity % 3 = 0 THEN family ELSE genus END AS genus FROM meta")
def p11_genus_map(i):
    paths = F.when(F.col("entity") % 3 == 0, F.lit("")).otherwise(F.concat_ws("/", F.lit("root"), "family", "genus"))
    return prep.genus_map(i.meta.select("entity", "family", paths.alias("classification"))).select("entity", "genus")


@query("SELECT entity, genus FROM meta WHERE entity % 3 <> 0")
def p12_drop_without_genus(i):
    paths = F.when(F.col("entity") % 3 != 0, F.concat_ws("/", F.lit("root"), "family", "genus"))
    return prep.genus_map(i.meta.select("entity", F.lit(None).cast("string").alias("family"), paths.alias("classification"))).select("entity", "genus")


@query(r"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND x <> '<range>'), ' ') AS text FROM documents WHERE text NOT LIKE '%' || chr(9) || '%'")
def p13_clean_verses(i):
    return i.table("documents").filter("text NOT LIKE '%\t%'").select("doc_id", prep.clean_verses("text").alias("text"))


@query(f"SELECT doc_id, n_tokens::INT AS n_tokens FROM (SELECT doc_id, {TOKENS.format(t='text')} AS n_tokens FROM documents) WHERE n_tokens >= 100")
def p14_min_tokens(i):
    return prep.min_tokens(i.table("documents"), 100).select("doc_id", "n_tokens")


@query(r"SELECT doc_id, a >= 20 AND b >= 0.8 * a AS ok FROM (SELECT doc_id, length(regexp_replace(text[1:5000], '[^\p{L}]', '', 'g')) AS a, length(regexp_replace(text[1:5000], '[^\p{Latin}\p{Cyrillic}\p{Greek}]', '', 'g')) AS b FROM documents)")
def p15_script_fraction(i):
    return i.table("documents").select("doc_id", prep.script_fraction("text").alias("ok"))


LONGEST = f"SELECT source, doc_id, n_tokens::INT AS n_tokens FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_tokens DESC, doc_id) AS r FROM (SELECT source, doc_id, {TOKENS.format(t='text')} AS n_tokens FROM documents)) WHERE r = 1"


@query(LONGEST)
def p16_longest_per_key(i):
    return prep.longest_per_key(prep.min_tokens(i.table("documents"), 0), "source", "doc_id").select("source", "doc_id", "n_tokens")


@query("SELECT key, corpus, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, corpus) AS r FROM (SELECT doc_id AS key, 'a' AS corpus, length(text) AS n FROM documents WHERE doc_id % 3 <> 0 UNION ALL SELECT conv_id, 'b', length(text) FROM conversations WHERE turn = 0)) WHERE r = 1")
def p17_merge_corpora(i):
    a = i.table("documents").filter("doc_id % 3 <> 0").selectExpr("doc_id AS key", "text")
    b = i.table("conversations").filter("turn = 0").selectExpr("conv_id AS key", "text")
    return prep.merge_corpora(a, b, "key").select("key", "corpus", F.length("text").alias("n"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN lang ELSE doc_id || '_x' END AS iso FROM documents")
def p18_iso_from_filename(i):
    name = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("dir/"), F.upper("lang"), F.lit("-v"), "doc_id", F.lit(".txt"))).otherwise(F.concat(F.lit("dir/"), "doc_id", F.lit("_X.txt")))
    return i.table("documents").select("doc_id", name.alias("name")).select("doc_id", prep.iso_from_filename("name").alias("iso"))


@query("SELECT lang, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents) WHERE r <= 25")
def p19_cap_first_n(i):
    return prep.cap_first_n(i.table("documents"), 25, "doc_id", "lang").select("lang", "doc_id")


@query(""", l AS (SELECT 'Code' || p_partkey AS code, CASE WHEN p_partkey % 4 = 0 THEN 'ISO' || p_partkey END AS iso, p_partkey AS k FROM part)
SELECT code, CASE WHEN k % 10 = 1 THEN 'man' || k WHEN k % 4 = 0 THEN 'iso' || k WHEN k % 3 = 0 THEN 'cODe' || k ELSE 'COD' END AS id, CASE WHEN k % 10 = 1 THEN 'manual' WHEN k % 4 = 0 THEN 'iso' WHEN k % 3 = 0 THEN 'code' ELSE 'prefix' END AS how FROM l""")
def p20_match_entities(i):
    part = i.table("part")
    left = part.selectExpr("'Code' || p_partkey AS code", "CASE WHEN p_partkey % 4 = 0 THEN 'ISO' || p_partkey END AS iso")
    ids = part.filter("p_partkey % 4 = 0").selectExpr("'iso' || p_partkey AS id").union(part.filter("p_partkey % 3 = 0").selectExpr("'cODe' || p_partkey")).union(part.limit(1).selectExpr("'COD'"))
    return prep.match_entities(left, ids, part.filter("p_partkey % 10 = 1").selectExpr("'code' || p_partkey AS code", "'man' || p_partkey AS id"))


@query("SELECT p_partkey AS entity, e.vec_id IS NOT NULL AS found, round(coalesce(e.embedding[1], 0)::DOUBLE, 6) AS first, 64 AS dim FROM part LEFT JOIN embeddings e ON vec_id = p_partkey")
def p21_align_vectors(i):
    out = prep.align_vectors(i.meta.select("entity"), i.vecs.withColumnRenamed("id", "entity"), 64)
    return out.select("entity", "found", F.round(F.element_at("vec", 1).cast("double"), 6).alias("first"), F.size("vec").alias("dim"))


@query("""SELECT ch, freq, (row_number() OVER (ORDER BY freq DESC, ch) + 1)::INT AS idx FROM (SELECT ch, count(*) AS freq FROM (SELECT unnest(string_split(text[1:500000], '')) AS ch FROM documents WHERE text <> '') WHERE ch <> '' GROUP BY ch ORDER BY freq DESC, ch LIMIT 500) WHERE freq >= 5""")
def p22_char_vocab(i):
    return prep.char_vocab(i.table("documents"))


@query(""", cat AS (SELECT feature, value AS pos FROM book WHERE k > 2 UNION ALL SELECT feature, max(value) FROM book WHERE k = 2 GROUP BY feature), m AS (SELECT feature, pos, avg((value = pos)::INT) AS m FROM cells JOIN cat USING (feature) GROUP BY feature, pos)
SELECT feature, round(avg(greatest(m, 1 - m)), 9) AS majority FROM m GROUP BY feature HAVING avg(greatest(m, 1 - m)) <= 0.82""")
def p23_max_majority_filter(i):
    from lacuna.operators.coding import bin_catalog, binarise

    return prep.max_majority_filter(binarise(i.cells, bin_catalog(i.book)), 0.82).withColumn("majority", F.round("majority", 9))


@query("SELECT DISTINCT entity FROM other WHERE entity IN (SELECT c_custkey FROM customer)")
def p24_shared_entities(i):
    return prep.shared_entities(i.other, i.table("customer").selectExpr("c_custkey AS entity"))


@query("SELECT entity AS native, feature, value, 'G' || entity AS entity FROM cells WHERE entity % 6 <> 0 AND entity % 4 <> 0")
def p25_native_to_standard_id(i):
    mapping = i.meta.filter("entity % 4 <> 0").selectExpr("entity", "CASE WHEN entity % 6 = 0 THEN ' ' ELSE 'G' || entity END AS standard")
    return prep.native_to_standard_id(i.cells, mapping).select("native", "feature", "value", "entity")


@query("SELECT doc_id, CASE lang WHEN 'en' THEN 'Basic' WHEN 'de' THEN 'Umlaut' ELSE 'Latin' END AS script FROM documents")
def p26_lookup_with_default(i):
    scripts = i.spark.createDataFrame([("en", "Basic"), ("de", "Umlaut")], "lang string, script string")
    return prep.lookup_with_default(i.table("documents").select("doc_id", "lang"), scripts, "lang", "script", "Latin").select("doc_id", "script")


@query("SELECT lang, count(DISTINCT doc_id) AS n_sentences, sum(len(string_split(text, ' ')))::BIGINT AS n_tokens FROM documents GROUP BY lang")
def p27_size_counts(i):
    tokens = i.table("documents").select("lang", F.col("doc_id").alias("sent"), F.explode(F.split("text", " ")))
    return prep.size_counts(tokens, "lang")
