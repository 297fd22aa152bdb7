"""Invariants and small cases worked out by hand."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lacuna.functions import columns
from lacuna.operators import coding, evaluate, impute, prep, search, splits, stats, trees, universals, vectors
from lacuna.sources import files, sinks


def cells(spark, rows):
    return spark.createDataFrame(rows, "entity long, feature string, value string")


@pytest.fixture(scope="module")
def small(spark):
    return cells(spark, [(e, f, f"v{(e * n + e // 3) % k}") for e in range(60) for f, n, k in (("a", 1, 2), ("b", 3, 3), ("c", 5, 4)) if (e + n) % 7])


def test_split_never_shares_a_cell(spark, small):
    rows = small.withColumn("branch", F.concat(F.lit("g"), F.col("entity") % 4))
    branches = splits.qualifying_branches(rows.withColumnRenamed("branch", "genus"))
    parts = splits.split_by_branch(rows, branches, 0.2, splits.hash_order(1, "entity", "feature"))
    assert parts.count() == small.count()
    assert parts.groupBy("branch", "entity", "feature").count().filter("count > 1").isEmpty()
    again = splits.split_by_branch(rows.repartition(7), branches, 0.2, splits.hash_order(1, "entity", "feature"))
    assert parts.exceptAll(again).isEmpty()


def test_cooccurrence_is_symmetric_and_below_marginals(small):
    cooc = stats.cooccurrence(small)
    swapped = cooc.select(F.col("fj").alias("fi"), F.col("vj").alias("vi"), F.col("fi").alias("fj"), F.col("vi").alias("vj"), "n")
    assert cooc.exceptAll(swapped).isEmpty()
    counts = stats.marginal_counts(small).toDF("fi", "vi", "m")
    assert cooc.join(counts, ["fi", "vi"]).filter("n > m").isEmpty()


def test_marginals_sum_to_one(small):
    p = stats.marginals(stats.marginal_counts(small), coding.codebook(small))
    assert all(abs(r["s"] - 1) < 1e-9 for r in p.groupBy("feature").agg(F.sum("p").alias("s")).collect())


def test_binarise_two_values_give_one_column(spark):
    rows = cells(spark, [(1, "x", "a"), (2, "x", "b"), (1, "y", "a"), (2, "y", "b"), (3, "y", "c"), (1, "z", "only")])
    catalog = coding.bin_catalog(coding.codebook(rows))
    assert sorted((r["feature"], r["pos_value"]) for r in catalog.collect()) == [("x", "b"), ("y", "a"), ("y", "b"), ("y", "c")]
    bits = {(r["entity"], r["bin_col"]): r["bit"] for r in coding.binarise(rows, catalog).filter("feature = 'x'").collect()}
    assert bits == {(1, 0): 0, (2, 0): 1}


def test_ties_go_to_the_smaller_value(spark):
    rows = cells(spark, [(1, "x", "b"), (2, "x", "a"), (3, "x", "b"), (4, "x", "a")])
    assert impute.impute_freq(rows, cells(spark, [(9, "x", "")]).select("entity", "feature")).first()["value"] == "a"


def test_silhouette_of_planted_clusters(spark):
    rows = [(i, [1.0, 0.0 + i / 1000], "p") for i in range(5)] + [(10 + i, [0.0 + i / 1000, 1.0], "q") for i in range(5)] + [(99, [1.0, 1.0], "alone")]
    s = vectors.silhouette(spark.createDataFrame(rows, "id long, vec array<double>, g string"), "g")
    assert s.count() == 10 and s.agg(F.min("s")).first()[0] > 0.9


def test_procrustes_of_a_rotation_is_zero(spark):
    rows = [(i, [float(i % 7) + 1, float(i % 5), float(i % 3)]) for i in range(30)]
    a = spark.createDataFrame(rows, "id long, vec array<double>")
    b = a.select("id", F.array(-F.col("vec")[1], F.col("vec")[0], F.col("vec")[2]).alias("vec"))
    assert abs(vectors.procrustes_disparity(a, b).first()["disparity"]) < 1e-9
    matched = vectors.rotate_and_match(a, b, a, b, 30).filter("source = target")
    assert matched.agg(F.min("cos")).first()[0] > 1 - 1e-9


def test_preservation_of_perfect_groups(spark):
    groups = spark.createDataFrame([(i, i % 5) for i in range(40)], "id long, group long")
    near = spark.createDataFrame([(i, (i + 5) % 40) for i in range(40)], "source long, target long")
    row = vectors.group_preservation(near, groups, 50).first()
    assert row["share"] == 1.0 and row["null_mean"] < 0.6 and row["p"] < 0.05


def test_linearise_by_hand(spark):
    # 2 is the root; 1 and 3 hang on it, 4 on 3; the object comes before its head, the adverb behind it; 9 is in no tree
    tokens = spark.createDataFrame(
        [("x", "s", 0, 1, "a", "ADV", 2, "adv"), ("x", "s", 0, 2, "b", "VERB", 0, "root"), ("x", "s", 0, 3, "c", "NOUN", 2, "obj"), ("x", "s", 0, 4, "d", "ADJ", 3, "mod"), ("x", "s", 0, 9, "e", "X", 9, "dep")],
        "lang string, split string, sent long, id int, form string, upos string, head int, deprel string",
    )
    direction = spark.createDataFrame([("x", "obj_VERB_NOUN", 0.9), ("x", "adv_VERB_ADV", 0.1), ("x", "mod_NOUN_ADJ", 0.2)], "lang string, config string, p double")
    order = [r["id"] for r in trees.linearise(tokens, direction).orderBy("position").collect()]
    assert order == [3, 4, 2, 1, 9]


def test_long_chains_and_cycles_keep_all_rows(spark):
    rows = [(i, f"n{i}", i - 1 if i else None) for i in range(301)] + [(1000, "a", 1001), (1001, "b", 1002), (1002, "c", 1000), (1003, "d", 1001), (1004, "e", 9999)]
    got = {r["id"]: (r["path"], r["depth"]) for r in prep.ancestor_path(spark.createDataFrame(rows, "id long, name string, parent long")).collect()}
    assert len(got) == len(rows) and got[300] == ("/".join(f"n{i}" for i in range(301)), 300)
    assert got[1000] == ("c/b/a", 2) and got[1003] == ("a/c/b/d", 3) and got[1004] == ("e", 0)
    tokens = spark.createDataFrame([("x", "s", 0, i, "w", "X", i - 1, "dep") for i in range(1, 301)], "lang string, split string, sent long, id int, form string, upos string, head int, deprel string")
    behind = spark.createDataFrame([("x", "dep_X_X", 0.2)], "lang string, config string, p double")
    assert [r["id"] for r in trees.linearise(tokens, behind).orderBy("position").collect()] == list(range(1, 301))


def test_treebank_files_of_any_line_ends(spark, tmp_path):
    line = lambda i, form, head: f"{i}\t{form}\t_\tX\t_\t_\t{head}\tdep:sub\t_\t_"
    (tmp_path / "aa-train.conllu").write_text(f"# c\n{line(1, 'a', 0)}\n1-2\tx\t_\t_\t_\t_\t_\t_\t_\t_\n{line(2, 'b', 1)}\n\n{line(1, 'c', 0)}\n")
    (tmp_path / "bb.conllu").write_bytes(f"{line(1, 'd', 0)}\r\n\r\n{line(1, 'e', 0)}\r\n \r\n{line(1, 'f', 0)}".encode())
    (tmp_path / "other.csv").write_text("x")
    got = sorted((r["lang"], r["split"], r["id"], r["form"], r["head"], r["deprel"]) for r in files.read_conllu(spark, str(tmp_path)).collect())
    assert got == [("aa", "train", 1, "a", 0, "dep"), ("aa", "train", 1, "c", 0, "dep"), ("aa", "train", 2, "b", 1, "dep"), *(("bb", "all", 1, f, 0, "dep") for f in "def")]
    assert files.read_conllu(spark, str(tmp_path)).select("lang", "sent").distinct().count() == 5


def test_verse_files_without_references(spark, tmp_path):
    (tmp_path / "eng").mkdir()
    (tmp_path / "eng" / "eng-a.txt").write_text("one\ntwo")
    (tmp_path / "vref.txt").write_text("GEN 1:1")
    (tmp_path / "notes.md").write_text("x")
    assert [(r["folder"], r["file"], r["text"]) for r in files.read_verse_corpus(spark, str(tmp_path)).collect()] == [("eng", "eng-a.txt", "one\ntwo")]


def test_search_equals_comparing_all_pairs(spark):
    rng = np.random.default_rng(2)
    vecs = rng.integers(-2, 3, (90, 4)).astype(float)  # many equal and some zero vectors
    rows = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(vecs)] + [(500, None, 1)], "id long, vec array<double>, group int")
    size = np.linalg.norm(vecs, axis=1)
    cos = np.round(np.divide(vecs @ vecs.T, np.outer(size, size), out=np.zeros((90, 90)), where=np.outer(size, size) > 0), 12)
    for metric, s in (("cosine", cos), ("euclidean", -np.sqrt(((vecs[:, None] - vecs) ** 2).sum(2)))):
        got = {}
        for r in search.top_k(rows.filter("id % 4 = 0"), rows, 5, metric, other_group=True, block=16).collect():
            got.setdefault(r["source"], []).append((r["rank"], r["target"]))
        for q in range(0, 90, 4):
            best = sorted((j for j in range(90) if j % 3 != q % 3), key=lambda j: (-s[q, j], j))[:5]
            assert [t for _, t in sorted(got[q])] == best
    assert search.top_k(rows.limit(0), rows, 5).count() == 0


def test_places_are_those_of_one_sort(spark):
    rows = spark.range(3000).select("id", (F.col("id") % 3).alias("k")).withColumn("o", columns.draw(7, "id"))
    got = columns.numbered(rows, F.col("o"), "id", "k").collect()
    for k in range(3):
        own = sorted((r for r in got if r["k"] == k), key=lambda r: (r["o"], r["id"]))
        assert [r["place"] for r in own] == list(range(1, len(own) + 1))


def test_procrustes_permutation_and_cca_equal_numpy(spark):
    rng = np.random.default_rng(4)
    x, y = rng.normal(size=(60, 3)), rng.normal(size=(60, 3))
    y[:, 0] += x[:, 0]
    table = lambda m: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(m)], "id long, vec array<double>")

    def disparity(a, b):
        a, b = a - a.mean(0), b - b.mean(0)
        return 1 - (np.linalg.svd(a.T @ b, compute_uv=False).sum() / (np.linalg.norm(a) * np.linalg.norm(b))) ** 2

    drawn = lambda *key: int(hashlib.md5("|".join(map(str, key)).encode()).hexdigest()[:15], 16)
    here = sorted(range(60), key=lambda i: drawn(42, i))

    def moved(at, n, seed, key):
        """The keyed permutation, place by place."""
        prime, key = 2**31 - 1, (seed * 1000003 + key) % (2**31 - 1)
        mix = lambda v: v * (v % 65521 + 7) % prime
        for r in range(16):
            turn = (key * 40503 + r * 7919) % prime
            other = (mix(turn) % n - at) % n
            if mix((max(at, other) * 2654435 + turn) % prime) // 4096 % 2:
                at = other
        return at

    null = [disparity(x[here], y[[here[moved(p, 60, 42, r)] for p in range(60)]]) for r in range(1, 11)]
    row = vectors.procrustes_permutation(table(x), table(y), 10).first()
    assert abs(row["disparity"] - disparity(x, y)) < 1e-9 and abs(row["null_mean"] - np.mean(null)) < 1e-9
    assert row["p"] == (sum(d <= disparity(x, y) for d in null) + 1) / 11
    a, b = x - x.mean(0), y - y.mean(0)
    q = [np.linalg.qr(m)[0] for m in (a, b)]
    assert np.allclose([r["correlation"] for r in vectors.cca(table(x), table(y)).orderBy("component").collect()], np.linalg.svd(q[0].T @ q[1], compute_uv=False))


def test_hashed_pairs_find_planted_neighbours(spark):
    rng = np.random.default_rng(6)
    centers = rng.normal(size=(40, 16))
    vecs = np.repeat(centers / np.linalg.norm(centers, axis=1, keepdims=True), 5, axis=0) + rng.normal(size=(200, 16)) * 0.01
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vecs)], "id long, vec array<double>")
    got = {(r["source"], r["target"]): r["d"] for r in vectors.candidate_pairs(rows, 0.3).collect()}
    near = {(i, j) for i in range(200) for j in range(i + 1, 200) if i // 5 == j // 5}
    assert len(near & set(got)) >= 0.98 * len(near) and len(got) < 0.35 * 200 * 199 / 2
    assert all(abs(d - np.linalg.norm(vecs[i] - vecs[j])) < 1e-9 for (i, j), d in got.items())


def test_clusters_are_those_of_the_nearest_center(spark):
    rng = np.random.default_rng(8)
    places = np.concatenate([rng.normal(c, 1, (30, 2)) for c in ((0, 0), (40, 40), (-40, 60))])
    meta = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(places)] + [(999, None, 1.0)], "entity long, latitude double, longitude double")
    got = {r["entity"]: r["cluster"] for r in coding.geo_clusters(meta, 3).collect()}
    assert 999 not in got and [len({got[i] for i in range(30 * k, 30 * k + 30)}) for k in range(3)] == [1, 1, 1] and len(set(got.values())) == 3
    means = {c: places[[i for i in got if got[i] == c]].mean(0) for c in set(got.values())}
    assert all(got[i] == min(means, key=lambda c: np.linalg.norm(places[i] - means[c])) for i in got)


def test_low_rank_filling_follows_planted_blocks(spark):
    """Entities of two kinds answer alike; the commonest value is wrong for the smaller kind."""
    kind = lambda e: e % 3 == 0
    every = [(e, f"f{f}", f"v{int(kind(e)) * 2 + f % 2}") for e in range(60) for f in range(8)]
    hidden = {(e, f"f{f}") for e in range(60) for f in range(8) if (e * 7 + f * 5) % 11 == 0}
    known = cells(spark, [r for r in every if r[:2] not in hidden])
    blanks = spark.createDataFrame(sorted(hidden), "entity long, feature string")
    truth = {r[:2]: r[2] for r in every if r[:2] in hidden}
    right = lambda preds: sum(truth[r["entity"], r["feature"]] == r["value"] for r in preds.collect()) / len(truth)
    assert right(impute.impute_factorised(known, blanks, coding.codebook(known), 4)) > 0.95 > right(impute.impute_freq(known, blanks))


@pytest.mark.parametrize("kind", ["gbt", "forest"])
def test_stack_follows_the_system_that_is_right(spark, kind):
    rows = []
    for e in range(120):
        truth = e * 7 % 3
        for v in range(3):
            rows.append((e, "f", f"v{v}", f"g{e % 4}", float(v == truth), float(v == (e // 2) % 3), float(v == 0), int(v == truth)))
    table = spark.createDataFrame(rows, "entity long, feature string, value string, genus string, said_good double, said_bad double, p double, right int")
    best = impute.stack_systems(table.filter("entity < 80"), table.filter("entity >= 80"), kind)
    assert all(r["value"] == f"v{r['entity'] * 7 % 3}" for r in best.collect()) and best.count() == 40
    folds = impute.cross_validate_stack(table, 2, kind).collect()
    assert sum(r["n"] for r in folds) == 120 and all(r["acc"] == 1.0 for r in folds)


def test_formula_parts(spark):
    rows = spark.createDataFrame([(1, "GB1:1 & GB2:0 > GB3:1"), (2, "sum(GB1:1) > 2"), (3, "GB1:1"), (4, "(GB1:1 | GB2:1) > GB3:0 & GB4:0")], "id long, formula string")
    out = {r["id"]: (r["ant"], r["ftype"], r["status"]) for r in universals.parse_formula(rows).collect()}
    assert out[1] == (["GB1:1", "GB2:0"], "and>single", "ok") and out[4] == (["GB1:1", "GB2:1"], "or>and", "ok")
    assert out[2][2] == out[3][2] == "untestable"


def test_feature_table_repairs_and_last_duplicate(spark, tmp_path):
    (tmp_path / "f.tsv").write_text("code\tname\tlatitude\tlongitude\tgenus\tfamily\tcountrycodes\tfeatures\n" "aaa\tA\t1\t2\tG\tF\tX\tOrd=1 first|Ord=2 second|Neg=?|Bad=x y|Neg2=3 double negationSVONeg_Order=4 q\n" "bbb\tB\tx\t2\tG\tF\tX\tOne=1 a\tb|Two=?\nshort\tline\n")
    meta, got, blanks = files.read_feature_tsv(spark, str(tmp_path / "f.tsv"))
    assert {(r["entity"], r["feature"], r["value"]) for r in got.collect()} == {("aaa", "ord", "2"), ("aaa", "neg2", "3"), ("aaa", "svoneg_order", "4"), ("bbb", "one", "1")}
    assert {(r["entity"], r["feature"]) for r in blanks.collect()} == {("aaa", "neg"), ("bbb", "two")}
    assert meta.filter("entity = 'bbb'").first()["latitude"] is None


def test_vectors_with_other_columns_are_refused(spark, tmp_path):
    with pytest.raises(ValueError):
        sinks.write_vectors(spark.createDataFrame([(1, "x")], "entity long, extra string"), str(tmp_path / "v"), ["entity"], {})


def test_bootstrap_interval_holds_the_mean(spark):
    rows = spark.createDataFrame([(i, (i % 10) / 10, 0.0) for i in range(100)], "entity long, acc double, ref double")
    row = evaluate.bootstrap_ci(rows, 200).first()
    assert row["low"] < 0.45 < row["high"] and row["p"] == 0
