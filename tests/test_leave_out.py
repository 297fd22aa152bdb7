"""Predictions and figures of left-out cells against tables from which each cell is really removed."""

import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import impute, leave_out, stats
from lacuna.operators.coding import codebook

CELL = ("entity", "feature")


@pytest.fixture(scope="module")
def world(spark):
    """Cells with ties, values and features of one cell, an entity of one cell, and genera of one entity."""
    rng = random.Random(4)
    rows = [(e, f"f{f}", rng.choice("aabbc") if f % 2 else ("ab"[e % 2] if rng.random() < 0.8 else "b")) for e in range(36) for f in range(5) if rng.random() < 0.8]
    rows += [(90, "f1", "a"), (3, "f9", "z"), (5, "f1x", "p"), (6, "f1x", "q"), (91, "f0", "only"), (91, "f1", "a"), (91, "f2", "a")]
    meta = [(e, f"g{e % 7 if e < 35 else e}", f"m{e % 3}", float(e % 50), float(3 * e % 100)) for e in [*range(36), 90, 91]]
    cells = spark.createDataFrame(rows, "entity long, feature string, value string").repartition(2).cache()
    return cells, spark.createDataFrame(meta, "entity long, genus string, family string, latitude double, longitude double").cache(), rows


def known_to(cells, meta):
    counts, book = stats.marginal_counts(cells), codebook(cells)
    return {
        "freq": lambda blanks: impute.impute_freq(cells, blanks),
        "genus": lambda blanks: impute.impute_group_majority(cells, blanks, meta),
        "knn": lambda blanks: impute.impute_knn(cells, blanks),
        "idf_knn": lambda blanks: impute.impute_knn(cells, blanks, weights=stats.idf(cells)),
        "condprob": lambda blanks: impute.impute_condprob(cells, blanks, book, stats.cooccurrence(cells), counts),
    }


def test_equals_real_removal(spark, world):
    cells, meta, rows = world
    found = leave_out.predictions(cells, meta, codebook(cells), stats.cooccurrence(cells), stats.marginal_counts(cells), stats.idf(cells))
    said = {(r["system"], r["entity"], r["feature"]): (r["value"], round(r["score"], 6)) for r in found.collect()}
    assert len(said) == len(leave_out.SYSTEMS) * (len(rows) - 1)  # the one cell of f9 has no others
    special = [r for r in rows if (r[0], r[1]) in ((90, "f1"), (91, "f0"), (91, "f1"), (3, "f9"), (5, "f1x"))]
    for entity, feature, _ in [*special, *random.Random(6).sample(rows, 2)]:
        left = cells.filter(~((F.col("entity") == entity) & (F.col("feature") == feature)))
        blank = spark.createDataFrame([(entity, feature)], "entity long, feature string")
        for system, ask in known_to(left, meta).items():
            got = [(r["value"], round(r["score"], 6)) for r in ask(blank).collect()]
            assert ([said[system, entity, feature]] if (system, entity, feature) in said else []) == got, (system, entity, feature)


def test_figures_equal_real_removal(spark, world):
    cells, meta, rows = world
    book = codebook(cells)
    found = leave_out.own_counts(cells, meta, book).collect()
    counted = {}
    for e, f, v in rows:
        counted.setdefault(f, []).append((e, v))
    group = {r["entity"]: (r["genus"], r["family"]) for r in meta.collect()}
    values = {f: sorted({v for _, v in ev}) for f, ev in counted.items()}
    assert len(found) == sum(len(values[f]) for _, f, _ in rows if len(values[f]) > 1)
    for r in found:
        e, f, v = r["entity"], r["feature"], r["value"]
        rest = [(o, x) for o, x in counted[f] if o != e]
        n = {x: sum(y == x for _, y in rest) for x in values[f]}
        assert abs(r["p"] - (n[v] + 0.5) / (len(rest) + 0.5 * len(values[f]))) < 1e-12
        assert r["n_entities"] == len(rest) and r["n_known"] == sum(x[0] == e for x in rows) - 1
        assert r["majority"] == (min((x for x in n if n[x]), key=lambda x: (-n[x], x)) if rest else None)
        for at, name in ((0, "genus"), (1, "family")):
            own = [x for o, x in rest if group[o][at] == group[e][at]]
            assert abs(r[f"{name}_share"] - (own.count(v) / len(own) if own else 0)) < 1e-12
            assert r[f"{name}_known"] == any(group[x[0]][at] == group[e][at] for x in rows if (x[0], x[1]) != (e, f))


def test_stack_learns_whom_to_trust(spark):
    """A system that is right on one kind of feature and wrong on the other, and one the other way round: the stack, which has seen left-out cells only, follows each where it is right."""
    rng = random.Random(7)
    truth = {(e, f"{k}{j}"): rng.choice("abc") for e in range(60) for k in "xy" for j in range(2)}
    blanked = {c for c in truth if rng.random() < 0.3}
    cells = spark.createDataFrame([(*c, v) for c, v in truth.items() if c not in blanked], "entity long, feature string, value string")
    blanks = spark.createDataFrame(sorted(blanked), "entity long, feature string")
    meta = spark.createDataFrame([(e, f"g{e % 4}", "m", float(e), 0.0) for e in range(60)], "entity long, genus string, family string, latitude double, longitude double")
    other = lambda v: "abc"[("abc".index(v) + 1) % 3]
    said = [(s, *c, v if (c[1][0] == "x") == (s == "one") else other(v), 1.0) for c, v in truth.items() for s in ("one", "two")]
    preds = spark.createDataFrame(said, "system string, entity long, feature string, value string, score double")
    book = codebook(cells)
    counts = stats.marginal_counts(cells)
    entropy = book.select("feature").distinct().withColumn("h", F.when(F.col("feature").startswith("x"), 1.0).otherwise(0.5))
    common = (book, stats.marginals(counts, book), entropy)
    train = impute.candidate_rows(cells, cells, *common, preds.join(cells.select(*CELL), list(CELL), "left_semi"), meta, ["one", "two"], left_out=leave_out.own_counts(cells, meta, book))
    train = train.join(cells.withColumnRenamed("value", "truth"), list(CELL)).withColumn("right", (F.col("value") == F.col("truth")).cast("int")).drop("truth")
    assert train.count() == 3 * cells.count() and train.filter("right = 1").count() == cells.count()
    test = impute.candidate_rows(cells, blanks, *common, preds.join(blanks, list(CELL), "left_semi"), meta, ["one", "two"])
    got = impute.stack_systems(train, test).collect()
    assert len(got) == len(blanked)
    assert sum(truth[r["entity"], r["feature"]] == r["value"] for r in got) > 0.85 * len(blanked)  # each system alone is right on half
