"""What leave-one-out predictions and the stack work on grows with what differs, not with copies, and no task gets all of it."""

import math
import random

import pytest
from pyspark.sql import functions as F

from lacuna.operators import evaluate, impute, leave_out, postings, stats
from lacuna.operators.coding import codebook
from lacuna.plans import q_impute
from lacuna.plans.inputs import Inputs
from test_leave_out import known_to
from test_postings import plain, tables


def test_equal_entities_are_one_question(spark, monkeypatch):
    """12 different entities in 6 copies each: conditional probabilities are asked for 12, and every copy gets what it would get if its cell were really removed."""
    rng = random.Random(3)
    kinds = [{f"f{f}": rng.choice("aab") for f in range(4) if rng.random() < 0.9} for _ in range(12)]
    rows = [(e, f, v) for e in range(72) for f, v in kinds[e % 12].items()]
    cells = spark.createDataFrame(rows, "entity long, feature string, value string").repartition(2).cache()
    meta = spark.createDataFrame([(e, f"g{e % 5}") for e in range(72)], "entity long, genus string").cache()
    asked, real = [], leave_out.left_out_condprob
    monkeypatch.setattr(leave_out, "left_out_condprob", lambda own, *more: (asked.append(own.select("entity").distinct().count()), real(own, *more))[1])
    found = leave_out.predictions(cells, meta, codebook(cells), stats.cooccurrence(cells), stats.marginal_counts(cells), stats.idf(cells)).collect()
    assert asked == [len({tuple(sorted(k.items())) for k in kinds})]
    said = {(r["system"], r["entity"], r["feature"]): (r["value"], round(r["score"], 6)) for r in found}
    assert len(found) == len(said) == 5 * len(rows)
    for entity, feature, _ in (next(r for r in rows if r[0] == e) for e in (0, 71)):  # a first and a last copy
        left = cells.filter(~((F.col("entity") == entity) & (F.col("feature") == feature)))
        for system, ask in known_to(left, meta).items():
            assert [said[system, entity, feature]] == [(r["value"], round(r["score"], 6)) for r in ask(spark.createDataFrame([(entity, feature)], "entity long, feature string")).collect()], system


@pytest.mark.parametrize("leave_out", [False, True])
def test_queries_of_a_block_go_to_several_tasks(spark, monkeypatch, leave_out):
    rng = random.Random(5)
    rows = {i: {rng.randint(0, 3), rng.randint(4, 20), 100 + i} for i in range(64)}
    queries = {i: dict.fromkeys(rows[i], 1.0) for i in rows}
    monkeypatch.setattr(postings, "SHARE", 8)
    visit, tasks = postings.visit, []

    def seen(*args):
        out = visit(*args)
        tasks.append(out.select(F.spark_partition_id().alias("t")).distinct().count())
        return out

    monkeypatch.setattr(postings, "visit", seen)
    got = postings.shared_top_k(*tables(spark, queries, rows), k=3, leave_out=leave_out)
    assert sorted((tuple(x) for x in got.collect()), key=str) == plain(queries, rows, 3, leave_out)
    assert tasks[0] > 4


def test_shared_places_are_not_searched(spark, monkeypatch):
    rng = random.Random(6)
    at = {e: (float(rng.randint(-3, 3)), float(rng.randint(0, 5))) for e in range(60)}
    known = {e: p for e, p in at.items() if e % 3}
    table = lambda d: spark.createDataFrame([(e, *p) for e, p in d.items()], "entity long, latitude double, longitude double")
    asked, real = [], evaluate.top_k
    monkeypatch.setattr(evaluate, "top_k", lambda q, r, *more: (asked.append((q.count(), r.count())), real(q, r, *more))[1])
    got = {r["entity"]: r["km"] for r in evaluate.min_haversine_km(table(at), table(known)).collect()}

    def km(a, b):
        (la, lo), (lb, lp) = (tuple(map(math.radians, x)) for x in (a, b))
        return 2 * 6371.0 * math.asin(math.sqrt(math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((lp - lo) / 2) ** 2))

    assert got.keys() == at.keys()
    assert all(abs(got[e] - min(km(p, q) for o, q in known.items() if o != e)) < 1e-6 for e, p in at.items())
    alone = {p for e, p in at.items() if not any(q == p for o, q in known.items() if o != e)}
    assert asked == [(len(alone), len(set(known.values())))]
    # everybody shares a place: nothing is left to search
    both = {e: at[e // 2] for e in range(120)}
    assert {r["km"] for r in evaluate.min_haversine_km(table(both), table(both)).collect()} == {0.0}


def test_cross_validation_asks_for_no_blanks(spark, data, monkeypatch):
    def refuse(*args, **more):
        raise AssertionError("blanks were predicted")

    monkeypatch.setattr(impute, "impute_knn", refuse)
    stack = q_impute.Stack(Inputs(spark, data))
    assert stack.train().filter("right = 1").count() == stack.i.cells.join(stack.i.book, ["feature", "value"], "left_semi").count()
