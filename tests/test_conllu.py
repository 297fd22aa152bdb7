"""Treebank files, parsed and written a batch of sentences at a time: the same as line by line, for odd lines too."""

import random

import pytest
from test_orders import drawn

from lacuna.plans import QUERIES
from lacuna.sources import files, sinks


def test_odd_lines(spark, monkeypatch):
    line = lambda i, form="w", head="0", upos="NOUN", deprel="obj": f"{i}\t{form}\t_\t{upos}\t_\t_\t{head}\t{deprel}\t_\t_"
    texts = [
        f"# c\r\n{line(1)}\r\n  {line(2, head=1, deprel='obj:sub:x')}  \r\n1-2\tx\n{line('3-4')}\n{line('3.1')}\n{line('+3')}\n{line(' 4 ')}",
        f"{line(1, form='', upos='_')}\n{line(2, head='x')}\n{line(3, head='1.5')}\n{line(4, head='99999999999')}\n{line(5, head='-1', deprel='')}\nshort\tline",
        "# nothing",
        "",
    ]
    rows = spark.createDataFrame([("a", "s", n, t) for n, t in enumerate(texts)], "lang string, split string, sent long, s string")
    for cols, first in ((8, [(1, "", "_", 0, "obj"), (5, "w", "NOUN", -1, "")]), (10, [(5, "w", "NOUN", -1, "")])):
        got = {r["sent"]: [tuple(t) for t in r["tokens"]] for r in files.parse_sentences(rows, cols).collect()}
        assert got == {0: [(1, "w", "NOUN", 0, "obj"), (2, "w", "NOUN", 1, "obj"), (3, "w", "NOUN", 0, "obj"), (4, "w", "NOUN", 0, "obj")], 1: first}
        lists = {r["sent"]: list(zip(r["ids"], r["forms"], r["tags"], r["heads"], r["deprels"], strict=True)) for r in files.parse_sentences(rows, cols, lists=True).collect()}
        assert lists == got


def test_written_line_by_line(spark):
    rows = drawn(200)
    random.Random(3).shuffle(rows)
    df = spark.createDataFrame(rows, "lang string, split string, sent long, tokens array<struct<id: int, form: string, upos: string, head: int, deprel: string>>, order array<struct<id: int, position: int>>")
    for r, (_, _, sent, tokens, order) in zip(sinks.conllu_sentences(df).orderBy("sent").collect(), sorted(rows, key=lambda x: x[2]), strict=True):
        lines = []
        for i, form, upos, head, deprel in tokens:
            for own, p in order:
                if own is not None and own == i:
                    up = next((q for o, q in order if o is not None and o == head), 0) or 0
                    lines.append((-1 if p is None else p, "\t".join(str(x) for x in (p, form, "_", upos, "_", "_", up, deprel, "_", "_") if x is not None)))
        assert r["sent"] == sent and r["text"] == "\n".join(x for _, x in sorted(lines)) + "\n"


@pytest.mark.parametrize("name", ["s5_read_conllu", "w5_write_conllu"])
def test_no_functions_of_list_elements(spark, data, name):
    assert "lambdafunction" not in QUERIES[name](spark, data)._jdf.queryExecution().optimizedPlan().toString()
