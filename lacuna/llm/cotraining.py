"""Quality classifier by co-training of two views of a document.

The content view holds figures of the words: how long, how many different, capitals, digits, symbols and punctuation in them, repeated words and
windows. The page view holds metadata: language, source (by hash), recorded length, and the page's layout, that is figures of its lines
(how many, how long, how many end a sentence, are short, repeat, or hold separators), which look at no word. Each view has a logistic classifier.

In every round each classifier labels the pool of unlabelled documents, and of those that it calls good, and of those that it calls bad, the
``growth`` it is surest of (``sure`` or more) and has not handed over yet teach the other view with half the weight of a true label.
In the end each view's score is calibrated on labelled rows that did not teach (a fourth of them), the two are combined by weights fitted on all
labelled rows, and all documents are scored in one pass.

Labelled rows (``sample``) and the pool (``pool``) are those with the smallest hash of the id, so what is fitted is bounded; everything
is scored.

Defined cases: null and empty texts have zero figures; null metadata count as values of their own; rows with equal ids are scored each
for itself, and the largest of them teaches; a null ``doc_id`` is scored and counts as not held out; labels that are null do not teach, and of several
labels of one id the larger holds; if the labels have one class or none, all get their share of ones (0.5 without any); an empty table gives no
rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, narrow, slices, texts
from .logistic import fit_dense, sigmoid
from .rules import SYMBOLS, repeat_words
from .toxicity import held_out

SOURCES = 16
LANGUAGES = ("en", "de", "fr", "es")
ENDS = re.compile(r"[.!?…][\"'”»)]*\s*$")
CONTENT = (
    "log_words", "word_length", "capitals", "symbols", "digits", "punctuation", "different_words", "repeat_windows", "shouted_words", "longest_run",
)
LAYOUT = ("log_lines", "line_size", "longest_line", "sentence_ends", "short_lines", "repeat_lines", "separators", "blank_lines")


def content(text: str) -> list[float]:
    """Figures of the words, zero if there are none."""
    words = text.split()
    if not words:
        return [0.0] * len(CONTENT)
    data, n, size = text.encode(), len(words), len(text)
    longest = run = 1
    for a, b in zip(words, words[1:], strict=False):
        run = run + 1 if a == b else 1
        longest = max(longest, run)
    return [
        math.log1p(n),
        min(20.0, sum(map(len, words)) / n),
        sum(map(str.isupper, text)) / size,
        min(2.0, (len(data) - len(data.translate(None, SYMBOLS))) / n),
        (len(data) - len(data.translate(None, b"0123456789"))) / size,
        min(2.0, (len(data) - len(data.translate(None, b".,;:!?"))) / n),
        len(set(words)) / n,
        repeat_words(words) / n,
        sum(map(str.isupper, words)) / n,
        math.log(longest),
    ]


def layout(text: str) -> list[float]:
    """Figures of the lines, zero if all are blank."""
    every = text.split("\n")
    lines = [x for x in every if x.strip()]
    if not lines:
        return [0.0] * len(LAYOUT)
    n, sizes = len(lines), [len(x) for x in lines]
    return [
        math.log1p(n),
        math.log1p(sum(sizes) / n),
        math.log1p(max(sizes)),
        sum(bool(ENDS.search(x)) for x in lines) / n,
        sum(x < 40 for x in sizes) / n,
        1 - len(set(lines)) / n,
        min(10.0, sum(x.count("|") for x in lines) / n),
        1 - n / len(every),
    ]


def page(lang: str | None, source: str | None, n_chars: int | None) -> list[float]:
    """Metadata as figures."""
    size = math.log1p(max(0, n_chars or 0))
    bucket = zlib.crc32((source or "").encode()) % SOURCES
    return [*(float(lang == x) for x in LANGUAGES), float(lang is None), size, size * size / 10, float(n_chars is None), *(float(bucket == i) for i in range(SOURCES))]


def views(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    own = texts(batch)
    meta = zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "n_chars")), own, strict=True)
    return np.array([content(t) for t in own]).reshape(-1, len(CONTENT)), np.array([page(*m) + layout(t) for *m, t in meta])


@dataclass
class View:
    """A classifier of one view: the scale of its columns, weights, and calibration of its logit."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    slope: float = 1.0
    shift: float = 0.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        return self.slope * (np.column_stack([(x - self.mean) / self.spread, np.ones(len(x))]) @ self.weights) + self.shift


def fit_view(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> View:
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    return View(mean, spread, fit_dense((x - mean) / spread, y, weights))


@dataclass
class Model:
    """Both views, their weights in the score, and, by round, how many (good, bad) pseudo-labels each view gave the other, content first."""

    text: View | None
    page: View | None
    mix: np.ndarray
    prior: float
    exchanged: tuple = ()

    def scores(self, x: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if self.text is None or self.page is None:
            flat = np.full(len(x), self.prior)
            return flat, flat, flat
        a, b = self.text.logit(x), self.page.logit(m)
        return sigmoid(a), sigmoid(b), sigmoid(np.column_stack([a, b, np.ones(len(a))]) @ self.mix)


def gather(docs: DataFrame, chosen: DataFrame) -> list:
    """Both views of the chosen documents (a bounded number), with their label, null in the pool."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x, m = views(batch)
            kind = pa.list_(pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), batch.column("y"), pa.array(list(x), kind), pa.array(list(m), kind)], ["doc_id", "y", "x", "m"])

    size = F.col("n_chars").cast("long").alias("n_chars")
    rows = docs.select("doc_id", F.struct("text", "lang", "source", size).alias("row")).join(F.broadcast(chosen), "doc_id")
    once = rows.groupBy("doc_id", "y").agg(F.max("row").alias("row")).select("doc_id", "y", "row.*")
    found = once.mapInArrow(run, "doc_id long, y int, x array<double>, m array<double>").collect()
    return sorted(found, key=lambda r: r["doc_id"])


def surest(p: np.ndarray, taken: dict[int, float], growth: float, sure: float) -> dict[int, float]:
    """Of the rows called good and of those called bad, the share that is surest and not taken yet, with their label."""
    out: dict[int, float] = {}
    for label, q in ((1.0, p), (0.0, 1 - p)):
        called = np.flatnonzero(q >= 0.5)
        new = [int(i) for i in called[np.argsort(-q[called], kind="stable")] if q[i] >= sure and int(i) not in taken]
        out |= dict.fromkeys(new[: math.ceil(growth * len(called))], label)
    return out


def fit(
    docs: DataFrame, labels: DataFrame, scratch: Scratch, label: str = "quality", learn: Column | None = None,
    sample: int = 10_000, pool: int = 10_000, rounds: int = 4, growth: float = 0.1, sure: float = 0.75,
) -> Model:
    """Learns from at most ``sample`` labelled rows that ``learn`` (by default: not held out) lets through, and ``pool`` unlabelled ones."""
    marked = labels.filter(F.col(label).isNotNull()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    taught = marked.filter(~held_out() if learn is None else learn).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    ids = docs.select("doc_id").filter("doc_id is not null").join(marked.select("doc_id"), "doc_id", "left_anti")
    free = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(pool).distinct().withColumn("y", F.lit(None).cast("int"))
    found = gather(docs, scratch.table(taught.unionByName(free), "chosen"))
    known = [r for r in found if r["y"] is not None]
    other = [r for r in found if r["y"] is None]
    y = np.array([r["y"] > 0 for r in known], float)
    prior = (y.sum() + 0.5) / (len(y) + 1)
    if len(set(y)) < 2 or len(y) < 20:
        return Model(None, None, np.zeros(3), prior)
    test = np.array([zlib.crc32(f"calibrate {r['doc_id']}".encode()) % 4 == 0 for r in known])
    if len(set(y[test])) < 2 or len(set(y[~test])) < 2:
        test = np.arange(len(y)) % 4 == 0
    data = [(own := np.array([r[v] for r in known]), np.array([r[v] for r in other]).reshape(len(other), own.shape[1])) for v in ("x", "m")]
    extra: list[dict[int, float]] = [{}, {}]  # by view: pseudo-labels of the pool that teach it
    fitted: list[View] = []
    exchanged = []
    for turn in range(rounds + 1):
        fitted = []
        for (own, rest), pseudo in zip(data, extra, strict=True):
            which = sorted(pseudo)
            x = np.vstack([own[~test], rest[which]]) if which else own[~test]
            fitted.append(fit_view(x, np.append(y[~test], [pseudo[i] for i in which]), np.append(np.ones((~test).sum()), np.full(len(which), 0.5))))
        if len(other) and turn < rounds:
            given = [surest(sigmoid(fitted[v].logit(data[v][1])), extra[1 - v], growth, sure) for v in (0, 1)]
            for v in (0, 1):
                extra[1 - v] |= given[v]
            exchanged.append(tuple((sum(x > 0 for x in g.values()), sum(x == 0 for x in g.values())) for g in given))
    logits = []
    for view, (own, _) in zip(fitted, data, strict=True):
        raw = view.logit(own[test])
        if len(set(y[test])) == 2:
            view.slope, view.shift = fit_dense(raw[:, None], y[test], l2=1e-3)
        logits.append(view.logit(own))
    mix = fit_dense(np.column_stack(logits), y, l2=1e-3)
    return Model(fitted[0], fitted[1], mix, prior, tuple(exchanged))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """Calibrated scores of both views and of the two together, and the verdict, for every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            columns = model.scores(*views(batch))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), *map(pa.array, columns), pa.array((columns[2] >= 0.5).astype(np.int32))], ["doc_id", "text_score", "page_score", "score", "predicted"]
            )

    rows = docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars"))
    return rows.mapInArrow(run, "doc_id long, text_score double, page_score double, score double, predicted int")
