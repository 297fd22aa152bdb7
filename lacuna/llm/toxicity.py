"""Counterfactual-regularised toxicity classifier.

A document's features are its different words, lower-cased, and their first four to seven letters. The labelled rows for learning are a
bounded sample (``sample`` labels with the smallest hash). Spark counts the features by label; the ``n_features`` that tell the labels
apart most surely (a log-odds ratio of ``min_z`` standard errors or more, in ``min_docs`` documents or more) make the model, and beside them the
terms to swap that are as frequent, whatever they tell: what a mention adds is learned, and then held down.

The terms to swap are those of a list, by language and kind of group, and neutral words: those found in a share of ``spread`` or more of the toxic and of the other
labelled documents alike, ``n_neutral`` of them at most, the commonest; a term's partners are the ``swaps`` that follow it in each of its groups. In each labelled document up to
``mentions`` of its terms are swapped, one at a time, in all sentences where they stand, and logistic
regression pays for every change of the score that a swap brings. So the mere mention of a group, or of a word that everybody uses, does not
raise the score. ``n_features``, ``n_neutral``, ``mentions`` and ``swaps`` shape the model; all of them count within the labelled rows that teach.

First, ``tune`` of those rows at most are dealt into quarters by hash, and each quarter is judged by what the others teach: so the strength of the prior is chosen, by log loss, and then the highest price of changes (``pull``) that calls
no more rows wrongly than a free model does and whose log loss isn't higher by more than a twentieth. Then all rows teach. The prior is worth a fixed number of rows, so few rows can't make large weights.

All documents are then scored in one pass over the scan's partitions; the model, bounded by ``n_features``, goes with the tasks.

Defined cases: null and empty texts have no features and get the score of the bias; rows with equal ids are scored each for itself, and
the largest of their texts teaches; a null ``doc_id`` is scored and counts as not held out; labels that are null do not teach, and of several
labels of one id the larger holds; without any labelled rows every score is 0; an empty table gives no rows; a very long text is one set of words like any other; other columns of the input are
ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, narrow, release, slices, texts
from .logistic import SparseRows, fit_sparse, sigmoid

#: Groups of people whose mere mention must not change a score, by language and kind; any other groups can be given.
IDENTITY = (
    ("woman", "man", "girl", "boy", "transgender"), ("women", "men", "girls", "boys"),
    ("muslim", "christian", "jew", "hindu", "buddhist", "atheist"), ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("immigrant", "refugee", "foreigner", "tourist"), ("immigrants", "refugees", "foreigners", "tourists"),
    ("gay", "lesbian", "bisexual", "straight"), ("gays", "lesbians", "bisexuals"),
    ("black", "white", "asian", "african", "latino", "arab"), ("blacks", "whites", "asians", "africans", "latinos", "arabs"), ("disabled", "elderly", "teenagers"),
    ("frau", "mann", "mädchen", "junge"), ("frauen", "männer", "mädchen", "jungen"), ("muslim", "christ", "jude", "hindu", "atheist"),
    ("muslime", "christen", "juden", "hindus", "atheisten"), ("ausländer", "flüchtling", "migrant"), ("ausländer", "flüchtlinge", "migranten"),
    ("schwarze", "weiße", "asiaten", "afrikaner", "araber"), ("schwule", "lesben", "behinderte"),
    ("femme", "homme", "fille", "garçon"), ("femmes", "hommes", "filles", "garçons"), ("musulman", "chrétien", "juif", "hindou", "athée"),
    ("musulmans", "chrétiens", "juifs", "hindous", "athées"), ("immigré", "réfugié", "étranger"), ("immigrés", "réfugiés", "étrangers"),
    ("noirs", "blancs", "asiatiques", "africains", "arabes"), ("gays", "lesbiennes", "handicapés"),
    ("mujer", "hombre", "niña", "niño"), ("mujeres", "hombres", "niñas", "niños"), ("musulmán", "cristiano", "judío", "hindú", "ateo"),
    ("musulmanes", "cristianos", "judíos", "hindúes", "ateos"), ("inmigrante", "refugiado", "extranjero"), ("inmigrantes", "refugiados", "extranjeros"),
    ("negros", "blancos", "asiáticos", "africanos", "árabes"), ("gays", "lesbianas", "discapacitados"),
)
WORDS = re.compile(r"[^\W_]+")
PREFIXES = (4, 5, 6, 7)
#: Words of which a task remembers what they add.
CACHE = 100_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def features_of(word: str) -> tuple[str, ...]:
    return (word, *(f"^{word[:n]}" for n in PREFIXES if len(word) >= n))


def features(text: str) -> set[str]:
    return {f for w in set(WORDS.findall(text.lower())) for f in features_of(w)}


Groups = tuple[tuple[str, ...], ...]


def partners(groups: Groups, swaps: int) -> dict[str, tuple[str, ...]]:
    """For each term, the ``swaps`` terms that follow it in each of its groups."""
    out: dict[str, dict[str, None]] = {}
    for group in groups:
        for i, term in enumerate(group):
            others = [group[(i + k) % len(group)] for k in range(1, min(swaps, len(group) - 1) + 1)]
            out.setdefault(term, {}).update((o, None) for o in others if o != term)
    return {term: tuple(others) for term, others in out.items()}


def swapped(words: set[str], others: dict[str, tuple[str, ...]], mentions: int) -> Iterator[tuple[set[str], set[str]]]:
    """The features that go and those that come if one term of a document, given by its words, is swapped for another. A document with
    many terms gives ``mentions`` of them, drawn by hash."""
    terms = sorted((w for w in words if w in others), key=lambda w: (zlib.crc32(f"{len(words)} {w}".encode()), w))[:mentions]
    if not terms:
        return
    held = Counter(f for w in words for f in features_of(w))
    for term in terms:
        own = {f for f in features_of(term) if held[f] == 1}
        for other in others[term]:
            if other not in words:
                new = {f for f in features_of(other) if not held[f] or f in own}
                yield own - new, new - own


@dataclass
class Model:
    """Weights by feature, and the bias; how many swaps were made, and how many of them touched a feature of the model."""

    weights: dict[str, float]
    bias: float
    swaps: int = 0
    pairs: int = 0
    terms: Groups = ()
    prior: float = 0.0
    pull: float = 0.0

    def scorer(self):
        """Scores of texts; what each word adds is looked up once."""
        weights, known = self.weights, {}

        def score(text: str) -> float:
            seen: set[str] = set()
            for word in set(WORDS.findall(text.lower())):
                got = known.get(word)
                if got is None:
                    if len(known) >= CACHE:
                        known.clear()
                    got = known[word] = tuple(f for f in features_of(word) if f in weights)
                seen.update(got)
            return self.bias + sum(map(weights.__getitem__, sorted(seen)))

        return score


def teaching_rows(docs: DataFrame, labels: DataFrame, label: str, learn: Column, sample: int) -> DataFrame:
    """(text, y): one document for each of at most ``sample`` labels. The labels' side is bounded by it, so it may be broadcast."""
    marked = labels.filter(F.col(label).isNotNull() & learn).groupBy("doc_id").agg(F.max(label).alias("y"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.groupBy("doc_id").agg(F.max(F.struct("text", F.col("y").cast("int").alias("y"))).alias("row")).select("row.*")


def neutral_words(counts: DataFrame, n0: int, n1: int, spread: float, n: int) -> Groups:
    """The ``n`` commonest words that stand in a share of ``spread`` or more of the documents of either label."""
    wide = counts.filter(~F.startswith("feature", F.lit("^")) & (F.col("n0") >= spread * n0) & (F.col("n1") >= spread * n1))
    words = tuple(r["feature"] for r in wide.orderBy(F.desc(F.col("n0") + F.col("n1")), "feature").limit(n).collect())
    return (words,) if n0 and n1 and len(words) > 1 else ()


@dataclass
class Lessons:
    """Bounded rows that teach: their features, labels, and what each swap takes and brings."""

    x: list[list[int]]
    y: np.ndarray
    gone: list[list[list[int]]]
    come: list[list[list[int]]]

    def part(self, rows: Iterable[int]) -> Lessons:
        rows = list(rows)
        return Lessons([self.x[i] for i in rows], self.y[rows], [self.gone[i] for i in rows], [self.come[i] for i in rows])

    def fit(self, n_features: int, prior: float, pull: float) -> tuple[np.ndarray, float]:
        gone, come = (SparseRows.of([p for row in swaps for p in row]) for swaps in (self.gone, self.come))
        return fit_sparse(SparseRows.of(self.x), self.y, n_features, gone, come, pull, l2=prior / max(1, len(self.y)))

    def losses(self, w: np.ndarray, b: float) -> tuple[float, int]:
        """Log loss, and how many are called wrongly."""
        p = sigmoid(SparseRows.of(self.x).dot(w) + b)
        loss = -np.log(np.where(self.y > 0, p, 1 - p)).mean()
        return float(loss), int(((p >= 0.5) != (self.y > 0)).sum())


PRIORS, PULLS = (0.1, 0.5, 2.0, 8.0), (0.3, 1.0, 3.0, 10.0)
FOLDS = 4


def tuned(lessons: Lessons, n_features: int, tune: int, prior: float | None, pull: float | None) -> tuple[float, float]:
    """(prior, pull), chosen on rows that did not teach if not given; the middle ones if the rows are too few or of one class."""
    rows = range(min(tune, len(lessons.y)))
    folds = [(lessons.part(i for i in rows if i % FOLDS == f), lessons.part(i for i in rows if i % FOLDS != f)) for f in range(FOLDS)]
    if any(len(set(taught.y.tolist())) < 2 or not len(held.y) for held, taught in folds):
        return PRIORS[2] if prior is None else prior, PULLS[1] if pull is None else pull

    def losses(prior: float, pull: float) -> tuple[float, int]:
        found = [held.losses(*taught.fit(n_features, prior, pull)) for held, taught in folds]
        return sum(loss for loss, _ in found), sum(wrong for _, wrong in found)

    if prior is None:
        prior = min(PRIORS, key=lambda p: losses(p, PULLS[1] if pull is None else pull)[0])
    if pull is None:
        loss, wrong = losses(prior, 0.0)
        for pull in reversed(PULLS):
            other, more = losses(prior, pull)
            if more <= wrong and other <= 1.05 * loss:
                break
        else:
            pull = 0.0
    return prior, pull


def fit(
    docs: DataFrame,
    labels: DataFrame,
    scratch: Scratch,
    label: str = "toxic",
    learn: Column | None = None,
    sample: int = 20_000,
    n_features: int = 8192,
    min_docs: int = 3,
    min_z: float = 3.5,
    identity: Groups = IDENTITY,
    spread: float = 0.1,
    n_neutral: int = 64,
    mentions: int = 4,
    swaps: int = 3,
    pull: float | None = None,
    prior: float | None = None,
    tune: int = 1_000,
) -> Model:
    """Learns from labelled rows that ``learn`` (a condition on ``doc_id``; by default: not held out) lets through."""
    rows = scratch.table(teaching_rows(docs, labels, label, ~held_out() if learn is None else learn, sample), "teaching")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        counts: dict[str, list[int]] = {}
        for batch in slices(batches):
            for text, y in zip(texts(batch), batch.column("y").to_pylist(), strict=True):
                for f in features(text):
                    counts.setdefault(f, [0, 0])[y > 0] += 1
        n0, n1 = zip(*counts.values(), strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(n0, pa.int64()), pa.array(n1, pa.int64())], ["feature", "n0", "n1"])

    n1, n0 = rows.agg(F.count_if(F.col("y") > 0), F.count_if(F.col("y") <= 0)).first()
    if not n0 + n1:
        return Model({}, -np.inf)
    odds = lambda n, of: F.log((F.col(n) + 0.5) / (F.lit(of) - F.col(n) + 0.5))
    spreads = F.sqrt(1 / (F.col("n0") + 0.5) + 1 / (F.col("n1") + 0.5))
    counted = rows.mapInArrow(count, "feature string, n0 long, n1 long").groupBy("feature").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
    every = scratch.table(counted.filter(F.col("n0") + F.col("n1") >= min_docs), "counted")
    sure = every.withColumn("z", F.abs(odds("n1", n1) - odds("n0", n0)) / spreads).filter(F.col("z") >= min_z)
    groups = tuple(identity) + neutral_words(every, n0, n1, spread, n_neutral)
    others = partners(groups, swaps)
    terms = every.filter(F.col("feature").isin(sorted(others))).select("feature")  # bounded by the list of terms
    best = sure.orderBy(F.desc("z"), "feature").limit(n_features).select("feature")
    chosen = sorted(r["feature"] for r in best.union(terms).distinct().collect())
    number = {f: i for i, f in enumerate(chosen)}

    def rows_of(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = lambda fs: sorted(number[f] for f in fs if f in number)
        kind = pa.list_(pa.list_(pa.int32()))
        for batch in slices(batches):
            x, gone, come, made = [], [], [], []
            for text in texts(batch):
                pairs = [(known(a), known(b)) for a, b in swapped(set(WORDS.findall(text.lower())), others, mentions)]
                made.append(len(pairs))
                pairs = [p for p in pairs if p[0] or p[1]]
                x.append(known(features(text)))
                gone.append([p[0] for p in pairs])
                come.append([p[1] for p in pairs])
            order = [zlib.crc32(repr(r).encode()) for r in zip(x, gone, come, strict=True)]
            columns = [batch.column("y"), pa.array(x, pa.list_(pa.int32())), pa.array(gone, kind), pa.array(come, kind), pa.array(made, pa.int32()), pa.array(order, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["y", "x", "gone", "come", "made", "place"])

    # at most ``sample`` short rows; in an order of their own, so that the sums do not depend on how they were dealt
    schema = "y int, x array<int>, gone array<array<int>>, come array<array<int>>, made int, place long"
    found = rows.mapInArrow(rows_of, schema).toArrow().sort_by([("place", "ascending"), ("y", "ascending")]).combine_chunks()
    scratch.drop("teaching", "counted")
    lists = {c: found.column(c).to_pylist() for c in ("x", "gone", "come")}
    lessons = Lessons(lists["x"], (found.column("y").to_numpy() > 0).astype(float), lists["gone"], lists["come"])
    prior, pull = tuned(lessons, len(chosen), tune, prior, pull)
    w, b = lessons.fit(len(chosen), prior, pull)
    weights = {f: float(w[i]) for f, i in number.items() if w[i]}
    return Model(weights, b, int(found.column("made").to_numpy().sum()), sum(map(len, lessons.gone)), groups[len(identity) :], prior, pull)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, predicted) of every document."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = model.scorer()
        release()
        for batch in slices(batches):
            scores = sigmoid(np.array([logit(t) for t in texts(batch)]))
            if model.bias == -np.inf:
                scores[:] = 0
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(scores), pa.array((scores >= 0.5).astype(np.int32))], ["doc_id", "score", "predicted"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, score double, predicted int")


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """The documents, with all their columns, that the model does not call toxic."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logit = model.scorer()
        release()
        for batch in slices(batches):
            yield batch.filter(pa.array([logit(t) < 0 for t in texts(batch)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
