"""Language-model scores by Brown's class-based n-grams.

Every training text is counted. Words of a share of ``known_share`` or more of all tokens (so there are at most ``1 / known_share`` of them) are
the dictionary that goes with the tasks; the counts of all others stay a distributed table. What is clustered are units: the words of a share of ``unit_share`` or more, one by
one, and for all rarer words and unknown ones their endings, hashed to ``ENDINGS`` groups. So every word has a class that any task can tell. The end of a text is a unit and a
class of its own.

The exchange algorithm starts with units dealt to classes by rank of frequency. Each unit's neighbours, with counts over the whole corpus, are gathered into one row,
once. In every round a task works out, for each of its units, what moving it to any other class does to the likelihood of the class bigrams

    F = sum N(a, b) ln N(a, b) - 2 sum N(a) ln N(a)

with the counts after taking the unit out of its class, and proposes the best move; half of the units move in a round, the other half in the next, then class counts are
taken anew. The best classes of all rounds are kept. Rounds shuffle nothing but class counts.

The model is a class trigram with emissions, in log10:

    P(w | a, b) = (1 - p0) (l3 N(a, b, c) / N(a, b) + l2 N(b, c) / N(b) + l1 N(c) / N) n(w) / N(c),  c the class of w

with weights by deleted interpolation (each trigram votes, without itself, for the order that predicts it best), orders without their context left out and the others scaled up. An
unknown word has p0 = 0.5 / (N + 0.5 (V + 1)), as in the base model, so the probabilities of all words and the unknown one sum to 1.

Documents are scored in one scan: transitions and dictionary words in the task; rare words as rows (word, document), which meet in a shuffle by word, where their training count is the sum
of those very rows, and go back to their document as sums.

Defined cases: null, empty and wordless texts are just the end; rows with equal ids are counted and scored each for itself; a null ``doc_id`` counts as
not held out; without training texts all scores are 0; a very long text is one task's work; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, raw, release, slices

#: Groups of endings of rare words.
ENDINGS = 1024
#: Different words, or pairs of units, that a task holds before it hands them on.
HELD_WORDS, HELD_PAIRS = 300_000, 3_000_000


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether crc32 of the id as text, modulo 5, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 1, F.lit(False))


def words_of(text: bytes) -> list[bytes]:
    return text.lower().split()


def ending(word: bytes) -> int:
    """The group of a rare word: its last three bytes, and whether they are all there is."""
    return zlib.crc32(word[-3:] if len(word) > 3 else word + b" ") % ENDINGS


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of the column ``text``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: Counter[bytes] = Counter()
        give = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in slices(batches):
            for text in raw(batch):
                held.update(words_of(text))
                if len(held) > HELD_WORDS:
                    yield give()
                    held.clear()
        if held:
            yield give()

    return docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class Vocabulary:
    """The dictionary by falling count, with its counts; how many of its words are units; texts, tokens and different tokens of the corpus."""

    words: list[bytes]
    counts: np.ndarray
    n_units: int
    n_docs: int
    n_tokens: int
    n_different: int

    @property
    def end(self) -> int:
        return self.n_units

    @property
    def size(self) -> int:
        """Units in all: words, the end, endings."""
        return self.n_units + 1 + ENDINGS

    def encoder(self):
        """From texts to (places of the first tokens, units, dictionary numbers): one number a token; no dictionary number (-1) for rare words, -2 for the end."""
        number = {w: i for i, w in enumerate(self.words)}
        unit_of = np.array([i if i < self.n_units else self.n_units + 1 + ending(w) for i, w in enumerate(self.words)] + [self.end, 0], dtype=np.int64)

        def encode(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes]]:
            sizes = np.array([len(t) + 1 for t in texts], dtype=np.int64)
            flat = [w for t in texts for w in (*t, b" ")]
            get = number.get
            known = np.fromiter((get(w, -1) for w in flat), np.int64, len(flat))
            ends = np.cumsum(sizes) - 1
            known[ends] = -2
            units = unit_of[known]
            rare = np.flatnonzero(known == -1)
            units[rare] = [self.n_units + 1 + ending(flat[i]) for i in rare.tolist()]
            return ends - sizes + 1, units, known, flat

        return encode


def vocabulary(docs: DataFrame, scratch: Scratch, known_share: float, unit_share: float) -> Vocabulary:
    """Counts all words of the training texts; the words kept here are bounded by the shares."""
    words = scratch.table(count_words(docs), "words")
    n_docs = docs.count()
    n_words, n_different = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    n_tokens = n_words + n_docs
    found = words.filter(F.col("n") >= known_share * n_tokens).toArrow().sort_by([("n", "descending"), ("word", "ascending")])
    scratch.drop("words")
    counts = found.column("n").to_numpy()
    return Vocabulary(found.column("word").to_pylist(), counts, int((counts >= unit_share * n_tokens).sum()), n_docs, n_tokens, n_different + (n_docs > 0))


NEAR = "unit int, code array<int>, n array<long>"


def listed(unit: np.ndarray, code: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """Rows of units, which come in order, with the lists of their codes and counts."""
    starts = np.flatnonzero(np.r_[True, unit[1:] != unit[:-1]])
    offsets = pa.array(np.append(starts, len(unit)).astype(np.int32))
    lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (code.astype(np.int32), n.astype(np.int64))]
    return pa.RecordBatch.from_arrays([pa.array(unit[starts].astype(np.int32)), *lists], ["unit", "code", "n"])


def summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Each code once, with the sum of its counts."""
    code, inverse = np.unique(np.concatenate(codes), return_inverse=True)
    return code, np.bincount(inverse, np.concatenate(counts)).astype(np.int64)


def neighbours(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(unit, code, n): the lists of each unit's neighbours, code being twice the other unit, and one more if it follows, and of their numbers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encode, size = vocabulary.encoder(), vocabulary.size
        held, waiting = [], 0

        def give() -> Iterator[pa.RecordBatch]:
            keys, counts = summed(*map(list, zip(*held, strict=True)))
            before, after = keys // size, keys % size
            yield listed(before, 2 * after + 1, counts)
            order = np.argsort(after, kind="stable")
            yield listed(after[order], 2 * before[order], counts[order])

        for batch in slices(batches):
            _, units, _, _ = encode([words_of(t) for t in raw(batch)])
            found = np.unique(np.r_[vocabulary.end, units[:-1]] * size + units, return_counts=True)
            held.append(found)
            waiting += len(found[0])
            if waiting > HELD_PAIRS:
                yield from give()
                held, waiting = [], 0
        if held:
            yield from give()

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """All lists of a unit come one after the other."""
        unit, codes, counts, waiting = None, [], [], 0
        for batch in batches:
            units, starts, code, n = flattened(batch)
            for i, u in enumerate(units.tolist()):
                if u != unit or waiting > HELD_PAIRS:
                    if codes:
                        codes, counts = ([x] for x in summed(codes, counts))
                    if u != unit and codes:
                        yield listed(np.full(len(codes[0]), unit), codes[0], counts[0])
                        codes, counts = [], []
                    unit, waiting = u, 0
                part = slice(starts[i], starts[i + 1])
                codes.append(code[part])
                counts.append(n[part])
                waiting += starts[i + 1] - starts[i]
        if codes:
            code, n = summed(codes, counts)
            yield listed(np.full(len(code), unit), code, n)

    return docs.select("text").mapInArrow(run, NEAR).repartition("unit").sortWithinPartitions("unit").mapInArrow(merge, NEAR)


def flattened(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(units, start of each unit's neighbours, codes, counts) of a batch of neighbour rows."""
    offsets = batch.column("code").offsets.to_numpy()
    return batch.column("unit").to_numpy(), offsets - offsets[0], batch.column("code").flatten().to_numpy(), batch.column("n").flatten().to_numpy()


def class_counts(near: DataFrame, classes: np.ndarray, n_classes: int) -> np.ndarray:
    """How often each class follows each class."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n_classes * n_classes)
        for batch in batches:
            units, starts, code, n = flattened(batch)
            before = np.repeat(classes[units], np.diff(starts))
            follows = code & 1 == 1
            total += np.bincount(before[follows] * n_classes + classes[code[follows] >> 1], n[follows], len(total))
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells].astype(np.int64))], ["cell", "n"])

    out = np.zeros(n_classes * n_classes)
    for r in near.mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow().to_pylist():  # at most one row a pair of classes
        out[r["cell"]] = r["n"]
    return out.reshape(n_classes, n_classes)


def entropy(x: np.ndarray) -> np.ndarray:
    """x ln x, 0 at 0."""
    return x * np.log(np.maximum(x, 1))


def likelihood(counts: np.ndarray) -> float:
    return float(entropy(counts).sum() - entropy(counts.sum(0)).sum() - entropy(counts.sum(1)).sum())


def gains(counts: np.ndarray, own: int, before: np.ndarray, after: np.ndarray, twice: float) -> np.ndarray:
    """What the likelihood becomes, up to a constant, if a unit of class ``own`` goes to each class: ``before`` and ``after`` count its neighbours'
    classes, ``twice`` how often it follows itself."""
    rest = counts.copy()
    rest[:, own] -= before
    rest[own] -= after
    rest[own, own] -= twice
    size, left, right = twice + before.sum(), counts.sum(1), counts.sum(0)
    left[own] -= size
    right[own] -= size
    f = entropy(rest)
    column = (entropy(rest + before[:, None]) - f).sum(0)
    row = (entropy(rest + after) - f).sum(1)
    d = rest.diagonal()
    # the cell of the class with itself gets both sides at once
    both = entropy(d + before + after + twice) - entropy(d + before) - entropy(d + after) + entropy(d)
    return column + row + both - (entropy(left + size) - entropy(left)) - (entropy(right + size) - entropy(right))


def moves(near: DataFrame, classes: np.ndarray, counts: np.ndarray, end: int, turn: int) -> dict[int, int]:
    """Units that gain by another class, of those whose turn it is."""
    n_classes = len(counts)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units, starts, codes, ns = flattened(batch)
            out = []
            for i, unit in enumerate(units.tolist()):
                if unit == end or (unit + turn) % 2:
                    continue
                code, n = codes[starts[i] : starts[i + 1]], ns[starts[i] : starts[i + 1]]
                other = code >> 1
                sides = [(code & 1 == side) & (other != unit) for side in (0, 1)]
                before, after = (np.bincount(classes[other[s]], n[s], n_classes) for s in sides)
                gain = gains(counts, classes[unit], before, after, float(n[code == 2 * unit + 1].sum()))[:-1]  # the last class is the end's
                best = int(gain.argmax())
                if gain[best] > gain[classes[unit]] + 1e-6:
                    out.append((unit, best))
            moved = np.array(out, dtype=np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(moved[:, 0]), pa.array(moved[:, 1])], ["unit", "class"])

    return {r["unit"]: r["class"] for r in near.mapInArrow(run, "unit int, class int").toArrow().to_pylist()}  # at most one row a unit


def cluster(near: DataFrame, vocabulary: Vocabulary, n_classes: int, rounds: int) -> np.ndarray:
    """The class of each unit; the end's is ``n_classes``."""
    classes = np.arange(vocabulary.size, dtype=np.int64) % n_classes
    classes[vocabulary.end] = n_classes
    best, reached = classes, -np.inf
    for turn in range(rounds + 1):
        counts = class_counts(near, classes, n_classes + 1)
        if likelihood(counts) > reached:
            best, reached = classes, likelihood(counts)
        if turn < rounds:
            classes = classes.copy()
            for unit, to in moves(near, classes, counts, vocabulary.end, turn).items():
                classes[unit] = to
    return best


def contexts(starts: np.ndarray, classes: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The classes before each token, and before those; ends before a text."""
    one, two = np.r_[end, classes[:-1]], np.r_[end, end, classes[:-2]] if len(classes) > 1 else np.full(len(classes), end)
    two[starts] = end
    return two, one


def count_trigrams(docs: DataFrame, vocabulary: Vocabulary, classes: np.ndarray) -> np.ndarray:
    """How often each class follows each pair of classes."""
    n = int(classes.max()) + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        encode, total = vocabulary.encoder(), np.zeros(n**3, dtype=np.int64)
        for batch in slices(batches):
            starts, units, _, _ = encode([words_of(t) for t in raw(batch)])
            third = classes[units]
            first, second = contexts(starts, third, n - 1)
            np.add.at(total, (first * n + second) * n + third, 1)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells.astype(np.int32)), pa.array(total[cells])], ["cell", "n"])

    found = docs.select("text").mapInArrow(run, "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()  # bounded by the classes
    out = np.zeros(n**3, dtype=np.int64)
    out[found.column("cell").to_numpy()] = found.column("n").to_numpy()
    return out.reshape(n, n, n)


def transitions(counts: np.ndarray) -> np.ndarray:
    """log10 of the smoothed probability of each class after each pair of classes."""
    c3 = counts.astype(float)
    c2, c1 = c3.sum(0), c3.sum((0, 1))
    of3, of2, total = c3.sum(2), c3.sum((0, 2)), max(1.0, c3.sum())
    less = lambda a, b: np.where(b > 1, (a - 1) / np.maximum(b - 1, 1), 0.0)
    votes = np.stack([less(c3, of3[:, :, None]), np.broadcast_to(less(c2, of2[:, None]), c3.shape), np.broadcast_to((c1 - 1) / max(1.0, total - 1), c3.shape)])
    winner = votes.argmax(0)
    weight = np.array([c3[winner == i].sum() + 1 for i in range(3)])  # every order keeps some weight
    weight /= weight.sum()
    seen3, seen2 = (of3 > 0)[:, :, None], (of2 > 0)[None, :, None]
    sums = weight[0] * c3 / np.maximum(of3, 1)[:, :, None] + weight[1] * (c2 / np.maximum(of2, 1)[:, None])[None] + weight[2] * (c1 / total)
    given = weight[0] * seen3 + weight[1] * seen2 + weight[2]
    with np.errstate(divide="ignore"):
        return np.log10(sums / given)


@dataclass
class Model:
    """Classes of units, log10 transitions and class sizes."""

    vocabulary: Vocabulary
    classes: np.ndarray
    transitions: np.ndarray
    sizes: np.ndarray

    @property
    def scale(self) -> float:
        return self.vocabulary.n_tokens + 0.5 * (self.vocabulary.n_different + 1)

    @property
    def unknown(self) -> float:
        """The probability of an unknown word."""
        return 0.5 / self.scale

    def known_terms(self) -> np.ndarray:
        """log10 (1 - p0) / N(c) of each class, 0 for classes without words."""
        return np.where(self.sizes > 0, np.log10(max(1 - self.unknown, 1e-300)) - np.log10(np.maximum(self.sizes, 1)), 0.0)


def fit(docs: DataFrame, scratch: Scratch, learn: Column | None = None, n_classes: int = 64, rounds: int = 8, known_share: float = 1e-6, unit_share: float = 1e-5) -> Model:
    """Learns from all documents that ``learn`` (a condition on ``doc_id``; by default: not held out) lets through."""
    taught = docs.filter(~held_out() if learn is None else learn).select("text")
    words = vocabulary(taught, scratch, known_share, unit_share)
    near = scratch.table(neighbours(taught, words), "near")
    classes = cluster(near, words, n_classes, rounds)
    scratch.drop("near")
    counts = count_trigrams(taught, words, classes)
    return Model(words, classes, transitions(counts), counts.sum((0, 1)))


def score(docs: DataFrame, model: Model, learn: Column | None = None) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every document; ``learn`` as in ``fit``."""
    words, end = model.vocabulary, len(model.sizes) - 1
    floor = float(np.log10(model.unknown))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, done = TaskContext.get().partitionId() << 40, 0
        encode, emit = words.encoder(), model.known_terms()
        counts = np.r_[words.counts, words.n_docs, 0].astype(float)  # the end is number -2, a rare word -1
        base_of = np.log10((counts + 0.5) / model.scale)
        log_count = np.log10(np.maximum(counts, 1))
        for batch in slices(batches):
            starts, units, known, flat = encode([words_of(t) for t in raw(batch)])
            classes = model.classes[units]
            two, one = contexts(starts, classes, end)
            terms = model.transitions[two, one, classes] + emit[classes]
            rare = known == -1
            here = np.where(rare | (counts[known] == 0), 0.0, terms + log_count[known])
            if not words.n_docs:
                here[:] = 0.0
            doc = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(flat)]))
            sums = [np.add.reduceat(x, starts) for x in (np.ones(len(flat)), (~rare & (counts[known] > 0)).astype(float), np.where(rare, 0.0, base_of[known]), here)]
            held: dict[tuple[int, bytes], list[float]] = {}
            for i, d, t in zip(np.flatnonzero(rare).tolist(), doc[rare].tolist(), terms[rare].tolist(), strict=True):
                got = held.setdefault((d, flat[i]), [0, 0.0])
                got[0] += 1
                got[1] += t
            key = part + done
            done += len(starts)
            n = len(held)
            taught = ~batch.column("held_out").to_numpy(zero_copy_only=False)
            docs_of = np.array([d for d, _ in held], dtype=np.int64)
            times = np.array([k for k, _ in held.values()], dtype=np.int32)
            # each document's own row first: its group is its key after a space, which no word holds
            columns = [
                pa.array([b" %d" % (key + i) for i in range(len(starts))] + [w for _, w in held], pa.binary()),
                pa.array(np.r_[key + np.arange(len(starts)), key + docs_of]),
                pa.array(np.r_[np.zeros(len(starts), np.int32), np.where(taught[docs_of], times, -times)].astype(np.int32)),
                pa.array(np.r_[sums[3], [t for _, t in held.values()]]),
                pa.concat_arrays([batch.column("doc_id").cast(pa.int64()), pa.nulls(n, pa.int64())]),
                pa.array(np.r_[sums[0], np.zeros(n)].astype(np.int64)),
                pa.array(np.r_[sums[1], np.zeros(n)].astype(np.int64)),
                pa.array(np.r_[sums[2], np.zeros(n)]),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["word", "key", "times", "term", "doc_id", "n_tokens", "n_known", "base"])

    held = held_out() if learn is None else ~learn
    rows = docs.select("doc_id", "text", F.coalesce(held, F.lit(False)).alias("held_out"))
    schema = "word binary, key long, times int, term double, doc_id long, n_tokens long, n_known long, base double"
    # a rare word's training count: its rows of training documents
    count = F.sum(F.greatest("times", F.lit(0))).over(Window.partitionBy("word"))
    met = rows.mapInArrow(run, schema).withColumn("count", count).withColumn("k", F.abs("times"))
    known = (F.col("k") > 0) & (F.col("count") > 0)
    log_count = F.log10(F.greatest("count", F.lit(1)).cast("double"))
    own = met.select(
        "key", "doc_id", "n_tokens",
        (F.col("n_known") + F.when(known, F.col("k")).otherwise(0)).alias("n_known"),
        (F.col("base") + F.col("k") * F.log10((F.col("count") + 0.5) / F.lit(model.scale))).alias("base"),
        F.when(F.col("k") == 0, F.col("term")).when(known, F.col("term") + F.col("k") * log_count).otherwise(F.col("k") * F.lit(floor)).alias("term"),
    )
    summed = own.groupBy("key").agg(F.max("doc_id").alias("doc_id"), F.sum("n_tokens").alias("n_tokens"), F.sum("n_known").alias("n_known"), F.sum("base").alias("base_score"), F.sum("term").alias("score"))
    after = F.coalesce(held, F.lit(False)).alias("held_out")
    return summed.select("doc_id", after, "n_tokens", "n_known", F.lit(words.n_tokens).cast("long").alias("train_tokens"), "base_score", "score")
