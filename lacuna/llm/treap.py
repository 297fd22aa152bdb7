"""Ranked lexical search over K2-treaps of the grid of terms and documents.

The documents are dealt into blocks of about ``postings`` grid points. A block numbers its terms by falling document frequency and its documents
by rising id, and keeps the grid as a compressed quadtree: a node covers as many terms as documents, its mask of four bits names the quarters that
are not empty, and its top is the largest impact inside. Nodes are stored level by level, so the first child of a node comes after as
many nodes as the masks before it have bits; nothing but masks and tops is stored, each top as what it lacks to that of the node above, compressed. All terms and documents are indexed, and an index answers any items.

An item's terms are looked up in the blocks' term lists by a join, so a block gets, for each item, just the rows of the terms that it has. There the
row paths of all terms go down the quadtree together, over ranges of documents: the sum of weight times top of the terms' nodes bounds the
score of every document in the range. The ranges with the highest bounds are split first, several at a time, and a range is left when it can't
beat the ``k`` documents found. A range of one document has its exact score. The best ``k`` of the blocks' best are the answer.

Scores are integers: see ``impacts`` and ``weight``.

Defined cases: null and wordless texts have no terms, are never found and are not counted; documents with equal ids are ranked each for itself,
those with a null id after all others of the same score; items with the same id are one item with the terms of all its texts, a null id too;
items without known terms, and empty tables, give no rows; very long texts make a block of their own; other columns are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, narrow, raw, release, slices

#: What a term is made of: ASCII letters and digits, and everything beyond ASCII; the rest separates.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
FOLD = bytes(c if c > 127 else ord(chr(c).lower()) if chr(c).isalnum() else 32 for c in range(256))
#: Bits set in a mask, before each quarter and in all.
BITS = np.array([[bin(mask & ((1 << slot) - 1)).count("1") for slot in range(5)] for mask in range(16)], dtype=np.int64)
#: Documents of a block at most.
BLOCK_DOCS = 1 << 16
#: Ranges that are split at once, at first; twice as many every time.
AT_ONCE = 32


def terms_of(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def impacts(tf: np.ndarray, length: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """What occurrences of a term count for, less for long documents: below a million."""
    norm = 50 + (50 * length * n_docs) // n_terms
    return (1_000_000_000 * tf) // (1000 * tf + 20 * norm)


def weight(df: Column, n_docs: int) -> Column:
    """A rare term weighs more: a thousand times the logarithm of (2 N + 2) / (2 df + 1), rounded down."""
    return F.floor(1000 * F.log((2 * F.lit(n_docs) + 2).cast("double") / (2 * df + 1).cast("double"))).cast("long")


def spread(a: np.ndarray) -> np.ndarray:
    """The bits of numbers below 2^31, each followed by a zero."""
    a = a.astype(np.uint64)
    for shift, keep in ((16, 0x0000FFFF0000FFFF), (8, 0x00FF00FF00FF00FF), (4, 0x0F0F0F0F0F0F0F0F), (2, 0x3333333333333333), (1, 0x5555555555555555)):
        a = (a | (a << np.uint64(shift))) & np.uint64(keep)
    return a


def zstd(a: np.ndarray) -> bytes:
    return pa.compress(a, "zstd", asbytes=True)


@dataclass
class Treap:
    """The quadtree of a block: ``height`` levels below the root, masks of the inner nodes, tops of all."""

    height: int
    masks: np.ndarray
    tops: np.ndarray

    @classmethod
    def of(cls, row: np.ndarray, column: np.ndarray, impact: np.ndarray) -> Treap:
        """From grid points, of which no two share row and column."""
        height = max(1, int(max(row.max(), column.max())).bit_length())
        code = (spread(row) << np.uint64(1)) | spread(column)
        order = np.argsort(code)
        code, top = code[order], impact[order].astype(np.int32)
        masks, tops = [], [top]
        for _ in range(height):
            parent = code >> np.uint64(2)
            starts = np.flatnonzero(np.r_[True, parent[1:] != parent[:-1]])
            masks.append(np.bitwise_or.reduceat(np.uint8(1) << (code & np.uint64(3)).astype(np.uint8), starts))
            top = np.maximum.reduceat(top, starts)
            tops.append(top)
            code = parent[starts]
        return cls(height, np.concatenate(masks[::-1]), np.concatenate(tops[::-1]))

    def packed(self) -> tuple[bytes, bytes]:
        """Masks and tops, compressed."""
        above = np.repeat(np.arange(len(self.masks)), BITS[self.masks, 4])
        lacks = np.r_[self.tops[:1], self.tops[above] - self.tops[1:]].astype(np.int32)
        return zstd(self.masks), zstd(lacks)

    @classmethod
    def unpacked(cls, height: int, nodes: int, leaves: int, masks: pa.Buffer, tops: pa.Buffer) -> Treap:
        masks = np.frombuffer(pa.decompress(masks, nodes - leaves, "zstd"), np.uint8)
        tops = np.frombuffer(pa.decompress(tops, 4 * nodes, "zstd"), np.int32).copy()
        start, end = 0, 1  # the nodes of a level
        for _ in range(height):
            bits = BITS[masks[start:end], 4]
            below = slice(end, end + int(bits.sum()))
            tops[below] = np.repeat(tops[start:end], bits) - tops[below]
            start, end = below.start, below.stop
        return cls(height, masks, tops)

    def opened(self) -> Treap:
        """With the place of each node's first child, and one empty node at the end (place -1)."""
        self.first = np.append(1 + np.cumsum(BITS[self.masks, 4]) - BITS[self.masks, 4], 0)
        self.masks, self.tops = np.append(self.masks, np.uint8(0)), np.append(self.tops, np.int32(0))
        return self

    def best(self, rows: np.ndarray, weights: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Columns and scores of the ``k`` highest sums of weight times impact above 0, ties to the smaller column."""
        node, column, level = np.zeros((1, len(rows)), np.int64), np.zeros(1, np.int64), np.zeros(1, np.int64)
        bound = np.array([int(self.tops[0]) * int(weights.sum())])
        found, scores, at_once = np.empty(0, np.int64), np.empty(0, np.int64), AT_ONCE
        while len(bound):
            if len(scores) == k:
                alive = np.flatnonzero((bound > scores[-1]) | ((bound == scores[-1]) & (column < found[-1])))
                node, column, level, bound = node[alive], column[alive], level[alive], bound[alive]
                if not len(bound):
                    break
            split = np.zeros(len(bound), dtype=bool)
            split[np.argpartition(-bound, at_once - 1)[:at_once] if len(bound) > at_once else slice(None)] = True
            at_once *= 2
            parent, below = node[split], self.height - 1 - level[split]
            mask, first = self.masks[parent], self.first[parent]
            upper = ((rows >> below[:, None]) & 1) * 2
            kept = [(node[~split], column[~split], level[~split], bound[~split])]
            for side in (0, 1):
                slot = upper + side
                child = np.where((mask >> slot) & 1, first + BITS[mask, slot], -1)
                top = self.tops[child] @ weights
                some = np.flatnonzero(top)
                kept.append((child[some], (column[split] + (side << below))[some], level[split][some] + 1, top[some]))
            node, column, level, bound = (np.concatenate(parts) for parts in zip(*kept, strict=True))
            leaf = level == self.height
            if leaf.any():
                found, scores = np.append(found, column[leaf]), np.append(scores, bound[leaf])
                order = np.lexsort((found, -scores))[:k]
                found, scores = found[order], scores[order]
                node, column, level, bound = node[~leaf], column[~leaf], level[~leaf], bound[~leaf]
        return found, scores


#: What is stored of a quadtree.
SHAPE = ("height", "nodes", "leaves", "masks", "tops", "ids")
INDEX = "block long, height int, nodes int, leaves int, masks binary, tops binary, ids array<long>, term binary, row int, df long"
ARROW_INDEX = pa.schema([("block", pa.int64()), ("height", pa.int32()), ("nodes", pa.int32()), ("leaves", pa.int32()), ("masks", pa.binary()), ("tops", pa.binary()), ("ids", pa.list_(pa.int64())), ("term", pa.binary()), ("row", pa.int32()), ("df", pa.int64())])


class Block:
    """Collects documents until they are many enough."""

    def __init__(self):
        self.number: defaultdict[bytes, int] = defaultdict()
        self.number.default_factory = self.number.__len__
        self.ids: list[int | None] = []
        self.length: list[int] = []
        self.points: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, ids: list[int | None], texts: list[list[bytes]]) -> None:
        """Texts of one slice of a batch."""
        sizes = [len(t) for t in texts]
        terms = np.fromiter((n for t in texts for n in map(self.number.__getitem__, t)), np.int64, sum(sizes))
        docs = np.repeat(np.arange(len(texts)), sizes)
        point, tf = np.unique(terms * len(texts) + docs, return_counts=True)
        self.points.append((point // len(texts), point % len(texts) + len(self.ids), tf))
        self.ids += ids
        self.length += sizes
        self.size += len(point)

    def rows(self, block: int, n_docs: int, n_terms: int) -> Iterator[pa.RecordBatch]:
        """The block's quadtree as one row, then its terms."""
        term, doc, tf = (np.concatenate(parts) for parts in zip(*self.points, strict=True))
        df = np.bincount(term, minlength=len(self.number))
        row_of, column_of = np.empty(len(df), np.int64), np.empty(len(self.ids), np.int64)
        row_of[np.argsort(-df, kind="stable")] = np.arange(len(df))
        order = sorted(range(len(self.ids)), key=lambda i: (self.ids[i] is None, self.ids[i] or 0, i))
        column_of[order] = np.arange(len(order))
        tree = Treap.of(row_of[term], column_of[doc], impacts(tf, np.array(self.length)[doc], n_docs, n_terms))
        masks, tops = tree.packed()
        grid = {"block": [block], "height": [tree.height], "nodes": [len(tree.tops)], "leaves": [len(term)], "masks": [masks], "tops": [tops], "ids": [[self.ids[i] for i in order]], "term": [None], "row": [None], "df": [None]}
        yield pa.RecordBatch.from_pydict(grid, ARROW_INDEX)
        none = {c: pa.nulls(len(df), ARROW_INDEX.field(c).type) for c in ("height", "nodes", "leaves", "masks", "tops", "ids")}
        terms = {"block": pa.array(np.full(len(df), block)), **none, "term": pa.array(list(self.number), pa.binary()), "row": pa.array(row_of.astype(np.int32)), "df": pa.array(df.astype(np.int64))}
        whole = pa.RecordBatch.from_pydict(terms, ARROW_INDEX)
        yield from (whole.slice(i, 50_000) for i in range(0, whole.num_rows, 50_000))


@dataclass
class Index:
    """A table with a row for each block's quadtree and one for each term of each block; documents that have terms, and terms in all."""

    table: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, scratch: Scratch, postings: int = 1_000_000, doc_id: str = "doc_id", text: str = "text") -> Index:
    """Indexes every term of every document."""
    docs = narrow(docs, doc_id, text)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        n_docs = n_terms = 0
        for batch in slices(batches, text):
            sizes = [len(terms_of(t)) for t in raw(batch, text)]
            n_docs, n_terms = n_docs + sum(map(bool, sizes)), n_terms + sum(sizes)
        yield pa.RecordBatch.from_arrays([pa.array([n_docs]), pa.array([n_terms])], ["n_docs", "n_terms"])

    totals = docs.select(text).mapInArrow(count, "n_docs long, n_terms long")
    n_docs, n_terms = totals.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum("n_terms"), F.lit(0))).first()

    def index(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        part, done, block = TaskContext.get().partitionId(), 0, Block()
        for batch in slices(batches, text):
            held = [(d, t) for d, t in zip(batch.column(doc_id).cast(pa.int64()).to_pylist(), map(terms_of, raw(batch, text)), strict=True) if t]
            if held:
                block.add([d for d, _ in held], [t for _, t in held])
            if block.size >= postings or len(block.ids) >= BLOCK_DOCS:
                yield from block.rows((part << 32) + done, n_docs, n_terms)
                done, block = done + 1, Block()
                release()
        if block.size:
            yield from block.rows((part << 32) + done, n_docs, n_terms)

    return Index(scratch.table(docs.mapInArrow(index, INDEX), "index"), n_docs, n_terms)


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, term): the different terms of each item, as UTF-8."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    terms = items.select(F.col(item_id).alias("item_id"), F.explode(F.regexp_extract_all(lower, F.lit(TERM), F.lit(0))).alias("term"))
    return terms.select("item_id", F.col("term").cast("binary").alias("term")).distinct()


def search(index: Index, items: DataFrame, scratch: Scratch, k: int = 50, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): each item's ``k`` documents with the highest scores above 0, equal scores by id."""
    kind = items.schema[item_id].dataType.simpleString()
    # tables of their own, so that Spark knows their size: a small one is broadcast, a large one is not
    wanted = scratch.table(item_terms(items, item_id, text), "wanted")
    places = index.table.filter("term IS NOT NULL").select("block", "term", "row", "df").join(wanted.select("term").distinct(), "term")
    places = scratch.table(places, "places")
    weights = places.groupBy("term").agg(F.sum("df").alias("df")).select("term", weight(F.col("df"), index.n_docs).alias("weight")).filter("weight > 0")
    paths = wanted.join(weights, "term").join(places.select("term", "block", "row"), "term")
    paths = paths.groupBy("block", "item_id").agg(F.sort_array(F.collect_list(F.struct("row", "weight"))).alias("path"))
    asked = paths.select("block", F.lit(1).alias("kind"), "item_id", F.col("path.row").alias("rows"), F.col("path.weight").alias("weights"))
    grid = index.table.filter("height IS NOT NULL").select("block", *SHAPE)
    n_blocks = grid.select("block").count()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The quadtree of a block comes before its paths."""
        release()
        tree, ids = None, None
        for batch in batches:
            names = batch.column("item_id")
            taken, docs, scores = [], [], []
            for i, kind in enumerate(batch.column("kind").to_pylist()):
                if kind == 0:
                    shape = [batch.column(c)[i] for c in SHAPE]
                    tree, ids = Treap.unpacked(*(x.as_py() for x in shape[:3]), *(x.as_buffer() for x in shape[3:5])).opened(), shape[5].values
                    continue
                rows, weights = (batch.column(c)[i].values.to_numpy().astype(np.int64) for c in ("rows", "weights"))
                columns, score = tree.best(rows, weights, k)
                taken.append(np.full(len(score), i))
                docs.append(ids.take(pa.array(columns)))
                scores.append(score)
            if taken:
                out = [names.take(pa.array(np.concatenate(taken))), pa.concat_arrays(docs), pa.array(np.concatenate(scores))]
                yield pa.RecordBatch.from_arrays(out, ["item_id", "doc_id", "score"])

    empty = {"item_id": kind, "rows": "array<int>", "weights": "array<bigint>", "height": "int", "nodes": "int", "leaves": "int", "masks": "binary", "tops": "binary", "ids": "array<bigint>"}
    columns = ["block", "kind", *empty]
    held = grid.withColumn("kind", F.lit(0)).withColumns({c: F.lit(None).cast(empty[c]) for c in ("item_id", "rows", "weights")})
    asked = asked.withColumns({c: F.lit(None).cast(empty[c]) for c in SHAPE})
    both = held.select(columns).union(asked.select(columns)).repartition(max(1, n_blocks), "block").sortWithinPartitions("block", "kind")
    hits = both.mapInArrow(run, f"item_id {kind}, doc_id long, score long")
    rank = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


SQL = rf"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM documents
), tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL
), sizes AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id
), totals AS (SELECT count(*)::BIGINT AS all_docs, sum(n)::BIGINT AS all_terms FROM sizes
), asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')) AS term FROM benchmark
), df AS (SELECT term, count(*) AS df FROM tf WHERE term IN (SELECT term FROM asked) GROUP BY term
), weights AS (SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS w FROM df, totals
), scores AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tf USING (term) JOIN sizes USING (doc_id), totals GROUP BY item_id, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM scores WHERE score > 0
QUALIFY rank <= 50
"""
