"""Approximate nearest neighbours by a permutation index.

Pivots are vectors of the table itself. Each vector is represented by the order of its ``prefix`` nearest pivots and posted, with the
pivot's rank, in the inverted file of each of them. A query runs through the files of its own pivots; the tally of common pivots and
their ranks is the footrule distance between the two orders, where a pivot outside a prefix counts as ranked just behind it:

    footrule(q, v) = p (p + 1) - 2 * sum over common pivots of (p - max(rank in q, rank in v)),  ranks from 0, prefix p

With prefixes of half the pivots a file names every second row, so a block stores each file as one array of ranks, with ``p`` for the rows
that it does not name; those add nothing.

The nearest ``share`` of the rows by footrule, ties included, are ranked again by the exact inner product.

The rows are dealt into blocks by a hash of their id, each with its own inverted files, and the stated set of queries visits every
block; a task holds one block. Each block gives a query's best ``k``, and the best of those are the answer. The pivots are chosen from
a bounded sample (``sample`` rows with the smallest hash); every row is indexed.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components are neither indexed nor queried; vectors of
another length than the query are no candidates, and those of a length that the sample lacks have no pivots, so they are all compared; rows with the same id count once, with the smallest vector, and a query is not its own
candidate; null ids take no part; a query with fewer candidates than ``k`` gets all; equal scores go to the smaller id; an empty table
gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch


def usable(vectors: DataFrame, vec_id: str, embedding: str) -> DataFrame:
    """(id, vec): one row per id, only vectors that take part."""
    vec = F.col(embedding).cast("array<double>")
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    good = vec.isNotNull() & ~F.exists("vec", bad) & F.exists("vec", lambda x: x != 0)
    return vectors.select(F.col(vec_id).cast("long").alias("id"), vec.alias("vec")).filter(F.col("id").isNotNull() & good).groupBy("id").agg(F.min("vec").alias("vec"))


def choose_pivots(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` different directions of the sample, in its order."""
    unit = sample / np.linalg.norm(sample, axis=1, keepdims=True)
    taken: list[int] = []
    for i in range(len(unit)):
        if not taken or (unit[taken] @ unit[i]).max() < 0.999:
            taken.append(i)
        if len(taken) == n:
            break
    return unit[taken]


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """The nearest pivots of each vector, nearest first; equally near ones by number."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :prefix]


class Block:
    """Inverted files of some rows."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, prefix: int):
        near = orders(vectors, pivots, prefix)
        self.ids, self.vectors, self.prefix = ids, vectors, near.shape[1]
        self.files = np.full((len(pivots), len(ids)), self.prefix, np.uint16)
        self.files[near, np.arange(len(ids))[:, None]] = np.arange(self.prefix, dtype=np.uint16)

    def search(self, query_id: int, query: np.ndarray, near: np.ndarray, k: int, share: float) -> tuple[np.ndarray, np.ndarray]:
        """Ids and scores of the best ``k`` of the block."""
        n, p = len(self.ids), self.prefix
        ranks, total = np.empty(n, np.uint16), np.zeros(n, np.uint32)
        for rank, pivot in enumerate(near):
            total += np.maximum(self.files[pivot], rank, out=ranks)
        footrule = p * (p + 1) - 2 * (p * p - total.astype(np.int64))
        wanted = min(n, max(int(np.ceil(share * n)), k))
        rows = np.flatnonzero(footrule <= np.partition(footrule, wanted - 1)[wanted - 1])
        rows = rows[self.ids[rows] != query_id]
        scores = (self.vectors[rows] * query).sum(axis=1)  # row by row, so that equal vectors have equal scores in any block
        best = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows][best], scores[best]


def search(
    vectors: DataFrame,
    scratch: Scratch,
    is_query: Column,
    k: int = 20,
    n_pivots: int = 128,
    prefix: int = 64,
    share: float = 0.25,
    sample: int = 1024,
    block_rows: int = 8192,
    vec_id: str = "vec_id",
    embedding: str = "embedding",
) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest rows found. ``is_query`` is a condition on the column ``id``."""
    rows = scratch.table(usable(vectors, vec_id, embedding).withColumn("dim", F.size("vec")), "rows")
    blocks = rows.groupBy("dim").agg(F.ceil(F.count("*") / block_rows).cast("int").alias("n_blocks"))
    # one length of vectors is the rule; each has its own pivots and blocks
    sizes = {r["dim"]: r["n_blocks"] for r in blocks.collect()}
    # a sort with a limit: no task sees more than its own rows and ``sample`` of each other's
    chosen: dict[int, list] = {dim: [] for dim in sizes}
    for r in rows.orderBy(F.xxhash64("id"), "id").limit(sample).select("dim", "vec").collect():
        chosen[r["dim"]].append(r["vec"])
    pivots = {dim: choose_pivots(np.array(found).reshape(-1, dim), n_pivots) for dim, found in chosen.items()}
    if not sizes:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    n_blocks = F.lit(1)
    for dim, n in sizes.items():
        n_blocks = F.when(F.col("dim") == dim, n).otherwise(n_blocks)
    placed = rows.select("dim", F.pmod(F.xxhash64("id"), n_blocks).cast("int").alias("block"), F.lit(0).alias("kind"), "id", "vec")
    asked = rows.filter(is_query).select("dim", F.explode(F.sequence(F.lit(0), n_blocks - 1)).alias("block"), F.lit(1).alias("kind"), "id", "vec")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The rows of a block come before its queries."""
        key, ids, vecs, block = None, [], [], None

        for batch in batches:
            if not batch.num_rows:
                continue
            where = np.stack([batch.column(c).to_numpy() for c in ("dim", "block", "kind")], axis=1)
            starts = np.append(np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)]), len(where))
            found = []
            for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                dim, number, kind = where[a].tolist()
                part = batch.slice(a, b - a)
                part_ids = part.column("id").to_numpy()
                part_vecs = part.column("vec").flatten().to_numpy().reshape(len(part_ids), dim)
                if kind == 0:
                    if key != (dim, number):
                        key, ids, vecs, block = (dim, number), [], [], None
                    ids.append(part_ids)
                    vecs.append(part_vecs)
                    continue
                if key != (dim, number):  # no row fell into this block
                    continue
                if block is None:
                    block = Block(np.concatenate(ids), np.concatenate(vecs), pivots[dim], prefix)
                for i, near in enumerate(orders(part_vecs, pivots[dim], prefix)):
                    hit, scores = block.search(int(part_ids[i]), part_vecs[i], near, k, share)
                    found.append((np.full(len(hit), part_ids[i]), hit, scores))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found, strict=True)], ["query_id", "vec_id", "score"])

    keys = ["dim", "block"]
    hits = placed.union(asked).repartition(*keys).sortWithinPartitions(*keys, "kind").mapInArrow(run, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
