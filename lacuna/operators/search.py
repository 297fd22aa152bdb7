"""Best partners of rows among many others, exactly, in blocks that are skipped when they are too far: no pair is ever a row.

Rows are dealt to the nearest of a bounded number of centres (rows of a bounded sample, far from each other), and within a centre into rings by their
distance to it; a ring that is too large is dealt out by a hash of the id. So a block is known by its centre and the least and largest distance to it, and for any
query the triangle inequality bounds how near the block's rows can be:

    distance(query, row) >= max(distance(query, centre) - largest, least - distance(query, centre))

In the first phase a query meets the block of its own centre and ring, which gives it ``k`` partners that are probably near. In the second it visits only blocks that
can hold a nearer one than the last of these. A task holds one block of rows; queries stream by and are scored by matrix products. If vectors have no structure all
blocks are visited, as an exact search then must.

Cosines are searched as distances of unit vectors. A zero vector has cosine 0 to everything: zero rows are a centre of their own that is never skipped, and zero queries skip nothing.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.scratch import written

#: Rows of a block on average, centres at most, rows that centres are chosen from, and steps of distance by which rings are cut.
BLOCK, CENTRES, SAMPLE, STEPS = 4096, 1024, 8192, 256
#: What rounding can do to a distance, at most.
SLACK = 1e-6
#: The centre of zero rows.
ZERO = -1


def dense(column: pa.Array) -> np.ndarray:
    """A table of vectors of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def pointed(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Points whose distances are in the order of the metric."""
    if metric != "cosine":
        return vectors
    size = np.linalg.norm(vectors, axis=1, keepdims=True)
    return np.divide(vectors, size, out=np.zeros_like(vectors), where=size > 0)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(0, np.square(a).sum(1)[:, None] + np.square(b).sum(1) - 2 * a @ b.T))


def scores(a: np.ndarray, b: np.ndarray, metric: str) -> np.ndarray:
    """The larger the nearer. Cosines are 0 if a side is zero; distances are negative."""
    if metric == "cosine":
        size = np.outer(np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1))
        return np.round(np.divide(a @ b.T, size, out=np.zeros_like(size), where=size > 0), 12)
    return -np.stack([np.sqrt(np.square(b - row).sum(axis=1)) for row in a])  # differences, so that equal rows are at 0


def best_of(s: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` highest scores, ties by name."""
    known = np.flatnonzero(s > -np.inf)
    if len(known) > k:
        known = known[s[known] >= np.partition(s[known], len(known) - k)[len(known) - k]]
    return known[np.lexsort((names[known], -s[known]))[:k]]


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """``n`` points, each the farthest from those before it; fewer if no others are left."""
    chosen, gap = [0], np.full(len(points), np.inf)
    while len(chosen) < n:
        gap = np.minimum(gap, np.square(points - points[chosen[-1]]).sum(1))
        if gap.max() <= SLACK:
            break
        chosen.append(int(gap.argmax()))
    return points[chosen]


class Blocks:
    """The rows in blocks: a table of rows, one of rings (keys, centre, base, parts, least, largest), and the centres."""

    def __init__(self, rows: DataFrame, metric: str, keys: Sequence[str], block: int, n_centres: int | None):
        self.metric, self.keys = metric, list(keys)
        n = rows.count()
        sample = rows.orderBy(F.xxhash64("id", *keys), "id").limit(SAMPLE).select("vec").toArrow()
        points = pointed(dense(sample.column("vec").combine_chunks()), metric)
        if metric == "cosine":
            points = points[np.square(points).sum(1) > 0]
        wanted = n_centres or min(CENTRES, max(1, n // block))
        self.centres = far_apart(points, wanted) if len(points) else np.zeros((1, points.shape[1]))
        placed = written(self.nearest(rows), "search-placed")
        longest = placed.agg(F.max("r")).first()[0] or 1.0
        level = F.least(F.floor(F.col("r") / longest * STEPS), F.lit(STEPS)).cast("int")
        by = [*self.keys, "centre"]
        counted = placed.withColumn("level", level).groupBy(*by, "level").agg(F.count("*").alias("n"), F.min("r").alias("least"), F.max("r").alias("largest"))
        before = F.sum("n").over(Window.partitionBy(*by).orderBy("level")) - F.col("n")
        levels = written(counted.withColumn("ring", F.floor(before / block)).withColumn("parts", F.ceil(F.col("n") / block).cast("int")), "search-levels")
        rings = levels.groupBy(*by, "ring").agg(F.min("least").alias("least"), F.max("largest").alias("largest"), F.max("parts").alias("parts"))
        self.rings = written(rings.withColumn("base", F.monotonically_increasing_id()), "search-rings")
        at = levels.select(*by, "level", "ring").join(self.rings.select(*by, "ring", "base", "parts"), [*by, "ring"])
        joined = placed.withColumn("level", level).join(at, [*by, "level"])
        self.rows = joined.withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).drop("centre", "r", "level", "ring", "parts")
        self.reach = {r["centre"]: r["r"] for r in placed.groupBy("centre").agg(F.max("r").alias("r")).collect()}  # at most one row a centre

    def nearest(self, df: DataFrame) -> DataFrame:
        """Adds the nearest centre and the distance to it."""
        centres, metric, schema = self.centres, self.metric, f"{', '.join(f'{c} {t}' for c, t in df.dtypes)}, centre int, r double"

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = pointed(dense(batch.column("vec")), metric)
                gaps = distances(points, centres)
                centre, r = gaps.argmin(1).astype(np.int32), gaps.min(1)
                if metric == "cosine":
                    zero = ~points.any(axis=1)
                    centre[zero], r[zero] = ZERO, 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(centre), pa.array(r)], [*batch.schema.names, "centre", "r"])

        return df.mapInArrow(run, schema)

    def homes(self, queries: DataFrame) -> DataFrame:
        """(keys, id, base, part) of the block of each query's own centre and ring, if there is one."""
        gap = F.greatest(F.col("r") - F.col("largest"), F.col("least") - F.col("r"), F.lit(0.0))
        near = self.nearest(queries).select(*self.keys, "id", "centre", "r").join(self.rings, [*self.keys, "centre"])
        own = near.groupBy(*self.keys, "id").agg(F.min_by(F.struct("base", "parts"), F.struct(gap.alias("gap"), "base")).alias("to"))
        return own.select(*self.keys, "id", "to.base", F.pmod(F.xxhash64("id"), F.col("to.parts")).cast("int").alias("part"))

    def visits(self, queries: DataFrame) -> DataFrame:
        """(keys, id, base, part) of the blocks that can hold rows at a distance of ``limit`` or less of each query (keys, id, vec, limit)."""
        centres, metric, reach, keys = self.centres, self.metric, self.reach, self.keys
        types = dict(queries.dtypes)
        farthest = np.array([reach.get(c, -np.inf) for c in range(len(centres))])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                points = pointed(dense(batch.column("vec")), metric)
                gaps, limits = distances(points, centres), batch.column("limit").to_numpy()
                if metric == "cosine":
                    limits = np.where(points.any(axis=1), limits, np.inf)
                row, centre = np.nonzero((gaps - farthest <= limits[:, None] + SLACK) & (farthest > -np.inf))
                r = gaps[row, centre]
                if ZERO in reach:
                    every = np.arange(len(points))
                    row, centre, r = np.append(row, every), np.append(centre, np.full(len(points), ZERO)), np.append(r, np.zeros(len(points)))
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in (*keys, "id")), pa.array(limits[row]), pa.array(centre.astype(np.int32)), pa.array(r)], [*keys, "id", "limit", "centre", "r"])

        schema = ", ".join([*(f"{c} {types[c]}" for c in (*self.keys, "id")), "limit double", "centre int", "r double"])
        near = queries.select(*self.keys, "id", "vec", "limit").mapInArrow(run, schema).join(self.rings, [*self.keys, "centre"])
        bound = F.greatest(F.col("r") - F.col("largest"), F.col("least") - F.col("r"))
        open_to = near.filter((F.col("centre") == ZERO) | (bound <= F.col("limit") + SLACK))
        return open_to.select(*self.keys, "id", "base", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))

    def meet(self, queries: DataFrame, k: int, other_group: bool, itself: bool) -> DataFrame:
        """(keys, source, target, score): the best ``k`` of each block for the queries sent there (with base and part)."""
        metric, keys = self.metric, self.keys
        types = dict(queries.dtypes)
        columns = [*keys, "id", "vec", *(["group"] if other_group else [])]

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            block, held, rows = None, [], None
            for batch in batches:
                if not batch.num_rows:
                    continue
                where = np.stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("base", "part", "asks")], axis=1)
                cuts = np.append(np.flatnonzero(np.r_[True, (where[1:] != where[:-1]).any(axis=1)]), len(where))
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                    if (place := tuple(where[a, :2])) != block:
                        block, held, rows = place, [], None
                    if not where[a, 2]:
                        held.append(batch.slice(a, b - a))
                        continue
                    if not held:
                        continue
                    if rows is None:
                        whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
                        rows = whole.column("id").to_numpy(), dense(whole.column("vec")), group_of(whole)
                    for start in range(a, b, 1024):
                        part = batch.slice(start, min(1024, b - start))
                        asks, s = part.column("id").to_numpy(), scores(dense(part.column("vec")), rows[1], metric)
                        if not itself:
                            s[asks[:, None] == rows[0]] = -np.inf
                        if other_group:
                            s[group_of(part)[:, None] == rows[2]] = -np.inf
                        best = [best_of(line, rows[0], k) for line in s]
                        row, at = np.repeat(np.arange(len(asks)), [len(x) for x in best]), np.concatenate(best)
                        out = [*(part.column(c).take(pa.array(row)) for c in keys), pa.array(asks[row]), pa.array(rows[0][at]), pa.array(s[row, at])]
                        yield pa.RecordBatch.from_arrays(out, [*keys, "source", "target", "score"])

        def group_of(batch: pa.RecordBatch) -> np.ndarray | None:
            return np.array(batch.column("group").to_pylist(), dtype=object) if other_group else None

        both = self.rows.withColumn("asks", F.lit(False)).select(*columns, "base", "part", "asks")
        both = both.unionByName(queries.withColumn("asks", F.lit(True)).select(*columns, "base", "part", "asks"))
        schema = ", ".join([*(f"{c} {types[c]}" for c in keys), "source long", "target long", "score double"])
        return both.repartition("base", "part").sortWithinPartitions("base", "part", "asks").mapInArrow(run, schema)


def ranked(hits: DataFrame, k: int, keys: Sequence[str]) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys, "source").orderBy(F.col("score").desc(), "target"))
    return hits.withColumn("rank", rank).filter(F.col("rank") <= k)


def phases(
    queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", keys: Sequence[str] = (), other_group: bool = False, itself: bool = False, block: int = BLOCK, n_centres: int | None = None
) -> tuple[DataFrame, DataFrame, Blocks]:
    """(what queries find, the visits (keys, id, base, part) of the second phase, the blocks)."""
    columns = [*keys, "id", "vec", *(["group"] if other_group else [])]
    ready = lambda df: df.filter(F.col("vec").isNotNull() & F.col("id").isNotNull()).withColumn("vec", F.col("vec").cast("array<double>")).withColumn("id", F.col("id").cast("long")).select(*columns)
    asked = written(ready(queries), "search-queries")
    blocks = Blocks(written(ready(rows), "search-rows"), metric, keys, block, n_centres)
    by = [*keys, "id"]
    homes = written(blocks.homes(asked), "search-homes")
    first = written(blocks.meet(asked.join(homes, by), k, other_group, itself), "search-first")
    kth = ranked(first, k, keys).filter(F.col("rank") == k)
    limit = F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("score"))) if metric == "cosine" else -F.col("score")
    limits = kth.select(*keys, F.col("source").alias("id"), limit.alias("limit"))
    asked = asked.join(limits, by, "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    visits = written(blocks.visits(asked).join(homes, [*by, "base", "part"], "left_anti"), "search-visits")
    second = blocks.meet(asked.join(visits, by), k, other_group, itself)
    return first.unionByName(second), visits, blocks


def top_k(
    queries: DataFrame, rows: DataFrame, k: int, metric: str = "cosine", keys: Sequence[str] = (), other_group: bool = False, itself: bool = False, block: int = BLOCK, n_centres: int | None = None
) -> DataFrame:
    """(keys, source, target, score, rank) of the ``k`` best rows for each query of the same keys, itself excluded unless ``itself``.

    Both sides have the keys, an integer ``id``, unique for its keys, and ``vec``, all of one length. With ``other_group`` both have ``group`` too and partners are of another one.
    Ties go to the smaller id. Null vectors take no part.
    """
    return ranked(phases(queries, rows, k, metric, keys, other_group, itself, block, n_centres)[0], k, keys)
