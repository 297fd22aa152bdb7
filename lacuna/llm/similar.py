"""Near-duplicate groups by the similarity of word shingles: SimHash fingerprints and MinHash bands give candidates, whole shingle sets verify them.

Operator 6 comes first: fingerprints of the same shingles, linked by its inverted index of byte positions with the count filter, make groups, and each group is a
list of candidates. Two texts of similarity 0.8 differ in ten of 64 bits on average, so byte positions guarantee no shared one; for those that
fingerprints can't link, bands add lists. A list that a group of fingerprints already is, is not compared again. The pipeline uses it; ``simhash`` keeps to three bits.

Each text is lower-cased (A-Z only) and cut into words; its set has the 64-bit hashes of its shingles of five words. Two texts are linked
if the Jaccard similarity of their sets is 0.8 or more. Other candidates share all ``ROWS`` minima of one of ``BANDS`` bands: a pair of similarity
0.8 is missed with a chance of 3 in 100,000, a more similar one less often. Every candidate is then compared by its whole set.

Equal sets are one entry, so exact copies cost nothing, and bands that hold the same entries are compared once. Bands with many shingles
are cut into blocks, and a task compares two blocks at a time; inside one it grows trees of linked entries, as ``simhash`` does.

Defined cases: null, empty and wordless texts have the empty set, which equals itself only; fewer words than a shingle are one shingle;
rows with equal ids are separate rows of one group; rows without an id are left out; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, narrow, raw, release, slices
from .graph import components
from .simhash import BYTES, SEED, fingerprint, keep_first, roots

BANDS, ROWS = 20, 4
#: Shingles that one block of a band holds on average.
BLOCK = 1 << 18
DRAWS = np.random.default_rng(SEED).integers(1, 2**63, (2, BANDS * ROWS), np.uint64) * np.uint64(2) + np.uint64(1)


def mixed(h: np.ndarray) -> np.ndarray:
    """Bits of 64-bit numbers stirred, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The different hashes of the shingles, in order."""
    tokens = text.lower().split()
    if not tokens:
        return np.zeros(0, np.uint64)
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(t, SEED) for t in tokens]), ">u8").astype(np.uint64)
    n = max(1, len(hashes) - words + 1)
    out = np.full(n, min(len(hashes), words), np.uint64)
    for i in range(min(words, len(hashes))):
        out = mixed(out + hashes[i : i + n])
    return np.unique(out)


def bands(own: np.ndarray) -> np.ndarray:
    """One key for each band of minima."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 2048):
        least = np.minimum(least, ((own[i : i + 2048] ^ DRAWS[1][:, None]) * DRAWS[0][:, None]).min(axis=1))
    keys = np.zeros(BANDS, np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mixed(keys + column)
    return keys


def name_of(own: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes(), SEED)).astype(np.int64))


def marks(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, own, n, fp, keys): the name and size of each row's set, its fingerprint and its bands. Equal sets are one entry, whichever row's fingerprint it has."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            texts = list(raw(batch))
            sets = [shingles(t, words) for t in texts]
            fps = np.frombuffer(b"".join([fingerprint(t, words) for t in texts]), f">i{BYTES}").astype(np.int64)
            keys = pa.array([bands(s).view(np.int64) if len(s) else [] for s in sets], pa.list_(pa.int64()))
            columns = [batch.column("doc_id").cast(pa.int64()), pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), keys]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "own", "n", "fp", "keys"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, own long, n long, fp long, keys array<long>")


def whole_sets(docs: DataFrame, words: int) -> DataFrame:
    """(own, hashes): the sets of the rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            sets = [shingles(t, words) for t in raw(batch)]
            yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array([s.tobytes() for s in sets], pa.binary())], ["own", "hashes"])

    return narrow(docs, "text").mapInArrow(run, "own long, hashes binary")


def trees(names: list[int], sets: list[np.ndarray], percent: int) -> Iterator[tuple[int, int]]:
    """Links that join all entries of a block that links join."""
    left = np.arange(len(sets))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            start = queue.pop()
            at = sets[start]
            sizes = np.array([len(sets[k]) for k in left])
            flat = np.concatenate([sets[k] for k in left])
            found = at[np.minimum(np.searchsorted(at, flat), len(at) - 1)] == flat
            both = np.add.reduceat(found.astype(np.int64), np.r_[0, np.cumsum(sizes)[:-1]])
            near = 100 * both >= percent * (sizes + len(at) - both)
            yield from ((names[k], names[start]) for k in left[near])
            queue.extend(left[near])
            left = left[~near]


def candidates(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(own, first, n, band, key): the lists in which entries meet. Band 0 has the groups of linked fingerprints, the others MinHash; empty sets are in none."""
    held = entries.filter("n > 0")
    groups = scratch.table(roots(held.select("fp").distinct(), scratch), "fingerprints")
    by_fingerprint = held.join(groups, "fp").select("own", "first", "n", F.lit(0).alias("band"), F.col("root").alias("key"))
    by_band = held.select("own", "first", "n", F.posexplode("keys").alias("band", "key")).withColumn("band", F.col("band") + 1)
    scratch.drop("links", "lists")
    return by_fingerprint.unionByName(by_band)


def links(entries: DataFrame, docs: DataFrame, scratch: Scratch, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) between different sets, enough of them to join all that are linked."""
    posted = candidates(entries, scratch)
    lists = posted.groupBy("band", "key").agg(F.count("*").alias("held"), F.bit_xor("own").alias("x"), F.min("own").alias("low"), F.max("own").alias("high"), F.sum("n").alias("size")).filter("held > 1")
    lists = lists.groupBy("held", "x", "low", "high", "size").agg(F.min(F.struct("band", "key")).alias("at"))
    lists = scratch.table(lists.select("at.band", "at.key", F.ceil(F.col("size") / BLOCK).cast("int").alias("n_blocks")), "lists")
    met = scratch.table(posted.join(lists, ["band", "key"]), "met")
    wanted = met.select(F.col("first").alias("doc_id")).distinct()
    sets = whole_sets(docs.join(wanted, "doc_id", "left_semi"), words)
    sets = scratch.table(sets.groupBy("own").agg(F.first("hashes").alias("hashes")), "sets")
    block = F.pmod(F.xxhash64("own"), F.col("n_blocks")).cast("int")
    placed = met.withColumn("block", block).select("band", "key", "own", "block", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("other"))
    placed = placed.select("band", "key", "own", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their block."""
        rows = ((r[:4], r[4], r[5]) for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("band", "key", "i", "j", "own", "hashes")), strict=True))
        for _, members in groupby(rows, lambda r: r[0]):
            held = [(own, np.frombuffer(h, np.uint64)) for _, own, h in members]
            if len(held) > 1:
                pairs = list(trees([own for own, _ in held], [s for _, s in held], percent))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    order = ["band", "key", "i", "j"]
    return placed.join(sets, "own").repartition(*order).sortWithinPartitions(*order).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per document with an id: (doc_id, own, component_id), the smallest ``doc_id`` that links reach."""
    docs = docs.filter("doc_id is not null")
    marked = scratch.table(marks(docs, words), "marked")
    entries = marked.groupBy("own").agg(F.min("doc_id").alias("first"), F.first("n").alias("n"), F.min("fp").alias("fp"), F.first("keys").alias("keys"))
    entries = scratch.table(entries, "entries")
    roots = components(scratch.table(links(entries, docs, scratch, words, percent), "links"), scratch).withColumnRenamed("node", "own")
    rooted = entries.select("own", "first").join(roots, "own", "left").withColumn("root", F.coalesce("root", "own"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = scratch.table(rooted.join(least, "root").select("own", "component_id"), "groups")
    scratch.drop("links", "lists", "met", "sets", "entries", "fingerprints")
    return marked.join(groups, "own").select("doc_id", "own", "component_id")


def keep_one(docs: DataFrame, scratch: Scratch, words: int = 5, percent: int = 80) -> DataFrame:
    """The documents, with all their columns, of which each group keeps the one with the smallest id; as ``simhash.keep_one``."""
    return keep_first(docs, near_duplicates(docs, scratch, words, percent))
