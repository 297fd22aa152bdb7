"""Near-duplicate groups by SimHash fingerprints and an inverted index of their bytes.

Each text is lower-cased (A-Z only), cut into words and shingles of words; a fingerprint bit is set where more than half of the
shingles' 64-bit hashes have it. Two fingerprints that differ in at most three bits share at least five of their eight bytes, byte by
byte. Split the eight positions into two halves: one half then holds three shared ones. So fingerprints are posted under their bytes
at each of the eight triples of positions inside a half, and linked ones always meet in some posting list. Within a list the shared
positional bytes of each pair are tallied, pairs with fewer than five are dropped, and the others are verified bit by bit.

Equal fingerprints are one entry of the index, so exact copies cost nothing. Lists are cut into blocks of ``BLOCK`` entries, and a
task compares two blocks at a time; inside one it grows trees of linked entries and compares a grown entry only with those that no
tree has yet, so lists of near copies stay cheap and give at most one edge per entry. Every pair meets in a block, so no link is lost.

Defined cases: null, empty and wordless texts have fingerprint zero, which links like any other; fewer words than a shingle are one
shingle; rows with equal ids are separate rows of one group; a null ``doc_id`` is grouped but is never the smallest one (a group of
only nulls has a null id); an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, narrow, raw, slices
from .graph import components

BYTES, BITS_APART = 8, 3
SHARED = BYTES - BITS_APART
#: The triples of byte positions inside each half: any five positions include one of them.
LISTS = tuple(t for half in ((0, 1, 2, 3), (4, 5, 6, 7)) for t in ((half[:i] + half[i + 1 :]) for i in range(4)))
BLOCK = 4096
SEED = 42


def fingerprint(text: bytes, words: int = 3) -> bytes:
    """Eight bytes, the highest bit first."""
    tokens = text.lower().split()
    if not tokens:
        return bytes(BYTES)
    shingles = map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)) if len(tokens) >= words else [b" ".join(tokens)]
    digest = xxhash.xxh64_digest
    hashes = np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), np.uint8).reshape(-1, BYTES)
    counts = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        counts += np.unpackbits(hashes[i : i + 4096], axis=1).sum(axis=0, dtype=np.int32)
    return np.packbits(2 * counts > len(hashes)).tobytes()


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            fps = np.frombuffer(b"".join([fingerprint(t, words) for t in raw(batch)]), ">i8").astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(fps)], ["doc_id", "fp"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def postings(entries: DataFrame) -> DataFrame:
    """Entries (fp) under their bytes at each triple of positions: (list, key, fp)."""
    byte = lambda p: F.shiftright("fp", 8 * (BYTES - 1 - p)).bitwiseAND(F.lit(255))
    keys = [(byte(p) * 65536 + byte(q) * 256 + byte(r)).cast("int") for p, q, r in LISTS]
    return entries.select("fp", F.posexplode(F.array(*keys)).alias("list", "key"))


def blocks(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Postings of lists with two entries or more, each with every pair of blocks in which it is compared."""
    posted = postings(entries)
    lists = posted.groupBy("list", "key").agg(F.count("*").alias("n")).filter("n > 1")
    lists = scratch.table(lists.withColumn("n_blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n"), "lists")
    met = posted.join(lists, ["list", "key"]).withColumn("own", F.pmod(F.xxhash64("fp"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    return met.select("list", "key", "fp", "own", other.alias("other")).select("list", "key", "fp", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def trees(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links that join all entries of a block that links join: (entry, entry it was reached from)."""
    left, froms, tos = fps, [], []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            apart = left ^ at
            shared = (apart.view(np.uint8).reshape(-1, BYTES) == 0).sum(axis=1)
            near = np.flatnonzero(shared >= SHARED)
            near = near[np.bitwise_count(apart[near]) <= BITS_APART]
            if len(near):
                reached = left[near]
                tos.append(reached)
                froms.append(np.full(len(reached), at, np.uint64))
                queue.extend(reached)
                left = np.delete(left, near)
    none = np.zeros(0, np.uint64)
    return np.concatenate([none, *tos]), np.concatenate([none, *froms])


def links(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """Verified links (a, b) between different fingerprints, enough of them to join all that are linked."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of their block; one that a batch cuts is carried over."""
        held_keys, held = np.zeros((0, 4), np.int32), np.zeros(0, np.uint64)

        def found(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            starts = np.flatnonzero(np.r_[True, (keys[1:] != keys[:-1]).any(axis=1)]) if len(keys) else np.zeros(0, int)
            ends = np.r_[starts[1:], len(keys)]
            pairs = [trees(fps[s:e]) for s, e in zip(starts.tolist(), ends.tolist(), strict=True) if e - s > 1] if len(starts) else []
            a, b = (np.concatenate([np.zeros(0, np.uint64), *(p[k] for p in pairs)]).view(np.int64) for k in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy() for c in ("list", "key", "i", "j")], axis=1)
            keys = np.concatenate([held_keys, keys])
            fps = np.concatenate([held, batch.column("fp").to_numpy().view(np.uint64)])
            if not len(keys):
                continue
            cut = int(np.flatnonzero((keys != keys[-1]).any(axis=1))[-1]) + 1 if (keys != keys[-1]).any() else 0
            held_keys, held = keys[cut:], fps[cut:]
            yield found(keys[:cut], fps[:cut])
        yield found(held_keys, held)

    keys = ["list", "key", "i", "j"]
    return blocks(entries, scratch).repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, scratch: Scratch, words: int = 3) -> DataFrame:
    """One row per document: (doc_id, fp, component_id), the smallest ``doc_id`` that links reach."""
    marked = scratch.table(fingerprints(docs, words), "marked")
    entries = scratch.table(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "entries")
    rooted = entries.join(roots(entries, scratch), "fp")
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    groups = scratch.table(rooted.join(least, "root").select("fp", "component_id"), "groups")
    scratch.drop("links", "lists")
    return marked.join(groups, "fp").select("doc_id", "fp", "component_id")


def roots(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(fp, root) of different fingerprints: one root for all that links join."""
    found = components(scratch.table(links(entries.select("fp"), scratch), "links"), scratch).withColumnRenamed("node", "fp")
    return entries.select("fp").join(found, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def keep_one(docs: DataFrame, scratch: Scratch, words: int = 3) -> DataFrame:
    """The documents, with all their columns, of which each group keeps the one with the smallest id.

    Rows with equal ids count as one document, of which the first by text stays; rows without an id are no group's and stay.
    """
    return keep_first(docs, near_duplicates(docs.filter("doc_id is not null"), scratch, words))


def keep_first(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """The documents that are the first of their group (doc_id, component_id), and those without an id."""
    first = groups.filter("doc_id = component_id").select("doc_id").distinct()
    again = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    kept = docs.join(first, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("row"), again.alias("place")).filter("place = 1")
    return kept.select("row.*").unionByName(docs.filter("doc_id is null"))
