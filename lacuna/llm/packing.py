"""Hierarchical multi-length packing of documents into training sequences.

Every document is encoded, an end id is appended, and its ids are cut into pieces. Full windows of the longest context size are
sequences of their own. What remains of a document is routed to the tier of the smallest context size that holds it. Tiers are
packed from the longest to the shortest: each remainder opens a sequence of its tier, and the gap behind it is filled with the
longest fitting remainders of the shorter tiers, then by cutting one to size. So every sequence is exactly as long as its tier
(a power of two), but for one at the end of each task. Sequences of a tier are dealt to step groups of equal token count, in
serpentine order of their attention cost, so that the steps of a pool cost about the same.

It is one pass over the scan's own partitions: nothing is shuffled, and a task holds one pool of ``pool_tokens`` ids at a time.

Defined cases: null or empty text is a document of just the end id; a null ``doc_id`` stays null; repeated rows are documents of
their own; an empty table gives no rows; other columns of the input are ignored. A very long document is cut into many windows.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, slices, texts
from .encoding import encoder

TIERS = (256, 512, 1024, 2048)
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs the pieces of one task, pool by pool. A remainder is (length, number, start), with its document by number."""

    def __init__(self, tiers: Iterable[int], first_id: int, step_sequences: int):
        self.tiers = sorted(tiers)
        self.window = self.tiers[-1]
        self.next_sequence = self.next_group = first_id
        self.step_tokens = step_sequences * self.window
        self.docs: dict[int, tuple[int | None, bytes]] = {}
        self.number = 0
        self.full: list[tuple[int, list]] = []
        self.waiting: dict[int, list] = {t: [] for t in self.tiers}

    def add(self, doc_id: int | None, ids: bytes) -> None:
        n, start = len(ids) // 4, 0
        self.number += 1
        self.docs[self.number] = (doc_id, ids)
        while n - start >= self.window:
            self.full.append((self.window, [(self.window, self.number, start)]))
            start += self.window
        if start < n:
            self.wait((n - start, self.number, start))

    def wait(self, rest: tuple[int, int, int]) -> None:
        insort(self.waiting[next(t for t in self.tiers if t >= rest[0])], rest)

    def fill(self, tier: int, gap: int) -> list:
        """The longest remainders of this tier and the shorter ones that fit into the gap, then one cut to its size."""
        taken = []
        for t in [t for t in reversed(self.tiers) if t <= tier]:
            rests = self.waiting[t]
            while gap and rests and (i := bisect_right(rests, (gap, self.number + 1, 0))):
                taken.append(rests.pop(i - 1))
                gap -= taken[-1][0]
        if gap:
            rests = next((self.waiting[t] for t in self.tiers if self.waiting[t]), None)
            if rests:  # all are longer than the gap
                n, number, start = rests.pop()
                taken.append((gap, number, start))
                self.wait((n - gap, number, start + gap))
        return taken

    def pack(self, last: bool) -> list[tuple[int, list]]:
        """Sequences of all that waits; what can't fill a sequence waits for the next pool, or is the last, padded one."""
        for tier in reversed(self.tiers):
            rests = self.waiting[tier]
            while rests:
                held = sum(r[0] for t in self.tiers for r in self.waiting[t]) if len(rests) < 8 else tier
                if held < tier:  # too little for this tier: shorter ones take it
                    break
                self.full.append((tier, [first := rests.pop(), *self.fill(tier, tier - first[0])]))
        if last:
            rest = [r for t in reversed(self.tiers) for r in self.waiting[t]]
            while rest:  # fewer ids than two windows: whole tiers first, then one padded sequence
                held = sum(r[0] for r in rest)
                tier = next((t for t in reversed(self.tiers) if t <= held), self.window)
                pieces, room = [], tier
                while rest and room:
                    n, number, start = rest.pop(0)
                    pieces.append((min(n, room), number, start))
                    if n > room:
                        rest.insert(0, (n - room, number, start + room))
                    room -= min(n, room)
                self.full.append((tier, pieces))
            self.waiting = {t: [] for t in self.tiers}
        done, self.full = self.full, []
        return done

    def rows(self, last: bool = False) -> Iterator[tuple]:
        by_tier: dict[int, list] = {}
        for tier, pieces in self.pack(last):
            by_tier.setdefault(tier, []).append(pieces)
        for tier, sequences in sorted(by_tier.items()):
            sequences.sort(key=lambda pieces: -sum(p[0] ** 2 for p in pieces))
            groups = -(-len(sequences) * tier // self.step_tokens)
            for i, pieces in enumerate(sequences):
                turn, at = divmod(i, groups)
                group = self.next_group + (groups - 1 - at if turn % 2 else at)
                offset = 0
                for n, number, start in pieces:
                    doc_id, ids = self.docs[number]
                    yield doc_id, start, n, ids[4 * start : 4 * (start + n)], len(ids) // 4, self.next_sequence, offset, tier, group
                    offset += n
                self.next_sequence += 1
            self.next_group += groups
        kept = {r[1] for rests in self.waiting.values() for r in rests}
        self.docs = {k: v for k, v in self.docs.items() if k in kept}


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 1,
    tiers: Iterable[int] = TIERS,
    pool_tokens: int = 1 << 20,
    step_sequences: int = 16,
) -> DataFrame:
    """One row per piece: its document, place in it, ids (little-endian unsigned 32 bit), sequence, tier and step group.

    ``tokenizer`` is the path of a ``tokenizers`` file on every machine. ``tiers`` are context sizes, each twice the last one.
    ``step_group`` numbers batches of about ``step_sequences`` longest windows' worth of ids, each of one tier.
    """
    tiers = tuple(sorted(tiers))
    if any(t & (t - 1) for t in tiers):
        raise ValueError("context sizes must be powers of two")
    end = end_id.to_bytes(4, "little")

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer).encode
        packer = Packer(tiers, TaskContext.get().partitionId() << 36, step_sequences)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]

        def out(last: bool = False) -> Iterator[pa.RecordBatch]:
            if rows := list(packer.rows(last)):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        held = 0
        for batch in slices(batches):
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                packer.add(doc_id, ids := encode(text) + end)
                held += len(ids) // 4
                if held >= pool_tokens:
                    yield from out()
                    held = 0
        yield from out(last=True)

    return narrow(docs, "doc_id", "text").mapInArrow(pack, SCHEMA)


def digests(pieces: DataFrame) -> DataFrame:
    """The pieces with a checksum in place of their ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group"
    )
