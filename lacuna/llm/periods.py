"""Runs of a repeated stretch of words inside a text, found by minimizers of several scales.

A run is a stretch of words with smallest period ``q``, ``powers`` periods or more and ``least`` words or more, that cannot be made longer.

Periods under ``SHORT`` words are found by direct scans: for each such lag, the stretches of words that equal the word one lag on.
Longer ones have a scale each, ``w <= q < 2 w`` with ``w`` a power of two. The scale's minimizers are the places of the smallest word hash in
each window of ``w`` words, the leftmost on ties; its keys are hashes of the ``2 w`` words from there. Inside a run windows a period apart have
equal words, so their minimizers are a period apart and have equal keys, and no place between them has that key: strings of ``q`` words
or more inside a run with smallest period ``q`` are equal only at multiples of ``q``. As a run has four periods or more, its first window gives such a pair. So
neighbouring places of equal keys with a lag inside the scale are all the seeds that are needed. A seed is extended word by word to both sides
(words are compared, not hashes), and a lag that has a smaller period inside is dropped. Seeds inside a stretch that is known are skipped. A
stretch costs its length, and one that isn't a run is shorter than three lags, so the work is in proportion to the words of each scale.

Texts are worked on as numbers, many short ones at a time with a different number between them. Key hashes have 64 bits: a run could be missed only
if two different strings of one slice had equal ones.

Defined cases: null, empty and wordless texts have no runs and collapse to the empty text; a very long text is one task's work, with a few
arrays of 8 bytes a word; rows with equal ids are worked on each for itself; a null ``doc_id`` stays null; an empty table gives no rows;
other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, raw, release, slices

#: Periods under this many words are scanned for directly; it is the window of the first scale.
SHORT = 8
#: Odd multipliers of the hashes.
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))

Run = tuple[int, int, int]
RUN_TYPE = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


def mixed(a: np.ndarray) -> np.ndarray:
    a = (a ^ (a >> np.uint64(32))) * MIX[0]
    a = (a ^ (a >> np.uint64(29))) * MIX[1]
    return a ^ (a >> np.uint64(32))


def stretches(x: np.ndarray, lag: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the longest stretches of places whose word equals the word ``lag`` later."""
    at = np.flatnonzero(x[lag:] == x[:-lag])
    if not len(at):
        return at, at
    cut = np.flatnonzero(np.diff(at) > 1)
    return at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]] + 1


def extended(x: np.ndarray, lag: int, start: int, end: int) -> tuple[int, int]:
    """The longest stretch around [start, end) of places whose word equals the word ``lag`` later."""
    step = 32
    while end < len(x) - lag:
        n = min(step, len(x) - lag - end)
        same = x[end : end + n] == x[end + lag : end + lag + n]
        if not same.all():
            end += int(same.argmin())
            break
        end, step = end + n, 2 * step
    step = 32
    while start > 0:
        n = min(step, start)
        same = (x[start - n : start] == x[start - n + lag : start + lag])[::-1]
        if not same.all():
            start -= int(same.argmin())
            break
        start, step = start - n, 2 * step
    return start, end


def primes(n: int) -> list[int]:
    """The different prime divisors."""
    out, p = [], 2
    while p * p <= n:
        if n % p == 0:
            out.append(p)
            while n % p == 0:
                n //= p
        p += 1
    return [*out, n] if n > 1 else out


def is_smallest(x: np.ndarray, start: int, period: int) -> bool:
    """Whether a stretch of at least two periods from ``start`` has no smaller period, which would divide this one."""
    block = x[start : start + period]
    return not any((block[: period - period // p] == block[period // p :]).all() for p in primes(period))


def seeds(x: np.ndarray, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each scale (window, places, lags): neighbouring minimizers with equal keys, a lag of one to two windows apart."""
    first = mixed(x.astype(np.uint64) + MIX[1])
    least = (first >> np.uint64(32) << np.uint64(32)) | np.arange(len(x), dtype=np.uint64)
    key, width = first, 1  # smallest values of windows, and hashes of strings, of ``width`` words
    while 4 * width <= longest:
        longer = mixed(key[: len(key) - width] * MIX[0] + key[width:])
        if width >= SHORT:
            at = (least & np.uint64(0xFFFFFFFF)).astype(np.int64)
            at = at[np.r_[True, at[1:] != at[:-1]]]
            at = at[at < len(longer)]
            order = at[np.argsort(longer[at], kind="stable")]
            lag = order[1:] - order[:-1]
            near = np.flatnonzero((longer[order[1:]] == longer[order[:-1]]) & (lag >= width) & (lag < 2 * width))
            yield width, order[near], lag[near]
        least = np.minimum(least[: len(least) - width], least[width:])
        key, width = longer, 2 * width


def find_runs(x: np.ndarray, longest: int, powers: int = 4, least: int = 6) -> list[Run]:
    """All runs (start, length, period) of the numbers ``x``, whose texts have ``longest`` words at most."""
    found: list[Run] = []
    for lag in range(1, min(SHORT - 1, longest // powers) + 1):
        starts, ends = stretches(x, lag)
        long = np.flatnonzero(ends - starts >= max(least, powers * lag) - lag)
        found += [(a, b - a + lag, lag) for a, b in zip(starts[long].tolist(), ends[long].tolist(), strict=True) if is_smallest(x, a, lag)]
    for _, places, lags in seeds(x, longest):
        known: dict[int, int] = {}
        for i in np.lexsort((places, lags)).tolist():
            place, lag = int(places[i]), int(lags[i])
            if place < known.get(lag, 0):
                continue
            start, end = extended(x, lag, place, place)
            known[lag] = end
            if end - start >= max(least, powers * lag) - lag and is_smallest(x, start, lag):
                found.append((start, end - start + lag, lag))
    return sorted(found, key=lambda r: (r[0], r[2]))


def runs_of(texts: list[list[bytes]], powers: int = 4, least: int = 6) -> list[list[Run]]:
    """The runs of each text, given by its words."""
    number: defaultdict[bytes, int] = defaultdict()
    number.default_factory = number.__len__
    sizes = np.array([len(words) for words in texts], dtype=np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    x = np.empty(starts[-1], dtype=np.int64)
    for i, words in enumerate(texts):
        x[starts[i] : starts[i] + len(words)] = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        x[starts[i + 1] - 1] = -1 - i  # equals nothing else
    out: list[list[Run]] = [[] for _ in texts]
    if len(texts):
        found = find_runs(x, int(sizes.max()), powers, least)
        owner = np.searchsorted(starts, [r[0] for r in found], "right") - 1
        for i, (start, length, period) in zip(owner.tolist(), found, strict=True):
            out[i].append((start - int(starts[i]), length, period))
    return out


def collapsed(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words without those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), dtype=bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


def repeat_tail(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """A tenth of the texts, by the checksum of their id, with their tail made periodic: runs of known periods to look for."""
    n = len(words)
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or not n or h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    times = -(-(n - a) // p)
    return words[:a] + (words[a : a + p] * times)[: n - a]


def collapse_runs(
    docs: DataFrame, powers: int = 4, least: int = 6, prepare: Callable[[list[bytes], int | None], list[bytes]] | None = None, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): each text's runs by start and period, and its words without repeats joined by one space.

    ``prepare`` may change the words before, given the id.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, text):
            ids = batch.column(doc_id).cast(pa.int64())
            words = [t.split() for t in raw(batch, text)]
            if prepare:
                words = [prepare(w, d) for w, d in zip(words, ids.to_pylist(), strict=True)]
            found = runs_of(words, powers, least)
            flat = np.array([r for runs in found for r in runs], dtype=np.int64).reshape(-1, 3)
            offsets = np.r_[0, np.cumsum([len(r) for r in found], dtype=np.int64)].astype(np.int32)
            structs = pa.StructArray.from_arrays([pa.array(flat[:, i]) for i in range(3)], fields=list(RUN_TYPE.value_type))
            left = [b" ".join(collapsed(w, r)).decode() for w, r in zip(words, found, strict=True)]
            columns = [ids, pa.array([len(w) for w in words], pa.int64()), pa.ListArray.from_arrays(offsets, structs, type=RUN_TYPE), pa.array(left, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "runs", "collapsed"])

    schema = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    return narrow(docs, doc_id, text).mapInArrow(run, schema)


def digests(found: DataFrame) -> DataFrame:
    """One row of numbers a document: how many runs, the one with the most periods, and checksums of the runs and of the collapsed text."""
    better = lambda a, b: a["length"] * b["period"] > b["length"] * a["period"]
    # the list is in the order of ties, so a later run must be truly better
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.get("runs", F.lit(0)), lambda a, b: F.when(better(b, a), b).otherwise(a))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    chosen = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(listed.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
    exponent = F.expr("(1000 * best.length) div best.period")
    return chosen.select("doc_id", "n_runs", "best.start", "best.length", "best.period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
