"""Removal of long repeated byte strings, by suffix arrays over the places where texts can repeat.

A byte goes if a string of ``length`` bytes that covers it also starts anywhere else. No machine sees the whole corpus at once, so
the windows (strings of that length) are dealt out by content. The smallest hash of a window's 128-grams is its anchor, and the
first place of the anchor inside is the same in equal windows, so equal windows have the same anchor at the same distance. Windows in
a row with the same anchor at the same place form a run of the text, one string of at most 400 + 272 bytes. Anchors that occur once
in the corpus, and they are nearly all, can't hold a repeat; the strings of the others are gathered by anchor, equal ones once with
their number.

Strings of an anchor are aligned at it. Of each, only the part that any other one shares is kept, and columns that do not differ
among the strings are joined to one symbol, so few symbols remain. Their suffix array comes from linear grouping (``lyndon``), each
string that occurs several times standing twice in the text; the longest prefix that a suffix shares with a neighbour tells, byte by
byte, which windows start a repeat.

An anchor with more than ``CROWD`` different strings is not gathered in one task. Its windows are dealt out anew by more of their
bytes: a window that reaches far enough to the left of the anchor by the anchor with half of the remaining bytes before it, others by the
anchor with as many behind it. Equal windows take the same side, so they meet again; groups that are still too large are split in the same
way, until a group's key is the whole window, of which there is only one. So a task never sorts more than ``CROWD`` strings at a time.

Defined cases: null and empty texts have no bytes; texts shorter than ``length`` lose nothing; equal texts share one verdict, and
all their bytes go if they are long enough; repeats inside one text count; rows with equal ids stay separate rows; a null ``doc_id``
stays null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import contextlib
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, narrow, raw, release, slices, unused
from .lyndon import common_prefixes, suffix_array

LENGTH = 400
GRAM = 128
#: Bytes of the strings by which passages of over 50 words are found, and of their anchors.
PASSAGE, PASSAGE_GRAM = 240, 96
#: Different strings of one group that a task holds at most.
CROWD = 512
#: Bytes of a window beside the key below which a crowded group is dealt out by whole windows.
RIM = 16
#: Windows of a long text that are hashed at a time.
PIECE = 1 << 18

FACTOR = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(FACTOR), -1, 1 << 64))
BYTE_VALUES = np.random.default_rng(7).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """1, base, base**2 ... modulo 2**64, n of them at least."""
    known = _powers.get(int(base))
    if known is None or len(known) < n:
        known = np.full(max(n, 1 << 16), base, np.uint64)
        known[0] = 1
        known = _powers[int(base)] = np.multiply.accumulate(known)
    return known


def mixed(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of a hash."""
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * powers(FACTOR, len(data))[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of the strings data[start:end], equal for equal strings."""
    return mixed((prefix[end] - prefix[start]) * powers(INVERSE, len(prefix))[start])


def sliding_least(a: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` values in a row, from running minima of blocks."""
    n = len(a)
    rows = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    rows[:n] = a
    rows = rows.reshape(-1, width)
    upto = np.minimum.accumulate(rows, axis=1).ravel()
    onward = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(onward[: n - width + 1], upto[width - 1 : n])


def runs(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Windows of a text by anchor: first window, number of windows, anchor, and hash of the string of each run."""
    found = []
    for at in range(0, max(0, len(text) - length + 1), PIECE):
        data = np.frombuffer(text, np.uint8, min(PIECE + length - 1, len(text) - at), at)
        prefix = prefix_hashes(data)
        places = np.arange(len(data) - gram + 1)
        grams = span_hashes(prefix, places, places + gram)
        least = sliding_least(grams, length - gram + 1)
        n = len(least)
        new = np.ones(n, bool)  # the anchor changes, or the window before started with it
        new[1:] = (least[1:] != least[:-1]) | (grams[: n - 1] == least[:-1])
        start = np.flatnonzero(new)
        end = np.append(start[1:], n)
        found.append((start + at, end - start, least[start].view(np.int64), span_hashes(prefix, start, end + length - 1).view(np.int64)))
    if not found:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def anchor_place(string: bytes, gram: int = GRAM, length: int = LENGTH) -> int:
    """Where the anchor of a run's first window starts in its string."""
    data = np.frombuffer(string, np.uint8, length)
    places = np.arange(length - gram + 1)
    return int(span_hashes(prefix_hashes(data), places, places + gram).argmin())


class Places:
    """Where the anchors of strings start; strings of one anchor nearly always hold the same bytes there."""

    def __init__(self, gram: int, length: int):
        self.gram, self.length, self.key = gram, length, {}

    def of(self, group: int, string: bytes) -> int:
        key = self.key.get(group)
        at = string.find(key) if key else -1
        if at < 0:
            at = anchor_place(string, self.gram, self.length)
            if not key:
                self.key = {group: string[at : at + self.gram]}
        return at


def shared(a: bytes, b: bytes) -> int:
    """Bytes of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int((np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)).argmax())


def most_shared(parts: list[bytes]) -> list[int]:
    """For each, the longest prefix that it shares with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        n = shared(parts[i], parts[j])
        out[i], out[j] = max(out[i], n), max(out[j], n)
    return out


def repeated(strings: list[bytes], counts: list[int], place: list[int], gram: int = GRAM, length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each different string of one group, the parts covered by windows that repeat. ``counts`` tell how often each string occurs,
    ``place`` where its key of ``gram`` bytes begins, which all of its windows hold there."""
    out: list[list[tuple[int, int]]] = [[] for _ in strings]
    keys = [s[p : p + gram] for s, p in zip(strings, place, strict=True)]
    if len(different := dict.fromkeys(keys)) > 1:  # other keys with the same hash: groups of their own
        for key in different:
            which = [i for i, k in enumerate(keys) if k == key]
            for i, spans in zip(which, repeated(*([x[i] for i in which] for x in (strings, counts, place)), gram, length), strict=True):
                out[i] = spans
        return out
    right = most_shared([s[p:] for s, p in zip(strings, place, strict=True)])
    left = most_shared([s[:p][::-1] for s, p in zip(strings, place, strict=True)])
    cores: dict[tuple[int, bytes], list[int]] = {}
    for i, s in enumerate(strings):
        if counts[i] > 1:
            left[i], right[i] = place[i], len(s) - place[i]
        if left[i] + right[i] >= length:
            cores.setdefault((left[i], s[place[i] - left[i] : place[i] + right[i]]), []).append(i)
    if not cores:
        return out
    zero = max(n for n, _ in cores)
    width = zero + max(len(core) - n for n, core in cores)
    table = np.full((len(cores), width), 256, np.uint16)
    edge = np.zeros(width + 1, bool)
    bounds = []
    for row, (n, core) in zip(table, cores, strict=True):
        lo = zero - n
        row[lo : lo + len(core)] = np.frombuffer(core, np.uint8)
        edge[[lo, lo + len(core)]] = True
        bounds.append((lo, lo + len(core)))
    lowest, highest = table.min(axis=0), np.where(table == 256, 0, table).max(axis=0)
    differ = np.flatnonzero(lowest != highest)
    edge[differ] = edge[differ + 1] = True
    cuts = np.flatnonzero(edge)
    sizes = np.diff(cuts)
    text: list[int] = []
    weight: list[int] = []
    at = []
    for row, (lo, hi), members in zip(table, bounds, cores.values(), strict=True):
        i, j = np.searchsorted(cuts, (lo, hi))
        symbols = (2 + cuts[i:j] * 257 + row[cuts[i:j]]).tolist()
        at.append((len(text), i, j))
        twice = len(members) > 1 or counts[members[0]] > 1
        for _ in range(2 if twice else 1):
            text += symbols
            text.append(1)
            weight += sizes[i:j].tolist()
            weight.append(0)
    text.append(0)
    prefixes = common_prefixes(text, suffix_array(text))
    upto = np.concatenate([[0], np.cumsum(weight)]).tolist()
    for (start, i, j), members in zip(at, cores.values(), strict=True):
        spans: list[tuple[int, int]] = []
        end = start + j - i
        for k in range(i, j):
            p = start + k - i
            n = upto[min(p + prefixes[p], end)] - upto[p]
            if n >= length:
                lo, hi = int(cuts[k]), int(cuts[k]) + min(int(sizes[k]), n - length + 1) - 1 + length
                if spans and lo <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], max(spans[-1][1], hi))
                else:
                    spans.append((lo, hi))
        for m in members:
            out[m] = [(a - zero + place[m], b - zero + place[m]) for a, b in spans]
    return out


def merge(spans: Iterable[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of covered bytes."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def without(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    """The bytes outside the spans."""
    ends = [0, *(b for _, b in spans)]
    return b"".join([text[e:a] for e, a in zip(ends, [*(a for a, _ in spans), len(text)], strict=True)])


SPANS = "spans array<struct<a:int,b:int>>"
SPAN_TYPE = pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())]))


def text_key(text: str = "text"):
    """MD5 of the text's bytes, null as empty."""
    return F.unhex(F.md5(F.coalesce(F.col(text).cast("binary"), F.lit("").cast("binary"))))


def mark(docs: DataFrame, length: int, gram: int) -> DataFrame:
    """One row per document, without its text: key, size and SHA-256 of the text, and its runs."""
    names = ["doc_id", "key", "n_bytes", "sha256", "start", "n", "anchor", "content"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            data = raw(batch)
            found = [runs(t, length, gram) for t in data]
            columns = [
                batch.column("doc_id").cast(pa.int64()),
                pa.array([hashlib.md5(t).digest() for t in data], pa.binary()),
                pa.array([len(t) for t in data], pa.int64()),
                pa.array([hashlib.sha256(t).hexdigest() for t in data], pa.string()),
            ]
            ends = pa.array(np.cumsum([0] + [len(f[0]) for f in found]), pa.int32())
            for k, kind in enumerate((np.int32, np.int32, np.int64, np.int64)):
                values = np.concatenate([f[k] for f in found]) if found else np.zeros(0)
                columns.append(pa.ListArray.from_arrays(ends, pa.array(values.astype(kind))))
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, key binary, n_bytes long, sha256 string, start array<int>, n array<int>, anchor array<long>, content array<long>"
    return narrow(docs, "doc_id", "text").mapInArrow(run, schema)


STRINGS = "group long, sub long, copies long, place int, gram int, string binary"


def batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as a batch of columns, whose names and types are those of ``schema``."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<struct<a:int,b:int>>": SPAN_TYPE}
    names, types = zip(*(c.split() for c in schema.split(", ")), strict=True)
    columns = list(zip(*rows, strict=True)) or [()] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(columns, types, strict=True)], names)


def cut_strings(held: DataFrame, length: int, gram: int) -> DataFrame:
    """Strings of runs, from the texts that hold them, by anchor (``group``) and content (``sub``); where the key begins is still to be found."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, chars=500_000):
            rows = []
            for text, wanted in zip(raw(batch), batch.column("wanted").to_pylist(), strict=True):
                rows += [(w["anchor"], w["content"], w["copies"], None, gram, text[w["start"] : w["start"] + w["n"] + length - 1]) for w in wanted]
            yield batch_of(rows, STRINGS)

    return held.filter("wanted is not null").select("text", "wanted").mapInArrow(run, STRINGS)


def judge(strings: DataFrame, length: int) -> DataFrame:
    """Repeated parts of each string, one group after the other: (group, sub, spans)."""
    schema = f"group long, sub long, {SPANS}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def verdict(group: list[dict]) -> Iterator[tuple]:
            if len(group) > 1 or group[0]["copies"] > 1:
                places = Places(gram := group[0]["gram"], length)
                at = [places.of(r["group"], r["string"]) if r["place"] is None else r["place"] for r in group]
                found = repeated([r["string"] for r in group], [r["copies"] for r in group], at, gram, length)
                for row, spans in zip(group, found, strict=True):
                    if spans:
                        yield row["group"], row["sub"], [{"a": a, "b": b} for a, b in spans]

        release()
        group: list[dict] = []
        for batch in slices(batches, "string", 200_000):
            rows = []
            for row in batch.to_pylist():
                if group and row["group"] != group[0]["group"]:
                    rows += verdict(group)
                    group = []
                group.append(row)
            yield batch_of(rows, schema)
        if group:
            yield batch_of(list(verdict(group)), schema)

    return strings.repartition("group").sortWithinPartitions("group", "sub").mapInArrow(run, schema)


def sides(string: bytes, place: int, gram: int, length: int) -> Iterator[tuple[int, int, int, int]]:
    """The windows of a string dealt out by a longer key: (first window, number of windows, where the key begins, its size)."""
    n, rest = len(string) - length + 1, length - gram
    if rest <= RIM:
        yield from ((w, 1, w, length) for w in range(n))
        return
    more = -(-rest // 2)
    left = max(0, min(n, place - more + 1))  # the windows that hold the key and ``more`` bytes before it
    if left:
        yield 0, left, place - more, gram + more
    if left < n:
        yield left, n - left, place, gram + more


def deal_out(strings: DataFrame, length: int) -> DataFrame:
    """Strings of crowded groups cut into those of smaller groups, with the group and string they come from and their place in it (``base``)."""
    schema = f"from_group long, from_sub long, base int, {STRINGS}"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = None
        for batch in slices(batches, "string", 200_000):
            rows = []
            for r in batch.to_pylist():
                string, own = r["string"], r["place"]
                if own is None:
                    places = places or Places(r["gram"], length)
                    own = places.of(r["group"], string)
                for at, n, key, gram in sides(string, own, r["gram"], length):
                    part, place = string[at : at + n + length - 1], key - at
                    group = xxhash.xxh3_64_intdigest(string[key : key + gram], key < own)
                    sub = xxhash.xxh3_64_intdigest(part, place)
                    rows.append((r["group"], r["sub"], at, signed(group), signed(sub), r["copies"], place, gram, part))
            yield batch_of(rows, schema)

    return strings.mapInArrow(run, schema)


def signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def judge_all(strings: DataFrame, scratch: Scratch, length: int, crowd: int, level: int = 0) -> DataFrame:
    """As ``judge``, with groups of more than ``crowd`` strings dealt out by longer keys, as often as it takes."""
    crowded = scratch.table(strings.groupBy("group").count().filter(F.col("count") > crowd).select("group"), f"crowded{level}")
    if crowded.isEmpty():
        return judge(strings, length)
    parts = scratch.table(deal_out(strings.join(crowded, "group", "left_semi"), length), f"parts{level}")
    merged = parts.groupBy("group", "sub").agg(F.sum("copies").alias("copies"), F.first("place").alias("place"), F.first("gram").alias("gram"), F.first("string").alias("string"))
    often = parts.groupBy("group").agg(F.sum("copies").alias("n")).filter("n > 1").select("group")
    smaller = scratch.table(merged.join(often, "group", "left_semi"), f"smaller{level}")
    below = scratch.table(judge_all(smaller, scratch, length, crowd, level + 1), f"below{level}")
    found = parts.select("from_group", "from_sub", "base", "group", "sub").join(below, ["group", "sub"])
    lifted = found.groupBy("from_group", "from_sub").agg(F.flatten(F.collect_list(moved("spans", "base"))).alias("spans"))
    return judge(strings.join(crowded, "group", "left_anti"), length).union(lifted)


def moved(spans: str, by: str) -> Column:
    return F.transform(spans, lambda s: F.struct((s["a"] + F.col(by)).alias("a"), (s["b"] + F.col(by)).alias("b")))


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 500) -> Iterator[None]:
    """Texts go to tasks in Python by few rows at a time, so that neither side ever holds thousands of them beside what it makes of them."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def find_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM, crowd: int = CROWD) -> tuple[DataFrame, DataFrame]:
    """(documents, cuts): per document its key, size and SHA-256; per different text with repeats its key, the spans of bytes that go,
    and the bytes that stay (``kept``). ``gram`` is the size of the anchors, less than ``length``."""
    with small_batches(docs.sparkSession):
        marked = scratch.table(mark(docs, length, gram), "marked")
    arrays = ["start", "n", "anchor", "content"]
    texts = marked.groupBy("key").agg(F.count("*").alias("copies"), F.first(F.arrays_zip(*arrays)).alias("runs"))
    each = scratch.table(texts.select("key", "copies", F.explode("runs").alias("r")).select("key", "copies", "r.*"), "runs")
    # a written table, so that the join has a shuffle on both sides and adaptive execution can split an anchor with very many runs
    often = scratch.table(each.groupBy("anchor").agg(F.sum("copies").alias("n")).filter("n > 1").select("anchor"), "often")
    met = scratch.table(each.join(often, "anchor").select("key", "copies", *arrays), "met")
    scratch.drop("runs", "often")
    strings = met.groupBy("anchor", "content").agg(F.sum("copies").alias("copies"), F.min(F.struct("key", "start", "n")).alias("at"))
    wanted = strings.groupBy(F.col("at.key").alias("key")).agg(F.collect_list(F.struct("anchor", "content", "copies", "at.start", "at.n")).alias("wanted"))
    touched = met.select("key").distinct()
    # texts without a repeated anchor leave before texts are gathered; if the keys are few, adaptive execution does not shuffle any of them
    whole = docs.select(text_key().alias("key"), "text").join(touched, "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    held = scratch.table(whole.join(wanted, "key", "left"), "held")
    with small_batches(docs.sparkSession):
        cut = scratch.table(cut_strings(held, length, gram), "strings")
    spans = judge_all(cut, scratch, length, crowd).select(F.col("group").alias("anchor"), F.col("sub").alias("content"), "spans")
    spans = scratch.table(spans, "spans")
    scratch.drop("strings")
    by_text = met.select("key", "start", "anchor", "content").join(spans, ["anchor", "content"]).groupBy("key").agg(F.flatten(F.collect_list(moved("spans", "start"))).alias("spans"))

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            merged, kept = [], []
            for text, found in zip(raw(batch), batch.column("spans").to_pylist(), strict=True):
                found = merge((s["a"], s["b"]) for s in found)
                kept.append(without(text, found))
                merged.append([{"a": a, "b": b} for a, b in found])
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(merged, SPAN_TYPE), pa.array(kept, pa.binary())], ["key", "spans", "kept"])

    cuts = held.select("key", "text").join(by_text, "key").mapInArrow(keep, f"key binary, {SPANS}, kept binary")
    with small_batches(docs.sparkSession):
        cuts = scratch.table(cuts, "cuts")
    scratch.drop("held", "met", "spans")
    return marked.select("doc_id", "key", "n_bytes", "sha256"), cuts


def digests(documents: DataFrame, cuts: DataFrame) -> DataFrame:
    """One row per document: bytes and runs of bytes that went, and SHA-256 of those that stayed."""
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"])
    cuts = cuts.select("key", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
    number = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    rows = documents.join(cuts, "key", "left")
    return rows.select("doc_id", "n_bytes", number("n_removed"), number("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"))


def remove_repeats(docs: DataFrame, scratch: Scratch, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """The documents, with all their columns, without their repeated strings; ``n_chars`` is counted anew.

    Bytes of a character that a cut has split go too. Documents of which no word is left are dropped; those that had none stay.
    """
    _, cuts = find_repeats(docs, scratch, length, gram)
    whole = docs.select(F.struct(*docs.columns).alias("row"), text_key().alias("key"))
    joined = whole.join(cuts.select("key", "kept"), "key", "left").select("row.*", F.col("kept").alias(column := unused("kept", docs)))
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches):
            own, kept = batch.column("text").to_pylist(), batch.column(column).to_pylist()
            new = [t if k is None else k.decode("utf-8", "ignore") for t, k in zip(own, kept, strict=True)]
            stays = pa.array([k is None or bool(k.split()) for k in kept], pa.bool_())
            columns = [pa.array(new, pa.string()) if c == "text" else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names).filter(stays)

    out = joined.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.length("text").cast(dict(docs.dtypes)["n_chars"])) if "n_chars" in names else out
