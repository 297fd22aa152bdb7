"""Token ids in patched frame-of-reference blocks.

A dataset is a folder of Parquet files that Spark commits, so it lies on any storage and a lost task leaves no half file. Each
row is one frame: a run of whole documents in ascending ``doc_id`` order. ``shard`` numbers the tasks that wrote, ``frame`` the
frames of a shard; in (shard, frame) order the frames hold all documents. The column ``data`` is the binary format proper,
little-endian throughout:

    header      4 bytes magic "PFR1", uint32 block size B, uint32 number of documents, uint64 number of ids, uint32 number of blocks
    documents   int64 doc_id each, uint8 "doc_id is null" each, uint64 number of ids each
    blocks      uint32 base each (its minimum), uint8 width each (bits), uint16 number of exceptions each
    index       uint64 start each: the byte in the payload where the block begins
    exceptions  uint16 place in their block each, uint32 value each, block by block
    payload     B values each, minus the base, `width` bits per value; of an exception only the low bits stand here

The width of a block is that of its ``percentile`` value above the base; larger ones are exceptions. The last block is filled
up with its base.
"""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import narrow, slices, texts
from .encoding import encoder

MAGIC = b"PFR1"
BLOCK = 128
#: Ids after which a frame is closed.
FRAME_TOKENS = 1 << 20
#: Blocks whose bits are spread out at a time.
CHUNK = 1024
FRAMES = "shard int, frame int, n_docs long, n_tokens long, first_doc_id long, data binary"
DOCS = "doc_id long, shard int, frame int, frame_offset long, n_tokens long, ids binary"


def bit_length(values: np.ndarray) -> np.ndarray:
    """Bits of each unsigned 32-bit value."""
    return np.frexp(values.astype(np.float64))[1].astype(np.uint8)


def by_width(width: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """The blocks of each width above 0, some at a time, so that a frame of one huge document needs little memory beside its ids."""
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        for i in range(0, len(which), CHUNK):
            yield int(w), which[i : i + CHUNK]


def encode_frame(doc_ids: list[int | None], parts: list[bytes], block: int = BLOCK, percentile: float = 90.0) -> bytes:
    """One frame of documents, given their ids as little-endian unsigned 32-bit integers."""
    ids = np.frombuffer(b"".join(parts), "<u4")
    n, n_blocks = len(ids), -(-len(ids) // block)
    rows = np.empty(n_blocks * block, np.uint32)
    rows[:n] = ids
    if n < len(rows):
        rows[n:] = ids[(n_blocks - 1) * block :].min()
    rows = rows.reshape(n_blocks, block)
    base = rows.min(axis=1) if n_blocks else np.zeros(0, np.uint32)
    above = rows - base[:, None]
    rank = min(block - 1, int(np.ceil(block * percentile / 100)) - 1)
    width = bit_length(np.partition(above, rank, axis=1)[:, rank]) if n_blocks else np.zeros(0, np.uint8)
    wide = (above.astype(np.uint64) >> width[:, None].astype(np.uint64)) > 0
    at = np.flatnonzero(wide.ravel())
    sizes = width.astype(np.uint64) * np.uint64(block) // np.uint64(8)
    index = np.concatenate([np.zeros(1, np.uint64), np.cumsum(sizes)]).astype(np.uint64)
    payload = np.zeros(int(index[-1]), np.uint8)
    for w, which in by_width(width):
        bits = (above[which][:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).reshape(len(which), -1), axis=1, bitorder="little")
        payload[index[which].astype(np.int64)[:, None] + np.arange(packed.shape[1])] = packed
    null = [d is None for d in doc_ids]
    return b"".join(
        [
            MAGIC,
            struct.pack("<IIQI", block, len(parts), n, n_blocks),
            np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes(),
            np.array(null, np.uint8).tobytes(),
            np.array([len(p) // 4 for p in parts], "<u8").tobytes(),
            base.astype("<u4").tobytes(),
            width.tobytes(),
            wide.sum(axis=1).astype("<u2").tobytes(),
            index[:-1].astype("<u8").tobytes(),
            (at % block).astype("<u2").tobytes(),
            above.ravel()[at].astype("<u4").tobytes(),
            payload.tobytes(),
        ]
    )


def decode_frame(data: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, their numbers of ids, and all ids of a frame."""
    if data[:4] != MAGIC:
        raise ValueError("not a frame of token ids")
    block, n_docs, n, n_blocks = struct.unpack_from("<IIQI", data, 4)
    pos = 4 + struct.calcsize("<IIQI")

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal pos
        out = np.frombuffer(data, kind, count, pos)
        pos += out.nbytes
        return out

    doc_ids, null, lengths = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    base, width, n_wide, index = take("<u4", n_blocks), take("u1", n_blocks), take("<u2", n_blocks), take("<u8", n_blocks)
    n_out = int(n_wide.sum(dtype=np.int64))
    places, values = take("<u2", n_out), take("<u4", n_out)
    at = np.repeat(np.arange(n_blocks, dtype=np.int64) * block, n_wide) + places
    payload = np.frombuffer(data, np.uint8, offset=pos)
    rows = np.zeros((n_blocks, block), np.uint32)
    for w, which in by_width(width):
        packed = payload[index[which].astype(np.int64)[:, None] + np.arange(int(w) * block // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), block, int(w))
        rows[which] = bits @ (np.uint32(1) << np.arange(w, dtype=np.uint32))
    flat = rows.ravel()
    flat[at] = values
    ids = (rows + base[:, None]).ravel()[:n]
    return [None if z else int(d) for d, z in zip(doc_ids, null, strict=True)], lengths.astype(np.int64), ids


def write_tokens(
    docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, block: int = BLOCK, percentile: float = 90.0, frame_tokens: int = FRAME_TOKENS
) -> None:
    """Encodes every document, appends ``end_id`` and writes the dataset to ``path``, in ascending ``doc_id`` order.

    One range shuffle moves the texts; they are encoded after it, so each is encoded once. Null texts count as empty, null ids
    come first, and an empty table gives a dataset without frames. The ranges go by id and hash of the text, so that rows without an id, or with
    one id, spread over tasks; rows with equal ids lie in the order of those hashes, then of their texts.
    """
    if block % 8 or not 0 < block <= 1 << 16:
        raise ValueError("the block size must be a multiple of 8, at most 65,536")
    end = end_id.to_bytes(4, "little")

    def frames(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, frame = encoder(tokenizer).encode, TaskContext.get().partitionId(), 0
        ids: list[bytes] = []
        keys: list[int | None] = []
        held = 0

        def close() -> pa.RecordBatch:
            row = {
                "shard": pa.array([shard], pa.int32()), "frame": pa.array([frame], pa.int32()), "n_docs": pa.array([len(keys)], pa.int64()),
                "n_tokens": pa.array([held], pa.int64()), "first_doc_id": pa.array([keys[0]], pa.int64()), "data": pa.array([encode_frame(keys, ids, block, percentile)], pa.binary()),
            }
            return pa.RecordBatch.from_arrays(list(row.values()), list(row))

        for batch in slices(batches):
            for key, text in zip(batch.column("doc_id").to_pylist(), texts(batch), strict=True):
                keys.append(key)
                ids.append(encode(text) + end)
                held += len(ids[-1]) // 4
                if held >= frame_tokens:
                    yield close()
                    ids, keys, held, frame = [], [], 0, frame + 1
        if keys:
            yield close()

    rows = narrow(docs, "doc_id", "text").withColumn("h", F.xxhash64("text")).repartitionByRange("doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    rows.drop("h").mapInArrow(frames, FRAMES).write.mode("overwrite").option("compression", "uncompressed").parquet(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, with its ids as little-endian unsigned 32-bit integers and its place in its frame."""

    def unpack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                keys, lengths, ids = decode_frame(batch.column("data")[i].as_py())
                ends = np.cumsum(lengths)
                data, starts = ids.astype("<u4").tobytes(), ends - lengths
                n = len(keys)
                values = pa.array([data[4 * s : 4 * e] for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(keys, pa.int64()),
                        pa.array([batch.column("shard")[i].as_py()] * n, pa.int32()),
                        pa.array([batch.column("frame")[i].as_py()] * n, pa.int32()),
                        pa.array(starts, pa.int64()),
                        pa.array(lengths, pa.int64()),
                        values,
                    ],
                    ["doc_id", "shard", "frame", "frame_offset", "n_tokens", "ids"],
                )

    return spark.read.schema(FRAMES).parquet(path).select("shard", "frame", "data").mapInArrow(unpack, DOCS)


def frame_starts(spark: SparkSession, path: str) -> DataFrame:
    """Ids before each frame: sums inside shards first, then over the shards, of which there are as many as tasks."""
    frames = spark.read.schema(FRAMES).parquet(path).select("shard", "frame", "n_tokens")
    before = lambda *keys: F.coalesce(F.sum("n").over(Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shards = frames.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", before("shard").alias("shard_start"))
    inside = frames.withColumnRenamed("n_tokens", "n").select("shard", "frame", before("shard", "frame").alias("in_shard"))
    return inside.join(shards, "shard").select("shard", "frame", (F.col("shard_start") + F.col("in_shard")).alias("frame_start"))


def digests(spark: SparkSession, path: str) -> DataFrame:
    """Per document of a dataset: ids before it, their number and checksum, all from the files."""
    docs = read_tokens(spark, path).select("doc_id", "shard", "frame", "frame_offset", "n_tokens", F.crc32("ids").alias("ids_crc32"))
    return docs.join(frame_starts(spark, path), ["shard", "frame"]).select(
        "doc_id", (F.col("frame_start") + F.col("frame_offset")).alias("start"), "n_tokens", "ids_crc32"
    )
