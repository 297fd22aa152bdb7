"""Token counts, packing, and the binary output."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from lacuna.llm import packing, tokenbin, wordpiece
from lacuna.llm.encoding import Encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, "<u4")


def test_encoder_equals_the_library(library):
    encoder, rng = Encoder(PATH), random.Random(1)
    letters = [*"ab c  \n\t's1#.,!é中 ", " ", " ", "\x1c", "\x85", "<|endoftext|>", "  ", "'ll", "\n\n", "word", " The"]
    for _ in range(4000):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 14)))
        assert encoder.encode(text) == ids_of(library, text).tobytes()


def greedy(word, pieces):
    at = n = 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in pieces), None)
        if end is None:
            return 1
        at, n = end, n + 1
    return n


def test_automaton_equals_greedy_match():
    rng = random.Random(2)
    for _ in range(800):
        pieces = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(1, 8))}
        machine = wordpiece.Automaton(pieces)
        for _ in range(8):
            word = bytes(rng.choice(b"abcd") for _ in range(rng.randint(0, 9)))
            assert machine.count(word) == greedy(word, pieces)


def test_token_counts(odd, empty):
    pieces = set(wordpiece.byte_vocabulary(PATH))
    got = wordpiece.count_tokens(odd, PATH).collect()
    texts = {(r["doc_id"], len((r["text"] or "").split())): r["text"] or "" for r in odd.collect()}
    assert len(got) == 10
    for r in got:
        words = texts[r["doc_id"], r["n_words"]].encode().split()
        assert r["n_tokens"] == sum(greedy(b" " + w, pieces) for w in words[:3000]) * (10 if len(words) == 30_000 else 1)
    assert wordpiece.count_tokens(empty, PATH).count() == 0


def test_packing_covers_every_id_once(odd, empty, library):
    rows = packing.pack_documents(odd, PATH, pool_tokens=4000).collect()
    texts = [(r["doc_id"], r["text"]) for r in odd.collect()]
    assert sum(r["length"] for r in rows) == sum(len(ids_of(library, t)) + 1 for _, t in texts)
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        assert len(r["ids"]) == 4 * r["length"] and r["start"] + r["length"] <= r["doc_tokens"]
    padded = 0
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 2048
        padded += bool(at & (at - 1))
    assert padded <= 3  # at most one for each of the three tasks
    long_one = np.append(ids_of(library, "word " * 30_000), 1).astype("<u4").tobytes()
    assert b"".join(r["ids"] for r in sorted((r for r in rows if r["doc_id"] == 5), key=lambda r: r["start"])) == long_one
    assert packing.pack_documents(empty, PATH).count() == 0


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 5000])
def test_frames_round_trip(n):
    rng = np.random.default_rng(n)
    values = np.where(rng.random(n) < 0.05, rng.integers(0, 2**32, n), rng.integers(100, 900, n)).astype("<u4")
    cuts = sorted({0, n, *rng.integers(0, n + 1, 3).tolist()})
    parts = [values[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = [None if i == 1 else -i for i in range(len(parts))]
    got_keys, lengths, ids = tokenbin.decode_frame(tokenbin.encode_frame(keys, parts))
    assert got_keys == keys and lengths.tolist() == [len(p) // 4 for p in parts] and np.array_equal(ids, values)


def test_files_hold_all_ids_in_order(spark, odd, empty, library, scratch):
    tokenbin.write_tokens(odd, scratch.path("tokens"), PATH, frame_tokens=500)
    rows = sorted(tokenbin.digests(spark, scratch.path("tokens")).collect(), key=lambda r: r["start"])
    docs = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda d: (d[0] is not None, d[0] or 0))
    assert [r["doc_id"] for r in rows] == [d for d, _ in docs]
    start = 0
    for r, (_, text) in zip(rows, docs, strict=True):
        ids = np.append(ids_of(library, text), 2).astype("<u4")
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    tokenbin.write_tokens(empty, scratch.path("none"), PATH)
    assert tokenbin.digests(spark, scratch.path("none")).count() == 0
