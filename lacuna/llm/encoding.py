"""Token ids of whole texts by the ``tokenizers`` library, with bounded caches in front of its byte-level BPE model.

A byte-level BPE file (no normalizer, the usual pre-tokenizer) never joins what stands before a space with what follows it,
as long as the space is followed by something else than white space. Texts are therefore cut there, and the ids of a piece are
looked up; only pieces that were not met before go to the library. Any other tokenizer file is simply run by the library.
"""

from __future__ import annotations

import functools
import json
import os

import numpy as np
import regex
from tokenizers import Tokenizer

#: Entries after which a cache starts anew: the bound of its memory.
CACHE = 700_000

#: The characters with the Unicode property White_Space.
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"
#: Closing punctuation that is one piece of its own behind letters.
PUNCTUATION = ".,;:!?*#%&$|)]}>-"
#: The pattern by which byte-level BPE files of this kind split text.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, int]:
    """The code point by which byte-level vocabularies write each byte: printable Latin-1 stays, the rest moves past U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(moved)}


class Encoder:
    """Encodes texts to little-endian unsigned 32-bit ids; equal to ``Tokenizer.encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        pre = spec.get("pre_tokenizer") or {}
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.cut = (
            spec["model"].get("type") == "BPE"
            and not spec.get("normalizer")
            and pre.get("type") == "ByteLevel"
            and not pre.get("add_prefix_space", True)
            and pre.get("use_regex", True)
        )
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.packed = [i.to_bytes(4, "little") for i in range(self.tokenizer.get_vocab_size())]
        self.space = chr(self.letters[32])
        self.pattern = regex.compile(PIECES)
        self.plain = regex.compile(r"[\t\n\r -~¡-ɏ]*")
        self.white = frozenset(WHITE_SPACE)
        self.joints = regex.compile(f"(?V1)(?= [^{WHITE_SPACE}])")
        self.bad = [lead + c for lead in " \n" for c in WHITE_SPACE]
        self.feed = self.whole("\n")
        self.words: dict[str, bytes] = {}  # of " " + key, or of a key that starts with a line feed
        self.pieces: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def merged(self, letters: str) -> bytes:
        """Ids of one piece, given as the letters by which the vocabulary writes its bytes."""
        return b"".join([self.packed[t.id] for t in self.model.tokenize(letters)])

    def piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            if len(self.pieces) >= CACHE // 8:
                self.pieces.clear()
            ids = self.pieces[piece] = self.merged(piece.encode().decode("latin-1").translate(self.letters))
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Of a stretch that no piece crosses. Unusual characters are left to the library's own pattern."""
        if self.plain.fullmatch(chunk):
            return b"".join(map(self.piece, self.pattern.findall(chunk)))
        return self.whole(chunk)

    def word(self, key: str) -> bytes:
        """Of a key that ``words`` lacks. Letters are remembered; letters with punctuation behind them are put together."""
        letters = key.rstrip(PUNCTUATION)
        tail = len(letters) < len(key)
        ids = self.words.get(letters) if tail else None
        if ids is None:
            feed = key[0] == "\n"
            body = letters[1:] if feed else letters
            if body.isascii() and body.isalpha():
                ids = self.feed + self.merged(body) if feed else self.merged(self.space + body)
            elif body.isalpha() and self.plain.fullmatch(body):
                body = body.encode().decode("latin-1").translate(self.letters)
                ids = self.feed + self.merged(body) if feed else self.merged(self.space + body)
            else:
                return self.chunk(key if feed else " " + key)
            if len(self.words) >= CACHE:
                self.words.clear()
            if len(letters) < 64:
                self.words[letters] = ids
        if tail:
            ids += self.piece(key[len(letters) :])
            if len(key) < 6:
                self.words[key] = ids
        return ids

    def encode(self, text: str) -> bytes:
        if not text:
            return b""
        if not self.cut or any(s in text for s in self.special):
            return self.whole(text)
        if text[-1] in self.white or any(b in text for b in self.bad):
            return self.spaced(text)
        first, *rest = text.replace("\n", " \n").split(" ")
        got = list(map(self.words.get, rest))
        if None in got:
            for i, ids in enumerate(got):
                if ids is None:
                    got[i] = self.word(rest[i])
        return self.chunk(first) + b"".join(got)

    def spaced(self, text: str) -> bytes:
        """Of a text with runs of white space: it is cut only at spaces before something else."""
        return b"".join(map(self.chunk, self.joints.split(text)))


@functools.lru_cache(2)
def encoder(path: str) -> Encoder:
    """One per worker process and file; workers are reused, so the caches serve later tasks too."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return Encoder(path)


def forget() -> None:
    """Drops the encoders of this process and their caches."""
    encoder.cache_clear()
