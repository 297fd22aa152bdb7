"""Token counts by a linear longest-match automaton.

The vocabulary is a trie. Greedy longest match would go back after each piece; here every node knows, from the vocabulary alone, what to
do when no child fits: how many pieces its letters give up (the popped-token count) and the node at which the rest of the letters stands
(the failure link). So a word is read once, letter by letter, and only numbers are added; no piece is ever built. A node whose letters
can't be split gives up the word, which then counts as one unknown token.

Words are what ``bytes.split()`` gives, each read with a space before it, so pieces that start with a space begin words. One pass over
the scan's partitions; each worker builds the automaton once, and counts of words are kept in a bounded cache.

Defined cases: null, empty and wordless texts have no words and no tokens; rows with equal ids are counted each for itself; a null
``doc_id`` stays null; an empty table gives no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import functools
import json
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import narrow, raw, slices
from .encoding import byte_letters

CACHE = 500_000


class Automaton:
    """Counts the pieces of greedy longest match over byte strings."""

    def __init__(self, pieces: Iterable[bytes]):
        self.children: list[dict[int, int]] = [{}]
        parent, letter, depth_order = [0], [0], [0]
        ends: set[int] = set()
        for piece in pieces:
            if not piece:
                continue
            node = 0
            for c in piece:
                nxt = self.children[node].get(c)
                if nxt is None:
                    nxt = self.children[node][c] = len(self.children)
                    self.children.append({})
                    parent.append(node)
                    letter.append(c)
                node = nxt
            ends.add(node)
        level = [0]
        while level:  # breadth first: links point at shorter letters
            level = [n for v in level for n in self.children[v].values()]
            depth_order += level
        n = len(self.children)
        self.fail: list[int] = [-1] * n
        self.popped = [0] * n
        for v in depth_order[1:]:
            if v in ends:  # the letters are one piece; nothing is left of them
                self.fail[v], self.popped[v] = 0, 1
                continue
            u, c = parent[v], letter[v]
            z, count = self.fail[u], self.popped[u]
            while z >= 0 and c not in self.children[z]:
                count += self.popped[z]
                z = self.fail[z]
            if z >= 0:
                self.fail[v], self.popped[v] = self.children[z][c], count

    def count(self, word: bytes) -> int:
        """Pieces of a word, 1 if it can't be split."""
        children, fail, popped = self.children, self.fail, self.popped
        node = total = 0
        for c in word:
            while (nxt := children[node].get(c)) is None:
                if not node or fail[node] < 0:
                    return 1
                total += popped[node]
                node = fail[node]
            node = nxt
        while node:
            if fail[node] < 0:
                return 1
            total += popped[node]
            node = fail[node]
        return total


def byte_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level ``tokenizers`` file as bytes, without its special tokens."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    special = {t["content"] for t in spec.get("added_tokens", [])}
    back = {chr(v): k for k, v in byte_letters().items()}
    return [bytes(back[c] for c in piece) for piece in spec["model"]["vocab"] if piece not in special]


@functools.lru_cache(2)
def automaton(path: str) -> tuple[Automaton, dict[bytes, int]]:
    """One per worker process and file, with its cache."""
    return Automaton(byte_vocabulary(path)), {}


def forget() -> None:
    """Drops the automata of this process and their caches."""
    automaton.cache_clear()


def count_tokens(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) of every document. ``vocabulary`` is the path of a byte-level ``tokenizers`` file."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, known = automaton(vocabulary)
        for batch in slices(batches):
            words = [t.split() for t in raw(batch)]
            tokens = []
            for doc in words:
                counts = list(map(known.get, doc))
                if None in counts:
                    for i, n in enumerate(counts):
                        if n is None:
                            word = doc[i]
                            n = known.get(word)
                            if n is None:
                                n = machine.count(b" " + word)
                                if len(known) >= CACHE:
                                    known.clear()
                                if len(word) < 64:
                                    known[word] = n
                            counts[i] = n
                tokens.append(sum(counts))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(list(map(len, words)), pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return narrow(docs, "doc_id", "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
