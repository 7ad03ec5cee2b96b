"""Token counts by a linear longest-match automaton.

Greedy word pieces are the longest vocabulary entries from left to right. The vocabulary is a trie; a node's failure
link leads to the node of what is left after its string's greedy pieces were taken off, and its count says how many
pieces those are. A word is then read once, byte by byte: where the trie has no way on, the count is added and the
link followed. No piece is ever built, and the time is linear in the word's length.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterable
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.llm.bpe import read_ranks
from umbraframe.llm.common import held, map_batches, record_batch, texts_of

CACHE_WORDS = 400_000


class Automaton:
    """Node 0 is the root. `step` goes from node << 8 | byte to the next node."""

    def __init__(self, vocabulary: Iterable[bytes]):
        self.step: dict[int, int] = {}
        self.pops, self.link, final, children = [0], [-1], [False], [[]]
        for token in vocabulary:
            node = 0
            for byte in token:
                key = node << 8 | byte
                if key not in self.step:
                    self.step[key] = len(final)
                    children[node].append(byte)
                    final.append(False)
                    children.append([])
                node = self.step[key]
            final[node] = True
        self.pops, self.link = [0] * len(final), [-1] * len(final)
        order = deque([0])
        while order:  # breadth first: links lead to shorter strings
            parent = order.popleft()
            for byte in children[parent]:
                node = self.step[parent << 8 | byte]
                order.append(node)
                if final[node]:
                    self.pops[node], self.link[node] = 1, 0
                    continue
                pops, at = self.pops[parent], self.link[parent]
                while at >= 0 and at << 8 | byte not in self.step:
                    pops, at = pops + self.pops[at], self.link[at]
                if at >= 0:
                    self.pops[node], self.link[node] = pops, self.step[at << 8 | byte]

    def count(self, word: bytes) -> int:
        """The number of pieces; a word that can't be cut into entries is one unknown piece."""
        step, pops, link, node, total = self.step, self.pops, self.link, 0, 0
        for byte in word:
            while (to := step.get(node << 8 | byte)) is None:
                total += pops[node]
                node = link[node]
                if node < 0:
                    return 1
            node = to
        while node:
            total += pops[node]
            node = link[node]
            if node < 0:
                return 1
        return total


class _Counts(dict):
    """Counts by word; a full cache keeps its older half, as frequent words come early."""

    def __init__(self, automaton: Automaton, prefix: bytes):
        super().__init__()
        self.automaton, self.prefix = automaton, prefix

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(self.prefix + word)
        if len(self) >= CACHE_WORDS:
            for old in list(islice(self, CACHE_WORDS // 2, None)):
                del self[old]
        if len(word) <= 64:
            self[word] = n
        return n


def counts(file: str, prefix: bytes) -> _Counts:
    return held(("pieces", file, prefix), lambda: _Counts(Automaton(read_ranks(file)), prefix))


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def count_tokens(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None, prefix: bytes = b" ") -> DataFrame:
    """One row for each document: id, n_words and n_tokens (longs).

    Words are `[^\\x20\\x09-\\x0D]+`; `prefix` stands before each, as entries that begin a word begin with a space
    in this vocabulary and the others continue one. The default vocabulary is that of a byte-level BPE tokenizer, read as a
    list of pieces: the counts are greedy ones, not that tokenizer's. A null text has no words. Repeated rows and rows without
    an id give results like any other.
    """
    file = vocabulary or default_vocabulary()

    def run(batches):
        known = counts(file, prefix)
        of = known.__getitem__
        for batch in batches:
            words = [t.encode("utf-8", "surrogatepass").split() for t in texts_of(batch)]
            yield record_batch({"id": batch.column("id"), "n_words": pa.array([len(w) for w in words], pa.int64()), "n_tokens": pa.array([sum(map(of, w)) for w in words], pa.int64())})

    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(df, run, "id bigint, n_words bigint, n_tokens bigint").withColumnRenamed("id", id_col)


def greedy(vocabulary: set[bytes], word: bytes) -> list[bytes] | None:
    """Longest match by trying all lengths; for tests."""
    out, at = [], 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocabulary), None)
        if end is None:
            return None
        out.append(word[at:end])
        at = end
    return out
