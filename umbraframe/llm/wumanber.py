"""Benchmark decontamination: Wu-Manber multi-pattern search over words.

A pattern is a window of consecutive item words. A block is a pair of words: for the pair that ends at a text
position, the shift table says how far the search may jump without missing a pattern; where it says zero, the
pair picks a bucket of patterns, and direct comparison confirms an occurrence. Patterns of one length share a
table, so that short items do not shorten the jumps of the others.

The patterns are broadcast in blocks of a bounded size (BLOCK_WORDS words). More blocks mean more passes over
the same rows, each of them narrow: no shuffle at any size of either table.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.llm.common import held, map_batches, record_batch, texts_of, unused

WINDOW = 13
#: Words of benchmark text that one broadcast block holds at most, unless a single item has more.
BLOCK_WORDS = 500_000
#: Bytes that are not part of a word become a space, A-Z become a-z.
FOLD = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after lower-casing A-Z; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD).split()


class PatternTable:
    """Patterns of one length with their shift table and their buckets."""

    def __init__(self, length: int, patterns: dict[tuple[bytes, ...], list[int]]):
        self.length, self.block = length, min(2, length)
        self.most = length - self.block + 1
        self.shift: dict = {}
        self.buckets: dict = {}
        for words, items in patterns.items():
            for end in range(self.block - 1, length):
                block, jump = self._block(words, end), length - 1 - end
                self.shift[block] = min(jump, self.shift.get(block, self.most))
            self.buckets.setdefault(self._block(words, length - 1), []).append((list(words), items))

    def _block(self, words, end: int):
        return words[end] if self.block == 1 else (words[end - 1], words[end])

    def search(self, words: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Starts of all occurrences, in order, with the items that have the window."""
        length, most, shift, buckets = self.length, self.most, self.shift, self.buckets
        at, n = length - 1, len(words)
        pair = self.block == 2
        while at < n:
            block = (words[at - 1], words[at]) if pair else words[at]
            jump = shift.get(block, most)
            if jump:
                at += jump
                continue
            start = at - length + 1
            here = words[start : at + 1]
            for pattern, items in buckets.get(block, ()):
                if pattern == here:
                    yield start, items
            at += 1


def tables_for(items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> list[PatternTable]:
    """One table for each pattern length; an item of fewer words than the window, but not none, is one pattern."""
    by_length: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
    for item, text in items:
        words = words_of(text)
        if not words:
            continue
        length = min(window, len(words))
        for start in range(len(words) - length + 1):
            owners = by_length.setdefault(length, {}).setdefault(tuple(words[start : start + length]), [])
            if not owners or owners[-1] != item:
                owners.append(item)
    return [PatternTable(k, v) for k, v in sorted(by_length.items())]


def _blocks(benchmark: DataFrame, item_col: str, text_col: str) -> Iterator[list[tuple[int, str | None]]]:
    """The benchmark in blocks of a bounded number of bytes; the driver holds one block at a time."""
    block, size = [], 0
    for row in benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).toLocalIterator():
        block.append((row.i, row.t))
        size += len(row.t or "") // 5 + 1
        if size >= BLOCK_WORDS:
            yield block
            block, size = [], 0
    if block:
        yield block


def _tables(name: str, broadcast, window: int) -> list[PatternTable]:
    """A worker builds a block's tables once."""
    return held(("benchmark", name), lambda: tables_for(broadcast.value, window))


#: What a search adds to the rows it passes through, under names that the table doesn't have.
_STATE = {"_wm_words": ("bigint", pa.int64()), "_wm_starts": ("array<int>", pa.list_(pa.int32())), "_wm_lengths": ("array<int>", pa.list_(pa.int32())), "_wm_items": ("array<string>", pa.list_(pa.string()))}
_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def state_names(documents: DataFrame) -> dict[str, str]:
    return {n: unused(n, documents) for n in _STATE}


def search(documents: DataFrame, benchmark: DataFrame, finish, schema, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """Passes over the rows for all benchmark blocks, which add the columns of _STATE; `finish` takes the batches of the
    last pass in the same worker."""
    context, names = documents.sparkSession.sparkContext, state_names(documents)
    empty = {names[n]: F.lit(0).cast(t) if t == "bigint" else F.array().cast(t) for n, (t, _) in _STATE.items()}
    df = documents.withColumns(empty)
    last = None
    for block in _blocks(benchmark, item_col, item_text_col):
        df = map_batches(df, last, df.schema) if last else df
        last = _pass(context.broadcast(block), names, text_col, window)
    last = last or _pass(context.broadcast([]), names, text_col, window)
    return map_batches(df, lambda batches: finish(last(batches)), schema)


def find_overlaps(documents: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row for each document: id, n_words, n_hit, items (sorted as strings), spans.

    spans are merged word ranges [start, end) covered by benchmark windows. A null or empty text has no words and
    no hits; repeated rows give repeated results; an empty benchmark gives no hits; other columns are ignored.
    """
    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = "id bigint, n_words bigint, n_hit bigint, items array<string>, spans array<struct<start:int,end:int>>"
    return search(df, benchmark, _merge, schema, "text", item_col, item_text_col, window).withColumnRenamed("id", id_col)


def _pass(broadcast, names: dict[str, str], text_col: str, window: int):
    name = uuid.uuid4().hex

    def run(batches):
        tables = _tables(name, broadcast, window)
        for batch in batches:
            n_words, starts, lengths, items = [], [], [], []
            before = zip(*(batch.column(names[c]).to_pylist() for c in ("_wm_starts", "_wm_lengths", "_wm_items")), strict=True)
            for text, (s, l, i) in zip(texts_of(batch, text_col), before, strict=True):
                words, found = words_of(text), set(i)
                for table in tables:
                    for start, owners in table.search(words):
                        s.append(start)
                        l.append(table.length)
                        found.update(map(str, owners))
                n_words.append(len(words))
                starts.append(s)
                lengths.append(l)
                items.append(sorted(found))
            own = {names[n]: pa.array(v, t) for (n, (_, t)), v in zip(_STATE.items(), (n_words, starts, lengths, items), strict=True)}
            yield record_batch({c: own.get(c, batch.column(c)) for c in batch.schema.names})

    return run


def merged(starts: list[int], lengths: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for start, length in sorted(zip(starts, lengths, strict=True)):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], start + length)
        else:
            out.append([start, start + length])
    return out


def _merge(batches):
    for batch in batches:
        spans = [merged(s, l) for s, l in zip(batch.column("_wm_starts").to_pylist(), batch.column("_wm_lengths").to_pylist(), strict=True)]
        yield record_batch({
            "id": batch.column("id"), "n_words": batch.column("_wm_words"), "n_hit": pa.array([sum(b - a for a, b in x) for x in spans], pa.int64()),
            "items": batch.column("_wm_items"), "spans": pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS),
        })


def drop_contaminated(documents: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows that the contract's rule does not call contaminated, with all their columns, whatever their names are."""

    names = state_names(documents)

    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(names[c]).to_pylist() for c in ("_wm_words", "_wm_starts", "_wm_lengths")), strict=True)
            hits = [(n, sum(b - a for a, b in merged(s, l))) for n, s, l in rows]
            yield batch.filter(pa.array([not contaminated_row(h, n) for n, h in hits], pa.bool_())).select(documents_columns)

    documents_columns = documents.columns
    return search(documents, benchmark, run, documents.schema, text_col)


def contaminated_row(n_hit: int, n_words: int) -> bool:
    return n_hit > 0 and 20 * n_hit >= n_words


def contaminated(n_hit, n_words):
    """The contract's rule: some words are hit, and they are a twentieth of all words or more."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def decontamination_report(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    found = find_overlaps(documents, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


def brute_force(documents: Iterable[tuple[int, str | None]], items: Iterable[tuple[int, str | None]], window: int = WINDOW) -> list[tuple]:
    """The same rows by trying every window at every position; for tests."""
    patterns = []
    for item, text in items:
        w = words_of(text)
        k = min(window, len(w))
        patterns += [(w[i : i + k], item) for i in range(len(w) - k + 1)] if k else []
    rows = []
    for doc, text in documents:
        w = words_of(text)
        hit, found = set(), set()
        for p, item in patterns:
            for i in range(len(w) - len(p) + 1):
                if w[i : i + len(p)] == p:
                    hit.update(range(i, i + len(p)))
                    found.add(str(item))
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        rows.append((doc, len(w), len(hit), len(found), digest, bool(hit) and 20 * len(hit) >= len(w)))
    return rows
