"""Substring dedup by window hashes under anchors, in place of a relative Lempel-Ziv parse.

A document's factors are its runs of words whose windows of WINDOW words all start earlier somewhere (in a document of
smaller id, or earlier in itself). At a factor's boundaries each window is looked up by itself, so a duplicate that begins
inside one factor and ends in the next is found too. Words covered by a factor are duplicates. The parse itself was exchanged:
a greedy parse against every reference block passes over all text once for each block, so its time grows with the square
of the corpus; here the blocks are keyed by content, and a window meets only the one block that can hold it.

A window's anchor is the least of its GRAM-word sequences, by hash, with hot ones last: equal windows have equal anchors, so
one shuffle by anchor brings all places of a window to one block, and about one row in eight words is enough, as
consecutive windows mostly share their anchor. A hot sequence holds more than one in HOT_SHARE of all places (counted
over all documents first; there can't be more than HOT_SHARE of them, which bounds the broadcast). It is the anchor only of windows that have
nothing else: those lie within a passage that is frequent as a whole. Windows that merely touch a frequent line go
to where the words around it lead, so no line gathers the texts around its places.

A row carries the 64-bit hashes of its windows beside the 64-bit anchor. A block is a sorted stream: windows of an anchor
seen before are duplicates, so that neither a document nor a group of copies is ever held as a whole. Two different windows
of one anchor are taken for one with a probability of 2 ** -64, so n of them give n ** 2 / 2 ** 65 false repeats; hot
anchors, where n would be large, have few different windows.

Windows that repeat within an Arrow batch are settled before the shuffle: a passage that a third of all documents share
goes out once a batch.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.llm.common import cut, map_batches, partitions_for, record_batch, texts_of
from umbraframe.llm.neardedup import marked

WINDOW, GRAM = 20, 6
SPAN = WINDOW - GRAM + 1  # sequences in a window; at most as many windows share an anchor's place
#: Places among which a hot sequence has more than one, and so the most hot sequences that there can be.
HOT_SHARE = 50_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
_HASH = 8  # bytes of a window's hash beside its anchor


def words_of(text: str | None) -> list[bytes]:
    """Words `[^\\x20\\x09-\\x0D]+`, unchanged; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all n consecutive words, put together from halves."""
    if n == 1:
        return h
    half = _rolled(h, n // 2)
    pair = half[: len(h) - 2 * (n // 2) + 1] * _power(n // 2) + half[n // 2 :][: len(h) - 2 * (n // 2) + 1]
    return pair if n % 2 == 0 else pair[: len(h) - n + 1] * _BASE + h[n - 1 :]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts that have a window, and the number of words of each text (0 without a window)."""
    hashes, counts = [np.zeros(0, np.uint64)], []
    for t in texts:
        w = words_of(t)
        if len(w) >= WINDOW:
            hashes.append(np.fromiter(map(xxhash.xxh64_intdigest, w), np.uint64, len(w)))
        counts.append(len(w) if len(w) >= WINDOW else 0)
    return np.concatenate(hashes), np.array(counts, np.int64)


def _frequent(batches):
    """Places of sequences, all (null) and of those that a batch has often; what is hot overall is frequent in batches."""
    for batch in batches:
        h, counts = _word_hashes(texts_of(batch))
        if len(h):
            grams, n = np.unique(_mixed(_rolled(h, GRAM)), return_counts=True)
            often = n >= max(4, len(counts) // 256)
            yield record_batch({"gram": pa.array([None, *grams[often].view(np.int64).tolist()], pa.int64()), "n": pa.array([len(h), *n[often].tolist()], pa.int64())})


def hot_sequences(texts: DataFrame) -> np.ndarray:
    """Sorted hashes of the sequences that hold more than one in HOT_SHARE of all places."""
    counts = cut(map_batches(texts, _frequent, "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n")))
    places = next((r.n for r in counts.where("gram is null").collect()), 0)
    hot = counts.where(F.col("gram").isNotNull() & (F.col("n") * HOT_SHARE > places)).select("gram").collect()
    return np.sort(np.array([r.gram for r in hot], np.int64).view(np.uint64))


def _ranked(grams: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """What sequences are compared by: their hashes, hot ones behind all others."""
    last = np.zeros(len(grams), np.uint64)
    if len(hot):
        last = (hot[np.minimum(np.searchsorted(hot, grams), len(hot) - 1)] == grams).astype(np.uint64)
    return grams >> np.uint64(1) | last << np.uint64(63)


def _windows(rows: np.ndarray, texts: list[str], hot: np.ndarray) -> dict[str, np.ndarray] | None:
    """All windows of some texts, in order of text and start: row (what `rows` says of the text), start, hash, anchor, place of
    the anchor."""
    h, counts = _word_hashes(texts)
    if not len(h):
        return None
    has = counts > 0
    begins, lengths = np.concatenate([[0], np.cumsum(counts[has])[:-1]]), counts[has] - WINDOW + 1
    first = np.cumsum(lengths) - lengths
    at = np.arange(lengths.sum()) - np.repeat(first - begins, lengths)  # place of each window's first word
    whole = _mixed(_rolled(h, WINDOW))[at]
    grams = _ranked(_mixed(_rolled(h, GRAM)), hot)
    low, size = grams, 1
    while size * 2 <= SPAN:
        low, size = np.minimum(low[: len(low) - size], low[size:]), size * 2
    low = np.minimum(low[: len(grams) - SPAN + 1], low[SPAN - size :][: len(grams) - SPAN + 1])[at]
    place = np.zeros(len(at), np.int64)
    for k in range(SPAN - 1, -1, -1):
        place[grams[at + k] == low] = k
    return {"row": np.repeat(rows[has], lengths), "start": at - np.repeat(begins, lengths), "hash": whole, "anchor": low, "place": at + place}


def _repeats(key: np.ndarray, place: tuple[np.ndarray, ...], group: np.ndarray | None = None) -> np.ndarray:
    """Which windows have an equal one (of their group) at another, earlier place; they come in order of their places."""
    order = np.argsort(key, kind="stable") if group is None else np.lexsort((key, group))
    k = key[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    if group is not None:
        new[1:] |= group[order][1:] != group[order][:-1]
    first = order[np.flatnonzero(new)][np.cumsum(new) - 1]
    out = np.zeros(len(key), bool)
    out[order] = np.logical_or.reduce([x[order] != x[first] for x in place])
    return out


def _emit(hot):
    def run(batches):
        """A row for each anchor place: anchor, id and mark, start of its first window with a mask of the windows whose
        hashes follow and one of those known to be duplicates, and the hashes."""
        for batch in batches:
            ids, marks = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("id", "mark"))
            texts, order = texts_of(batch), np.lexsort((marks, ids))
            w = _windows(order, [texts[k] for k in order], hot.value)
            if w is None:
                continue
            doc, mark = ids[w["row"]], marks[w["row"]]
            known = _repeats(w["hash"], (doc, mark, w["start"]))
            # A row of the batch begins where the anchor's place changes, or the text.
            head = np.concatenate([[True], (np.diff(w["place"]) != 0) | (np.diff(w["start"]) != 1)])
            heads = np.flatnonzero(head)
            bit = np.int64(1) << (np.arange(len(head)) - heads[np.cumsum(head) - 1])
            sent, done = np.add.reduceat(np.where(known, 0, bit), heads), np.add.reduceat(np.where(known, bit, 0), heads)
            raw = w["hash"][~known].astype("<u8")
            n = np.add.reduceat((~known).astype(np.int64), heads)
            ends = np.concatenate([[0], np.cumsum(n * _HASH)]).astype("<i4")
            data = pa.BinaryArray.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(raw.tobytes())])
            # A row without hashes only carries marks on; it goes anywhere, so that settled copies don't pile up.
            anchor = np.where(sent > 0, w["anchor"][heads], _mixed(doc[heads].astype(np.uint64) * _BASE + w["start"][heads].astype(np.uint64)))
            place = w["start"][heads] << 32 | sent << 16 | done
            yield record_batch({"anchor": pa.array(anchor.view(np.int64)), "doc": pa.array(doc[heads]), "mark": pa.array(mark[heads]), "place": pa.array(place), "hashes": data})

    return run


def _bits(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bit) of the set bits, in order."""
    return np.nonzero((mask[:, None] >> np.arange(SPAN)) & 1)


def _settle(batches):
    """Rows come sorted by anchor, id, mark and start; gives id, mark and start << 16 | mask of duplicate windows."""
    none = (np.zeros(0, np.int64),) * 3
    held_anchor, held, held_place = None, np.zeros(0, np.uint64), none  # the last anchor so far and the windows seen under it
    for batch in batches:
        anchor, doc, mark, place = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "doc", "mark", "place"))
        if not len(anchor):
            continue
        start, sent, done = place >> 32, (place >> 16) & 0xFFFF, (place & 0xFFFF).copy()
        column = batch.column("hashes")
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        ends = np.frombuffer(column.buffers()[1], "<i4")[column.offset : column.offset + len(column) + 1]
        data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].reshape(-1, _HASH)
        row, bit = _bits(sent)
        new = np.concatenate([[True], anchor[1:] != anchor[:-1]])
        group = np.cumsum(new) - 1
        alone = new & np.concatenate([new[1:], [False]])  # the last anchor may go on
        alone[0] &= anchor[0] != held_anchor
        some = ~alone[row]
        row, bit, data = row[some], bit[some], data[some]
        if len(row):
            key, of, at = np.ascontiguousarray(data).view("<u8").reshape(-1), group[row], (doc[row], mark[row], start[row] + bit)
            if anchor[0] == held_anchor:  # what was seen before this batch comes first
                key, at = np.concatenate([held, key]), tuple(map(np.concatenate, zip(held_place, at, strict=True)))
                of = np.concatenate([np.zeros(len(held), of.dtype), of])
            found = _repeats(key, at, of)
            last = of == group[-1]
            own = found[len(found) - len(row) :]
            np.bitwise_or.at(done, row[own], np.int64(1) << bit[own])
            held, first = np.unique(key[last], return_index=True)
            held_place = tuple(x[last][first] for x in at)
        elif anchor[-1] != held_anchor:
            held, held_place = np.zeros(0, np.uint64), none
        held_anchor = anchor[-1]
        hit = np.flatnonzero(done)
        if len(hit):
            yield record_batch({"doc": pa.array(doc[hit]), "mark": pa.array(mark[hit]), "repeats": pa.array(start[hit] << 16 | done[hit])})


def _factors(n: int, marks: list[int] | None) -> list[tuple[int, int]]:
    """Merged word ranges [start, end) that duplicate windows cover."""
    if not marks or n < WINDOW:
        return []
    m = np.array(marks, np.int64)
    row, bit = _bits(m & 0xFFFF)
    starts = np.unique((m >> 16)[row] + bit)
    starts = starts[starts <= n - WINDOW]
    if not len(starts):
        return []
    cut = np.flatnonzero(np.diff(starts) > WINDOW)
    heads, tails = np.concatenate([[0], cut + 1]), np.concatenate([cut, [len(starts) - 1]])
    return list(zip(starts[heads].tolist(), (starts[tails] + WINDOW).tolist(), strict=True))


def _packed(batches):
    """Texts as they move to their marks: compressed, as they are most of what moves."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        packed = [pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts_of(batch)]
        yield record_batch({"id": batch.column("id"), "mark": batch.column("mark"), "packed": pa.array(packed, pa.binary())})


def _kept(batches):
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        kept, sizes, removed, spans = [], [], [], []
        for packed, marks in zip(batch.column("packed").to_pylist(), batch.column("repeats").to_pylist(), strict=True):
            words = unpack.decompress(packed).split()
            factors = _factors(len(words), marks)
            left, at = [], 0
            for a, b in factors:
                left += words[at:a]
                at = b
            left += words[at:]
            kept.append(b" ".join(left).decode("utf-8", "replace"))
            sizes.append(len(words))
            removed.append(len(words) - len(left))
            spans.append([{"start": a, "end": b} for a, b in factors])
        yield record_batch({"id": batch.column("id"), "n_words": pa.array(sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": pa.array(kept, pa.string()), "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))})


def _told_apart(df: DataFrame) -> DataFrame:
    """(id, mark, text) with mark 0 where an id has one text only, as nearly all do: then the mark costs a shuffle nothing."""
    marks = df.where("id is not null").groupBy("id").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    several = cut(marks.where("low <> high").select(F.col("id").alias("own")))
    if several.isEmpty():
        return df.withColumn("mark", F.lit(0).cast("bigint"))
    own = F.when(F.col("own").isNull(), F.lit(0)).otherwise(F.col("mark"))
    return df.join(several, F.col("id") == F.col("own"), "left").select("id", own.cast("bigint").alias("mark"), "text")


def remove_repeats(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, n_words, n_removed, kept (words joined by a space) and spans (word ranges).

    A null text has no words. A repeated row (same id, same text) isn't a place of its own: it starts neither earlier nor later
    than the row that it repeats, and both get the same result. Rows of one id with different texts are documents
    of their own, in the order of a hash of their texts. A row without an id has no place among the others: nothing is
    removed from it, and it makes nothing a repeat. Other columns are ignored.
    """
    df = _told_apart(marked(documents, id_col, text_col))
    placed = df.where("id is not null")
    hot = df.sparkSession.sparkContext.broadcast(hot_sequences(placed.select("text")))  # at most HOT_SHARE hashes
    rows = map_batches(placed, _emit(hot), "anchor bigint, doc bigint, mark bigint, place bigint, hashes binary")
    rows = rows.repartition(partitions_for(df.sparkSession), "anchor").sortWithinPartitions("anchor", "doc", "mark", "place")
    found = map_batches(rows, _settle, "doc bigint, mark bigint, repeats bigint").groupBy(F.col("doc").alias("own_id"), F.col("mark").alias("own_mark")).agg(F.collect_list("repeats").alias("repeats"))
    texts = map_batches(df, _packed, "id bigint, mark bigint, packed binary")
    joined = texts.join(found, (F.col("id") == F.col("own_id")) & (F.col("mark") == F.col("own_mark")), "left").select("id", "packed", "repeats")
    out = map_batches(joined, _kept, "id bigint, n_words bigint, n_removed bigint, kept string, spans array<struct<start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def repeats_report(documents: DataFrame) -> DataFrame:
    out = remove_repeats(documents)
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(documents: list[tuple], order=lambda row: row[0]) -> list[tuple]:
    """The same rows from a dictionary of all windows, for tests; rows are (id, text), and `order` says which come first."""
    first: dict[tuple, tuple] = {}
    split = [(d, order((d, t)), words_of(t)) for d, t in documents]
    for d, at, w in split:
        for s in range(len(w) - WINDOW + 1 if d is not None else 0):
            key = tuple(w[s : s + WINDOW])
            first[key] = min(first.get(key, (at, s)), (at, s))
    rows = []
    for d, at, w in split:
        gone: set[int] = set()
        for s in range(len(w) - WINDOW + 1 if d is not None else 0):
            if first[tuple(w[s : s + WINDOW])] < (at, s):
                gone.update(range(s, s + WINDOW))
        left = b" ".join(x for k, x in enumerate(w) if k not in gone)
        rows.append((d, len(w), len(gone), hashlib.sha256(left).hexdigest()))
    return rows
