"""Document fingerprints: weighted SimHash of 128 bits, and permuted block tables that search them.

A term is a pair of neighbouring words (the first word also pairs with the text's beginning). Its hash votes on every
bit, for or against, with a weight that grows with the logarithm of the term's count and with its length, as short
pairs are the common ones. A bit is set if the votes for it win.

Search: with radius r the 128 bits are cut into r + 2 blocks. Two fingerprints within r bits are equal in two blocks at
least, so each pair of blocks has a table that is sorted, i.e. joined, by those two blocks.
"""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbraframe.llm.common import cut, map_batches, partitions_for, record_batch, texts_of

BITS, RADIUS = 128, 3
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprint(text: str) -> bytes:
    """16 bytes; a text without words has zeros."""
    words = text.encode("utf-8", "surrogatepass").split()
    if not words:
        return bytes(16)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    before = np.concatenate([np.zeros(1, np.uint64), h[:-1]])
    pairs, first, tf = np.unique(_mixed(before * _MULTIPLY + h), return_index=True, return_counts=True)
    length = sizes[first] + np.concatenate([np.zeros(1, np.int64), sizes[:-1]])[first]
    weight = (np.minimum(length, 24) * (1 + np.log2(tf).astype(np.int64))).astype(np.float32)
    votes = np.zeros(BITS, np.float64)
    for k in range(0, len(pairs), 8192):
        some = np.stack([pairs[k : k + 8192], _mixed(pairs[k : k + 8192] + _MULTIPLY)], axis=1).astype("<u8")
        ones = np.unpackbits(some.view(np.uint8), axis=1, bitorder="little")
        votes += weight[k : k + 8192] @ ones.astype(np.float32)
    return np.packbits(2 * votes > weight.sum(dtype=np.float64), bitorder="little").tobytes()


def likeness(a: bytes, b: bytes) -> float:
    """The share of equal bits."""
    return 1 - (int.from_bytes(a) ^ int.from_bytes(b)).bit_count() / BITS


def edited(text: str, following: str) -> str:
    """The last quarter of the code points gives way to the first as many of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


_COLUMNS = {"doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(), "near_edited": pa.float64(), "near_next": pa.float64()}
_EDGE = {"part": pa.int64(), "edge": pa.string(), "text": pa.string()}
_SQL = {pa.int64(): "bigint", pa.string(): "string", pa.float64(): "double"}


def _schema(columns: dict) -> str:
    return ", ".join(f"{n} {_SQL[t]}" for n, t in columns.items())


def _rows(rows: list[dict], columns: dict) -> pa.RecordBatch:
    return record_batch({n: pa.array([r.get(n) for r in rows], t) for n, t in columns.items()})


def _compared(doc: int | None, text: str, own: bytes, following: str, next_own: bytes) -> dict:
    other = edited(text, following)
    changed = fingerprint(other)
    return {
        "doc_id": doc, "n_chars": len(text), "edited_sha256": hashlib.sha256(other.encode("utf-8", "surrogatepass")).hexdigest(), "fingerprint": own.hex(),
        "edited_fingerprint": changed.hex(), "near_edited": likeness(own, changed), "near_next": likeness(own, next_own),
    }


def _in_order(batches):
    """Each document with the one that follows it in the partition; the partition's first and last one also go out
    with their texts, as their neighbours are elsewhere."""
    part, held, columns = TaskContext.get().partitionId(), None, _COLUMNS | _EDGE
    for batch in batches:
        out = []
        for doc, text in zip(batch.column("id").to_pylist(), texts_of(batch), strict=True):
            own = fingerprint(text)
            if held is None:
                out.append({"doc_id": doc, "part": part, "edge": "first", "text": text, "fingerprint": own.hex()})
            else:
                out.append(_compared(*held, text, own))
            held = (doc, text, own)
        yield _rows(out, columns)
    if held is not None:
        yield _rows([{"doc_id": held[0], "part": part, "edge": "last", "text": held[1], "fingerprint": held[2].hex()}], columns)


def _across(batches):
    for batch in batches:
        rows = [_compared(r["doc_id"], r["text"] or "", bytes.fromhex(r["fingerprint"]), r["next_text"] or "", bytes.fromhex(r["next_fingerprint"])) for r in batch.to_pylist()]
        yield _rows(rows, _COLUMNS)


def fingerprints_in_order(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of all texts and of their edited forms, with likenesses; the last document's next is the first.

    A null text counts as empty; rows without an id come first, repeated ids are ordered by text (null first); other columns
    are ignored; a single document is its own next one; an empty table gives no rows. One range shuffle puts the texts in order; only the texts at
    the edges of partitions, two for each partition, move again.
    """
    df = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    df = df.repartitionByRange(partitions_for(df.sparkSession), "id").sortWithinPartitions("id", "text")
    rows = cut(map_batches(df, _in_order, _schema(_COLUMNS | _EDGE)))
    firsts, lasts = rows.where("edge = 'first'"), rows.where("edge = 'last'")
    order = Window.orderBy("part")  # a row for each partition that has rows
    follow = firsts.select("part", F.lead("part").over(order).alias("following"), F.min("part").over(Window.partitionBy()).alias("front"))
    follow = follow.select("part", F.coalesce("following", "front").alias("following"))
    heads = firsts.select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_fingerprint"))
    pairs = lasts.select("doc_id", "text", "fingerprint", "part").join(follow, "part").join(heads, "following")
    ends = map_batches(pairs.select("doc_id", "text", "fingerprint", "next_text", "next_fingerprint"), _across, _schema(_COLUMNS))
    return rows.where("edge is null").select(*_COLUMNS).unionByName(ends)


def fingerprint_table(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, high, low): fingerprints as two longs."""

    def run(batches):
        for batch in batches:
            fps = np.frombuffer(b"".join([fingerprint(t) for t in texts_of(batch)]), ">i8").astype(np.int64).reshape(-1, 2)
            yield record_batch({"id": batch.column("id"), "high": pa.array(fps[:, 0]), "low": pa.array(fps[:, 1])})

    return map_batches(documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, "id bigint, high bigint, low bigint")


def _permuted(radius: int):
    blocks = radius + 2
    edges = [BITS * k // blocks for k in range(blocks + 1)]

    def run(batches):
        for batch in batches:
            high, low = (batch.column(c).to_pylist() for c in ("high", "low"))
            whole = [(h & (1 << 64) - 1) << 64 | (l & (1 << 64) - 1) for h, l in zip(high, low, strict=True)]
            for table, (a, b) in enumerate(combinations(range(blocks), 2)):
                (sa, na), (sb, nb) = ((edges[k], edges[k + 1] - edges[k]) for k in (a, b))
                lead = [((f >> sa & (1 << na) - 1) << nb | f >> sb & (1 << nb) - 1).to_bytes(16) for f in whole]
                yield record_batch({"block": pa.array([table] * len(lead), pa.int32()), "lead": pa.array(lead, pa.binary()), "high": batch.column("high"), "low": batch.column("low")})

    return run


def search(queries: DataFrame, fingerprints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """All pairs of a query fingerprint and a different stored one within `radius` bits, with their distance.

    Both frames have high and low; only different fingerprints meet, equal ones belong together by equality. The join
    on a table's two leading blocks gives candidates, the distance verifies them, and a pair found in several tables
    comes once.
    """
    schema = "block int, lead binary, high bigint, low bigint"
    asked = map_batches(queries.select("high", "low").distinct(), _permuted(radius), schema)
    stored = map_batches(fingerprints.select("high", "low").distinct(), _permuted(radius), schema)
    stored = stored.withColumnsRenamed({"high": "match_high", "low": "match_low"})
    distance = F.bit_count(F.col("high").bitwiseXOR(F.col("match_high"))) + F.bit_count(F.col("low").bitwiseXOR(F.col("match_low")))
    pairs = asked.join(stored, ["block", "lead"]).withColumn("distance", distance.cast("int")).where((F.col("distance") > 0) & (F.col("distance") <= radius))
    return pairs.select("high", "low", "match_high", "match_low", "distance").distinct()


def search_classes(documents: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Search for every document whose id is divisible by 20 against all documents: a row for each such document and each
    class of equal fingerprints within the radius, by the smallest id and the number of documents of that class, and the
    distance (0: the document's own class). Copies among the documents found are not expanded; a repeated query id comes once
    for each of its fingerprints. Rows without an id are not asked for, but are found and counted."""
    fps = cut(fingerprint_table(documents))
    classes = fps.groupBy("high", "low").agg(F.min("id").alias("match_id"), F.count(F.lit(1)).alias("n_docs"))
    asked = cut(fps.where("id % 20 = 0").select(F.col("id").alias("doc_id"), "high", "low").distinct())
    found = search(asked, classes, radius)
    own = asked.select("high", "low").distinct()
    found = found.unionByName(own.select("high", "low", F.col("high").alias("match_high"), F.col("low").alias("match_low"), F.lit(0).alias("distance")))
    named = classes.withColumnsRenamed({"high": "match_high", "low": "match_low"})
    return found.join(named, ["match_high", "match_low"]).join(asked, ["high", "low"]).select("doc_id", "match_id", "n_docs", "distance")
