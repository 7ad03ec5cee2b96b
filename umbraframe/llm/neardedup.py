"""SimHash near-dedup with Golay-code keys.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits, each read as a word of the perfect binary Golay
code (23 bits, padded with zeros). Every 23-bit word lies within three bits of exactly one codeword. A segment's
list holds the codeword of the segment itself and those of all segments one bit away: one or six different ones.
Two segments that differ in two bits have a word between them, one bit from either, so their lists share its
codeword. If two fingerprints differ in two bits at most, then by the pigeonhole principle some segment is equal in both,
and the segment after it differs in two bits at most: its lists meet. A key is therefore an exact segment with one
codeword of the next segment's list, about 16 keys for each fingerprint.

Only different fingerprints get keys. The pairs of a bucket are verified. A hot key, one that over BUCKET fingerprints have,
is split: it is lengthened by each word that gave its codeword, i.e. by the fingerprint with at most one bit of the other
two segments turned. Fingerprints that differ in two bits at most have such a word in common under a key of both, and all that
share one lie within two bits, so the parts of a hot key hold 65 fingerprints at most and give the same links.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.llm.common import cut, map_batches, record_batch, texts_of, unused
from umbraframe.llm.components import components

SHINGLE, SEED, RADIUS = 3, 42, 2
#: Fingerprints of a key beyond which it is split.
BUCKET = 128
#: (first bit, bits) of each segment.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: The Golay code's generator, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101


def _remainder(word: int) -> int:
    for bit in range(22, 10, -1):
        if word >> bit & 1:
            word ^= GENERATOR << (bit - 11)
    return word


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The check bits of each 12 data bits, and the error of up to three bits behind each syndrome."""
    parity = np.array([_remainder(d << 11) for d in range(1 << 12)], np.int64)
    single = [_remainder(1 << b) for b in range(23)]
    errors = np.zeros(1 << 11, np.int64)
    for i in range(23):
        errors[single[i]] = 1 << i
        for j in range(i):
            errors[single[i] ^ single[j]] = 1 << i | 1 << j
            for k in range(j):
                errors[single[i] ^ single[j] ^ single[k]] = 1 << i | 1 << j | 1 << k
    return parity, errors


PARITY, ERRORS = _tables()


def codeword(words: np.ndarray) -> np.ndarray:
    """The index (data bits) of the codeword nearest to each 23-bit word."""
    return (words ^ ERRORS[(words & 0x7FF) ^ PARITY[words >> 11]]) >> 11


def codeword_lists(words: np.ndarray, bits: int) -> np.ndarray:
    """A row for each word: the codewords of the word and of all words one bit away; repeats are -1."""
    flips = np.array([0, *(1 << b for b in range(bits))], np.int64)
    out = np.sort(codeword(words[:, None] ^ flips), axis=1)
    out[:, 1:][out[:, 1:] == out[:, :-1]] = -1
    return out


def keys(fingerprints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place of the fingerprint, key) for all keys of int64 fingerprints."""
    words = fingerprints.view(np.uint64)
    segments = [((words >> np.uint64(a)) & np.uint64((1 << n) - 1)).astype(np.int64) for a, n in SEGMENTS]
    at, out = [], []
    for i in range(3):
        j = (i + 1) % 3
        lists = codeword_lists(segments[j], SEGMENTS[j][1])
        row, col = np.nonzero(lists >= 0)
        at.append(row)
        out.append(i << 34 | segments[i][row] << 12 | lists[row, col])
    return np.concatenate(at), np.concatenate(out)


def shingle_hashes(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Hashes of the lower-cased text's shingles, repeats included; a text of fewer words is one shingle, one without
    words has none."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    shingles = map(b" ".join, zip(*(words[k:] for k in range(size)))) if len(words) >= size else [b" ".join(words)]  # noqa: B905
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64)


def majority(hashes: np.ndarray) -> int:
    """64 bits; a bit is 1 if it is set in over half of the hashes. Without hashes all are 0."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[k : k + 4096].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: str | None) -> int:
    return majority(shingle_hashes(text))


def fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, mark, fp): the fingerprint as a signed long, and a hash of the text that tells rows of one id apart. Null and
    empty texts have the fingerprint 0."""

    def run(batches):
        for batch in batches:
            fps = np.array([fingerprint(t) for t in texts_of(batch)], np.uint64).view(np.int64)
            yield record_batch({"id": batch.column("id"), "mark": batch.column("mark"), "fp": pa.array(fps)})

    return map_batches(marked(documents, id_col, text_col), run, "id bigint, mark bigint, fp bigint")


def mark(text_col: str):
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def marked(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return documents.select(F.col(id_col).cast("bigint").alias("id"), mark(text_col).alias("mark"), F.col(text_col).alias("text"))


def _keyed(batches):
    for batch in batches:
        fps = batch.column("fp").to_numpy(zero_copy_only=False).astype(np.int64)
        at, key = keys(fps)
        for k in range(0, len(key), 100_000):
            yield record_batch({"key": pa.array(key[k : k + 100_000]), "fp": pa.array(fps[at[k : k + 100_000]])})


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count((a ^ b).view(np.uint64))


def _verified(batches):
    """Links that join what belongs together in a bucket; a link that follows from others may be left out."""
    for batch in batches:
        a: list[int] = []
        b: list[int] = []
        for bucket in batch.column("fps").to_pylist():
            fps = np.array(sorted(bucket), np.int64)
            left = np.arange(len(fps))
            while len(left) > 1:  # breadth first from the first fingerprint that is left
                front, left = left[:1], left[1:]
                while len(front) and len(left):
                    near = _distance(fps[left][:, None], fps[front][None, :]) <= RADIUS
                    linked = near.any(axis=1)
                    a += fps[left[linked]].tolist()
                    b += fps[front[near[linked].argmax(axis=1)]].tolist()
                    front, left = left[linked], left[~linked]
        yield record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})


def _lengthened(batches):
    """Rows (key, fp) of hot keys, each once for every word that gives the key's codeword: the fingerprint itself or with
    one bit of segment j turned, and where it gives the codeword itself, with one bit of segment k turned."""
    for batch in batches:
        key, fp = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("key", "fp"))
        words = fp.view(np.uint64)
        for i in range(3):
            (j_at, j_bits), (k_at, k_bits) = SEGMENTS[(i + 1) % 3], SEGMENTS[(i + 2) % 3]
            rows = np.flatnonzero(key >> 34 == i)
            if not len(rows):
                continue
            own = ((words[rows] >> np.uint64(j_at)) & np.uint64((1 << j_bits) - 1)).astype(np.int64)
            turns = np.array([0, *(1 << b for b in range(j_bits))], np.int64)
            gives = codeword(own[:, None] ^ turns) == (key[rows] & 0xFFF)[:, None]
            turned = np.concatenate([turns.astype(np.uint64) << np.uint64(j_at), np.uint64(1) << np.arange(k_at, k_at + k_bits, dtype=np.uint64)])
            row, turn = np.nonzero(np.concatenate([gives, np.repeat(gives[:, :1], k_bits, axis=1)], axis=1))
            word = (words[rows[row]] ^ turned[turn]).view(np.int64)
            for k in range(0, len(row), 100_000):
                some = rows[row[k : k + 100_000]]
                yield record_batch({"key": pa.array(key[some]), "word": pa.array(word[k : k + 100_000]), "fp": pa.array(fp[some])})


def links(distinct: DataFrame, bucket: int = BUCKET) -> DataFrame:
    """Links (a, b) between different fingerprints whose components are those of all links of RADIUS bits or less."""
    keyed = map_batches(distinct.select("fp"), _keyed, "key bigint, fp bigint")
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = keyed.join(sizes, "key")
    buckets = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list("fp").alias("fps"))
    close = map_batches(buckets.select("fps"), _verified, "a bigint, b bigint")
    split = map_batches(shared.where(F.col("n") > bucket).select("key", "fp"), _lengthened, "key bigint, word bigint, fp bigint")
    parts = split.groupBy("key", "word").agg(F.collect_list("fp").alias("fps")).where("size(fps) > 1")
    met = parts.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b")
    return close.unionByName(met).distinct()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, mark (a hash of the text), fp (signed long) and component_id: the smallest id reachable over fingerprints within
    RADIUS bits.

    Equal fingerprints are linked; so are all null, empty and blank texts (fingerprint 0). Rows of one id that have
    different texts are rows of their own: links are between fingerprints, so each gets the component of its own one.
    Repeated rows give repeated results. Other columns are ignored. An empty table gives no rows. Rows without an
    id have no result.
    """
    fps = cut(fingerprints(documents.where(F.col(id_col).isNotNull()), id_col, text_col))
    classes = cut(fps.groupBy("fp").agg(F.min("id").alias("rep")))
    roots = components(links(classes))
    rooted = cut(classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return fps.join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "mark", "fp", "component_id")


def near_duplicate_report(documents: DataFrame) -> DataFrame:
    out = near_duplicates(documents)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def first_of_each(documents: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each component of members (id, mark, component_id), with all its columns: the one with the smallest id,
    of rows that share this id the one with the smallest mark, and of rows that share the text too the one whose columns
    come first as JSON. Rows without an id stay, as they can't be told apart."""
    rows = members.groupBy("component_id", "id", "mark").agg(F.count(F.lit(1)).alias("n"))
    first = cut(rows.groupBy("component_id").agg(F.min(F.struct("id", "mark", "n")).alias("x")).select("x.*"))
    named = [unused(c, documents) for c in ("id", "mark", "n")]
    first = first.toDF(*named)
    own = (F.col(id_col).cast("bigint") == F.col(named[0])) & (mark(text_col) == F.col(named[1]))
    out, several = documents.join(first.where(F.col(named[2]) == 1), own, "left_semi"), first.where(F.col(named[2]) > 1)
    if not several.isEmpty():
        same = documents.join(several, own, "left_semi")
        whole = F.struct(*[F.col(f"`{c}`") for c in documents.columns])
        kept = same.groupBy(F.col(id_col).alias(named[0]), mark(text_col).alias(named[1])).agg(F.min_by(whole, F.to_json(whole)).alias(named[2]))
        out = out.unionByName(kept.select(f"{named[2]}.*"))
    return out.unionByName(documents.where(F.col(id_col).isNull()))


def keep_one_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of `near_duplicates`, as `first_of_each` chooses it."""
    return first_of_each(documents, near_duplicates(documents, id_col, text_col).withColumnRenamed(id_col, "id"), id_col, text_col)
