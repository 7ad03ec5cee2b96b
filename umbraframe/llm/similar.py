"""Near-dedup by similarity: operator 2 for documents of which four fifths of the five-word shingles are shared.

A document is the set of the 64-bit hashes of its lower-cased five-word shingles. Documents with equal sets are one class.
Candidates come from two places. SimHash fingerprints of the shingles meet by their Golay-code keys, which finds all that
differ in two bits at most. At similarity 0.8 fingerprints differ in about ten bits of 64, which no such key reaches; so
candidates also share one of BANDS keys, each a hash of ROWS minhashes: a pair of similarity 0.8 shares none with a
probability of (1 - 0.8 ** ROWS) ** BANDS, two in a million. Each candidate pair, whichever way it came, is verified by the
Jaccard similarity of the whole sets, and components of the verified pairs are the groups.

Pairs are tried in two steps, so that a group of near copies costs a few pairs for each member and not all pairs. First every
class meets one class that shares a key with it: the most central one, whose keys are shared most. Then only buckets (the classes
of a key) that lie in several components are open, and only pairs across components are tried, as others can't join any. A bucket of
up to BUCKET members gives all its pairs. The classes of all larger ones are compared by prefixes: each puts its shingles in one order,
those that few of these classes have first, and two sets of similarity 0.8 have a shingle among the first fifth of either. Its places
also bound what can still follow in both, and pairs whose bound is too low are not similar. This is exact whatever the order, and
the order keeps a family's common passages at the end, so classes that are merely half alike hardly meet. Of the component with most
classes that have a shingle in their prefix, none meet each other.

A class that very many others meet is spread: its text goes to as many groups as SPREAD of them need.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from umbraframe.llm.common import cut, cut_round, map_batches, partitions_for, record_batch, release, texts_of
from umbraframe.llm.components import components
from umbraframe.llm.neardedup import first_of_each, links, majority, marked, shingle_hashes

SHINGLE, SIMILAR = 5, (4, 5)  # similarity as a fraction, 0.8
BANDS, ROWS = 25, 4
#: Members of a bucket up to which all its pairs are tried, and classes that meet one text in one group.
BUCKET, SPREAD = 2, 500
_A, _B = np.random.default_rng(5).integers(1 << 63, size=(2, BANDS * ROWS), dtype=np.uint64)
_A |= np.uint64(1)


def shingles(text: str | None) -> np.ndarray:
    """The set as sorted hashes; a text of fewer words is one shingle, a text without words has none."""
    return np.unique(shingle_hashes(text, SHINGLE))


def digest(own: np.ndarray) -> int:
    """What names a set: a signed long."""
    return int(np.uint64(xxhash.xxh64_intdigest(own.tobytes())).view(np.int64))


def keys(own: np.ndarray) -> np.ndarray:
    """The keys of a set, one for each band; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for k in range(0, len(own), 2048):
        x = own[k : k + 2048, None] * _A + _B
        least = np.minimum(least, (x ^ (x >> np.uint64(32))).min(axis=0))
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, ROWS))], np.uint64).view(np.int64)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return SIMILAR[1] * both >= SIMILAR[0] * (len(a) + len(b) - both)


def _signed(batches):
    for batch in batches:
        sets = [shingles(t) for t in texts_of(batch)]
        yield record_batch({
            "id": batch.column("id"), "mark": batch.column("mark"), "fp": pa.array([digest(s) for s in sets], pa.int64()), "n": pa.array([len(s) for s in sets], pa.int64()),
            "simhash": pa.array(np.array([majority(s) for s in sets], np.uint64).view(np.int64)), "keys": pa.array([keys(s) for s in sets], pa.list_(pa.int64())),
        })


def _packed(batches):
    """Texts of classes, compressed: they are shorter than their sets."""
    pack = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield record_batch({"fp": batch.column("fp"), "own": pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts_of(batch)], pa.binary())})


def _verified(batches):
    """Pairs (a, b) that are similar; rows of one b mostly come one after the other."""
    unpack = zstandard.ZstdDecompressor()
    set_of = lambda x: shingles(unpack.decompress(x).decode("utf-8", "surrogatepass"))
    last, held = None, np.zeros(0, np.uint64)
    for batch in batches:
        found = []
        for b, own, other in zip(*(batch.column(c).to_pylist() for c in ("b", "own", "other")), strict=True):
            if b != last:
                last, held = b, set_of(other)
            found.append(similar(set_of(own), held))
        yield batch.select(["a", "b"]).filter(pa.array(found, pa.bool_()))


def _listed(batches):
    """A row (fp, root, n, shingle) for each shingle of a class."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for fp, own, root in zip(*(batch.column(c).to_pylist() for c in ("fp", "own", "root")), strict=True):
            own = shingles(unpack.decompress(own).decode("utf-8", "surrogatepass")).view(np.int64)
            for k in range(0, len(own), 100_000):
                some = own[k : k + 100_000]
                yield record_batch({c: pa.array(np.full(len(some), x)) for c, x in (("fp", fp), ("root", root), ("n", len(own)))} | {"shingle": pa.array(some)})


def _golay_pairs(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of classes whose SimHash fingerprints are linked by their Golay keys, or are equal; one class stands for
    all of a fingerprint."""
    stands = cut(classes.where("n > 0").groupBy("simhash").agg(F.min("fp").alias("fp")))
    left, right = stands.select(F.col("simhash").alias("a"), F.col("fp").alias("x")), stands.select(F.col("simhash").alias("b"), F.col("fp").alias("y"))
    linked = links(stands.select(F.col("simhash").alias("fp"))).join(left, "a").join(right, "b").select("x", "y")
    equal = classes.where("n > 0").select("simhash", F.col("fp").alias("x")).join(stands.withColumnRenamed("fp", "y"), "simhash").select("x", "y")
    return linked.unionByName(equal).where("x <> y").toDF("a", "b")


def _near_sizes(n: str, other: str):
    return F.least(n, other) * SIMILAR[1] >= F.greatest(n, other) * SIMILAR[0]


def _central_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b): each class with the most central one of near size that shares a key with it. Near copies often have all keys
    of their original; of equally central ones the earliest counts, by rep."""
    weighed = members.join(members.groupBy("fp").agg(F.sum("size").alias("weight")), "fp")
    most = weighed.groupBy("key").agg(F.max(F.struct("weight", F.bitwise_not("rep"), "fp", "n")).alias("b"))
    met = members.join(most, "key").where((F.col("fp") != F.col("b.fp")) & _near_sizes("n", "b.n"))
    return met.groupBy(F.col("fp").alias("a")).agg(F.max("b").alias("b")).select("a", "b.fp").toDF("a", "b")


def _bucket_pairs(members: DataFrame) -> DataFrame:
    """Pairs (a, b) of near size across components, of members (key, fp, n, root) of small buckets."""
    other = members.toDF("key", "b", "bn", "broot")
    met = members.join(other, "key").where((F.col("fp") > F.col("b")) & (F.col("root") != F.col("broot")) & _near_sizes("n", "bn"))
    return met.select(F.col("fp").alias("a"), "b")


def _prefix_pairs(some: DataFrame, packed: DataFrame) -> DataFrame:
    """Pairs (a, b) across components among the classes (fp, root): all that are similar, and few that are not."""
    listed = map_batches(packed.join(some, "fp"), _listed, "fp bigint, root bigint, n bigint, shingle bigint")
    shared = listed.groupBy("shingle").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    # Shingles of one class come first in the order; nothing meets there, so they only shift the places of the others.
    own = Window.partitionBy("fp")
    at = F.col("n") - F.count(F.lit(1)).over(own) + F.row_number().over(own.orderBy("df", "shingle")) - 1
    placed = listed.join(shared, "shingle").withColumn("left", F.col("n") - at)
    prefix = cut_round(placed.where(F.col("left") * SIMILAR[1] >= F.col("n") * SIMILAR[0]).select("shingle", "fp", "root", "n", "left"))
    roots = prefix.groupBy("shingle", "root").agg(F.count(F.lit(1)).alias("classes"))
    roots = roots.groupBy("shingle").agg(F.max(F.struct("classes", "root")).alias("most"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    met = cut_round(prefix.join(roots.select("shingle", F.col("most.root").alias("most")), "shingle"))
    other = met.where("root <> most").select("shingle", F.col("fp").alias("b"), F.col("root").alias("broot"), F.col("n").alias("bn"), F.col("left").alias("bleft"))
    # Similar sets have SIMILAR / (1 + SIMILAR) of both sizes together in common, and no more than is left of either.
    enough = F.least("left", "bleft") * sum(SIMILAR) >= (F.col("n") + F.col("bn")) * SIMILAR[0]
    met = met.join(other, "shingle").where((F.col("root") != F.col("broot")) & enough)
    return met.select(F.greatest("fp", "b").alias("a"), F.least("fp", "b").alias("b"))


def _similar_pairs(pairs: DataFrame, packed: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) that are similar; the ones that meet one b are spread over groups."""
    groups = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / SPREAD).alias("groups"))
    spread = pairs.join(groups.where("groups > 1"), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("groups", F.lit(1))).alias("share"))
    left = spread.join(packed.withColumnRenamed("fp", "a"), "a")
    right = groups.join(packed.toDF("b", "other"), "b").select("b", "other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("groups") - 1)).alias("share"))
    return map_batches(left.join(right, ["b", "share"]).select("a", "b", "own", "other"), _verified, "a bigint, b bigint")


def similar_groups(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET) -> DataFrame:
    """id, mark (a hash of the text) and component_id: the smallest id reachable over documents that are similar. Texts
    without words are one group; rows of one id that have different texts are rows of their own; repeated rows give repeated
    results; rows without an id have no result."""
    spark, texts = documents.sparkSession, marked(documents.where(F.col(id_col).isNotNull()), id_col, text_col)
    signed = cut(map_batches(texts, _signed, "id bigint, mark bigint, fp bigint, n bigint, simhash bigint, keys array<bigint>"))
    one = F.min_by(F.struct("mark", "n", "simhash", "keys"), F.struct("id", "mark"))
    classes = cut(signed.groupBy("fp").agg(F.min("id").alias("rep"), one.alias("one")).select("fp", "rep", "one.*"))
    keyed = classes.select("fp", "rep", "n", F.explode("keys").alias("key"))
    sizes = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = cut_round(keyed.join(sizes, "key").select("key", "fp", "rep", "n", "size"))
    pairs = cut_round(_central_pairs(members).unionByName(_golay_pairs(classes)).distinct())
    asked = members.select("fp").unionAll(pairs.select("a")).unionAll(pairs.select("b")).distinct()
    asked = classes.select("fp", F.col("rep").alias("id"), "mark").join(asked, "fp")
    wanted = texts.join(asked, ["id", "mark"]).dropDuplicates(["id", "mark"]).select("fp", "text")
    packed = cut(map_batches(wanted, _packed, "fp bigint, own binary").repartition(partitions_for(spark), "fp"))
    edges = cut_round(_similar_pairs(pairs, packed))
    release(spark)
    roots = components(edges)
    members = members.join(roots, F.col("fp") == F.col("node"), "left").select("key", "fp", "n", F.coalesce("root", "fp").alias("root"), "size")
    several = members.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    members = cut_round(members.join(several.select("key"), "key"))
    some = cut_round(members.where(F.col("size") > bucket).select("fp", "root").distinct())
    pairs = _bucket_pairs(members.where(F.col("size") <= bucket).drop("size")).unionByName(_prefix_pairs(some, packed))
    edges = cut_round(edges.unionByName(_similar_pairs(cut_round(pairs.distinct()), packed)))
    release(spark)
    roots = components(edges)
    rooted = cut(classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("root", "fp").alias("root")))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return signed.select("id", "mark", "fp").join(rooted.join(least, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "mark", "component_id")


def keep_one_each(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each group, as `first_of_each` chooses it; rows without an id stay."""
    return first_of_each(documents, similar_groups(documents, id_col, text_col).withColumnRenamed(id_col, "id"), id_col, text_col)
