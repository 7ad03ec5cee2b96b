"""Token ids in files of compressed bit or byte planes.

A file holds the ids of consecutive documents. Its ids are cut into blocks of BLOCK ids; a block is transposed into
planes (all lowest bytes, then all second bytes, ...; or all lowest bits, ...), each compressed by itself with
zstandard. The chunk index has the place and length of every plane, so any range of ids can be read alone; a plane of
zeros takes no bytes. Layout, all little-endian:

    "UFTP", u32 version, u32 kind (0 byte planes, 1 bit planes), u32 planes, u32 ids in a block, u32 blocks,
    u64 ids, u64 documents; i64 document ids; u64 starts (documents + 1); u64 plane ends (blocks x planes); planes

Files are rows of a Parquet table in a folder that all executors share, so a lost task writes its own files again
and only complete tables are seen; `export_files` writes them out one by one.
"""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import zlib
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbraframe.llm.common import held, map_batches, partitions_for, record_batch, texts_of

MAGIC, VERSION = b"UFTP", 1
HEAD = struct.Struct("<4sIIIIIQQ")
BLOCK = 1 << 16
#: Ids after which a file ends; a single longer document still stays in one file.
FILE_IDS = 1 << 21
CACHE_WORDS = 400_000
#: Marks that compose with an ASCII letter.
_MARKS = re.compile("[\u0300-\u036f]")


def _byte_alphabet() -> dict[int, int]:
    """Byte-level models write a visible Latin-1 byte as itself and the others, in order, from code point 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_ALPHABET = _byte_alphabet()


def to_planes(ids: np.ndarray, planes: int, bits: bool) -> list[bytes]:
    """The planes of a block; an all-zero plane is empty."""
    if bits:
        out = [np.packbits((ids >> np.uint32(k)) & np.uint32(1), bitorder="little") for k in range(planes)]
    else:
        out = list(np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T[:planes]))
    return [p.tobytes() if p.any() else b"" for p in out]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if bits:
        ids = np.zeros(n, "<u4")
        for k, p in enumerate(planes):
            if p:
                ids |= np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little").astype("<u4") << np.uint32(k)
        return ids
    raw = np.zeros((n, 4), np.uint8)
    for k, p in enumerate(planes):
        if p:
            raw[:, k] = np.frombuffer(p, np.uint8)
    return raw.reshape(-1).view("<u4")


def pack(doc_ids: list[int], lengths: list[int], ids: np.ndarray, bits: bool = False, block: int = BLOCK, level: int = 3) -> bytes:
    """A file's bytes."""
    top = int(ids.max()) if len(ids) else 0
    planes = max(1, top.bit_length() if bits else -(-top.bit_length() // 8))
    packer, data, ends, at = zstandard.ZstdCompressor(level=level), [], [], 0
    for start in range(0, len(ids), block):
        for plane in to_planes(ids[start : start + block], planes, bits):
            data.append(packer.compress(plane) if plane else b"")
            at += len(data[-1])
            ends.append(at)
    starts = np.concatenate([[0], np.cumsum(lengths, dtype="<u8")]).astype("<u8")
    head = HEAD.pack(MAGIC, VERSION, int(bits), planes, block, -(-len(ids) // block), len(ids), len(doc_ids))
    return b"".join([head, np.array(doc_ids, "<i8").tobytes(), starts.tobytes(), np.array(ends, "<u8").tobytes(), *data])


class TokenFile:
    """Reads a file's bytes, any range of ids at a time."""

    def __init__(self, content: bytes):
        magic, version, bits, self.planes, self.block, blocks, self.n_ids, n_docs = HEAD.unpack_from(content)
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a token file of this version")
        at = HEAD.size
        self.bits = bool(bits)
        self.doc_ids = np.frombuffer(content, "<i8", n_docs, at)
        self.starts = np.frombuffer(content, "<u8", n_docs + 1, at := at + 8 * n_docs).astype(np.int64)
        ends = np.frombuffer(content, "<u8", blocks * self.planes, at := at + 8 * (n_docs + 1)).astype(np.int64)
        self._at = np.concatenate([[0], ends]) + at + 8 * blocks * self.planes
        self._content, self._unpacker = memoryview(content), zstandard.ZstdDecompressor()

    def read_block(self, k: int) -> np.ndarray:
        n = min(self.block, self.n_ids - k * self.block)
        cuts = self._at[k * self.planes : (k + 1) * self.planes + 1]
        planes = [self._unpacker.decompress(self._content[a:b]) if b > a else b"" for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        return from_planes(planes, n, self.bits)

    def read(self, start: int, end: int) -> np.ndarray:
        if end <= start:
            return np.zeros(0, "<u4")
        first = start // self.block
        blocks = [self.read_block(k) for k in range(first, -(-end // self.block))]
        return np.concatenate(blocks)[start - first * self.block : end - first * self.block]

    def documents(self) -> Iterator[tuple[int, int, np.ndarray]]:
        """(document id, start in the file, ids); each block is unpacked once."""
        have, have_from, next_block = np.zeros(0, "<u4"), 0, 0
        for doc, start, end in zip(self.doc_ids.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True):
            if have_from + len(have) < end:
                parts, upto = [have[start - have_from :]], have_from + len(have)
                have_from = start
                while upto < end:
                    parts.append(self.read_block(next_block))
                    upto += len(parts[-1])
                    next_block += 1
                have = np.concatenate(parts)
            yield doc, start, have[start - have_from : end - have_from]


class _Known(dict):
    """Ids by word. A word that ends in punctuation is put together from what stands before it and the punctuation,
    as the splitter always cuts between a letter and a run of such signs. A full cache keeps its older half: words
    that are frequent come early."""

    def __init__(self, library):
        super().__init__()
        self.library = library

    def __missing__(self, word: bytes) -> bytes:
        core = word.rstrip(b".,;:!?")
        if len(core) < len(word) and core and core.decode("utf-8", "replace")[-1].lower()[-1].isalpha():
            ids = self[core] + self[word[len(core) :]]
        else:
            ids = array("I", self._by_library(word)).tobytes()
        if len(self) >= CACHE_WORDS:
            for old in list(islice(self, CACHE_WORDS // 2, None)):
                del self[old]
        if len(word) <= 64:
            self[word] = ids
        return ids


    def _by_library(self, word: bytes) -> list[int]:
        """A word of lower-case letters is one piece that the normaliser leaves alone: the model takes it as it is, byte
        by byte in the alphabet of byte-level models. Any other word goes the whole way."""
        text = word.decode("utf-8", "replace")
        if text.isalpha() and text == text.lower() and unicodedata.is_normalized("NFC", text):
            return [t.id for t in self.library.model.tokenize(word.decode("latin-1").translate(_ALPHABET))]
        return self.library.encode_batch_fast([text], add_special_tokens=False)[0].ids


class WordTokenizer:
    """The library's tokenizer with a cache by word.

    The vocabulary's normaliser and splitter never look across white space, so the ids of a text are those of its
    words, one after the other. A-Z are lower-cased first, as the normaliser does it later on, unless the text has
    marks that could be composed with a letter before that.
    """

    def __init__(self, file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.known = _Known(Tokenizer.from_file(file))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian uint32 ids of each text."""
        out, ids_of = [], self.known.__getitem__
        for text in texts:
            raw = text.encode("utf-8", "surrogatepass")
            if text.isascii() or not _MARKS.search(text):
                raw = raw.lower()
            out.append(b"".join(map(ids_of, raw.split())))
        return out


def word_tokenizer(file: str) -> WordTokenizer:
    return held(("words", file), lambda: WordTokenizer(file))


def default_tokenizer() -> tuple[str, int]:
    """The vocabulary file and the id that ends a document."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json"), 2


FILES = "part bigint, file bigint, first_doc bigint, n_docs bigint, n_ids bigint, content binary"


def _write_part(tokenizer: str, end_id: int, bits: bool, file_ids: int):
    end = np.array([end_id], "<u4").tobytes()

    def file_row(part: int, file: int, docs: list[int], lengths: list[int], raw: list[bytes]) -> pa.RecordBatch:
        ids = np.frombuffer(b"".join(raw), "<u4")
        values = (part, file, docs[0], len(docs), len(ids))
        return record_batch({n: pa.array([v], pa.int64()) for n, v in zip(("part", "file", "first_doc", "n_docs", "n_ids"), values, strict=True)} | {"content": pa.array([pack(docs, lengths, ids, bits)], pa.binary())})

    def run(batches):
        part, file, docs, lengths, raw, held = TaskContext.get().partitionId(), 0, [], [], [], 0
        for batch in batches:
            for doc, ids in zip(batch.column("id").to_pylist(), word_tokenizer(tokenizer).encode(texts_of(batch)), strict=True):
                n = len(ids) // 4 + 1
                if docs and held + n > file_ids:
                    yield file_row(part, file, docs, lengths, raw)
                    file, docs, lengths, raw, held = file + 1, [], [], [], 0
                docs.append(doc)
                lengths.append(n)
                raw += (ids, end)
                held += n
        if docs:
            yield file_row(part, file, docs, lengths, raw)

    return run


def write_token_files(documents: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, int] | None = None, bits: bool = False, file_ids: int = FILE_IDS) -> None:
    """Encodes all documents in ascending order of id (repeated ids: by text) and writes the table of files.

    A null text counts as empty: it has the end id alone. Rows without an id come first.
    """
    file, end_id = tokenizer or default_tokenizer()
    df = documents.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text"))
    df = df.repartitionByRange(partitions_for(df.sparkSession), "id").sortWithinPartitions("id", "text")
    files = map_batches(df, _write_part(file, end_id, bits, file_ids), FILES)
    files.write.option("compression", "uncompressed").option("parquet.block.size", 16 << 20).mode("overwrite").parquet(path)


def read_token_files(spark: SparkSession, path: str) -> DataFrame:
    """One row for each document: part, file, doc_id, its start in the file, n_tokens, crc32 of the ids."""

    def run(batches):
        for batch in batches:
            for part, file, content in zip(*(batch.column(c).to_pylist() for c in ("part", "file", "content")), strict=True):
                rows = [(d, s, len(ids), zlib.crc32(ids.tobytes())) for d, s, ids in TokenFile(content).documents()]
                d, s, n, c = zip(*rows, strict=True) if rows else ((), (), (), ())
                yield record_batch({k: pa.array(v, pa.int64()) for k, v in {"part": [part] * len(d), "file": [file] * len(d), "doc_id": d, "start_in_file": s, "n_tokens": n, "ids_crc32": c}.items()})

    files = spark.read.schema(FILES).parquet(path).select("part", "file", "content")
    return map_batches(files, run, "part bigint, file bigint, doc_id bigint, start_in_file bigint, n_tokens bigint, ids_crc32 bigint")


def file_bases(spark: SparkSession, path: str) -> DataFrame:
    """The number of ids before each file: sums by part first, so that no window holds more rows than there are
    parts, or files in one part."""
    sizes = spark.read.schema(FILES).parquet(path).select("part", "file", "n_ids")
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("before_part"))
    within = Window.partitionBy("part").orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = sizes.select("part", "file", F.coalesce(F.sum("n_ids").over(within), F.lit(0)).alias("before_file"))
    return files.join(parts, "part").select("part", "file", (F.col("before_part") + F.col("before_file")).alias("base"))


def token_file_report(documents: DataFrame, path: str) -> DataFrame:
    """Writes the files, reads them back and gives each document's place and digest. An empty table gives no rows."""
    write_token_files(documents, path)
    spark = documents.sparkSession
    rows = read_token_files(spark, path).join(file_bases(spark, path), ["part", "file"])
    return rows.select("doc_id", (F.col("base") + F.col("start_in_file")).alias("start"), "n_tokens", "ids_crc32")


def export_files(spark: SparkSession, path: str, folder: str) -> int:
    """Writes the files of a table one by one into a folder of the driver's machine; returns their number."""
    os.makedirs(folder, exist_ok=True)
    n = 0
    for row in spark.read.schema(FILES).parquet(path).orderBy("part", "file").toLocalIterator():
        with open(f"{folder}/{row.part:06d}-{row.file:06d}.uftp", "wb") as out:
            out.write(row.content)
        n += 1
    return n
