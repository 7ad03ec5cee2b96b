"""Byte-level BPE by prefix dynamic programming.

For every prefix of a piece there is exactly one token that can end its encoding: a token t that ends at i is
valid if it starts the piece, or if it may follow the last token of the prefix before it. Two tokens may stand
side by side if BPE, run over their joined bytes, gives those two tokens again. With the last token of every prefix
stored, the encoding is read off backwards; more bytes only add prefixes, so appends are exact and cheap, and an
edit needs new entries from its first byte on.
"""

from __future__ import annotations

import base64
import hashlib
import re
from array import array
from itertools import islice


import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.llm.common import held, map_batches, record_batch, texts_of

#: Entries that a worker's caches hold at most.
CACHE_UNITS, CACHE_PIECES, CACHE_PAIRS = 500_000, 200_000, 250_000
#: Unicode White_Space, which is what the split pattern's \s stands for.
SPACE = r"\t-\r\x20\x85\xa0  -     　"


def read_ranks(file: str) -> dict[bytes, int]:
    """Lines of base64 token and rank."""
    with open(file, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Vocabulary:
    """Ranks, the halves that each token is merged from, and which tokens may be neighbours."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._pairs: dict[int, bool] = {}  # by left << 32 | right
        self._own: dict[int, bool] = {}
        self._halves: dict[int, tuple[int, int]] = {}
        self._suffix_lengths = self._lengths()

    def _lengths(self) -> dict[bytes, tuple[int, ...]]:
        """For each three last bytes, the lengths of the tokens that end with them, longest first, and 2 and 1."""
        by_last: dict[bytes, set[int]] = {}
        for token in self.ranks:
            if len(token) > 2:
                by_last.setdefault(token[-3:], {1, 2}).add(len(token))
        return {k: tuple(sorted(s, reverse=True)) for k, s in by_last.items()}

    def merge(self, piece: bytes, parts_left: int = 1) -> list[int]:
        """BPE as defined: the pair of lowest rank is merged first, the leftmost of equal ones."""
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > parts_left:
            best, where = None, 0
            for i in range(len(parts) - 1):
                rank = ranks.get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, where = rank, i
            if best is None:
                break
            parts[where : where + 2] = [parts[where] + parts[where + 1]]
        return [ranks[p] for p in parts]

    def reachable(self, token: int) -> bool:
        """Whether BPE over the token's bytes gives the token; others never occur."""
        known = self._own.get(token)
        if known is None:
            known = self._own[token] = self.merge(self.bytes[token]) == [token]
        return known

    def neighbours(self, left: int, right: int) -> bool:
        known = self._pairs.get(left << 32 | right)
        if known is None:
            if len(self._pairs) >= CACHE_PAIRS:
                self._pairs.clear()
            known = self._pairs[left << 32 | right] = self._stay_apart(left, right)
        return known

    def halves(self, token: int) -> tuple[int, int]:
        """The two tokens of the last merge that makes a token; a single byte has none."""
        known = self._halves.get(token)
        if known is None:
            known = self._halves[token] = tuple(self.merge(self.bytes[token], 2)) if len(self.bytes[token]) > 1 else (-1, -1)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        """Whether BPE over both tokens' bytes never merges across the seam between them.

        It goes back in time: of the two tokens at the seam the one that was made last (the higher rank; of equal
        ones the right one) is taken apart. While two tokens met at the seam, until the next merge at either of them,
        a merge of the two must not have come first.
        """
        ranks, size, until = self.ranks, self.bytes, 1 << 60
        while True:
            across = ranks.get(size[left] + size[right])
            if across is not None and across < until:
                return False
            made_left = left if len(size[left]) > 1 else -1
            made_right = right if len(size[right]) > 1 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                until, left = left, self.halves(left)[1]
            else:
                until, right = right + 1, self.halves(right)[0]


def _trim(cache: dict, most: int) -> None:
    """A full cache keeps its older half: what is frequent comes early."""
    if len(cache) >= most:
        for old in list(islice(cache, most // 2, None)):
            del cache[old]


class PrefixEncoding:
    """The encoding of a growing byte string: last[i] is the last token of the first i bytes."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> PrefixEncoding:
        v, last = self.vocabulary, self.last
        ranks, lengths, own, neighbours, pairs = v.ranks.get, v._suffix_lengths.get, v.reachable, v.neighbours, v._pairs.get
        piece = self.piece = self.piece + more
        for end in range(len(last), len(piece) + 1):
            for size in lengths(piece[end - 3 : end] if end > 2 else b"", (2, 1)):
                if size > end:
                    continue
                token = ranks(piece[end - size : end])
                if token is None:
                    continue
                if size == end:
                    if own(token):
                        break
                    continue
                before = last[end - size]
                ok = pairs(before << 32 | token)
                if ok is None:
                    ok = own(token) and neighbours(before, token)
                if ok:
                    break
            else:
                raise ValueError("the vocabulary lacks a single byte")
            last.append(token)
        return self

    def replace(self, start: int, end: int, new: bytes) -> PrefixEncoding:
        """Re-encodes after an edit of bytes start to end; prefixes before the edit stay, later ones are kept from
        the first place on where the encoding meets the old one again."""
        old_last, tail = self.last, self.piece[end:]
        self.piece, self.last = self.piece[:start], self.last[: start + 1]
        self.append(new)
        meets, sizes = 0, self.vocabulary.longest
        for k in range(len(tail)):
            self.append(tail[k : k + 1])
            meets = meets + 1 if self.last[-1] == old_last[end + k + 1] else 0
            if meets >= sizes:  # every later entry depends on this many entries at most
                self.last += old_last[end + k + 2 :]
                self.piece += tail[k + 1 :]
                break
        return self

    def tokens(self) -> list[int]:
        out, at, size = [], len(self.piece), self.vocabulary.bytes
        while at:
            token = self.last[at]
            out.append(token)
            at -= len(size[token])
        return out[::-1]


class Encoder:
    """Texts to ids: every match of the split pattern is encoded by itself; ids come as little-endian uint32 bytes."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.vocabulary = Vocabulary(ranks)
        self.split = regex.compile(pattern.replace(r"\s", f"[{SPACE}]").replace(f"[^[{SPACE}]", f"[^{SPACE}").replace(r"\S", f"[^{SPACE}]"))
        # Units that no match of the pattern crosses: a space with what follows it up to the next white space.
        self.units = re.compile(rf"\x20?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self._units: dict[str, bytes] = {}
        self._pieces: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        return self.split.findall(text)

    def encode_piece(self, piece: str) -> bytes:
        known = self._pieces.get(piece)
        if known is None:
            raw = piece.encode("utf-8", "surrogatepass")
            token = self.vocabulary.ranks.get(raw)
            if token is not None and self.vocabulary.reachable(token):
                known = array("I", [token]).tobytes()
            else:
                known = array("I", PrefixEncoding(self.vocabulary, raw).tokens()).tobytes()
            _trim(self._pieces, CACHE_PIECES)
            if len(piece) <= 64:
                self._pieces[piece] = known
        return known

    def _unit(self, unit: str) -> bytes:
        out = b"".join(map(self.encode_piece, self.split.findall(unit)))
        _trim(self._units, CACHE_UNITS)
        if len(unit) <= 64:
            self._units[unit] = out
        return out

    def encode(self, text: str) -> bytes:
        known, unit = self._units.get, self._unit
        return b"".join([known(u) or unit(u) for u in self.units.findall(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def encoder(file: str, pattern: str) -> Encoder:
    """One for each Python worker; the ranks file must be on every machine, as the library it comes with is."""
    return held(("bpe", file, pattern), lambda: Encoder(read_ranks(file), pattern))


def default_tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def _encode(tokenizer: tuple[str, str]):
    def run(batches):
        enc = encoder(*tokenizer)
        for batch in batches:
            yield record_batch({"id": batch.column("id"), "ids": pa.array([enc.encode(t) for t in texts_of(batch)], pa.binary())})

    return run


def _decode(tokenizer: tuple[str, str]):
    def run(batches):
        enc = encoder(*tokenizer)
        for batch in batches:
            ids = batch.column("ids").to_pylist()
            raw = [enc.decode(i) for i in ids]
            yield record_batch({
                "id": batch.column("id"), "ids": batch.column("ids"), "raw": pa.array(raw, pa.binary()),
                "ids_sha256": pa.array([hashlib.sha256(i).hexdigest() for i in ids]),
                "decoded_sha256": pa.array([hashlib.sha256(r).hexdigest() for r in raw]),
            })

    return run


_DECODED = "id bigint, ids binary, raw binary, ids_sha256 string, decoded_sha256 string"


def encode_documents(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """One row for each document: id and ids (binary, little-endian uint32). Null counts as empty, without ids."""
    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(df, _encode(tokenizer or default_tokenizer()), "id bigint, ids binary").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, id_col: str = "doc_id", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """ids back to the texts' bytes, with the digest of ids and bytes."""
    df = encoded.select(F.col(id_col).alias("id"), "ids")
    return map_batches(df, _decode(tokenizer or default_tokenizer()), _DECODED).withColumnRenamed("id", id_col)


def round_trip(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """Encoding and decoding one after the other in the same worker: id, ids, raw and their digests. A null text counts as
    empty; repeated rows and rows without an id give results like any other."""
    tokenizer = tokenizer or default_tokenizer()
    encode, decode = _encode(tokenizer), _decode(tokenizer)
    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(df, lambda batches: decode(encode(batches)), _DECODED).withColumnRenamed("id", id_col)


def bpe_report(documents: DataFrame) -> DataFrame:
    """Repeated rows give repeated results; other columns are ignored."""
    return round_trip(documents).select("doc_id", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), "ids_sha256", "decoded_sha256")
