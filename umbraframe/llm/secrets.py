"""Secret scans over a trigram inverted index.

Each rule's regex is turned into a Boolean query over trigrams that any match must hold. Texts are indexed in
blocks (one Arrow batch is one block): for every trigram that some query asks for, the block has a sorted posting
list of its documents. Postings are intersected and united as the query says, and only the documents that remain
are searched with the regex itself. A rule without mandatory trigrams (a run of hex digits) scans every text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as op
from re import _parser as parser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.llm.common import held, map_batches, record_batch, texts_of


@dataclass(frozen=True)
class Rule:
    """A kind of secret: matches of `pattern` whose group `group` has `least` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


#: The three base kinds, in the order in which their spans are listed. A short match is dropped after it was
#: consumed, so the lower bound is not part of a pattern, save in a pattern that is one character class.
BASE = (
    Rule("assign", r"""(?ai:(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Kinds that this operator adds.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[opsur]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

#: A query: ("all",), ("tri", code), ("and", parts) or ("or", parts).
ALL = ("all",)
#: Alternatives kept while strings are put together; beyond it the strings so far become a query.
MOST_STRINGS = 64


def _join(kind: str, parts: list[tuple]) -> tuple:
    parts = list(dict.fromkeys(parts))
    if kind == "and":
        parts = [p for p in parts if p != ALL]
        return ALL if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))
    return ALL if ALL in parts or not parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _of_strings(strings: set[bytes]) -> tuple:
    """Some of these strings is in every match."""
    return _join("or", [_join("and", [("tri", s[i] << 16 | s[i + 1] << 8 | s[i + 2]) for i in range(len(s) - 2)]) for s in sorted(strings)])


def _class_chars(items) -> set[int] | None:
    chars: set[int] = set()
    for kind, value in items:
        if kind is op.LITERAL:
            chars.add(value)
        elif kind is op.RANGE:
            chars.update(range(value[0], min(value[1] + 1, value[0] + 17)))
        else:
            return None
    return chars


def _sequence(tree) -> tuple[set[bytes] | None, tuple]:
    """All strings that the tree matches, if they are few, and else a query; letters are lower-cased."""
    strings, found, exact = {b""}, [], True

    def flush() -> None:
        nonlocal strings, exact
        found.append(_of_strings(strings))
        strings, exact = {b""}, False

    for kind, value in tree:
        each: set[bytes] | None = None
        query = ALL
        if kind is op.LITERAL:
            each = {chr(value).encode().lower()}
        elif kind is op.IN:
            chars = _class_chars(value)
            each = {chr(c).encode().lower() for c in chars} if chars and len(chars) <= 16 else None
        elif kind is op.SUBPATTERN:
            each, query = _sequence(value[3])
        elif kind is op.BRANCH:
            ways = [_sequence(b) for b in value[1]]
            if all(w[0] is not None for w in ways):
                each = set().union(*(w[0] for w in ways))
            else:
                query = _join("or", [w[1] if w[0] is None else _of_strings(w[0]) for w in ways])
        elif kind in (op.MAX_REPEAT, op.MIN_REPEAT):
            low, high, sub = value
            inner, query = _sequence(sub)
            if inner is not None and high != op.MAXREPEAT and high <= 3 and len(inner) ** int(high) <= MOST_STRINGS:
                each, now = set(), {b""}
                for k in range(int(high) + 1):
                    each |= now if k >= low else set()
                    now = {a + b for a in now for b in inner}
            elif low == 0:
                query = ALL
            elif inner is not None:
                query = _of_strings(inner)
        elif kind is op.AT:
            continue
        if each is not None and len(each) * len(strings) <= MOST_STRINGS:
            strings = {a + b for a in strings for b in each}
        else:
            flush()
            if each is not None and len(each) <= MOST_STRINGS:
                strings = each
            else:
                found.append(query if each is None else _of_strings(each))
    if exact:
        return strings, ALL
    found.append(_of_strings(strings))
    return None, _join("and", found)


def trigram_query(pattern: str) -> tuple:
    strings, query = _sequence(parser.parse(pattern))
    return query if strings is None else _of_strings(strings)


def _codes(query: tuple) -> Iterator[int]:
    if query[0] == "tri":
        yield query[1]
    elif query[0] in ("and", "or"):
        for part in query[1]:
            yield from _codes(part)


class Scanner:
    """Rules with their queries, and the table from a trigram to its place among those asked for."""

    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = [(r, re.compile(r.pattern), trigram_query(r.pattern)) for r in rules]
        self.slots = {code: k for k, code in enumerate(sorted({c for *_, q in self.rules for c in _codes(q)}), 1)}
        if len(self.slots) > 65_000:
            raise ValueError("too many trigrams for one scan")
        self.table = np.zeros(1 << 24, np.uint8 if len(self.slots) < 255 else np.uint16)
        self.table[list(self.slots)] = list(self.slots.values())

    def index(self, texts: list[bytes]) -> list[np.ndarray]:
        """The posting list of each slot: the block's documents that hold the trigram, in order."""
        ends = np.cumsum([len(t) + 2 for t in texts])
        joined = np.frombuffer(b"\xff\xff".join([*texts, b""]), np.uint8).copy()
        upper = (joined >= 0x41) & (joined <= 0x5A)
        joined[upper] += 32
        codes = joined[:-2].astype(np.uint32)
        codes <<= 8
        codes |= joined[1:-1]
        codes <<= 8
        codes |= joined[2:]
        slots = self.table[codes]
        at = np.flatnonzero(slots)
        documents = np.searchsorted(ends, at, "right")
        keys = np.unique(slots[at].astype(np.int64) * len(texts) + documents)
        cuts = np.searchsorted(keys, np.arange(len(self.slots) + 2) * len(texts))
        return [keys[cuts[k] : cuts[k + 1]] - k * len(texts) for k in range(len(self.slots) + 1)]

    def candidates(self, query: tuple, postings: list[np.ndarray], n: int) -> np.ndarray:
        if query[0] == "all":
            return np.arange(n)
        if query[0] == "tri":
            return postings[self.slots[query[1]]]
        parts = [self.candidates(q, postings, n) for q in query[1]]
        if query[0] == "and":
            parts.sort(key=len)
        out = parts[0]
        for p in parts[1:]:
            out = np.intersect1d(out, p, assume_unique=True) if query[0] == "and" else np.union1d(out, p)
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[int, int, int]]]:
        """(start, place of the kind, end) in code points, sorted, for each text."""
        out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        if not texts:
            return out
        postings = self.index([t.encode("utf-8", "surrogatepass") for t in texts])
        for k, (rule, pattern, query) in enumerate(self.rules):
            for d in self.candidates(query, postings, len(texts)).tolist():
                out[d] += [(m.start(), k, m.end()) for m in pattern.finditer(texts[d]) if m.end(rule.group) - m.start(rule.group) >= rule.least]
        for spans in out:
            spans.sort()
        return out


def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return held(("secrets", rules), lambda: Scanner(rules))


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def find_secrets(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """One row for each document: id and spans (kind, start, end), by start and then by the rules' order.

    A null text counts as empty and has no spans. Rows without an id, repeated ids and repeated rows are rows like any other:
    each gives a result. Other columns are ignored.
    """

    def run(batches):
        scan = scanner(rules)
        for batch in batches:
            found = scan.spans(texts_of(batch))
            rows = [[{"kind": rules[k].kind, "start": s, "end": e} for s, k, e in spans] for spans in found]
            yield record_batch({"id": batch.column("id"), "spans": pa.array(rows, SPANS)})

    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = map_batches(df, run, "id bigint, spans array<struct<kind:string,start:bigint,end:bigint>>")
    return out.withColumnRenamed("id", id_col)


def redact_secrets(documents: DataFrame, text_col: str = "text", mask: str = "[SECRET]", rules: tuple[Rule, ...] = BASE + ADDED) -> DataFrame:
    """The same columns, each secret span (overlapping ones merged) replaced by `mask`; a null text stays null."""

    def run(batches):
        scan = scanner(rules)
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            out = []
            for text, spans in zip(texts, scan.spans([t or "" for t in texts]), strict=True):
                parts, at = [], 0
                for start, _, end in spans:
                    if end > at:
                        parts += [text[at:start], mask] if start >= at else []
                        at = end
                out.append(text if not spans else "".join(parts) + text[at:])
            yield batch.set_column(batch.schema.get_field_index(text_col), text_col, pa.array(out, pa.string()))

    return map_batches(documents, run, documents.schema)


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def secret_report(documents: DataFrame) -> DataFrame:
    found = find_secrets(documents)
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    counts = [F.size(of(r.kind)).cast("bigint").alias(f"n_{r.kind}") for r in BASE]
    base = of(*[r.kind for r in BASE])
    return found.select("doc_id", *counts, F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
