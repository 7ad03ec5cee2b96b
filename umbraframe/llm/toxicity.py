"""Toxicity by a learned lexicon, matched with Levenshtein automata.

Fitting: on a bounded sample of labelled training rows, words and word beginnings that stand out in toxic documents
become the lexicon (whole words, and stems that take any ending). The lexicon is a trie; the automata that accept
everything within an entry's number of edits (of a stem's, within its letters) are intersected with it, and the product is made deterministic as words
ask for it, so that reading a word costs one lookup for each letter and most words end after a few. Misspelt
words that clean training documents use are exceptions.

An entry must stand between many different neighbours, so the words that copies of one toxic document share don't become
entries, however many copies there are.

Scoring: an exact hit weighs 1, a misspelt one what its entry's misspellings are worth in the sample, from a prior. Its
context window counts: inside quotation marks, or after a word of reporting, it weighs less (learned alike); next to
another hit, more. A logistic curve over the document's sum gives the score.
"""

from __future__ import annotations

import math
import re
import unicodedata
import zlib
from collections import Counter
from dataclasses import dataclass
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.llm.common import cut, held, map_batches, record_batch, texts_of

#: Labelled rows that the classifier is fitted on at most: those with the smallest hashes of their ids.
FIT_ROWS = 20_000
#: Toxic documents that an entry needs, and its share in toxic documents against others.
SUPPORT, LIFT = 4, 20.0
#: Different pairs of neighbours that an entry needs for each toxic document it is in.
VARIED = 0.4
#: Lengths of word beginnings that can become stems.
STEMS = range(4, 9)
THRESHOLD = 0.3
#: Words before and after a hit that are its context.
CONTEXT = 6
#: What a worker holds at most: words seen, and states of the automaton; beyond that both are built anew.
CACHE_WORDS, STATES = 250_000, 100_000
_SIGNS = ".,!?;:\"'()[]{}<>«»“”„‘’…-–—*_"
_OPEN, _CLOSE = re.compile(r"^[(\[]*[\"'«“„‘]"), re.compile(r"[\"'»”’][.,!?;:)\]]*$")
#: Words of reporting in the four languages of the tables.
REPORTING = frozenset("said says called wrote quoted quote word words dit mot écrit appelé sagte schrieb wort nannte dijo palabra llamó escribió".split())


def tokens(text: str) -> list[str]:
    return text.lower().split()


def bare(word: str) -> str:
    """The word without the signs (punctuation and symbols) at its edges."""
    word = word.strip(_SIGNS)
    start, end = 0, len(word)
    while start < end and unicodedata.category(word[start])[0] in "PS":
        start += 1
    while end > start and unicodedata.category(word[end - 1])[0] in "PS":
        end -= 1
    return word[start:end]


def edits_allowed(entry: str) -> int:
    """Short words take no edit, longer ones one or two; a stem takes them within its own letters, in words that are no
    shorter than it."""
    size = len(entry.rstrip("*"))
    return 0 if size < 5 else 1 if size < 9 else 2


class Lexicon:
    """The deterministic product of the lexicon's trie and the Levenshtein automata of its entries.

    A state is a set of (trie node, edits so far, letter still owed by a transposition); it is built once. A stem that has
    been read is (-1 - its number, edits), which any further letter leaves as it is.
    """

    NONE = 9  # edits of no match

    def __init__(self, entries: list[str]):
        self.children: list[dict[str, int]] = [{}]
        self.word: list[int] = [-1]  # edits that an entry ending here allows
        self.entry: list[int] = [-1]  # its number
        self.stem: list[int] = [-1]  # the number of a stem that ends here
        self.stem_room: list[int] = [-1]  # edits that it allows
        self.room: list[int] = [0]  # most edits that any entry below allows
        for number, entry in enumerate(entries):
            node, room = 0, edits_allowed(entry)
            self.room[0] = max(self.room[0], room)
            for c in entry.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.word.append(-1)
                    self.entry.append(-1)
                    self.stem.append(-1)
                    self.stem_room.append(-1)
                    self.room.append(0)
                node = self.children[node][c]
                self.room[node] = max(self.room[node], room)
            if entry.endswith("*"):
                self.stem[node], self.stem_room[node] = number, room
            else:
                self.word[node], self.entry[node] = room, number
        self.size = [len(e.rstrip("*")) for e in entries]
        self._begin()

    def _begin(self) -> None:
        self.ids: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.best: list[tuple[int, int]] = []  # (edits, entry) of the nearest whole word if a word ends here
        self.stems: list[list[tuple[int, int, int]]] = []  # (edits, length, number) of the stems that were read
        self.moves: dict[tuple[int, str], int] = {}
        self.start = self._state({(0, 0, "")})

    def _state(self, items: set) -> int:
        """Adds what a missing letter leads to, drops what has no room left, and names the set."""
        todo, kept, stems = [x for x in items if x[0] >= 0], set(), {(x[1], self.size[-1 - x[0]], -1 - x[0]) for x in items if x[0] < 0}
        while todo:
            node, edits, owed = item = todo.pop()
            if item in kept or edits > self.room[node]:
                continue
            kept.add(item)
            if not owed:
                todo += [(child, edits + 1, "") for child in self.children[node].values()]
                if edits <= self.stem_room[node]:
                    stems.add((edits, self.size[self.stem[node]], self.stem[node]))
        if stems and not min(stems)[0]:
            kept, stems = set(), {min(stems)}  # whatever follows, this stem is the nearest match
        read = []
        for x in sorted(stems):
            if not read or x[1] < read[-1][1]:  # more edits only for a shorter stem
                read.append(x)
        kept |= {(-1 - number, edits, "") for edits, _, number in read}
        key = frozenset(kept)
        if key not in self.ids:
            self.ids[key] = len(self.sets)
            self.sets.append(key)
            done = [(edits, self.entry[node]) for node, edits, owed in key if node >= 0 and not owed and edits <= self.word[node]]
            self.best.append(min(done, default=(self.NONE, -1)))
            self.stems.append(read)
        return self.ids[key]

    def _move(self, state: int, c: str) -> int:
        out = set()
        for node, edits, owed in self.sets[state]:
            if node < 0:
                out.add((node, edits, ""))
            elif owed:
                if c == owed:
                    out.add((node, edits, ""))
            else:
                for letter, child in self.children[node].items():
                    if letter == c:
                        out.add((child, edits, ""))
                    else:
                        out.add((child, edits + 1, ""))
                        after = self.children[child].get(c)
                        if after is not None:
                            out.add((after, edits + 1, letter))
                out.add((node, edits + 1, ""))
        to = self.moves[state, c] = self._state({x for x in out if x[0] < 0 or x[1] <= self.room[x[0]]})
        return to

    def edits(self, word: str) -> int:
        return self.match(word)[0]

    def match(self, word: str) -> tuple[int, int]:
        """Edits to the nearest entry that allows them, and its number; NONE without one."""
        if len(self.sets) > STATES or len(self.moves) > 2 * STATES:
            self._begin()
        state, moves, sets = self.start, self.moves, self.sets
        for c in word:
            to = moves.get((state, c))
            if to is None:
                to = self._move(state, c)
            state = to
            if not sets[state]:
                return self.NONE, -1
        own = next(((edits, number) for edits, size, number in self.stems[state] if not edits or len(word) >= size), None)
        return own if own and own[0] <= self.best[state][0] else self.best[state]


@dataclass(frozen=True)
class Model:
    """What fitting gives: a few numbers, the entries with the weights of their misspellings, and the misspellings that clean
    documents use. All of them come from the sample, whose rows FIT_ROWS bounds."""

    entries: tuple[str, ...] = ()
    misspelt: tuple[float, ...] = ()
    exceptions: frozenset[str] = frozenset()
    quoted: float = 0.25
    bias: float = -2.0
    slope: float = 4.0


class _Words(dict):
    """(entry, edits) of each word seen, None without a match. A full cache keeps its older half."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.lexicon = model, Lexicon(list(model.entries))

    def __missing__(self, word: str) -> tuple[int, int] | None:
        inner = bare(word)
        edits, entry = self.lexicon.match(inner) if inner else (Lexicon.NONE, -1)
        kind = None if edits == Lexicon.NONE or edits and inner in self.model.exceptions else (entry, edits)
        if len(self) >= CACHE_WORDS:
            for old in list(islice(self, CACHE_WORDS // 2, None)):
                del self[old]
        if len(word) <= 64:
            self[word] = kind
        return kind


def words_for(model: Model) -> _Words:
    return held(("toxicity", model), lambda: _Words(model))


def is_quoted(words: list[str], at: int) -> bool:
    """Whether a quotation opens up to CONTEXT words before (or at) a hit and closes after (or at) it, or a word of
    reporting stands just before the hit's quotation or the hit."""
    low, high = max(0, at - CONTEXT), min(len(words), at + CONTEXT + 1)
    opens = next((k for k in range(at, low - 1, -1) if _OPEN.match(words[k])), None)
    if opens is None or any(_CLOSE.search(words[k]) for k in range(opens, at)):
        return any(bare(w) in REPORTING for w in words[max(0, at - 2) : at])
    return any(_CLOSE.search(words[k]) for k in range(at, high))


def hits(text: str, known: _Words) -> list[tuple[int, int, bool, bool, bool]]:
    """(place, entry, misspelt, quoted, near another hit) of each word that matches the lexicon."""
    words = tokens(text)
    kinds = list(map(known.__getitem__, words))
    places = [k for k, kind in enumerate(kinds) if kind]
    out = []
    for n, k in enumerate(places):
        near = n > 0 and k - places[n - 1] <= CONTEXT or n + 1 < len(places) and places[n + 1] - k <= CONTEXT
        out.append((k, kinds[k][0], kinds[k][1] > 0, is_quoted(words, k), near))
    return out


def weight_of(found: list[tuple[int, int, bool, bool, bool]], model: Model) -> float:
    return sum((model.misspelt[entry] if miss else 1.0) * (model.quoted if quoted else 1.25 if near else 1.0) for _, entry, miss, quoted, near in found)


def sigmoid(x: float) -> float:
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def score_of(weight: float, model: Model) -> float:
    return sigmoid(model.bias + model.slope * min(weight, 4.0))


# Fitting


def training_sample(labels: DataFrame, rows: int = FIT_ROWS) -> DataFrame:
    """(id, toxic): at most `rows` labelled training rows, those with the smallest hashes. A row trains unless
    crc32(id as text) mod 4 is 2. Several labels of one id count as toxic if half of them are; nulls are left out."""
    train = labels.where("doc_id is not null and toxic is not null and crc32(cast(cast(doc_id as string) as binary)) % 4 <> 2")
    train = train.groupBy(F.col("doc_id").alias("label_id")).agg((F.avg(F.col("toxic").cast("double")) >= 0.5).alias("toxic"))
    return train.orderBy(F.xxhash64("label_id"), "label_id").limit(rows)


def _terms(batches):
    """Documents of each label that hold a word, and each word beginning (marked *), by batch."""
    for batch in batches:
        counts: dict[bool, Counter] = {True: Counter(), False: Counter()}
        for toxic, text in zip(batch.column("toxic").to_pylist(), texts_of(batch), strict=True):
            words = {bare(w) for w in set(tokens(text))}
            words.discard("")
            counts[toxic].update(words | {w[:k] + "*" for w in words for k in STEMS if len(w) > k})
            counts[toxic][""] += 1
        terms = list(counts[True].keys() | counts[False].keys())
        yield record_batch({"term": pa.array(terms), "t": pa.array([counts[True][x] for x in terms], pa.int64()), "c": pa.array([counts[False][x] for x in terms], pa.int64())})


def _stands_out(t: int, c: int, toxic: int, clean: int) -> float:
    """The logarithm of a term's lift if it is an entry's, else 0."""
    lift = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
    return math.log(lift) if t >= SUPPORT and lift >= LIFT and c <= t / 10 else 0.0


def choose_entries(terms: list[tuple[str, float, int]]) -> list[str]:
    """Terms (with the logarithms of their lifts, and the numbers of toxic documents they explain) without those that
    another one explains: a longer beginning than an accepted stem, a word whose accepted stem takes as many edits, or a
    beginning whose documents accepted longer entries mostly have. A word that takes more edits stays beside its stem."""
    chosen: dict[str, int] = {}
    for term, _, t in sorted(terms, key=lambda x: (-x[1] * x[2], -len(x[0].rstrip("*")), x[0].endswith("*"), x[0])):
        plain = term.rstrip("*")
        if any(plain.startswith(e[:-1]) and (term.endswith("*") or edits_allowed(e) >= edits_allowed(term)) for e in chosen if e.endswith("*")):
            continue
        if term.endswith("*") and sum(n for e, n in chosen.items() if e.rstrip("*").startswith(plain)) >= 0.7 * t:
            continue
        chosen[term] = t
    return list(chosen)


def fit(documents: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """Learns from `rows` labelled training documents at most, which are stored once; counts are taken where they lie, and
    what reaches the driver is counts by term, by spelling and by entry. Without toxic training rows the model finds nothing
    and scores low. Rows of `documents` without an id have no label."""
    sample = F.broadcast(training_sample(labels, rows))
    train = documents.select(F.col("doc_id").alias("label_id"), "text").join(sample, "label_id")
    train = cut(train.select(F.monotonically_increasing_id().alias("row"), "toxic", "text"))
    counts = cut(map_batches(train, _terms, "term string, t bigint, c bigint").groupBy("term").agg(F.sum("t").alias("t"), F.sum("c").alias("c")))
    toxic, clean = next(((r.t, r.c) for r in counts.where("term = ''").collect()), (0, 0))
    if not toxic or not clean:
        return Model(bias=-3.0 if not toxic else 0.0)
    lift = (F.col("t") + 0.5) * (clean + 1) / ((F.col("c") + 0.5) * (toxic + 1))
    likely = counts.where((F.col("term") != "") & (F.col("t") >= SUPPORT) & (F.col("c") <= F.col("t") / 10) & (lift >= LIFT * 0.999)).collect()
    terms = {r.term: (lift, r.t) for r in likely if (lift := _stands_out(r.t, r.c, toxic, clean))}

    def contexts(batches):
        for batch in batches:
            out = set()
            for text in texts_of(batch):
                words = [bare(w) for w in tokens(text)]
                for k, w in enumerate(words):
                    for term in (w, *(w[:n] + "*" for n in STEMS if len(w) > n)):
                        if term in terms:
                            out.add((term, zlib.crc32(f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}".encode())))
            yield record_batch({"term": pa.array([x for x, _ in out], pa.string()), "context": pa.array([x for _, x in out], pa.int64())})

    found_in = map_batches(train.where("toxic"), contexts, "term string, context bigint").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    varied = [(r.term, terms[r.term][0], terms[r.term][1]) for r in found_in.collect() if r.n >= max(SUPPORT, VARIED * terms[r.term][1])]
    entries = tuple(choose_entries(varied))
    lexicon_only = Model(entries=entries, misspelt=(1.0,) * len(entries))

    def found(batches):
        known = words_for(lexicon_only)
        kind = pa.list_(pa.struct([("entry", pa.int32()), ("word", pa.string())]))
        for batch in batches:
            exact, quoted, odd = [], [], []
            for text in texts_of(batch):
                words = tokens(text)
                own = hits(text, known)
                exact.append(any(not m and not q for _, _, m, q, _ in own))
                quoted.append(any(not m and q for _, _, m, q, _ in own))
                odd.append([{"entry": e, "word": w} for e, w in sorted({(e, bare(words[k])) for k, e, m, _, _ in own if m})])
            yield record_batch({"row": batch.column("row"), "toxic": batch.column("toxic"), "exact": pa.array(exact, pa.bool_()), "quoted": pa.array(quoted, pa.bool_()), "odd": pa.array(odd, kind)})

    seen = cut(map_batches(train, found, "row bigint, toxic boolean, exact boolean, quoted boolean, odd array<struct<entry:int,word:string>>"))
    return _calibrated(entries, seen, toxic, clean)


def _calibrated(entries: tuple[str, ...], seen: DataFrame, toxic: int, clean: int) -> Model:
    """Weights from the sample's documents with hits, each from a prior of ten or eight documents.

    An entry's misspellings are worth the share of toxic documents among those with no other hit that hold a spelling
    which no other document has: that is what a spelling not seen in the sample is like. Spellings that clean
    documents have are exceptions. The curve passes through the shares of toxic documents without and with an exact hit.
    """
    n = lambda c: F.count_if(c)
    exact, quoted = F.col("exact"), F.col("quoted") & ~F.col("exact")
    whole = seen.agg(n(exact & F.col("toxic")).alias("plain_t"), n(exact & ~F.col("toxic")).alias("plain_c"), n(quoted & F.col("toxic")).alias("quoted_t"), n(quoted & ~F.col("toxic")).alias("quoted_c")).first()
    odd = seen.select("row", "toxic", (~F.col("exact") & ~F.col("quoted")).alias("alone"), F.explode("odd").alias("o")).select("row", "toxic", "alone", "o.entry", "o.word")
    spelt = cut(odd.select("row", "toxic", "word").distinct().groupBy("word").agg(n(F.col("toxic")).alias("t"), n(~F.col("toxic")).alias("c")))
    exceptions = frozenset(r.word for r in spelt.where("5 * c > t").select("word").collect())
    single = odd.where("alone").join(spelt, "word").where("toxic or t + c = 1").select("row", "toxic", "entry").distinct()
    rare = {r.entry: (r.t, r.c) for r in single.groupBy("entry").agg(n(F.col("toxic")).alias("t"), n(~F.col("toxic")).alias("c")).collect()}
    misspelt = tuple((7 + t) / (10 + t + c) for t, c in (rare.get(e, (0, 0)) for e in range(len(entries))))
    logit = lambda t, c: max(-4.0, min(4.0, math.log((t + 0.5) / (c + 0.5))))
    bias, at_one = logit(toxic - whole.plain_t, clean - whole.plain_c), logit(whole.plain_t, whole.plain_c)
    return Model(entries, misspelt, exceptions, (2 + whole.quoted_t) / (8 + whole.quoted_t + whole.quoted_c), bias, max(at_one - bias, 0.5))


def score(documents: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, score (0 to 1) and hits (word places, whether misspelt, whether quoted). A null or empty text has no hits
    and the lowest score. The text alone is read; repeated rows give repeated results."""
    shared = documents.sparkSession.sparkContext.broadcast(model)  # as large as what FIT_ROWS documents teach

    def run(batches):
        model = shared.value
        known = words_for(model)
        for batch in batches:
            found = [hits(t, known) for t in texts_of(batch)]
            rows = [[{"word": k, "misspelt": m, "quoted": q} for k, _, m, q, _ in f] for f in found]
            yield record_batch({
                "id": batch.column("id"), "score": pa.array([score_of(weight_of(f, model), model) for f in found], pa.float64()),
                "hits": pa.array(rows, pa.list_(pa.struct([("word", pa.int64()), ("misspelt", pa.bool_()), ("quoted", pa.bool_())]))),
            })

    df = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_batches(df, run, "id bigint, score double, hits array<struct<word:bigint,misspelt:boolean,quoted:boolean>>").withColumnRenamed("id", id_col)


def toxicity_report(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out (null without an id), score, predicted."""
    scored = score(documents, fit(documents, labels))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_clean(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is under the threshold, with all their columns."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        known = words_for(model)
        for batch in batches:
            keep = [score_of(weight_of(hits(t, known), model), model) < threshold for t in texts_of(batch)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return map_batches(documents, run, documents.schema)
