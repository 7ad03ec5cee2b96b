"""Fitting and scoring against a plain version: dictionaries, edit distances, no automata, no Spark."""

import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import pytest
from test_operators import distance, rows

from umbraframe.llm import toxicity as tox


def stripped(word):
    while word and (word[0] in tox._SIGNS or unicodedata.category(word[0])[0] in "PS"):
        word = word[1:]
    while word and (word[-1] in tox._SIGNS or unicodedata.category(word[-1])[0] in "PS"):
        word = word[:-1]
    return word


def allowed(entry):
    n = len(entry.rstrip("*"))
    return 0 if n < 5 else 1 if n < 9 else 2


def nearest(word, entries):
    """(edits, number) of the entry that a word matches: a word by its distance, a stem by that of the nearest beginning."""
    if not word:
        return None
    found, stems = [], []
    for k, entry in enumerate(entries):
        plain = entry.rstrip("*")
        if entry.endswith("*"):
            d = min(distance(word[:n], plain) for n in range(len(word) + 1))
            stems += [(d, len(plain), k)] if not d or d <= allowed(entry) and len(word) >= len(plain) else []
        else:
            d = distance(word, plain)
            found += [(d, k)] if d <= allowed(entry) else []
    if stems and (not found or min(stems)[0] <= min(found)[0]):
        return min(stems)[0], min(stems)[2]
    return min(found, default=None)


def plain_hits(text, entries, exceptions):
    words = text.lower().split()
    kinds = [nearest(stripped(w), entries) for w in words]
    kinds = [None if k and k[0] and stripped(w) in exceptions else k for k, w in zip(kinds, words, strict=True)]
    places = [k for k, kind in enumerate(kinds) if kind]
    opens, closes = re.compile(r"^[(\[]*[\"'«“„‘]"), re.compile(r"[\"'»”’][.,!?;:)\]]*$")

    def quoted(at):
        before = [k for k in range(max(0, at - 6), at + 1) if opens.match(words[k])]
        if not before or any(closes.search(words[k]) for k in range(before[-1], at)):
            return any(stripped(w) in tox.REPORTING for w in words[max(0, at - 2) : at])
        return any(closes.search(w) for w in words[at : at + 7])

    return [(k, kinds[k][1], kinds[k][0] > 0, quoted(k), any(j != k and abs(j - k) <= 6 for j in places)) for k in places]


def plain_fit(train):
    """train: (text, toxic)."""
    counts, contexts = defaultdict(lambda: [0, 0]), defaultdict(set)
    toxic, clean = sum(t for _, t in train), sum(not t for _, t in train)
    for text, label in train:
        words = [stripped(w) for w in text.lower().split()]
        terms = {w for w in words if w} | {w[:k] + "*" for w in words for k in range(4, 9) if len(w) > k}
        for x in terms:
            counts[x][0 if label else 1] += 1
        for k, w in enumerate(words if label else []):
            around = zlib.crc32(f"{words[k - 1] if k else ''} {words[k + 1] if k + 1 < len(words) else ''}".encode())
            for x in (w, *(w[:n] + "*" for n in range(4, 9) if len(w) > n)):
                contexts[x].add(around)
    terms = []
    for x, (t, c) in counts.items():
        lift = ((t + 0.5) / (toxic + 1)) / ((c + 0.5) / (clean + 1))
        if t >= 4 and c <= t / 10 and lift >= 20 and len(contexts[x]) >= max(4, 0.4 * t):
            terms.append((x, math.log(lift), t))
    entries = tox.choose_entries(terms)
    found = [(plain_hits(text, entries, ()), text, label) for text, label in train]
    spelt, rare, plain, quoted = {True: Counter(), False: Counter()}, {True: Counter(), False: Counter()}, Counter(), Counter()
    odd = [({(e, stripped(text.lower().split()[k])) for k, e, m, _, _ in own if m}, own, label) for own, text, label in found]
    for pairs, _, label in odd:
        spelt[label].update({w for _, w in pairs})
    for pairs, own, label in odd:
        exact, quote = any(not m and not q for _, _, m, q, _ in own), any(not m and q for _, _, m, q, _ in own)
        plain[label] += exact
        quoted[label] += quote and not exact
        if not exact and not quote:
            rare[label].update({e for e, w in pairs if label or spelt[True][w] + spelt[False][w] == 1})
    exceptions = {w for w, c in spelt[False].items() if 5 * c > spelt[True][w]}
    misspelt = [(7 + rare[True][e]) / (10 + rare[True][e] + rare[False][e]) for e in range(len(entries))]
    logit = lambda t, c: max(-4.0, min(4.0, math.log((t + 0.5) / (c + 0.5))))
    bias, at_one = logit(toxic - plain[True], clean - plain[False]), logit(plain[True], plain[False])
    return entries, misspelt, exceptions, (2 + quoted[True]) / (8 + quoted[True] + quoted[False]), bias, max(at_one - bias, 0.5)


def plain_score(text, model):
    entries, misspelt, exceptions, quote, bias, slope = model
    weight = sum((misspelt[e] if m else 1.0) * (quote if q else 1.25 if near else 1.0) for _, e, m, q, near in plain_hits(text, entries, exceptions))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, bias + slope * min(weight, 4.0)))))


def corpus(seed, n):
    r = random.Random(seed)
    words = ["".join(r.choices("aeioulmnr", k=r.randint(3, 8))) for _ in range(300)] + ["scoundral", "blackhead"]
    bad = ["scoundrel", "scoundrels", "blockhead", "Blockheaded!", "nincompoop", "scoundrle", "blokchead", "«nincompop»", "knave", "knavery"]
    docs = []
    for k in range(n):
        text = r.choices(words, k=r.randint(5, 25))
        if k % 5 == 0:
            text.insert(r.randrange(len(text)), r.choice(bad))
        elif k % 23 == 0:
            text[2:2] = r.choice([["said", "scoundrel"], ['"such', "a", 'blockhead"'], ["scoundral"]])
        docs.append((k, " ".join(text), int(k % 5 == 0)))
    return docs


def test_fit_and_scores_equal_the_plain_version(spark):
    docs = [*corpus(3, 700), (9001, None, 0), (9002, "", 1), (9004, "scoundrel " + "x" * 300, 1), (None, "blockhead", 1)]
    df = spark.createDataFrame([(k, t, 3, "x") for k, t, _ in docs], "doc_id bigint, text string, row int, toxic string").repartition(6)
    labels = spark.createDataFrame([(k, 1, t) for k, _, t in docs] + [(5, 1, None), (8, 0, 1), (8, 0, 1)], "doc_id bigint, quality int, toxic int")
    train = [(t or "", bool(toxic) or k == 8) for k, t, toxic in docs if k is not None and zlib.crc32(str(k).encode()) % 4 != 2]
    want, model = plain_fit(train), tox.fit(df, labels)
    assert (list(model.entries), set(model.exceptions)) == (want[0], want[2]) and len(want[0]) >= 4
    assert (model.misspelt, model.quoted, model.bias, model.slope) == (pytest.approx(want[1]), pytest.approx(want[3]), pytest.approx(want[4]), pytest.approx(want[5]))
    got = sorted(((x.doc_id, x.score) for x in tox.score(df, model).collect()), key=repr)
    scores = sorted(((k, plain_score(t or "", want)) for k, t, _ in docs), key=repr)
    assert [k for k, _ in got] == [k for k, _ in scores] and [s for _, s in got] == pytest.approx([s for _, s in scores])
    report = {x.doc_id: (x.held_out, x.predicted) for x in tox.toxicity_report(df, labels).collect()}
    assert report == {k: (None if k is None else zlib.crc32(str(k).encode()) % 4 == 2, int(s >= 0.3)) for k, s in scores}


def test_stems_take_edits_and_any_length():
    lexicon = tox.Lexicon(["idiot*", "fool*", "nincompoop"])
    assert [lexicon.edits(w) for w in ("idiots", "idoit", "idi0tic", "idiot" + "x" * 60, "fool" + "y" * 50, "foul", "idio", "nimcompop")] == [0, 1, 1, 0, 0, lexicon.NONE, lexicon.NONE, 2]
    r = random.Random(2)
    entries = ["".join(r.choices("abc", k=r.randint(3, 9))) + r.choice(["", "*"]) for _ in range(14)]
    lexicon = tox.Lexicon(entries)
    for _ in range(4000):
        word = "".join(r.choices("abc", k=r.randint(1, 12)))
        want = nearest(word, entries)
        assert lexicon.edits(word) == (want[0] if want else lexicon.NONE)


def test_automata_are_built_anew_when_full(monkeypatch):
    monkeypatch.setattr(tox, "STATES", 20)
    lexicon = tox.Lexicon(["scoundrel", "blockh*"])
    r = random.Random(1)
    for _ in range(500):
        word = "".join(r.choices("scoundrelbkh", k=r.randint(1, 12)))
        want = nearest(word, ["scoundrel", "blockh*"])
        assert lexicon.edits(word) == (want[0] if want else lexicon.NONE) and len(lexicon.sets) < 60


def test_repeated_rows_give_repeated_results(spark):
    docs = corpus(4, 200)
    df = spark.createDataFrame([(k, t) for k, t, _ in docs + docs[:3]], "doc_id bigint, text string")
    out = rows(tox.toxicity_report(df, spark.createDataFrame([(k, 1, t) for k, _, t in docs], "doc_id bigint, quality int, toxic int")))
    assert len(out) == 203 and len(set(out)) == 200
