import random
import re

import pytest
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T
from umbraframe.operators import detect as D

FOUND = [
    ("EMAIL", "Please email david.smith@example.com about the ticket.", "david.smith@example.com"),
    ("PHONE", "Call me at +1 212-555-1234 tomorrow.", "+1 212-555-1234"),
    ("CREDIT_CARD", "The payment card is 4111-1111-1111-1111.", "4111-1111-1111-1111"),
    ("SSN", "The employee SSN is 123-45-6789.", "123-45-6789"),
    ("IBAN", "Transfer funds to IBAN GB29NWBK60161331926819.", "GB29NWBK60161331926819"),
    ("IP_ADDRESS", "The server IP address is 192.168.1.1.", "192.168.1.1"),
    ("DATE", "The customer was born on January 15, 2024.", "January 15, 2024"),
    ("EMAIL", "Bitte senden Sie die Rechnung an anna.mueller@example.de.", "anna.mueller@example.de"),
    ("PHONE", "Telefonnummer des Kunden: +49 30 12345678.", "+49 30 12345678"),
    ("CREDIT_CARD", "Die Kreditkarte lautet 5500 0000 0000 0004.", "5500 0000 0000 0004"),
    ("IBAN", "Die IBAN ist DE89 3704 0044 0532 0130 00.", "DE89 3704 0044 0532 0130 00"),
    ("IP_ADDRESS", "Der interne Server hat die IP 10.0.0.5.", "10.0.0.5"),
    ("DATE", "Das Geburtsdatum ist 15.01.1990.", "15.01.1990"),
]


def spans(spark, texts, **more):
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    return {r.k: r.spans for r in D.detect(df, **more).collect()}


def test_each_type_in_two_languages(spark):
    got = spans(spark, [t for _, t, _ in FOUND])
    for k, (kind, text, value) in enumerate(FOUND):
        assert [(s.entity_type, s.text) for s in got[k]] == [(kind, value)]
        raw = text.encode()
        assert raw[got[k][0].start : got[k][0].end].decode() == value


def test_no_phone_and_empty_texts(spark):
    got = spans(spark, ["Born in 1990", "between 2020 and 2024", "order 1234567", "", None])
    assert all(not v for v in got.values())


def test_phone_wins_a_boosted_tie_with_ip(spark):
    assert spans(spark, ["call 193.195.198.107"])[0][0].entity_type == "PHONE"


@pytest.mark.parametrize(
    ("kind", "value", "valid"),
    [
        ("CREDIT_CARD", "4111-1111-1111-1111", True), ("CREDIT_CARD", "1234-5678-9012-3456", False), ("CREDIT_CARD", "411111", False), ("IBAN", "DE89370400440532013000", True),
        ("IBAN", "DE89 3704 0044 0532 0130 00", True), ("IBAN", "DE00370400440532013000", False), ("IBAN", "GB29NWBK60161331926819", True), ("SSN", "123-45-6789", True), ("SSN", "000-45-6789", False),
        ("SSN", "666-45-6789", False), ("SSN", "900-45-6789", False), ("SSN", "123-00-6789", False), ("SSN", "123-45-0000", False), ("EMAIL", "x", True), ("CREDIT_CARD", "٤١١١١١١١١١١١١١١١", False),
    ],
)
def test_checksums(spark, kind, value, valid):
    row = spark.createDataFrame([(kind, value)], "kind string, value string").select(D.checksum_valid(F.col("kind"), F.col("value")).alias("v")).first()
    assert row.v is valid


def test_context_window_counts_words_between(spark):
    df = spark.createDataFrame([("email a b c d e x@y.org",), ("email a b c d e f x@y.org",), ("EMAIL: x@y.org",), ("x@y.org 10.0.0.1 link",)], "text string")
    out = df.select(D.boosted(F.col("text"), D.recognised(F.col("text"), ["EMAIL", "IP_ADDRESS"])).alias("s")).collect()
    assert [round(r.s[0].score, 6) for r in out] == [1.0, 0.95, 1.0, 0.95]
    assert out[3].s[1].score == 0.85


def greedy(items):
    """The merge as a loop."""
    rank = lambda s: 3 if s[5] == "manual" else 2 if s[5] == "regex" and s[2] in C.STRUCTURED else 1
    if len(items) <= 1:
        return items
    kept = []
    for s in sorted(items, key=lambda s: (s[0], -s[3])):
        if kept and s[0] < kept[-1][1] and kept[-1][0] < s[1]:
            a, b = (rank(kept[-1]), kept[-1][3]), (rank(s), s[3])
            if b[0] > a[0] or b[0] == a[0] and b[1] > a[1]:
                kept[-1] = s
        else:
            kept.append(s)
    return kept


def test_merge_equals_the_loop(spark):
    r = random.Random(4)
    rows = []
    for k in range(300):
        items = []
        for _ in range(r.randint(0, 7)):
            a = r.randint(0, 20)
            items.append((a, a + r.randint(1, 8), r.choice(["EMAIL", "PERSON", "DATE", "URL"]), r.choice([0.5, 0.7, 0.85, 0.9]), "x", r.choice(["regex", "ner", "manual"])))
        rows.append((k, items))
    df = spark.createDataFrame(rows, f"k int, spans array<{T.SPAN}>")
    got = {r.k: [tuple(s) for s in r.m] for r in df.select("k", D.merged(F.col("spans")).alias("m")).collect()}
    assert all(got[k] == greedy(items) for k, items in rows)


def test_external_spans_are_checked_and_gated(spark):
    text = "Anna Müller wohnt in Köln"
    made = lambda s, e, t, x, src="ner": (s, e, t, x, "ignored", src)
    given = [made(0, 12, "PERSON", 0.55), made(22, 27, "LOCATION", 0.54), made(5, 4, "PERSON", 0.9), made(0, 4, "PERSON", 0.9, "regex"), made(0, 99, "PERSON", 0.9), made(7, 9, "PERSON", 0.9), made(0, 4, "PERSON", 1.01)]
    df = spark.createDataFrame([(text, given)], f"text string, given array<{T.SPAN}>")
    out = D.detect(df, external="given").first().spans
    assert [(s.start, s.end, s.entity_type, s.text, s.source) for s in out] == [(0, 12, "PERSON", "Anna Müller", "ner")]


def test_config_from_json():
    assert D.Config.from_json("not json") == D.Config() == D.Config.from_json(None) == D.Config.from_json("[]")
    assert D.Config.from_json('{"min_confidence": 0.8, "context_window": "x", "other": 1}') == D.Config(min_confidence=0.8)


def test_located_equals_finditer(spark):
    r = random.Random(1)
    texts = ["".join(r.choice("aé😀 1@.") for _ in range(r.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, text string")
    for row in df.select("k", "text", T.located(F.col("text"), "[aé]+1?").alias("m")).collect():
        want = [(len(row.text[: m.start()].encode()), len(row.text[: m.end()].encode()), m[0]) for m in re.finditer("[aé]+1?", row.text)]
        assert [tuple(m) for m in row.m] == want


def test_offsets_there_and_back(spark):
    text = "aé😀z"
    df = spark.createDataFrame([(text, k) for k in range(-1, 7)], "text string, k int")
    rows = df.select("k", T.byte_offset(F.col("text"), F.col("k")).alias("b"), T.code_point_index(F.col("text"), F.col("k").cast("bigint")).alias("c")).collect()
    assert [r.b for r in rows] == [0, 0, 1, 3, 7, 8, 8, 8]
    assert [r.c for r in rows] == [0, 0, 1, 2, 2, 3, 3, 3]


def test_small_text_functions(spark):
    df = spark.createDataFrame([("  Anna  MÜLLER ", "x" * 121, "en-US", '<a b="1">&', "😀" * 61)], "a string, b string, c string, d string, e string")
    row = df.select(
        T.normal_key(F.col("a")).alias("key"), T.length_bucket(F.col("b")).alias("bucket"), T.length_bucket(F.col("e")).alias("astral"), T.language_code(F.col("c")).alias("lang"), T.language_code(F.lit("fr")).alias("none"),
        T.escape_html(F.col("d")).alias("html"), T.context_around(F.lit("abcdefghij"), F.lit("ef"), 2, "...").alias("context"), T.truncated(F.lit("abcdefghij"), 6).alias("short"),
    ).first()
    assert tuple(row) == ("anna müller", "medium", "medium", "en", None, "&lt;a b=&quot;1&quot;&gt;&amp;", "...cdefgh...", "abc...")


def test_context_words_far_from_the_edge_of_the_neighbourhood(spark):
    """Words beyond the near bytes, words cut by their edge, a word that reaches into the span from far away."""
    near = D.NEAR_BYTES
    long = "ü" * near
    texts = [f"one two three {' ' * (2 * near)} 10.0.0.1", f"first {'é ' * near}10.0.0.1{' è' * near} last", f"far {long} x10.0.0.1", f"a b c d e f g h 10.0.0.1 {'. ' * near} one two {long} three four five six seven"]

    def plain(text, at, size):
        token = r"[^\W_]|['’\-]"
        words = lambda side: re.findall(rf"(?:{token})+", side)
        head, tail = text[:at], text[at + size :]
        head, tail = re.sub(rf"(?:{token})+$", "", head), re.sub(rf"^(?:{token})+", "", tail)
        return words(head)[::-1][:6], words(tail)[:6]

    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    at = F.instr("text", "10.0.0.1") - 1
    start = T.byte_offset(F.col("text"), at)
    s = D.span(start, start + 8, F.lit("IP_ADDRESS"), F.lit(0.9), F.lit("10.0.0.1"), F.lit("regex"))
    got = {r.id: (r.b, r.a) for r in df.withColumn("s", s).select("id", D.words_before(F.col("text"), F.col("s"), 6).alias("b"), D.words_after(F.col("text"), F.col("s"), 6).alias("a")).collect()}
    assert got == {k: plain(t, t.index("10.0.0.1"), 8) for k, t in enumerate(texts)}
