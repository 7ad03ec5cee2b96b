import pytest
from pyspark.sql import functions as F

from umbraframe.functions import text as T
from umbraframe.operators import policy as P

PATTERNS = [
    ("Smith", "Smith", ["Smith"]), ("Hired Smith today", "Smith", ["Smith"]), ("nothing here", "Smith", []), ("Smith SMITH smith", "Smith", ["Smith", "SMITH", "smith"]), ("smithsonian hired Smith", "Smith", ["Smith"]),
    ("goldsmith", "Smith", []), ("aSmithB", "Smith", []), ("acme-prod acme-dev", "acme-*", ["acme-prod", "acme-dev"]), ("acme prod", "acme-*", []), ("acme-", "acme-*", []), ("acme-!prod", "acme-*", []),
    ("foobar barfoo", "*bar", ["foobar"]), ("foobar barfoo xbarx", "*bar*", ["xbarx"]), ("a b a", "a", ["a", "a"]), ("user.name other", "user.name", ["user.name"]), ("userXname", "user.name", []),
    ("+49 30 123456 is allowed", "+49 30 123456", ["+49 30 123456"]), ("Call (555) 123-4567 today", "(555) 123-4567", ["(555) 123-4567"]), ("Use https://example.com/ here", "https://example.com/", ["https://example.com/"]),
    ("x+49 30 123456", "+49 30 123456", []), ("+49 30 123456x", "+49 30 123456", []), ("Hello Müller there", "Müller", ["Müller"]),
]
REGIONS = [
    ("hello `world` there", []), ("just plain", []), ("```\nhello\n```", [(0, 13)]), ("```js\nhello\n```", [(0, 15)]), ("prose\n```\ncode\n```\nmore", [(6, 18)]), ("```\nfoo\n```\nprose\n```\nbar\n```", [(0, 11), (18, 29)]),
    ("```\nhello\nworld", [(0, 15)]), ("```\n```", [(0, 7)]), ("```\nhello `world` end\n```", [(0, 25)]), ("<code>hello</code>", [(0, 18)]), ('<code class="js">foo</code>', [(0, 27)]), ("before <code>x</code> after", [(7, 21)]),
    ("<pre>world</pre>", [(0, 16)]), ("````\nhello\n````", [(0, 15)]), ("````\na\n```\nb", [(0, 12)]), ("é\n```\nx\n```", [(3, 12)]),
]


@pytest.mark.parametrize("pattern", sorted({p for _, p, _ in PATTERNS}))
def test_wildcards(spark, pattern):
    rows = [(t, want) for t, p, want in PATTERNS if p == pattern]
    df = spark.createDataFrame(rows, "text string, want array<string>")
    for r in df.select("text", "want", T.wildcard_matches(F.col("text"), pattern).alias("m")).collect():
        assert [m.text for m in r.m] == r.want
        assert all(r.text.encode()[m.start : m.end].decode() == m.text for m in r.m)


def test_code_regions(spark):
    df = spark.createDataFrame([(t, k) for k, (t, _) in enumerate(REGIONS)], "text string, k int")
    for r in df.select("k", P.code_regions(F.col("text")).alias("m")).collect():
        assert [tuple(m) for m in r.m] == REGIONS[r.k][1], REGIONS[r.k][0]


def one(spark, text, spans, column):
    df = spark.createDataFrame([(text, spans)], f"text string, spans array<{T.SPAN}>")
    return [tuple(s) for s in df.select(column(F.col("text"), F.col("spans")).alias("s")).first().s]


def test_allowlist_covers_split_phrases(spark):
    spans = [(0, 4, "PERSON", 0.9, "John", "ner"), (5, 8, "PERSON", 0.9, "Doe", "ner"), (13, 17, "PERSON", 0.9, "Jane", "ner")]
    out = one(spark, "John Doe and Jane", spans, lambda t, s: P.without_allowed(t, s, ["john doe"]))
    assert [s[4] for s in out] == ["Jane"]


def test_blocklist_beats_allowlist_and_keeps_ranges_once(spark):
    text, spans = "Büro Acme x Acme", [(6, 10, "ORGANIZATION", 0.9, "Acme", "ner")]
    out = one(spark, text, spans, lambda t, s: P.with_blocked(t, P.without_allowed(t, s, ["acme"]), [("acme", "any"), ("ACME", "URL")]))
    assert out == [(6, 10, "MISC", 1.0, "Acme", "manual"), (13, 17, "MISC", 1.0, "Acme", "manual")]


def test_review_order(spark):
    text = "```\na@b.com\n``` 12/05/2023 c@d.org"
    spans = [(4, 11, "EMAIL", 0.95, "a@b.com", "regex"), (16, 26, "DATE", 0.9, "12/05/2023", "regex"), (27, 34, "EMAIL", 0.3, "c@d.org", "regex")]
    out = one(spark, text, spans, lambda t, s: P.review(t, s))
    assert [(s[4], s[6]) for s in out] == [("a@b.com", True)]
    assert [s[4] for s in one(spark, text, spans, lambda t, s: P.review(t, s, enabled={"Low-signal": True}, adaptive=F.create_map(F.lit("EMAIL"), F.lit(0.2))))] == ["a@b.com", "12/05/2023", "c@d.org"]


def test_thresholds(spark):
    of = lambda t, x, **m: spark.range(1).select(P.threshold(F.lit(t), x, **m).alias("v")).first().v
    assert [round(of("PASSWORD", x), 6) for x in (0.0, 0.5, 1.0)] == [0.75, 0.7, 0.65]
    assert round(of("EMAIL", 0.5, mode="individual", overrides={"Contact": 1.0}), 6) == 0.2
    assert round(of("DATE", 0.0), 6) == 0.7
    assert P.minimum_threshold(0.5) == pytest.approx(0.4)


def test_adaptive(spark):
    rows = [("EMAIL", "NOT_PII")] * 3 + [("EMAIL", "PHONE"), (None, "EMAIL"), (None, "PERSON"), ("", "PERSON")]
    got = {r.entity_type: round(r.threshold, 6) for r in P.adaptive_thresholds(spark.createDataFrame(rows, "detected_type string, corrected_type string"), 0.5).collect()}
    assert got == {"EMAIL": 0.6, "PERSON": 0.3}
