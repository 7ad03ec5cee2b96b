import pytest
from pyspark.sql import functions as F

from umbraframe.functions import text as T
from umbraframe.operators import ner as N

ITEM = "struct<word:string,score:double,entity_type:string,start:int,end:int>"


def run(spark, text, items, column):
    df = spark.createDataFrame([(text, [(w, s, t, *(more or (None, None))) for w, s, t, *more in items])], f"text string, items array<{ITEM}>")
    return [tuple(s) for s in df.select(column(F.col("text"), F.col("items")).alias("s")).first().s]


def test_ranges_from_uncased_words(spark):
    text = "Ada Lovelace works at Acme Corp in Berlin."
    out = run(spark, text, [("ada", 0.99, "PERSON"), ("acme corp", 0.92, "ORGANIZATION"), ("berlin", 0.94, "LOCATION")], N.model_spans)
    assert [(s[2], s[4]) for s in out] == [("PERSON", "Ada"), ("ORGANIZATION", "Acme Corp"), ("LOCATION", "Berlin")]


def test_spaced_punctuation(spark):
    text = "Open https://portal.example/private with alice_admin. Password: P@ssw0rd123!"
    out = run(spark, text, [("https : / / portal. example / private", 0.98, "URL"), ("alice _ admin", 0.98, "USERNAME"), ("p @ ssw0rd123", 0.88, "PASSWORD")], N.model_spans)
    assert [s[4] for s in out] == ["https://portal.example/private", "alice_admin", "P@ssw0rd123"]


def test_fragments_are_stitched_and_grown(spark):
    text = "Email john@example.com and mention condition asthma."
    items = [("joh", 0.99, "EMAIL"), ("n", 0.98, "EMAIL"), ("ex", 0.88, "EMAIL"), ("a", 0.65, "EMAIL"), ("mple", 0.56, "EMAIL"), (".", 0.27, "EMAIL"), ("com", 0.38, "EMAIL"), ("asth", 0.72, "MISC")]
    out = run(spark, text, items, lambda t, i: N.model_spans(t, i, "bardsai"))
    assert [(s[2], s[4], s[3]) for s in out] == [("EMAIL", "john@example.com", 0.99), ("MISC", "asthma", 0.72)]
    assert len(run(spark, text, items, lambda t, i: N.model_spans(t, i, "ai4privacy"))) == 1


def test_street_fragments(spark):
    out = run(spark, "Office at Andreas Hofer Weg 455 in Innsbruck.", [("Andreas", 0.82, "ADDRESS"), ("Hofer Weg", 0.78, "ADDRESS"), ("455", 0.91, "ADDRESS"), ("Innsbruck", 0.88, "LOCATION")], N.model_spans)
    assert [(s[4], s[3]) for s in out] == [("Andreas Hofer Weg 455", 0.91), ("Innsbruck", 0.88)]


def test_overlaps_leave_the_better(spark):
    rows = [([(0, 5, "PERSON", 0.9, "", "ner"), (3, 9, "PERSON", 0.9, "", "ner"), (0, 5, "URL", 0.1, "", "ner")],), ([(0, 5, "PERSON", 0.95, "", "ner"), (3, 9, "PERSON", 0.9, "", "ner")],)]
    df = spark.createDataFrame(rows, f"s array<{T.SPAN}>")
    got = [[tuple(x)[:4] for x in r.m] for r in df.select(N.best_of_overlaps(F.col("s")).alias("m")).collect()]
    assert got == [[(0, 5, "URL", 0.1), (3, 9, "PERSON", 0.9)], [(0, 5, "PERSON", 0.95)]]


@pytest.mark.parametrize(("raw", "want"), [("B-FIRSTNAME", "FIRSTNAME"), ("firstName", "FIRST_NAME"), ("[email address]", "EMAIL_ADDRESS"), ("I-per", "PER"), ("__x--y__", "X_Y")])
def test_label_names(spark, raw, want):
    assert spark.range(1).select(N.label_name(F.lit(raw)).alias("v")).first().v == want


def test_labels_by_model(spark):
    df = spark.createDataFrame([("bardsai", "PIN"), ("ai4privacy", "PIN"), ("hikmaai", "CITY")], "m string, l string")
    assert sorted((r.model, r.entity_type) for r in N.mapped(df, F.col("m"), F.col("l")).collect()) == [("ai4privacy", "PASSWORD"), ("hikmaai", "LOCATION")]


def test_dictionary_in_bytes(spark):
    text = "Anna Müller, Berlin; Anna Müller"
    got = spark.range(1).select(N.dictionary_spans(F.lit(text)).alias("s")).first().s
    assert [(s.start, s.text) for s in got] == [(0, "Anna Müller"), (14, "Berlin"), (22, "Anna Müller")]


def test_chunks(spark):
    text = "alpha beta gamma delta epsilon zeta eta theta"
    bounds = N.chunk_bounds(text, 24, 8)
    assert bounds[0][0] == 0 and bounds[-1][1] == len(text) and all(b - a <= 24 for a, b in bounds)
    assert all(c == b - 8 for (_, b), (c, _) in zip(bounds[:-1], bounds[1:], strict=True))
    assert N.chunk_bounds("x" * 30, 10, 20) == [(k, k + 10) for k in range(0, 21)]
    rows = N.chunks(spark.createDataFrame([(1, "é" * 12), (2, None)], "id int, text string"), "id", most=5, overlap=0).collect()
    assert [(r.id, r.start_byte, r.end_byte) for r in rows] == [(1, 0, 10), (1, 10, 20), (1, 20, 24)]
    with pytest.raises(ValueError):
        N.chunk_bounds("x", 0)
