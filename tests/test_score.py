import json
import random

import pytest

from umbraframe.functions import constants as C
from umbraframe.operators import corpus, score
from umbraframe.sources import jsonl

SPAN = "example_id int, {0}_index int, start bigint, end bigint, entity_type string"


def scored(spark, gold, found, examples=None, **tolerance):
    g = spark.createDataFrame(gold, SPAN.format("gold"))
    f = spark.createDataFrame(found, SPAN.format("found"))
    ids = sorted({x[0] for x in gold} | {x[0] for x in found} | set(examples or ()))
    e = spark.createDataFrame([(i, "en", "short") for i in ids], "example_id int, language string, length_bucket string")
    m = score.matches(score.candidates(g, f, score.Tolerance(**tolerance)))
    return score.with_bucket(score.outcomes(g, f, m), e, g), m, e, g


def headline(spark, gold, found):
    r = score.headline(scored(spark, gold, found)[0]).first()
    return r.tp, r.fp, r.fn


def test_cases(spark):
    g = [(1, 0, 10, 20, "EMAIL")]
    assert headline(spark, g, [(1, 0, 10, 20, "EMAIL")]) == (1, 0, 0)
    assert headline(spark, g, [(1, 0, 9, 21, "PERSON")]) == (1, 0, 0)
    assert headline(spark, g, [(1, 0, 0, 40, "EMAIL")]) == (0, 1, 1)
    assert headline(spark, g, [(1, 0, 16, 24, "EMAIL")]) == (0, 1, 1)
    assert headline(spark, g, [(1, 0, 10, 20, "EMAIL"), (1, 1, 10, 20, "EMAIL")]) == (1, 1, 0)
    assert headline(spark, [*g, (1, 1, 22, 32, "EMAIL")], [(1, 0, 9, 33, "EMAIL")]) == (0, 1, 2)


def test_negative_and_misc_examples_are_apart(spark):
    gold, found = [(1, 0, 0, 5, "EMAIL"), (2, 0, 0, 5, "MISC")], [(2, 0, 0, 5, "MISC"), (3, 0, 0, 5, "URL"), (3, 1, 9, 12, "URL")]
    rows, _, e, g = scored(spark, gold, found, examples=[4])
    neg = score.negatives(rows, e, g).first()
    assert (neg.examples, neg.passed, neg.failed, neg.false_positive_rate) == (2, 1, 1, 1.0)
    assert score.metrics(rows.where("kind = 'misc'")).first().tp == 1
    assert score.headline(rows).first().fn == 1
    types = {r.entity_type: r for r in score.by_type(rows).collect()}
    assert len(types) == 16 and types["EMAIL"].fn == 1 and types["URL"].fp == 0


def test_greedy_equals_the_loop(spark):
    r = random.Random(2)
    gold = [(e, k, s, s + r.randint(3, 9), "EMAIL") for e in range(40) for k, s in enumerate(r.choices(range(30), k=5))]
    found = [(e, k, s, s + r.randint(3, 9), "EMAIL") for e in range(40) for k, s in enumerate(r.choices(range(30), k=5))]
    want = set()
    for e in range(40):
        pairs = []
        for _, i, a, b, _ in (x for x in gold if x[0] == e):
            for _, j, c, d, _ in (x for x in found if x[0] == e):
                o = min(b, d) - max(a, c)
                if o > 0 and max(0, c - a, b - d) <= 2 and o / (b - a) >= 0.8 and o / (d - c) >= 0.5:
                    pairs.append((-o / (b - a), -o / (d - c), max(0, c - a, b - d), abs((d - c) - (b - a)), i, j))
        used_g, used_f = set(), set()
        for *_, i, j in sorted(pairs):
            if i not in used_g and j not in used_f:
                used_g.add(i)
                used_f.add(j)
                want.add((e, i, j))
    assert {(m.example_id, m.gold_index, m.found_index) for m in scored(spark, gold, found)[1].collect()} == want


def test_latency_is_nearest_rank(spark):
    r = score.latency(spark.createDataFrame([(float(x),) for x in (10, 20, 30, 40)], "ms double"), "ms").first()
    assert (r["count"], r.p50_ms, r.p95_ms, r.max_ms) == (4, 20.0, 40.0, 40.0)
    assert tuple(score.latency(spark.createDataFrame([], "ms double"), "ms").first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)


def test_report_text():
    row = {"tp": 1, "fp": 0, "fn": 1, "precision": 1.0, "recall": 0.5, "f1": 2 / 3}
    text = score.report_text("run", row, [{"entity_type": "EMAIL", **row}], {"average_ms": 1.5, "p50_ms": 1.0, "p95_ms": 2.25, "max_ms": 3.12345})
    assert "recall 50.0%" in text and "p95 2.25 max 3.123" in text


RAW = {"id": "r1", "language": "en-US", "source_text": "Ada is in Köln, Köln", "privacy_mask": [{"start": 0, "end": 3, "value": "Ada", "label": "FULL_NAME"}, {"start": 1, "end": 2, "value": "Köln", "label": "city"}, {"value": "Ada", "label": "UNKNOWN"}]}


def test_records_to_examples(spark, tmp_path):
    path = tmp_path / "raw.json"
    path.write_text(json.dumps({"data": [RAW, {"id": "r2", "language": "fr", "source_text": "x"}, {"id": "r3", "language": "Deutsch", "source_text": "nichts", "privacy_mask": []}]}), encoding="utf-8")
    df = corpus.examples(jsonl.read_raw_json(spark, str(path)))
    rows = {r.id: r for r in df.collect()}
    assert set(rows) == {"r1", "r3"} and rows["r3"].gold == [] and rows["r1"].language == "en"
    assert [tuple(g) for g in rows["r1"].gold] == [(0, 3, "PERSON", "Ada"), (10, 15, "LOCATION", "Köln")]
    assert corpus.violations(df).count() == 0
    out = str(tmp_path / "corpus")
    jsonl.write_corpus(df, out, {"corpusId": "c"})
    metadata, again = jsonl.read_corpus(spark, out)
    assert metadata["corpusId"] == "c" and again.count() == 2
    counts = {(r.what, r.key): r.n for r in corpus.summary(again).collect()}
    assert counts["examples", "negative"] == 1 and counts["entity_type", "PERSON"] == 1


def test_corpus_errors(spark, tmp_path):
    good = {"recordType": "example", "id": "a", "language": "en", "lengthBucket": "short", "text": "é x", "goldSpans": [{"start": 1, "end": 2, "entity_type": "EMAIL", "text": "x"}], "source": {}}
    for k, lines in enumerate(([good], [{"recordType": "metadata"}], [{"recordType": "metadata"}, good], [{"recordType": "metadata"}, {"recordType": "odd"}])):
        path = tmp_path / f"{k}.jsonl"
        path.write_text("\n\n".join(map(json.dumps, lines)), encoding="utf-8")
        with pytest.raises(ValueError):
            jsonl.read_corpus(spark, str(path))


def test_repair():
    lines = ['{"id": "a", "t": "one', 'two"}', "", '{"id": "b"}']
    assert [(f, json.loads(r), x) for f, r, x in jsonl.repaired(iter(lines))] == [(1, {"id": "a", "t": "one\ntwo"}, True), (4, {"id": "b"}, False)]
    with pytest.raises(ValueError):
        list(jsonl.repaired(iter(['{"a" 1}'])))


def test_raw_jsonl(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text(json.dumps(RAW) + '\n{"id": "x", "source_text": "a\nb"}\n', encoding="utf-8")
    rows = jsonl.read_raw_jsonl(spark, str(tmp_path / "r.jsonl")).orderBy("source_row").collect()
    assert [(r.source_row, r.was_repaired, r.id) for r in rows] == [(1, False, "r1"), (2, True, "x")] and rows[1].source_text == "a\nb"


def test_vault_rows_need_all_fields(spark, tmp_path):
    full = {"id": "1", "originalText": "Ada", "normalizedKey": "ada", "entityType": "PERSON", "placeholder": "[PERSON_1]", "syntheticValue": "", "replacementMode": "placeholder", "pinned": False, "createdAt": 1, "updatedAt": 1, "lastSeenAt": 1, "usageCount": 1}
    bad = [{**full, "usageCount": -1}, {**full, "entityType": "X"}, {k: v for k, v in full.items() if k != "pinned"}]
    (tmp_path / "v.jsonl").write_text("\n".join(map(json.dumps, [full, *bad])))
    assert jsonl.read_vault(spark, str(tmp_path / "v.jsonl")).count() == 1


def test_sample_equals_one_pass_over_all(spark):
    r = random.Random(7)
    rows = [(k, r.choice(["en", "de"]), r.choice(["short", "medium", "long"]), sorted(r.sample(["EMAIL", "PERSON", "SSN", "URL", "MISC"], r.choice([0, 1, 1, 2]))), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "id int, language string, length_bucket string, types array<string>, place bigint")
    for limit, neg, misc in ((100, 25, 50), (40, 5, 5), (500, 25, 50)):
        want = corpus.place_examples([(i, lang, b, sorted(t)) for i, lang, b, t, _ in rows], limit, neg, misc)
        got = [x.id for x in corpus.coverage_sample(df, limit, neg, misc).collect()]
        assert sorted(got) == sorted(want) and len(got) == limit


def test_corpus_labels(spark):
    from pyspark.sql import functions as F

    of = lambda v: spark.range(1).select(corpus.corpus_type(F.lit(v)).alias("v")).first().v
    assert [of(x) for x in ("full name", "POSTAL_CODE", "pin", "Email", "nope")] == ["PERSON", "MISC", "MISC", "EMAIL", None]
    assert set(C.SAMPLED_TYPES) <= set(C.ENTITY_TYPES)


def test_full_report():
    m = {"tp": 1, "fp": 0, "fn": 1, "precision": 1.0, "recall": 0.5, "f1": 2 / 3}
    accuracy = {"type_accuracy": 1.0, "type_correct": 1, "matched": 1}
    times = {"average_ms": 1.5, "p50_ms": 1.0, "p95_ms": 2.25, "max_ms": 3.6}
    sample = {"example_id": "e1", "entity_type": "EMAIL", "text": "y" * 70, "start": 1, "end": 71, "detected_type": "PHONE", "score": 0.12345, "context": "around"}
    report = {
        "corpus": {"id": "c", "examples": 2, "schema": 1, "dataset": "d", "revision": "r1", "unit": "utf8-bytes", "scoring": "span"}, "mode": "regex-only", "config": {"provider": "off", "model": "bardsai", "ner_enabled": False, "min_confidence": 0.5, "context_boost": 0.15, "context_window": 5},
        "provider": {"state": "ready"}, "headline": m | accuracy, "languages": {"en": m}, "lengths": {"short": m}, "types": {"EMAIL": m, "PHONE": m | {"tp": 0, "fn": 0}}, "negative": {"passed": 1, "examples": 2, "pass_rate": 0.5, "false_positive_rate": 1.25},
        "misc": m | accuracy | {"examples": 1, "gold_spans": 3}, "wall_ms": 12.4, "latency": times, "ner": None, "load_ms": None, "missed": [sample], "wrong": [],
    }
    lines = score.full_report(report).split("\n")
    assert lines[:3] == ["OpenPII benchmark", "Corpus: c (2 examples, schema 1)", "Source: d @ r1"] and lines[4] == ""
    assert "Micro span P/R/F1: 100.0% / 50.0% / 66.7% (TP 1, FP 0, FN 1)" in lines and "Entity: EMAIL 66.7% (TP 1, FP 0, FN 1)" in lines
    assert "Negative examples: 1/2 passed (50.0%); false positives/example 1.25" in lines and "Min confidence: 0.5; context boost: 0.15; context window: 5" in lines
    assert "Per example: avg 2 ms, p50 1 ms, p95 2 ms, max 4 ms" in lines and "NER timing: unavailable" in lines
    assert f'- e1 EMAIL "{"y" * 57}..." [1-71, detected PHONE, score 0.123] :: around' in lines and lines[-1] == "none"


def test_latency_over_many_ranges(spark):
    import random

    r = random.Random(3)
    values = [r.choice([1.0, 2.5, r.random() * 100]) for _ in range(999)]
    row = score.latency(spark.createDataFrame([(v,) for v in [*values, None]], "ms double"), "ms").first()
    s = sorted(values)
    assert (row["count"], row.p50_ms, row.p95_ms, row.max_ms) == (999, s[499], s[949], s[-1]) and abs(row.total_ms - sum(values)) < 1e-6
    assert tuple(score.latency(spark.createDataFrame([], "ms double"), "ms").first()) == (0, 0.0, 0.0, 0.0, 0.0, 0.0)
