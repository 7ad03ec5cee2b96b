import json
import random

import pytest
from pyspark.sql import functions as F

from umbraframe.operators import ner
from umbraframe.operators import vault as V
from umbraframe.sources import jsonl


def test_line_numbers_of_split_files(spark, tmp_path):
    """A fault is named by its line in the file, however many tasks read it; blank lines count as lines."""
    good = {"recordType": "example", "id": "x", "language": "en", "lengthBucket": "short", "text": "plain", "goldSpans": [], "source": {"sourceFile": "f", "sourceRow": 1}}
    lines = [json.dumps({"recordType": "metadata"}), "", *[json.dumps(good | {"id": f"x{k}"}) for k in range(4000)]]
    lines[3210] = json.dumps(good | {"language": "fr"})
    path = tmp_path / "corpus.jsonl"
    path.write_text("\n".join(lines))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 40_000)
    try:
        assert spark.read.text(str(path)).rdd.getNumPartitions() > 5
        with pytest.raises(ValueError, match="line 3211:"):
            jsonl.read_corpus(spark, str(path))
        lines[3210] = "[]"
        path.write_text("\n".join(lines))
        with pytest.raises(ValueError, match="line 3211: not a metadata"):
            jsonl.read_corpus(spark, str(path))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_spans_under_all_names(spark):
    records = [
        '{"id":"1","privacy_mask":[{"start":1,"end_offset":2,"label":"","entity_type":"CITY","value":"","text":"x"},{}]}', '{"id":"2","span_labels":[[0,3,"NAME","Ada"],[5,null,7]]}',
        '{"id":"3","privacy_mask":[],"span_labels":[[0,3,"NAME"]]}', '{"id":"4"}',
    ]
    rows = jsonl.parsed_records(spark.createDataFrame([(r,) for r in records], "record string")).orderBy("id").collect()
    got = [[tuple(s) for s in r.privacy_mask] for r in rows]
    assert got == [[(1, 2, "x", "CITY"), (None, None, None, None)], [(0, 3, "Ada", "NAME"), (5, None, None, "7")], [], []]


def test_external_replacements_equal_two_dictionaries(spark):
    r = random.Random(5)
    events = [(r.randrange(3), k, f"[R_{r.randrange(6)}]", f"text {r.randrange(5)}") for k in range(80)]
    want = {}
    for c in range(3):
        keys, texts = {}, {}
        for _, _, key, text in [e for e in events if e[0] == c]:
            if texts.get(text, key) != key:
                keys.pop(texts[text], None)
            keys[key], texts[text] = text, key
        want[c] = keys
    df = spark.createDataFrame(events, "conv_id bigint, seq bigint, replacement string, original string")
    got = {c: {} for c in range(3)}
    for x in V.external_map(df).collect():
        got[x.conv_id][x.key] = x.original
    assert got == want


def test_models_are_tried_in_order(spark):
    df = spark.createDataFrame([(1, "Ada was in Berlin"), (2, ""), (3, None)], "id bigint, text string")

    def broken(chunks):
        raise ImportError("no runtime")

    def late(chunks):
        return chunks.withColumn("items", F.raise_error(F.lit("fails when it runs")).cast("array<struct<word:string,score:double,entity_type:string,start:int,end:int>>"))

    def works(chunks):
        item = F.struct(F.lit("ada").alias("word"), F.lit(0.99).alias("score"), F.lit("PERSON").alias("entity_type"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
        return chunks.withColumn("items", F.array(item))

    got = {r.id: [s.text for s in r.external] for r in ner.provided(df, "id", "transformers", {"bardsai": broken, "hikmaai": late, "ai4privacy": works}).collect()}
    assert got == {1: ["Ada"], 2: [], 3: []}
    assert all(not r.external for r in ner.provided(df, "id", "transformers", {"bardsai": broken}).collect())


def test_numbering_of_one_large_group(spark):
    """No range is large: the rows of one group are dealt over many."""
    df = spark.range(20_000).select(F.lit("A").alias("g"), F.struct((F.col("id") % 7).alias("a"), F.col("id").alias("b")).alias("o"))
    rows = V.numbered(df, ["g"], "o").orderBy("o").collect()
    assert [r.n for r in rows] == list(range(1, 20_001))
