import datetime as dt

from umbraframe.operators import detect
from umbraframe.streaming import flows


def stream(spark, tmp_path, rows, schema, build, mode="append"):
    """Files as a stream through a transformation into a memory table."""
    src = str(tmp_path / "src")
    for k, some in enumerate(rows):
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{src}/{k}")
    df = spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(src)
    query = build(df).writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    query.stop()
    return spark.table("out").collect()


def at(ms):
    return dt.datetime(2024, 1, 1) + dt.timedelta(milliseconds=ms)


def test_detection_on_a_stream_equals_the_batch(spark, tmp_path):
    rows = [[(1, "mail a@b.org")], [(2, "call +49 30 12345678"), (3, None)]]
    got = stream(spark, tmp_path, rows, "id int, text string", lambda df: detect.exploded(flows.detected(df), "id"))
    want = detect.exploded(detect.detect(spark.createDataFrame(sum(rows, []), "id int, text string")), "id").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) == 2


def test_quiet_texts(spark, tmp_path):
    rows = [("a", at(0), "x"), ("a", at(300), "xy"), ("a", at(2000), "z"), ("a", at(100_000), "end")]
    schema = "k string, ts timestamp, text string"
    batch = flows.quiet_texts(spark.createDataFrame(rows, schema), "k").collect()
    assert sorted(r.text for r in batch) == ["end", "xy", "z"]
    got = stream(spark, tmp_path, [rows[:3], rows[3:], [("b", at(200_000), "late")]], schema, lambda df: flows.quiet_texts(df, "k"))
    assert {"xy", "z"} <= {r.text for r in got}


def test_repeats(spark, tmp_path):
    rows = [("a", 0, "x"), ("a", 100, "x"), ("a", 200, "y"), ("a", 300, "x"), ("a", 900, "x")]
    want = [0, 200, 300, 900]
    assert sorted(r["at"] for r in flows.without_repeats_batch(spark.createDataFrame(rows, "k string, at bigint, text string"), "k").collect()) == want
    got = stream(spark, tmp_path, [rows[:2], rows[2:]], "k string, at bigint, text string", lambda df: flows.without_repeats(df, "k"))
    assert sorted(r["at"] for r in got) == want


def test_cancelled(spark):
    results = spark.createDataFrame([(1, at(1000)), (2, at(1000)), (3, at(600_000))], "k int, ts timestamp")
    cancels = spark.createDataFrame([(1, at(500)), (2, at(2000)), (3, at(0))], "k int, ts timestamp")
    assert sorted(r.k for r in flows.not_cancelled(results, cancels, "k").collect()) == [2, 3]


def test_vault_stream(spark, tmp_path):
    rows = [[("PERSON", "Ada", 1), ("PERSON", "Bob", 2)], [("PERSON", " ada", 3), ("PERSON", "Eve", 4), ("EMAIL", "a@b", 5)]]
    got = stream(spark, tmp_path, rows, "entity_type string, text string, seq bigint", flows.vault_records)
    assert sorted((r.normalized_key, r.placeholder) for r in got) == [("a@b", "[EMAIL_1]"), ("ada", "[PERSON_1]"), ("bob", "[PERSON_2]"), ("eve", "[PERSON_3]")]


def test_running_thresholds_and_log(spark, tmp_path):
    rows = [[("EMAIL", "NOT_PII", 1)], [("EMAIL", "NOT_PII", 2), (None, "EMAIL", 3)]]
    got = stream(spark, tmp_path, rows, "detected_type string, corrected_type string, n bigint", lambda df: flows.running_thresholds(df, 0.5), "complete")
    assert {r.entity_type: round(r.threshold, 4) for r in got} == {"EMAIL": 0.5667}
    merge = flows.keep_log(str(tmp_path / "log"), "n", 2)
    for k, some in enumerate(rows):
        merge(spark.createDataFrame(some, "detected_type string, corrected_type string, n bigint"), k)
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "log" / "1")).collect()) == [2, 3]


def test_sessions(spark):
    rows = [("u", at(0)), ("u", at(20_000)), ("u", at(60_000))]
    assert sorted(r.n_events for r in flows.activity(spark.createDataFrame(rows, "u string, ts timestamp"), "u").collect()) == [1, 2]
