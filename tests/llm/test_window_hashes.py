import random

import numpy as np
import pyarrow as pa
import pytest

from umbraframe.llm import neardedup, rlz


class Held:
    value = np.zeros(0, np.uint64)


def test_windows_are_compared_by_whole_hashes(monkeypatch):
    """Windows of one anchor whose hashes differ in their lowest bits only are different; equal ones are repeats."""
    hashes = {1: 7 << 40, 2: 7 << 40 | 1, 3: 7 << 40}
    now = []

    def windows(rows, texts, hot):
        return {"row": rows, "start": np.zeros(len(rows), np.int64), "hash": np.array([hashes[now[0]]], np.uint64), "anchor": np.full(len(rows), 9, np.uint64), "place": rows}

    monkeypatch.setattr(rlz, "_windows", windows)
    sent = []
    for d in hashes:
        now[:] = [d]
        sent += rlz._emit(Held)([pa.RecordBatch.from_pydict({"id": pa.array([d], pa.int64()), "mark": pa.array([d], pa.int64()), "text": ["x"]})])
    for rows in (sent, [pa.Table.from_batches(sent).combine_chunks().to_batches()[0]]):  # one row a batch, all in one
        assert [d for b in rlz._settle(rows) for d in b.column("doc").to_pylist()] == [3]


@pytest.mark.parametrize("share", [1, 100_000])
def test_rows_and_frequent_lines(spark, monkeypatch, share):
    """Ids with several texts, repeated rows, rows without ids, and a line that nearly all texts have; whether sequences count
    as hot (share 100000: nearly all that repeat) changes no result."""
    monkeypatch.setattr(rlz, "HOT_SHARE", share)
    r = random.Random(9)
    line = " ".join(f"l{k}" for k in range(26))
    word = lambda: f"{r.choice('abcdefgh')}{r.randint(0, 400)}"
    parts = [" ".join(word() for _ in range(40)) for _ in range(15)]
    rows = []
    for k in range(160):
        text = " ".join([" ".join(word() for _ in range(r.randint(0, 30))), line if r.random() < 0.9 else "", r.choice(parts), " ".join(word() for _ in range(r.randint(0, 9)))])
        rows.append((r.choice([k, k, k // 3]), text))
    rows += [*r.sample(rows, 10), (None, rows[3][1]), (None, parts[0]), (7, None), (8, "")]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id bigint, text string, mark int, own_id string")
    marks = {x.text: x.m for x in df.select("text", neardedup.mark("text").alias("m")).collect()}
    want = rlz.brute_force(rows, lambda row: (row[0], marks[row[1]]))
    assert sorted(map(tuple, rlz.repeats_report(df.repartition(5)).collect()), key=repr) == sorted(want, key=repr)


def test_another_text_of_the_same_id_keeps_its_words(spark):
    words = [" ".join(f"{c}{k}" for k in range(60)) for c in "abc"]
    rows = [(1, words[0]), (2, words[0] + " " + words[1]), (2, words[2])]
    got = sorted((x.doc_id, x.n_words, x.n_removed) for x in rlz.repeats_report(spark.createDataFrame(rows, "doc_id bigint, text string")).collect())
    assert got == [(1, 60, 0), (2, 60, 0), (2, 120, 60)]
