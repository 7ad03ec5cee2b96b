import hashlib
import random

import numpy as np
import public_tokenizers
import tiktoken
from test_operators import made, plain_fingerprint, plain_spans, union_find

import corpus_pipeline
from umbraframe.llm import bpe, wumanber


def test_pipeline_equals_plain_python(spark, tmp_path):
    r = random.Random(3)
    docs, labels = made(4, 900)
    toxic = {k for k, _, t in labels if t}
    items = [(0, " ".join(f"b{k}" for k in range(30))), (1, "short item words")]
    texts = dict(docs)
    clean = [k for k in texts if k not in toxic]
    for k in r.sample(clean, 60):
        texts[k] += " " + r.choice([items[0][1], "short item words", "token=abcdef123456", "0123456789abcdef01234567 end"])
    for k, j in zip(r.sample(clean, 40), r.sample(clean, 40), strict=True):
        texts[max(k, j)] = texts[min(k, j)]
    rows = [(k, t, "en", "s", len(t)) for k, t in texts.items()] + [(2000, None, "en", "s", 0), (2001, "", "en", None, 0)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    left = {k: t for k, t, *_ in rows if k not in toxic}
    fps = {k: plain_fingerprint(t) for k, t in left.items()}
    close = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
    left = {k: left[k] for k, root in union_find(close, fps).items() if k == root}
    left = {w[0]: left[w[0]] for w in wumanber.brute_force(left.items(), items) if not w[5]}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(bpe.default_tokenizer()[0]), special_tokens={})
    want = {}
    for k, t in left.items():
        text, parts, at = t or "", [], 0
        for _, start, end in plain_spans(text):
            if end > at:
                parts += [text[at:start], "[SECRET]"] if start >= at else []
                at = end
        text = "".join(parts) + text[at:]
        ids = library.encode_ordinary(text)
        want[k] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())
    got = {x.doc_id: (x.n_tokens, x.ids_sha256, x.decoded_sha256) for x in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 500 < len(got) < len(clean)


def test_stages_keep_the_columns(spark, tmp_path):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for rows in ([], [(1, None, None, None, None), (2, "a b", "en", "s", 3), (2, "a b", "en", "s", 3)]):
        df = spark.createDataFrame(rows, schema)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            assert stage(spark, df, str(tmp_path)).dtypes == df.dtypes, name
        assert corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).count() == len(rows)
