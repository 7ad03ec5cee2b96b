import random

from test_operators import union_find

import corpus_pipeline
from umbraframe.llm import similar


def plain(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def edited_copies(r, n, originals):
    """Originals, and copies of some with words replaced at scattered places."""
    texts = [" ".join(f"w{r.randrange(4000)}" for _ in range(r.randint(60, 200))) for _ in range(originals)]
    for _ in range(n - originals):
        words = r.choice(texts[:originals]).split()
        for k in r.sample(range(len(words)), r.randint(0, 5)):
            words[k] = f"w{r.randrange(4000)}"
        texts.append(" ".join(words))
    return texts


def expected(docs):
    sets = {k: plain(t) for k, t in docs.items()}
    same = lambda a, b: a == b or 5 * len(a & b) >= 4 * len(a | b)
    return union_find([(a, b) for a in sets for b in sets if a < b and same(sets[a], sets[b])], docs)


def test_groups_equal_all_pairs(spark):
    r = random.Random(7)
    docs = dict(enumerate([*edited_copies(r, 240, 60), *edited_copies(r, 80, 1), None, "", " \n", "a b", "A b", "a b c d e"]))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in similar.similar_groups(df, bucket=12).collect()}
    assert got == expected(docs) and 60 < len(set(got.values())) < 200


def test_the_stage_drops_edited_copies(spark, tmp_path):
    docs = dict(enumerate(edited_copies(random.Random(8), 90, 30)))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    kept = {x.doc_id for x in corpus_pipeline.drop_near_duplicates(spark, df, str(tmp_path)).collect()}
    want = {k for k, root in expected(docs).items() if k == root}
    assert kept == want and len(want) < 75


def test_a_family_that_is_half_alike_costs_few_pairs(spark, monkeypatch):
    """Copies of one text with so many words changed that hardly any two are similar, and some near copies."""
    r = random.Random(9)
    base = [f"w{r.randrange(4000)}" for _ in range(150)]
    docs = {}
    for k in range(300):
        words = list(base)
        for at in r.sample(range(150), 12 if k % 4 else r.randint(0, 3)):
            words[at] = f"w{r.randrange(4000)}"
        docs[k] = " ".join(words)
    tried, whole = [], similar._similar_pairs
    monkeypatch.setattr(similar, "_similar_pairs", lambda pairs, packed: tried.append(pairs.count()) or whole(pairs, packed))
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {x.doc_id: x.component_id for x in similar.similar_groups(df).collect()}
    assert got == expected(docs) and len(set(got.values())) > 200
    assert sum(tried) < 4 * len(docs)
