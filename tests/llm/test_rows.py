"""Tables in which one id has several texts, rows repeat, ids are null, and columns have the operators' own names."""

import random

import pytest
from test_operators import plain_fingerprint, union_find
from test_similar import edited_copies, plain

from umbraframe.llm import neardedup, similar


def rowed(seed, n=60):
    """(id, text) rows: some ids repeat with other texts, some rows repeat whole, some ids are null."""
    r = random.Random(seed)
    texts = [*edited_copies(r, n, n // 2), None, "", "a b", "A  b"]
    rows = [(k, t) for k, t in enumerate(texts)]
    rows += [(r.randrange(n), r.choice(texts)) for _ in range(n // 2)]
    return [*rows, *r.sample(rows, 8), (None, texts[0]), (None, None)]


def by_row(rows, linked):
    """(id, text) rows to component ids: rows are the nodes, so an id with two texts is two nodes."""
    nodes = sorted({(i, t or "") for i, t in rows if i is not None})
    roots = union_find([(a, b) for a in nodes for b in nodes if a < b and linked(a[1], b[1])], nodes)
    return {n: roots[n][0] for n in nodes}


def kept_rows(rows, components):
    """The rows that stay: of each component the smallest id, one row; rows without an id."""
    least = {}
    for node, root in components.items():
        if node[0] == root:
            least.setdefault(root, []).append(node)
    return least


GROUPS = [
    (neardedup.near_duplicates, neardedup.keep_one_each, lambda a, b: (plain_fingerprint(a) ^ plain_fingerprint(b)).bit_count() <= 2),
    (similar.similar_groups, similar.keep_one_each, lambda a, b: plain(a) == plain(b) or 5 * len(plain(a) & plain(b)) >= 4 * len(plain(a) | plain(b))),
]


@pytest.mark.parametrize("case", GROUPS, ids=["fingerprints", "similarity"])
def test_rows_of_one_id_are_rows_of_their_own(spark, case):
    groups, keep, linked = case
    rows = rowed(11)
    df = spark.createDataFrame([(i, t, "x", 1, 2, 3.5, "k") for i, t in rows], "doc_id bigint, text string, id string, _nd_id int, mark int, n double, component_id string")
    want = by_row(rows, linked)
    marks = {(x.doc_id, x.m): x.text or "" for x in df.select("doc_id", "text", neardedup.mark("text").alias("m")).collect()}
    got = [((x.doc_id, marks[x.doc_id, x["mark"]]), x.component_id) for x in groups(df).collect()]
    assert sorted(got) == sorted(((i, t or ""), want[i, t or ""]) for i, t in rows if i is not None)
    kept = keep(df)
    assert kept.columns == df.columns
    left, least = [(x.doc_id, x.text or "") for x in kept.collect()], kept_rows(rows, want)
    assert sorted(t for i, t in left if i is None) == sorted(t or "" for i, t in rows if i is None)
    own = [x for x in left if x[0] is not None]
    # The smallest id of each component, once, by one of the texts that this id has there.
    assert sorted(want[x] for x in own) == sorted(set(want.values())) and all(x in least[want[x]] for x in own)


def test_an_id_with_two_texts_links_no_strangers(spark):
    """A' is near A, B is near nothing but B: the id that has A and B doesn't bring them together, and (1, A) goes."""
    a, b = " ".join(f"a{k}" for k in range(300)), " ".join(f"b{k}" for k in range(300))
    df = spark.createDataFrame([(0, a), (1, a), (1, b), (9, b)], "doc_id bigint, text string")
    assert sorted((x.doc_id, x.component_id) for x in neardedup.near_duplicates(df).collect()) == [(0, 0), (1, 0), (1, 1), (9, 1)]
    assert sorted((x.doc_id, x.text[0]) for x in neardedup.keep_one_each(df).collect()) == [(0, "a"), (1, "b")]


@pytest.mark.parametrize("bucket", [1, 3, 128])
def test_hot_keys_are_split_without_losing_links(spark, bucket):
    r = random.Random(5)
    centre = [r.getrandbits(64) for _ in range(3)]
    fps = {c ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 5))) for c in centre for _ in range(150)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    df = spark.createDataFrame([(x,) for x in signed], "fp bigint")
    got = [(x.a, x.b) for x in neardedup.links(df, bucket).collect()]
    near = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 2
    assert all(near(a, b) for a, b in got)
    every = [(a, b) for a in signed for b in signed if a < b and near(a, b)]
    assert union_find(got, signed) == union_find(every, signed)
