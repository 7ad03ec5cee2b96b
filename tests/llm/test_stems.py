import random

from umbraframe.llm import toxicity


def test_signs_at_the_edges():
    assert [toxicity.bare(w) for w in ("idiot###", "$$stupid$$$", "«mot»", "=", "naïve", "a#b")] == ["idiot", "stupid", "mot", "", "naïve", "a#b"]


def test_a_word_beside_its_stem_takes_edits():
    entries = toxicity.choose_entries([("idio*", 5.0, 124), ("idiot", 5.0, 119), ("idiot*", 5.0, 120), ("idiots", 4.0, 6)])
    lexicon = toxicity.Lexicon(entries)
    assert "idiot*" not in entries and [lexicon.edits(w) for w in ("idiot", "idiotic", "idoit", "ixiot", "iddiot")] == [0, 0, 1, 1, 1]


def test_misspellings_of_words_that_have_endings(spark):
    r = random.Random(4)
    docs, labels = [], []
    for k in range(600):
        words = [f"c{r.randrange(3000)}" for _ in range(40)]
        if k % 6 == 0:
            words.insert(r.randrange(40), "stupid" if k % 36 else r.choice(["stupidly", "stupid$$$"]))
        docs.append((k, " ".join(words)))
        labels.append((k, 1, int(k % 6 == 0)))
    df, lab = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    model = toxicity.fit(df, lab)
    lexicon = toxicity.Lexicon(list(model.entries))
    assert [lexicon.edits(w) for w in ("stupid", "stupidly", "stipid", "stpuid")] == [0, 0, 1, 1]
