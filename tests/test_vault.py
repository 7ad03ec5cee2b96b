import pytest
from pyspark.sql import functions as F

from umbraframe.functions import text as T
from umbraframe.operators import anonymize as A
from umbraframe.operators import vault as V

MENTION = "conv_id bigint, seq bigint, start bigint, entity_type string, text string"


def test_entity_map_numbers_and_restores_counters(spark):
    rows = [(1, 10, 0, "PERSON", "Ada"), (1, 20, 5, "PERSON", "Bob"), (1, 30, 9, "PERSON", "Ada"), (1, 40, 9, "ORGANIZATION", "Ada"), (2, 50, 0, "PERSON", "Bob")]
    df = spark.createDataFrame(rows, MENTION)
    got = {(r.conv_id, r.original): r.placeholder for r in V.entity_map(df).collect()}
    assert got == {(1, "Ada"): "[PERSON_1]", (1, "Bob"): "[PERSON_2]", (2, "Bob"): "[PERSON_1]"}
    stored = spark.createDataFrame([(1, "[PERSON_7]", "Bob")], "conv_id bigint, placeholder string, original string")
    got = {(r.conv_id, r.original): r.placeholder for r in V.entity_map(df, stored).collect()}
    assert got == {(1, "Bob"): "[PERSON_7]", (1, "Ada"): "[PERSON_8]", (2, "Bob"): "[PERSON_1]"}


def test_vault_shares_variants_and_separates_types(spark):
    rows = [(1, 1, 0, "PERSON", "Ada  Lovelace"), (2, 2, 0, "PERSON", "ada lovelace "), (2, 3, 0, "LOCATION", "Ada Lovelace"), (3, 4, 0, "URL", "http://x")]
    got = {(r.entity_type, r.normalized_key): r for r in V.vault(spark.createDataFrame(rows, MENTION), mode="synthetic").collect()}
    ada = got["PERSON", "ada lovelace"]
    assert (ada.original_text, ada.placeholder, ada.synthetic_value, ada.usage_count, ada.replacement_mode) == ("Ada  Lovelace", "[PERSON_1]", "Jordan Park", 2, "synthetic")
    assert got["LOCATION", "ada lovelace"].placeholder == "[LOCATION_1]"
    assert (got["URL", "http://x"].synthetic_value, got["URL", "http://x"].replacement_mode) == ("", "placeholder")


def test_numbering_passes_strides(spark):
    df = spark.range(0, 50).select(F.lit("A").alias("g"), (F.col("id") * 700_000).alias("o"))
    assert [r.n for r in V.numbered(df, ["g"], "o").orderBy("o").collect()] == list(range(1, 51))


@pytest.mark.parametrize(
    ("kind", "i", "want"),
    [("PERSON", 0, "Jordan Park"), ("PERSON", 24, "Jordan Park 2"), ("EMAIL", 0, "jordan.park@example.com"), ("EMAIL", 25, "casey.morrow.2@example.org"), ("CREDIT_CARD", 4, "4111 1111 1111 1111-2"), ("SSN", 12, "900-92-0117-3"), ("IBAN", 3, "GB82 WEST 1234 5698 7654 32 2"), ("IP_ADDRESS", 6, "192.0.2.10 2"), ("URL", 0, None), ("DATE", 1, None), ("PASSWORD", 2, None)],
)
def test_synthetic_values(spark, kind, i, want):
    assert spark.range(1).select(V.synthetic(F.lit(kind), F.lit(i)).alias("v")).first().v == want


def test_import_update_and_counters(spark):
    old = V.vault(spark.createDataFrame([(1, 1, 0, "PERSON", "Ada")], MENTION))
    given = V.vault(spark.createDataFrame([(1, 5, 0, "PERSON", "Ada"), (1, 6, 0, "PERSON", "Bob")], MENTION)).withColumn("line", F.col("first_seq"))
    both = V.imported(old, given.unionByName(given.withColumn("line", F.col("line") + 10).withColumn("original_text", F.lit("later"))))
    assert sorted((r.original_text, r.placeholder) for r in both.collect()) == [("Ada", "[PERSON_1]"), ("Bob", "[PERSON_2]")]
    assert V.counters(both).first().used == 2
    patch = spark.createDataFrame([("[PERSON_1]", "", "synthetic")], "placeholder string, synthetic_value string, replacement_mode string")
    assert {r.placeholder: r.replacement_mode for r in V.updated(both, patch).collect()}["[PERSON_1]"] == "placeholder"


FIXTURES = [
    ("David Smith from Acme Corp lives in Berlin. Email david.smith@example.com.", ["David Smith", "Acme Corp", "Berlin", "david.smith@example.com"], "[T_1] from [T_2] lives in [T_3]. Email [T_4]."),
    ("Kundin Anna Müller wohnt in München 😀, Telefon +49 30 12345678.", ["Anna Müller", "München", "+49 30 12345678"], "Kundin [T_1] wohnt in [T_2] 😀, Telefon [T_3]."),
]


@pytest.mark.parametrize(("text", "values", "want"), FIXTURES)
def test_anonymise_and_restore(spark, text, values, want):
    at = [len(text[: text.index(v)].encode()) for v in values]
    tokens = spark.createDataFrame([(1, s, s + len(v.encode()), f"[T_{k + 1}]") for k, (v, s) in enumerate(zip(values, at, strict=True))], "id int, start bigint, end bigint, token string")
    df = A.anonymized(spark.createDataFrame([(1, text), (2, "nothing")], "id int, text string"), tokens, "id")
    got = {r.id: r.anonymized for r in df.collect()}
    assert got == {1: want, 2: "nothing"}
    originals = F.create_map(*[F.lit(x) for k, v in enumerate(values) for x in (f"[T_{k + 1}]", v)])
    assert df.where("id = 1").select(A.restored_canonical(F.col("anonymized"), originals).alias("r")).first().r == text



@pytest.mark.parametrize("variant", ["[PERSON_1]", "[PERSON 1]", "PERSON_1", "PERSON 1", "[person_1]", "[PERSON1]", "PERSON1", "[PERSON_1", "PERSON_1]"])
def test_variants(spark, variant):
    originals = F.create_map(F.lit("[PERSON_1]"), F.lit("A$da"), F.lit("[PERSON_12]"), F.lit("Bob"))
    assert spark.range(1).select(A.restored(F.lit(f"x {variant}, y"), originals).alias("r")).first().r == "x A$da, y"


@pytest.mark.parametrize("text", ["GMAILPERSON_1", "PERSON_10", "PERSON_1A", "ÜPERSON_1", "PERSON_01", "[PERSON_99]"])
def test_no_variant(spark, text):
    originals = F.create_map(F.lit("[PERSON_1]"), F.lit("Ada"))
    assert spark.range(1).select(A.restored(F.lit(text), originals).alias("r")).first().r == text


def test_larger_numbers_first_and_long_synthetics_first(spark):
    originals = F.create_map(*[F.lit(x) for x in ("[PERSON_1]", "Ada", "[PERSON_12]", "Bob", "Jordan Park", "Eve", "Jordan", "Zoe")])
    got = spark.range(1).select(A.resolved(F.lit("PERSON 12 and person_1, Jordan Park, Jordan; Jordans [PERSON_1]"), originals).alias("r")).first().r
    assert got.text == "Bob and Ada, Eve, Zoe; Jordans Ada"
    assert [m.key for m in got.matches] == ["[PERSON_12]", "[PERSON_1]", "Jordan Park", "Jordan", "[PERSON_1]"]


def test_three_passes_cascade_but_resolving_does_not(spark):
    places = F.create_map(F.lit("[PERSON_1]"), F.lit("EMAIL_1"), F.lit("[EMAIL_1]"), F.lit("a@b.c"))
    row = spark.range(1).select(A.restored_with_vault(F.lit("[PERSON_1]"), places, F.create_map(F.lit("a@b.c"), F.lit("z"))).alias("v"), A.resolved(F.lit("[PERSON_1]"), places).alias("r")).first()
    assert (row.v, row.r.text) == ("z", "EMAIL_1")


@pytest.mark.parametrize(("text", "want"), [
    ("ssn [SSN_147], card [CARD_1]", "ssn 147-47-8147, card SSN 147"), ("ssn 147 and [SSN_147]ssn_147", "147-47-8147 and 147-47-8147147-47-8147"), ("[SSN_99] [SSN_147", "[SSN_99] 147-47-8147"), ("147", "147"),
])
def test_restored_text_is_not_restored_again(spark, text, want):
    originals = F.create_map(*[F.lit(x) for x in ("[SSN_147]", "147-47-8147", "[CARD_1]", "SSN 147")])
    assert spark.range(1).select(A.restored(F.lit(text), originals).alias("r")).first().r == want


def test_augment(spark):
    records = V.vault(spark.createDataFrame([(1, 1, 0, "PERSON", "Ada"), (1, 2, 0, "PERSON", "Bob")], MENTION))
    stored = spark.createDataFrame([(9, "Jordan Park", "Ada")], "conv_id bigint, key string, original string")
    assert sorted((r.key, r.original) for r in V.augmented(stored, records).collect()) == [("Jordan Park", "Ada"), ("[PERSON_1]", "Ada")]
    assert {r.key: r.original for r in V.reverse_index(records).collect()}["Casey Morrow"] == "Bob"


def test_gates(spark):
    row = spark.range(1).select(A.may_have_placeholder(F.lit("say PERSON 1")).alias("a"), A.may_have_placeholder(F.lit("A1 b_2")).alias("b"), A.has_reversible(F.lit("xJordanx"), F.create_map(F.lit("Jordan"), F.lit("Ada"))).alias("c"), A.has_placeholder(F.lit("[_A_1]")).alias("d")).first()
    assert tuple(row) == (True, False, True, True)


def test_normal_key_of_nothing(spark):
    assert spark.range(1).select(T.normal_key(F.lit("   ")).alias("k")).first().k == ""
