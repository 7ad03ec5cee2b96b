"""Evaluation corpora: raw records to examples, coverage sampling, validation, summary."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T

GOLD = "array<struct<start:bigint,end:bigint,entity_type:string,text:string>>"
LANGUAGES, BUCKETS = ("en", "de"), ("short", "medium", "long")


def corpus_type(label: Column) -> Column:
    """A raw label's type: the types' own names and the fixed aliases; null for others."""
    name = F.regexp_replace(F.regexp_replace(F.upper(F.trim(label)), "[^A-Z0-9]+", "_"), "^_+|_+$", "")
    table = {t: t for t in C.ENTITY_TYPES} | {x: t for t, names in C.CORPUS_LABELS.items() for x in names}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in table.items() for x in pair]), name)


def source_range(text: Column, start: Column, end: Column, value: Column) -> Column:
    """struct<start,end> in code points: the given range if it holds the value, else the value's first occurrence."""
    given = F.substring(text, start + 1, end - start)
    trusted = start.isNotNull() & end.isNotNull() & (value.isNull() | (given == value)) & (end > start)
    at = F.instr(text, value)
    return F.when(F.coalesce(trusted, F.lit(False)), F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"))).when(
        (F.length(value) > 0) & (at > 0), F.struct((at - 1).cast("int").alias("start"), (at - 1 + F.length(value)).cast("int").alias("end"))
    )


def gold_spans(text: Column, mask: Column) -> Column:
    """Gold spans in bytes, by start, end and type, of raw spans (start, end, value, label); unusable ones go."""

    def one(m: Column) -> Column:
        place = source_range(text, m["start"], m["end"], m["value"])
        start, end = T.byte_offset(text, place["start"]), T.byte_offset(text, place["end"])
        return F.struct(start.alias("start"), end.alias("end"), corpus_type(m["label"]).alias("entity_type"), F.substring(text, place["start"] + 1, place["end"] - place["start"]).alias("text"))

    usable = F.filter(F.transform(F.coalesce(mask, F.expr("cast(array() as array<struct<start:int,end:int,value:string,label:string>>)")), one), lambda g: g["entity_type"].isNotNull() & g["start"].isNotNull() & (g["end"] > g["start"]))
    return F.sort_array(usable)


RAW_SPAN = "struct<start:int,end:int,value:string,label:string>"


def source_spans(mask: Column, labels: Column) -> Column:
    """Raw spans of either kind as one: `mask` objects with any of the names that are in use (the first that is there and not
    empty), or `labels` tuples of start, end, label and value."""

    def text(*names: Column) -> Column:
        return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])

    named = F.transform(mask, lambda m: F.struct(F.coalesce(m["start"], m["start_offset"]).alias("start"), F.coalesce(m["end"], m["end_offset"]).alias("end"), text(m["value"], m["text"]).alias("value"), text(m["label"], m["entity_type"], m["type"]).alias("label")))
    at = lambda t, k: F.get(t, F.lit(k))
    tuples = F.transform(labels, lambda t: F.struct(at(t, 0).try_cast("int").alias("start"), at(t, 1).try_cast("int").alias("end"), text(at(t, 3)).alias("value"), text(at(t, 2)).alias("label")))
    return F.coalesce(named, tuples, F.expr(f"cast(array() as array<{RAW_SPAN}>)"))


def examples(raw: DataFrame) -> DataFrame:
    """Records (id, language, source_text, privacy_mask, source_file, source_row) to examples; those without text or of
    other languages go."""
    text = F.col("source_text")
    df = raw.withColumn("language", T.language_code(F.col("language"))).where((F.coalesce(text, F.lit("")) != "") & F.col("language").isNotNull())
    return df.select("id", "language", T.length_bucket(text).alias("length_bucket"), text.alias("text"), gold_spans(text, F.col("privacy_mask")).alias("gold"), "source_file", "source_row")


def stable_order(df: DataFrame) -> DataFrame:
    return df.orderBy("language", "source_file", "source_row", "id")


def _bucket_limit(key: str, target: int, keys: list[str]) -> int:
    if target <= 0 or key not in keys:
        return 0
    return 1 if target < len(keys) else target // len(keys) + (keys.index(key) < target % len(keys))


def place_examples(rows: list[tuple[str, str, str, list[str]]], limit: int, negative_target: int = 25, misc_target: int = 50) -> list[str]:
    """Ids chosen in one pass over (id, language, length bucket, sorted distinct types) rows in order: each example goes
    to the least filled of its buckets that has room; what found no room waits and fills the gap at the end."""
    negative = min(negative_target, limit)
    misc = min(misc_target, limit - negative)
    targets = {"negative": negative, "misc": misc, "supported": max(0, limit - negative - misc)}
    pairs = [f"{lang}:{b}" for lang in LANGUAGES for b in BUCKETS]
    keys = {"negative": pairs, "misc": pairs, "supported": [f"{lang}:{t}:{b}" for lang in LANGUAGES for t in C.SAMPLED_TYPES for b in BUCKETS]}
    room = {c: {k: _bucket_limit(k, targets[c], ks) for k in ks} for c, ks in keys.items()}
    filled = {c: dict.fromkeys(ks, 0) for c, ks in keys.items()}
    chosen: dict[str, None] = {}
    waiting: list[str] = []
    for id_, lang, bucket, types in rows:
        category = "negative" if not types else "misc" if "MISC" in types else "supported"
        own = [f"{lang}:{t}:{bucket}" for t in types if t in C.SAMPLED_TYPES] if category == "supported" else [f"{lang}:{bucket}"]
        free = [k for k in own if filled[category].get(k, 0) < room[category].get(k, 0)] if sum(filled[category].values()) < targets[category] else []
        if free:
            if id_ not in chosen:
                key = min(free, key=lambda k: (filled[category][k], room[category][k], k))
                filled[category][key] += 1
                chosen[id_] = None
        elif id_ not in chosen and len(waiting) < 4 * limit:
            waiting.append(id_)
    for id_ in waiting:
        if len(chosen) >= limit:
            break
        chosen.setdefault(id_)
    return list(chosen)[:limit]


def coverage_sample(df: DataFrame, limit: int, negative_target: int = 25, misc_target: int = 50) -> DataFrame:
    """Ids of a sample that covers languages, types and lengths. df: id, language, length_bucket, types, and a unique
    long `place` that orders the examples.

    The choice is sequential, but bounded: as long as a bucket has room, every example that falls into it is chosen, so
    of each bucket only the first `limit` examples can matter, and for the gap the first 5 x `limit` of all. Only
    these reach the one ordered pass, whatever the table's size.
    """
    types = F.array_sort(F.array_distinct("types"))
    df = df.select("id", "language", "length_bucket", types.alias("types"), "place")
    bucket = F.when(F.size("types") == 0, F.array(F.lit("-"))).when(F.array_contains("types", "MISC"), F.array(F.lit("MISC"))).otherwise(F.col("types"))
    keyed = df.select("id", "place", "language", "length_bucket", F.explode(bucket).alias("b"))
    first = keyed.withColumn("n", F.row_number().over(Window.partitionBy("language", "length_bucket", "b").orderBy("place"))).where(F.col("n") <= limit).select("place")
    some = first.unionByName(df.orderBy("place").limit(5 * limit).select("place")).distinct()

    def choose(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("place")
        triples = [(r.id, r.language, r.length_bucket, list(r.types)) for r in rows.itertuples()]
        return pd.DataFrame({"id": place_examples(triples, limit, negative_target, misc_target)}, dtype=object)

    bounded = df.join(some, "place").withColumn("all", F.lit(1))
    return bounded.groupBy("all").applyInPandas(choose, f"id {dict(df.dtypes)['id']}")


def first_sample(df: DataFrame, limit: int) -> DataFrame:
    return df.orderBy("source_row", "id").limit(limit)


def violations(df: DataFrame) -> DataFrame:
    """Rows of examples that break a rule: one row for each gold span with its problem; empty for a sound corpus."""
    text = F.col("text")
    g = lambda f: F.col(f"g.{f}")
    problem = (
        F.when(~g("entity_type").isin(*C.ENTITY_TYPES) | g("entity_type").isNull(), "entity type")
        .when((g("start") < 0) | (g("end") <= g("start")) | (g("end") > T.byte_length(text)), "range")
        .when(~T.on_boundaries(text, g("start"), g("end")), "character boundary")
        .when(T.byte_slice(text, g("start"), g("end")) != g("text"), "text")
    )
    return df.select("id", "text", F.explode("gold").alias("g")).select("id", problem.alias("problem")).where("problem is not null")


def summary(df: DataFrame) -> DataFrame:
    """(what, key, n): counts by language, length bucket and type (once for each example), negatives and MISC examples."""
    types = F.array_distinct(F.transform("gold", lambda g: g["entity_type"]))
    keys = F.concat(
        F.array(F.struct(F.lit("language").alias("what"), F.col("language").alias("key")), F.struct(F.lit("length_bucket").alias("what"), F.col("length_bucket").alias("key"))),
        F.transform(types, lambda t: F.struct(F.lit("entity_type").alias("what"), t.alias("key"))),
        F.filter(F.array(F.struct(F.lit("examples").alias("what"), F.when(F.size("gold") == 0, "negative").alias("key"))), lambda x: x["key"].isNotNull()),
        F.filter(F.array(F.struct(F.lit("examples").alias("what"), F.when(F.array_contains(types, "MISC"), "misc").alias("key"))), lambda x: x["key"].isNotNull()),
    )
    return df.select(F.explode(keys).alias("k")).groupBy("k.what", "k.key").agg(F.count(F.lit(1)).alias("n"))
