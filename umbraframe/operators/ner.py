"""Named-entity spans: a dictionary provider, and everything between a model's output and sound spans."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T
from umbraframe.operators.detect import no_spans, span
from umbraframe.sources.state import stored


def dictionary_spans(text: Column, entries: list[tuple[str, str, float]] = C.DICTIONARY) -> Column:
    """Case-sensitive occurrences of each entry by itself, sorted by start; entries may overlap."""
    found = [_entry(text, *entry) for entry in entries]
    numbered = F.transform(F.concat(*found), lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(numbered), lambda x: x["s"])


def _entry(text: Column, value: str, kind: str, score: float) -> Column:
    spans = F.transform(T.located(text, T.quoted(value)), lambda m: span(m["start"], m["end"], F.lit(kind), F.lit(score), m["text"], F.lit("ner")))
    return F.when(text.contains(value), spans).otherwise(no_spans())


def label_name(raw: Column) -> Column:
    """B-/I- and brackets go, camelCase and other signs become underscores, upper case."""
    value = F.regexp_replace(raw, r"^[BbIi]-", "")
    value = F.regexp_replace(value, r"[\[\]<>{}()]", "")
    value = F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1_$2")
    value = F.regexp_replace(value, "[^A-Za-z0-9]+", "_")
    return F.upper(F.regexp_replace(value, "^_+|_+$", ""))


def label_table(spark: SparkSession) -> DataFrame:
    """(model, label, entity_type): 138 fixed rows."""
    rows = [(m, label, t) for m, types in C.NER_LABELS.items() for t, labels in types.items() for label in labels]
    return spark.createDataFrame(rows, "model string, label string, entity_type string")


def mapped(items: DataFrame, model: Column, raw: Column) -> DataFrame:
    """Adds entity_type; labels that the model's taxonomy lacks are dropped. The fixed table is broadcast."""
    named = items.withColumn("model", model).withColumn("label", label_name(raw))
    return named.join(F.broadcast(label_table(items.sparkSession)), ["model", "label"])


def gate(model: Column, entity_type: Column) -> Column:
    """The score that a model's span needs."""
    table = F.create_map(*[x for t, m in C.NER_MINIMUM.items() for x in (F.lit(t), F.lit(m))])
    misc = F.create_map(*[x for m, v in C.NER_GATE_MISC.items() for x in (F.lit(m), F.lit(v))])
    return F.when(entity_type == "MISC", F.try_element_at(misc, model)).otherwise(F.try_element_at(table, entity_type))


def stitched(text: Column, spans: Column) -> Column:
    """Neighbours of one type with a gap of up to four characters of separators become one span with the higher score."""

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        gap = T.byte_slice(text, last["end"], s["start"])
        joins = (F.size(acc) > 0) & (last["entity_type"] == s["entity_type"]) & (last["end"] <= s["start"]) & (F.length(gap) <= 4) & gap.rlike(r"(?U)^[\s._@:/+\-(),]*$")
        grown = span(last["start"], s["end"], last["entity_type"], F.greatest(last["score"], s["score"]), T.byte_slice(text, last["start"], s["end"]), last["source"])
        return F.when(F.coalesce(joins, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(grown))).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.sort_array(spans), no_spans(), step)


def expanded(text: Column, spans: Column) -> Column:
    """Both ends grow over letters, digits, _ and -."""

    def one(s: Column) -> Column:
        head, tail = T.byte_slice(text, F.lit(0).cast("bigint"), s["start"]), T.byte_slice(text, s["end"], T.byte_length(text))
        start = s["start"] - T.byte_length(F.regexp_extract(head, r"[\p{L}\p{N}_-]*$", 0))
        end = s["end"] + T.byte_length(F.regexp_extract(tail, r"^[\p{L}\p{N}_-]*", 0))
        return span(start, end, s["entity_type"], s["score"], T.byte_slice(text, start, end), s["source"])

    return F.transform(spans, one)


def best_of_overlaps(spans: Column) -> Column:
    """Within a type, overlapping spans leave the better one: score, then length, then smaller start, smaller end."""

    def better(a: Column, b: Column) -> Column:
        la, lb = a["end"] - a["start"], b["end"] - b["start"]
        second = F.when(a["score"] != b["score"], b["score"] > a["score"]).when(la != lb, lb > la).when(a["start"] != b["start"], b["start"] < a["start"]).otherwise(b["end"] < a["end"])
        return F.when(second, b).otherwise(a)

    def step(acc: Column, s: Column) -> Column:
        last = F.try_element_at(acc, F.lit(-1))
        meets = (F.size(acc) > 0) & (last["start"] < s["end"]) & (s["start"] < last["end"])
        return F.when(F.coalesce(meets, F.lit(False)), F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(better(last, s)))).otherwise(F.concat(acc, F.array(s)))

    def of_type(t: Column) -> Column:
        return F.aggregate(F.sort_array(F.filter(spans, lambda s: s["entity_type"] == t)), no_spans(), step)

    types = F.array_distinct(F.transform(spans, lambda s: s["entity_type"]))
    return F.sort_array(F.flatten(F.transform(types, of_type)))


def search_words(word: Column) -> Column:
    """Spellings in which a model's word may stand in the text."""
    trimmed = F.regexp_replace(F.regexp_replace(word, "^##", ""), r"(?U)^\s+|\s+$", "")
    return F.filter(
        F.array_distinct(F.array(trimmed, F.regexp_replace(trimmed, r"(?U)\s*([_@:/.-])\s*", "$1"), F.regexp_replace(trimmed, r"(?U)\s+", ""), F.regexp_replace(trimmed, r"(?U)\s+", " "))),
        lambda w: w != "",
    )


def ranges(text: Column, items: Column) -> Column:
    """Code-point ranges of a model's items: given ones, else the first spelling found from a cursor that moves on.

    Items are structs of word, score, entity_type, start and end (null if the model gives none); unfound ones go.
    """
    low = F.lower(text)

    def step(acc: Column, item: Column) -> Column:
        found = F.filter(F.transform(search_words(item["word"]), lambda w: F.struct((F.call_function("locate", F.lower(w), low, acc["at"] + 1) - 1).alias("i"), F.length(w).alias("n"))), lambda f: f["i"] >= 0)
        first = F.get(found, F.lit(0))
        given = item["start"].isNotNull() & item["end"].isNotNull()
        start, end = F.when(given, item["start"]).otherwise(first["i"]), F.when(given, item["end"]).otherwise(first["i"] + first["n"])
        row = F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), item["entity_type"].alias("entity_type"), item["score"].alias("score"))
        return F.when(end.isNull(), acc).otherwise(F.struct(end.cast("int").alias("at"), F.concat(acc["out"], F.array(row)).alias("out")))

    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,entity_type:string,score:double>>)").alias("out"))
    return F.aggregate(items, begin, step, lambda acc: acc["out"])


def model_spans(text: Column, items: Column, model: str = "ai4privacy") -> Column:
    """Items of one text (or chunk) to spans: ranges, stitching, growth, overlaps, and the model's gate."""
    spans = F.transform(ranges(text, items), lambda r: span(T.byte_offset(text, r["start"]), T.byte_offset(text, r["end"]), r["entity_type"], r["score"], F.substring(text, r["start"] + 1, r["end"] - r["start"]), F.lit("ner")))
    whole = best_of_overlaps(expanded(text, stitched(text, spans)))
    return F.filter(whole, lambda s: s["score"] >= gate(F.lit(model), s["entity_type"]))


def chunk_bounds(text: str, most: int = 5000, overlap: int = 256) -> list[tuple[int, int]]:
    """Code-point ranges of at most `most`, cut after white space in the last two fifths if there is some; the next chunk
    begins `overlap` before the last one's end."""
    if most < 1 or overlap < 0:
        raise ValueError("chunks need a positive size and an overlap that isn't negative")
    out, start, overlap = [], 0, min(overlap, most - 1)
    while start < len(text):
        end = min(len(text), start + most)
        if end < len(text):
            floor = min(end, start + max(1, most * 3 // 5))
            end = next((k for k in range(end, floor, -1) if text[k - 1].isspace()), end)
        out.append((start, end))
        if end >= len(text):
            break
        start = max(start + 1, end - overlap)
    return out


def chunks(df: DataFrame, id_col: str, text_col: str = "text", most: int = 5000, overlap: int = 256) -> DataFrame:
    """One row for each chunk: id, chunk number, text, character and byte ranges. Where a chunk begins depends on where
    the last one ended, so this is an Arrow-batched Python function."""

    @F.pandas_udf("array<struct<start_char:bigint,end_char:bigint,start_byte:bigint,end_byte:bigint,text:string>>")
    def cut(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.fillna("").map(rows)

    def rows(text: str) -> list[dict]:
        out, at, size = [], 0, 0
        for a, b in chunk_bounds(text, most, overlap):
            size, at = size + len(text[at:a].encode()), a
            out.append({"start_char": a, "end_char": b, "start_byte": size, "end_byte": size + len(text[a:b].encode()), "text": text[a:b]})
        return out

    return df.select(id_col, F.posexplode(cut(F.col(text_col))).alias("chunk", "c")).select(id_col, "chunk", "c.*")


def chunk_spans(text: Column, items: Column) -> Column:
    """Items of one chunk to spans: ranges, stitching, growth."""
    spans = F.transform(ranges(text, items), lambda r: span(T.byte_offset(text, r["start"]), T.byte_offset(text, r["end"]), r["entity_type"], r["score"], F.substring(text, r["start"] + 1, r["end"] - r["start"]), F.lit("ner")))
    return expanded(text, stitched(text, spans))


def detected(df: DataFrame, id_col: str, infer: Callable[[DataFrame], DataFrame], model: str = "ai4privacy", most: int = 5000, overlap: int = 256) -> DataFrame:
    """(id, spans) of texts of any length: chunks, a model's items for each (`infer` adds the column items to the chunks), spans,
    the chunks' places, the better of overlapping ones, and the model's gate. Documents without spans have no row."""
    found = infer(chunks(df, id_col, most=most, overlap=overlap))
    own = found.select(id_col, F.explode(shifted(chunk_spans(F.col("text"), F.col("items")), F.col("start_byte"))).alias("s"))
    whole = own.groupBy(id_col).agg(best_of_overlaps(F.array_distinct(F.collect_list("s"))).alias("spans"))
    return whole.select(id_col, F.filter("spans", lambda s: s["score"] >= gate(F.lit(model), s["entity_type"])).alias("spans"))


def provided(df: DataFrame, id_col: str, mode: str, models: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """df with external: named-entity spans by mode. off: none; fixture: the dictionary; transformers: the first of the models
    (name -> infer) that works, in order, and none if all fail, so that patterns alone are left."""
    if mode == "fixture":
        return df.withColumn("external", dictionary_spans(F.col("text")))
    for name, infer in (models or {}).items() if mode == "transformers" else ():
        try:
            spans = stored(detected(df, id_col, infer, name)).withColumnRenamed("spans", "external")
        except Exception as error:  # a model that can't be loaded, whatever it says
            logging.getLogger(__name__).warning("model %s failed: %s", name, error)
            continue
        return df.join(spans, id_col, "left").withColumn("external", F.coalesce("external", no_spans()))
    return df.withColumn("external", no_spans())


def shifted(spans: Column, by: Column) -> Column:
    """A chunk's spans in the document's offsets."""
    return F.transform(spans, lambda s: span(s["start"] + by, s["end"] + by, s["entity_type"], s["score"], s["text"], s["source"]))


def with_raw_label(final: DataFrame, given: DataFrame, id_col: str) -> DataFrame:
    """Final named-entity spans get the label their input had (the last of equal spans)."""
    last = given.groupBy(id_col, "start", "end", "entity_type").agg(F.max_by("raw_label", "item").alias("raw_label"))
    return final.join(last, [id_col, "start", "end", "entity_type"], "left")
