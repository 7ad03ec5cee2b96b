"""Detection of structured identifiers: recognise, check, boost by context, merge, threshold.

Everything is a column expression over one row, so detection never shuffles, and a document without a digit or an @
costs one regex test. Spans are array<struct<start,end,entity_type,score,text,source>>.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T


@dataclass(frozen=True)
class Config:
    min_confidence: float = 0.5
    context_boost: float = 0.15
    context_window: int = 5
    ner_enabled: bool = False

    @classmethod
    def from_json(cls, raw: str | None) -> Config:
        """Defaults for what is missing or of the wrong kind, and for text that isn't a JSON object."""
        try:
            given = json.loads(raw or "")
        except ValueError:
            return cls()
        given = given if isinstance(given, dict) else {}
        right = {float: (int, float), int: (int,), bool: (bool,)}
        kinds = {f.name: type(f.default) for f in fields(cls)}
        return cls(**{k: v for k, v in given.items() if k in kinds and isinstance(v, right[kinds[k]]) and (kinds[k] is bool) == isinstance(v, bool)})


def no_spans() -> Column:
    return F.expr(f"cast(array() as array<{T.SPAN}>)")


def span(start: Column, end: Column, entity_type: Column, score: Column, text: Column, source: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), entity_type.alias("entity_type"), score.cast("double").alias("score"), text.alias("text"), source.alias("source"))


def with_score(s: Column, score: Column) -> Column:
    return span(s["start"], s["end"], s["entity_type"], score, s["text"], s["source"])


def recognise(text: Column, entity_type: str, regex: str, score: float) -> Column:
    """Spans of one recogniser. A phone number that reads as a date is left out."""
    spans = F.transform(T.located(text, regex), lambda m: span(m["start"], m["end"], F.lit(entity_type), F.lit(score), m["text"], F.lit("regex")))
    if entity_type == "PHONE":
        spans = F.filter(spans, lambda s: F.regexp_extract(s["text"], C.DATE, 0) != s["text"])
    shape = text.contains("@") if entity_type == "EMAIL" else text.rlike(r"(?U)\d")
    return F.when(shape, spans).otherwise(no_spans())


def recognised(text: Column, types: list[str] | None = None) -> Column:
    """Spans of all recognisers, in their order."""
    return F.concat(*[recognise(text, *r) for r in C.RECOGNISERS if types is None or r[0] in types])


def luhn_valid(value: Column) -> Column:
    digits = F.regexp_replace(value, "[^0-9]", "")
    return F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def iban_valid(value: Column) -> Column:
    """Four characters move to the end, letters count from 10, and the number leaves 1 when divided by 97."""
    plain = F.regexp_replace(value, r"(?U)\s", "")
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, 1, 4))

    def step(acc: Column, c: Column) -> Column:
        return F.when(c.rlike("[0-9]"), (acc * 10 + c.try_cast("int")) % 97).otherwise((acc * 100 + F.ascii(c) - 55) % 97)

    rest = F.aggregate(F.split(turned, ""), F.lit(0), step)
    return F.length(plain).between(5, 34) & plain.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]+$") & F.when(plain.rlike("^[A-Z0-9]+$"), rest == 1).otherwise(False)


def ssn_valid(value: Column) -> Column:
    """Three ASCII parts; area not 0, 666 or from 900 on, group and serial not 0."""
    parts = F.split(value, "-", -1)
    area, group, serial = (F.get(parts, F.lit(k)).try_cast("int") for k in range(3))
    return F.coalesce(value.rlike("^[0-9]+-[0-9]+-[0-9]+$") & ~area.isin(0, 666) & (area < 900) & (group != 0) & (serial != 0), F.lit(False))


def checksum_valid(entity_type: Column, value: Column) -> Column:
    return F.when(entity_type == "CREDIT_CARD", luhn_valid(value)).when(entity_type == "IBAN", iban_valid(value)).when(entity_type == "SSN", ssn_valid(value)).otherwise(True)


def checked(spans: Column) -> Column:
    """A failing number is gone before it can win a merge; only regex spans are checked."""
    return F.filter(spans, lambda s: (s["source"] != "regex") | checksum_valid(s["entity_type"], s["text"]))


def _keywords(entity_type: Column) -> Column:
    pairs = [x for t, words in C.CONTEXT_KEYWORDS.items() for x in (F.lit(t), F.array(*map(F.lit, words)))]
    return F.try_element_at(F.create_map(*pairs), entity_type)


#: Bytes on either side of a span in which its neighbours are looked for first.
NEAR_BYTES = 384


def _neighbours(near: Column, whole: Column, is_whole: Column, touching: Column, edge: str, n: int, turned) -> Column:
    """The n words next to a span. `near` is the text beside it up to a few hundred bytes, which is enough if it has one word
    more (the farthest may be cut); else `whole` is searched. A word that reaches into the span is none of them."""

    def words(side: Column) -> Column:
        side = F.when(touching, F.regexp_replace(side, edge, "")).otherwise(side)
        return turned(F.regexp_extract_all(side, F.lit(f"{C.TOKEN}+"), F.lit(0)))

    first = F.array(words(near))
    return F.get(F.transform(first, lambda w: F.slice(F.when(is_whole | (F.size(w) > n), w).otherwise(words(whole)), 1, n)), F.lit(0))


def words_before(text: Column, s: Column, n: int) -> Column:
    """Up to n whole words that end before a span, nearest first; a word that reaches into the span is none of them."""
    zero, begin = F.lit(0).cast("bigint"), F.greatest(s["start"] - NEAR_BYTES, F.lit(0).cast("bigint"))
    near, whole = T.byte_slice(text, begin, s["start"]), T.byte_slice(text, zero, s["start"])
    return _neighbours(near, whole, begin == 0, s["text"].rlike(f"^{C.TOKEN}"), f"{C.TOKEN}+$", n, F.reverse)


def words_after(text: Column, s: Column, n: int) -> Column:
    length = T.byte_length(text)
    end = F.least(s["end"] + NEAR_BYTES, length)
    near, whole = T.byte_slice(text, s["end"], end), T.byte_slice(text, s["end"], length)
    return _neighbours(near, whole, end == length, s["text"].rlike(f"{C.TOKEN}$"), f"^{C.TOKEN}+", n, lambda words: words)


def boosted(text: Column, spans: Column, window: int = 5, boost: float = 0.15) -> Column:
    """A keyword with at most `window` words between it and a span raises the score once, up to 1."""

    def one(s: Column) -> Column:
        near = F.concat(words_before(text, s, window + 1), words_after(text, s, window + 1))
        hit = F.coalesce(F.arrays_overlap(F.transform(near, lambda w: F.lower(w)), _keywords(s["entity_type"])), F.lit(False))
        return with_score(s, F.when(hit, F.least(F.lit(1.0), s["score"] + F.lit(boost))).otherwise(s["score"]))

    return F.transform(spans, one)


def precedence(s: Column) -> Column:
    return F.when(s["source"] == "manual", 3).when((s["source"] == "regex") & s["entity_type"].isin(*C.STRUCTURED), 2).otherwise(1)


def merged(spans: Column) -> Column:
    """By start and falling score (ties: as given), each span meets the last one kept: without overlap it stays, else the
    one of higher precedence, and of equals the one of strictly higher score."""
    numbered = F.transform(spans, lambda s, i: F.struct(i.alias("i"), s.alias("s")))

    def order(a: Column, b: Column) -> Column:
        x, y = a["s"], b["s"]
        return (
            F.when(x["start"] != y["start"], F.when(x["start"] < y["start"], -1).otherwise(1))
            .when(x["score"] != y["score"], F.when(x["score"] > y["score"], -1).otherwise(1))
            .otherwise(F.when(a["i"] < b["i"], -1).when(a["i"] > b["i"], 1).otherwise(0))
        )

    def step(acc: Column, item: Column) -> Column:
        s, last = item["s"], F.try_element_at(acc, F.lit(-1))
        apart = (F.size(acc) == 0) | (s["start"] >= last["end"]) | (last["start"] >= s["end"])
        better = F.when(precedence(s) != precedence(last), precedence(s) > precedence(last)).otherwise(s["score"] > last["score"])
        swapped = F.concat(F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))), F.array(s))
        return F.when(apart, F.concat(acc, F.array(s))).when(better, swapped).otherwise(acc)

    folded = F.aggregate(F.array_sort(numbered, order), no_spans(), step)
    return F.when(F.size(spans) <= 1, spans).otherwise(folded)


def ner_minimum(entity_type: Column) -> Column:
    return F.try_element_at(F.create_map(*[x for t, m in C.NER_MINIMUM.items() for x in (F.lit(t), F.lit(m))]), entity_type)


def confident(spans: Column, min_confidence: float = 0.5) -> Column:
    return F.filter(spans, lambda s: s["score"] >= F.when(s["source"] == "ner", F.greatest(F.lit(min_confidence), ner_minimum(s["entity_type"]))).otherwise(F.lit(min_confidence)))


def valid_external(text: Column, spans: Column) -> Column:
    """Named-entity spans with sound offsets and scores; their text is read anew from the offsets."""

    def sound(s: Column) -> Column:
        score = (s["score"] >= 0) & (s["score"] <= 1) & ~F.isnan(s["score"])
        return F.coalesce((s["source"] == "ner") & (s["start"] >= 0) & (s["start"] < s["end"]) & (s["end"] <= T.byte_length(text)) & T.on_boundaries(text, s["start"], s["end"]) & score, F.lit(False))

    kept = F.filter(F.coalesce(spans, no_spans()), sound)
    return F.transform(kept, lambda s: span(s["start"], s["end"], s["entity_type"], s["score"], T.byte_slice(text, s["start"], s["end"]), s["source"]))


def detect(df: DataFrame, text_col: str = "text", out: str = "spans", external: str | None = None, config: Config = Config()) -> DataFrame:
    """The whole pipeline; adds `out`. `external` names a column of named-entity spans. A null or empty text has none."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = df.withColumn(out, checked(recognised(text)))
    if external:
        df = df.withColumn(out, F.concat(F.col(out), valid_external(text, F.col(external))))
    df = df.withColumn(out, boosted(text, F.col(out), config.context_window, config.context_boost))
    return df.withColumn(out, confident(merged(F.col(out)), config.min_confidence))


def rows_of(df: DataFrame, spans: str | Column, *keep: str, name: str = "s") -> DataFrame:
    """One row for each element of an array. The outer form keeps Spark from inferring a filter on the array: that filter
    would be pushed below every step of detection, each time with the whole expression once more."""
    return df.select(*keep, F.explode_outer(spans).alias(name)).where(F.col(name).isNotNull())


def exploded(df: DataFrame, *keep: str, spans: str = "spans") -> DataFrame:
    """One row for each span."""
    return rows_of(df, spans, *keep).select(*keep, "s.*")
