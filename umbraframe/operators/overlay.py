"""What a reviewer sees and does: rendered highlights and previews, manual spans, retyped spans, feedback rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T
from umbraframe.operators.detect import rows_of, span


def _marked(text: Column, marks: Column, open_tag) -> Column:
    """The escaped text with every mark (start, end, shown, ...) in a tag, by start; a mark inside the one before is left out."""

    def step(acc: Column, m: Column) -> Column:
        piece = T.escape_html(T.byte_slice(text, acc["at"], F.greatest(m["start"], acc["at"])))
        tagged = F.concat(acc["out"], piece, open_tag(m), T.escape_html(m["shown"]), F.lit("</span>"))
        return F.when(m["start"] < acc["at"], acc).otherwise(F.struct(m["end"].alias("at"), tagged.alias("out")))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    return F.aggregate(F.sort_array(marks), begin, step, lambda acc: F.concat(acc["out"], T.escape_html(T.byte_slice(text, acc["at"], T.byte_length(text)))))


def _title(m: Column) -> Column:
    return F.concat(F.lit(' title="'), m["entity_type"], F.lit(" ("), F.round(m["score"] * 100, 0).cast("int").cast("string"), F.lit('%)">'))


def highlighted(text: Column, spans: Column, enabled, prefix: str = C.MARK_PREFIX) -> Column:
    """HTML of the text with its spans; `enabled` maps a span to whether it is on, `prefix` begins class and attribute names.
    Spans in code are not shown."""
    shown = F.filter(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("index"), s["end"].alias("end"), s["text"].alias("shown"), s["entity_type"].alias("entity_type"), s["score"].alias("score"), s["source"].alias("source"), enabled(s).alias("on"), F.coalesce(s["in_code"], F.lit(False)).alias("hidden"))), lambda m: ~m["hidden"])

    def tag(m: Column) -> Column:
        index = F.when(m["source"] == "manual", "").otherwise(F.concat(F.lit(f' data-{prefix}-span-index="'), m["index"].cast("string"), F.lit('"')))
        return F.concat(F.lit(f'<span class="{prefix}-highlight {prefix}-highlight-'), F.lower(m["entity_type"]), F.when(m["on"], "").otherwise(f" {prefix}-highlight-off"), F.lit('"'), index, _title(m))

    return _marked(text, shown, tag)


def preview(text: Column, tokens: Column, prefix: str = C.MARK_PREFIX) -> Column:
    """HTML of the text as it will be sent: tokens are (start, end, token, entity_type, score)."""
    marks = F.transform(tokens, lambda t, i: F.struct(t["start"].alias("start"), i.alias("index"), t["end"].alias("end"), t["token"].alias("shown"), t["entity_type"].alias("entity_type"), t["score"].alias("score")))
    return _marked(text, marks, lambda m: F.concat(F.lit(f'<span class="{prefix}-highlight {prefix}-highlight-'), F.lower(m["entity_type"]), F.lit('"'), _title(m)))


def manual_span(text: Column, selected: Column, entity_type: Column) -> Column:
    """The first occurrence of a selected text as a manual span; null if there is none."""
    at = F.instr(text, selected)
    start = T.byte_offset(text, at - 1)
    return F.when((F.length(selected) > 0) & (at > 0), span(start, start + T.byte_length(selected), entity_type, F.lit(1.0), selected, F.lit("manual")))


def approved(spans: Column, enabled, manual: Column) -> Column:
    """What a reviewer sends on: the spans that are on, and the manual ones, by start."""
    return F.sort_array(F.concat(F.filter(spans, enabled), F.filter(manual, lambda m: m.isNotNull())))


def retyped(spans: Column, types: Column) -> Column:
    """Spans whose place (number) is in the map get the type given there."""
    return F.transform(spans, lambda s, i: span(s["start"], s["end"], F.coalesce(F.try_element_at(types, i), s["entity_type"]), s["score"], s["text"], s["source"]))


def feedback_rows(df: DataFrame, id_col: str, text_col: str, actions: str) -> DataFrame:
    """Feedback of reviewers' actions (kind, text, entity_type, new_type): dismissed spans are NOT_PII, added ones have no
    detected type; with 20 code points of context on both sides."""
    rows = rows_of(df.withColumn("_text", F.col(text_col)), actions, id_col, "_text", name="a")
    detected = F.when(F.col("a.kind") == "add", F.lit(None)).otherwise(F.col("a.entity_type"))
    corrected = F.when(F.col("a.kind") == "dismiss", "NOT_PII").otherwise(F.coalesce("a.new_type", "a.entity_type"))
    return rows.select(id_col, F.col("a.text").alias("text"), detected.alias("detected_type"), corrected.alias("corrected_type"), T.context_around(F.col("_text"), F.col("a.text"), 20).alias("context"))


def counts(states: Column) -> Column:
    """struct<enabled,total> of an array of booleans."""
    both = lambda x: F.struct(F.size(F.filter(x, lambda on: on)).alias("enabled"), F.size(x).alias("total"))
    return F.get(F.transform(F.array(states), both), F.lit(0))


def counted(df: DataFrame, states: Column, *keep: str) -> DataFrame:
    """enabled and total of every row that has anything to count. They are rows of an outer generator, as the filter would
    otherwise be pushed below every step that made the states, with the whole expression once more for each use."""
    rows = rows_of(df, F.array(counts(states)), *keep, name="c").where("c.total > 0")
    return rows.select(*keep, F.col("c.enabled").cast("bigint").alias("enabled"), F.col("c.total").cast("bigint").alias("total"))


def response_text(visible: Column, controls: Column) -> Column:
    """A reply's visible text and the values of its form controls, one a line."""
    return F.concat_ws("\n", visible, controls)
