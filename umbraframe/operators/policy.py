"""Review policy: groups, thresholds, allow and block lists, code regions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T
from umbraframe.operators.detect import no_spans, span

RANGES = "array<struct<start:bigint,end:bigint>>"


def _map(table: dict) -> Column:
    return F.create_map(*[x for k, v in table.items() for x in (F.lit(k), F.lit(v))])


def group_table(spark: SparkSession) -> DataFrame:
    rows = [(t, g, g not in C.GROUPS_OFF) for g, types in C.GROUPS.items() for t in types]
    return spark.createDataFrame(rows, "entity_type string, group_name string, default_on boolean")


def group_of(entity_type: Column) -> Column:
    return F.try_element_at(_map({t: g for g, types in C.GROUPS.items() for t in types}), entity_type)


def in_enabled_group(spans: Column, enabled: dict[str, bool] | None = None) -> Column:
    """Spans whose group is on; types without a group go."""
    on = {g: g not in C.GROUPS_OFF for g in C.GROUPS} | (enabled or {})
    return F.filter(spans, lambda s: F.coalesce(F.try_element_at(_map(on), group_of(s["entity_type"])), F.lit(False)))


def threshold(entity_type: Column, slider: Column | float, mode: str = "global", overrides: dict[str, float] | None = None) -> Column:
    """Slider 0 is strictest. In individual mode a group's own slider takes the place of the common one."""
    position = F.lit(slider) if isinstance(slider, (int, float)) else slider
    if mode == "individual" and overrides:
        position = F.coalesce(F.try_element_at(_map(overrides), group_of(entity_type)), position)
    baseline = F.try_element_at(_map({t: b for t, (b, _) in C.CATEGORY_THRESHOLDS.items()}), entity_type)
    delta = F.try_element_at(_map({t: d for t, (_, d) in C.CATEGORY_THRESHOLDS.items()}), entity_type)
    floor, ceiling = F.greatest(F.lit(0.0), baseline - delta), F.least(F.lit(1.0), baseline + delta)
    return ceiling - position * (ceiling - floor)


def minimum_threshold(slider: float, mode: str = "global", overrides: dict[str, float] | None = None) -> float:
    """The smallest threshold of all types: what the pipeline itself needs to keep."""
    group = {t: g for g, types in C.GROUPS.items() for t in types}
    out = []
    for t, (b, d) in C.CATEGORY_THRESHOLDS.items():
        position = (overrides or {}).get(group[t], slider) if mode == "individual" else slider
        low, high = max(0.0, b - d), min(1.0, b + d)
        out.append(high - position * (high - low))
    return min(out)


def above_threshold(spans: Column, slider: float, adaptive: Column | None = None, **mode) -> Column:
    """An adaptive threshold (map by type) takes the place of the resolved one."""

    def least(s: Column) -> Column:
        resolved = threshold(s["entity_type"], slider, **mode)
        return F.coalesce(F.try_element_at(adaptive, s["entity_type"]), resolved) if adaptive is not None else resolved

    return F.filter(spans, lambda s: s["score"] >= least(s))


def adaptive_thresholds(feedback: DataFrame, base: float) -> DataFrame:
    """(entity_type, threshold): dismissed detections raise it, added ones lower it; other feedback doesn't count."""
    has, not_pii = F.coalesce(F.col("detected_type"), F.lit("")) != "", F.col("corrected_type") == "NOT_PII"
    kind = F.when(has & not_pii, F.col("detected_type")).when(~has & ~not_pii, F.col("corrected_type"))
    counted = feedback.select(kind.alias("entity_type"), has.cast("int").alias("dismissed")).where("entity_type is not null")
    rate = F.sum("dismissed") / F.count(F.lit(1))
    return counted.groupBy("entity_type").agg(F.greatest(F.lit(0.1), F.least(F.lit(0.99), F.lit(base) + (rate - 0.5) * 0.4)).alias("threshold"))


def _covers(value: Column, pattern: str) -> Column:
    return F.exists(T.wildcard_matches(value, pattern), lambda m: (m["start"] == 0) & (m["end"] == T.byte_length(value)))


def allowed_ranges(text: Column, patterns: list[str]) -> Column:
    found = [F.transform(T.wildcard_matches(text, p), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"))) for p in patterns]
    return F.concat(*found) if found else F.expr(f"cast(array() as {RANGES})")


def without_allowed(text: Column, spans: Column, patterns: list[str]) -> Column:
    """Drops spans that a pattern covers, by their own text or within a longer match in the document."""
    if not patterns:
        return spans
    own = F.filter(spans, lambda s: ~F.coalesce(_any([_covers(s["text"], p) for p in patterns]), F.lit(False)))
    ranges = allowed_ranges(text, patterns)
    return F.filter(own, lambda s: ~F.exists(ranges, lambda r: (r["start"] <= s["start"]) & (r["end"] >= s["end"])))


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def with_blocked(text: Column, spans: Column, entries: list[tuple[str, str]]) -> Column:
    """Adds a manual span of score 1 for each match of (pattern, scope) whose exact range no span has yet."""
    for pattern, scope in entries:
        kind = "MISC" if scope == "any" else scope
        spans = F.aggregate(T.wildcard_matches(text, pattern), spans, _blocker(kind))
    return spans


def _blocker(kind: str):
    def step(acc: Column, m: Column) -> Column:
        taken = F.exists(acc, lambda s: (s["start"] == m["start"]) & (s["end"] == m["end"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(span(m["start"], m["end"], F.lit(kind), F.lit(1.0), m["text"], F.lit("manual")))))

    return step


def code_regions(text: Column) -> Column:
    """Byte ranges of fenced blocks (three or more backticks; the fence that closes is at least as long and stands alone; an open one
    runs to the end), then of code and pre elements."""
    empty = F.expr(f"cast(array() as {RANGES})")

    def step(acc: Column, line: Column) -> Column:
        ticks = F.length(F.regexp_extract(line, "^(`{3,})", 1))
        rest = F.regexp_replace(F.substring(line, ticks + 1, F.length(line)), r"(?U)^\s+|\s+$", "")
        opens, closes = (ticks > 0) & (acc["open"] < 0), (ticks > 0) & (acc["open"] >= 0) & (ticks >= acc["ticks"]) & (rest == "")
        after = acc["at"] + T.byte_length(line)
        region = F.struct(acc["open"].alias("start"), after.alias("end"))
        return F.struct(
            (after + 1).alias("at"),
            F.when(opens, acc["at"]).when(closes, F.lit(-1).cast("bigint")).otherwise(acc["open"]).alias("open"),
            F.when(opens, ticks).when(closes, F.lit(0)).otherwise(acc["ticks"]).alias("ticks"),
            F.when(closes, F.concat(acc["out"], F.array(region))).otherwise(acc["out"]).alias("out"),
        )

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit(-1).cast("bigint").alias("open"), F.lit(0).alias("ticks"), empty.alias("out"))
    done = lambda acc: F.when(acc["open"] >= 0, F.concat(acc["out"], F.array(F.struct(acc["open"].alias("start"), T.byte_length(text).alias("end"))))).otherwise(acc["out"])
    fenced = F.when(text.contains("```"), F.aggregate(F.split(text, "\n", -1), begin, step, done)).otherwise(empty)
    elements = F.transform(T.located(text, r"(?is)<(code|pre)(\s[^>]*)?>.*?</\1>"), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end")))
    return F.concat(fenced, F.when(F.lower(text).rlike("<(code|pre)"), elements).otherwise(empty))


def tagged_in_code(spans: Column, regions: Column) -> Column:
    """Each span with in_code: whether it starts in a region."""
    return F.transform(spans, lambda s: F.struct(*[s[f].alias(f) for f in ("start", "end", "entity_type", "score", "text", "source")], F.exists(regions, lambda r: (s["start"] >= r["start"]) & (s["start"] < r["end"])).alias("in_code")))


def review(text: Column, spans: Column, slider: float = 0.5, enabled: dict[str, bool] | None = None, allow: list[str] = (), block: list[tuple[str, str]] = (), adaptive: Column | None = None, **mode) -> Column:
    """Groups, allowlist, thresholds, blocklist (which none of these filters), and code tags, in this order."""
    spans = without_allowed(text, in_enabled_group(spans, enabled), list(allow))
    spans = with_blocked(text, above_threshold(spans, slider, adaptive, **mode), list(block))
    return tagged_in_code(F.coalesce(spans, no_spans()), code_regions(text))


def popup_review(text: Column, spans: Column, slider: float = 0.5, enabled: dict[str, bool] | None = None, allow: list[str] = (), **mode) -> Column:
    """The short form: no adaptive thresholds, no blocklist, no code tags."""
    return above_threshold(without_allowed(text, in_enabled_group(spans, enabled), list(allow)), slider, **mode)


def overlay_enabled(s: Column, slider: float, chosen: Column | None = None, **mode) -> Column:
    """Outside code and above both thresholds; a choice made by hand stays."""
    by_rule = ~F.coalesce(s["in_code"], F.lit(False)) & (s["score"] >= F.greatest(threshold(s["entity_type"], slider, **mode), F.lit(slider)))
    return F.coalesce(chosen, by_rule) if chosen is not None else by_rule


def feedback_counts(feedback: DataFrame, allow: list[str]) -> DataFrame:
    """One row: how many entries the log has, how many patterns are ignored, and none pending."""
    return feedback.agg(F.count(F.lit(1)).alias("confirmed")).select("confirmed", F.lit(len(allow)).cast("bigint").alias("ignored"), F.lit(0).cast("bigint").alias("pending"))


def list_conflicts(allow: DataFrame, block: DataFrame) -> DataFrame:
    """Patterns that stand on both lists, by normal form."""
    key = lambda df, name: df.select(T.normal_key(F.col("pattern")).alias("key"), F.col("pattern").alias(name))
    return key(allow, "allow_pattern").join(key(block, "block_pattern"), "key")
