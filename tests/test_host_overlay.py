import math

import pytest
from pyspark.sql import functions as F

from umbraframe.functions import text as T
from umbraframe.operators import host, overlay


@pytest.mark.parametrize(("gb", "tier"), [(None, "unknown"), (-1.0, "unknown"), (math.nan, "unknown"), (2.0, "critical"), (2.5, "warning"), (4.0, "warning"), (8.0, "ok")])
def test_tiers(spark, gb, tier):
    assert spark.createDataFrame([(gb,)], "gb double").select(host.memory_tier(F.col("gb")).alias("t")).first().t == tier


def test_settings():
    assert host.Settings.sanitised(None) == host.Settings() == host.Settings.sanitised({"min_confidence": 0, "ner_provider": "x", "vault_enabled": 1})
    assert host.Settings.sanitised({"min_confidence": 0.9, "skip_code_blocks": True}) == host.Settings(min_confidence=0.9, skip_code_blocks=True)


def test_all_settings_are_sanitised():
    entry = {"pattern": "x", "scope": "any", "added_at": 1, "source": "manual"}
    raw = {
        "ner_model": "ai4privacy", "ner_dtype": "fp16", "theme": "light", "cancel_behavior": "drop", "unload_timeout_ms": None, "clipboard_intercept": "no", "keep_loaded_while_active": False,
        "groups_enabled": {"Contact": False, "no group": True, "Low-signal": 1}, "group_thresholds": {"Contact": 0.25, "Low-signal": 2}, "allowlist": [entry, {**entry, "scope": "EMAIL"}, None, {**entry, "source": "x"}],
        "blocklist": [{**entry, "scope": "EMAIL"}, {**entry, "added_at": "1"}],
    }
    got = host.Settings.sanitised(raw)
    assert (got.ner_model, got.ner_dtype, got.theme, got.cancel_behavior, got.unload_timeout_ms, got.clipboard_intercept, got.keep_loaded_while_active) == ("bardsai", "q4f16", "light", "drop", None, True, False)
    assert got.groups_enabled["Contact"] is False and got.groups_enabled["Low-signal"] is False and "no group" not in got.groups_enabled and got.group_thresholds == {"Contact": 0.25}
    assert got.allowlist == [entry] and got.blocklist == [{**entry, "scope": "EMAIL"}]
    assert host.Settings.sanitised({"unload_timeout_ms": 5}).unload_timeout_ms == 600_000 and host.Settings.sanitised({"unload_timeout_ms": 60_000}).unload_timeout_ms == 60_000


def test_highlights_and_previews(spark):
    text, kind = "a <é@b.org> z", f"array<{T.SPAN[:-1]},in_code:boolean>>"
    df = spark.createDataFrame([(text, [(3, 11, "EMAIL", 0.95, "é@b.org", "regex", False), (0, 1, "URL", 0.5, "a", "regex", True)])], f"text string, spans {kind}")
    out = df.select(overlay.highlighted(F.col("text"), F.col("spans"), lambda s: s["score"] > 0.9).alias("h")).first().h
    assert out == 'a &lt;<span class="pg-highlight pg-highlight-email" data-pg-span-index="0" title="EMAIL (95%)">é@b.org</span>&gt; z'
    tokens = F.array(F.struct(F.lit(3).cast("bigint").alias("start"), F.lit(11).cast("bigint").alias("end"), F.lit("[EMAIL_1]").alias("token"), F.lit("EMAIL").alias("entity_type"), F.lit(0.95).alias("score")))
    assert 'title="EMAIL (95%)">[EMAIL_1]</span>&gt; z' in df.select(overlay.preview(F.col("text"), tokens).alias("p")).first().p


def test_manual_retyped_and_feedback(spark):
    df = spark.createDataFrame([(1, "xé Bob and Bob")], "id int, text string")
    m = df.select(overlay.manual_span(F.col("text"), F.lit("Bob"), F.lit("PERSON")).alias("m"), overlay.manual_span(F.col("text"), F.lit("Eve"), F.lit("PERSON")).alias("n")).first()
    assert (m.m.start, m.m.end, m.m.source, m.n) == (4, 7, "manual", None)
    actions = df.select("id", "text", F.expr("array(named_struct('kind','dismiss','text','Bob','entity_type','PERSON','new_type',cast(null as string)), named_struct('kind','add','text','and','entity_type','MISC','new_type',cast(null as string)), named_struct('kind','retype','text','Bob','entity_type','PERSON','new_type','URL'))").alias("acts"))
    got = [(r.detected_type, r.corrected_type) for r in overlay.feedback_rows(actions, "id", "text", "acts").collect()]
    assert got == [("PERSON", "NOT_PII"), (None, "MISC"), ("PERSON", "URL")]
