"""Host rules: memory tiers and what follows from them, as ordered rule tables over columns; settings."""

from __future__ import annotations

from dataclasses import dataclass, field, fields

from pyspark.sql import Column
from pyspark.sql import functions as F

from umbraframe.functions import constants as C

# Gigabytes up to which memory is critical, and up to which it is a warning.
CRITICAL_GB, WARNING_GB = 2, 4
RECOMMENDATIONS = {"critical": "auto-disable-local-ai", "warning": "warn", "unknown": "warn", "ok": "none"}


def _first(rules: list[tuple[Column, str | None]], other: str | None = None) -> Column:
    """The value of the first rule that holds; a rule over nulls doesn't."""
    out = F.lit(other)
    for condition, value in reversed(rules):
        out = F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(out)
    return out


def memory_tier(gb: Column) -> Column:
    known = gb.isNotNull() & ~F.isnan(gb) & (gb > 0) & (gb < float("inf"))
    return _first([(~known, "unknown"), (gb <= CRITICAL_GB, "critical"), (gb <= WARNING_GB, "warning")], "ok")


def recommendation(tier: Column) -> Column:
    return _first([(tier == t, r) for t, r in RECOMMENDATIONS.items()])


def may_warm_up(provider: Column, state: Column, tier: Column, gpu: Column, ready_on_cpu: Column) -> Column:
    """Whether a model may be loaded ahead: it is on and enabled, memory is ample, and nothing says that it runs on the CPU."""
    return F.coalesce((provider != "off") & (state == "enabled") & (tier == "ok"), F.lit(False)) & F.coalesce(gpu != "unavailable", F.lit(True)) & ~F.coalesce(ready_on_cpu, F.lit(False))


def chip_reason(state: Column, tier: Column, modal: Column, ready_on_cpu: Column) -> Column:
    """Why protection is less than full, or null."""
    low, on = (state == "off-low-memory-auto") & (tier == "critical"), state == "enabled"
    return _first([
        (state.isNull(), None), (state == "off-load-failure", "model-failed"), (low & (modal == "pending"), None), (low, "low-memory-protection"), (state == "enabled-low-memory-override", "enabled-despite-low-memory"),
        (state == "off-user-choice", "pattern-only"), (on & (tier == "warning"), "low-memory-warning"), (on & (tier == "unknown"), "unknown-memory"), (on & ready_on_cpu, "running-on-cpu"),
    ])


def resource_summary(provider: Column, state: Column, tier: Column, ready_on_cpu: Column, gb: Column) -> Column:
    """struct<tone,title,detail>, or null where there is nothing to say."""
    memory = F.when(gb.isNull(), "unavailable").otherwise(F.concat(F.when(gb == F.floor(gb), F.floor(gb).cast("string")).otherwise(gb.cast("string")), F.lit(" GB")))
    off = (provider == "off") | (state == "off-user-choice")
    rules = {
        "failed": state == "off-load-failure", "protected": state == "off-low-memory-auto", "overridden": state == "enabled-low-memory-override",
        "off": off, "on_cpu": ready_on_cpu, "tight": tier == "warning", "uncertain": tier == "unknown",
    }
    out = F.lit(None).cast("struct<tone:string,title:string,detail:string>")
    for name, holds in reversed(rules.items()):
        tone, title, detail = C.RESOURCE_SUMMARIES[name]
        said = F.struct(F.lit(tone).alias("tone"), F.lit(title).alias("title"), F.replace(F.lit(detail), F.lit("{memory}"), memory).alias("detail"))
        out = F.when(F.coalesce(holds, F.lit(False)), said).otherwise(out)
    return F.when(provider.isNotNull() & state.isNotNull(), out)


def supported(url: Column, prefixes: list[str]) -> Column:
    """Whether a page is one of the curated ones, by prefix."""
    return F.exists(F.array(*map(F.lit, prefixes)), lambda p: url.startswith(p)) if prefixes else F.lit(False)


def _number(low: float, high: float, above: bool = False):
    """Whether a value is a number from `low` (or above it) to `high`."""
    return lambda v: isinstance(v, (int, float)) and not isinstance(v, bool) and (low < v if above else low <= v) and v <= high


def _one_of(*values):
    return lambda v: any(v is x or (type(v) is type(x) or isinstance(v, int) and isinstance(x, int) and not isinstance(v, bool)) and v == x for x in values)


def _flag(v: object) -> bool:
    return isinstance(v, bool)


@dataclass(frozen=True)
class Settings:
    """Settings as they are stored; what is missing, of the wrong kind or out of range gets its default."""

    min_confidence: float = 0.5
    ner_provider: str = "transformers"
    ner_model: str = "bardsai"
    ner_dtype: str = "q4f16"
    sensitivity_mode: str = "global"
    replacement_mode: str = "placeholder"
    vault_enabled: bool = True
    theme: str = "dark"
    clipboard_intercept: bool = True
    skip_code_blocks: bool = False
    cancel_behavior: str = "ask"
    unload_timeout_ms: int | None = C.UNLOAD_TIMEOUT_MS
    keep_loaded_while_active: bool = True
    warm_on_supported_page: bool = True
    groups_enabled: dict[str, bool] = field(default_factory=lambda: {g: g not in C.GROUPS_OFF for g in C.GROUPS})
    group_thresholds: dict[str, float] = field(default_factory=dict)
    allowlist: list[dict] = field(default_factory=list)
    blocklist: list[dict] = field(default_factory=list)

    @classmethod
    def sanitised(cls, raw: object) -> Settings:
        """Fields that hold; a model that isn't active gives way to the default one, groups count one by one, and list
        entries that lack a field go."""
        given = raw if isinstance(raw, dict) else {}
        sound = {
            "min_confidence": _number(0, 1, above=True), "ner_provider": _one_of("off", "fixture", "transformers"), "ner_model": _one_of(*C.ACTIVE_MODELS), "ner_dtype": _one_of(*C.MODEL_DTYPES),
            "sensitivity_mode": _one_of("global", "individual"), "replacement_mode": _one_of("placeholder", "synthetic"), "theme": _one_of("dark", "light"),
            "cancel_behavior": _one_of("ask", "paste-original", "drop"), "unload_timeout_ms": _one_of(*C.UNLOAD_TIMEOUTS_MS),
        } | {f.name: _flag for f in fields(cls) if isinstance(f.default, bool)}
        kept = {name: given[name] for name, holds in sound.items() if name in given and holds(given[name])}
        groups, levels = (given[k] if isinstance(given.get(k), dict) else {} for k in ("groups_enabled", "group_thresholds"))
        kept["groups_enabled"] = {g: groups[g] if _flag(groups.get(g)) else g not in C.GROUPS_OFF for g in C.GROUPS}
        kept["group_thresholds"] = {g: levels[g] for g in C.GROUPS if _number(0, 1)(levels.get(g))}
        for name, scopes in (("allowlist", ("any",)), ("blocklist", ("any", *C.ENTITY_TYPES))):
            rows = given[name] if isinstance(given.get(name), list) else []
            kept[name] = [r for r in rows if isinstance(r, dict) and isinstance(r.get("pattern"), str) and r.get("scope") in scopes and _number(float("-inf"), float("inf"))(r.get("added_at")) and r.get("source") in ("manual", "detection")]
        return cls(**kept)
