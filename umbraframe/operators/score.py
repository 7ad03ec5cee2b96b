"""Scoring detections against gold spans.

gold: example_id, gold_index, start, end, entity_type, text. found: example_id, found_index, start, end, entity_type, score.
examples: example_id, language, length_bucket.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.sources.state import stored


@dataclass(frozen=True)
class Tolerance:
    boundary_bytes: int = 2
    gold_coverage: float = 0.8
    found_coverage: float = 0.5


def candidates(gold: DataFrame, found: DataFrame, tolerance: Tolerance = Tolerance()) -> DataFrame:
    """Pairs of one example that overlap enough. An equi-join on the example with the interval test on top; drift counts
    only what gold loses."""
    g = gold.select("example_id", "gold_index", F.col("start").alias("gs"), F.col("end").alias("ge"), F.col("entity_type").alias("gold_type"))
    f = found.select("example_id", "found_index", F.col("start").alias("fs"), F.col("end").alias("fe"), F.col("entity_type").alias("found_type"))
    pairs = g.join(f, "example_id").where("gs < fe and fs < ge")
    overlap = F.least("ge", "fe") - F.greatest("gs", "fs")
    g_len, f_len = F.greatest(F.col("ge") - F.col("gs"), F.lit(1)), F.greatest(F.col("fe") - F.col("fs"), F.lit(1))
    pairs = pairs.select(
        "example_id", "gold_index", "found_index", "gold_type", "found_type", overlap.alias("overlap_bytes"), (overlap / g_len).alias("gold_coverage"), (overlap / f_len).alias("found_coverage"),
        F.greatest(F.lit(0), F.col("fs") - F.col("gs"), F.col("ge") - F.col("fe")).alias("drift"), F.abs(f_len - g_len).alias("length_delta"),
    )
    return pairs.where((F.col("drift") <= tolerance.boundary_bytes) & (F.col("gold_coverage") >= tolerance.gold_coverage) & (F.col("found_coverage") >= tolerance.found_coverage))


def matches(pairs: DataFrame) -> DataFrame:
    """Greedy one-to-one: pairs by coverage, drift, length and place; each gold and each detection is used once. An
    example's pairs are few, so they are folded as one array."""
    key = F.struct(
        (-F.col("gold_coverage")).alias("a"), (-F.col("found_coverage")).alias("b"), F.col("drift").alias("c"), F.col("length_delta").alias("d"), "gold_index", "found_index", "gold_type", "found_type", "overlap_bytes"
    )
    grouped = pairs.groupBy("example_id").agg(F.sort_array(F.collect_list(key)).alias("pairs"))
    empty = F.filter("pairs", lambda p: F.lit(False))

    def step(acc: Column, p: Column) -> Column:
        return F.when(F.exists(acc, lambda q: (q["gold_index"] == p["gold_index"]) | (q["found_index"] == p["found_index"])), acc).otherwise(F.concat(acc, F.array(p)))

    chosen = grouped.select("example_id", F.explode(F.aggregate("pairs", empty, step)).alias("p"))
    return chosen.select("example_id", "p.gold_index", "p.found_index", "p.gold_type", "p.found_type", "p.overlap_bytes", (-F.col("p.a")).alias("gold_coverage"), (-F.col("p.b")).alias("found_coverage"), (F.col("p.gold_type") == F.col("p.found_type")).alias("type_correct"))


def outcomes(gold: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """A row for each match (tp, by gold type), unmatched gold (fn) and unmatched detection (fp)."""
    tp = matched.select("example_id", F.col("gold_type").alias("entity_type"), F.lit("tp").alias("outcome"), "type_correct")
    fn = gold.join(matched, ["example_id", "gold_index"], "left_anti").select("example_id", "entity_type", F.lit("fn").alias("outcome"), F.lit(None).cast("boolean").alias("type_correct"))
    fp = found.join(matched, ["example_id", "found_index"], "left_anti").select("example_id", "entity_type", F.lit("fp").alias("outcome"), F.lit(None).cast("boolean").alias("type_correct"))
    return tp.unionByName(fn).unionByName(fp)


def with_bucket(rows: DataFrame, examples: DataFrame, gold: DataFrame) -> DataFrame:
    """Adds language, length_bucket and kind: negative (no gold), misc (some MISC gold), else headline."""
    kinds = gold.groupBy("example_id").agg(F.bool_or(F.col("entity_type") == "MISC").alias("has_misc"))
    kind = F.when(F.col("has_misc").isNull(), "negative").when(F.col("has_misc"), "misc").otherwise("headline")
    return rows.join(examples.join(kinds, "example_id", "left").select("example_id", "language", "length_bucket", kind.alias("kind")), "example_id")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, 0.0).otherwise(a / b)


def metrics(rows: DataFrame, *by: str, accuracy: bool = False) -> DataFrame:
    """tp, fp, fn, precision, recall, f1 (0 without a denominator) by the given columns, in one aggregation; on request also the
    share of matches whose type is right."""
    more = [F.coalesce(F.avg(F.col("type_correct").cast("double")), F.lit(0.0)).alias("type_accuracy")] if accuracy else []
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = rows.groupBy(*by).agg(n("tp").alias("tp"), n("fp").alias("fp"), n("fn").alias("fn"), *more)
    p, r = _ratio(F.col("tp"), F.col("tp") + F.col("fp")), _ratio(F.col("tp"), F.col("tp") + F.col("fn"))
    return counts.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))))


def headline(rows: DataFrame) -> DataFrame:
    """One row; also the share of matches whose type is right."""
    return metrics(rows.where("kind = 'headline'"), accuracy=True)


def by_type(rows: DataFrame) -> DataFrame:
    """All types, also those without rows; false positives count under the detected type."""
    types = rows.sparkSession.createDataFrame([(t,) for t in C.ENTITY_TYPES], "entity_type string")
    got = metrics(rows.where("kind = 'headline'"), "entity_type")
    joined = types.join(got, "entity_type", "left")
    return joined.select("entity_type", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("tp", "fp", "fn")], *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")])


def negatives(rows: DataFrame, examples: DataFrame, gold: DataFrame) -> DataFrame:
    """Examples without gold: how many, how many without a detection, and false positives for each example (may pass 1)."""
    own = examples.join(gold, "example_id", "left_anti").select("example_id")
    fps = rows.where("kind = 'negative' and outcome = 'fp'").groupBy("example_id").agg(F.count(F.lit(1)).alias("n"))
    per = own.join(fps, "example_id", "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    out = per.agg(F.count(F.lit(1)).alias("examples"), F.count_if(F.col("n") == 0).alias("passed"), F.count_if(F.col("n") > 0).alias("failed"), F.coalesce(F.sum("n"), F.lit(0)).alias("false_positives"))
    return out.withColumn("pass_rate", _ratio(F.col("passed"), F.col("examples"))).withColumn("false_positive_rate", _ratio(F.col("false_positives"), F.col("examples")))


def samples(rows: DataFrame, outcome: str, most: int = 5) -> DataFrame:
    return rows.where(F.col("outcome") == outcome).orderBy(*rows.columns).limit(most)


def latency(df: DataFrame, ms: str) -> DataFrame:
    """Count, sum, mean, nearest-rank p50 and p95, and maximum; zeros for an empty table.

    Values are counted, dealt by ranges and stored; the sizes of the ranges, a row for each, say which one holds a rank, and only
    that range is put in order.
    """
    values = df.where(F.col(ms).isNotNull()).select(F.col(ms).cast("double").alias("ms"))
    counts = stored(values.groupBy("ms").agg(F.count(F.lit(1)).alias("n")).repartitionByRange("ms").withColumn("_range", F.spark_partition_id()))
    sizes = sorted(counts.groupBy("_range").agg(F.sum("n").alias("n")).collect())
    total = sum(r.n for r in sizes)

    def rank(share: float) -> float:
        at = max(1, math.ceil(total * share))
        for r in sizes:
            if at <= r.n:
                within = counts.where(F.col("_range") == r["_range"]).withColumn("upto", F.sum("n").over(Window.partitionBy("_range").orderBy("ms")))
                return within.where(F.col("upto") >= at).agg(F.min("ms")).first()[0]
            at -= r.n
        return 0.0

    number = lambda c: F.coalesce(c, F.lit(0.0))
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("count"), number(F.max("ms")).alias("max_ms"))
    exact = values.agg(number(F.sum("ms")).alias("total_ms"), number(F.avg("ms")).alias("average_ms")).first()
    return sums.select("count", F.lit(exact.total_ms).alias("total_ms"), F.lit(exact.average_ms).alias("average_ms"), F.lit(rank(0.5)).alias("p50_ms"), F.lit(rank(0.95)).alias("p95_ms"), "max_ms")


def by_example(examples: DataFrame, gold: DataFrame, found: DataFrame, matched: DataFrame) -> DataFrame:
    """Each example with the lists gold, found, matches, missed and wrong, empty where there are none. An example has few spans."""
    lists = {
        "gold": (gold, ["gold_index", "start", "end", "entity_type"]), "found": (found, ["found_index", "start", "end", "entity_type"]), "matches": (matched, ["gold_index", "found_index", "type_correct"]),
        "missed": (gold.join(matched, ["example_id", "gold_index"], "left_anti"), ["gold_index", "entity_type"]), "wrong": (found.join(matched, ["example_id", "found_index"], "left_anti"), ["found_index", "entity_type"]),
    }
    out = examples
    for name, (df, columns) in lists.items():
        rows = df.groupBy("example_id").agg(F.sort_array(F.collect_list(F.struct(*columns))).alias(name))
        out = out.join(rows, "example_id", "left")
        out = out.withColumn(name, F.coalesce(name, F.filter(name, lambda x: F.lit(False)), F.from_json(F.lit("[]"), out.schema[name].dataType)))
    return out


def report_text(name: str, row: dict, types: list[dict], timing: dict) -> str:
    """The report's fixed layout, from collected aggregates: percentages with one decimal, numbers with up to three."""
    number = lambda v: f"{v:.3f}".rstrip("0").rstrip(".")
    percent = lambda v: f"{100 * v:.1f}%"
    lines = [name, f"TP {row['tp']}  FP {row['fp']}  FN {row['fn']}", f"precision {percent(row['precision'])}  recall {percent(row['recall'])}  F1 {percent(row['f1'])}"]
    lines += [f"  {t['entity_type']}: precision {percent(t['precision'])} recall {percent(t['recall'])} F1 {percent(t['f1'])}" for t in types if t["tp"] + t["fp"] + t["fn"]]
    return "\n".join([*lines, f"latency ms: avg {number(timing['average_ms'])} p50 {number(timing['p50_ms'])} p95 {number(timing['p95_ms'])} max {number(timing['max_ms'])}"])


def number_text(value: float | None) -> str:
    """Up to three decimals."""
    return "n/a" if value is None else f"{value:.3f}".rstrip("0").rstrip(".")


def _counted(m: dict) -> str:
    return f"TP {m['tp']}, FP {m['fp']}, FN {m['fn']}"


def _percent(value: float) -> str:
    return f"{100 * value:.1f}%"


def _times(t: dict) -> str:
    return ", ".join(f"{name} {t[key]:.0f} ms" for name, key in (("avg", "average_ms"), ("p50", "p50_ms"), ("p95", "p95_ms"), ("max", "max_ms")))


def _sampled(rows: list[dict]) -> str:
    def line(r: dict) -> str:
        other = f", detected {r['detected_type']}" if r.get("detected_type") and r["detected_type"] != r["entity_type"] else ""
        scored = f", score {number_text(r['score'])}" if r.get("score") is not None else ""
        text = r["text"] if len(r["text"]) <= 60 else r["text"][:57] + "..."
        return f"- {r['example_id']} {r['entity_type']} \"{text}\" [{r['start']}-{r['end']}{other}{scored}] :: {r['context']}"

    return "\n".join(map(line, rows)) or "none"


def full_report(report: dict) -> str:
    """The whole report in its fixed layout, from collected aggregates.

    Keys: corpus (id, examples, schema, dataset, revision, unit, scoring), mode, config (provider, model, ner_enabled,
    min_confidence, context_boost, context_window), provider (state, message), headline (metrics, type_accuracy, type_correct,
    matched), languages, lengths, types (metrics by key, in order), negative, misc (also examples, gold_spans), wall_ms, latency,
    ner (or None), load_ms (or None), missed and wrong (samples).
    """
    c, f, h, neg, misc = (report[k] for k in ("corpus", "config", "headline", "negative", "misc"))
    by_key = lambda rows: "; ".join(f"{k} {_percent(m['f1'])} ({_counted(m)})" for k, m in rows.items())
    accuracy = lambda m: f"{_percent(m['type_accuracy'])} ({m['type_correct']}/{m['matched']})"
    scored = {k: m for k, m in report["types"].items() if m["tp"] + m["fp"] + m["fn"]}
    state, load = report["provider"], report.get("load_ms")
    sections = [
        ["OpenPII benchmark", f"Corpus: {c['id']} ({c['examples']} examples, schema {c['schema']})", f"Source: {c['dataset']}" + (f" @ {c['revision']}" if c.get("revision") else ""), f"Offsets: {c['unit']}; scoring: {c['scoring']}"],
        [
            "Effective config", f"Mode: {report['mode']}", f"Provider: {f['provider']}; model: {f['model']}; NER enabled: {'yes' if f['ner_enabled'] else 'no'}",
            f"Min confidence: {number_text(f['min_confidence'])}; context boost: {number_text(f['context_boost'])}; context window: {f['context_window']}", f"Provider status: {state['state']}" + (f" ({state['message']})" if state.get("message") else ""),
        ],
        ["Headline quality", f"Micro span P/R/F1: {_percent(h['precision'])} / {_percent(h['recall'])} / {_percent(h['f1'])} ({_counted(h)})", f"Type accuracy on matched spans: {accuracy(h)}"],
        ["Breakdowns", f"Language: {by_key(report['languages'])}", f"Length: {by_key(report['lengths'])}", f"Entity: {by_key(scored) or 'no scored entity spans'}"],
        [
            "Negative and miscellaneous", f"Negative examples: {neg['passed']}/{neg['examples']} passed ({_percent(neg['pass_rate'])}); false positives/example {number_text(neg['false_positive_rate'])}",
            f"Misc bucket: {misc['examples']} examples, {misc['gold_spans']} gold spans, F1 {_percent(misc['f1'])}, type accuracy {accuracy(misc)}",
        ],
        [
            "Latency", f"Total wall time: {report['wall_ms']:.0f} ms", f"Per example: {_times(report['latency'])}", f"NER timing: {_times(report['ner']) if report.get('ner') else 'unavailable'}",
            f"Last provider model load: {'unavailable' if load is None else f'{load:.0f} ms'}",
        ],
        ["False negative samples", _sampled(report["missed"])],
        ["False positive samples", _sampled(report["wrong"])],
    ]
    return "\n\n".join("\n".join(lines) for lines in sections)
