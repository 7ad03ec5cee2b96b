"""Streams: quiet responses, repeats, activity, cancellations, running thresholds, the vault as state, detection."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from umbraframe.functions import text as T
from umbraframe.operators import detect, policy

QUIET, REPEAT_MS, KEEP_ALIVE, IDLE, TOMBSTONE = "500 milliseconds", 250, "30 seconds", "10 minutes", "5 minutes"


def quiet_texts(df: DataFrame, key: str, ts: str = "ts", text: str = "text", gap: str = QUIET, late: str = "10 seconds", order: Column | None = None) -> DataFrame:
    """The last text of each burst (by `order`, or by time): a response is read once it has been quiet for `gap`."""
    session = F.session_window(ts, gap)
    df = df.withWatermark(ts, late) if df.isStreaming else df
    return df.groupBy(key, session.alias("w")).agg(F.max_by(text, F.col(ts) if order is None else order).alias(text), F.max(ts).alias(ts)).select(key, ts, text)


def activity(df: DataFrame, key: str, ts: str = "ts", gap: str = KEEP_ALIVE, late: str = "1 minute") -> DataFrame:
    """Sessions with their number of events: how long something is kept alive, or until it is idle."""
    df = df.withWatermark(ts, late) if df.isStreaming else df
    return df.groupBy(key, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n_events")).select(key, F.col("w.start").alias("begins"), F.col("w.end").alias("ends"), "n_events")


def _fresh(last: tuple[str, int] | None, text: str, at: int, window_ms: int) -> bool:
    return last is None or last[0] != text or at - last[1] >= window_ms


def without_repeats(df: DataFrame, key: str, window_ms: int = REPEAT_MS) -> DataFrame:
    """Rows (key, at, text) without those that repeat the last seen text within the window; state: that text and its time."""

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get if state.exists else None
        for frame in frames:
            out = []
            for at, text in sorted(zip(frame["at"], frame["text"], strict=True)):
                if _fresh(last, text, at, window_ms):
                    out.append((group[0], at, text))
                last = (text, int(at))
            yield pd.DataFrame(out, columns=[key, "at", "text"])
        if last is not None:
            state.update(last)

    kind = dict(df.dtypes)[key]
    return df.select(key, "at", "text").groupBy(key).applyInPandasWithState(run, f"{key} {kind}, at bigint, text string", "text string, at bigint", "append", GroupStateTimeout.NoTimeout)


def without_repeats_batch(df: DataFrame, key: str, window_ms: int = REPEAT_MS) -> DataFrame:
    """The same over a table, as a window over each key's rows."""
    order = Window.partitionBy(key).orderBy("at", "text")
    same = (F.lag("text").over(order) == F.col("text")) & (F.col("at") - F.lag("at").over(order) < window_ms)
    return df.select(key, "at", "text", F.coalesce(same, F.lit(False)).alias("_same")).where("not _same").drop("_same")


def not_cancelled(results: DataFrame, cancels: DataFrame, key: str, ts: str = "ts", keep: str = TOMBSTONE) -> DataFrame:
    """Results whose request was not cancelled at most `keep` before. On streams this is a left outer join in a time range
    whose unmatched rows come out as the watermark passes; on tables a left anti join."""
    c = cancels.select(F.col(key).alias("_key"), F.col(ts).alias("_ts"))
    if not results.isStreaming:
        return results.join(c, (results[key] == c["_key"]) & (c["_ts"] <= results[ts]) & (c["_ts"] >= results[ts] - F.expr(f"interval {keep}")), "left_anti")
    results, c = results.withWatermark(ts, keep), c.withWatermark("_ts", keep)
    timed = (F.col(key) == F.col("_key")) & (F.col("_ts") <= F.col(ts)) & (F.col("_ts") >= F.col(ts) - F.expr(f"interval {keep}"))
    return results.join(c, timed, "leftOuter").where("_key is null").drop("_key", "_ts")


def running_thresholds(feedback: DataFrame, base: float) -> DataFrame:
    """Adaptive thresholds after each feedback: a streaming aggregation in complete or update mode."""
    return policy.adaptive_thresholds(feedback, base)


def last_rows(df: DataFrame, order: str, most: int = 1000) -> DataFrame:
    """What a bounded log keeps: its last rows."""
    return df.orderBy(F.desc(order)).limit(most)


def keep_log(path: str, order: str, most: int = 1000) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: the log table at `path` with the batch added, cut to its last rows. Two folders take turns, so
    that a batch that runs again after a failure finds what the one before it wrote."""

    def merge(batch: DataFrame, number: int) -> None:
        spark, rows = batch.sparkSession, batch
        if number:
            rows = spark.read.parquet(f"{path}/{(number - 1) % 2}").unionByName(batch)
        last_rows(rows, order, most).write.mode("overwrite").parquet(f"{path}/{number % 2}")

    return merge


def vault_records(mentions: DataFrame) -> DataFrame:
    """The vault as state: mentions (entity_type, text, seq) in, a record for each new (type, normal key) out, numbered
    by type in order of arrival. The state of a type is its next number; keys are deduplicated before."""
    keyed = mentions.withColumn("normalized_key", T.normal_key(F.col("text"))).dropDuplicates(["entity_type", "normalized_key"])

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        used = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values("seq")
            numbers = range(used + 1, used + 1 + len(frame))
            used += len(frame)
            yield pd.DataFrame({"entity_type": group[0], "normalized_key": frame["normalized_key"], "original_text": frame["text"], "placeholder": [f"[{group[0]}_{n}]" for n in numbers]})
        state.update((used,))

    schema = "entity_type string, normalized_key string, original_text string, placeholder string"
    return keyed.groupBy("entity_type").applyInPandasWithState(run, schema, "used bigint", "append", GroupStateTimeout.NoTimeout)


def detected(df: DataFrame, text: str = "text", config: detect.Config = detect.Config()) -> DataFrame:
    """Detection is a column expression, so a stream takes it as a table does."""
    return detect.detect(df, text, config=config)
