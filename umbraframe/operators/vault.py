"""Numbering, placeholders, synthetic values, the entity map of a conversation and the global vault.

Inputs are mention rows: conv_id, seq (unique, and what orders all mentions), start, entity_type, text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T
from umbraframe.sources.state import stored as stored_frame

def numbered(df: DataFrame, group: list[str], order: str, out: str = "n") -> DataFrame:
    """1, 2, ... by a unique order within a group, without gathering a group in one task.

    Rows are dealt by ranges of group and order and stored, so that each knows its range. A window numbers the rows that a
    group has in one range, and a sum over the sizes of a group's few ranges gives where each of them begins.
    """
    placed = stored_frame(df.repartitionByRange(*group, order).withColumn("_range", F.spark_partition_id()))
    within = Window.partitionBy(*group, "_range").orderBy(order)
    sizes = placed.groupBy(*group, "_range").agg(F.count(F.lit(1)).alias("_size"))
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    begins = sizes.select(*group, "_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    rows = placed.withColumn("_n", F.row_number().over(within)).join(begins, [*group, "_range"])
    return rows.withColumn(out, F.col("_n") + F.col("_before")).drop("_n", "_before", "_range")


def first_mentions(mentions: DataFrame, keys: list[str], *first: str) -> DataFrame:
    """One row for each key: its first seq, and the named columns of that mention."""
    return mentions.groupBy(*keys).agg(F.min("seq").alias("first_seq"), *[F.min_by(c, "seq").alias(c) for c in first])


def entity_map(mentions: DataFrame, stored: DataFrame | None = None) -> DataFrame:
    """(conv_id, placeholder, original, entity_type): numbers by conversation and type in order of first mention.

    The same text has one placeholder whatever its later types. `stored` holds earlier rows (conv_id, placeholder,
    original): known texts keep theirs, and counters go on behind the largest number.
    """
    first = first_mentions(mentions, ["conv_id", "text"], "entity_type")
    if stored is not None:
        first = first.join(stored.select("conv_id", F.col("original").alias("text")), ["conv_id", "text"], "left_anti")
    rows = numbered(first, ["conv_id", "entity_type"], "first_seq")
    if stored is not None:
        kind, index = T.parsed_placeholder(F.col("placeholder"))
        used = stored.select("conv_id", kind.alias("entity_type"), index.alias("index")).where("index is not null").groupBy("conv_id", "entity_type").agg(F.max("index").alias("used"))
        rows = rows.join(used, ["conv_id", "entity_type"], "left").withColumn("n", F.col("n") + F.coalesce("used", F.lit(0)))
    new = rows.select("conv_id", T.placeholder(F.col("entity_type"), F.col("n")).alias("placeholder"), F.col("text").alias("original"), "entity_type")
    if stored is None:
        return new
    return new.unionByName(stored.select("conv_id", "placeholder", "original", T.parsed_placeholder(F.col("placeholder"))[0].alias("entity_type")))


def from_pool(pool: list[str], index: Column) -> Column:
    """Value by number from 0; after the last the values come again with a count behind them."""
    n = len(pool)
    base = F.element_at(F.array(*map(F.lit, pool)), (index % n + 1).cast("int"))
    again = (F.floor(index / n) + 1).cast("string")
    return F.when(index < n, base).when(base.rlike(r"^[\d\s+\-()]+$"), F.concat(base, F.lit("-"), again)).otherwise(F.concat(base, F.lit(" "), again))


def synthetic(entity_type: Column, index: Column) -> Column:
    """A safe stand-in by number from 0; null for types that have none."""
    local = F.regexp_replace(F.regexp_replace(F.lower(from_pool(C.POOLS["PERSON"], index)), "[^a-z0-9]+", "."), r"^\.+|\.+$", "")
    email = F.concat(local, F.lit("@"), F.element_at(F.array(*map(F.lit, C.EMAIL_DOMAINS)), (index % 3 + 1).cast("int")))
    out = F.when(entity_type == "EMAIL", email)
    for kind, pool in C.POOLS.items():
        out = out.when(entity_type == kind, from_pool(pool, index))
    return out


def pool_size(entity_type: str) -> int:
    return len(C.POOLS["PERSON"]) * len(C.EMAIL_DOMAINS) if entity_type == "EMAIL" else len(C.POOLS.get(entity_type, ()))


def active_replacement(placeholder: Column, value: Column, mode: Column) -> Column:
    return F.when((mode == "synthetic") & (F.coalesce(value, F.lit("")) != ""), value).otherwise(placeholder)


def vault(mentions: DataFrame, counters: DataFrame | None = None, mode: str = "placeholder") -> DataFrame:
    """One record for each (type, normal key) with its first spelling, placeholder from 1 on and synthetic value from 0.

    Columns: entity_type, normalized_key, original_text, placeholder, synthetic_value, replacement_mode, pinned,
    first_seq, last_seq, usage_count. `counters` (entity_type, used) lets numbers go on. Mentions are reduced to keys
    before anything is numbered.
    """
    keyed = mentions.withColumn("normalized_key", T.normal_key(F.col("text")))
    records = keyed.groupBy("entity_type", "normalized_key").agg(F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"), F.count(F.lit(1)).alias("usage_count"), F.min_by("text", "seq").alias("original_text"))
    rows = numbered(records, ["entity_type"], "first_seq")
    if counters is not None:
        rows = rows.join(F.broadcast(counters.where(F.col("entity_type").isin(*C.ENTITY_TYPES))), "entity_type", "left").withColumn("n", F.col("n") + F.coalesce("used", F.lit(0)))
    value = F.coalesce(synthetic(F.col("entity_type"), F.col("n") - 1), F.lit(""))
    rows = rows.withColumn("synthetic_value", value).withColumn("placeholder", T.placeholder(F.col("entity_type"), F.col("n")))
    chosen = F.when((F.lit(mode) == "synthetic") & (F.col("synthetic_value") != ""), "synthetic").otherwise("placeholder")
    return rows.select("entity_type", "normalized_key", "original_text", "placeholder", "synthetic_value", chosen.alias("replacement_mode"), F.lit(False).alias("pinned"), "first_seq", "last_seq", "usage_count")


def updated(records: DataFrame, patch: DataFrame) -> DataFrame:
    """Applies a patch by placeholder (null: unchanged). Synthetic mode without a value falls back to placeholder."""
    cols = [c for c in ("original_text", "synthetic_value", "replacement_mode", "pinned") if c in patch.columns]
    joined = records.join(patch.select("placeholder", *[F.col(c).alias(f"new_{c}") for c in cols]), "placeholder", "left")
    for c in cols:
        joined = joined.withColumn(c, F.coalesce(f"new_{c}", c)).drop(f"new_{c}")
    mode = F.when((F.col("replacement_mode") == "synthetic") & (F.col("synthetic_value") == ""), "placeholder").otherwise(F.col("replacement_mode"))
    return joined.withColumn("replacement_mode", mode).withColumn("normalized_key", T.normal_key(F.col("original_text"))).select(*records.columns)


def imported(records: DataFrame, given: DataFrame) -> DataFrame:
    """Adds given records whose (type, key) is new; of several in the file the first (by `line`) counts."""
    first = given.groupBy("entity_type", "normalized_key").agg(*[F.min_by(c, "line").alias(c) for c in records.columns if c not in ("entity_type", "normalized_key")])
    return records.unionByName(first.join(records, ["entity_type", "normalized_key"], "left_anti").select(*records.columns))


def merged_counters(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).groupBy("entity_type").agg(F.max("used").alias("used"))


def counters(records: DataFrame) -> DataFrame:
    return records.groupBy("entity_type").agg(F.max(T.parsed_placeholder(F.col("placeholder"))[1]).alias("used"))


def by_recency(records: DataFrame, most: int | None = None) -> DataFrame:
    """All records, or the `most` first ones, by when they were last seen."""
    ordered = records.orderBy(F.desc("last_seq"), "placeholder")
    return ordered if most is None else ordered.limit(most)


def without_unpinned(records: DataFrame) -> DataFrame:
    return records.where("pinned")


def deleted(records: DataFrame, placeholders: DataFrame) -> DataFrame:
    """Records without those that a table (placeholder) names."""
    return records.join(placeholders.select("placeholder"), "placeholder", "left_anti").select(*records.columns)


def preview(mentions: DataFrame, records: DataFrame, pass_col: str, mode: str = "placeholder") -> DataFrame:
    """What each mention (pass, seq, entity_type, text) would be replaced by, without changing the vault: a known key has its
    record's replacement; a new one gets the next number of its type behind the vault's, counted anew in each pass."""
    keyed = mentions.withColumn("normalized_key", T.normal_key(F.col("text")))
    known = records.select("entity_type", "normalized_key", active_replacement(F.col("placeholder"), F.col("synthetic_value"), F.col("replacement_mode")).alias("known"))
    keyed = keyed.join(known, ["entity_type", "normalized_key"], "left")
    new = keyed.where("known is null").groupBy(pass_col, "entity_type", "normalized_key").agg(F.min("seq").alias("first_seq"))
    new = numbered(new, [pass_col, "entity_type"], "first_seq").join(F.broadcast(counters(records)), "entity_type", "left")
    n = F.col("n") + F.coalesce("used", F.lit(0))
    shown = active_replacement(T.placeholder(F.col("entity_type"), n), synthetic(F.col("entity_type"), n - 1), F.lit(mode))
    new = new.select(pass_col, "entity_type", "normalized_key", shown.alias("new"))
    return keyed.join(new, [pass_col, "entity_type", "normalized_key"], "left").withColumn("replacement", F.coalesce("known", "new")).drop("known", "new", "normalized_key")


def external_map(events: DataFrame) -> DataFrame:
    """(conv_id, key, original) after events (conv_id, seq, replacement, original) were added one after the other: a text's new
    replacement takes the place of its earlier one, whose key is forgotten."""
    order = Window.partitionBy("conv_id", "original").orderBy("seq")
    rows = events.select("conv_id", "seq", "replacement", "original", F.lag("replacement").over(order).alias("earlier"))
    gone = rows.where("earlier <> replacement").groupBy("conv_id", F.col("earlier").alias("key")).agg(F.max("seq").alias("gone"))
    put = rows.groupBy("conv_id", F.col("replacement").alias("key")).agg(F.max("seq").alias("put"), F.max_by("original", "seq").alias("original"))
    return put.join(gone, ["conv_id", "key"], "left").where("gone is null or gone < put").select("conv_id", "key", "original")


def reverse_index(records: DataFrame) -> DataFrame:
    """(key, original): placeholders and synthetic values; of equal keys the last record's counts."""
    keys = records.select(F.col("placeholder").alias("key"), "original_text", "first_seq").unionByName(
        records.where("synthetic_value <> ''").select(F.col("synthetic_value").alias("key"), "original_text", "first_seq")
    )
    return keys.groupBy("key").agg(F.max_by("original_text", "first_seq").alias("original"))


def augmented(stored: DataFrame, records: DataFrame) -> DataFrame:
    """A conversation's map (conv_id, key, original) with the other key of every record that it already uses."""
    own = records.select("placeholder", "synthetic_value", "original_text")
    touched = stored.join(own, stored["key"] == own["placeholder"]).select("conv_id", "placeholder", "synthetic_value", "original_text")
    touched = touched.unionByName(stored.join(own.where("synthetic_value <> ''"), stored["key"] == own["synthetic_value"]).select("conv_id", "placeholder", "synthetic_value", "original_text")).distinct()
    both = touched.select("conv_id", F.explode(F.array("placeholder", "synthetic_value")).alias("key"), F.col("original_text").alias("original")).where("key <> ''").dropDuplicates(["conv_id", "key"])
    return stored.select("conv_id", "key", "original").unionByName(both.join(stored, ["conv_id", "key"], "left_anti").select("conv_id", "key", "original"))


def merged_maps(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows (conv_id, key, original): new ones win, nothing is deleted."""
    return new.unionByName(old.join(new, ["conv_id", "key"], "left_anti"))


def preview_numbers(mentions: DataFrame) -> DataFrame:
    """Placeholders without memory: every mention of a document gets the next number of its type."""
    order = Window.partitionBy("doc_id", "entity_type").orderBy("start")
    return mentions.select("*", T.placeholder(F.col("entity_type"), F.row_number().over(order)).alias("placeholder"))
