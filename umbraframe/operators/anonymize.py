"""Replacing spans in texts, and restoring originals in replies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from umbraframe.functions import text as T

_WORD = r"[\p{L}\p{N}_]"


def replaced(text: Column, spans: Column, resolve_overlaps: bool = True) -> Column:
    """The text with each span (start, end, token) given by its token, by start. Without `resolve_overlaps` a span that
    begins inside the one before it is written all the same."""

    def step(acc: Column, s: Column) -> Column:
        skip = (s["start"] < acc["at"]) if resolve_overlaps else F.lit(False)
        piece = T.byte_slice(text, acc["at"], F.greatest(s["start"], acc["at"]))
        return F.when(skip, acc).otherwise(F.struct(s["end"].alias("at"), F.concat(acc["out"], piece, s["token"]).alias("out")))

    begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    ordered = F.sort_array(F.transform(spans, lambda s, i: F.struct(s["start"].alias("start"), i.alias("i"), s["end"].alias("end"), s["token"].alias("token"))))
    done = F.aggregate(ordered, begin, step, lambda acc: F.concat(acc["out"], T.byte_slice(text, acc["at"], T.byte_length(text))))
    return F.when(F.size(spans) > 0, done).otherwise(text)


def anonymized(documents: DataFrame, tokens: DataFrame, id_col: str, resolve_overlaps: bool = True) -> DataFrame:
    """documents (id, text) with the column anonymized; tokens are rows of id, start, end, token. One shuffle by id."""
    spans = tokens.groupBy(id_col).agg(F.collect_list(F.struct("start", "end", "token")).alias("_spans"))
    joined = documents.join(spans, id_col, "left")
    return joined.withColumn("anonymized", F.when(F.col("_spans").isNull(), F.col("text")).otherwise(replaced(F.col("text"), F.col("_spans"), resolve_overlaps))).drop("_spans")


def interleaved(text: Column, regex: str, replace) -> Column:
    """The text with each match m of the regex given by replace(m)."""
    both = F.struct(F.split(text, regex, -1).alias("p"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"))
    joined = lambda x: F.array_join(F.transform(x["p"], lambda piece, i: F.concat(piece, F.coalesce(replace(F.get(x["m"], i)), F.lit("")))), "")
    return F.get(F.transform(F.array(both), joined), F.lit(0))


def restored_canonical(text: Column, originals: Column) -> Column:
    """[TYPE_n] by its original; unknown ones stay. `originals` is a map from key to original."""
    regex = r"\[([A-Z_]+)_(\d+)\]"
    known = lambda m: F.coalesce(F.try_element_at(originals, m), m)
    return F.when(text.rlike(regex), interleaved(text, regex, known)).otherwise(text)


def has_placeholder(text: Column) -> Column:
    return text.rlike(r"\[([A-Z_]+)_(\d+)\]")


def may_have_placeholder(text: Column) -> Column:
    """A cheap test that every mangled form with two capitals passes."""
    return text.rlike(r"\[?[A-Z]{2,}[A-Z_]*[_ ]?\d+(?!\d)\]?")


def _variant_regex(key: Column) -> Column:
    """Brackets, separator and case may be lost; a side without its bracket must not touch a word."""
    kind, index = T.parsed_placeholder(key)
    left, right = rf"(?i)(?:\[|(?<!{_WORD}))", rf"(?!\d)(?:\]|(?!{_WORD}|\]))"
    return F.concat(F.lit(left), kind, F.lit("[_ ]?"), index.cast("string"), F.lit(right))


def candidate_keys(text: Column) -> Column:
    """Canonical keys that the text may hold in any form: what looks like a type and a number, as it would be written."""
    loose = F.regexp_extract_all(text, F.lit(r"(?i)[A-Z][A-Z_]*[_ ]?\d+"), F.lit(0))
    key = lambda m: F.concat(F.lit("["), F.upper(F.regexp_replace(m, r"[_ ]?\d+$", "")), F.lit("_"), F.regexp_extract(m, r"\d+$", 0), F.lit("]"))
    return F.array_union(F.transform(loose, key), F.regexp_extract_all(text, F.lit(r"\[([A-Z_]+)_(\d+)\]"), F.lit(0)))


def variant_matches(text: Column, keys: Column) -> Column:
    """Non-overlapping matches (start, end, text, key) of known placeholders, larger numbers and longer keys first. Only
    keys that the text may hold are searched for, so the cost doesn't grow with the number of known ones."""
    near = F.array_intersect(candidate_keys(text), keys)
    ranked = F.sort_array(F.transform(near, lambda k, i: F.struct((-T.parsed_placeholder(k)[1]).alias("n"), (-F.length(k)).alias("size"), i.alias("i"), k.alias("key"))))
    usable = F.filter(ranked, lambda r: r["n"].isNotNull())
    found = F.flatten(F.transform(usable, lambda r: F.transform(T.located(text, _variant_regex(r["key"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), r["key"].alias("key")))))
    return _apart(found)


def _apart(found: Column) -> Column:
    """Matches that overlap an earlier one of the list go; the rest by start."""
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,text:string,key:string>>)")

    def step(acc: Column, m: Column) -> Column:
        return F.when(F.exists(acc, lambda p: (m["start"] < p["end"]) & (m["end"] > p["start"])), acc).otherwise(F.concat(acc, F.array(m)))

    return F.sort_array(F.aggregate(found, empty, step))


def _by_original(matches: Column, originals: Column) -> Column:
    return F.transform(matches, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.coalesce(F.try_element_at(originals, m["key"]), m["text"]).alias("token")))


def restored_variants(text: Column, originals: Column) -> Column:
    done = replaced(text, _by_original(variant_matches(text, F.map_keys(originals)), originals))
    return F.when(text.rlike(r"(?i)[A-Z][_ ]?\d"), done).otherwise(text)


def _whole(needle: Column) -> Column:
    """A regex for the needle as a whole word; an end that isn't a word character may touch anything."""
    quoted = F.concat(F.lit(r"\Q"), needle, F.lit(r"\E"))
    left = F.when(needle.rlike(f"^{_WORD}"), F.lit(f"(?<!{_WORD})")).otherwise(F.lit(""))
    right = F.when(needle.rlike(f"{_WORD}$"), F.lit(f"(?!{_WORD})")).otherwise(F.lit(""))
    return F.concat(left, quoted, right)


def restored_synthetic(text: Column, originals: Column) -> Column:
    """Synthetic values, longest first, each over the text that the one before left."""
    entries = F.filter(F.map_entries(originals), lambda e: F.length(e["key"]) > 0)
    ranked = F.sort_array(F.transform(entries, lambda e, i: F.struct((-F.length(e["key"])).alias("size"), i.alias("i"), e["key"].alias("key"), e["value"].alias("value"))))

    def step(acc: Column, r: Column) -> Column:
        literal = F.regexp_replace(r["value"], r"([\\$])", r"\\$1")
        return F.when(acc.contains(r["key"]), F.regexp_replace(acc, _whole(r["key"]), literal)).otherwise(acc)

    return F.aggregate(ranked, text, step)


def restored(text: Column, originals: Column) -> Column:
    """Canonical placeholders, and mangled ones in what stands beside them. Restored text is not looked at again: in
    "ssn [SSN_147]" with the original 147-47-8147 the second pass would find "ssn 147", a mangled form of the same key."""
    regex = r"\[[A-Z_]+_\d+\]"
    both = F.struct(F.split(text, regex, -1).alias("p"), F.regexp_extract_all(text, F.lit(regex), F.lit(0)).alias("m"))
    # Pieces and canonical placeholders in turn; brackets are no word characters, so each can be searched by itself.
    parts = lambda x: F.flatten(F.transform(x["p"], lambda piece, i: F.array(piece, F.coalesce(F.get(x["m"], i), F.lit("")))))
    one = lambda part, i: F.coalesce(F.when(i % 2 == 1, F.try_element_at(originals, part)), restored_variants(part, originals))
    done = F.get(F.transform(F.array(both), lambda x: F.array_join(F.transform(parts(x), one), "")), F.lit(0))
    return F.when(text.rlike(r"(?i)[A-Z][_ ]?\d"), done).otherwise(text)


def restored_with_vault(text: Column, placeholders: Column, synthetics: Column) -> Column:
    """Three passes, each over what the last one left: canonical, mangled, synthetic."""
    return restored_synthetic(restored_variants(restored_canonical(text, placeholders), placeholders), synthetics)


def _is_placeholder(key: Column) -> Column:
    return key.rlike(r"^\[[A-Z][A-Z_]*_\d+\]$")


def resolved(text: Column, originals: Column) -> Column:
    """struct<matches, text>: one pass over the text as it is; placeholders win over synthetic values, and no
    restored text is looked at again. Matches are (start, end, text, key)."""
    keys = F.map_keys(originals)
    spoken = F.sort_array(F.transform(F.filter(keys, lambda k: ~_is_placeholder(k) & (k != "") & text.contains(k)), lambda k, i: F.struct((-F.length(k)).alias("size"), i.alias("i"), k.alias("key"))))
    echoes = F.flatten(F.transform(spoken, lambda r: F.transform(T.located(text, _whole(r["key"])), lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), m["text"].alias("text"), r["key"].alias("key")))))
    matches = _apart(F.concat(variant_matches(text, F.filter(keys, _is_placeholder)), echoes))
    one = lambda m: F.struct(m.alias("matches"), replaced(text, _by_original(m, originals)).alias("text"))
    return F.get(F.transform(F.array(matches), one), F.lit(0))


def has_reversible(text: Column, originals: Column) -> Column:
    """Whether a known placeholder in any form, or any synthetic value even inside a word, is in the text."""
    keys = F.map_keys(originals)
    return (F.size(variant_matches(text, F.filter(keys, _is_placeholder))) > 0) | F.exists(F.filter(keys, lambda k: ~_is_placeholder(k) & (k != "")), lambda k: text.contains(k))


def map_of(rows: DataFrame, id_col: str, key: str = "key", original: str = "original") -> DataFrame:
    """(id, originals): a conversation's keys as a map; its size is that of one conversation's entities."""
    return rows.dropDuplicates([id_col, key]).groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct(key, original))).alias("originals"))


def with_needed(df: DataFrame, id_col: str, group_col: str, text: Column, rows: DataFrame) -> DataFrame:
    """df with originals: a map of those rows (group, key, original) that the text may need. A long conversation's whole
    map never travels with each of its texts."""
    need = df.select(id_col, group_col, F.explode(candidate_keys(text)).alias("key"))
    found = need.join(rows.select(group_col, "key", "original").dropDuplicates([group_col, "key"]), [group_col, "key"])
    maps = found.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("key", "original"))).alias("originals"))
    return df.join(maps, id_col, "left").withColumn("originals", F.coalesce("originals", F.expr("cast(map() as map<string,string>)")))


_PIECE = rf"{_WORD}+|[^\p{{L}}\p{{N}}_]"


def _sequences(text: Column, most: int) -> Column:
    """All sequences of up to `most` neighbouring pieces of a text (runs of word characters, and single other signs). Whatever
    stands in the text as a whole is one of them."""
    joined = lambda p, k: F.transform(F.sequence(F.lit(1), F.size(p) - k + 1), lambda i: F.array_join(F.slice(p, i, k), ""))
    some = lambda p: F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size(p))), lambda k: joined(p, k)))
    pieces = F.regexp_extract_all(text, F.lit(_PIECE), F.lit(0))
    return F.get(F.transform(F.array(pieces), lambda p: F.when(F.size(p) > 0, F.array_distinct(some(p))).otherwise(F.expr("cast(array() as array<string>)"))), F.lit(0))


def with_vault(df: DataFrame, id_col: str, text: Column, records: DataFrame) -> DataFrame:
    """df with placeholders and synthetics: maps from the vault's keys that a text may hold to their originals. The vault is
    joined by key, so neither it nor a map of it travels with the texts; of equal synthetic values the later record's counts."""
    empty = F.expr("cast(map() as map<string,string>)")
    own = records.select("placeholder", "synthetic_value", "original_text", "first_seq")
    most = own.agg(F.max(F.size(F.regexp_extract_all("synthetic_value", F.lit(_PIECE), F.lit(0))))).first()[0] or 1
    last = own.where("synthetic_value <> ''").groupBy(F.col("synthetic_value").alias("key")).agg(F.max_by("original_text", "first_seq").alias("original"))
    kinds = {"placeholders": (candidate_keys(text), own.select(F.col("placeholder").alias("key"), F.col("original_text").alias("original"))), "synthetics": (_sequences(text, most), last)}
    for name, (keys, rows) in kinds.items():
        need = df.select(id_col, F.explode(keys).alias("key")).join(rows, "key")
        maps = need.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("key", "original"))).alias(name))
        df = df.join(maps, id_col, "left").withColumn(name, F.coalesce(name, empty))
    return df
