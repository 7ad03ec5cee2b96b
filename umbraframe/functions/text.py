"""Column functions over texts: offsets, slices, keys, patterns. Offsets are UTF-8 bytes, ends exclusive."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:bigint,end:bigint,entity_type:string,score:double,text:string,source:string>"


def byte_length(text: Column) -> Column:
    return F.octet_length(text).cast("bigint")


def byte_offset(text: Column, index: Column) -> Column:
    """The byte offset of a code-point index; below the text 0, beyond it the text's length."""
    return F.when(index <= 0, F.lit(0).cast("bigint")).otherwise(byte_length(F.substring(text, F.lit(1), index.cast("int"))))


def code_point_index(text: Column, offset: Column) -> Column:
    """The code-point index of a byte offset, rounded up inside a character."""
    raw = text.cast("binary")
    # A byte 10xxxxxx goes on with a character: its place is counted at the character's end.
    head = F.hex(F.substring(raw, F.lit(1), F.greatest(offset, F.lit(0)).cast("int")))
    leading = F.length(F.regexp_replace(head, "([89AB][0-9A-F])|([0-9A-F]{2})", "$2")) / 2
    return leading.cast("bigint")


def byte_slice(text: Column, start: Column, end: Column) -> Column:
    """The text between two byte offsets. Strings are UTF-8 bytes already, so neither cast copies the text."""
    return F.substring(text.cast("binary"), (start + 1).cast("int"), (end - start).cast("int")).cast("string")


def on_boundaries(text: Column, start: Column, end: Column) -> Column:
    """Whether neither offset is inside a character."""
    raw = text.cast("binary")
    inside = lambda at: F.hex(F.substring(raw, (at + 1).cast("int"), F.lit(1))).rlike("^[89AB]")
    return ~inside(start) & ~inside(end)


def located(text: Column, regex: str | Column) -> Column:
    """All non-overlapping matches with their byte offsets: array<struct<start,end,text>>.

    The matches and the pieces between them together are the text, so lengths add up to offsets.
    """
    pattern = F.lit(regex) if isinstance(regex, str) else regex
    empty = F.expr("cast(array() as array<struct<start:bigint,end:bigint,text:string>>)")

    def placed(x: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            start = acc["at"] + byte_length(F.get(x["p"], i))
            end = start + byte_length(F.get(x["m"], i))
            return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), F.get(x["m"], i).alias("text")))).alias("out"))

        begin = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))
        return F.when(F.size(x["m"]) > 0, F.aggregate(F.sequence(F.lit(0), F.size(x["m"]) - 1), begin, step, lambda acc: acc["out"])).otherwise(empty)

    both = F.struct(F.regexp_extract_all(text, pattern, F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("p"))
    return F.coalesce(F.get(F.transform(F.array(both), placed), F.lit(0)), empty)


def normal_key(value: Column) -> Column:
    """Trimmed, white space collapsed, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(value, r"(?U)^\s+|\s+$", ""), r"(?U)\s+", " "))


def placeholder(entity_type: Column, index: Column) -> Column:
    return F.concat(F.lit("["), entity_type, F.lit("_"), index.cast("string"), F.lit("]"))


def parsed_placeholder(value: Column) -> tuple[Column, Column]:
    """(type, index) of `[TYPE_n]`; nulls for anything else."""
    regex = r"^\[([A-Z][A-Z_]*)_(\d+)\]$"
    part = lambda k: F.nullif(F.regexp_extract(value, regex, k), F.lit(""))
    return part(1), part(2).cast("bigint")


def wildcard_regex(pattern: str) -> str:
    """Whole-word, case-insensitive pattern; * stands for word characters. Boundaries are ASCII; group 2 matches."""
    escaped = re.sub(r"[.+?^${}()|\[\]\\]", lambda m: "\\" + m[0], pattern).replace("*", r"\w+")
    return f"(?i)(^|[^A-Za-z0-9_])({escaped})(?=$|[^A-Za-z0-9_])"


def wildcard_matches(text: Column, pattern: str) -> Column:
    """Matches of a list pattern with byte offsets; the boundary character before a match is not part of it."""
    first = wildcard_regex(pattern)
    lead = lambda m: byte_length(m["text"]) - byte_length(F.regexp_extract(m["text"], first, 2))
    return F.transform(located(text, first), lambda m: F.struct((m["start"] + lead(m)).alias("start"), m["end"].alias("end"), F.regexp_extract(m["text"], first, 2).alias("text")))


def length_bucket(text: Column) -> Column:
    """short up to 120 UTF-16 units, medium up to 260, else long."""
    units = F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", ""))
    return F.when(units <= 120, "short").when(units <= 260, "medium").otherwise("long")


def language_code(value: Column) -> Column:
    """en or de from a tag or a name, else null."""
    tag = F.get(F.split(F.lower(F.trim(value)), "[-_]"), F.lit(0))
    return F.when(tag.isin("en", "english"), "en").when(tag.isin("de", "german", "deutsch"), "de")


def escape_html(value: Column) -> Column:
    for sign, name in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(sign), F.lit(name))
    return value


def context_around(text: Column, found: Column, width: int, mark: str = "") -> Column:
    """`width` code points on both sides of the first occurrence; `mark` stands for what is cut off."""
    at = F.instr(text, found)
    low = F.greatest(at - width, F.lit(1))
    high = F.least(at + F.length(found) + width, F.length(text) + 1)
    body = F.substring(text, low, high - low)
    cut = F.concat(F.when(low > 1, mark).otherwise(""), body, F.when(high <= F.length(text), mark).otherwise(""))
    return F.when(at > 0, cut)


def compact_context(text: Column, found: Column, width: int) -> Column:
    """`width` code points on both sides of the first occurrence, white space collapsed, "..." for what is cut off; without an
    occurrence the text's beginning."""
    plain = lambda c: F.trim(F.regexp_replace(c, r"(?U)\s+", " "))
    whole = context_around(plain(text), F.nullif(plain(found), F.lit("")), width, "...")
    return F.coalesce(whole, truncated(plain(text), 2 * width))


def long_enough(text: Column, least: int = 10) -> Column:
    """Whether a text has so many UTF-16 units."""
    return F.length(text) + F.length(F.regexp_replace(text, "[^\\x{10000}-\\x{10FFFF}]", "")) >= least


def truncated(value: Column, most: int, mark: str = "...") -> Column:
    return F.when(F.length(value) > most, F.concat(F.substring(value, 1, most - len(mark)), F.lit(mark))).otherwise(value)


def quoted(needle: str) -> str:
    """A regex that matches the needle as it is."""
    return r"\Q" + needle.replace(r"\E", r"\E\\E\Q") + r"\E"
