"""JSON and JSON Lines: corpora with their metadata line, raw records with repair, vaults, reports."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.operators.corpus import GOLD, source_spans, violations

EXAMPLE = f"recordType string, id string, language string, lengthBucket string, text string, goldSpans {GOLD}, source struct<dataset:string,recordId:string,split:string,uid:string,region:string,script:string,sourceFile:string,sourceRow:bigint>"
SPANS = "array<struct<start:bigint,end:bigint,entity_type:string,score:double,text:string,source:string>>"
VAULT = "id string, originalText string, normalizedKey string, entityType string, placeholder string, syntheticValue string, replacementMode string, pinned boolean, createdAt bigint, updatedAt bigint, lastSeenAt bigint, usageCount bigint"
RAW = "id string, language string, source_text string, privacy_mask array<struct<start:int,start_offset:int,end:int,end_offset:int,value:string,text:string,label:string,entity_type:string,type:string>>, span_labels array<array<string>>, region string, script string"


def external_spans(raw):
    """A column of JSON arrays of spans; bad JSON gives an empty array."""
    return F.coalesce(F.from_json(raw, SPANS), F.expr(f"cast(array() as {SPANS})"))


def _numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) with line numbers from 1: lines are counted by partition, in the order of the file, and a partition's lines
    begin behind those of the ones before it."""
    at = F.monotonically_increasing_id()  # the partition's number << 33, plus the line's place in it
    lines = spark.read.text(path).select(F.shiftright(at, 33).alias("part"), at.bitwiseAND((1 << 33) - 1).alias("place"), "value")
    sizes = lines.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    begins = sizes.select("part", F.coalesce(F.sum("n").over(order), F.lit(0)).alias("begins"))
    return lines.join(F.broadcast(begins), "part").select((F.col("begins") + F.col("place") + 1).alias("line"), "value")


def parsed_records(df: DataFrame, column: str = "record") -> DataFrame:
    """Raw records of a JSON column, their spans in one form: id, language, source_text, privacy_mask, region, script."""
    rows = df.withColumn("_r", F.from_json(column, f"struct<{_struct(RAW)}>"))
    spans = source_spans(F.col("_r.privacy_mask"), F.col("_r.span_labels"))
    return rows.select("*", "_r.id", "_r.language", "_r.source_text", spans.alias("privacy_mask"), "_r.region", "_r.script").drop("_r", column)


def read_corpus(spark: SparkSession, path: str) -> tuple[dict, DataFrame]:
    """The metadata record and the examples of a corpus; raises on anything unsound, with the lines' places.

    A line's number is counted by partitions of the text file, never in one task; blank lines don't count as records.
    """
    lines = _numbered_lines(spark, path).withColumn("value", F.regexp_replace("value", r"\r$", "")).where("trim(value) <> ''")
    kind = F.get_json_object("value", "$.recordType")
    bad = lines.where(kind.isNull() | ~kind.isin("metadata", "example")).select("line").orderBy("line").take(1)
    if bad:
        raise ValueError(f"line {bad[0].line}: not a metadata or example record")
    metadata = lines.where(kind == "metadata").select("value").take(2)
    if len(metadata) != 1:
        raise ValueError(f"a corpus has one metadata record, not {len(metadata)}")
    rows = lines.where(kind == "example").select("line", F.from_json("value", EXAMPLE).alias("e")).select("line", "e.*")
    if rows.isEmpty():
        raise ValueError("a corpus has at least one example")
    df = rows.select("id", "language", F.col("lengthBucket").alias("length_bucket"), "text", F.col("goldSpans").alias("gold"), F.col("source.sourceFile").alias("source_file"), F.col("source.sourceRow").alias("source_row"), "line")
    odd = df.where(F.col("id").isNull() | F.col("text").isNull() | ~F.coalesce(F.col("language").isin("en", "de"), F.lit(False)) | ~F.coalesce(F.col("length_bucket").isin("short", "medium", "long"), F.lit(False)) | F.col("gold").isNull())
    if first := odd.orderBy("line").take(1):
        raise ValueError(f"line {first[0].line}: a field is missing or has a value that isn't allowed")
    if first := violations(df).orderBy("id").take(1):
        raise ValueError(f"example {first[0].id}: gold span with a wrong {first[0].problem}")
    return json.loads(metadata[0].value), df.drop("line")


def write_corpus(df: DataFrame, path: str, metadata: dict) -> None:
    """Examples after a metadata line, in stable order, then read again to be sure."""
    source = F.struct(F.col("source_file").alias("sourceFile"), F.col("source_row").alias("sourceRow"))
    rows = df.orderBy("language", "source_file", "source_row", "id").select(F.to_json(F.struct(F.lit("example").alias("recordType"), "id", "language", F.col("length_bucket").alias("lengthBucket"), "text", F.col("gold").alias("goldSpans"), source.alias("source"))).alias("value"))
    head = df.sparkSession.createDataFrame([(json.dumps({"recordType": "metadata"} | metadata, ensure_ascii=False),)], "value string")
    head.unionAll(rows).write.mode("overwrite").text(path)
    read_corpus(df.sparkSession, path)


def read_raw_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of a JSON file that is an array, or has them under data or records."""
    whole = spark.read.text(path, wholetext=True)
    records = f"array<struct<{_struct(RAW)}>>"
    inner = F.coalesce(F.get_json_object("value", "$.data"), F.get_json_object("value", "$.records"))
    parsed = F.from_json(F.when(F.col("value").rlike(r"^\s*\["), F.col("value")).otherwise(inner), records)
    rows = whole.select(F.input_file_name().alias("source_file"), F.posexplode(parsed).alias("n", "r")).select("source_file", (F.col("n") + 1).cast("bigint").alias("source_row"), "r.*")
    return rows.withColumn("privacy_mask", source_spans(F.col("privacy_mask"), F.col("span_labels"))).drop("span_labels")


def _struct(columns: str) -> str:
    return ",".join(f"{a}:{b}" for a, b in (c.strip().split(" ", 1) for c in _columns(columns)))


def _columns(columns: str) -> list[str]:
    out, depth, at = [], 0, 0
    for k, c in enumerate(columns + ","):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            out.append(columns[at:k])
            at = k + 1
    return out


def repaired(lines: Iterator[str], most: int = 50) -> Iterator[tuple[int, str, bool]]:
    """(first line, record, repaired): a record whose string is not ended takes the next physical lines, joined by an
    escaped line break, up to `most` lines."""
    held, first, n = "", 0, 0
    for number, line in enumerate(lines, 1):
        if not held and not line.strip():
            continue
        held, first, n = (held + "\\n" + line, first, n + 1) if held else (line, number, 1)
        try:
            json.loads(held)
        except json.JSONDecodeError as error:
            if n < most and ("Unterminated string" in error.msg or "Expecting" in error.msg and error.pos >= len(held.rstrip())):
                continue
            raise ValueError(f"line {first}: {error.msg}") from None
        yield first, held, n > 1
        held = ""
    if held:
        raise ValueError(f"line {first}: the record doesn't end")


def read_raw_jsonl(spark: SparkSession, path: str) -> DataFrame:
    """Raw records of JSON Lines files with repair; one task reads a file, as a broken record spans lines, and many files
    are read side by side."""

    def run(batches):
        for batch in batches:
            rows = [(p, f, r, x) for p, v in zip(batch["path"], batch["value"], strict=True) for f, r, x in repaired(iter(v.replace("\r\n", "\n").split("\n")))]
            yield pd.DataFrame(rows, columns=["source_file", "source_row", "record", "was_repaired"])

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    rows = whole.mapInPandas(run, "source_file string, source_row bigint, record string, was_repaired boolean")
    return parsed_records(rows)


def read_vault(spark: SparkSession, path: str) -> DataFrame:
    """Vault records of JSON Lines; rows with a missing or wrong field go."""
    df = spark.read.schema(VAULT).json(path)
    sound = F.col("entityType").isin(*C.ENTITY_TYPES) & F.col("replacementMode").isin("placeholder", "synthetic") & (F.col("usageCount") >= 0)
    return df.dropna(how="any").where(sound)


def write_json(df: DataFrame, path: str) -> None:
    """Reports and vaults, one JSON object a line."""
    df.write.mode("overwrite").json(path)


def save_state(df: DataFrame, path: str, by: str | None = None) -> None:
    """A state table (settings, entity maps by conversation, vault), replaced as a whole."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)
