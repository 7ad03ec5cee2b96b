"""Inputs that both engines derive from the given tables by the same SQL."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Prompts with all kinds of identifiers, valid and not, non-ASCII names and an emoji.
PROMPTS = """
SELECT c_custkey AS prompt_id, c_custkey % 50 AS conv_id,
  'Hello, my name is ' || CASE c_custkey % 3 WHEN 0 THEN 'Ada Lovelace' WHEN 1 THEN 'David Smith' ELSE 'Anna Müller' END
  || ' from ' || CASE c_custkey % 2 WHEN 0 THEN 'Berlin' ELSE 'München' END || CASE WHEN c_custkey % 11 = 0 THEN ' 😀' ELSE '' END
  || '. Email: user' || cast(c_custkey % 400 AS string) || '@example.com, phone +49 30 ' || lpad(cast(c_custkey % 97 AS string), 8, '5')
  || ', ssn ' || lpad(cast(c_custkey % 1000 AS string), 3, '0') || '-' || lpad(cast(c_custkey % 100 AS string), 2, '0') || '-' || lpad(cast(c_custkey % 10000 AS string), 4, '0')
  || '; card ' || CASE c_custkey % 4 WHEN 0 THEN '4111 1111 1111 1111' WHEN 1 THEN '5555-5555-5555-4444' WHEN 2 THEN '6011111111111117' ELSE '4111 1111 1111 1112' END
  || '; iban ' || CASE c_custkey % 5 WHEN 0 THEN 'DE89370400440532013000' WHEN 1 THEN 'GB82 WEST 1234 5698 7654 32' WHEN 2 THEN 'DE89370400440532013001' ELSE 'FR1420041010050500013M02606' END
  || ' at ' || CASE c_custkey % 4 WHEN 0 THEN 'Acme Corp' WHEN 1 THEN 'Beispiel GmbH' ELSE 'home' END
  || ', born 12/0' || cast(1 + c_custkey % 9 AS string) || '/1985, host 10.0.' || cast(c_custkey % 256 AS string) || '.7' AS text
FROM customer
"""

#: A text has fewer bytes, so prompt * MOST_BYTES + offset orders and tells apart all places in all prompts.
MOST_BYTES = 1 << 31

#: Replies that name placeholders canonically, mangled, inside other words, and such as nobody knows.
REPLIES = """
SELECT c_custkey AS prompt_id, c_custkey % 50 AS conv_id, CASE c_custkey % 4
  WHEN 0 THEN 'Dear person_1 and PERSON 2: [email_1], [PERSON_1, PERSON_2] or PERSON1; not GMAILEMAIL_1, PERSON_1A, [PERSON_99] nor PERSON_01. IBAN1 ok'
  WHEN 1 THEN 'Hi PERSON_' || cast(1 + c_custkey % 3 AS string) || ', see [EMAIL ' || cast(1 + c_custkey % 5 AS string) || '] (email_' || cast(1 + c_custkey % 5 AS string) || ')!'
  WHEN 2 THEN 'No [PERSON' || cast(1 + c_custkey % 3 AS string) || ' ] xPERSON_' || cast(1 + c_custkey % 3 AS string) || ' PERSON_' || cast(1 + c_custkey % 3 AS string) || '00 here; é iban_1.'
  ELSE 'nothing to restore, ' || cast(c_custkey AS string) END AS reply
FROM customer
"""

TEXTS = f"SELECT doc_id AS text_id, text FROM documents UNION ALL SELECT -1 - prompt_id AS text_id, text FROM ({PROMPTS}) prompts"

_LINES = "(SELECT l_orderkey, l_linenumber, min(l_partkey) AS l_partkey, min(l_suppkey) AS l_suppkey FROM lineitem GROUP BY l_orderkey, l_linenumber) lines"
#: Gold spans, detections and examples for scoring; every tenth example has no gold. Some gold spans lie one byte beside another,
#: so detections and gold spans compete for each other.
GOLD = f"""
SELECT l_orderkey AS example_id, l_linenumber AS gold_index, l_linenumber * 50 AS s, l_linenumber * 50 + 6 + l_partkey % 20 AS e,
  CASE l_suppkey % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'PERSON' WHEN 3 THEN 'DATE' ELSE CASE WHEN l_orderkey % 17 = 0 THEN 'MISC' ELSE 'SSN' END END AS entity_type
FROM {_LINES} WHERE l_orderkey % 10 <> 0
UNION ALL
SELECT l_orderkey, 200 + l_linenumber, l_linenumber * 50 + 1, l_linenumber * 50 + 7 + l_partkey % 20, 'PHONE' FROM {_LINES} WHERE l_orderkey % 10 <> 0 AND l_partkey % 5 = 0
"""
FOUND = f"""
SELECT l_orderkey AS example_id, l_linenumber AS found_index, l_linenumber * 50 + l_partkey % 4 AS s, l_linenumber * 50 + 5 + l_partkey % 20 + l_suppkey % 3 AS e,
  CASE l_suppkey % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' WHEN 2 THEN CASE WHEN l_partkey % 3 = 0 THEN 'LOCATION' ELSE 'PERSON' END WHEN 3 THEN 'DATE' ELSE 'SSN' END AS entity_type
FROM {_LINES} WHERE l_suppkey % 7 <> 0 AND (l_orderkey % 10 <> 0 OR l_orderkey % 20 = 0)
UNION ALL
SELECT l_orderkey, 100 + l_linenumber, l_linenumber * 50 + 1, l_linenumber * 50 + 6 + l_partkey % 20, 'MISC' FROM {_LINES} WHERE l_partkey % 6 = 0
"""
EXAMPLES = """
SELECT o_orderkey AS example_id, CASE o_orderkey % 2 WHEN 0 THEN 'en' ELSE 'de' END AS language, CASE o_custkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS length_bucket FROM orders
"""
#: Feedback: dismissed, added and retyped detections.
FEEDBACK = """
SELECT event_id, CASE WHEN user_id % 3 = 0 THEN NULL ELSE CASE user_id % 5 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PHONE' WHEN 2 THEN 'PERSON' ELSE 'DATE' END END AS detected_type,
  CASE WHEN event_id % 4 < 2 THEN 'NOT_PII' ELSE CASE event_id % 3 WHEN 0 THEN 'EMAIL' WHEN 1 THEN 'PERSON' ELSE 'SSN' END END AS corrected_type FROM events
"""
#: Examples for sampling: their distinct types by arithmetic.
SAMPLED = """
SELECT o_orderkey AS id, o_orderkey AS place, CASE o_orderkey % 2 WHEN 0 THEN 'en' ELSE 'de' END AS language, CASE o_custkey % 3 WHEN 0 THEN 'short' WHEN 1 THEN 'medium' ELSE 'long' END AS length_bucket,
  o_custkey % 9 AS t1, o_orderkey % 7 AS t2, o_custkey % 13 AS t3 FROM orders
"""


def derived(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """What the SQL makes of tables of the data folder. They have names of their own while it is read, so that no view of the
    session is touched."""
    own, used = uuid.uuid4().hex, set(re.findall(r"FROM (\w+)", sql))
    for name in used:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(f"{name}_{own}")
    try:
        return spark.sql(re.sub(r"FROM (\w+)", rf"FROM \1_{own}", sql))
    finally:
        for name in used:
            spark.catalog.dropTempView(f"{name}_{own}")


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts come from a table of short rows: a few megabytes that all cores should share before detection."""
    return derived(spark, sf_dir, PROMPTS).repartition(spark.sparkContext.defaultParallelism)


def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id as text_id", "text")
    return documents.unionByName(prompts(spark, sf_dir).selectExpr("-1 - prompt_id as text_id", "text"))


def spans_of(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({"s": "start", "e": "end"})
