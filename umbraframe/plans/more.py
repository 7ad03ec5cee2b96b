"""Further queries with their DuckDB forms beside them: sources, corpora, reviews, vault upkeep, composed recognition."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T
from umbraframe.operators import corpus, detect, host, ner, overlay, policy, score, vault
from umbraframe.plans import duck, inputs
from umbraframe.plans import oracles as O
from umbraframe.plans import queries as Q
from umbraframe.plans.duck import ENTITY_MAP, MENTIONS, VAULT
from umbraframe.plans.inputs import EXAMPLES, FEEDBACK, FOUND, GOLD, PROMPTS
from umbraframe.sources import jsonl
from umbraframe.sources.state import stored, work_folder
from umbraframe.streaming import flows

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


# Sources

_EXTERNAL = f"""
SELECT prompt_id, text, prompt_id % 7 - 1 AS s, prompt_id % 7 + 4 + prompt_id % 3 AS e, CASE prompt_id % 5 WHEN 0 THEN 'regex' ELSE 'ner' END AS src, CASE prompt_id % 4 WHEN 0 THEN '1.5' ELSE '0.' || cast(1 + prompt_id % 9 AS string) END AS sc,
  prompt_id % 11 = 0 AS broken FROM ({PROMPTS}) prompts
"""
_EXTERNAL_JSON = """CASE WHEN broken THEN '[{' ELSE '[{"start":' || cast(s AS string) || ',"end":' || cast(e AS string) || ',"entity_type":"PERSON","score":' || sc || ',"text":"old","source":"' || src || '"},{"start":0,"end":999999,"entity_type":"PERSON","score":0.5,"text":"","source":"ner"}]' END"""


@query(f"SELECT prompt_id, cast(s AS BIGINT) AS span_start, cast(e AS BIGINT) AS span_end, round(cast(sc AS DOUBLE), 6) AS score, substr(text, s + 1, e - s) AS span_text FROM ({_EXTERNAL}) x WHERE NOT broken AND s >= 0 AND src = 'ner' AND cast(sc AS DOUBLE) <= 1")
def external_spans(spark, sf_dir):
    """Spans from JSON: bad JSON, bad offsets, bad scores and other sources go; texts are read anew."""
    df = inputs.derived(spark, sf_dir, f"SELECT prompt_id, text, {_EXTERNAL_JSON} AS raw FROM ({_EXTERNAL}) x")
    rows = detect.rows_of(df, detect.valid_external(F.col("text"), jsonl.external_spans(F.col("raw"))), "prompt_id")
    return rows.select("prompt_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), F.round("s.score", 6).alias("score"), F.col("s.text").alias("span_text"))


# Raw corpus records of both kinds, with every name for a field, wrong offsets, unknown labels, other languages, empty texts.
_RAW = """
SELECT k, CASE k % 3 WHEN 0 THEN 'Ada Lovelace' WHEN 1 THEN 'Anna Müller' ELSE 'Zoë 😀 Stone' END AS person, CASE k % 2 WHEN 0 THEN 'Berlin' ELSE 'München' END AS city,
  CASE k % 8 WHEN 4 THEN 'fr' WHEN 0 THEN 'en-US' WHEN 1 THEN 'German' WHEN 2 THEN ' EN ' ELSE 'de' END AS language FROM (SELECT c_custkey AS k FROM customer) c
"""
_RAW_TEXT = "CASE WHEN k % 8 = 5 THEN '' ELSE 'Hi ' || person || ' of ' || city || '.' END"
_RAW_JSON = f"""SELECT k, '{{"id":"r' || cast(k AS string) || '","language":"' || language || '","source_text":"' || {_RAW_TEXT} || '",' || CASE k % 8
  WHEN 0 THEN '"privacy_mask":[{{"start":3,"end":' || cast(3 + length(person) AS string) || ',"label":"FIRST_NAME","value":"' || person || '"}},{{"start":' || cast(7 + length(person) AS string) || ',"end":' || cast(7 + length(person) + length(city) AS string) || ',"label":"city","value":"' || city || '"}}]'
  WHEN 1 THEN '"privacy_mask":[{{"start_offset":0,"end_offset":2,"entity_type":"FULL NAME","text":"' || person || '"}},{{"start":1,"end":2,"type":"no such label","value":"H"}}]'
  WHEN 2 THEN '"span_labels":[[3,' || cast(3 + length(person) AS string) || ',"GIVEN_NAME"]]'
  WHEN 3 THEN '"span_labels":[[0,1,"CITY","' || city || '"],[0,1,"O","x"]]'
  ELSE '"privacy_mask":[{{"start":3,"end":' || cast(3 + length(person) AS string) || ',"label":"","type":"LASTNAME","value":"","text":"' || person || '"}}]' END || '}}' AS record FROM ({_RAW}) x"""
_RAW_GOLD = f"""SELECT 'r' || cast(k AS VARCHAR) AS id, CASE WHEN k % 8 IN (0, 2) THEN 'en' ELSE 'de' END AS language, 'short' AS length_bucket, cast(s AS BIGINT) AS span_start, cast(s + strlen(v) AS BIGINT) AS span_end, entity_type, v AS span_text FROM (
  SELECT k, 3 AS s, person AS v, 'PERSON' AS entity_type FROM ({_RAW}) a WHERE k % 8 NOT IN (3, 4, 5) UNION ALL SELECT k, 7 + strlen(person), city, 'LOCATION' FROM ({_RAW}) b WHERE k % 8 IN (0, 3)) g"""


def _raw_gold(df: DataFrame) -> DataFrame:
    rows = detect.rows_of(corpus.examples(df), "gold", "id", "language", "length_bucket", name="g")
    return rows.select("id", "language", "length_bucket", F.col("g.start").alias("span_start"), F.col("g.end").alias("span_end"), "g.entity_type", F.col("g.text").alias("span_text"))


@query(_RAW_GOLD)
def raw_examples(spark, sf_dir):
    """Raw records of both kinds to gold spans in bytes."""
    df = inputs.derived(spark, sf_dir, _RAW_JSON).withColumns({"source_file": F.lit("f"), "source_row": F.col("k")})
    return _raw_gold(jsonl.parsed_records(df))


@query(_RAW_GOLD)
def raw_lines(spark, sf_dir):
    """The same records written as JSON Lines, some broken over two physical lines, and read with repair."""
    folder = work_folder(spark, "raw")
    broken = F.when(F.col("k") % 6 == 0, F.replace(F.col("record"), F.lit('"source_text":"Hi '), F.lit('"region":"x\ny","source_text":"Hi '))).otherwise(F.col("record"))
    inputs.derived(spark, sf_dir, _RAW_JSON).select(broken).write.text(folder)
    return _raw_gold(jsonl.read_raw_jsonl(spark, folder))


@query(f"SELECT k, k % 6 = 0 AND k % 8 <> 5 AS was_repaired FROM ({_RAW}) x")
def raw_repairs(spark, sf_dir):
    folder = work_folder(spark, "raw")
    broken = F.when(F.col("k") % 6 == 0, F.replace(F.col("record"), F.lit('"source_text":"Hi '), F.lit('"region":"x\ny","source_text":"Hi '))).otherwise(F.col("record"))
    inputs.derived(spark, sf_dir, _RAW_JSON).select(broken).write.text(folder)
    return jsonl.read_raw_jsonl(spark, folder).select(F.substring("id", 2, 20).cast("bigint").alias("k"), "was_repaired")


@query(_RAW_GOLD)
def raw_json(spark, sf_dir):
    """The same records as one JSON file that has them under "data"."""
    folder = work_folder(spark, "json")
    rows = inputs.derived(spark, sf_dir, _RAW_JSON).groupBy(F.pmod("k", F.lit(8)).alias("file")).agg(F.concat(F.lit('{"data":['), F.array_join(F.collect_list("record"), ","), F.lit("]}")).alias("value"))
    rows.write.partitionBy("file").text(folder)
    return _raw_gold(jsonl.read_raw_json(spark, folder))


@query(f"SELECT k, CASE WHEN k % 8 IN (0, 2) THEN 'en' WHEN k % 8 <> 4 THEN 'de' END AS code FROM ({_RAW}) x")
def language_codes(spark, sf_dir):
    return inputs.derived(spark, sf_dir, _RAW).select("k", T.language_code(F.col("language")).alias("code"))


def _corpus(spark, sf_dir) -> DataFrame:
    df = inputs.derived(spark, sf_dir, _RAW_JSON).withColumns({"source_file": F.concat(F.lit("f"), (F.col("k") % 3).cast("string")), "source_row": F.col("k")})
    return corpus.examples(jsonl.parsed_records(df))


@query(_RAW_GOLD)
def corpus_file(spark, sf_dir):
    """Examples written after a metadata line in stable order, validated and read again."""
    folder = work_folder(spark, "corpus")
    jsonl.write_corpus(_corpus(spark, sf_dir), folder, {"corpusId": "c", "schemaVersion": 1})
    metadata, df = jsonl.read_corpus(spark, folder)
    rows = detect.rows_of(df.where(F.lit(metadata["corpusId"]) == "c"), "gold", "id", "language", "length_bucket", name="g")
    return rows.select("id", "language", "length_bucket", F.col("g.start").alias("span_start"), F.col("g.end").alias("span_end"), "g.entity_type", F.col("g.text").alias("span_text"))


_KEPT_RAW = f"(SELECT 'r' || cast(k AS VARCHAR) AS id, CASE WHEN k % 8 IN (0, 2) THEN 'en' ELSE 'de' END AS language, 'f' || cast(k % 3 AS VARCHAR) AS source_file, k AS source_row FROM ({_RAW}) x WHERE k % 8 NOT IN (4, 5))"


@query(f"SELECT id, row_number() OVER (ORDER BY language, source_file, source_row, id) AS n FROM {_KEPT_RAW} x")
def corpus_order(spark, sf_dir):
    """Examples with their places in the corpus's stable order, numbered by ranges."""
    df = _corpus(spark, sf_dir).select("id", F.struct("language", "source_file", "source_row", "id").alias("place"))
    return vault.numbered(df, [], "place").select("id", "n")


@query(f"SELECT id FROM {_KEPT_RAW} x ORDER BY source_row, id LIMIT 500")
def first_examples(spark, sf_dir):
    return corpus.first_sample(_corpus(spark, sf_dir), 500).select("id")


_FAULTY = f"""SELECT prompt_id AS id, text, prompt_id % 9 AS kind FROM ({PROMPTS}) prompts"""


@query(f"SELECT id, CASE kind WHEN 1 THEN 'entity type' WHEN 2 THEN 'range' WHEN 3 THEN 'range' WHEN 4 THEN 'character boundary' WHEN 5 THEN 'text' END AS problem FROM ({_FAULTY}) f WHERE kind IN (1, 2, 3, 5) OR kind = 4 AND id % 3 = 2")
def corpus_violations(spark, sf_dir):
    """Gold spans with a fault of each kind. "Anna Müller" has its ü at bytes 24 and 25."""
    kind = F.col("kind")
    start = F.when(kind == 2, -1).when(kind == 4, 25).otherwise(0).cast("bigint")
    end = F.when(kind == 3, 100_000).when(kind == 4, 27).otherwise(5).cast("bigint")
    text = F.when(kind == 5, "wrong").when(kind == 4, T.byte_slice(F.col("text"), F.lit(25), F.lit(27))).otherwise(T.byte_slice(F.col("text"), F.lit(0), F.lit(5)))
    gold = F.struct(start.alias("start"), end.alias("end"), F.when(kind == 1, "NO_TYPE").otherwise("PERSON").alias("entity_type"), text.alias("text"))
    return corpus.violations(inputs.derived(spark, sf_dir, _FAULTY).withColumn("gold", F.array(gold)))


# Vault upkeep


@query(f"SELECT key, arg_max(original_text, first_seq) AS original FROM (SELECT placeholder AS key, original_text, first_seq FROM ({VAULT}) a UNION ALL SELECT synthetic_value, original_text, first_seq FROM ({VAULT}) b WHERE synthetic_value <> '') x GROUP BY key")
def reverse_index(spark, sf_dir):
    return vault.reverse_index(vault.vault(Q._mentions(spark, sf_dir)))


_PATCHED = f"""SELECT *, CASE WHEN first_seq % 11 = 0 THEN '' ELSE synthetic_value END AS value, first_seq % 7 = 0 AS pin FROM ({VAULT}) v"""


def _patched(spark, sf_dir) -> DataFrame:
    records = stored(vault.vault(Q._mentions(spark, sf_dir)))
    nothing = F.lit(None).cast("string")
    patch = records.select("placeholder", F.when(F.col("first_seq") % 11 == 0, "").otherwise(nothing).alias("synthetic_value"), F.when(F.col("first_seq") % 5 == 0, "synthetic").otherwise(nothing).alias("replacement_mode"), (F.col("first_seq") % 7 == 0).alias("pinned"))
    return vault.updated(records, patch)


@query(f"SELECT placeholder, value AS synthetic_value, CASE WHEN first_seq % 5 = 0 AND value <> '' THEN 'synthetic' ELSE 'placeholder' END AS replacement_mode, pin AS pinned FROM ({_PATCHED}) p")
def vault_update(spark, sf_dir):
    return _patched(spark, sf_dir).select("placeholder", "synthetic_value", "replacement_mode", "pinned")


@query(f"SELECT placeholder FROM ({_PATCHED}) p WHERE pin AND usage_count > 1")
def vault_cleared(spark, sf_dir):
    """What is left when unpinned records are cleared, and those that were used once are deleted."""
    records = stored(_patched(spark, sf_dir))
    return vault.deleted(vault.without_unpinned(records), records.where("usage_count = 1")).select("placeholder")


@query(f"SELECT entity_type, max(n) AS used FROM (SELECT entity_type, cast(regexp_extract(placeholder, '_(\\d+)\\]', 1) AS BIGINT) AS n FROM ({VAULT}) v UNION ALL SELECT 'PERSON', 7 UNION ALL SELECT 'ADDRESS', 3) x GROUP BY entity_type")
def vault_counters(spark, sf_dir):
    """The counters of two vaults, the larger of each type."""
    given = spark.createDataFrame([("PERSON", 7), ("ADDRESS", 3)], "entity_type string, used bigint")
    return vault.merged_counters(vault.counters(vault.vault(Q._mentions(spark, sf_dir))), given)


@query(f"SELECT placeholder, normalized_key, usage_count FROM ({VAULT}) v")
def vault_file(spark, sf_dir):
    """The vault written as JSON Lines and read again; a line that isn't sound is dropped."""
    folder, records = work_folder(spark, "vault"), vault.vault(Q._mentions(spark, sf_dir))
    long = lambda c: F.col(c).cast("bigint")
    rows = records.select(
        F.concat("entity_type", F.lit("|"), "normalized_key").alias("id"), F.col("original_text").alias("originalText"), F.col("normalized_key").alias("normalizedKey"), F.col("entity_type").alias("entityType"), "placeholder",
        F.col("synthetic_value").alias("syntheticValue"), F.col("replacement_mode").alias("replacementMode"), "pinned", long("first_seq").alias("createdAt"), long("last_seq").alias("updatedAt"), long("last_seq").alias("lastSeenAt"), long("usage_count").alias("usageCount"),
    )
    bad = rows.limit(1).withColumn("entityType", F.lit("NO_TYPE")).unionByName(rows.limit(1).withColumn("usageCount", F.lit(-1).cast("bigint")))
    jsonl.write_json(rows.unionByName(bad), folder)
    return jsonl.read_vault(spark, folder).select("placeholder", F.col("normalizedKey").alias("normalized_key"), F.col("usageCount").alias("usage_count"))


_STATED = f"SELECT conv_id, placeholder AS key, original FROM ({ENTITY_MAP}) e"


@query(f"SELECT conv_id, key, CASE WHEN conv_id % 2 = 0 THEN upper(original) ELSE original END AS original FROM ({_STATED}) x UNION ALL SELECT DISTINCT conv_id, '[NEW_1]', 'new' FROM ({_STATED}) y WHERE conv_id % 2 = 0")
def merged_maps(spark, sf_dir):
    """A stored map of each conversation, merged with a newer one: new rows win, nothing is deleted."""
    folder, old = work_folder(spark, "maps"), vault.entity_map(Q._mentions(spark, sf_dir)).select("conv_id", F.col("placeholder").alias("key"), "original")
    jsonl.save_state(old, folder, "conv_id")
    old = spark.read.parquet(folder).select(F.col("conv_id").cast("bigint").alias("conv_id"), "key", "original")
    even = old.where("conv_id % 2 = 0")
    new = even.withColumn("original", F.upper("original")).unionByName(even.select("conv_id", F.lit("[NEW_1]").alias("key"), F.lit("new").alias("original")).distinct())
    return vault.merged_maps(old, new)


@query(f"SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN '[X' || substr(key, 2) ELSE key END AS key, original FROM ({_STATED}) x")
def external_map(spark, sf_dir):
    """Replacements that a vault decided, some of them replaced later on: the earlier key is forgotten."""
    rows = vault.entity_map(Q._mentions(spark, sf_dir)).select("conv_id", F.col("placeholder").alias("replacement"), "original")
    events = rows.withColumn("seq", F.lit(1)).unionByName(rows.where("conv_id % 3 = 0").withColumn("replacement", F.concat(F.lit("[X"), F.substring("replacement", 2, 100))).withColumn("seq", F.lit(2)))
    return vault.external_map(events)


_EARLIER = f"SELECT entity_type, normalized_key, synthetic_value, placeholder, cast(regexp_extract(placeholder, '_(\\d+)\\]', 1) AS BIGINT) AS n FROM ({VAULT.replace(f'FROM ({MENTIONS}) m', f'FROM ({MENTIONS}) m WHERE conv_id < 20')}) v"
_LATER = f"(SELECT *, {duck.KEY} AS normalized_key FROM ({MENTIONS}) m WHERE conv_id >= 20)"


@query(f"""WITH later AS {_LATER}, old AS ({_EARLIER}), used AS (SELECT entity_type, max(n) AS used FROM old GROUP BY entity_type),
  new AS (SELECT prompt_id, entity_type, normalized_key, row_number() OVER (PARTITION BY prompt_id, entity_type ORDER BY min(seq)) AS k FROM later l WHERE NOT EXISTS (SELECT 1 FROM old o WHERE o.entity_type = l.entity_type AND o.normalized_key = l.normalized_key) GROUP BY prompt_id, entity_type, normalized_key)
  SELECT l.prompt_id, l.s AS span_start, coalesce(CASE WHEN o.synthetic_value <> '' THEN o.synthetic_value ELSE o.placeholder END, {duck.synthetic('l.entity_type', '(k + coalesce(used, 0) - 1)')}, '[' || l.entity_type || '_' || cast(k + coalesce(used, 0) AS VARCHAR) || ']') AS replacement
  FROM later l LEFT JOIN old o USING (entity_type, normalized_key) LEFT JOIN new n ON n.prompt_id = l.prompt_id AND n.entity_type = l.entity_type AND n.normalized_key = l.normalized_key LEFT JOIN used u ON u.entity_type = l.entity_type""")
def vault_preview(spark, sf_dir):
    """Later prompts as they would go out under the vault of earlier ones, which stays as it is."""
    mentions = Q._mentions(spark, sf_dir)
    records = stored(vault.vault(mentions.where("conv_id < 20"), mode="synthetic"))
    return vault.preview(mentions.where("conv_id >= 20"), records, "prompt_id", "synthetic").select("prompt_id", F.col("start").alias("span_start"), "replacement")


@query(f"SELECT conv_id, placeholder, original FROM ({ENTITY_MAP}) e")
def entity_map_resumed(spark, sf_dir):
    """Maps made in two goes: the second goes on behind the numbers that the first one stored."""
    mentions = Q._mentions(spark, sf_dir)
    early = vault.entity_map(mentions.where(F.col("prompt_id") <= 700)).select("conv_id", "placeholder", "original")
    return vault.entity_map(mentions, stored(early)).select("conv_id", "placeholder", "original")


@query("SELECT * FROM (VALUES " + ", ".join(f"('{t}', {vault.pool_size(t)})" for t in C.ENTITY_TYPES) + ") t(entity_type, n)")
def pool_sizes(spark, sf_dir):
    """How many different synthetic values each type has before they come again, counted from the values themselves."""
    rows = spark.createDataFrame([(t,) for t in C.ENTITY_TYPES], "entity_type string").select("entity_type", F.explode(F.sequence(F.lit(0), F.lit(71))).alias("i"))
    base = F.regexp_replace(F.regexp_replace(vault.synthetic(F.col("entity_type"), F.col("i")), r"\.\d+@", "@"), r"[- ]\d$", "")
    pools = spark.createDataFrame([(t, len(p)) for t, p in C.POOLS.items()] + [("EMAIL", 72)], "entity_type string, known int")
    return rows.withColumn("v", base).groupBy("entity_type").agg(F.count_distinct("v").alias("d")).join(pools, "entity_type", "left").select("entity_type", F.coalesce(F.when(F.col("entity_type") == "EMAIL", 72).otherwise(F.col("known")), F.lit(0)).cast("int").alias("n"))


# Reviews

_NAMED_SPANS = f"SELECT prompt_id, s, e, entity_type, score, source, text AS t, cs, ce FROM ({MENTIONS}) m"


@query(f"SELECT prompt_id, s AS span_start, CASE WHEN n = 0 THEN 'MISC' ELSE entity_type END AS entity_type FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY s) - 1 AS n FROM ({_NAMED_SPANS}) a) x")
def retyped_spans(spark, sf_dir):
    """The first span of each prompt gets another type."""
    df = Q._with_ner(spark, sf_dir).withColumn("spans", overlay.retyped(F.col("spans"), F.create_map(F.lit(0), F.lit("MISC"))))
    return detect.rows_of(df, "spans", "prompt_id").select("prompt_id", F.col("s.start").alias("span_start"), "s.entity_type")


_AROUND = "substr(p.text, greatest(x.cs - 20, 0) + 1, least(x.ce + 20, length(p.text)) - greatest(x.cs - 20, 0))"


@query(f"SELECT x.prompt_id, x.t AS text, x.entity_type AS detected_type, 'NOT_PII' AS corrected_type, {_AROUND} AS context FROM ({_NAMED_SPANS}) x JOIN ({PROMPTS}) p USING (prompt_id) WHERE strpos(p.text, x.t) = x.cs + 1 UNION ALL SELECT prompt_id, 'Hello', NULL, 'MISC', substr(text, 1, 25) FROM ({PROMPTS}) p")
def feedback_emitted(spark, sf_dir):
    """Feedback for dismissing every span (those at their text's first place) and adding one by hand."""
    df = Q._with_ner(spark, sf_dir)
    action = lambda kind, text, t: F.struct(F.lit(kind).alias("kind"), text.alias("text"), t.alias("entity_type"), F.lit(None).cast("string").alias("new_type"))
    first = F.filter("spans", lambda s: T.byte_offset(F.col("text"), F.instr(F.col("text"), s["text"]) - 1) == s["start"])
    actions = F.concat(F.transform(first, lambda s: action("dismiss", s["text"], s["entity_type"])), F.array(action("add", F.lit("Hello"), F.lit("MISC"))))
    return overlay.feedback_rows(df.withColumn("actions", actions), "prompt_id", "text", "actions")


@query(f"SELECT prompt_id, count(*) FILTER (WHERE entity_type <> 'EMAIL') AS enabled, count(*) AS total FROM ({_NAMED_SPANS}) x GROUP BY prompt_id")
def enabled_counts(spark, sf_dir):
    return overlay.counted(Q._with_ner(spark, sf_dir), F.transform("spans", lambda s: s["entity_type"] != "EMAIL"), "prompt_id")


@query(f"SELECT prompt_id, s AS span_start, entity_type FROM ({_NAMED_SPANS}) x WHERE entity_type <> 'EMAIL' UNION ALL SELECT prompt_id, cast(strlen(substr(text, 1, strpos(text, 'born') - 1)) AS BIGINT), 'DATE' FROM ({PROMPTS}) p")
def approved_spans(spark, sf_dir):
    """What a reviewer sends on: the spans that are on, and one marked by hand."""
    df = Q._with_ner(spark, sf_dir)
    manual = F.array(overlay.manual_span(F.col("text"), F.lit("born"), F.lit("DATE")))
    rows = detect.rows_of(df, overlay.approved(F.col("spans"), lambda s: s["entity_type"] != "EMAIL", manual), "prompt_id")
    return rows.select("prompt_id", F.col("s.start").alias("span_start"), "s.entity_type")


@query(f"SELECT prompt_id, s AS span_start, entity_type FROM ({_NAMED_SPANS}) x JOIN ({O._TYPE_ROWS}) t USING (entity_type) WHERE g NOT IN ({', '.join(repr(x) for x in C.GROUPS_OFF) or "''"}) AND lower(x.t) <> 'david smith' AND NOT regexp_full_match(lower(x.t), 'user1\\w+@example\\.com') AND NOT regexp_full_match(x.t, '10\\.0\\.7\\.\\w+') AND score >= t.b")
def popup_review(spark, sf_dir):
    df = Q._with_ner(spark, sf_dir)
    rows = detect.rows_of(df, policy.popup_review(F.col("text"), F.col("spans"), 0.5, allow=Q.ALLOW), "prompt_id")
    return rows.select("prompt_id", F.col("s.start").alias("span_start"), "s.entity_type")


@query(f"SELECT count(*) AS confirmed, cast({len(Q.ALLOW)} AS BIGINT) AS ignored, cast(0 AS BIGINT) AS pending FROM ({FEEDBACK}) f")
def feedback_counts(spark, sf_dir):
    return policy.feedback_counts(inputs.derived(spark, sf_dir, FEEDBACK), Q.ALLOW)


@query("""SELECT conv_id, turn, text || chr(10) || 'a' || chr(10) || role AS response, length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) >= 10 AS analysed FROM conversations WHERE text IS NOT NULL""")
def responses(spark, sf_dir):
    """Visible text and form values of a reply, and whether a paste of it would be analysed (ten UTF-16 units or more)."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("text is not null")
    return df.select("conv_id", "turn", overlay.response_text(F.col("text"), F.array(F.lit("a"), F.col("role"))).alias("response"), T.long_enough(F.col("text")).alias("analysed"))


@query("SELECT page_id, coalesce(starts_with(url, 'https://a') OR starts_with(url, 'http://') OR starts_with(url, 'https://www.'), false) AS supported FROM pages")
def supported_pages(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return df.select("page_id", F.coalesce(host.supported(F.col("url"), ["https://a", "http://", "https://www."]), F.lit(False)).alias("supported"))


_FOUND_AT = "strpos(text, 'Email') - 1"


@query(f"""SELECT prompt_id, substr(text, greatest({_FOUND_AT} - 20, 0) + 1, least({_FOUND_AT} + 25, length(text)) - greatest({_FOUND_AT} - 20, 0)) AS around,
  CASE WHEN {_FOUND_AT} > 48 THEN '...' ELSE '' END || substr(text, greatest({_FOUND_AT} - 48, 0) + 1, least({_FOUND_AT} + 53, length(text)) - greatest({_FOUND_AT} - 48, 0)) || CASE WHEN {_FOUND_AT} + 53 < length(text) THEN '...' ELSE '' END AS compact FROM ({PROMPTS}) p""")
def contexts(spark, sf_dir):
    df, found = inputs.prompts(spark, sf_dir), F.lit("Email")
    return df.select("prompt_id", T.context_around(F.col("text"), found, 20).alias("around"), T.compact_context(F.col("text"), found, 48).alias("compact"))


# Recognition

_HITS = "SELECT doc_id, start_byte, text, strpos(lower(text), 'apache license') - 1 AS pos FROM (WITH RECURSIVE" + O.ORACLES["ner_chunks"].split("WITH RECURSIVE", 1)[1].replace("md5(substr(text, a + 1, b - a)) AS text", "substr(text, a + 1, b - a) AS text") + ") chunks"


@query(rf"""SELECT DISTINCT doc_id, cast(start_byte + strlen(substr(text, 1, pos)) - strlen(regexp_extract(substr(text, 1, pos), '[\p{{L}}\p{{N}}_-]*$')) AS BIGINT) AS span_start,
  cast(start_byte + strlen(substr(text, 1, pos + 14)) + strlen(regexp_extract(substr(text, pos + 15), '^[\p{{L}}\p{{N}}_-]*')) AS BIGINT) AS span_end, 'ORGANIZATION' AS entity_type FROM ({_HITS}) h WHERE pos >= 0""")
def ner_composed(spark, sf_dir):
    """Documents of any length through chunks, a model that knows one name, the chunks' places, overlaps and the gate. The first
    of the two models can't be loaded."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").where("text is not null")

    def infer(chunks: DataFrame) -> DataFrame:
        item = F.struct(F.lit("apache license").alias("word"), F.lit(0.95).alias("score"), F.lit("ORGANIZATION").alias("entity_type"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
        return chunks.withColumn("items", F.array(item))

    def missing(chunks: DataFrame) -> DataFrame:
        raise FileNotFoundError("no such model")

    rows = detect.rows_of(ner.provided(df, "doc_id", "transformers", {"bardsai": missing, "ai4privacy": infer}), "external", "doc_id")
    return rows.select("doc_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.entity_type")


@query(f"SELECT 'fixture' AS mode, count(*) AS n FROM ({duck.raw_spans(duck.PROMPT_ROWS, True, [])}) r UNION ALL SELECT 'off', 0 UNION ALL SELECT 'transformers', 0")
def ner_modes(spark, sf_dir):
    """Spans by provider: none, the dictionary, and none if every model fails."""
    def fails(chunks: DataFrame) -> DataFrame:
        raise OSError("not loaded")

    out = None
    for mode in ("off", "fixture", "transformers"):
        one = ner.provided(inputs.prompts(spark, sf_dir), "prompt_id", mode, {"ai4privacy": fails}).agg(F.lit(mode).alias("mode"), F.sum(F.size("external")).cast("bigint").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out.select("mode", "n")


@query(f"SELECT f.order_id, f.span_start, f.span_end, f.entity_type, g.raw_label FROM ({O.ORACLES['ner_overlap_merge']}) f LEFT JOIN (SELECT order_id, s, e, entity_type, arg_max(raw_label, item) AS raw_label FROM {O._NAMED} r GROUP BY ALL) g ON g.order_id = f.order_id AND g.s = f.span_start AND g.e = f.span_end AND g.entity_type = f.entity_type")
def raw_labels(spark, sf_dir):
    """Merged named-entity spans with the labels that their inputs had."""
    given = ner.mapped(Q._items(spark, sf_dir), F.col("model_name"), F.col("raw_label")).select("order_id", F.col("s").cast("bigint").alias("start"), F.col("e").cast("bigint").alias("end"), "entity_type", "raw_label", "item")
    final = Q.ner_overlap_merge(spark, sf_dir).withColumnsRenamed({"span_start": "start", "span_end": "end"}).drop("score")
    return ner.with_raw_label(final, given, "order_id").withColumnsRenamed({"start": "span_start", "end": "span_end"})


# Reports


@query(f"""SELECT x.example_id, x.language, x.length_bucket, coalesce(g.n, 0) AS n_gold, coalesce(f.n, 0) AS n_found, coalesce(tp, 0) AS n_matches, coalesce(fn, 0) AS n_missed, coalesce(fp, 0) AS n_wrong FROM ({EXAMPLES}) x
  LEFT JOIN (SELECT example_id, count(*) AS n FROM ({GOLD}) a GROUP BY example_id) g USING (example_id) LEFT JOIN (SELECT example_id, count(*) AS n FROM ({FOUND}) b GROUP BY example_id) f USING (example_id)
  LEFT JOIN (SELECT example_id, count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fn') AS fn, count(*) FILTER (WHERE outcome = 'fp') AS fp FROM {O._OUTCOMES} o GROUP BY example_id) s USING (example_id)""")
def example_report(spark, sf_dir):
    """The report's part for each example: gold, detections, matches, what was missed, what was wrong."""
    gold, found, examples, pairs = Q._scored(spark, sf_dir)
    out = score.by_example(examples, gold, found, score.matches(pairs))
    n = lambda c: F.size(c).cast("bigint")
    return out.select("example_id", "language", "length_bucket", n("gold").alias("n_gold"), n("found").alias("n_found"), n("matches").alias("n_matches"), n("missed").alias("n_missed"), n("wrong").alias("n_wrong"))


@query(f"SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM ({O.ORACLES['score_by_lang']}) s")
def report_file(spark, sf_dir):
    """A report's metrics written as JSON and read again."""
    folder = work_folder(spark, "report")
    jsonl.write_json(Q.score_by_lang(spark, sf_dir), folder)
    return spark.read.json(folder).agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn")])


# Streams, as tables


@query("""SELECT user_id, last(event_id ORDER BY ts, event_id) AS event_id, max(epoch_us(ts)) AS seen FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, g""")
def quiet_texts(spark, sf_dir):
    """The last event of each burst without a pause of an hour."""
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"), "event_id")
    quiet = flows.quiet_texts(df, "user_id", text="event_id", gap="1 hour", order=F.struct("ts", "event_id"))
    return quiet.select("user_id", "event_id", F.unix_micros("ts").alias("seen"))
