"""One query for each operator or group of operators. Each runs over whole tables; offsets are UTF-8 bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from umbraframe.functions import constants as C
from umbraframe.functions import text as T
from umbraframe.operators import anonymize, corpus, detect, host, ner, overlay, policy, score, vault
from umbraframe.plans import inputs
from umbraframe.sources.state import stored
from umbraframe.streaming import flows

ALLOW, BLOCK = ["david smith", "user1*@example.com", "10.0.7.*"], [("berlin", "LOCATION"), ("acme *", "any"), ("hello", "any")]


def _flat(df: DataFrame, *keep: str, spans: str = "spans") -> DataFrame:
    """Spans as rows; scores rounded, as the engines print doubles differently."""
    rows = detect.rows_of(df, spans, *keep)
    return rows.select(*keep, F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.entity_type", F.round("s.score", 6).alias("score"), F.col("s.text").alias("span_text"), "s.source")


def _recogniser(kind: str):
    def query(spark, sf_dir):
        df = inputs.texts(spark, sf_dir)
        return _flat(df.withColumn("spans", detect.recognised(F.col("text"), [kind])), "text_id").drop("source")

    return query


def _checked(kind: str):
    def query(spark, sf_dir):
        rows = _flat(inputs.texts(spark, sf_dir).withColumn("spans", detect.recognised(F.col("text"), [kind])), "text_id")
        return rows.select("text_id", "span_start", "span_text", detect.checksum_valid(F.col("entity_type"), F.col("span_text")).alias("valid"))

    return query


def context_boost(spark, sf_dir):
    df = inputs.texts(spark, sf_dir)
    return _flat(df.withColumn("spans", detect.boosted(F.col("text"), detect.checked(detect.recognised(F.col("text"))))), "text_id")


def context_tokens(spark, sf_dir):
    df = inputs.texts(spark, sf_dir).withColumn("spans", detect.checked(detect.recognised(F.col("text"))))
    rows = detect.rows_of(df, "spans", "text_id", "text")
    words = lambda f: F.array_join(F.transform(f(F.col("text"), F.col("s"), 6), lambda w: F.lower(w)), " ")  # noqa: E731, nearest first
    return rows.select("text_id", F.col("s.start").alias("span_start"), F.col("s.entity_type").alias("entity_type"), words(detect.words_before).alias("before"), words(detect.words_after).alias("after"))


def merge_spans(spark, sf_dir):
    df = inputs.texts(spark, sf_dir)
    spans = detect.merged(detect.boosted(F.col("text"), detect.checked(detect.recognised(F.col("text")))))
    return _flat(df.withColumn("spans", spans), "text_id")


def detect_pipeline(spark, sf_dir):
    return _flat(detect.detect(inputs.texts(spark, sf_dir)), "text_id")


def detect_documents(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return _flat(detect.detect(df), "doc_id")


def detect_by_type(spark, sf_dir):
    return detect_pipeline(spark, sf_dir).groupBy("entity_type").agg(F.count(F.lit(1)).alias("n_spans"), F.count_distinct("text_id").alias("n_texts"))


def detect_by_lang(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    return detect.exploded(detect.detect(df), "lang").groupBy("lang", "entity_type").agg(F.count(F.lit(1)).alias("n_spans"))


def spans_by_source(spark, sf_dir):
    return _mentions(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n_spans"))


def _with_ner(spark, sf_dir) -> DataFrame:
    df = inputs.prompts(spark, sf_dir).withColumn("external", ner.dictionary_spans(F.col("text")))
    return detect.detect(df, external="external").drop("external")


def _mentions(spark, sf_dir) -> DataFrame:
    rows = detect.exploded(_with_ner(spark, sf_dir), "conv_id", "prompt_id")
    return stored(rows.withColumn("seq", F.col("prompt_id") * inputs.MOST_BYTES + F.col("start")))


def ner_dictionary(spark, sf_dir):
    return _flat(inputs.prompts(spark, sf_dir).withColumn("spans", ner.dictionary_spans(F.col("text"))), "prompt_id")


def detect_with_ner(spark, sf_dir):
    return _flat(_with_ner(spark, sf_dir), "prompt_id")


def _items(spark, sf_dir) -> DataFrame:
    """Model output by arithmetic: labels of all spellings, some of which no taxonomy has."""
    return inputs.derived(spark, sf_dir, _ITEMS)


_ITEMS = """
SELECT l_orderkey AS order_id, l_linenumber AS item, CASE l_partkey % 3 WHEN 0 THEN 'ai4privacy' WHEN 1 THEN 'bardsai' ELSE 'hikmaai' END AS model_name,
  CASE l_suppkey % 8 WHEN 0 THEN 'B-GIVENNAME' WHEN 1 THEN 'I-FIRSTNAME' WHEN 2 THEN 'personName' WHEN 3 THEN 'email address' WHEN 4 THEN 'EMAIL' WHEN 5 THEN 'CITY' WHEN 6 THEN 'passport' ELSE 'O' END AS raw_label,
  l_linenumber * 6 + l_partkey % 4 AS s, l_linenumber * 6 + 5 + l_suppkey % 4 AS e, (l_partkey % 50 + 50) / 100.0 AS sc FROM lineitem
"""


def ner_label_map(spark, sf_dir):
    items = _items(spark, sf_dir)
    return ner.mapped(items, F.col("model_name"), F.col("raw_label")).groupBy("model", "label", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def ner_threshold(spark, sf_dir):
    rows = ner.mapped(_items(spark, sf_dir), F.col("model_name"), F.col("raw_label"))
    return rows.where(F.col("sc").cast("double") >= ner.gate(F.col("model"), F.col("entity_type"))).groupBy("model", "entity_type").agg(F.count(F.lit(1)).alias("n"))


def ner_overlap_merge(spark, sf_dir):
    rows = ner.mapped(_items(spark, sf_dir), F.col("model_name"), F.col("raw_label"))
    one = detect.span(F.col("s").cast("bigint"), F.col("e").cast("bigint"), F.col("entity_type"), F.col("sc"), F.lit(""), F.lit("ner"))
    grouped = rows.groupBy("order_id").agg(F.collect_list(one).alias("spans"))
    return _flat(grouped.withColumn("spans", ner.best_of_overlaps(F.col("spans"))), "order_id").select("order_id", "span_start", "span_end", "entity_type", "score")


def ner_stitch(spark, sf_dir):
    """First and last names as fragments of one person."""
    df = inputs.prompts(spark, sf_dir)
    pieces = lambda v, k, x: F.transform(T.located(F.col("text"), T.quoted(v)), lambda m: detect.span(m["start"], m["end"], F.lit(k), F.lit(x), m["text"], F.lit("ner")))
    spans = F.concat(pieces("Ada", "PERSON", 0.7), pieces("Love", "PERSON", 0.9), pieces("David", "PERSON", 0.8), pieces("Smith", "PERSON", 0.6))
    return _flat(df.withColumn("spans", ner.expanded(F.col("text"), ner.stitched(F.col("text"), spans))), "prompt_id")


def ner_chunks(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return ner.chunks(df, "doc_id").withColumn("text", F.md5("text"))


def ner_model_output(spark, sf_dir):
    """Items without offsets, found from a moving cursor, to spans."""
    df = inputs.prompts(spark, sf_dir)
    item = lambda w, s, t: F.struct(F.lit(w).alias("word"), F.lit(s).alias("score"), F.lit(t).alias("entity_type"), F.lit(None).cast("int").alias("start"), F.lit(None).cast("int").alias("end"))
    items = F.array(item("ada", 0.9, "PERSON"), item("##lovelace", 0.8, "PERSON"), item("david smith", 0.95, "PERSON"), item("user @ example . com", 0.9, "EMAIL"), item("example", 0.85, "EMAIL"), item("acme corp", 0.6, "ORGANIZATION"))
    return _flat(df.withColumn("spans", ner.model_spans(F.col("text"), items)), "prompt_id")


def group_filter(spark, sf_dir):
    return _flat(_with_ner(spark, sf_dir).withColumn("spans", policy.in_enabled_group(F.col("spans"), {"Contact": False})), "prompt_id")


def resolve_threshold(spark, sf_dir):
    types = policy.group_table(spark).select("entity_type")
    rows = types.select("entity_type", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("k")).withColumn("slider", F.col("k") / 10)
    one = lambda **m: F.round(policy.threshold(F.col("entity_type"), F.col("slider"), **m), 6)
    return rows.select("entity_type", F.col("k").cast("bigint").alias("k"), one().alias("threshold"), one(mode="individual", overrides={"Contact": 0.9, "Low-signal": 0.0}).alias("individual"))


def min_threshold(spark, sf_dir):
    types = policy.group_table(spark)
    return types.agg(F.round(F.min(policy.threshold(F.col("entity_type"), 0.5)), 6).alias("min_threshold"))


def adaptive_threshold(spark, sf_dir):
    return policy.adaptive_thresholds(inputs.derived(spark, sf_dir, inputs.FEEDBACK), 0.5).withColumn("threshold", F.round("threshold", 6))


def allowlist(spark, sf_dir):
    df = _with_ner(spark, sf_dir)
    return _flat(df.withColumn("spans", policy.without_allowed(F.col("text"), F.col("spans"), ALLOW)), "prompt_id")


def blocklist(spark, sf_dir):
    df = _with_ner(spark, sf_dir)
    return _flat(df.withColumn("spans", policy.with_blocked(F.col("text"), F.col("spans"), BLOCK)), "prompt_id")


def _fenced(spark, sf_dir) -> DataFrame:
    return inputs.derived(spark, sf_dir, _FENCED)


_FENCED = """
SELECT c_custkey AS text_id, CASE c_custkey % 4
  WHEN 0 THEN 'Größe ' || cast(c_custkey AS string) || chr(10) || '```py' || chr(10) || 'mail a' || cast(c_custkey AS string) || '@b.com' || chr(10) || '```' || chr(10) || 'call 212-555-' || lpad(cast(c_custkey % 10000 AS string), 4, '0')
  WHEN 1 THEN 'see <code class=x>10.0.0.' || cast(c_custkey % 200 AS string) || '</code> and 10.0.0.' || cast(c_custkey % 200 AS string)
  WHEN 2 THEN 'open' || chr(10) || '````' || chr(10) || 'x' || chr(10) || '```' || chr(10) || 'y@z.org'
  ELSE 'plain `a@b.com` text' END AS text FROM customer
"""


def code_regions(spark, sf_dir):
    df = detect.rows_of(_fenced(spark, sf_dir), policy.code_regions(F.col("text")), "text_id", name="r")
    return df.select("text_id", F.col("r.start").alias("region_start"), F.col("r.end").alias("region_end"))


def review_spans(spark, sf_dir):
    df = detect.detect(_fenced(spark, sf_dir))
    spans = policy.review(F.col("text"), F.col("spans"), 0.5, allow=["y@z.org"], block=[("see", "any")])
    rows = detect.rows_of(df, spans, "text_id")
    return rows.select("text_id", F.col("s.start").alias("span_start"), F.col("s.end").alias("span_end"), "s.entity_type", F.round("s.score", 6).alias("score"), "s.source", "s.in_code")


def list_conflicts(spark, sf_dir):
    words = inputs.derived(spark, sf_dir, "SELECT c_custkey AS k, c_mktsegment AS pattern FROM customer")
    allow = words.where("k % 2 = 0").select(F.concat(F.lit("  "), "pattern").alias("pattern")).distinct()
    block = words.where("k % 3 = 0").select(F.lower("pattern").alias("pattern")).distinct()
    return policy.list_conflicts(allow, block)


def entity_map(spark, sf_dir):
    return vault.entity_map(_mentions(spark, sf_dir)).select("conv_id", "placeholder", "original")


def anonymize_map(spark, sf_dir):
    return _anonymized(spark, sf_dir).select("prompt_id", "anonymized")


def _anonymized(spark, sf_dir, mentions: DataFrame | None = None) -> DataFrame:
    mentions = _mentions(spark, sf_dir) if mentions is None else mentions
    tokens = mentions.join(vault.entity_map(mentions).withColumnRenamed("original", "text").select("conv_id", "text", "placeholder"), ["conv_id", "text"])
    return anonymize.anonymized(inputs.prompts(spark, sf_dir), tokens.select("prompt_id", "start", "end", F.col("placeholder").alias("token")), "prompt_id")


def vault_records(spark, sf_dir):
    return vault.vault(_mentions(spark, sf_dir)).drop("pinned", "replacement_mode")


def synthetic_values(spark, sf_dir):
    rows = spark.createDataFrame([(t,) for t in C.ENTITY_TYPES], "entity_type string").select("entity_type", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    return rows.select("entity_type", F.col("i").cast("bigint").alias("i"), vault.synthetic(F.col("entity_type"), F.col("i")).alias("value"))


def _under_vault(spark, sf_dir, mentions: DataFrame, records: DataFrame) -> DataFrame:
    tokens = records.select("entity_type", "normalized_key", vault.active_replacement(F.col("placeholder"), F.col("synthetic_value"), F.col("replacement_mode")).alias("token"))
    used = mentions.withColumn("normalized_key", T.normal_key(F.col("text"))).join(tokens, ["entity_type", "normalized_key"])
    return anonymize.anonymized(inputs.prompts(spark, sf_dir), used.select("prompt_id", "start", "end", "token"), "prompt_id").select("prompt_id", "anonymized")


def anonymize_vault(spark, sf_dir):
    mentions = _mentions(spark, sf_dir)
    return _under_vault(spark, sf_dir, mentions, vault.vault(mentions, mode="synthetic"))


def vault_import(spark, sf_dir):
    mentions = _mentions(spark, sf_dir)
    old, new = vault.vault(mentions.where("conv_id < 20")), vault.vault(mentions.where("conv_id >= 10")).withColumn("line", F.col("first_seq"))
    return vault.imported(old, new).select("entity_type", "normalized_key", "placeholder", "usage_count")


def vault_recency(spark, sf_dir):
    return vault.by_recency(vault.vault(_mentions(spark, sf_dir))).select("placeholder", "last_seq", "usage_count")


def preview_numbers(spark, sf_dir):
    rows = _mentions(spark, sf_dir).withColumnRenamed("prompt_id", "doc_id")
    return vault.preview_numbers(rows).select("doc_id", F.col("start").alias("span_start"), "placeholder")


def augment_map(spark, sf_dir):
    """Conversations that know a record by its placeholder learn its synthetic value, and the other way round."""
    mentions = _mentions(spark, sf_dir)
    records = stored(vault.vault(mentions))
    key = T.normal_key(F.col("text"))
    used = mentions.withColumn("normalized_key", key).join(records, ["entity_type", "normalized_key"])
    known = used.select("conv_id", F.when(F.col("conv_id") % 2 == 0, F.col("placeholder")).otherwise(F.when(F.col("synthetic_value") != "", F.col("synthetic_value")).otherwise(F.col("placeholder"))).alias("key"), F.col("original_text").alias("original")).distinct()
    return vault.augmented(known, records)


def _restorable(spark, sf_dir) -> DataFrame:
    """Anonymised prompts with the part of their conversation's map that they need."""
    mentions = _mentions(spark, sf_dir)
    rows = vault.entity_map(mentions).withColumnRenamed("placeholder", "key")
    return anonymize.with_needed(_anonymized(spark, sf_dir, mentions), "prompt_id", "conv_id", F.col("anonymized"), rows)


def restore_canonical(spark, sf_dir):
    """Anonymised prompts back to what they were, by each conversation's map."""
    return _restorable(spark, sf_dir).select("prompt_id", anonymize.restored_canonical(F.col("anonymized"), F.col("originals")).alias("restored"))


def _replies(spark, sf_dir) -> DataFrame:
    """A reply to every prompt, which names placeholders in many forms, with the part of its conversation's map that it needs."""
    df = inputs.derived(spark, sf_dir, inputs.REPLIES)
    rows = vault.entity_map(_mentions(spark, sf_dir)).withColumnRenamed("placeholder", "key")
    return anonymize.with_needed(df, "prompt_id", "conv_id", F.col("reply"), rows)


def restore_variants(spark, sf_dir):
    return _replies(spark, sf_dir).select("prompt_id", anonymize.restored(F.col("reply"), F.col("originals")).alias("restored"))


def resolve_text(spark, sf_dir):
    df = _replies(spark, sf_dir).select("prompt_id", anonymize.resolved(F.col("reply"), F.col("originals")).alias("r"))
    return df.select("prompt_id", F.col("r.text").alias("restored"), F.size("r.matches").cast("bigint").alias("n_matches"))


def restore_vault(spark, sf_dir):
    """Prompts as they went out under the vault (synthetic values, and placeholders where a type has none), restored."""
    mentions = _mentions(spark, sf_dir)
    records = stored(vault.vault(mentions, mode="synthetic"))
    df = anonymize.with_vault(_under_vault(spark, sf_dir, mentions, records), "prompt_id", F.col("anonymized"), records)
    text, maps = F.col("anonymized"), (F.col("placeholders"), F.col("synthetics"))
    return df.select("prompt_id", anonymize.restored_with_vault(text, *maps).alias("restored"), anonymize.has_reversible(text, F.map_concat(*maps)).alias("reversible"))


def round_trip(spark, sf_dir):
    """All three steps on every prompt: detect, anonymise, restore in any form."""
    df = _restorable(spark, sf_dir)
    return df.select("prompt_id", anonymize.restored(F.col("anonymized"), F.col("originals")).alias("restored"), anonymize.has_placeholder(F.col("anonymized")).alias("had_placeholder"))


def _scored(spark, sf_dir):
    gold, found = (inputs.spans_of(inputs.derived(spark, sf_dir, q)) for q in (inputs.GOLD, inputs.FOUND))
    examples = inputs.derived(spark, sf_dir, inputs.EXAMPLES)
    pairs = score.candidates(gold, found)
    return gold, found, examples, pairs


def score_candidates(spark, sf_dir):
    *_, pairs = _scored(spark, sf_dir)
    return pairs.select("example_id", "gold_index", "found_index", F.col("overlap_bytes").cast("bigint").alias("overlap_bytes"), F.round("gold_coverage", 6).alias("gold_coverage"), F.round("found_coverage", 6).alias("found_coverage"), F.col("drift").cast("bigint").alias("drift"))


def score_matches(spark, sf_dir):
    *_, pairs = _scored(spark, sf_dir)
    return score.matches(pairs).select("example_id", "gold_index", "found_index", "type_correct")


def _rows(spark, sf_dir):
    gold, found, examples, pairs = _scored(spark, sf_dir)
    return score.with_bucket(score.outcomes(gold, found, score.matches(pairs)), examples, gold), examples, gold


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def score_headline(spark, sf_dir):
    return _rounded(score.headline(_rows(spark, sf_dir)[0]))


def score_by_type(spark, sf_dir):
    return _rounded(score.by_type(_rows(spark, sf_dir)[0]))


def score_by_lang(spark, sf_dir):
    return _rounded(score.metrics(_rows(spark, sf_dir)[0].where("kind = 'headline'"), "language", "length_bucket"))


def score_misc(spark, sf_dir):
    return _rounded(score.metrics(_rows(spark, sf_dir)[0].where("kind = 'misc'")))


def score_negative(spark, sf_dir):
    return _rounded(score.negatives(*_rows(spark, sf_dir)))


def score_samples(spark, sf_dir):
    return score.samples(_rows(spark, sf_dir)[0].select("example_id", "entity_type", "language", "outcome"), "fn")


def length_bucket(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").select(T.length_bucket(F.col("text")).alias("length_bucket"))
    return df.groupBy("length_bucket").agg(F.count(F.lit(1)).alias("n"))


def corpus_summary(spark, sf_dir):
    gold = inputs.spans_of(inputs.derived(spark, sf_dir, inputs.GOLD)).groupBy("example_id").agg(F.collect_list(F.struct("entity_type")).alias("gold"))
    df = inputs.derived(spark, sf_dir, inputs.EXAMPLES).join(gold, "example_id", "left").withColumn("gold", F.coalesce("gold", F.expr("cast(array() as array<struct<entity_type:string>>)")))
    return corpus.summary(df)


_SAMPLE_TYPES = ["EMAIL", "PHONE", "PERSON", "DATE", "SSN", "LOCATION", "MISC"]


def _sampled(spark, sf_dir) -> DataFrame:
    df = inputs.derived(spark, sf_dir, inputs.SAMPLED)
    kinds = F.array(*map(F.lit, _SAMPLE_TYPES))
    types = F.filter(F.array(F.get(kinds, F.col("t1").cast("int")), F.get(kinds, F.col("t3").cast("int"))), lambda t: t.isNotNull())
    return df.withColumn("types", F.when(F.col("t2") == 0, F.expr("cast(array() as array<string>)")).otherwise(types))


def coverage_sample(spark, sf_dir):
    return corpus.coverage_sample(_sampled(spark, sf_dir), 500)


def latency_percentiles(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("value")
    return _rounded(score.latency(df, "value"))


def activity_sessions(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = flows.activity(df, "user_id", gap=flows.IDLE)
    return out.select("user_id", F.unix_micros("begins").alias("begins"), F.unix_micros("ends").alias("ends"), "n_events")


def dedupe_window(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at"), F.col("event_type").alias("text"))
    return flows.without_repeats_batch(df, "user_id", 3_600_000)


def feedback_last_n(spark, sf_dir):
    return flows.last_rows(inputs.derived(spark, sf_dir, inputs.FEEDBACK), "event_id").select("event_id", "detected_type", "corrected_type")


def cancelled_results(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type")
    results, cancels = df.where("event_id % 3 <> 0"), df.where("event_id % 3 = 0")
    return flows.not_cancelled(results, cancels, "user_id", keep="6 hours").select("event_id", "user_id")


def text_offsets(spark, sf_dir):
    """Offsets of each document's middle, there and back."""
    df = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", F.floor(F.length("text") / 2).cast("bigint").alias("cp"))
    at = T.byte_offset(F.col("text"), F.col("cp"))
    return df.select("doc_id", "cp", at.alias("byte_at"), T.code_point_index(F.col("text"), at).alias("back"), F.md5(T.byte_slice(F.col("text"), at, T.byte_length(F.col("text")))).alias("rest"))


def anonymized_replies(spark, sf_dir):
    """Assistant turns by whether they may hold a placeholder, and digests of their normal keys."""
    df = spark.read.parquet(f"{sf_dir}/conversations.parquet").where("role = 'assistant' and length(text) >= 10")
    return df.select("conv_id", "turn", anonymize.may_have_placeholder(F.col("text")).alias("gate"), F.md5(T.normal_key(F.col("text"))).alias("key"), T.truncated(T.escape_html(F.col("text")), 30).alias("shown"))


_HOSTS = """
SELECT c_custkey AS host_id, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE cast(c_custkey % 7 AS double) END AS gb, CASE c_custkey % 3 WHEN 0 THEN 'off' ELSE 'transformers' END AS provider,
  CASE c_custkey % 5 WHEN 0 THEN 'enabled' WHEN 1 THEN 'off-low-memory-auto' WHEN 2 THEN 'off-user-choice' WHEN 3 THEN 'off-load-failure' ELSE 'enabled' END AS state,
  CASE c_custkey % 4 WHEN 0 THEN 'unavailable' ELSE 'available' END AS gpu, CASE c_custkey % 2 WHEN 0 THEN 'pending' ELSE 'seen' END AS modal, c_custkey % 11 = 0 AS on_cpu FROM customer
"""


def host_rules(spark, sf_dir):
    df = inputs.derived(spark, sf_dir, _HOSTS).withColumn("tier", host.memory_tier(F.col("gb")))
    c = F.col
    df = df.withColumn("s", host.resource_summary(c("provider"), c("state"), c("tier"), c("on_cpu"), c("gb")))
    return df.select(
        "host_id", "tier", host.recommendation(c("tier")).alias("recommendation"), host.may_warm_up(c("provider"), c("state"), c("tier"), c("gpu"), c("on_cpu")).alias("warm_up"),
        host.chip_reason(c("state"), c("tier"), c("modal"), c("on_cpu")).alias("chip"), c("s.tone").alias("tone"), c("s.title").alias("title"), c("s.detail").alias("detail"),
    )


def highlighted_html(spark, sf_dir):
    df = detect.detect(_fenced(spark, sf_dir))
    spans = policy.tagged_in_code(F.col("spans"), policy.code_regions(F.col("text")))
    df = df.select("text_id", "text", spans.alias("spans"))
    return df.select("text_id", overlay.highlighted(F.col("text"), F.col("spans"), lambda s: policy.overlay_enabled(s, 0.5)).alias("html"))


def manual_spans(spark, sf_dir):
    df = inputs.prompts(spark, sf_dir).select("prompt_id", overlay.manual_span(F.col("text"), F.lit("München"), F.lit("LOCATION")).alias("m")).where("m is not null")
    return df.select("prompt_id", F.col("m.start").alias("span_start"), F.col("m.end").alias("span_end"), "m.entity_type")


QUERIES = {f"detect_{k.lower()}": _recogniser(k) for k in ("EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS", "IBAN", "DATE")}
QUERIES |= {"luhn_cards": _checked("CREDIT_CARD"), "iban_valid": _checked("IBAN"), "ssn_valid": _checked("SSN")}
QUERIES |= {
    f.__name__: f
    for f in (
        context_tokens, context_boost, merge_spans, detect_pipeline, detect_documents, detect_by_type, detect_by_lang, spans_by_source, ner_dictionary, detect_with_ner,
        ner_label_map, ner_threshold, ner_overlap_merge, ner_stitch, ner_chunks, ner_model_output, group_filter, resolve_threshold, min_threshold, adaptive_threshold,
        allowlist, blocklist, code_regions, review_spans, list_conflicts, entity_map, anonymize_map, vault_records, synthetic_values, anonymize_vault, vault_import,
        vault_recency, preview_numbers, augment_map, restore_canonical, restore_variants, resolve_text, restore_vault, round_trip, score_candidates, score_matches,
        score_headline, score_by_type, score_by_lang, score_misc, score_negative, score_samples, length_bucket, corpus_summary, coverage_sample, latency_percentiles,
        activity_sessions, dedupe_window, feedback_last_n, cancelled_results, text_offsets, anonymized_replies, host_rules, highlighted_html, manual_spans,
    )
}
