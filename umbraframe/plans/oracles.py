"""The queries as DuckDB SQL, by the queries' names."""

from __future__ import annotations

from umbraframe.functions import constants as C
from umbraframe.plans import duck
from umbraframe.plans import queries as Q
from umbraframe.plans.duck import MENTIONS, PROMPT_ROWS, TEXT_ROWS
from umbraframe.plans.inputs import EXAMPLES, FEEDBACK, FOUND, GOLD, PROMPTS, REPLIES

_SPAN = "s AS span_start, e AS span_end, entity_type, round(cast(score AS DOUBLE), 6) AS score, t AS span_text"
DOCUMENT_ROWS = "(SELECT doc_id AS id, text FROM documents)"


def _recogniser(kind: str) -> str:
    return f"SELECT id AS text_id, {_SPAN} FROM ({duck.raw_spans(TEXT_ROWS, types=[kind])}) r"


def _checked(kind: str) -> str:
    return f"SELECT id AS text_id, s AS span_start, t AS span_text, {duck.CHECK} AS valid FROM ({duck.raw_spans(TEXT_ROWS, types=[kind])}) r"



ORACLES = {f"detect_{k.lower()}": _recogniser(k) for k in ("EMAIL", "PHONE", "SSN", "CREDIT_CARD", "IP_ADDRESS", "IBAN", "DATE")}
ORACLES |= {"luhn_cards": _checked("CREDIT_CARD"), "iban_valid": _checked("IBAN"), "ssn_valid": _checked("SSN")}

ORACLES["context_tokens"] = f"""SELECT id AS text_id, s AS span_start, entity_type, coalesce(array_to_string(list_transform(list_reverse(b[greatest(1, len(b) - 5):]), lambda w: lower(w)), ' '), '') AS before,
  coalesce(array_to_string(list_transform(a[1:6], lambda w: lower(w)), ' '), '') AS after FROM (
  SELECT *, regexp_extract_all({duck._HEAD}, '{duck.TOKEN}+') AS b, regexp_extract_all({duck._TAIL}, '{duck.TOKEN}+') AS a FROM ({duck.raw_spans(TEXT_ROWS)}) r WHERE {duck.CHECK}) w"""
ORACLES["context_boost"] = f"SELECT id AS text_id, {_SPAN}, source FROM ({duck.boosted(TEXT_ROWS)}) r"
ORACLES["merge_spans"] = f"SELECT id AS text_id, {_SPAN}, source FROM ({duck.merged(TEXT_ROWS)}) r"
ORACLES["detect_pipeline"] = f"SELECT id AS text_id, {_SPAN}, source FROM ({duck.detected(TEXT_ROWS)}) r"
ORACLES["detect_documents"] = f"SELECT id AS doc_id, {_SPAN}, source FROM ({duck.detected(DOCUMENT_ROWS)}) r"
ORACLES["detect_by_type"] = f"SELECT entity_type, count(*) AS n_spans, count(DISTINCT id) AS n_texts FROM ({duck.detected(TEXT_ROWS)}) r GROUP BY entity_type"
ORACLES["detect_by_lang"] = f"SELECT d.lang, r.entity_type, count(*) AS n_spans FROM ({duck.detected(DOCUMENT_ROWS)}) r JOIN documents d ON d.doc_id = r.id GROUP BY ALL"
ORACLES["spans_by_source"] = f"SELECT source, count(*) AS n_spans FROM ({MENTIONS}) m GROUP BY source"

_NER = f"SELECT prompt_id, s AS span_start, e AS span_end, entity_type, round(score, 6) AS score, text AS span_text, source FROM ({MENTIONS}) m"
ORACLES["ner_dictionary"] = f"SELECT id AS prompt_id, {_SPAN}, source FROM ({duck.raw_spans(PROMPT_ROWS, True, [])}) r"
ORACLES["detect_with_ner"] = _NER

_LABELS = ", ".join(f"('{m}', '{label}', '{t}')" for m, types in C.NER_LABELS.items() for t, labels in types.items() for label in labels)
_NAMED = f"""(SELECT i.*, l.label, l.entity_type, l.model FROM (SELECT *, upper(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(raw_label, '^[BbIi]-', ''), '[\\[\\]<>{{}}()]', '', 'g'),
  '([a-z0-9])([A-Z])', '\\1_\\2', 'g'), '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS name FROM ({Q._ITEMS}) x) i JOIN (VALUES {_LABELS}) l(model, label, entity_type) ON l.model = i.model_name AND l.label = i.name)"""
ORACLES["ner_label_map"] = f"SELECT model, label, entity_type, count(*) AS n FROM {_NAMED} r GROUP BY ALL"
_GATE = f"CASE WHEN entity_type = 'MISC' THEN {duck.case('model', C.NER_GATE_MISC)} ELSE {duck.case('entity_type', C.NER_MINIMUM)} END"
ORACLES["ner_threshold"] = f"SELECT model, entity_type, count(*) AS n FROM {_NAMED} r WHERE cast(sc AS DOUBLE) >= cast({_GATE} AS DOUBLE) GROUP BY model, entity_type"
_LAST = "acc[len(acc)]"
ORACLES["ner_overlap_merge"] = f"""SELECT order_id, k.s AS span_start, k.e AS span_end, entity_type, round(k.score, 6) AS score FROM (SELECT order_id, entity_type, unnest(list_reduce(l, lambda acc, x:
  CASE WHEN {_LAST}.s < x[1].e AND x[1].s < {_LAST}.e THEN CASE WHEN x[1].score > {_LAST}.score OR (x[1].score = {_LAST}.score AND (x[1].e - x[1].s > {_LAST}.e - {_LAST}.s OR (x[1].e - x[1].s = {_LAST}.e - {_LAST}.s AND x[1].s < {_LAST}.s)))
    THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END ELSE list_concat(acc, x) END)) AS k FROM (
  SELECT order_id, entity_type, list([struct_pack(s := cast(s AS BIGINT), e := cast(e AS BIGINT), score := cast(sc AS DOUBLE))] ORDER BY s, e, sc) AS l FROM {_NAMED} r GROUP BY order_id, entity_type) g) u"""
ORACLES["ner_stitch"] = f"""SELECT prompt_id, cast(18 AS BIGINT) AS span_start, cast(18 + length(name) AS BIGINT) AS span_end, 'PERSON' AS entity_type, cast(CASE name WHEN 'Ada Lovelace' THEN 0.9 ELSE 0.8 END AS DOUBLE) AS score, name AS span_text, 'ner' AS source
  FROM (SELECT prompt_id, CASE prompt_id % 3 WHEN 0 THEN 'Ada Lovelace' WHEN 1 THEN 'David Smith' END AS name FROM ({PROMPTS}) p) q WHERE name IS NOT NULL"""
# The e-mail address stands with a number in it, so that item isn't found; the others are found one behind the other.
ORACLES["ner_model_output"] = f"""SELECT prompt_id, cast(strlen(substr(text, 1, strpos(text, v) - 1)) AS BIGINT) AS span_start, cast(strlen(substr(text, 1, strpos(text, v) - 1)) + strlen(v) AS BIGINT) AS span_end, entity_type, cast(score AS DOUBLE) AS score, v AS span_text, 'ner' AS source
  FROM ({PROMPTS}) p, (VALUES ('Ada Lovelace', 'PERSON', 0.9), ('David Smith', 'PERSON', 0.95), ('example', 'EMAIL', 0.85), ('Acme Corp', 'ORGANIZATION', 0.6)) i(v, entity_type, score) WHERE strpos(text, v) > 0"""
ORACLES["ner_chunks"] = r"""WITH RECURSIVE c AS (
  SELECT doc_id, text, length(text) AS n, 0 AS chunk, 0 AS a, CASE WHEN length(text) <= 5000 THEN length(text) ELSE coalesce(nullif(5000 - length(regexp_extract(substr(text, 3001, 2000), '[^\s]*$')), 3000), 5000) END AS b FROM documents WHERE text <> ''
  UNION ALL
  SELECT doc_id, text, n, chunk + 1, na, CASE WHEN na + 5000 >= n THEN n ELSE coalesce(nullif(na + 5000 - length(regexp_extract(substr(text, na + 3001, 2000), '[^\s]*$')), na + 3000), na + 5000) END
  FROM (SELECT *, greatest(a + 1, b - 256) AS na FROM c WHERE b < n) x)
SELECT doc_id, chunk, cast(a AS BIGINT) AS start_char, cast(b AS BIGINT) AS end_char, cast(strlen(substr(text, 1, a)) AS BIGINT) AS start_byte, cast(strlen(substr(text, 1, b)) AS BIGINT) AS end_byte, md5(substr(text, a + 1, b - a)) AS text FROM c"""

_GROUP = duck.case("entity_type", {t: g for g, types in C.GROUPS.items() for t in types})
ORACLES["group_filter"] = f"SELECT * FROM ({_NER}) r WHERE {_GROUP} NOT IN ('Contact', 'Low-signal')"
_BASE, _DELTA = (duck.case("entity_type", {t: v[k] for t, v in C.CATEGORY_THRESHOLDS.items()}) for k in (0, 1))
_TYPES = ", ".join(f"('{t}')" for t in C.ENTITY_TYPES)
_THR = "round(least(1.0, b + d) - {p} * (least(1.0, b + d) - greatest(0.0, b - d)), 6)"
_TYPE_ROWS = f"SELECT entity_type, cast({_BASE} AS DOUBLE) AS b, cast({_DELTA} AS DOUBLE) AS d, {_GROUP} AS g FROM (VALUES {_TYPES}) t(entity_type)"
ORACLES["resolve_threshold"] = f"""SELECT entity_type, k, {_THR.format(p='(k / 10.0)')} AS threshold, {_THR.format(p="(CASE g WHEN 'Contact' THEN 0.9 WHEN 'Low-signal' THEN 0.0 ELSE k / 10.0 END)")} AS individual
  FROM ({_TYPE_ROWS}) t, unnest(range(0, 11)) u(k)"""
ORACLES["min_threshold"] = f"SELECT min({_THR.format(p='0.5')}) AS min_threshold FROM ({_TYPE_ROWS}) t"
ORACLES["adaptive_threshold"] = f"""SELECT entity_type, round(greatest(0.1, least(0.99, 0.5 + (sum(dismissed) / count(*) - 0.5) * 0.4)), 6) AS threshold FROM (
  SELECT CASE WHEN detected_type IS NOT NULL AND corrected_type = 'NOT_PII' THEN detected_type WHEN detected_type IS NULL AND corrected_type <> 'NOT_PII' THEN corrected_type END AS entity_type,
  CASE WHEN detected_type IS NOT NULL THEN 1.0 ELSE 0.0 END AS dismissed FROM ({FEEDBACK}) f) x WHERE entity_type IS NOT NULL GROUP BY entity_type"""

ORACLES["allowlist"] = f"SELECT * FROM ({_NER}) r WHERE NOT (lower(span_text) = 'david smith' OR regexp_full_match(lower(span_text), 'user1\\w+@example\\.com') OR regexp_full_match(span_text, '10\\.0\\.7\\.\\w+'))"
_BLOCKED = " UNION ALL ".join(
    f"SELECT prompt_id, cast(strlen(substr(text, 1, pos)) AS BIGINT) AS s, cast(strlen(substr(text, 1, pos)) + strlen(w) AS BIGINT) AS e, '{kind}' AS entity_type, w FROM (SELECT prompt_id, text, strpos(text, w) - 1 AS pos, w FROM (SELECT prompt_id, text, {word} AS w FROM ({PROMPTS}) p) q WHERE w <> '' AND strpos(text, w) > 0) x"
    for word, kind in (("'Berlin'", "LOCATION"), ("regexp_extract(text, 'Acme \\w+')", "MISC"), ("'Hello'", "MISC"))
)
ORACLES["blocklist"] = f"""SELECT * FROM ({_NER}) r UNION ALL SELECT prompt_id, s AS span_start, e AS span_end, entity_type, 1.0 AS score, w AS span_text, 'manual' AS source FROM ({_BLOCKED}) b
  WHERE NOT EXISTS (SELECT 1 FROM ({_NER}) r WHERE r.prompt_id = b.prompt_id AND r.span_start = b.s AND r.span_end = b.e)"""
_FENCED_ROWS = f"(SELECT text_id AS id, text FROM ({Q._FENCED}) f)"
_REGIONS = f"""SELECT text_id, strlen(substr(text, 1, strpos(text, '```') - 1)) AS region_start, CASE WHEN text_id % 4 = 0 THEN strlen(substr(text, 1, strpos(text, 'com' || chr(10) || '```') + 6)) ELSE strlen(text) END AS region_end FROM ({Q._FENCED}) f WHERE text_id % 4 IN (0, 2)
  UNION ALL SELECT text_id, strpos(text, '<code') - 1, strpos(text, '</code>') + 6 FROM ({Q._FENCED}) f WHERE text_id % 4 = 1"""
ORACLES["code_regions"] = f"SELECT text_id, cast(region_start AS BIGINT) AS region_start, cast(region_end AS BIGINT) AS region_end FROM ({_REGIONS}) r"
ORACLES["review_spans"] = f"""SELECT r.*, coalesce(g.region_start <= r.span_start AND r.span_start < g.region_end, false) AS in_code FROM (
  SELECT id AS text_id, s AS span_start, e AS span_end, entity_type, round(score, 6) AS score, source FROM ({duck.detected(_FENCED_ROWS)}) d JOIN ({_TYPE_ROWS}) t USING (entity_type)
  WHERE entity_type <> 'DATE' AND lower(d.t) <> 'y@z.org' AND score >= t.b
  UNION ALL SELECT text_id, 0, 3, 'MISC', 1.0, 'manual' FROM ({Q._FENCED}) f WHERE text_id % 4 = 1) r LEFT JOIN ({_REGIONS}) g USING (text_id)"""
ORACLES["list_conflicts"] = """SELECT DISTINCT lower(c_mktsegment) AS key, '  ' || c_mktsegment AS allow_pattern, lower(c_mktsegment) AS block_pattern FROM customer
  WHERE c_custkey % 2 = 0 AND c_mktsegment IN (SELECT c_mktsegment FROM customer WHERE c_custkey % 3 = 0)"""

ORACLES["entity_map"] = f"SELECT conv_id, placeholder, original FROM ({duck.ENTITY_MAP}) e"
ORACLES["anonymize_map"] = f"SELECT prompt_id, anonymized FROM ({duck.anonymized(duck.MAP_TOKENS)}) a"
ORACLES["vault_records"] = duck.VAULT
ORACLES["synthetic_values"] = f"SELECT entity_type, i, {duck.synthetic('entity_type', 'i')} AS value FROM (VALUES {_TYPES}) t(entity_type), unnest(range(0, 100)) u(i)"
ORACLES["anonymize_vault"] = f"SELECT prompt_id, anonymized FROM ({duck.anonymized(duck.VAULT_TOKENS)}) a"
_OLD, _NEW = (duck.VAULT.replace(f"FROM ({MENTIONS}) m", f"FROM ({MENTIONS}) m WHERE conv_id {c}") for c in ("< 20", ">= 10"))
ORACLES["vault_import"] = f"""SELECT entity_type, normalized_key, placeholder, usage_count FROM ({_OLD}) o UNION ALL
  SELECT entity_type, normalized_key, placeholder, usage_count FROM ({_NEW}) n WHERE (entity_type, normalized_key) NOT IN (SELECT (entity_type, normalized_key) FROM ({_OLD}) o)"""
ORACLES["vault_recency"] = f"SELECT placeholder, last_seq, usage_count FROM ({duck.VAULT}) v"
ORACLES["preview_numbers"] = f"SELECT prompt_id AS doc_id, s AS span_start, '[' || entity_type || '_' || cast(row_number() OVER (PARTITION BY prompt_id, entity_type ORDER BY s) AS VARCHAR) || ']' AS placeholder FROM ({MENTIONS}) m"
_USED = f"(SELECT DISTINCT m.conv_id, v.placeholder, v.synthetic_value, v.original_text FROM (SELECT *, {duck.KEY} AS normalized_key FROM ({MENTIONS}) x) m JOIN ({duck.VAULT}) v USING (entity_type, normalized_key))"
ORACLES["augment_map"] = f"SELECT conv_id, placeholder AS key, original_text AS original FROM {_USED} u UNION ALL SELECT conv_id, synthetic_value, original_text FROM {_USED} u WHERE synthetic_value <> ''"

ORACLES["restore_canonical"] = f"SELECT prompt_id, text AS restored FROM ({PROMPTS}) p"
ORACLES["round_trip"] = f"SELECT prompt_id, text AS restored, true AS had_placeholder FROM ({PROMPTS}) p"


def _known(key: str, other: str) -> str:
    """What stands for a reply's spelling `other` of a placeholder `key`; both are SQL."""
    return f"coalesce(max(e.original) FILTER (WHERE e.placeholder = {key}), {other})"


def _used(key: str) -> str:
    return f"count(*) FILTER (WHERE e.placeholder = {key})"


_N, _M = "cast(1 + r.prompt_id % 3 AS VARCHAR)", "cast(1 + r.prompt_id % 5 AS VARCHAR)"
_P, _E = f"'[PERSON_' || {_N} || ']'", f"'[EMAIL_' || {_M} || ']'"
_ONE, _TWO, _MAIL, _ACCOUNT = "'[PERSON_1]'", "'[PERSON_2]'", "'[EMAIL_1]'", "'[IBAN_1]'"
_SHAPES = [
    (
        f"""'Dear ' || {_known(_ONE, "'person_1'")} || ' and ' || {_known(_TWO, "'PERSON 2'")} || ': ' || {_known(_MAIL, "'[email_1]'")} || ', ' || {_known(_ONE, "'[PERSON_1'")} || ', ' || {_known(_TWO, "'PERSON_2]'")} || ' or ' || {_known(_ONE, "'PERSON1'")}
          || '; not GMAILEMAIL_1, PERSON_1A, [PERSON_99] nor PERSON_01. ' || {_known(_ACCOUNT, "'IBAN1'")} || ' ok'""",
        f"3 * {_used(_ONE)} + 2 * {_used(_TWO)} + {_used(_MAIL)} + {_used(_ACCOUNT)}",
    ),
    (
        f"""'Hi ' || {_known(_P, f"'PERSON_' || {_N}")} || ', see ' || {_known(_E, f"'[EMAIL ' || {_M} || ']'")} || ' (' || {_known(_E, f"'email_' || {_M}")} || ')!'""",
        f"{_used(_P)} + 2 * {_used(_E)}",
    ),
    (
        f"""'No ' || {_known(_P, f"'[PERSON' || {_N}")} || ' ] xPERSON_' || {_N} || ' PERSON_' || {_N} || '00 here; é ' || {_known(_ACCOUNT, "'iban_1'")} || '.'""",
        f"{_used(_P)} + {_used(_ACCOUNT)}",
    ),
    ("any_value(r.reply)", "0"),
]
_CASE = lambda k: "CASE r.prompt_id % 4 " + " ".join(f"WHEN {n} THEN {shape[k]}" for n, shape in enumerate(_SHAPES)) + " END"
_ANSWERED = f"FROM ({REPLIES}) r LEFT JOIN ({duck.ENTITY_MAP}) e ON e.conv_id = r.conv_id GROUP BY r.prompt_id"
ORACLES["restore_variants"] = f"SELECT r.prompt_id, {_CASE(0)} AS restored {_ANSWERED}"
ORACLES["resolve_text"] = f"SELECT r.prompt_id, {_CASE(0)} AS restored, cast({_CASE(1)} AS BIGINT) AS n_matches {_ANSWERED}"
# All synthetic numbers of this type begin with 900, so "ssn 900" reads as a mangled [SSN_900] where the vault has that one.
ORACLES["restore_vault"] = f"""SELECT p.prompt_id, CASE WHEN s.synthetic_value IS NOT NULL AND o.original_text IS NOT NULL THEN replace(p.text, 'ssn ' || s.original_text, o.original_text || substr(s.synthetic_value, 4)) ELSE p.text END AS restored, true AS reversible
  FROM ({PROMPTS}) p LEFT JOIN (SELECT * FROM ({duck.VAULT}) v WHERE entity_type = 'SSN') s ON s.original_text = regexp_extract(p.text, 'ssn ([0-9-]+)', 1) LEFT JOIN (SELECT * FROM ({duck.VAULT}) v WHERE placeholder = '[SSN_900]') o ON true"""

_PAIRS = f"""(SELECT example_id, gold_index, found_index, g.entity_type AS gold_type, f.entity_type AS found_type, least(g.e, f.e) - greatest(g.s, f.s) AS overlap_bytes, (least(g.e, f.e) - greatest(g.s, f.s)) / greatest(g.e - g.s, 1) AS gold_coverage,
  (least(g.e, f.e) - greatest(g.s, f.s)) / greatest(f.e - f.s, 1) AS found_coverage, greatest(0, f.s - g.s, g.e - f.e) AS drift, abs(greatest(f.e - f.s, 1) - greatest(g.e - g.s, 1)) AS length_delta
  FROM ({GOLD}) g JOIN ({FOUND}) f USING (example_id) WHERE g.s < f.e AND f.s < g.e)"""
_CANDIDATES = f"(SELECT * FROM {_PAIRS} p WHERE drift <= 2 AND gold_coverage >= 0.8 AND found_coverage >= 0.5)"
ORACLES["score_candidates"] = f"SELECT example_id, gold_index, found_index, overlap_bytes, round(gold_coverage, 6) AS gold_coverage, round(found_coverage, 6) AS found_coverage, drift FROM {_CANDIDATES} c"
# The greedy choice: pairs in order, each taken if neither of its spans is.
_TAKEN = "list_contains(list_transform(acc, lambda p: p.{k}), x[1].{k})"
_GREEDY = f"""(SELECT example_id, unnest(list_reduce(l, lambda acc, x: CASE WHEN {_TAKEN.format(k='gold_index')} OR {_TAKEN.format(k='found_index')} THEN acc ELSE list_concat(acc, x) END)) AS k FROM (
  SELECT example_id, list([struct_pack(gold_index := gold_index, found_index := found_index)] ORDER BY gold_coverage DESC, found_coverage DESC, drift, length_delta, gold_index, found_index) AS l FROM {_CANDIDATES} c GROUP BY example_id) g)"""
_MATCHES = f"(SELECT c.*, gold_type = found_type AS type_correct FROM {_CANDIDATES} c JOIN {_GREEDY} g ON g.example_id = c.example_id AND g.k.gold_index = c.gold_index AND g.k.found_index = c.found_index)"
ORACLES["score_matches"] = f"SELECT example_id, gold_index, found_index, type_correct FROM {_MATCHES} m"
_OUTCOMES = f"""(SELECT example_id, gold_type AS entity_type, 'tp' AS outcome, type_correct FROM {_MATCHES} m
  UNION ALL SELECT example_id, entity_type, 'fn', NULL FROM ({GOLD}) g WHERE NOT EXISTS (SELECT 1 FROM {_MATCHES} m WHERE m.example_id = g.example_id AND m.gold_index = g.gold_index)
  UNION ALL SELECT example_id, entity_type, 'fp', NULL FROM ({FOUND}) f WHERE NOT EXISTS (SELECT 1 FROM {_MATCHES} m WHERE m.example_id = f.example_id AND m.found_index = f.found_index))"""
_KINDS = f"(SELECT example_id, language, length_bucket, CASE WHEN has_misc IS NULL THEN 'negative' WHEN has_misc THEN 'misc' ELSE 'headline' END AS kind FROM ({EXAMPLES}) x LEFT JOIN (SELECT example_id, bool_or(entity_type = 'MISC') AS has_misc FROM ({GOLD}) g GROUP BY example_id) h USING (example_id))"
_SCORED = f"(SELECT o.*, k.language, k.length_bucket, k.kind FROM {_OUTCOMES} o JOIN {_KINDS} k USING (example_id))"


_HEADLINE = "kind = 'headline'"


def _metrics(by: str, where: str, more: str = "") -> str:
    counts = f"SELECT {by + ', ' if by else ''}count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn{more} FROM {_SCORED} s WHERE {where}{' GROUP BY ' + by if by else ''}"
    rates = f"SELECT *, CASE WHEN tp + fp = 0 THEN 0.0 ELSE tp / (tp + fp) END AS p, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS r FROM ({counts}) c"
    return f"SELECT * EXCLUDE (p, r), round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r = 0 THEN 0.0 ELSE 2 * p * r / (p + r) END, 6) AS f1 FROM ({rates}) q"


ORACLES["score_headline"] = _metrics("", "kind = 'headline'", ", round(coalesce(avg(cast(type_correct AS INT)), 0.0), 6) AS type_accuracy")
ORACLES["score_by_type"] = f"SELECT entity_type, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, coalesce(precision, 0.0) AS precision, coalesce(recall, 0.0) AS recall, coalesce(f1, 0.0) AS f1 FROM (VALUES {_TYPES}) t(entity_type) LEFT JOIN ({_metrics('entity_type', _HEADLINE)}) m USING (entity_type)"
ORACLES["score_by_lang"] = _metrics("language, length_bucket", "kind = 'headline'")
ORACLES["score_misc"] = _metrics("", "kind = 'misc'")
ORACLES["score_negative"] = f"""SELECT count(*) AS examples, count(*) FILTER (WHERE n = 0) AS passed, count(*) FILTER (WHERE n > 0) AS failed, cast(sum(n) AS BIGINT) AS false_positives, round(count(*) FILTER (WHERE n = 0) / count(*), 6) AS pass_rate, round(sum(n) / count(*), 6) AS false_positive_rate
  FROM (SELECT k.example_id, count(s.outcome) AS n FROM {_KINDS} k LEFT JOIN {_SCORED} s ON s.example_id = k.example_id AND s.outcome = 'fp' WHERE k.kind = 'negative' GROUP BY k.example_id) x"""
ORACLES["score_samples"] = f"SELECT example_id, entity_type, language, outcome FROM {_SCORED} s WHERE outcome = 'fn' ORDER BY ALL LIMIT 5"

_UNITS = "(length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')))"
ORACLES["length_bucket"] = f"SELECT CASE WHEN {_UNITS} <= 120 THEN 'short' WHEN {_UNITS} <= 260 THEN 'medium' ELSE 'long' END AS length_bucket, count(*) AS n FROM conversations GROUP BY 1"
ORACLES["corpus_summary"] = f"""SELECT 'language' AS what, language AS key, count(*) AS n FROM ({EXAMPLES}) x GROUP BY language UNION ALL SELECT 'length_bucket', length_bucket, count(*) FROM ({EXAMPLES}) x GROUP BY length_bucket
  UNION ALL SELECT 'entity_type', entity_type, count(DISTINCT example_id) FROM ({GOLD}) g WHERE example_id IN (SELECT o_orderkey FROM orders) GROUP BY entity_type
  UNION ALL SELECT 'examples', kind, count(*) FROM {_KINDS} k WHERE kind <> 'headline' GROUP BY kind"""
ORACLES["latency_percentiles"] = "SELECT count(value) AS count, round(sum(value), 6) AS total_ms, round(avg(value), 6) AS average_ms, round(quantile_disc(value, 0.5), 6) AS p50_ms, round(quantile_disc(value, 0.95), 6) AS p95_ms, round(max(value), 6) AS max_ms FROM events"
ORACLES["activity_sessions"] = """SELECT user_id, epoch_us(min(ts)) AS begins, epoch_us(max(ts)) + 600000000 AS ends, count(*) AS n_events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (
  SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 10 MINUTE THEN 0 ELSE 1 END AS new FROM events) x) y GROUP BY user_id, g"""
ORACLES["dedupe_window"] = """SELECT user_id, "at", text FROM (SELECT user_id, (epoch_us(ts) // 1000) AS "at", event_type AS text, coalesce(lag(event_type) OVER w = event_type AND (epoch_us(ts) // 1000) - lag((epoch_us(ts) // 1000)) OVER w < 3600000, false) AS same FROM events WINDOW w AS (PARTITION BY user_id ORDER BY (epoch_us(ts) // 1000), event_type)) x WHERE NOT same"""
ORACLES["feedback_last_n"] = f"SELECT event_id, detected_type, corrected_type FROM ({FEEDBACK}) f ORDER BY event_id DESC LIMIT 1000"
ORACLES["cancelled_results"] = """SELECT event_id, user_id FROM events r WHERE event_id % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM events c WHERE c.event_id % 3 = 0 AND c.user_id = r.user_id AND c.ts <= r.ts AND c.ts >= r.ts - INTERVAL 6 HOUR)"""
ORACLES["text_offsets"] = "SELECT doc_id, cp, cast(strlen(substr(text, 1, cp)) AS BIGINT) AS byte_at, cp AS back, md5(substr(text, cp + 1)) AS rest FROM (SELECT doc_id, text, cast(length(text) // 2 AS BIGINT) AS cp FROM documents) d"
ORACLES["anonymized_replies"] = r"""SELECT conv_id, turn, regexp_matches(text, '\[?[A-Z]{2,}[A-Z_]*[_ ]?\d+\]?') AS gate, md5(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g'))) AS key,
  CASE WHEN length(h) > 30 THEN substr(h, 1, 27) || '...' ELSE h END AS shown FROM (SELECT *, replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS h FROM conversations WHERE role = 'assistant' AND length(text) >= 10) c"""

_TIERED = f"(SELECT *, CASE WHEN gb IS NULL OR gb <= 0 THEN 'unknown' WHEN gb <= 2 THEN 'critical' WHEN gb <= 4 THEN 'warning' ELSE 'ok' END AS tier FROM ({Q._HOSTS}) h)"
_MEMORY = "CASE WHEN gb IS NULL THEN 'unavailable' ELSE cast(cast(gb AS BIGINT) AS VARCHAR) || ' GB' END"


def _said(name: str) -> str:
    tone, title, detail = C.RESOURCE_SUMMARIES[name]
    return f"struct_pack(tone := '{tone}', title := '{title}', detail := replace('{detail}', '{{memory}}', {_MEMORY}))"


ORACLES["host_rules"] = f"""SELECT host_id, tier, CASE tier WHEN 'critical' THEN 'auto-disable-local-ai' WHEN 'ok' THEN 'none' ELSE 'warn' END AS recommendation,
  provider <> 'off' AND state = 'enabled' AND tier = 'ok' AND gpu <> 'unavailable' AND NOT on_cpu AS warm_up,
  CASE state WHEN 'off-load-failure' THEN 'model-failed' WHEN 'off-user-choice' THEN 'pattern-only' WHEN 'off-low-memory-auto' THEN CASE WHEN tier = 'critical' AND modal <> 'pending' THEN 'low-memory-protection' END
    ELSE CASE WHEN tier = 'warning' THEN 'low-memory-warning' WHEN tier = 'unknown' THEN 'unknown-memory' WHEN on_cpu THEN 'running-on-cpu' END END AS chip, said.tone AS tone, said.title AS title, said.detail AS detail
  FROM (SELECT *, CASE WHEN state = 'off-load-failure' THEN {_said('failed')} WHEN state = 'off-low-memory-auto' THEN {_said('protected')} WHEN provider = 'off' OR state = 'off-user-choice' THEN {_said('off')}
    WHEN on_cpu THEN {_said('on_cpu')} WHEN tier = 'warning' THEN {_said('tight')} WHEN tier = 'unknown' THEN {_said('uncertain')} END AS said FROM {_TIERED} t) x"""
_ESC = "replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
_TAG = """'<span class="pg-highlight pg-highlight-' || lower(entity_type) || CASE WHEN score >= greatest(b, 0.5) THEN '' ELSE ' pg-highlight-off' END || '" data-pg-span-index="' || cast(n AS VARCHAR) || '" title="' || entity_type || ' (' || cast(cast(round(score * 100) AS INT) AS VARCHAR) || '%)">'"""
ORACLES["highlighted_html"] = f"""WITH n AS (SELECT d.*, t.b, row_number() OVER (PARTITION BY id ORDER BY s) - 1 AS n FROM ({duck.detected(_FENCED_ROWS)}) d JOIN ({_TYPE_ROWS}) t USING (entity_type)),
  v AS (SELECT n.* FROM n LEFT JOIN ({_REGIONS}) g ON g.text_id = n.id AND n.s >= g.region_start AND n.s < g.region_end WHERE g.text_id IS NULL),
  p AS (SELECT v.id, v.cs, v.ce, {_ESC.format('substr(f.text, coalesce(lag(v.ce) OVER w, 0) + 1, v.cs - coalesce(lag(v.ce) OVER w, 0))')} || {_TAG} || {_ESC.format('v.t')} || '</span>' AS piece FROM v JOIN {_FENCED_ROWS} f USING (id) WINDOW w AS (PARTITION BY v.id ORDER BY v.cs))
  SELECT f.id AS text_id, coalesce(head, '') || {_ESC.format('substr(f.text, coalesce(j.ce, 0) + 1)')} AS html FROM {_FENCED_ROWS} f LEFT JOIN (SELECT id, string_agg(piece, '' ORDER BY cs) AS head, max(ce) AS ce FROM p GROUP BY id) j USING (id)"""
ORACLES["manual_spans"] = f"SELECT prompt_id, cast(strlen(substr(text, 1, strpos(text, 'München') - 1)) AS BIGINT) AS span_start, cast(strlen(substr(text, 1, strpos(text, 'München') - 1)) + 8 AS BIGINT) AS span_end, 'LOCATION' AS entity_type FROM ({PROMPTS}) p WHERE strpos(text, 'München') > 0"
