"""DuckDB SQL that says the same as the operators, in relational terms."""

from __future__ import annotations

from umbraframe.functions import constants as C
from umbraframe.plans.inputs import MOST_BYTES, PROMPTS, TEXTS

TOKEN = r"[\p{L}\p{N}''\-]"


def regex(pattern: str) -> str:
    """A pattern for this engine: without the flag that means something else here, quotes doubled."""
    return pattern.replace("(?U)", "").replace("'", "''")


def values(pairs) -> str:
    return ", ".join("(" + ", ".join(repr(v) if not isinstance(v, str) else "'" + v.replace("'", "''") + "'" for v in p) + ")" for p in pairs)


def case(column: str, table: dict, other: str = "NULL") -> str:
    show = lambda v: "'" + v + "'" if isinstance(v, str) else str(v)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {show(v)}" for k, v in table.items()) + f" ELSE {other} END"


def _size(items: str, f: str) -> str:
    return f"coalesce(list_sum(list_transform({items}, lambda x: {f}(x))), 0)"


def _matches(source: str, rank: int, kind: str, score: float, found: str, pieces: str, origin: str) -> str:
    at = lambda f: f"{_size('p[1:i]', f)} + {_size('m[1:i-1]', f)}"
    return f"""SELECT id, text, {rank} AS rk, i, m[i] AS t, '{kind}' AS entity_type, {score} AS score, '{origin}' AS source,
      cast({at('strlen')} AS BIGINT) AS s, cast({at('length')} AS BIGINT) AS cs
      FROM (SELECT id, text, {found} AS m, {pieces} AS p FROM {source}) x, unnest(range(1, len(m) + 1)) u(i)"""


def raw_spans(source: str, ner: bool = False, types: list[str] | None = None) -> str:
    """Spans before the checks: id, text, rk and i (order), t, entity_type, score, source, s, e (bytes), cs, ce (code points)."""
    parts = []
    for rank, (kind, pattern, score) in enumerate(C.RECOGNISERS):
        if types is None or kind in types:
            r = regex(pattern)
            one = _matches(source, rank, kind, score, f"regexp_extract_all(text, '{r}')", f"string_split_regex(text, '{r}')", "regex")
            parts.append(f"SELECT * FROM ({one}) y WHERE regexp_extract(t, '{regex(C.DATE)}') <> t" if kind == "PHONE" else one)
    if ner:
        for rank, (value, kind, score) in enumerate(C.DICTIONARY):
            # by start first, then by the dictionary's order
            one = _matches(source, 0, kind, score, f"list_transform(range(len(string_split(text, '{value}')) - 1), lambda x: '{value}')", f"string_split(text, '{value}')", "ner")
            parts.append(f"SELECT id, text, 100 AS rk, s * 100 + {rank} AS i, t, entity_type, score, source, s, cs FROM ({one}) y")
    return f"SELECT *, s + strlen(t) AS e, cs + length(t) AS ce FROM ({' UNION ALL '.join(parts)}) z"


LUHN = """(strlen(regexp_replace(t, '[^0-9]', '', 'g')) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(regexp_replace(t, '[^0-9]', '', 'g')), ''),
  lambda c, k: CASE WHEN k % 2 = 1 THEN cast(c AS INT) WHEN cast(c AS INT) > 4 THEN cast(c AS INT) * 2 - 9 ELSE cast(c AS INT) * 2 END)) % 10 = 0)"""
_PLAIN = r"regexp_replace(t, '\s', '', 'g')"
IBAN = f"""(regexp_matches({_PLAIN}, '^[A-Z]{{2}}[0-9]{{2}}[A-Z0-9]+$') AND length({_PLAIN}) BETWEEN 5 AND 34 AND list_reduce(list_transform(string_split(substr({_PLAIN}, 5) || substr({_PLAIN}, 1, 4), ''),
  lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN cast(c AS BIGINT) ELSE cast(ascii(c) - 55 AS BIGINT) END), lambda a, x: CASE WHEN x < 10 THEN (a * 10 + x) % 97 ELSE (a * 100 + x) % 97 END) = 1)"""
SSN = """(cast(split_part(t, '-', 1) AS INT) NOT IN (0, 666) AND cast(split_part(t, '-', 1) AS INT) < 900 AND cast(split_part(t, '-', 2) AS INT) <> 0 AND cast(split_part(t, '-', 3) AS INT) <> 0)"""
CHECK = f"CASE WHEN source <> 'regex' THEN true WHEN entity_type = 'CREDIT_CARD' THEN {LUHN} WHEN entity_type = 'IBAN' THEN {IBAN} WHEN entity_type = 'SSN' THEN {SSN} ELSE true END"

_HEAD = f"CASE WHEN regexp_matches(t, '^{TOKEN}') THEN regexp_replace(substr(text, 1, cs), '{TOKEN}+$', '') ELSE substr(text, 1, cs) END"
_TAIL = f"CASE WHEN regexp_matches(t, '{TOKEN}$') THEN regexp_replace(substr(text, ce + 1), '^{TOKEN}+', '') ELSE substr(text, ce + 1) END"
_WORDS = "CASE entity_type " + " ".join(f"WHEN '{t}' THEN [{', '.join(repr(w) for w in words)}]" for t, words in C.CONTEXT_KEYWORDS.items()) + " ELSE []::VARCHAR[] END"


def boosted(source: str, ner: bool = False, window: int = 5) -> str:
    """Checked spans with boosted scores."""
    n = window + 1
    return f"""SELECT id, rk, i, t, entity_type, source, s, e, cs, ce, CASE WHEN list_has_any(list_transform(list_concat(b[greatest(1, len(b) - {n} + 1):], a[1:{n}]), lambda w: lower(w)), {_WORDS})
      THEN least(1.0, score + cast(0.15 AS DOUBLE)) ELSE score END AS score FROM (
      SELECT * EXCLUDE (score), cast(score AS DOUBLE) AS score, regexp_extract_all({_HEAD}, '{TOKEN}+') AS b, regexp_extract_all({_TAIL}, '{TOKEN}+') AS a FROM ({raw_spans(source, ner)}) r WHERE {CHECK}) w"""


def merged(source: str, ner: bool = False) -> str:
    """Spans after the greedy merge: id, s, e, cs, ce, entity_type, score, source, t."""
    strength = "CASE WHEN source = 'regex' THEN 2 ELSE 1 END"
    one = f"struct_pack(s := s, e := e, cs := cs, ce := ce, entity_type := entity_type, score := score, source := source, t := t, q := {strength})"
    last = "acc[len(acc)]"
    fold = f"""list_reduce(l, lambda acc, x: CASE WHEN x[1].s >= {last}.e OR {last}.s >= x[1].e THEN list_concat(acc, x)
      WHEN x[1].q > {last}.q OR (x[1].q = {last}.q AND x[1].score > {last}.score) THEN list_concat(acc[1:len(acc) - 1], x) ELSE acc END)"""
    return f"""SELECT id, k.s AS s, k.e AS e, k.cs AS cs, k.ce AS ce, k.entity_type AS entity_type, k.score AS score, k.source AS source, k.t AS t FROM (
      SELECT id, unnest({fold}) AS k FROM (SELECT id, list([{one}] ORDER BY s, score DESC, rk, i) AS l FROM ({boosted(source, ner)}) o GROUP BY id) g) u"""


def detected(source: str, ner: bool = False) -> str:
    least = case("entity_type", C.NER_MINIMUM)
    return f"SELECT * FROM ({merged(source, ner)}) d WHERE score >= CASE WHEN source = 'ner' THEN greatest(0.5, {least}) ELSE 0.5 END"


PROMPT_ROWS = f"(SELECT prompt_id AS id, text FROM ({PROMPTS}) pr)"
TEXT_ROWS = f"(SELECT text_id AS id, text FROM ({TEXTS}) tx)"
#: Mentions: detected and dictionary spans of all prompts, in order.
MENTIONS = f"SELECT p.conv_id, m.id AS prompt_id, m.id * {MOST_BYTES} + m.s AS seq, m.s, m.e, m.cs, m.ce, m.entity_type, m.score, m.source, m.t AS text FROM ({detected(PROMPT_ROWS, True)}) m JOIN ({PROMPTS}) p ON p.prompt_id = m.id"

_PERSON = "[" + ", ".join(f"'{v}'" for v in C.POOLS["PERSON"]) + "]"


def _pool(pool: list[str], i: str) -> str:
    items, n = "[" + ", ".join(f"'{v}'" for v in pool) + "]", len(pool)
    base = f"{items}[{i} % {n} + 1]"
    return f"CASE WHEN {i} < {n} THEN {base} WHEN regexp_matches({base}, '^[\\d\\s+\\-()]+$') THEN {base} || '-' || cast({i} // {n} + 1 AS VARCHAR) ELSE {base} || ' ' || cast({i} // {n} + 1 AS VARCHAR) END"


def synthetic(kind: str, i: str) -> str:
    person = _pool(C.POOLS["PERSON"], i)
    email = f"regexp_replace(regexp_replace(lower({person}), '[^a-z0-9]+', '.', 'g'), '^\\.+|\\.+$', '', 'g') || '@' || [{', '.join(repr(d) for d in C.EMAIL_DOMAINS)}][{i} % 3 + 1]"
    return f"CASE {kind} WHEN 'EMAIL' THEN {email} " + " ".join(f"WHEN '{t}' THEN {_pool(p, i)}" for t, p in C.POOLS.items()) + " END"


KEY = r"lower(regexp_replace(trim(text), '\s+', ' ', 'g'))"
VAULT = f"""SELECT entity_type, normalized_key, original_text, '[' || entity_type || '_' || cast(n AS VARCHAR) || ']' AS placeholder, coalesce({synthetic('entity_type', '(n - 1)')}, '') AS synthetic_value, first_seq, last_seq, usage_count FROM (
  SELECT *, row_number() OVER (PARTITION BY entity_type ORDER BY first_seq) AS n FROM (
  SELECT entity_type, {KEY} AS normalized_key, min(seq) AS first_seq, max(seq) AS last_seq, count(*) AS usage_count, arg_min(text, seq) AS original_text FROM ({MENTIONS}) m GROUP BY ALL) k) v"""
ENTITY_MAP = f"""SELECT conv_id, '[' || entity_type || '_' || cast(row_number() OVER (PARTITION BY conv_id, entity_type ORDER BY first_seq) AS VARCHAR) || ']' AS placeholder, text AS original, entity_type FROM (
  SELECT conv_id, text, min(seq) AS first_seq, arg_min(entity_type, seq) AS entity_type FROM ({MENTIONS}) m GROUP BY conv_id, text) f"""


def anonymized(tokens: str) -> str:
    """prompt_id, text, anonymized, of rows (prompt_id, cs, ce, token)."""
    pieces = f"SELECT t.prompt_id, t.cs, t.ce, substr(p.text, coalesce(lag(t.ce) OVER w, 0) + 1, t.cs - coalesce(lag(t.ce) OVER w, 0)) || t.token AS piece FROM ({tokens}) t JOIN ({PROMPTS}) p USING (prompt_id) WINDOW w AS (PARTITION BY t.prompt_id ORDER BY t.cs)"
    joined = f"SELECT prompt_id, string_agg(piece, '' ORDER BY cs) AS head, max(ce) AS ce FROM ({pieces}) q GROUP BY prompt_id"
    return f"SELECT p.prompt_id, p.conv_id, p.text, coalesce(j.head || substr(p.text, j.ce + 1), p.text) AS anonymized FROM ({PROMPTS}) p LEFT JOIN ({joined}) j USING (prompt_id)"


MAP_TOKENS = f"SELECT m.prompt_id, m.cs, m.ce, e.placeholder AS token FROM ({MENTIONS}) m JOIN ({ENTITY_MAP}) e ON e.conv_id = m.conv_id AND e.original = m.text"
VAULT_TOKENS = f"SELECT m.prompt_id, m.cs, m.ce, CASE WHEN v.synthetic_value <> '' THEN v.synthetic_value ELSE v.placeholder END AS token FROM (SELECT *, {KEY} AS normalized_key FROM ({MENTIONS}) mm) m JOIN ({VAULT}) v USING (entity_type, normalized_key)"
