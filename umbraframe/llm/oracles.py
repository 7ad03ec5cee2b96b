"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from umbraframe.llm import chat, rlz, secrets, wumanber

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def _sql(pattern: str) -> str:
    return pattern.replace("(?ai:", "(?i:").replace("'", "''")


def secret_scan() -> str:
    parts = []
    for rank, rule in enumerate(secrets.BASE + secrets.ADDED):
        p = _sql(rule.pattern)
        at = "coalesce(list_sum(list_transform(p[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
        parts.append(f"""SELECT doc_id, {rank} AS rk, '{rule.kind}' AS kind, cast({at} AS BIGINT) AS s, cast({at} + length(m[i]) AS BIGINT) AS e
          FROM (SELECT doc_id, regexp_extract_all(text, '{p}') AS m, string_split_regex(text, '{p}') AS p FROM documents) x, unnest(range(1, len(m) + 1)) u(i) WHERE length(regexp_extract(m[i], '{p}', {rule.group})) >= {rule.least}""")
    shown = "kind || ':' || cast(s AS VARCHAR) || ':' || cast(e AS VARCHAR)"
    base = len(secrets.BASE)
    counts = ", ".join(f"count(*) FILTER (WHERE rk = {k}) AS n_{r.kind}" for k, r in enumerate(secrets.BASE))
    return f"""SELECT d.doc_id, {', '.join(f'coalesce(n_{r.kind}, 0) AS n_{r.kind}' for r in secrets.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM documents d LEFT JOIN (
      SELECT doc_id, {counts}, string_agg({shown}, ',' ORDER BY s, rk) FILTER (WHERE rk < {base}) AS base, string_agg({shown}, ',' ORDER BY s, rk) AS spans FROM ({' UNION ALL '.join(parts)}) f GROUP BY doc_id) g USING (doc_id)"""


def chat_format() -> str:
    said = chat.PLANTED
    rows = f"SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL VALUES (-1, 0, 'user', '{said}'), (-1, 1, 'assistant', '{said}')"
    marks = len(chat.START) + len(chat.SEP) + len(chat.END)
    escaped = lambda c: f"length({c}) + len(regexp_extract_all({c}, '<\\\\*\\|'))"
    loss = "coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')"
    return f"""SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, length({loss}) AS loss_chars, sha256({loss}) AS loss_sha256,
      cast(sum({marks} + {escaped('role')} + {escaped('text')}) AS BIGINT) AS formatted_chars FROM ({rows}) r GROUP BY conv_id"""


def substring_dedup() -> str:
    n = rlz.WINDOW
    return f"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
      x AS (SELECT doc_id, i, array_to_string(w[i:i + {n - 1}], ' ') AS k FROM d, unnest(range(1, len(w) - {n - 2})) u(i)),
      f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY k ORDER BY doc_id, i) AS r FROM x),
      g AS (SELECT DISTINCT doc_id, i + j AS p FROM f, unnest(range(0, {n})) u(j) WHERE r > 1),
      q AS (SELECT d.doc_id, p, w[p] AS word FROM d, unnest(range(1, len(w) + 1)) u(p)),
      l AS (SELECT q.doc_id, count(*) AS n_left, string_agg(word, ' ' ORDER BY p) AS kept FROM q ANTI JOIN g USING (doc_id, p) GROUP BY q.doc_id)
      SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, cast(len(w) - coalesce(n_left, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN l USING (doc_id)"""


def decontamination() -> str:
    words = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    n = wumanber.WINDOW
    return f"""WITH d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT item_id, {words} AS w FROM benchmark),
      p AS (SELECT DISTINCT item_id, least({n}, len(w)) AS k, array_to_string(w[i:i + least({n}, len(w)) - 1], ' ') AS pat FROM b, unnest(range(1, len(w) - least({n}, len(w)) + 2)) u(i) WHERE len(w) > 0),
      x AS (SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS pat FROM d, (SELECT DISTINCT k FROM p) ks, unnest(range(1, greatest(1, len(w) - k + 2))) u(i)),
      h AS (SELECT x.doc_id, x.i, x.k, p.item_id FROM x JOIN p USING (k, pat)),
      c AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM h, unnest(range(0, k)) u(j) GROUP BY doc_id),
      t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item FROM h) y GROUP BY doc_id)
      SELECT d.doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
      FROM d LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)"""


ORACLES = {"op1_secret_scan": secret_scan(), "op3_chat_format": chat_format(), "op6_substring_dedup": substring_dedup(), "op7_decontamination": decontamination()}
