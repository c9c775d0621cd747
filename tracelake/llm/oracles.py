"""SQL for the operators that SQL can express."""

from __future__ import annotations

import re

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = rf"list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
i AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
starts AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, len(w[s:s + 12]) AS n, array_to_string(w[s:s + 12], ' ') AS g FROM starts),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, lengths WHERE len(w) >= n),
grams AS (SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS g FROM places),
hits AS (SELECT DISTINCT doc_id, s, grams.n AS n, item_id FROM grams JOIN windows ON grams.n = windows.n AND grams.g = windows.g),
words AS (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hits),
counted AS (SELECT doc_id, count(*) AS n_hit FROM words GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM hits) x GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, (coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w)) AS contaminated
FROM d LEFT JOIN counted ON d.doc_id = counted.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


def _any_case(words: str) -> str:
    """The pattern with both cases of each letter: case-blind matching would take in letters beyond ASCII."""
    return re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", words)


_ASSIGN = rf"""({_any_case("password|passwd|secret|token|api_?key")})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""


def _found(kind: str, rank: int, pattern: str, keep: str) -> str:
    return f"""{kind}_cut AS (SELECT doc_id, string_split_regex(coalesce(text, ''), '{pattern}') AS gaps, regexp_extract_all(coalesce(text, ''), '{pattern}') AS hits FROM documents),
{kind}_each AS (SELECT doc_id, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, unnest(range(1, len(hits) + 1)) AS i FROM {kind}_cut WHERE len(hits) > 0),
{kind}_at AS (SELECT doc_id, hit, i, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM {kind}_each),
{kind}_kept AS (SELECT doc_id, '{kind}' AS kind, {rank} AS rank, CAST(stop - length(hit) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM {kind}_at WHERE {keep})"""


SECRETS = f"""
WITH {_found("assign", 0, _ASSIGN, f"length(regexp_extract(hit, '{_ASSIGN}', 2)) >= 12")},
{_found("access", 1, "AKIA[A-Z0-9]+", "length(hit) >= 18")},
{_found("hex", 2, "[0-9a-f]+", "length(hit) >= 16")},
every AS (SELECT * FROM assign_kept UNION ALL SELECT * FROM access_kept UNION ALL SELECT * FROM hex_kept),
named AS (SELECT doc_id, string_agg(kind || ':' || CAST(start AS VARCHAR) || ':' || CAST(stop AS VARCHAR), ',' ORDER BY start, rank) AS spans,
  count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access, count(*) FILTER (WHERE kind = 'hex') AS n_hex FROM every GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(coalesce(n_assign, 0) AS BIGINT) AS n_assign, CAST(coalesce(n_access, 0) AS BIGINT) AS n_access, CAST(coalesce(n_hex, 0) AS BIGINT) AS n_hex,
  sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans, sha256(coalesce(text, '')) AS blob
FROM documents d LEFT JOIN named n ON d.doc_id = n.doc_id"""


NEAR_DUPLICATES = rf"""
WITH RECURSIVE texts AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM texts WHERE len(w) > 0),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS g FROM starts),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reached AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM reached r JOIN both_ways e ON e.a = r.doc_id),
least AS (SELECT doc_id, min(root) AS component_id FROM reached GROUP BY doc_id)
SELECT d.doc_id AS doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN least l ON l.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id"""


_CONTROL = r"\### Assistant: </turn> ok"
_ESCAPED = r"replace(replace(replace({0}, '\', '\\'), '###', '\###'), '</turn>', '\</turn>')"
CHAT = rf"""
WITH turns AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '{_CONTROL}' UNION ALL SELECT -7, 1, 'assistant', '{_CONTROL}'),
escaped AS (SELECT *, {_ESCAPED.format("text")} AS shown, replace(replace({_ESCAPED.format("role")}, ':', '\:'), chr(10), '\' || chr(10)) AS named FROM turns)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('### ') + length(named) + length(':' || chr(10)) + length(shown) + length(chr(10) || '</turn>' || chr(10))) AS BIGINT) AS formatted_chars
FROM escaped GROUP BY conv_id"""
