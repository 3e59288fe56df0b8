"""DuckDB SQL for the corpus queries that SQL can express, written from the definitions."""

from __future__ import annotations

from learntrace.llm.license_scan import BASE_PHRASES, BASE_WEIGHTS, CLASSES, PHRASES, license_class
from learntrace.llm.quality_rules import RULES

WS = r"[\x20\x09-\x0D]"
NOT_WS = r"[^\x20\x09-\x0D]"

_LEDGER = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '{WS}+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{NOT_WS}')) AS ls FROM d),
grams AS (SELECT rid, i, array_to_string(ws[i:(i + 7)], ' ') AS g FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1),
covered AS (SELECT rid, count(DISTINCT i + k)::BIGINT AS n FROM twice, (SELECT unnest(range(8)) AS k) GROUP BY rid),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '{WS}+', '', 'g'))::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words,
    length(regexp_replace(t, '\PL+', '', 'g'))::BIGINT AS n_letters, length(regexp_replace(t, '\P{{Lu}}+', '', 'g'))::BIGINT AS n_capitals, length(regexp_replace(t, '[^!]+', '', 'g'))::BIGINT AS n_exclamations
    FROM w LEFT JOIN covered c USING (rid)),
f AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN n_lines >= 6 AND 100 * n_dup_lines > 60 * n_lines THEN 8 ELSE 0 END + CASE WHEN n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 14 * n_words) THEN 16 ELSE 0 END
    + CASE WHEN 2 * n_letters < word_chars OR word_chars = 0 THEN 32 ELSE 0 END + CASE WHEN n_letters > 0 AND 2 * n_capitals > n_letters THEN 64 ELSE 0 END
    + CASE WHEN n_words > 0 AND 10 * n_exclamations > n_words THEN 128 ELSE 0 END)::BIGINT AS failures FROM m)
"""
QUALITY = f"{_LEDGER} SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failures & 3) <> 0 AS base_failed, failures = 0 AS kept, failures FROM f"
_RULE_ROWS = ", ".join(f"({r.bit}, '{r.name}')" for r in RULES)
ABLATION = rf"""{_LEDGER}, rules(bit, rule) AS (VALUES {_RULE_ROWS})
SELECT bit, rule, (count(*) FILTER (WHERE (failures >> bit) & 1 = 1))::BIGINT AS failed, (count(*) FILTER (WHERE failures = 1 << bit))::BIGINT AS failed_alone,
    (count(*) FILTER (WHERE failures = 0 OR failures = 1 << bit))::BIGINT AS kept_without FROM f, rules GROUP BY bit, rule
"""

#: Leaks as whole items: canonical tokens without slots, which the given items have none of.
_MARK = r"""list_filter(regexp_split_to_array(lower(t), '[^\pL0-9]+'), lambda x: x <> '')"""
LEAKS = rf"""
WITH b AS (SELECT item_id, {_MARK} AS ws FROM (SELECT item_id, coalesce(text, '') AS t FROM benchmark)),
items AS (SELECT DISTINCT item_id, i, array_to_string(ws[i:(i + 4)], ' ') AS g FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM b WHERE len(ws) >= 5)),
sizes AS (SELECT item_id, count(DISTINCT i)::BIGINT AS n_windows FROM items GROUP BY item_id),
d AS (SELECT doc_id, {_MARK} AS ws FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)),
grams AS (SELECT DISTINCT doc_id, array_to_string(ws[i:(i + 4)], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)),
hits AS (SELECT doc_id, item_id, count(DISTINCT i)::BIGINT AS n_found FROM grams JOIN items USING (g) GROUP BY ALL)
SELECT doc_id, item_id, n_windows, n_found, round(n_found::DOUBLE / n_windows, 6) AS coverage FROM hits JOIN sizes USING (item_id) WHERE round(n_found::DOUBLE / n_windows, 6) >= 0.8
"""


def _spans(kind: str, order: int, pattern: str, score: float, context: str, extra: str = "") -> str:
    """Spans of a kind: the text between matches and the matches, summed to positions. ``extra`` names a
    leading group that stands for what the kind looks back at."""
    return rf"""SELECT rid, '{kind}' AS kind, {order} AS ord, v, s, s + length(v) AS e, CASE WHEN regexp_matches(substring(t, greatest(s - 40, 0) + 1, least(s, 40)), '(?i)(^|[^\pL\pN])({context})($|[^\pL\pN])') THEN {score + 0.3} ELSE {score} END AS sc
        FROM (SELECT rid, t, found[i] AS v, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(found[1:(i - 1)], lambda x: length(x))), 0))::BIGINT AS s
            FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}') AS found, regexp_split_to_array(t, '{pattern}') AS pieces FROM d WHERE regexp_matches(t, '{pattern}'))))"""


_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_LUHN = f"list_sum(list_transform(string_split(reverse({_DIGITS}), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN c::INT WHEN c::INT > 4 THEN 2 * c::INT - 9 ELSE 2 * c::INT END)) % 10 = 0"
_HEX = "regexp_matches(v, '^[0-9A-Fa-f]+$') AND regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Fa-f]')"
#: Base kinds and secrets, whose runs need no look back. The other added kinds do, which SQL's patterns cannot, and
#: occur in no row of the given tables; the brute-force tests hold them.
PII = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
found AS (
    {_spans("email", 0, r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", 0.8, "e-?mail|contact|correo|courriel|kontakt")}
    UNION ALL SELECT * FROM ({_spans("ip", 1, r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", 0.6, "ip|server|host|address|adresse")}) WHERE list_bool_and(list_transform(string_split(v, '.'), lambda p: p::HUGEINT <= 255))
    UNION ALL SELECT * FROM ({_spans("card", 2, r"[0-9](?:[\x20-]?[0-9])+", 0.7, "card|visa|mastercard|karte|carte|tarjeta")}) WHERE length({_DIGITS}) BETWEEN 12 AND 19 AND {_LUHN}
    UNION ALL SELECT * FROM ({_spans("phone", 3, r"\+[0-9][\x20().0-9-]+[0-9]", 0.6, "phone|tel|call|mobile|telefon|fax")}) WHERE length({_DIGITS}) BETWEEN 9 AND 15
    UNION ALL SELECT * FROM ({_spans("secret", 7, r"[A-Za-z0-9]{32,}", 0.3, "tokens?|secrets?|keys?|apikey|password|passwd|credentials?")}) WHERE {_HEX} AND sc >= 0.5),
told AS (SELECT rid, {", ".join(f"(count(*) FILTER (WHERE kind = '{k}'))::BIGINT AS n_{k}" for k in ("email", "ip", "card", "phone"))},
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (WHERE ord < 4) AS base, string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) AS spans, string_agg(printf('%.2f', sc::DOUBLE), ',' ORDER BY s, ord) AS scores FROM found GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in ("email", "ip", "card", "phone"))}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN told USING (rid)
"""

_PHRASE_ROWS = ", ".join(f"('{p}', '{label}', {w}::DOUBLE, {len(CLASSES) if label in ('reserved', 'copyright') else license_class(label)})" for p, label, w in [*((p, x, BASE_WEIGHTS[x]) for p, x in BASE_PHRASES.items()), *((p, x, w) for p, (x, w) in PHRASES.items())])
_PLACES = " UNION ALL ".join(f"SELECT rid, '{label}' AS label, unnest(list_filter(range(len(ws)), lambda i: {' AND '.join(f'ws[i + {k + 1}] = {chr(39)}{w}{chr(39)}' for k, w in enumerate(p.split()))})) AS at_word FROM w" for p, label in BASE_PHRASES.items())
#: Phrases and their labels. Expressions after identifier tags have no SQL; texts with such a tag are left to
#: the tests, and the given tables hold none.
LICENSES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT rid, doc_id, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM d),
places AS ({_PLACES}),
base AS (SELECT rid, count(*)::BIGINT AS n_base, min(at_word)::BIGINT AS first_word, max(at_word)::BIGINT AS last_word, array_to_string(list_sort(list_distinct(list(label))), ',') AS base_labels FROM places GROUP BY rid),
phrases(phrase, label, weight, k) AS (VALUES {_PHRASE_ROWS}),
named AS (SELECT rid, array_to_string(list_sort(list_distinct(list(label))), ',') AS labels, max(weight) AS score, max(k) FILTER (WHERE k < {len(CLASSES)}) AS k
    FROM w JOIN phrases ON contains(' ' || array_to_string(ws, ' ') || ' ', ' ' || phrase || ' ') GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score,
    CASE WHEN labels IS NULL THEN NULL ELSE [{', '.join(f"'{c}'" for c in CLASSES)}][coalesce(k, 3) + 1] END AS license_class FROM w LEFT JOIN base USING (rid) LEFT JOIN named USING (rid)
"""

#: All pairs of vectors, and what is reachable over their links.
NEAR = r"""
WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM e a JOIN e b ON a.vec_id <> b.vec_id AND len(a.v) = len(b.v) AND list_cosine_similarity(a.v, b.v) >= 0.95),
reach(id, other) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT id, b FROM reach JOIN l ON other = a),
roots AS (SELECT id, min(other) AS component_id FROM reach GROUP BY id), partners AS (SELECT a, count(*)::BIGINT AS n FROM l GROUP BY a)
SELECT id AS vec_id, coalesce(n, 0) AS n_links, component_id, id = component_id AS kept FROM roots LEFT JOIN partners ON id = a
"""

#: CRC-32 of a text of ASCII characters, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({k}, ''), lambda x: ord(x)::BIGINT)), lambda c, b: list_reduce(list_prepend(xor(c, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295)"
_NEXT = "[2, 2, 3, 2]"  # the state after the role that can follow: none, system, user, assistant
_KEPT = "CASE WHEN ini = ['u', 'u', 'a', 'u'][s + 1] THEN c[[2, 2, 3, 2][s + 1] + 1] WHEN ini = 's' AND s = 0 THEN c[2] ELSE 1000000000 END"
#: Damage, faults, least costs from the last row to the first, and edits from the first to the last.
REPAIR = rf"""
WITH RECURSIVE src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_CRC.format(k="(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))")} % 20 AS d FROM conversations),
hurt AS (SELECT coalesce(conv_id, -1) AS conv, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN d = 3 THEN [0, 1] ELSE [0] END) AS again FROM src WHERE d <> 0),
num AS (SELECT *, row_number() OVER (PARTITION BY conv, role, text ORDER BY i) AS nth FROM (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS i, substr(role, 1, 1) AS ini, regexp_replace(text, '{WS}+$', '') AS bare FROM hurt)),
f AS (SELECT *, CASE WHEN bare = '' THEN 'blank' WHEN nth > 1 THEN 'duplicate' WHEN NOT regexp_matches(bare, '[.!?]$') THEN 'truncated' ELSE '' END AS fault, lag(ini) OVER (PARTITION BY conv ORDER BY i) AS before FROM num),
told AS (SELECT conv, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps, (count(*) FILTER (WHERE fault = 'blank'))::BIGINT AS blank, (count(*) FILTER (WHERE fault = 'duplicate'))::BIGINT AS duplicate,
    (count(*) FILTER (WHERE fault = 'truncated'))::BIGINT AS truncated, (count(*) FILTER (WHERE before IS NOT NULL AND before || ini NOT IN ('su', 'ua', 'au')))::BIGINT AS illegal FROM f GROUP BY conv),
back(conv, i, c) AS (SELECT conv, n + 1, [0, 10, 5, 0] FROM told UNION ALL
    SELECT conv, i, [least(b[1], 5 + least(b[3], 5 + b[4])), least(b[2], 5 + least(b[3], 5 + b[4])), least(b[3], 5 + b[4]), least(b[4], 5 + b[3])] FROM (SELECT f.conv, f.i, list_transform([0, 1, 2, 3], lambda s: CASE WHEN fault IN ('blank', 'duplicate') THEN 2 + c[s + 1]
        ELSE least(2 + c[s + 1], CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END + {_KEPT}, CASE WHEN fault = 'truncated' THEN 6 ELSE 1 END + c[{_NEXT}[s + 1] + 1]) END) AS b FROM back JOIN f ON f.conv = back.conv AND f.i = back.i - 1)),
fwd(conv, i, s, audit, done) AS (SELECT conv, 1, 0, '', ''::VARCHAR FROM told UNION ALL
    SELECT conv, CASE WHEN e = 'I' THEN i ELSE i + 1 END, CASE WHEN e = 'D' THEN s WHEN e = 'K' AND ini = 's' THEN 1 ELSE {_NEXT}[s + 1] END, audit || e,
        CASE WHEN e = 'D' THEN done ELSE done || CASE WHEN done = '' THEN '' ELSE chr(10) END || CASE WHEN e = 'K' THEN role ELSE ['user', 'user', 'assistant', 'user'][s + 1] END || ':' || CASE WHEN e = 'I' THEN '' ELSE text END END
    FROM (SELECT w.*, f.role, f.text, f.ini, CASE WHEN f.i IS NULL THEN CASE WHEN s IN (1, 2) THEN 'I' END WHEN 2 + after.c[s + 1] = here.c[s + 1] THEN 'D' WHEN 5 + here.c[{_NEXT}[s + 1] + 1] = here.c[s + 1] THEN 'I'
        WHEN CASE WHEN fault = 'truncated' THEN 5 ELSE 0 END + {_KEPT.replace("c[", "after.c[")} = here.c[s + 1] THEN 'K' ELSE 'R' END AS e
        FROM fwd w LEFT JOIN f ON f.conv = w.conv AND f.i = w.i LEFT JOIN back here ON here.conv = w.conv AND here.i = w.i LEFT JOIN back after ON after.conv = w.conv AND after.i = w.i + 1) WHERE e IS NOT NULL),
ended AS (SELECT w.conv, audit, done FROM fwd w JOIN told ON told.conv = w.conv WHERE w.i = n + 1 AND s IN (0, 3))
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(c[1], 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(done, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN told ON told.conv = coalesce(o.conv_id, -1) LEFT JOIN ended ON ended.conv = told.conv LEFT JOIN back ON back.conv = told.conv AND back.i = 1
"""

ORACLES: dict[str, str] = {"op12_conversation_repair": REPAIR, "op11_embedding_near": NEAR, "op8_licenses": LICENSES, "op1_pii": PII, "op2_quality_rules": QUALITY, "op6_decontamination": LEAKS, "quality_rule_ablation": ABLATION}
