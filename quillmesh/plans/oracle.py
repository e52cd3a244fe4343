"""DuckDB SQL that gives the rows of the catalog's queries."""

from __future__ import annotations

from quillmesh.functions import patterns as P
from quillmesh.operators.gate import DISTRUST, KEEP_TOKENS, NOTHING_FOUND
from quillmesh.plans import corpus as C

#: RE2 has no lookaround; on these texts the boundaries hold by themselves.
RE2 = {
    "EMAIL": (r"[\p{L}\p{N}_.+-]+\s*@\s*[\p{L}\p{N}_-]+(?:\s*\.\s*[\p{L}\p{N}_-]+)+", 0),
    "API_KEY": (r"\b(?:sk-[\w-]{12,}|gh[pousr]_[\w]{20,}|AKIA[0-9A-Z]{16})\b", 0),
    "CARD": (r"(?:^|[^0-9])([0-9](?:[\s-]?[0-9]){12,18})(?:[^0-9]|$)", 1),
    "PHONE": (r"\+?[0-9][0-9\s().-]{8,}[0-9]", 0),
    "CONTRACT_ID": (r"(?i)\b(?:agreement|contract|invoice|case|proposal)\s+([A-Z0-9][A-Z0-9-]{4,})\b", 1),
    "OTHER_SECRET": (r"(?i)\b(?:temporary\s+phrase|access\s+code|password|secret)\s+([A-Z0-9][A-Z0-9-]{7,})\b", 1),
    "PASSPORT": (r"(?i)\bpassport\s*(?:no\.?|number)?\s*([0-9]{4}\s?[0-9]{6})\b", 1),
    "TAX_ID": (r"(?i)\b(?:tax\s*id|tin)\s*[:#-]?\s*([0-9]{12}|[0-9]{10})\b", 1),
}
DIGITS = "regexp_replace({v}, '[^0-9]', '', 'g')"


def luhn(v: str) -> str:
    d = DIGITS.format(v=v)
    digit = f"CAST(substr({d}, length({d}) - i + 1, 1) AS INTEGER)"
    return f"(length({d}) BETWEEN 13 AND 19 AND list_sum(list_transform(range(1, length({d}) + 1), lambda i: CASE WHEN i % 2 = 0 THEN 2 * {digit} - CASE WHEN {digit} > 4 THEN 9 ELSE 0 END ELSE {digit} END)) % 10 = 0)"


def rule(kind: str, source: str, key: str, text: str = "text") -> str:
    """SELECT of key, value and type of one rule's finds in a table's text."""
    pattern, group = RE2[kind]
    keep = {"CARD": luhn("value"), "PHONE": f"length({DIGITS.format(v='value')}) >= 10"}.get(kind, "true")
    return f"SELECT {key}, value, '{kind}' AS type FROM (SELECT {key}, unnest(regexp_extract_all({text}, '{pattern}', {group})) AS value FROM {source}) WHERE {keep}"


PRIORITY = "CASE type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in P.PRIORITY.items()) + f" ELSE {P.LAST_PRIORITY} END"
SEEN = "CASE type " + " ".join(f"WHEN '{r.type}' THEN {i}" for i, r in enumerate(P.RULES)) + " END"


def entities(source: str, key: str, text: str = "text", kinds: tuple[str, ...] = tuple(RE2)) -> str:
    """SELECT of key, value and type: one type for each value."""
    hits = " UNION ALL ".join(rule(k, source, key, text) for k in kinds)
    return f"SELECT {key}, value, type FROM (SELECT *, row_number() OVER (PARTITION BY {key}, value ORDER BY {PRIORITY}, {SEEN}) AS _n FROM ({hits})) WHERE _n = 1"


#: Operations with their entities, spans and tokens. Values don't overlap, so that every occurrence is a span.
BASE = f"""
ops AS ({C.OPS}),
combined AS (SELECT op_id, concat('TASK', chr(10), task, chr(10), 'DOCUMENT', chr(10), text) AS text FROM ops),
ents AS ({entities("combined", "op_id")}),
fields AS (SELECT op_id, 'task' AS field, 0 AS field_pos, task AS text FROM ops UNION ALL SELECT op_id, 'text', 1, text FROM ops),
parts AS (
  SELECT f.op_id, f.field, f.field_pos, e.value, e.type, string_split(f.text, e.value) AS p
  FROM fields AS f JOIN ents AS e ON f.op_id = e.op_id WHERE contains(f.text, e.value)),
starts AS (
  SELECT op_id, field, field_pos, value, type,
    unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(value))) AS s
  FROM parts),
spans AS (SELECT op_id, field, field_pos, value, type, s::INTEGER AS start_, (s + length(value))::INTEGER AS end_ FROM starts),
nonces AS (SELECT op_id, upper(left(sha256(concat('{C.SALT}', op_id)), 32)) AS nonce FROM ops)
"""
OPAQUE = BASE + f""",
tokened AS (
  SELECT s.*, concat('{P.TOKEN_PREFIX}', n.nonce, '_', lpad((row_number() OVER (PARTITION BY s.op_id ORDER BY field_pos, start_))::VARCHAR, 4, '0'), '__') AS token
  FROM spans AS s JOIN nonces AS n ON s.op_id = n.op_id)
"""
TYPED = BASE + f""",
used AS (SELECT DISTINCT op_id, value, type FROM spans),
numbered AS (SELECT *, row_number() OVER (PARTITION BY op_id, type ORDER BY length(value) DESC, value) AS k FROM used),
tokened AS (
  SELECT s.*, concat('{P.TOKEN_PREFIX}', n.nonce, '_', s.type, '_', lpad(u.k::VARCHAR, 4, '0'), '__') AS token
  FROM spans AS s JOIN nonces AS n ON s.op_id = n.op_id JOIN numbered AS u ON u.op_id = s.op_id AND u.value = s.value AND u.type = s.type)
"""
SPLICED = """,
pieces AS (
  SELECT t.op_id, t.field, start_, substr(f.text, coalesce(lag(end_) OVER w, 0) + 1, start_ - coalesce(lag(end_) OVER w, 0)) || token AS piece,
    last_value(end_) OVER (PARTITION BY t.op_id, t.field ORDER BY start_ ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_end
  FROM tokened AS t JOIN fields AS f ON t.op_id = f.op_id AND t.field = f.field WINDOW w AS (PARTITION BY t.op_id, t.field ORDER BY start_)),
joined AS (SELECT op_id, field, string_agg(piece, '' ORDER BY start_) AS head, max(last_end) AS last_end FROM pieces GROUP BY ALL),
sanitized AS (
  SELECT f.op_id, f.field, f.field_pos, coalesce(j.head || substr(f.text, j.last_end + 1), f.text) AS text
  FROM fields AS f LEFT JOIN joined AS j ON f.op_id = j.op_id AND f.field = j.field)
"""
#: Documents with their finds replaced, as the flagship query does it.
FLAGSHIP = f"""
WITH ents AS ({entities("documents", "doc_id", kinds=("EMAIL", "CARD", "PHONE"))}),
parts AS (SELECT d.doc_id, d.text, e.value, e.type, string_split(d.text, e.value) AS p FROM documents AS d JOIN ents AS e ON d.doc_id = e.doc_id),
starts AS (
  SELECT doc_id, text, value, unnest(list_transform(range(1, len(p)), lambda i: list_sum(list_transform(p[1:i], lambda x: length(x))) + (i - 1) * length(value)))::BIGINT AS s FROM parts),
apart AS (
  SELECT * FROM starts AS a WHERE NOT EXISTS (
    SELECT 1 FROM starts AS b WHERE b.doc_id = a.doc_id AND length(b.value) > length(a.value) AND a.s < b.s + length(b.value) AND a.s + length(a.value) > b.s)),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY s) AS k, lag(s + length(value), 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM apart),
named AS (SELECT *, concat('{P.TOKEN_PREFIX}', upper(left(sha256(concat('{C.SALT}', doc_id)), 32)), '_', lpad(k::VARCHAR, 4, '0'), '__') AS token FROM numbered),
done AS (
  SELECT doc_id, string_agg(concat(substr(text, before + 1, s - before), token), '' ORDER BY s) AS head, max(s + length(value)) AS last_end, count(*) AS n FROM named GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN regexp_matches(d.text, '^\\s*$') THEN 'empty_input' WHEN t.n IS NULL THEN 'BLOCKED' ELSE 'READY_FOR_REVIEW' END AS status,
  coalesce(t.head || substr(d.text, t.last_end + 1), d.text) AS sanitized_text, coalesce(t.n, 0)::INTEGER AS n_tokens,
  CASE WHEN t.n IS NULL THEN '{NOTHING_FOUND.replace("'", "''")}' ELSE '' END AS reasons
FROM documents AS d LEFT JOIN done AS t ON d.doc_id = t.doc_id
"""
ACTUAL = f"ops AS ({C.OPS}), actual AS (SELECT op_id AS case_id, value, type FROM ({entities('ops', 'op_id')})), expected AS ({C.EXPECTED})"
PAIRS = ACTUAL + """,
pairs AS (
  SELECT case_id, value, type, max(e) AS e, max(a) AS a, max(e) * max(a) AS h FROM (
    SELECT case_id, value, type, 1 AS e, 0 AS a FROM expected UNION ALL SELECT case_id, value, type, 0, 1 FROM actual) GROUP BY ALL)
"""
SUMS = "coalesce(sum(e), 0)::BIGINT AS expected, coalesce(sum(a), 0)::BIGINT AS predicted, coalesce(sum(h), 0)::BIGINT AS true_positives"
TYPES = "(SELECT unnest([" + ", ".join(f"'{t}'" for t in P.ENTITY_TYPES) + "]) AS type)"


def ratio(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN round_even(({part})::DOUBLE / ({whole})::DOUBLE, 4) END"


METRICS = f"*, greatest(0, predicted - true_positives) AS false_positives, greatest(0, expected - true_positives) AS false_negatives, {ratio('true_positives', 'predicted')} AS \"precision\", {ratio('true_positives', 'expected')} AS recall"


def wilson(s: str, n: str, low: bool) -> str:
    z2 = 1.959963984540054 * 1.959963984540054
    p, n = f"({s}::DOUBLE / {n}::DOUBLE)", f"{n}::DOUBLE"
    body = f"({p} + {z2!r} / (2 * {n}) {'-' if low else '+'} 1.959963984540054::DOUBLE * sqrt(({p} * (1 - {p}) + {z2!r} / (4 * {n})) / {n})) / (1 + {z2!r} / {n})"
    return f"CASE WHEN {n} > 0 THEN round_even({'greatest(0.0::DOUBLE' if low else 'least(1.0::DOUBLE'}, {body}), 4) END"


def hmac(key: bytes, message: str) -> str:
    padded = key.ljust(64, b"\0")
    inner, outer = (bytes(b ^ x for b in padded).hex() for x in (0x36, 0x5C))
    return f"sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({message}))))"


def trust(text: str) -> str:
    codes = [f"CASE WHEN regexp_matches({text}, '{P.trust_pattern(v, o, '(?is)')}') THEN '{code}' END" for code, v, o in P.TRUST]
    return f"array_to_string(list_filter([{', '.join(codes)}], lambda w: w IS NOT NULL), ',')"


ANSWER = "concat('Done: ', coalesce(string_agg(CASE WHEN t.op_id % 3 = 0 AND start_ = 0 THEN '' ELSE token END, ' ' ORDER BY field_pos, start_), ''), CASE WHEN t.op_id % 9 = 1 THEN ' " + P.TOKEN_PREFIX + "00000000_0001__' WHEN t.op_id % 9 = 2 THEN concat(' ', min(token)) ELSE '' END)"
HEAD = f"{KEEP_TOKENS}\n{DISTRUST}\n\n<task>\n".replace("'", "''").replace("\n", "' || chr(10) || '")
NOTHING = NOTHING_FOUND.replace("'", "''")
