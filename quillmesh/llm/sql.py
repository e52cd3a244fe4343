"""DuckDB SQL that gives the rows of the registered queries."""

from __future__ import annotations

from quillmesh.llm.sharding import ROUND_KEYS


def _mix(x: str, key: int) -> str:
    z1 = f"((({x}) * 2654435769 + {key}) % 4294967296)"
    z2 = f"((xor({z1}, {z1} >> 15) * 1103515245) % 4294967296)"
    return f"xor({z2}, {z2} >> 13)"


def _feistel(x: str, source: str) -> str:
    """SELECT of doc_id, n, a, b and the network's result p from rows of source that hold x."""
    inner = f"SELECT doc_id, n, a, b, ({x}) % a AS l, ({x}) // a AS r FROM {source}"
    for key in ROUND_KEYS:
        inner = f"SELECT doc_id, n, a, b, (l + {_mix('r', key)}) % a AS l, r FROM ({inner})"
        inner = f"SELECT doc_id, n, a, b, l, (r + {_mix('l', key + 40503)}) % b AS r FROM ({inner})"
    return f"SELECT doc_id, n, a, b, l + r * a AS p FROM ({inner})"


SHARDING = f"""
WITH RECURSIVE crc_table AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce(list_prepend(i, range(0, 8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c
    FROM range(0, 256) AS r(i))),
sized AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
    xor(4294967295, list_reduce(
      list_prepend(4294967295::BIGINT, list_transform(range(0, octet_length(encode(coalesce(text, '')))::BIGINT),
        lambda i: ('0x' || substr(hex(encode(coalesce(text, ''))), i * 2 + 1, 2))::BIGINT)),
      lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) AS text_crc32
  FROM documents, crc_table),
counted AS (SELECT count(*) AS n, greatest(1, ceil(sqrt(count(*)))::BIGINT) AS a FROM documents),
rows_ AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS x, n, a, (n + a - 1) // a AS b FROM documents, counted),
walk AS (
  {_feistel("x", "rows_")}
  UNION ALL
  {_feistel("p", "(SELECT * FROM walk WHERE p >= n)")})
SELECT s.doc_id, s.size::BIGINT AS size, s.text_crc32::BIGINT AS text_crc32, 'rows' AS law,
  (p % 24)::INTEGER AS shard, p // 24 AS slot, NULL::INTEGER AS grown_shard
FROM sized AS s JOIN walk AS w ON s.doc_id = w.doc_id AND w.p < w.n
"""
