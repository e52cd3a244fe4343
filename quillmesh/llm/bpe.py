"""Byte-level BPE with DuckDB recursive queries.

Texts are cut by the tokenizer's pattern; each match is encoded by itself. A match that is a token is that token. The others
go, once for each distinct match, through a recursive query: rows of (word, position, token), which start as single bytes, join the
merge table with their right neighbour; each step contracts each word's leftmost pair of minimum rank, until none is left. Words of
``LONG`` bytes and more contract, in each step, all pairs that have the minimum rank within reach of any token, which gives the same ids
in steps whose number does not grow with the word (see ``_encode_long``). Decoding takes the ids of whole documents, joins them with the
vocabulary and aggregates their bytes in the order of position.

Encoded matches are kept for the task's later batches (a bounded number, the least recently used go). The vocabulary's file is a
parameter; driver and executors need a path that all of them can read, as with the tokenizer libraries themselves. Null and
empty texts have no ids; equal texts get equal results; an empty table gives no rows; more columns of the input are left alone.
"""

from __future__ import annotations

import base64
import functools
import hashlib
from collections.abc import Iterable, Iterator

import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import holds

#: A match's ids as decimal text.
Entry = bytes

#: A place is a word's number and a position in it, so that one order by a number serves all words.
ENCODE = """
WITH RECURSIVE steps AS (
  SELECT (word << 32) | pos AS place, token, true AS more FROM bytes_
  UNION ALL
  (WITH pairs AS (
    SELECT place, token, lead(token) OVER w AS after, lead(place) OVER w AS next_, lag(place) OVER w AS before
    FROM steps WHERE more WINDOW w AS (ORDER BY place)),
  best AS (
    SELECT p.place >> 32 AS word, min((m.rank << 32) | (p.place & 4294967295)) AS key
    FROM pairs AS p JOIN merges AS m ON m.left_ = p.token AND m.right_ = p.after WHERE p.next_ >> 32 = p.place >> 32 GROUP BY ALL)
  SELECT p.place, CASE WHEN p.place & 4294967295 = b.key & 4294967295 THEN b.key >> 32 ELSE p.token END AS token, b.key IS NOT NULL AS more
  FROM pairs AS p LEFT JOIN best AS b ON p.place >> 32 = b.word
  WHERE b.key IS NULL OR p.before IS NULL OR p.before <> ((b.word << 32) | (b.key & 4294967295)))
)
SELECT place >> 32 AS word, place & 4294967295 AS pos, token FROM steps WHERE NOT more
"""

JOINED = """
SELECT word, string_agg(CAST(token AS VARCHAR), ',' ORDER BY pos) AS ids FROM ids GROUP BY word
"""

#: Bytes are written as the characters U+0000 to U+00FF.
DECODE = """
SELECT i.word, string_agg(v.piece, '' ORDER BY i.pos) AS piece
FROM ids AS i JOIN vocabulary AS v ON v.token = i.token GROUP BY i.word
"""

#: One step over a long word: of each run of equal neighbouring pairs, every second one from the run's start on, as far as
#: all have the minimum rank within reach.
STEP = """
WITH pairs AS (
  SELECT pos, token, lead(token) OVER (ORDER BY pos) AS after, row_number() OVER (ORDER BY pos) AS i FROM long_),
ranked AS (SELECT p.*, m.rank FROM pairs AS p LEFT JOIN merges AS m ON m.left_ = p.token AND m.right_ = p.after),
near AS (
  SELECT *, min(rank) OVER (ORDER BY pos RANGE BETWEEN {reach} PRECEDING AND {reach} FOLLOWING) AS least,
    i - row_number() OVER (PARTITION BY rank ORDER BY i) AS run FROM ranked),
chosen AS (
  SELECT *, rank IS NOT NULL AND row_number() OVER w % 2 = 1 AND bool_and(rank = least) OVER w AS go FROM near
  WINDOW w AS (PARTITION BY rank, run ORDER BY i ROWS UNBOUNDED PRECEDING)),
told AS (SELECT *, lag(go) OVER (ORDER BY i) AS gone FROM chosen)
SELECT pos, CASE WHEN go THEN rank ELSE token END AS token, rank <= greatest(token, after) AS odd, go FROM told WHERE gone IS NOT TRUE
"""
LONG = 1024


class Codec:
    """Encoder and decoder of one vocabulary in one process."""

    def __init__(self, path: str, pattern: str, keep: int = 600_000, rows: int = 1 << 18):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.pattern = regex.compile(pattern)
        self.keep, self.rows = keep, rows
        self.recent: dict[str, Entry] = {}
        self.older: dict[str, Entry] = {}
        self.single = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        # Nothing is spilled to a folder of the machine; what a query holds is bounded by rows and TEXTS.
        self.con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB", "temp_directory": ""})
        self.longest = max(map(len, self.ranks))
        merges = [(self.ranks[t[:i]], self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        left, right, rank = (pa.array(x, pa.int64()) for x in zip(*merges, strict=True))
        self._table("merges", pa.table({"left_": left, "right_": right, "rank": rank}))
        self._table("vocabulary", pa.table({"token": pa.array(list(self.ranks.values()), pa.int64()), "piece": [t.decode("latin-1") for t in self.ranks]}))

    def _table(self, name: str, rows: pa.Table) -> None:
        self.con.register("given", rows)
        self.con.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.con.unregister("given")

    def _encode(self, words: list[str]) -> list[Entry]:
        data = [w.encode() for w in words]
        sizes = np.array([len(d) for d in data])
        word = np.repeat(np.arange(len(data)), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        token = self.single[np.frombuffer(b"".join(data), np.uint8)]
        self._table("bytes_", pa.table({"word": word, "pos": pos, "token": token}))
        self.con.execute(f"CREATE OR REPLACE TABLE ids AS {ENCODE}")
        found: list[Entry] = [b""] * len(words)
        for i, ids in self.con.execute(JOINED).fetchall():
            found[i] = ids.encode()
        return found

    def _encode_long(self, word: str) -> Entry:
        """Ids of a long word.

        A pair of the least rank among all that start within three longest tokens of it is contracted before anything that could
        change its tokens: what overlaps it later must be built, within one token's length, by pairs of lower rank. This
        holds as long as no pair ranks below its own parts; a word in which one does goes the way of short ones.
        """
        data = word.encode()
        self._table("long_", pa.table({"pos": np.arange(len(data)), "token": self.single[np.frombuffer(data, np.uint8)]}))
        step = STEP.format(reach=3 * self.longest)
        while True:
            self.con.execute(f"CREATE OR REPLACE TABLE stepped AS {step}")
            odd, going = self.con.execute("SELECT coalesce(bool_or(odd), false), coalesce(bool_or(go), false) FROM stepped").fetchall()[0]
            if odd:
                return self._encode([word])[0]
            if not going:
                break
            self.con.execute("CREATE OR REPLACE TABLE long_ AS SELECT pos, token FROM stepped")
        return self.con.execute("SELECT string_agg(CAST(token AS VARCHAR), ',' ORDER BY pos) FROM long_").fetchall()[0][0].encode()

    def learn(self, words: Iterable[str]) -> dict[str, Entry]:
        """Entries of all these words."""
        out: dict[str, Entry] = {}
        hard: list[str] = []
        for w in words:
            entry = self.recent.get(w) or self.older.get(w)
            if entry is None:
                data = w.encode()
                rank = self.ranks.get(data)
                if rank is None and len(data) >= LONG:
                    entry = self._encode_long(w)
                elif rank is None:
                    hard.append(w)
                    continue
                else:
                    entry = b"%d" % rank
            out[w] = entry
        start = size = 0
        for i, w in enumerate(hard):
            size += len(w.encode())
            if size >= self.rows or i == len(hard) - 1:
                out.update(zip(hard[start : i + 1], self._encode(hard[start : i + 1]), strict=True))
                start, size = i + 1, 0
        self.recent.update(out)
        if len(self.recent) > self.keep:
            self.older, self.recent = self.recent if len(self.recent) <= 3 * self.keep else {}, {}
        return out

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes that each list of ids stands for."""
        sizes = np.array([len(x) for x in ids])
        word = np.repeat(np.arange(len(ids)), sizes)
        pos = np.arange(len(word)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._table("ids", pa.table({"word": word, "pos": pos, "token": np.concatenate([np.empty(0, np.int64), *ids])}))
        found = [b""] * len(ids)
        for i, piece in self.con.execute(DECODE).fetchall():
            found[i] = piece.encode("latin-1")
        return found

    def matches(self, text: str) -> list[str]:
        return self.pattern.findall(text)


@functools.lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


SCHEMA = "doc_id long, ids array<int>, decoded binary"
DIGESTS = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
TEXTS, SIZE = 512, 2 << 20


def _groups(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    """Some documents at a time: with very long texts, fewer."""
    ids, texts, size = [], [], 0
    for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        ids.append(doc_id)
        texts.append(text or "")
        size += len(texts[-1])
        if len(ids) >= TEXTS or size > SIZE:
            yield ids, texts
            ids, texts, size = [], [], 0
    if ids:
        yield ids, texts


def _each(path: str, pattern: str, finish, schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds(__name__, codec.cache_clear)
        own = codec(path, pattern)
        for batch in batches:
            for ids, texts in _groups(batch):
                cut = [own.matches(t) for t in texts]
                known = own.learn(set().union(*cut))
                joined = [b",".join([known[w] for w in words]) for words in cut]
                numbers = [np.fromstring(x, np.int64, sep=",") if x else np.empty(0, np.int64) for x in joined]
                rows = [finish(doc_id, x, n, back) for doc_id, x, n, back in zip(ids, joined, numbers, own.decode(numbers), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def encode(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids and decoded (the bytes that the ids stand for) of each document."""

    def finish(doc_id: int | None, joined: bytes, ids: np.ndarray, decoded: bytes) -> tuple:
        return doc_id, ids.tolist(), decoded

    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.binary())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_each(path, pattern, finish, schema), SCHEMA)


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """What ``encode`` gives, as a count and checksums."""

    def finish(doc_id: int | None, joined: bytes, ids: np.ndarray, decoded: bytes) -> tuple:
        return doc_id, len(ids), hashlib.sha256(joined).hexdigest(), hashlib.sha256(decoded).hexdigest()

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_each(path, pattern, finish, schema), DIGESTS)
