"""Packing of tokenized documents into sequences of fixed length.

Documents are tokenized and, if longer than a sequence, cut into pieces. Only the histogram of piece lengths (as many bins as a
sequence has tokens) goes to the driver. There, patterns of up to four coarse lengths that fill a sequence are enumerated, their
repeat counts are fitted to the histogram by non-negative least squares and rounded, and each pattern is realised with exact
lengths, the last of them the piece that fits best. What the patterns leave over is packed by best fit, longest first. The plan
is a list of (lengths, repeats) whose size depends on the sequence length alone. Each piece then finds its sequence
and offset from its rank among the pieces of its length; ranks come from counts by (bucket, length), so that no length, however
frequent, meets in one task.

Null and empty texts give the end token alone; equal rows get places of their own; an empty table gives no rows; more
columns of the input are left alone. Texts are tokenized whole.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmesh.llm.common import checkpoint, give_back, holds, partitions

COARSE, PARTS = 128, 4
KEEP = 1_000_000  # chunks whose ids a worker keeps
Plan = list[tuple[tuple[int, ...], int]]


class Encoder:
    """Token ids of texts, by white-space separated chunks, whose ids are kept (a bounded number; then it starts anew).

    The tokenizer drops white space and never joins what it separates, and special tokens hold none, so a text's ids are those of its chunks in order. New chunks
    are encoded many at a time, joined by spaces, and told apart by the tokens that end words, or by offsets.
    """

    def __init__(self, path: str, keep: int = KEEP, joined: int = 128):
        self.tokenizer = Tokenizer.from_file(path)
        self.keep, self.joined = keep, joined
        self.known: dict[bytes, bytes] = {}
        #: Ids of marks that often end a chunk.
        self.marks = {ord(m): np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in ".,;:!?"}
        #: Whether a token ends a word.
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def _plain(self, chunks: list[bytes], texts: list[str]) -> None:
        """Chunks of letters alone: a word each, whose ids are told apart by the tokens that end words."""
        groups = range(0, len(chunks), self.joined)
        found = self.tokenizer.encode_batch_fast([" ".join(texts[at : at + self.joined]) for at in groups], add_special_tokens=False)
        for at, e in zip(groups, found, strict=True):
            part = chunks[at : at + self.joined]
            ids = np.array(e.ids, "<u4")
            last = np.flatnonzero(self.ends[ids])
            if len(last) != len(part):  # normalisation has made more words of some chunk
                self._by_offsets(part, texts[at : at + self.joined])
                continue
            edges = ((last + 1) * 4).tolist()
            data = ids.tobytes()
            self.known.update((c, data[s:t]) for c, s, t in zip(part, [0, *edges[:-1]], edges, strict=True))

    def _by_offsets(self, chunks: list[bytes], texts: list[str]) -> None:
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begin = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        starts = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
        edges = (np.searchsorted(starts, begin) * 4).tolist()
        data = np.array(found.ids, "<u4").tobytes()
        if (starts[1:] < starts[:-1]).any():  # offsets that don't tell the chunks apart
            self.known.update((c, np.array(self.tokenizer.encode(t, add_special_tokens=False).ids, "<u4").tobytes()) for c, t in zip(chunks, texts, strict=True))
        else:
            self.known.update((c, data[s:e]) for c, s, e in zip(chunks, edges, [*edges[1:], len(data)], strict=True))

    def learn(self, chunks: list[bytes]) -> None:
        """Takes in new chunks. A mark after a letter is a word of its own, so that only what stands before it has to be known."""
        stems = [c[:-1] if c[-1] in self.marks and c[-2:-1].isalpha() else c for c in chunks]
        new = list({c for c in stems if c not in self.known})
        texts = [c.decode() for c in new]
        plain = [i for i, t in enumerate(texts) if t.isalpha()]
        if plain:
            self._plain([new[i] for i in plain], [texts[i] for i in plain])
        other = [i for i, t in enumerate(texts) if not t.isalpha()]
        for at in range(0, len(other), self.joined):
            part = other[at : at + self.joined]
            self._by_offsets([new[i] for i in part], [texts[i] for i in part])
        known, marks = self.known, self.marks
        known.update([(c, known[t] + marks[c[-1]]) for c, t in zip(chunks, stems, strict=True) if c is not t])

    def small(self, text: bytes) -> bytes:
        """The text with A-Z in small letters, as the tokenizer writes them itself, so that more chunks are known.

        Left alone are texts that may hold special tokens, which are found before, and combining marks U+0300 to U+036F, which are
        composed before.
        """
        return text if b"<|" in text or b"\xcc" in text or b"\xcd" in text else text.lower()

    def encode(self, texts: list[bytes | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, given as UTF-8."""
        if len(self.known) > self.keep:
            self.known.clear()
        get = self.known.get
        out: list[list[bytes | None]] = []
        open_: list[tuple[list[bytes | None], list[bytes], list[int]]] = []
        for text in texts:
            words = self.small(text).split() if text else []
            parts = [get(w) for w in words]
            out.append(parts)
            if None in parts:
                open_.append((parts, words, [i for i, p in enumerate(parts) if p is None]))
        self.learn(list({words[i] for _, words, at in open_ for i in at}))
        for parts, words, at in open_:
            for i in at:
                parts[i] = get(words[i])
        return [b"".join(parts) for parts in out]


@functools.lru_cache(maxsize=2)
def encoder(path: str, keep: int = KEEP) -> Encoder:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
    return Encoder(path, keep)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, room: int = 2048, end: int = 0, with_ids: bool = False, keep: int = KEEP) -> DataFrame:
    """A row for each piece; with_ids adds the ids themselves; keep bounds the chunks that a worker keeps, and so its memory."""
    tail = np.array([end], "<u4").tobytes()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int32()))] if with_ids else []))

    def rows(ids: list[int | None], texts: list[bytes | None]) -> Iterator[tuple]:
        for doc_id, data in zip(ids, encoder(path, keep).encode(texts), strict=True):
            data += tail
            for i, at in enumerate(range(0, len(data), 4 * room)):
                part = data[at : at + 4 * room]
                row = (doc_id, i, i * room, len(part) // 4, zlib.crc32(part))
                yield (*row, np.frombuffer(part, "<u4").tolist()) if with_ids else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds(__name__, encoder.cache_clear)
        for b in batches:
            for at in range(0, b.num_rows, 512):
                part = b.slice(at, 512)
                found = list(rows(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist()))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), schema, strict=True)], schema=schema)
        give_back()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, PIECES + (", ids array<int>" if with_ids else ""))


def patterns(size: int = COARSE, parts: int = PARTS) -> np.ndarray:
    """All multisets of up to so many lengths that add up to size: a row of descending lengths, 0 where there are fewer."""
    out = []

    def grow(chosen: list[int], left: int, most: int) -> None:
        if left == 0:
            out.append(chosen + [0] * (parts - len(chosen)))
        elif len(chosen) < parts:
            for x in range(min(most, left), 0, -1):
                if x * (parts - len(chosen)) < left:
                    break
                grow([*chosen, x], left - x, x)

    grow([], size, size)
    return np.array(out)


def fit(rows: np.ndarray, target: np.ndarray, weight: np.ndarray, rounds: int = 400) -> np.ndarray:
    """Repeat counts x >= 0 of patterns that minimise |weight * (made(x) - target)|, by the active-set method of Lawson and Hanson."""
    a = np.zeros((len(rows), len(target)))
    np.add.at(a, (np.repeat(np.arange(len(rows)), rows.shape[1]), rows.ravel()), 1.0)
    a[:, 0] = 0
    a *= weight
    b = weight * target
    x, active = np.zeros(len(rows)), []
    enough = 1e-6 * max(float(np.abs(b).max(initial=0)), 1.0)
    for _ in range(rounds):
        gradient = a @ (b - x[active] @ a[active])
        gradient[active] = -np.inf
        best = int(gradient.argmax())
        if gradient[best] <= enough:
            break
        active.append(best)
        while active:
            own = a[active]
            solved = np.linalg.solve(own @ own.T + 1e-9 * np.eye(len(active)), own @ b)
            if (solved > 0).all():
                x[active] = solved
                break
            now = x[active]
            falling = solved <= 0
            step = np.min(now[falling] / np.maximum(now[falling] - solved[falling], 1e-300))
            now = now + step * (solved - now)
            keep = (now > 1e-9) & ~(falling & (now <= 1e-9))
            x[active] = 0
            active = [i for i, k in zip(active, keep, strict=True) if k]
            x[active] = now[keep]
    return x


def plan(counts: np.ndarray, room: int = 2048) -> Plan:
    """Sequences, as (lengths, repeats), that hold counts[n] pieces of each length n <= room."""
    left = counts.astype(np.int64).copy()
    out: Plan = []
    coarse = max(1, room // COARSE)
    size = room // coarse

    def longest(most: int, least: int, used: list[int]) -> int:
        """The longest length of which there is one more, 0 if there is none."""
        there = np.flatnonzero(left[least : most + 1])[::-1] + least
        for n in there.tolist():
            if left[n] > used.count(n):
                return n
        return 0

    def fill(lengths: list[int]) -> list[int]:
        free = room - sum(lengths)
        while free and (n := longest(free, 1, lengths)):
            lengths.append(n)
            free -= n
        return lengths

    def place(lengths: list[int], most: int) -> int:
        kinds, uses = np.unique(lengths, return_counts=True)
        times = int(min(most, (left[kinds] // uses).min()))
        left[kinds] -= uses * times
        out.append((tuple(lengths), times))
        return times

    if left[room]:
        place([room], int(left[room]))
    if left.sum():
        rows = patterns(size)
        binned = np.zeros(size + 1)
        np.add.at(binned, -(-np.arange(room + 1) // coarse), left)
        # Short pieces fit anywhere, so that missing them counts for less.
        weight = np.sqrt(np.arange(size + 1) / size)
        repeats = np.rint(fit(rows, binned, weight)).astype(np.int64)
        for i in np.flatnonzero(repeats):
            todo = int(repeats[i])
            while todo:
                chosen: list[int] = []
                for part in rows[i][rows[i] > 0][:-1].tolist():
                    if not (n := longest(min(part * coarse, room - sum(chosen)), (part - 1) * coarse + 1, chosen)):
                        break
                    chosen.append(n)
                # The last part is what fits best; a sequence that stays short of full is left to the residuals.
                if len(chosen) < (rows[i] > 0).sum() - 1 or sum(fill(chosen)) < room:
                    break
                todo -= place(chosen, todo)
    while left.any():
        place(fill([int(np.flatnonzero(left)[-1])]), int(left.sum()))
    return out


def slots(found: Plan) -> dict[str, np.ndarray]:
    """For each length, runs of ranks from ``rank`` on that lie in consecutive sequences from ``sequence`` on, at ``offset``."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for lengths, times in found:
        offset = 0
        for n in lengths:
            rows.append((n, used.get(n, 0), base, offset))
            used[n] = used.get(n, 0) + times
            offset += n
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return dict(zip(("length", "rank", "sequence", "offset"), table.T, strict=True))


def bucketed(rows: DataFrame) -> DataFrame:
    """rows dealt evenly to as many buckets as a shuffle has tasks."""
    n = partitions(rows.sparkSession)
    return rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(n)))


def ranked(held: DataFrame) -> DataFrame:
    """Bucketed rows with the rank (from 0) of each among those of its length."""
    counts = held.groupBy("_bucket", "length").agg(F.count(F.lit(1)).alias("_n"))
    before = counts.withColumn("_before", F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n"))
    local = F.row_number().over(Window.partitionBy("_bucket", "length").orderBy("doc_id", "piece", "ids_crc32"))
    return held.withColumn("_local", local).join(before.drop("_n"), ["_bucket", "length"]).withColumn("rank", F.col("_before") + F.col("_local") - 1).drop("_bucket", "_before", "_local")


def pack(docs: DataFrame, path: str, room: int = 2048, end: int = 0, with_ids: bool = False, keep: int = KEEP) -> DataFrame:
    """Pieces with sequence_id and offset."""
    held = checkpoint(bucketed(pieces(docs, path, room, end, with_ids, keep)))
    rows = ranked(held)
    counts = np.zeros(room + 1, np.int64)
    for n, c in held.groupBy("length").count().collect():  # a row for each length
        counts[n] = c
    shared = docs.sparkSession.sparkContext.broadcast(slots(plan(counts, room)))
    names = [c for c in rows.columns if c != "rank"]
    schema = rows.select(*names).schema.add("sequence_id", "long").add("offset", "long")
    step = 1 << 40

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds(f"{__name__}.pack")  # all texts are encoded by now
        table = shared.value
        keys = table["length"] * step + table["rank"]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy()
            at = np.searchsorted(keys, length * step + rank, side="right") - 1
            sequence = table["sequence"][at] + rank - table["rank"][at]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(sequence), pa.array(table["offset"][at])], names=[*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, schema)
