"""Removal of repeated byte strings by suffix arrays.

A byte goes if it is covered by a string of ``length`` bytes that also starts earlier: in a document of smaller doc_id, or further
up in the same one. Strings are judged on the input, overlaps count, and no match crosses documents.

1. Documents are gathered into shards of bounded size, in the order of doc_id. In each run of start positions an anchor is chosen, the least
   of the hashed 8-grams in the first ``window`` bytes of the string, so that equal strings have their anchor at the same place.
   Shards send a hash of what follows each anchor to the bucket of that hash; buckets tell them which are found twice. All other
   start positions are done with: their strings are unique.
2. Each shard builds a suffix array over its remaining regions. Larsson-Sadakane refinement in numpy doubles the depth by which groups are
   ordered, sorting only groups that are not yet single, until suffixes are ordered by their first ``length`` bytes. Kasai's
   algorithm, in step over blocks of positions, gives common prefixes; runs of them of at least ``length`` are equal strings,
   of which all but the earliest are marked.
3. The earliest ones whose anchor is also found in another shard go, as short segments of text, to the anchor's bucket. There the
   strings of all shards form one ordered index, in which each shard's strings are found by binary search (on 64-bit keys; equal keys are
   compared byte by byte), and all but the earliest are marked.
4. Marks go back to the shards, which cut what they cover.

A string that a third of all documents share is one entry of each shard in steps 1 and 3, whatever its number of copies.

Null and empty texts have nothing to remove. Rows with equal doc_id are ordered by shard and place, and of their equal strings the first stays;
rows without doc_id come first; an empty table gives no rows; more columns of the input are left alone. A document is treated as a
whole, so a task's memory follows the longest document where that exceeds a shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillmesh.llm.common import checkpoint, holds, pack, partitions, unpack

LENGTH, WINDOW = 100, 60
CONTEXT = LENGTH - WINDOW + 1
SHARD_BYTES, SHARD_DOCS = 3 << 19, 50_000
#: Buckets of segments for each task, which treats one after another.
FINER = 6
FIRST = -(1 << 63)  # stands for a missing doc_id
PAD = bytes(256)
PLACE_BITS = 20


def eights(data: bytes, n: int) -> np.ndarray:
    """The 8 bytes at each of n positions, the first byte lowest; data has room for them."""
    out = np.empty(n, np.uint64)
    for o in range(8):
        m = len(range(o, n, 8))
        out[o::8] = np.frombuffer(data, "<u8", m, o)
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x


def anchored(data: bytes, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that follow each other in data: for each anchor its position, its first and last start position and a hash of its context.

    Start positions are those of strings that end within their document; each belongs to one anchor.
    """
    n = int(lengths.sum())
    if n < LENGTH:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    words = eights(data + PAD, n + 64)
    chosen = []
    step = (1 << PLACE_BITS) - 2 * WINDOW
    for begin in range(0, n, step):  # a place in the block fits the low bits
        own = words[begin : min(begin + step + WINDOW, n + WINDOW)]
        key = (mixed(own) & np.uint64(~((1 << PLACE_BITS) - 1) & (1 << 64) - 1)) | np.arange(len(own), dtype=np.uint64)
        span, low = 1, key
        while 2 * span <= WINDOW:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        low = np.minimum(low[: len(low) - (WINDOW - span)], low[WINDOW - span :])
        chosen.append((low[: min(step, n - begin)] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64) + begin)
    anchor = np.concatenate(chosen)
    ends = np.cumsum(lengths)
    keep = np.ones(len(anchor), bool)
    tail = np.repeat(ends, np.minimum(lengths, LENGTH - 1))  # the last starts of each document are none
    keep[tail - 1 - (np.arange(len(tail)) - np.repeat(np.cumsum(np.minimum(lengths, LENGTH - 1)) - np.minimum(lengths, LENGTH - 1), np.minimum(lengths, LENGTH - 1)))] = False
    starts = np.flatnonzero(keep)
    if not len(starts):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, np.uint64),)
    at = anchor[starts]
    edge = np.flatnonzero((np.diff(at) != 0) | (np.diff(starts) != 1)) + 1
    first, last = starts[np.concatenate([[0], edge])], starts[np.concatenate([edge - 1, [len(starts) - 1]])]
    x = at[np.concatenate([[0], edge])]
    h = np.zeros(len(x), np.uint64)
    for o in range(0, CONTEXT - 8, 8):
        h = mixed(h ^ words[x + o])
    h = mixed(h ^ words[x + CONTEXT - 8])
    return x, first, last, h ^ (h >> np.uint64(29))


NAMES = ("shard", "bucket", "blob")
TYPES = [pa.int64(), pa.int32(), pa.binary()]
SCHEMA = "shard long, bucket int, blob binary"
SHARDS = "shard long, docs array<struct<doc_id:long,length:long>>, blob binary, rest binary"


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), TYPES, strict=True)], names=list(NAMES))


def _by_bucket(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in range(buckets):
        if edges[b] < edges[b + 1]:
            yield b, order[edges[b] : edges[b + 1]]


def _gather(others: bool):
    """From rows (doc_id, text, other columns): a row for each shard (docs, their bytes, and the other columns as an Arrow stream)."""
    docs_type = pa.list_(pa.struct([("doc_id", pa.int64()), ("length", pa.int64())]))

    def close(shard: int, held: list[tuple[int | None, bytes]], parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        order = sorted(range(len(held)), key=lambda i: FIRST if held[i][0] is None else held[i][0])
        blob = pack(np.frombuffer(b"".join([held[i][1] for i in order]), np.uint8))
        rest = None
        if others:
            table = pa.Table.from_batches(parts).take(order)
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(table)
            rest = sink.getvalue().to_pybytes()
        docs = [{"doc_id": held[i][0], "length": len(held[i][1])} for i in order]
        arrays = [pa.array([shard]), pa.array([docs], docs_type), pa.array([blob], pa.binary()), pa.array([rest], pa.binary())]
        return pa.RecordBatch.from_arrays(arrays, names=["shard", "docs", "blob", "rest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds(__name__)
        task, made = TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        parts: list[pa.RecordBatch] = []
        size = 0
        for b in batches:
            begin = 0
            rest = b.select(range(2, b.num_columns))
            for i, (doc_id, text) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)):
                held.append((doc_id, (text or "").encode()))
                size += len(held[-1][1])
                if size >= SHARD_BYTES or len(held) >= SHARD_DOCS:
                    yield close(task << 32 | made, held, [*parts, rest.slice(begin, i + 1 - begin)])
                    held, parts, size, made, begin = [], [], 0, made + 1, i + 1
            if begin < b.num_rows:
                parts.append(rest.slice(begin))
        if held:
            yield close(task << 32 | made, held, parts)

    return run


def short(hashes: np.ndarray) -> np.ndarray:
    """The upper 40 bits, as bytes. Within a bucket few others share them, and these only cost time."""
    return (hashes >> np.uint64(24)).view(np.uint8).reshape(-1, 8)[:, :5].reshape(-1)


def long(data: np.ndarray) -> np.ndarray:
    out = np.zeros((len(data) // 5, 8), np.uint8)
    out[:, :5] = data.reshape(-1, 5)
    return out.view(np.uint64).reshape(-1)


def _hashes(buckets: int):
    """From shards: the hashes of their anchors' contexts, and the anchors' numbers, for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds(__name__)
        for batch in batches:
            for i in range(batch.num_rows):
                shard, docs, blob = (batch.column(c)[i].as_py() for c in ("shard", "docs", "blob"))
                hashes = anchored(unpack(blob, "u1")[0].tobytes(), np.array([d["length"] for d in docs], np.int64))[3]
                rows = [(shard, b, pack(short(hashes[at]), np.diff(at, prepend=0).astype(np.uint32))) for b, at in _by_bucket((hashes % np.uint64(buckets)).astype(np.int64), buckets)]
                if rows:
                    yield _batch(rows)

    return run


def _buckets(treat):
    """Runs treat(rows of one bucket) for whole buckets. Negative buckets hold marks, which pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for b in batches:  # in the order of bucket
            for bucket, shard, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "shard", "blob")), strict=True):
                if bucket < 0:
                    yield _batch([(shard, bucket, blob)])
                    continue
                if bucket != now and rows:
                    yield _batch(treat(now, rows))
                    rows = []
                now = bucket
                rows.append((shard, blob))
        if rows:
            yield _batch(treat(now, rows))

    return run


def _twice(bucket: int, rows: list[tuple[int, bytes]]) -> list[tuple]:
    """For each shard: its anchors whose hash is found twice, and whether another shard has it."""
    parts = [(long(data), np.cumsum(steps)) for data, steps in (unpack(blob, "u1", "<u4") for _, blob in rows)]
    hashes = np.concatenate([p[0] for p in parts])
    of = np.repeat(np.arange(len(parts), dtype=np.int32), [len(p[0]) for p in parts])
    order = np.argsort(hashes)
    sorted_ = hashes[order]
    edge = np.concatenate([[True], sorted_[1:] != sorted_[:-1]]) if len(sorted_) else np.empty(0, bool)
    group = np.cumsum(edge) - 1
    starts = np.flatnonzero(edge)
    size = np.diff(np.concatenate([starts, [len(sorted_)]]))
    shards = of[order]
    across = np.minimum.reduceat(shards, starts) != np.maximum.reduceat(shards, starts) if len(starts) else np.empty(0, bool)
    state = np.empty(len(hashes), np.uint8)
    state[order] = ((size > 1).astype(np.uint8) + across)[group]
    out, at = [], 0
    for (shard, _), (_, ordinal) in zip(rows, parts, strict=True):
        own = state[at : at + len(ordinal)]
        at += len(ordinal)
        if own.any():
            out.append((shard, bucket, pack(ordinal[own > 0].astype(np.uint32), own[own > 0])))
    return out or [(-1, bucket, None)]


def suffix_array(words: np.ndarray, n: int, depth: int) -> np.ndarray:
    """Positions 0..n-1 in the order of their first ``depth`` bytes (8 at least), by Larsson-Sadakane refinement.

    words are the 8 bytes at each position (as from ``eights``), with zeros past the end; what compares equal stays in the order of position.
    """
    if not n:
        return np.empty(0, np.int64)
    keys = words[:n].byteswap()
    order = np.argsort(keys, kind="stable")
    sorted_ = keys[order]
    edge = np.concatenate([[True], sorted_[1:] != sorted_[:-1]])
    rank = np.zeros(n + depth, np.int64)  # past the end: rank 0, the least
    head = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
    rank[order] = head + 1
    reach = 8
    while reach < depth:
        ahead = min(reach, depth - reach)
        # Only groups with more than one member are sorted again.
        single = edge & np.concatenate([edge[1:], [True]])
        todo = np.flatnonzero(~single)
        if not len(todo):
            break
        members = order[todo]
        pairs = (head[todo].astype(np.uint64) << np.uint64(32)) | rank[members + ahead].astype(np.uint64)
        again = np.argsort(pairs, kind="stable")
        order[todo] = members[again]
        pairs = pairs[again]
        edge[todo] = np.concatenate([[True], pairs[1:] != pairs[:-1]])
        head = np.maximum.accumulate(np.where(edge, np.arange(n), 0))
        rank[order[todo]] = head[todo] + 1
        reach += ahead
    return order


def common_prefixes(words: np.ndarray, order: np.ndarray, most: int, block: int = 512) -> np.ndarray:
    """For each place of the suffix array, the bytes (``most`` at most) that its suffix shares with the one before, by Kasai's algorithm.

    Blocks of positions go in step: each lane carries the common length from one position to the next, less one.
    """
    n = len(order)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    shared = np.zeros(n, np.int64)
    at = np.arange(0, n, block)
    end = np.minimum(at + block, n)
    length = np.zeros(len(at), np.int64)
    while len(at):
        other = before[at]
        there = other >= 0
        x = words[at + length] ^ words[np.where(there, other, 0) + length]
        same = np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)).astype(np.int64) >> 3)
        length = np.where(there, np.minimum(length + same, most), 0)
        done = (x != 0) | (length >= most) | ~there
        shared[at[done]] = length[done]
        # Order ends at ``most`` bytes: past it, the length carries over only between the same two runs of text.
        capped = done & (length >= most)
        at = at + done
        length = np.maximum(length - done, 0)
        length[capped & (before[np.minimum(at, n - 1)] != other + 1)] = 0
        if (at >= end).any():
            live = at < end
            at, end, length = at[live], end[live], length[live]
    return shared[order]


def repeated_within(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Which of the ascending start positions hold a string that also starts at an earlier one of them.

    Only the text near the starts enters the suffix array.
    """
    if len(starts) < 2:
        return np.zeros(len(starts), bool)
    need = np.zeros(len(data) + 1, np.int32)
    np.add.at(need, starts, 1)
    np.subtract.at(need, starts + LENGTH, 1)
    used = np.cumsum(need[:-1]) > 0
    text = data[used]
    place = (np.cumsum(used) - 1)[starts]
    n = len(text)
    words = eights(text.tobytes() + PAD, n + LENGTH + 8)
    order = suffix_array(words, n, LENGTH)
    shared = common_prefixes(words, order, LENGTH)
    valid = np.zeros(n, bool)
    valid[place] = True
    group = np.cumsum(shared < LENGTH)
    kept = valid[order]
    order, group = order[kept], group[kept]
    edge = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    earliest = np.minimum.reduceat(order, edge)
    later = np.zeros(n, bool)
    later[order] = True
    later[earliest] = False
    return later[place]


def runs_of(positions: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First positions and lengths of the runs in ascending positions."""
    if not len(positions):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    edge = np.flatnonzero(np.diff(positions) != 1) + 1
    first = positions[np.concatenate([[0], edge])]
    return first, positions[np.concatenate([edge - 1, [len(positions) - 1]])] - first + 1


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All positions of runs."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


def _local(buckets: int):
    """From shards with their repeated anchors: marks within the shard (negative buckets, dealt evenly), and segments for each bucket."""

    def one(shard: int, docs: list[dict], blob: bytes, found: list[bytes]) -> list[tuple]:
        data = unpack(blob, "u1")[0].tobytes()
        lengths = np.array([d["length"] for d in docs], np.int64)
        _, first, last, hashes = anchored(data, lengths)
        state = np.zeros(len(first), np.uint8)
        for blob in found:
            ordinal, own = unpack(blob, "<u4", "u1")
            state[ordinal] = own
        again = np.flatnonzero(state)
        size = (last - first + 1)[again]
        starts = spread(first[again], size)
        of = np.repeat(again, size)
        text = np.frombuffer(data, np.uint8)
        later = repeated_within(text, starts)
        rows = [(shard, -1 - (shard * 0x9E3779B1 >> 20) % 1024, pack(*(x.astype(np.int64) for x in runs_of(starts[later]))))]
        sent = ~later & (state[of] > 1)
        starts, of = starts[sent], of[sent]
        if len(starts):
            edge = np.flatnonzero((np.diff(starts) != 1) | (np.diff(of) != 0)) + 1
            begin = np.concatenate([[0], edge])
            at, count = starts[begin], np.diff(np.concatenate([begin, [len(starts)]]))
            ids = np.array([FIRST if d["doc_id"] is None else d["doc_id"] for d in docs], np.int64)
            doc = ids[np.searchsorted(np.cumsum(lengths), at, side="right")]
            for b, i in _by_bucket((hashes[of[begin]] % np.uint64(buckets)).astype(np.int64), buckets):
                rows.append((shard, b, pack(doc[i], at[i], count[i], text[spread(at[i], count[i] + LENGTH - 1)])))
        return rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        holds(__name__)
        for b in batches:
            for i in range(b.num_rows):
                yield _batch(one(*(b.column(c)[i].as_py() for c in ("shard", "docs", "blob", "found"))))

    return run


BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)


def string_keys(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit keys of the strings at starts: a polynomial over their bytes."""
    power = np.ones(len(text) + 1, np.uint64)
    power[1:] = np.uint64(BASE)
    np.multiply.accumulate(power, out=power)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    power[1:] = np.uint64(BASE_INVERSE)
    np.multiply.accumulate(power, out=power)
    return mixed((sums[starts + LENGTH] - sums[starts]) * power[starts])


def _merge(bucket: int, rows: list[tuple[int, bytes]]) -> list[tuple]:
    """For each shard: the start positions whose string another shard has earlier."""
    parts = [unpack(blob, "<i8", "<i8", "<i8", "u1") for _, blob in rows]
    doc, at, count = (np.concatenate([p[k] for p in parts]) for k in (0, 1, 2))
    of = np.repeat(np.arange(len(parts)), [len(p[0]) for p in parts])
    # The order of segments is that of doc_id, shard and position.
    turn = np.empty(len(doc), np.int64)
    turn[np.lexsort((at, np.array([s for s, _ in rows])[of], doc))] = np.arange(len(doc))
    keys, texts, places, shift = [], [], [], 0
    for _, _, n, text in parts:
        begin = np.cumsum(n + LENGTH - 1) - (n + LENGTH - 1)
        starts = spread(begin, n)
        keys.append(string_keys(text, starts))
        texts.append(text)
        places.append(starts + shift)
        shift += len(text)
    own, text, place = np.concatenate(keys), np.concatenate(texts), np.concatenate(places)
    del keys, texts, places
    offset = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count)
    turns = np.repeat(turn, count) << np.int64(8) | offset
    order = np.argsort(own)
    index = own[order]
    edge = np.concatenate([[True], index[1:] != index[:-1]])
    equal = np.flatnonzero(~edge)
    if len(equal):
        windows = np.lib.stride_tricks.sliding_window_view(text, LENGTH)
        bad = np.zeros(len(equal), bool)
        for i in range(0, len(equal), 1 << 15):
            own_part = equal[i : i + (1 << 15)]
            bad[i : i + len(own_part)] = (windows[place[order[own_part - 1]]] != windows[place[order[own_part]]]).any(axis=1)
        if bad.any():  # equal keys of different strings: these get keys of their own
            view = text.tobytes()
            clash = np.flatnonzero(np.isin(own, index[equal[bad]]))
            names = {s: i for i, s in enumerate(sorted({view[p : p + LENGTH] for p in place[clash].tolist()}))}
            own = np.searchsorted(np.unique(own), own).astype(np.uint64)
            own[clash] = np.array([len(own) + names[view[p : p + LENGTH]] for p in place[clash].tolist()], np.uint64)
            order = np.argsort(own)
            index = own[order]
            edge = np.concatenate([[True], index[1:] != index[:-1]])
    begins = np.flatnonzero(edge)
    index, earliest = index[begins], np.minimum.reduceat(turns[order], begins)
    del order, edge, equal, place
    out, start = [], 0
    for (shard, _), (_, positions, n, _) in zip(rows, parts, strict=True):
        size = int(n.sum())
        mine = slice(start, start + size)
        later = turns[mine] != earliest[np.searchsorted(index, own[mine])]
        if later.any():
            out.append((shard, bucket, pack(*(x.astype(np.int64) for x in runs_of(np.sort(spread(positions, n)[later]))))))
        start += size
    return out or [(-1, bucket, None)]


def _covered(docs: list[dict], data: bytes, marks: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Which bytes go, and the ends of the documents."""
    change = np.zeros(len(data) + 1, np.int32)
    for blob in marks or []:
        first, size = unpack(blob, "<i8", "<i8")
        np.add.at(change, first, 1)
        np.subtract.at(change, first + size - 1 + LENGTH, 1)
    return np.cumsum(change[:-1]) > 0, np.cumsum([d["length"] for d in docs])


def _finish(emit):
    """Runs emit(docs, rest, for each document its runs, its removed bytes and what is left) for each shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                docs, blob, marks, rest = (b.column(c)[i].as_py() for c in ("docs", "blob", "found", "rest"))
                data = unpack(blob, "u1")[0].tobytes()
                gone, ends = _covered(docs, data, marks)
                kept = np.frombuffer(data, np.uint8)[~gone].tobytes()
                left = np.concatenate([[0], np.cumsum(~gone)])
                begin = np.concatenate([[0], ends[:-1]]).astype(np.int64)
                opens = np.concatenate([[False], gone[1:] & ~gone[:-1]]) if len(gone) else gone
                opened = np.concatenate([[0], np.cumsum(opens)])
                rows = []
                for s, e in zip(begin.tolist(), ends.tolist(), strict=True):
                    # A run that goes on from the document before counts as one that opens here.
                    spans = int(opened[e] - opened[s]) + int(e > s and gone[s] and not opens[s])
                    rows.append((spans, e - s - int(left[e] - left[s]), kept[int(left[s]) : int(left[e])]))
                yield emit(docs, rest, rows)

    return run


def _marked(docs: DataFrame, others: tuple[str, ...] = ()) -> DataFrame:
    """Shards with docs, blob (their bytes), rest (their other columns) and found (marks)."""
    spark = docs.sparkSession
    n = partitions(spark)

    def dealt(rows: DataFrame, treat) -> DataFrame:
        own = rows.repartition(n, "bucket").sortWithinPartitions("bucket")
        return own.mapInArrow(_buckets(treat), SCHEMA).where("shard >= 0")

    def with_found(found: DataFrame) -> DataFrame:
        listed = found.groupBy("shard").agg(F.collect_list("blob").alias("found"))
        return shards.join(listed, "shard", "left")

    # Columns are told apart by place, so that names may clash.
    rows = docs.select(F.col("doc_id").cast("long").alias("_0"), F.col("text").alias("_1"), *(F.col(c).alias(f"_{i}") for i, c in enumerate(others, 2)))
    shards = checkpoint(rows.mapInArrow(_gather(bool(others)), SHARDS))
    if not others:
        shards = shards.select("shard", "docs", "blob")  # so that both joins share one exchange
    seen = with_found(dealt(shards.select("shard", "docs", "blob").mapInArrow(_hashes(n), SCHEMA), _twice)).withColumn("found", F.coalesce("found", F.array().cast("array<binary>")))
    # Segments are only ever in shuffle files; tasks that lose them start from the shards again.
    local = seen.select("shard", "docs", "blob", "found").mapInArrow(_local(FINER * n), SCHEMA)
    marks = dealt(local, _merge)
    return with_found(marks).select("docs", "blob", "found", "rest" if others else F.lit(None).cast("binary").alias("rest"))


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans (runs of removed bytes) and a checksum of what is left."""

    def emit(docs: list[dict], rest: bytes | None, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        spans, removed, kept = zip(*rows, strict=True)
        arrays = [*(pa.array([d[c] for d in docs], pa.int64()) for c in ("doc_id", "length")), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _marked(docs).mapInArrow(_finish(emit), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, removed: str | None = None) -> DataFrame:
    """docs with what is left as text; with ``removed``, a column of that name has the number of bytes removed.

    Characters of which only some bytes are left go as a whole. The other columns stay as they are. Null texts become empty.
    """
    names = docs.columns
    others = tuple(c for c in names if c != "text")
    more = [removed] if removed else []

    def emit(found: list[dict], rest: bytes, rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        columns = iter(pa.ipc.open_stream(rest).read_all().combine_chunks().columns)
        texts = pa.array([k.decode(errors="ignore") for _, _, k in rows], pa.string())
        arrays = [texts if c == "text" else next(columns).combine_chunks() for c in names]
        return pa.RecordBatch.from_arrays([*arrays, *(pa.array([r[1] for r in rows], pa.int64()) for _ in more)], names=[*names, *more])

    schema = docs.schema if removed is None else StructType([*docs.schema.fields, StructField(removed, LongType())])
    return _marked(docs, others).mapInArrow(_finish(emit), schema)
