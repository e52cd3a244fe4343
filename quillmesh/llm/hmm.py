"""Language-model scores from a hidden Markov model.

Training counts of all words come from the whole corpus: documents are gathered into shards, each shard sends its distinct words
once to the bucket of their hash, buckets add up counts and send them back, so a frequent word is one entry for each shard, never
a row for each occurrence.

The model's latent states emit word classes, and a class emits its words: P(w | state) = P(class | state) * (c + 0.1) / (N_k +
0.1 * (V_k + 1)), with the class's training tokens N_k and distinct words V_k; the extra share is that of words never seen. A word with a
share of at least 1 / ``frequent`` of the training tokens is a class of its own (there can be no more than ``frequent``); others are
classed by their endings. So the model's size is bounded. An open vocabulary gives 0.1 to each word that was never seen, as the base score
does, so the probabilities of all texts add up to more than one.

Baum-Welch: each round runs forward and backward recursions over the training documents of every shard, and expected counts are
added up across partitions. For this only, documents are cut into chunks that share a token with the one before, so that every
transition counts once; a document's first chunk alone counts as a start. Every round, from the first on, sees all training documents.
Scores are exact: the scaled forward recursion runs over each whole text.

Null and empty texts are one end token. Equal texts get equal scores (up to the last bits of sums); rows without doc_id are learned from; without any
training document all counts are zero; an empty table gives no rows; more columns of the input are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint, learnable, pack, partitions, unpack, words_of

END = b"\n"  # no word holds white space
SMOOTH = 0.1
ENDINGS, ENDING_BYTES = 2048, 3
SHARD_BYTES, SHARD_DOCS = 6 << 20, 20_000
BIG = np.int64(1) << np.int64(62)


def _shards(buckets: int):
    """From (doc_id, held, text): shard rows (bucket -1) with the documents as word numbers, and for each bucket the shard's words and counts."""
    names = ("shard", "bucket", "docs", "blob")

    def close(shard: int, ids: list, held: list[bool], cut: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
        vocabulary: dict[bytes, int] = {}
        number = vocabulary.setdefault
        raw = [np.fromiter((number(w, len(vocabulary)) for w in words), np.int64, len(words)) for words in cut]
        words = list(vocabulary)
        bucket = np.array([xxhash.xxh64_intdigest(w, 11) % buckets for w in words], np.int64)
        order = np.argsort(bucket, kind="stable")
        renumber = np.empty(len(words), np.int64)
        renumber[order] = np.arange(len(words))
        tokens = [renumber[r] for r in raw]
        counts = np.bincount(np.concatenate([np.empty(0, np.int64), *(t for t, h in zip(tokens, held, strict=True) if not h)]), minlength=len(words))
        ordered = [words[i] for i in order]
        docs = [{"doc_id": d, "held": h, "length": len(t)} for d, h, t in zip(ids, held, tokens, strict=True)]
        rows = [(shard, -1, docs, pack(np.concatenate(tokens).astype("<u4")))]
        edges = np.searchsorted(bucket[order], np.arange(buckets + 1))
        for b in range(buckets):
            if edges[b] < edges[b + 1]:
                own = slice(edges[b], edges[b + 1])
                rows.append((shard, b, None, pack(np.frombuffer(b" ".join(ordered[own]), np.uint8), counts[own].astype("<i8"))))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), SHARD_TYPES, strict=True)], names=list(names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        ids: list = []
        held: list[bool] = []
        cut: list[list[bytes]] = []
        size = 0
        for b in batches:
            for doc_id, h, text in zip(b.column("doc_id").to_pylist(), b.column("held").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids.append(doc_id)
                held.append(bool(h))
                cut.append([*words_of(text), END])
                size += len(text or "")
                if size >= SHARD_BYTES or len(ids) >= SHARD_DOCS:
                    yield from close(task << 32 | made, ids, held, cut)
                    ids, held, cut, size, made = [], [], [], 0, made + 1
        if ids:
            yield from close(task << 32 | made, ids, held, cut)

    return run


_DOC = pa.list_(pa.struct([("doc_id", pa.int64()), ("held", pa.bool_()), ("length", pa.int64())]))
SHARD_TYPES = [pa.int64(), pa.int32(), _DOC, pa.binary()]
SHARD_SCHEMA = "shard long, bucket int, docs array<struct<doc_id:long,held:boolean,length:long>>, blob binary"


def _add_up(total: int, frequent: int):
    """For rows of whole buckets: each shard's words with their corpus counts (class_key -1), and what each class has."""
    names = ("shard", "bucket", "blob", "class_key", "n", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[int, bytes]]] = {}
        for b in batches:
            for bucket, shard, blob in zip(*(b.column(c).to_pylist() for c in ("bucket", "shard", "blob")), strict=True):
                held.setdefault(bucket, []).append((shard, blob))
        while held:
            bucket, rows = held.popitem()
            number: dict[bytes, int] = {}
            at, own = [], []
            for _, blob in rows:
                words, n = unpack(blob, "u1", "<i8")
                at.append(np.fromiter((number.setdefault(w, len(number)) for w in words.tobytes().split(b" ")), np.int64, len(n)))
                own.append(n)
            counts = np.zeros(len(number), np.int64)
            for i, n in zip(at, own, strict=True):
                counts[i] += n
            keys = np.array([xxhash.xxh64_intdigest(w, 13) >> 2 for w in number], np.int64) | BIG
            endings = np.array([xxhash.xxh32_intdigest(w[-ENDING_BYTES:], 5) % ENDINGS for w in number], np.int64)
            kind = np.where((counts * frequent >= total) & (counts > 0), keys, endings)
            out = [(shard, bucket, pack(counts[i], kind[i]), -1, 0, 0) for i, (shard, _) in zip(at, rows, strict=True)]
            known = counts > 0
            kinds, inverse = np.unique(kind[known], return_inverse=True)
            n, v = np.bincount(inverse, counts[known], len(kinds)), np.bincount(inverse, minlength=len(kinds))
            out += [(-1, bucket, None, int(k), int(a), int(c)) for k, a, c in zip(kinds, n, v, strict=True)]
            types = [pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=list(names))

    return run


def _code(total: int, distinct: int, classes: tuple[np.ndarray, np.ndarray, np.ndarray]):
    """Documents as class numbers, with the sums that don't depend on the states."""
    keys_of, n_of, v_of = classes
    within_of = np.log10(n_of + SMOOTH * (v_of + 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, tokens, parts in zip(*(b.column(c).to_pylist() for c in ("docs", "blob", "parts")), strict=True):
                found = [unpack(p["blob"], "<i8", "<i8") for p in sorted(parts, key=lambda p: p["bucket"])]
                counts, own = (np.concatenate([f[i] for f in found]) for i in (0, 1))
                number = np.searchsorted(keys_of, own)
                base = np.log10((counts + SMOOTH) / (total + SMOOTH * (distinct + 1)))
                within = np.log10(counts + SMOOTH) - within_of[number]
                at = unpack(tokens, "<u4")[0]
                starts = np.concatenate([[0], np.cumsum([d["length"] for d in docs])[:-1]]).astype(np.int64)
                sums = [np.add.reduceat(x[at], starts) for x in (base, within, (counts > 0).astype(np.int64))]
                rows = [{**d, "base": float(s), "within": float(w), "known": int(k)} for d, s, w, k in zip(docs, *sums, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([rows], _CODED), pa.array([pack(number[at].astype("<u2"))], pa.binary())], names=["docs", "classes"])

    return run


_CODED = pa.list_(pa.struct([("doc_id", pa.int64()), ("held", pa.bool_()), ("length", pa.int64()), ("base", pa.float64()), ("within", pa.float64()), ("known", pa.int64())]))
CODED_SCHEMA = "docs array<struct<doc_id:long,held:boolean,length:long,base:double,within:double,known:long>>, classes binary"
Model = tuple[np.ndarray, np.ndarray, np.ndarray]


def expected(model: Model, sequences: np.ndarray, mask: np.ndarray, opens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Expected counts (starts, transitions, emissions) of sequences, a row each; mask tells real tokens from the padding at the ends.

    Where opens is false, a row goes on from another one, which has counted its first token already.
    """
    start, step, emit = (np.ascontiguousarray(x, np.float32) for x in model)
    states = len(start)
    sizes = mask.sum(axis=1)
    order = np.argsort(-sizes, kind="stable")
    sizes = sizes[order]
    lanes, width = len(sizes), int(sizes[0])
    at = np.ascontiguousarray(sequences[order, :width].T, np.intp)
    alive = np.searchsorted(-sizes, -np.arange(1, width + 1), side="right").tolist()
    # (time, state, lane): the first lanes of a time are real, so all work is over long runs and none over padding.
    seen = np.empty((width, states, lanes), np.float32)
    alpha = np.zeros_like(seen)
    forth = np.ascontiguousarray(step.T)
    for t, n in enumerate(alive):
        own = np.take(emit, at[t], axis=1, out=seen[t], mode="clip")[:, :n]
        now = np.multiply(forth @ alpha[t - 1, :, :n] if t else start[:, None], own, out=alpha[t, :, :n])
        scale = np.float32(1) / now.sum(axis=0)
        now *= scale
        own *= scale
    # Both recursions have the same scale, so alpha * back adds up to one and needs no other; alpha becomes the states' shares in place.
    back = np.ones((states, lanes), np.float32)
    moves = np.zeros((states, states))
    for t in range(width - 1, 0, -1):
        n = alive[t]
        ahead = seen[t, :, :n]
        ahead *= back[:, :n]
        alpha[t, :, :n] *= back[:, :n]
        moves += alpha[t - 1, :, :n] @ ahead.T
        back[:, :n] = step @ ahead
    alpha[0] *= back
    if opens is not None:
        alpha[0] *= opens[order]
    flat = at.reshape(-1)
    emitted = np.stack([np.bincount(flat, alpha[:, s].reshape(-1), emit.shape[1]) for s in range(states)])
    return alpha[0].sum(axis=1, dtype=np.float64), moves * step.astype(np.float64), emitted


def chunked(classes: np.ndarray, lengths: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents cut into rows of width tokens, each beginning with the last token of the one before; the mask of real tokens; which rows open a document."""
    step = width - 1
    pieces = np.maximum(1, -(-(lengths - 1) // step))
    first = np.repeat(np.cumsum(lengths) - lengths, pieces)
    place = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    begin = first + place * step
    size = np.minimum(width, np.repeat(lengths, pieces) - place * step)
    mask = np.arange(width)[None, :] < size[:, None]
    rows = np.lib.stride_tricks.sliding_window_view(np.concatenate([classes, np.zeros(width, classes.dtype)]), width)[begin]
    return rows * mask, mask, place == 0


def _counted(model: Model, width: int = 128, lanes: int = 2048):
    """A row (place, value) for each expected count of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for b in batches:
            for length, held, blob in zip(b.column("length"), b.column("held"), b.column("classes"), strict=True):
                lengths, train = length.values.to_numpy(), ~held.values.to_numpy(zero_copy_only=False)
                own = unpack(blob.as_py(), "<u2")[0][np.repeat(train, lengths)]
                if not len(own):
                    continue
                rows, mask, opens = chunked(own, lengths[train], width)
                for at in range(0, len(rows), lanes):
                    part = expected(model, rows[at : at + lanes], mask[at : at + lanes], opens[at : at + lanes])
                    sums = part if sums is None else [x + y for x, y in zip(sums, part, strict=True)]
        if sums is not None:
            flat = np.concatenate([np.asarray(x).ravel() for x in sums])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["place", "value"])

    return run


def learned(counts: np.ndarray, states: int, shares: np.ndarray) -> Model:
    """Parameters from expected counts in one row, with pseudo-counts by the classes' shares."""
    start, moves, emitted = counts[:states], counts[states : states * (1 + states)].reshape(states, states), counts[states * (1 + states) :].reshape(states, -1)
    start, moves, emitted = start + 1.0, moves + 1.0, emitted + 20.0 * shares[None, :]
    return start / start.sum(), moves / moves.sum(axis=1, keepdims=True), emitted / emitted.sum(axis=1, keepdims=True)


def fresh(states: int, shares: np.ndarray) -> Model:
    """States that keep to themselves, each with its own fixed deviations from the classes' shares."""
    rng = np.random.default_rng(5)
    emit = shares[None, :] * rng.gamma(2.0, 0.5, (states, len(shares)))
    step = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(step, 0.9 if states > 1 else 1.0)
    return np.full(states, 1 / states), step, emit / emit.sum(axis=1, keepdims=True)


def forward(model: Model, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """log10 probability of each sequence of classes, by the scaled forward recursion, all sequences in step, longest first."""
    start, step, emit = model
    table = np.ascontiguousarray(emit.T)
    order = np.argsort(-lengths, kind="stable")
    begin = (np.cumsum(lengths) - lengths)[order]
    sizes = lengths[order]
    total = np.zeros(len(lengths))
    alive = np.searchsorted(-sizes, -np.arange(1, (sizes[0] if len(sizes) else 0) + 1), side="right")
    alpha = np.empty((0, len(start)))
    for t, n in enumerate(alive.tolist()):
        seen = table[classes[begin[:n] + t]]
        alpha = (alpha[:n] @ step if t else start[None, :]) * seen
        scale = alpha.sum(axis=1)
        alpha /= scale[:, None]
        total[:n] += np.log10(scale)
    out = np.empty(len(lengths))
    out[order] = total
    return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: Model, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for docs, blob in zip(b.column("docs").to_pylist(), b.column("classes").to_pylist(), strict=True):
                lengths = np.array([d["length"] for d in docs])
                logs = forward(model, unpack(blob, "<u2")[0].astype(np.int64), lengths)
                pick = lambda name: [d[name] for d in docs]
                arrays = [pa.array(pick("doc_id"), pa.int64()), pa.array(pick("held")), pa.array(lengths), pa.array(pick("known"), pa.int64()), pa.array([total] * len(docs), pa.int64()), pa.array(pick("base"), pa.float64()), pa.array(logs + np.array(pick("within")))]
                yield pa.RecordBatch.from_arrays(arrays, names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return run


def score(docs: DataFrame, states: int = 8, rounds: int = 4, warm_rounds: int = 12, frequent: int = 4096) -> DataFrame:
    """Counts and log10 probabilities of each document; rows whose crc32(doc_id as text) mod 10 is 0 are held out.

    warm_rounds and rounds are both over all training documents.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(learnable() % 10 == 0, F.lit(False)).alias("held"), "text")
    built = checkpoint(rows.mapInArrow(_shards(buckets), SHARD_SCHEMA))
    shards = built.where("bucket < 0")
    total = shards.select(F.explode("docs").alias("d")).where("not d.held").agg(F.coalesce(F.sum("d.length"), F.lit(0))).first()[0]
    sent = built.where("bucket >= 0").select("shard", "bucket", "blob")
    added = checkpoint(sent.repartition(buckets, "bucket").mapInArrow(_add_up(total, frequent), "shard long, bucket int, blob binary, class_key long, n long, v long"))
    kinds = added.where("class_key >= 0").groupBy("class_key").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()  # frequent + ENDINGS rows at most
    found = {k: (n, v) for k, n, v in kinds}
    keys = np.array(sorted({*range(ENDINGS), *found}), np.int64)
    n_of, v_of = (np.array([found.get(int(k), (0, 0))[i] for k in keys], np.float64) for i in (0, 1))
    parts = added.where("class_key < 0").groupBy("shard").agg(F.collect_list(F.struct("bucket", "blob")).alias("parts"))
    joined = shards.select("shard", "docs", "blob").join(parts, "shard").select("docs", "blob", "parts")
    coded = checkpoint(joined.mapInArrow(_code(total, int(v_of.sum()), (keys, n_of, v_of)), CODED_SCHEMA))
    shares = (n_of + SMOOTH * (v_of + 1)) / (n_of + SMOOTH * (v_of + 1)).sum()

    def round_(source: DataFrame, model: Model) -> Model:
        source = source.select("docs.length", "docs.held", "classes")
        sums = source.mapInArrow(_counted(model), "place long, value double").groupBy("place").agg(F.sum("value").alias("value")).toPandas()
        counts = np.zeros(states * (1 + states + len(keys)))
        counts[sums["place"].to_numpy(np.int64)] = sums["value"].to_numpy(np.float64)
        return learned(counts, states, shares)

    model = fresh(states, shares)
    if total:
        for _ in range(warm_rounds + rounds):
            model = round_(coded, model)
    return coded.mapInArrow(_scored(model, total), SCORES)
