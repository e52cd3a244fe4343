"""Near-duplicates by SimHash, with covering codes as anchor points.

A fingerprint's leading bits fall into blocks, each with a perfect code: Golay [23, 12] (every word within 3 of one
codeword) and Hamming [15, 11] (within 1). A tuple of codewords is an anchor. Of two fingerprints at most two bits
apart, each is within one bit of a word midway, and that word has an anchor within the covering radii. So a fingerprint
is replicated to every anchor that exceeds the covering radii by one bit in total, half the threshold, and both meet
at one anchor at least; fingerprints are compared only there. At an anchor, a breadth-first search over the exact
distances emits a spanning forest: no pairs of a group are listed, and no link between different fingerprints is lost
in the components. Equal fingerprints are one node.

``fingerprints`` and ``link`` serve exact linking at two bits. ``near_copies`` serves copies with edits: fingerprints of the sets
of five-word shingles, linked in the same way, give candidates, which the sets themselves confirm. An exact similarity join finds the
rest: sets meet at shingles that each has among its first, in an order that puts frequent ones last, and are compared
unless confirmed links have joined them already.

Null and empty texts have no words and fingerprint zero, which links like any other; in ``near_copies`` they are one
group too. Rows without doc_id take part like all others; equal rows get equal results; an empty table gives no rows;
more columns of the input are left alone.
"""

from __future__ import annotations

import functools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.llm.common import checkpoint, pack, partitions, per_batch, unpack, unused, words_of
from quillmesh.llm.graph import components

GOLAY, GOLAY_BITS, GOLAY_RADIUS = 0b101011100011, 23, 3  # generator polynomial, length, covering radius
HAMMING, HAMMING_BITS, HAMMING_RADIUS = 0b10011, 15, 1
CHUNK = 1 << 16


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """XXH64 (seed 42) of each k-word shingle, repeats included; of the whole sequence if there are fewer words."""
    digest = xxhash.xxh64_intdigest
    if not words:
        return np.empty(0, np.uint64)
    if len(words) <= k:
        return np.array([digest(b" ".join(words), 42)], np.uint64)
    return np.array([digest(b" ".join(s), 42) for s in zip(*(words[i:] for i in range(k)), strict=False)], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """Each bit is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    count = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        count += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(hashes), bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint's 64 bits as a long."""

    def batch(b: pa.RecordBatch) -> pa.RecordBatch:
        found = np.array([majority(shingle_hashes(words_of(t), shingle)) for t in b.column("text").to_pylist()], np.uint64)
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(per_batch(batch), "doc_id long, fp long")


@functools.cache
def code(polynomial: int, bits: int, radius: int) -> tuple[np.ndarray, list[list[np.ndarray]]]:
    """Syndrome of each word of a byte at each place, and for each extra e and syndrome the error patterns of weight <= radius + e."""
    degree = polynomial.bit_length() - 1

    def remainder(word: int) -> int:
        for i in range(word.bit_length() - 1, degree - 1, -1):
            if word >> i & 1:
                word ^= polynomial << (i - degree)
        return word

    unit = [remainder(1 << i) for i in range(bits)]
    tables = np.zeros((3, 256), np.int64)
    for place in range(3):
        for byte in range(256):
            for i in range(8):
                if byte >> i & 1 and place * 8 + i < bits:
                    tables[place, byte] ^= unit[place * 8 + i]
    shells: list[list[list[int]]] = []
    level = {0: 0}
    within: list[list[int]] = [[] for _ in range(1 << degree)]
    for weight in range(radius + 2):
        for word, s in level.items():
            within[s].append(word)
        if weight >= radius:
            shells.append([list(x) for x in within])
        level = {w | 1 << i: s ^ unit[i] for w, s in level.items() for i in range(w.bit_length(), bits)}
    return tables, [[np.array(x, np.int64) for x in shell] for shell in shells]


def near_codewords(words: np.ndarray, polynomial: int, bits: int, radius: int, extra: int) -> tuple[np.ndarray, np.ndarray]:
    """All (index of word, codeword) at most radius + extra apart."""
    tables, shells = code(polynomial, bits, radius)
    syndrome = tables[0][words & 255] ^ tables[1][words >> 8 & 255] ^ tables[2][words >> 16 & 255]
    patterns = shells[extra]
    size = np.array([len(p) for p in patterns])
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    flat = np.concatenate(patterns)
    n = size[syndrome]
    index = np.repeat(np.arange(len(words)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(start[syndrome], n)
    return index, words[index] ^ flat[at]


def anchors(fps: np.ndarray, hamming: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, anchor) for every anchor within the covering radii plus one bit."""
    fps = fps.astype(np.uint64)
    blocks = [((fps & np.uint64((1 << 23) - 1)).astype(np.int64), GOLAY, GOLAY_BITS, GOLAY_RADIUS), ((fps >> np.uint64(23) & np.uint64((1 << 23) - 1)).astype(np.int64), GOLAY, GOLAY_BITS, GOLAY_RADIUS)]
    shift = [0, 23]
    if hamming:
        blocks.append(((fps >> np.uint64(46) & np.uint64((1 << 15) - 1)).astype(np.int64), HAMMING, HAMMING_BITS, HAMMING_RADIUS))
        shift.append(46)
    home = [near_codewords(*b, 0)[1] for b in blocks]
    whole = sum(h << s for h, s in zip(home, shift, strict=True))
    index, out = [np.arange(len(fps))], [whole]
    for b, s, h in zip(blocks, shift, home, strict=True):
        i, word = near_codewords(*b, 1)
        other = word != h[i]
        i, word = i[other], word[other]
        index.append(i)
        out.append(whole[i] ^ (h[i] << s) ^ (word << s))
    return np.concatenate(index), np.concatenate(out)


def forest(fps: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Edges of a spanning forest of the graph that links fingerprints at most ``most`` bits apart."""
    left = np.arange(len(fps))
    while len(left) > 1:
        frontier, left = left[:1], left[1:]
        while len(frontier) and len(left):
            step, frontier = frontier[:64], frontier[64:]
            near = np.bitwise_count(fps[left][None, :] ^ fps[step][:, None]) <= most
            hit = near.any(axis=0)
            if hit.any():
                parent = step[near[:, hit].argmax(axis=0)]
                found = left[hit]
                yield from zip(parent.tolist(), found.tolist(), strict=True)
                left = left[~hit]
                frontier = np.concatenate([frontier, found])


def _meet(most: int):
    """For rows in the order of anchor: (u, v) of each link, from all batches of a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

        def links(parts: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
            anchor, node, fp = (np.concatenate(x) for x in zip(*parts, strict=True))
            edge = np.flatnonzero(np.diff(anchor)) + 1
            starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(anchor)]])
            us: list[int] = []
            vs: list[int] = []
            for i in np.flatnonzero(ends - starts > 1):
                s, e = int(starts[i]), int(ends[i])
                for a, b in forest(fp[s:e].view(np.uint64), most):
                    us.append(int(node[s + a]))
                    vs.append(int(node[s + b]))
            return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

        for b in batches:
            part = tuple(b.column(c).to_numpy(zero_copy_only=False) for c in ("anchor", "node", "fp"))
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))  # the last anchor may go on in the next batch
            if cut:
                yield links([*held, tuple(x[:cut] for x in part)])
                held = []
            held.append(tuple(x[cut:] for x in part))
        if held:
            yield links(held)

    return run


def link(nodes: DataFrame, most: int = 2, hamming: bool = True) -> DataFrame:
    """Edges (u, v) between nodes (node, fp) that meet at an anchor and differ in ``most`` bits at most."""

    def spread(b: pa.RecordBatch) -> pa.RecordBatch:
        fp, node = b.column("fp").to_numpy(), b.column("node").to_numpy()
        index, anchor = anchors(fp.view(np.uint64), hamming)
        return pa.RecordBatch.from_arrays([pa.array(anchor), pa.array(node[index]), pa.array(fp[index])], names=["anchor", "node", "fp"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                yield spread(b.slice(at, 4096))

    rows = nodes.select("node", "fp").mapInArrow(pieces, "anchor long, node long, fp long")
    dealt = rows.repartition(partitions(nodes.sparkSession), "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(_meet(most), "u long, v long").distinct()


def classes(docs: DataFrame, shingle: int = 3, most: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the least doc_id that links reach) of each document."""
    fps = checkpoint(fingerprints(docs, shingle))
    nodes = fps.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least")).withColumn("fp", F.col("node"))
    roots = components(link(nodes, most))
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    found = rooted.select("node", "root").join(least, "root").select(F.col("node").alias("fp"), "component_id")
    return fps.join(found, "fp").select("doc_id", "fp", "component_id")


SAMPLE, OFTEN, KNOWN = 10_000, 4, 1_000_000


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


def shingle_set(text: str | bytes | None, k: int) -> np.ndarray:
    """The distinct k-word shingles of a text (the whole sequence if it has fewer words) as 64-bit hashes, mixed from those of their words."""
    words = words_of(text) if text is None or isinstance(text, str) else text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(k, len(words))
    out = h[: len(h) - k + 1]
    for i in range(1, k):
        out = _mixed(out) + h[i : len(h) - k + 1 + i]
    return np.unique(_mixed(_mixed(out)))


def sketch(found: np.ndarray) -> bytes:
    """A bit for each hash of a set, added up modulo 2, in at least two bits for each member (a power of two).

    Sketches of two sets, the longer one folded to the length of the shorter one, differ in no more bits than the sets differ in members.
    """
    bits = max(64, 1 << (2 * len(found)).bit_length())
    at = (found & np.uint64(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits).astype(np.uint8) & 1, bitorder="little").tobytes()


def apart(x: bytes, y: bytes) -> int:
    """Differing bits of two sketches: a lower bound of the members that only one of the sets has."""
    a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(a) != len(b):
        a, b = (b, a) if len(a) < len(b) else (a, b)
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return int(np.bitwise_count(a ^ b).sum())


BRIEF = 16  # words of 64 bits


def brief(x: bytes) -> bytes:
    """A sketch folded to ``BRIEF`` words at most, with zeros after it up to that length."""
    a = np.frombuffer(x, np.uint64)
    while len(a) > BRIEF:
        a = a[: len(a) // 2] ^ a[len(a) // 2 :]
    return a.tobytes().ljust(8 * BRIEF, b"\0")


def _briefs(b: pa.RecordBatch) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([b.column("node"), pa.array([brief(x) for x in b.column("sketch").to_pylist()], pa.binary())], names=["node", "brief"])


def all_apart(briefs: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """``apart`` of the sketches of rows u and v, all pairs at once; briefs has a row of ``BRIEF`` words for each set, size the sets' members."""
    words = np.clip(2.0 ** (np.floor(np.log2(np.maximum(size, 1))) - 4), 1, BRIEF).astype(np.int64)
    least = np.minimum(words[u], words[v])
    out = np.empty(len(u), np.int64)
    for n in np.unique(least).tolist():
        at, now, wide = np.flatnonzero(least == n), briefs, BRIEF
        while wide > n:  # rows that are as short already have zeros in the upper half
            wide //= 2
            now = now[:, :wide] ^ now[:, wide:]
        for i in range(0, len(at), CHUNK):
            part = at[i : i + CHUNK]
            out[part] = np.bitwise_count(now[u[part]] ^ now[v[part]]).sum(axis=1)
    return out


def _sampled(shingle: int):
    """(token, n): documents of a batch that hold each shingle."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingle_set(t, shingle) for t in b.column("text").to_pylist()]
        token, n = np.unique(np.concatenate(sets), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(n)], names=["token", "n"])

    return run


def _needed(share: float, size):
    """The least whole number that is not below that share of a size."""
    return np.ceil(share * np.asarray(size) - 1e-9).astype(np.int64)


SETS = "doc_id long, node long, same binary, size int, rare int, fp long, first binary, sketch binary"


def _prefixes(similarity: float, shingle: int, often: tuple[np.ndarray, np.ndarray]):
    """For each document a digest of its set of shingles, the set's size, how many are not frequent, its SimHash, its first shingles and its sketch.

    Shingles are in one order for all documents, the frequent ones last; two sets that reach the similarity have one in common
    among the first size - similarity * size + 1 of each.
    """
    known, counts = often

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in b.column("text").to_pylist():
            found = shingle_set(t, shingle)
            rank = np.zeros(len(found), np.int64)
            if len(known) and len(found):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                rank = np.where(known[at] == found, counts[at], 0)
            length = len(found) - int(_needed(similarity, len(found))) + 1 if len(found) else 0
            first = found[np.argsort(rank, kind="stable")[:length]].view(np.int64).tobytes()
            fp = int(np.uint64(majority(found)).view(np.int64))
            rows.append((xxhash.xxh3_128_digest(found.tobytes()), len(found), int((rank == 0).sum()), fp, first, sketch(found)))
        types = [pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary()]
        arrays = [b.column("doc_id"), b.column("node"), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True))]
        return pa.RecordBatch.from_arrays(arrays, names=["doc_id", "node", "same", "size", "rare", "fp", "first", "sketch"])

    return run


BLOCK = ("token", "node", "size", "rare", "at")


def _dealt(b: pa.RecordBatch) -> pa.RecordBatch:
    """A row for each of a set's first shingles, with its place in the set's order."""
    first = [np.frombuffer(x, np.int64) for x in b.column("first").to_pylist()]
    n = np.array([len(x) for x in first])
    row = [np.repeat(b.column(c).to_numpy(), n) for c in ("node", "size", "rare")]
    at = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(x) for x in (np.concatenate(first), *row, at)], names=list(BLOCK))


def _by_token(names: tuple[str, ...], make: Callable[..., Iterator[pa.RecordBatch]]):
    """Hands rows in the order of token to make, with all rows of a token at once; what it makes goes on bit by bit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []
        for b in batches:
            part = [b.column(c).to_numpy(zero_copy_only=False) for c in names]
            if not len(part[0]):
                continue
            cut = int(np.searchsorted(part[0], part[0][-1]))  # the last token may go on in the next batch
            if cut:
                yield from make(*(np.concatenate(x) for x in zip(*held, [y[:cut] for y in part], strict=True)))
                held = []
            held.append([x[cut:] for x in part])
        if held:
            yield from make(*(np.concatenate(x) for x in zip(*held, strict=True)))

    return run


def _fits(similarity: float, z: np.ndarray, a: np.ndarray, x: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which sets of sizes z and x can reach the similarity, if the first token they share is at places a and b."""
    most = 1 + np.minimum(z - 1 - a, x - 1 - b)
    return (most >= _needed(similarity / (1 + similarity), z + x)) & (np.minimum(z, x) >= _needed(similarity, np.maximum(z, x)))


def _met(similarity: float, small: int = 64):
    """Rows of the tokens that more than one set has; of small blocks, of the sets that another one fits."""

    def make(token, node, size, rare, at) -> Iterator[pa.RecordBatch]:
        equal = token[1:] == token[:-1]
        rows = np.flatnonzero(np.concatenate([[False], equal]) | np.concatenate([equal, [False]]))
        kept = np.ones(len(rows), bool)
        edge = np.flatnonzero(np.diff(token[rows])) + 1
        starts, ends = np.concatenate([[0], edge]), np.concatenate([edge, [len(rows)]])
        z, a = size[rows].astype(np.int64), at[rows].astype(np.int64)
        two = starts[ends - starts == 2]
        kept[two] = kept[two + 1] = _fits(similarity, z[two], a[two], z[two + 1], a[two + 1])
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            if 2 < e - s <= small:
                fits = _fits(similarity, z[s:e, None], a[s:e, None], z[None, s:e], a[None, s:e])
                np.fill_diagonal(fits, False)
                kept[s:e] = fits.any(axis=1)
        rows = rows[kept]
        yield pa.RecordBatch.from_arrays([pa.array(x[rows]) for x in (token, node, size, rare, at)], names=list(BLOCK))

    return make


CELLS = 1 << 20  # pairs of a block that are judged at a time; as many at most wait to be given


def _pairs(similarity: float, stars: bool):
    """(u, v) of a token that have different roots and can reach the similarity by their sizes, the token's places and their brief sketches.

    The bound by places holds at the first token that two sets share, that by sketches everywhere, so no such pair is lost. With stars, only pairs
    with one member, u, are given: that with the fewest rare shingles, to which edited copies are closest.
    """

    def given(us: list[np.ndarray], vs: list[np.ndarray]) -> pa.RecordBatch:
        u, v = np.concatenate(us), np.concatenate(vs)
        if not stars:
            u, v = np.minimum(u, v), np.maximum(u, v)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def make(token, node, size, rare, at, root, brief) -> Iterator[pa.RecordBatch]:
        brief = np.frombuffer(b"".join(brief), np.uint64).reshape(-1, BRIEF)
        edge = np.flatnonzero(np.diff(token)) + 1
        us, vs, held = [np.empty(0, np.int64)], [np.empty(0, np.int64)], 0
        for s, e in zip(np.concatenate([[0], edge]).tolist(), np.concatenate([edge, [len(token)]]).tolist(), strict=True):
            own, many = np.unique(root[s:e], return_counts=True)
            if len(own) < 2:
                continue
            if stars:
                order = np.lexsort((node[s:e], rare[s:e]))
                rows = 1
            else:  # by size; members of the commonest root come last: they are not compared with each other
                last = root[s:e] == own[many.argmax()]
                order = np.lexsort((size[s:e], last))
                rows = int((~last).sum())
            n, z, a, r, f = (x[s:e][order] for x in (node, size.astype(np.int64), at, root, brief))
            step = max(1, min(256, CELLS // len(n)))
            for i in range(0, rows, step):
                part = slice(i, min(i + step, rows))
                if stars:
                    others = np.arange(1, len(n))
                else:  # partners are sought among sizes within reach only
                    reach = int(z[part.stop - 1] / similarity) + 1
                    low = int(similarity * z[i])
                    others = np.concatenate([np.arange(i, int(np.searchsorted(z[:rows], reach, side="right"))), rows + np.arange(*np.searchsorted(z[rows:], [low, reach + 1]))])
                fits = (r[part, None] != r[None, others]) & (others[None, :] > np.arange(part.start, part.stop)[:, None])
                fits &= _fits(similarity, z[part, None], a[part, None], z[None, others], a[None, others])
                k, m = np.nonzero(fits)
                k, m = k + i, others[m]
                near = z[k] + z[m] - all_apart(f, z, k, m) >= 2 * _needed(similarity / (1 + similarity), z[k] + z[m])
                us.append(n[k[near]])
                vs.append(n[m[near]])
                held += int(near.sum())
                if held >= CELLS // 4:
                    yield given(us, vs)
                    us, vs, held = [], [], 0
        if us:
            yield given(us, vs)

    return make


def _close(similarity: float):
    """Pairs whose sketches leave room for the similarity; what is dropped here can't reach it."""

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        size = b.column("size_u").to_numpy().astype(np.int64) + b.column("size_v").to_numpy()
        least = np.array([apart(x, y) for x, y in zip(b.column("sketch_u").to_pylist(), b.column("sketch_v").to_pylist(), strict=True)], np.int64)
        kept = pa.array(size - least >= 2 * _needed(similarity / (1 + similarity), size))
        return pa.RecordBatch.from_arrays([b.column("u").filter(kept), b.column("v").filter(kept)], names=["u", "v"])

    return run


def _packed(b: pa.RecordBatch) -> pa.RecordBatch:
    """Texts compressed, as they are shuffled."""
    return pa.RecordBatch.from_arrays([b.column("node"), pa.array([pack(np.frombuffer((t or "").encode(), np.uint8)) for t in b.column("text").to_pylist()], pa.binary())], names=["node", "text"])


def _verified(similarity: float, shingle: int):
    """Of rows in the order of (u, part), u's own row first: the pairs that reach the similarity. One set of u is held at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, own = None, np.empty(0, np.uint64)
        for b in batches:
            us, vs = [], []
            for u, part, v, text in zip(*(b.column(c).to_pylist() for c in ("u", "part", "v", "text")), strict=True):
                found = shingle_set(unpack(text, "u1")[0].tobytes(), shingle)
                if v is None:
                    hub, own = (u, part), found
                    continue
                if hub != (u, part):
                    raise ValueError("a pair without its first text")
                shared = len(np.intersect1d(own, found, assume_unique=True))
                union = len(own) + len(found) - shared
                if union == 0 or shared >= _needed(similarity, union):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    return run


def _row():
    """A key of a row: equal for rows with the same doc_id and text only."""
    return F.xxhash64(F.col("doc_id").cast("long"), "text")


EDGES = 512  # of one node that are compared in one go


def _grouped(docs: DataFrame, similarity: float, shingle: int, most: int = 2) -> DataFrame:
    """doc_id, node (the row's key) and root (equal for the rows of a group) of each row.

    SimHash fingerprints of the sets that differ in ``most`` bits at most give the first candidates, found at their anchors; each
    block of sets that share one of their first shingles adds the pairs with one member. Then follow, as an exact join,
    all pairs of a block that no verified links have joined. Candidates pass a bound from sketches before their texts are compared.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _row().alias("node"), "text")
    every = max(1, docs.count() // SAMPLE)
    # The order of shingles decides how many are compared, never what is found: a bounded sample will do.
    sample = rows.where(F.pmod("node", F.lit(every)) == 0).select("text").mapInArrow(per_batch(_sampled(shingle)), "token long, n long")
    held = checkpoint(sample.groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN))
    least = (held.agg(F.sum("n")).first()[0] or 0) // KNOWN + 1
    often = held.where(F.col("n") >= least).toPandas()  # KNOWN rows at most
    tokens, counts = often["token"].to_numpy(np.int64).view(np.uint64), often["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    sets = checkpoint(rows.mapInArrow(per_batch(_prefixes(similarity, shingle, (tokens[order], counts[order]))), SETS))
    nodes = sets.groupBy("same").agg(F.min("node").alias("least"), *(F.first(c).alias(c) for c in ("size", "rare", "fp", "first", "sketch"))).withColumnRenamed("least", "node")
    blocked = "token long, node long, size int, rare int, at int"
    dealt = nodes.where("size > 0").select("node", "size", "rare", "first").mapInArrow(per_batch(_dealt), blocked)
    blocks = checkpoint(dealt.repartition(n, "token").sortWithinPartitions("token").mapInArrow(_by_token(BLOCK, _met(similarity)), blocked))
    del sample, dealt
    spark._jvm.System.gc()  # shuffle files go once the driver's JVM sees that no frame holds them
    fps = checkpoint(nodes.where("size > 0").select("node", "fp", "size", "sketch"))
    near = checkpoint(_alike(fps, most))
    asked = blocks.select("node").union(near.select(F.col("u").alias("node"))).union(near.select(F.col("v").alias("node"))).distinct()
    sketches = checkpoint(fps.join(asked, "node", "left_semi").select("node", "size", "sketch"))
    briefs = sketches.select("node", "sketch").mapInArrow(per_batch(_briefs), "node long, brief binary")
    packed = rows.select("node", "text").mapInArrow(per_batch(_packed), "node long, text binary")
    texts = checkpoint(packed.join(asked, "node", "left_semi").dropDuplicates(["node"]))
    del packed
    spark._jvm.System.gc()

    def linked(roots: DataFrame | None, stars: bool, more: DataFrame | None = None) -> DataFrame:
        rooted = blocks.withColumn("root", F.col("node")) if roots is None else blocks.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        ordered = rooted.select(*BLOCK, "root").join(briefs, "node").select(*BLOCK, "root", "brief").repartition(n, "token").sortWithinPartitions("token")
        met = ordered.mapInArrow(_by_token((*BLOCK, "root", "brief"), _pairs(similarity, stars)), "u long, v long")
        pairs = (met if more is None else met.union(more)).distinct()
        own = lambda c: sketches.select(F.col("node").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        close = checkpoint(pairs.join(own("u"), "u").join(own("v"), "v").select("u", "v", "size_u", "size_v", "sketch_u", "sketch_v").mapInArrow(per_batch(_close(similarity)), "u long, v long"))
        many = close.groupBy("u").agg(F.count(F.lit(1)).alias("many"))
        parted = close.join(many, "u").select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("many") / EDGES)).alias("part"))
        partners = parted.join(texts.withColumnRenamed("node", "v"), "v").select("u", "part", "v", "text")
        hubs = parted.select("u", "part").distinct().join(texts.withColumnRenamed("node", "u"), "u").select("u", "part", F.lit(None).cast("long").alias("v"), "text")
        both = hubs.union(partners).repartition(n, "u", "part").sortWithinPartitions("u", "part", "v")  # nulls come first
        return checkpoint(both.mapInArrow(_verified(similarity, shingle), "u long, v long"))

    first = linked(None, True, near)
    roots = checkpoint(components(first))
    spark._jvm.System.gc()
    second = linked(roots, False)
    spark._jvm.System.gc()
    # Links of the second pass join whole groups of the first.
    of = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}"))
    between = second.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    joined = components(between).select(F.col("node").alias("root"), F.col("root").alias("top"))
    whole = nodes.select("same", "node").join(roots, "node", "left").select("same", F.coalesce("root", "node").alias("root"))
    rooted = whole.join(joined, "root", "left").select("same", F.coalesce("top", "root").alias("root"))
    return sets.select("doc_id", "node", "same").join(rooted, "same").select("doc_id", "node", "root")


def _alike(nodes: DataFrame, most: int) -> DataFrame:
    """(u, v): nodes (node, fp) whose fingerprints differ in ``most`` bits at most, each with one neighbour at least."""
    one = nodes.groupBy("fp").agg(F.min("node").alias("least"))
    equal = nodes.join(one, "fp").where("node <> least").select(F.col("least").alias("u"), F.col("node").alias("v"))
    return equal.union(link(one.select(F.col("least").alias("node"), "fp"), most))


def near_copies(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """doc_id and component_id (the group's least doc_id) of each document; links are all pairs whose sets of shingles have that Jaccard similarity."""
    grouped = checkpoint(_grouped(docs, similarity, shingle))
    return grouped.join(grouped.groupBy("root").agg(F.min("doc_id").alias("component_id")), "root").select("doc_id", "component_id")


def one_of_each(docs: DataFrame, similarity: float = 0.8, shingle: int = 5) -> DataFrame:
    """docs without near copies: of each group the row with the least doc_id stays, with all its columns.

    Rows are told apart by doc_id and text, so rows that share a doc_id, or have none, are compared like all others; a row
    without doc_id stays only if no row of its group has one.
    """
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "node"))["node"]
    kept = checkpoint(_grouped(docs, similarity, shingle).groupBy("root").agg(first.alias("_kept")).select("_kept"))
    docs.sparkSession._jvm.System.gc()  # all else that the join wrote can go
    own = unused("_own", docs.columns)
    mark = unused("_mark", [*docs.columns, own])
    return docs.withColumn(own, _row()).join(kept.withColumnRenamed("_kept", mark), F.col(own) == F.col(mark), "left_semi").dropDuplicates([own]).drop(own)
