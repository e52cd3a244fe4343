"""The corpus operators against brute force, round trips and the libraries they follow."""

import base64
import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillmesh.llm import bpe, hmm, jpeg, media, packing, pii, quality, sharding, simhash, suffix, toxicity

SCHEMA = "doc_id long, text string, lang string, rest string"
EDGES = [None, "", " ", "\n", "a", "a" * 99, "b" * 100, "é" * 60, "x y", "x y z", "x y z", "ü ü ü ü ü", "one two three four\none two three four\n"]


def corpus(spark, seed=1, n=60):
    """Texts with copies, near copies, shared passages, ties, nulls and one very long text; more columns with clashing names."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(1, 8))) for _ in range(80)]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = list(EDGES)
    for i in range(n):
        own = [rng.choice(words) for _ in range(rng.randrange(1, 120))]
        if i % 5 == 0:
            own.insert(len(own) // 2, passage)
        texts.append(" ".join(own))
        if i % 6 == 0:
            texts.append(texts[-1])
        if i % 7 == 0:
            texts.append(texts[-1] + " tail")
    texts.append(" ".join(rng.choice(words) for _ in range(6000)))
    rows = [(i, t, "en", "x") for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows, SCHEMA).withColumnRenamed("rest", "score").repartition(5)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def removed(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum()) if len(gone) else 0
        out[doc_id] = (len(data), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(data, np.uint8)[~gone].tobytes()).hexdigest())
    return out


def test_suffix_array_against_brute_force(spark, monkeypatch):
    rows, df = corpus(spark)
    want = removed([(r[0], r[1]) for r in rows])
    for size in (1 << 21, 3000):
        monkeypatch.setattr(suffix, "SHARD_BYTES", size)
        got = by_id(suffix.digests(df))
        assert {i: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for i, r in got.items()} == want
    assert sum(x[1] for x in want.values()) > 0
    assert suffix.digests(empty(spark)).count() == 0
    kept = by_id(suffix.deduplicated(df))
    assert all(r.lang == "en" and r.score == "x" for r in kept.values()) and len(kept) == len(rows)


def test_suffix_array_order_and_prefixes():
    rng = random.Random(2)
    for _ in range(20):
        data = bytes(rng.choice(b"ab") for _ in range(rng.randrange(1, 400)))
        words = suffix.eights(data + suffix.PAD, len(data) + 108)
        order = suffix.suffix_array(words, len(data), 100)
        padded = data + bytes(100)
        assert order.tolist() == sorted(range(len(data)), key=lambda i: (padded[i : i + 100], i))
        shared = suffix.common_prefixes(words, order, 100, block=16)
        for k in range(1, len(order)):
            a, b = padded[order[k - 1] :][:100], padded[order[k] :][:100]
            assert shared[k] == next((i for i in range(100) if a[i] != b[i]), 100)


def test_repeated_rows_and_missing_ids(spark):
    text = "q" * 150
    rows = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None)], "doc_id long, text string")
    got = suffix.digests(rows).collect()
    assert sorted(r.n_removed for r in got) == [0, 149, 150, 150]
    for frame in (simhash.classes(rows), pii.digests(rows), media.digests(rows), quality.judge(rows), sharding.shard_rows(rows), hmm.score(rows)):
        assert frame.count() == 4


def test_toxicity_learns(spark):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(700):
        own = [rng.choice(words) for _ in range(30)]
        bad = i % 4 == 0
        if bad:
            own[rng.randrange(30)] = rng.choice(["vilebad", "rotten"])
        rows.append((i, " ".join(own), int(bad)))
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows] + [(1000, None), (1001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(5000, 1)], "doc_id long, toxic int")
    got = by_id(toxicity.classify(docs, labels))
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(got[i].held_out for i, _ in held)
    assert sum(got[i].predicted == y for i, y in held) >= 0.95 * len(held)
    assert got[1000].score == got[1001].score and 0 <= got[1000].score <= 1
    blind = by_id(toxicity.classify(docs, labels.limit(0)))
    assert {r.score for r in blind.values()} == {0.5}
    kept = {r.doc_id for r in toxicity.keep_harmless(docs.withColumn("score", F.lit("own")).withColumn("_toxicity", F.lit(1)), labels).collect()}
    assert kept == {i for i, r in got.items() if r.predicted == 0}
    for few in (labels.limit(0), labels.limit(3), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert toxicity.keep_harmless(docs, few).count() == docs.count()
    assert toxicity.classify(docs.limit(0), labels).count() == 0
    long = docs.union(spark.createDataFrame([(2000, "w1 vilebad " * 100_000), (3, "w1 w2"), (3, "w1 w2")], docs.schema))
    found = toxicity.classify(long.withColumn("label", F.lit("x")), labels).collect()
    assert len(found) == docs.count() + 3 and next(r for r in found if r.doc_id == 2000).predicted == 1


def test_ftrl_against_a_scalar_loop():
    rng = np.random.default_rng(11)
    slots = [np.append(np.sort(rng.choice(40, 6, replace=False)), 1 << toxicity.BITS) for _ in range(80)]
    labels = np.array([float(x[0] < 6) for x in slots])
    at, weight = toxicity.train(slots, labels, epochs=3, alpha=0.3, beta=1.0, l1=0.5, l2=0.5)
    z, n = Counter(), Counter()

    def w(i):
        if abs(z[i]) <= 0.5:
            return 0.0
        return -(z[i] - math.copysign(0.5, z[i])) / ((1.0 + math.sqrt(n[i])) / 0.3 + 0.5)

    order = np.random.default_rng(7)
    for _ in range(3):
        for k in order.permutation(80):
            own = {int(i): w(int(i)) for i in slots[k]}
            g = 1 / (1 + math.exp(-sum(own.values()))) - labels[k]
            for i, x in own.items():
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / 0.3 * x
                n[i] += g * g
    want = {i: w(i) for i in z if w(i)}
    assert set(at.tolist()) == set(want) and all(math.isclose(x, want[i], rel_tol=1e-9) for i, x in zip(at.tolist(), weight.tolist(), strict=True))
    assert len(want) < 41


@pytest.fixture(scope="module")
def merges():
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
    return path, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_is_the_library(spark, merges):
    path, library = merges
    rows, df = corpus(spark, n=20)
    rows = [*rows, (900, "日本語😀 ﬁn\x1c  x\n\n", "en", "x"), (901, "x" * 300, "en", "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = by_id(bpe.encode(df, path, public_tokenizers.PATTERN))
    short = by_id(bpe.digests(df, path, public_tokenizers.PATTERN))
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        assert got[doc_id].ids == ids and bytes(got[doc_id].decoded) == (text or "").encode()
        assert short[doc_id].n_tokens == len(ids) and short[doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert short[doc_id].decoded_sha256 == hashlib.sha256((text or "").encode()).hexdigest()
    assert bpe.digests(empty(spark), path, public_tokenizers.PATTERN).count() == 0
    again = spark.createDataFrame([(1, "same text", 3)] * 3 + [(None, "same text", 4)], "doc_id long, text string, ids int")
    found = bpe.encode(again, path, public_tokenizers.PATTERN).collect()
    assert len(found) == 4 and len({tuple(r.ids) for r in found}) == 1


def test_bpe_decodes_ids(merges):
    path, library = merges
    own = bpe.Codec(path, public_tokenizers.PATTERN)
    lists = [library.encode_ordinary(t) for t in ("one two", "", "\u65e5\u672c\U0001f600")]
    assert own.decode([np.array(x, np.int64) for x in lists]) == [library.decode_bytes(x) for x in lists]
    altered = [lists[0][0], *reversed(lists[0][1:]), 300]
    assert own.decode([np.array(altered, np.int64)]) == [library.decode_bytes(altered)] != [b"one two"]


def test_bpe_of_long_words(merges):
    path, library = merges
    own = bpe.Codec(path, public_tokenizers.PATTERN)
    rng = random.Random(6)
    parts = ["hello", "the", "tion", "ing", "aa", "\u65e5\u672c", "\u0432", "b"]
    words = ["x" * 5000, "=" * 4001, "ab" * 2000, "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(20_000)), "".join(rng.choice(parts) for _ in range(4000))]
    for w, entry in own.learn(words).items():
        assert entry.decode() == ",".join(map(str, library.encode_ordinary(w)))
    for n in range(1030, 1060):  # against the short way
        w = "".join(rng.choice("aab") for _ in range(n))
        assert own._encode_long(w) == own._encode([w])[0]


def test_language_model(spark):
    rows, df = corpus(spark)
    got = by_id(hmm.score(df, rounds=2, warm_rounds=3))
    cut = {i: (t or "").encode().lower().split() + [b"\n"] for i, t, *_ in rows}
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in cut}
    c = Counter(w for i, ws in cut.items() if not held[i] for w in ws)
    n, v = sum(c.values()), len(c)
    for i, ws in cut.items():
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(ws), sum(c[w] > 0 for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in ws), rel_tol=1e-9)
        assert r.score < 0
    assert hmm.score(empty(spark)).count() == 0
    # However the input is laid out, and with more columns, scores are the same.
    for other in (df.repartition(1), df.repartition(7, "doc_id").withColumn("shard", F.lit("x")).withColumn("held", F.lit(1))):
        again = by_id(hmm.score(other, rounds=2, warm_rounds=3))
        assert all(math.isclose(again[i].score, got[i].score, rel_tol=1e-4) for i in cut)


def test_language_model_in_plain_python(spark, monkeypatch):
    """The whole model, learned and scored word by word, for a corpus that all goes into the starting rounds."""
    rng = random.Random(12)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))) for i in range(40)]
    states, frequent = 2, 4096
    got = by_id(hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=states, rounds=2, warm_rounds=1))
    cut = {i: t.encode().lower().split() + [hmm.END] for i, t in rows}
    train = [i for i in cut if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for i in train for w in cut[i])
    n = sum(c.values())

    def kind(w):
        if c[w] and c[w] * frequent >= n:
            return xxhash.xxh64_intdigest(w, 13) >> 2 | 1 << 62
        return xxhash.xxh32_intdigest(w[-hmm.ENDING_BYTES :], 5) % hmm.ENDINGS

    tokens, distinct = Counter(), Counter()
    for w, k in c.items():
        tokens[kind(w)] += k
        distinct[kind(w)] += 1
    keys = sorted({*range(hmm.ENDINGS), *tokens})
    mass = np.array([tokens[k] + 0.1 * (distinct[k] + 1) for k in keys])
    shares, place = mass / mass.sum(), {k: i for i, k in enumerate(keys)}
    start, step, emit = hmm.fresh(states, shares)
    for _ in range(3):
        starts, moves, seen = np.ones(states), np.ones((states, states)), 20.0 * np.tile(shares, (states, 1))
        for i in train:
            x = [place[kind(w)] for w in cut[i]]
            alpha, beta = [start * emit[:, x[0]]], [np.ones(states)]
            for o in x[1:]:
                alpha.append(alpha[-1] @ step * emit[:, o])
            for o in reversed(x[1:]):
                beta.insert(0, step @ (emit[:, o] * beta[0]))
            total = alpha[-1].sum()
            for t, o in enumerate(x):
                gamma = alpha[t] * beta[t] / total
                seen[:, o] += gamma
                starts += gamma * (t == 0)
                if t:
                    moves += np.outer(alpha[t - 1], emit[:, o] * beta[t]) * step / total
        start, step, emit = starts / starts.sum(), moves / moves.sum(axis=1, keepdims=True), seen / seen.sum(axis=1, keepdims=True)
    for i, ws in cut.items():
        alpha, log = start * emit[:, place[kind(ws[0])]], 0.0
        for k, w in enumerate(ws):
            if k:
                alpha = alpha @ step * emit[:, place[kind(w)]]
            log += math.log10(alpha.sum()) + math.log10((c[w] + 0.1) / mass[place[kind(w)]])
            alpha = alpha / alpha.sum()
        assert math.isclose(got[i].score, log, rel_tol=1e-4)


def test_language_model_learns_from_all_documents(spark, monkeypatch):
    """Each round is over all training documents: a corpus of more than 5,000 is learned as by plain rounds over its chunks."""
    rng = random.Random(13)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 5))) for _ in range(25)]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randrange(0, 4)))) for i in range(9000)]
    models = []
    scored = hmm._scored
    monkeypatch.setattr(hmm, "_scored", lambda model, total: models.append(model) or scored(model, total))
    hmm.score(spark.createDataFrame(rows, "doc_id long, text string"), states=2, rounds=0, warm_rounds=2)
    cut = [t.encode().lower().split() + [hmm.END] for i, t in rows if zlib.crc32(str(i).encode()) % 10]
    c = Counter(w for ws in cut for w in ws)
    n = sum(c.values())
    key = {w: xxhash.xxh64_intdigest(w, 13) >> 2 | 1 << 62 for w in c}
    assert all(k * 4096 >= n for k in c.values())
    keys = sorted({*range(hmm.ENDINGS), *key.values()})
    place = {k: i for i, k in enumerate(keys)}
    mass = np.full(len(keys), 0.1)
    for w in c:
        mass[place[key[w]]] = c[w] + 0.2
    classes, lengths = np.array([place[key[w]] for ws in cut for w in ws]), np.array([len(ws) for ws in cut])
    shares = mass / mass.sum()
    model = hmm.fresh(2, shares)
    for _ in range(2):
        model = hmm.learned(np.concatenate([x.ravel() for x in hmm.expected(model, *hmm.chunked(classes, lengths, 8))]), 2, shares)
    assert all(np.allclose(x, y, rtol=1e-3, atol=1e-7) for x, y in zip(models[0], model, strict=True))


def test_forward_is_exact():
    rng = np.random.default_rng(1)
    start, step, emit = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(5), 3)
    lengths = np.array([4, 1, 7])
    classes = rng.integers(0, 5, lengths.sum())
    got = hmm.forward((start, step, emit), classes, lengths)
    for k, (b, n) in enumerate(zip(np.cumsum(lengths) - lengths, lengths, strict=True)):
        seq = classes[b : b + n]
        total = 0.0
        for path in np.ndindex(*[3] * n):
            p = start[path[0]] * emit[path[0], seq[0]]
            for t in range(1, n):
                p *= step[path[t - 1], path[t]] * emit[path[t], seq[t]]
            total += p
        assert math.isclose(got[k], math.log10(total), rel_tol=1e-9)


def test_chunks_count_every_transition_once():
    rng = np.random.default_rng(4)
    lengths = np.array([1, 2, 7, 8, 9, 30])
    classes = rng.integers(0, 5, lengths.sum())
    rows, mask, opens = hmm.chunked(classes, lengths, 8)
    assert opens.sum() == len(lengths) and mask.any(axis=1).all()
    pairs = [(int(r[t - 1]), int(r[t])) for r, m in zip(rows, mask, strict=True) for t in range(1, 8) if m[t]]
    ends = np.cumsum(lengths)
    want = [(int(a), int(b)) for e, n in zip(ends, lengths, strict=True) for a, b in zip(classes[e - n : e - 1], classes[e - n + 1 : e], strict=True)]
    assert Counter(pairs) == Counter(want) and mask.sum() - (~opens).sum() == lengths.sum()


def test_expected_counts_leave_padding_out():
    """Rows of mixed lengths against loops in doubles; padding holds a class that no state can emit, so any work on it shows."""
    rng = np.random.default_rng(7)
    start, step = rng.dirichlet(np.ones(3)), rng.dirichlet(np.ones(3), 3)
    emit = np.hstack([np.zeros((3, 1)), rng.dirichlet(np.ones(5), 3)])
    sizes = np.array([4, 20, 1, 9, 9, 13])
    opens = np.array([True, False, True, True, False, False])
    mask = np.arange(20)[None, :] < sizes[:, None]
    rows = rng.integers(1, 6, mask.shape) * mask
    starts, moves, seen = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 6))
    for row, n, first in zip(rows, sizes, opens, strict=True):
        x = row[:n]
        alpha, beta = [start * emit[:, x[0]]], [np.ones(3)]
        for o in x[1:]:
            alpha.append(alpha[-1] @ step * emit[:, o])
        for o in x[:0:-1]:
            beta.insert(0, step @ (emit[:, o] * beta[0]))
        total = alpha[-1].sum()
        for t, o in enumerate(x):
            if t or first:
                seen[:, o] += alpha[t] * beta[t] / total
            if t:
                moves += np.outer(alpha[t - 1], emit[:, o] * beta[t]) * step / total
        starts += first * alpha[0] * beta[0] / total
    got = hmm.expected((start, step, emit), rows, mask, opens)
    assert all(np.allclose(x, y, rtol=1e-4, atol=1e-6) for x, y in zip(got, (starts, moves, seen), strict=True))


def test_em_raises_likelihood():
    rng = np.random.default_rng(2)
    shares = np.full(6, 1 / 6)
    rows = rng.integers(0, 3, (40, 12)) + 3 * (np.arange(40) % 2)[:, None]
    model = hmm.fresh(2, shares)
    last = -np.inf
    for _ in range(5):
        now = hmm.forward(model, rows.ravel(), np.full(40, 12)).sum()
        assert now >= last - 1.0
        last = now
        counts = np.concatenate([np.asarray(x).ravel() for x in hmm.expected(model, rows, np.ones_like(rows, bool))])
        model = hmm.learned(counts, 2, shares)


MAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")


def test_pii_base_against_patterns(spark):
    rng = random.Random(5)
    parts = ["a.b@c.de", "@", "x@y", "1.2.3.4", "300.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+12", " ", "é", ".", "-", "7", "@d.e"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randrange(0, 12)))) for i in range(300)] + [(900, None)]
    got = by_id(pii.digests(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        t = t or ""
        want = [("email", *m.span()) for m in MAIL.finditer(t)]
        want += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(x) for x in m[0] if x.isdigit()]
            if 16 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(sum(divmod(2 * x, 10)) for x in d[-2::-2])) % 10 == 0:
                want.append(("card", *m.span()))
        want += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 8 <= sum(x.isdigit() for x in m[0]) <= 15]
        assert got[i].base_sha256 == hashlib.sha256(",".join(f"{a}:{b}:{c}" for a, b, c in want).encode()).hexdigest()
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(w[0] == k for w in want) for k in pii.KINDS]


def test_pii_terms(spark):
    rows = [(i, f"agent Zorblax wrote word{i} other{i} to zed@mail.example.com on day{i} more{i}", "k") for i in range(6)] + [(10, None, "k"), (11, "clean text", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    got = {r.doc_id: r for r in pii.sanitise(df).collect()}
    assert "Zorblax" not in got[0].text and "[EMAIL]" in got[0].text and "other0" in got[0].text
    assert got[10].text is None and got[11].text == "clean text" and got[0].spans == "k"


def test_pii_terms_far_from_the_entity(spark):
    far = lambda i, k: " ".join(f"filler{i}x{k}x{j}" for j in range(20))
    rows = [(i, f"Dear Quorvin, {far(i, 0)} agent Zorblax wrote to zed@mail.example.com on day{i} {far(i, 1)} Zorblax again") for i in range(6)]
    rows += [(20 + i, f"Hello Marwick, {far(i, 2)} write to ann@mail.example.com today{i}") for i in range(3)] + [(30 + i, f"Marwick rests {far(i, 3)}") for i in range(4)]
    got = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all("Zorblax" not in got[i] and "Quorvin" not in got[i] and f"filler{i}x0x3" in got[i] for i in range(6))
    assert all("Marwick" in got[i] for i in range(20, 23)) and got[30] == rows[9][1]  # 3 of 7 documents: below the share


def test_pii_terms_with_unicode_spaces(spark):
    rows = [(i, f"agent Zor\u00a0blax wrote word{i} to zed@mail.example.com on day{i} more{i}") for i in range(6)]
    got = pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and all("blax" not in r.text for r in got)


def test_simhash_against_brute_force(spark):
    rows, df = corpus(spark, n=80)
    got = by_id(simhash.classes(df))

    def fingerprint(text):
        w = (text or "").encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = {i: fingerprint(t) for i, t, *_ in rows}
    assert {i: r.fp % (1 << 64) for i, r in got.items()} == fps
    root = {i: i for i in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (fps[a] ^ fps[b]).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    assert {i: r.component_id for i, r in got.items()} == {i: find(i) for i in fps}


def test_anchors_meet():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64) * np.uint64(2)
    b = a.copy()
    for i in range(len(a)):
        for bit in rng.choice(64, 2, replace=False):
            b[i] ^= np.uint64(1) << np.uint64(bit)
    met = set(zip(*map(np.ndarray.tolist, simhash.anchors(a)), strict=True)) & set(zip(*map(np.ndarray.tolist, simhash.anchors(b)), strict=True))
    assert {i for i, _ in met} == set(range(len(a)))


def test_near_copies(spark):
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    rows, groups = [], {}
    for g in range(12):
        base = [rng.choice(words) for _ in range(200)]
        for k in range(3):
            own = list(base)
            if k:
                own[rng.randrange(200)] = "edited"
            groups[len(rows)] = g
            rows.append((len(rows), " ".join(own), "en"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.component_id for r in simhash.near_copies(df).collect()}
    assert all(got[i] == 3 * g for i, g in groups.items())
    assert sorted(r.doc_id for r in simhash.one_of_each(df).collect()) == [3 * g for g in range(12)]


def shingled(text):
    w = text.encode().lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}


def groups_by_brute_force(rows, similarity=0.8):
    sets, root = {i: shingled(t) for i, t in rows}, {i: i for i, _ in rows}
    for a in sets:
        for b in sets:
            if a < b and root[a] != root[b] and len(sets[a] & sets[b]) >= similarity * len(sets[a] | sets[b]):
                x, y = sorted((root[a], root[b]))
                root = {i: x if r == y else r for i, r in root.items()}
    return root


def test_near_copies_of_a_base_that_is_not_the_root(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    rows = []
    for _ in range(4):
        base = [rng.choice(words) for _ in range(300)]
        at = len(rows) + 23
        for i in range(len(rows), len(rows) + 40):
            own = list(base)
            for k in rng.sample(range(0, 300, 5), 0 if i == at else 6):
                own[k] = f"edit{rng.randrange(10**6)}"
            rows.append((i, " ".join(own)))
    want = groups_by_brute_force(rows)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) == 4


def test_near_copies_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SAMPLE", 50, raising=False)
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(2000)]
    common = [rng.choice(words) for _ in range(60)]
    rows = []
    for g in range(60):
        n = rng.choice((4, 12, 60, 200, 400))
        base = [rng.choice(words) for _ in range(n)] + common * (g % 3 == 0)
        n = len(base)
        rows.append((len(rows), " ".join(base)))
        for share in (0.05, 0.1, 0.12, 0.2, 0.23, 0.26):
            k = int(n * share)
            rows.append((len(rows), " ".join(base + [rng.choice(words) for _ in range(k)])))
            rows.append((len(rows), " ".join([rng.choice(words) for _ in range(k // 2)] + base[k // 2 :])))
    rng.shuffle(rows)
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == groups_by_brute_force(rows)


def test_blocks_give_only_pairs_within_reach():
    """Of sets that share much but don't reach the similarity, a block gives few of its pairs; of those that do, all."""
    rng = np.random.default_rng(9)
    for size, edits in ((60, (4, 14)), (400, (20, 90)), (5000, (100, 1200))):
        base = rng.integers(0, 1 << 63, size, np.uint64)
        sets = [np.unique(np.concatenate([base[rng.permutation(size)[k:]], rng.integers(0, 1 << 63, k, np.uint64)])) for k in [edits[0]] * 8 + [edits[1]] * 60]
        sketches = [simhash.sketch(x) for x in sets]
        u, v = np.triu_indices(len(sets), 1)
        z, f = np.array([len(x) for x in sets]), np.frombuffer(b"".join(map(simhash.brief, sketches)), np.uint64).reshape(-1, simhash.BRIEF)
        least = simhash.all_apart(f, z, u, v)
        assert all(n <= simhash.apart(sketches[a], sketches[b]) for a, b, n in zip(u, v, least, strict=True))
        if size < 500:
            assert all(n == simhash.apart(sketches[a], sketches[b]) for a, b, n in zip(u, v, least, strict=True))
        zero = np.zeros(len(sets), np.int64)
        given = {
            (int(a), int(b))
            for batch in simhash._pairs(0.8, False)(zero, np.arange(len(sets)), z, zero, zero, np.arange(len(sets)), np.array([simhash.brief(x) for x in sketches], object))
            for a, b in zip(*(batch.column(c).to_pylist() for c in ("u", "v")), strict=True)
        }
        similar = {(a, b) for a, b in zip(u.tolist(), v.tolist(), strict=True) if len(np.intersect1d(sets[a], sets[b])) >= 0.8 * len(np.union1d(sets[a], sets[b]))}
        assert similar and similar <= given
        if size < 500:
            assert len(given) < 0.2 * len(u)


def test_brief_sketches_of_unlike_lengths():
    rng = np.random.default_rng(10)
    sets = [np.unique(rng.integers(0, 1 << 63, n, np.uint64)) for n in (1, 2, 15, 16, 17, 31, 32, 63, 64, 127, 128, 255, 256, 257, 500, 511)]
    sketches = [simhash.sketch(x) for x in sets]
    u, v = np.triu_indices(len(sets), 1)
    f = np.frombuffer(b"".join(map(simhash.brief, sketches)), np.uint64).reshape(-1, simhash.BRIEF)
    assert simhash.all_apart(f, np.array([len(x) for x in sets]), u, v).tolist() == [simhash.apart(sketches[a], sketches[b]) for a, b in zip(u, v, strict=True)]


def test_near_copies_with_repeated_or_missing_ids(spark):
    base = [f"word{i}" for i in range(100)]
    rows = [(1, " ".join(base)), (1, "another text that has nothing in common with it"), (None, " ".join([*base, "more"])), (None, "alone " * 3 + " ".join(base[::-1])), (None, "alone " * 4 + " ".join(base[::-1])), (2, "short"), (2, "short")]
    got = sorted((r.doc_id or 0, r.text.split()[0]) for r in simhash.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, "alone"), (1, "another"), (1, "word0"), (2, "short")]


def test_sharding(spark):
    for n in (1, 2, 3, 7, 24, 101, 1000):
        assert sorted(r[0] for r in spark.range(n).select(sharding.permuted(F.col("id"), n)).collect()) == list(range(n))
    rows, df = corpus(spark)
    got = sharding.shard_rows(df, 24).collect()
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = [len(s) for s in slots.values()]
    assert max(sizes) - min(sizes) <= 1 and len(got) == len(rows)
    texts = {i: t or "" for i, t, *_ in rows}
    assert all(r.size == len(texts[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(texts[r.doc_id].encode()) for r in got)
    assert sharding.shard_rows(empty(spark)).count() == 0


def test_packing(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)  # untouched
    rows, _ = corpus(spark)
    special = ["hello <|endoftext|>", "a<|endoftext|>b <|startoftext|><|endoftext|>, x.", " <|endoftext|>\u0301 e\u0301", "<|ENDOFTEXT|> <|endoftext |>", "x <|endoftext|>\u3000y\x1cz", "\u0130stanbul \ufb01 it's B.\u0301 c"]
    rows = [*rows, *((7000 + i, t, "en", "x") for i, t in enumerate(special))]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("length", F.lit("mine")).repartition(5)
    got = packing.pack(df, path, room=256, with_ids=True).collect()
    want = {}
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids + [0]
        for k, at in enumerate(range(0, len(ids), 256)):
            want[i, k] = ids[at : at + 256]
    assert {(r.doc_id, r.piece): list(r.ids) for r in got} == want
    places = {}
    for r in got:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.start == 256 * r.piece
    for p in places.values():
        assert [o for o, _ in sorted(p)] == np.cumsum([0, *(n for _, n in sorted(p))])[:-1].tolist() and sum(n for _, n in p) <= 256
    total = sum(map(len, want.values()))
    assert len(places) <= math.ceil(total / 256) * 1.02 + 1
    assert packing.pack(empty(spark), path).count() == 0
    twice = packing.pack(spark.createDataFrame([(1, "a b c")] * 5 + [(None, None)], "doc_id long, text string"), path, room=8).collect()
    assert len(twice) == 6 and len({(r.sequence_id, r.offset) for r in twice}) == 6


def test_packing_encoder_is_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    marks = [chr(p) for p in range(0x300, 0x3100) if unicodedata.category(chr(p))[0] in "MP"]
    texts = [" ".join(f"{a}{m}x {a}{m}, {m}{a}." for a in "AaEIiJKS") for m in marks]
    texts += ["It's, DON'T! x'S. <|x ABC <|endoftext|> ABC.", "<|ENDOFTEXT|> a.,b ..", ", . a. A, \u00c9., \u00e9!"]
    own = packing.Encoder(path)
    for text, ids in zip(texts, own.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_packing_plan():
    rng = np.random.default_rng(1)
    counts = np.zeros(2049, np.int64)
    np.add.at(counts, np.minimum(rng.gamma(2, 300, 20000).astype(int) + 1, 2048), 1)
    found = packing.plan(counts)
    held = np.zeros_like(counts)
    for lengths, times in found:
        assert sum(lengths) <= 2048
        np.add.at(held, list(lengths), times)
    assert (held == counts).all()
    assert sum(t for _, t in found) <= 1.01 * math.ceil((counts * np.arange(2049)).sum() / 2048)


def test_jpeg(spark):
    rng = np.random.default_rng(7)
    for blocks in (1, 2, 5, 6, 7, 50):
        data = rng.integers(0, 256, 64 * blocks, dtype=np.uint8).tobytes()
        file = jpeg.encode(data)
        height, width, planes, sampling = jpeg.decode(file)
        assert jpeg.payload_of(planes, len(data)) == data and jpeg.rgb(height, width, planes, sampling).shape == (height, width, 3)
    rows, df = corpus(spark, n=10)
    got = by_id(media.digests(df))
    for i, t, *_ in rows:
        data = (t or "").encode()
        padded = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
    back = by_id(media.load(media.store(df)))
    assert bytes(back[8].payload)[:3] == b"x y"


def reader(bits):
    whole = bits + "1" * (-len(bits) % 8)
    return jpeg._Reader(int(whole, 2).to_bytes(len(whole) // 8, "big"), jpeg._bits(whole))


def test_jpeg_slow_paths():
    """The bit-by-bit readers agree with those over arrays."""
    codes = jpeg._codes(bytes([1, 0, 0, 0, 15, *[0] * 11]), bytes([0x01, *(n << 4 for n in range(15))]))
    block = np.zeros((2, 64), np.int32)
    jpeg._ac_first(block, reader("00" + "01" + "10000" + "10000"), codes, 1, 63, 1)
    assert block[0, 1:4].tolist() == [-2, 2, 0] and not block[1].any()
    jpeg._ac_refine(block, reader("10001" + "0" + "11"), codes, 1, 63, 0)
    assert block[0, 1:4].tolist() == [-3, 3, 0]
    rng = np.random.default_rng(3)
    start = rng.choice([-1, 1], (5, 64)).astype(np.int32) << 8
    for low in range(7, -1, -1):
        bits = "".join(map(str, rng.integers(0, 2, 5 * 63)))
        code = jpeg.AC_SYMBOLS[2 << 4] + "01"  # a run of 5 blocks
        slow, plane = start.copy(), jpeg._Plane(5)
        plane.c[:] = start
        jpeg._ac_refine(slow, reader(code + bits), codes, 1, 63, low)
        assert plane.has_no_zeros((1, 63))
        plane.correct(1, 63, low, jpeg._only_runs(reader(code + bits), codes, 5, 63))
        assert (plane.settle() == slow).all()
        start = slow


def test_media_edges(spark):
    assert media.digests(empty(spark)).count() == 0
    long = "long text é " * 40_000
    rows = [(1, None), (2, ""), (3, long), (4, long), (4, long), (None, "x")]
    got = media.digests(spark.createDataFrame(rows, "doc_id long, text string").withColumn("media", F.lit(1)).withColumn("n_bytes", F.lit("a"))).collect()
    assert len(got) == 6 and len({r[1:] for r in got if r.doc_id in (3, 4)}) == 1 and len({r[1:] for r in got if r.doc_id in (1, 2)}) == 1
    padded = long.encode() + bytes(-len(long.encode()) % 64)
    assert next(r for r in got if r.doc_id == 3).payload_sha256 == hashlib.sha256(padded).hexdigest()


def test_quality_em_against_a_scalar_loop():
    rng = np.random.default_rng(5)
    codes = np.unique(rng.integers(0, 3 ** len(quality.RULES), 30))
    counts = rng.integers(1, 50, len(codes)).astype(float)
    got = quality.estimate(codes, counts, rounds=7)
    cast = [[code // 3**r % 3 for r in range(len(quality.RULES))] for code in codes.tolist()]
    post = [1 / (1 + math.exp(-sum(0.5 * (v == 2) - 4.0 * (v == 0) for v in c))) for c in cast]
    for _ in range(7):
        table = {}
        for y in (0, 1):
            mass = [(p if y else 1 - p) * k for p, k in zip(post, counts, strict=True)]
            for r in range(len(quality.RULES)):
                own = [sum(m for m, c in zip(mass, cast, strict=True) if c[r] == v) + (2.0 if v == 2 * y else 1.0) for v in range(3)]
                own = [x / sum(own) for x in own]
                if y:
                    own[0] = min(own[0], 0.004)
                    own = [x / sum(own) for x in own]
                table[y, r] = own
        good = sum(p * k for p, k in zip(post, counts, strict=True))
        share = [(sum(counts) - good + 1) / (sum(counts) + 2), (good + 1) / (sum(counts) + 2)]
        logs = [[math.log(share[y]) + sum(math.log(table[y, r][v]) for r, v in enumerate(c)) for c in cast] for y in (0, 1)]
        post = [1 / (1 + math.exp(min(700, max(-700, a - b)))) for a, b in zip(*logs, strict=True)]
    assert np.allclose(got, post, rtol=1e-9, atol=1e-12)


def test_quality_measures():
    rng = random.Random(8)
    for _ in range(200):
        w = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randrange(0, 30))]
        n = Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j for i, t in enumerate(zip(w, w[1:], w[2:], strict=False)) if n[t] > 1 for j in (i, i + 1, i + 2)}
        assert quality.repeated_words(w) == len(covered)
    m = quality.measure("ab #\nab #\n\n \nxé")
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines) == (5, 8, 2, 1)


def test_quality_verdicts(spark):
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 8))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = [(i, text(200)) for i in range(60)] + [(100 + i, " ".join(w.upper() + "!!" for w in text(150).split())) for i in range(8)]
    rows += [(200 + i, " ".join(w + "###" for w in text(150).split())) for i in range(8)] + [(300, text(20)), (301, None)]
    got = by_id(quality.judge(spark.createDataFrame(rows, "doc_id long, text string")))
    assert all(got[i].kept for i in range(60))
    assert not any(got[i].kept for i, _ in rows[60:])
    assert got[300].base_failed and got[301].n_words == 0
    assert quality.judge(empty(spark)).count() == 0
