"""Each stage of the pipeline on its own input, against brute force over the smallest tables."""

import datetime
import os
import zlib
from decimal import Decimal

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from quillmesh.llm import pii, toxicity

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage got and gave, written and read again in between."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp(name))
        stage(spark, docs, SF).write.mode("overwrite").parquet(path)
        made = spark.read.parquet(path)
        out.append((docs, made))
        docs = made
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.select("doc_id", "text").collect()}


def test_columns(stages):
    for before, after in stages[:-1]:
        assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert before.select("doc_id").distinct().count() == before.count()
    for _, after in stages[2:4]:
        assert after.where(F.length("text") != F.col("n_chars")).count() == 0


def test_toxic(spark, stages):
    before, after = stages[0]
    model = toxicity.fit(before, toxicity.usable(spark.read.parquet(f"{SF}/labels.parquet")))
    weights = dict(zip(model["slot"].tolist(), model["weight"].tolist(), strict=True))

    def score(text):
        w = weights.get(1 << toxicity.BITS, 0.0) + sum(weights.get(s, 0.0) for s in set(toxicity.feature_slots(text).tolist()))
        return 1 / (1 + np.exp(-w))

    scores = {i: score(t) for i, t in texts(before).items()}
    kept = set(texts(after))
    assert all((s < 0.3) == (i in kept) for i, s in scores.items() if abs(s - 0.3) > 1e-4)


def test_near_copies(stages):
    before, after = stages[1]
    sets = {}
    for i, t in texts(before).items():
        w = t.encode().lower().split()
        sets[i] = {b" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    kept = set(texts(after))

    def similar(a, b):
        return len(sets[a] & sets[b]) / len(sets[a] | sets[b]) if sets[a] | sets[b] else 1.0

    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            if i < j and similar(i, j) >= 0.8:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    assert kept == {i for i in sets if find(i) == i}
    exact = {}
    for i, t in texts(before).items():
        exact.setdefault(t, []).append(i)
    assert all(sum(i in kept for i in ids) <= 1 for ids in exact.values())


def test_repeats(stages):
    before, after = stages[2]
    seen, got = set(), texts(after)
    for i, t in sorted(texts(before).items()):
        data = t.encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            if data[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(data[p : p + 100])
        assert got[i] == np.frombuffer(data, np.uint8)[~gone].tobytes().decode(errors="ignore")


def test_personal_data(stages):
    before, after = stages[3]
    got = texts(after)
    for i, t in texts(before).items():
        base = [(pii.KINDS[k], s, e) for k, s, e in pii.base_spans(t)]
        if not base:
            assert got[i] == t
        else:
            assert all(t[s:e] not in got[i] for _, s, e in base)


def test_packing(stages):
    before, after = stages[4]
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, t in texts(before).items():
        ids = library.encode(t, add_special_tokens=False).ids + [0]
        want |= {(i, k, zlib.crc32(np.array(ids[2048 * k : 2048 * k + 2048], "<u4").tobytes())) for k in range(-(-len(ids) // 2048))}
    rows = after.collect()
    assert {(r.doc_id, r.piece, r.ids_crc32) for r in rows} == want and len(rows) == len(want)


def words(n, step):
    return " ".join(f"w{i * step % 977}x" for i in range(n))


def test_edges_of_all_stages(spark):
    """Nulls, empty and long texts, repeated rows, rows without doc_id, an empty table, and columns whose names the stages use themselves."""
    clash = ["score", "n_removed", "rest", "_kept", "_own", "_text", "_toxicity", "found", "_spans", "shard", "label", "blob", "docs", "node", "_1"]
    rows = [(1, None), (2, ""), (3, words(300, 7)), (4, words(300, 7) + " end"), (5, words(40_000, 31)), (6, "mail bob@example.com now"), (None, words(200, 11)), (7, "mail bob@example.com now"), (7, "mail bob@example.com now"), (8, words(20, 5) + "\u00e9" * 50)]
    stamp = datetime.datetime(2020, 1, 2, 3, 4, 5, 123456)
    docs = spark.createDataFrame([(i, t, stamp, ["a", None], Decimal("1.50")) for i, t in rows], "doc_id long, text string, stamp timestamp, tags array<string>, price decimal(10,2)")
    docs = docs.select("*", *(F.lit(c).alias(c) for c in clash))
    left = {"toxicity": 10, "simhash": 6, "suffix_array": 10, "pii": 10}
    for name, stage in corpus_pipeline.STAGES:
        found = stage(spark, docs, SF)
        nothing = stage(spark, docs.limit(0), SF)
        assert nothing.count() == 0
        if name == "packing":
            assert found.where("piece = 0").count() == 10
            continue
        assert found.columns == docs.columns == nothing.columns
        got = found.collect()
        assert len(got) == left[name]
        assert all(r.stamp == stamp and r.tags == ["a", None] and r.price == Decimal("1.50") and all(r[c] == c for c in clash) for r in got)


def test_no_labels(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "some words")], "doc_id long, text string")
    assert corpus_pipeline.drop_toxic(spark, docs, str(tmp_path)).count() == 3


def test_run(spark, stages):
    assert {tuple(r) for r in corpus_pipeline.run(spark, SF).select("doc_id", "piece", "ids_crc32").collect()} == {(r.doc_id, r.piece, r.ids_crc32) for r in stages[-1][1].collect()}
