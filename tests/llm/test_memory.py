"""What Python workers get at a time, and what they give back."""

import os
import re

import public_tokenizers
import pyarrow as pa
import pytest

from quillmesh.llm import common, packing


def private_mb() -> float:
    with open("/proc/self/smaps_rollup") as f:
        return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", f.read()))) / 1024


def test_batches_are_bounded_in_bytes(spark):
    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows]), pa.array([b.nbytes])], names=["rows", "bytes"])

    common.small_batches(spark)
    rows = spark.range(0, 300, 1, 1).selectExpr("repeat('x', 100000) as text")
    found = rows.mapInArrow(sizes, "rows long, bytes long").collect()
    assert sum(r.rows for r in found) == 300
    assert max(r.bytes for r in found) <= common.BYTES + 200_000


@pytest.mark.skipif(not os.path.exists("/proc/self/smaps_rollup"), reason="no /proc")
def test_a_task_of_another_module_gives_memory_back():
    kept = {"texts": [os.urandom(2000) for _ in range(100_000)]}
    common.holds("one", kept.clear)
    top = os.urandom(2000)  # what is freed below it stays in the allocator
    before = private_mb()
    common.holds("two")
    assert not kept and top
    assert before - private_mb() > 100
    common._held.pop("two")


def test_few_known_chunks_give_the_same_pieces(spark):
    rows = [(i, f"Word{i} and {'more ' * (i % 7)}words{i * 7}, the{i % 3} end." if i % 5 else None) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    path = public_tokenizers.path("word_bpe_49k.json")
    few, many = (sorted(map(tuple, packing.pieces(docs, path, keep=n).collect())) for n in (100, packing.KEEP))
    assert few == many and len(few) == 3000
