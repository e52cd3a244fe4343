"""Training-data pipeline: documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the next one gets it after it has been written and read again. All
but the last return the columns of ``documents``, and any more that the input has, whatever their names. Empty tables pass all stages.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.llm import packing, pii, simhash, suffix, toxicity
from quillmesh.llm.common import checkpoint, read, small_batches

TOXIC = 0.3
SIMILARITY, SHINGLE = 0.8, 5
ROOM = 2048
KEEP = 300_000  # chunks a worker knows; a long-lived executor has both its workers and a full heap in one budget


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity stays below the threshold. Null and empty texts are judged like others; without labels that tell anything all stay."""
    return toxicity.keep_harmless(docs, read(spark, sf_dir, "labels"), TOXIC)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies. Null and empty texts are one group; of rows equal in doc_id and text one stays."""
    small_batches(spark)
    return simhash.one_of_each(docs, similarity=SIMILARITY, shingle=SHINGLE)


def _counted(docs: DataFrame) -> DataFrame:
    """docs whose n_chars, if there is one, is that of the text."""
    if "n_chars" not in docs.columns:
        return docs
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without byte strings that are found earlier. Every row stays; null texts become empty."""
    small_batches(spark)
    return _counted(suffix.deduplicated(docs))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data, and terms that reveal it, masked. Every row stays; null texts stay null."""
    small_batches(spark)
    return _counted(pii.sanitise(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece in the packed sequences. Null and empty texts give a piece of their own."""
    small_batches(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), room=ROOM, keep=KEEP)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("simhash", drop_near_copies),
    ("suffix_array", cut_repeats),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]

#: No SQL expresses these stages; the tests hold them against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what passes between stages is written to the cluster's shared folder and read again."""
    docs = read(spark, sf_dir)
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = checkpoint(docs)
    return docs
