"""Blind human review: bundles without labels, checks of what comes back, and its score."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P
from quillmesh.functions import scalar as S
from quillmesh.operators import evaluate


def blind_id(salt: str, case_id: Column) -> Column:
    return F.left(S.hmac_sha256(salt.encode(), case_id.cast("string")), F.lit(16))


def blind_items(cases: DataFrame, salt: str) -> DataFrame:
    """item_id, language and text, with the place of each item in an order that only the salt's owner can derive."""
    items = cases.select(blind_id(salt, F.col("case_id")).alias("item_id"), F.coalesce("language", F.lit("unknown")).alias("language"), "text")
    return items.withColumn("shuffle_key", F.sha2(F.concat(F.lit(salt), "item_id"), 256))


def template(items: DataFrame) -> DataFrame:
    return items.select("item_id", F.array().cast("array<struct<value:string,type:string>>").alias("entities"), F.lit("").alias("reviewer_id"), F.lit("").alias("reviewed_at"))


def manifest(items: DataFrame, salt: str, version: str, source_sha256: str) -> DataFrame:
    return items.agg(F.count(F.lit(1)).alias("items")).select(
        F.lit(version).alias("version"), "items", F.lit(source_sha256).alias("source_sha256"), F.lit(False).alias("labels_included"), F.lit(False).alias("case_ids_included"),
        F.lit(hashlib.sha256(salt.encode()).hexdigest()[:12]).alias("salt_id"), F.lit("not_collected").alias("human_results"),
    )


def violations(items: DataFrame, rows: DataFrame) -> DataFrame:
    """item_id and reason of everything that makes labels unusable; no rows if they are fine.

    rows have item_id and entities, an array of (value, type) or null.
    """
    twice = items.groupBy("item_id").count().where("count > 1").select("item_id", F.lit("duplicate_item").alias("reason"))
    again = rows.groupBy("item_id").count().where("count > 1").select("item_id", F.lit("duplicate_label").alias("reason"))
    unknown = rows.join(items, "item_id", "left_anti").select("item_id", F.lit("unknown_item").alias("reason"))
    missing = items.join(rows, "item_id", "left_anti").select("item_id", F.lit("missing_item").alias("reason"))
    unlisted = rows.where(F.col("entities").isNull()).select("item_id", F.lit("entities_not_a_list").alias("reason"))
    each = rows.join(items.select("item_id", "text"), "item_id").select("item_id", "text", F.explode("entities").alias("e"))
    value, kind = F.coalesce(F.col("e.value"), F.lit("")), F.coalesce(F.col("e.type"), F.lit(""))
    wrong = each.withColumn("reason", F.when(~kind.isin(*P.ENTITY_TYPES), F.lit("unknown_type")).when((value == "") | ~F.contains(F.col("text"), value), F.lit("not_a_substring")))
    found = [twice, again, unknown, missing, unlisted, wrong.where("reason is not null").select("item_id", "reason")]
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.distinct()


def labels(rows: DataFrame) -> DataFrame:
    """Distinct (case_id, value, type) of label rows."""
    return rows.select(F.col("item_id").alias("case_id"), F.explode("entities").alias("e")).select("case_id", F.col("e.value").alias("value"), F.col("e.type").alias("type")).distinct()


def score(human: DataFrame, predictions: DataFrame) -> DataFrame:
    """Overall metrics with the interval of recall."""
    return evaluate.with_wilson(evaluate.overall(evaluate.marked(labels(human), labels(predictions))))


def case_scores(items: DataFrame, human: DataFrame, predictions: DataFrame) -> DataFrame:
    """expected, predicted and true_positives of each item."""
    pairs = evaluate.marked(labels(human), labels(predictions)).withColumnRenamed("case_id", "item_id")
    sums = pairs.groupBy("item_id").agg(F.sum("is_expected").alias("expected"), F.sum("is_actual").alias("predicted"), F.sum("hit").alias("true_positives"))
    return items.select("item_id").join(sums, "item_id", "left").na.fill(0)
