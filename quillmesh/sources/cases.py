"""JSON-lines tables: labelled cases, review items, label rows and receipts. Schemas are explicit; nothing is inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P

ENTITIES = "array<struct<value:string,type:string>>"
CASES = f"id string, language string, category string, text string, entities {ENTITIES}"
ITEMS = "item_id string, language string, text string"
LABELS = f"item_id string, entities {ENTITIES}, reviewer_id string, reviewed_at string"


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """case_id, language, category, text and entities, with defaults."""
    rows = spark.read.schema(CASES).option("mode", "FAILFAST").json(path)
    return rows.select(F.col("id").alias("case_id"), F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("category", F.lit("standard")).alias("category"), "text", F.coalesce("entities", F.array().cast(ENTITIES)).alias("entities"))


def read_items(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ITEMS).option("mode", "FAILFAST").json(path)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LABELS).option("mode", "FAILFAST").json(path)


def read_receipts(spark: SparkSession, path: str) -> DataFrame:
    """receipt (its JSON text) and signature."""
    return spark.read.schema("receipt string, signature string").option("mode", "FAILFAST").json(path)


def case_violations(cases: DataFrame) -> DataFrame:
    """case_id and reason of cases that can't be used: ids that are not unique, unknown types, values that are not in the text."""
    twice = cases.groupBy("case_id").count().where("count > 1").select("case_id", F.lit("duplicate_id").alias("reason"))
    each = cases.select("case_id", "text", F.explode("entities").alias("e"))
    wrong = F.when(~F.col("e.type").isin(*P.ENTITY_TYPES), F.lit("unknown_type")).when(~F.contains(F.col("text"), F.col("e.value")), F.lit("not_a_substring"))
    return twice.unionByName(each.select("case_id", wrong.alias("reason")).where("reason is not null").distinct())
