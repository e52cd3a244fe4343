"""The engine's functions under SQL names."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from quillmesh.operators.detect import entities_of


@udtf(returnType="value string, type string")
class DetectEntities:
    """SELECT * FROM detect_entities(text): a row for each entity."""

    def eval(self, text: str) -> Iterator[tuple[str, str]]:
        for e in entities_of(text):
            yield e["value"], e["type"]


#: name(parameters) RETURNS type, and its body.
FUNCTIONS = (
    ("pii_source_hash(v STRING)", "STRING", "sha2(encode(v, 'UTF-8'), 256)"),
    ("pii_is_card(v STRING)", "BOOLEAN", "length(regexp_replace(v, '[^0-9]', '')) BETWEEN 13 AND 19 AND luhn_check(regexp_replace(v, '[^0-9]', ''))"),
    ("pii_tokens(v STRING)", "ARRAY<STRING>", "regexp_extract_all(v, '__PII_[A-F0-9]{8,32}_(?:[A-Z][A-Z_]*_)?[0-9]{4}__', 0)"),
    ("pii_ratio(part BIGINT, whole BIGINT)", "DOUBLE", "CASE WHEN whole > 0 THEN bround(part / whole, 4) END"),
)


def register(spark: SparkSession) -> None:
    """Makes them known to the session."""
    for head, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {head} RETURNS {kind} RETURN {body}")
    spark.udtf.register("detect_entities", DetectEntities)
