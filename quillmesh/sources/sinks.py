"""Reports, review bundles and event logs as files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmesh.operators import review

#: Events of the log. It has no column for text.
EVENTS = ("operation_blocked", "operation_created", "authorization_blocked", "operation_authorized", "completion_blocked", "completion_finished", "redaction_review_blocked", "redaction_reviewed", "stateless_blocked")


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def append_events(events: DataFrame, path: str) -> None:
    """Appends op_id, event, at and counts; other events and columns are refused."""
    columns = ["op_id", "event", "at", "n_reasons"]
    if set(events.columns) - set(columns):
        raise ValueError("the log takes no other columns than " + ", ".join(columns))
    checked = events.withColumn("event", F.when(F.col("event").isin(*EVENTS), F.col("event")).otherwise(F.raise_error(F.lit("unknown event")).cast("string")))
    checked.write.mode("append").json(path)


def write_bundle(cases: DataFrame, salt: str, path: str, version: str, source_sha256: str) -> None:
    """Blind items in their shuffled order, an empty template for labels, and the manifest."""
    items = review.blind_items(cases, salt).orderBy("shuffle_key")
    items.drop("shuffle_key").write.mode("overwrite").json(f"{path}/blind-items")
    review.template(items).write.mode("overwrite").json(f"{path}/review-template")
    review.manifest(items, salt, version, source_sha256).write.mode("overwrite").json(f"{path}/manifest")
