"""Receipts without values: what was reviewed and authorised, signed with a key."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import scalar as S


def key_id(key: bytes) -> str:
    return hashlib.sha256(key).hexdigest()[:16]


def fingerprint(key: bytes, kind: str, value: Column) -> Column:
    return S.hmac_sha256(key, F.concat(F.lit(f"{kind}:"), value))


def canonical(body: Column, sort_maps: bool = False) -> Column:
    """JSON of a struct whose fields are in order: no spaces, nulls kept."""
    return F.to_json(body, {"ignoreNullFields": "false"})


def body(key: bytes, persistent: bool = False, build: str = "unknown") -> Column:
    """The receipt's content from columns op_id, issued_at_unix, model, token_mode, status, review_revision, review_channel, authorized_revision,
    authorization_channel, acknowledged_warnings, fields, spans (with tokens), entity_counts, security_warnings and detector_warnings.

    Fields stand in the order of their names, so that equal receipts have equal JSON.
    """
    sources = F.array_sort(F.transform("fields", lambda f: F.struct(f["field"].alias("field"), fingerprint(key, "source", S.source_hash(f["text"])).alias("fingerprint"))))
    reds = F.transform("spans", lambda s: F.struct(s["end"].alias("end"), s["field"].alias("field"), s["start"].alias("start"), fingerprint(key, "token", s["token"]).alias("token_fingerprint"), s["type"].alias("type")))
    parts = {
        "acknowledged_warnings": F.col("acknowledged_warnings"), "authorization_channel": F.col("authorization_channel"), "authorized_revision": F.col("authorized_revision"),
        "build_commit": F.lit(build), "detector_warnings": F.sort_array("detector_warnings"), "entity_counts": F.map_from_entries("entity_counts"),
        "issued_at_unix": F.col("issued_at_unix"), "key_id": F.lit(key_id(key)), "key_persistence": F.lit("configured" if persistent else "ephemeral_process_key"),
        "model": F.col("model"), "operation_id": F.col("op_id"), "redactions": reds, "review_channel": F.col("review_channel"), "review_revision": F.col("review_revision"),
        "security_warnings": F.sort_array("security_warnings"), "source_fingerprints": F.map_from_entries(sources), "status": F.col("status"), "token_mode": F.col("token_mode"), "version": F.lit(1),
    }
    return F.struct(*[c.alias(n) for n, c in parts.items()])


def signed(ops: DataFrame, key: bytes, **how) -> DataFrame:
    """ops with receipt (JSON) and signature."""
    made = ops.withColumn("receipt", canonical(body(key, **how)))
    return made.withColumn("signature", S.hmac_sha256(key, F.col("receipt")))


def verified(receipt: Column, signature: Column, key: bytes) -> Column:
    """Whether a receipt is by this key and unchanged."""
    return F.coalesce((F.get_json_object(receipt, "$.key_id") == key_id(key)) & (signature == S.hmac_sha256(key, receipt)), F.lit(False))
