"""Admission: why a file or a request is refused. The first reason in the order below wins; null admits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P
from quillmesh.functions import scalar as S

#: Models that may be asked for.
MODELS = ("qwen/qwen3.5-9b", "google/gemma-4-e4b", "ensemble/both-local-models")
ALIASES = {"qwen": MODELS[0], "gemma": MODELS[1], "both": MODELS[2]}


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def file_reason(path: Column, size: Column) -> Column:
    """From name and size alone, so that refused files are never read."""
    return F.when(~suffix(path).isin(*P.SUFFIXES), F.lit("unsupported_type")).when(size == 0, F.lit("empty_file")).when(size > P.MAX_FILE_BYTES, F.lit("file_too_large"))


def text_reason(text: Column) -> Column:
    """Of extracted text; what is counted is the text without white space at its ends."""
    stripped = S.strip(text)
    return F.when(text.isNull(), F.lit("undecodable")).when(S.is_blank(text), F.lit("no_text")).when(F.length(stripped) > P.MAX_TEXT, F.lit("text_too_long"))


def request_reason(text: Column, task: Column, model: Column) -> Column:
    return (
        F.when(~F.coalesce(F.length(text), F.lit(0)).between(1, P.MAX_TEXT), F.lit("text_bounds"))
        .when(~F.coalesce(F.length(task), F.lit(0)).between(1, P.MAX_TASK), F.lit("task_bounds"))
        .when(~F.coalesce(model, F.lit("")).isin(*MODELS), F.lit("unsupported_model"))
    )


def edits_reason(edits: Column) -> Column:
    bad = F.exists(edits, lambda e: ~e["start"].between(0, P.MAX_TEXT) | ~e["end"].between(1, P.MAX_TEXT))
    return F.when(F.size(edits) > P.MAX_EDITS, F.lit("too_many_edits")).when(bad, F.lit("edit_bounds"))


def model_of(alias: Column) -> Column:
    out = alias
    for short, full in ALIASES.items():
        out = F.when(alias == short, F.lit(full)).otherwise(out)
    return out
