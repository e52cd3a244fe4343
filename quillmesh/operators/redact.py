"""Redaction: from entities to spans, tokens, sanitized text and a mapping back.

An operation is a row with ``fields``, an array of (field, text) in order. Everything is an expression over the row's arrays, so that
redacting a table needs no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P
from quillmesh.functions import scalar as S
from quillmesh.operators.detect import settled

SPANS = "array<struct<field:string,field_pos:int,start:int,end:int,type:string,value:string>>"


def fields_of(*named: tuple[str, Column]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("field"), text.alias("text")) for name, text in named])


def input_code(fields: Column) -> Column:
    """Why fields can't be redacted at all, null if they can."""
    empty = F.forall(fields, lambda f: f["text"].isNull() | S.is_blank(f["text"]))
    reserved = F.exists(fields, lambda f: F.contains(F.lower(f["text"]), F.lit(P.TOKEN_PREFIX.lower())))
    return F.when(empty, F.lit("empty_input")).when(reserved, F.lit("reserved_token_in_input"))


def accepted(entities: Column) -> Column:
    """One entity for each value, by length (longest first), type and value."""
    ordered = F.array_sort(F.transform(F.filter(entities, lambda e: F.length(e["value"]) > 0), lambda e: F.struct((-F.length(e["value"])).alias("n"), e["type"].alias("type"), e["value"].alias("value"))))
    return F.aggregate(
        ordered,
        F.array().cast("array<struct<n:int,type:string,value:string>>"),
        lambda acc, e: F.when(F.exists(acc, lambda x: x["value"] == e["value"]), acc).otherwise(F.concat(acc, F.array(e))),
    )


def foreign(fields: Column, entities: Column) -> Column:
    """Whether some value isn't found in the fields."""
    corpus = F.array_join(F.transform(fields, lambda f: f["text"]), "\n")
    return F.exists(entities, lambda e: ~F.contains(corpus, e["value"]))


def occurrences(text: Column, value: Column) -> Column:
    """All starts of value in text, those that overlap each other too."""
    quoted = F.concat(F.lit("(?=\\Q"), F.replace(value, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E)"))
    parts = F.split(text, quoted, -1)
    ends = F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")),
        lambda acc, p: F.struct((acc["at"] + F.length(p)).alias("at"), F.concat(acc["out"], F.array(acc["at"] + F.length(p))).alias("out")),
        lambda acc: acc["out"],
    )
    inner = F.slice(ends, F.lit(1), F.size(ends) - 1)
    return F.when(F.startswith(text, value), F.concat(F.array(F.lit(0)), inner)).otherwise(inner)


def chosen(candidates: Column) -> Column:
    """Of candidates (n, start, type, value, end), ordered, those that overlap none chosen before; by start."""
    picked = F.aggregate(
        F.array_sort(candidates),
        F.array().cast("array<struct<n:int,start:int,type:string,value:string,end:int>>"),
        lambda acc, c: F.when(F.exists(acc, lambda x: (c["start"] < x["end"]) & (c["end"] > x["start"])), acc).otherwise(F.concat(acc, F.array(c))),
    )
    return F.array_sort(F.transform(picked, lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["type"].alias("type"), c["value"].alias("value"))))


def candidate_spans(text: Column, entities: Column) -> Column:
    return F.flatten(
        F.transform(
            entities,
            lambda e: F.transform(
                F.when(F.contains(text, e["value"]), occurrences(text, e["value"])).otherwise(F.array().cast("array<int>")),
                lambda s: F.struct((-F.length(e["value"])).alias("n"), s.alias("start"), e["type"].alias("type"), e["value"].alias("value"), (s + F.length(e["value"])).alias("end")),
            ),
        )
    )


def spans(fields: Column, entities: Column) -> Column:
    """Non-overlapping spans of all fields, in the order of fields and starts."""
    return F.flatten(
        F.transform(
            fields,
            lambda f, i: F.transform(
                chosen(candidate_spans(f["text"], entities)),
                lambda s: F.struct(f["field"].alias("field"), i.alias("field_pos"), s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type"), s["value"].alias("value")),
            ),
        )
    ).cast(SPANS)


def used_entities(found: Column) -> Column:
    """Distinct (type, value) of spans, by length (longest first), type and value."""
    return F.array_sort(F.array_distinct(F.transform(found, lambda s: F.struct((-F.length(s["value"])).alias("n"), s["type"].alias("type"), s["value"].alias("value")))))


def tokens(found: Column, nonce: Column, typed: bool) -> Column:
    """spans with their tokens."""
    if typed:
        used = used_entities(found)
        numbered = F.transform(used, lambda e, i: F.struct(e["type"].alias("type"), e["value"].alias("value"), (F.size(F.filter(F.slice(used, F.lit(1), i), lambda x: x["type"] == e["type"])) + 1).alias("k")))

        def named(s: Column, i: Column) -> Column:
            own = F.element_at(F.filter(numbered, lambda e: (e["type"] == s["type"]) & (e["value"] == s["value"])), 1)
            return F.format_string("%s%s_%s_%04d__", F.lit(P.TOKEN_PREFIX), nonce, s["type"], own["k"])
    else:

        def named(s: Column, i: Column) -> Column:
            return F.format_string("%s%s_%04d__", F.lit(P.TOKEN_PREFIX), nonce, i + 1)

    return F.transform(found, lambda s, i: F.struct(*[s[c].alias(c) for c in ("field", "field_pos", "start", "end", "type", "value")], named(s, i).alias("token")))


def spliced(fields: Column, tokened: Column) -> Column:
    """Fields with each span replaced by its token."""

    def one(f: Column, i: Column) -> Column:
        own = F.filter(tokened, lambda s: s["field_pos"] == i)
        done = F.aggregate(
            own,
            F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
            lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["out"], S.sub(f["text"], acc["at"], s["start"]), s["token"]).alias("out")),
        )
        return F.struct(f["field"].alias("field"), F.concat(done["out"], S.sub(f["text"], done["at"], F.length(f["text"]))).alias("text"))

    return F.transform(fields, one)


def mapping(tokened: Column) -> Column:
    """token to value."""
    return F.map_from_entries(F.array_distinct(F.transform(tokened, lambda s: F.struct(s["token"], s["value"]))))


def counts(found: Column) -> Column:
    """Distinct values of each type, as an array of (type, n) by type."""
    used = used_entities(found)
    kinds = F.array_sort(F.array_distinct(F.transform(used, lambda e: e["type"])))
    return F.transform(kinds, lambda t: F.struct(t.alias("type"), F.size(F.filter(used, lambda e: e["type"] == t)).alias("n")))


def redact(df: DataFrame, nonce: Column, typed: bool = False) -> DataFrame:
    """df (with fields and entities) with error, spans (with tokens), sanitized fields and mapping.

    error is why the operation fails; such rows get no spans. The columns are made one after the other, so that no step is evaluated twice.
    """
    coded = settled(settled(df, "fields", "entities").withColumn("_accepted", accepted(F.col("entities"))), "_accepted")
    code = input_code(F.col("fields"))
    coded = coded.withColumn("error", F.coalesce(code, F.when(foreign(F.col("fields"), F.col("_accepted")), F.lit("non_exact_substring"))))
    coded = settled(coded, "error")
    spanned = coded.withColumn("spans", F.when(F.col("error").isNull(), spans(F.col("fields"), F.col("_accepted"))).otherwise(F.array().cast(SPANS)))
    return redact_spans(settled(spanned.drop("_accepted"), "spans"), nonce, typed)


def redact_spans(df: DataFrame, nonce: Column, typed: bool = False) -> DataFrame:
    """df (with fields and spans) with tokens in the spans, sanitized fields and mapping."""
    named = settled(df.withColumn("spans", tokens(F.col("spans"), nonce, typed)), "spans")
    return settled(named.withColumns({"sanitized": spliced(F.col("fields"), F.col("spans")), "mapping": mapping(F.col("spans"))}), "sanitized", "mapping")


def span_error(fields: Column, found: Column) -> Column:
    """Why reviewed spans can't be used, null if they can."""
    by = lambda s: F.get(F.filter(fields, lambda f: f["field"] == s["field"]), F.lit(0))
    unknown = F.exists(found, lambda s: by(s).isNull())
    bounds = F.exists(found, lambda s: (s["start"] < 0) | (s["end"] <= s["start"]) | (s["end"] > F.length(by(s)["text"])))
    overlap = F.exists(found, lambda a: F.size(F.filter(found, lambda b: (a["field"] == b["field"]) & (a["start"] < b["end"]) & (a["end"] > b["start"]))) > 1)
    return F.when(unknown, F.lit("unknown_field")).when(bounds, F.lit("invalid_span")).when(overlap, F.lit("overlapping_spans"))


def bad_nonce(nonce: Column) -> Column:
    return ~F.upper(nonce).rlike(P.NONCE)
