"""Detection of sensitive values by rules, and its union with what other detectors propose.

``entities`` is an expression over a text column: one array of (value, type) for each row, without a shuffle and without Python. Texts
whose canonical form differs from themselves take ``unusual_entities``, a vectorised function that maps each match back to its source.
``with_entities`` sends each row the right way.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillmesh.functions import patterns as P
from quillmesh.functions import scalar as S
from quillmesh.operators.canon import canonical, is_usual

ENTITIES = "array<struct<value:string,type:string>>"


def _passes(kind: str) -> Callable[[Column], Column]:
    return {"CARD": S.is_card, "PHONE": S.is_phone}.get(kind, lambda v: F.lit(True))


def candidates(text: Column, rule: P.Rule) -> Column:
    """Values that one rule finds, in the order of the text."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    if rule.type in ("CARD", "PHONE"):
        found = F.filter(found, _passes(rule.type))
    return F.when(text.rlike(rule.hint), found).otherwise(F.array().cast("array<string>"))


def priority(kind: Column) -> Column:
    out = F.lit(P.LAST_PRIORITY)
    for name, value in P.PRIORITY.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def first_of_each_value(found: Column) -> Column:
    """One entity for each value, the one of least priority, of these the first; sorted by length (longest first), type and value."""
    keyed = F.transform(found, lambda e, i: F.struct(e["value"].alias("value"), priority(e["type"]).alias("priority"), i.alias("seen"), e["type"].alias("type")))
    ordered = F.array_sort(keyed)
    firsts = F.aggregate(
        ordered,
        F.array().cast("array<struct<n:int,type:string,value:string>>"),
        lambda acc, e: F.when((F.size(acc) > 0) & (F.element_at(acc, -1)["value"] == e["value"]), acc).otherwise(
            F.concat(acc, F.array(F.struct((-F.length(e["value"])).alias("n"), e["type"].alias("type"), e["value"].alias("value"))))
        ),
    )
    return F.transform(F.array_sort(firsts), lambda e: F.struct(e["value"].alias("value"), e["type"].alias("type")))


def rule_hits(text: Column, rules: tuple[P.Rule, ...] = P.RULES) -> Column:
    """What all rules find, in the order of rules."""

    def of_type(kind: str) -> Callable[[Column], Column]:
        return lambda v: F.struct(v.alias("value"), F.lit(kind).alias("type"))

    return F.concat(*[F.transform(candidates(text, r), of_type(r.type)) for r in rules])


def entities(text: Column, rules: tuple[P.Rule, ...] = P.RULES) -> Column:
    """Entities of a text that is its own canonical form."""
    hits = rule_hits(text, rules)
    return F.when(F.size(hits) > 0, first_of_each_value(hits)).otherwise(F.array().cast(ENTITIES))


@functools.cache
def _compiled(rule: P.Rule) -> regex.Pattern:
    return regex.compile(rule.pattern.replace("(?iu)", "(?i)"))


def _card(value: str) -> bool:
    own = [int(c) for c in value if c.isdecimal()]
    return 13 <= len(own) <= 19 and sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(own))) % 10 == 0


def entities_of(text: str | None, rules: tuple[P.Rule, ...] = P.RULES) -> list[dict[str, str]]:
    """Entities of any text, by way of its canonical form."""
    if not text:
        return []
    plain, starts, ends = canonical(text)
    best: dict[str, tuple[int, str]] = {}
    for rule in rules:
        for m in _compiled(rule).finditer(plain):
            s, e = m.span(rule.group)
            value = text[min(starts[s:e]) : max(ends[s:e])]
            if rule.type == "CARD" and not _card(value) or rule.type == "PHONE" and sum(map(str.isdecimal, value)) < 10:
                continue
            rank = P.PRIORITY.get(rule.type, P.LAST_PRIORITY)
            if value not in best or rank < best[value][0]:
                best[value] = (rank, rule.type)
    return [{"value": v, "type": t} for v, (_, t) in sorted(best.items(), key=lambda x: (-len(x[0]), x[1][1], x[0]))]


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("type", T.StringType())])))
def unusual_entities(texts: pd.Series) -> pd.Series:
    return texts.map(entities_of)


@F.pandas_udf(T.ArrayType(T.ArrayType(T.StructType([T.StructField("value", T.StringType()), T.StructField("type", T.StringType())]))))
def unusual_entities_of_all(lists: pd.Series) -> pd.Series:
    """Entities of each text of a list; null for null texts and lists."""
    return lists.map(lambda texts: None if texts is None else [None if t is None else entities_of(t) for t in texts])


def settled(df: DataFrame, *names: str) -> DataFrame:
    """df with the named columns computed once, here: later steps refer to their values instead of repeating their expressions."""
    others = [c for c in df.columns if c not in names]
    return df.select(*others, F.explode(F.array(F.struct(*names))).alias("_s")).select(*others, *[F.col(f"_s.{n}").alias(n) for n in names])


def _slow(rules: tuple[P.Rule, ...]) -> Callable[[Column], Column]:
    if rules == P.RULES:
        return unusual_entities

    @F.pandas_udf(ENTITIES)
    def found(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: entities_of(t, rules))

    return found


def with_entities(df: DataFrame, text: str = "text", name: str = "entities", sure_usual: bool = False, rules: tuple[P.Rule, ...] = P.RULES) -> DataFrame:
    """df with its entities, in one pass: each rule runs once on each text.

    The rules' finds in usual texts are settled before they are sorted out. Only the unusual texts, null for all other rows, go
    through the vectorised function. With sure_usual the caller vouches that there are none.
    """
    none = F.array().cast(ENTITIES)
    if sure_usual:
        hits = settled(df.withColumn(name, rule_hits(F.col(text), rules)), name)
        return settled(hits.withColumn(name, F.when(F.size(name) > 0, first_of_each_value(F.col(name))).otherwise(none)), name)
    odd = F.when(~is_usual(F.col(text)), F.col(text))
    hits = settled(df.withColumn("_odd", odd).withColumn(name, F.when(F.col("_odd").isNull(), rule_hits(F.col(text), rules))), "_odd", name)
    slow = _slow(rules)(F.col("_odd"))
    fast = settled(hits.withColumn(name, F.when(F.size(name) > 0, first_of_each_value(F.col(name))).otherwise(none)), name)
    return fast.withColumn(name, F.when(F.col("_odd").isNull(), F.col(name)).otherwise(slow)).drop("_odd")


def exploded(df: DataFrame, *keys: str, name: str = "entities") -> DataFrame:
    """A row for each entity: keys, value and type."""
    return df.select(*keys, F.explode(name).alias("_e")).select(*keys, F.col("_e.value").alias("value"), F.col("_e.type").alias("type"))


def merged(*found: Column) -> Column:
    """Union of detectors' entities: earlier ones win among equal priorities."""
    return first_of_each_value(F.concat(*[F.coalesce(f, F.array().cast(ENTITIES)) for f in found]))


def proposal_code(text: Column, proposed: Column) -> Column:
    """Why a semantic detector's proposals for a text are all rejected, null if they are fine.

    proposed is null where its answer could not be parsed.
    """
    wrong = F.exists(proposed, lambda e: (F.length(e["value"]) == 0) | ~F.contains(text, e["value"]))
    unknown = F.exists(proposed, lambda e: e["value"].isNull() | e["type"].isNull() | ~e["type"].isin(*P.ENTITY_TYPES))
    return F.when(proposed.isNull() | unknown, F.lit("invalid_structured_output")).when(wrong, F.lit("non_exact_substring"))


ANSWER = "struct<entities:array<struct<value:string,type:string>>>"


def parsed_proposals(content: Column, reasoning: Column) -> Column:
    """Entities in a model's answer: its content, or its reasoning if that is empty."""
    chosen = F.coalesce(F.nullif(content, F.lit("")), reasoning)
    return F.from_json(chosen, ANSWER)["entities"]


def single_outcome(rules: Column, proposed: Column, code: Column) -> Column:
    """Entities, warnings and whether a person has to look, of one semantic detector and the rules."""
    none = F.array().cast("array<string>")
    return F.struct(
        F.when(code.isNull(), merged(proposed, rules)).otherwise(rules).alias("entities"),
        F.when(code.isNull(), none).otherwise(F.array(F.concat(F.lit("semantic_detector_"), code))).alias("warnings"),
        code.isNotNull().alias("requires_manual_review"),
    )


def ensemble_outcome(rules: Column, models: list[tuple[str, Column, Column]]) -> Column:
    """The same for several models, each (name, proposals, code): one that fails gives a warning, all failing ask for a person."""
    empty = F.array().cast(ENTITIES)
    found = [F.when(code.isNull(), proposed).otherwise(empty) for _, proposed, code in models]
    warnings = F.filter(F.array(*[F.when(code.isNotNull(), F.concat(F.lit(f"semantic_detector_{name.split('/')[-1]}_"), code)) for name, _, code in models]), lambda w: w.isNotNull())
    failed = F.lit(True)
    for _, _, code in models:
        failed = failed & code.isNotNull()
    return F.struct(F.when(failed, rules).otherwise(merged(merged(*found), rules)).alias("entities"), warnings.alias("warnings"), failed.alias("requires_manual_review"))
