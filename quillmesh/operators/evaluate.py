"""Scoring of detectors against labels.

expected and actual are tables of (case_id, value, type); cases has one row for each case. All joins are on keys, all sums are partial
before the shuffle, and the few dimension rows are literals.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmesh.functions import patterns as P
from quillmesh.functions import scalar as S
from quillmesh.operators import gate, redact
from quillmesh.operators.detect import ENTITIES, settled

PAIR = ("case_id", "value", "type")


def marked(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Every distinct pair of a case, with is_expected, is_actual and hit."""
    both = expected.select(*PAIR, F.lit(1).alias("e"), F.lit(0).alias("a")).unionByName(actual.select(*PAIR, F.lit(0).alias("e"), F.lit(1).alias("a")))
    return both.groupBy(*PAIR).agg(F.max("e").alias("is_expected"), F.max("a").alias("is_actual")).withColumn("hit", F.col("is_expected") * F.col("is_actual"))


def _sums() -> list[Column]:
    return [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("is_expected", "expected"), ("is_actual", "predicted"), ("hit", "true_positives"))]


def with_metrics(sums: DataFrame) -> DataFrame:
    """expected, predicted and true_positives with misses and rates."""
    e, p, t = (F.col(c) for c in ("expected", "predicted", "true_positives"))
    return sums.withColumns({"false_positives": F.greatest(F.lit(0), p - t), "false_negatives": F.greatest(F.lit(0), e - t), "precision": S.ratio(t, p), "recall": S.ratio(t, e)})


def entity_types(spark: SparkSession) -> DataFrame:
    return spark.range(1).select(F.explode(F.array(*[F.lit(t) for t in P.ENTITY_TYPES])).alias("type"))


def overall(pairs: DataFrame) -> DataFrame:
    return with_metrics(pairs.agg(*_sums()))


def per_type(pairs: DataFrame) -> DataFrame:
    """A row for each of the types, found or not."""
    sums = pairs.groupBy("type").agg(*_sums())
    kinds = entity_types(pairs.sparkSession).join(sums, "type", "left")
    return with_metrics(kinds.na.fill(0, ["expected", "predicted", "true_positives"]))


def per_language(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Languages with at least one expected entity."""
    joined = pairs.join(cases.select("case_id", F.coalesce("language", F.lit("unknown")).alias("language")), "case_id")
    sums = joined.groupBy("language").agg(*_sums()).where(F.col("expected") > 0)
    return sums.select("language", "expected", "true_positives", S.ratio(F.col("true_positives"), F.col("expected")).alias("recall"))


def grouped(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Overall, by type and by language in one pass."""
    joined = pairs.join(cases.select("case_id", F.coalesce("language", F.lit("unknown")).alias("language")), "case_id")
    sums = joined.groupingSets([[], ["type"], ["language"]], "type", "language").agg(*_sums(), F.grouping_id().alias("grouping_id"))
    return with_metrics(sums)


def covered(pairs: DataFrame, cases: DataFrame) -> DataFrame:
    """Cases with expected entities, those found in full, and what is left to a person; rates are 0 where there is nothing."""
    by_case = pairs.groupBy("case_id").agg(*_sums())
    rows = cases.select("case_id").join(by_case, "case_id", "left").na.fill(0)
    out = rows.agg(
        *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(n) for c, n in (("expected", "expected_values"), ("true_positives", "found_values"), ("predicted", "predicted_values"))],
        F.count_if(F.col("expected") > 0).alias("documents_with_entities"),
        F.count_if((F.col("expected") > 0) & (F.col("expected") == F.col("true_positives"))).alias("documents_fully_covered"),
        F.coalesce(F.sum(F.col("expected") - F.col("true_positives")), F.lit(0)).cast("long").alias("values_left"),
    )
    rate = lambda whole: F.coalesce(S.ratio(F.col("found_values"), F.col(whole)), F.lit(0.0))
    return out.withColumns({"recall": rate("expected_values"), "precision": rate("predicted_values")})


def values_left(expected: DataFrame, actual: DataFrame) -> DataFrame:
    return expected.select(*PAIR).distinct().join(actual.select(*PAIR), list(PAIR), "left_anti")


def extra_values(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Values found that no label of the case has, whatever the type."""
    return actual.select("case_id", "value").distinct().join(expected.select("case_id", "value"), ["case_id", "value"], "left_anti")


def with_wilson(sums: DataFrame, successes: str = "true_positives", total: str = "expected") -> DataFrame:
    return sums.withColumns({"wilson_low": S.wilson(F.col(successes), F.col(total), True), "wilson_high": S.wilson(F.col(successes), F.col(total), False)})


def status(code: Column, gate_reasons: Column, manual_warning: Column, leaked: Column) -> Column:
    """What became of a case; the first that holds."""
    return (
        F.when(code.isNotNull(), F.concat(F.lit("blocked:"), code))
        .when(F.size(gate_reasons) > 0, F.lit("blocked:GateBlocked"))
        .when(manual_warning.isNotNull(), F.concat(F.lit("blocked:"), manual_warning))
        .when(leaked > 0, F.lit("blocked:fixture_oracle"))
        .otherwise(F.lit("passed"))
    )


#: What the gate, or redaction itself, makes of a case whose detection worked.
BLOCKED_BY_GATE = ("blocked:GateBlocked", "blocked:AirlockError")


def _failed(status: Column) -> Column:
    return status.startswith("blocked:") & ~status.isin(*BLOCKED_BY_GATE, "blocked:fixture_oracle")


def case_counters(cases: DataFrame) -> DataFrame:
    """From cases with status, category, expected and predicted counts: the report's counters."""
    s = F.col("status")
    return cases.agg(
        F.count(F.lit(1)).alias("cases"),
        F.count_if(s.isin("passed", "blocked:fixture_oracle")).alias("runtime_gate_passes"),
        F.count_if(s.isin(*BLOCKED_BY_GATE)).alias("runtime_gate_blocks"),
        F.count_if(_failed(s)).alias("detection_failures"),
        F.count_if(s == "passed").alias("fixture_oracle_passes"),
        F.count_if(s == "blocked:fixture_oracle").alias("known_control_leak_cases"),
        F.count_if(F.col("expected") == 0).alias("clean_cases"),
        F.count_if((F.col("expected") == 0) & (F.col("predicted") == 0)).alias("clean_cases_without_detections"),
        F.count_if(F.coalesce("category", F.lit("standard")) != "standard").alias("adversarial_cases"),
    )


def failures_by_code(cases: DataFrame) -> DataFrame:
    return cases.where(_failed(F.col("status"))).groupBy(F.regexp_replace("status", "^blocked:(semantic_detector_)?", "").alias("code")).agg(F.count(F.lit(1)).alias("n"))


def latencies(cases: DataFrame, seconds: str = "seconds") -> DataFrame:
    return cases.agg(F.bround(F.median(seconds), 3).alias("latency_median_seconds"), F.bround(F.max(seconds), 3).alias("latency_max_seconds"))


def _values(entities: Column) -> Column:
    """Distinct (value, type), in which arrays can be compared."""
    return F.array_distinct(F.transform(entities, lambda e: F.struct(e["value"].alias("value"), e["type"].alias("type"))))


def _passed(df: DataFrame, nonce: Column, typed: bool) -> DataFrame:
    """df (with text, entities and expected) redacted and gated, with leaked: how many expected values the sanitized text still has."""
    done = gate.gated(redact.redact(df.withColumn("fields", redact.fields_of(("text", F.col("text")))), nonce, typed))
    sent = F.element_at("sanitized", 1)["text"]
    leaked = F.size(F.filter("expected", lambda e: F.contains(sent, e["value"])))
    return settled(done.withColumn("leaked", leaked), "leaked")


def case_results(cases: DataFrame, nonce: Column, typed: bool = False) -> DataFrame:
    """A row for each case: what detection, redaction, gate and restoring make of it.

    cases have case_id, language, category, text, expected (labels), entities (found; nulls count as none), code (why detection
    failed, or null) and manual_warning (null unless a person has to look). A case whose detection failed has nothing found.
    Texts that can't be redacted are blocked by their error; assisted says whether the text passes once the labels themselves are redacted.
    """
    none = F.array().cast(ENTITIES)
    asked = {"expected": _values(F.coalesce("expected", none)), "entities": F.when(F.col("code").isNull(), _values(F.coalesce("entities", none))).otherwise(none)}
    kept = ["case_id", F.coalesce("language", F.lit("unknown")).alias("language"), F.coalesce("category", F.lit("standard")).alias("category"), "text", "code", "manual_warning"]
    rows = settled(cases.select(*kept, *[c.alias(n) for n, c in asked.items()]).withColumn("_nonce", nonce), "expected", "entities", "_nonce")
    own = _passed(rows, F.col("_nonce"), typed)
    echo = F.concat(F.lit("Acknowledged: "), F.array_join(F.map_keys("mapping"), " "))
    restored = settled(own.withColumn("_restored", gate.restore(echo, F.col("mapping"))), "_restored")
    through = F.col("code").isNull() & F.col("error").isNull() & (F.size("reasons") == 0)
    values = lambda c: F.array_distinct(F.transform(c, lambda e: e["value"]))
    told = restored.select(
        *rows.columns, F.size("expected").alias("n_expected"), F.size("entities").alias("n_predicted"), F.size(F.array_intersect("expected", "entities")).alias("n_hits"),
        F.size(F.array_except(values(F.col("entities")), values(F.col("expected")))).alias("n_extra_values"),
        (through & F.forall(F.map_values("mapping"), lambda v: F.contains(F.col("_restored"), v))).alias("restoration_checked"),
        status(F.coalesce("code", F.when(F.col("error").isNotNull(), F.lit("AirlockError"))), F.col("reasons"), F.col("manual_warning"), F.col("leaked")).alias("status"),
    )
    again = _passed(told.withColumn("entities", F.col("expected")), F.col("_nonce"), typed)
    assisted = (F.size("expected") > 0) & F.col("error").isNull() & (F.size("reasons") == 0) & (F.col("leaked") == 0)
    return again.select(*[c for c in told.columns if c not in ("_nonce", "text", "expected", "entities")], assisted.alias("assisted"))


def report(results: DataFrame) -> DataFrame:
    """One row of counters over ``case_results``: sums are partial before the single row."""
    s = F.col("status")
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return results.agg(
        F.count(F.lit(1)).alias("cases"),
        total("n_expected").alias("expected_entities"),
        total("n_hits").alias("true_positives"),
        total("n_predicted").alias("predicted_entities"),
        total("n_extra_values").alias("extra_replacement_values"),
        F.count_if(_failed(s)).alias("detection_failures"),
        F.count_if(s.isin("passed", "blocked:fixture_oracle")).alias("runtime_gate_passes"),
        F.count_if(s.isin(*BLOCKED_BY_GATE)).alias("runtime_gate_blocks"),
        F.count_if(s == "blocked:fixture_oracle").alias("known_control_leak_cases"),
        F.count_if(s == "passed").alias("fixture_oracle_passes"),
        F.count_if("restoration_checked").alias("deterministic_restoration_checks"),
        F.count_if(F.col("n_expected") == 0).alias("clean_cases"),
        F.count_if((F.col("n_expected") == 0) & (F.col("n_predicted") == 0) & F.col("code").isNull()).alias("clean_cases_without_detections"),
        F.count_if(F.col("category") != "standard").alias("adversarial_cases"),
        F.count_if("assisted").alias("fixture_assisted_review_passes"),
    )
