"""Detection, redaction, gate and audit against small cases written for them."""

import math
import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmesh.operators import admission, canon, detect, gate, lifecycle, operation, receipts, redact
from quillmesh.operators.lifecycle import State, transition

NONCE = "ABCDEF0123456789"


def found(spark, *texts):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = {r.id: [(e.value, e.type) for e in r.entities] for r in detect.with_entities(df).collect()}
    return [rows[i] for i in range(len(texts))]


def test_rules(spark):
    got = found(
        spark, "write to a.b@mail.example, please", "card 4111 1111 1111 1111!", "call +7 (912) 000-11-22 now", "Invoice AB-1234 is due", "on 2024-01-02 nothing",
        "passport 4510 123456 and tin 1234567890", "password QWERTY-12345", None, "", "паспорт 4510 123456",
    )
    assert got[0] == [("a.b@mail.example", "EMAIL")]
    assert got[1] == [("4111 1111 1111 1111", "CARD")]
    assert got[2] == [("+7 (912) 000-11-22", "PHONE")]
    assert got[3] == [("AB-1234", "CONTRACT_ID")]
    assert got[4] == []
    assert got[5] == [("4510 123456", "PASSPORT"), ("1234567890", "TAX_ID")]
    assert ("QWERTY-12345", "OTHER_SECRET") in got[6]
    assert got[7] == [] and got[8] == []
    assert got[9] == [("4510 123456", "PASSPORT")]


def test_obfuscated_values_keep_their_source(spark):
    got = found(spark, "ivan [at] mail (dot) example", "key sk-abcdefghij​klmnop", "４１１１ １１１１ １１１１ １１１１")
    assert got[0] == [("ivan [at] mail (dot) example", "EMAIL")]
    assert ("sk-abcdefghij​klmnop", "API_KEY") in got[1]
    assert got[2][0][1] == "CARD"


def test_both_ways_agree(spark):
    texts = ["x@y.zz and 4111111111111111", "Agreement ABCDE-1 with +1 555 123 4567 8", "tin 123456789012", "мой email тест@пример.рф, договор №1", "case against"]
    assert found(spark, *texts) == [[(e["value"], e["type"]) for e in detect.entities_of(t)] for t in texts]


def test_canonical_ranges():
    assert canon.canonical("a​ﬁ[at]b") == ("afi@b", [0, 2, 2, 3, 7], [1, 3, 3, 7, 8])


def ops(spark, text, entities, task="Sum up"):
    ents = F.array(*[F.struct(F.lit(v).alias("value"), F.lit(t).alias("type")) for v, t in entities]) if entities else F.array().cast(detect.ENTITIES)
    df = spark.createDataFrame([(1, task, text)], "op_id int, task string, text string")
    return df.withColumn("fields", redact.fields_of(("task", F.col("task")), ("text", F.col("text")))).withColumn("entities", ents)


def test_longest_first_and_tokens(spark):
    rows = ops(spark, "Ann Lee met Ann. Ann Lee left.", [("Ann Lee", "PERSON"), ("Ann", "PERSON")])
    opaque = redact.redact(rows, F.lit(NONCE)).first()
    assert opaque.sanitized[1].text == f"__PII_{NONCE}_0001__ met __PII_{NONCE}_0002__. __PII_{NONCE}_0003__ left."
    typed = redact.redact(rows, F.lit(NONCE), typed=True).first()
    assert typed.sanitized[1].text == f"__PII_{NONCE}_PERSON_0001__ met __PII_{NONCE}_PERSON_0002__. __PII_{NONCE}_PERSON_0001__ left."
    assert typed.mapping == {f"__PII_{NONCE}_PERSON_0001__": "Ann Lee", f"__PII_{NONCE}_PERSON_0002__": "Ann"}


def test_nested_value_without_place_is_not_mapped(spark):
    assert set(redact.redact(ops(spark, "Ann Lee", [("Ann Lee", "PERSON"), ("Lee", "ORG")]), F.lit(NONCE)).first().mapping.values()) == {"Ann Lee"}


def test_input_errors(spark):
    assert redact.redact(ops(spark, " ", [], task=" "), F.lit(NONCE)).first().error == "empty_input"
    assert redact.redact(ops(spark, "a __pii_ b", []), F.lit(NONCE)).first().error == "reserved_token_in_input"
    assert redact.redact(ops(spark, "a", [("zz", "ORG")]), F.lit(NONCE)).first().error == "non_exact_substring"


def test_gate(spark):
    made = redact.redact(ops(spark, "Ann, x@y.example", [("Ann", "PERSON")]), F.lit(NONCE))
    assert gate.gated(made).first()["reasons"] == ["Residual high-confidence sensitive data in text: EMAIL:1"]
    none = redact.redact(ops(spark, "nothing here", []), F.lit(NONCE))
    assert gate.gated(none).first()["reasons"] == [gate.NOTHING_FOUND]


@pytest.mark.parametrize("change", [lambda t: t.replace("0001", "0002"), lambda t: t.lower(), lambda t: t[:-1], lambda t: t + t])
def test_forged_tokens(spark, change):
    token = f"__PII_{NONCE}_0001__"
    df = spark.createDataFrame([(change(token), {token: "Ann"}, {token: 1})], "answer string, mapping map<string,string>, limits map<string,int>")
    assert df.select(gate.audit(F.col("answer"), F.col("mapping"), F.col("limits"))["error"]).first()[0] is not None


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abcé 1@.\n\\E", max_size=30), min_size=1, max_size=8), st.lists(st.text(alphabet="abcé1\\E", min_size=1, max_size=3), max_size=3))
def test_round_trip(spark, texts, values):
    rows = [(i, t, [v for v in dict.fromkeys(values) if v in t]) for i, t in enumerate(texts) if t.strip()]
    if not rows:
        return
    df = spark.createDataFrame(rows, "op_id int, text string, found array<string>")
    df = df.withColumn("fields", redact.fields_of(("text", F.col("text")))).withColumn("entities", F.transform("found", lambda v: F.struct(v.alias("value"), F.lit("ORG").alias("type"))))
    for r in redact.redact(df, F.lit(NONCE)).withColumn("back", gate.restore(F.element_at("sanitized", 1)["text"], F.col("mapping"))).collect():
        assert r.back == r.text
        rest = r.sanitized[0].text
        for token in r.mapping:
            rest = rest.replace(token, "\0")
        assert not any(v in rest for v in r.found)


def test_lifecycle_steps():
    state, outcome = transition(None, "create", 0.0)
    assert outcome == "operation_created"
    assert transition(state, "complete", 1.0) == (state, "authorization_required")
    ready, outcome = transition(state, "authorize", 2.0, revision=0)
    assert outcome == "operation_authorized"
    edited, _ = transition(ready, "review", 3.0)
    assert edited == State("READY_FOR_REVIEW", 1, None, 600.0)
    assert transition(edited, "authorize", 4.0, revision=0)[1] == "revision_mismatch"
    assert transition(ready, "complete", 5.0) == (None, "completed")
    assert transition(ready, "complete", 600.0) == (None, "operation_not_found")
    assert transition(ready, "authorize", 5.0, revision=0, warned=True)[1] == "acknowledgement_required"


def test_fold_is_the_transition(spark):
    import random

    rng = random.Random(3)
    rows = [(op, float(rng.randrange(0, 1500)), i, rng.choice(["create", "review", "authorize", "complete", "delete"]), rng.choice([0, 0, 1, None]), rng.random() < 0.5, rng.random() < 0.2, rng.random() < 0.3) for i, op in enumerate(rng.choices(range(12), k=150))]
    df = spark.createDataFrame(rows, "op_id int, at double, seq long, action string, revision int, acknowledge boolean, blocked boolean, warned boolean")
    got = {r.op_id: r for r in lifecycle.fold(df).collect()}
    for op in {r[0] for r in rows}:
        state, outcomes = None, []
        for _, at, _, action, revision, ack, blocked, warned in sorted((r for r in rows if r[0] == op), key=lambda r: (r[1], r[2])):
            state, outcome = transition(state, action, at, revision, ack, blocked, warned)
            outcomes.append(outcome)
        assert got[op].outcomes == outcomes
        assert got[op].status == (state.status if state else None)


def test_receipts(spark):
    import hashlib
    import hmac

    df = spark.createDataFrame([("v",)], "v string").select(receipts.fingerprint(b"k" * 40, "source", F.col("v")))
    assert df.first()[0] == hmac.new(b"k" * 40, b"source:v", hashlib.sha256).hexdigest()


def test_admission(spark):
    df = spark.createDataFrame([("a.exe", 1), ("a.TXT", 0), ("a.docx", 6 << 20), ("a.pdf", 1)], "path string, n long")
    assert [r[0] for r in df.select(admission.file_reason(F.col("path"), F.col("n"))).collect()] == ["unsupported_type", "empty_file", "file_too_large", None]


@pytest.mark.parametrize("name", ["detect_all_dedup", "detect_counts", "redact_typed", "score_per_type", "token_audit", "receipt_rows", "spans_opaque"])
def test_rules_run_once(spark, name):
    """Eight rules, eight extractions in the plan; the audit has one more, for tokens."""
    from quillmesh.plans import catalog

    plan = catalog.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") <= 8 + (name == "token_audit")


def test_gate_looks_at_the_canonical_form(spark):
    texts = ["bob [at] example (dot) com", "bo​b@example.com", "ｂｏｂ＠ｅｘａｍｐｌｅ．ｃｏｍ", "nothing — here 日本", "card \U0001d7d2\U0001d7cf\U0001d7cf\U0001d7cf 1111 1111 1111", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    rows = rows.select("i", F.array(F.struct(F.lit("text").alias("field"), F.coalesce("t", F.lit("")).alias("text")), F.struct(F.lit("task").alias("field"), F.lit("plain").alias("text"))).alias("sanitized"), F.create_map(F.lit("__PII_ABCDEFABCDEFABCD_0001__"), F.lit("v")).alias("mapping"))
    got = {r.i: r.reasons for r in gate.gated(rows).collect()}
    residual = "Residual high-confidence sensitive data in text: "
    assert [got[i] for i in range(6)] == [[residual + "EMAIL:1"]] * 3 + [[]] + [[residual + "CARD:1"]] + [[]]
    assert gate.gated(rows.limit(0)).count() == 0


def test_usual_texts(spark):
    """What the pattern lets pass is its own canonical form, and the other way round, character by character."""
    points = [p for p in range(1, 0x11000) if not 0xD800 <= p < 0xE000][::7] + list(range(0x1D400, 0x1D7FF, 5)) + [0x1F600, 0x20000, 0xE0001]
    rows = spark.createDataFrame([(chr(p),) for p in points], "t string").select("t", canon.is_usual(F.col("t")).alias("u")).collect()
    assert all(r.u == (canon.canonical(r.t)[0] == r.t) for r in rows)


def test_cards_of_all_planes(spark):
    from quillmesh.functions import scalar

    values = ["4111 1111 1111 1111", "".join(chr(0x1D7CE + int(c)) for c in "4111111111111111"), "".join(chr(0xFF10 + int(c)) for c in "4111111111111112")]
    rows = spark.createDataFrame([(v,) for v in values], "v string").select(scalar.is_card(F.col("v"))).collect()
    assert [r[0] for r in rows] == [True, True, False]


def test_operation_from_request_to_answer(spark):
    rows = spark.createDataFrame([(1, "Sum up", "mail bob@mail.example now"), (2, "Sum up", "nothing here"), (3, None, " ")], "op_id long, task string, text string")
    nonce = F.lit(NONCE)
    made = operation.create(rows, nonce)
    got = {r.op_id: r for r in made.collect()}
    assert got[1].status == "READY_FOR_REVIEW" and got[1].sanitized[1].text == f"mail __PII_{NONCE}_0001__ now"
    assert got[2].status == "BLOCKED" and got[2].reasons == [gate.NOTHING_FOUND] and got[3].error == "empty_input" and got[3].status is None

    def reviewed(action, start, end, kind="ORG", named=("task", "text")):
        edit = F.struct(F.lit(action).alias("action"), F.lit("text").alias("field"), F.lit(start).alias("start"), F.lit(end).alias("end"), F.lit(kind).alias("type"))
        return operation.review(made.where("op_id = 1").withColumns({"edits": F.array(edit), "named_fields": F.array(*map(F.lit, named))}), nonce).first()

    uncovered = reviewed("remove", 5, 21)
    assert (uncovered.status, uncovered.revision, uncovered.review_error) == ("BLOCKED", 1, None) and "EMAIL:1" in uncovered.reasons[0]
    more = reviewed("add", 0, 4)
    assert more.sanitized[1].text == f"__PII_{NONCE}_0001__ __PII_{NONCE}_0002__ now" and more.status == "READY_FOR_REVIEW"
    assert [reviewed(*x).review_error for x in (("add", 0, 99), ("add", 3, 3), ("add", 0, 4, "CAT"), ("add", 4, 8), ("remove", 0, 4))] == ["invalid_span", "invalid_span", "unknown_type", "overlapping_spans", "span_not_found"]
    kept = reviewed("add", 0, 4, "ORG", ("text",))
    assert (kept.review_error, kept.revision, kept.sanitized) == ("field_names_mismatch", 0, got[1].sanitized)

    one = made.where("op_id = 1")
    done = operation.complete(one.withColumn("answer", F.lit(f"To __PII_{NONCE}_0001__"))).first()
    assert done.restored == "To bob@mail.example" and done.complete_error is None and done.omitted == []
    bad = operation.complete(one.withColumn("answer", F.lit(f"__PII_{NONCE}_0001__ __PII_{NONCE}_0001__"))).first()
    assert bad.complete_error == "token_limit_exceeded" and bad.restored is None
    sent = {r.op_id: r.sent for r in operation.stateless(rows, nonce).collect()}
    assert sent[2] is None and sent[1].input_text == f"mail __PII_{NONCE}_0001__ now"
    assert operation.stateless(rows.limit(0), nonce).count() == 0


def test_capacity_counts_live_operations(spark):
    events = [("a", i, float(i), i + 0.5) for i in range(10)] + [("b", i, float(i), None) for i in range(4)] + [("b", 9, 700.0, None)]
    rows = lifecycle.live_operations(spark.createDataFrame(events, "store string, op_id long, at double, released double"), capacity=3)
    got = {(r.store, r.op_id): (r.live, r.refused) for r in rows.collect()}
    assert all(got["a", i] == (1, False) for i in range(10))
    assert [got["b", i] for i in (0, 1, 2, 3, 9)] == [(1, False), (2, False), (3, False), (3, True), (1, False)]


def test_capacity_within_one_lifetime(spark):
    """Against a plain count, over whole buckets, their edges, negative times, repeated times and rows without a time."""
    rng = random.Random(3)
    times = [rng.choice((rng.uniform(-30, 60), float(rng.randrange(-30, 60)), 20.0)) for _ in range(400)] + [200.0, 200.001, 209.999, 210.0, 219.999, 220.0, None, None]
    rows = lifecycle.beyond_capacity(spark.createDataFrame(list(enumerate(times)), "op_id long, at double"), capacity=3, ttl=10.0).collect()
    ms = [None if t is None else math.floor(t * 1000) for t in times]
    want = {i: sum(o is None if m is None else o is not None and m - 10_000 < o <= m for o in ms) for i, m in enumerate(ms)}
    assert len(rows) == len(times) and {r.op_id: (r.at, r.live, r.refused) for r in rows} == {i: (times[i], n, n > 3) for i, n in want.items()}


def test_capacity_is_not_counted_row_by_row(spark):
    """Only counts of a millisecond pass a window: frames that slide over rows take the square of their number."""
    rows = spark.range(10).selectExpr("id AS op_id", "CAST(id AS DOUBLE) AS at")
    plan = lifecycle.beyond_capacity(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition" in plan and "-599999" not in plan
