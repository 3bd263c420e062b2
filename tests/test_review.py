"""Review operators on small fixtures: nulls, repeats, ties and empty tables."""

from pyspark.sql import functions as F

from leafgauge.operators import candidates, review, runlog


def test_misaligned(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), ("z", 3), ("z", 3), ("w", 1)], "k string, v int")
    b = spark.createDataFrame([("x", 2), ("y", None), ("z", 3), ("q", 9)], "k string, v int")
    assert {tuple(r) for r in review.misaligned(a, b, ["k"], ["v"]).collect()} == {("x", "v-conflict"), ("z", "repeated"), ("w", "missing"), ("q", "extra")}
    assert review.misaligned(a.limit(0), b.limit(0), ["k"], ["v"]).count() == 0


def test_overlay_rules(spark):
    from leafgauge.operators.contracts import violations

    rows = spark.createDataFrame([("r1", "detected", "eligible", None, "g"), ("r2", "missed", "eligible", None, None), ("bad id", None, None, None, None), ("r4", None, "excluded", None, "g"), ("r5", None, None, "boundary-clipped", " ")], "region_id string, detection_status string, ocr_eligibility string, exclusion_reason string, expected_ocr string")
    got = {(r.key, r.rule) for r in violations(rows, "region_id", review.overlay_rules(("boundary-clipped", "detection-missed"))).collect()}
    assert got == {("r2", "missed-not-excluded"), ("bad id", "unsafe-id"), ("bad id", "changes-nothing"), ("r4", "excluded-without-reason"), ("r4", "excluded-with-gold"), ("r5", "reason-without-exclusion"), ("r5", "blank-gold")}


def test_difference_and_drift(spark):
    a, b = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k int, v string"), spark.createDataFrame([(2, None), (1, "b")], "k int, v string")
    assert sorted((r.side, r.k, r.v or "") for r in review.difference(a, b).collect()) == [("actual", 1, "b"), ("expected", 1, "a"), ("expected", 2, "")]
    assert [tuple(r) for r in review.drifted(a.distinct(), b, "k", "v").collect()] == [(1, "a", "b")]


def test_codes(spark):
    df = spark.createDataFrame([(100, None), (5000, None), (5000, 100), (5000, 9000)], "p int, c int")
    assert [r[0] for r in df.select(review.headroom(F.col("p"), F.col("c"))).collect()] == ["PHYSICAL_MEMORY_LOW", "COMMIT_COUNTER_UNAVAILABLE", "COMMIT_HEADROOM_LOW", "RESOURCE_HEADROOM_OK"]
    s = spark.createDataFrame([(None,), (" ",), ("Completed-with-ERRORS",), ("completed",), ("running",)], "s string")
    assert [r[0] for r in s.select(review.status_kind(F.col("s"))).collect()] == ["idle", "idle", "failed", "finished", "active"]
    assert s.limit(1).select(review.qa_code(F.lit("engine-missing"))).first()[0] == "OCR_RUNTIME_ENGINE_MISSING"


def test_final_states(spark):
    e = spark.createDataFrame([("a", 1, "w"), ("a", 2, "ok"), ("a", 3, "bad"), ("a", 4, "w"), ("b", 1, "w"), ("c", 1, "bad"), ("c", 1, "ok"), (None, 1, "ok")], "k string, t int, e string")
    got = {r.k: (r.state, r.warnings, r.last_seen) for r in runlog.final_states(e, "k", "t", "e", "bad", "ok", "w").collect()}
    assert got == {"a": ("finished", 1, 4), "b": ("running", 1, 1), "c": ("failed", 0, 1), None: ("finished", 0, 1)}
    assert runlog.final_states(e.limit(0), "k", "t", "e", "bad", "ok", "w").count() == 0


def test_candidate_scores(spark):
    box = "struct<x:double,y:double,width:double,height:double>"
    g = spark.createDataFrame([("r1", "p1", "あい", None, True), ("r2", "p1", "う", None, False), ("r3", "p2", "え", None, False)], f"region_id string, page_id string, expected_ocr string, bbox {box}, non_refusal_required boolean")
    c = spark.createDataFrame(
        [(1, "a", "r1", "p1", True, "あい", "甲", None, True, True, True), (2, "a", "r2", "p1", True, "う", "乙", None, True, None, True), (3, "a", "r3", "p2", True, "え", "丙", None, True, True, True), (4, "b", "r1", "p1", True, "あ", None, None, False, None, None), (5, "c", "zz", "p9", False, None, None, None, None, None, None)],
        f"candidate_row long, candidate_id string, region_id string, page_id string, detected boolean, ocr_text string, translation string, bbox {box}, semantic_usable boolean, terms_correct boolean, layout_ok boolean",
    )
    facts = spark.createDataFrame([("a", 5.0, True, 100.0)], "candidate_id string, repair_score double, format_valid boolean, peak_vram double")
    s = {r.candidate_id: r for r in candidates.scores(g, c, candidates.greedy_matches(g, c), facts, 200.0).collect()}
    assert abs(s["a"].weighted_score - 1.0) < 1e-9 and s["a"].hard_gate and s["a"].no_edit_page_rate == 1.0
    assert (s["b"].detected, s["b"].regions, s["b"].ocr_cer, s["b"].non_refusal_rate, s["b"].hard_gate) == (1, 3, 0.5, 0.0, False)
    assert (s["c"].detected, s["c"].ocr_cer, s["c"].format_valid) == (0, 1.0, False)
    scored = candidates.scores(g, c, candidates.greedy_matches(g, c), facts, 200.0)
    assert tuple(candidates.winner(scored).first()) == ("a", 1, 3)
    assert candidates.winner(scored.where("candidate_id <> 'a'")).first().winner is None
    assert candidates.acceptance(scored).where("candidate_id = 'a' and not accepted").count() == 0
