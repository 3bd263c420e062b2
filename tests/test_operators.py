"""Golden vectors and edge cases of the core operators."""

import itertools
import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from leafgauge.functions.geometry import iou, overlap_decision, point_in_polygon, polygon_area
from leafgauge.functions.rng import mulberry, mulberry_array
from leafgauge.operators import candidates, contracts, ocr, quality, raster, routing, runlog, translation
from leafgauge.operators.nested import flatten_scenes
from leafgauge.operators.scene_walk import walked_regions

OBS = (
    "observation_id string, page_id string, category string, detected boolean, native_role string, legacy_policy string, "
    "evidence struct<inside_bubble:boolean,confidence:double,role_provenance:string,geometry_source:string>, overlap_rate double, dominant_share double, hard_case_tags array<string>, hardness double"
)


def observations(spark):
    return spark.createDataFrame([
        ("inside", "p1", "ordinary-dialogue", True, "unknown", "replace", (True, 0.99, "bubble-mask", "line-polygons"), 0.99, 1.0, None, None),
        ("outside", "p2", "artistic-sfx-action", True, "unknown", "replace", (False, 1.0, "bubble-mask", "bbox"), 0.0, 0.0, ["detected-external:artistic-sfx-action"], 2.0),
        ("uncertain", "p3", "dark-complex", True, "unknown", "replace", (None, 0.6, "bubble-mask", "line-polygons"), 0.6, 1.0, ["uncertain:threshold-band"], 3.0),
        ("missed", "p4", "structural-negative", False, None, None, (False, 1.0, "bubble-mask", "bbox"), 0.0, 0.0, ["undetected-external", "uncertain:threshold-band"], 1.0),
    ], OBS)


def test_routing_vector(spark):
    r = routing.routed(observations(spark))
    assert rows_of(routing.distribution(r)) == [(2, 1, 4, 1)]
    s = routing.summary(r).first()
    assert (s.role_dialogue, s.role_unknown, s.policy_replace, s.policy_preserve, s.mapped, s.classified, s.line_polygons, s.bbox, s.legacy_unknown_replace) == (1, 2, 1, 2, 1, 2, 2, 1, 3)
    assert round(s.mapped_rate, 9) == round(1 / 3, 9)
    assert tuple(routing.page_safety(r).first()) == (4, 2, 1, 1)
    assert tuple(routing.separation(r).first()) == (0.0, 0.99, 1.0)
    assert rows_of(routing.hard_cases(observations(spark))) == [("missed",), ("outside",)]
    assert contracts.violations(observations(spark), "observation_id", routing.contract_rules()).count() == 0
    broken = observations(spark).withColumn("overlap_rate", F.lit(0.5))
    assert contracts.violations(broken, "observation_id", routing.contract_rules()).count() > 0
    empty = routing.routed(observations(spark).limit(0))
    assert routing.summary(empty).first().mapped_rate == 0


def test_cover_against_brute_force():
    assert routing.smallest_cover([("left", 0, tuple("abcd")), ("right", 0, tuple("cdf") + ("e",)), ("x", 0, tuple("abe"))]) == ["left", "right"]
    rnd = random.Random(3)
    for _ in range(30):
        rows = [(f"r{i}", float(rnd.randrange(3)), tuple(rnd.sample("abcdef", rnd.randrange(1, 4)))) for i in range(7)]
        tags = {t for _, _, ts in rows for t in ts}
        found = routing.smallest_cover(rows)
        best = min((n for n in range(1, 8) for c in itertools.combinations(rows, n) if {t for _, _, ts in c for t in ts} == tags))
        assert len(found) == best and {t for i, _, ts in rows if i in found for t in ts} == tags


def test_violations_are_enforced(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), (None, 3)], "k string, v int")
    with pytest.raises(contracts.ContractError):
        contracts.enforce([contracts.duplicates(df, "k")])
    contracts.enforce([contracts.violations(df, "k", {"never": F.lit(False)})])
    assert contracts.population(df, spark.createDataFrame([("a",), ("b",)], "k string"), "k").count() == 2


def units(spark, rows):
    reg = spark.createDataFrame([(r[0], r[1], r[2], "detected", "eligible", r[4], [(e, t) for e, t in (("p", r[5]), ("m", r[6])) if t is not None]) for r in rows],
        "region_id string, page_id string, category string, detection_status string, ocr_eligibility string, expected_ocr string, candidates array<struct<engine:string,text:string>>")
    obs = spark.createDataFrame([(r[0], (r[3],)) for r in rows], "observation_id string, evidence struct<inside_bubble:boolean>")
    return ocr.units(reg, obs, "p", "m")


VECTOR = [("a", "page-a", "structural-negative", True, "A", "A", "X"), ("b", "page-b", "structural-negative", False, "B", "X", "B"), ("c", "page-c", "structural-negative", False, "C", "X", "C")]


def test_arbitration_vector(spark):
    u = units(spark, VECTOR)
    m = {r.policy: r for r in ocr.metrics(ocr.predictions(u, ocr.held_out_models(u, 1))).collect()}
    assert m["agreement-category"].exact == 0 and m["agreement-category-bubble"].exact == 2
    p = m["always-paddle"]
    assert (p.regions, p.exact, p.edits, p.gold_chars, p.p50_cer, p.max_cer, p.within_3_percent) == (3, 1, 2, 3, 1.0, 1.0, 1)
    assert round(p.macro_cer, 9) == round(2 / 3, 9)
    m = {r.policy: r.exact for r in ocr.metrics(ocr.predictions(u, ocr.held_out_models(u, 2))).collect()}
    assert m["agreement-category-bubble"] == 0
    renamed = units(spark, [("z" + r[0], "q" + r[1], *r[2:]) for r in VECTOR])
    assert rows_of(ocr.metrics(ocr.predictions(renamed, ocr.held_out_models(renamed, 1)))) == rows_of(ocr.metrics(ocr.predictions(u, ocr.held_out_models(u, 1))))


def test_held_out_models_equal_naive_folds(spark):
    rnd = random.Random(1)
    rows = [(f"r{i}", f"p{i % 7}", rnd.choice("xy"), rnd.choice([True, False, None]), "gold" + str(i % 3), rnd.choice(["gold0", "gold1", "golf", None]), rnd.choice(["gold2", "gold1", "g"])) for i in range(60)]
    u = units(spark, rows).cache()
    table = {(r.page_id, r.level, r.category, r.bubble): r.engine for r in ocr.held_out_models(u, 2).collect()}
    data = [r for r in u.collect() if r.p_safe and r.m_safe and r.p_norm != r.m_norm]
    for page in {r.page_id for r in data}:
        train = [r for r in data if r.page_id != page]
        mine = {r.category for r in data if r.page_id == page}
        for cat in mine:
            g = [r for r in train if r.category == cat]
            expect = None
            if len(g) >= 2:
                loss = lambda k: sum(r[f"{k}_dist"] > 0 for r in g) / len(g) + sum(r[f"{k}_dist"] for r in g) / sum(len(r.gold) for r in g)  # noqa: B023, E731
                expect = "manga" if loss("m") < loss("p") else "paddle"
            assert table[page, "category", cat, "*"] == expect


def test_baseline_vector(spark):
    rows = [("region-a", "page-a", "c", None, "Alpha", "Alpha", "Al pha"), ("region-b", "page-a", "c", None, "Beta", "Beta", "Wrong"), ("region-d", "page-b", "c", None, "Gamma", "Gamma", None)]
    reg = spark.createDataFrame([(r[0], r[1], r[2], "detected", "eligible", r[4], [(e, t) for e, t in (("l", r[5]), ("r", r[6])) if t is not None]) for r in rows]
        + [("region-c", "page-b", "c", "detected", "excluded", None, [("l", "Shape"), ("r", "Shape")]), ("region-missed", "page-b", "c", "missed", "excluded", None, [])],
        "region_id string, page_id string, category string, detection_status string, ocr_eligibility string, expected_ocr string, candidates array<struct<engine:string,text:string>>")
    b = {r.engine: r for r in ocr.baseline(ocr.engine_rows(reg, ("l", "r"))).collect()}
    assert (b["l"].available, b["l"].missing, b["l"].exact, b["l"].gold_chars, b["l"].edits) == (3, 0, 3, 14, 0)
    assert (b["r"].available, b["r"].missing, b["r"].exact, b["r"].gold_chars, b["r"].edits, b["r"].adjusted_edits) == (2, 1, 1, 9, 5, 10)
    d = ocr.denominators(reg).first()
    assert (d.regions, d.detected, d.missed, d.eligible, d.excluded_detected, d.excluded) == (5, 4, 1, 3, 1, 2)
    a = ocr.agreement(units(spark, rows)).first()
    assert (a.paired, a.raw, a.normalized, a.normalization_only, a.gold_exact, a.joint_wrong, a.left_only, a.right_only, a.neither) == (2, 0, 1, 1, 1, 0, 1, 0, 0)


def test_runtime_choice(spark):
    rows = [("a", "p", "c", None, "g", "原", "原"), ("b", "p", "c", None, "g", "Ａ 原", "A原"), ("c", "p", "c", None, "g", "甲", "乙"), ("d", "p", "c", None, "g", "x�", "x‮"), ("e", "p", "c", None, "g", None, "x")]
    strict = {r.region_id: (r.outcome, r.reasons) for r in ocr.runtime_choice(units(spark, rows), True).collect()}
    assert strict["a"] == ("raw-agreement", []) and strict["b"] == ("normalized-agreement", []) and strict["c"] == ("qa-blocked", ["candidate-disagreement"])
    assert strict["d"] == ("qa-blocked", ["paddle-replacement-character", "manga-bidi-control"]) and strict["e"] == ("qa-blocked", ["paddle-candidate-missing"])
    assert {r.region_id: r.outcome for r in ocr.runtime_choice(units(spark, rows), False).collect()}["c"] == "paddle"


def test_random_column(spark):
    def port(seed):
        state = seed & 0xFFFFFFFF
        imul = lambda a, b: (a * b) & 0xFFFFFFFF
        while True:
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            v = imul(state ^ (state >> 15), state | 1)
            v ^= (v + imul(v ^ (v >> 7), v | 61)) & 0xFFFFFFFF
            yield (v ^ (v >> 14)) / 4294967296

    got = [r.u for r in spark.range(500).select("id", mulberry(F.lit(20260811).cast("bigint"), F.col("id")).alias("u")).orderBy("id").collect()]
    assert got == list(itertools.islice(port(20260811), 500))


REGION = "region_id string, chapter_id string, page_id string, region_order int, role string, policy string, source_text string, translated_text string, confidence double, bbox struct<x:double,y:double,width:double,height:double>"


def region(i, s, t, policy="replace", page="p", role="dialogue", conf=0.99, box=None, chapter="ch"):
    return (i, chapter, page, 0, role, policy, s, t, conf, box)


def test_region_flags(spark):
    df = spark.createDataFrame([
        region("kana", "テスト123！", "测试テスト", conf=0.5), region("refusal", "テスト", "抱歉，我无法翻译テスト"), region("missing", "あ", " "), region("kept", "あ", None, policy="preserve-with-annotation"),
        region("box", "あいうえお", "一二三四五六七八九", box=(0.0, 0.0, 40.0, 40.0)), region("long", "ab", "一二三四五六七"), region("run", "あああああ", "一二三"), region("think", "ab", "<think>x</think>一"), region("null", None, "一"),
    ], REGION)
    f = {r.region_id: [x.code for x in r.qa_flags] for r in quality.chapter_flags(df).collect()}
    assert f["kana"] == ["LOW_OCR_CONFIDENCE", "JAPANESE_KANA_REMAINS", "SIGNIFICANT_TOKEN_LOST", "SIGNIFICANT_TOKEN_LOST"]
    assert f["refusal"][:2] == ["TRANSLATION_REFUSAL", "JAPANESE_KANA_REMAINS"]
    assert f["missing"] == ["MISSING_TRANSLATION"] and f["kept"] == []
    assert f["box"] == ["TEXT_OVERFLOW_RISK"] and f["long"] == ["TRANSLATION_TOO_LONG"] and f["run"] == ["OCR_TEXT_ANOMALY"]
    assert "LLM_REASONING_LEAK" in f["think"] and f["null"] == []
    assert quality.chapter_flags(df.limit(0)).count() == 0


def test_duplicates_glossary_chunks(spark):
    df = spark.createDataFrame([region(str(i), f"源{i}", "同じ訳") for i in range(3)] + [region("g1", "山田", "山田先生"), region("g2", "山田", "山田先生"), region("s", "山田", "别", role="sfx")], REGION)
    assert [tuple(r) for r in quality.duplicate_targets(df).collect()] == [("ch", "同じ訳", 3)]
    assert rows_of(quality.glossary(df)) == [("山田", "山田先生", 2)]
    pages = spark.createDataFrame([("c", f"p{i + 1}", i, 4) for i in range(5)], "chapter_id string, page_id string, page_no long, last long")
    got = sorted((r.chunk_no, r.position, r.page_id) for r in quality.page_chunks(pages, 3, 1, "chapter_id").collect())
    assert [p for _, _, p in got] == ["p1", "p2", "p3", "p3", "p4", "p5"] and max(c for c, _, _ in got) == 1
    with pytest.raises(ValueError):
        quality.page_chunks(pages, 2, 2)
    for n, size, overlap in itertools.product(range(1, 9), range(1, 5), range(0, 3)):
        if overlap >= size:
            continue
        expect, start = [], 0
        while True:
            expect.append([f"p{k}" for k in range(start, min(n, start + size))])
            if start + size >= n:
                break
            start += size - overlap
        pages = spark.createDataFrame([(f"p{i}", i, n - 1) for i in range(n)], "page_id string, page_no long, last long")
        if (n, size) in ((1, 3), (7, 3), (8, 2), (5, 4)):
            got = sorted((r.chunk_no, r.position, r.page_id) for r in quality.page_chunks(pages, size, overlap).collect())
            assert [[p for c, _, p in got if c == k] for k in range(len(expect))] == expect


def test_page_plan(spark):
    pages = spark.createDataFrame([("c", p, i, 3) for i, p in enumerate(("cover", "story", "art", "blank"))], "chapter_id string, page_id string, page_no long, last long")
    df = spark.createDataFrame([region("1", "あ", None, page="cover"), region("2", "あい", "一二", page="story"), region("3", "ド", "轰", page="art", role="sfx", policy="preserve-with-annotation"), region("4", "あい", "二", page="story", role="unknown", policy="preserve-with-annotation")], REGION)
    plan = {r.page_id: r.codes for r in quality.page_plan(pages, quality.chapter_flags(df)).collect()}
    assert plan == {"cover": ["BLOCKING_REGION_QA", "RISKY_BOUNDARY_PAGE"], "story": ["UNCLASSIFIED_TEXT_REGION"], "art": ["ARTISTIC_TEXT_ONLY_PAGE"], "blank": ["NO_TEXT_REGIONS_DETECTED"]}


def test_geometry(spark):
    df = spark.createDataFrame([((0.0, 0.0, 2.0, 2.0), (1.0, 0.0, 2.0, 2.0), [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0)])],
        "a struct<x:double,y:double,width:double,height:double>, b struct<x:double,y:double,width:double,height:double>, p array<struct<x:double,y:double>>")
    r = df.select(iou(F.col("a"), F.col("b")).alias("i"), polygon_area(F.col("p")).alias("s"), point_in_polygon(F.lit(1.0), F.lit(1.0), F.col("p")).alias("t"), point_in_polygon(F.lit(5.0), F.lit(1.0), F.col("p")).alias("f"),
        overlap_decision(F.lit(0.9), F.lit(0.85)).alias("in_"), overlap_decision(F.lit(0.04), F.lit(1.0)).alias("out"), overlap_decision(F.lit(0.5), F.lit(1.0)).alias("mid")).first()
    assert round(r.i, 9) == round(1 / 3, 9) and r.s == 12 and r.t and not r.f
    assert tuple(r.in_) == (True, 0.85) and tuple(r.out) == (False, 0.96) and tuple(r.mid) == (None, 0.5)


def test_mask_and_raster(spark):
    labels = spark.createDataFrame([("page1", x, y, 7 if x < 4 else 0) for x in range(8) for y in range(4)], "page string, x int, y int, v int")
    boxes = spark.createDataFrame([("page1", "inside", 0, 0, 2, 2), ("page1", "outside", 6, 0, 8, 2), ("page1", "partial", 2, 0, 6, 2)], "page string, region_id string, x0 int, y0 int, x1 int, y1 int")
    got = {r.region_id: (r.inside, r.dominant, r.overlap_rate) for r in raster.mask_overlap(labels, boxes, "page").collect()}
    assert got == {"inside": (True, 7, 1.0), "outside": (False, None, 0.0), "partial": (None, 7, 0.5)}
    grid = lambda f: spark.createDataFrame([("g", x, y, float(f(x, y))) for x in range(3) for y in range(3)], "k string, x int, y int, v double")
    same = raster.outside_changes(grid(lambda x, y: 0), grid(lambda x, y: 255 * (x == 1 and y == 1)), grid(lambda x, y: x == 1 and y == 1), "k", 3, 3).first()
    assert same.changed == 0 and same.max_delta == 0
    out = raster.outside_changes(grid(lambda x, y: 0), grid(lambda x, y: 255 * (x == 0 and y == 0)), grid(lambda x, y: x == 1 and y == 1), "k", 3, 3).first()
    assert out.changed == 1 and out.max_delta == 255


def test_candidates(spark):
    box = "bbox struct<x:double,y:double,width:double,height:double>"
    g = spark.createDataFrame([("r1", "p", "123", "译", (0.0, 0.0, 10.0, 10.0), True), ("r2", "p", "ab", "译", (0.0, 1.0, 10.0, 10.0), None), ("r3", "q", None, None, None, True)],
        f"region_id string, page_id string, expected_ocr string, expected_translation string, {box}, non_refusal_required boolean")
    c = spark.createDataFrame([(1, "A", "r1", "p", True, "１２３", "译", (0.0, 0.0, 10.0, 10.0), True, True, True), (2, "A", None, "p", True, "ab", "译", (0.0, 1.0, 10.0, 10.0), True, None, True), (3, "B", None, "p", True, "xx", "抱歉，我不能", (50.0, 50.0, 1.0, 1.0), False, False, False)],
        f"candidate_row long, candidate_id string, region_id string, page_id string, detected boolean, ocr_text string, translation string, {box}, semantic_usable boolean, terms_correct boolean, layout_ok boolean")
    m = candidates.greedy_matches(g, c)
    assert rows_of(m, ["candidate_id", "region_id", "candidate_row"]) == [("A", "r1", 1), ("A", "r2", 2)]
    s = {r.candidate_id: r for r in candidates.scores(g, c, m).collect()}
    assert (s["A"].detected, s["A"].ocr_cer, s["A"].semantic_rate, s["A"].no_edit_page_rate, s["A"].non_refusal_rate) == (2, 0.0, 1.0, 0.5, 0.5)
    assert (s["B"].detected, s["B"].ocr_cer) == (0, 1.0)


def test_translation_operators(spark):
    df = spark.createDataFrame([(" a", "x"), ("", "x"), ("```", "x"), ("テ", "x"), ("same", "s a m e"), ("一" * 13, "ab")], "t string, s string")
    got = [r.f for r in df.select(translation.structural_flags(F.col("t"), F.col("s")).alias("f")).collect()]
    assert got == [["surrounding-whitespace"], ["empty-output"], ["markdown-fence"], ["japanese-kana-remains"], ["source-echo"], ["excessive-length-ratio", "excessive-repetition"]]
    pool = spark.createDataFrame([(f"r{i}", f"p{i % 4}", "ab"[i % 2], ("short", "long")[i // 2 % 2]) for i in range(24)], "region_id string, page_id string, category string, length_stratum string")
    top = translation.stratified_top(pool, 1, "s", "hard")
    fill = translation.fill_balanced(pool, top, 10, "s", "hard").collect()
    assert len({r.region_id for r in fill}) == 10 and top.count() == 4 and [r.position for r in fill] == list(range(10))
    none = translation.paired_bootstrap(spark.createDataFrame([], "candidate string, metric string, region_id string, page_id string, value int"), "A", "B", "m", 10, 1)
    assert none.count() == 0


def test_run_log(spark):
    log = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("b", 1, "y")], "k string, t int, phase string")
    assert rows_of(runlog.sequence_breaks(log, "k", ["t"], "phase", ["x", "y"])) == [("x", "y", "b", 0)]
    reads = spark.createDataFrame([("a", 1, "h", True), ("a", 2, "h", False), ("a", 3, "h", True), ("a", 4, "h", True)], "k string, t int, h string, idle boolean")
    assert rows_of(runlog.stable_reads(reads, "k", ["t"], "h", "idle")) == [(4, "a")]


SCENE = "snapshot_id long, scene string, extra int"


def test_nested_scenes_of_all_shapes(spark):
    import json

    deep = {"id": "leaf", "kind": {"text": None}}
    for i in range(9):
        deep = {"id": f"g{i}", "kind": {"group": {"name": None, "nodes": [deep]}}}
    tree = {"pages": [{"id": "p1", "width": 1, "height": 2, "nodes": {"k1": {"kind": {"text": {"text": "a"}}}, "m": {"kind": {"mask": {}}}}}, {"pageId": "p2", "nodes": [deep]}, {"id": "p3"}]}
    comp = {"components": [{"type": "SourceText", "ownerId": "t1", "pageId": "p9", "value": {"text": "x"}}, {"type": "Geometry", "ownerId": "t2", "pageId": "p9", "value": {}}]}
    rows = [(1, json.dumps(tree), 0), (1, json.dumps(tree), 0), (2, json.dumps({"epoch": 1, "scene": tree}), 0), (3, json.dumps(json.dumps(comp)), 0), (4, None, 0), (5, "{broken", 0), (6, "[]", 0), (7, "3", 0), (8, "", 0)]
    t = flatten_scenes(spark.createDataFrame(rows, SCENE))
    got = {tuple(r) for r in t["text_nodes"].select("snapshot_id", "page_id", "parent_id", "node_id").collect()}
    assert got == {(s, *x) for s in (1, 2) for x in (("p1", "p1", "k1"), ("p2", "g0", "leaf"))} | {(3, "p9", "p9", "t1")}
    assert t["pages"].count() == 7 and t["groups"].count() == 18
    assert t["text_nodes"].join(t["pages"], ["snapshot_id", "page_id"], "left_anti").count() == 0
    parents = t["groups"].select("snapshot_id", F.col("group_id").alias("parent_id")).union(t["pages"].select("snapshot_id", "page_id"))
    assert t["text_nodes"].join(parents, ["snapshot_id", "parent_id"], "left_anti").count() == 0
    empty = flatten_scenes(spark.createDataFrame([], SCENE))
    assert all(df.count() == 0 for df in empty.values())


def test_scene_walk(spark):
    import json

    a = {"pages": [{"pageId": "p1", "regions": [{"id": "r1", "sourceText": " 甲 ", "bbox": {"left": 1, "top": 2, "w": 3, "h": 4}}, {"id": "r1", "translatedText": "A"}, {"id": "r2", "ocrText": " "}]}]}
    b = {"pages": {"p": {"id": "p", "width": 5, "height": 5, "nodes": {"n": {"id": "n", "kind": {"text": {"text": "乙", "confidence": 2}}, "transform": {"x": 0, "y": 0, "width": 0, "height": 1}}}}}}
    df = walked_regions(spark.createDataFrame([(1, json.dumps(a), 0), (2, json.dumps(b), 0), (3, "{", 0), (4, None, 0)], SCENE))
    got = {(r.snapshot_id, r.region_id): r for r in df.collect()}
    assert set(got) == {(1, "r1"), (2, "n")}
    assert (got[1, "r1"].page_id, got[1, "r1"].translated_text, got[1, "r1"].x, got[1, "r1"].region_order) == ("p1", "A", 1.0, 0)
    assert (got[2, "n"].page_id, got[2, "n"].confidence, got[2, "n"].width) == ("p", 1.0, 0.0)


def _resampled_by_hand(totals, replicates, seed):
    """Sums of each replicate, draw by draw."""
    out, mask = [], 0xFFFFFFFF
    for r in range(replicates):
        sums = [0] * len(totals[0])
        for k in range(r * len(totals), (r + 1) * len(totals)):
            s = (seed + (k + 1) * 0x6D2B79F5) & mask
            t = ((s ^ (s >> 15)) * (s | 1)) & mask
            t ^= (t + (t ^ (t >> 7)) * (t | 61)) & mask
            u = (t ^ (t >> 14)) / 4294967296.0
            sums = [a + b for a, b in zip(sums, totals[int(u * len(totals))])]
        out.append((r, *sums))
    return out


def test_resampled(spark, monkeypatch):
    """Draws match the generator's column; blocks of pages and of draws change nothing."""
    draws = spark.range(50).select((mulberry(F.lit(20260811).cast("bigint"), F.col("id") + 10**6)).alias("u")).collect()
    assert mulberry_array(20260811, 10**6, 50).tolist() == [r.u for r in draws]
    totals = [(i * 7 % 5, i) for i in range(11)]
    numbered = spark.createDataFrame([(i, *t) for i, t in enumerate(totals)], "number long, a long, b long")
    expected = _resampled_by_hand(totals, 40, 20260811)
    rows = lambda: sorted(tuple(r) for r in ocr.resampled(numbered, ["a", "b"], 11, 40, 20260811).collect())
    assert rows() == expected
    monkeypatch.setattr(ocr, "PAGE_BLOCK", 4)
    monkeypatch.setattr(ocr, "TASK_DRAWS", 3)
    assert rows() == expected


def test_paired_bootstrap_by_hand(spark):
    """Both ends of the interval from replicates that are drawn one by one."""
    import hashlib

    values = [(f"p{i // 2:02}", f"r{i:02}", int(i % 3 == 0), int(i % 4 != 1)) for i in range(30)]
    rows = [(c, "m", r, p, v) for p, r, a, b in values for c, v in (("A", a), ("B", b))]
    pages = sorted({p for p, *_ in values})
    totals = [tuple(sum(x) for x in zip(*[(a, b, 1) for q, _, a, b in values if q == p])) for p in pages]
    seed = 9 ^ int(hashlib.sha256(b"A|B|m").hexdigest()[:8], 16)
    deltas = sorted(b / n - a / n for _, a, b, n in _resampled_by_hand(totals, 101, seed))
    at = lambda q: deltas[int(q * 100)] + (q * 100 % 1) * (deltas[int(q * 100) + 1] - deltas[int(q * 100)])
    got = translation.paired_bootstrap(spark.createDataFrame(rows, "candidate string, metric string, region_id string, page_id string, value int"), "A", "B", "m", 101, 9).collect()[0]
    assert (got.pairs, got.pages) == (30, 15) and got.low == pytest.approx(at(0.025)) and got.high == pytest.approx(at(0.975))
