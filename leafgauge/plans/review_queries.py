"""Queries over review data: contracts, alignments, settled regions, roll-ups and choices, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgauge.functions import text as X
from leafgauge.operators import contracts, review
from leafgauge.plans import domain as D
from leafgauge.plans import ocr_queries
from leafgauge.session import table

# Why a region may be left out of scoring.
REASONS = ("boundary-clipped", "partial-glyph-bbox", "detection-missed")
HINTS = ("manga", "paddle", "engine")
SEED = "20260815"


def overlay_contract(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the benchmark's deliveries read as overlay entries, one row for each; reasons outside the list are broken, too."""
    rows = table(spark, d, "ocr_benchmark_regions").select("row_id", "region_id", "detection_status", "ocr_eligibility", "exclusion_reason", "expected_ocr")
    return contracts.violations(rows, "row_id", review.overlay_rules(REASONS))


def settled_regions(spark: SparkSession, d: str) -> DataFrame:
    """Detected and missed regions together, each with its settled status."""
    r = D.benchmark_regions(spark, d)
    detected = r.where("detection_status = 'detected'").select("region_id", "page_id", "ocr_eligibility", "exclusion_reason", "expected_ocr", F.lit("detected").alias("found"))
    missed = r.where("detection_status = 'missed'").select("region_id", "page_id", F.lit(None).cast("string").alias("ocr_eligibility"), F.lit(None).cast("string").alias("exclusion_reason"), "expected_ocr", F.lit("missed").alias("found"))
    both = detected.unionByName(missed)
    return both.select("region_id", "page_id", review.settled_region(F.col("found"), F.col("ocr_eligibility"), F.col("exclusion_reason"), F.col("expected_ocr")).alias("s")).select("region_id", "page_id", "s.*")


def translation_input_contract(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the reference items as fixed input."""
    g = table(spark, d, "golden_regions").distinct()
    blank = lambda c: F.col(c).isNull() | (F.trim(c) == "")
    rules = {
        "unsafe-id": ~F.coalesce(F.col("region_id").rlike(review.IDENTIFIER), F.lit(False)), "unsafe-page": ~F.coalesce(F.col("page_id").rlike(review.IDENTIFIER), F.lit(False)),
        "gold-missing": blank("expected_ocr"), "reference-missing": blank("expected_translation"), "box-missing": F.col("bbox").isNull(), "refusal-rule-missing": F.col("non_refusal_required").isNull(),
    }
    return contracts.violations(g, "region_id", rules)


def translation_run_contract(spark: SparkSession, d: str) -> DataFrame:
    """Broken rules of the candidates' outputs: unknown regions, missing texts, reviews without an output."""
    known = table(spark, d, "golden_regions").where("region_id is not null").select(F.col("region_id").alias("k")).distinct()
    r = table(spark, d, "candidate_regions").select("candidate_row", "region_id", "detected", "ocr_text", "translation", "semantic_usable").distinct()
    r = r.join(known, F.col("region_id") == F.col("k"), "left")
    on = F.coalesce("detected", F.lit(False))
    rules = {
        "region-missing": F.col("region_id").isNull(), "region-unknown": F.col("region_id").isNotNull() & F.col("k").isNull(), "source-missing": on & F.col("ocr_text").isNull(), "translation-missing": on & F.col("translation").isNull(),
        "review-without-output": F.col("semantic_usable").isNotNull() & F.col("translation").isNull(), "output-of-undetected": ~on & F.col("translation").isNotNull(),
    }
    return contracts.violations(r, "candidate_row", rules)


def translation_run_repeats(spark: SparkSession, d: str) -> DataFrame:
    """Regions for which a candidate has more than one output, with their number."""
    r = table(spark, d, "candidate_regions").where("region_id is not null").select("candidate_row", "candidate_id", "region_id").distinct()
    return r.groupBy("candidate_id", "region_id").agg(F.count("*").alias("outputs")).where("outputs > 1")


def ocr_pass_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Regions on which the reading passes of both engines don't line up: one without the other, repeated, or of another status."""
    rows = table(spark, d, "ocr_candidates").where("region_id is not null").select("candidate_row", "region_id", "engine", "status").distinct()
    one = lambda e: rows.where(F.col("engine") == e)
    return review.misaligned(one(D.PADDLE), one(D.MANGA), ["region_id"], ["status"])


def decision_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Read regions and benchmark regions (the decisions' population) that don't line up, or on other pages."""
    records = D.regions(spark, d).select("region_id", D.page_key(F.col("page_id")).alias("page"))
    return review.misaligned(D.benchmark_regions(spark, d).select("region_id", F.col("page_id").alias("page")), records, ["region_id"], ["page"])


def geometry_alignment(spark: SparkSession, d: str) -> DataFrame:
    """Reference and read regions whose boxes differ, or of which one has none."""
    a = D.golden(spark, d).select("region_id", F.col("bbox").alias("box"))
    b = D.regions(spark, d).select("region_id", F.col("bbox").alias("box"))
    return review.misaligned(a, b, ["region_id"], ["box"]).where("issue <> 'extra'")


def historical_run(spark: SparkSession, d: str) -> DataFrame:
    """Read regions with both texts as a candidate run, in the order of the benchmark's pages."""
    r = D.regions(spark, d).where("source_text is not null and translated_text is not null").select("region_id", "source_text", "translated_text", "region_order")
    b = D.benchmark_regions(spark, d).select("region_id", "page_order")
    return r.join(b, "region_id").select("region_id", "page_order", "region_order", "source_text", "translated_text")


def reference_drift(spark: SparkSession, d: str) -> DataFrame:
    """Regions whose reference translation isn't the read version's translation."""
    a = D.golden(spark, d).select("region_id", F.col("expected_translation").alias("t"))
    return review.drifted(a, D.regions(spark, d).select("region_id", F.col("translated_text").alias("t")), "region_id", "t")


def unevaluated_chapters(spark: SparkSession, d: str) -> DataFrame:
    """Declared pages of which nothing was read, per chapter."""
    pages = table(spark, d, "chapter_manifests").select("chapter_id", F.inline("source_files")).select("chapter_id", "page_id")
    read = table(spark, d, "partial_regions").where("page_id is not null").select(D.page_key(F.col("page_id")).alias("page_id")).distinct()
    return pages.join(read, "page_id", "left_anti").groupBy("chapter_id").agg(F.count("*").alias("pages"))


def baseline_reproduction(spark: SparkSession, d: str) -> DataFrame:
    """Fixed policies beside the baseline of their engine: how many regions, exact ones, letters and edits each has, and whether they agree."""
    base = ocr_queries.ocr_baseline_by_engine(spark, d)
    fixed = ocr_queries.arbitration_metrics(spark, d).where("policy in ('always-paddle', 'always-manga')")
    engine = F.when(F.col("policy") == "always-paddle", D.PADDLE).otherwise(D.MANGA)
    both = fixed.select(engine.alias("engine"), F.col("regions").alias("p_regions"), F.col("exact").alias("p_exact"), F.col("edits").alias("p_edits")).join(base, "engine")
    return both.select("engine", "p_regions", "p_exact", "p_edits", ((F.col("p_regions") == F.col("regions")) & (F.col("p_exact") == F.col("exact")) & (F.col("p_edits") == F.col("adjusted_edits"))).alias("reproduced"))


def polygon_gate(spark: SparkSession, d: str) -> DataFrame:
    """Whether the routing's geometry would let a policy be frozen, per category and over all."""
    o = D.observations(spark, d)
    source = F.col("evidence.geometry_source")
    counts = [F.count_if("detected").alias("detected"), F.count_if(F.col("detected") & (source == "line-polygons")).alias("polygons"), F.count_if(F.col("detected") & (source == "bbox")).alias("boxes")]
    by = o.groupBy(F.coalesce("category", F.lit("none")).alias("category")).agg(*counts)
    return review.gate(by.unionByName(o.agg(*counts).withColumn("category", F.lit("all"))))


def first_passing_policy(spark: SparkSession, d: str) -> DataFrame:
    """Per category the first policy, by name, whose regions of at most 3 % errors make up 60 %; null where none does."""
    s = table(spark, d, "region_scores").where("cer is not null and not isnan(cer) and abs(cer) < double('infinity') and cer >= 0").dropDuplicates(["score_id"])
    by = s.groupBy("category", "ocr_policy").agg((F.count_if(F.col("cer") <= 0.03) / F.count("*")).alias("rate"))
    return by.groupBy("category").agg(F.min(F.when(F.col("rate") >= 0.6, F.col("ocr_policy"))).alias("policy"), F.count_if(F.col("rate") >= 0.6).alias("passed"))


def selection_digest(spark: SparkSession, d: str) -> DataFrame:
    """Digest of the regions of each category that need scoring, in order of id; two per category and length (a bounded selection)."""
    pool = D.benchmark_regions(spark, d).where("ocr_eligibility = 'eligible' and expected_ocr is not null").select(F.coalesce("category", F.lit("none")).alias("category"), X.length_stratum(X.normalized(F.col("expected_ocr"))).alias("stratum"), "region_id")
    least = pool.groupBy("category", "stratum").agg(F.min("region_id").alias("a"), F.max("region_id").alias("b"))
    ids = F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("a", "b")))))  # three strata a category
    return least.groupBy("category").agg(ids.alias("ids")).select("category", review.selection_digest(SEED, "bench", F.col("ids")).alias("digest"), F.size("ids").alias("regions"))


def runtime_qa_codes(spark: SparkSession, d: str) -> DataFrame:
    """Codes of the reasons for which regions are left out, with their number."""
    r = D.benchmark_regions(spark, d).where("exclusion_reason is not null")
    return r.groupBy(review.qa_code(F.col("exclusion_reason")).alias("code")).agg(F.count("*").alias("regions"))


def resource_headroom(spark: SparkSession, d: str) -> DataFrame:
    """Events as memory readings (value as physical, the property k as commit headroom, each in units of 100 MiB): codes and their number."""
    e = table(spark, d, "events").select((F.col("value") * 100).alias("physical"), (F.get_json_object("props", "$.k").cast("double") * 100).alias("commit"))
    commit = F.when(F.col("commit") < 9000, F.col("commit"))
    return e.groupBy(review.headroom(F.col("physical"), commit).alias("code")).agg(F.count("*").alias("readings"))


def operation_status(spark: SparkSession, d: str) -> DataFrame:
    """Kinds of status among events and readings."""
    status = table(spark, d, "events").select(F.col("event_type").alias("status")).unionByName(table(spark, d, "ocr_candidates").select("status"))
    return status.groupBy(review.status_kind(F.col("status")).alias("kind")).agg(F.count("*").alias("events"), F.count_distinct("status").alias("texts"))


def run_rollup(spark: SparkSession, d: str) -> DataFrame:
    """Each user's run: failures by count, whether every check passed, and the run's status."""
    e = table(spark, d, "events")
    failed, warned = F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") == "signup")
    return e.groupBy("user_id").agg(failed.alias("failures"), F.min(F.coalesce(F.col("event_type") != "error", F.lit(True))).alias("healthy"), F.when(failed > 0, "failed").when(warned > 0, "completed-with-warnings").otherwise("completed").alias("status"))


def failure_counters(spark: SparkSession, d: str) -> DataFrame:
    """Failures by code, a code being the hundreds of the event's value."""
    e = table(spark, d, "events").where("event_type = 'error'")
    return e.groupBy(F.floor(F.col("value") / 100).alias("code")).agg(F.count("*").alias("failures"))


def engine_choice(spark: SparkSession, d: str) -> DataFrame:
    """Per status the engine whose role and name hold most hints."""
    e = table(spark, d, "ocr_candidates").where("engine is not null").select("status", "engine", "engine_role").distinct()
    return review.best_hint(e, ["status"], F.concat_ws(" ", "engine_role", "engine"), list(HINTS), "engine")


def identifier_families(spark: SparkSession, d: str) -> DataFrame:
    """How many identifiers, labels, tags and digests have their safe form, and how many don't."""
    files = table(spark, d, "chapter_manifests").select(F.inline("source_files"))
    obs = table(spark, d, "routing_observations")
    parts = [
        files.select(F.lit("identifier").alias("family"), F.col("page_id").alias("v"), F.lit(review.IDENTIFIER).alias("form")), obs.select(F.lit("identifier").alias("family"), F.col("observation_id").alias("v"), F.lit(review.IDENTIFIER).alias("form")),
        obs.select(F.lit("label").alias("family"), F.col("category").alias("v"), F.lit(review.LABEL).alias("form")), obs.select(F.lit("tag").alias("family"), F.explode("hard_case_tags").alias("v"), F.lit(review.TAG).alias("form")),
        files.select(F.lit("digest").alias("family"), F.col("sha256").alias("v"), F.lit(review.DIGEST).alias("form")),
    ]
    counted = [p.where("v is not null").groupBy("family").agg(F.count_if(F.col("v").rlike(form)).alias("safe"), F.count("*").alias("values")) for p, form in zip(parts, (review.IDENTIFIER, review.IDENTIFIER, review.LABEL, review.TAG, review.DIGEST))]
    whole = counted[0]
    for c in counted[1:]:
        whole = whole.unionByName(c)
    return whole.groupBy("family").agg(F.sum("safe").alias("safe"), F.sum("values").alias("values"))


def cloud_reroute(spark: SparkSession, d: str) -> DataFrame:
    """Answers of regions with a translation: unselected, with the region's translation selected behind them."""
    t = table(spark, d, "translation_candidates").where("region_id is not null").select("candidate_row", "region_id", "model", "text", "selected", "selection_reason", "route").distinct()
    # One region has a handful of answers, one for each model.
    per = t.groupBy("region_id").agg(F.array_sort(F.collect_list(F.struct("candidate_row", "model", "text", "selected", "selection_reason", "route"))).alias("c"))
    r = per.join(D.regions(spark, d).select("region_id", "translated_text"), "region_id")
    plain = F.transform("c", lambda c: F.struct(c["model"].alias("model"), c["text"].alias("text"), c["selected"].alias("selected"), c["selection_reason"].alias("selection_reason"), c["route"].alias("route")))
    return r.select("region_id", F.inline(review.rerouted(plain, F.lit("model-cloud"), F.col("translated_text"), "cloud-enabled")))


def manifest_pages(spark: SparkSession, d: str) -> DataFrame:
    """Source files with their page ids, numbered by place where a page id is missing."""
    f = table(spark, d, "chapter_manifests").select("chapter_id", F.posexplode("source_files").alias("i", "f"))
    return f.select("chapter_id", (F.col("i") + 1).alias("position"), F.coalesce("f.page_id", F.concat(F.lit("source-page-"), F.col("i") + 1)).alias("page_id"), "f.file_name", F.lower("f.sha256").alias("sha256"))


def region_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Read regions with the evidence of their own page and id: how many have one, and how many lie in a bubble by it."""
    r = D.regions(spark, d).select("region_id", D.page_key(F.col("page_id")).alias("page_id"), "role")
    o = D.observations(spark, d).select(F.col("observation_id").alias("region_id"), "page_id", "evidence")
    j = r.join(o, ["region_id", "page_id"], "left")
    return j.groupBy("role").agg(F.count("*").alias("regions"), F.count("evidence").alias("with_evidence"), F.count_if("evidence.inside_bubble").alias("inside"))


def queries() -> dict:
    found = [
        overlay_contract, settled_regions, translation_input_contract, translation_run_contract, translation_run_repeats, ocr_pass_alignment, decision_alignment, geometry_alignment, historical_run, reference_drift, unevaluated_chapters, baseline_reproduction,
        polygon_gate, first_passing_policy, selection_digest, runtime_qa_codes, resource_headroom, operation_status, run_rollup, failure_counters, engine_choice, identifier_families, cloud_reroute, manifest_pages, region_evidence,
    ]
    return {f.__name__: f for f in found}


def _rules(rows: str, key: str, rules: dict[str, str]) -> str:
    """Union of one query for each rule."""
    return " union all ".join(f"select '{n}' as rule, {key}::varchar as key from {rows} where {c}" for n, c in rules.items())


def _aligned(a: str, b: str, key: str, column: str) -> str:
    """Alignment of two tables of (key, column) in SQL."""
    return f"""sa as (select {key}, count(*) as n, min({column}) as v from {a} group by {key}), sb as (select {key}, count(*) as n, min({column}) as v from {b} group by {key}),
        j as (select coalesce(sa.{key}, sb.{key}) as {key}, sa.n as an, sb.n as bn, sa.v as av, sb.v as bv from sa full join sb on sa.{key} = sb.{key})
        select {key}, 'extra' as issue from j where an is null union all select {key}, 'missing' from j where bn is null union all select {key}, 'repeated' from j where an > 1 or bn > 1
        union all select {key}, '{column}-conflict' from j where an is not null and bn is not null and av is distinct from bv"""


def oracle_sql() -> dict[str, str]:
    blank = "({0} is null or trim({0}) = '')"
    excluded, missed = "ocr_eligibility is not distinct from 'excluded'", "detection_status is not distinct from 'missed'"
    ocr = ocr_queries.oracle_sql()
    no_id = f"coalesce(not regexp_matches(region_id, '{review.IDENTIFIER}'), true)"
    return {
        "overlay_contract": _rules("ocr_benchmark_regions", "row_id", {
            "unsafe-id": no_id, "unknown-detection": f"detection_status not in {review.DETECTION}", "unknown-eligibility": f"ocr_eligibility not in {review.ELIGIBILITY}", "unknown-reason": f"exclusion_reason not in {REASONS}",
            "blank-gold": "trim(expected_ocr) = ''", "excluded-without-reason": f"{excluded} and exclusion_reason is null", "reason-without-exclusion": f"exclusion_reason is not null and not ({excluded})",
            "excluded-with-gold": f"{excluded} and expected_ocr is not null", "missed-not-excluded": f"{missed} and not ({excluded} and exclusion_reason is not distinct from 'detection-missed')",
            "changes-nothing": "detection_status is null and ocr_eligibility is null and expected_ocr is null",
        }),
        "settled_regions": f"""with {D.REGIONS_SQL}, s as (select *, case when detection_status = 'missed' then 'excluded' else coalesce(ocr_eligibility, 'eligible') end as status from bench where detection_status in ('detected', 'missed'))
            select region_id, page_id, detection_status, status as ocr_eligibility, case when detection_status = 'missed' then 'detection-missed' else exclusion_reason end as exclusion_reason, case when status = 'eligible' then expected_ocr end as expected_ocr from s""",
        "translation_input_contract": "with g as (select distinct * from golden_regions) " + _rules("g", "region_id", {
            "unsafe-id": no_id, "unsafe-page": no_id.replace("region_id", "page_id"), "gold-missing": blank.format("expected_ocr"), "reference-missing": blank.format("expected_translation"),
            "box-missing": "bbox is null", "refusal-rule-missing": "non_refusal_required is null",
        }),
        "translation_run_contract": """with known as (select distinct region_id as k from golden_regions where region_id is not null),
            r as (select *, coalesce(detected, false) as on_ from (select distinct candidate_row, region_id, detected, ocr_text, translation, semantic_usable from candidate_regions) left join known on region_id = k) """ + _rules("r", "candidate_row", {
            "region-missing": "region_id is null", "region-unknown": "region_id is not null and k is null", "source-missing": "on_ and ocr_text is null", "translation-missing": "on_ and translation is null",
            "review-without-output": "semantic_usable is not null and translation is null", "output-of-undetected": "not on_ and translation is not null",
        }),
        "translation_run_repeats": "select candidate_id, region_id, count(*) as outputs from (select distinct candidate_row, candidate_id, region_id from candidate_regions where region_id is not null) group by all having count(*) > 1",
        "ocr_pass_alignment": f"""with r as (select distinct candidate_row, region_id, engine, status from ocr_candidates where region_id is not null), pa as (select * from r where engine = '{D.PADDLE}'), pb as (select * from r where engine = '{D.MANGA}'),
            {_aligned('pa', 'pb', 'region_id', 'status')}""",
        "decision_alignment": f"""with {D.REGIONS_SQL}, {D.READ_SQL}, pa as (select region_id, page_id as page from bench), pb as (select region_id, {D.page_key_sql('page_id')} as page from read), {_aligned('pa', 'pb', 'region_id', 'page')}""",
        "geometry_alignment": f"""with {D.READ_SQL}, pa as (select region_id, any_value(bbox) as box from golden_regions where region_id is not null group by region_id), pb as (select region_id, bbox as box from read),
            al as ({{}}) select * from al where issue <> 'extra'""".replace("al as ({})", "al as (with " + _aligned("pa", "pb", "region_id", "box") + ")"),
        "historical_run": f"""with {D.REGIONS_SQL}, {D.READ_SQL} select region_id, b.page_order, r.region_order, r.source_text, r.translated_text from read r join bench b using (region_id) where r.source_text is not null and r.translated_text is not null""",
        "reference_drift": f"""with {D.READ_SQL}, g as (select region_id, any_value(expected_translation) as t from golden_regions where region_id is not null group by region_id)
            select region_id, g.t as base_value, r.translated_text as other_value from g join read r using (region_id) where g.t is distinct from r.translated_text""",
        "unevaluated_chapters": f"""with pages as (select chapter_id, f.page_id from chapter_manifests, unnest(source_files) t(f)), seen as (select distinct {D.page_key_sql('page_id')} as page_id from partial_regions where page_id is not null)
            select chapter_id, count(*) as pages from pages where page_id is null or page_id not in (select page_id from seen) group by chapter_id""",
        "baseline_reproduction": f"""with b as ({ocr['ocr_baseline_by_engine']}), m as ({ocr['arbitration_metrics']})
            select b.engine, m.regions as p_regions, m.exact as p_exact, m.edits as p_edits, m.regions = b.regions and m.exact = b.exact and m.edits = b.adjusted_edits as reproduced
            from m join b on b.engine = case m.policy when 'always-paddle' then '{D.PADDLE}' when 'always-manga' then '{D.MANGA}' end""",
        "polygon_gate": f"""with {D.OBSERVATIONS_SQL}, c as (
                select coalesce(category, 'none') as category, detected, evidence.geometry_source as source from obs union all select 'all', detected, evidence.geometry_source from obs
            ), n as (select category, count(*) filter (detected) as detected, count(*) filter (detected and source = 'line-polygons') as polygons, count(*) filter (detected and source = 'bbox') as boxes from c group by category)
            select category, detected, polygons, boxes, case when polygons = 0 then 'LINE_POLYGONS_UNAVAILABLE' when boxes > 0 then 'BBOX_FALLBACK_PRESENT' when polygons <> detected then 'GEOMETRY_EVIDENCE_INCOMPLETE' end as reason,
                case when polygons > 0 and boxes = 0 and polygons = detected then 'passed' else 'failed' end as status from n""",
        "first_passing_policy": """with s as (select any_value(category) as category, any_value(ocr_policy) as ocr_policy, any_value(cer) as cer from region_scores where cer is not null and not isnan(cer) and not isinf(cer) and cer >= 0 group by score_id),
            r as (select category, ocr_policy, count(*) filter (cer <= 0.03) / count(*) as rate from s group by all)
            select category, min(ocr_policy) filter (rate >= 0.6) as policy, count(*) filter (rate >= 0.6) as passed from r group by category""",
        "selection_digest": f"""with {D.REGIONS_SQL}, n as (select coalesce(category, 'none') as category, region_id, length({D.norm_sql('expected_ocr')}) as n from bench where ocr_eligibility = 'eligible' and expected_ocr is not null),
            st as (select category, case when n <= 8 then 'short' when n <= 20 then 'medium' else 'long' end as stratum, min(region_id) as a, max(region_id) as b from n group by all),
            ids as (select category, list_sort(list_distinct(flatten(list([a, b])))) as ids from st group by category)
            select category, sha256('{{"selectorRevision":1,"benchmarkId":"bench","seed":"{SEED}","selectedRegionIds":' || to_json(ids)::varchar || '}}') as digest, len(ids)::int as regions from ids""",
        "runtime_qa_codes": f"with {D.REGIONS_SQL} select 'OCR_RUNTIME_' || upper(replace(exclusion_reason, '-', '_')) as code, count(*) as regions from bench where exclusion_reason is not null group by all",
        "resource_headroom": """with e as (select value * 100 as physical, case when (props::json ->> '$.k')::double * 100 < 9000 then (props::json ->> '$.k')::double * 100 end as commit from events)
            select case when physical < 4096 then 'PHYSICAL_MEMORY_LOW' when commit is null then 'COMMIT_COUNTER_UNAVAILABLE' when commit < 8192 then 'COMMIT_HEADROOM_LOW' else 'RESOURCE_HEADROOM_OK' end as code, count(*) as readings from e group by all""",
        "operation_status": """with s as (select event_type as status from events union all select status from ocr_candidates)
            select case when status is null or trim(status) = '' then 'idle' when regexp_matches(lower(status), 'fail|error|cancel') then 'failed' when regexp_matches(lower(status), 'finish|complete|success|done|purchase') then 'finished' else 'active' end as kind,
                count(*) as events, count(distinct status) as texts from s group by kind""",
        "run_rollup": """select user_id, count(*) filter (event_type = 'error') as failures, bool_and(coalesce(event_type <> 'error', true)) as healthy,
            case when count(*) filter (event_type = 'error') > 0 then 'failed' when count(*) filter (event_type = 'signup') > 0 then 'completed-with-warnings' else 'completed' end as status from events group by user_id""",
        "failure_counters": "select floor(value / 100)::bigint as code, count(*) as failures from events where event_type = 'error' group by all",
        "engine_choice": f"""with e as (select distinct status, engine, lower(concat_ws(' ', engine_role, engine)) as t from ocr_candidates where engine is not null),
            s as (select *, {' + '.join(f"contains(t, '{h}')::int" for h in HINTS)} as score from e)
            select status, engine as choice, score from (select *, row_number() over (partition by status order by score desc, engine) as k from s) where k = 1""",
        "identifier_families": f"""with f as (select f.page_id, f.sha256 from chapter_manifests, unnest(source_files) t(f)), v as (
                select 'identifier' as family, page_id as v, '{review.IDENTIFIER}' as form from f union all select 'identifier', observation_id, '{review.IDENTIFIER}' from routing_observations
                union all select 'label', category, '{review.LABEL}' from routing_observations union all select 'tag', unnest(hard_case_tags), '{review.TAG}' from routing_observations union all select 'digest', sha256, '{review.DIGEST}' from f)
            select family, (count(*) filter (regexp_matches(v, form)))::bigint as safe, count(*) as values from v where v is not null group by family""",
        "cloud_reroute": f"""with {D.READ_SQL}, t as (select distinct candidate_row, region_id, model, text, selected, selection_reason, route from translation_candidates where region_id is not null),
            j as (select t.*, r.translated_text as more from t join read r using (region_id))
            select region_id, model, text, case when coalesce(more <> '', false) then false else selected end as selected, selection_reason, route from j
            union all select distinct region_id, 'model-cloud', more, true, 'cloud-enabled', 'cloud' from j where coalesce(more <> '', false)""",
        "manifest_pages": """select chapter_id, i as position, coalesce(source_files[i].page_id, 'source-page-' || i) as page_id, source_files[i].file_name as file_name, lower(source_files[i].sha256) as sha256
            from (select chapter_id, source_files, unnest(range(1, len(source_files) + 1))::int as i from chapter_manifests)""",
        "region_evidence": f"""with {D.READ_SQL}, {D.OBSERVATIONS_SQL}, r as (select region_id, {D.page_key_sql('page_id')} as page_id, role from read), o as (select observation_id as region_id, page_id, evidence from obs)
            select role, count(*) as regions, count(evidence) as with_evidence, count(*) filter (evidence.inside_bubble) as inside from r left join o using (region_id, page_id) group by role""",
    }
