"""Queries over routing observations and translated regions, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgauge.functions import text as X
from leafgauge.operators import contracts, quality, routing
from leafgauge.operators.scene_walk import walked_regions
from leafgauge.plans import domain as D
from leafgauge.session import table


def _routed(spark: SparkSession, d: str) -> DataFrame:
    return routing.routed(D.observations(spark, d))


def routing_distribution(spark: SparkSession, d: str) -> DataFrame:
    return routing.summary(_routed(spark, d))


def routing_by_category(spark: SparkSession, d: str) -> DataFrame:
    return routing.distribution(_routed(spark, d).where("detected"), "category")


def routing_page_safety(spark: SparkSession, d: str) -> DataFrame:
    return routing.page_safety(_routed(spark, d))


def routing_separation(spark: SparkSession, d: str) -> DataFrame:
    return routing.separation(_routed(spark, d))


def routing_contract_violations(spark: SparkSession, d: str) -> DataFrame:
    return contracts.violations(D.observations(spark, d), "observation_id", routing.contract_rules())


def routing_hard_cases(spark: SparkSession, d: str) -> DataFrame:
    return routing.hard_cases(D.observations(spark, d))


def _flagged(spark: SparkSession, d: str) -> DataFrame:
    return quality.chapter_flags(D.regions(spark, d))


def region_qa_flags(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_rows(_flagged(spark, d)).select("region_id", "position", "code", "severity", "detail")


def region_qa_summary(spark: SparkSession, d: str) -> DataFrame:
    return quality.flag_rows(_flagged(spark, d)).groupBy("code").agg(F.count("*").alias("flags"))


def chapter_duplicate_translations(spark: SparkSession, d: str) -> DataFrame:
    return quality.duplicate_targets(D.regions(spark, d))


def page_flag_lists(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_lists(_flagged(spark, d))


def _pages(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chapter_manifests")
    return m.select("chapter_id", (F.size("source_files") - 1).alias("last"), F.posexplode("source_files").alias("page_no", "f")).select("chapter_id", "last", "page_no", F.col("f.page_id").alias("page_id"))


def page_protection_plan(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_plan(_pages(spark, d), _flagged(spark, d)).select("chapter_id", "page_id", F.array_join("codes", ",").alias("codes"))


def skipped_region_flags(spark: SparkSession, d: str) -> DataFrame:
    """Number of flags of each region after marking those on preserved pages, twice."""
    flagged = _flagged(spark, d)
    plan = quality.page_plan(_pages(spark, d), flagged)
    return quality.mark_skipped(quality.mark_skipped(flagged, plan), plan).select("region_id", F.size("qa_flags").alias("flags"))


def glossary_mode(spark: SparkSession, d: str) -> DataFrame:
    return quality.glossary(D.regions(spark, d))


def glossary_prompts(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "chapter_manifests").where("glossary is not null").select("chapter_id", F.explode("glossary").alias("source", "target"))
    return quality.glossary_prompt(m, "翻译", "chapter_id")


def page_chunks(spark: SparkSession, d: str) -> DataFrame:
    return quality.page_chunks(_pages(spark, d), 3, 1, "chapter_id")


def input_order(spark: SparkSession, d: str) -> DataFrame:
    """Pages of each chapter in the natural order of their file names."""
    from pyspark.sql import Window as W

    f = table(spark, d, "chapter_manifests").select("chapter_id", F.inline("source_files")).select("chapter_id", "page_id", "file_name", X.natural_key(F.col("file_name")).alias("key"))
    return f.withColumn("position", F.row_number().over(W.partitionBy("chapter_id").orderBy("key", "page_id")) - 1).drop("key")


def manifest_pins(spark: SparkSession, d: str) -> DataFrame:
    """Pages whose scan hash isn't a usable pin."""
    f = table(spark, d, "chapter_manifests").select("chapter_id", F.inline("source_files"))
    low = F.lower("sha256")
    bad = F.when(low.isNull(), "missing").when(~low.rlike("^[0-9a-f]{64}$"), "malformed").when(F.replace(low, F.substring(low, 1, 1), F.lit("")) == "", "placeholder")
    return f.select("page_id", bad.alias("rule")).where("rule is not null")


def fallback_ids(spark: SparkSession, d: str) -> DataFrame:
    """Opaque and fallback ids of regions."""
    r = D.benchmark_regions(spark, d).select("region_id", "page_id")
    return r.select("region_id", F.sha2(F.concat(F.lit("ocr-m3.2-region:"), F.col("region_id")), 256).alias("opaque"), F.concat(F.lit("region-"), F.substring(F.sha2(F.concat("page_id", F.lit("/"), "region_id"), 256), 1, 16)).alias("fallback"))


def length_strata(spark: SparkSession, d: str) -> DataFrame:
    r = D.benchmark_regions(spark, d)
    stratum = X.length_stratum(F.when(F.col("ocr_eligibility") == "eligible", X.normalized(F.col("expected_ocr"))))
    return r.groupBy("category", stratum.alias("stratum")).agg(F.count("*").alias("regions"))


def scene_walk_regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions by the walk over scenes of unknown shape."""
    return walked_regions(table(spark, d, "scene_snapshots"))


SCENE_SCHEMA = {
    "type": "object", "required": ["project", "pages"], "properties": {"project": {"type": "object", "required": ["id"], "properties": {"id": {"type": "string", "pattern": "^project-[0-9]+$"}}}, "components": {"type": "array", "items": {"$ref": "#/$defs/component"}}},
    "$defs": {"component": {"type": "object", "required": ["type", "ownerId", "pageId"], "properties": {"type": {"enum": ["SourceText", "Translation", "Geometry"]}}}},
}


def scene_schema_errors(spark: SparkSession, d: str) -> DataFrame:
    """Scenes that break the scene schema, with their errors."""
    from leafgauge.operators.json_documents import schema_check

    s = table(spark, d, "scene_snapshots").dropDuplicates(["snapshot_id"])
    return s.select("snapshot_id", F.explode(schema_check(SCENE_SCHEMA)(F.col("scene"))).alias("error"))


def scene_hashes(spark: SparkSession, d: str) -> DataFrame:
    """Canonical hash and number of pages of each readable scene."""
    from leafgauge.operators.json_documents import document_hash, document_page_ids

    s = table(spark, d, "scene_snapshots").dropDuplicates(["snapshot_id"])
    return s.select("snapshot_id", document_hash("scene").alias("sha256"), F.size(document_page_ids("scene")).alias("pages")).where("sha256 is not null")


def queries() -> dict:
    found = [
        scene_schema_errors, scene_hashes, routing_distribution, routing_by_category, routing_page_safety, routing_separation, routing_contract_violations, routing_hard_cases, region_qa_flags, region_qa_summary, chapter_duplicate_translations,
        page_flag_lists, page_protection_plan, skipped_region_flags, glossary_mode, glossary_prompts, page_chunks, input_order, manifest_pins, fallback_ids, length_strata, scene_walk_regions,
    ]
    return {f.__name__: f for f in found}


_ROUTED = f"""with {D.OBSERVATIONS_SQL},
    roles as (select *, case when native_role in ('dialogue', 'caption', 'sfx') then native_role when coalesce(evidence.inside_bubble, false) and evidence.confidence >= 0.8 then 'dialogue' else 'unknown' end as role from obs),
    routed as (select *, case when role in ('dialogue', 'caption') then 'replace' else 'preserve-with-annotation' end as policy, case when role in ('dialogue', 'caption') then 'ordinary-dialogue' when evidence.inside_bubble = false then 'bubble-external' else 'unknown' end as routing_class from roles)"""


def _ns(x: str) -> str:
    return f"regexp_replace({x}, '{D.SPACE_SQL}', '', 'g')"


_FLAGS = f"""with {D.READ_SQL},
    texts as (select *, coalesce(source_text, '') as s, regexp_replace(regexp_replace(coalesce(translated_text, ''), '^{D.SPACE_SQL}', ''), '{D.SPACE_SQL}$', '') as t from read),
    sized as (select *, length({_ns('t')}) as tn, length({_ns('s')}) as sn from texts),
    ruled as (
        select *, list_filter([
            case when confidence < 0.86 then {{'code': 'LOW_OCR_CONFIDENCE', 'severity': 'warning', 'detail': null::varchar}} end,
            case when contains(s, chr(65533)) or len(list_filter(range(1, length(s) - 3), lambda i: s[i:i + 4] = repeat(s[i], 5) and s[i] <> chr(10))) > 0 then {{'code': 'OCR_TEXT_ANOMALY', 'severity': 'warning', 'detail': null::varchar}} end,
            case when t = '' and policy = 'replace' then {{'code': 'MISSING_TRANSLATION', 'severity': 'error', 'detail': null::varchar}} end,
            case when t <> '' and regexp_matches(t, '(?i)</?think\\b[^>]*>|<\\|(?:analysis|reasoning)(?:_content)?\\|>') then {{'code': 'LLM_REASONING_LEAK', 'severity': 'error', 'detail': null::varchar}} end,
            case when t <> '' and regexp_matches(t, '(?i)(无法(?:协助|翻译|处理)|不能(?:协助|翻译|处理)|抱歉.{{0,12}}(?:不能|无法)|I\\s+(?:can(?:not|''t)|am unable to)\\s+(?:help|translate|assist))') then {{'code': 'TRANSLATION_REFUSAL', 'severity': 'error', 'detail': null::varchar}} end,
            case when t <> '' and policy = 'replace' and regexp_matches(t, '[\\x{{3040}}-\\x{{30FF}}\\x{{FF66}}-\\x{{FF9F}}]') then {{'code': 'JAPANESE_KANA_REMAINS', 'severity': 'error', 'detail': null::varchar}} end
        ], lambda x: x is not null) as head,
        case when t = '' then [] else list_transform(list_filter(regexp_extract_all(s, '[0-9０-９]+|[!?！？…]+'), lambda x: not list_contains(regexp_extract_all(t, '[0-9０-９]+|[!?！？…]+'), x)), lambda x: {{'code': 'SIGNIFICANT_TOKEN_LOST', 'severity': 'warning', 'detail': x}}) end as lost,
        list_filter([
            case when t <> '' and tn / greatest(1, sn) > 2.8 then {{'code': 'TRANSLATION_TOO_LONG', 'severity': 'warning', 'detail': null::varchar}} end,
            case when t <> '' and tn / greatest(1, sn) < 0.25 then {{'code': 'TRANSLATION_TOO_SHORT', 'severity': 'warning', 'detail': null::varchar}} end,
            case when t <> '' and bbox.width > 0 and bbox.height > 0 and tn > greatest(1, floor(bbox.width / 20) * floor(bbox.height / 20)) then {{'code': 'TEXT_OVERFLOW_RISK', 'severity': 'error', 'detail': null::varchar}} end
        ], lambda x: x is not null) as tail from sized
    ), dup as (select chapter_id, target, count(*) as sources from (select distinct chapter_id, lower({_ns('translated_text')}) as target, {_ns("coalesce(source_text, '')")} as source from read where translated_text <> '') group by all having count(*) >= 3),
    flagged as (
        select r.*, list_concat(list_concat(head, lost), list_concat(tail, case when d.target is not null and length(r.translated_text) >= 3 then [{{'code': 'SUSPICIOUS_DUPLICATE_TRANSLATION', 'severity': 'warning', 'detail': null::varchar}}] else [] end)) as flags
        from ruled r left join dup d on d.chapter_id is not distinct from r.chapter_id and d.target = lower({_ns('r.translated_text')})
    ), coded as (select *, list_transform(flags, lambda f: f.code) as codes from flagged),
    judged as (
        select *, list_has_any(codes, ['MISSING_TRANSLATION', 'LLM_REASONING_LEAK', 'TRANSLATION_REFUSAL', 'JAPANESE_KANA_REMAINS']) or list_has_all(codes, ['TRANSLATION_TOO_LONG', 'TEXT_OVERFLOW_RISK']) as strict,
            list_has_any(codes, ['MISSING_TRANSLATION', 'LLM_REASONING_LEAK', 'TRANSLATION_REFUSAL', 'JAPANESE_KANA_REMAINS', 'SIGNIFICANT_TOKEN_LOST', 'TRANSLATION_TOO_LONG', 'TRANSLATION_TOO_SHORT', 'TEXT_OVERFLOW_RISK', 'SUSPICIOUS_DUPLICATE_TRANSLATION']) as retry_text from coded
    )"""
_PAGES = "pages as (select chapter_id, len(source_files) - 1 as last, i - 1 as page_no, source_files[i].page_id as page_id from chapter_manifests, range(1, len(source_files) + 1) t(i))"
_PLAN = f"""{_FLAGS}, {_PAGES},
    sums as (select page_id, count(*) as n, bool_or(strict) as strict, bool_or(role = 'unknown') as unk, bool_and(role = 'sfx' and policy = 'preserve-with-annotation') as art, count(*) filter (len(codes) > 0) as risky from judged group by page_id),
    plan as (select * from (select p.chapter_id, p.page_id, array_to_string(list_filter([case when strict then 'BLOCKING_REGION_QA' end, case when coalesce(n, 0) = 0 then 'NO_TEXT_REGIONS_DETECTED' end, case when unk then 'UNCLASSIFIED_TEXT_REGION' end,
        case when n > 0 and art then 'ARTISTIC_TEXT_ONLY_PAGE' end, case when page_no in (0, last) and n > 0 and ((n <= 2 and risky = n) or (n >= 12 and risky / n >= 0.5)) then 'RISKY_BOUNDARY_PAGE' end], lambda x: x is not null), ',') as codes
        from pages p left join sums s using (page_id)) where codes <> '')"""


def oracle_sql() -> dict[str, str]:
    bubble = "detected and evidence.role_provenance = 'bubble-mask'"
    want_in = "(overlap_rate >= 0.8 and dominant_share >= 0.8)"
    return {
        "routing_distribution": f"""{_ROUTED}, c as (select count(*) as regions, count(*) filter (detected) as detected_regions, count(*) filter (detected and role = 'dialogue') as role_dialogue, count(*) filter (detected and role = 'caption') as role_caption,
            count(*) filter (detected and role = 'sfx') as role_sfx, count(*) filter (detected and role = 'unknown') as role_unknown, count(*) filter (detected and policy = 'replace') as policy_replace, count(*) filter (detected and policy <> 'replace') as policy_preserve,
            count(*) filter ({bubble} and evidence.inside_bubble and role = 'dialogue') as mapped, count(*) filter (detected and routing_class <> 'unknown') as classified, count(*) filter ({bubble} and evidence.geometry_source = 'line-polygons') as line_polygons,
            count(*) filter ({bubble} and evidence.geometry_source = 'bbox') as bbox, count(*) filter (native_role = 'unknown' and legacy_policy = 'replace') as legacy_unknown_replace from routed)
            select *, coalesce(mapped / nullif(detected_regions, 0), 0) as mapped_rate, coalesce(classified / nullif(detected_regions, 0), 0) as classified_rate from c""",
        "routing_by_category": f"{_ROUTED} select category, count(*) filter (routing_class = 'ordinary-dialogue') as ordinary_dialogue, count(*) filter (routing_class = 'bubble-external') as bubble_external, count(*) filter (routing_class = 'unknown') as unknown, count(*) as regions from routed where detected group by category",
        "routing_page_safety": f"""{_ROUTED}, p as (select page_id, bool_or(coalesce(detected, false)) as seen, bool_or(coalesce(detected and role = 'unknown', false)) as unk from routed group by page_id)
            select count(*) as pages, count(*) filter (unk) as pages_unknown, count(*) filter (not seen) as pages_empty, count(*) filter (seen and not unk) as pages_free from p""",
        "routing_separation": f"""{_ROUTED} select max(overlap_rate) filter (routing_class = 'bubble-external') as external_max, min(overlap_rate) filter (routing_class = 'ordinary-dialogue') as dialogue_min,
            min(dominant_share) filter (routing_class = 'ordinary-dialogue') as dialogue_share_min from routed where detected""",
        "routing_contract_violations": f"""{_ROUTED}, w as (select *, case when {want_in} then true when overlap_rate <= 0.05 then false end as want, case when {want_in} then least(overlap_rate, dominant_share) when overlap_rate <= 0.05 then 1 - overlap_rate else greatest(overlap_rate, 1 - overlap_rate) end as conf from obs)
            select r as rule, observation_id as key from (select observation_id, unnest(list_filter([
            case when not (overlap_rate between 0 and 1) or not (dominant_share between 0 and 1) or not (evidence.confidence between 0 and 1) then 'rate-out-of-range' end, case when (overlap_rate = 0) <> (dominant_share = 0) then 'zero-overlap-mismatch' end,
            case when evidence.role_provenance = 'bubble-mask' and overlap_rate is not null and dominant_share is not null and evidence.inside_bubble is distinct from want then 'decision-mismatch' end,
            case when evidence.role_provenance = 'bubble-mask' and abs(evidence.confidence - conf) > 1e-9 then 'confidence-mismatch' end, case when evidence.role_provenance = 'bubble-mask' and evidence.geometry_source is null then 'geometry-missing' end,
            case when category is null then 'category-missing' end, case when coalesce(len(hard_case_tags), 0) > 0 and hardness is null then 'tags-without-hardness' end], lambda x: x is not null)) as r from w)""",
        "region_qa_flags": f"{_FLAGS} select region_id, (i - 1)::int as position, flags[i].code as code, flags[i].severity as severity, flags[i].detail as detail from coded, range(1, len(flags) + 1) t(i)",
        "region_qa_summary": f"{_FLAGS} select code, count(*) as flags from (select unnest(codes) as code from coded) group by code",
        "chapter_duplicate_translations": f"{_FLAGS} select * from dup",
        "page_flag_lists": f"{_FLAGS}, p as (select page_id, bool_or(len(codes) > 0) as retry, bool_or(retry_text) as translation_retry, bool_or(strict) as blocked from judged group by page_id) select * from p where retry or translation_retry or blocked",
        "page_protection_plan": f"{_PLAN} select * from plan",
        "skipped_region_flags": f"{_PLAN} select region_id, (len(flags) + (page_id in (select page_id from plan))::int)::int as flags from judged",
        "glossary_mode": f"""with {D.READ_SQL}, t as (select {_ns("coalesce(source_text, '')")} as source, {_ns('translated_text')} as target from read where translated_text <> '' and role <> 'sfx'),
            c as (select source, target, count(*) as uses from t where length(source) >= 2 and target <> '' group by all)
            select source, target, uses from (select *, row_number() over (partition by source order by uses desc, target) as k from c) where k = 1 and uses >= 2""",
        "glossary_prompts": """with e as (select chapter_id, unnest(map_keys(glossary)) as source, unnest(map_values(glossary)) as target from chapter_manifests where glossary is not null),
            r as (select *, row_number() over (partition by chapter_id order by source) as k from e)
            select chapter_id, '翻译' || chr(10) || '必须遵守以下章节术语表：' || chr(10) || string_agg(source || ' => ' || target, chr(10) order by source) as prompt from r where k <= 100 group by chapter_id""",
        "page_chunks": f"""with {_PAGES}, c as (select *, greatest(0, ceil((last + 1 - 3) / 2.0))::bigint as final from pages)
            select chapter_id, chunk_no, page_id, page_no - chunk_no * 2 as position from c, range(0, 100000) t(chunk_no) where chunk_no <= final and page_no >= chunk_no * 2 and page_no < chunk_no * 2 + 3""",
        "manifest_pins": f"""select page_id, rule from (select f.page_id as page_id, case when f.sha256 is null then 'missing' when not regexp_full_match(lower(f.sha256), '[0-9a-f]{{64}}') then 'malformed'
            when replace(lower(f.sha256), lower(f.sha256)[1], '') = '' then 'placeholder' end as rule from chapter_manifests, unnest(source_files) t(f)) where rule is not null""",
        "fallback_ids": f"with {D.REGIONS_SQL} select region_id, sha256('ocr-m3.2-region:' || region_id) as opaque, 'region-' || sha256(page_id || '/' || region_id)[1:16] as fallback from bench",
        "input_order": r"""with f as (select chapter_id, unnest(source_files) as f from chapter_manifests),
            k as (select chapter_id, f.page_id as page_id, f.file_name as file_name, array_to_string(list_transform(regexp_extract_all(lower(f.file_name), '\d+|\D+'), lambda x: case when regexp_matches(x, '^\d') then '0' || lpad(ltrim(x, '0'), 40, '0') else x end), chr(1)) as key from f)
            select chapter_id, page_id, file_name, (row_number() over (partition by chapter_id order by key nulls first, page_id) - 1)::int as position from k""",
        "length_strata": f"""with {D.REGIONS_SQL}, n as (select category, case when ocr_eligibility = 'eligible' then length({D.norm_sql('expected_ocr')}) end as n from bench)
            select category, case when n is null then 'not-applicable' when n <= 8 then 'short' when n <= 20 then 'medium' else 'long' end as stratum, count(*) as regions from n group by all""",
    }
