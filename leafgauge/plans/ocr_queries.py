"""Queries over recognition benchmarks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgauge.functions.rng import mulberry, mulberry_sql
from leafgauge.operators import contracts, ocr
from leafgauge.plans import domain as D
from leafgauge.session import cut, table

MIN_SUPPORT = 5
SEED = 20260811
REPLICATES = 5000


def _units(spark: SparkSession, d: str) -> DataFrame:
    return cut(ocr.units(D.benchmark_regions(spark, d), D.observations(spark, d), D.PADDLE, D.MANGA))


def _predictions(spark: SparkSession, d: str) -> DataFrame:
    rows = _units(spark, d)
    return ocr.predictions(rows, cut(ocr.held_out_models(rows, MIN_SUPPORT)))


def ocr_baseline_by_engine(spark: SparkSession, d: str) -> DataFrame:
    return ocr.baseline(ocr.engine_rows(D.benchmark_regions(spark, d), (D.PADDLE, D.MANGA)))


def ocr_denominators(spark: SparkSession, d: str) -> DataFrame:
    return ocr.denominators(D.benchmark_regions(spark, d))


def ocr_pair_agreement(spark: SparkSession, d: str) -> DataFrame:
    return ocr.agreement(_units(spark, d))


def ocr_text_safety(spark: SparkSession, d: str) -> DataFrame:
    """Readings of all engines that can't be used, with reasons."""
    from leafgauge.functions.text import hard_reasons, normalized

    rows = table(spark, d, "ocr_candidates").select("candidate_row", "text").distinct()
    return rows.withColumn("reasons", hard_reasons(F.col("text"), normalized(F.col("text")))).where("size(reasons) > 0").select("candidate_row", F.array_join("reasons", ",").alias("reasons"))


def ocr_contract_violations(spark: SparkSession, d: str) -> DataFrame:
    r = D.benchmark_regions(spark, d)
    eligible, excluded = F.col("ocr_eligibility") == "eligible", F.col("ocr_eligibility") == "excluded"
    rules = {
        "eligible-not-detected": eligible & (F.col("detection_status") != "detected"), "eligible-without-gold": eligible & F.col("expected_ocr").isNull(),
        "excluded-without-reason": excluded & F.col("exclusion_reason").isNull(), "excluded-with-gold": excluded & F.col("expected_ocr").isNotNull(),
        "missed-with-candidates": (F.col("detection_status") == "missed") & (F.size("candidates") > 0), "category-missing": F.col("category").isNull(),
        "engine-twice": F.size("candidates") != F.size(F.array_distinct(F.transform("candidates", lambda c: c["engine"]))),
    }
    return contracts.violations(r, "region_id", rules)


def ocr_population_check(spark: SparkSession, d: str) -> DataFrame:
    """Regions of only one of the two tables."""
    return contracts.population(D.benchmark_regions(spark, d).select("region_id"), D.observations(spark, d).select(F.col("observation_id").alias("region_id")), "region_id")


def ocr_join_conflicts(spark: SparkSession, d: str) -> DataFrame:
    """Regions of both tables whose page, category or detection differ."""
    a = D.benchmark_regions(spark, d).select("region_id", "page_id", "category", (F.col("detection_status") == "detected").alias("detected"))
    b = D.observations(spark, d).select(F.col("observation_id").alias("region_id"), F.col("page_id").alias("o_page"), F.col("category").alias("o_category"), F.col("detected").alias("o_detected"))
    same = lambda x, y: F.col(x).eqNullSafe(F.col(y))
    bad = a.join(b, "region_id").withColumn("conflict", F.concat_ws(",", F.when(~same("page_id", "o_page"), "page"), F.when(~same("category", "o_category"), "category"), F.when(~same("detected", "o_detected"), "detected")))
    return bad.where("conflict <> ''").select("region_id", "conflict")


def overlay_patch_join(spark: SparkSession, d: str) -> DataFrame:
    """Benchmark regions with expected text and category of later deliveries laid over the first ones."""
    rows = table(spark, d, "ocr_benchmark_regions")
    first = rows.where("region_id is not null").groupBy("region_id").agg(F.min_by(F.struct("category", "expected_ocr"), F.struct("received_at", "row_id")).alias("f")).select("region_id", "f.*")
    return ocr.overlay(first, D.latest(rows, "region_id", ["received_at", "row_id"]), "region_id", ["category", "expected_ocr"])


def overlay_unknown_ids(spark: SparkSession, d: str) -> DataFrame:
    """Answered regions that aren't in the benchmark."""
    o = table(spark, d, "translation_candidates").where("region_id is not null").select("region_id").distinct()
    return ocr.unknown_keys(D.benchmark_regions(spark, d), o, "region_id")


def runtime_policy_strict(spark: SparkSession, d: str) -> DataFrame:
    return ocr.runtime_choice(_units(spark, d), True).groupBy("outcome", F.array_join("reasons", ",").alias("reasons")).count().withColumnRenamed("count", "regions")


def runtime_policy_low_manual(spark: SparkSession, d: str) -> DataFrame:
    return ocr.runtime_choice(_units(spark, d), False).groupBy("outcome", F.array_join("reasons", ",").alias("reasons")).count().withColumnRenamed("count", "regions")


def arbitration_lopo_model(spark: SparkSession, d: str) -> DataFrame:
    return ocr.held_out_models(_units(spark, d), MIN_SUPPORT)


def arbitration_predictions(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).select("policy", "region_id", "engine", "reason", "distance", "gold_chars")


def arbitration_reason_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _predictions(spark, d).groupBy("policy", "reason").agg(F.count("*").alias("regions"))


def arbitration_metrics(spark: SparkSession, d: str) -> DataFrame:
    return ocr.metrics(_predictions(spark, d))


def arbitration_strata(spark: SparkSession, d: str) -> DataFrame:
    p = cut(_predictions(spark, d))
    parts = [ocr.metrics(p, g).withColumn("field", F.lit(g)).withColumnRenamed(g, "stratum") for g in ("category", "bubble")]
    return parts[0].unionByName(parts[1])


def arbitration_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return ocr.bootstrap(cut(_predictions(spark, d)), REPLICATES, SEED)


def bootstrap_random_column(spark: SparkSession, d: str) -> DataFrame:
    """The first 20,000 draws of the generator, as integers of 32 bits."""
    u = mulberry(F.lit(SEED).cast("bigint"), F.col("id"))
    return spark.range(20_000).select(F.col("id").alias("k"), (u * 4294967296).cast("bigint").alias("draw"))


def arbitration_qa_residual_counts(spark: SparkSession, d: str) -> DataFrame:
    return ocr.residual_counts(_units(spark, d))


def arbitration_soft_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    return ocr.soft_diagnostics(_units(spark, d))


def arbitration_script_loss(spark: SparkSession, d: str) -> DataFrame:
    return ocr.script_loss(_units(spark, d))


def ocr_candidate_confidence(spark: SparkSession, d: str) -> DataFrame:
    """Per engine and status: deliveries counted once, confidences and selections."""
    rows = table(spark, d, "ocr_candidates").dropDuplicates(["candidate_row"])
    return rows.groupBy("engine", "status").agg(F.count("*").alias("rows"), F.count("confidence").alias("with_confidence"), F.round(F.avg("confidence"), 9).alias("mean_confidence"), F.count_if("selected").alias("selected"), F.countDistinct("region_id").alias("regions"))


def region_score_summary(spark: SparkSession, d: str) -> DataFrame:
    """Error totals per policy and category over measured scores, repeated deliveries counted once."""
    s = table(spark, d, "region_scores").where("cer is not null and not isnan(cer) and abs(cer) <> double('inf') and cer >= 0").dropDuplicates(["score_id"])
    return s.groupBy("ocr_policy", "category").agg(F.count("*").alias("scores"), F.sum("edits").alias("edits"), F.sum("gold_chars").alias("gold_chars"), F.count_if(F.col("cer") <= 0.03).alias("within_3_percent"), F.max("cer").alias("max_cer"), F.expr("percentile_disc(0.9) within group (order by cer)").alias("p90_cer"))


def queries() -> dict:
    found = [
        ocr_baseline_by_engine, ocr_denominators, ocr_pair_agreement, ocr_text_safety, ocr_contract_violations, ocr_population_check, ocr_join_conflicts, overlay_patch_join, overlay_unknown_ids,
        runtime_policy_strict, runtime_policy_low_manual, arbitration_lopo_model, arbitration_predictions, arbitration_reason_histogram, arbitration_metrics, arbitration_strata, arbitration_bootstrap_ci,
        bootstrap_random_column, arbitration_qa_residual_counts, arbitration_soft_diagnostics, arbitration_script_loss, ocr_candidate_confidence, region_score_summary,
    ]
    return {f.__name__: f for f in found}


_CAND = "list_filter(candidates, lambda c: c.engine = '{0}')[1].text"
_BASE = f"""with {D.REGIONS_SQL}, {D.OBSERVATIONS_SQL},
    plain as (
        select b.region_id, b.page_id, coalesce(b.category, 'none') as category, {D.norm_sql('b.expected_ocr')} as gold, {_CAND.format(D.PADDLE)} as p_text, {_CAND.format(D.MANGA)} as m_text,
            case when o.evidence.inside_bubble then 'bubble-contained' when not o.evidence.inside_bubble then 'bubble-external' else 'bubble-unknown' end as bubble
        from bench b left join obs o on o.observation_id = b.region_id where b.detection_status = 'detected' and b.ocr_eligibility = 'eligible' and b.expected_ocr is not null
    ), normed as (select *, {D.norm_sql('p_text')} as p_norm, {D.norm_sql('m_text')} as m_norm, coalesce({D.norm_sql('p_text')}, '') as p_or, coalesce({D.norm_sql('m_text')}, '') as m_or from plain),
    {D.distance_sql('normed', [('gold', 'p_or', 'p_dist'), ('gold', 'm_or', 'm_dist')], 'measured')},
    units as (select *, p_text is not null and p_norm <> '' and not contains(p_text, chr(65533)) as p_safe, m_text is not null and m_norm <> '' and not contains(m_text, chr(65533)) as m_safe from measured)"""
_MODEL = f"""{_BASE},
    dis as (select * from units where p_safe and m_safe and p_norm <> m_norm),
    grouped as (
        select l.level, case when l.level in ('category-bubble', 'category') then category else '*' end as category, case when l.level in ('category-bubble', 'bubble') then bubble else '*' end as bubble, page_id,
            count(*) as support, count(*) filter (p_dist > 0) as p_wrong, count(*) filter (m_dist > 0) as m_wrong, sum(p_dist) as p_edits, sum(m_dist) as m_edits, sum(length(gold)) as chars
        from dis, (values ('category-bubble'), ('category'), ('bubble'), ('global')) l(level) group by all
    ), held as (
        select '*' as page_id, level, category, bubble, sum(support) as support, sum(p_wrong) as p_wrong, sum(m_wrong) as m_wrong, sum(p_edits) as p_edits, sum(m_edits) as m_edits, sum(chars) as chars from grouped group by level, category, bubble
        union all
        select p.page_id, o.level, o.category, o.bubble, sum(o.support) - any_value(p.support), sum(o.p_wrong) - any_value(p.p_wrong), sum(o.m_wrong) - any_value(p.m_wrong), sum(o.p_edits) - any_value(p.p_edits), sum(o.m_edits) - any_value(p.m_edits), sum(o.chars) - any_value(p.chars)
        from grouped p join grouped o using (level, category, bubble) group by p.page_id, o.level, o.category, o.bubble
    ), models as (
        select page_id, level, category, bubble, support::bigint as support, case when support >= {MIN_SUPPORT} then case when
            coalesce(m_wrong::double / nullif(support, 0), 0) + coalesce(m_edits::double / nullif(chars, 0), 0) < coalesce(p_wrong::double / nullif(support, 0), 0) + coalesce(p_edits::double / nullif(chars, 0), 0)
            then 'manga' else 'paddle' end end as engine from held
    )"""


def _pick(level: str, on: str) -> str:
    return f"(select case when count(*) filter (m.page_id = u.page_id) > 0 then any_value(m.engine) filter (m.page_id = u.page_id) else any_value(m.engine) filter (m.page_id = '*') end from models m where m.level = '{level}' and m.page_id in ('*', u.page_id) {on})"


_PRED = f"""{_MODEL},
    laddered as (
        select u.*, {_pick('category-bubble', 'and m.category = u.category and m.bubble = u.bubble')} as by_cb, {_pick('category', 'and m.category = u.category')} as by_c, {_pick('bubble', 'and m.bubble = u.bubble')} as by_b, {_pick('global', '')} as by_g from units u
    ), reasons as (
        select t.policy, l.*, case when t.policy = 'always-paddle' then 'fixed-paddle' when t.policy = 'always-manga' then 'fixed-manga' when p_safe and m_safe and p_norm = m_norm then 'normalized-agreement'
            when p_safe and not m_safe then 'sole-safe-paddle' when m_safe and not p_safe then 'sole-safe-manga' when not p_safe and not m_safe then 'no-safe-candidate'
            when t.policy = 'agreement-category-bubble' and by_cb is not null then 'category-bubble' when by_c is not null then 'category' when t.policy = 'agreement-category-bubble' and by_b is not null then 'bubble'
            when by_g is not null then 'global' else 'paddle-fallback' end as reason
        from laddered l, (values ('always-paddle'), ('always-manga'), ('agreement-category'), ('agreement-category-bubble')) t(policy)
    ), engines as (
        select *, case reason when 'fixed-manga' then 'manga' when 'sole-safe-manga' then 'manga' when 'no-safe-candidate' then 'none' when 'category-bubble' then by_cb when 'category' then by_c when 'bubble' then by_b when 'global' then by_g else 'paddle' end as engine from reasons
    ), pred as (select policy, region_id, page_id, category, bubble, engine, reason, case engine when 'manga' then m_dist when 'paddle' then p_dist else length(gold) end as distance, length(gold) as gold_chars from engines)"""
_METRIC = """count(*) as regions, count(*) filter (distance = 0) as exact, sum(gold_chars)::bigint as gold_chars, sum(distance)::bigint as edits, avg(distance / greatest(1, gold_chars)) as macro_cer,
    quantile_disc(distance / greatest(1, gold_chars), 0.5) as p50_cer, quantile_disc(distance / greatest(1, gold_chars), 0.9) as p90_cer, quantile_disc(distance / greatest(1, gold_chars), 0.95) as p95_cer, max(distance / greatest(1, gold_chars)) as max_cer,
    count(*) filter (distance / greatest(1, gold_chars) <= 0.03) as within_3_percent, count(*) filter (distance = 0) / count(*) as exact_rate, sum(distance) / sum(gold_chars) as corpus_cer"""
_POLICIES = "('always-paddle'), ('always-manga'), ('agreement-category'), ('agreement-category-bubble')"


def oracle_sql() -> dict[str, str]:
    reason = lambda s, name: f"case when {s}_text is null then ['{name}-candidate-missing'] else list_filter([case when contains({s}_text, chr(65533)) then '{name}-replacement-character' end, case when {s}_norm = '' then '{name}-empty-text' end], lambda x: x is not null) end"
    runtime = lambda other: f"""{_BASE}, outcomes as (
        select case when len(bad) > 0 then 'qa-blocked' when p_text = m_text then 'raw-agreement' when p_norm = m_norm then 'normalized-agreement' else '{other}' end as outcome, bad
        from (select *, list_concat({reason('p', 'paddle')}, {reason('m', 'manga')}) as bad from units)
    ) select outcome, case when len(bad) > 0 then array_to_string(bad, ',') when outcome = 'qa-blocked' then 'candidate-disagreement' else '' end as reasons, count(*) as regions from outcomes group by all"""  # noqa: E731
    both = f"{_BASE} select count(*) filter (p_text is not null and m_text is not null) as paired"
    return {
        "ocr_baseline_by_engine": f"""{_BASE} select engine, count(*) as regions, count(*) filter (t is not null) as available, count(*) filter (t is null) as missing, count(*) filter (t is not null and dist = 0) as exact,
            coalesce(sum(length(gold)) filter (t is not null), 0)::bigint as gold_chars, coalesce(sum(dist) filter (t is not null), 0)::bigint as edits, sum(length(gold))::bigint as all_gold_chars, sum(case when t is null then length(gold) else dist end)::bigint as adjusted_edits,
            coalesce(count(*) filter (t is not null and dist = 0) / nullif(count(*) filter (t is not null), 0), 0) as exact_rate, coalesce(sum(dist) filter (t is not null) / nullif(sum(length(gold)) filter (t is not null), 0), 0) as cer,
            sum(case when t is null then length(gold) else dist end) / sum(length(gold)) as adjusted_cer
            from (select '{D.PADDLE}' as engine, p_text as t, p_dist as dist, gold from units union all select '{D.MANGA}', m_text, m_dist, gold from units) group by engine""",
        "ocr_denominators": f"""with {D.REGIONS_SQL} select count(*) as regions, count(*) filter (detection_status = 'detected') as detected, count(*) filter (detection_status <> 'detected') as missed,
            count(*) filter (detection_status = 'detected' and ocr_eligibility = 'eligible') as eligible, count(*) filter (detection_status = 'detected' and ocr_eligibility <> 'eligible') as excluded_detected, count(*) filter (ocr_eligibility <> 'eligible') as excluded, count(distinct page_id) as pages from bench""",
        "ocr_pair_agreement": f"""{both}, count(*) filter (p_text = m_text) as raw, count(*) filter (p_norm = m_norm) as normalized, count(*) filter (p_norm = m_norm and p_text <> m_text) as normalization_only,
            count(*) filter (p_norm = m_norm and p_dist = 0) as gold_exact, count(*) filter (p_norm = m_norm and p_dist <> 0) as joint_wrong, count(*) filter (p_text is not null and m_text is not null and p_dist = 0 and m_dist <> 0) as left_only,
            count(*) filter (p_text is not null and m_text is not null and m_dist = 0 and p_dist <> 0) as right_only, count(*) filter (p_text is not null and m_text is not null and m_dist <> 0 and p_dist <> 0) as neither from units""",
        "ocr_contract_violations": f"""with {D.REGIONS_SQL} select r as rule, region_id as key from (select region_id, unnest(list_filter([
            case when ocr_eligibility = 'eligible' and detection_status <> 'detected' then 'eligible-not-detected' end, case when ocr_eligibility = 'eligible' and expected_ocr is null then 'eligible-without-gold' end,
            case when ocr_eligibility = 'excluded' and exclusion_reason is null then 'excluded-without-reason' end, case when ocr_eligibility = 'excluded' and expected_ocr is not null then 'excluded-with-gold' end,
            case when detection_status = 'missed' and len(candidates) > 0 then 'missed-with-candidates' end, case when category is null then 'category-missing' end,
            case when len(candidates) <> len(list_distinct(list_transform(candidates, lambda c: c.engine))) then 'engine-twice' end], lambda x: x is not null)) as r from bench)""",
        "ocr_population_check": f"""with {D.REGIONS_SQL}, {D.OBSERVATIONS_SQL} select 'missing-right' as rule, region_id as key from bench where region_id not in (select observation_id from obs)
            union all select 'missing-left', observation_id from obs where observation_id not in (select region_id from bench)""",
        "ocr_join_conflicts": f"""with {D.REGIONS_SQL}, {D.OBSERVATIONS_SQL} select * from (select region_id, array_to_string(list_filter([case when b.page_id is distinct from o.page_id then 'page' end, case when b.category is distinct from o.category then 'category' end,
            case when (b.detection_status = 'detected') is distinct from o.detected then 'detected' end], lambda x: x is not null), ',') as conflict from bench b join obs o on o.observation_id = b.region_id) where conflict <> ''""",
        "overlay_patch_join": f"""with {D.REGIONS_SQL}, firsts as (select * from (select *, row_number() over (partition by region_id order by received_at, row_id) as k from ocr_benchmark_regions where region_id is not null) where k = 1)
            select f.region_id, coalesce(b.category, f.category) as category, coalesce(b.expected_ocr, f.expected_ocr) as expected_ocr from firsts f left join bench b using (region_id)""",
        "overlay_unknown_ids": f"with {D.REGIONS_SQL} select distinct region_id from translation_candidates where region_id is not null and region_id not in (select region_id from bench)",
        "runtime_policy_strict": runtime("qa-blocked"),
        "runtime_policy_low_manual": runtime("paddle"),
        "arbitration_lopo_model": f"{_MODEL} select * from models",
        "arbitration_predictions": f"{_PRED} select policy, region_id, engine, reason, distance::int as distance, gold_chars::int as gold_chars from pred",
        "arbitration_reason_histogram": f"{_PRED} select policy, reason, count(*) as regions from pred group by policy, reason",
        "arbitration_metrics": f"{_PRED} select policy, {_METRIC} from pred group by policy",
        "arbitration_strata": f"{_PRED} select policy, category as stratum, {_METRIC}, 'category' as field from pred group by policy, category union all by name select policy, bubble as stratum, {_METRIC}, 'bubble' as field from pred group by policy, bubble",
        "arbitration_bootstrap_ci": f"""{_PRED}, numbers as (select page_id, row_number() over (order by page_id) - 1 as number from (select distinct page_id from pred)),
            totals as (select policy, number, count(*) as regions, count(*) filter (distance = 0) as exact, sum(gold_chars) as gold, sum(distance) as edits from pred join numbers using (page_id) group by policy, number),
            size as (select count(*) as p from numbers), drawn as (select (k // p) as replicate, floor({mulberry_sql(str(SEED), 'k')} * p)::bigint as number from size, range((select {REPLICATES} * p from size)) r(k)),
            counted as (select replicate, number, count(*) as times from drawn group by all),
            reps as (select policy, replicate, sum(times * regions)::double as regions, sum(times * exact)::double as exact, sum(times * gold)::double as gold, sum(times * edits)::double as edits from counted join totals using (number) group by policy, replicate),
            deltas as (select a.policy, b.policy as baseline, a.exact / a.regions - b.exact / b.regions as ed, a.edits / a.gold - b.edits / b.gold as cd from reps a join reps b using (replicate) where b.policy in ('always-paddle', 'always-manga'))
            select policy, baseline, quantile_disc(ed, 0.025000000000000022) as exact_low, quantile_disc(ed, 0.975) as exact_high, quantile_disc(cd, 0.025000000000000022) as cer_low, quantile_disc(cd, 0.975) as cer_high from deltas group by policy, baseline""",
        "bootstrap_random_column": f"select k, ({mulberry_sql(str(SEED), 'k')} * 4294967296)::bigint as draw from range(20000) r(k)",
        "arbitration_qa_residual_counts": f"""{_BASE} select e.engine, r.reason, count(*) filter (case r.reason when 'candidate-missing' then t is null when 'replacement-character' then coalesce(contains(t, chr(65533)), false) when 'empty-text' then coalesce(n = '', false)
            when 'forbidden-control' then coalesce(regexp_matches(t, '[\\x{{0000}}-\\x{{0008}}\\x{{000B}}\\x{{000C}}\\x{{000E}}-\\x{{001F}}\\x{{007F}}-\\x{{009F}}]'), false) else coalesce(regexp_matches(t, '[\\x{{061C}}\\x{{200E}}\\x{{200F}}\\x{{202A}}-\\x{{202E}}\\x{{2066}}-\\x{{2069}}]'), false) end) as n
            from (select 'paddle' as engine, p_text as t, p_norm as n from units union all select 'manga', m_text, m_norm from units) e, (values ('candidate-missing'), ('replacement-character'), ('forbidden-control'), ('bidi-control'), ('empty-text')) r(reason) group by all""",
        "arbitration_script_loss": f"""{_BASE}, s as (select p_norm as p, m_norm as m from units where p_norm is not null and m_norm is not null) select name as script,
            count(*) filter (not regexp_matches(p, re) and regexp_matches(m, re)) as paddle_missing, count(*) filter (regexp_matches(p, re) and not regexp_matches(m, re)) as manga_missing
            from (select * from (values ('han', '\\p{{Han}}'), ('hiragana', '\\p{{Hiragana}}'), ('katakana', '\\p{{Katakana}}'), ('latin', '\\p{{Latin}}'), ('number', '\\p{{N}}')) v(name, re)) join s on true group by name""",
        "ocr_candidate_confidence": """select engine, status, count(*) as rows, count(confidence) as with_confidence, round(avg(confidence), 9) as mean_confidence, count(*) filter (selected) as selected, count(distinct region_id) as regions
            from (select candidate_row, any_value(engine) as engine, any_value(status) as status, any_value(confidence) as confidence, any_value(selected) as selected, any_value(region_id) as region_id from ocr_candidates group by candidate_row) group by engine, status""",
        "region_score_summary": """select ocr_policy, category, count(*) as scores, sum(edits)::bigint as edits, sum(gold_chars)::bigint as gold_chars, count(*) filter (cer <= 0.03) as within_3_percent, max(cer) as max_cer, quantile_disc(cer, 0.9) as p90_cer
            from (select distinct on (score_id) * from region_scores where cer is not null and not isnan(cer) and not isinf(cer) and cer >= 0) group by ocr_policy, category""",
    }
