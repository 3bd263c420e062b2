"""Queries over candidate translations and results, rasters and event logs, with their SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgauge.functions import text as X
from leafgauge.functions.rng import mulberry_sql
from leafgauge.operators import candidates, raster, runlog, translation
from leafgauge.plans import domain as D
from leafgauge.session import cut, table

SEED = 20260815
REPLICATES = 5000
CANDIDATES = ("cand-01", "cand-02", "cand-03")
PHASES = ["view", "click", "signup", "purchase", "error"]


def _results(spark: SparkSession, d: str) -> DataFrame:
    """Candidate results without repeated deliveries, pages in official spelling."""
    return table(spark, d, "candidate_regions").dropDuplicates(["candidate_row"]).withColumn("page_id", D.page_key(F.col("page_id")))


def _outputs(spark: SparkSession, d: str) -> DataFrame:
    r = _results(spark, d).where("region_id is not null and detected")
    one = r.groupBy("candidate_id", "region_id").agg(F.min_by(F.struct("ocr_text", "translation", "semantic_usable", "terms_correct", "layout_ok"), "candidate_row").alias("o"))
    return one.select(F.col("candidate_id").alias("candidate"), "region_id", F.col("o.ocr_text").alias("source_text"), F.col("o.translation").alias("translated_text"), "o.semantic_usable", "o.terms_correct", "o.layout_ok")


def _gold(spark: SparkSession, d: str) -> DataFrame:
    return D.golden(spark, d).select("region_id", F.col("page_id"), F.col("expected_ocr").alias("gold"), F.col("expected_ocr").isNotNull().alias("eligible"), F.col("expected_translation").alias("reference"))


def translation_attribution(spark: SparkSession, d: str) -> DataFrame:
    return translation.attribution(_gold(spark, d).select("region_id", "gold", "eligible"), _outputs(spark, d).select("candidate", "region_id", "source_text"))


def translation_review_rates(spark: SparkSession, d: str) -> DataFrame:
    return translation.review_rates(_outputs(spark, d), ["semantic_usable", "terms_correct", "layout_ok"], "candidate")


def translation_structural_flags(spark: SparkSession, d: str) -> DataFrame:
    """Counts of structural codes per model over answers with a valid source, deliveries counted once."""
    t = table(spark, d, "translation_candidates").select("candidate_row", "region_id", "model", "text").dropDuplicates(["candidate_row"]).where("text is not null")
    s = D.regions(spark, d).select("region_id", F.coalesce("source_text", F.lit("")).alias("region_source"))
    flags = t.join(s, "region_id").select("model", F.explode(translation.structural_flags(F.col("text"), F.col("region_source"))).alias("code"))
    return flags.groupBy("model", "code").agg(F.count("*").alias("answers"))


def translation_challenge_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Per candidate over analysable outputs: format, structure and closeness to the reference."""
    o = _outputs(spark, d).where("translated_text is not null").join(_gold(spark, d).where("eligible"), "region_id")
    o = o.where(translation.input_agreement(F.coalesce("source_text", F.lit("")), F.col("gold")) != "different")
    o = o.withColumn("flags", translation.structural_flags(F.col("translated_text"), F.coalesce("source_text", F.lit("")))).withColumn("t", X.normalized(F.col("translated_text"))).withColumn("r", X.normalized(F.coalesce("reference", F.lit(""))))
    return o.groupBy("candidate").agg(
        F.count("*").alias("analyzable"), F.count_if(translation.format_valid(F.col("flags"))).alias("format_valid"), F.count_if(F.size("flags") == 0).alias("structural_pass"),
        F.count_if(F.col("t") == F.col("r")).alias("reference_exact"), F.sum(F.levenshtein("t", "r")).alias("edits"), F.sum(F.length("r")).alias("reference_chars"),
    )


def _pool(spark: SparkSession, d: str) -> DataFrame:
    r = D.benchmark_regions(spark, d).where("ocr_eligibility = 'eligible' and expected_ocr is not null")
    return r.select("region_id", "page_id", F.coalesce("category", F.lit("none")).alias("category"), X.length_stratum(X.normalized(F.col("expected_ocr"))).alias("length_stratum"))


def challenge_stratified_topk(spark: SparkSession, d: str) -> DataFrame:
    return translation.stratified_top(_pool(spark, d), 2, str(SEED), "hard")


def challenge_selection(spark: SparkSession, d: str) -> DataFrame:
    pool = cut(_pool(spark, d))
    return translation.fill_balanced(pool, translation.stratified_top(pool, 1, str(SEED), "hard"), 40, str(SEED), "hard")


def paired_bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    o = _outputs(spark, d).join(_gold(spark, d).select("region_id", D.page_key(F.col("page_id")).alias("page_id")), "region_id")
    long = cut(o.select("candidate", F.lit("semantic-usable").alias("metric"), "region_id", "page_id", F.col("semantic_usable").cast("int").alias("value")))
    # The candidates that compete are few; each pair of them is a comparison of its own.
    ids = sorted(r.candidate for r in long.select("candidate").distinct().collect())
    parts = [translation.paired_bootstrap(long, a, b, "semantic-usable", REPLICATES, SEED) for i, a in enumerate(ids) for b in ids[i + 1 :]]
    return reduce(DataFrame.unionByName, parts) if parts else translation.paired_bootstrap(long, "", "", "semantic-usable", REPLICATES, SEED)


def candidate_iou_match(spark: SparkSession, d: str) -> DataFrame:
    g = D.golden(spark, d).withColumn("page_id", D.page_key(F.col("page_id")))
    return candidates.best_overlap(g, _results(spark, d))


def candidate_scores(spark: SparkSession, d: str) -> DataFrame:
    g = cut(D.golden(spark, d).withColumn("page_id", D.page_key(F.col("page_id"))))
    c = cut(_results(spark, d))
    return candidates.scores(g, c, cut(candidates.greedy_matches(g, c)))


def candidate_acceptance(spark: SparkSession, d: str) -> DataFrame:
    """What a release would accept of each candidate, measure by measure."""
    return candidates.acceptance(candidate_scores(spark, d))


def candidate_winner(spark: SparkSession, d: str) -> DataFrame:
    """The candidate that passes the hard gate with the greatest score."""
    return candidates.winner(candidate_scores(spark, d))


def translation_route_mix(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "translation_candidates").dropDuplicates(["candidate_row"])
    return t.groupBy("model", "route", "selection_reason").agg(F.count("*").alias("answers"), F.count_if("selected").alias("selected"), F.count_if(F.trim("text") == "").alias("blank"), F.count("confidence").alias("with_confidence"))


def rendered_page_fallback(spark: SparkSession, d: str) -> DataFrame:
    """Every page of a chapter with its own scan, or that of the page it was reissued from where its own is unknown."""
    f = table(spark, d, "chapter_manifests").select("chapter_id", F.posexplode("source_files").alias("position", "f")).select("chapter_id", "position", "f.*")
    other = f.select(F.col("page_id").alias("o_page"), F.col("sha256").alias("o_sha"))
    joined = f.join(other, D.page_key(F.col("reissue_of")) == F.col("o_page"), "left")
    return joined.select("chapter_id", "position", "page_id", F.lower(F.coalesce("sha256", "o_sha")).alias("sha256"))


def provenance_carry(spark: SparkSession, d: str) -> DataFrame:
    """Regions whose outdated and valid versions differ in text or box: provenance can't be carried over."""
    p = table(spark, d, "partial_regions")
    old = p.groupBy("region_id").agg(F.min_by(F.struct("source_text", "bbox"), F.struct("updated_at", "row_id")).alias("o"))
    new = D.regions(spark, d).select("region_id", "source_text", "bbox")
    j = old.join(new, "region_id")
    return j.select("region_id", F.concat_ws(",", F.when(~F.col("o.source_text").eqNullSafe(F.col("source_text")), "text"), F.when(~F.col("o.bbox").eqNullSafe(F.col("bbox")), "bbox")).alias("drift")).where("drift <> ''")


def text_patch_plan(spark: SparkSession, d: str) -> DataFrame:
    """Regions whose text a selected reading of the trusted engine would change."""
    sel = table(spark, d, "ocr_candidates").where("selected and text is not null").groupBy("region_id").agg(F.min_by("text", "candidate_row").alias("new_text"))
    return D.regions(spark, d).select("region_id", "source_text").join(sel, "region_id").where("source_text <> new_text").select("region_id", F.sha2("source_text", 256).alias("before"), F.sha2("new_text", 256).alias("after"))


def _grids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select("vec_id", "embedding")


def mask_overlap(spark: SparkSession, d: str) -> DataFrame:
    """Overlap of four boxes with the label mask of each grid (label by sign and size of the value)."""
    px = raster.pixels(_grids(spark, d), "embedding", 8, "vec_id").withColumn("v", F.when(F.col("v") > 0.1, 2).when(F.col("v") > 0, 1).otherwise(0))
    boxes = F.array(*[F.struct(F.lit(n).alias("region_id"), *[F.lit(v).alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), b)]) for n, b in (("a", (0, 0, 4, 4)), ("b", (4, 0, 8, 4)), ("c", (2, 2, 6, 6)), ("d", (0, 0, 8, 8)))])
    return raster.mask_overlap(px, _grids(spark, d).select("vec_id", F.inline(boxes)), "vec_id")


def polygon_containment(spark: SparkSession, d: str) -> DataFrame:
    """Pixels of each grid inside a fixed quadrilateral, and its area."""
    from leafgauge.functions.geometry import point_in_polygon, polygon_area

    poly = F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ((0, 0), (6, 1), (7, 7), (1, 6))])
    px = raster.pixels(_grids(spark, d), "embedding", 8, "vec_id").where(point_in_polygon(F.col("x") + 0.5, F.col("y") + 0.5, poly))
    return px.groupBy("vec_id").agg(F.count("*").alias("pixels"), F.round(F.sum("v"), 6).alias("total"), F.max(polygon_area(poly)).alias("area"))


def raster_outside_mask(spark: SparkSession, d: str) -> DataFrame:
    """Each grid against its negative, outside the mask of its large values."""
    px = raster.pixels(_grids(spark, d), "embedding", 8, "vec_id").withColumn("v", F.col("v").cast("double") * 255)
    after = px.withColumn("v", F.when(F.col("x") < 4, F.col("v")).otherwise(-F.col("v")))
    out = raster.outside_changes(px, after, px.withColumn("v", F.when(F.col("v") > 25, 1).otherwise(0)), "vec_id", 8, 8)
    return out.select("vec_id", "changed", F.round("max_delta", 6).alias("max_delta"), "outside", "inside", F.round("inside_edges", 6).alias("inside_edges"), F.round("around_edges", 6).alias("around_edges"), "risk")


def journal_sequence_check(spark: SparkSession, d: str) -> DataFrame:
    return runlog.sequence_breaks(table(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type", PHASES)


def stable_read(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("idle", F.col("event_type") != "error")
    return runlog.stable_reads(e, "user_id", ["ts", "event_id"], "event_type", "idle")


def operation_terminal_state(spark: SparkSession, d: str) -> DataFrame:
    return runlog.final_states(table(spark, d, "events"), "user_id", "ts", "event_type", "error", "purchase", "view")


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    """Counts and sums of events per hour and type."""
    e = table(spark, d, "events")
    return e.groupBy(F.date_trunc("hour", "ts").alias("hour"), "event_type").agg(F.count("*").alias("events"), F.round(F.sum("value"), 6).alias("total"), F.sum(F.get_json_object("props", "$.k").cast("bigint")).alias("k"))


def queries() -> dict:
    found = [
        translation_attribution, translation_review_rates, translation_structural_flags, translation_challenge_metrics, challenge_stratified_topk, challenge_selection, paired_bootstrap_ci, candidate_iou_match, candidate_scores, candidate_acceptance, candidate_winner, translation_route_mix,
        rendered_page_fallback, provenance_carry, text_patch_plan, mask_overlap, polygon_containment, raster_outside_mask, journal_sequence_check, stable_read, operation_terminal_state, event_windows,
    ]
    return {f.__name__: f for f in found}


_RESULTS = f"results as (select * exclude (page_id, k), {D.page_key_sql('page_id')} as page_id from (select *, row_number() over (partition by candidate_row) as k from candidate_regions) where k = 1)"
_OUTPUTS = f"""{_RESULTS}, outputs as (select * from (select *, row_number() over (partition by candidate_id, region_id order by candidate_row) as k from results where region_id is not null and detected) where k = 1),
    gold as (select distinct on (region_id) * exclude (page_id), {D.page_key_sql('page_id')} as page_id from golden_regions where region_id is not null)"""
_GRID = "px as (select vec_id, ((i - 1) % 8)::int as x, ((i - 1) // 8)::int as y, embedding[i] as v from embeddings, range(1, 65) t(i))"


def _pair_sql(a: str, b: str) -> str:
    import hashlib

    word = int(hashlib.sha256(f"{a}|{b}|semantic-usable".encode()).hexdigest()[:8], 16)
    seed = (SEED ^ word) & 0xFFFFFFFF
    return f"""select * from (with p as (select g.page_id, sum(x.semantic_usable::int) as a, sum(y.semantic_usable::int) as b, count(*) as n from outputs x join outputs y using (region_id) join gold g using (region_id)
            where x.candidate_id = '{a}' and y.candidate_id = '{b}' and x.semantic_usable is not null and y.semantic_usable is not null group by g.page_id),
        num as (select *, row_number() over (order by page_id) - 1 as number, count(*) over () as pages from p), size as (select count(*) as c from p),
        drawn as (select k // c as replicate, floor({mulberry_sql(str(seed), 'k')} * c)::bigint as number from size, range((select {REPLICATES} * c from size)) r(k)),
        reps as (select replicate, sum(a)::double as a, sum(b)::double as b, sum(n)::double as n from drawn join num using (number) group by replicate)
        select '{a}' as candidate_a, '{b}' as candidate_b, 'semantic-usable' as metric, (select sum(n)::bigint from p) as pairs, (select count(*) from p) as pages, (select sum(b) / sum(n) - sum(a) / sum(n) from p) as difference,
            quantile_cont(b / n - a / n, 0.025) as low, quantile_cont(b / n - a / n, 0.975) as high from reps)"""


def oracle_sql() -> dict[str, str]:
    iou_w = "greatest(0, least(g.bbox.x + g.bbox.width, c.bbox.x + c.bbox.width) - greatest(g.bbox.x, c.bbox.x))"
    iou_h = "greatest(0, least(g.bbox.y + g.bbox.height, c.bbox.y + c.bbox.height) - greatest(g.bbox.y, c.bbox.y))"
    pairs = [(a, b) for i, a in enumerate(CANDIDATES) for b in CANDIDATES[i + 1 :]]
    grey = "(select v from g g2 where g2.vec_id = g.vec_id and g2.x = greatest(0, least(7, g.x + {0})) and g2.y = greatest(0, least(7, g.y + {1})))"
    return {
        "translation_review_rates": f"""with {_OUTPUTS}, long as (select candidate_id as candidate, f.field, f.v from outputs, lateral (select unnest([{{'field': 'semantic_usable', 'v': semantic_usable}}, {{'field': 'terms_correct', 'v': terms_correct}}, {{'field': 'layout_ok', 'v': layout_ok}}]) as f))
            select candidate, field, count(v) as reviewed, count(*) filter (v) as passed, count(*) filter (not v) as failed, coalesce(count(*) filter (v) / nullif(count(v), 0), 0) as pass_rate from long group by all""",
        "challenge_stratified_topk": f"""with {D.REGIONS_SQL}, n as (select region_id, page_id, coalesce(category, 'none') as category, length({D.norm_sql('expected_ocr')}) as n from bench where ocr_eligibility = 'eligible' and expected_ocr is not null),
            s as (select *, category || '|' || case when n <= 8 then 'short' when n <= 20 then 'medium' else 'long' end as stratum from n),
            k as (select stratum, region_id, page_id, (row_number() over (partition by stratum order by sha256('{SEED}' || chr(0) || 'hard|' || stratum || chr(0) || page_id || chr(0) || region_id)))::int as k from s) select * from k where k <= 2""",
        "paired_bootstrap_ci": f"with {_OUTPUTS} " + " union all ".join(_pair_sql(a, b) for a, b in pairs),
        "candidate_iou_match": f"""with {_OUTPUTS}, m as (select c.candidate_id, g.region_id, c.candidate_row, case when g.bbox.width * g.bbox.height + c.bbox.width * c.bbox.height - {iou_w} * {iou_h} > 0 then {iou_w} * {iou_h} / (g.bbox.width * g.bbox.height + c.bbox.width * c.bbox.height - {iou_w} * {iou_h}) else 0 end as score
            from gold g join results c using (page_id) where g.bbox is not null and c.bbox is not null)
            select candidate_id, region_id, candidate_row, score from (select *, row_number() over (partition by candidate_id, region_id order by score desc, candidate_row) as k from m where score >= 0.5) where k = 1""",
        "translation_route_mix": """select model, route, selection_reason, count(*) as answers, count(*) filter (selected) as selected, count(*) filter (trim(text, ' ') = '') as blank, count(confidence) as with_confidence
            from (select distinct on (candidate_row) * from translation_candidates) group by all""",
        "rendered_page_fallback": f"""with f as (select chapter_id, (i - 1)::int as position, source_files[i] as s from chapter_manifests, range(1, len(source_files) + 1) t(i))
            select f.chapter_id, f.position, f.s.page_id as page_id, lower(coalesce(f.s.sha256, o.s.sha256)) as sha256 from f left join f o on o.s.page_id = {D.page_key_sql('f.s.reissue_of')}""",
        "provenance_carry": f"""with {D.READ_SQL}, old as (select * from (select *, row_number() over (partition by region_id order by updated_at, row_id) as k from partial_regions where region_id is not null) where k = 1)
            select * from (select region_id, array_to_string(list_filter([case when o.source_text is distinct from r.source_text then 'text' end, case when o.bbox is distinct from r.bbox then 'bbox' end], lambda x: x is not null), ',') as drift from old o join read r using (region_id)) where drift <> ''""",
        "text_patch_plan": f"""with {D.READ_SQL}, sel as (select region_id, arg_min(text, candidate_row) as new_text from ocr_candidates where selected and text is not null and region_id is not null group by region_id)
            select region_id, sha256(source_text) as before, sha256(new_text) as after from read join sel using (region_id) where source_text <> new_text""",
        "mask_overlap": f"""with {_GRID}, m as (select vec_id, x, y, case when v > 0.1::float then 2 when v > 0 then 1 else 0 end as v from px), b(region_id, x0, y0, x1, y1) as (values ('a', 0, 0, 4, 4), ('b', 4, 0, 8, 4), ('c', 2, 2, 6, 6), ('d', 0, 0, 8, 8)),
            c as (select vec_id, region_id, v, count(*) as n from m join b on x >= x0 and x < x1 and y >= y0 and y < y1 group by all),
            a as (select vec_id, region_id, sum(n)::bigint as geometry_pixels, coalesce(sum(n) filter (v <> 0), 0)::bigint as nonzero, arg_min(v, -n * 10 + v) filter (v <> 0) as dominant, max(n) filter (v <> 0) as top from c group by all),
            r as (select *, nonzero / geometry_pixels as overlap_rate, coalesce(top / nullif(nonzero, 0), 0) as dominant_share from a)
            select vec_id, region_id, geometry_pixels, nonzero, dominant, overlap_rate, dominant_share, case when overlap_rate >= 0.8 and dominant_share >= 0.8 then true when overlap_rate <= 0.05 then false end as inside,
            case when overlap_rate >= 0.8 and dominant_share >= 0.8 then least(overlap_rate, dominant_share) when overlap_rate <= 0.05 then 1 - overlap_rate else greatest(overlap_rate, 1 - overlap_rate) end as confidence from r""",
        "polygon_containment": f"""with {_GRID}, e(ax, ay, bx, by_) as (values (0.0, 0.0, 6.0, 1.0), (6.0, 1.0, 7.0, 7.0), (7.0, 7.0, 1.0, 6.0), (1.0, 6.0, 0.0, 0.0)),
            h as (select vec_id, x, y, any_value(v) as v, count(*) filter ((ay > y + 0.5) <> (by_ > y + 0.5) and x + 0.5 < (bx - ax) * (y + 0.5 - ay) / nullif(by_ - ay, 0) + ax) as crossed from px, e group by vec_id, x, y)
            select vec_id, count(*) as pixels, round(sum(v::double), 6) as total, (select abs(sum(ax * by_ - bx * ay)) / 2 from e)::double as area from h where crossed % 2 = 1 group by vec_id""",
        "journal_sequence_check": f"""select user_id, position, found, expected from (select user_id, event_type as found, (row_number() over (partition by user_id order by ts, event_id) - 1)::int as position,
            ({PHASES})[((row_number() over (partition by user_id order by ts, event_id) - 1) % 5 + 1)::int] as expected from events) where found is distinct from expected""",
        "stable_read": """select user_id, min(k)::int as "at" from (select user_id, row_number() over w as k, event_type = lag(event_type) over w and event_type <> 'error' and lag(event_type) over w <> 'error' as same from events window w as (partition by user_id order by ts, event_id)) where same group by user_id""",
        "operation_terminal_state": """with ends as (select user_id, min(ts) filter (event_type in ('error', 'purchase')) as first_end, max(ts) as last_seen from events group by user_id)
            select e.user_id, case when first_end is null then 'running' when bool_or(event_type = 'error' and ts = first_end) then 'failed' else 'finished' end as state,
                count(*) filter (event_type = 'view' and (first_end is null or ts < first_end)) as warnings, last_seen from events e join ends n on e.user_id is not distinct from n.user_id group by e.user_id, first_end, last_seen""",
        "event_windows": "select date_trunc('hour', ts) as hour, event_type, count(*) as events, round(sum(value), 6) as total, sum((props::json ->> '$.k')::bigint)::bigint as k from events group by all",
        "raster_outside_mask": f"""with {_GRID}, b as (select vec_id, x, y, v::double * 255 as b from px), g as (select vec_id, x, y, b, case when x < 4 then b else -b end as v, b > 25 as m from b),
            e as (select g.*, sqrt(pow(-{grey.format(-1, -1)} + {grey.format(1, -1)} - 2 * {grey.format(-1, 0)} + 2 * {grey.format(1, 0)} - {grey.format(-1, 1)} + {grey.format(1, 1)}, 2)
                + pow(-{grey.format(-1, -1)} - 2 * {grey.format(0, -1)} - {grey.format(1, -1)} + {grey.format(-1, 1)} + 2 * {grey.format(0, 1)} + {grey.format(1, 1)}, 2)) as edge,
                exists (select 1 from g g3 where g3.vec_id = g.vec_id and g3.m and abs(g3.x - g.x) <= 2 and abs(g3.y - g.y) <= 2) as near from g)
            select vec_id, count(*) filter (not m and v <> b) as changed, round(coalesce(max(abs(v - b)) filter (not m), 0), 6) as max_delta, count(*) filter (not m) as outside, count(*) filter (m) as inside,
            round(coalesce(avg(edge) filter (m), 0), 6) as inside_edges, round(coalesce(avg(edge) filter (not m and near), 0), 6) as around_edges, count(*) filter (m) > 0 and coalesce(avg(edge) filter (m), 0) > greatest(80, 2.5 * coalesce(avg(edge) filter (not m and near), 0)) as risk from e group by vec_id""",
    }
