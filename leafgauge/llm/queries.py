"""The queries of the problems in this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafgauge.llm import canonical, chunking, groupsplit, leakage, moderation, packing, pairs, percentiles
from leafgauge.session import cut, table

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
PROBS = [0.5, 0.9, 0.95]


def _fragments(spark: SparkSession, d: str) -> DataFrame:
    return chunking.split_oversized(table(spark, d, "partial_regions"), table(spark, d, "chapter_manifests"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Chapters, pages and regions over their chapter's limit, from the pieces they were cut into."""
    return chunking.items_over_limit(cut(_fragments(spark, d).drop("fragment_text")))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    """All pieces of all chapters in order, with what they repeat."""
    return chunking.numbered_pieces(cut(_fragments(spark, d).drop("fragment_text")))


def p1_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Per chapter what its pieces hold anew, letters and regions, each once, and whether all pieces keep the limit."""
    f = cut(_fragments(spark, d).drop("fragment_text"))
    size = F.col("end_char") - F.col("start_char")
    piece = f.groupBy("chapter_id", "seg", "block", "local_piece").agg(F.sum(size).alias("size"), F.max("max_chars").alias("max_chars"))
    kept = piece.groupBy("chapter_id").agg(F.min(F.col("size") <= F.col("max_chars")).alias("within_limit"))
    new = f.where("not repeated").groupBy("chapter_id").agg(F.sum(size).cast("long").alias("chars"), F.count_distinct("region_id").alias("regions"))
    return new.join(kept, "chapter_id")


def _pages(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chapter_manifests").select(F.inline("source_files"))


def _page_rows(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "ocr_benchmark_regions").select(F.lit("ocr_benchmark_regions").alias("row_table"), "row_id", "region_id", "page_id")
    b = table(spark, d, "routing_observations").select(F.lit("routing_observations").alias("row_table"), "row_id", F.col("observation_id").alias("region_id"), "page_id")
    return a.unionByName(b)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Pages of works of two or more pages."""
    return groupsplit.works_of_pages(_pages(spark, d), _page_rows(spark, d))


def p2_splits(spark: SparkSession, d: str) -> DataFrame:
    """Every row of both tables with its split."""
    return groupsplit.assign_splits(_page_rows(spark, d), _pages(spark, d), SHARES)


def p2_kept(spark: SparkSession, d: str) -> DataFrame:
    """Rows with a split per table, and how many works and pages lie in more than one split."""
    splits = cut(groupsplit.assign_splits(_page_rows(spark, d), _pages(spark, d), SHARES))
    torn = lambda key: splits.where(F.col(key).isNotNull()).groupBy(key).agg((F.min("split") != F.max("split")).alias("t")).agg(F.lit(f"torn {key}").alias("measure"), F.count_if("t").alias("n"))
    rows = splits.groupBy(F.col("row_table").alias("measure")).agg(F.count("split").alias("n"))
    return rows.unionByName(torn("group_page_id")).unionByName(torn("page_id"))


def _scores(spark: SparkSession, d: str) -> DataFrame:
    scores = table(spark, d, "region_scores").select("score_id", "evaluation_id", "category", "ocr_policy", "page_id", "cer")
    return percentiles.measurements(scores, "cer", "score_id")


def p3_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Exact p50, p90 and p95 of cer for each category and policy, of each day and of all days, and for each page and policy."""
    groups = ["scope", "category", "ocr_policy"]
    each = F.inline(F.array(
        F.struct(F.col("evaluation_id").alias("scope"), "category", F.lit(False).alias("page"), "ocr_policy", "cer"),
        F.struct(F.col("page_id").alias("scope"), F.lit(None).cast("string").alias("category"), F.lit(True).alias("page"), "ocr_policy", "cer"),
    ))
    counted = cut(percentiles.counted_values(_scores(spark, d).select(each), [*groups, "page"], "cer"))
    whole = counted.where("not page").groupBy("category", "ocr_policy", "v").agg(F.sum("n").alias("n")).withColumn("scope", F.lit("all"))
    return percentiles.exact_percentiles(counted.drop("page").unionByName(cut(whole)), groups, PROBS)


def p3_merged(spark: SparkSession, d: str) -> DataFrame:
    """Percentiles of all days from the merged ledgers of single days, with their error bound."""
    days = percentiles.ledger(_scores(spark, d), ["evaluation_id", "category", "ocr_policy"], "cer")
    merged = percentiles.merge_ledgers(days, ["category", "ocr_policy"])
    return percentiles.ledger_percentiles(merged, ["category", "ocr_policy"], PROBS)


def _judged(spark: SparkSession, d: str) -> DataFrame:
    regions = table(spark, d, "partial_regions")
    valid = cut(pairs.valid_sources(regions))
    t = table(spark, d, "translation_candidates").select(F.lit("translation_candidates").alias("pair_table"), "candidate_row", "region_id", F.col("text").alias("answer"))
    c = table(spark, d, "candidate_regions").where("detected").select(F.lit("candidate_regions").alias("pair_table"), "candidate_row", "region_id", F.col("translation").alias("answer"))
    model = pairs.train_pairs(valid, table(spark, d, "documents"))
    return pairs.judged_pairs(t.unionByName(c), valid, model)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Defective answers with their defect."""
    return _judged(spark, d).where("defect is not null")


def p4_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Every pair with its defect, null for a sound one."""
    return _judged(spark, d)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Readings that look like the expected text but are another string."""
    o = table(spark, d, "ocr_candidates").select(F.lit("ocr_candidates").alias("text_table"), "candidate_row", "region_id", "text")
    c = table(spark, d, "candidate_regions").select(F.lit("candidate_regions").alias("text_table"), "candidate_row", "region_id", F.col("ocr_text").alias("text"))
    g = table(spark, d, "golden_regions").select("region_id", F.col("expected_ocr").alias("expected"))
    return canonical.same_reading(o.unionByName(c), g)


def p6_canonical(spark: SparkSession, d: str) -> DataFrame:
    """All three text columns in canonical form."""
    o = table(spark, d, "ocr_candidates").select(F.lit("ocr_candidates").alias("text_table"), F.col("candidate_row").cast("string").alias("row_key"), "text")
    c = table(spark, d, "candidate_regions").select(F.lit("candidate_regions").alias("text_table"), F.col("candidate_row").cast("string").alias("row_key"), F.col("ocr_text").alias("text"))
    g = table(spark, d, "golden_regions").select(F.lit("golden_regions").alias("text_table"), F.col("region_id").alias("row_key"), F.col("expected_ocr").alias("text"))
    return canonical.canonical_texts(o.unionByName(c).unionByName(g), "text")


def _packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.items_of(cut(packing.token_sizes(table(spark, d, "documents")))))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents larger than one container, which the packing had to cut."""
    return packing.over_capacity(_packed(spark, d))


def p7_containers(spark: SparkSession, d: str) -> DataFrame:
    """The container of every item."""
    return _packed(spark, d)


def p7_loads(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers: their number, documents whose pieces don't add up to a whole, and containers that hold too much."""
    packed = cut(_packed(spark, d))
    bins = packed.groupBy("container_id").agg(F.sum("size").alias("load"), F.max("container_load").alias("told"))
    docs = packed.groupBy("doc_id").agg(((F.count_distinct("piece") == F.max("piece") + 1) & (F.count("*") == F.count_distinct("piece"))).alias("whole"))
    n = lambda df, name, c: df.agg(F.lit(name).alias("measure"), F.count_if(c).alias("n"))
    parts = [n(docs, "documents", F.lit(True)), n(docs, "broken", ~F.col("whole")), n(bins, "overfull", F.col("load") > packing.CAPACITY), n(bins, "mistold", F.col("load") != F.col("told"))]
    return reduce(DataFrame.unionByName, parts)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Items and the documents that hold a passage of them."""
    return p8_leaks(spark, d).select("item_id", "doc_id")


def p8_leaks(spark: SparkSession, d: str) -> DataFrame:
    """Leaked items with the share of the item that leaked."""
    return leakage.leaked_items(table(spark, d, "documents"), table(spark, d, "eval_items"))


def _moderated(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents").select("doc_id", "source", "text")
    return moderation.moderated(documents, table(spark, d, "labelled_texts"))


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that use abusive, hateful or sexual language."""
    return moderation.flagged_documents(_moderated(spark, d))


def p9_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of every document."""
    return _moderated(spark, d)


def p9_source_rates(spark: SparkSession, d: str) -> DataFrame:
    """Rates of each category per source."""
    return moderation.source_rates(_moderated(spark, d))


def queries() -> dict:
    """All queries of this subpackage by name."""
    found = [
        p1_found, p1_pieces, p1_coverage, p2_found, p2_splits, p2_kept, p3_percentiles, p3_merged, p4_found, p4_pairs, p6_found, p6_canonical,
        p7_found, p7_containers, p7_loads, p8_found, p8_leaks, p9_found, p9_scores, p9_source_rates,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    """SQL over the whole tables for the queries that SQL can express."""
    return {
        "p1_found": """
            with valid as (
                select chapter_id, page_id, region_id, max(coalesce(length(source_text), 0)) as n
                from (select *, rank() over (partition by region_id order by updated_at desc) as k from partial_regions) where k = 1
                group by chapter_id, page_id, region_id
            ), sized as (select v.*, m.max_chars from valid v join chapter_manifests m using (chapter_id))
            select 'chapter' as item_level, chapter_id as item_id from sized group by chapter_id, max_chars having sum(n) > max_chars
            union all select 'page', page_id from sized group by page_id, max_chars having sum(n) > max_chars
            union all select 'region', region_id from sized where n > max_chars
        """,
        "p1_coverage": """
            with valid as (
                select chapter_id, region_id, max(coalesce(length(source_text), 0)) as n
                from (select *, rank() over (partition by region_id order by updated_at desc) as k from partial_regions) where k = 1 group by chapter_id, region_id
            )
            select chapter_id, sum(n)::bigint as chars, count(*) as regions, true as within_limit from valid join chapter_manifests using (chapter_id) group by chapter_id
        """,
        "p2_kept": """
            select 'ocr_benchmark_regions' as measure, count(*) as n from ocr_benchmark_regions union all select 'routing_observations', count(*) from routing_observations
            union all select 'torn group_page_id', 0 union all select 'torn page_id', 0
        """,
        "p7_loads": "select 'documents' as measure, count(distinct doc_id) as n from documents union all select 'broken', 0 union all select 'overfull', 0 union all select 'mistold', 0",
        "p2_found": """
            with recursive pages as (
                select cast(regexp_replace(f.page_id, '[^0-9]', '', 'g') as bigint) as page, f.page_id as spelling, lower(trim(f.sha256)) as sha,
                       cast(nullif(regexp_replace(translate(f.reissue_of, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g'), '') as bigint) as of_page
                from chapter_manifests, unnest(source_files) t(f)
            ), seen as (
                select region_id, cast(regexp_replace(translate(page_id, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g') as bigint) as page from ocr_benchmark_regions
                union select observation_id, cast(regexp_replace(translate(page_id, '０１２３４５６７８９', '0123456789'), '[^0-9]', '', 'g') as bigint) from routing_observations
            ), links as (
                select min(page) over (partition by sha) as a, page as b from pages where sha <> '' and replace(sha, sha[1], '') <> ''
                union select min(page) over (partition by region_id), page from seen where region_id is not null
                union select of_page, page from pages where of_page is not null
            ), edges as (select a, b from links where a <> b union select b, a from links where a <> b),
            reach as (
                select a as page, b as other from edges
                union select r.page, e.b from reach r join edges e on e.a = r.other
            ), root as (select page, least(page, min(other)) as root from reach group by page),
            spelled as (select page, min(spelling) as spelling from pages group by page)
            select coalesce(s.spelling, 'pg-' || lpad(cast(r.root as varchar), 8, '0')) as group_page_id, coalesce(t.spelling, 'pg-' || lpad(cast(r.page as varchar), 8, '0')) as page_id
            from root r left join spelled s on s.page = r.root left join spelled t on t.page = r.page where r.page <> r.root
        """,
        "p3_percentiles": """
            with good as (
                select any_value(evaluation_id) as evaluation_id, any_value(page_id) as page_id, any_value(category) as category, any_value(ocr_policy) as ocr_policy, any_value(cer) as cer from region_scores
                where cer is not null and not isnan(cer) and not isinf(cer) and cer >= 0 group by score_id
            ), scoped as (select evaluation_id as scope, category, ocr_policy, cer from good union all select 'all', category, ocr_policy, cer from good
                union all select page_id, null, ocr_policy, cer from good
            ),
            ranked as (
                select *, row_number() over (partition by scope, category, ocr_policy order by cer) as k, count(*) over (partition by scope, category, ocr_policy) as n from scoped
            )
            select scope, category, ocr_policy, p, n, cer as value from ranked, (values (0.5::double), (0.9::double), (0.95::double)) t(p)
            where k = greatest(1, cast(ceil(p * n) as bigint))
        """,
        "p3_merged": """
            with good as (
                select any_value(category) as category, any_value(ocr_policy) as ocr_policy, any_value(cer) as cer from region_scores
                where cer is not null and not isnan(cer) and not isinf(cer) and cer >= 0 group by score_id
            ), lifted as (select *, floor(log2(greatest(cer, pow(2, -60)))) as e from good),
            exact as (select *, greatest(-60, case when pow(2, e) > cer then e - 1 when pow(2, e + 1) <= cer then e + 1 else e end) as x from lifted),
            cells as (
                select category, ocr_policy, case when cer = 0 then 0 else (x + 61) * 128 + least(floor(greatest(0, cer / pow(2, x) - 1) * 128), 127) + 1 end as cell,
                       count(*) as n, min(cer) as low, max(cer) as high
                from exact group by all
            ), run as (
                select *, sum(n) over (partition by category, ocr_policy order by cell) as upto, sum(n) over (partition by category, ocr_policy) as total from cells
            )
            select category, ocr_policy, p, cast(total as bigint) as n, (low + high) / 2 as value, (high - low) / 2 as error_bound
            from run, (values (0.5::double), (0.9::double), (0.95::double)) t(p)
            where upto >= greatest(1, ceil(p * total)) and upto - n < greatest(1, ceil(p * total))
        """,
    }
