"""Rule flags of translated regions, page plans, glossaries and page chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgauge.functions import text as X
from leafgauge.functions.geometry import capacity

STRICT = ("MISSING_TRANSLATION", "LLM_REASONING_LEAK", "TRANSLATION_REFUSAL", "JAPANESE_KANA_REMAINS")
TRANSLATION_RETRY = (
    "MISSING_TRANSLATION", "LLM_REASONING_LEAK", "TRANSLATION_REFUSAL", "JAPANESE_KANA_REMAINS", "SIGNIFICANT_TOKEN_LOST",
    "TRANSLATION_TOO_LONG", "TRANSLATION_TOO_SHORT", "TEXT_OVERFLOW_RISK", "SUSPICIOUS_DUPLICATE_TRANSLATION",
)
RISK = (*TRANSLATION_RETRY, "LOW_OCR_CONFIDENCE", "OCR_TEXT_ANOMALY")


def _flag(cond: Column, code: str, severity: str, detail: Column | None = None) -> Column:
    return F.when(cond, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), (detail if detail is not None else F.lit(None).cast("string")).alias("detail")))


def region_flags(confidence_min: float = 0.86, too_long: float = 2.8, too_short: float = 0.25, glyph: int = 20) -> Column:
    """Flags of a row with confidence, source_text, translated_text, policy and bbox, in the order of the rules.

    A missing translation ends the list: an error where text is to be replaced, else nothing more.
    """
    src = F.coalesce("source_text", F.lit(""))
    t = X.script_trim(F.coalesce("translated_text", F.lit("")))
    replace = F.col("policy") == "replace"
    there = t != ""
    ratio = X.utf16_length(X.no_space(t)) / F.greatest(F.lit(1), X.utf16_length(X.no_space(src)))
    first = [
        _flag(F.col("confidence") < confidence_min, "LOW_OCR_CONFIDENCE", "warning"),
        _flag(src.contains("�") | src.rlike(r"(.)\1{4,}"), "OCR_TEXT_ANOMALY", "warning"),
        _flag(~there & replace, "MISSING_TRANSLATION", "error"),
        _flag(there & t.rlike(X.REASONING), "LLM_REASONING_LEAK", "error"),
        _flag(there & t.rlike(X.REFUSAL), "TRANSLATION_REFUSAL", "error"),
        _flag(there & replace & t.rlike(X.KANA_WIDE), "JAPANESE_KANA_REMAINS", "error"),
    ]
    target = X.significant_tokens(t)
    lost = F.transform(F.filter(X.significant_tokens(src), lambda s: ~F.array_contains(target, s)), lambda s: _flag(F.lit(True), "SIGNIFICANT_TOKEN_LOST", "warning", s))
    last = [
        _flag(there & (ratio > too_long), "TRANSLATION_TOO_LONG", "warning"), _flag(there & (ratio < too_short), "TRANSLATION_TOO_SHORT", "warning"),
        _flag(there & (X.utf16_length(X.no_space(t)) > capacity(F.col("bbox"), glyph)), "TEXT_OVERFLOW_RISK", "error"),
    ]
    none = F.array().cast("array<struct<code:string,severity:string,detail:string>>")
    return F.concat(F.array_compact(F.array(*first)), F.when(there, lost).otherwise(none), F.array_compact(F.array(*last)))


def duplicate_targets(regions: DataFrame) -> DataFrame:
    """(chapter_id, target) that stand for three or more different sources of their chapter.

    Distinct (target, source) pairs first, by partial aggregation, so a common target's rows
    don't meet in one task; then counts.
    """
    pairs = regions.where("translated_text <> ''").select("chapter_id", F.lower(X.no_space(F.col("translated_text"))).alias("target"), X.no_space(F.coalesce("source_text", F.lit(""))).alias("source")).distinct()
    return pairs.groupBy("chapter_id", "target").agg(F.count("*").alias("sources")).where("sources >= 3")


def chapter_flags(regions: DataFrame) -> DataFrame:
    """Regions with qa_flags, the chapter-wide duplicate flag included."""
    df = regions.withColumn("qa_flags", region_flags()).withColumn("_t", F.lower(X.no_space(F.col("translated_text"))))
    dup = duplicate_targets(regions).select(F.col("chapter_id").alias("_c"), F.col("target").alias("_d"))
    joined = df.join(dup, df.chapter_id.eqNullSafe(F.col("_c")) & (F.col("_t") == F.col("_d")), "left")
    long = X.utf16_length(F.col("translated_text")) >= 3
    more = F.when(F.col("_d").isNotNull() & long, F.concat("qa_flags", F.array(_flag(F.lit(True), "SUSPICIOUS_DUPLICATE_TRANSLATION", "warning")))).otherwise(F.col("qa_flags"))
    return joined.withColumn("qa_flags", more).drop("_t", "_c", "_d")


def flag_rows(flagged: DataFrame) -> DataFrame:
    """One row for each flag, with its position."""
    return flagged.select("region_id", "page_id", F.posexplode("qa_flags").alias("position", "f")).select("region_id", "page_id", "position", "f.*")


def has_code(codes: tuple[str, ...]) -> Column:
    return F.exists("qa_flags", lambda f: f["code"].isin(*codes))


def blocks_rendering() -> Column:
    return has_code(STRICT) | (has_code(("TRANSLATION_TOO_LONG",)) & has_code(("TEXT_OVERFLOW_RISK",)))


def page_lists(flagged: DataFrame) -> DataFrame:
    """(page_id, retry, translation_retry, blocked) of pages with any of these."""
    retry = F.size("qa_flags") > 0
    pages = flagged.groupBy("page_id").agg(F.max(retry).alias("retry"), F.max(has_code(TRANSLATION_RETRY)).alias("translation_retry"), F.max(blocks_rendering()).alias("blocked"))
    return pages.where("retry or translation_retry or blocked")


def page_plan(pages: DataFrame, flagged: DataFrame, sparse: int = 2, dense: int = 12, ratio: float = 0.5) -> DataFrame:
    """(chapter_id, page_id, codes) of pages to be preserved, in the fixed order of codes.

    ``pages``: chapter_id, page_id, page_no, last (0-based number of the last page).  Pages
    without regions are kept by the left join.
    """
    sums = flagged.groupBy("page_id").agg(
        F.count("*").alias("n"), F.max(blocks_rendering()).alias("strict"), F.max(F.col("role") == "unknown").alias("unknown"),
        F.min((F.col("role") == "sfx") & (F.col("policy") == "preserve-with-annotation")).alias("artistic"), F.count_if(has_code(RISK)).alias("risky"),
    )
    df = pages.join(sums, "page_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    edge = (F.col("page_no") == 0) | (F.col("page_no") == F.col("last"))
    risk = ((F.col("n") <= sparse) & (F.col("risky") == F.col("n"))) | ((F.col("n") >= dense) & (F.col("risky") / F.col("n") >= ratio))
    codes = F.array_compact(F.array(
        F.when(F.col("strict"), "BLOCKING_REGION_QA"), F.when(F.col("n") == 0, "NO_TEXT_REGIONS_DETECTED"), F.when(F.col("unknown"), "UNCLASSIFIED_TEXT_REGION"),
        F.when((F.col("n") > 0) & F.col("artistic"), "ARTISTIC_TEXT_ONLY_PAGE"), F.when(edge & (F.col("n") > 0) & risk, "RISKY_BOUNDARY_PAGE"),
    ))
    return df.select("chapter_id", "page_id", codes.alias("codes")).where("size(codes) > 0")


def mark_skipped(flagged: DataFrame, plan: DataFrame) -> DataFrame:
    """Regions on planned pages get one RENDERING_SKIPPED_FOR_PAGE flag, once however often this runs."""
    marked = flagged.join(plan.select("page_id", F.lit(True).alias("_b")).distinct(), "page_id", "left")
    code = "RENDERING_SKIPPED_FOR_PAGE"
    more = F.when(F.col("_b") & ~has_code((code,)), F.concat("qa_flags", F.array(_flag(F.lit(True), code, "warning")))).otherwise(F.col("qa_flags"))
    return marked.withColumn("qa_flags", more).drop("_b")


def glossary(regions: DataFrame, *groups: str) -> DataFrame:
    """(groups, source, target, uses): the commonest target of each source with at least two uses; sound effects don't count."""
    r = regions.where("translated_text <> '' and role <> 'sfx'").select(*groups, X.no_space(F.coalesce("source_text", F.lit(""))).alias("source"), X.no_space(F.col("translated_text")).alias("target"))
    counts = r.where((X.utf16_length(F.col("source")) >= 2) & (F.col("target") != "")).groupBy(*groups, "source", "target").agg(F.count("*").alias("uses"))
    best = counts.groupBy(*groups, "source").agg(F.min(F.struct((-F.col("uses")).alias("u"), "target")).alias("b"))
    return best.select(*groups, "source", F.col("b.target").alias("target"), (-F.col("b.u")).alias("uses")).where("uses >= 2")


def glossary_prompt(entries: DataFrame, base: str, *groups: str, limit: int = 100) -> DataFrame:
    """(groups, prompt): base text and the first ``limit`` entries by source, a line each."""
    ranked = entries.withColumn("k", F.row_number().over(W.partitionBy(*groups).orderBy("source"))).where(F.col("k") <= limit)
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", F.concat("source", F.lit(" => "), "target").alias("line")))), lambda x: x["line"]), "\n")
    return ranked.groupBy(*groups).agg(F.concat(F.lit(base + "\n必须遵守以下章节术语表：\n"), lines).alias("prompt"))


def page_chunks(pages: DataFrame, size: int, overlap: int, *groups: str) -> DataFrame:
    """(groups, chunk_no, page_id, position): windows of ``size`` pages that share ``overlap``.

    The window that reaches the last page is the last one.  A page's chunks follow from its
    number and the page count alone, so no pages are gathered.
    """
    step = size - overlap
    if size < 1 or overlap < 0 or step < 1:
        raise ValueError("overlap must be less than size")
    n, i = F.col("last") + 1, F.col("page_no")
    final = F.greatest(F.lit(0), F.ceil((n - size) / step)).cast("long")
    low = F.greatest(F.lit(0), F.floor((i - size) / step) + 1)
    high = F.least(final, F.floor(i / step))
    df = pages.where(low <= high).select(*groups, "page_id", "page_no", F.explode(F.sequence(low.cast("long"), high.cast("long"))).alias("chunk_no"))
    return df.select(*groups, "chunk_no", "page_id", (F.col("page_no") - F.col("chunk_no") * step).cast("long").alias("position"))
