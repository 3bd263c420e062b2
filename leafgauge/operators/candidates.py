"""Reference regions against candidate results: matches by id, then by overlap, and scores."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgauge.functions import text as X
from leafgauge.functions.geometry import iou


def best_overlap(golden: DataFrame, cand: DataFrame, least: float = 0.5) -> DataFrame:
    """(candidate_id, region_id, candidate_row, score): the best overlapping candidate of each reference region on its page.

    Only rows of one page and candidate meet (an equi-join with an overlap condition).
    """
    g = golden.where("bbox is not null").select("region_id", "page_id", F.col("bbox").alias("g"))
    c = cand.where("bbox is not null").select("candidate_id", "page_id", "candidate_row", F.col("bbox").alias("c"))
    scored = g.join(c, "page_id").withColumn("score", iou(F.col("g"), F.col("c"))).where(F.col("score") >= least)
    best = scored.groupBy("candidate_id", "region_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "candidate_row")).alias("b"))
    return best.select("candidate_id", "region_id", F.col("b.candidate_row").alias("candidate_row"), (-F.col("b.s")).alias("score"))


def greedy_matches(golden: DataFrame, cand: DataFrame, least: float = 0.5) -> DataFrame:
    """(candidate_id, region_id, candidate_row): by id, else by best unused overlap on the page, in the order of region ids.

    Id matches are an equi-join.  What is left competes only within its page, so the ordered
    pass runs per candidate and page.
    """
    first = cand.where("region_id is not null").groupBy("candidate_id", "region_id").agg(F.min("candidate_row").alias("candidate_row"))
    by_id = golden.select("region_id").join(first, "region_id").select("candidate_id", "region_id", "candidate_row")
    open_c = cand.where("bbox is not null").join(by_id.select("candidate_id", "candidate_row"), ["candidate_id", "candidate_row"], "left_anti")
    g = golden.where("bbox is not null").select("page_id", "region_id", F.col("bbox").alias("g"))
    pairs = g.join(open_c.select("candidate_id", "page_id", "candidate_row", F.col("bbox").alias("c")), "page_id").withColumn("score", iou(F.col("g"), F.col("c"))).where(F.col("score") >= least)
    pairs = pairs.join(by_id.select("candidate_id", "region_id"), ["candidate_id", "region_id"], "left_anti")

    def take(pdf: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for rid, part in pdf.sort_values(["region_id", "score", "candidate_row"], ascending=[True, False, True]).groupby("region_id", sort=True):
            for r in part.itertuples():
                if r.candidate_row not in used:
                    used.add(r.candidate_row)
                    out.append((r.candidate_id, rid, r.candidate_row))
                    break
        return pd.DataFrame(out, columns=["candidate_id", "region_id", "candidate_row"])

    rest = pairs.select("candidate_id", "page_id", "region_id", "candidate_row", "score").groupBy("candidate_id", "page_id").applyInPandas(take, "candidate_id string, region_id string, candidate_row long")
    return by_id.unionByName(rest)


def scores(golden: DataFrame, cand: DataFrame, matches: DataFrame, facts: DataFrame | None = None, vram: float | None = None) -> DataFrame:
    """Per candidate: recall, mean error rate (1 without readings), review rates, pages without edits, weighted score, hard gate.

    ``facts``: candidate_id, repair_score (mean of the pages' lettering scores of 0 to 5), format_valid, peak_vram.  Without
    facts of its own a candidate's format is valid where every detected region has a translation, its
    repair score is 0 and its memory unknown.  ``vram``: what is available; null means any.
    """
    rows = matches.join(golden.withColumnRenamed("page_id", "g_page"), "region_id").join(cand.drop("region_id", "page_id", "bbox"), ["candidate_id", "candidate_row"])
    det = F.coalesce("detected", F.lit(False))
    cer = F.when(det & F.col("ocr_text").isNotNull(), X.error_rate(X.normalized_script(F.coalesce("expected_ocr", F.lit(""))), X.normalized_script(F.col("ocr_text"))))
    refused = F.coalesce(F.col("translation").rlike(X.REFUSAL), F.lit(False))
    spoke = F.coalesce(F.col("translation") != "", F.lit(False)) & ~refused
    rows = rows.withColumns({"det": det, "cer": cer, "spoke": spoke})
    clean = F.col("det") & F.coalesce(F.col("cer") <= 0.03, F.lit(False)) & F.coalesce("semantic_usable", F.lit(False)) & F.coalesce("terms_correct", F.lit(True)) & F.coalesce("layout_ok", F.lit(False)) & ~refused
    need = F.coalesce("non_refusal_required", F.lit(False))
    # Regions without a match count in the totals only, so no candidate meets all regions.
    whole = golden.agg(F.count("*").alias("n"), F.count_if(need).alias("need"), F.count_distinct(F.struct("page_id")).alias("pages")).first()
    size = golden.groupBy(F.col("page_id").alias("s_page")).agg(F.count("*").alias("size"))
    by_page = rows.groupBy("candidate_id", "g_page").agg(F.count_if(clean).alias("clean"))
    pages = by_page.join(size, F.col("g_page").eqNullSafe(F.col("s_page"))).groupBy("candidate_id").agg((F.count_if(F.col("clean") == F.col("size")) / max(whole.pages, 1)).alias("no_edit_page_rate"))
    agg = rows.groupBy("candidate_id").agg(
        F.count_if("det").alias("detected"), F.avg("cer").alias("ocr_cer"),
        F.avg(F.when(F.col("det"), F.col("semantic_usable").cast("int"))).alias("semantic_rate"), F.avg(F.when(F.col("det"), F.col("terms_correct").cast("int"))).alias("terms_rate"),
        F.count_if(need & F.col("spoke")).alias("kept"), F.min(F.when(F.col("det"), F.col("translation").isNotNull())).alias("all_translated"),
    )
    agg = cand.where("candidate_id is not null").select("candidate_id").distinct().join(agg, "candidate_id", "left").join(pages, "candidate_id", "left")
    agg = agg.select(
        "candidate_id", F.lit(whole.n).alias("regions"), F.coalesce("detected", F.lit(0)).alias("detected"), F.coalesce("ocr_cer", F.lit(1.0)).alias("ocr_cer"), F.coalesce("semantic_rate", F.lit(0.0)).alias("semantic_rate"), F.coalesce("terms_rate", F.lit(0.0)).alias("terms_rate"),
        (F.coalesce("kept", F.lit(0)) / whole.need if whole.need else F.lit(1.0)).alias("non_refusal_rate"), F.coalesce("no_edit_page_rate", F.lit(0.0)).alias("no_edit_page_rate"), F.coalesce("all_translated", F.lit(False)).alias("all_translated"),
    )
    if facts is None:
        agg = agg.withColumns({"repair_score": F.lit(None).cast("double"), "given_format": F.lit(None).cast("boolean"), "peak_vram": F.lit(None).cast("double")})
    else:
        agg = agg.join(facts.select("candidate_id", F.col("repair_score").cast("double").alias("repair_score"), F.col("format_valid").alias("given_format"), F.col("peak_vram").cast("double").alias("peak_vram")), "candidate_id", "left")
    agg = agg.withColumn("repair_score", F.coalesce("repair_score", F.lit(0.0))).withColumn("format_valid", F.coalesce("given_format", "all_translated")).drop("given_format", "all_translated")
    recall = F.col("detected") / F.greatest(F.lit(1), F.col("regions"))
    repair, valid = F.least(F.lit(1.0), F.col("repair_score") / 5), F.col("format_valid").cast("int")
    score = 0.15 * recall + 0.15 * F.greatest(F.lit(0.0), 1 - F.least(F.lit(1.0), F.col("ocr_cer"))) + 0.35 * F.col("semantic_rate") + 0.15 * F.col("terms_rate") + 0.1 * F.col("no_edit_page_rate") + 0.05 * repair + 0.05 * valid
    fits = F.lit(True) if vram is None else F.coalesce(F.col("peak_vram") <= vram, F.lit(True))
    gate = F.col("format_valid") & (F.col("non_refusal_rate") == 1) & fits & (F.col("detection_recall") >= 0.95) & (F.col("ocr_cer") <= 0.05) & (F.col("semantic_rate") >= 0.8)
    return agg.withColumn("detection_recall", recall).withColumn("weighted_score", score).withColumn("hard_gate", gate)


# What a release accepts, by measure; 1 means at least, -1 at most.
ACCEPTED = {
    "detection_recall": (1, 0.98), "ocr_cer": (-1, 0.03), "semantic_rate": (1, 0.9), "terms_rate": (1, 0.99), "no_edit_page_rate": (1, 0.85), "repair_score": (1, 4.0), "non_refusal_rate": (1, 1.0),
}


def acceptance(scored: DataFrame) -> DataFrame:
    """(candidate_id, measure, accepted) of every measure and of the format."""
    rows = [F.struct(F.lit(m).alias("measure"), (F.col(m) >= v if sign > 0 else F.col(m) <= v).alias("accepted")) for m, (sign, v) in ACCEPTED.items()]
    rows.append(F.struct(F.lit("format_valid").alias("measure"), F.col("format_valid").alias("accepted")))
    return scored.select("candidate_id", F.inline(F.array(*rows)))


def winner(scored: DataFrame) -> DataFrame:
    """One row: the candidate of the greatest score that passes the hard gate, ties to the least id, or null; and how many passed."""
    best = F.min(F.when(F.col("hard_gate"), F.struct((-F.col("weighted_score")).alias("s"), F.col("candidate_id").alias("id"))))
    return scored.agg(best["id"].alias("winner"), F.count_if("hard_gate").alias("passed"), F.count("*").alias("candidates"))
