"""Roles and routing classes of regions, their distributions and page safety."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafgauge.functions.text import rate

ROLES = ("dialogue", "caption", "sfx")


def role_of(native: Column, inside: Column, confidence: Column) -> Column:
    """A native role wins; else a bubble with enough confidence makes dialogue; else unknown."""
    return F.when(native.isin(*ROLES), native).when(inside & (confidence >= 0.8), F.lit("dialogue")).otherwise(F.lit("unknown"))


def policy_of(role: Column) -> Column:
    return F.when(role.isin("dialogue", "caption"), F.lit("replace")).otherwise(F.lit("preserve-with-annotation"))


def routed(obs: DataFrame) -> DataFrame:
    """``obs`` with role, policy and routing_class."""
    inside, conf = F.col("evidence.inside_bubble"), F.col("evidence.confidence")
    df = obs.withColumn("role", role_of(F.col("native_role"), F.coalesce(inside, F.lit(False)), conf)).withColumn("policy", policy_of(F.col("role")))
    cls = F.when(F.col("role").isin("dialogue", "caption"), "ordinary-dialogue").when(inside == F.lit(False), "bubble-external").otherwise("unknown")
    return df.withColumn("routing_class", cls)


def distribution(df: DataFrame, *groups: str) -> DataFrame:
    """Counts of the three classes per group."""
    classes = ("ordinary-dialogue", "bubble-external", "unknown")
    return df.groupBy(*groups).agg(*[F.count_if(F.col("routing_class") == c).alias(c.replace("-", "_")) for c in classes], F.count("*").alias("regions"))


def summary(df: DataFrame) -> DataFrame:
    """One row of routing counts and rates over routed observations."""
    det = F.col("detected")
    bubble = F.col("evidence.role_provenance") == "bubble-mask"
    geometry = F.col("evidence.geometry_source")
    agg = df.agg(
        F.count("*").alias("regions"), F.count_if(det).alias("detected_regions"),
        *[F.count_if(det & (F.col("role") == r)).alias(f"role_{r}") for r in (*ROLES, "unknown")],
        *[F.count_if(det & (F.col("policy") == p)).alias(f"policy_{p.split('-')[0]}") for p in ("replace", "preserve-with-annotation")],
        F.count_if(det & bubble & F.col("evidence.inside_bubble") & (F.col("role") == "dialogue")).alias("mapped"),
        F.count_if(det & (F.col("routing_class") != "unknown")).alias("classified"),
        F.count_if(det & bubble & (geometry == "line-polygons")).alias("line_polygons"), F.count_if(det & bubble & (geometry == "bbox")).alias("bbox"),
        F.count_if((F.col("native_role") == "unknown") & (F.col("legacy_policy") == "replace")).alias("legacy_unknown_replace"),
    )
    return agg.withColumns({"mapped_rate": rate(F.col("mapped"), F.col("detected_regions")), "classified_rate": rate(F.col("classified"), F.col("detected_regions"))})


def separation(df: DataFrame) -> DataFrame:
    """Extremes that separate the classes among detected regions; null where a class is absent."""
    det = df.where("detected")
    dialogue = F.col("routing_class") == "ordinary-dialogue"
    return det.agg(
        F.max(F.when(F.col("routing_class") == "bubble-external", F.col("overlap_rate"))).alias("external_max"),
        F.min(F.when(dialogue, F.col("overlap_rate"))).alias("dialogue_min"), F.min(F.when(dialogue, F.col("dominant_share"))).alias("dialogue_share_min"),
    )


def page_safety(df: DataFrame) -> DataFrame:
    """Reviewed pages, pages with an unknown detected region, without any detected region, and with neither."""
    pages = df.groupBy("page_id").agg(F.max(F.coalesce(F.col("detected"), F.lit(False))).alias("some"), F.max(F.coalesce(F.col("detected") & (F.col("role") == "unknown"), F.lit(False))).alias("unknown"))
    return pages.agg(F.count("*").alias("pages"), F.count_if("unknown").alias("pages_unknown"), F.count_if(~F.col("some")).alias("pages_empty"), F.count_if(~F.col("unknown") & F.col("some")).alias("pages_free"))


def contract_rules() -> dict[str, Column]:
    """Rules that a valid observation must not break."""
    o, s, c = F.col("overlap_rate"), F.col("dominant_share"), F.col("evidence.confidence")
    inside = F.col("evidence.inside_bubble")
    bubble = F.col("evidence.role_provenance") == "bubble-mask"
    want_in = (o >= 0.8) & (s >= 0.8)
    want_out = ~want_in & (o <= 0.05)
    want_conf = F.when(want_in, F.least(o, s)).when(want_out, 1 - o).otherwise(F.greatest(o, 1 - o))
    return {
        "rate-out-of-range": ~o.between(0, 1) | ~s.between(0, 1) | ~c.between(0, 1),
        "zero-overlap-mismatch": (o == 0) != (s == 0),
        "decision-mismatch": bubble & o.isNotNull() & s.isNotNull() & ~inside.eqNullSafe(F.when(want_in, True).when(want_out, False)),
        "confidence-mismatch": bubble & (F.abs(c - want_conf) > 1e-9),
        "geometry-missing": bubble & F.col("evidence.geometry_source").isNull(),
        "category-missing": F.col("category").isNull(),
        "tags-without-hardness": F.coalesce(F.size("hard_case_tags"), F.lit(0)).__gt__(0) & F.col("hardness").isNull(),
    }


MAX_TAGS = 20


def smallest_cover(rows: list[tuple[str, float, tuple[str, ...]]]) -> list[str]:
    """Ids of the smallest set of rows whose tags cover all tags: exact over at most 20 tags.

    Ties: fewer rows, then greater total hardness, then the lesser sorted ids.
    """
    tags = sorted({t for _, _, ts in rows for t in ts})
    if len(tags) > MAX_TAGS:
        raise ValueError(f"more than {MAX_TAGS} tags")
    bit = {t: 1 << i for i, t in enumerate(tags)}
    best: dict[int, tuple[int, float, tuple[str, ...]]] = {0: (0, 0.0, ())}
    for rid, hardness, ts in sorted(rows, key=lambda r: r[0]):
        mask = 0
        for t in ts:
            mask |= bit[t]
        for covered, (n, h, ids) in list(best.items()):
            cand = (n + 1, h - hardness, tuple(sorted((*ids, rid))))
            got = best.get(covered | mask)
            if covered | mask != covered and (got is None or cand < got):
                best[covered | mask] = cand
    return list(best[(1 << len(tags)) - 1][2])


def hard_cases(obs: DataFrame) -> DataFrame:
    """(observation_id) of the smallest set of observations that shows every hard-case tag.

    Of observations with one set of tags only the hardest can be in it, so the search sees one
    row for each set of tags (bounded by the tag vocabulary, not by the rows).
    """
    tagged = obs.where("size(hard_case_tags) > 0").select("observation_id", F.coalesce("hardness", F.lit(0.0)).alias("hardness"), F.array_sort(F.array_distinct("hard_case_tags")).alias("tags"))
    best = tagged.groupBy("tags").agg(F.min(F.struct((-F.col("hardness")).alias("h"), "observation_id")).alias("b")).select(F.lit(1).alias("one"), "tags", F.col("b.observation_id").alias("observation_id"), (-F.col("b.h")).alias("hardness"))

    def solve(pdf):
        rows = [(r.observation_id, float(r.hardness), tuple(r.tags)) for r in pdf.itertuples()]
        return pdf[pdf["observation_id"].isin(smallest_cover(rows))][["observation_id"]]

    return best.groupBy("one").applyInPandas(solve, "observation_id string")
