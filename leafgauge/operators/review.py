"""Review data: alignment of passes, contracts of overlays and runs, roll-ups and choices, as column expressions and plans.

Contracts return one row for each broken rule, so an empty result means that all holds.  Alignments are full
outer joins on unique keys: nothing is matched within groups, and what only one side has comes out too.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Forms of identifiers.
IDENTIFIER = r"^[A-Za-z0-9][A-Za-z0-9._:-]{0,127}$"
LABEL = r"^[a-z0-9][a-z0-9-]{0,63}$"
TAG = r"^[a-z0-9][a-z0-9-]{0,63}(:[a-z0-9][a-z0-9-]{0,63})?$"
DIGEST = r"^[a-f0-9]{64}$"
# What an overlay may say.
DETECTION = ("detected", "missed")
ELIGIBILITY = ("eligible", "excluded")


def outside(value: Column, allowed: tuple[str, ...]) -> Column:
    """A value that is there and not among ``allowed``; null is no value."""
    return F.coalesce(~value.isin(*allowed), F.lit(False))


def overlay_rules(reasons: tuple[str, ...]) -> dict[str, Column]:
    """Rules between the fields of an overlay entry, by name; each is true where it is broken."""
    has = lambda c: F.col(c).isNotNull()
    excluded = F.col("ocr_eligibility").eqNullSafe("excluded")
    missed = F.col("detection_status").eqNullSafe("missed")
    return {
        "unsafe-id": ~F.coalesce(F.col("region_id").rlike(IDENTIFIER), F.lit(False)),
        "unknown-detection": outside(F.col("detection_status"), DETECTION),
        "unknown-eligibility": outside(F.col("ocr_eligibility"), ELIGIBILITY),
        "unknown-reason": outside(F.col("exclusion_reason"), reasons),
        "blank-gold": has("expected_ocr") & (F.trim("expected_ocr") == ""),
        "excluded-without-reason": excluded & ~has("exclusion_reason"),
        "reason-without-exclusion": has("exclusion_reason") & ~excluded,
        "excluded-with-gold": excluded & has("expected_ocr"),
        "missed-not-excluded": missed & ~(excluded & F.col("exclusion_reason").eqNullSafe("detection-missed")),
        "changes-nothing": ~has("detection_status") & ~has("ocr_eligibility") & ~has("expected_ocr"),
    }


def settled_region(detection: Column, eligibility: Column, reason: Column, gold: Column) -> Column:
    """Struct of a region's settled status: defaults follow from detection, and gold text stays with eligible regions only."""
    status = F.coalesce(eligibility, F.when(detection == "detected", "eligible").otherwise("excluded"))
    why = F.coalesce(reason, F.when(detection == "missed", "detection-missed"))
    return F.struct(detection.alias("detection_status"), status.alias("ocr_eligibility"), why.alias("exclusion_reason"), F.when(status == "eligible", gold).alias("expected_ocr"))


def misaligned(primary: DataFrame, other: DataFrame, key: list[str], same: list[str]) -> DataFrame:
    """(key, issue): keys of one side only, repeated keys, and keys whose ``same`` columns differ (null equals null).

    Keys that repeat are reported once and compared by their least value, so no pair of repeats is formed.
    """
    side = lambda df, p: df.groupBy(*key).agg(F.count("*").alias(f"{p}n"), F.min(F.struct(*same)).alias(p))
    joined = side(primary, "a").join(side(other, "b"), key, "full_outer")
    issues = [
        F.when(F.col("an").isNull(), "extra"), F.when(F.col("bn").isNull(), "missing"), F.when((F.col("an") > 1) | (F.col("bn") > 1), "repeated"),
        *[F.when(F.col("an").isNotNull() & F.col("bn").isNotNull() & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), f"{c}-conflict") for c in same],
    ]
    return joined.select(*key, F.explode(F.array_compact(F.array(*issues))).alias("issue"))


def drifted(base: DataFrame, other: DataFrame, key: str, column: str) -> DataFrame:
    """(key, base_value, other_value) of keys in both whose values differ."""
    a, b = base.select(key, F.col(column).alias("base_value")), other.select(key, F.col(column).alias("other_value"))
    return a.join(b, key).where(~F.col("base_value").eqNullSafe(F.col("other_value")))


def difference(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows of only one side with the side, repeats counted; empty where ``actual`` reproduces ``expected``."""
    cols = sorted(expected.columns)
    a, b = expected.select(cols), actual.select(cols)
    return a.exceptAll(b).withColumn("side", F.lit("expected")).unionByName(b.exceptAll(a).withColumn("side", F.lit("actual")))


def gate(counts: DataFrame) -> DataFrame:
    """(status, reason) of line polygons from counts ``polygons``, ``boxes`` and ``detected``; the first broken rule counts."""
    reason = (
        F.when(F.col("polygons") == 0, "LINE_POLYGONS_UNAVAILABLE").when(F.col("boxes") > 0, "BBOX_FALLBACK_PRESENT").when(F.col("polygons") != F.col("detected"), "GEOMETRY_EVIDENCE_INCOMPLETE")
    )
    return counts.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "passed").otherwise("failed"))


def headroom(physical: Column, commit: Column, least_physical: int = 4096, least_commit: int = 8192) -> Column:
    """Code of a memory reading in MiB; an unknown commit headroom is allowed."""
    return F.when(physical < least_physical, "PHYSICAL_MEMORY_LOW").when(commit.isNull(), "COMMIT_COUNTER_UNAVAILABLE").when(commit < least_commit, "COMMIT_HEADROOM_LOW").otherwise("RESOURCE_HEADROOM_OK")


def status_kind(status: Column) -> Column:
    """idle, failed, finished or active by what a status says."""
    low = F.lower(status)
    return F.when(status.isNull() | (F.trim(status) == ""), "idle").when(low.rlike("fail|error|cancel"), "failed").when(low.rlike("finish|complete|success|done|purchase"), "finished").otherwise("active")


def qa_code(reason: Column) -> Column:
    return F.concat(F.lit("OCR_RUNTIME_"), F.upper(F.translate(reason, "-", "_")))


def best_hint(entries: DataFrame, group: list[str], text: Column, hints: list[str], name: str) -> DataFrame:
    """(group, choice, score): the entry whose text holds most hints, then the least name; hint scores of 0 leave the least name."""
    score = reduce(lambda a, b: a + b, [F.col("_t").contains(h.lower()).cast("int") for h in hints], F.lit(0))
    scored = entries.withColumn("_t", F.lower(text)).withColumn("score", score)
    return scored.groupBy(*group).agg(F.min(F.struct((-F.col("score")).alias("s"), F.col(name).alias("n"))).alias("b")).select(*group, F.col("b.n").alias("choice"), (-F.col("b.s")).alias("score"))


def selection_digest(seed: str, benchmark: str, ids: Column) -> Column:
    """SHA-256 of the JSON text of a selection; ``ids`` is an array in the order of selection."""
    head = f'{{"selectorRevision":1,"benchmarkId":"{benchmark}","seed":"{seed}","selectedRegionIds":'
    return F.sha2(F.concat(F.lit(head), F.to_json(ids), F.lit("}")), 256)


def rerouted(candidates: Column, model: Column, text: Column, reason: str) -> Column:
    """The candidates unselected, with a selected one of the cloud route behind them; unchanged without text."""
    more = F.struct(model.alias("model"), text.alias("text"), F.lit(True).alias("selected"), F.lit(reason).alias("selection_reason"), F.lit("cloud").alias("route"))
    off = F.transform(candidates, lambda c: F.struct(c["model"].alias("model"), c["text"].alias("text"), F.lit(False).alias("selected"), c["selection_reason"].alias("selection_reason"), c["route"].alias("route")))
    return F.when(F.coalesce(text != "", F.lit(False)), F.concat(off, F.array(more))).otherwise(candidates)
