"""Candidate translations: structural flags, attribution, review rates, challenge choice, paired bootstraps."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgauge.functions import text as X
from leafgauge.operators.ocr import page_numbers, resampled
from leafgauge.session import cut

FORMAT_CODES = ("empty-output", "surrounding-whitespace", "disallowed-control", "unpaired-surrogate", "markdown-fence", "too-many-lines")


def structural_flags(text: Column, source: Column, max_lines: int = 6, max_ratio: float = 4.0, window: int = 4) -> Column:
    """Codes of an output's form in fixed order."""
    t, s = X.normalized(text), X.normalized(source)
    trimmed = X.script_trim(text)
    return F.array_compact(F.array(
        F.when(trimmed == "", "empty-output"), F.when(trimmed != text, "surrounding-whitespace"), F.when(text.rlike(X.CONTROL_NARROW), "disallowed-control"), F.when(text.contains("�"), "unpaired-surrogate"),
        F.when(text.contains("```"), "markdown-fence"), F.when(F.size(F.split(text, "\r?\n")) > max_lines, "too-many-lines"), F.when(text.rlike(X.KANA), "japanese-kana-remains"),
        F.when((t != "") & (t == s), "source-echo"), F.when((s != "") & (F.length(t) > max_ratio * F.length(s)), "excessive-length-ratio"), F.when(X.repeated_block(t, window, window), "excessive-repetition"),
    ))


def format_valid(flags: Column) -> Column:
    return ~F.arrays_overlap(flags, F.array(*[F.lit(c) for c in FORMAT_CODES]))


def input_agreement(source: Column, gold: Column) -> Column:
    """raw, normalized-only or different."""
    return F.when(source == gold, "raw").when(X.normalized(source) == X.normalized(gold), "normalized-only").otherwise("different")


def attribution(regions: DataFrame, outputs: DataFrame) -> DataFrame:
    """Per candidate: how far its input agrees with the gold text.

    ``regions``: region_id, gold, eligible.  ``outputs``: candidate, region_id, source_text.
    """
    joined = outputs.join(regions, "region_id").withColumn("agreement", F.when(F.col("eligible"), input_agreement(F.col("source_text"), F.col("gold"))))
    per = joined.groupBy("candidate").agg(
        F.count("*").alias("outputs"), F.count_if("eligible").alias("eligible_outputs"), F.count_if(~F.col("eligible")).alias("excluded_outputs"),
        *[F.count_if(F.col("agreement") == a).alias(a.replace("-", "_")) for a in ("raw", "normalized-only", "different")],
    )
    total = regions.agg(F.count_if("eligible").alias("eligible_regions"))
    one = F.lit(0).alias("_j")
    return per.select("*", one).join(total.select("*", one), "_j").drop("_j").withColumn("missing_eligible", F.col("eligible_regions") - F.col("eligible_outputs"))


def verdict(flag: Column) -> Column:
    return F.when(flag, "pass").when(~flag, "fail").otherwise("not-reviewed")


def review_rates(reviews: DataFrame, fields: list[str], *groups: str) -> DataFrame:
    """(groups, field, reviewed, passed, failed, pass_rate); what was not reviewed counts nowhere."""
    long = reviews.select(*groups, F.inline(F.array(*[F.struct(F.lit(f).alias("field"), verdict(F.col(f)).alias("v")) for f in fields])))
    agg = long.groupBy(*groups, "field").agg(F.count_if(F.col("v") != "not-reviewed").alias("reviewed"), F.count_if(F.col("v") == "pass").alias("passed"), F.count_if(F.col("v") == "fail").alias("failed"))
    return agg.withColumn("pass_rate", X.rate(F.col("passed"), F.col("reviewed")))


def sampling_key(seed: str, bucket: Column, page: Column, region: Column) -> Column:
    """Hash by which rows are drawn, the same on every run."""
    zero = F.lit("\u0000")
    return F.sha2(F.concat(F.lit(seed), zero, bucket, zero, page, zero, region), 256)


def stratified_top(pool: DataFrame, per_stratum: int, seed: str, bucket: str) -> DataFrame:
    """The first ``per_stratum`` regions of each (category, length) stratum by their sampling key.

    Ranks within a stratum keep only the least keys: the window's limit is pushed below its
    shuffle, so a stratum's rows don't all meet.
    """
    stratum = F.concat_ws("|", "category", "length_stratum")
    keyed = pool.withColumn("stratum", stratum).withColumn("key", sampling_key(seed, F.concat(F.lit(bucket + "|"), F.col("stratum")), F.col("page_id"), F.col("region_id")))
    return keyed.withColumn("k", F.row_number().over(W.partitionBy("stratum").orderBy("key"))).where(F.col("k") <= per_stratum).select("stratum", "region_id", "page_id", "k")


def fill_balanced(pool: DataFrame, chosen: DataFrame, limit: int, seed: str, bucket: str) -> DataFrame:
    """(region_id, position): ``chosen`` up to ``limit``, then the regions that keep pages, categories and lengths even.

    Each step depends on the one before.  At most ``limit`` pages are ever touched, so of each
    (category, length) only the ``limit`` + 1 pages with the least keys can matter, and of a
    page's rows the ``limit`` least; the candidates are reduced to that before one task runs
    the steps.
    """
    keyed = pool.withColumn("key", sampling_key(seed, F.lit(bucket + "|fill"), F.col("page_id"), F.col("region_id")))
    cell = W.partitionBy("page_id", "category", "length_stratum").orderBy("key")
    few = keyed.withColumn("c", F.row_number().over(cell)).where(F.col("c") <= limit)
    heads = few.where("c = 1").withColumn("k", F.row_number().over(W.partitionBy("category", "length_stratum").orderBy("key"))).where(F.col("k") <= limit + 1)
    few = few.join(heads.select("page_id", "category", "length_stratum"), ["page_id", "category", "length_stratum"], "left_semi")
    start = chosen.orderBy("stratum", "k").limit(limit).select("region_id", F.monotonically_increasing_id().alias("order"))
    rows = few.select("region_id", "page_id", "category", "length_stratum", "key", F.lit(None).cast("long").alias("order"))
    picked = start.join(keyed, "region_id").select("region_id", "page_id", "category", "length_stratum", "key", "order")
    both = picked.unionByName(rows.join(start.select("region_id"), "region_id", "left_anti")).withColumn("one", F.lit(1))

    def fill(pdf):
        import collections

        taken = pdf[pdf["order"].notna()].sort_values("order")
        out = taken["region_id"].tolist()
        counts = [collections.Counter(taken[c]) for c in ("page_id", "category", "length_stratum")]
        rest = {r.region_id: r for r in pdf[pdf["order"].isna()].itertuples()}
        while len(out) < limit and rest:
            best = min(rest.values(), key=lambda r: (counts[0][r.page_id], counts[1][r.category], counts[2][r.length_stratum], r.key))
            del rest[best.region_id]
            out.append(best.region_id)
            for c, v in zip(counts, (best.page_id, best.category, best.length_stratum)):
                c[v] += 1
        return type(pdf)({"region_id": out, "position": range(len(out))})

    return both.groupBy("one").applyInPandas(fill, "region_id string, position long")


def paired_bootstrap(outcomes: DataFrame, left: str, right: str, metric: str, replicates: int, seed: int) -> DataFrame:
    """Difference of two candidates' rates on common regions, pages resampled: one row, or none without pairs.

    ``outcomes``: candidate, metric, region_id, page_id, value (0 or 1).
    """
    one = outcomes.where((F.col("metric") == metric) & F.col("value").isNotNull())
    a = one.where(F.col("candidate") == left).select("region_id", "page_id", F.col("value").alias("a"))
    b = one.where(F.col("candidate") == right).select("region_id", F.col("value").alias("b"))
    pages = a.join(b, "region_id").groupBy("page_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.count("*").alias("n"))
    pages = cut(pages)
    n = pages.count()
    word = int(hashlib.sha256(f"{left}|{right}|{metric}".encode()).hexdigest()[:8], 16)
    if not n:
        return pages.sparkSession.createDataFrame([], "candidate_a string, candidate_b string, metric string, pairs long, pages long, difference double, low double, high double")
    numbered = pages.join(page_numbers(pages).withColumnRenamed("page", "page_id"), "page_id")
    reps = resampled(numbered, ["a", "b", "n"], n, replicates, (seed ^ word) & 0xFFFFFFFF)
    deltas = reps.select((X.rate(F.col("b"), F.col("n")) - X.rate(F.col("a"), F.col("n"))).alias("d"))
    ci = deltas.agg(F.percentile("d", 0.025).alias("low"), F.percentile("d", 0.975).alias("high"))
    total = pages.agg(F.sum("n").alias("pairs"), F.count("*").alias("pages"), (X.rate(F.sum("b"), F.sum("n")) - X.rate(F.sum("a"), F.sum("n"))).alias("difference"))
    j = F.lit(0).alias("_j")
    head = [F.lit(left).alias("candidate_a"), F.lit(right).alias("candidate_b"), F.lit(metric).alias("metric")]
    return total.select("*", j).join(ci.select("*", j), "_j").select(*head, "pairs", "pages", "difference", "low", "high")
