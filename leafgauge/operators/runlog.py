"""Append-only run logs: order checks, stable reads and final states of operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def sequence_breaks(log: DataFrame, key: str, order: list[str], phase: str, phases: list[str]) -> DataFrame:
    """(key, position, found, expected) where the n-th entry of a log isn't the n-th phase (phases repeat)."""
    n = F.row_number().over(W.partitionBy(key).orderBy(*order)) - 1
    expected = F.element_at(F.array(*[F.lit(p) for p in phases]), (F.col("position") % len(phases) + 1).cast("int"))
    df = log.withColumn("position", n).withColumn("expected", expected)
    return df.where(~F.col(phase).eqNullSafe(F.col("expected"))).select(key, "position", F.col(phase).alias("found"), "expected")


def stable_reads(reads: DataFrame, key: str, order: list[str], digest: str, idle: str) -> DataFrame:
    """(key, at): the first read that equals the one before, both while nothing was active."""
    w = W.partitionBy(key).orderBy(*order)
    same = (F.lag(digest).over(w) == F.col(digest)) & F.lag(idle).over(w) & F.col(idle)
    marked = reads.withColumn("at", F.row_number().over(w)).withColumn("same", same)
    return marked.where("same").groupBy(key).agg(F.min("at").alias("at"))


def final_states(events: DataFrame, key: str, order: str, kind: str, failed: str, finished: str, warning: str) -> DataFrame:
    """(key, state, warnings, last_seen): the first end in ``order`` decides; warnings are counted before it; without an end running.

    Of several events at the same place in ``order`` a failure counts before a finish.
    """
    end = F.when(F.col(kind).isin(failed, finished), F.struct(F.col(order).alias("o"), F.when(F.col(kind) == failed, 0).otherwise(1).alias("k")))
    first = events.groupBy(F.col(key).alias("_key")).agg(F.min(end).alias("end"), F.max(order).alias("last_seen"))
    early = events.where(F.col(kind) == warning).join(first, F.col(key).eqNullSafe(F.col("_key"))).where(F.col("end").isNull() | (F.col(order) < F.col("end.o"))).groupBy("_key").agg(F.count("*").alias("warnings")).withColumnRenamed("_key", "_w")
    state = F.when(F.col("end").isNull(), "running").when(F.col("end.k") == 0, "failed").otherwise("finished")
    return first.join(early, F.col("_key").eqNullSafe(F.col("_w")), "left").select(F.col("_key").alias(key), state.alias("state"), F.coalesce("warnings", F.lit(0)).alias("warnings"), "last_seen")


def allowed_fields(rows: DataFrame, allowed: list[str]) -> DataFrame:
    """Only the allowed scalar columns of a log row."""
    scalar = {"string", "boolean", "int", "bigint", "double", "float", "smallint", "tinyint", "timestamp"}
    return rows.select(*[c for c, t in rows.dtypes if c in allowed and t in scalar])
