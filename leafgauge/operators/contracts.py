"""Contracts as queries whose result must be empty.

A check inside an expression may be pruned with its column; a violations query can't be.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """A contract does not hold."""


def violations(df: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """(rule, key) for each row and rule whose condition is true; null counts as no violation."""
    found = F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in rules.items()]))
    return df.select(F.explode(found).alias("rule"), F.col(key).cast("string").alias("key"))


def duplicates(df: DataFrame, key: str, rule: str = "duplicate-key") -> DataFrame:
    return df.groupBy(key).count().where("count > 1").select(F.lit(rule).alias("rule"), F.col(key).cast("string").alias("key"))


def population(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only."""
    l, r = left.select(key).distinct().withColumn("l", F.lit(True)), right.select(key).distinct().withColumn("r", F.lit(True))
    joined = l.join(r, key, "full_outer").where("l is null or r is null")
    return joined.select(F.when(F.col("r").isNull(), "missing-right").otherwise("missing-left").alias("rule"), F.col(key).cast("string").alias("key"))


def enforce(parts: Iterable[DataFrame]) -> None:
    """Raise if any violations query has a row; at most five rows come to the driver."""
    bad = reduce(DataFrame.unionByName, parts).limit(5).collect()
    if bad:
        raise ContractError("; ".join(f"{r.rule}: {r.key}" for r in bad))
