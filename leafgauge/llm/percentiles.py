"""Percentiles of very large numeric columns, per group, exact or from mergeable ledgers.

Exact: bisection.  For each group and percentile an interval of values and the rank sought
in it are kept.  A pass counts the rows below midpoints (LEVELS halvings at once) and notes
the least and greatest value of each part; the interval shrinks to the part that holds the
rank, and to the values that occur there.  It ends when only one value is left, after a few
passes whatever the tails.  Before, equal values of a group are counted once by a partial
aggregation, so ties cost nothing and no group, however large, meets in one task.

Mergeable: a ledger per group and day counts rows in cells of the bisection tree of a fixed
width (relative to the value's power of two) with their least and greatest value.  Ledgers of
days, partitions or machines merge by adding counts.  A percentile of merged ledgers lies in
its cell's value range, whose width is the error bound that is reported; it is at most
2**-(BITS) of the value.

The percentile is the nearest rank: the value at position ceil(p * n), at least 1.  Values that
are null, NaN, infinite or (by default) negative are no measurements and don't count.  Groups
without any measurement give no row.  A null group key is a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgauge.session import cut

LEVELS = 4
PARTS = 1 << LEVELS
BITS = 7


def measurements(df: DataFrame, value: str, key: str | None = None, negative: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``value`` is a measurement; of repeated deliveries of ``key`` one stays."""
    v = F.col(value)
    good = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    df = df.where(good if negative else good & (v >= 0))
    return df.dropDuplicates([key]) if key else df


def counted_values(df: DataFrame, groups: list[str], value: str) -> DataFrame:
    """(groups, v, n): how often each value occurs in each group."""
    return df.groupBy(*groups, F.col(value).cast("double").alias("v")).agg(F.count("*").alias("n"))


def _rank(p: Column, n: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(p * n)).cast("long")


def exact_percentiles(counted: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """(groups, p, n, value) from counted values (see ``counted_values``) by bisection.

    ``counted`` should be materialised: each pass reads it.  Group columns may have any
    name but ``v``, ``n``, ``p``, ``lo``, ``hi``, ``r``, ``part``.
    """
    key = F.struct(*[F.col(g) for g in groups]) if groups else F.struct(F.lit(1).alias("all"))
    rows = counted.select(key.alias("g"), "v", "n")
    ends = rows.groupBy("g").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("n").alias("total"))
    targets = F.array(*[F.struct(F.lit(float(p)).alias("p"), _rank(F.lit(float(p)), F.col("total")).alias("r")) for p in probs])
    state = cut(ends.select("g", "lo", "hi", "total", targets.alias("targets")))
    done = [state.where("lo = hi")]
    open_ = state.where("lo < hi")
    while not open_.isEmpty():
        # One row for each open interval of a group, with the percentiles sought in it.  Rows outside all of a group's intervals drop out in the join.
        part = F.least(F.lit(PARTS - 1), F.floor((F.col("v") / F.col("width") - F.col("lo") / F.col("width")) * PARTS)).cast("int")
        o = open_.select(F.col("g").alias("og"), "lo", "hi", (F.col("hi") - F.col("lo")).alias("width"))
        o = o.withColumn("width", F.when(F.col("width") == float("inf"), F.lit(1e308)).otherwise(F.greatest("width", F.lit(1e-300))))
        met = rows.join(o, rows.g.eqNullSafe(F.col("og")) & F.col("v").between(F.col("lo"), F.col("hi")))
        counts = met.groupBy("og", "lo", F.when(F.col("v") == F.col("hi"), PARTS - 1).when(F.col("v") == F.col("lo"), 0).otherwise(F.greatest(F.lit(0), part)).alias("part")).agg(F.sum("n").alias("c"), F.min("v").alias("a"), F.max("v").alias("b"))
        # At most PARTS rows of an interval meet here.
        parts = counts.groupBy("og", "lo").agg(F.array_sort(F.collect_list(F.struct("part", "c", "a", "b"))).alias("parts"))
        upto = parts.withColumn("parts", F.transform("parts", lambda x, i: F.struct(x["c"].alias("c"), x["a"].alias("a"), x["b"].alias("b"), F.aggregate(F.slice("parts", 1, i + 1), F.lit(0).cast("long"), lambda s, y: s + y["c"]).alias("upto"))))
        held = upto.join(open_.select("g", F.col("lo").alias("from"), "total", "targets"), F.col("og").eqNullSafe(F.col("g")) & (F.col("lo") == F.col("from")))
        part_of = held.select("g", "total", "targets", F.explode("parts").alias("x"))
        inside = F.filter("targets", lambda t: (t["r"] <= F.col("x.upto")) & (t["r"] > F.col("x.upto") - F.col("x.c")))
        left = F.transform(inside, lambda t: F.struct(t["p"].alias("p"), (t["r"] - F.col("x.upto") + F.col("x.c")).alias("r")))
        state = cut(part_of.select("g", F.col("x.a").alias("lo"), F.col("x.b").alias("hi"), "total", left.alias("targets")).where("size(targets) > 0"))
        done.append(state.where("lo = hi"))
        open_ = state.where("lo < hi")
    found = reduce(DataFrame.unionByName, done)
    return found.select(*[F.col("g")[g].alias(g) for g in groups], F.explode("targets.p").alias("p"), F.col("total").alias("n"), F.col("lo").alias("value"))


def cell_of(value: Column, bits: int = BITS) -> Column:
    """Number of the bisection cell of a value; order of cells is order of values.

    The power of two of the magnitude is split into 2**bits cells of equal width; 0 is a cell
    of its own, magnitudes below 2**-60 share one.
    """
    m = F.abs(value)
    e = F.least(F.lit(1000.0), F.greatest(F.lit(-60.0), F.floor(F.log2(F.greatest(m, F.lit(2.0**-60))))))
    # log2 may round up just below a power of two: the exponent is put right by comparison.
    e = F.when(F.pow(F.lit(2.0), e) > m, e - 1).when(F.pow(F.lit(2.0), e + 1) <= m, e + 1).otherwise(e)
    e = F.greatest(e, F.lit(-60.0))
    inside = F.floor(F.greatest(F.lit(0.0), m / F.pow(F.lit(2.0), e) - 1) * 2**bits)
    n = ((e + 61) * 2**bits + F.least(inside, F.lit(2**bits - 1)) + 1).cast("long")
    return F.when(m == 0, F.lit(0).cast("long")).when(value < 0, -n).otherwise(n)


def ledger(df: DataFrame, groups: list[str], value: str, bits: int = BITS) -> DataFrame:
    """(groups, cell, n, low, high): mergeable summary; its size depends on the spread, not the rows."""
    v = F.col(value).cast("double")
    return df.groupBy(*groups, cell_of(v, bits).alias("cell")).agg(F.count("*").alias("n"), F.min(v).alias("low"), F.max(v).alias("high"))


def merge_ledgers(parts: DataFrame, groups: list[str]) -> DataFrame:
    """The ledger of ``groups`` from ledgers of finer groups, days or partitions."""
    return parts.groupBy(*groups, "cell").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))


def ledger_percentiles(cells: DataFrame, groups: list[str], probs: list[float]) -> DataFrame:
    """(groups, p, n, value, error_bound): the true percentile is within error_bound of value."""
    w = W.partitionBy(*groups) if groups else W.partitionBy(F.lit(1))
    run = cells.withColumn("upto", F.sum("n").over(w.orderBy("cell"))).withColumn("total", F.sum("n").over(w))
    p = run.select("*", F.explode(F.array(*[F.lit(float(x)) for x in probs])).alias("p"))
    rank = _rank(F.col("p"), F.col("total"))
    hit = p.where((F.col("upto") >= rank) & (F.col("upto") - F.col("n") < rank))
    return hit.select(*groups, "p", F.col("total").alias("n"), ((F.col("low") + F.col("high")) / 2).alias("value"), ((F.col("high") - F.col("low")) / 2).alias("error_bound"))
