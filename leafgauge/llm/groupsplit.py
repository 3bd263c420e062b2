"""Train, validation and test splits that keep the pages of one work together.

Pages are vertices; a shared scan hash, a reissue note and a region recorded under two pages
are edges.  Works are the connected components, found by Borůvka-style contraction: in each
round every component picks its least edge in a total order, the picked edges join the
spanning forest (written to the shared checkpoint folder), components hook along them,
pointer jumping finds the new roots, and the contracted edges keep one representative per
pair of components.  The number of components with an outgoing edge at least halves in each
round, so a chain of n pages takes about log2(n) rounds.

Nothing about single pages, edges or components is collected: the driver reads only counts
that tell whether to go on.  Keys shared by very many rows (a placeholder that slipped
through, a region sent again thousands of times) are reduced by a partial aggregation to
distinct (key, page) pairs and become a star around the least page, not all pairs.

Roots are then stratified by the size band of their work (powers of two of its rows) and
dealt systematically: within a band, roots stand in the order of a hash, and position k takes
the split of a smooth weighted rotation at k.  Ranks are two-level (hash bucket, then rank in
the bucket), so no task holds a whole band.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgauge.session import cut

BUCKETS = 1024
FULL_WIDTH_DIGITS = "０１２３４５６７８９"


def page_number(page: Column) -> Column:
    """The number that the digits of a page id carry, in any spelling; null without digits or beyond 64 bits."""
    digits = F.regexp_replace(F.translate(page, FULL_WIDTH_DIGITS, "0123456789"), "[^0-9]", "")
    return F.when(digits != "", digits.try_cast("bigint"))


def known_hash(sha: Column) -> Column:
    """The scan hash in one letter case; null for a placeholder of one repeated character."""
    low = F.lower(F.trim(sha))
    return F.when((low != "") & (F.replace(low, F.substring(low, 1, 1), F.lit("")) != ""), low)


def _star(pairs: DataFrame, kind: int) -> DataFrame:
    """Edges from the least page of each key to its other pages: (k, a, b)."""
    pairs = pairs.where("key is not null and page is not null").distinct()
    least = pairs.groupBy("key").agg(F.min("page").alias("a"), F.max("page").alias("z")).where("a < z")
    return pairs.join(least, "key").where("page > a").select(F.lit(kind).alias("k"), "a", F.col("page").alias("b"))


def page_edges(manifests: DataFrame, regions: DataFrame) -> DataFrame:
    """Edges (k, a, b) with a < b between page numbers.

    ``manifests``: exploded pages with ``page_id``, ``sha256``, ``reissue_of``.  ``regions``:
    ``region_id``, ``page_id`` of all tables.  Nulls name no page and give no edge.
    """
    pages = manifests.select(page_number(F.col("page_id")).alias("page"), known_hash(F.col("sha256")).alias("key"), page_number(F.col("reissue_of")).alias("of"))
    same_scan = _star(pages.select("key", "page"), 1)
    same_region = _star(regions.select(F.col("region_id").alias("key"), page_number(F.col("page_id")).alias("page")), 2)
    reissue = pages.where("of <> page").select(F.lit(3).alias("k"), F.least("page", "of").alias("a"), F.greatest("page", "of").alias("b"))
    return same_scan.unionByName(same_region).unionByName(reissue).groupBy("a", "b").agg(F.min("k").alias("k"))


def spanning_forest(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(labels, forest) of the edges (k, a, b).

    labels: (page, root) for every page with an edge; the root is the least page of its
    component.  forest: the chosen edges (k, a, b), one fewer than the pages of each component.
    """
    weight = F.struct("k", "a", "b").alias("w")
    live = cut(edges.select(weight, F.col("a").alias("u"), F.col("b").alias("v")))
    labels = cut(live.select(F.explode(F.array("u", "v")).alias("page")).distinct().withColumn("root", F.col("page")))
    forests: list[DataFrame] = []
    while not live.isEmpty():
        ends = live.select(F.col("u").alias("c"), F.struct("w", F.col("v").alias("o")).alias("e")).unionByName(live.select(F.col("v").alias("c"), F.struct("w", F.col("u").alias("o")).alias("e")))
        picks = cut(ends.groupBy("c").agg(F.min("e").alias("e")).select("c", "e.o", "e.w"))
        forests.append(picks.select("w").distinct())
        back = picks.select(F.col("c").alias("o"), F.col("o").alias("c_back"))
        # Of two components that picked each other the smaller becomes the root.
        parent = picks.join(back, "o").select("c", F.when((F.col("c_back") == F.col("c")) & (F.col("c") < F.col("o")), F.col("c")).otherwise(F.col("o")).alias("p"))
        parent = cut(parent)
        while True:
            up = parent.select(F.col("c").alias("p"), F.col("p").alias("pp"))
            jumped = cut(parent.join(up, "p").select("c", F.col("pp").alias("p"), (F.col("pp") != F.col("p")).alias("moved")))
            parent = jumped.drop("moved")
            if jumped.where("moved").isEmpty():
                break
        to = lambda name: parent.select(F.col("c").alias(name), F.col("p").alias(name + "_"))
        labels = cut(labels.join(to("root"), "root", "left").select("page", F.coalesce("root_", "root").alias("root")))
        moved = live.join(to("u"), "u").join(to("v"), "v").where("u_ <> v_")
        live = cut(moved.groupBy(F.least("u_", "v_").alias("u"), F.greatest("u_", "v_").alias("v")).agg(F.min("w").alias("w")))
    least = labels.groupBy("root").agg(F.min("page").alias("least"))
    labels = cut(labels.join(least, "root").select("page", F.col("least").alias("root")))
    none = edges.limit(0).select("k", "a", "b")
    forest = reduce(DataFrame.unionByName, [f.select("w.*") for f in forests], none)
    return labels, cut(forest)


def official_spelling(manifests: DataFrame) -> DataFrame:
    """(page, spelling) from the manifests' own page ids."""
    return manifests.select(page_number(F.col("page_id")).alias("page"), F.col("page_id").alias("spelling")).where("page is not null").groupBy("page").agg(F.min("spelling").alias("spelling"))


def spelled(df: DataFrame, official: DataFrame, column: str) -> DataFrame:
    """``df`` with page numbers in ``column`` replaced by official page ids; unknown pages get the same form."""
    joined = df.join(official.withColumnsRenamed({"page": column, "spelling": "_s"}), column, "left")
    return joined.withColumn(column, F.coalesce("_s", F.when(F.col(column).isNotNull(), F.format_string("pg-%08d", column)))).drop("_s")


def works_of_pages(manifests: DataFrame, regions: DataFrame) -> DataFrame:
    """(group_page_id, page_id): each page but the smallest of every work of two or more pages."""
    labels, _ = spanning_forest(page_edges(manifests, regions))
    official = official_spelling(manifests)
    pairs = labels.where("page <> root").select(F.col("root").alias("group_page_id"), F.col("page").alias("page_id"))
    return spelled(spelled(pairs, official, "group_page_id"), official, "page_id").select("group_page_id", "page_id")


def rotation(shares: dict[str, float], length: int = 100) -> list[str]:
    """A smooth weighted rotation: after k steps each split has about k times its share.

    Shares are scaled to 1.  A split with share 0 never occurs.
    """
    total = sum(shares.values())
    if not shares or total <= 0 or min(shares.values()) < 0:
        raise ValueError("shares must be positive")
    credit = dict.fromkeys(shares, 0.0)
    out = []
    for _ in range(length):
        for s in shares:
            credit[s] += shares[s] / total
        best = max(shares, key=lambda s: (credit[s], shares[s]))
        credit[best] -= 1
        out.append(best)
    return out


def deal_roots(sizes: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """(root, band, split) from (root, size): systematic dealing within bands of size."""
    base = sizes.select("root", F.floor(F.log2(F.greatest(F.col("size"), F.lit(1)))).cast("int").alias("band"), F.xxhash64(F.lit(seed), "root").alias("h"))
    base = base.withColumn("bucket", F.pmod("h", F.lit(BUCKETS)).cast("int"))
    counts = base.groupBy("band", "bucket").agg(F.count("*").alias("n"))
    # At most BUCKETS rows in each of some 40 bands, whatever the data's size.
    before = counts.select("band", "bucket", (F.sum("n").over(W.partitionBy("band").orderBy("bucket")) - F.col("n")).alias("before"))
    rank = F.row_number().over(W.partitionBy("band", "bucket").orderBy("h", "root")) - 1
    cycle = rotation(shares)
    names = F.array(*[F.lit(s) for s in cycle])
    at = (F.col("before") + F.col("rank")) % len(cycle)
    return base.withColumn("rank", rank).join(before, ["band", "bucket"]).select("root", "band", F.element_at(names, (at + 1).cast("int")).alias("split"))


def assign_splits(rows: DataFrame, manifests: DataFrame, shares: dict[str, float], seed: int = 0) -> DataFrame:
    """Every row of ``rows`` with its split and the first page of its work.

    ``rows``: ``row_table``, ``row_id``, ``region_id``, ``page_id``.  Result: ``row_table``,
    ``row_id``, ``page_id`` (official spelling), ``group_page_id``, ``split``.  Pages without
    any link are works of one page.  Rows whose page id carries no number are a work of
    their own each by row and have null pages.  Repeated rows stay repeated.
    """
    labels, _ = spanning_forest(page_edges(manifests, rows.select("region_id", "page_id")))
    own = rows.select("row_table", "row_id", page_number(F.col("page_id")).alias("page"))
    rooted = own.join(labels, "page", "left").withColumn("root", F.coalesce("root", "page", -1 - F.pmod(F.xxhash64("row_table", "row_id"), F.lit(2**62))))
    rooted = cut(rooted)
    dealt = deal_roots(rooted.groupBy("root").agg(F.count("*").alias("size")), shares, seed)
    out = rooted.join(dealt, "root").select("row_table", "row_id", F.col("page").alias("page_id"), F.when(F.col("page").isNotNull(), F.col("root")).alias("group_page_id"), "split")
    official = official_spelling(manifests)
    return spelled(spelled(out, official, "page_id"), official, "group_page_id").select("row_table", "row_id", "page_id", "group_page_id", "split")
