"""Chapters cut into ordered pieces within a size limit, by content-defined boundaries.

A piece ends where a rolling hash over the last code points has its least value between the
minimum and maximum size (a landmark that depends on the text alone), snapped to the nearest
natural boundary of the best kind found there: the end of a page, else of a region, else of
a sentence, else the landmark itself.  An edit moves only the boundaries next to it.

A chapter may hold a third of all regions, so it isn't one group.  Hard landmarks (pages
whose id's hash is 0 modulo SEGMENT_PAGES) divide it into segments that are cut on their own;
pages of more than DENSE_REGIONS regions are divided again by blocks of the region order.
The last pages with regions before a start, listed or not, come along as context rows to be
repeated there; of dense pages the last blocks, and a block's start repeats the block before.  Chapters within their limit
are one piece and never leave the JVM.

Defined results: the valid version of a region is the row with the greatest ``updated_at``
(repeated rows tie and count once); rows without a region id are regions of their own; null
text has size 0 and gives an empty fragment, so every region lies in some piece; null
``region_order`` sorts last; a null or non-positive ``max_chars`` is no limit; pages missing
from the manifest follow the listed ones, each a segment of its own; a chapter without a
manifest has no limit.  Repeated pages are counted in the limit and may take all of it but one
part in NEW_PART for new text; of a page that doesn't fit the tail is repeated, from the first
region or sentence that does, else from within a sentence; pages before it are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from leafgauge.session import cut

SEGMENT_PAGES = 16
DENSE_REGIONS = 2000
ORDER_BLOCK = 512
HASH_WIDTH = 16
NEW_PART = 8
SENTENCE_ENDS = "。．.！!？?…\n"
_FAR = 1 << 40

FRAGMENTS = (
    "chapter_id string, seg long, block long, local_piece int, page_no long, page_id string, region_id string, "
    "fragment_no int, start_char int, end_char int, repeated boolean, fragment_text string"
)


def valid_regions(regions: DataFrame) -> DataFrame:
    """The valid version of each region: region_id, chapter_id, page_id, region_order, source_text."""
    key = F.coalesce("region_id", F.concat(F.lit("row:"), F.col("row_id").cast("string")))
    picked = F.struct("region_id", "chapter_id", "page_id", "region_order", "source_text")
    return regions.groupBy(key.alias("region_key")).agg(F.max_by(picked, F.struct("updated_at", "row_id")).alias("r")).select("region_key", "r.*")


def _rolling(points: np.ndarray) -> np.ndarray:
    """A hash of the HASH_WIDTH code points that end at each position."""
    out = np.zeros(len(points), np.uint64)
    padded = np.concatenate([np.zeros(HASH_WIDTH, np.uint64), points.astype(np.uint64) + np.uint64(1)])
    for k in range(HASH_WIDTH):
        out += padded[HASH_WIDTH - k : len(padded) - k] * np.uint64(pow(0x9E3779B97F4A7C15, k, 1 << 64))
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def cut_points(points: np.ndarray, level: np.ndarray, limit: int, overlap_of) -> Iterator[tuple[int, int, int]]:
    """(start, end, overlap) of the pieces of one segment.

    ``level[i]``: 0 to 3, the kind of the boundary after code point i.  ``overlap_of(start,
    previous start, room)``: size of what is repeated before ``start`` in at most ``room``.
    """
    n, s, before = len(points), 0, 0
    h = _rolling(points)
    while True:
        repeat = overlap_of(s, before, limit - max(1, limit // NEW_PART))
        room = max(1, limit - repeat)
        if n - s <= room:
            yield s, n, repeat
            return
        low, high = s + max(1, room // 2), s + room  # the piece ends after high code points at most
        mark = low + int(np.argmin(h[low - 1 : high]))
        kinds = level[low - 1 : high]
        best = kinds.max()
        end = mark
        if best > 0:
            at = np.flatnonzero(kinds == best) + low
            end = int(at[np.argmin(np.abs(at - mark))])
        yield s, end, repeat
        before, s = s, end


def _cut_segment(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.assign(o=pdf["region_order"].fillna(np.inf)).sort_values(["page_no", "null_block", "o", "region_key"], kind="stable")
    texts = pdf["source_text"].fillna("").astype(str).tolist()
    first = pdf.iloc[0]
    limit, wanted = int(first["max_chars"]), int(max(0, first["overlap_pages"]))
    context = pdf["context"].to_numpy()
    pages = pdf["page_no"].to_numpy()
    sizes = np.array([len(t) for t in texts], np.int64)
    old = int(context.sum())  # context rows come first, their pages stand before the segment
    points = np.frombuffer("".join(texts[old:]).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(sizes[old:])
    begins = ends - sizes[old:]
    level = np.isin(points, [ord(c) for c in SENTENCE_ENDS]).astype(np.int8)
    own_pages = pages[old:]
    last_of_page = np.append(own_pages[1:] != own_pages[:-1], True)
    full = ends > 0
    level[ends[full] - 1] = np.maximum(level[ends[full] - 1], 2)
    level[ends[last_of_page & full] - 1] = 3
    context_spans = [(i, 0, int(sizes[i])) for i in range(old)]

    def spans(a: int, b: int, last: bool) -> list[tuple[int, int, int]]:
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(begins, b, "left")
        while lo > 0 and ends[lo - 1] == a and begins[lo - 1] == a:
            lo -= 1
        empty_tail = np.searchsorted(begins, b, "right") if last else hi
        out = [(old + i, int(max(a - begins[i], 0)), int(min(b, ends[i]) - begins[i])) for i in range(lo, max(hi, empty_tail))]
        return [x for x in out if x[2] > x[1] or sizes[x[0]] == 0]

    chosen: dict[int, list[tuple[int, int, int]]] = {}

    def tail(part: list[tuple[int, int, int]], room: int) -> list[tuple[int, int, int]]:
        """The end of a page part in at most ``room``."""
        out: list[tuple[int, int, int]] = []
        for i, a, b in reversed(part):
            if b - a > room:
                at = next((k for k in range(b - room, b) if texts[i][k - 1] in SENTENCE_ENDS), b if out else b - room)
                return [(i, at, b), *out] if at < b else out
            out = [(i, a, b), *out]
            room -= b - a
        return out

    def overlap_of(s: int, before: int, room: int) -> int:
        source = context_spans if s == 0 else spans(before, s, False)
        taken: list[tuple[int, int, int]] = []
        used, seen = 0, []
        for page in dict.fromkeys(pages[i] for i, _, _ in reversed(source)):
            part = [x for x in source if pages[x[0]] == page]
            size = sum(b - a for _, a, b in part)
            if len(seen) == wanted:
                break
            if used + size > room:
                part = tail(part, room - used)
                used += sum(b - a for _, a, b in part)
                taken = part + taken
                break
            seen.append(page)
            used += size
            taken = part + taken
        chosen[s] = taken
        return used

    rows, given = [], np.zeros(len(texts), bool)
    for k, (a, b, _) in enumerate(cut_points(points, level, limit, overlap_of)):
        fresh = [x for x in spans(a, b, b == len(points)) if sizes[x[0]] or not given[x[0]]]
        for x in fresh:
            given[x[0]] = True
        rows += [(k, j, *x, True) for j, x in enumerate(chosen[a])]
        rows += [(k, len(chosen[a]) + j, *x, False) for j, x in enumerate(fresh)]
    at = [r[2] for r in rows]
    return pd.DataFrame({
        "chapter_id": first["chapter_id"], "seg": first["seg"], "block": first["block"], "local_piece": [r[0] for r in rows], "page_no": pages[at], "page_id": pdf["page_id"].to_numpy()[at],
        "region_id": pdf["region_id"].to_numpy()[at], "fragment_no": [r[1] for r in rows], "start_char": [r[3] for r in rows], "end_char": [r[4] for r in rows],
        "repeated": [r[5] for r in rows], "fragment_text": [texts[r[2]][r[3] : r[4]] for r in rows],
    })


def split_oversized(regions: DataFrame, manifests: DataFrame) -> DataFrame:
    """Fragments of all pieces of all chapters (columns FRAGMENTS and ``max_chars``).

    A piece is (chapter_id, seg, block, local_piece), in that order within its chapter; its
    text is its fragments in the order of ``fragment_no``.  ``repeated`` marks what the
    previous piece holds too.
    """
    # Read three times below: once for sizes, once for each way through.
    valid = cut(valid_regions(regions))
    limits = manifests.select("chapter_id", F.when(F.col("max_chars") > 0, F.col("max_chars")).alias("max_chars"), F.coalesce("overlap_pages", F.lit(0)).alias("overlap_pages"))
    # A chapter's page list is one record of the manifest, so this window holds no more than one input record.
    listed = manifests.select("chapter_id", F.posexplode("source_files").alias("page_no", "f")).select("chapter_id", F.col("page_no").cast("long"), F.col("f.page_id").alias("page_id"))
    listed = listed.where("page_id is not null").groupBy("chapter_id", "page_id").agg(F.min("page_no").alias("page_no"))
    hard = F.pmod(F.xxhash64("page_id"), F.lit(SEGMENT_PAGES)) == 0
    running = W.partitionBy("chapter_id").orderBy("page_no").rowsBetween(W.unboundedPreceding, 0)
    listed = listed.withColumn("seg", F.coalesce(F.max(F.when(hard, F.col("page_no"))).over(running), F.lit(0)))

    size = F.coalesce(F.length("source_text"), F.lit(0))
    page_sums = valid.groupBy("chapter_id", "page_id").agg(F.sum(size).alias("page_size"), F.count("*").alias("page_regions"))
    over = page_sums.groupBy("chapter_id").agg(F.sum("page_size").alias("chapter_size")).join(limits, "chapter_id").where("chapter_size > max_chars")
    over = over.select("chapter_id", "max_chars", "overlap_pages")
    null_safe = (F.col("page_id").eqNullSafe(F.col("l_page")))
    pages = page_sums.join(over, "chapter_id").join(listed.select("chapter_id", F.col("page_id").alias("l_page"), "page_no", "seg").withColumnRenamed("chapter_id", "l_chapter"), (F.col("chapter_id") == F.col("l_chapter")) & null_safe, "left")
    unlisted = F.lit(_FAR) + F.pmod(F.xxhash64(F.coalesce("page_id", F.lit(""))), F.lit(_FAR))
    pages = pages.select("chapter_id", "page_id", "max_chars", "overlap_pages", (F.col("page_regions") > DENSE_REGIONS).alias("dense"), F.coalesce("page_no", unlisted).alias("page_no"), F.coalesce("seg", unlisted).alias("seg"))
    # A dense page is a segment of its own, and what follows it starts another.
    pages = pages.withColumn("seg", F.when(F.col("dense"), F.col("page_no")).otherwise(F.greatest("seg", F.coalesce(F.max(F.when(F.col("dense"), F.col("page_no") + 1)).over(running), F.lit(0)))))
    placed = pages.withColumnsRenamed({"chapter_id": "p_chapter", "page_id": "p_page"})

    rows = valid.join(placed, (F.col("chapter_id") == F.col("p_chapter")) & F.col("page_id").eqNullSafe(F.col("p_page"))).drop("p_chapter", "p_page")
    null_block = F.when(F.col("region_order").isNull() & F.col("dense"), F.pmod(F.xxhash64("region_key"), F.lit(ORDER_BLOCK))).otherwise(-1)
    rows = rows.withColumn("null_block", null_block)
    block = F.when(~F.col("dense"), 0).when(F.col("null_block") >= 0, F.lit(_FAR) + F.col("null_block")).otherwise(F.floor(F.col("region_order") / ORDER_BLOCK))
    rows = rows.withColumn("block", block.cast("long")).withColumn("context", F.lit(False))
    rows = cut(rows)
    # Units are pages with regions, and the blocks of dense pages; the last of them before each start come along.
    units = rows.where("overlap_pages > 0").groupBy("chapter_id", "page_id", "overlap_pages", "page_no", "seg", "block").agg(F.count("*").alias("regions"))
    units = units.withColumn("unit", F.row_number().over(W.partitionBy("chapter_id").orderBy("page_no", "page_id", "block")))
    starts = units.groupBy("chapter_id", "seg", "block").agg(F.min("unit").alias("from_unit"))
    before = units.select(F.col("chapter_id").alias("u_chapter"), F.col("page_id").alias("u_page"), F.col("block").alias("u_block"), "unit", F.explode(F.sequence(F.lit(1), "overlap_pages")).alias("j"))
    starts = starts.select(F.col("chapter_id").alias("s_chapter"), F.col("seg").alias("s_seg"), F.col("block").alias("s_block"), "from_unit")
    before = before.join(starts, (F.col("u_chapter") == F.col("s_chapter")) & (F.col("unit") + F.col("j") == F.col("from_unit"))).select("u_chapter", "u_page", "u_block", "s_seg", "s_block")
    repeated = rows.join(before, (F.col("chapter_id") == F.col("u_chapter")) & F.col("page_id").eqNullSafe(F.col("u_page")) & (F.col("block") == F.col("u_block")))
    repeated = repeated.withColumns({"seg": F.col("s_seg"), "block": F.col("s_block"), "context": F.lit(True)}).select(*rows.columns)
    rows = rows.unionByName(repeated)
    cut_rows = rows.groupBy("chapter_id", "seg", "block").applyInPandas(_cut_segment, FRAGMENTS)

    whole = valid.join(over.select("chapter_id"), "chapter_id", "left_anti")
    order = F.row_number().over(W.partitionBy("chapter_id", "page_id").orderBy(F.col("region_order").asc_nulls_last(), "region_key")) - 1
    whole = whole.join(listed.select(F.col("chapter_id").alias("l_chapter"), F.col("page_id").alias("l_page"), "page_no"), (F.col("chapter_id") == F.col("l_chapter")) & null_safe, "left").select(
        "chapter_id", F.lit(0).cast("long").alias("seg"), F.lit(0).cast("long").alias("block"), F.lit(0).alias("local_piece"), F.coalesce("page_no", unlisted).alias("page_no"), "page_id", "region_id",
        order.alias("fragment_no"), F.lit(0).alias("start_char"), size.cast("int").alias("end_char"), F.lit(False).alias("repeated"), F.coalesce("source_text", F.lit("")).alias("fragment_text"),
    )
    return cut_rows.unionByName(whole).join(limits.select(F.col("chapter_id").alias("m_chapter"), "max_chars"), F.col("chapter_id") == F.col("m_chapter"), "left").drop("m_chapter")


def numbered_pieces(fragments: DataFrame) -> DataFrame:
    """(chapter_id, piece_no, page_from, page_to, piece_size, repeated_size, fragments) in reading order.

    Pieces are counted by segment first; the running sum goes over a chapter's segments, which
    are no more than its listed pages.
    """
    key = ["chapter_id", "seg", "block"]
    pieces = fragments.groupBy(*key, "local_piece").agg(
        F.min("page_no").alias("page_from"), F.max("page_no").alias("page_to"), F.sum(F.col("end_char") - F.col("start_char")).alias("piece_size"),
        F.sum(F.when(F.col("repeated"), F.col("end_char") - F.col("start_char")).otherwise(0)).alias("repeated_size"), F.count("*").alias("fragments"),
    )
    per = pieces.groupBy(*key).agg((F.max("local_piece") + 1).alias("n"))
    base = per.select(*key, (F.sum("n").over(W.partitionBy("chapter_id").orderBy("seg", "block")) - F.col("n")).alias("base"))
    return pieces.join(base.withColumnsRenamed({k: f"b_{k}" for k in key}), F.col("chapter_id").eqNullSafe(F.col("b_chapter_id")) & (F.col("seg") == F.col("b_seg")) & (F.col("block") == F.col("b_block"))).select(
        "chapter_id", (F.col("base") + F.col("local_piece")).cast("long").alias("piece_no"), "page_from", "page_to", "piece_size", "repeated_size", "fragments"
    )


def items_over_limit(fragments: DataFrame) -> DataFrame:
    """(item_level, item_id) of chapters, pages and regions whose fragments exceed their chapter's limit."""
    new = fragments.where("not repeated").select("chapter_id", "page_id", "region_id", "max_chars", (F.col("end_char") - F.col("start_char")).alias("n"))
    region = new.groupBy("chapter_id", "page_id", "region_id", "max_chars").agg(F.sum("n").alias("n"))
    page = region.groupBy("chapter_id", "page_id", "max_chars").agg(F.sum("n").alias("n"))
    chapter = page.groupBy("chapter_id", "max_chars").agg(F.sum("n").alias("n"))
    parts = [(chapter, "chapter", "chapter_id"), (page, "page", "page_id"), (region, "region", "region_id")]
    found = [df.where(f"n > max_chars and {c} is not null").select(F.lit(level).alias("item_level"), F.col(c).alias("item_id")) for df, level, c in parts]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()
