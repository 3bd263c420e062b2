"""Evaluation items that leaked into a corpus, wholly or in part.

A prefix-filtered set join.  Item and document texts are reduced to the letters and digits
of their canonical form (case folded; spacing, line breaks, punctuation and the speaker names
at line starts are gone) and seen as sets of shingles, k letters each (by the item's script).

* Rarity: one pass over all documents counts in how many of them each item shingle occurs.
* Prefix: every window of two fifths of an item has T shingles, of which ``need`` must match
  for a leak with the allowed alterations.  A match of ``need`` shingles has at least
  ``PREFIX_HITS`` in common with the T - need + PREFIX_HITS rarest, so only those of each
  window are looked up and joined first; the rest only in the documents of the candidates.
* Bounds: pairs of documents too short for any window are left out (length); of the pairs that pass,
  all shingles are looked up and a diagonal band (position in the document minus position in
  the item) must hold ``need`` of them (position).
* Verification: seeds of a band are chained in order over the window; a leak is a stretch of
  at least two fifths of the item whose letters are covered to at least ``DENSITY``.

The items go to every task (they are a held-out set of a stated size: blocks of at most
``BLOCK_CHARS`` letters, one pass over the documents for each block), the documents stay
where they are: there is no shuffle of text and no pair that isn't a candidate.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgauge.llm.canonical import _code_points, canonical_array, slices

SHARE = 0.4
DENSITY = 0.72
PREFIX_HITS = 3
BLOCK_CHARS = 4_000_000
DRIFT = 14
GAP = 60
SHINGLE = {"wide": 5, "narrow": 12}
#: Letters that one altered word takes; one alteration is allowed for each so many letters.
WORD = {"wide": 3, "narrow": 7}
PER_ALTERATION = {"wide": 20, "narrow": 45}
SPEAKER = r"(?m)^[^\n:：]{1,16}[:：]"


@cache
def _letters() -> np.ndarray:
    """Case-folded code point of each letter or digit, 0 for everything else."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        ch = chr(cp)
        if unicodedata.category(ch)[0] in "LN":
            low = ch.casefold()
            table[cp] = ord(low) if len(low) == 1 else cp
    return table


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of a string array, and the row of each."""
    points, rows = _code_points(canonical_array(column))
    folded = _letters()[points]
    keep = folded > 0
    return folded[keep], rows[keep]


def shingle_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of the k code points from each position (shorter input: none)."""
    n = len(points) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    wide = points.astype(np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(k):
        out = out * np.uint64(0x100000001B3) + wide[i : i + n]
    out ^= out >> np.uint64(31)
    return out * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)


class ItemIndex:
    """Shingles of a block of items with their postings; grows with the items only."""

    def __init__(self, ids: list, texts: list[str]):
        column = pa.array(texts, pa.string())
        points, rows = letters(column)
        self.ids = ids
        self.size = np.bincount(rows, minlength=len(ids)).astype(np.int64)
        wide = np.bincount(rows, weights=points >= 0x2E80, minlength=len(ids)) * 2 >= self.size
        # An item of fewer letters than a shingle is one shingle as a whole: it leaks where it stands whole.
        self.k = np.minimum(np.where(wide, SHINGLE["wide"], SHINGLE["narrow"]), np.maximum(self.size, 1))
        self.sizes = np.unique(self.k[self.size > 0]).tolist()
        window = np.ceil(SHARE * self.size).astype(np.int64)
        self.window = window
        terms = np.maximum(window - self.k + 1, 1)
        lost = np.where(wide, np.maximum(1, window // PER_ALTERATION["wide"]) * (WORD["wide"] + SHINGLE["wide"] - 1), np.maximum(1, window // PER_ALTERATION["narrow"]) * (WORD["narrow"] + SHINGLE["narrow"] - 1))
        self.terms = terms
        self.need = np.maximum(np.maximum(terms - lost, np.ceil(DENSITY * window / self.k).astype(np.int64)), 1)
        tokens, items, positions = [], [], []
        start = np.cumsum(self.size) - self.size
        for i in range(len(ids)):
            h = shingle_hashes(points[start[i] : start[i] + self.size[i]], int(self.k[i]))
            tokens.append(h)
            items.append(np.full(len(h), i, np.int32))
            positions.append(np.arange(len(h), dtype=np.int32))
        token = np.concatenate([*tokens, np.zeros(0, np.uint64)])
        order = np.argsort(token, kind="stable")
        self.token = token[order]
        self.item = np.concatenate([*items, np.zeros(0, np.int32)])[order]
        self.position = np.concatenate([*positions, np.zeros(0, np.int32)])[order]
        self.distinct, self.begin = np.unique(self.token, return_index=True)
        self.end = np.append(self.begin[1:], len(self.token))
        self.prefix = np.ones(len(self.token), bool)
        self.in_prefix = np.ones(len(self.distinct), bool)

    def choose_prefixes(self, frequency: np.ndarray) -> None:
        """Mark the postings in the prefix of some window; ``frequency`` per distinct shingle."""
        rank_of = np.empty(len(self.distinct), np.int64)
        rank_of[np.lexsort((self.distinct, frequency))] = np.arange(len(self.distinct))
        rank = np.repeat(rank_of, self.end - self.begin)
        self.prefix = np.zeros(len(self.token), bool)
        by_item = np.lexsort((self.position, self.item))
        bounds = np.searchsorted(self.item[by_item], np.arange(len(self.ids) + 1))
        for i in range(len(self.ids)):
            at = by_item[bounds[i] : bounds[i + 1]]
            t = int(min(self.terms[i], len(at)))
            length = min(t, int(t - self.need[i] + PREFIX_HITS)) if t else 0
            for s in range(0, len(at) - t + 1):
                w = at[s : s + t]
                self.prefix[w[np.argpartition(rank[w], length - 1)[:length]] if length < t else w] = True
        self.in_prefix = np.logical_or.reduceat(self.prefix, self.begin) if len(self.token) else self.in_prefix

    def lookup(self, points: np.ndarray, rows: np.ndarray, prefix: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """(position in ``points``, index in ``distinct``) of every item shingle, or every one of a prefix, that lies within a row."""
        known = np.flatnonzero(self.in_prefix) if prefix else np.arange(len(self.distinct))
        tokens = self.distinct[known]
        where, which = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for k in self.sizes if len(tokens) else ():
            h = shingle_hashes(points, k)
            at = np.searchsorted(tokens, h)
            at[at == len(tokens)] = 0
            hit = np.flatnonzero((tokens[at] == h) & (rows[: len(h)] == rows[k - 1 :]))
            where.append(hit)
            which.append(known[at[hit]])
        return np.concatenate(where), np.concatenate(which)

    def postings(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of each posting of the shingles ``which``, and the index into ``which``."""
        n = self.end[which] - self.begin[which]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(self.begin[which], n) + inner, np.repeat(np.arange(len(which)), n)


def _stretch(dpos: np.ndarray, ipos: np.ndarray, k: int, window: int) -> tuple[int, int, int] | None:
    """The densest chain of seeds: (first letter, end, covered) in the item, or None below the bounds."""
    order = np.lexsort((ipos, dpos))
    chains: list[list] = []
    for d, i in zip(dpos[order].tolist(), ipos[order].tolist()):
        best, least = None, DRIFT + 1
        for c in reversed(chains):
            step, jump = d - c[0], i - c[1]
            if 0 < jump <= GAP + k and 0 < step <= GAP + k and abs(step - jump) < least:
                best, least = c, abs(step - jump)
                if least == 0:
                    break
        if best is None:
            chains.append([d, i, i, k, [(i, i + k)]])
            continue
        best[3] += min(k, i - best[1])
        if i <= best[4][-1][1]:
            best[4][-1] = (best[4][-1][0], i + k)
        else:
            best[4].append((i, i + k))
        best[0], best[1] = d, i
    answer = None
    for c in chains:
        runs = c[4]
        for a in range(len(runs)):  # any stretch of the chain, from run to run
            covered = 0
            for b in range(a, len(runs)):
                covered += runs[b][1] - runs[b][0]
                span = runs[b][1] - runs[a][0]
                if span >= window and covered >= DENSITY * span and (answer is None or covered > answer[2]):
                    answer = (runs[a][0], runs[b][1], covered)
    return answer


def _leaks(index: ItemIndex, column: pa.Array) -> list[tuple[int, int, float]]:
    """(row, item index, share of the item's letters in the stretch) of one batch."""
    points, rows = letters(column)
    where, which = index.lookup(points, rows, prefix=True)
    if not len(where):
        return []
    # Prefix join: only shingles of prefixes are looked up and only their postings are met.
    post, source = index.postings(which)
    own = np.flatnonzero(index.prefix[post])
    post, source = post[own], source[own]
    keys, counts = np.unique(rows[where[source]].astype(np.int64) * len(index.ids) + index.item[post], return_counts=True)
    item_of = keys % len(index.ids)
    lengths = np.bincount(rows, minlength=len(column))
    long_enough = lengths[keys // len(index.ids)] >= DENSITY * index.window[item_of]
    keys = keys[(counts >= np.minimum(PREFIX_HITS, index.need[item_of])) & long_enough]
    if not len(keys):
        return []
    # All shingles are looked up in the rows of the candidates alone.
    candidate = np.zeros(len(column), bool)
    candidate[keys // len(index.ids)] = True
    inside = candidate[rows]
    points, rows = points[inside], rows[inside]
    where, which = index.lookup(points, rows)
    post, source = index.postings(which)
    pair = rows[where[source]].astype(np.int64) * len(index.ids) + index.item[post]
    chosen = np.flatnonzero(np.isin(pair, keys))
    # Positional bound: enough distinct seeds in one of two overlapping series of diagonal bands.
    dpos, ipos, pair = where[source[chosen]].astype(np.int64), index.position[post[chosen]].astype(np.int64), pair[chosen]
    order = np.lexsort((dpos, pair))
    dpos, ipos, pair = dpos[order], ipos[order], pair[order]
    width = 4 * DRIFT
    good = np.zeros(len(pair), bool)
    for shift in (0, width // 2):
        band = (dpos - ipos + shift) // width
        sort = np.lexsort((band, pair))
        new = np.concatenate([[True], (pair[sort][1:] != pair[sort][:-1]) | (band[sort][1:] != band[sort][:-1])])
        group = np.cumsum(new) - 1
        size = np.bincount(group)
        ok = size[group] >= np.minimum(index.need[pair[sort] % len(index.ids)], index.terms[pair[sort] % len(index.ids)])
        good[sort[ok]] = True
    dpos, ipos, pair = dpos[good], ipos[good], pair[good]
    out = []
    keys, first = np.unique(pair, return_index=True)
    last = np.append(first[1:], len(pair))
    for key, a, b in zip(keys.tolist(), first.tolist(), last.tolist()):
        i = key % len(index.ids)
        found = _stretch(dpos[a:b], ipos[a:b], int(index.k[i]), int(index.window[i]))
        if found:
            out.append((key // len(index.ids), i, (found[1] - found[0]) / float(index.size[i])))
    return out


def _blocks(items: DataFrame) -> Iterator[tuple[list, list[str]]]:
    """The items' ids and texts in blocks of at most BLOCK_CHARS letters; the driver holds one block."""
    ids: list = []
    texts: list[str] = []
    size = 0
    texts_of = F.regexp_replace("item_text", SPEAKER, "").alias("item_text")
    for r in items.where("item_id is not null and item_text is not null").select("item_id", texts_of).distinct().orderBy("item_id").toLocalIterator():
        if ids and size + len(r.item_text) > BLOCK_CHARS:
            yield ids, texts
            ids, texts, size = [], [], 0
        ids.append(r.item_id)
        texts.append(r.item_text)
        size += len(r.item_text)
    if ids:
        yield ids, texts


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, leaked_share) for each document that holds a passage of an item.

    Speaker names at line starts count in neither table; an item of fewer letters than a shingle leaks where it stands whole.
    ``leaked_share``: part of the item's letters and digits that the longest leaked stretch
    spans.  Null texts hold nothing; items without letters leak nowhere; repeated rows of
    either table count once; items with the same text are reported each under its own id.
    Blocks of items are read from their table one after another, so a larger set only takes
    more passes over the documents.
    """
    spark = documents.sparkSession
    docs = documents.where("text is not null and doc_id is not null").select("doc_id", F.regexp_replace("text", SPEAKER, "").alias("text"))
    id_type = dict(items.dtypes)["item_id"]
    doc_type = dict(documents.dtypes)["doc_id"]
    found: list[DataFrame] = []
    for ids, texts in _blocks(items):
        index = spark.sparkContext.broadcast(ItemIndex(ids, texts))

        def count(batches, index=index):
            ix = index.value
            total = np.zeros(len(ix.distinct), np.int64)
            for batch in (part for whole in batches for part in slices(whole)):
                points, rows = letters(batch.column(0))
                where, which = ix.lookup(points, rows)
                seen = np.unique(rows[where].astype(np.int64) * len(ix.distinct) + which)
                total += np.bincount(seen % len(ix.distinct), minlength=len(ix.distinct)) if len(ix.distinct) else 0
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["token", "n"])

        frequency = np.zeros(len(index.value.distinct), np.int64)
        # One row for each shingle of the block at most.
        for r in docs.select("text").mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).toLocalIterator():
            frequency[r.token] = r.n
        chosen = index.value
        chosen.choose_prefixes(frequency)
        ready = spark.sparkContext.broadcast(chosen)

        def search(batches, ready=ready):
            ix = ready.value
            for batch in (part for whole in batches for part in slices(whole)):
                hits = _leaks(ix, batch.column(1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([ix.ids[i] for _, i, _ in hits], pa.int64() if id_type == "bigint" else None), batch.column(0).take(pa.array([r for r, _, _ in hits], pa.int64())), pa.array([s for _, _, s in hits], pa.float64())],
                    ["item_id", "doc_id", "leaked_share"],
                )

        found.append(docs.mapInArrow(search, f"item_id {id_type}, doc_id {doc_type}, leaked_share double"))
    if not found:
        return spark.createDataFrame([], f"item_id {id_type}, doc_id {doc_type}, leaked_share double")
    return reduce(DataFrame.unionByName, found).groupBy("item_id", "doc_id").agg(F.max("leaked_share").alias("leaked_share"))
