"""Scores for abusive, hateful and sexual language in whole documents.

A text is cut into sentences; a sentence is the bag of its hashed character n-grams (one to
five letters, between word ends).  Each n-gram has a vector; the average of a sentence's
vectors goes through a linear softmax over (none, abusive, hateful, sexual).  Vectors and
softmax are trained jointly in numpy on a bounded sample of labelled texts, so unseen
spellings are judged by the n-grams they share with known ones.  Before that the text is brought
to its canonical form and common disguises are undone by rule: letters drawn alike, invisible
characters, digits for letters inside words, separators between single letters.

How common each n-gram is, is counted over all sentences of all documents.  An n-gram weighs
the more in the average the rarer it is, and rare n-grams share one trained back-off
(the part of any n-gram that no label shows), so wording that no label shows is judged too.
Counts are kept per group of sources and the group that uses an n-gram most doesn't count, so
what a single source says over and over stays rare.

A labelled text may hold one telling sentence among harmless ones.  Training therefore goes
in rounds: the label goes to the text's sentence of the rarest wording, then to the one that the
model of the round before holds most telling; the rest count as none.  Labels may be wrong: texts
whose label the models trained without them (by folds) contradict don't train.

The threshold lies where the counts of the corpus' sentences, sorted by their score, stop falling
steeply above the bulk of harmless ones.  Which category a found sentence has is settled over all
finds: n-grams take the categories of the surely judged finds that hold them, in a few passes of counts.
The same passes count how large a part of each n-gram's occurrences lies in found sentences.  That share moves
the finds' scores, as far as other sentences hold their n-grams: of a wording that is mostly found the rest is found too,
and short names whose n-grams stand in harmless sentences everywhere drop out.

A document's score for a category is the greatest of its sentences; a document uses the
category when the score reaches the threshold.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgauge.llm.canonical import canonical_array, slices
from leafgauge.session import cut

CATEGORIES = ("abusive", "hateful", "sexual")
BUCKET_BITS = 18
BUCKETS = 1 << BUCKET_BITS
#: So many letters are scored at once.
RUN_CHARS = 200_000
GRAMS = (1, 2, 3, 4, 5)
SIZE = 12
#: So many n-grams without meaning are averaged in, so a few words alone don't weigh too much.
SHRINK = 15
STEPS = 120
DECAY = 0.02
#: At most so many labelled texts are read for training, the first by label_id.
MAX_LABELLED = 20_000
#: An n-gram that occurs in this part of the sentences is half rare; and has 0.7 of the weight of a rare one.
RARE = 7e-5
COMMON = 3e-4
#: Groups of sources whose counts are kept apart.
SOURCE_GROUPS = 8
#: Counts travel in pieces of so many buckets.
PIECE = 512
#: A label is taken for wrong where the models trained without the text score it as this part of harmless sentences and its wording is
#: as common as this part of theirs; that of a harmless text where they give more than SURE.
QUANTILE = 0.8
USUAL = 0.9
SURE = 0.5
#: Sentences are counted in bins of this width of log-odds.
BIN = 0.25
#: Above the bin from which this part of all sentences lies, the bulk of harmless ones ends where a bin's count is more than FALL of the bin's below.
TAIL = 0.02
FALL = 0.35
#: The tail's first bin needs so many sentences to say anything.
LEAST_BULK = 30
#: Bin from which on sentences are kept as finds; their threshold is no lower.
FLOOR = -10
#: Passes over the finds, share from which a find is surely judged, weight of the finds' n-grams, and their smoothing.
PASSES = 4
JUDGED = 0.7
LEAN = 9.0
SMOOTH = 0.3
#: So many occurrences of no meaning are added to an n-gram's; log-ratio of an n-gram's share in finds to all n-grams' from which it speaks for a find;
#: and so many n-grams without meaning are averaged in.
KNOWN = 10
CENTRE = 2.0
NAMELESS = 3
FOLDS = 3
SEED = 7
#: The last round is fitted so many times from other starts and averaged.
STARTS = 2

_SENTENCE = re.compile(r"[^。.!?\n]+[。.!?\n]*")
_WIDE = r"⺀-鿿豈-﫿"
# Digits and signs written for letters.
_LEET = str.maketrans("013457@$", "oieastas")
_LEET_WORD = re.compile(r"(?<![a-z0-9@$*])(?=[a-z0-9@$*]*[a-z])(?=[a-z0-9@$*]*[013457@$])[a-z0-9@$*]+(?![a-z0-9@$*])")
_SPACED = re.compile(r"(?<![a-z0-9])(?:[a-z0-9@$][ .\-_*])(?:[a-z0-9@$*][ .\-_]){2,}[a-z0-9@$](?![a-z0-9])")
_WIDE_GAP = re.compile(rf"(?<=[{_WIDE}])[ .·*_〇○+~\-]+(?=[{_WIDE}])")


def _plain(text: str) -> str:
    low = text.lower()
    low = _SPACED.sub(lambda m: re.sub(r"[ .\-_]", "", m[0]), low)
    return _LEET_WORD.sub(lambda m: m[0].translate(_LEET), low)


def sentences(column: pa.Array) -> tuple[list[str], np.ndarray]:
    """Sentences of all texts in readable canonical form, and the row of each."""
    # Line breaks end sentences: they become full stops before white space is folded.
    lines = pc.replace_substring_regex(column.cast(pa.string()), pattern=r"\n+", replacement=" \n. ")
    parts: list[str] = []
    rows: list[int] = []
    for i, t in enumerate(canonical_array(lines, keep_space=True).to_pylist()):
        if not t:
            continue
        for m in _SENTENCE.finditer(_protect(t)):
            whole = m[0].strip(" .\x00")
            said = _SPEAKER.match(whole)
            # What stands before a colon is mostly a name; it is a sentence of its own.
            for s in (whole,) if said is None else (said[1], whole[said.end() :]):
                if s:
                    parts.append(_WIDE_GAP.sub("", s.replace("\x00", ".")))
                    rows.append(i)
    return parts, np.array(rows, np.int64)


_SPEAKER = re.compile(r"^([^:]{1,16}): ?(?=.)")
_DOT_INSIDE = re.compile(rf"(?<=[{_WIDE}])\.(?=[{_WIDE}])|(?<=\w)\.(?=\w)")


def _protect(text: str) -> str:
    """Undo disguises, keeping full stops inside words from ending a sentence."""
    return _plain(_DOT_INSIDE.sub("\x00", text)) if "." in text else _plain(text)


def _hashed(parts: list[str]):
    """For n from 1 to the greatest size: (n, bucket of the n-gram at each place, first place and number of n-grams of each sentence)."""
    text = "".join(f" {s} " for s in parts)
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    points[(points >= 48) & (points <= 57)] = 48
    size = np.fromiter((len(s) + 2 for s in parts), np.int64, len(parts))
    first = np.cumsum(size) - size
    h = np.full(len(points), 0x9E3779B97F4A7C15, np.uint64)
    for n in range(1, max(GRAMS) + 1):
        if len(points) < n:
            return
        h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * np.uint64(0x100000001B3)
        mixed = h ^ (h >> np.uint64(31))
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        yield n, (mixed >> np.uint64(64 - BUCKET_BITS)).astype(np.int64), first, np.maximum(size - n + 1, 0)


def grams(parts: list[str], sizes: tuple[int, ...] = GRAMS) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, sentence) of every n-gram of the sentences; digits count as one sign."""
    buckets, owners = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for n, bucket, first, count in _hashed(parts) if parts else ():
        if n in sizes:
            owner = np.repeat(np.arange(len(parts)), count)
            inner = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            buckets.append(bucket[np.repeat(first, count) + inner])
            owners.append(owner)
    return np.concatenate(buckets), np.concatenate(owners)


def _runs(parts: list[str]):
    """(begin, end) of runs of about RUN_CHARS letters."""
    begin, size = 0, 0
    for i, s in enumerate(parts):
        size += len(s) + 2
        if size >= RUN_CHARS or i == len(parts) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


@dataclass
class Rarity:
    """How rare each n-gram bucket is in the corpus: its part in the back-off, its weight in the average, and its occurrences."""

    back_off: np.ndarray
    weight: np.ndarray
    count: np.ndarray

    @classmethod
    def of(cls, frequency: np.ndarray, count: np.ndarray) -> Rarity:
        """From occurrences per sentence and all occurrences."""
        return cls((1 / (1 + frequency / RARE)).astype(np.float32), (1 / (1 + frequency / COMMON)).astype(np.float32) ** 0.5, count)


def count_grams(parts: list[str]) -> np.ndarray:
    """Occurrences of each n-gram bucket."""
    out = np.zeros(BUCKETS, np.int64)
    for begin, end in _runs(parts):
        for n, bucket, first, count in _hashed(parts[begin:end]):
            has = count > 0
            # Places that run over a sentence's end are none: the last n - 1 of each.
            ends = np.zeros(len(bucket) + 1, np.int64)
            np.add.at(ends, first[has], 1)
            np.add.at(ends, (first + count)[has], -1)
            out += np.bincount(bucket[np.cumsum(ends[:-1]) > 0], minlength=BUCKETS)
    return out


def trimmed_frequency(counts: np.ndarray, sentences_of: np.ndarray) -> np.ndarray:
    """Occurrences per sentence without the group that uses each n-gram most; ``counts`` is (groups, buckets).

    With fewer than three groups in use nothing is left out.
    """
    used = sentences_of > 0
    counts, sentences_of = counts[used], sentences_of[used].astype(float)
    if not len(counts):
        return np.zeros(BUCKETS)
    if len(counts) < 3:
        return counts.sum(0) / sentences_of.sum()
    top = (counts / sentences_of[:, None]).argmax(0)
    return (counts.sum(0) - counts[top, np.arange(counts.shape[1])]) / (sentences_of.sum() - sentences_of[top])


def _summed(pieces: DataFrame, length: int) -> np.ndarray:
    """Sum of arrays that tasks emit in pieces (piece long, data binary of int64); the sum reaches the driver."""

    def add(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                a = np.frombuffer(data, np.int64)
                held[piece] = held[piece] + a if piece in held else a
        yield _pieces(held)

    out = np.zeros(length, np.int64)
    for r in pieces.repartition("piece").mapInArrow(add, "piece long, data binary").collect():
        a = np.frombuffer(r.data, np.int64)
        out[r.piece * PIECE : r.piece * PIECE + len(a)] += a
    return out


def _pieces(held: dict[int, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(held), pa.int64()), pa.array([a.tobytes() for a in held.values()], pa.binary())], ["piece", "data"])


def _cut_array(a: np.ndarray) -> pa.RecordBatch:
    """The pieces of an array that aren't all zero."""
    parts = {i: a[i * PIECE : (i + 1) * PIECE] for i in range(-(-len(a) // PIECE))}
    return _pieces({i: p for i, p in parts.items() if p.any()})


def corpus_rarity(documents: DataFrame) -> Rarity:
    """Counts over all sentences of all documents (source, text), summed in the tasks before they travel."""

    def count(batches):
        total = np.zeros(SOURCE_GROUPS * (BUCKETS + PIECE), np.int64).reshape(SOURCE_GROUPS, -1)
        for batch in (part for whole in batches for part in slices(whole)):
            parts, rows = sentences(batch.column(1))
            group = batch.column(0).to_numpy(zero_copy_only=False)[rows] if parts else np.zeros(0, int)
            for g in np.unique(group):
                own = [parts[i] for i in np.flatnonzero(group == g)]
                total[g, :BUCKETS] += count_grams(own)
                total[g, BUCKETS] += len(own)
        yield _cut_array(total.ravel())

    keyed = documents.where("text is not null").select(F.pmod(F.xxhash64(F.coalesce(F.col("source").cast("string"), F.lit(""))), F.lit(SOURCE_GROUPS)).cast("int").alias("g"), "text")
    total = _summed(keyed.mapInArrow(count, "piece long, data binary"), SOURCE_GROUPS * (BUCKETS + PIECE)).reshape(SOURCE_GROUPS, -1)
    return Rarity.of(trimmed_frequency(total[:, :BUCKETS], total[:, BUCKETS]), total[:, :BUCKETS].sum(0))


class _Bags:
    """N-grams of sentences as index arrays, sorted both ways for segment sums."""

    def __init__(self, parts: list[str], rarity: Rarity):
        bucket, owner = grams(parts)
        order = np.argsort(owner, kind="stable")
        self.owner = owner[order]
        self.used, self.column = np.unique(bucket[order], return_inverse=True)
        self.count = (np.bincount(self.owner, minlength=len(parts)) + SHRINK).astype(np.float32)[:, None]
        self.first = np.searchsorted(self.owner, np.arange(len(parts)))
        self.back = np.argsort(self.column, kind="stable")
        self.first_back = np.searchsorted(self.column[self.back], np.arange(len(self.used)))
        self.weight = rarity.weight[self.used][:, None]
        self.rare = np.bincount(owner, weights=rarity.back_off[bucket], minlength=len(parts)).astype(np.float32)[:, None] / self.count

    def mean(self, vectors: np.ndarray) -> np.ndarray:
        return np.add.reduceat((vectors * self.weight)[self.column], self.first, axis=0) / self.count

    def spread(self, g: np.ndarray) -> np.ndarray:
        return self.weight * np.add.reduceat((g / self.count)[self.owner[self.back]], self.first_back, axis=0)


def _fit(parts: list[str], target: np.ndarray, weight: np.ndarray, rarity: Rarity, seed: int = SEED, rate: float = 0.08) -> np.ndarray:
    """Score table of vectors, back-off and softmax fitted to sentence targets by Adam; its last row is the bias."""
    rng = np.random.default_rng(seed)
    bags = _Bags(parts, rarity)
    vectors = rng.normal(0, 0.05, (len(bags.used), SIZE)).astype(np.float32)
    linear = rng.normal(0, 0.5, (SIZE, 4)).astype(np.float32)
    bias = np.zeros((1, 4), np.float32)
    rare = np.zeros((1, 1), np.float32)
    params = (vectors, linear, bias, rare)
    state = [(np.zeros_like(a), np.zeros_like(a)) for a in params]
    w = (weight / weight.sum())[:, None].astype(np.float32)
    for t in range(1, STEPS + 1):
        mean = bags.mean(vectors)
        z = mean @ linear + bias
        z[:, :1] += bags.rare * rare
        p = np.exp(z - z.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        g = (p - target) * w
        grads = (bags.spread(g @ linear.T) + DECAY * vectors / len(parts), mean.T @ g + 1e-4 * linear, g.sum(0, keepdims=True), (bags.rare * g[:, :1]).sum(0, keepdims=True))
        for a, d, (m, v) in zip(params, grads, state):
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            a -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    table = np.zeros((BUCKETS + 1, 4), np.float32)
    table[bags.used] = (vectors * bags.weight) @ linear
    table[:BUCKETS, 0] += rarity.back_off * rare[0, 0]
    table[BUCKETS] = bias
    return table


def _sums(table: np.ndarray, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sum of each sentence's rows of ``table`` and its number of n-grams, in runs of bounded size."""
    z = np.zeros((len(parts), table.shape[1]))
    total = np.zeros((len(parts), 1))
    for begin, end in _runs(parts):
        for n, bucket, first, count in _hashed(parts[begin:end]):
            has = np.flatnonzero(count > 0)
            if n not in GRAMS or not len(has):
                continue
            # Sums from each sentence's first place to its last; those between, across sentences, are skipped.
            rows = np.append(table[bucket], np.zeros((1, table.shape[1]), table.dtype), axis=0)
            edges = np.stack([first[has], first[has] + count[has]], 1).ravel()
            z[begin + has] += np.add.reduceat(rows, edges, axis=0)[::2]
            total[begin + has, 0] += count[has]
    return z, total


def _sentence_scores(table: np.ndarray, parts: list[str]) -> np.ndarray:
    """Softmax (none and the categories) of each sentence."""
    z, total = _sums(table[:BUCKETS], parts)
    z = z / (total + SHRINK) + table[BUCKETS]
    p = np.exp(z - z.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


@dataclass
class Moderator:
    """The fitted table, the rarity of n-grams, the threshold, the finds' n-gram categories and their n-grams' occurrences."""

    table: np.ndarray
    rarity: Rarity
    threshold: float = 2.0
    lean: np.ndarray | None = None
    hits: np.ndarray | None = None
    thresholds: tuple[float, ...] = field(init=False)

    def __post_init__(self):
        self.thresholds = (self.threshold,) * 3

    def judged(self, parts: list[str], p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of sentences with softmax ``p``: the probability of any category (sentences, 1), and how the categories share it (sentences, 3)."""
        some = 1 - p[:, :1]
        z = np.log(np.maximum(p[:, 1:], 1e-9))
        if self.lean is not None and len(parts):
            rare = self.rarity.back_off[:, None]
            sums, _ = _sums(np.column_stack([rare, self.lean * rare, self._telling() * rare]).astype(np.float32), parts)
            z = z + LEAN * sums[:, 1:4] / (sums[:, :1] + 3)
            # A sentence that was found from the start doesn't speak for itself.
            own = np.where(some >= self.threshold, sums[:, 5:6], sums[:, 4:5])
            moved = sums[:, 6:] / np.maximum(sums[:, :1], 1e-9) * (own / (sums[:, :1] + NAMELESS) - CENTRE)
            some = 1 / (1 + np.maximum(p[:, :1], 1e-12) / np.maximum(some, 1e-12) * np.exp(-moved))
        q = np.exp(z - z.max(1, keepdims=True))
        return some, q / q.sum(1, keepdims=True)

    def _telling(self) -> np.ndarray:
        """Per n-gram: log-ratio of its share in finds to all n-grams', the same without one find of its own, and how far it is known from other sentences."""
        other = np.maximum(self.rarity.count - 1, 0)
        base = max(self.hits.sum() / max(self.rarity.count.sum(), 1), 1e-9)
        share = [np.log((np.clip(h, 0, other) / base + KNOWN) / (other + KNOWN)) for h in (self.hits, self.hits - 1)]
        return np.column_stack([*share, other / (other + KNOWN)])

    def sentence_scores(self, parts: list[str]) -> np.ndarray:
        """(sentences, 3): the probability of any category, given to the one or two that hold most of it."""
        return self.given(parts, _sentence_scores(self.table, parts))

    def given(self, parts: list[str], p: np.ndarray) -> np.ndarray:
        """The scores of sentences with softmax ``p``; those of categories that hold little stay below the threshold."""
        some, share = self.judged(parts, p)
        return np.where(_most(share), some, share * np.minimum(some, self.threshold))

    def score(self, column: pa.Array) -> np.ndarray:
        """(rows, 3) scores; 0 for null and blank texts."""
        out = np.zeros((len(column), 3))
        parts, rows = sentences(column)
        if parts:
            p = self.sentence_scores(parts)
            for c in range(3):
                np.maximum.at(out[:, c], rows, p[:, c])
        return out


def _most(share: np.ndarray) -> np.ndarray:
    """The one or two categories of each sentence that hold most."""
    top = share.max(1, keepdims=True) if len(share) else share[:, :1]
    return (share >= 0.4) | (share == top)


def _given(some: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.where(_most(share), some, share * some)


def _rounds(parts: list[str], rows: np.ndarray, labels: np.ndarray, rarity: Rarity, rounds: int, starts: int = 1) -> np.ndarray:
    """Fit sentence targets from text labels, reassigning them between rounds; categories weigh nearly alike."""
    bucket, owner = grams(parts)
    number = np.bincount(owner, minlength=len(parts))
    order = -np.bincount(owner, weights=rarity.back_off[bucket], minlength=len(parts)) / (number + 5)
    table = None
    for k in range(rounds):
        if table is not None:
            order = _sentence_scores(table, parts)[:, 0]
        target = np.zeros((len(parts), 4), np.float32)
        target[:, 0] = 1
        for i in np.unique(rows):
            y = np.flatnonzero(labels[i])
            if len(y):
                at = np.flatnonzero(rows == i)
                telling = at[int(np.argmin(order[at]))]
                target[telling] = 0
                target[telling, y + 1] = 1 / len(y)
        positive = target[:, 0] < 0.5
        weight = np.ones(len(parts), np.float32)
        for c in (1, 2, 3):
            own = target[:, c] > 0
            if own.any():
                weight[own] *= (positive.sum() / own.sum()) ** 0.5
        for group in (positive, ~positive):
            if group.any():
                weight[group] *= 0.5 / weight[group].sum()
        table = np.mean([_fit(parts, target, weight, rarity, SEED + i) for i in range(starts if k == rounds - 1 else 1)], 0)
    return table


def fit_moderator(texts: list[str | None], labels: np.ndarray, rarity: Rarity | None = None) -> Moderator:
    """Train on labelled texts; ``labels`` is (n, 3) of 0 and 1.  Without ``rarity`` it is counted over the texts themselves.

    The model's threshold is the greatest held-out score of a harmless sentence; ``settled`` replaces it by the corpus'.
    """
    parts, rows = sentences(pa.array(texts, pa.string()))
    labels = np.asarray(labels).reshape(-1, 3) > 0
    if rarity is None:
        count = count_grams(parts)
        rarity = Rarity.of(count / max(len(parts), 1), count)
    if not parts or not labels.any():
        return Moderator(np.zeros((BUCKETS + 1, 4), np.float32), rarity)
    # Texts that say the same stay in one fold.
    _, same = np.unique([re.sub(r"\W+|\d+", "", t or "") for t in texts], return_inverse=True)
    fold = np.random.default_rng(SEED).integers(0, FOLDS, same.max() + 1)[same]
    held = np.zeros(len(parts))
    for k in range(FOLDS):
        train, test = np.flatnonzero(fold[rows] != k), np.flatnonzero(fold[rows] == k)
        if len(test) and len(train) and labels[rows[train]].any():
            table = _rounds([parts[j] for j in train], rows[train], labels, rarity, 1)
            held[test] = 1 - _sentence_scores(table, [parts[j] for j in test])[:, 0]
    most = np.zeros(len(texts))
    np.maximum.at(most, rows, held)
    labelled = labels.any(1)
    harmless = ~labelled[rows]
    bucket, owner = grams(parts)
    strange = np.bincount(owner, weights=rarity.back_off[bucket], minlength=len(parts)) / np.bincount(owner, minlength=len(parts))
    rarest = np.zeros(len(texts))
    np.maximum.at(rarest, rows, strange)
    doubt = np.zeros(len(texts), bool)
    if harmless.any():
        doubt = (most < np.quantile(held[harmless], QUANTILE)) & (rarest < np.quantile(strange[harmless], USUAL))
    wrong = (~labelled & (most > SURE)) | (labelled & doubt)
    good = np.flatnonzero(~wrong[rows])
    if not labels[rows[good]].any():
        good = np.arange(len(parts))
    table = _rounds([parts[j] for j in good], rows[good], labels, rarity, 2, STARTS)
    return Moderator(table, rarity, max(float(held[harmless & ~wrong[rows]].max(initial=0.0)), _odds(FLOOR)) + 1e-3)


def _odds(k: float) -> float:
    """Probability at the lower edge of bin ``k``."""
    return float(1 / (1 + np.exp(-k * BIN)))


def _bins(some: np.ndarray) -> np.ndarray:
    some = np.clip(some, 1e-9, 1 - 1e-9)
    return np.clip(np.floor(np.log(some / (1 - some)) / BIN), -100, 100).astype(np.int8)


def bulk_end(counts: dict[int, int]) -> int | None:
    """The bin that begins where the counts of the upper tail stop falling steeply; None for too few sentences."""
    total, above = sum(counts.values()), 0
    k = max(counts, default=0)
    while above + counts.get(k, 0) <= TAIL * total and k >= min(counts, default=0):
        above += counts.get(k, 0)
        k -= 1
    k += 1
    if counts.get(k, 0) < LEAST_BULK:
        return None
    while counts.get(k, 0) and counts.get(k + 1, 0) <= FALL * counts[k]:
        k += 1
    return k + 1


def train_moderator(labelled: DataFrame, documents: DataFrame, limit: int = MAX_LABELLED) -> Moderator:
    """Fit on at most ``limit`` labelled rows (sample_text, abusive, hateful, sexual), the first by label_id."""
    rows = labelled.where("sample_text is not null").orderBy("label_id").select("sample_text", *[F.coalesce(c, F.lit(0)).alias(c) for c in CATEGORIES]).limit(limit).collect()
    labels = np.array([[r[c] for c in CATEGORIES] for r in rows]).reshape(-1, 3)
    return fit_moderator([r.sample_text for r in rows], labels, corpus_rarity(documents))


_FINDS = "finds array<struct<sentence string, none double, abusive double, hateful double, sexual double>>"


def found_sentences(documents: DataFrame, model: Moderator) -> DataFrame:
    """Every document row: doc_id, source, the scores of its sentences below bin FLOOR, the bins of all, and the sentences from FLOOR on (``finds``).

    Null and blank texts have score 0 and no finds.  There is no shuffle.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    types = dict(documents.dtypes)
    schema = f"doc_id {types['doc_id']}, source {types['source']}, " + ", ".join(f"{c} double" for c in CATEGORIES) + ", bins array<tinyint>, " + _FINDS

    def run(batches):
        m = shared.value
        for batch in (part for whole in batches for part in slices(whole)):
            parts, rows = sentences(batch.column(2))
            p = _sentence_scores(m.table, parts)
            bins = _bins(1 - p[:, 0])
            hit = bins >= FLOOR
            low = np.zeros((batch.num_rows, 3))
            scores = _given(1 - p[~hit, :1], p[~hit, 1:] / np.maximum(p[~hit, 1:].sum(1, keepdims=True), 1e-9))
            for c in range(3):
                np.maximum.at(low[:, c], rows[~hit], scores[:, c])
            every = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows, np.arange(batch.num_rows + 1)), pa.int32()), pa.array(bins, pa.int8()))
            at = np.flatnonzero(hit)
            offsets = np.searchsorted(rows[at], np.arange(batch.num_rows + 1))
            finds = pa.StructArray.from_arrays([pa.array([parts[i] for i in at], pa.string()), *[pa.array(p[at, c]) for c in range(4)]], ["sentence", "none", *CATEGORIES])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(low[:, c]) for c in range(3)], every, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), finds)], ["doc_id", "source", *CATEGORIES, "bins", "finds"])

    return documents.select("doc_id", "source", "text").mapInArrow(run, schema)


def _find_batch(column: pa.Array) -> tuple[list[str], np.ndarray]:
    finds = column.flatten()
    return finds.field("sentence").to_pylist(), np.column_stack([finds.field(c).to_numpy(zero_copy_only=False) for c in ("none", *CATEGORIES)]) if len(finds) else np.zeros((0, 4))


def settled(found: DataFrame, model: Moderator) -> Moderator:
    """The model with the threshold that the corpus shows, and the categories and occurrences of the finds' n-grams.

    ``found`` should be cut, it is read PASSES + 1 times; only counts of bins and n-grams reach the driver.
    """
    bins = found.select(F.explode("bins").alias("bin")).groupBy("bin").count().collect()
    end = bulk_end({r["bin"]: r["count"] for r in bins})
    threshold = model.threshold if end is None else _odds(max(end, FLOOR))
    out = Moderator(model.table, model.rarity, threshold)
    telling = found.where(F.size("finds") > 0).select("finds")
    for _ in range(PASSES):
        shared = found.sparkSession.sparkContext.broadcast(out)

        def count(batches):
            m = shared.value
            total = np.zeros(4 * BUCKETS)
            for batch in (part for whole in batches for part in slices(whole)):
                parts, p = _find_batch(batch.column(0))
                some, q = m.judged(parts, p)
                hit = np.flatnonzero(some[:, 0] >= m.threshold)
                if not len(hit):
                    continue
                own, q = [parts[i] for i in hit], q[hit]
                q[q.max(1) < JUDGED] = 0
                q = np.column_stack([q, np.ones(len(q))])
                for begin, end in _runs(own):
                    bucket, owner = grams(own[begin:end])
                    for c in range(4):
                        total[c * BUCKETS : (c + 1) * BUCKETS] += np.bincount(bucket, weights=q[begin:end][owner, c], minlength=BUCKETS)
            yield _cut_array(np.round(total * 1000).astype(np.int64))

        counts = _summed(telling.mapInArrow(count, "piece long, data binary"), 4 * BUCKETS).reshape(4, BUCKETS).T / 1000
        counts, hits = counts[:, :3], counts[:, 3]
        size = counts.sum(0)
        each_as_large = counts / np.maximum(size, 1) * size.mean() + SMOOTH
        lean = np.log(each_as_large / each_as_large.sum(1, keepdims=True) * 3).astype(np.float32)
        out = Moderator(model.table, model.rarity, threshold, lean, hits)
    return out


def judged_documents(found: DataFrame, model: Moderator) -> DataFrame:
    """Every document row: doc_id, source and the scores ``abusive``, ``hateful``, ``sexual`` with flags ``is_*``."""
    shared = found.sparkSession.sparkContext.broadcast(model)
    types = dict(found.dtypes)

    def run(batches):
        m = shared.value
        for batch in (part for whole in batches for part in slices(whole)):
            s = np.column_stack([batch.column(2 + c).to_numpy(zero_copy_only=False) for c in range(3)]).copy()
            parts, p = _find_batch(batch.column(5))
            if parts:
                rows = np.repeat(np.arange(batch.num_rows), pc.list_value_length(batch.column(5)).to_numpy(zero_copy_only=False))
                scores = m.given(parts, p)
                for c in range(3):
                    np.maximum.at(s[:, c], rows, scores[:, c])
            flags = [pa.array(s[:, c] >= m.threshold) for c in range(3)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(s[:, c]) for c in range(3)], *flags], ["doc_id", "source", *CATEGORIES, *[f"is_{c}" for c in CATEGORIES]])

    schema = f"doc_id {types['doc_id']}, source {types['source']}, " + ", ".join([f"{c} double" for c in CATEGORIES] + [f"is_{c} boolean" for c in CATEGORIES])
    return found.select("doc_id", "source", *CATEGORIES, "finds").mapInArrow(run, schema)


def moderated(documents: DataFrame, labelled: DataFrame) -> DataFrame:
    """All documents judged by a model trained on ``labelled``; documents are read twice, once for counts."""
    model = train_moderator(labelled, documents)
    found = cut(found_sentences(documents, model))
    return judged_documents(found, settled(found, model))


def score_documents(documents: DataFrame, model: Moderator) -> DataFrame:
    """Every document row judged by a settled model: doc_id, source, scores and flags."""
    return judged_documents(found_sentences(documents, model), model)


def source_rates(scored: DataFrame) -> DataFrame:
    """Per source (null is a source): documents, and count and rate of each category."""
    sums = [F.count_if(F.col(f"is_{c}")).alias(f"{c}_documents") for c in CATEGORIES]
    rates = [(F.col(f"{c}_documents") / F.col("documents")).alias(f"{c}_rate") for c in CATEGORIES]
    return scored.groupBy("source").agg(F.count("*").alias("documents"), *sums).select("*", *rates)


def flagged_documents(scored: DataFrame) -> DataFrame:
    """Distinct (doc_id, category) for each category that a document uses."""
    pick = F.array_compact(F.array(*[F.when(F.col(f"is_{c}"), F.lit(c)) for c in CATEGORIES]))
    return scored.select("doc_id", F.explode(pick).alias("category")).distinct()
