"""Broken source and answer pairs, each with its type of defect.

A multi-label linear classifier over hashed n-grams of the answer (whole and tail) and pair
features: how much of the source comes back, shares of the scripts, and how far the answer
falls short of the length to be expected from the source.  The expected length is a ridge
regression on the source's hashed n-grams.  Features of all pairs of a batch are worked out together
on code-point arrays.

Nothing is labelled by hand: sound pairs are a bounded sample of regions with their accepted
translation, and defects are made from them: cut answers, sources handed back, answers of other regions,
answers in other languages, refusals put together from single words, and nothing at all.  Harmless
changes (a missing full stop, a dropped particle, other width or spacing, quotes) are made too and stay
sound.  Thresholds are set on a held-out part of that set, one for each label.

Defects are exclusive; of several that reach their threshold the one with the greatest margin
counts, a refusal before what its language or length would make of it.  An exact check of the definitions follows
(see ``PairClassifier.defects``).
"""

from __future__ import annotations

import functools
import re
import sys
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafgauge.llm.canonical import canonical_array

DEFECTS = ("empty", "truncated", "refusal", "copy", "wrong_language")
#: The classifier learns answers of other regions, too; they are none of the defects asked for.
LABELS = (*DEFECTS, "swapped")
#: At most so many region pairs and so many foreign sentences train the classifier, the first by a hash.
MAX_PAIRS = 4000
MAX_FOREIGN = 2000
DIMENSIONS = 1 << 16
#: The upper half of the buckets holds n-grams of the whole answer.  They tell the labels of WORDED; what an answer is
#: about says nothing of the others, for which the pair features and the last letters speak.
GRAMS_FROM = DIMENSIONS // 2
WORDED = ("empty", "refusal")
LENGTH_DIMENSIONS = 3072
#: Passes over the training rows and updates of the weights, at least.
EPOCHS = 12
UPDATES = 180
BATCH = 1500
SEED = 11
COPIED = 0.7
#: From this share of kana on a text is Japanese.
KANA_SHARE = 0.25
#: So many letters are judged at once.
RUN_CHARS = 400_000
SOUND_WEIGHT = 20.0

_KANA = re.compile(r"[ぁ-ゖァ-ヺ]")
_WORD = re.compile(r"[^\W_]")
_HAN = re.compile(r"[㐀-鿿豈-﫿\U00020000-\U0003ffff]")

# Words that refusals are made of, by slot, in the languages that answers come in.  One word of each slot is taken;
# slots may be left out or change places.
REFUSAL_WORDS = {
    "zh": {
        "open": ("抱歉，", "对不起，", "不好意思，", "很遗憾，", "作为助手，", "作为AI，", ""), "who": ("我", "本助手", "我们", "系统", ""), "not": ("不能", "无法", "拒绝", "不便", "难以", "没办法", "不可以", "没法"),
        "do": ("翻译", "译出", "处理", "回答", "完成", "提供译文", "帮忙", "输出", "协助"), "which": ("这段", "该", "此类", "上述", "这句", "这个", "您的", "以上"), "what": ("内容", "文字", "文本", "句子", "台词", "请求", "原文", "话"),
        "why": ("，因为违规", "，涉及敏感", "，不合政策", "，有违规定", "，不适合", "，超出范围", "", ""), "end": ("。", "，请换一句。", "，请另选。", "，敬请谅解。", "！", ""),
    },
    "zh2": {
        "which": ("这段", "该", "此", "上述", "这句"), "what": ("内容", "文字", "文本", "话", "台词"), "why": ("违规", "敏感", "不合规定", "违反政策", "不当", "违反准则", "不宜翻译", "不适合"), "open": ("，", "，恕", "，所以", "，抱歉", "，请换", "，请提供"), "not": ("不能", "无法", "不予", "不便", "其他", "别的"),
        "do": ("翻译", "处理", "译文", "回答", "文本", "内容"), "end": ("。", "，请换一段。", "！", ""),
    },
    "zh3": {
        "open": ("抱歉，", "对不起，", "很遗憾，", "", ""), "who": ("我", "本助手", "我们", ""), "not": ("不能", "无法", "没有办法", "不便", "难以", "没法"), "for": ("为您", "给您", "替您", ""), "do": ("提供", "给出", "完成", "输出"),
        "which": ("这段", "该", "此类", "上述", "这句", "这个"), "what": ("内容", "文字", "文本", "句子", "台词", "原文"), "of": ("的译文", "的翻译", "的译法"), "end": ("。", "！", "", "，请换一句。"),
    },
    "ja": {
        "open": ("すみません、", "恐縮ですが、", "ごめんなさい、", "残念ながら、", "申し訳ないですが、", ""), "which": ("この", "その", "ご指定の", "上記の"), "what": ("内容", "文", "台詞", "依頼", "テキスト"), "do": ("は翻訳", "の翻訳は", "を訳すことは", "の処理は", "には対応"),
        "not": ("できません", "不可能です", "致しかねます", "お断りします", "控えます", "できかねます"), "end": ("。", "！", ""),
    },
    "en": {
        "open": ("sorry, ", "apologies, ", "unfortunately, ", "regrettably, ", "as an AI, ", ""), "who": ("I ", "we ", "this assistant "), "not": ("cannot ", "can't ", "won't ", "will not ", "am unable to ", "must decline to ", "refuse to ", "am not allowed to "),
        "do": ("translate ", "render ", "process ", "help ", "complete ", "answer ", "assist ", "provide "), "with": ("", "with ", "you with ", ""), "which": ("this ", "that ", "the ", "such "), "what": ("line", "text", "content", "request", "passage", "sentence", "material", ""),
        "why": (", it breaks policy", " because of guidelines", ", it is unsafe", " under my rules", "", ""), "end": (".", "!", ". Try another.", ""),
    },
    "en2": {
        "which": ("this ", "that ", "the ", "your "), "what": ("line ", "text ", "content ", "request ", "passage "), "why": ("violates policy", "breaks the rules", "is against guidelines", "is not permitted", "is disallowed"), "not": (" and cannot be ", " and won't be ", "; it can't be "),
        "do": ("translated", "processed", "rendered", "answered"), "end": (".", "!", ""),
    },
    "ko": {
        "open": ("죄송하지만 ", "미안하지만 ", "유감스럽게도 ", ""), "which": ("이 ", "해당 ", "그 "), "what": ("내용은 ", "문장은 ", "요청은 ", "글은 "), "do": ("번역할 ", "처리할 ", "도울 "), "not": ("수 없습니다", "수 없어요", "수가 없습니다"), "end": (".", "!", ""),
    },
}
# Signs and words that stand for nothing.
PLACEHOLDERS = ("N/A", "null", "None", "nil", "NaN", "undefined", "TODO", "TBD", "无", "空", "暂无", "[]", "{}", "なし", "未翻译", "待翻译", "empty", "...", "-", "—", "「」", "\"\"", "。", "？", " ", "", "\n")

BRACKETS = ("", "", "()", "[]", "<>", "（）", "【】")


def _letters(text: str) -> str:
    return "".join(_WORD.findall(text))


# Kinds of code points.
_HAN_KIND, _KANA_KIND, _LATIN_KIND, _DIGIT_KIND, _OTHER_KIND = 1, 2, 3, 4, 5


@functools.cache
def _kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Kind of every code point (0 for what is no letter or digit), whether it is kana proper, and its mark: 1 sentence end, 2 pause, 3 closing quote, 4 other final."""
    size = sys.maxunicode + 1
    kind = np.zeros(size, np.uint8)
    for cp in range(size):
        if chr(cp).isalnum():
            kind[cp] = _OTHER_KIND
    for k, ranges in ((_HAN_KIND, ((0x3400, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x3FFFF))), (_KANA_KIND, ((0x3041, 0x3096), (0x30A1, 0x30FA), (0x30FC, 0x30FC))), (_LATIN_KIND, ((0x41, 0x5A), (0x61, 0x7A), (0xC0, 0x24F))), (_DIGIT_KIND, ((0x30, 0x39),))):
        for low, high in ranges:
            own = kind[low : high + 1]
            own[own > 0] = k
    kana = np.zeros(size, bool)
    kana[0x3041:0x3097] = kana[0x30A1:0x30FB] = True
    mark = np.zeros(size, np.uint8)
    for k, signs in ((1, "。.！!？?…"), (2, "，、,;；:：—-"), (3, "」』”\"')）"), (4, "ー~♪")):
        mark[[ord(c) for c in signs]] = k
    return kind, kana, mark


def _distinct(keys: np.ndarray) -> np.ndarray:
    """Sorted keys, each once."""
    keys = np.sort(keys)
    return keys[np.append(True, keys[1:] != keys[:-1])[: len(keys)]]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


def _chain(*parts: np.ndarray) -> np.ndarray:
    h = np.full(parts[0].shape, 0x9E3779B97F4A7C15, np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0x100000001B3)
    return _mix(h)


@dataclass
class _Texts:
    """Code points of many texts in one array, with each text's first place and size."""

    points: np.ndarray
    first: np.ndarray
    size: np.ndarray

    @classmethod
    def of(cls, texts: list[str]) -> _Texts:
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        return cls(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.cumsum(size) - size, size)

    @functools.cached_property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def where(self, keep: np.ndarray) -> _Texts:
        size = np.bincount(self.owner[keep], minlength=len(self.size))
        return _Texts(self.points[keep], np.cumsum(size) - size, size)

    def count(self, mask: np.ndarray) -> np.ndarray:
        return np.bincount(self.owner[mask], minlength=len(self.size))

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, owner) of each n-gram."""
        if len(self.points) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = self.owner[: len(self.points) - n + 1] == self.owner[n - 1 :]
        h = _chain(*[self.points[k : len(self.points) - n + 1 + k] for k in range(n)])
        return h[inside], self.owner[: len(inside)][inside]

    def at_end(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(hash, owner) of the last n letters of the texts that have as many."""
        own = np.flatnonzero(self.size >= n)
        end = (self.first + self.size)[own]
        return _chain(*[self.points[end - n + k] for k in range(n)]), own

    def whole(self) -> np.ndarray:
        """A hash of each text."""
        h = _chain(self.points, np.arange(len(self.points)) - self.first[self.owner])
        total = np.zeros(len(self.size), np.uint64)
        np.add.at(total, self.owner, h)
        return _mix(total ^ self.size.astype(np.uint64))


def _pairs_of_letters(t: _Texts) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, pair of neighbouring letters), a single letter for texts of one, as sorted keys, and their number per text."""
    h, owner = t.grams(2)
    one = np.flatnonzero(t.size == 1)
    h, owner = np.append(h, _chain(t.points[t.first[one]])), np.append(owner, one)
    keys = _distinct((owner.astype(np.uint64) << np.uint64(40)) | (h >> np.uint64(24)))
    return keys, np.bincount((keys >> np.uint64(40)).astype(np.int64), minlength=len(t.size))


def _length_bags(letters: _Texts) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, owner) of single letters and pairs, the ends marked."""
    one, own_one = letters.grams(1)
    two, own_two = letters.grams(2)
    full = np.flatnonzero(letters.size > 0)
    head = _chain(np.full(len(full), 94), letters.points[letters.first[full]])
    tail = _chain(letters.points[(letters.first + letters.size)[full] - 1], np.full(len(full), 36))
    every = np.arange(len(letters.size))
    h = np.concatenate([one, two, head, tail, _chain(np.full(len(every), 1))])
    return (h % np.uint64(LENGTH_DIMENSIONS)).astype(np.int64), np.concatenate([own_one, own_two, full, full, every])


def _letters_only(t: _Texts) -> _Texts:
    return t.where(_kinds()[0][t.points] > 0)


def pair_features(sources: list[str], answers: list[str], length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of pairs in canonical form and small letters, each once: (bucket, owner), sorted by owner.

    ``length``: the length regression.  Worked out on the code points of all pairs together.
    """
    kind, kana_table, mark = _kinds()
    n = len(sources)
    out: list[np.ndarray] = []

    def add(name: str, owner: np.ndarray, value: np.ndarray, half: int = 0) -> None:
        h = _chain(np.full(len(owner), zlib.crc32(name.encode())), np.asarray(value).astype(np.int64).astype(np.uint64))
        out.append((owner.astype(np.uint64) << np.uint64(16)) | (h % np.uint64(GRAMS_FROM) + np.uint64(half * GRAMS_FROM)))

    full_a, full_s = _Texts.of(answers), _Texts.of(sources)
    a, s = _letters_only(full_a), _letters_only(full_s)
    every = np.arange(n)
    add("bias", every, np.zeros(n))
    void = a.size == 0
    add("void", every[void], s.size[void] > 0)
    # What follows is worked out for all pairs and kept for those with letters.
    some = ~void
    keep = lambda owner: some[owner]
    count = {k: a.count(kind[a.points] == k) for k in (_HAN_KIND, _KANA_KIND, _LATIN_KIND, _DIGIT_KIND, _OTHER_KIND)}
    words = np.maximum(a.size - count[_DIGIT_KIND], 1)
    chinese = count[_HAN_KIND] / words
    kana = s.count(kana_table[s.points]) > 0
    x, nx = _pairs_of_letters(a)
    y, ny = _pairs_of_letters(s)
    both = np.bincount((np.intersect1d(x, y, assume_unique=True) >> np.uint64(40)).astype(np.int64), minlength=n)
    back, of = both / np.maximum(nx, 1), both / np.maximum(ny, 1)
    same = (a.size == s.size) & (a.whole() == s.whole())
    bucket, owner = _length_bags(s)
    expected = np.bincount(owner, weights=length[bucket], minlength=n)
    short = expected - a.size
    mostly = (chinese > 0.5).astype(int)
    tenth = np.rint(10 * np.minimum(back, of))
    lost = np.clip(10 * short / np.maximum(expected, 1), -3, 10).astype(int) + 5
    ends = lambda t: np.bincount(t.owner[(mark[t.points] == 1) & np.append(True, (mark[t.points][:-1] != 1) | (t.owner[1:] != t.owner[:-1]))[: len(t.points)]], minlength=n)
    place = np.where(mark[full_a.points] != 3, np.arange(len(full_a.points)), -1)
    last = np.full(n, -1)
    np.maximum.at(last, full_a.owner, place)
    end = np.where(last >= full_a.first, mark[full_a.points[np.maximum(last, 0)]] if len(full_a.points) else 0, 0)
    end = np.where(end == 4, 1, np.where(end == 3, 0, end))
    whole_number = (count[_DIGIT_KIND] == a.size).astype(int)
    own = every[some]
    scalars = [
        ("script-han", np.rint(10 * chinese)), ("script-kana", np.rint(10 * count[_KANA_KIND] / words)), ("script-latin", np.rint(10 * count[_LATIN_KIND] / words)), ("script-other", np.rint(10 * count[_OTHER_KIND] / words)),
        ("chinese", np.rint(20 * chinese) * 2 + whole_number), ("copied", np.rint(10 * back) * 2 + kana), ("copied2", tenth * 2 + kana), ("same", same * 2 + kana),
        ("copied+chinese", tenth * 4 + kana * 2 + mostly), ("copied+kana", tenth * 40 + np.rint(10 * count[_KANA_KIND] / words) * 2 + kana),
        ("short", (np.clip(np.rint(short), -6, 12) + 6) * 2 + mostly), ("far", (short > 5) * 4 + (short > 0.3 * expected + 2) * 2 + mostly), ("scaled", (np.clip(np.rint(2 * short / np.sqrt(np.maximum(expected, 1))), -6, 20) + 6) * 2 + mostly), ("ratio", np.rint(10 * np.clip(a.size / np.maximum(expected, 1), 0, 2)) * 2 + mostly),
        ("sentences", (np.clip(ends(full_s) - ends(full_a), -2, 4) + 2) * 8 + (short > 3) * 4 + (lost > 6) * 2 + mostly), ("end", end * 2 + mostly), ("end+short", end * 20 + np.clip(np.rint(short / 2), -2, 4) + 2),
        *[(f"foreign{k}", ((chinese > 0.5) * 1000 + np.rint(5 * count[_KANA_KIND] / words) * 100 + tenth * 2 + kana)) for k in range(3)], *[(f"lost{k}", lost * 2 + mostly) for k in range(3)],
    ]
    for name, value in scalars:
        add(name, own, np.asarray(value)[some])
    for k in range(1, 6):
        h, owner = a.at_end(k)
        add(f"tail{k}", owner[keep(owner)], h[keep(owner)] >> np.uint64(8))
    h, owner = a.at_end(2)
    add("tail+short", owner, (h >> np.uint64(8)) * np.uint64(2) + (short[owner] > 1.5).astype(np.uint64))
    few = np.flatnonzero(some & (a.size <= 12))
    add("whole", few, full_a.whole()[few] >> np.uint64(8))
    for k in (2, 3, 4):
        h, owner = full_a.grams(k)
        add(f"g{k}", owner[keep(owner)], h[keep(owner)] >> np.uint64(8), 1)
    keys = _distinct(np.concatenate(out))
    return (keys & np.uint64(0xFFFF)).astype(np.int64), (keys >> np.uint64(16)).astype(np.int64)


@dataclass
class PairClassifier:
    """Weights (DIMENSIONS, labels), thresholds on the logit, and the length regression."""

    weights: np.ndarray
    thresholds: np.ndarray
    length: np.ndarray

    def margins(self, sources: list[str], answers: list[str]) -> np.ndarray:
        """(pairs, labels): logit less threshold."""
        if not sources:
            return np.zeros((0, len(LABELS)))
        bucket, owner = pair_features(sources, answers, self.length)
        return np.add.reduceat(self.weights[bucket], np.searchsorted(owner, np.arange(len(sources))), axis=0) - self.thresholds

    def defects(self, sources: list[str], answers: list[str]) -> np.ndarray:
        """Number of the defect of each pair in canonical form and small letters, -1 for a sound one.

        The classifier's greatest margin above 0 decides.  An exact check of the definitions follows: only a source with
        kana can be copied, by at least COPIED of its letter pairs (what else was taken for a copy counts as
        in another language where it is); an answer of mostly Han letters and few kana isn't in another language; a refusal isn't broken off;
        what came back unchanged from a source without kana is sound.
        """
        m = self.margins(sources, answers)[:, : len(DEFECTS)].copy()
        if not len(m):
            return np.zeros(0, np.int64)
        a, s = _letters_only(_Texts.of(answers)), _letters_only(_Texts.of(sources))
        kind, kana, _ = _kinds()
        x, _ = _pairs_of_letters(a)
        y, ny = _pairs_of_letters(s)
        kept = np.bincount((np.intersect1d(x, y, assume_unique=True) >> np.uint64(40)).astype(np.int64), minlength=len(m)) / np.maximum(ny, 1)
        copied = (s.count(kana[s.points]) > 0) & (kept >= COPIED)
        han = a.count(kind[a.points] == _HAN_KIND)
        # Japanese may be mostly Han letters, too, but not without kana.
        foreign = (a.size > 0) & ((han < 0.5 * a.size) | (a.count(kana[a.points]) >= KANA_SHARE * a.size))
        same = (a.size == s.size) & (a.whole() == s.whole())
        copy, language, refused = DEFECTS.index("copy"), DEFECTS.index("wrong_language"), DEFECTS.index("refusal")
        taken = (m.argmax(1) == copy) & (m[:, copy] > 0) & ~copied & foreign & (a.count(kind[a.points] == _DIGIT_KIND) < a.size)
        m[taken, language] = np.maximum(m[taken, language], m[taken, copy])
        m[~copied, copy] = -np.inf
        m[~foreign, language] = -np.inf
        told = m[:, refused] > 0
        m[told, DEFECTS.index("truncated")] = -np.inf
        m[same & (a.size > 0) & (s.count(kana[s.points]) == 0)] = -np.inf
        return np.where(m.max(1) > 0, m.argmax(1), -1)

    def defect(self, source: str, answer: str) -> str | None:
        """The defect of one pair in canonical form, or None for a sound one."""
        k = int(self.defects([source.lower()], [answer.lower()])[0])
        return None if k < 0 else DEFECTS[k]


def _fit_length(sources: list[str], sizes: np.ndarray) -> np.ndarray:
    """Ridge regression of the answer's letters on the source's hashed n-grams."""
    bucket, owner = _length_bags(_letters_only(_Texts.of(sources)))
    x = np.bincount(owner * LENGTH_DIMENSIONS + bucket, minlength=len(sources) * LENGTH_DIMENSIONS).reshape(len(sources), -1).astype(np.float32)
    gram = x.T @ x
    gram[np.diag_indices(LENGTH_DIMENSIONS)] += 0.5
    return np.linalg.solve(gram, x.T @ sizes.astype(np.float32))


def _fit(bucket: np.ndarray, owner: np.ndarray, y: np.ndarray, known: np.ndarray, rate: float = 0.05) -> np.ndarray:
    """One logistic regression for each column of ``y``, by Adam on batches of rows; ``known`` is 0 where a row says nothing of a column."""
    rng = np.random.default_rng(SEED)
    rows = len(y)
    share = np.maximum(y.mean(0), 1e-3)
    balance = known * np.where(y > 0, 0.5 / share, 0.5 / np.maximum(1 - share, 1e-3)).astype(np.float32)
    begin = np.searchsorted(owner, np.arange(rows + 1))
    batches = []
    for part in np.array_split(rng.permutation(rows), max(1, rows // BATCH)):
        size = (begin[1:] - begin[:-1])[part]
        flat = np.repeat(begin[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        back = np.argsort(bucket[flat], kind="stable")
        used = _distinct(bucket[flat])
        column = np.searchsorted(used, bucket[flat])
        batches.append((part, used, column, np.cumsum(size) - size, np.repeat(np.arange(len(part)), size)[back], np.searchsorted(column[back], np.arange(len(used)))))
    w = np.zeros((DIMENSIONS, y.shape[1]), np.float32)
    m, v, t = np.zeros_like(w), np.zeros_like(w), 0
    total = np.zeros_like(w)
    worded = np.isin(LABELS, WORDED)
    epochs = max(EPOCHS, -(-UPDATES // len(batches)))
    for epoch in range(epochs):
        for k in rng.permutation(len(batches)):
            part, used, column, first, back, first_back = batches[k]
            z = np.add.reduceat(w[used][column], first, axis=0)
            g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * balance[part] / len(part)
            d = 2e-6 * w
            d[used] += np.add.reduceat(g[back], first_back, axis=0)
            d[GRAMS_FROM:] *= worded
            t += 1
            m += 0.1 * (d - m)
            v += 0.01 * (d * d - v)
            w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
        if epoch >= epochs // 2:
            total += w
    return total / (epochs - epochs // 2)


def _harmless(t: str, rng: np.random.Generator) -> str:
    """The same answer with changes that are no defect."""
    k = rng.integers(0, 7)
    if k == 0:
        return t.rstrip("。.！!")
    if k == 6 or k == 5:
        bare = t.rstrip("。.！!？?")
        return bare[:-1] + (t[len(bare) :] if k == 6 else "") if bare.endswith("了") else t
    if k == 1 and "了" in t:
        at = [m.start() for m in re.finditer("了", t)]
        p = at[rng.integers(0, len(at))]
        return t[:p] + t[p + 1 :]
    if k == 2:
        return f"「{t}」"
    if k == 3:
        return t.rstrip("。") + "！" if t.endswith("。") else t
    return t


def _cut(t: str, rng: np.random.Generator) -> str | None:
    """The answer broken off somewhere, with or without a mark at the end; None where nothing of weight is lost."""
    letters = len(_letters(t))
    if letters < 4:
        return None
    ends = [m.end() for m in re.finditer(r"[。！？!?…]+", t[:-1])]
    if ends and rng.random() < 0.3:  # whole sentences are missing
        head = t[: ends[int(rng.integers(0, len(ends)))]]
        return head if len(_letters(t[len(head) :])) > 1 and _letters(head) else None
    keep = int(rng.integers(1, letters)) if rng.random() < 0.6 else letters - int(rng.integers(1, min(8, letters - 1) + 1))
    seen = 0
    for i, ch in enumerate(t):
        seen += bool(_WORD.match(ch))
        if seen == keep:
            lost = _letters(t[i + 1 :])
            return None if lost in ("了", "") or len(lost) < 2 and lost in "呢哦吧吗啊呀的" else t[: i + 1] + str(rng.choice(["", "", "", "，", "——", "……", "。"]))
    return None


def _noise_language(n: int, rng: np.random.Generator) -> str:
    """Letters of a script that neither source nor answer use."""
    low, high = [(0xAC00, 0xD7A3), (0x0430, 0x044F), (0x0E01, 0x0E2E), (0x0621, 0x064A), (0xAC00, 0xD7A3)][rng.integers(0, 5)]
    return " ".join("".join(chr(int(c)) for c in rng.integers(low, high, rng.integers(1, 6))) for _ in range(max(1, n // 4))) + "."


def refusal(rng: np.random.Generator, part: int | None = None) -> str:
    """A refusal put together from words; ``part`` 0 or 1 takes only every other word of each slot."""
    slots = REFUSAL_WORDS[str(rng.choice(list(REFUSAL_WORDS)))]
    pick = lambda words: str(rng.choice(words if part is None or len(words) < 4 else words[part::2]))
    body = [pick(words) for name, words in slots.items() if name != "end" and (name not in ("open", "why") or len(slots) < 7 or rng.random() < 0.7)]
    return "".join(body).strip() + pick(slots["end"])


def training_set(pairs: list[tuple[str, str]], foreign: list[str], part: int | None = None) -> tuple[list[tuple[str, str]], np.ndarray]:
    """Sound and synthetically broken pairs with their labels (n, labels); ``part``: see ``refusal``."""
    rng = np.random.default_rng(SEED)
    rows: list[tuple[str, str]] = []
    labels: list[int] = []

    def add(s: str, a: str, k: int) -> None:
        rows.append((s, a))
        labels.append(k)

    sources = [s for s, _ in pairs]
    for s, t in pairs:
        add(s, t, -1)
        add(s, _harmless(t, rng), -1)
        add(s, _harmless(_harmless(t, rng), rng), -1)
        for _ in range(2):
            cut = _cut(t, rng)
            if cut is not None:
                add(s, cut, 1)
        k = rng.random()
        if k < 0.3:
            mark = str(rng.choice(BRACKETS))
            add(s, mark[:1] + str(rng.choice(PLACEHOLDERS)) + mark[1:], 0)
        add(s, refusal(rng, part), 2) if k < 0.6 else None
        if _KANA.search(s):
            c = s
            if rng.random() < 0.5:
                c = str(rng.choice(["译文：", "翻译：", "", ""])) + (c.rstrip("。") if rng.random() < 0.5 else c)
            if len(c) > 6 and rng.random() < 0.5:
                p = int(rng.integers(0, len(c) - 1))
                c = c[:p] + str(rng.choice(["", "の", "、", "一"])) + c[p + 1 :]
            add(s, c, 3)
        elif _letters(s):
            add(s, s, -1)
        if rng.random() < 0.3:
            swapped = pairs[int(rng.integers(0, len(pairs)))]
            if swapped[0] != s and swapped[1] != t:
                add(s, swapped[1], 5)
        k = rng.random()
        other = str(rng.choice(foreign)) if foreign and k < 0.4 else _noise_language(len(t), rng) if k < 0.6 else sources[int(rng.integers(0, len(sources)))]
        if other != s and not (_letters(other) and len(_HAN.findall(other)) > 0.5 * len(_letters(other)) and len(_KANA.findall(other)) < KANA_SHARE * len(_letters(other))):
            add(s, t[: int(rng.integers(0, max(1, min(len(t) // 2, len(other) // 3))))] + other if rng.random() < 0.3 else other, 4)
    for f in foreign[: len(pairs)]:  # each foreign sentence once more: what it is about is no refusal
        add(sources[int(rng.integers(0, len(sources)))], f, 4)
    for p in PLACEHOLDERS:
        if not _letters(p):  # what says nothing may rightly be answered by nothing
            for _ in range(8):
                add(p, str(rng.choice([q for q in PLACEHOLDERS if not _letters(q)])), -1)
    y = np.zeros((len(rows), len(LABELS)), np.float32)
    for i, k in enumerate(labels):
        if k >= 0:
            y[i, k] = 1
    return rows, y


def fit_pairs(pairs: list[tuple[str, str]], foreign: list[str], part: int | None = None) -> PairClassifier:
    """Fit on sound (source, answer) pairs and sentences in languages other than the answers'; ``part``: see ``refusal``."""
    canon = lambda texts: pc.utf8_lower(canonical_array(pa.array(texts, pa.string()))).to_pylist()
    spaced = lambda texts: canonical_array(pa.array(texts, pa.string()), keep_space=True).to_pylist()
    good = [(s, t) for s, t in zip(canon([p[0] for p in pairs]), canon([p[1] for p in pairs])) if _letters(s) and _letters(t)]
    if not good:
        return PairClassifier(np.zeros((DIMENSIONS, len(LABELS)), np.float32), np.ones(len(LABELS)), np.zeros(LENGTH_DIMENSIONS, np.float32))
    length = _fit_length([s for s, _ in good], np.array([len(_letters(t)) for _, t in good]))
    rows, y = training_set(good, spaced(foreign), part)
    bucket, owner = pair_features([s for s, _ in rows], canon([a for _, a in rows]), length)
    # Another region's answer may also be too short; it says nothing of the other labels.
    known = np.where((y[:, 5:] > 0) & (np.arange(len(LABELS)) < 5), 0, 1).astype(np.float32)
    held = np.random.default_rng(SEED).random(len(rows)) < 0.2
    new = np.cumsum(~held) - 1
    inside = ~held[owner]
    weights = _fit(bucket[inside], new[owner[inside]], y[~held], known[~held])
    z = np.add.reduceat(weights[bucket], np.searchsorted(owner, np.arange(len(rows))), axis=0)[held]
    thresholds = np.zeros(len(LABELS))
    for c in range(len(LABELS)):
        truth, told = y[held, c] > 0, known[held, c] > 0
        grid = np.arange(-5, 5.01, 0.25)
        # Sound pairs are far commoner than in the training set and weigh so much more.
        each = np.where(y[held].any(1), 1.0, SOUND_WEIGHT) * told
        f1 = np.array([2 * np.sum(truth & (z[:, c] > g)) / max(truth.sum() + each[z[:, c] > g].sum(), 1) for g in grid])
        best = np.flatnonzero(f1 >= f1.max() - 1e-6) if len(z) else np.array([4])
        thresholds[c] = grid[best[len(best) // 2]]
    return PairClassifier(weights, thresholds, length)


def train_pairs(valid: DataFrame, documents: DataFrame, limit: int = MAX_PAIRS) -> PairClassifier:
    """Fit on at most ``limit`` valid regions with both texts and ``MAX_FOREIGN`` sentences of documents in other languages."""
    both = valid.where("source_text is not null and translated_text is not null")
    rows = both.select("source_text", "translated_text", F.xxhash64("region_key").alias("h")).orderBy("h", "source_text").limit(limit).collect()
    latin = documents.where("text is not null and text not rlike '[\\\\x{3040}-\\\\x{30ff}\\\\x{4e00}-\\\\x{9fff}]'")
    each = latin.select(F.explode(F.split("text", r"(?<=[.!?])\s+|\n")).alias("t")).select(F.trim("t").alias("t")).where("length(t) > 8").distinct()
    foreign = [r.t for r in each.orderBy(F.xxhash64("t"), "t").limit(MAX_FOREIGN).collect()]
    return fit_pairs([(r.source_text, r.translated_text) for r in rows], foreign)


def _slices(*columns: list[str]):
    """(begin, end) of runs of rows of about RUN_CHARS letters in all columns together."""
    begin, size = 0, 0
    for i, row in enumerate(zip(*columns)):
        size += sum(map(len, row)) + 1
        if size >= RUN_CHARS or i == len(columns[0]) - 1:
            yield begin, i + 1
            begin, size = i + 1, 0


def valid_sources(regions: DataFrame) -> DataFrame:
    """region_key, source_text and translated_text of each region's valid version."""
    return regions.where("region_id is not null").groupBy(F.col("region_id").alias("region_key")).agg(F.max_by(F.struct("source_text", "translated_text"), F.struct("updated_at", "row_id")).alias("r")).select("region_key", "r.*")


def judged_pairs(answers: DataFrame, valid: DataFrame, model: PairClassifier) -> DataFrame:
    """(pair_table, candidate_row, defect) of every pair; ``defect`` is null for a sound one.

    ``answers``: pair_table, candidate_row, region_id, answer.  A pair needs a region id and
    a valid source that is not null; a null answer is an empty one.  Repeated rows count once.
    """
    shared = answers.sparkSession.sparkContext.broadcast(model)
    pairs = answers.where("region_id is not null").distinct().join(valid.where("source_text is not null").select("region_key", "source_text"), F.col("region_id") == F.col("region_key"))

    @F.pandas_udf("string")
    def judge(source: pd.Series, answer: pd.Series) -> pd.Series:
        s = pc.utf8_lower(canonical_array(pa.array(source, pa.string()))).to_pylist()
        a = pc.utf8_lower(canonical_array(pa.array(answer.fillna(""), pa.string()))).to_pylist()
        names = np.array([*DEFECTS, None], object)
        return pd.Series(np.concatenate([names[shared.value.defects(s[i:k], a[i:k])] for i, k in _slices(s, a)]) if s else [], dtype=object)

    return pairs.select("pair_table", "candidate_row", judge("source_text", "answer").alias("defect")).distinct()
