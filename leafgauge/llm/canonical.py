"""One consistent form for texts that look alike but differ in code points.

The text column arrives as an Arrow string array.  Its UTF-8 buffer is decoded once per
batch into a single code-point array; every later step works on that array: a gather in a
lookup table gives each code point its expansion length, offsets are built by cumulative
sums, expansions are gathered, and combining marks are reordered and composed by sorted
searches over (base, mark) pairs.  No string function is called for a row.

Canonical form, in order:

1. compatibility decomposition (full/half width, radicals, compatibility ideographs,
   ligatures, enclosed forms);
2. removal of invisible code points (zero-width and joiner controls, byte order mark, soft
   hyphen, variation selectors, grapheme joiner, bidi controls and other format characters)
   and of white space and line breaks of any kind;
3. letters and signs of one shape become one representative;
4. canonical ordering and composition of combining marks.

White space carries no meaning for a reading comparison and is removed altogether;
``keep_space=True`` keeps one U+0020 for each run instead (none at the ends).

Nulls stay null, an empty text or one of invisible characters only becomes ``''``.  Equal
inputs give equal outputs whatever batch they are in.
"""

from __future__ import annotations

import functools
import sys
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Letters and signs drawn alike; the first of each row represents the others.
SAME_SHAPE = (
    "エ工", "ロ口囗", "ハ八", "ト卜", "タ夕", "オ才", "ニ二", "カ力", "へヘ", "リり", "ノ丿", "ム厶",
    "ー一―—─━", "-‐‑–‒−", "…⋯", "・·•‧∙⋅･", "~～〜∼", "'’‘′`ʼ＇", "\"”“″〃", "|｜∣ǀ", "!ǃ", ":ː∶",
    "/⁄∕", "*∗＊", "<‹〈", ">›〉",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ",
    "XХΧ", "YΥҮ", "ZΖ", "aаɑ", "cсϲ", "eе", "hһ", "iі", "jј", "oоο", "pрρ", "sѕ", "vν", "xх", "yу",
)

_MARK_CLASSES = ("Mn", "Mc", "Me")


@functools.cache
def _tables() -> dict[str, np.ndarray]:
    """Lookup tables over all code points, built from rules of the Unicode database."""
    size = sys.maxunicode + 1
    rep = {}
    for row in SAME_SHAPE:
        for ch in row[1:]:
            rep[ord(ch)] = ord(row[0])
    # へ with marks: べ ぺ decompose to へ + mark, so the row above also unites ベ and べ.
    length = np.ones(size, np.uint8)
    single = np.arange(size, dtype=np.uint32)
    start = np.zeros(size, np.uint32)
    ccc = np.zeros(size, np.uint8)
    pool: list[int] = []
    pairs: list[tuple[int, int, int]] = []
    invisible = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x2800, 0x3164, 0xFFA0}
    invisible.update(range(0x180B, 0x1810), range(0xFE00, 0xFE10), range(0xE0100, 0xE01F0))
    for cp in range(size):
        if 0xD800 <= cp < 0xE000:
            continue
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind == "Cn" and cp not in invisible:
            continue
        if kind == "Mn" or kind == "Mc":
            ccc[cp] = unicodedata.combining(ch)
        if kind == "Cf" or cp in invisible or kind == "Cc" or ch.isspace():
            length[cp] = 0
            single[cp] = 0x20 if ch.isspace() else 0
            continue
        raw = unicodedata.normalize("NFKD", ch)
        out = []
        for x in raw:
            if x.isspace() or ord(x) in invisible:
                continue
            if x in "゛゜":
                x = "゙" if x == "゛" else "゚"
            y = rep.get(ord(x), ord(x))
            out.extend([0x2E] * 3 if y == 0x2026 else [y])
        if cp in (0x309B, 0x309C, 0xFF9E, 0xFF9F):  # spacing voice marks
            out = [0x3099 if cp in (0x309B, 0xFF9E) else 0x309A]
            ccc[cp] = 8
        if len(out) == 1:
            single[cp] = out[0]
        elif not out:
            length[cp] = 0
            single[cp] = 0x20
        else:
            length[cp] = len(out)
            start[cp] = len(pool)
            pool.extend(out)
        if unicodedata.decomposition(ch) and not unicodedata.decomposition(ch).startswith("<"):
            parts = [int(p, 16) for p in unicodedata.decomposition(ch).split()]
            if len(parts) == 2 and unicodedata.normalize("NFC", ch) == ch:
                pairs.append((rep.get(parts[0], parts[0]), parts[1], cp))
    for lv in range(0xAC00, 0xAC00 + 11172):  # Hangul syllables compose by rule
        i = lv - 0xAC00
        if i % 28:
            pairs.append((lv - i % 28, 0x11A7 + i % 28, lv))
        else:
            pairs.append((0x1100 + i // 588, 0x1161 + i % 588 // 28, lv))
    pairs.sort(key=lambda p: (p[0], p[1], p[2]))
    keys = np.array([(a << 21) | b for a, b, _ in pairs], np.uint64)
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    return {
        "length": length, "single": single, "start": start, "ccc": ccc, "pool": np.array(pool or [0], np.uint32),
        "pair": keys[first], "made": np.array([c for _, _, c in pairs], np.uint32)[first],
    }


def _code_points(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All code points of a string array, and for each the row that holds it."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    lead = (raw & 0xC0) != 0x80
    row_of_byte = np.repeat(np.arange(len(column)), np.diff(offsets))
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, row_of_byte[lead]


def _to_array(points: np.ndarray, rows: np.ndarray, count: int, mask: np.ndarray | None) -> pa.Array:
    """The string array with these code points; ``rows`` rises."""
    raw = np.frombuffer(points.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8"), np.uint8)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    sizes = np.bincount(rows, weights=width, minlength=count).astype(np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    valid = None if mask is None else pa.array(~mask).buffers()[1]
    built = pa.Array.from_buffers(pa.large_string(), count, [valid, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
    return built.cast(pa.string())


def _reorder(points: np.ndarray, rows: np.ndarray, ccc: np.ndarray) -> np.ndarray:
    """Runs of combining marks in the order of their classes; stable."""
    cls = ccc[points]
    if len(points) < 2 or not np.any((cls[1:] < cls[:-1]) & (cls[1:] > 0) & (rows[1:] == rows[:-1])):
        return points
    run = np.cumsum((cls == 0) | np.concatenate([[True], rows[1:] != rows[:-1]]))
    return points[np.lexsort((cls, run))]


def _compose(points: np.ndarray, rows: np.ndarray, t: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Compose base and mark, pair after pair, until nothing changes."""
    while len(points) > 1:
        key = (points[:-1].astype(np.uint64) << np.uint64(21)) | points[1:].astype(np.uint64)
        may = np.flatnonzero((points[1:] >= 0x300) & (rows[1:] == rows[:-1]))
        if not len(may):
            break
        at = np.searchsorted(t["pair"], key[may])
        at[at == len(t["pair"])] = 0
        hit = t["pair"][at] == key[may]
        left, made = may[hit], t["made"][at[hit]]
        if len(left) > 1:  # of two pairs that share a code point the first goes
            far = np.concatenate([[True], np.diff(left) > 1])
            left, made = left[far], made[far]
        if not len(left):
            break
        points = points.copy()
        points[left] = made
        keep = np.ones(len(points), bool)
        keep[left + 1] = False
        points, rows = points[keep], rows[keep]
    return points, rows


#: So many rows of an Arrow batch are worked on at once: bounds memory, whatever the session's batch size.
SLICE_ROWS = 1000


def slices(batch: pa.RecordBatch):
    """The batch in runs of SLICE_ROWS rows."""
    for i in range(0, batch.num_rows, SLICE_ROWS):
        yield batch.slice(i, SLICE_ROWS)


def canonical_array(column: pa.Array, keep_space: bool = False) -> pa.Array:
    """The canonical form of a string array."""
    t = _tables()
    mask = np.asarray(column.is_null()) if column.null_count else None
    points, rows = _code_points(column)
    length = t["length"][points].astype(np.int64)
    if keep_space:
        blank = (length == 0) & (t["single"][points] == 0x20)
        length[blank] = 1
    total = int(length.sum())
    begin = np.cumsum(length) - length
    out = np.repeat(t["single"][points], length)
    rows_out = np.repeat(rows, length)
    many = np.flatnonzero(length > 1)
    if len(many):
        n = length[many]
        inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(begin[many], n) + inner] = t["pool"][np.repeat(t["start"][points[many]].astype(np.int64), n) + inner]
    assert len(out) == total
    if keep_space and total:
        space = out == 0x20
        edge = np.concatenate([[True], rows_out[1:] != rows_out[:-1]])
        drop = space & (np.concatenate([[True], space[:-1]]) | edge)
        out, rows_out = out[~drop], rows_out[~drop]
        if len(out):
            last = (out == 0x20) & np.concatenate([rows_out[1:] != rows_out[:-1], [True]])
            out, rows_out = out[~last], rows_out[~last]
    out = _reorder(out, rows_out, t["ccc"])
    out, rows_out = _compose(out, rows_out, t)
    return _to_array(out, rows_out, len(column), mask)


@F.arrow_udf(T.StringType())
def _canonical(column: pa.Array) -> pa.Array:
    return canonical_array(column)


@F.arrow_udf(T.StringType())
def _canonical_spaced(column: pa.Array) -> pa.Array:
    return canonical_array(column, keep_space=True)


def canonical(text: Column | str, keep_space: bool = False) -> Column:
    """Column expression: canonical form of ``text``; null stays null."""
    text = F.col(text) if isinstance(text, str) else text
    return (_canonical_spaced if keep_space else _canonical)(text.cast("string"))


def canonical_texts(df: DataFrame, column: str, out: str = "canonical_text") -> DataFrame:
    """``df`` with one more column ``out``; an existing column of that name is replaced."""
    return df.withColumn(out, canonical(df[column]))


def same_reading(readings: DataFrame, expected: DataFrame, key: str = "region_id") -> DataFrame:
    """Readings that differ from the expected text as strings yet read the same.

    ``readings``: ``text_table``, ``candidate_row``, ``key``, ``text``.  ``expected``:
    ``key``, ``expected``.  Result: distinct (``text_table``, ``candidate_row``).  Rows
    with a null key or text on either side are no case; repeated rows count once; several
    expected texts of one key are each compared.

    The join is on the key; texts are compared after it, so the canonical form is worked
    out only for rows whose strings differ.
    """
    left = readings.select("text_table", "candidate_row", F.col(key).alias("_k"), F.col("text").alias("_t"))
    right = expected.select(F.col(key).alias("_k"), F.col("expected").alias("_e")).where("_k is not null and _e is not null").distinct()
    pairs = left.where("_k is not null and _t is not null").join(right, "_k").where("_t <> _e")
    return pairs.where(canonical("_t") == canonical("_e")).select("text_table", "candidate_row").distinct()
