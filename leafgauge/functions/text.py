"""Text functions as column expressions; only Unicode normalisation leaves the JVM."""

from __future__ import annotations

import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Character classes and patterns of the rules.
SPACE = r"[\p{IsWhite_Space}]+"
SCRIPT_SPACE = r"[\p{IsWhite_Space}\x{FEFF}&&[^\x{0085}]]+"
CONTROL = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}-\x{009F}]"
CONTROL_NARROW = r"[\x{0000}-\x{0008}\x{000B}\x{000C}\x{000E}-\x{001F}\x{007F}]"
BIDI = r"[\x{061C}\x{200E}\x{200F}\x{202A}-\x{202E}\x{2066}-\x{2069}]"
KANA = r"[\x{3040}-\x{30FF}]"
KANA_WIDE = r"[\x{3040}-\x{30FF}\x{FF66}-\x{FF9F}]"
REASONING = r"(?iu)</?think\b[^>]*>|<\|(?:analysis|reasoning)(?:_content)?\|>"
REFUSAL = r"(?iu)(无法(?:协助|翻译|处理)|不能(?:协助|翻译|处理)|抱歉.{0,12}(?:不能|无法)|I\s+(?:can(?:not|'t)|am unable to)\s+(?:help|translate|assist))"
TOKENS = r"[0-9０-９]+|[!?！？…]+"
LONE_SURROGATE_ESCAPE = r"\\u[dD][89abAB][0-9a-fA-F]{2}(?!\\u[dD][c-fC-F][0-9a-fA-F]{2})|(?<!\\u[dD][89abAB][0-9a-fA-F]{2})\\u[dD][c-fC-F][0-9a-fA-F]{2}"


@F.arrow_udf(T.StringType())
def _nfkc(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", t) for t in column.to_pylist()], pa.string())


def nfkc(text: Column) -> Column:
    """Compatibility composition; printable ASCII takes the short way inside the JVM."""
    return F.when(text.rlike("^[ -~]*$"), text).otherwise(_nfkc(text))


def normalized(text: Column) -> Column:
    """NFKC without any white space: the form in which readings are compared."""
    return F.regexp_replace(nfkc(text), SPACE, "")


def normalized_script(text: Column) -> Column:
    """NFKC without the white space of script regular expressions (also U+FEFF, not U+0085)."""
    return F.regexp_replace(nfkc(text), SCRIPT_SPACE, "")


def no_space(text: Column) -> Column:
    return F.regexp_replace(text, SCRIPT_SPACE, "")


def script_trim(text: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(text, f"^{SCRIPT_SPACE}|{SCRIPT_SPACE}$", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 units."""
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def rate(n: Column, d: Column) -> Column:
    """n / d, and 0 for 0 / 0."""
    return F.coalesce(F.try_divide(n.cast("double"), d.cast("double")), F.lit(0.0))


def error_rate(expected: Column, actual: Column) -> Column:
    """Edits per expected code point of texts in one normal form; the divisor is at least 1."""
    return F.levenshtein(expected, actual) / F.greatest(F.lit(1), F.length(expected))


def hard_reasons(text: Column, norm: Column) -> Column:
    """Why a reading can't be used, in fixed order; empty for a usable one.

    A lone surrogate can't be held by the engine's strings: it is looked for in raw JSON, see
    ``lone_surrogate``, and shows here as U+FFFD at the latest.
    """
    found = F.array(
        F.when(text.contains("�"), F.lit("replacement-character")), F.when(text.rlike(CONTROL), F.lit("forbidden-control")),
        F.when(text.rlike(BIDI), F.lit("bidi-control")), F.when(norm == "", F.lit("empty-text")),
    )
    return F.when(text.isNull(), F.array(F.lit("candidate-missing"))).otherwise(F.array_compact(found))


def lone_surrogate(raw_json: Column) -> Column:
    """Raw JSON text with an escape of half a surrogate pair."""
    return raw_json.rlike(LONE_SURROGATE_ESCAPE)


def longest_run(text: Column) -> Column:
    """Length of the longest run of one code point; 0 for the empty text."""
    start = F.struct(F.lit("").alias("c"), F.lit(0).alias("n"), F.lit(0).alias("top"))

    def step(acc: Column, ch: Column) -> Column:
        n = F.when(acc["c"] == ch, acc["n"] + 1).otherwise(F.lit(1))
        return F.struct(ch.alias("c"), n.alias("n"), F.greatest(acc["top"], n).alias("top"))

    return F.aggregate(F.filter(F.split(text, ""), lambda c: c != ""), start, step, lambda acc: acc["top"])


def repeated_block(text: Column, low: int = 1, high: int = 8) -> Column:
    """Some block of low to high code points stands three times in a row."""
    return text.rlike(rf"(?s)(.{{{low},{high}}})\1\1")


def scripts(text: Column) -> Column:
    """Names of the scripts that occur."""
    pairs = (("han", "IsHan"), ("hiragana", "IsHiragana"), ("katakana", "IsKatakana"), ("latin", "IsLatin"), ("number", "N"))
    return F.array_compact(F.array(*[F.when(text.rlike(rf"\p{{{p}}}"), F.lit(n)) for n, p in pairs]))


def significant_tokens(text: Column) -> Column:
    """Runs of digits and of emphatic signs, each occurrence."""
    return F.regexp_extract_all(text, F.lit(TOKENS), F.lit(0))


def length_stratum(norm: Column) -> Column:
    n = F.length(norm)
    return F.when(norm.isNull(), F.lit("not-applicable")).when(n <= 8, F.lit("short")).when(n <= 20, F.lit("medium")).otherwise(F.lit("long"))


def slug(text: Column, limit: int = 80) -> Column:
    """Lower-case ASCII name for files."""
    s = F.regexp_replace(F.lower(nfkc(text)), r"[^\p{L}\p{N}]+", "-")
    s = F.substring(F.regexp_replace(s, r"^-+|-+$", ""), 1, limit)
    return F.when(s == "", F.lit("untitled")).otherwise(s)


def archive_path(raw: Column) -> Column:
    """Safe relative path of an archive entry, or null for one that must be refused."""
    p = F.replace(raw, F.lit("\\"), F.lit("/"))
    parts = F.split(F.regexp_replace(p, "/+$", ""), "/")
    bad = raw.rlike(r"[\x{0000}\x{FFFD}]") | p.rlike(r"^/|^[A-Za-z]:") | p.contains(":") | (p == "") | F.exists(parts, lambda x: x.isin("", ".", "..") | x.rlike(r"[. ]$"))
    return F.when(~bad, F.array_join(parts, "/"))


def natural_key(name: Column) -> Column:
    """Sort key in which numbers inside names count by value, letter case aside."""
    parts = F.regexp_extract_all(F.lower(name), F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.array_join(F.transform(parts, lambda x: F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 40, "0"))).otherwise(x)), "\u0001")


def media_type(content: Column) -> Column:
    """Image type by the first bytes; null for anything else."""
    h = F.hex(F.substring(content, 1, 12))
    return F.when(h.startswith("89504E470D0A1A0A"), F.lit("image/png")).when(h.startswith("FFD8FF"), F.lit("image/jpeg")).when(h.startswith("52494646") & h.endswith("57454250"), F.lit("image/webp"))


def reasoning_stripped(text: Column) -> Column:
    """(status, text): the answer without a leading reasoning block; malformed ones have null text."""
    lead = F.regexp_replace(text, f"^{SCRIPT_SPACE}", "")
    opening = r"(?iu)^<think\b[^>]*>"
    closed = r"(?isu)^<think\b[^>]*>.*?</think\s*>"
    rest = script_trim(F.regexp_replace(lead, closed, ""))
    status = (
        F.when(~lead.rlike(opening), F.when(lead.rlike(REASONING), F.lit("format-invalid")).otherwise(F.lit("ok")))
        .when(~lead.rlike(closed), F.lit("unterminated")).when(rest.rlike(REASONING), F.lit("format-invalid")).otherwise(F.lit("ok"))
    )
    body = F.when(lead.rlike(opening), rest).otherwise(F.regexp_replace(lead, f"{SCRIPT_SPACE}$", ""))
    return F.struct(status.alias("status"), F.when(status == "ok", body).alias("text"))


def numbered_list(text: Column) -> Column:
    """Lines numbered 1, 2, 3 .. get the delimiter ': '; any other text stays as it is."""
    item = r"^(\s*)(\d+)\s*[:：﹕]\s*(.*)$"
    lines = F.split(text, "\r?\n")
    filled = F.filter(lines, lambda x: ~x.rlike(r"^\s*$"))
    right = F.size(filled) > 0
    right &= F.forall(F.transform(filled, lambda x, i: F.coalesce(F.regexp_extract(x, item, 2).try_cast("decimal(38,0)") == i + 1, F.lit(False))), lambda ok: ok)
    return F.when(right, F.array_join(F.transform(lines, lambda x: F.regexp_replace(x, item, "$1$2: $3")), "\n")).otherwise(text)


def same_version(left: Column, right: Column) -> Column:
    """Versions equal but for a leading v and what follows + or -."""
    base = lambda v: F.regexp_replace(F.regexp_replace(F.trim(v), "^[vV]", ""), "[-+].*$", "")
    return base(left) == base(right)


def is_loopback(url: Column) -> Column:
    host = F.try_parse_url(url, F.lit("HOST"))
    return F.coalesce(host.isin("127.0.0.1", "localhost", "[::1]", "::1"), F.lit(False))
