"""Scalar text functions as Column expressions."""

from __future__ import annotations

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

# The first code points of the digit blocks of nine Indic scripts.
INDIC_ZEROS = [0x0966, 0x09E6, 0x0A66, 0x0AE6, 0x0B66, 0x0BE6, 0x0C66, 0x0CE6, 0x0D66]
DIGIT_WORDS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]
TEENS = ["ten", "eleven", "twelve", "thirteen", "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen"]
TENS = ["twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety"]

_FROM = "".join(chr(z + d) for z in INDIC_ZEROS for d in range(10))
_TO = "0123456789" * len(INDIC_ZEROS)


#: The characters that Python takes for white space, as Java's class is ASCII only.
_SPACE = r"[\s\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"


@F.pandas_udf(StringType())
def nfc(text: pd.Series) -> pd.Series:
    """Unicode NFC, which Spark SQL lacks; with casefold the only Python in this module."""
    return text.astype("object").str.normalize("NFC")


@F.pandas_udf(StringType())
def casefold(text: pd.Series) -> pd.Series:
    """Unicode case folding, which Spark SQL lacks."""
    return text.astype("object").str.casefold()


def fold_digits(text: Column) -> Column:
    return F.when(text.rlike(r"[^\x00-\x7f]"), F.translate(text, _FROM, _TO)).otherwise(text)


def folded_text(text: Column, normalize: bool = True) -> Column:
    """NFC (unless told the text is ASCII or normal already), ASCII digits, no grouping marks between digits."""
    return F.regexp_replace(fold_digits(nfc(text) if normalize else text), r"[,٬](?<=\p{Nd}[,٬])(?=\p{Nd})", "")


def normalize_digits(text: Column) -> Column:
    return F.regexp_replace(fold_digits(text), "[^0-9]", "")


def normalize_currency(amount: Column, code: str = "INR") -> Column:
    return F.concat(F.lit(code + ":"), F.bround(amount.cast("decimal(28,6)"), 2).cast("decimal(28,2)").cast("string"))


def normalize_date(year: Column, month: Column, day: Column) -> Column:
    """2026-03-14, --03-14, 2026-03 or --03; day and year may be null."""
    two = lambda x: F.lpad(x.cast("string"), 2, "0")
    head = F.when(year.isNull(), F.lit("--")).otherwise(F.concat(F.lpad(year.cast("string"), 4, "0"), F.lit("-")))
    return F.concat(head, two(month), F.when(day.isNull(), F.lit("")).otherwise(F.concat(F.lit("-"), two(day))))


def normalize_name(text: Column) -> Column:
    return F.trim(F.regexp_replace(casefold(nfc(text)), _SPACE, " "))


def indian_grouping(n: Column) -> Column:
    """123456789 -> 12,34,56,789; the sign stays."""
    sign, d = F.when(n < 0, F.lit("-")).otherwise(F.lit("")), F.abs(n).cast("string")
    grouped = F.concat(F.regexp_replace(F.substr(d, F.lit(1), F.length(d) - 3), "(?<=[0-9])(?=([0-9]{2})+$)", ","), F.lit(","), F.right(d, F.lit(3)))
    return F.concat(sign, F.when(F.length(d) <= 3, d).otherwise(grouped))


ENGLISH_BELOW_100 = DIGIT_WORDS + TEENS + [t if u == 0 else f"{t} {DIGIT_WORDS[u]}" for t in TENS for u in range(10)]
ENGLISH_SCALES = ("hundred", "thousand", "lakh", "crore")


def word_of(words: list[str], i: Column) -> Column:
    """The i-th of words, which are one constant of the plan."""
    return F.element_at(F.split(F.lit("|".join(words)), "[|]"), (i + 1).cast("int"))


def number_to_words(n: Column, below_100: list[str] = ENGLISH_BELOW_100, scales: tuple[str, ...] = ENGLISH_SCALES) -> Column:
    """A whole number under 10^11 in words with Indian scales, English unless told other words; any other is refused."""
    n = n.cast("long")
    n = F.when(n.isNull() | n.between(0, 99_999_999_999), n).otherwise(F.raise_error(F.concat(F.lit("no words for "), n.cast("string"))))
    part = lambda div, mod: F.floor(n / div) % mod
    piece = lambda v, scale: F.when(v > 0, F.concat_ws(" ", word_of(below_100, v), F.lit(scale)))
    crore = F.floor(n / 10_000_000)
    crores = F.when(crore > 0, F.concat_ws(" ", F.when(crore >= 100, F.concat_ws(" ", word_of(below_100, F.floor(crore / 100)), F.lit(scales[0]))), F.when(crore % 100 > 0, word_of(below_100, crore % 100)), F.lit(scales[3])))
    rest = F.when(n % 100 > 0, word_of(below_100, n % 100))
    return F.when(n == 0, F.lit(below_100[0])).otherwise(F.concat_ws(" ", crores, piece(part(100_000, 100), scales[2]), piece(part(1_000, 100), scales[1]), piece(part(100, 10), scales[0]), rest))


def digits_to_words(d: Column, words: list[str] = DIGIT_WORDS) -> Column:
    return F.array_join(F.transform(F.regexp_extract_all(d, F.lit("([0-9])")), lambda c: word_of(words[:10], c.cast("int"))), " ")


def edit_distance(a: Column, b: Column) -> Column:
    return F.levenshtein(a, b)


def _wer_text(text: Column, normalize: bool) -> Column:
    kept = F.regexp_replace(nfc(text) if normalize else text, r"[^\p{L}\p{N}_\s\x{0900}-\x{097F}]", " ")
    return casefold(kept) if normalize else F.lower(kept)


def wer_tokens(text: Column, normalize: bool = True) -> Column:
    """Case-folded words of the NFC text (unless told that it is ASCII); punctuation goes, except that the whole Devanagari
    block stays."""
    return F.filter(F.split(_wer_text(text, normalize), r"\s+"), lambda x: x != "")


def token_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein over words: each distinct word of the pair becomes one character, then the built-in runs. The pair goes
    through a lambda, as its parts may hold Python functions, which no inner lambda may name."""

    def distance(pair):
        vocabulary = F.array_distinct(F.concat(pair["a"], pair["b"]))
        spell = lambda words: F.array_join(F.transform(words, lambda w: F.decode(F.unhex(F.lpad(F.hex(F.array_position(vocabulary, w) + 0x4E00), 8, "0")), "UTF-32")), "")
        return F.levenshtein(spell(pair["a"]), spell(pair["b"]))

    return F.element_at(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), distance), 1)


def wer_of(r: Column, h: Column) -> Column:
    """Word edits per reference word from two lists of words; for an empty reference 0 if the other is empty too, else 1."""
    return F.when(F.size(r) == 0, F.when(F.size(h) == 0, 0.0).otherwise(1.0)).otherwise(token_edit_distance(r, h) / F.size(r))


def edits(a: list[str], b: list[str]) -> int:
    """Levenshtein over words, a column of the table at a time: the steps down a column are the bits of two numbers."""
    first, n = 0, min(len(a), len(b))
    while first < n and a[first] == b[first]:
        first += 1
    last = 0
    while last < n - first and a[-1 - last] == b[-1 - last]:
        last += 1
    a, b = a[first : len(a) - last], b[first : len(b) - last]
    if not a or not b:
        return len(a) + len(b)
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    every, end, out = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = every, 0
    for w in b:
        same = at.get(w, 0)
        level = (((same & up) + up) ^ up) | same | down
        more, less = down | every & ~(level | up), up & level
        out += 1 if more & end else -1 if less & end else 0
        more, less = (more << 1 | 1) & every, (less << 1) & every
        up, down = less | every & ~(level | more), more & level
    return out


@F.arrow_udf(DoubleType())
def _wer_of_texts(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
    def rate(r: str | None, h: str | None) -> float | None:
        if r is None or h is None:
            return None
        if r == h:
            return 0.0
        r, h = r.split(), h.split()
        return edits(r, h) / len(r) if r else float(bool(h))

    return pa.array([rate(r, h) for r, h in zip(reference.to_pylist(), hypothesis.to_pylist(), strict=True)], pa.float64())


def wer_in_task(reference: Column, hypothesis: Column, normalize: bool = True) -> Column:
    """wer_of the wer_tokens of two texts; the words are compared over Arrow batches. Null if either text is."""
    return _wer_of_texts(_wer_text(reference, normalize), _wer_text(hypothesis, normalize))


def wer(reference: Column, hypothesis: Column) -> Column:
    return wer_of(wer_tokens(reference), wer_tokens(hypothesis))


def gold_digits(expected: Column) -> Column:
    """The digits a model would write for a value: after the last colon, without a zero fraction."""
    return F.regexp_replace(F.regexp_replace(F.substring_index(expected, ":", -1), r"\.0+$", ""), "[^0-9]", "")


def rendering_of(expected: Column, hypothesis: Column, hit: Column) -> Column:
    d = gold_digits(expected)
    return F.when(d == "", "n/a").when(F.contains(F.regexp_replace(hypothesis, "[^0-9]", ""), d), "digits").when(hit, "words").otherwise("absent")


def pretty_value(value: Column) -> Column:
    """INR:797.00 -> the rupee sign and 797; other values stay."""
    return F.when(value.startswith("INR:"), F.concat(F.lit("₹"), F.regexp_replace(F.substr(value, F.lit(5)), r"\.00$", ""))).otherwise(value)


_PARTS = "array<struct<text:string,kind:string>>"


def _longest_common(e: Column, f: Column) -> Column:
    """Rows i of cells j: the longest common subsequence of the first i of e and the first j of f."""

    def grown(row, c):
        cell = lambda acc, j: F.when(F.get(f, j - 1) == c, F.get(row, j - 1) + 1).otherwise(F.greatest(F.get(row, j), F.element_at(acc, -1)))
        return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(f), F.lit(1))), F.array(F.lit(0)), lambda acc, j: F.concat(acc, F.array(cell(acc, j))))

    first = F.array(F.transform(F.sequence(F.lit(0), F.size(f)), lambda _: F.lit(0)))
    return F.aggregate(e, first, lambda rows, c: F.concat(rows, F.array(grown(F.element_at(rows, -1), c))))


def _walk(x: Column) -> Column:
    """One (text, kind) for each step of the walk over the table of x.e and x.f, which are the letters from the last on."""
    e, f, rows = x["e"], x["f"], x["rows"]

    def step(s, _):
        i, j = s["i"], s["j"]
        ec, fc = F.get(e, i - 1), F.get(f, j - 1)
        kind = F.when((i > 0) & (j > 0) & (ec == fc), "same").when((i > 0) & ((j == 0) | (F.get(F.get(rows, i - 1), j) >= F.get(F.get(rows, i), j - 1))), "missing").otherwise("wrong")
        part = F.array(F.struct(F.when(kind == "missing", ec).otherwise(fc).alias("text"), kind.alias("kind")))
        on = (i > 0) | (j > 0)
        return F.struct((i - F.when(on & (kind != "wrong"), 1).otherwise(0)).alias("i"), (j - F.when(on & (kind != "missing"), 1).otherwise(0)).alias("j"), F.when(on, F.concat(s["parts"], part)).otherwise(s["parts"]).alias("parts"))

    start = F.struct(F.size(e).alias("i"), F.size(f).alias("j"), F.array().cast(_PARTS).alias("parts"))
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(e) + F.size(f), F.lit(1))), start, step, lambda s: s["parts"])


def value_diff(expected: Column, found: Column) -> Column:
    """array<(text, kind)>: what was found against what was expected, as runs of same, wrong (found but not expected) and
    missing (expected, at the place where it was dropped). Values of one length are compared place by place, others along a
    longest common subsequence. A null found is all missing, a null expected null."""
    chars = lambda c: F.regexp_extract_all(c, F.lit("(.)"))
    bound = lambda value, then: F.get(F.transform(F.array(value), then), F.lit(0))
    by_place = F.zip_with(chars(expected), chars(found), lambda a, b: F.struct(b.alias("text"), F.when(a == b, "same").otherwise("wrong").alias("kind")))
    table = bound(F.struct(F.reverse(chars(expected)).alias("e"), F.reverse(chars(found)).alias("f")), lambda x: F.struct(x["e"].alias("e"), x["f"].alias("f"), _longest_common(x["e"], x["f"]).alias("rows")))
    steps = F.when(F.length(expected) == F.length(found), by_place).otherwise(bound(table, _walk))

    def merged(parts, x):
        last = F.element_at(parts, -1)
        longer = F.concat(F.slice(parts, F.lit(1), F.size(parts) - 1), F.array(F.struct(F.concat(last["text"], x["text"]).alias("text"), last["kind"].alias("kind"))))
        return F.when((F.size(parts) > 0) & (F.try_element_at(parts, F.lit(-1))["kind"] == x["kind"]), longer).otherwise(F.concat(parts, F.array(x)))

    whole = F.aggregate(steps, F.array().cast(_PARTS), merged)
    return F.when(found.isNull(), F.when(expected.isNotNull(), F.array(F.struct(expected.alias("text"), F.lit("missing").alias("kind"))))).otherwise(whole)


def value_diff_lost(parts: Column) -> Column:
    """Characters of a value_diff that are not the same on both sides."""
    return F.aggregate(parts, F.lit(0), lambda n, p: n + F.when(p["kind"] == "same", 0).otherwise(F.length(p["text"])))


def entity_starts(text: Column, surfaces: Column) -> Column:
    """0-based offset of each surface, searched for after the one before; null (and no move) where it is not found."""
    start = F.struct(F.lit(1).alias("at"), F.expr("cast(array() as array<int>)").alias("found"))

    def step(s, surface):
        p = F.call_function("locate", surface, text, s["at"])
        return F.struct(F.when(p > 0, p + F.length(surface)).otherwise(s["at"]).alias("at"), F.concat(s["found"], F.array(F.when(p > 0, p - 1))).alias("found"))

    return F.aggregate(surfaces, start, step, lambda s: s["found"])


def language_key(language: Column, known: tuple[str, ...] = ("hi", "en")) -> Column:
    key = F.element_at(F.split(F.lower(language), "[-_]"), 1)
    return F.when(key.isin(*known), key).otherwise("en")


def request_key(*fields: Column) -> Column:
    """sha256 of the compact JSON of the fields, which are given in key order."""
    return F.sha2(F.to_json(F.struct(*fields)), 256)


def derived_seed(*parts: Column) -> Column:
    """64 bits that depend on the parts alone, so order and parallelism do not matter."""
    return F.xxhash64(*parts)
