"""A text read word by word inside a task: its words, what the lexicon makes of them, and the values that its number runs
may be. These are Python over Arrow batches; scores, causes and figures are left to column expressions."""

from __future__ import annotations

import gc
import re
import unicodedata
from collections.abc import Callable
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters that separate words.
SEPARATORS = " \t\n\r\f\x0b।॥!\"#%&'()*+,-./:;<=>?@[\\]^_`{|}~–—…“”‘’«»"
_SPACED = str.maketrans(SEPARATORS, " " * len(SEPARATORS))
_WORD = re.compile("[0-9]+|[₹$]|[^0-9₹$]+")  #: inside what separators leave

SHAPES = [("pin_code", 6, 6), ("otp", 4, 6), ("account_number", 9, 18)]  #: digit types and the lengths that fit them
BEHIND, AHEAD = 5, 3  #: how far a cue may be from its number
ALL_TYPES = ["account_number", "otp", "pin_code", "currency", "date"]
_DATE = re.compile(r"(?<![0-9A-Za-z_])([0-9]{1,2})\s*[/.\-]\s*([0-9]{1,2})\s*[/.\-]\s*([0-9]{2,4})(?![0-9A-Za-z_])", re.ASCII)

CANDIDATE = "struct<type:string,normalized:string,start:int,end:int,part:int,k:int,cue:string>"
TOKEN = "struct<pos:int,text:string,start:int,end:int>"
MARK = "struct<pos:int,text:string,start:int,end:int,kind:string,value:decimal(28,6),month:int,cue_types:array<string>,numberish:boolean>"
RUN = "struct<lo:int,hi:int,start:int,end:int,prev_hi:int,next_lo:int,split:boolean,run_kind:string,digits:string,value:decimal(28,6),lenient:decimal(28,6)>"
BAG = "struct<cue_total:int,cue_kept:int,word_total:int,word_kept:int,lost:array<struct<type:string,n:int>>>"
_DEC, _TEXTS = pa.decimal128(28, 6), pa.list_(pa.string())
_TOKEN = {"pos": pa.int32(), "text": pa.string(), "start": pa.int32(), "end": pa.int32()}
_MARK = {**_TOKEN, "kind": pa.string(), "value": _DEC, "month": pa.int32(), "cue_types": _TEXTS, "numberish": pa.bool_()}
_CANDIDATE = {"type": pa.string(), "normalized": pa.string(), "start": pa.int32(), "end": pa.int32(), "part": pa.int32(), "k": pa.int32(), "cue": pa.string()}
_RUN = {"lo": pa.int32(), "hi": pa.int32(), "start": pa.int32(), "end": pa.int32(), "prev_hi": pa.int32(), "next_lo": pa.int32(), "split": pa.bool_(), "run_kind": pa.string(), "digits": pa.string(), "value": _DEC, "lenient": _DEC}

ONE = 10**6  #: values are counted in millionths, as decimal(28,6) holds them
KEPT = 50_000  #: words and number runs of which a task keeps the reading


def _column(values: tuple, kind: pa.DataType) -> pa.Array:
    """Values as an array; decimals come in millionths."""
    if kind != _DEC:
        return pa.array(values, kind)
    known = pa.array([v is not None for v in values], pa.bool_()).buffers()[1]
    data = b"".join([(v or 0).to_bytes(16, "little", signed=True) for v in values])
    return pa.Array.from_buffers(_DEC, len(values), [known, pa.py_buffer(data)])


def _nested(rows: list[list[tuple] | None], fields: dict[str, pa.DataType]) -> pa.Array:
    """Rows of tuples as an array of lists of structs; a row may be null."""
    ends = [0, *accumulate(len(r or ()) for r in rows)]
    offsets = [None if r is None else at for r, at in zip(rows, ends, strict=False)] + ends[-1:]
    flat = [x for r in rows if r for x in r]
    columns = list(zip(*flat, strict=True)) or [()] * len(fields)
    struct = pa.StructArray.from_arrays([_column(c, t) for c, t in zip(columns, fields.values(), strict=True)], names=list(fields))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), struct)


def _words(text: str) -> list[str]:
    """The words, digit runs and currency signs of a text."""
    out: list[str] = []
    for w in text.translate(_SPACED).split(" "):
        if w.isalpha() or w.isdigit() and w.isascii():
            out.append(w)
        elif w:
            out += _WORD.findall(w)
    return out


def _placed(text: str) -> list[tuple]:
    at, out = 0, []
    for i, w in enumerate(_words(text)):
        start = text.find(w, at)  # only separators lie between
        at = start + len(w)
        out.append((i, w, start, at))
    return out


def tokens(folded: Column) -> Column:
    """array<(pos, text, start, end)>: words, digit runs and currency signs with their place in the text; null for null."""

    @F.arrow_udf(f"array<{TOKEN}>")
    def read(texts: pa.Array) -> pa.Array:
        return _nested([None if x is None else _placed(x) for x in texts.to_pylist()], _TOKEN)

    return read(folded)


def value_of(run: list[tuple]) -> tuple[int | None, int | None]:
    """(value, lenient) in millionths of a run of (text, kind, value): see numbers.parse_both. Beyond decimal(28,6): null."""
    if len(run) == 1 and run[0][1] == "digits":
        return run[0][2], run[0][2]
    total = group = small = mod = 0  # None: a number too long to have a value
    saw = some = bad = False
    last = ""
    plus = lambda a, b: None if a is None or b is None else a + b
    for _, kind, v in run:
        if kind == "modifier":
            mod, some, last = v, True, kind
        elif kind == "scale":
            held = plus(group, small)
            bad = bad or not saw and mod == 0
            base = plus(ONE if not saw and held == 0 else held, mod)
            product = None if base is None else (base * v + ONE // 2) // ONE
            if v >= 1000 * ONE:
                total, group, saw = plus(total, product), 0, False
            else:
                group, saw = product, True
            small, mod, some, last = 0, 0, True, kind
        elif kind != "repeat":
            may_join = kind == "unit" and 0 < v < 10 * ONE
            joins = may_join and small is not None and 20 * ONE <= small < 100 * ONE and small % (10 * ONE) == 0
            bad = bad or last == "value" and kind != "fraction" and not joins and not (may_join and small is None)
            small, saw, some, last = small + v if joins else v, True, True, "value"
    tail = plus(group, small)
    if mod:
        tail = plus(tail if saw else ONE, mod)
    whole = plus(total, tail) if some else None
    whole = whole if whole is not None and abs(whole) < 10**28 else None
    return None if bad else whole, whole


def digits_of(run: list[tuple]) -> str:
    """The digits that a run spells: see numbers.parse_digits."""
    if len(run) == 1 and run[0][1] == "digits":
        return run[0][0]
    out, times = "", 1
    for text, kind, v in run:
        if kind in ("digits", "unit"):
            out, times = out + (text if kind == "digits" else str(v // ONE)) * times, 1
        elif kind == "scale" and v in (100 * ONE, 1000 * ONE):
            out += str(v // ONE)[1:] if out else str(v // ONE)
        elif kind == "repeat":
            times = v // ONE
    return out


def _reading(run: list[tuple]) -> tuple:
    kind = "magnitude" if any(k in ("scale", "modifier", "fraction") for _, k, _ in run) else "digits"
    return (kind, digits_of(run), *value_of(run))


def money_of(amount: int) -> str:
    """text.normalize_currency for millionths."""
    paise, rest = divmod(abs(amount), ONE // 100)
    paise += rest > ONE // 200 or rest == ONE // 200 and paise % 2
    return f"INR:{'-' if amount < 0 and paise else ''}{paise // 100}.{paise % 100:02d}"


def _amount(digits: str) -> int | None:
    """numbers.amount_from_digits in millionths."""
    return int(digits) * ONE if 0 < len(digits) <= 18 and (len(digits) == 1 or digits[0] != "0") else None


def wanted(types: list[str]) -> tuple:
    """What values and candidates ask of a set of types: shapes, digit types, types with cues, money, dates."""
    shapes = [s for s in SHAPES if s[0] in types]
    digit = sorted(s[0] for s in shapes)
    return shapes, digit, {*digit, "currency"}, "currency" in types, "date" in types


def values(marks: list[tuple], runs: list[tuple], asked: tuple) -> list[tuple]:
    """The candidates of all runs: see extraction.run_candidates."""
    shapes, digit, looked, money_too, _ = asked
    out, cues = [], [(m[0], m[1], [t for t in m[7] if t in looked]) for m in marks if m[7]]
    for lo, hi, start, end, before, after, split, kind, digits, value, _ in runs:
        if split:
            continue
        near: dict[str, tuple] = {}
        lowest, highest = max(lo - BEHIND, before or 0), hi + AHEAD if after is None else min(hi + AHEAD, after)
        for pos, word, of in cues:
            if lowest <= pos < lo or hi <= pos < highest:
                hit = (lo - pos, False, word) if pos < lo else (pos - hi + 1, True, word)
                for t in of:
                    if t not in near or hit < near[t]:
                        near[t] = hit
        money = near.get("currency")
        cued = [(t, near[t]) for t in digit if t in near] if near else []
        best = min([c[0] for _, c in cued]) if cued else None
        cue = money and money[2]
        if kind == "magnitude":
            if value is not None and money_too:
                out.append(("currency", money_of(value), start, end, 0, 0, cue))
            continue
        amount, k, closed = value if value is not None else _amount(digits), 0, False
        if money_too and money and amount is not None and (best is None or money[0] <= best):
            out.append(("currency", money_of(amount), start, end, 0, 0, cue))
            k, closed = 1, value is not None
        if best is not None and (not money or best <= money[0]):
            found = [(t, c[2]) for t, c in cued]
        else:
            found = [] if closed else [(t, None) for t, least, most in shapes if least <= len(digits) <= most]
        out += [(t, digits, start, end, 0, k + i, c) for i, (t, c) in enumerate(found)]
    return out


def _is_word(text: str, i: int) -> bool:
    """Whether a word goes on at text[i], a mark counting as the letter it stands on."""
    while i > 0 and unicodedata.category(text[i]) == "Mn":
        i -= 1
    return text[i] == "_" or unicodedata.category(text[i])[0] == "L" or unicodedata.category(text[i]) == "Nd"


def _day(year: int | None, month: int, day: int) -> str:
    return f"{'--' if year is None else str(year).rjust(4, '0')[:4] + '-'}{month:02d}-{day:02d}"


def dates_in_digits(text: str) -> list[tuple]:
    """The dates of a text that are written in digits: see extraction.digit_dates."""
    out, k, m = [], 0, _DATE.search(text) if "/" in text or "-" in text or "." in text else None
    while m:
        start, end = m.span()
        if start and text[start - 1] > "\x7f" and _is_word(text, start - 1) or end < len(text) and text[end] > "\x7f" and _is_word(text, end):
            m = _DATE.search(text, start + 1)
            continue
        day, month, year = map(int, m.groups())
        if 1 <= month <= 12 and 1 <= day <= 31:
            out.append(("date", _day(year + 2000 if year < 100 else year, month, day), start, end, 1, k, None))
        k, m = k + 1, _DATE.search(text, end)
    return out


def dates_in_words(marks: list[tuple], runs: list[tuple]) -> list[tuple]:
    """Month words with number runs beside them: see extraction.word_dates."""
    out = []
    for pos, _, start, end, _, _, month, _, _ in marks:
        if month is None:
            continue
        at = lambda i, p: next((r for r in runs if r[i] == p), None)
        whole = lambda r: None if r is None or r[10] is None else r[10] // ONE
        before, after = at(1, pos), at(0, pos + 1)
        b, a = whole(before), whole(after)
        early, late = b is not None and 1 <= b <= 31, a is not None and 1 <= a <= 31
        if not early and not late:
            continue
        year, last, beyond = None, end if early else after[3], at(0, after[1] + 1) if after else None
        n = whole(beyond)
        if a is not None and a >= 1000:
            year, last = a, after[3]
        elif a is not None and a <= 31 and n is not None and n >= 1000:
            year, last = n, beyond[3]
        out.append(("date", _day(year, month, b if early else a), before[2] if early else start, last, 2, pos, None))
    return out


def candidates(text: str, marks: list[tuple], runs: list[tuple], asked: tuple) -> list[tuple]:
    """What a text yields for one set of types, as wanted has it: see extraction.with_candidates."""
    found = values(marks, runs, asked)
    dates = dates_in_digits(text) + dates_in_words(marks, runs) if asked[-1] else []
    return [c for c in found if not any(d[2] <= c[2] and c[3] <= d[3] for d in dates)] + dates if dates else found


def _digits(text: str) -> tuple:
    n = int(text) * ONE if len(text.lstrip("0")) <= 22 else None
    return "digits", n, None, None


class _Layer:
    """What one layer of the lexicon makes of a text; the readings of frequent words and runs are kept."""

    def __init__(self, words: dict[str, tuple], canonical: Callable[[str], str], numbers: bool):
        self.words, self.canonical, self.numbers = words, canonical, numbers
        self.known: dict[str, tuple | None] = {}
        self.readings: dict[tuple, tuple] = {}

    def look(self, word: str) -> tuple | None:
        if "0" <= word[0] <= "9":
            return _digits(word)
        if len(self.known) > KEPT:
            self.known.clear()
        found = self.known[word] = self.words.get(self.canonical(word))
        return found

    def reading(self, words: tuple[str, ...]) -> tuple:
        if len(self.readings) > KEPT:
            self.readings.clear()
        found = self.readings[words] = _reading([(w, *(self.known.get(w) or self.look(w))[:2]) for w in words])
        return found

    def read(self, text: str) -> tuple[list[tuple], list[tuple]]:
        """(marks, runs) of a text."""
        marks, parts, hi, pos, next_at = [], [], -1, -1, 0
        known, numbers = self.known.get, self.numbers
        for piece in text.translate(_SPACED).split(" "):
            at = next_at
            next_at += len(piece) + 1
            found = known(piece, _UNSEEN)
            if found is None:
                pos += 1
                continue
            if found is not _UNSEEN:
                inside = ((piece, found),)
            elif not piece:
                continue
            elif piece.isalpha() or piece.isdigit() and piece.isascii():
                inside = ((piece, self.look(piece)),)
            else:
                inside = [(w, self.look(w)) for w in _WORD.findall(piece)]
            for w, found in inside:
                pos += 1
                start, at = at, at + len(w)
                if found is None:
                    continue
                kind, value, month, cues = found
                if kind is not None:
                    if pos == hi:
                        part[0].append(w)
                    else:
                        part = [[w], pos, start, kind, 0, 0, value]
                        parts.append(part)
                    part[4] = hi = pos + 1
                    part[5] = at
                if cues or month is not None or numbers and kind is not None:
                    marks.append((pos, w, start, at, kind, value, month, cues, kind is not None))
        runs, before, readings, n = [], None, self.readings.get, len(parts)
        for i, (words, lo, start, kind, hi, end, value) in enumerate(parts):
            after = parts[i + 1] if i + 1 < n else None
            split = kind == "scale" and before is not None and lo - before <= 2 or after is not None and after[3] == "scale" and after[1] - hi <= 2
            if kind == "digits" and hi == lo + 1:
                read = ("digits", words[0], value, value)
            else:
                key = tuple(words)
                read = readings(key) or self.reading(key)
            runs.append((lo, hi, start, end, before, after and after[1], split, *read))
            before = hi
        return marks, runs


_UNSEEN = ("",)


def reader(layers: dict[str, dict[str, tuple]], by_language: bool, canonical: Callable[[str], str], numbers: bool = False, types: list[str] | None = None, parts: tuple[str, ...] = ("marks", "runs"), alone: bool = False) -> Callable[..., Column]:
    """(folded text[, language][, array of types]) -> struct of parts (marks, runs, found), null for a null text. layers:
    canonical form -> (kind, value in millionths, month, cue types) by layer. marks are months and cues, and with numbers
    the words of numbers too; found the candidates for types, or, alone, those for each type of the array by itself."""

    fields = {"marks": (MARK, _MARK), "runs": (RUN, _RUN), "found": (CANDIDATE, _CANDIDATE)}
    kind = ",".join(f"{x}:array<{fields[x][0]}>" for x in parts)
    held: dict[str, _Layer] = {}  # of the task's Python process
    sought, each = wanted(types or ALL_TYPES), {t: wanted([t]) for t in ALL_TYPES}
    fallback = "en" if "en" in layers else min(layers, default="")

    def layer(language: str | None) -> _Layer:
        key = re.split("[-_]", (language or "").lower())[0] if by_language else ""
        key = key if key in layers else fallback
        if key not in held:
            held[key] = _Layer(layers.get(key, {}), canonical, numbers)
        return held[key]

    def row(text: str | None, language: _Layer, mine: list[str] | None) -> dict[str, list[tuple] | None]:
        if text is None:
            return dict.fromkeys(fields)
        marks, runs = language.read(text)
        found = []
        if "found" in parts:
            for one in [sought] if not alone else [each[t] for t in mine or () if t in each]:
                found += candidates(text, marks, runs, one)
        return {"marks": marks, "runs": runs, "found": found}

    @F.arrow_udf(f"struct<{kind}>")
    def read(*columns: pa.Array) -> pa.Array:
        texts, *others = (c.to_pylist() for c in columns)
        spoken = others[0] if by_language else [None] * len(texts)
        by = {x: layer(x) for x in set(spoken)}
        gc.disable()  # a batch makes many tuples and no cycles
        try:
            out = [row(text, by[x], w) for text, x, w in zip(texts, spoken, others[-1] if alone else spoken, strict=True)]
            return pa.StructArray.from_arrays([_nested([r[x] for r in out], fields[x][1]) for x in parts], names=list(parts))
        finally:
            gc.enable()

    return read


def bags(cues: dict[str, list[str]], canonical: Callable[[str], str]) -> Callable[[Column, Column], Column]:
    """(folded reference, folded hypothesis) -> struct: the cue words and the other words of the reference, how many of
    either came through (bag intersection of canonical forms), and lost, the types that have a cue in the reference and none
    in the hypothesis, with the number of their cues. cues: canonical form -> types. A null text has no words."""
    held: dict[str, str] = {}  # of the task's Python process

    def spelt(word: str) -> str:
        if len(held) > KEPT:
            held.clear()
        found = held[word] = word if "0" <= word[0] <= "9" else canonical(word)
        return found

    def bag(text: str | None) -> dict[str, int]:
        out: dict[str, int] = {}
        for w in _words(text or ""):
            c = held.get(w)
            if c is None:
                c = spelt(w)
            out[c] = out.get(c, 0) + 1
        return out

    def row(reference: str | None, hypothesis: str | None) -> tuple:
        said, heard = bag(reference), bag(hypothesis)
        cue_total = cue_kept = kept = 0
        had: dict[str, int] = {}
        for c, n in said.items():
            came = min(n, heard.get(c, 0))
            kept += came
            if c in cues:
                cue_total, cue_kept = cue_total + n, cue_kept + came
                for t in cues[c]:
                    had[t] = had.get(t, 0) + n
        there = {t for c in cues.keys() & heard.keys() for t in cues[c]} if had else ()
        return cue_total, cue_kept, sum(said.values()) - cue_total, kept - cue_kept, [(t, n) for t, n in sorted(had.items()) if t not in there]

    @F.arrow_udf(BAG)
    def read(reference: pa.Array, hypothesis: pa.Array) -> pa.Array:
        *counts, lost = zip(*map(row, reference.to_pylist(), hypothesis.to_pylist()), strict=True) if len(reference) else [()] * 5
        arrays = [*(pa.array(c, pa.int32()) for c in counts), _nested(list(lost), {"type": pa.string(), "n": pa.int32()})]
        return pa.StructArray.from_arrays(arrays, names=["cue_total", "cue_kept", "word_total", "word_kept", "lost"])

    return read
