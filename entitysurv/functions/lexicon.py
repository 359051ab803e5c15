"""Number words, scales, months and cue words as a small dimension table."""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import reading
from . import text as T
from .text import language_key

BUCKETS = 64  #: small maps that the lexicon is cut into

# The vocabulary of Hindi and Indian English numbers, in order of value.
HINDI_0_TO_99 = (
    "शून्य एक दो तीन चार पाँच छह सात आठ नौ दस ग्यारह बारह तेरह चौदह पंद्रह सोलह सत्रह अठारह उन्नीस "
    "बीस इक्कीस बाईस तेईस चौबीस पच्चीस छब्बीस सत्ताईस अट्ठाईस उनतीस तीस इकतीस बत्तीस तैंतीस चौंतीस पैंतीस छत्तीस सैंतीस अड़तीस उनतालीस "
    "चालीस इकतालीस बयालीस तैंतालीस चवालीस पैंतालीस छियालीस सैंतालीस अड़तालीस उनचास पचास इक्यावन बावन तिरेपन चौवन पचपन छप्पन सत्तावन अट्ठावन उनसठ "
    "साठ इकसठ बासठ तिरसठ चौंसठ पैंसठ छियासठ सड़सठ अड़सठ उनहत्तर सत्तर इकहत्तर बहत्तर तिहत्तर चौहत्तर पचहत्तर छिहत्तर सतहत्तर अठहत्तर उन्यासी "
    "अस्सी इक्यासी बयासी तिरासी चौरासी पचासी छियासी सत्तासी अट्ठासी नवासी नब्बे इक्यानवे बानवे तिरानवे चौरानवे पचानवे छियानवे सत्तानवे अट्ठानवे निन्यानवे"
)
# Further spellings of these numbers, by value.
HINDI_VARIANTS = {5: "पांच", 6: "छः छे छै", 9: "नो", 11: "ग्यारा", 12: "बारा", 15: "पन्द्रह पंद्रा", 18: "अट्ठारह", 19: "उन्निस", 22: "बाइस", 23: "तेइस", 25: "पचीस", 28: "अठाइस", 29: "उन्तीस", 31: "इकत्तीस", 39: "उन्तालीस", 43: "तिरालीस", 44: "चौवालीस", 49: "उन्चास", 51: "इकावन", 53: "तिरपन", 57: "सतावन", 59: "उन्सठ", 66: "छाछठ", 69: "उन्हत्तर", 79: "उनासी", 86: "छयासी", 89: "नौवासी", 91: "इकानवे", 99: "निन्नानवे"}
# The same in Latin letters, in order of value: a parameter (see romanised), as some are English words too.
HINDI_ROMAN_0_TO_99 = (
    "shunya ek do teen chaar paanch chhah saat aath nau das gyaarah baarah terah chaudah pandrah solah satrah athaarah unnees "
    "bees ikkees baees teis chaubees pachchees chhabbees sattaees atthaees untees tees ikattees battees taintees chauntees paintees chhattees saintees adtees untaalees "
    "chaalees iktaalees bayaalees taintaalees chavaalees paintaalees chhiyaalees saintaalees adtaalees unchaas pachaas ikyaavan baavan tirpan chauvan pachpan chhappan sattaavan atthaavan unsath "
    "saath iksath baasath tirsath chaunsath painsath chhiyaasath sadsath adsath unhattar sattar ikhattar bahattar tihattar chauhattar pachhattar chhihattar satahattar athahattar unyaasee "
    "assee ikyaasee bayaasee tiraasee chauraasee pachaasee chhiyaasee sataasee athaasee navaasee nabbe ikyaanave baanave tiraanave chauraanave pachaanave chhiyaanave sattaanave atthaanave ninyaanave"
)
HINDI_SCALES = ("सौ", "हज़ार", "लाख", "करोड़")
ENGLISH_0_TO_20 = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty"
ENGLISH_TENS = "thirty forty fifty sixty seventy eighty ninety"
SCALES = {100: "सौ sau hundred", 1000: "हज़ार hazaar thousand", 100000: "लाख lakh lakhs lac", 10000000: "करोड़ crore crores", 1000000000: "अरब arab"}
FRACTIONS = {"1.5": "डेढ़ derh dedh", "2.5": "ढाई dhai"}
MODIFIERS = {"0.5": "साढ़े saadhe sade", "0.25": "सवा sawa sava", "-0.25": "पौने paune pone"}
REPEATS = {2: "डबल double", 3: "ट्रिपल triple treble"}
CUES = {
    "currency": "रुपये रुपए राशि बकाया शेष भुगतान rupees rupee rs inr balance payment ₹",
    "otp": "ओटीपी कोड otp code password",
    "account_number": "खाता खाते अकाउंट account acct",
    "pin_code": "पिन पिनकोड pin pincode postal zip",
}
MONTHS = "january february march april may june july august september october november december"
MONTHS_HINDI = "जनवरी फरवरी मार्च अप्रैल मई जून जुलाई अगस्त सितंबर अक्टूबर नवंबर दिसंबर"

#: Letters of one code point that hold a nukta, and their bases; as escapes, since an editor may take them apart.
NUKTA_LETTERS = ("\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f\u0929\u0931\u0934", "कखगजडढफयनरळ")
# A stop that is written before its aspirate, or any consonant before itself, is dropped with the virama
# between.
STOPS = {"क": "ख", "ग": "घ", "च": "छ", "ज": "झ", "ट": "ठ", "ड": "ढ", "त": "थ", "द": "ध", "प": "फ", "ब": "भ"}
_PLAIN = str.maketrans(*NUKTA_LETTERS)


def canonicalize(word: Column) -> Column:
    """The look-up key of a word: spelling variants of one number word fall together.

    Devanagari: no nukta, chandrabindu as anusvara, no doubled consonants, two regular vowel alternations. Latin: z as
    j, long vowels short, doubled letters single.
    """
    w = F.translate(F.lower(F.trim(word)), NUKTA_LETTERS[0], NUKTA_LETTERS[1])
    w = F.translate(F.regexp_replace(w, "़", ""), "ँ", "ं")
    d = w
    for _ in range(2):
        d = F.regexp_replace(d, "([क-ह])्(?=\\1)", "")
        for first, second in STOPS.items():
            d = F.replace(d, F.lit(f"{first}्{second}"), F.lit(second))
    d = F.replace(F.replace(d, F.lit("िय"), F.lit("य")), F.lit("नब"), F.lit("नव"))
    w = F.when(w.rlike("[\\x{0900}-\\x{097F}]"), d).otherwise(w)
    v = F.replace(w, F.lit("z"), F.lit("j"))
    for long, short in (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u")):
        v = F.replace(v, F.lit(long), F.lit(short))
    w = F.when(w.rlike("[a-z]"), F.regexp_replace(v, r"(.)\1+", "$1")).otherwise(w)
    return F.regexp_replace(w, "^[.\\-_'।]+|[.\\-_'।]+$", "")


def canonical(word: str) -> str:
    """canonicalize for a word that a task reads."""
    w = word.strip(" ").lower().translate(_PLAIN).replace("़", "").replace("ँ", "ं")
    if re.search("[\u0900-\u097f]", w):
        for _ in range(2):
            w = re.sub("([क-ह])्(?=\\1)", "", w)
            for first, second in STOPS.items():
                w = w.replace(f"{first}्{second}", second)
        w = w.replace("िय", "य").replace("नब", "नव")
    if re.search("[a-z]", w):
        w = w.replace("z", "j")
        for long, short in (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u")):
            w = w.replace(long, short)
        w = re.sub(r"(.)\1+", r"\1", w)
    return re.sub(r"^[.\-_'।]+|[.\-_'।]+$", "", w)


def canonical_words(words: Column) -> Column:
    """canonicalize for an array of words that hold no line feed, in one pass over all of them: the letters of either
    script are folded by rules that leave the other alone, so only doubled letters have to be told word by word."""
    w = F.translate(F.lower(F.array_join(words, "\n")), NUKTA_LETTERS[0], NUKTA_LETTERS[1])
    w = F.translate(F.regexp_replace(w, "़", ""), "ँ", "ं")

    def devanagari(d):
        for _ in range(2):
            d = F.regexp_replace(d, "([क-ह])्(?=\\1)", "")
            for first, second in STOPS.items():
                d = F.replace(d, F.lit(f"{first}्{second}"), F.lit(second))
        return F.replace(F.replace(d, F.lit("िय"), F.lit("य")), F.lit("नब"), F.lit("नव"))

    def latin(d):
        v = F.replace(d, F.lit("z"), F.lit("j"))
        for long, short in (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u")):
            v = F.replace(v, F.lit(long), F.lit(short))
        return F.zip_with(F.split(d, "\n"), F.split(F.regexp_replace(v, r"([^\n])\1+", "$1"), "\n"), lambda a, b: F.when(a.rlike("[a-z]"), b).otherwise(a))

    bound = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    d = bound(w, lambda x: F.when(x.rlike("[\\x{0900}-\\x{097F}]"), devanagari(x)).otherwise(x))
    edges = "(?md)^[.\\-_'।]+|[.\\-_'।]+$"
    folded = bound(F.regexp_replace(d, edges, ""), latin)
    return F.when(F.size(words) > 0, folded).otherwise(words)


def _rows(lexicon: DataFrame, most: int) -> list:
    layer = F.col("language") if "language" in lexicon.columns else F.lit("")
    rows = lexicon.select(layer.alias("layer"), "canon", "kind", F.col("value").cast("string").alias("value"), "month", "cue_types", F.pmod(F.hash("canon"), F.lit(BUCKETS)).alias("bucket")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"the lexicon has over {most} words")
    return rows


def reader(lexicon: DataFrame, numbers: bool = False, most: int = 50_000, **asked) -> Callable[..., Column]:
    """(folded text[, language]) -> struct(marks, runs), or what else is asked for, by a lexicon of at most `most` words,
    which goes with the task: see reading.reader. With a column language it is one by language, as in lookup."""
    layers: dict[str, dict] = {}
    for r in _rows(lexicon, most):
        layers.setdefault(r.layer, {})[r.canon] = (r.kind, r.value and int(Decimal(r.value).scaleb(6)), r.month, r.cue_types or [])
    return reading.reader(layers, "language" in lexicon.columns, canonical, numbers, **asked)


def bags(lexicon: DataFrame, most: int = 50_000) -> Callable[[Column, Column], Column]:
    """(folded reference, folded hypothesis) -> how cues and other words came through, by the cue words of a lexicon without
    languages: see reading.bags."""
    return reading.bags({r.canon: r.cue_types for r in _rows(lexicon, most) if r.cue_types}, canonical)


def lookup(lexicon: DataFrame, most: int = 50_000) -> Callable[[Column, Column | None], Column]:
    """(canonical form, language) -> struct(kind, value, month, cue_types), null for other words.

    The lexicon is a fixed vocabulary (over `most` rows it is refused) and becomes a constant of the plan, as small maps by
    a hash of the form. With a column language it is one by language: the text's language picks the layer, and languages
    that it does not know read as English.
    """
    by_language, rows = "language" in lexicon.columns, _rows(lexicon, most)
    kind = "array<map<string,struct<kind:string,value:decimal(28,6),month:int,cue_types:array<string>>>>"

    def maps(name):
        mine: list[dict] = [{} for _ in range(BUCKETS)]
        for r in rows:
            if r.layer == name:
                mine[r.bucket][r.canon] = {"kind": r.kind, "value": r.value and float(r.value), "month": r.month, "cue_types": r.cue_types or []}
        return F.from_json(F.lit(json.dumps(mine)), kind)  # one node of the plan, which the optimizer makes a constant

    layers = sorted({r.layer for r in rows})
    if not layers:
        return lambda word, language=None: F.lit(None).cast(kind.removeprefix("array<map<string,")[:-2])
    every = {name: maps(name) for name in layers}

    def find(word: Column, language: Column | None = None) -> Column:
        held = every[layers[0]]
        if by_language:
            if language is None:
                raise ValueError("a lexicon by language needs the language of each text")
            held = every.get("en", held)
            for name in layers:
                if name != "en":
                    held = F.when(language_key(language, tuple(layers)) == name, every[name]).otherwise(held)
        return F.try_element_at(F.get(held, F.pmod(F.hash(word), F.lit(BUCKETS))), word)

    return find


def entries() -> list[tuple]:
    """(word, kind, value, month, cue type) in order of precedence."""
    out = [(w, "unit", str(i), None, None) for i, w in enumerate(HINDI_0_TO_99.split())]
    out += [(w, "unit", str(n), None, None) for n, words in HINDI_VARIANTS.items() for w in words.split()]
    out += [(w, "unit", str(i), None, None) for i, w in enumerate(ENGLISH_0_TO_20.split())]
    out += [(w, "unit", str(30 + 10 * i), None, None) for i, w in enumerate(ENGLISH_TENS.split())]
    for kind, table in (("scale", SCALES), ("fraction", FRACTIONS), ("modifier", MODIFIERS), ("repeat", REPEATS)):
        out += [(w, kind, str(v), None, None) for v, words in table.items() for w in words.split()]
    for months in (MONTHS, MONTHS_HINDI):
        out += [(w, None, None, i + 1, None) for i, w in enumerate(months.split())]
    out += [(w[:3], None, None, i + 1, None) for i, w in enumerate(MONTHS.split())]
    return out + [(w, None, None, None, t) for t, words in CUES.items() for w in words.split()]


def romanised() -> list[tuple]:
    """Hindi numbers in Latin letters, as `extra` entries of the lexicon for text that is known to be Hindi."""
    return [(w, "unit", str(i), None, None) for i, w in enumerate(HINDI_ROMAN_0_TO_99.split())]


# Hindi words in Latin letters among the scales, fractions and modifiers; the other Latin words are English.
HINDI_IN_LATIN = "sau hazaar arab derh dedh dhai saadhe sade sawa sava paune pone".split()


def number_words(n: Column, language: str) -> Column:
    """A whole number under 10^11 as a speaker of the language says it."""
    return T.number_to_words(n, HINDI_0_TO_99.split(), HINDI_SCALES) if language.lower().startswith("hi") else T.number_to_words(n)


def digit_words(d: Column, language: str) -> Column:
    """A string of digits, read one by one."""
    return T.digits_to_words(d, HINDI_0_TO_99.split()) if language.lower().startswith("hi") else T.digits_to_words(d)


def layers() -> dict[str, list[tuple]]:
    """The entries of each language in order of precedence: its own words first, English ones below, as speech mixes them."""
    hindi = lambda w: any("\u0900" <= c <= "\u097f" for c in w) or w in HINDI_IN_LATIN
    english = [e for e in entries() if not hindi(e[0])]
    return {"en": english, "hi": [e for e in entries() if hindi(e[0])] + romanised() + english}


def lexicon_by_language(spark: SparkSession) -> DataFrame:
    """(language, canon, kind, value, month, cue_types): one layer for each language. A text's language picks its layer,
    and a language without one reads as English: see lookup."""
    rows = [(language, i, *e) for language, words in layers().items() for i, e in enumerate(words)]
    return _dimension(spark.createDataFrame(rows, f"language string, {_ENTRY}"), "language")


_ENTRY = "place int, word string, kind string, value string, month int, cue string"


def _dimension(rows: DataFrame, *by: str) -> DataFrame:
    df = rows.withColumn("canon", canonicalize(F.col("word")))
    known = F.when(F.col("kind").isNotNull(), F.col("place"))
    return df.groupBy(*by, "canon").agg(F.min_by("kind", known).alias("kind"), F.min_by(F.col("value").cast("decimal(28,6)"), known).alias("value"), F.min_by("month", F.when(F.col("month").isNotNull(), F.col("place"))).alias("month"), F.array_sort(F.collect_set("cue")).alias("cue_types"))


def lexicon(spark: SparkSession, extra: list[tuple] | None = None) -> DataFrame:
    """One row per canonical form: kind, value, month, cue_types. extra entries come after the built-in ones, so a
    caller adds spellings or languages without changing what is known."""
    rows = [(i, *e) for i, e in enumerate(entries() + (extra or []))]
    return _dimension(spark.createDataFrame(rows, _ENTRY))
