"""Labelled corpora from a seed: every row depends on (seed, language, number) alone, so a smaller corpus is a prefix."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lexicon as L
from ..functions import text as T

#: By language: (id, text, gloss, domain, code_mixed); slots are {type} or {type:name}, in text and gloss. English needs
#: no gloss.
HINDI_TEMPLATES = [
    ("bal", "खाते {account_number} में {currency} रुपये शेष हैं", "account {account_number} holds {currency} rupees", "banking", False),
    ("otp", "आपका ओटीपी {otp} है इसे न बताएँ", "your code is {otp} do not tell it", "banking", False),
    ("pin", "पिन {pin_code} पर सामान {date} तक पहुँचेगा", "the parcel reaches pin {pin_code} by {date}", "delivery", False),
    ("due", "{currency} रुपये का भुगतान {date} तक करना है", "{currency} rupees are due by {date}", "billing", False),
    ("two", "code {otp:first} या code {otp:second} बताइए", "tell code {otp:first} or code {otp:second}", "banking", True),
]
TEMPLATES = [
    ("bal", "the balance of account {account_number} is rupees {currency}", "banking", False),
    ("otp", "your code is {otp} do not share it", "banking", False),
    ("pin", "deliver to pin {pin_code} by {date}", "delivery", False),
    ("due", "payment of rupees {currency} is due on {date}", "billing", False),
    ("two", "use code {otp:first} or code {otp:second}", "banking", False),
]


def draw(seed: int, language: Column, i: Column, slot: str, modulus: int, salt: str = "") -> Column:
    """A number below modulus from the hash of where it is used; never rand()."""
    return F.pmod(F.xxhash64(F.lit(seed), language, i, F.lit(slot + salt)), F.lit(modulus))


def sample_account(r) -> Column:
    """11 to 16 digits, the first not zero."""
    digits = F.concat(F.lpad(r(10**9, "a").cast("string"), 9, "0"), F.lpad(r(10**9, "b").cast("string"), 9, "0"))
    return F.concat((r(9, "head") + 1).cast("string"), F.substr(digits, F.lit(1), (r(6, "len") + 10).cast("int")))


def sample_otp(r) -> Column:
    """4 or 6 digits; a leading zero is allowed."""
    return F.when(r(2, "len") == 0, F.lpad(r(10**4, "v").cast("string"), 4, "0")).otherwise(F.lpad(r(10**6, "v").cast("string"), 6, "0"))


def sample_pin(r) -> Column:
    """6 digits, the first 1 to 8."""
    return F.concat((r(8, "head") + 1).cast("string"), F.lpad(r(10**5, "v").cast("string"), 5, "0"))


def sample_currency(r) -> Column:
    """Five equal buckets: hundreds, thousands, lakhs, crores, and a quarter or half of a scale."""
    units = F.element_at(F.array(*(F.lit(x).cast("long") for x in (100, 1000, 100000, 10000000))), (r(4, "scale") + 1).cast("int"))
    whole = (r(99, "v") + 1) * F.element_at(F.array(*(F.lit(x).cast("long") for x in (100, 1000, 100000, 10000000, 0))), (r(5, "bucket") + 1).cast("int"))
    fractional = (r(9, "v") + 2) * units + F.floor(units * F.element_at(F.array(F.lit(0.5), F.lit(0.25), F.lit(-0.25)), (r(3, "mod") + 1).cast("int")))
    return F.when(r(5, "bucket") == 4, fractional).otherwise(whole).cast("long")


def spoken_currency(r, language: str) -> Column:
    """The words for sample_currency's value: in Hindi a quarter or half of a scale is a modifier, a number and the scale."""
    whole = L.number_words(sample_currency(r), language)
    if base_of(language) != "hi":
        return whole
    modifier = T.word_of([L.MODIFIERS[m].split()[0] for m in ("0.5", "0.25", "-0.25")], r(3, "mod"))
    fractional = F.concat_ws(" ", modifier, T.word_of(L.HINDI_0_TO_99.split(), r(9, "v") + 2), T.word_of(list(L.HINDI_SCALES), r(4, "scale")))
    return F.when(r(5, "bucket") == 4, fractional).otherwise(whole)


def base_of(language: str) -> str:
    return language.lower().split("-")[0]


def sample_date(r) -> Column:
    return F.date_add(F.lit("2026-01-01").cast("date"), r(701, "v").cast("int"))


def generate_corpus(keys: DataFrame, seed: int, language: str = "en-IN") -> DataFrame:
    """One labelled utterance per row of keys(i long): id, template_id, realization, text, gloss (null in English),
    entities with surface and normal form. Gold comes from the sampled value, never from the text. Hindi rows speak Hindi
    numbers and months, all others English ones."""
    lang, i = F.lit(language), F.col("i")
    spark = keys.sparkSession
    known = templates(spark).where(F.col("language") == ("hi" if base_of(language) == "hi" else "en")).withColumnRenamed("text", "template")
    rows = keys.withColumn("_k", (i % len(TEMPLATES)).cast("int")).join(F.broadcast(known.drop("language")), "_k")  # a handful of templates
    rows = rows.withColumn("realization", F.when(draw(seed, lang, i, "realization", 2) == 0, "digits").otherwise("words"))
    words = F.col("realization") == "words"
    months = (L.MONTHS_HINDI if base_of(language) == "hi" else L.MONTHS).split()
    month = lambda v: T.word_of(months, F.month(v) - 1)
    text, gloss, entities = F.col("template"), F.col("gloss"), []
    for slot in ("account_number", "otp", "pin_code", "currency", "date", "otp:first", "otp:second"):
        r = lambda m, salt, s=slot: draw(seed, lang, i, s, m, salt)
        kind = slot.split(":")[0]
        if kind == "currency":
            v = sample_currency(r)
            norm, surface = T.normalize_currency(v), F.when(words, spoken_currency(r, language)).otherwise(T.indian_grouping(v))
        elif kind == "date":
            v = sample_date(r)
            norm = F.date_format(v, "yyyy-MM-dd")
            surface = F.when(words, F.concat_ws(" ", L.number_words(F.dayofmonth(v), language), month(v), L.number_words(F.year(v), language))).otherwise(F.date_format(v, "dd/MM/yyyy"))
        else:
            norm = {"account_number": sample_account, "otp": sample_otp, "pin_code": sample_pin}[kind](r)
            surface = F.when(words, L.digit_words(norm, language)).otherwise(norm)
        hole = F.lit("{" + slot + "}")
        entities.append(F.when(F.contains("template", hole), F.struct(F.lit(kind).alias("type"), surface.alias("surface"), norm.alias("normalized"))))
        text, gloss = F.replace(text, hole, surface), F.replace(gloss, hole, surface)
    ident = F.concat(F.lit(f"{language}-{seed}-"), F.format_string("%05d", i))
    return rows.select("i", ident.alias("id"), lang.alias("language"), "template_id", "domain", "realization", text.alias("text"), gloss.alias("gloss"), F.filter(F.array(*entities), lambda e: e.isNotNull()).alias("entities"))


def templates(spark: SparkSession) -> DataFrame:
    """(language, _k, template_id, text, gloss, domain, code_mixed) of all languages."""
    rows = [("en", k, t[0], t[1], None, *t[2:]) for k, t in enumerate(TEMPLATES)] + [("hi", k, *t) for k, t in enumerate(HINDI_TEMPLATES)]
    return spark.createDataFrame(rows, "language string, _k int, template_id string, text string, gloss string, domain string, code_mixed boolean")
