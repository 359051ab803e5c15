"""Folds over the tokens of a number run: array<struct<text, kind, value>> -> value or digits.

kind is digits, unit, scale, fraction, modifier or repeat; a written number carries its value like a word does.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEC = "decimal(28,6)"


def _dec(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast(DEC)


def lone(tokens: Column) -> Column:
    return (F.size(tokens) == 1) & (tokens[0]["kind"] == "digits")


def parse_both(tokens: Column) -> Column:
    """(value, lenient): the magnitude that the words say, with Indian grouping; null if they say none. value is null too
    where something looks truncated: a bare scale, or two values with no scale between them.

    The state holds the finished total, the hundreds and the rest of the open group, a pending fraction, and what came
    last. A lone written number is itself.
    """
    fields = [("total", _dec(0)), ("group", _dec(0)), ("small", _dec(0)), ("mod", _dec(0)), ("saw", F.lit(False)), ("some", F.lit(False)), ("prev", F.lit("")), ("bad", F.lit(False))]
    start = F.struct(*(c.alias(n) for n, c in fields))

    def step(s, t):
        kind, v = t["kind"], t["value"]
        unit = kind == "unit"
        joins = unit & (s["small"] >= 20) & (s["small"] < 100) & (s["small"] % 10 == 0) & (v > 0) & (v < 10)
        value = kind.isin("digits", "unit", "fraction")
        clash = (s["prev"] == "value") & kind.isin("digits", "unit") & ~joins
        scale = kind == "scale"
        bare = scale & ~s["saw"] & (s["mod"] == 0)
        held = s["group"] + s["small"]
        base = F.when(~s["saw"] & (held == 0), _dec(1)).otherwise(held) + s["mod"]
        big = scale & (v >= 1000)
        hundred = scale & ~big
        return F.struct(
            F.when(big, s["total"] + base * v).otherwise(s["total"]).cast(DEC).alias("total"),
            F.when(big, _dec(0)).when(hundred, base * v).otherwise(s["group"]).cast(DEC).alias("group"),
            F.when(scale, _dec(0)).when(joins, s["small"] + v).when(value, v).otherwise(s["small"]).cast(DEC).alias("small"),
            F.when(kind == "modifier", v).when(scale, _dec(0)).otherwise(s["mod"]).cast(DEC).alias("mod"),
            F.coalesce(F.when(big, F.lit(False)).when(hundred | value, F.lit(True)).otherwise(s["saw"]), F.lit(False)).alias("saw"),
            F.coalesce(s["some"] | value | scale | (kind == "modifier"), s["some"]).alias("some"),
            F.when(value, "value").when(scale, "scale").when(kind == "modifier", "modifier").otherwise(s["prev"]).alias("prev"),
            F.coalesce(s["bad"] | clash | bare, s["bad"]).alias("bad"),
        )

    def finish(s):
        tail = s["group"] + s["small"]
        tail = F.when(s["mod"] != 0, F.when(s["saw"], tail).otherwise(_dec(1)) + s["mod"]).otherwise(tail)
        whole = F.when(s["some"], (s["total"] + tail).cast(DEC))
        return F.struct(F.when(~s["bad"], whole).alias("value"), whole.alias("lenient"))

    return F.when(lone(tokens), F.struct(_dec(tokens[0]["value"]).alias("value"), _dec(tokens[0]["value"]).alias("lenient"))).otherwise(F.aggregate(tokens, start, step, finish))


def parse_value(tokens: Column, strict: bool = False) -> Column:
    """The magnitude alone: see parse_both."""
    return parse_both(tokens)["value" if strict else "lenient"]




def parse_digits(tokens: Column) -> Column:
    """The digit string that the words spell; double and triple repeat the next, hundred and thousand append zeros."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("times"))

    def step(s, t):
        written = F.when(t["kind"] == "digits", t["text"]).when(t["kind"] == "unit", t["value"].cast("long").cast("string"))
        zeros = F.when((t["kind"] == "scale") & (t["value"] == 100), F.lit("00")).when((t["kind"] == "scale") & (t["value"] == 1000), F.lit("000"))
        add = F.when(written.isNotNull(), F.repeat(written, s["times"])).when(zeros.isNotNull(), F.when(s["out"] == "", t["value"].cast("long").cast("string")).otherwise(zeros)).otherwise("")
        return F.struct(F.concat(s["out"], add).alias("out"), F.when(t["kind"] == "repeat", t["value"].cast("int")).when(written.isNotNull(), 1).otherwise(s["times"]).alias("times"))

    return F.when(lone(tokens), tokens[0]["text"]).otherwise(F.aggregate(tokens, start, step, lambda s: s["out"]))


def run_kind(tokens: Column) -> Column:
    return F.when(F.exists(tokens, lambda t: F.coalesce(t["kind"].isin("scale", "modifier", "fraction"), F.lit(False))), "magnitude").otherwise("digits")


def amount_from_digits(digits: Column) -> Column:
    """A digit string may be money unless it is empty or has a leading zero."""
    return F.when((digits != "") & ~((F.length(digits) > 1) & digits.startswith("0")) & (F.length(digits) <= 18), digits.cast(DEC))
