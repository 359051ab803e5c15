"""What a task reads of a text, against the column expressions for the same."""

import itertools
import random

from pyspark.sql import functions as F

from entitysurv.functions import numbers as N
from entitysurv.functions import reading as R
from entitysurv.functions.lexicon import NUKTA_LETTERS, STOPS, canonical, canonicalize, entries, lexicon, romanised
from entitysurv.operators import extraction as X
from entitysurv.operators import scoring as S
from entitysurv.plans import call_queries, demo, more_queries


def test_number_runs_read_as_the_column_expressions_do(spark):
    """All runs of up to three kinds of number words and digits, and random longer ones."""
    some = ["five", "twenty", "fifteen", "hundred", "lakh", "dhai", "saadhe", "paune", "double", "7", "007", "250000"]
    rng = random.Random(5)
    runs = [list(x) for n in (1, 2, 3) for x in itertools.product(some, repeat=n)] + [rng.choices(some, k=rng.randint(4, 9)) for _ in range(3000)]
    texts = spark.createDataFrame([(i, " ".join(r)) for i, r in enumerate(runs)], "row_key int, text string").repartition(4)
    toks = F.array_sort(F.collect_list(F.struct("pos", "text", "kind", "value")))
    t = X.with_lexicon(X.tokenize(texts.withColumnRenamed("text", "folded")), lexicon(spark)).groupBy("row_key").agg(toks.alias("t"))
    want = t.select("row_key", N.run_kind(F.col("t")).alias("k"), N.parse_digits(F.col("t")).alias("d"), N.parse_both(F.col("t")).alias("v"))
    got = X.number_runs(texts, lexicon(spark)).select("row_key", "run_kind", "digits", "value", "lenient")
    assert {(r.row_key, r.k, r.d, r.v.value, r.v.lenient) for r in want.collect()} == {tuple(r) for r in got.collect()}
    assert len(runs) == got.count()


def test_words_and_their_canonical_forms(spark):
    words = [e[0] for e in entries() + romanised()] + [a + "्" + b + x for a, b in STOPS.items() for x in ("", a, "ि" + "य")] + [*NUKTA_LETTERS[0], "Saadhe", "ZZeroo", "_-one'", "क्क्क"]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", canonicalize(F.col("w")).alias("c")).collect()
    assert [(r.w, canonical(r.w)) for r in got] == [(r.w, r.c) for r in got]
    texts = spark.createDataFrame([(0, "a,b₹5x’é 12-3"), (1, ""), (2, None)], "row_key int, folded string")
    assert [tuple(r) for r in X.tokenize(texts).collect()] == [(0, 0, "a", 0, 1), (0, 1, "b", 2, 3), (0, 2, "₹", 3, 4), (0, 3, "5", 4, 5), (0, 4, "x", 5, 6), (0, 5, "é", 7, 8), (0, 6, "12", 9, 11), (0, 7, "3", 12, 13)]
    assert [r.text for r in X.words(texts).collect()] == ["a", "b", "₹", "5", "x", "é", "12", "3"]


def test_numbers_past_every_type_have_no_value():
    assert R.value_of([("9" * 30, "digits", None), ("crore", "scale", 10**13)]) == (None, None)
    assert R.value_of([("9" * 21, "digits", int("9" * 21) * R.ONE), ("crore", "scale", 10**13)]) == (None, None)


def test_candidates_of_the_scan_are_those_of_the_column_expressions(spark):
    """Random sentences of cues, months, numbers, dates and odd neighbours of dates, for each set of types."""
    some = "code otp account pin rupees amount is the blah may march twenty five hundred lakh dhai paune zero one double 7 0042 31 1995 250000 123456789012 12/03/95 1-13-2020 32.1.345 a1/2/34/56 ½1/2/2020 é1/2/20 5/6/77é क़12/1/20 x_1/2/2003 1/2/34/5678 ₹ 1,00,000".split()
    rng = random.Random(7)
    texts = spark.createDataFrame([(i, " ".join(rng.choices(some, k=rng.randint(1, 16)))) for i in range(4000)] + [(-1, None), (-2, "")], "row_key int, text string").repartition(4)
    held, each = X.annotate(texts, lexicon(spark), F.col("text")), F.array(*map(F.lit, X.ALL_TYPES))
    for types in (None, ["otp", "date"], ["account_number", "pin_code"], ["currency"]):
        want = X.with_candidates(held, types).select("row_key", F.to_json("_found"))
        got = X.extracted(texts, lexicon(spark), F.col("text"), types).select("row_key", F.to_json("_found"))
        assert {tuple(r) for r in want.collect()} == {tuple(r) for r in got.collect()}
    alone = X.extracted(texts, lexicon(spark), F.col("text"), alone=each).select("row_key", F.to_json("_found"))
    one = held
    for t in X.ALL_TYPES:
        one = X.with_candidates(one, [t], f"_{t}")
    assert {tuple(r) for r in one.select("row_key", F.to_json(F.concat(*(f"_{t}" for t in X.ALL_TYPES)))).collect()} == {tuple(r) for r in alone.collect()}


def test_money_is_rounded_half_to_even():
    assert [R.money_of(n) for n in (-250_000, -1, 5_000, 15_000, 15_001, 123_456_785_000)] == ["INR:-0.25", "INR:0.00", "INR:0.00", "INR:0.02", "INR:0.02", "INR:123456.78"]


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_more_orders_are_more_tasks(spark, monkeypatch):
    few = spark.range(70).selectExpr("id AS o_orderkey", "id AS o_custkey", "100.0D AS o_totalprice", "timestamp'2026-01-02' AS o_orderdate")
    monkeypatch.setattr(demo, "table", lambda *_: few)
    monkeypatch.setattr(call_queries, "ROWS_A_TASK", 5)
    assert call_queries.calls(spark, "").rdd.getNumPartitions() == 14


def test_readings_stay_in_their_row(spark, monkeypatch):
    """Neither a join nor a grouping puts words or readings together again, and no row is copied for a second count."""
    few = spark.range(4).selectExpr("id AS o_orderkey", "id AS o_custkey", "id * 1111.0D AS o_totalprice", "timestamp'2026-01-02' AS o_orderdate")
    monkeypatch.setattr(demo, "table", lambda *_: few)
    for p in (plan(call_queries.parse_digits(spark, "")), plan(more_queries.spoken_hindi(spark, ""))):
        assert "Join" not in p and "Aggregate" not in p
    assert "Union" not in plan(more_queries.split_runs(spark, ""))
    rows = spark.createDataFrame([(1, "a", [(True,)], "r", None, "m", "t"), (1, "b", [(False,)], "r", "x", None, "t"), (2, None, [], None, "x", "m", "t")], "row_key int, condition string, entities array<struct<hit:boolean>>, run_id string, asr_impl string, asr_model string, asr_mode string")
    h = S.triage_header(rows)
    assert "Expand" not in plan(h)
    assert tuple(h.select("rows", "utterances", "conditions", "entities", "hits", "run_id").first()) == (3, 2, 2, 2, 1, ["-", "r"])
