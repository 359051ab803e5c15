"""What is known of a text is worked out inside its row: no join, no grouping and no exploded words."""

import random

import pytest
from pyspark.sql import functions as F

from entitysurv.functions import text as T
from entitysurv.functions.lexicon import lexicon
from entitysurv.operators import cues as C
from entitysurv.operators import extraction as X
from entitysurv.operators import scoring as S
from entitysurv.plans import demo, line_queries, more_queries


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def orders(spark, monkeypatch, *rows):
    few = spark.createDataFrame(rows, "o_orderkey long, o_totalprice double").selectExpr("o_orderkey", "o_orderkey AS o_custkey", "o_totalprice", "timestamp'2026-01-02' AS o_orderdate")
    monkeypatch.setattr(demo, "table", lambda *_: few)


def test_run_kind_joins_nothing(spark, monkeypatch):
    """A join of the tokens was broadcast, which the driver's memory does not hold; a key that comes twice is two rows."""
    orders(spark, monkeypatch, (1, 7.0), (2, 99.0), (3, 100.0), (3, 12.0), (None, 350000.0), (4, None))
    q = more_queries.run_kind(spark, "")
    assert "Join" not in plan(q) and "Aggregate" not in plan(q)
    assert sorted(map(tuple, q.collect()), key=str) == sorted([(1, 7, "digits"), (2, 99, "digits"), (3, 100, "magnitude"), (3, 12, "digits"), (None, 350000, "magnitude")], key=str)


def brute_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(row[-1] + 1, last[j] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_word_edits_of_any_length():
    rng = random.Random(3)
    for n in [*range(12), 70, 200]:
        for _ in range(60 if n < 50 else 3):
            a, b = (rng.choices("abcd"[: rng.randint(1, 4)], k=rng.randint(0, n)) for _ in "ab")
            assert T.edits(a, b) == brute_edits(a, b), (a, b)


@pytest.mark.parametrize("ascii_only", [True, False])
def test_word_error_rates_are_those_of_the_column_expression(spark, ascii_only):
    odd = [None, "", "  ", "a b", "A, b!", "your code is 12", "code is 21 now", "पाँच सौ", "पाँच-सौ रुपये", "x\u2003y z\x1cq\x85r", "İstanbul ΑΣ straße", "e\u0301t\u00e9 _x", "a\u00a0b\x0bc"]
    texts = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in odd for b in odd)], "row_key int, reference string, hypothesis string").repartition(4)
    rows = texts.withColumn("gold", F.array().cast("array<struct<type:string,surface:string,expected:string>>"))
    words = lambda c: T.wer_tokens(F.coalesce(c, F.lit("")) if c == "hypothesis" else F.col(c), not ascii_only)
    want = texts.select("row_key", T.wer_of(words("reference"), words("hypothesis")))
    scored = S.score_rows(rows, lexicon(spark), ascii_only=ascii_only).select("row_key", "wer")
    assert {tuple(r) for r in want.collect()} == {tuple(r) for r in scored.collect()}
    assert "unhex" not in plan(scored)  # the words of a pair are no longer spelt as one text each


def heard_lines(spark, monkeypatch, keys):
    """Random sentences of cues and values with what was heard of them, under these keys; the names of what is staged."""
    some = "code otp Code account pin_ rupees rs amount is the blah may twenty five hundred 482913 50100234567 12/03/95 999 ₹".split()
    rng = random.Random(11)
    rows = []
    for k in keys:
        said = rng.choices(some, k=rng.randint(0, 14))
        heard = [w for w in said if rng.random() < 0.7] + rng.choices(some, k=2)
        gold = [("otp", "482913", "482913"), ("account_number", "50100234567", "50100234567"), ("otp", "482913", "482913"), ("currency", "999", "INR:999.00"), ("date", "12/03/95", None)]
        rows.append((k, rng.choice("abc"), " ".join(said) or None, " ".join(heard), None, rng.sample(gold, 4)))
    rows += [(900, "a", "code 482913", " ", None, []), (901, "d", "code 482913", "", None, []), (902, "a", "code 482913", "482913", "timeout", [])]
    table = spark.createDataFrame(rows, "row_key long, condition string, reference string, hypothesis string, error string, gold array<struct<type:string,surface:string,expected:string>>").repartition(4).cache()
    names, staged = [], X.staged
    monkeypatch.setattr(line_queries, "lines", lambda *_: table)
    monkeypatch.setattr(X, "staged", lambda df, name: (names.append(name), staged(df, name))[1])
    return names


def by_relations(spark):
    """What the relations of all words make of the same lines."""
    counts, orphan, present = line_queries._shared(line_queries._heard(spark, "").where("row_key is not null"), spark)
    return orphan, C.cue_survival(counts, orphan.withColumn("n", F.lit(1)), present)


def same_rows(a, b):
    assert a.count() > 0 and sorted(map(str, a.collect())) == sorted(map(str, b.select(a.columns).collect()))


def test_cues_are_read_inside_rows_whose_key_is_their_own(spark, monkeypatch):
    names = heard_lines(spark, monkeypatch, range(300))
    orphan, survival = line_queries.orphans(spark, ""), line_queries._survival(spark, "")
    assert "words" not in names and "found" not in names  # neither words nor values are rows of their own
    want = by_relations(spark)
    same_rows(orphan, want[0])
    same_rows(survival, want[1])


def test_keys_that_repeat_are_one_bag_and_null_keys_none(spark, monkeypatch):
    heard_lines(spark, monkeypatch, [*range(40), *range(20, 60), *range(30, 36), None, None, None])
    want = by_relations(spark)
    same_rows(line_queries.orphans(spark, ""), want[0])
    same_rows(line_queries._survival(spark, ""), want[1])


def test_triage_reads_a_hypothesis_once(spark, monkeypatch):
    """Buckets and patterns are the same whether or not scoring hands on what it extracted; a failed call is not read."""
    some = "code otp account pin rupees amount is three lakh fifty thousand 482913 482 913 350000 3,50,000 50100234567 12/03/95 4829".split()
    rng = random.Random(13)
    gold = [("otp", "482913", "482913"), ("otp", "4829", "4829"), ("account_number", "50100234567", "50100234567"), ("currency", "3,50,000", "INR:350000.00"), ("currency", "none", None), ("date", "12/03/95", "1995-03-12")]
    rows = [(i, "c", "digits", f"t{i % 3}", " ".join(rng.choices(some, k=12)), " ".join(rng.choices(some, k=rng.randint(0, 12))), "timeout" if i % 11 == 0 else None, rng.sample(gold, 4)) for i in range(400)]
    rows.append((400, "c", "words", "t", "pay rupees 3,50,000 now", "pay three lakh blah fifty thousand now", None, [("currency", "3,50,000", "INR:350000.00")]))
    rows.append((401, "c", "digits", "t", "the otp is 482913", "the pin is 482913", None, [("otp", "482913", "482913")]))
    table = spark.createDataFrame(rows, "row_key int, condition string, realization string, template_id string, reference string, hypothesis string, error string, gold array<struct<type:string,surface:string,expected:string>>").repartition(4).cache()
    read, extracted = [], X.extracted
    monkeypatch.setattr(line_queries, "lines", lambda *_: table)
    monkeypatch.setattr(X, "extracted", lambda texts, lexicon, text, *a, **b: (read.append(str(text)), extracted(texts, lexicon, text, *a, **b))[1])
    got = line_queries._triage(spark, "")
    assert len(read) == 2  # the hypothesis and the reference
    again = S.triage(S.score_rows(table, lexicon(spark)), lexicon(spark))
    assert sorted(map(str, got.collect())) == sorted(map(str, again.collect()))
    assert {r.reason for r in got.select("reason").distinct().collect()} >= {"call_error", "gold_error", "typed", "digits", "amount", "dropped", "different"}
