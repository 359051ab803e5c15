"""Queries over all rows, against plain Python on small inputs: nothing is left out to suit a comparison."""

import re
import unicodedata
from collections import Counter

from pyspark.sql import functions as F

from entitysurv.functions import text as T
from entitysurv.operators import metrics as M
from entitysurv.plans import call_queries, demo, more_queries
from entitysurv.plans.queries import QUERIES

TEXTS = [None, "", "one line", "two\nlines\r\n\tand  more ", "Café au lait, 5 €", "Café STRASSE straße", "करें। नमस्ते", "क़ १,२३,४५६", "1,2,3 and 12,34,567", "a b c d\x1ce\x85f", " 　x ", "İstanbul ΑΣ", "١,٢", "_x-y_ ½ ²"]


def documents(spark, monkeypatch):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    monkeypatch.setattr(demo, "table", lambda *_: df)


def nfc(x):
    return unicodedata.normalize("NFC", x)


def brute_words(x):
    return len(re.sub(r"[^\w\sऀ-ॿ]", " ", nfc(x)).casefold().split())


def brute_fold(x):
    zeros = {chr(z + d): str(d) for z in T.INDIC_ZEROS for d in range(10)}
    return re.sub(r"(?<=\d)[,٬](?=\d)", "", "".join(zeros.get(c, c) for c in nfc(x)))


def brute_name(x):
    return re.sub(r"\s+", " ", nfc(x).strip()).casefold()


def same_for_all_documents(spark, monkeypatch, name, column, brute):
    documents(spark, monkeypatch)
    got = {r.doc_id: r[column] for r in QUERIES[name](spark, "").collect()}
    assert got == {i: None if t is None else brute(t) for i, t in enumerate(TEXTS)}


def test_wer_tokens_of_all_documents(spark, monkeypatch):
    same_for_all_documents(spark, monkeypatch, "wer_tokens", "words", brute_words)


def test_folded_text_of_all_documents(spark, monkeypatch):
    same_for_all_documents(spark, monkeypatch, "folded_text", "folded", brute_fold)


def test_normalize_name_of_all_documents(spark, monkeypatch):
    same_for_all_documents(spark, monkeypatch, "normalize_name", "name", brute_name)


def orders(spark, monkeypatch, amounts):
    rows = [(i, 10 + i, None if a is None else float(a), f"2024-{1 + i % 12:02d}-{1 + i % 28:02d}") for i, a in enumerate(amounts, 1)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderdate string")
    monkeypatch.setattr(demo, "table", lambda *_: df)
    return {r[0]: (None if r[2] is None else int(r[2]), r[3]) for r in rows}


def brute_grouping(n):
    head, tail = str(n)[:-3], str(n)[-3:]
    while len(head) > 2:
        head, tail = head[:-2], f"{head[-2:]},{tail}"
    return f"{head},{tail}" if head else tail


AMOUNTS = [0, 7, 100, 999, 1000, 9_999, 10_000, 54_321.9, 99_999, 100_000, 350_000, 1_234_567, 12_345_678, 123_456_789, None]


def test_indian_grouping_of_every_length(spark, monkeypatch):
    want = orders(spark, monkeypatch, AMOUNTS)
    got = {r.row_key: r.grouped for r in QUERIES["indian_grouping"](spark, "").collect()}
    assert got == {k: None if a is None else brute_grouping(a) for k, (a, _) in want.items()}


def test_orders_of_both_kinds(spark, monkeypatch):
    want = orders(spark, monkeypatch, [a for a in AMOUNTS if a is not None])
    rows = lambda name, c: sorted((r.row_key, r[c]) for r in QUERIES[name](spark, "").collect())
    assert rows("parse_value", "value") == [(k, a) for k, (a, _) in want.items()]
    assert rows("canonicalize", "value") == [(k, k) for k in want]
    code = lambda k: f"{k * 7919 % 1000000:06d}"
    assert rows("tokenize_spans", "digits") == [(k, T.DIGIT_WORDS[int(code(k)[0])] if k % 2 else code(k)) for k in want]


def test_date_rules_meet_sentences_of_the_other_kind(spark, monkeypatch):
    from entitysurv.plans import more_queries as Q

    orders(spark, monkeypatch, [1234, 5678])
    both = spark.createDataFrame([(1, "words", "due on 14/03/2026"), (2, "digits", "due on four may two thousand twenty six"), (3, "words", "none")], "row_key long, realization string, text string")
    monkeypatch.setattr(Q, "calls", lambda *_: both)
    assert [tuple(r) for r in Q.extract_numeric_dates(spark, "").collect()] == [(1, "2026-03-14")]
    assert [tuple(r) for r in Q.extract_month_dates(spark, "").collect()] == [(2, "2026-05-04")]


def sentences(c, damage=False):
    """{row_key: words}, without those at every ninth place if damaged."""
    rows = {r.row_key: r.text.split(" ") for r in c.select("row_key", "text").collect()}
    return {k: [w for i, w in enumerate(ws) if not damage or (i * 7 + k) % 9] for k, ws in rows.items()}


def test_all_words_of_a_row_are_counted(spark, monkeypatch):
    orders(spark, monkeypatch, AMOUNTS[:6])
    c = call_queries.calls(spark, "")
    parts = lambda ws: Counter(p for w in ws for p in re.findall(r"[0-9]+|[^\W\d]+", w.replace(",", "")))
    want = {(k, w): (n, min(n, parts(kept)[w])) for (k, ws), kept in zip(sentences(c).items(), sentences(c, True).values()) for w, n in parts(ws).items()}
    got = {(r.row_key, r.word): (r.n_ref, r.kept) for r in QUERIES["cue_multiset_intersect"](spark, "").collect()}
    words = {k: v for k, v in want.items() if not k[1].isdigit()}
    assert {k: v for k, v in got.items() if not k[1].isdigit()} == words and len(words) > 6


def test_extraction_keeps_candidates_that_are_not_gold(spark, monkeypatch):
    both = spark.createDataFrame([(1, "your otp is 482913 and 123456789 is new"), (2, "nothing")], "row_key long, text string")
    monkeypatch.setattr(call_queries, "calls", lambda *_: both)
    monkeypatch.setattr(call_queries, "gold", lambda c: spark.createDataFrame([(1, "digits", 0, "otp", "482913")], "row_key long, realization string, idx int, type string, expected string"))
    got = {tuple(r) for r in call_queries.extract_entities(spark, "").collect()}
    assert got == {(1, "otp", "482913"), (1, "account_number", "123456789")}


def test_rescore_counts_hits_and_keeps_losses(spark):
    score = lambda *rows: spark.createDataFrame(rows, "type string, hit boolean")
    before, after = score(("a", True), ("a", True), ("b", False), ("c", True)), score(("a", False), ("a", True), ("b", True), ("c", True))
    assert {(r.type, r.total, r.before, r.after, r.delta) for r in M.rescore_delta(before, after, "type").collect()} == {("a", 2, 2, 1, -1), ("b", 1, 0, 1, 1), ("c", 1, 1, 1, 0)}


def test_split_runs_break_each_amount(spark, monkeypatch):
    want = orders(spark, monkeypatch, [100, 999, 1000, 54_321, 350_000, 1_234_567, 123_456_789])
    seen = {k: " ".join(ws) for k, ws in sentences(more_queries.broken_amounts(call_queries.calls(spark, ""))).items()}
    whole = {k: " ".join(ws) for k, ws in sentences(call_queries.calls(spark, "").select("row_key", T.number_to_words(F.col("amount")).alias("text"))).items()}
    assert all(t.count("blah") == 1 and t.replace("blah ", "") == f"rupees {whole[k]} only" for k, t in seen.items()) and len(set(seen.values())) == len(want)
    amounts = {r.row_key: r.value for r in QUERIES["split_runs"](spark, "").collect()}
    assert amounts == {k: f"INR:{a}.00" for k, (a, _) in want.items() if k % 2 == 0}  # the broken ones yield nothing
