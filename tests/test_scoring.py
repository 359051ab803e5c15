"""Score rows, the presence of a value and the cause of a miss, case by case."""

import pytest

from entitysurv.functions.lexicon import lexicon
from entitysurv.operators import cues as C
from entitysurv.operators import metrics as M
from entitysurv.operators import scoring as S

ROW = "row_key int, condition string, realization string, template_id string, reference string, hypothesis string, error string, gold array<struct<type:string,surface:string,expected:string>>"


def scored(spark, *rows):
    """Score rows of (reference, hypothesis, error, [(type, expected)])."""
    table = [(i, "c", "digits", "t1", ref, hyp, err, [(t, v, v) for t, v in gold]) for i, (ref, hyp, err, gold) in enumerate(rows)]
    return S.score_rows(spark.createDataFrame(table, ROW), lexicon(spark))


def test_score_rows_nest_scores_and_confusions(spark):
    gold = [("otp", "482913"), ("account_number", "50100234567")]
    ref = "your otp is 482913 for account 50100234567"
    got = {r.row_key: r for r in scored(spark, (ref, ref, None, gold), (ref, "otp 482914", None, gold), (ref, None, None, gold), ("hello there", "", None, [])).collect()}
    assert [(e.hit, e.found, e.edit_distance) for e in got[0].entities] == [(True, None, 0)] * 2 and got[0].wer == 0 and got[0].confusions == []
    one, two = got[1].entities
    assert (one.hit, one.found, one.found_surface, one.edit_distance, one.candidates) == (False, "482914", "482914", 1, ["482914"])
    assert (two.hit, two.found, two.edit_distance, two.candidates) == (False, None, None, [])
    assert [(c.type, c.got, c.edit_distance) for c in got[1].confusions] == [("otp", "482914", 1), ("account_number", None, None)]
    assert got[1].wer == pytest.approx(6 / 7) and got[2].wer == 1.0 and len(got[2].confusions) == 2
    assert got[3].entities == [] and got[3].confusions == []


def test_first_extracted_candidate_wins_ties(spark):
    r = scored(spark, ("otp 1235", "otp 1234 or otp 1236", None, [("otp", "1235")])).first()
    assert r.entities[0].candidates == ["1234", "1236"] and r.entities[0].found == "1234"


def test_triage_buckets_in_order(spark):
    otp, money = [("otp", "482913")], [("currency", "INR:350000.00")]
    ref, due = "the otp is 482913", "pay rupees 3,50,000 now"
    rows = [
        (ref, "", "timeout", otp),
        ("no number here", "otp 482913", None, [("otp", "111111")]),
        (ref, "the pin is 482913", None, otp),
        ("otp 4829", "account 348291234567", None, [("otp", "4829")]),
        (ref, "otp 482 blah 913", None, otp),
        (due, "pay three lakh blah fifty thousand now", None, money),
        (due, "pay 350000", None, money),
        (ref, "  ", None, otp),
        (ref, "the otp is gone", None, otp),
        (ref, "the otp is 482914", None, otp),
    ]
    got = {r.row_key: (r.bucket, r.reason, r.pattern) for r in S.triage(scored(spark, *rows), lexicon(spark)).collect()}
    assert [got[i][:2] for i in range(10)] == [("uncertain", "call_error"), ("gold_error", "gold_error"), ("extractor_error", "typed"), ("uncertain", "weak"), ("extractor_error", "digits"), ("extractor_error", "amount"), ("extractor_error", "digits"), ("uncertain", "empty_hypothesis"), ("asr_error", "dropped"), ("asr_error", "different")]
    assert [got[i][2] for i in (0, 1, 2, 7, 8, 9)] == ["call_error::c", "gold_error::otp::t1", "extractor_error::otp::digits::t1", "empty_hypothesis::c", "asr_error::otp::dropped::c", "asr_error::otp::d1::c"]
    assert S.triage(scored(spark, (ref, ref, None, otp)), lexicon(spark)).count() == 0


def test_cues_are_bags_and_types_not_words(spark):
    tokens = lambda *rows: spark.createDataFrame(rows, "row_key int, canon string, cue_types array<string>")
    ref = tokens((1, "otp", ["otp"]), (1, "otp", ["otp"]), (1, "is", None), (2, "rupees", ["currency"]), (3, "is", None))
    hyp = tokens((1, "otp", ["otp"]), (1, "otp", ["otp"]), (1, "otp", ["otp"]), (2, "rs", ["currency"]), (3, "otp", ["otp"]))
    assert {(r.row_key, r.canon): (r.n_ref, r.kept) for r in C.cue_multiset(ref, hyp).collect()} == {(1, "otp"): (2, 2), (1, "is"): (1, 0), (2, "rupees"): (1, 0), (3, "is"): (1, 0)}
    present = spark.createDataFrame([(1, "otp"), (2, "currency"), (3, "otp")], "row_key int, type string")
    assert C.orphans(present, ref, hyp).count() == 0
    assert [(r.row_key, r.cues_expected) for r in C.orphans(present, ref, hyp.where("row_key = 3")).orderBy("row_key").collect()] == [(1, 2), (2, 1)]


def test_close_rates_are_not_ties(spark):
    rows = [("m0", "a", 1_000_000, 2_000_001), ("m1", "a", 1_000_001, 2_000_003)]
    ents = spark.createDataFrame([(m, c, True, h) for m, c, h, t in rows] + [(m, c, False, t - h) for m, c, h, t in rows], "asr_model string, condition string, hit boolean, n int")
    few = ents.selectExpr("asr_model", "condition", "hit").where("false")
    assert M.never_worse(few, "m0", "m1").first().never_worse is False
    a = spark.createDataFrame([("m0", "x", True), ("m0", "x", False), ("m1", "x", True), ("m1", "x", False), ("m1", "y", True)], "asr_model string, condition string, hit boolean")
    assert M.never_worse(a, "m1", "m0").first().never_worse is True and M.never_worse(a, "m0", "m1").first().never_worse is False
    f = M.finding(a).first()
    assert (f.best, f.worst, f.tied) == ("y", "x", 1)
