"""Every registered query against its SQL on the smallest tables, and the cases that the semantics pin down."""

import functools
import itertools
import random
import re

import pytest
from compare import differences, duck
from pyspark.sql import functions as F

from entitysurv.functions import numbers as N
from entitysurv.functions import text as T
from entitysurv.functions.lexicon import HINDI_0_TO_99, HINDI_ROMAN_0_TO_99, canonical_words, canonicalize, lexicon, romanised
from entitysurv.operators import extraction as X
from entitysurv.operators import rows as R
from entitysurv.operators import series as Z
from entitysurv.plans.queries import ORACLE_SQL, QUERIES
from entitysurv.sources import io

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLE_SQL:
        assert not differences(df, con, ORACLE_SQL[name])
    else:
        assert name in NO_SQL and df.count() > 0


#: Seeds are hashes of the engine; the others have their own tests beside this one.
NO_SQL = {"derived_seed", "nearest_candidate", "number_runs", "wer"}


def test_queries_without_sql(spark):
    """What SQL does not say of the four: distances, runs, rates, seeds."""
    near = QUERIES["nearest_candidate"](spark, SF).collect()
    assert all(r.edit_distance >= 1 and r.found != r.expected for r in near)
    runs = QUERIES["number_runs"](spark, SF).collect()
    assert all(r.lo < r.hi and (r.prev_hi is None or r.prev_hi < r.lo) and (r.next_lo is None or r.next_lo > r.hi) for r in runs)
    for r in QUERIES["wer"](spark, SF).join(spark.read.parquet(f"{SF}/conversations.parquet"), ["conv_id", "turn"]).collect():
        words = r.text.split(" ")
        kept = [w for i, w in enumerate(words) if (i + r.turn) % 9]
        whole, left = (sum(bool(p) for w in ws for p in re.sub(r"[^\w\s]", " ", w).split()) for ws in (words, kept))
        assert r.wer == pytest.approx((whole - left) / whole if whole else 0, abs=1e-6)
    seeds = [r.seed for r in QUERIES["derived_seed"](spark, SF).select("seed").distinct().collect()]
    assert len(seeds) == spark.read.parquet(f"{SF}/events.parquet").select("user_id", "event_type").distinct().count()


def readings(spark, *sentences, extra=None):
    texts = spark.createDataFrame(list(enumerate(sentences)), "row_key int, folded string")
    toks = F.array_sort(F.collect_list(F.struct("pos", "text", "kind", "value")))
    t = X.with_lexicon(X.tokenize(texts), lexicon(spark, extra)).groupBy("row_key").agg(toks.alias("t"))
    got = t.select("row_key", N.parse_value(F.col("t"), True).alias("strict"), N.parse_value(F.col("t")).alias("lenient"), N.parse_digits(F.col("t")).alias("digits")).collect()
    num = lambda x: None if x is None else float(x)
    return [(num(r.strict), num(r.lenient), r.digits) for r in sorted(got)]


def test_magnitudes_and_digits(spark):
    got = readings(spark, "तीन लाख पचास हज़ार", "सवा लाख", "पौने दो लाख", "twenty one thousand", "hazaar", "76 74 लाख", "double five nine", "dedh lakh", "तीन सौ पचास", "nothing here")
    assert [g[0] for g in got] == [350000, 125000, 175000, 21000, None, None, None, 150000, 350, None]
    assert got[4][1] == 1000 and got[6][2] == "559" and got[9][1] is None


def test_spellings_of_one_number(spark):
    got = readings(spark, "teen laakh pachaas hazaar", "paune do lakh", "पांच सौ", "छः लाख छाछठ", "athahattar hajaar", extra=romanised())
    assert [g[0] for g in got] == [350000, 175000, 500, 600066, 78000]
    canon = spark.createDataFrame([(w, i) for i, w in enumerate(HINDI_0_TO_99.split())], "word string, i int").select("i", canonicalize(F.col("word")).alias("c")).collect()
    roman = spark.createDataFrame([(w, i) for i, w in enumerate(HINDI_ROMAN_0_TO_99.split())], "word string, i int").select("i", canonicalize(F.col("word")).alias("c")).collect()
    assert len({r.c for r in canon}) == len({r.c for r in roman}) == 100


def found(spark, text, types=None):
    out = X.extract_entities(spark.createDataFrame([(1, text)], "row_key int, text string"), lexicon(spark), types, ascii_only=False)
    return {(r.type, r.normalized) for r in out.collect()}


def test_extraction_cases(spark):
    assert found(spark, "your otp is 482913") == {("otp", "482913")}
    assert found(spark, "482913") == {("otp", "482913"), ("pin_code", "482913")}
    assert found(spark, "rupees 3,50,000 only") == {("currency", "INR:350000.00")}
    assert found(spark, "पाँच लाख अबक हज़ार रुपये") == set()
    assert found(spark, "due 14/03/2026") == {("date", "2026-03-14")}
    assert found(spark, "on four may two thousand twenty six") == {("date", "2026-05-04")}
    assert found(spark, "खाते 50100234567890 में ₹3,50,000") == {("account_number", "50100234567890"), ("currency", "INR:350000.00")}
    assert found(spark, "14/03/2026", ["otp"]) == set() and found(spark, "") == set()


def test_matching_one_wrong_digit_is_a_miss(spark):
    gold = spark.createDataFrame([(1, 0, "otp", "482913"), (2, 0, "otp", "482913"), (3, 0, "otp", "482913")], "row_key int, idx int, type string, expected string")
    cands = X.extract_entities(spark.createDataFrame([(1, "otp 482913"), (2, "otp 482914"), (3, "nothing")], "row_key int, text string"), lexicon(spark))
    got = {r.row_key: (r.hit, r.found, r.edit_distance) for r in X.gold_match(gold, cands).collect()}
    assert got == {1: (True, None, 0), 2: (False, "482914", 1), 3: (False, None, None)}


def test_scalars(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert [one(T.indian_grouping(F.lit(n))) for n in (7, 123, 1234, 123456789, -50000)] == ["7", "123", "1,234", "12,34,56,789", "-50,000"]
    assert one(T.number_to_words(F.lit(21050003))) == "two crore ten lakh fifty thousand three" and one(T.number_to_words(F.lit(0))) == "zero"
    assert one(T.wer(F.lit("a b c"), F.lit("a x c d"))) == pytest.approx(2 / 3) and one(T.wer(F.lit(""), F.lit("a"))) == 1.0
    assert one(T.wer(F.lit("करें"), F.lit("करें।"))) == 1.0
    assert one(canonicalize(F.lit("सत्तर"))) == one(canonicalize(F.lit("सतर"))) and one(canonicalize(F.lit("hazaar"))) == "hajar"
    assert one(T.normalize_date(F.lit(None).cast("int"), F.lit(3), F.lit(14))) == "--03-14"
    assert one(io.manifest_dropped_fraction(F.array(F.lit("x"), F.lit("dropped 0/0 frames"), F.lit("dropped 3/12 frames")))) == 0.25


def diff_brute(e, f):
    if f is None:
        return [(e, "missing")]
    steps, i, j = [], 0, 0
    if len(e) == len(f):
        steps = [(y, "same" if x == y else "wrong") for x, y in zip(e, f, strict=True)]
    else:
        common = functools.cache(lambda i, j: 0 if i == len(e) or j == len(f) else common(i + 1, j + 1) + 1 if e[i] == f[j] else max(common(i + 1, j), common(i, j + 1)))
        while i < len(e) or j < len(f):
            if i < len(e) and j < len(f) and e[i] == f[j]:
                steps, i, j = [*steps, (f[j], "same")], i + 1, j + 1
            elif i < len(e) and (j == len(f) or common(i + 1, j) >= common(i, j + 1)):
                steps, i = [*steps, (e[i], "missing")], i + 1
            else:
                steps, j = [*steps, (f[j], "wrong")], j + 1
    return [("".join(t for t, _ in g), k) for k, g in ((k, list(g)) for k, g in itertools.groupby(steps, key=lambda s: s[1]))]


def test_value_diff_against_brute_force(spark):
    rng = random.Random(5)
    draw = lambda: "".join(rng.choices("123", k=rng.randint(0, 7)))
    pairs = [(draw(), draw()) for _ in range(400)] + [("1234", None), ("", ""), ("", "12"), ("12", "")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, e string, f string").withColumn("d", T.value_diff(F.col("e"), F.col("f"))).withColumn("lost", T.value_diff_lost(F.col("d")))
    for r in df.collect():
        want = diff_brute(r.e, r.f)
        assert [tuple(p) for p in r.d] == want and r.lost == sum(len(t) for t, k in want if k != "same")


def test_canonical_forms_keep_letters_apart(spark):
    """A nukta goes, with its letter or beside it; no other consonant changes."""
    base, nukta = "कखगजडढफयनरळ", "\u093c"
    joined = "\u0958\u0959\u095a\u095b\u095c\u095d\u095e\u095f\u0929\u0931\u0934"
    words = [(f"अ{a}र", f"अ{b}र") for a, b in zip([*joined, *(c + nukta for c in base), *"कखगघचछजझटठडढणतथदधपफबभमयरलवशषसह"], [*base, *base, *"कखगघचछजझटठडढणतथदधपफबभमयरलवशषसह"], strict=True)]
    df = spark.createDataFrame(words, "w string, want string").select("want", canonicalize(F.col("w")).alias("c"), F.get(canonical_words(F.array("w")), F.lit(0)).alias("d"))
    assert all(r.want == r.c == r.d for r in df.collect())


def test_canonical_words_are_the_canonical_forms(spark):
    rng = random.Random(6)
    words = HINDI_0_TO_99.split() + HINDI_ROMAN_0_TO_99.split() + ["".join(rng.choices("azeiouकखतथ्िनबय़ँक़ज़12'", k=rng.randint(1, 8))) for _ in range(500)]
    df = spark.createDataFrame([(words[i : i + 7],) for i in range(0, len(words), 7)] + [([],)], "w array<string>")
    got = df.select(canonical_words(F.col("w")).alias("c"), F.transform("w", canonicalize).alias("d")).collect()
    assert all(r.c == r.d for r in got)


def test_rows_do_not_depend_on_partitioning(spark):
    r = QUERIES["hit_rate"](spark, SF)
    few = sorted(map(tuple, r.collect()))
    spark.conf.set("spark.sql.shuffle.partitions", "37")
    try:
        assert sorted(map(tuple, QUERIES["hit_rate"](spark, SF).collect())) == few
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_mock_rows_stay_if_there_is_nothing_else(spark):
    only = spark.createDataFrame([("mock", 1)], "asr_impl string, event_id long")
    assert R.exclude_mock(only).count() == 1 and R.exclude_mock(only.limit(0)).count() == 0


def test_bad_corpus_line_is_named(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text('// note\n\n{"id":"a","language":"hi-IN","text":"x","entities":[]}\n')
    assert io.scan_corpus(spark, str(p)).count() == 1
    p.write_text("not json\n")
    with pytest.raises(Exception, match="bad utterance"):
        io.scan_corpus(spark, str(p)).collect()


def test_series_without_loss_and_without_frames(spark):
    f = spark.createDataFrame([(1, 0, 5.0, True), (1, 1, 2.0, False), (1, 2, 9.0, True)], "series int, idx long, v double, lost boolean")
    assert [r.filled for r in Z.repeat_fill(f).orderBy("idx").collect()] == [0.0, 2.0, 2.0]
    assert Z.loss_run_stats(f).first().runs == 2 and Z.loss_run_stats(f.limit(0)).count() == 0
