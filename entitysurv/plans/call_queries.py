"""Sentences made from orders: extraction, scoring, triage, cues."""

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as T
from ..functions.lexicon import lexicon
from ..operators import extraction as X
from ..operators import scoring as S
from . import demo
from .registry import query

GOLD_SQL = """WITH o AS (SELECT *, o_orderkey AS row_key, CASE WHEN o_orderkey % 2 = 0 THEN 'digits' ELSE 'words' END AS realization FROM orders),
gold AS (SELECT row_key, realization, 0 AS idx, 'otp' AS type, lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') AS expected FROM o
UNION ALL SELECT row_key, realization, 1, 'account_number', '1' || lpad((o_custkey * 1000003 % 10000000000)::VARCHAR, 10, '0') FROM o
UNION ALL SELECT row_key, realization, 2, 'currency', 'INR:' || floor(o_totalprice)::BIGINT || '.00' FROM o
UNION ALL SELECT row_key, realization, 3, 'date', strftime(o_orderdate, '%Y-%m-%d') FROM o)
"""


_HEAD = "left(d, length(d) - 3)"
#: 12,34,56,789 from the digits d: pairs from the right of all but the last three.
GROUPED_SQL = f"CASE WHEN length(d) <= 3 THEN d ELSE reverse(rtrim(regexp_replace(reverse({_HEAD}), '(..)', '\\1,', 'g'), ',')) || ',' || right(d, 3) END"
DIGITS_SQL = f"""o AS (SELECT *, d AS amount, {GROUPED_SQL} AS grouped, CASE WHEN o_orderkey % 2 = 0 THEN 'digits' ELSE 'words' END AS realization, lpad((o_orderkey * 7919 % 1000000)::VARCHAR, 6, '0') AS otp,
  '1' || lpad((o_custkey * 1000003 % 10000000000)::VARCHAR, 10, '0') AS account FROM (SELECT *, floor(o_totalprice)::BIGINT::VARCHAR AS d FROM orders))"""
_SMALL = T.DIGIT_WORDS + T.TEENS + [t if u == 0 else f"{t} {T.DIGIT_WORDS[u]}" for t in T.TENS for u in range(10)]


def words_sql(n: str) -> str:
    """A whole number under 10^9 in words, as a DuckDB expression."""
    small = lambda x: f"{_SMALL}[({x})::INTEGER + 1]"
    pieces = [f"CASE WHEN {n} // {div} % 100 > 0 THEN {small(f'{n} // {div} % 100')} || ' {scale}' END" for div, scale in ((10_000_000, "crore"), (100_000, "lakh"), (1000, "thousand"))]
    pieces.append(f"CASE WHEN {n} // 100 % 10 > 0 THEN {small(f'{n} // 100 % 10')} || ' hundred' END")
    pieces.append(f"CASE WHEN {n} % 100 > 0 THEN {small(f'{n} % 100')} END")
    return f"CASE WHEN {n} = 0 THEN 'zero' ELSE array_to_string(list_filter([{', '.join(pieces)}], lambda x: x IS NOT NULL), ' ') END"


def word_count_sql(n: str) -> str:
    return f"len(string_split({words_sql(n)}, ' '))"


SPELT_SQL = "array_to_string(list_transform(string_split({}, ''), lambda c: ['zero','one','two','three','four','five','six','seven','eight','nine'][c::INTEGER + 1]), ' ')"
#: The sentences of calls().
TEXTS_SQL = f"""texts AS (SELECT *, CASE realization WHEN 'digits' THEN 'your code is ' || otp || ' for the account ' || account || ' it has a pending sum of rupees ' || grouped || ' due on the ' || strftime(o_orderdate, '%d/%m/%Y')
  ELSE 'your code is ' || {SPELT_SQL.format("otp")} || ' for the account ' || {SPELT_SQL.format("account")} || ' it has a pending sum of ' || {words_sql("amount::BIGINT")} || ' rupees due on the ' || {words_sql("day(o_orderdate)")} || ' ' || lower(strftime(o_orderdate, '%B')) || ' ' || {words_sql("year(o_orderdate)")} END AS text FROM o)"""


ROWS_A_TASK = 25_000  #: rows that a task makes sentences of: more rows are more tasks, not longer ones


def calls(spark, sf):
    """(row_key, realization, text, otp, account, amount, date): the values come from the columns, never from the text."""
    o = demo.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    o = o.repartition(max(spark.sparkContext.defaultParallelism, o.count() // ROWS_A_TASK))  # a small file is one task, and all that follows is inside the row
    otp = F.lpad((F.col("o_orderkey") * 7919 % 1000000).cast("string"), 6, "0")
    account = F.concat(F.lit("1"), F.lpad((F.col("o_custkey") * 1000003 % 10000000000).cast("string"), 10, "0"))
    rows = o.select(F.col("o_orderkey").alias("row_key"), F.when(F.col("o_orderkey") % 2 == 0, "digits").otherwise("words").alias("realization"), otp.alias("otp"), account.alias("account"), F.floor("o_totalprice").cast("long").alias("amount"), F.to_date("o_orderdate").alias("date"))
    digits = F.concat_ws(" ", F.lit("your code is"), "otp", F.lit("for the"), F.lit("account"), "account", F.lit("it has a pending sum of rupees"), T.indian_grouping(F.col("amount")), F.lit("due on the"), F.date_format("date", "dd/MM/yyyy"))
    month = F.lower(F.date_format("date", "MMMM"))
    words = F.concat_ws(" ", F.lit("your code is"), T.digits_to_words(F.col("otp")), F.lit("for the account"), T.digits_to_words(F.col("account")), F.lit("it has a pending sum of"), T.number_to_words(F.col("amount")), F.lit("rupees due on the"), T.number_to_words(F.dayofmonth("date")), month, T.number_to_words(F.year("date")))
    return rows.withColumn("text", F.when(F.col("realization") == "digits", digits).otherwise(words))


def gold():
    """The four values of a sentence of calls(), as an array."""
    values = (("otp", F.col("otp")), ("account_number", F.col("account")), ("currency", T.normalize_currency(F.col("amount"))), ("date", F.date_format("date", "yyyy-MM-dd")))
    return F.array(*(F.struct(F.lit(t).alias("type"), v.alias("surface"), v.alias("expected")) for t, v in values))


def damaged(c, m=9):
    """The sentences without the words at every m-th place: what a poor line leaves."""
    kept = F.filter(F.split("text", " "), lambda w, i: (i * 7 + F.col("row_key")) % m != 0)
    return c.withColumn("text", F.array_join(kept, " "))


def scored(spark, sf, damage=False):
    """(row_key, realization, idx, type, expected, hit, found, edit_distance) of every gold value in its own sentence."""
    c = calls(spark, sf)
    rows = (damaged(c) if damage else c).select("row_key", "realization", F.col("text").alias("reference"), F.col("text").alias("hypothesis"), gold().alias("gold"))
    return S.score_rows(rows, lexicon(spark)).select("row_key", "realization", F.posexplode("entities").alias("idx", "e")).select("row_key", "realization", "idx", "e.*")


@query(GOLD_SQL + "SELECT type, realization, count(*) AS n, count(*) AS found FROM gold GROUP BY ALL")
def gold_recoverable(spark, sf):
    return scored(spark, sf).groupBy("type", "realization").agg(F.count(F.lit(1)).alias("n"), F.count_if("hit").alias("found"))


@query(GOLD_SQL + "SELECT row_key, idx, type, expected, true AS hit, NULL::VARCHAR AS found, 0 AS edit_distance FROM gold")
def gold_match(spark, sf):
    return scored(spark, sf).select("row_key", "idx", "type", "expected", "hit", "found", "edit_distance")


@query(GOLD_SQL + "SELECT DISTINCT row_key, type, expected AS normalized FROM gold UNION SELECT row_key, 'account_number', expected FROM gold WHERE type = 'otp'")
def extract_entities(spark, sf):
    """All values that extraction finds, gold or not: the word account is near enough to the code to be its cue as well."""
    return X.extract_entities(calls(spark, sf).select("row_key", "text"), lexicon(spark)).select("row_key", "type", "normalized").distinct()


@query()
def nearest_candidate(spark, sf):
    return scored(spark, sf, True).where("not hit and found is not null").select("row_key", "type", "expected", "found", "edit_distance")


@query(GOLD_SQL + "SELECT row_key, expected AS date FROM gold WHERE type = 'date'")
def extract_dates(spark, sf):
    c = calls(spark, sf)
    return X.extract_entities(c.select("row_key", "text"), lexicon(spark), ["date"]).select("row_key", F.col("normalized").alias("date"))


@query(GOLD_SQL + "SELECT row_key, regexp_extract(expected, '[0-9]+')::BIGINT AS value FROM gold WHERE type = 'currency'")
def parse_value(spark, sf):
    c = calls(spark, sf)
    t = X.with_lexicon(X.tokenize(c.select("row_key", T.number_to_words(F.col("amount")).alias("folded"))), lexicon(spark))
    toks = F.array_sort(F.collect_list(F.struct("pos", "text", "kind", "value")))
    return t.groupBy("row_key").agg(N.parse_value(toks, True).cast("long").alias("value"))


@query(GOLD_SQL + "SELECT row_key, expected AS digits FROM gold WHERE type = 'account_number'")
def parse_digits(spark, sf):
    c = calls(spark, sf)
    said = c.select("row_key", T.digits_to_words(F.col("account")).alias("text"))
    return X.with_runs(said, lexicon(spark), F.col("text")).select("row_key", F.get("_runs", F.lit(0))["digits"].alias("digits"))


@query()
def number_runs(spark, sf):
    return X.number_runs(damaged(calls(spark, sf)), lexicon(spark))


@query(f"WITH {DIGITS_SQL} SELECT o_orderkey AS row_key, grouped FROM o")
def indian_grouping(spark, sf):
    """One row per order."""
    return calls(spark, sf).select("row_key", T.indian_grouping(F.col("amount")).alias("grouped"))


@query(GOLD_SQL + "SELECT row_key, array_to_string(list_transform(string_split(expected, ''), lambda c: ['zero','one','two','three','four','five','six','seven','eight','nine'][c::INTEGER + 1]), ' ') AS words FROM gold WHERE type = 'otp'")
def digits_to_words(spark, sf):
    return calls(spark, sf).select("row_key", T.digits_to_words(F.col("otp")).alias("words"))


@query("SELECT o_orderkey AS row_key, 'INR:' || printf('%.2f', floor(o_totalprice)) AS normalized, strftime(o_orderdate, '%Y-%m-%d') AS date FROM orders")
def normalize_currency(spark, sf):
    return calls(spark, sf).select("row_key", T.normalize_currency(F.col("amount")).alias("normalized"), T.normalize_date(F.year("date"), F.month("date"), F.dayofmonth("date")).alias("date"))


@query("SELECT doc_id, regexp_replace(text, '[^0-9]', '', 'g') AS digits FROM documents")
def normalize_digits(spark, sf):
    return demo.table(spark, sf, "documents").select("doc_id", T.normalize_digits(F.col("text")).alias("digits"))


@query()
def wer(spark, sf):
    """Word error rate of every document against itself without every ninth word; words and edits over whole texts."""
    d = demo.table(spark, sf, "conversations").select("conv_id", "turn", "text")
    words = F.split("text", " ")
    kept = F.filter(F.transform(words, lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: (x["i"] + F.col("turn")) % 9 != 0)
    return d.select("conv_id", "turn", F.round(T.wer(F.col("text"), F.array_join(F.transform(kept, lambda x: x["w"]), " ")), 6).alias("wer"))


@query(r"SELECT doc_id, len(list_filter(string_split_regex(regexp_replace(nfc_normalize(text), '[^\p{L}\p{N}_\s\x0B\x{0900}-\x{097F}]', ' ', 'g'), '[\s\x0B]+'), lambda x: x <> '')) AS words FROM documents")
def wer_tokens(spark, sf):
    """Words of every document; null for a null text."""
    return demo.table(spark, sf, "documents").select("doc_id", F.size(T.wer_tokens(F.col("text"))).cast("long").alias("words"))
