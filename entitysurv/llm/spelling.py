"""Spelling variants: words one edit apart, found in a variable-length gram index."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, staged

#: A maximal run of Latin letters; the last range holds two signs besides, as stated.
_RUN = re.compile("[A-Za-zÀ-ÿ]+")
_NOT_RUN = re.compile("[^A-Za-zÀ-ÿ]")
_LOWER = {c: c + 32 for c in range(65, 91)}
Q_MIN, Q_MAX = 3, 6  #: shortest and longest gram; each word has a sign before and after it
_FULL, _SUB, _DEL = 1, 2, 4


def runs_of(text: str, piece: int = 1 << 20):
    """Lists of the letter runs of a text, a piece at a time; no run is cut."""
    at = 0
    while at < len(text):
        end = len(text) if at + piece >= len(text) else at + piece
        if end < len(text):
            m = _NOT_RUN.search(text, end)
            end = m.start() if m else len(text)
        yield _RUN.findall(text, at, end)
        at = end


def count_words(batches, min_len: int, drop: int, most: int = 300_000):
    """(id, text) -> (word, n), partial counts. Whether a run loses a letter depends on id and run alone, so each distinct run
    of a text is hashed once. After `most` words the counts go out and start anew."""
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["word", "n"])
        counts.clear()
        return b

    for batch in batches:
        for doc, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for runs in runs_of(text or ""):
                for run, n in Counter(runs).items():
                    if len(run) < min_len:
                        continue
                    run = run.lower() if run.isascii() else run.translate(_LOWER)
                    h = zlib.crc32(run.encode(), head)
                    if h % drop == 0:
                        h %= len(run)
                        run = run[:h] + run[h + 1 :]
                        if len(run) < min_len:
                            continue
                    counts[run] += n
                if len(counts) >= most:
                    yield out()
    yield out()


def count_grams(batches, most: int = 300_000):
    """word -> (gram, n) for all grams that may be extended, partial counts."""
    counts: Counter[str] = Counter()
    for batch in batches:
        for word in batch.column("word").to_pylist():
            s = f"^{word}$"
            counts.update(s[p : p + q] for q in range(Q_MIN, Q_MAX) for p in range(len(s) - q + 1))
            if len(counts) >= most:
                yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])
                counts.clear()
    yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["gram", "n"])


def grams(s: str, frequent: dict[str, int]) -> list[tuple[int, str]]:
    """(frequency, start, gram) of each place: the shortest gram that is not frequent, at most Q_MAX long, rarest first.
    A gram depends on its own letters alone, so an edit beside it leaves it as it is."""
    out, n = [], len(s)
    for p in range(n - Q_MIN + 1):
        e = p + Q_MIN
        f = frequent.get(s[p:e], 0)
        while f and e < n and e - p < Q_MAX:
            e += 1
            f = frequent.get(s[p:e], 0)
        out.append((f, s[p:e], p))
    out.sort()
    return out


def postings(s: str, frequent: dict[str, int]) -> list[tuple[int, str, list[int]]]:
    """(frequency, gram, edits) of the lists that s has to be in: for every edit of s, the rarest gram that it does not
    touch. An edit touches at most Q_MAX grams (the word's bound is often less), so these are the first few of its order.

    edits are places that lose or change their letter and are dealt to this gram; a gram may be listed without any, for
    letters inserted between two places. Two words one edit apart have the same rarest untouched gram, so both are in its
    list, and only there is the pair counted.
    """
    places, gaps = set(range(1, len(s) - 1)), set(range(1, len(s)))
    out = []
    for f, g, p in grams(s, frequent):
        e = p + len(g)
        mine = [x for x in places if not p <= x < e]
        between = [x for x in gaps if not p < x < e]
        if mine or between:
            out.append((f, g, mine))
            places.difference_update(mine)
            gaps.difference_update(between)
            if not places and not gaps:
                break
    return out


def posting_rows(batches, frequent: dict[str, int], most_list: int):
    """(word, n) -> (key, word, n, edits, what). A list that may be longer than most_list is cut by what its words share
    without the edited letter, so no key has more words than one-letter changes allow; other lists have one key. Runs of
    over _Rest.SHORT + 1 letters have one key a list, as a row for each of their edits would hold the run again."""
    import xxhash

    rows: list[tuple] = []
    names = ["key", "word", "n", "edits", "what"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.list_(pa.int32()), pa.int32()]

    def key(*parts) -> int:
        return xxhash.xxh3_64_intdigest("\x00".join(map(str, parts)).encode()) - (1 << 63)

    def out() -> pa.RecordBatch:
        b = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kinds[i]) for i in range(5)], names)
        rows.clear()
        return b

    for batch in batches:
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist(), strict=True):
            s = f"^{word}$"
            for f, g, edits in postings(s, frequent):
                whole = f <= most_list or len(word) > _Rest.SHORT + 1
                if whole or len(word) > _Rest.SHORT:
                    rows.append((key(g), word, n, edits, _FULL | _SUB | (_DEL if whole else 0)))
                else:
                    rows.append((key(g, "full", word), word, n, [], _FULL))
                for e in [] if whole else edits:
                    rest = word[: e - 1] + word[e:]
                    if len(word) <= _Rest.SHORT:
                        rows.append((key(g, "change", e, rest), word, n, [e], _SUB))
                    if s[e] != s[e - 1]:
                        rows.append((key(g, "full", rest), word, n, [e], _DEL))
            if len(rows) >= 10_000:
                yield out()
    yield out()


class _Rest:
    """Words without one letter: strings for short words, else hashes of prefix and suffix that take no time per letter;
    what these find is compared letter by letter."""

    SHORT, P, B = 64, (1 << 61) - 1, 1_000_003

    def __init__(self, word: str):
        self.word, self.m = word, len(word)
        if self.m > self.SHORT:
            self.head, self.power = [0], [1]
            for c in word:
                self.head.append((self.head[-1] * self.B + ord(c)) % self.P)
                self.power.append(self.power[-1] * self.B % self.P)

    def whole(self):
        return self.word if self.m <= self.SHORT else (self.m, self.head[self.m])

    def without(self, i: int):
        if self.m <= self.SHORT or self.m - 1 == self.SHORT:
            return self.word[:i] + self.word[i + 1 :]
        tail = (self.head[self.m] - self.head[i + 1] * self.power[self.m - i - 1]) % self.P
        return (self.m - 1, (self.head[i] * self.power[self.m - i - 1] + tail) % self.P)


def merge_list(rows: list[tuple[str, int, list[int], int]]) -> dict[str, list]:
    """The words of one list -> word: [near words found here, frequency and word of the best of them]."""
    full: dict = {}
    change: dict = defaultdict(list)
    drop: list = []
    for word, n, edits, what in rows:
        r = _Rest(word)
        if what & _FULL:
            full[r.whole()] = (word, n)
        for e in edits:
            i = e - 1
            rest = r.without(i)
            if what & _SUB:
                change[i, rest].append((word, n))
            if what & _DEL and (i == 0 or word[i] != word[i - 1]):  # of a run of one letter the first goes
                drop.append((word, n, i, rest))
    found: dict[str, list] = {}

    def near(word: str, other: str, n: int, count: int = 1) -> None:
        x = found.setdefault(word, [0, -1, ""])
        x[0] += count
        if n > x[1] or n == x[1] and other < x[2]:
            x[1], x[2] = n, other

    for (i, _), words in change.items():
        words = dict(words)
        if len(words) > 1:
            groups: dict[str, dict] = defaultdict(dict)  # one, but for a collision of hashes
            for w, n in words.items():
                groups[w[:i] + w[i + 1 :]][w] = n
            for same in groups.values():
                best = sorted(same, key=lambda w: (-same[w], w))[:2]
                for w in same:
                    if len(same) > 1:
                        o = best[0] if w != best[0] else best[1]
                        near(w, o, same[o], len(same) - 1)
    for word, n, i, rest in drop:
        if (hit := full.get(rest)) and hit[0] == word[:i] + word[i + 1 :]:
            near(word, *hit)
            near(hit[0], word, n)
    return found


def merge_lists(batches):
    """Posting rows in order of key -> (word, near, best_n, best), partial: one list in memory at a time."""
    names, kinds = ["word", "near", "best_n", "best"], [pa.string(), pa.int64(), pa.int64(), pa.string()]
    at, rows, out = None, [], []
    for batch in batches:
        for key, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "word", "n", "edits", "what")), strict=True):
            if key != at:
                out += [(w, *x) for w, x in merge_list(rows).items()] if len(rows) > 1 else []
                at, rows = key, []
            rows.append(row)
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(4)], names)
            out = []
    out += [(w, *x) for w, x in merge_list(rows).items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(4)], names)


def words(docs: DataFrame, min_len: int = 7, min_n: int = 2, drop: int = 31, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): the distinct words of at least min_len code points with at least min_n occurrences in all texts."""
    counted = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(lambda b: count_words(b, min_len, drop), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= min_n)


def dictionary(vocabulary: DataFrame, least: int = 64, most_grams: int = 200_000, scratch: list[str] | None = None) -> dict[str, int]:
    """The grams that are extended, with their counts over all words: those that occur over 2^j times, with the least 2^j,
    from `least` on, for which they are at most most_grams. That bounds what the driver holds and broadcasts."""
    counted = staged(vocabulary.select("word").mapInArrow(count_grams, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") > least), "grams", scratch=scratch)
    sizes = {r["b"]: r["n"] for r in counted.groupBy(F.floor(F.log2("n")).cast("int").alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()}
    limit = least
    while sum(n for b, n in sizes.items() if 2**b >= limit) > most_grams:
        limit *= 2
    return {r["gram"]: r["n"] for r in counted.where(F.col("n") > limit).collect()}


def follow(forms: DataFrame) -> DataFrame:
    """(word, form) -> (word, root) by doubling: each round joins the pointers with themselves, until no root has a form.
    Counts grow tenfold at each step, so a chain is short, and a form has no more variants than one edit makes."""
    scratch: list[str] = []
    at = staged(forms.select("word", F.col("form").alias("root")), "forms", scratch=scratch)
    while True:
        step = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after = staged(at.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots", scratch=scratch)
        if after.where("moved").isEmpty():
            scratch.pop()  # read by the result
            discard(forms.sparkSession, scratch)
            return after.select("word", "root")
        at = after.select("word", "root")


def spelling_variants(docs: DataFrame, min_len: int = 7, min_n: int = 2, ratio: int = 10, drop: int = 31, most_list: int = 20_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every word of the texts with its more frequent spelling: word, n, n_near, form, form_n, root.

    Words are maximal runs of Latin letters, A-Z lower-cased; where `drop` divides the CRC of "id:run" the run loses the
    letter at CRC % length, a planted typing error that depends on the row alone. n_near counts the words at distance one
    (a letter more, less or other); form is the one of them with the largest n (ties: smallest in code-point order) if that
    is at least ratio * n, else null; root follows forms to the last one.

    Grams of three to six letters: a gram that occurs often is extended by the next letter (`dictionary`), so lists are of
    rare grams; a word is put in the list of the rarest gram that each possible edit leaves untouched (`postings`). A list
    is merged by what its words share without the edited letter, which finds exactly the words one edit apart, each pair
    in one list. Lists over most_list words are cut by that same rest, so no task holds a long list.

    Null texts are none, a null id is written as nothing, very long texts go a piece at a time, repeated rows count again,
    an empty table gives no rows, other columns are left out. min_len must be over Q_MAX, so that every edit leaves a gram.
    """
    if min_len <= Q_MAX:
        raise ValueError(f"min_len must be over {Q_MAX}")
    spark, scratch = docs.sparkSession, []
    known = staged(words(docs, min_len, min_n, drop, id_col, text_col), "words", scratch=scratch)
    frequent = spark.sparkContext.broadcast(dictionary(known, scratch=scratch))

    def post(batches):
        return posting_rows(batches, frequent.value, most_list)

    lists = known.mapInArrow(post, "key long, word string, n long, edits array<int>, what int").repartition("key").sortWithinPartitions("key")
    near = lists.mapInArrow(merge_lists, "word string, near long, best_n long, best string")
    none = known.select("word", "n", F.lit(0).cast("long").alias("near"), F.lit(None).cast("long").alias("best_n"), F.lit(None).cast("string").alias("best"))
    best = F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), F.col("best")))).alias("x")
    each = none.unionByName(near.withColumn("n", F.lit(None).cast("long"))).groupBy("word").agg(F.max("n").alias("n"), F.sum("near").alias("n_near"), best)
    more = -F.col("x.m") >= ratio * F.col("n")
    each = staged(each.select("word", "n", "n_near", F.when(more, F.col("x.best")).alias("form"), F.when(more, -F.col("x.m")).alias("form_n")), "variants")
    discard(spark, scratch)
    roots = follow(each.where("form is not null"))
    return each.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word")).select("word", "n", "n_near", "form", "form_n", "root")
