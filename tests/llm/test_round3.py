"""Brute force for the prefix trie, the spelling variants and the exact top-k search."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

pytest.importorskip("entitysurv.llm")

from compare import differences, duck  # noqa: E402

from entitysurv.llm import exact_topk, prefix_trie, queries, spelling  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op11_prefix_trie", "op12_spelling_variants", "op13_exact_topk"])
def test_sql_agrees(spark, name):
    df = queries.QUERIES[name](spark, SF)
    assert not differences(df, duck(SF), queries.ORACLE_SQL[name]) and df.count() > 0


# ---- prefix trie ---------------------------------------------------------------------------------------------------

TURN = "conv_id long, turn long, role string, text string, path string, shard int, n int"


def turns_table(spark, rows):
    return spark.createDataFrame([(*r, "p", 7, 3) for r in rows], TURN)


def trie_brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, role, hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest(), text))
    plain = {c: [(x[2], x[4]) for x in sorted(t)] for c, t in own.items()}
    nodes = defaultdict(list)
    for c, t in plain.items():
        base, h = c - int(math.fmod(c, 5)), zlib.crc32(str(c).encode()) % 9
        built = plain.get(base, [])[:h] + t[h:]
        for d in range(len(built) + 1):
            nodes[tuple(built[:d])].append((c, len(built)))
    kids, leaves, saved = Counter(k[:-1] for k in nodes if k), Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += not kids[k]
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1].encode()) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c, n in members if n == len(k))))
        out.append((min(members)[0], len(k), min(nodes[k[:-1]])[0] if k else None, len(members), kids[k], leaves[k], saved[k], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


def trie_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def dialogues(n, seed, hot=0.0):
    """Conversations that share turns; a share `hot` of them are copies of one."""
    rng, rows = random.Random(seed), []
    for c in range(n):
        turns = [("user", "hi"), ("bot", "hello"), ("user", "bye")] if rng.random() < hot else [(rng.choice(["user", "bot"]), rng.choice(["hi", "é", "what now", ""])) for _ in range(rng.randint(1, 7))]
        rows += [(c - 20, i, *t) for i, t in enumerate(turns)]
    return rows


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
@pytest.mark.parametrize("shards", [1, 7, 40])
def test_trie_is_the_same_over_any_shards(spark, hot, shards):
    rows = dialogues(300, 5, hot)
    assert trie_rows(prefix_trie.prefix_trie(turns_table(spark, rows), least_shards=shards)) == trie_brute(rows)


def test_trie_of_odd_rows(spark):
    long = "long " * 50_000
    rows = [(0, 1, "user", "a"), (0, 1, "user", "a"), (0, None, None, None), (0, 1, "bot", "a"), (3, 2, None, "b"), (3, None, "user", ""), (None, 1, "user", "lost"), (-7, 0, "user", long), (-5, 0, "user", long), (12, 5, "", "x")]
    rows += [(40, i, "user", f"t{i % 3}") for i in range(2000)]
    assert trie_rows(prefix_trie.prefix_trie(turns_table(spark, rows), least_shards=5)) == trie_brute(rows)
    assert prefix_trie.prefix_trie(turns_table(spark, rows).limit(0)).count() == 0
    assert prefix_trie.prefix_trie(turns_table(spark, [(None, 1, "user", "x")])).count() == 0


def test_bounds_cut_copies_and_stay_short(spark):
    paths = spark.createDataFrame([(i, bytearray(bytes([i % 2]) * 16 + bytes([9]) * 160), [1] * 11) for i in range(200)], "conv_id long, path binary, sizes array<long>")
    bounds = prefix_trie.splitters(paths, 8, 200)
    assert 4 <= len(bounds) <= 7 and len({p for p, _ in bounds}) <= 3 and any(c != prefix_trie.FIRST for _, c in bounds)
    assert len(prefix_trie.splitters(paths, 8, 200, most_nodes=3)) < len(bounds)


# ---- spelling ------------------------------------------------------------------------------------------------------


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    long, short = (a, b) if len(a) > len(b) else (b, a)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def variants_brute(rows, drop=31):
    counts = Counter()
    for doc, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % drop == 0 else run] += 1
    n = {w: k for w, k in counts.items() if len(w) >= 7 and k >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best and n[best] >= 10 * n[w] else None

    def root(w):
        while form[w]:
            w = form[w]
        return w

    return sorted((w, n[w], len(near[w]), form[w], n.get(form[w]), root(w)) for w in n)


def misspelt(seed, words=60, typos=700):
    rng, letters = random.Random(seed), "abcdé"
    base = ["".join(rng.choices(letters, k=rng.randint(6, 9))) for _ in range(words)]
    out = []
    for _ in range(typos):
        w, i = rng.choice(base), rng.randrange(7)
        w = rng.choice([w, w[:i] + w[i + 1 :], w[:i] + rng.choice(letters) + w[i:], w[:i] + rng.choice(letters) + w[i + 1 :]])
        out.append(" ".join([w] * rng.choice([1, 2, 2, 3, 30, 400])))
    return [(i, t.upper() if i % 3 else t) for i, t in enumerate(out)]


def docs_table(spark, rows):
    return spark.createDataFrame([(*r, "w", 3, 1) for r in rows], "doc_id long, text string, word string, n int, near int")


@pytest.mark.parametrize("most_list", [20_000, 0])
def test_variants_by_long_and_short_lists(spark, most_list, monkeypatch):
    rows = misspelt(3)
    monkeypatch.setattr(spelling.dictionary, "__defaults__", (8, 200_000, None))  # so that grams are extended in a small table
    got = spelling.spelling_variants(docs_table(spark, rows), most_list=most_list).select("word", "n", "n_near", "form", "form_n", "root")
    want = variants_brute(rows)
    assert sorted(map(tuple, got.collect())) == want
    assert any(r[3] for r in want) and any(r[5] not in (r[0], r[3]) for r in want) and max(r[2] for r in want) > 5


def test_variants_of_odd_rows(spark):
    long = "abcdefgh" * 30
    rows = [(1, None), (2, ""), (None, "Zähnchen zähnchen zahnchen zahnchen"), (3, "short word"), (4, long + " " + long), (5, f"{long}x {long}x {long[:100]}y{long[101:]} {long[:100]}y{long[101:]}"), (6, "é" * 64 + " " + "é" * 64 + " " + "é" * 65 + " " + "é" * 65), (7, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa"), (7, "aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa"), (8, "×÷ÀÿÿÿÿÿÀ " * 3)]
    for most_list in (20_000, -1):
        got = spelling.spelling_variants(docs_table(spark, rows), most_list=most_list).select("word", "n", "n_near", "form", "form_n", "root")
        assert sorted(map(tuple, got.collect())) == variants_brute(rows)
    assert spelling.spelling_variants(docs_table(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        spelling.spelling_variants(docs_table(spark, rows), min_len=6)


def test_every_edit_leaves_a_posted_gram():
    rng = random.Random(1)
    words = ["".join(rng.choices("abc", k=rng.randint(7, 12))) for _ in range(300)]
    frequent = {w: c for w, c in Counter(f"^{w}$"[p : p + q] for w in words for q in range(3, 6) for p in range(len(w) + 3 - q)).items() if c > 8}
    for w in words:
        posts = spelling.postings(f"^{w}$", frequent)
        assert sorted(e for _, _, edits in posts for e in edits) == list(range(1, len(w) + 1))
        i = rng.randrange(len(w))
        for v in (w[:i] + "d" + w[i + 1 :], w[:i] + "d" + w[i:]):
            mine = next(g for _, g, edits in spelling.postings(f"^{v}$", frequent) if i + 1 in edits)
            assert mine in {g for _, g, _ in posts}


def test_pieces_cut_no_run():
    text = "alpha beta" * 500 + "x" * 300 + " é1" + "gamma" * 100
    assert [r for runs in spelling.runs_of(text, 64) for r in runs] == re.findall("[A-Za-zÀ-ÿ]+", text)


# ---- top k ---------------------------------------------------------------------------------------------------------


def topk_brute(rows, k=10):
    ok = [(i, v) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    ints = [(i, [math.floor(1024 * x) for x in v]) for i, v in ok]
    out = []
    for a, (q, x) in enumerate(ints):
        if q is not None and q % 100 == 0:
            best = sorted((-sum(s * t for s, t in zip(x, y, strict=False)), c is None, c or 0, b) for b, (c, y) in enumerate(ints) if b != a)[:k]
            out += [(q, r + 1, None if none else c, -s) for r, (s, none, c, _) in enumerate(best)]
    return sorted(out, key=repr)


def vectors_table(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "vec_id long, embedding array<double>, row int, rank int, score int")


def test_topk_with_hot_copies_over_shards(spark):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.normal(size=16).tolist() if i % 3 else [0.3] * 16) for i in range(900)]
    got = exact_topk.top_k(vectors_table(spark, rows), shard_rows=100, query_rows=4)
    assert sorted(map(tuple, got.collect()), key=repr) == topk_brute(rows)


def test_topk_of_odd_rows(spark):
    rows = [(0, [1.0, -2.0]), (0, [1.0, -2.0]), (100, None), (200, [1.0, None]), (300, [float("nan"), 1.0]), (400, [float("inf"), 1.0]), (None, [1.0, -2.0]), (7, [1.0]), (8, []), (500, [0.0, 0.0]), (9, [-0.0004, 0.5]), (2**60 + 1, [1.0, -2.0])]
    for k in (1, 3, 10):
        got = exact_topk.top_k(vectors_table(spark, rows), k)
        assert sorted(map(tuple, got.collect()), key=repr) == topk_brute(rows, k)
    assert exact_topk.top_k(vectors_table(spark, rows).limit(0)).count() == 0 and exact_topk.top_k(vectors_table(spark, [(1, [1.0])])).count() == 0
    big = [(0, [1e6, 1e6]), (1, [1e4, 1.0]), (2, [-1e6, 3.0]), (3, [1e5, 1e5])]  # past the products that machine integers bound
    assert sorted(map(tuple, exact_topk.top_k(vectors_table(spark, big)).collect()), key=repr) == topk_brute(big)
    with pytest.raises(Exception, match="no long"):
        exact_topk.top_k(vectors_table(spark, [(0, [1e300]), (1, [1.0])])).collect()


def test_index_stops_only_on_proof():
    rng = np.random.default_rng(7)
    for n, dims, spread in ((3000, 64, 150), (500, 3, 9), (200, 8, 100_000)):
        x = rng.integers(-spread, spread, (n, dims))
        index = exact_topk.ImpactIndex(x)
        for q in np.concatenate([rng.integers(-spread, spread, (20, dims)), np.zeros((1, dims), int)]):
            may = index.top(q, 5)
            score = x @ q
            bar = np.sort(score)[-5]
            assert set(np.flatnonzero(score >= bar)) <= set(may.tolist())
    assert len(index.top(rng.integers(-spread, spread, dims), 5)) < 200
