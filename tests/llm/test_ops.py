"""Brute force, round trips and edge cases of the training-data operators."""

import random
import zlib

import duckdb
import numpy as np
import pytest

pytest.importorskip("entitysurv.llm")

from pyspark.sql import functions as F  # noqa: E402

from entitysurv.llm import embedding_dedup, mixing, ngram_join, packing, quality, queries, sharding, token_counts, token_output, toxicity, url_filter  # noqa: E402
from entitysurv.llm.common import components, scratch_path  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, source string, n int, gram string, score double, rank int"
WORDS = [f"w{i}" for i in range(400)]


def odd_docs(spark):
    """Nulls in every column, empty, blank and very long texts, ties, repeated rows, and columns that operators use inside."""
    rng = random.Random(1)
    long = " ".join(rng.choice(WORDS) for _ in range(30_000))
    rows = [(1, "a b c d e f g", "s1"), (1, "a b c d e f g", "s1"), (2, None, "s2"), (3, "", None), (4, " \t\n ", "s1"), (None, "lost id here", "s3"), (5, long, "s1"), (6, long, "s2"), (7, "x", None), (8, "A B C D E F G", "s2"), (9, "über straße naïve", "s9")]
    return spark.createDataFrame([(*r, 1, "z", 0.5, 2) for r in rows], DOC)


def empty_docs(spark):
    return spark.createDataFrame([], DOC)


def test_shards_hold_every_row_once_with_gapless_slots(spark):
    docs = odd_docs(spark)
    out = sharding.shard(docs, 3).collect()
    assert len(out) == docs.count()
    for s in {r.shard for r in out}:
        assert sorted(r.slot for r in out if r.shard == s) == list(range(sum(r.shard == s for r in out)))
    assert {r.size for r in out if r.doc_id == 2} == {16} and {r.text_crc32 for r in out if r.doc_id in (2, 3)} == {0}
    assert {r.text_crc32 for r in out if r.doc_id == 7} == {zlib.crc32(b"x")}
    assert sharding.shard(empty_docs(spark), 3).count() == 0


def test_shards_are_even_with_a_group_of_a_third(spark):
    rng = random.Random(3)
    rows = [(i, "same text " * 20 if i % 3 == 0 else " ".join(rng.choices(WORDS, k=rng.randint(1, 200)))) for i in range(4000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    for k in ("b", "n"):
        v = [r[k] for r in out]
        assert max(v) < 1.02 * sum(v) / 8


def jaccard_brute(rows):
    sets = []
    for _, text in rows:
        w = (text or "").encode().translate(ngram_join._ASCII_LOWER).split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    comp = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = sorted((comp[i], comp[j]))
                comp = [a if c == b else c for c in comp]
    return {rows[i][0]: (len(sets[i]), min(rows[j][0] for j in range(len(rows)) if comp[j] == comp[i])) for i in range(len(rows))}


@pytest.mark.parametrize("pivots", [True, False])
def test_jaccard_components_equal_brute_force(spark, pivots):
    rng = random.Random(7)
    passage = rng.choices(WORDS, k=60)
    base = rng.choices(WORDS, k=80)
    rows = []
    for i in range(260):
        kind = i % 5
        if kind == 0:
            w = rng.choices(WORDS, k=rng.randint(1, 120))
        elif kind == 1:
            w = passage + rng.choices(WORDS, k=rng.randint(0, 30))
        else:
            w = list(base)
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
        rows.append((i, " ".join(w)))
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), pivots=pivots, block_docs=16, frequent=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == jaccard_brute(rows)


def test_jaccard_odd_rows(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd_docs(spark)).collect()}
    assert got[1] == (3, 1) and got[8] == (3, 1) and got[5][1] == got[6][1] == 5
    assert got[2] == (0, 2) and got[3] == (0, 3) and got[4] == (0, 4) and got[7] == (1, 7) and got[None] == (1, None)
    assert ngram_join.jaccard_components(empty_docs(spark)).count() == 0


def greedy(word: bytes, pieces: set) -> int:
    s, i, n = (*word, token_counts.END), 0, 0
    while i < len(s):
        if s[i:] == (token_counts.END,):
            break
        j = next((j for j in range(len(s), i, -1) if s[i:j] in pieces), None)
        n, i = n + 1, j
    return n


def test_token_counts_equal_greedy_matching(spark):
    path = queries.tokenizer_path(queries.WORD_BPE)
    pieces = token_counts.load_vocabulary(path)
    automaton, known = token_counts.LongestMatch(pieces), set(pieces)
    rng = random.Random(5)
    words = {"".join(rng.choices("abcdefghinorstuéß.,#ू", k=rng.randint(1, 18))).encode() for _ in range(1500)} | {b"a" * 5000}
    assert all(automaton.count(w) == greedy(w, known) for w in words)
    got = {r.doc_id: (r.n_words, r.n_tokens) for r in token_counts.token_counts(odd_docs(spark), path).collect()}
    assert got[2] == got[3] == got[4] == (0, 0) and got[1][0] == 7
    assert token_counts.token_counts(empty_docs(spark), path).count() == 0


def test_embedding_links_equal_brute_force(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(300, 16))
    x = np.concatenate([base, base[:80] + rng.normal(scale=0.05, size=(80, 16)), np.repeat(base[:1], 60, 0) + rng.normal(scale=0.04, size=(60, 16)), base[5:8]])
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    big = [(2000, [1e200, 1e200]), (2001, [1e200, 1.0001e200]), (2002, [1e-200, 1e-200]), (2003, [-1e200, 1e-200])]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [None] * 16), (1004, []), (1005, [1.0, -2.0])]
    audits = []
    table = spark.createDataFrame([(*r, 1, "x", True) for r in rows + odd + big], "vec_id long, embedding array<double>, n int, rep string, fine boolean")
    got = {r.vec_id: r for r in embedding_dedup.near_duplicates(table, shards=3, fan=2, audits=audits).collect()}
    assert len(audits) >= 3 and all(a.recall >= 0.99 for a in audits)
    assert [(got[i].n_links, got[i].component_id) for i, _ in big[:3]] == [(2, 2000)] * 3 and got[2003].n_links == 0 and got[1005].n_links == 0
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = u @ u.T >= 0.95
    n = link.sum(1) - 1
    found = sum(got[i].n_links for i in range(len(x)))
    assert found >= 0.99 * n.sum() and all(got[i].n_links <= n[i] for i in range(len(x)))
    root = np.arange(len(x))
    while (low := np.array([root[r].min() for r in link])).tolist() != root.tolist():
        root = low
    assert sum(got[i].component_id == root[i] for i in range(len(x))) >= 0.99 * len(x)
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i, _ in odd)
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 40 != 39] + [(3, 3), (2, 1), (None, 5)], "a long, b long")
    for size in (1000, 20):
        got = {r.node: r.component for r in components(edges, part_edges=size).collect()}
        assert all(got[i] == i // 40 * 40 for i in range(200))


def repeat_brute(words):
    seen = {}
    for i in range(len(words) - 7):
        seen.setdefault(tuple(words[i : i + 8]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + 8)})


def test_quality_measures(spark):
    rng = random.Random(4)
    for _ in range(60):
        words = [rng.choice([b"a", b"b", b"c"]) for _ in range(rng.randint(0, 60))]
        assert quality.repeated_words(words) == repeat_brute(words)
    prose = " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(500))
    noise = "".join(chr(rng.randrange(33, 0x2000)) + ("" if i % 7 else " ") for i in range(4000))
    rows = [(1, prose), (2, "same line\n" * 300), (3, None), (4, noise), (5, "dup\n\n x\ndup\n\nü #%")]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].kept and not got[2].kept and not got[3].kept and not got[4].kept
    assert (got[5].n_words, got[5].word_chars, got[5].n_symbols, got[5].n_dup_lines, got[5].base_failed) == (5, 10, 2, 1, True)
    assert quality.quality(odd_docs(spark)).count() == 11 and quality.quality(empty_docs(spark)).count() == 0
    assert quality.filter_quality(odd_docs(spark)).columns == odd_docs(spark).columns


def test_mix_meets_targets(spark):
    rng = random.Random(6)
    rows = [(i, " ".join("w" * rng.randint(1, 40)), "abc"[i % 3] if i % 7 else None) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert sorted(got) == sorted(mixing.mix(docs.repartition(7)).collect())
    total = sum(r.size for r in got)
    by = {}
    for r in got:
        by.setdefault(r.source, [r.target, r.source_size, 0])[2] += r.taken
        assert r.taken <= 2 * r.size
    assert abs(sum(t for t, _, _ in by.values()) - 1.5 * total) < 1e-6 and list(sorted(by, key=lambda s: (s is None, s or ""))) == ["a", "b", "c", None]
    assert all(t <= 2 * s + 1e-9 and abs(t - k) <= 1 for t, s, k in by.values())
    assert mixing.mix(odd_docs(spark)).count() == 11 and mixing.mix(empty_docs(spark)).count() == 0


def test_fit_reaches_the_best_subset_sum():
    rng = random.Random(8)
    for _ in range(1500):
        step = rng.choice([1, 1, 3])
        lengths = [step * n for n in sorted(rng.sample(range(0, 30), 5))]
        counts = [rng.randint(0, 3) for _ in lengths]
        budget = rng.randint(0, 60 * step)
        sums = {0}
        for n, c in zip(lengths, counts, strict=True):
            sums = {s + k * n for s in sums for k in range(c + 1)}
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        assert sum(n * t for n, t in zip(lengths, take, strict=True)) == max(s for s in sums if s <= budget)
    # a budget far beyond the window, and one text of ten million words: memory stays a few bytes a word of the window
    lengths, counts = [10, 14, 22, 3000], [10**7, 10**6, 10**5, 1000]
    assert sum(n * t for n, t in zip(lengths, mixing.fit(lengths, counts, 87_654_321, window=1 << 16), strict=True)) == 87_654_320
    take = mixing.fit([7, 9, 10_000_000], [100, 100, 3], 20_000_050)
    assert sum(n * t for n, t in zip([7, 9, 10_000_000], take, strict=True)) == 20_000_050


def test_packing_keeps_all_words_without_conflicts(spark):
    rng = random.Random(9)
    rows = [(i, "copy of one text" if i % 3 == 0 else " ".join("w" * rng.randint(0, 300)), "hot" if i % 2 else f"s{i % 9}") for i in range(500)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=128, bucket_pieces=120).collect()
    size, seen = {}, set()
    words = {}
    for r in out:
        size[r.pack_id] = size.get(r.pack_id, 0) + r.length + 1
        assert (r.pack_id, r.cluster) not in seen
        seen.add((r.pack_id, r.cluster))
        words[r.doc_id] = words.get(r.doc_id, 0) + r.length
    assert max(size.values()) <= 128 and words == {i: len(t.split()) for i, t, _ in rows}
    assert packing.pack(odd_docs(spark)).where("doc_id is null").count() == 1 and packing.pack(empty_docs(spark)).count() == 0


def test_best_fit_replayed(spark):
    """Every item goes to a compatible bin with the least room that holds it, or to a new one if there is none."""
    rng = random.Random(31)
    for _ in range(60):
        n, capacity = rng.randint(1, 80), rng.randint(8, 40)
        sizes = [rng.randint(1, capacity) for _ in range(n)]
        masks = [1 << rng.randrange(4) | (1 << (4 + rng.randrange(6)) if rng.random() < 0.5 else 0) for _ in range(n)]
        put, left, bits = packing.best_fit(sizes, masks, capacity), {}, {}
        for i in sorted(range(n), key=lambda i: -sizes[i]):
            b, at = put[i]
            able = [x for x in left if left[x] >= sizes[i] and not bits[x] & masks[i]]
            assert (b in able and left[b] == min(left[x] for x in able)) if able else b not in left
            assert at == capacity - left.get(b, capacity)
            left[b], bits[b] = left.get(b, capacity) - sizes[i], bits.get(b, 0) | masks[i]


def test_a_source_keeps_its_quota(spark):
    rng = random.Random(13)
    rows = [(i, " ".join("w" * rng.randint(5, 60)) + f" {i}", "hot" if i % 3 == 0 else f"s{i % 30}") for i in range(900)]
    out = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), capacity=256).collect()
    per_bin = len(out) * 256 / sum(r.length + 1 for r in out)
    count, per = {}, {}
    for r in out:
        count[r.source] = count.get(r.source, 0) + 1
        per[r.pack_id, r.source] = per.get((r.pack_id, r.source), 0) + 1
    assert all(n <= np.ceil(2 * per_bin * count[s] / len(out)) for (_, s), n in per.items())
    assert sum(r.length + 1 for r in out) > 0.85 * 256 * len({r.pack_id for r in out})


def test_shards_replayed_and_a_hot_group_without_ids(spark):
    rng = random.Random(17)
    for _ in range(20):
        items, residual = np.array([[rng.random() for _ in range(3)] for _ in range(30)]), np.full((4, 3), 6.0)
        left, out = residual.copy(), sharding.place(items, residual)
        for i in sorted(range(30), key=lambda i: -items[i].max()):
            best = (left @ items[i]).max()
            assert left[out[i]] @ items[i] == pytest.approx(best)
            left[out[i]] -= items[i]
    rows = [(None if i % 3 else i, "hot text here" if i % 3 else " ".join(rng.choices(WORDS, k=rng.randint(1, 60)))) for i in range(3000)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 8).groupBy("shard").count().collect()
    assert len(out) == 8 and max(r["count"] for r in out) < 1.1 * 3000 / 8


def test_links_come_from_the_product(spark, monkeypatch):
    """With the product's blocks empty nothing but equal sets is one component, with and without frequent n-grams."""
    rng = random.Random(23)
    base = rng.choices(WORDS, k=60)
    rows = [(i, " ".join([*base[: 55 + i % 5], f"x{i}"])) for i in range(30)] + [(40 + i, f"p{i} q{i} " * 6 + "a b c d e f") for i in range(20)]
    docs = spark.createDataFrame([*rows, (90, rows[0][1])], "doc_id long, text string")
    comp = lambda **how: {r.doc_id: r.component_id for r in ngram_join.jaccard_components(docs, **how).collect()}
    assert {k: c for k, c in comp(frequent=4).items()} == {k: c for k, (_, c) in jaccard_brute([*rows, (90, rows[0][1])]).items()}

    def nothing(batches, percent):
        import pyarrow as pa

        for _ in batches:
            yield pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])

    monkeypatch.setattr(ngram_join, "_product", nothing)
    for frequent in (4, 10**6):
        assert comp(frequent=frequent) == {**{i: i for i, _ in rows}, 90: 0}


def test_best_fit_takes_the_tightest_compatible_bin():
    assert packing.best_fit([6, 5, 4, 3], [1, 2, 4, 1], 10) == [(0, 0), (1, 0), (0, 6), (1, 5)]
    assert packing.best_fit([5, 5, 5], [1, 1, 2], 10) == [(0, 0), (1, 0), (0, 5)]


def test_url_rules_and_trees(spark):
    urls = ["http://A.Example.NET/en/x", "http://a.example.net/de/x", "https://example.com/de/1?x=1", "https://badexample.com/de/1", "https://q.org/fr/", "no scheme", None, "ftp://h.org#f"]
    rows = [(i, u) for i, u in enumerate(urls)] + [(100 + i, f"https://spam-farm{i}.example.org/a/b/{i}?q={i}") for i in range(40)] + [(200 + i, f"https://site{i}.example.org/en/{i}") for i in range(40)]
    labels = spark.createDataFrame([(u, int("spam" in u)) for i, u in rows if i >= 100], "url string, label int")
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), labels=labels).collect()}
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(8)] == [("a.example.net", "/en/x", "example.net/en/"), ("a.example.net", "/de/x", "net/"), ("example.com", "/de/1", "example.com/de/"), ("badexample.com", "/de/1", None), ("q.org", "/fr/", "org/fr/"), ("", "", None), ("", "", None), ("h.org", "", None)]
    assert [got[i].verdict for i in (0, 1, 2, 4)] == ["allow", "block", "block", "allow"]
    assert all(got[100 + i].verdict == "block" and got[200 + i].verdict == "allow" for i in range(40) if i > 0)
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_url_statistics_count_all_pages_but_the_own_fold(spark):
    rows = [(i, f"https://h{i}.{('one', 'two', 'three')[i % 3]}/{'ab'[i % 2]}/x", int(i % 5 == 0)) for i in range(90)] + [(90, "https://rare.example/only/here", 1)]
    split = lambda url: (url.split("/")[2].split(".")[-1], "/".join((url.split("/")[2].split(".")[-1], url.split("/")[3])))
    labelled = spark.createDataFrame(rows, "id long, url string, label int").withColumns({"host": url_filter.host_of(F.col("url")), "path": url_filter.path_of(F.col("url"))})
    _, suffixes, sections = url_filter.train(labelled, max_rows=10)
    got = url_filter.with_statistics(url_filter.with_features(labelled), suffixes, sections).collect()
    fold = {r.url: r.fold for r in got}
    assert len(got) == 91 and len(set(fold.values())) == 5
    for r in got:
        others = [[y for _, u, y in rows if fold[u] != r.fold and split(u)[k] == split(r.url)[k]] for k in (0, 1)]
        share = [(sum(x) + 1) / (len(x) + 2) for x in others]
        assert (r.f_suffix_block, r.f_path_block, r.f_suffix_count) == (pytest.approx(share[0]), pytest.approx(share[1]), pytest.approx(np.log1p(len(others[0]))))


def test_url_filter_on_unseen_hosts_and_odd_rows(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = url_filter.held_out(pages).agg(*(F.sum(c).alias(c) for c in ("n", "blocked", "caught", "false_blocks"))).first()
    assert got.n == pages.count() and got.blocked > 30
    assert got.caught >= 0.9 * got.blocked and got.false_blocks <= 0.05 * (got.n - got.blocked)
    odd = [(1, "https://a.org/x"), (1, "https://a.org/x"), (None, "https://casino.org/x"), (2, None), (3, ""), (4, "https://" + "a" * 100_000 + ".org/" + "b/" * 50_000)]
    clash = spark.createDataFrame([(*r, 1, "z", 0.5, "q", 3) for r in odd], "page_id long, url string, label int, host string, n double, fold string, rows int")
    out = url_filter.judge(clash)
    assert out.count() == 6 and out.columns == ["page_id", "url", "host", "path", "rule", "margin", "verdict"]


def test_url_margin_is_the_fitted_model_s(spark):
    rng = random.Random(8)
    rows = [([rng.random() * 9 for _ in url_filter.FEATURES],) for _ in range(400)]
    ready = spark.createDataFrame([(*r, float(r[0] + r[5] > 9 or r[9] > 8)) for (r,) in rows], ", ".join(f"{f} double" for f in url_filter.FEATURES) + ", label double")
    model = url_filter.fit_trees(ready)
    vectors = url_filter.VectorAssembler(inputCols=url_filter.FEATURES, outputCol="features").transform(ready)
    got = model.transform(vectors).withColumn("margin", url_filter.margin_of(model)).select("margin", "rawPrediction", "prediction", "label").collect()
    assert len({r.label for r in got}) == 2
    assert all(r.margin == pytest.approx(r.rawPrediction[1]) and (r.margin > 0) == (r.prediction == 1) for r in got)


def test_url_words_are_the_fallback(spark):
    rows = [(i, f"https://{'casino' if i % 2 else 'house'}{'-' * (i % 2)}{i}.com/x") for i in range(60)]
    labelled = url_filter.labelled_urls(spark.createDataFrame(rows, "page_id long, url string"), rules=[]).collect()
    assert sum(r.label for r in labelled) == 30 and all(r.label == ("casino" in r.host) for r in labelled)


def test_huffman_round_trip_and_optimal_lengths():
    rng = np.random.default_rng(4)
    for n, limit in ((1, 16), (2, 16), (300, 16), (300, 9), (5000, 13)):
        ids = np.minimum(rng.geometric(0.01, size=3000), n).astype(np.uint32) - 1
        counts = {i: int(c) for i, c in enumerate(np.bincount(ids, minlength=n))}
        lengths = token_output.code_lengths(counts, limit)
        assert max(lengths.values()) <= limit and sum(2.0**-b for b in lengths.values()) <= 1 + 1e-12
        codes, bits = token_output.canonical(lengths)
        payload, at = token_output.encode_ids(ids, codes, bits)
        symbol, used = token_output.decode_table(lengths, limit)
        assert (token_output.decode_ids(payload, at, len(ids), symbol, used, limit) == ids).all()


def test_word_shortcuts_equal_whole_text_encoding():
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_BPE)
    with open(path, encoding="utf-8") as f:
        spec = f.read()
    t, words, rng = Tokenizer.from_str(spec), token_output._WordIds(spec, 50), random.Random(3)
    assert words.lower and words.letters
    scripts = [(0x21, 0x7F), (0xA0, 0x250), (0x300, 0x370), (0x370, 0x530), (0x900, 0x980), (0xE00, 0xE80), (0x1E00, 0x2000), (0x3040, 0x30FF), (0xAC00, 0xACFF), (0x1F600, 0x1F640)]
    texts = ["a<|EndOfText|>b c.", "A<|endoftext|>b", "<|STARTOFTEXT|> x", "İstanbul. ΟΔΟΣ. Kelvin, it's. don't!? 'tis ''", "a\u00a0B\u2003c.\x1cd,\x85e", "e\u0301. A\u030a, \u1e9e."]
    for low, high in scripts:
        for _ in range(300):
            pool = [chr(rng.randrange(low, high)) for _ in range(5)] + list(rng.choice(["aB", ".,", "'s ", " \t", "1é"]))
            texts.append("".join(rng.choice(pool) for _ in range(rng.randint(1, 14))) + rng.choice(["", ".", ",", "!?"]))
    for x in texts:
        assert words.of_text(x) == np.array(t.encode(x, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(x)


def test_token_files_round_trip(spark):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path(queries.WORD_BPE)
    t = Tokenizer.from_file(path)
    for docs in (odd_docs(spark), empty_docs(spark), spark.read.parquet(f"{SF}/documents.parquet")):
        got = sorted(token_output.read_tokens(spark, token_output.write_tokens(docs, path, scratch_path(spark, "t"), block_ids=4000)).collect(), key=lambda r: r.start)
        start = 0
        want = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
        for r, (doc, text) in zip(got, want, strict=True):
            ids = t.encode(text or "", add_special_tokens=False).ids + [1]
            assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (doc, start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())) and r.ids == ids
            start += len(ids)


def test_toxicity_finds_sentences_and_holds_out(spark):
    rng = random.Random(2)
    bad = ["grumblehead", "snotface", "dolt"]
    rows = []
    for i in range(900):
        sents = [" ".join(rng.choices(WORDS, k=8)) + "." for _ in range(rng.randint(1, 12))]
        if i % 6 == 0:
            sents[rng.randrange(len(sents))] = f"you {rng.choice(bad)} {rng.choice(WORDS)}."
        rows.append((i, " ".join(sents), int(i % 6 == 0)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit_model(docs.drop("toxic"), docs.where("doc_id < 600").select("doc_id", "toxic"))
    got = {r.doc_id: r for r in toxicity.score(docs.drop("toxic"), model).collect()}
    assert sum((got[i].score >= 0.5) == bool(y) for i, _, y in rows if i >= 600) >= 297
    assert all(any(b in rows[i][1][s.start : s.end] for b in bad) for i in range(0, 900, 6) for s in got[i].offending)
    assert toxicity.score(odd_docs(spark), model).count() == 11 and toxicity.score(empty_docs(spark), model).count() == 0
    assert 0 <= toxicity.score(odd_docs(spark), toxicity.Model({}, -3.0)).first().score <= 1


def test_registered_queries_run_and_match_sql(spark):
    from compare import differences, duck

    con = duck(SF)
    for name, f in queries.QUERIES.items():
        if name in queries.ORACLE_SQL:
            assert not differences(f(spark, SF), con, queries.ORACLE_SQL[name]), name


def stage_docs(spark):
    """Small documents for the stages, with columns that the operators use inside."""
    rng = random.Random(21)
    prose = lambda n: " ".join("".join(rng.choices("etaoinshrdlu", k=rng.randint(2, 9))) for _ in range(n))
    base = [prose(rng.randint(40, 300)) for _ in range(30)]
    near = [t.rsplit(" ", 2)[0] + " other end" for t in base[:8]]
    texts = base + near + base[:4] + ["same line\n" * 40, "few words", "", None, " \t "]
    rows = [(i if i % 17 else None, t, "en", ["a", "b", "c", None][i % 4], 1, 2, "x", 0.5) for i, t in enumerate(texts)]
    return rows, spark.createDataFrame(rows + rows[5:6], "doc_id long, text string, lang string, source string, row long, copies int, d string, size double")


def test_each_pipeline_stage_equals_brute_force(spark):
    import zstandard

    import corpus_pipeline as P

    rows, docs = stage_docs(spark)
    rows = rows + rows[5:6]
    as_rows = lambda df: sorted(map(tuple, df.collect()), key=repr)

    def good(text):
        data = (text or "").encode()
        words = data.split()
        n = len(words)
        if n < 20 or 100 * repeat_brute(words) > 30 * n:
            return False
        z = zstandard.ZstdCompressor(level=3, write_content_size=False)
        low, high = next((lo, hi) for least, lo, hi in quality.BANDS[::-1] if len(data) >= least)
        chunks = [len(z.compress(data[i : i + 1024])) / 1024 for i in range(0, len(data) - 1023, 1024)]
        return low <= len(z.compress(data)) / len(data) <= high and sum(not 0.36 <= c <= 0.8 for c in chunks) <= 0.25 * len(chunks)

    kept = [r for r in rows if good(r[1])]
    assert as_rows(P.quality_rules(spark, docs, SF)) == sorted(kept, key=repr) and 0 < len(kept) < len(rows)
    assert {r.doc_id: r.kept for r in quality.quality(docs).where("doc_id is not null").collect()} == {r[0]: good(r[1]) for r in rows if r[0] is not None}

    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.fit_model(docs, labels.where(~queries.held_out(F.col("doc_id"))))
    weights = toxicity._Weights(model)
    assert as_rows(P.drop_toxic(spark, docs, SF)) == sorted((r for r in rows if toxicity.score_text(r[1] or "", weights)[0] < 0.5), key=repr)

    known = {i: r for i, r in enumerate(dict.fromkeys(r for r in rows if r[0] is not None))}
    groups = {}
    for i, (_, c) in jaccard_brute([(i, r[1]) for i, r in known.items()]).items():
        groups.setdefault(c, []).append(known[i])
    want = [min(g, key=lambda r: r[0]) for g in groups.values()] + [r for r in rows if r[0] is None]
    assert as_rows(P.one_of_each_group(spark, docs, SF)) == sorted(want, key=repr) and len(want) < len(rows) - 8

    out = P.mix_sources(spark, docs, SF).collect()
    size = lambda r: len((r[1] or "").split())
    for source, target in zip(["a", "b", "c", None], mixing.reshare([sum(size(r) for r in rows if r[3] == s) for s in ("a", "b", "c", None)], [3, 1, 2, 3], 1.5 * sum(map(size, rows)), 2.0), strict=True):
        mine = [size(r) for r in rows if r[3] == source]
        passes = int(target // sum(mine))
        budget = round(target - passes * sum(mine))
        sums = {0}
        for n in mine:
            sums |= {x + n for x in sums if x + n <= budget}
        assert sum(size(r) for r in out if r[3] == source) == passes * sum(mine) + max(sums)
    assert {tuple(r) for r in out} <= set(rows) and P.mix_sources(spark, docs, SF).columns == docs.columns

    packs = P.pack_sequences(spark, docs, SF).collect()
    words = {}
    for r in packs:
        words[r.doc_id] = words.get(r.doc_id, 0) + r.length
    assert words == {k: sum(size(r) for r in rows if r[0] == k) for k in {r[0] for r in rows}}


def test_pipeline_on_an_empty_table_and_on_the_smallest(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs.limit(0), SF)
        assert out.count() == 0 and (name == "best-fit packing" or out.columns == docs.columns), name
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_pipeline_keeps_rows_with_null_and_shared_ids(spark):
    import corpus_pipeline

    rng = random.Random(12)
    text = lambda: " ".join(rng.choices(WORDS, k=30))
    same, base = text(), text()
    rows = [(None, same, "a"), (None, same, "a"), (None, text(), "b"), (7, text(), "a"), (7, text(), "b"), (7, base, "a"), (5, base, "b"), (8, text(), None), (8, None, "a"), (9, "", "b"), (9, "", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    one = [r for i, r in enumerate(rows) if i not in (5, 10)]  # 7 goes for 5, whose text it has, and a repeated row stays once
    key = lambda r: tuple((x is None, x or "") if not isinstance(x, int) else (False, str(x)) for x in r)
    assert sorted(map(tuple, corpus_pipeline.one_of_each_group(spark, docs, SF).collect()), key=key) == sorted(one, key=key)
    taken = {}
    for r in mixing.mix(docs).collect():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    words = {}
    for r in corpus_pipeline.mix_sources(spark, docs, SF).collect():
        assert tuple(r) in rows
        words[r.source] = words.get(r.source, 0) + len((r.text or "").split())
    assert {s: words.get(s, 0) for s in taken} == taken


def test_base_measures_match_sql(spark):
    con = duckdb.connect()
    sql = f"""SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS n_words,
      coalesce(length(regexp_replace(text, '[\\x20\\x09-\\x0D]', '', 'g')), 0) AS word_chars, coalesce(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')), 0) AS n_symbols
      FROM read_parquet('{SF}/documents.parquet')"""
    want = {r[0]: r[1:] for r in con.execute(sql).fetchall()}
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols) for r in queries.op5_quality_rules(spark, SF).collect()}
    assert got == want
