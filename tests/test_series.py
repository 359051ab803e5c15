"""Scans over series in ranges, against plain Python."""

import itertools
import random

import pytest

from entitysurv.operators import series as Z


@pytest.fixture(autouse=True)
def small_ranges(spark):
    """Ranges of small inputs are not put together, so that borders are met."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def brute(frames):
    out = {}
    for series, rows in itertools.groupby(sorted(frames, key=lambda f: (f[0], f[1])), key=lambda f: f[0]):
        last, filled, runs, before, lost, n = 0.0, [], 0, None, 0, 0
        for _, idx, v, gone in rows:
            n += 1
            if gone:
                lost, runs, before = lost + 1, runs + (before != idx - 1), idx
            elif v is not None:
                last = v
            filled.append((idx, last if gone or v is None else v))
        out[series] = (filled, runs, lost / n)
    return out


def test_one_long_series_spreads_and_runs_cross_ranges(spark):
    """One series with most rows, long losses over several ranges, gaps in idx, a series lost from its start."""
    rng = random.Random(3)
    frames, gone = [], False
    for i in range(4000):
        gone = gone if rng.random() < 0.97 else not gone
        if i % 501:
            frames.append((1, i, rng.random() if i % 13 else None, gone))
    frames += [(2, i, 1.0 + i, i < 900) for i in range(1000)] + [(3, 0, 5.0, True), (4, 0, 6.0, False)]
    df = spark.createDataFrame(random.Random(4).sample(frames, len(frames)), "series int, idx long, v double, lost boolean")
    parts = {r[0] for r in Z.ranged(df, "series", "idx").where("series = 1").select("_range").distinct().collect()}
    assert len(parts) > 1
    want = brute(frames)
    got = {}
    for r in Z.repeat_fill(df).collect():
        got.setdefault(r.series, []).append((r.idx, r.filled))
    assert {s: sorted(f) for s, f in got.items()} == {s: w[0] for s, w in want.items()}
    stats = {r.series: (r.runs, r.loss_rate) for r in Z.loss_run_stats(df).collect()}
    assert stats == {s: (w[1], round(w[2], 6)) for s, w in want.items()}


def test_numbers_within_series(spark):
    rows = [(s, (i * 37) % 1000, i) for s, n in ((None, 300), (1, 1000), (2, 1)) for i in range(n)]
    got = Z.numbered(spark.createDataFrame(rows, "series int, t int, k int"), "t", "k").collect()
    for s in (None, 1, 2):
        assert [r.idx for r in sorted((r for r in got if r.series == s), key=lambda r: (r.t, r.k))] == list(range(sum(r[0] == s for r in rows)))
    assert Z.numbered(spark.createDataFrame([], "series int, t int"), "t").count() == 0
