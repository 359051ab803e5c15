"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, ranked, staged


def reshare(sizes: list[int], weights: list[float], budget: float, cap: float) -> list[float]:
    """Share budget by weight; a target stops at cap times its size, the excess is reshared by weight among the others."""
    targets, open_ = [0.0] * len(sizes), set(range(len(sizes)))
    left = budget
    while open_:
        total = sum(weights[i] for i in open_)
        over = {i for i in open_ if left * weights[i] / total > cap * sizes[i]}
        if not over:
            for i in open_:
                targets[i] = left * weights[i] / total
            break
        for i in over:
            targets[i] = cap * sizes[i]
            left -= targets[i]
        open_ -= over
    return targets


def fill(lengths: list[int], spare: list[int], left: int) -> tuple[list[int], int]:
    """(how many of each length, their sum): the largest sum up to left that spare[i] documents of lengths[i] can reach.

    Bounded knapsack: counts are split into powers of two, and for every sum the first part is kept by which it was
    reached, so memory is five bytes a sum. Short lengths come first, and it ends once left itself is reached.
    """
    reach, first = np.zeros(left + 1, dtype=bool), np.full(left + 1, -1, dtype=np.int32)
    reach[0] = True
    parts: list[tuple[int, int]] = []
    for i in sorted(range(len(lengths)), key=lambda i: lengths[i]):
        n = min(spare[i], left // lengths[i]) if lengths[i] else 0
        k = 1
        while n and not reach[left]:
            k = min(k, n)
            w = k * lengths[i]
            fresh = np.flatnonzero(reach[: left + 1 - w] & ~reach[w:]) + w
            reach[fresh], first[fresh] = True, len(parts)
            parts.append((i, k))
            n -= k
            k *= 2
    total = at = int(np.flatnonzero(reach)[-1])
    take = [0] * len(lengths)
    while at:
        i, k = parts[first[at]]
        take[i] += k
        at -= k * lengths[i]
    return take, total


def fit(lengths: list[int], counts: list[int], budget: int, window: int = 1 << 22) -> list[int]:
    """How many documents of each length to take so that their words reach the largest possible sum up to budget.

    Every length gives the same fraction of its documents, rounded down, for all but a window of the budget, and what
    that leaves beyond the window is filled from the longest lengths. `fill` closes the window from all documents left.
    The window is first twice the longest length and grows until the sum is the budget (or the last multiple of the
    lengths' common divisor before it), the window holds the whole budget, where fill is exact, or `window` words or
    twice the longest length. Past that the sum may stay short of the best one, by less than the longest length.
    """
    total = sum(n * c for n, c in zip(lengths, counts, strict=True))
    if budget <= 0 or total == 0:
        return [0] * len(lengths)
    if budget >= total:
        return list(counts)
    divisor = math.gcd(*(n for n, c in zip(lengths, counts, strict=True) if c))
    longest = max(lengths)
    goal, most, size = budget // divisor * divisor, max(window, 2 * longest), 2 * longest
    while True:
        size = min(size, goal)
        take = [c * (goal - size) // total for c in counts]
        left = goal - sum(n * t for n, t in zip(lengths, take, strict=True))
        for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
            if lengths[i] and left - size >= longest:
                more = min(counts[i] - take[i], (left - size) // lengths[i])
                take[i] += more
                left -= more * lengths[i]
        added, reached = fill(lengths, [c - t for c, t in zip(counts, take, strict=True)], left)
        if reached == left or size == goal or size >= most:
            return [t + a for t, a in zip(take, added, strict=True)]
        size = min(8 * size, max(most, size))


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, known, source_size -> with target. One row per source: a catalogue, not the data."""
    columns = ["source", "known", "source_size"]

    def one(batches):
        pdf = pd.concat([*batches] or [pd.DataFrame(columns=columns)])
        pdf = pdf.assign(key=[(not k, s.encode()) for s, k in zip(pdf["source"], pdf["known"], strict=True)]).sort_values("key", ignore_index=True).drop(columns="key")
        size = [int(x) for x in pdf["source_size"]]
        pdf["target"] = reshare(size, [weights[i % len(weights)] for i in range(len(size))], share * sum(size), cap)
        yield pdf

    return sizes.select(*columns).coalesce(1).mapInPandas(one, "source string, known boolean, source_size long, target double")


def mix(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, seed: int = 17, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", keep: tuple[str, ...] = ()) -> DataFrame:
    """How often the mix takes every document: id, source, size (words), source_size, target, copies, taken (words).

    Sources in code-point order, null last, get the weights in turn and share `share` times all words; no target exceeds
    cap times its source. A target holds floor(target / source_size) whole passes; the remaining budget is fitted by
    subset sums over the counts of documents by exact length, and of each length the documents with the lowest seeded
    hash are taken, so reruns and any partitioning agree. A document is taken at most ceil(cap) times.
    Null and empty texts have size 0 and are taken 0 words (copies: the whole passes); repeated rows count each; null
    ids are kept; an empty table gives no rows; other columns than those in keep are left out.
    """
    rows = staged(
        docs.select(
            F.col(id_col).alias("id"),
            F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"),
            F.col(source_col).isNotNull().alias("known"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"),
            *keep,
        ),
        "mix-rows",
    )
    by_length = rows.groupBy("source", "known", "size").agg(F.count(F.lit(1)).alias("n"))
    by_length = staged(by_length, "mix-lengths")
    goal = staged(targets(by_length.groupBy("source", "known").agg(F.sum(F.col("size") * F.col("n")).alias("source_size")), weights, share, cap), "mix-targets")
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    goal = goal.withColumn("passes", passes).withColumn("budget", F.round(F.col("target") - F.col("passes") * F.col("source_size")).cast("long"))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ignore_index=True)
        pdf["take"] = fit([int(x) for x in pdf["size"]], [int(x) for x in pdf["n"]], int(pdf["budget"].iloc[0]))
        return pdf[["source", "known", "size", "source_size", "target", "passes", "take"]]

    chosen = by_length.join(goal, ["source", "known"]).groupBy("source", "known").applyInPandas(choose, "source string, known boolean, size long, source_size long, target double, passes long, take long")
    placed = ranked(rows, ["source", "known", "size"], "h", ["id"], 64).join(chosen, ["source", "known", "size"])
    copies = F.col("passes") + (F.col("rank") < F.col("take")).cast("long")
    return placed.select(F.col("id").alias(id_col), F.when(F.col("known"), F.col("source")).alias("source"), "size", F.col("source_size").cast("long").alias("source_size"), "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *keep)
