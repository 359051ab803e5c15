"""Embedding near-duplicates: a navigable small-world graph per shard, every shard searched, cosine verified, components."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, salted_join, staged

M = 16  #: neighbours of a node on the upper layers; twice that on the lowest


# ---- one graph -------------------------------------------------------------------------------------------------


class Graph:
    """Hierarchical navigable small world over unit vectors; builds and searches run for many vectors at once.

    layers[0] holds all nodes, layers[k] those drawn for level k (by the position, so a rebuild gives the same graph);
    each layer is (nodes, links): links[i] are the neighbours of nodes[i], as vector numbers, -1 where there is none.
    """

    def __init__(self, x: np.ndarray, m: int = M, ef: int = 48, batch: int = 512, seed: int = 3):
        self.x, self.m = x, m
        n = len(x)
        rng = np.random.default_rng(seed)
        level = np.minimum((-np.log(1 - rng.random(n)) / np.log(m)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the highest first: an upper layer is complete before the lower ones use it
        self.layers: list[tuple[np.ndarray, np.ndarray]] = []
        self.at = np.zeros(n, dtype=np.int64)
        self.level = level
        self.links = [np.full((n, 2 * m if k == 0 else m), -1, dtype=np.int32) for k in range(int(level.max(initial=0)) + 1)]
        self.entry = int(order[0]) if n else -1
        self.done = np.zeros(n, dtype=bool)
        i = 0
        while i < n:
            step = order[i : i + max(1, min(batch, i))]
            self._insert(step, ef)
            i += len(step)

    def _insert(self, new: np.ndarray, ef: int) -> None:
        for k in range(len(self.links)):
            own = new[self.level[new] >= k]
            if not len(own):
                break
            there = self.done.copy() if k == 0 else self.done & (self.level >= k)
            inside = self.x[own] @ self.x[own].T
            np.fill_diagonal(inside, -2)
            pick = np.argsort(-inside, axis=1)[:, : min(len(own) - 1, ef)]
            cand = [own[pick]]
            score = [np.take_along_axis(inside, pick, axis=1)]
            if there.any():
                ids, sims = self._beam(self.x[own], ef, k)
                cand.append(ids)
                score.append(sims)
            cand, score = np.concatenate(cand, axis=1), np.concatenate(score, axis=1)
            chosen = self._diverse(cand, score, self.links[k].shape[1] // (2 if k == 0 else 1))
            self.links[k][own, : chosen.shape[1]] = chosen
            self._back(own, chosen, k)
        self.done[new] = True

    def _diverse(self, cand: np.ndarray, score: np.ndarray, keep: int) -> np.ndarray:
        """Of each row's candidates those nearer to the row's vector than to any chosen one; the nearest others fill up."""
        width = min(cand.shape[1], 3 * keep)
        order = np.argsort(-score, axis=1, kind="stable")[:, :width]
        cand, score = np.take_along_axis(cand, order, axis=1), np.take_along_axis(score, order, axis=1)
        rows = len(cand)
        out = np.full((rows, keep), -1, dtype=np.int32)
        count = np.zeros(rows, dtype=np.int64)
        used = np.zeros(cand.shape, dtype=bool)
        held = np.zeros((rows, keep, self.x.shape[1]), dtype=np.float32)
        for j in range(width):
            vec = self.x[np.maximum(cand[:, j], 0)]
            near = np.einsum("rkd,rd->rk", held, vec)
            near[np.arange(keep)[None, :] >= count[:, None]] = -2
            ok = (cand[:, j] >= 0) & (count < keep) & (near.max(axis=1, initial=-2) < score[:, j])
            r = np.flatnonzero(ok)
            out[r, count[r]], held[r, count[r]], used[r, j] = cand[r, j], vec[r], True
            count[r] += 1
        for j in range(width):
            r = np.flatnonzero(~used[:, j] & (cand[:, j] >= 0) & (count < keep))
            out[r, count[r]] = cand[r, j]
            count[r] += 1
        return out

    def _back(self, own: np.ndarray, chosen: np.ndarray, k: int) -> None:
        """Link the chosen neighbours back; a full neighbour keeps a diverse choice of old and new."""
        links = self.links[k]
        to, frm = chosen.ravel(), np.repeat(own, chosen.shape[1])
        ok = to >= 0
        to, frm = to[ok], frm[ok]
        order = np.argsort(to, kind="stable")
        to, frm = to[order], frm[order]
        nodes, start, count = np.unique(to, return_index=True, return_counts=True)
        wide = int(count.max(initial=0))
        if not wide:
            return
        fresh = np.full((len(nodes), wide), -1, dtype=np.int64)
        row = np.repeat(np.arange(len(nodes)), count)
        fresh[row, np.arange(len(to)) - np.repeat(start, count)] = frm
        every = np.concatenate([links[nodes].astype(np.int64), fresh], axis=1)
        every = np.sort(every, axis=1)
        every[:, 1:][every[:, 1:] == every[:, :-1]] = -1
        for a in range(0, len(nodes), 256):
            part = every[a : a + 256]
            sims = np.einsum("rkd,rd->rk", self.x[np.maximum(part, 0)], self.x[nodes[a : a + 256]])
            sims[part < 0] = -3
            links[nodes[a : a + 256]] = self._diverse(part, sims, links.shape[1])

    def _beam(self, q: np.ndarray, ef: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, similarities), best first, of the ef nearest nodes of layer k that the graph leads to; -1 where fewer."""
        start = np.full(len(q), self.entry, dtype=np.int64)
        best = np.einsum("qd,qd->q", self.x[start], q)
        for upper in range(len(self.links) - 1, k, -1):  # greedy descent
            moved = np.arange(len(q))
            while len(moved):
                near = self.links[upper][start[moved]]
                sims = np.einsum("qkd,qd->qk", self.x[np.maximum(near, 0)], q[moved])
                sims[near < 0] = -3
                j = sims.argmax(axis=1)
                got = sims[np.arange(len(moved)), j]
                better = got > best[moved] + 1e-9
                start[moved[better]], best[moved[better]] = near[np.arange(len(moved)), j][better], got[better]
                moved = moved[better]
        ids = np.full((len(q), ef), -1, dtype=np.int64)
        sims = np.full((len(q), ef), -3, dtype=np.float32)
        open_ = np.zeros((len(q), ef), dtype=bool)
        ids[:, 0], sims[:, 0], open_[:, 0] = start, best, True
        seen = np.zeros((len(q), len(self.x)), dtype=bool)
        seen[np.arange(len(q)), start] = True
        links, at_once = self.links[k], 3
        active = np.arange(len(q))
        while len(active):
            o = np.where(open_[active], sims[active], -4)
            top = np.argpartition(-o, min(at_once, ef) - 1, axis=1)[:, :at_once] if ef > at_once else np.argsort(-o, axis=1)
            live = np.take_along_axis(o, top, axis=1) > -3.5
            some = live.any(axis=1)
            active, top, live = active[some], top[some], live[some]
            if not len(active):
                break
            node = np.where(live, ids[active[:, None], top], -1)
            open_[active[:, None], top] = False
            near = links[np.maximum(node, 0)].astype(np.int64)
            near[node < 0] = -1
            near = np.sort(near.reshape(len(active), -1), axis=1)
            near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
            fresh = (near >= 0) & ~seen[active[:, None], np.maximum(near, 0)]
            r, c = np.nonzero(fresh)
            seen[active[r], near[r, c]] = True
            s = np.full(near.shape, -3, dtype=np.float32)
            s[r, c] = np.einsum("kd,kd->k", self.x[near[r, c]], q[active[r]])
            both_s = np.concatenate([sims[active], s], axis=1)
            both_i = np.concatenate([ids[active], np.where(fresh, near, -1)], axis=1)
            both_o = np.concatenate([open_[active], fresh], axis=1)
            keep = np.argpartition(-both_s, ef - 1, axis=1)[:, :ef]
            sims[active] = np.take_along_axis(both_s, keep, axis=1)
            ids[active] = np.take_along_axis(both_i, keep, axis=1)
            open_[active] = np.take_along_axis(both_o, keep, axis=1)
        order = np.argsort(-sims, axis=1, kind="stable")
        return np.take_along_axis(ids, order, axis=1), np.take_along_axis(sims, order, axis=1)

    def within(self, q: np.ndarray, least: float, ef: int, widest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node) pairs of similarity >= least, and the queries whose beam was full of them at the widest."""
        found_q, found_n, rest = [], [], np.arange(len(q))
        while len(rest) and ef <= widest:
            full = []
            chunk = max(32, min(1024, (1 << 26) // max(1, len(self.x))))
            for a in range(0, len(rest), chunk):
                part = rest[a : a + chunk]
                ids, sims = self._beam(q[part], min(ef, len(self.x)), 0)
                hit = (sims >= least) & (ids >= 0)
                crowded = hit.all(axis=1) & (ids.shape[1] < len(self.x))
                r, c = np.nonzero(hit & ~crowded[:, None])
                found_q.append(part[r])
                found_n.append(ids[r, c])
                full.append(part[crowded])
            rest, ef = np.concatenate(full), ef * 2
        none = [np.zeros(0, dtype=np.int64)]
        return np.concatenate(found_q or none), np.concatenate(found_n or none), rest


# ---- tasks -----------------------------------------------------------------------------------------------------


def _pack_graph(g: Graph) -> bytes:
    import pickle

    return pickle.dumps((g.level.astype(np.int8), g.links, g.entry))


def _unpack_graph(blob: bytes, x: np.ndarray) -> Graph:
    import pickle

    g = Graph.__new__(Graph)
    g.x, (g.level, g.links, g.entry) = x, pickle.loads(blob)
    return g


def _unit(v: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision; dividing by the largest part first keeps very large and small ones exact."""
    v = v.astype(np.float64)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def audit(g: Graph, least: float, ef: int, links: int, recall: float, seed: int = 9) -> tuple[int, float]:
    """(beam, recall): beams widen from ef until so many planted links are found: copies of nodes turned at random to a
    cosine just over `least`, the hardest that has to be found."""
    n, dim = g.x.shape
    rng = np.random.default_rng(seed)
    node = rng.integers(0, n, size=links)
    noise = rng.normal(size=(links, dim))
    noise -= np.einsum("kd,kd->k", noise, g.x[node])[:, None] * g.x[node]
    size = np.linalg.norm(noise, axis=1, keepdims=True)
    cosine = min(1.0, least + 1e-3)
    turned = cosine * g.x[node] + np.sqrt(1 - cosine * cosine) * noise / np.where(size > 1e-9, size, 1)
    q = (turned / np.linalg.norm(turned, axis=1, keepdims=True)).astype(np.float32)
    while True:
        ef = min(ef, n)
        a, b, rest = g.within(q, least - 1e-4, ef, max(256, ef))
        found = np.zeros(links, dtype=bool)
        found[rest] = True  # these are compared with every node
        found[a[b == node[a]]] = True
        if found.mean() >= recall or ef == n:
            return ef, float(found.mean())
        ef *= 2


def _build(pdf: pd.DataFrame, kind: str, least: float, ef: int, links: int, recall: float) -> pd.DataFrame:
    pdf = pdf.sort_values("rep", ignore_index=True)
    v = np.array(pdf["embedding"].tolist(), dtype=kind)
    g = Graph(_unit(v).astype(np.float32))
    ef, measured = audit(g, least, ef, links, recall)
    row = {"dim": pdf["dim"].iloc[0], "shard": pdf["shard"].iloc[0], "reps": pdf["rep"].to_numpy(dtype="<i8").tobytes(), "n": pdf["n"].to_numpy(dtype="<i8").tobytes(), "vectors": v.tobytes(), "graph": _pack_graph(g), "ef": ef, "recall": measured}
    return pd.DataFrame([row])


def _search(q: np.ndarray, g: Graph, x: np.ndarray, least: float, ef: int) -> tuple[np.ndarray, np.ndarray]:
    """(query, node) pairs of cosine >= least, searched in single precision with some slack and verified in double.
    Queries whose beams stay full of links are compared with every node, in blocks."""
    a, b, rest = g.within(q.astype(np.float32), least - 1e-4, min(ef, len(x)), max(256, ef))
    ok = np.concatenate([np.einsum("kd,kd->k", q[a[i : i + 65536]], x[b[i : i + 65536]]) for i in range(0, len(a), 65536)] or [np.zeros(0)]) >= least
    a, b = [a[ok]], [b[ok]]
    for i in range(0, len(rest), 256):
        r, c = np.nonzero((q[rest[i : i + 256]] @ x.T) >= least)
        a.append(rest[i + r])
        b.append(c)
    return np.concatenate(a), np.concatenate(b)


def _links(reps_i, n_i, reps_j, n_j, a, b, same: bool) -> pa.RecordBatch:
    """Per representative with a link the copies that it links with and the smallest representative of its group here."""
    if same:  # either end may have found the other
        a, b = np.minimum(a, b), np.maximum(a, b)
        a, b = a[a != b], b[a != b]
    pair = np.unique(a * len(reps_j) + b)
    a, b = pair // len(reps_j), pair % len(reps_j)
    reps = reps_i if same else np.concatenate([reps_i, reps_j])
    at = b if same else b + len(reps_i)
    n = np.bincount(a, n_j[b], minlength=len(reps)) + np.bincount(at, n_i[a], minlength=len(reps))
    root = reps.copy()
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[at])
        np.minimum.at(low, at, root[a])
        if (low == root).all():
            break
        root = low
    some = n > 0
    return pa.RecordBatch.from_arrays([pa.array(reps[some]), pa.array(n[some].astype(np.int64)), pa.array(root[some])], ["rep", "n", "root"])


def _match(batches, kind: str, least: float):
    """Links from rows (dim, shard, fan, query, i, reps, n, vectors, graph, ef), sorted by the first five: a shard's graph,
    then the shards whose vectors search it. One of these is held at a time."""
    ids = lambda x: np.frombuffer(x.as_buffer(), dtype="<i8")
    node = None
    for batch in batches:
        for r in range(batch.num_rows):
            of = {c: batch.column(c)[r] for c in batch.schema.names}
            x = _unit(np.frombuffer(of["vectors"].as_buffer(), dtype=kind).reshape(-1, of["dim"].as_py()))
            if not of["query"].as_py():
                node = ids(of["reps"]).copy(), ids(of["n"]).copy(), x, _unpack_graph(of["graph"].as_py(), x.astype(np.float32)), of["ef"].as_py(), of["shard"].as_py()
                continue
            reps, n, y, g, ef, shard = node
            a, b = _search(x, g, y, least, ef)
            yield _links(ids(of["reps"]), ids(of["n"]), reps, n, a, b, of["i"].as_py() == shard)


def near_duplicates(vectors: DataFrame, least: float = 0.95, shards: int = 8, shard_rows: int = 100_000, shard_bytes: int = 64 << 20, fan: int = 4, ef: int = 24, links: int = 512, recall: float = 0.99, id_col: str = "vec_id", vector_col: str = "embedding", audits: list | None = None) -> DataFrame:
    """One row per vector: id, n_links (other vectors with cosine >= least), component_id, kept.

    Equal vectors form a class first, so copies are neither indexed nor searched twice. Classes are dealt by hash to
    shards, at least `shards`, of at most about shard_rows and shard_bytes. One task builds a shard's graph and audits
    it: the beam widens until `recall` of `links` planted links are found. Then every shard is searched with the vectors
    of itself and of all shards before it: a task gets one graph and, one after the other, `fan` shards of vectors, so
    every pair of shards meets once. Every pair found is verified in double precision, and the task returns only link
    counts and the smallest linked id. The vectors shuffled grow with the square of the shards, as the method asks each
    shard; a vector goes with its own precision and without its links. Vectors of different length are never compared.
    audits, if given, gets one row (dim, shard, ef, recall) per shard.

    Vectors that are null, empty, zero or hold null or non-finite parts have no links and are their own component.
    Very large and very small vectors are compared by direction like others. Repeated rows with equal vectors are copies
    of each other. A null id takes no part in links (component null). An empty table gives no rows; other columns are
    left out.
    """
    e = F.col("embedding")
    single = dict(vectors.dtypes)[vector_col] == "array<float>"
    kind, cast = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(cast).alias("embedding"))
    fine = e.isNotNull() & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(e, lambda x: x != 0) & F.col("id").isNotNull()
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    valid = rows.where("fine")
    classes = staged(valid.groupBy("embedding").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n")).withColumn("dim", F.size("embedding")), "vector-classes")
    most = F.greatest(F.lit(shards), F.ceil(F.col("all") / shard_rows), F.ceil(F.col("all") * F.col("dim") * (4 if single else 8) / shard_bytes))
    by_dim = classes.groupBy("dim").agg(F.count(F.lit(1)).alias("all")).withColumn("shards", most.cast("long"))
    dealt = salted_join(classes, by_dim, ["dim"], "all", ["rep"]).withColumn("shard", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int"))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        return _build(pdf, kind, least, ef, links, recall)

    blocks = dealt.select("embedding", "rep", "n", "dim", "shard").groupBy("dim", "shard").applyInPandas(build, "dim int, shard int, reps binary, n binary, vectors binary, graph binary, ef int, recall double")
    blocks = staged(blocks, "vector-graphs")
    if audits is not None:
        audits += blocks.select("dim", "shard", "ef", "recall").collect()  # one row per shard
    keys = blocks.select("dim", "shard")
    fans = F.explode(F.sequence(F.lit(0), F.floor(F.col("shard") / fan).cast("int"))).alias("fan")
    graphs = blocks.select("dim", "shard", fans, F.lit(False).alias("query"), F.lit(-1).alias("i"), "reps", "n", "vectors", "graph", "ef")
    queries = blocks.select("dim", F.col("shard").alias("i"), "reps", "n", "vectors").join(keys, "dim").where("i <= shard")  # shard numbers, not rows
    queries = queries.select("dim", "shard", F.floor(F.col("i") / fan).cast("int").alias("fan"), F.lit(True).alias("query"), "i", "reps", "n", "vectors", F.lit(None).cast("binary").alias("graph"), F.lit(None).cast("int").alias("ef"))
    tasks = graphs.unionByName(queries).repartition(max(1, graphs.count()), "dim", "shard", "fan").sortWithinPartitions("dim", "shard", "fan", "query", "i")
    found = staged(tasks.mapInArrow(lambda x: _match(x, kind, least), "rep long, n long, root long"), "vector-links", batch_rows=1)
    linked = found.groupBy("rep").agg(F.sum("n").alias("links"))
    comp = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    by_class = classes.join(linked, "rep", "left").join(comp.withColumnRenamed("node", "rep"), "rep", "left")
    by_class = by_class.select("embedding", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = salted_join(valid, by_class, ["embedding"], "n", ["id"]).select("id", "n_links", "component_id").unionByName(rows.where("not fine").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))
