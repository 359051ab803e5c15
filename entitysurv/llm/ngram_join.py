"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence, with size-derived bounds."""

from __future__ import annotations

import math
import uuid
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import components, discard, once_per_worker, salted_join, staged

_ASCII_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_MULTIPLIERS = np.array([pow(0x9E3779B97F4A7C15, 2 * k + 1, 1 << 64) for k in range(64)], dtype=np.uint64)


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the word n-grams; with fewer words the whole sequence is one; none without words."""
    words = (text or "").encode("utf-8", "replace").translate(_ASCII_LOWER).split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))
    k = min(width, len(words))
    out = np.full(len(h) - k + 1, k, dtype=np.uint64)
    for i in range(k):
        out += h[i : i + len(out)] * _MULTIPLIERS[i]
    out ^= out >> np.uint64(31)  # spreads the sums, so that their order is as good as random
    out *= np.uint64(0x7FB5D329728EA185)
    out ^= out >> np.uint64(27)
    out *= np.uint64(0x81DADEF4BC2DD44D)
    out ^= out >> np.uint64(33)
    return np.unique(out)


def digest(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


# ---- the incidence matrix ----------------------------------------------------------------------------------------


_BITS, _SLICE = 1 << 28, 1 << 23


def _bitmap(places: DataFrame):
    """A broadcast bitmap of places(at): at most 32 MB whatever their number, as 32 packed slices, with its own name."""

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        bits = np.zeros(_SLICE, dtype=np.uint8)
        bits[pdf["at"].to_numpy() % _SLICE] = 1
        return pd.DataFrame({"slice": [int(pdf["at"].iloc[0]) // _SLICE], "bits": [zlib.compress(np.packbits(bits).tobytes(), 1)]})

    slices = places.distinct().groupBy(F.floor(F.col("at") / _SLICE).alias("slice")).applyInPandas(pack, "slice long, bits binary").collect()
    return places.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, {int(r["slice"]): bytes(r["bits"]) for r in slices}))


def _bits(bitmap: tuple[str, dict[int, bytes]]) -> np.ndarray:
    """The bytes of a bitmap, unpacked once in a worker; only the last one is kept."""
    held = once_per_worker("ngram bitmap", dict)
    if bitmap[0] not in held:
        held.clear()
        out = np.zeros(_BITS // 8, dtype=np.uint8)
        for k, bits in bitmap[1].items():
            out[k * _SLICE // 8 : (k + 1) * _SLICE // 8] = np.frombuffer(zlib.decompress(bits), dtype=np.uint8)
        held[bitmap[0]] = out
    return held[bitmap[0]]


class Order:
    """The global order of n-grams: those not known as frequent first, then the frequent ones by count; ties by hash.

    Any order is exact; this one keeps passages that many documents share out of the prefixes.
    """

    def __init__(self, grams: np.ndarray, counts: np.ndarray):
        at = np.argsort(grams)
        self.grams, self.counts = grams[at], counts[at]

    def first(self, grams: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The first k of a document's (hash-sorted) n-grams in the global order, and their counts, 0 if not known."""
        if not len(self.grams):
            return grams[:k], np.zeros(k, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        count = np.where(self.grams[at] == grams, self.counts[at], 0)
        order = np.argsort(count, kind="stable")[:k]
        return grams[order], count[order]


_SURVEY = ["doc", "n", "key", "at", "gram", "count"]


def _place(key: bytes, doc: int | None) -> int | None:
    """Where a bitmap has the document of a set."""
    return None if doc is None else xxhash.xxh3_64_intdigest(key + doc.to_bytes(8, "little", signed=True)) % _BITS


def _survey(batches, width: int, least: int, chunk: int = 1 << 21):
    """One row (doc, n, key, at) per document, key being a digest of its set; and rows (gram, count) of the n-grams in at
    least `least` different sets of a chunk of the partition."""
    held, size, seen = [], 0, set()

    def counted():
        grams, n = np.unique(np.concatenate(held), return_counts=True)
        some = n >= least
        none = pa.nulls(int(some.sum()))
        return pa.RecordBatch.from_arrays([none.cast(pa.int64()), none.cast(pa.int64()), none.cast(pa.binary()), none.cast(pa.int64()), pa.array(grams[some].view(np.int64)), pa.array(n[some], pa.int64())], _SURVEY)

    for batch in batches:
        sizes, keys, at = [], [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            grams = shingles(text.as_py(), width)
            key = digest(grams)
            sizes.append(len(grams))
            keys.append(key)
            at.append(_place(key, doc))
            if len(grams) and key not in seen:
                seen.add(key)
                held.append(grams)
                size += len(grams)
                if size >= chunk:
                    yield counted()
                    held, size = [], 0
                    seen.clear()
        none = pa.nulls(len(sizes))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(at, pa.int64()), none.cast(pa.int64()), none.cast(pa.int64())], _SURVEY)
    if held:
        yield counted()


def _prefix(n: int, percent: int) -> int:
    """Two sets can only link if they share an n-gram among so many first ones of each."""
    return n - (percent * n + 99) // 100 + 1


def _incidence(batches, order: Order, bitmap, width: int, percent: int, cell: int, remember: int = 1_000_000):
    """(gram, part, doc, n, pos): the prefix of every document's row of the matrix, once for equal sets: where the bitmap
    has no place for a set with this document, another one stands for it. part is 0 but for n-grams known to be in over `cell` sets, which are dealt to parts 1.. of that size."""
    seen, bits = set(), _bits(bitmap)
    for batch in batches:
        docs, sizes, counts, grams_, parts, at = [], [], [], [], [], []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            grams = shingles(text.as_py(), width)
            n = len(grams)
            key = digest(grams)
            place = _place(key, d)
            if not n or key in seen or not bits[place >> 3] >> (7 - (place & 7)) & 1:
                continue
            if len(seen) >= remember:
                seen.clear()
            seen.add(key)
            p = _prefix(n, percent)
            own, known = order.first(grams, p)
            docs.append(d), sizes.append(n), counts.append(p), grams_.append(own), at.append(np.arange(p, dtype=np.int32))
            parts.append(np.where(known > cell, 1 + int.from_bytes(key[:4]) % (1 + known // cell), 0).astype(np.int32))
        if docs:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(grams_).view(np.int64)), pa.array(np.concatenate(parts)), pa.array(np.repeat(np.array(docs, dtype=np.int64), counts)), pa.array(np.repeat(np.array(sizes, dtype=np.int32), counts)), pa.array(np.concatenate(at))],
                ["gram", "part", "doc", "n", "pos"],
            )


# ---- bounds ------------------------------------------------------------------------------------------------------


def _need(n1: Column, n2: Column, percent: int) -> Column:
    """The overlap that two sizes ask for."""
    return F.ceil(F.lit(percent) * (n1 + n2) / F.lit(100.0 + percent) - F.lit(1e-9))


def _sizes_may(n: Column, low: Column, high: Column, percent: int) -> Column:
    """May a set of size n link with one of a size from low to high? The smaller has at least percent of the larger."""
    return (100 * high >= percent * n) & (100 * n >= percent * low)


def _may_start(n: Column, pos: Column, low: Column, room: Column, percent: int) -> Column:
    """May the first n-gram that two linked sets share be at pos of one and have at most `room` n-grams left in the other?
    What follows it in either row must be enough for the overlap."""
    least = F.greatest(low, F.ceil(F.lit(percent) * n / 100.0 - 1e-9))
    return F.least(n - pos, room) >= _need(n, least, percent)


def _size_class(percent: int) -> Column:
    """Sizes that may link are in one class or in classes side by side."""
    return F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent))


def _enough(count: Column, n: Column, low: Column, high: Column, percent: int) -> Column:
    """Is the count accumulated over the prefixes enough for a link with some size from low to high? The overlap is at
    most count plus the longer of the two parts behind the prefixes; the bound is loosest at an end of the range."""
    behind = lambda x: F.ceil(F.lit(percent) * x / 100.0 - 1e-9) - 1
    at = lambda x: count + F.greatest(behind(n), behind(x)) + 2 >= _need(n, x, percent)
    return at(F.greatest(low, F.ceil(F.lit(percent) * n / 100.0 - 1e-9))) | at(F.least(high, F.floor(100.0 * n / percent + 1e-9)))


# ---- the product -------------------------------------------------------------------------------------------------


class _Block:
    """The postings of some documents: n-gram -> documents, as two sorted arrays."""

    def __init__(self, docs: list[int], sets: list[np.ndarray]):
        self.docs, self.sizes = np.array(docs, dtype=np.int64), np.array([len(x) for x in sets])
        grams, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), self.sizes)
        order = np.argsort(grams, kind="stable")
        self.grams, self.owner = grams[order], owner[order]

    def row(self, doc: int, grams: np.ndarray, percent: int) -> np.ndarray:
        """The places of the documents of the block that link with the given one: a row of the product, counted over the
        postings."""
        low, high = np.searchsorted(self.grams, grams, "left"), np.searchsorted(self.grams, grams, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        both = np.bincount(self.owner[at], minlength=len(self.sizes))
        return np.flatnonzero((100 * both >= percent * (len(grams) + self.sizes - both)) & (both > 0) & (self.docs != doc))


def _product(batches, percent: int):
    """Links (a, b) of components, from rows (block, salt, query, doc, comp, grams) sorted by the first three: members of
    a block come before the documents that visit it, so one block and one row are held at a time. Links that say nothing
    new about what is connected in the block are not repeated, so there are fewer than members and visitors."""
    key, docs, comps, sets, block, parent = None, [], [], [], None, {}

    def find(x: int) -> int:
        while (p := parent.setdefault(x, x)) != x:
            parent[x] = x = parent.setdefault(p, p)
        return x

    for batch in batches:
        links = []
        for i, (k, s, query, doc, comp) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(5)), strict=True)):
            grams = np.frombuffer(batch.column(5)[i].as_buffer(), dtype=np.uint64)
            if (k, s) != key:
                key, docs, comps, sets, block, parent = (k, s), [], [], [], None, {}
            if not query:
                docs.append(doc)
                comps.append(comp)
                sets.append(grams.copy())
            elif docs:
                block = block or _Block(docs, sets)
                for j in block.row(doc, grams, percent):
                    x, y = find(comp), find(comps[j])
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        links.append((comp, comps[j]))
        if links:
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([x for _, x in links], pa.int64())], ["a", "b"])


def _sets(batches, bitmap, width: int, remember: int = 1_000_000):
    """(doc, n, grams) of the documents whose hashed id is in the bitmap; equal rows once within a partition."""
    bits = _bits(bitmap)
    seen: set[tuple[int, bytes]] = set()
    for batch in batches:
        at = batch.column(2).to_numpy()
        some = np.flatnonzero(bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1)
        docs, sizes, grams_ = [], [], []
        for d, text in zip(batch.column(0).take(pa.array(some)).to_pylist(), batch.column(1).take(pa.array(some)), strict=True):
            grams = shingles(text.as_py(), width)
            key = (d, digest(grams))
            if not len(grams) or key in seen:
                continue
            if len(seen) >= remember:
                seen.clear()
            seen.add(key)
            docs.append(d), sizes.append(len(grams)), grams_.append(grams.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.array(sizes, pa.int32()), pa.array(grams_, pa.binary())], ["doc", "n", "grams"])


class _Join:
    def __init__(self, docs: DataFrame, width: int, percent: int, block_docs: int, block_grams: int, scratch: list[str]):
        self.docs, self.width, self.percent, self.scratch = docs, width, percent, scratch
        self.block_docs, self.block_grams = block_docs, block_grams

    def staged(self, df: DataFrame, name: str) -> DataFrame:
        return staged(df, name, scratch=self.scratch)

    def join(self, left: DataFrame, right: DataFrame, on: list[str], rows: str, by: list[str]) -> DataFrame:
        return salted_join(left, right, on, rows, by, scratch=self.scratch)

    def sets(self, needed: DataFrame) -> DataFrame:
        """(doc, n, grams) of the documents in needed(doc, n) and of few others. Hashing a text again costs less than
        keeping eight bytes a word of every text; the bitmap keeps the texts that are not needed out of the shuffle."""
        at = F.pmod(F.xxhash64("doc"), F.lit(_BITS)).alias("at")
        width, bitmap = self.width, _bitmap(needed.select(at))
        return self.docs.select("doc", "text", at).mapInArrow(lambda b: _sets(b, bitmap.value, width), "doc long, n int, grams binary")

    def links(self, visits: DataFrame, members: DataFrame) -> DataFrame:
        """Links between documents and the blocks that they visit, both (block, doc, n, comp), as pairs of components.

        Both bring their whole rows of the incidence matrix to the block, which counts overlaps over its postings. A
        block with many visitors is cut by salts: its members, few, go to each.
        """
        percent = self.percent
        load = visits.groupBy("block").agg(F.sum("n").alias("load"), F.count(F.lit(1)).alias("visitors"))
        salts = F.ceil(F.greatest(F.col("load") / (16 * self.block_grams), F.col("visitors") / (4 * self.block_docs)))
        load = self.staged(load.select("block", "visitors", salts.cast("int").alias("salts")), "ngram-load")
        salted = self.join(visits, load, ["block"], "visitors", ["doc"])
        q = salted.select("block", F.pmod(F.xxhash64("doc"), F.col("salts")).cast("int").alias("salt"), F.lit(True).alias("query"), "doc", F.col("n").cast("int").alias("n"), "comp")
        m = members.join(load, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(False).alias("query"), "doc", F.col("n").cast("int").alias("n"), "comp")
        rows = self.staged(q.unionByName(m), "ngram-visits")
        sets = self.sets(rows.select("doc").distinct())
        dealt = rows.join(sets, ["doc", "n"]).select("block", "salt", "query", "doc", "comp", "grams").repartition("block", "salt").sortWithinPartitions("block", "salt", "query")
        return staged(dealt.mapInArrow(lambda x: _product(x, percent), "a long, b long"), "ngram-links", 128, self.scratch)

    def pivot_links(self, entries: DataFrame, reps: DataFrame) -> DataFrame:
        """The columns of the product that belong to pivots, entries(doc, n, pos, heads): a document visits the heads of
        its n-grams, each of which is a block. So a group of copies has few blocks, which all of it visits."""
        met = entries.select("doc", "n", "pos", F.explode("heads").alias("p")).where("doc <> p.doc").where(_sizes_may(F.col("n"), F.col("p.n"), F.col("p.n"), self.percent))
        start = _may_start(F.col("n"), F.col("pos"), F.col("p.n"), F.col("p.n") - F.col("p.pos"), self.percent)
        visits = met.groupBy("doc", "n", F.col("p.doc").alias("head"), F.col("p.n").alias("size")).agg(F.count(F.lit(1)).alias("count"), F.bool_or(start).alias("start"))
        visits = visits.where("start").where(_enough(F.col("count"), F.col("n"), F.col("size"), F.col("size"), self.percent))
        of = lambda doc, n, rep: reps.select(F.col("doc").alias(doc), F.col("n").alias(n), F.col("rep").alias(rep))
        visits = self.staged(visits.join(of("doc", "n", "comp"), ["doc", "n"]).join(of("head", "size", "block"), ["head", "size"]).where("comp <> block"), "ngram-pivots")
        members = visits.select("block", F.col("head").alias("doc"), F.col("size").alias("n"), F.col("block").alias("comp")).distinct()
        return self.links(visits.select("block", "doc", "n", "comp").distinct(), members)

    def block_links(self, entries: DataFrame) -> DataFrame:
        """The rest of the product, entries(gram, doc, n, pos, comp): every pair in different components.

        In each n-gram with several components every document outside the largest one is a query; the documents are cut
        into blocks of similar size along the component that they meet. First the product of documents by blocks: the
        n-grams that a query shares with a block within the bounds are counted, which is no less than it shares with
        any document there; visits that cannot reach the overlap asked for are discarded. The others count exactly.
        """
        percent = self.percent
        parts = entries.groupBy("gram", "comp").agg(F.count(F.lit(1)).alias("w"))
        major = parts.groupBy("gram").agg(F.max(F.struct("w", "comp")).alias("m"), F.sum("w").alias("k"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        e = self.staged(self.join(entries, major.select("gram", "m", "k"), ["gram"], "k", ["doc"]), "ngram-rest")
        home = e.groupBy("doc", "n").agg(F.max("m").alias("m"), F.first("comp").alias("comp"))
        size_class = _size_class(percent)
        home = self.staged(home.select("doc", "n", "comp", F.xxhash64("m.comp", size_class).alias("place")), "ngram-home")
        load = home.groupBy("place").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("grams"))
        load = load.withColumn("cells", F.ceil(F.greatest(F.col("docs") / self.block_docs, F.col("grams") / self.block_grams)).cast("int"))
        home = self.join(home, load, ["place"], "docs", ["doc"])
        home = self.staged(home.select("doc", "n", "comp", F.xxhash64("place", F.pmod(F.xxhash64("doc"), F.col("cells"))).alias("block")), "ngram-blocks")
        blocks = e.drop("comp").join(home, ["doc", "n"]).groupBy("gram", "block").agg(F.min("n").alias("low"), F.max("n").alias("high"), F.max(F.col("n") - F.col("pos")).alias("room"), F.first("k").alias("k"))
        salts = 1 + F.floor(F.col("k") / 4096)
        q = e.where("comp <> m.comp").select("gram", F.pmod(F.xxhash64("doc"), salts).alias("salt"), "doc", "n", "pos", "comp")
        b = blocks.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), salts - 1))).drop("k")
        meets = q.join(b, ["gram", "salt"]).where(_sizes_may(F.col("n"), F.col("low"), F.col("high"), percent))
        start = _may_start(F.col("n"), F.col("pos"), F.col("low"), F.col("room"), percent)
        visits = meets.groupBy("doc", "n", "comp", "block").agg(F.count(F.lit(1)).alias("count"), F.bool_or(start).alias("start"), F.min("low").alias("low"), F.max("high").alias("high"))
        visits = visits.where("start").where(_enough(F.col("count"), F.col("n"), F.col("low"), F.col("high"), percent)).select("block", "doc", "n", "comp")
        return self.links(self.staged(visits, "ngram-meets"), home)


def frequent_grams(counts: DataFrame, least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-grams of counts(gram, count) with `least` or more, but only counts that at most `most` n-grams reach."""
    totals = counts.groupBy("gram").agg(F.sum("count").alias("count")).where(F.col("count") >= least)
    steps = totals.groupBy(F.floor(F.log2(F.col("count").cast("double")) * 8).cast("int").alias("step")).agg(F.count(F.lit(1)).alias("n"), F.min("count").alias("from")).orderBy(F.desc("step")).collect()  # at most 8 * 64 rows
    bound, total = None, 0
    for r in steps:
        total += r["n"]
        if total > most:
            break
        bound = r["from"]
    if bound is None:
        return np.zeros(0, dtype=np.uint64), np.zeros(0, dtype=np.int64)
    top = totals.where(F.col("count") >= bound).toPandas()  # at most `most` rows of two numbers
    return top["gram"].to_numpy(dtype=np.int64).view(np.uint64), top["count"].to_numpy(dtype=np.int64)


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 80, pivots: bool = True, frequent: int = 8, known_frequent: int = 1_000_000, block_docs: int = 64, block_grams: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate components by the Jaccard similarity of word n-grams: id, n_shingles, component_id.

    Documents link when 100 * overlap >= percent * union of their sets of distinct n-grams of A-Z-lower-cased words.
    All links but those of equal sets are entries of the product of the incidence matrix with its transpose:

    1. One pass gives each set's size and digest, and the n-grams known to be frequent (at most known_frequent, for
       the order only). Equal sets are one class, one row of the matrix, by their 128-bit digest.
    2. The matrix is cut to prefixes: two sets can only link if they share an n-gram among the first
       n - ceil(percent * n / 100) + 1 in the global order. Entries without another document of a size that may link go.
    3. The product is computed in blocks of its columns. A document visits a block if the n-grams that they share within
       the bounds, counted by a join and an aggregate, can reach the overlap that the sizes ask for. In the block whole
       rows are counted over the block's postings, and pairs under percent are discarded there: no pair that does not
       link leaves a task. First, with `pivots`, the blocks are the first document of each n-gram and size class
       by hash, and the one before in that order, so that a group of copies costs its size, not its square; pairs inside one component need no more counting. Then the blocks hold all
       documents, so no pair across components is missed and none is capped.

    N-grams are compared by 64-bit hashes. Documents without words have no n-grams, link with nothing and are their own
    component. A null id gives its n_shingles and a null component; repeated rows each give a row; rows with one id
    count as one document with the links of each. An empty table gives no rows; other columns are left out.
    """
    scratch: list[str] = []
    known = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    surveyed = staged(known.mapInArrow(lambda b: _survey(b, width, 2), "doc long, n long, key binary, at long, gram long, count long"), "ngram-survey")
    j = _Join(known.where("doc is not null"), width, percent, block_docs, block_grams, scratch)
    order = docs.sparkSession.sparkContext.broadcast(frequent_grams(surveyed.where("gram is not null").select("gram", "count"), frequent, known_frequent))
    info = surveyed.where("gram is null").select("doc", "n", "key")
    filled = info.where("doc is not null and n > 0")
    first = F.min(F.struct("doc", "at")).alias("first")
    classes = staged(surveyed.where("doc is not null and n > 0").groupBy("key").agg(first, F.count(F.lit(1)).alias("copies")).select("key", F.col("first.doc").alias("rep"), F.col("first.at").alias("at"), "copies"), "ngram-classes")
    bitmap = _bitmap(classes.select("at"))
    classes = classes.drop("at")

    def incidence(batches):
        yield from _incidence(batches, Order(*order.value), bitmap.value, width, percent, 4096)

    by_size = Window.partitionBy("gram", "part").orderBy("n", "doc")
    beside = lambda c: F.coalesce(_sizes_may(F.col("n"), c, c, percent), F.lit(False))
    entries = j.docs.mapInArrow(incidence, "gram long, part int, doc long, n int, pos int")
    live = entries.select("*", F.lag("n").over(by_size).alias("before"), F.lead("n").over(by_size).alias("after")).where((F.col("part") > 0) | beside(F.col("before")) | beside(F.col("after")))
    dealt = Window.partitionBy("gram", "part", _size_class(percent)).orderBy(F.xxhash64("doc"), "doc", "pos")
    head = F.struct("doc", "n", "pos")
    heads = F.array_distinct(F.array_compact(F.array(F.first(head).over(dealt), F.lag(head).over(dealt))))
    live = j.staged(live.select("gram", "doc", "n", "pos", heads.alias("heads")), "ngram-live")
    reps = j.staged(salted_join(filled, classes, ["key"], "copies", ["doc"], scratch=scratch).select("doc", "n", "rep").distinct(), "ngram-reps")
    several = filled.groupBy("doc").agg(F.min("key").alias("lo"), F.max("key").alias("hi")).where("lo <> hi").select("doc")
    several = filled.join(several, "doc", "left_semi").select("doc", "key").distinct().join(classes, "key")
    links = j.staged(several.select(F.col("rep").alias("a"), F.col("doc").alias("b")), "ngram-ids")
    links = links.unionByName(j.pivot_links(live.drop("gram"), reps)) if pivots else links
    near = components(links).select(F.col("node").alias("rep"), "component")
    near = classes.groupBy("rep").agg(F.sum("copies").alias("copies")).join(near, "rep", "left").select("rep", "copies", F.coalesce("component", "rep").alias("comp"))
    near = j.join(reps, near, ["rep"], "copies", ["doc"]).select("doc", "n", "comp")
    comp = components(links.unionByName(j.block_links(live.drop("heads").join(near, ["doc", "n"])))).select(F.col("node").alias("rep"), F.col("component").alias("comp"))
    by_key = classes.join(comp, "rep", "left").select("key", "copies", F.coalesce("comp", "rep").alias("comp")).where("copies > 1 or comp <> rep")
    found = salted_join(filled, by_key, ["key"], "copies", ["doc"], how="left", scratch=[])
    out = found.select("doc", "n", F.coalesce("comp", "doc").alias("comp")).unionByName(info.where("doc is null or n = 0").select("doc", "n", F.col("doc").alias("comp")))
    discard(docs.sparkSession, scratch)
    return out.select(F.col("doc").alias(id_col), F.col("n").alias("n_shingles"), F.col("comp").alias("component_id"))
