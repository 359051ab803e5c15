"""Trie of conversations by their turns: sorted shards finish what they hold whole, the skeleton between them is reduced."""

from __future__ import annotations

import bisect
import hashlib

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

TURN = 16  #: bytes of a turn's digest in a path
FIRST = -(1 << 63) - 1  #: before every conv_id
_NODE = "sid int, parent_sid int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, bytes long, ends_sha256 string, first long, ends string"
_TOP = "sid int, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_ENDS = "sid int, ends_sha256 string"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}


def _batch(rows: list[tuple], columns: str) -> pa.RecordBatch:
    fields = [x.split() for x in columns.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _ARROW[kind]) for i, (_, kind) in enumerate(fields)], [name for name, _ in fields])


def own_paths(conversations: DataFrame) -> DataFrame:
    """(conv_id, own): the turns of every conversation in order, each as (turn, role, digest of role and text, bytes of
    the text). One shuffle by base = conv_id - conv_id % 5, which carries digests and no texts."""
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    conv = F.col("conv_id").cast("long")
    turns = conversations.where("conv_id is not null").select((conv - conv % 5).alias("base"), conv.alias("conv_id"), F.struct(F.col("turn"), role.alias("role"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes")).alias("t"))
    return turns.repartition("base").groupBy("base", "conv_id").agg(F.sort_array(F.collect_list("t")).alias("own"))


def rebuilt(conversations: DataFrame, mod: int = 9) -> DataFrame:
    """(conv_id, path, sizes): the first h turns of the base conversation, then the own turns after the first h, where h is
    crc32(conv_id) % mod; path is the digests end to end, sizes the bytes of each text.

    The base's head comes from a window over the same partitioning: at most nine conversations share a base.
    """
    paths = own_paths(conversations)
    base = Window.partitionBy("base").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.first(F.when(F.col("conv_id") == F.col("base"), F.slice("own", 1, mod - 1)), ignorenulls=True).over(base)
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % mod).cast("int")
    t = paths.withColumn("head", head).withColumn("h", h)
    turns = F.concat(F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("own", 1, 0)), F.slice("own", F.col("h") + 1, F.size("own")))
    t = t.select("conv_id", turns.alias("turns"))
    return t.select("conv_id", F.unhex(F.array_join(F.transform("turns", lambda x: F.hex(x["digest"])), "")).alias("path"), F.transform("turns", lambda x: x["bytes"]).alias("sizes"))


def splitters(paths: DataFrame, shards: int, rows: int, sample: int = 20, longest: int = 1024, most_nodes: int = 200_000) -> list[tuple[bytes, int]]:
    """At most shards - 1 bounds (path, conv_id) in order, from about `sample` hashed rows per shard.

    A bound is the shortest prefix that still lies between its two neighbours in the sample, so the trie of all bounds is
    small; between copies of one path it is the whole path with a conv_id, so a hot conversation is cut too. Only the
    bounds come to the driver, each of at most `longest` turns; while their trie has over most_nodes nodes every other
    bound goes, which makes larger shards and no other difference. (Copies that share over `longest` turns stay together.)
    """
    share = sample * shards / max(1, rows)
    some = paths.where(F.shiftrightunsigned(F.xxhash64("conv_id"), 33) < int(min(1.0, share) * (1 << 31))).select(F.substring("path", 1, longest * TURN).alias("path"), "conv_id")
    order = Window.orderBy("path", "conv_id")  # over the sample alone: some twenty rows a shard
    placed = some.select("path", "conv_id", F.lag("path").over(order).alias("before"), F.row_number().over(order).alias("at"))
    step = max(1, round(sample * min(1.0, 1 / share)) if share > 1 else sample)
    found = []
    for r in placed.where(f"at > 1 and at % {step} = 0").select("path", "before", "conv_id").collect():
        path, before = bytes(r.path), bytes(r.before)
        if path == before:
            found.append((path, r.conv_id))
        else:
            same = next((i for i, (a, b) in enumerate(zip(path, before, strict=False)) if a != b), min(len(path), len(before)))
            found.append((path[: (same // TURN + 1) * TURN], FIRST))
    found = sorted(set(found))
    if len(found) >= shards:
        found = [found[i * len(found) // shards] for i in range(1, shards)]
    while len(skeleton(found)) > most_nodes:
        found = found[1::2]
    return found


def skeleton(bounds: list[tuple[bytes, int]]) -> dict[tuple[int, bytes], int]:
    """The trie of the bounds' paths: (parent, digest) -> node; the root is node 0 and parents come before children."""
    kids: dict[tuple[int, bytes], int] = {}
    for path, _ in bounds:
        at = 0
        for i in range(0, len(path), TURN):
            at = kids.setdefault((at, path[i : i + TURN]), len(kids) + 1)
    return kids


class _Open:
    """A node with rows still to come."""

    __slots__ = ("below", "bytes", "chunk", "first", "hash", "kids", "leaves", "low", "n", "saved", "sid")

    def __init__(self, sid: int, size: int):
        self.sid, self.bytes = sid, size
        self.low, self.n, self.kids, self.leaves, self.saved = None, 0, 0, 0, 0
        self.hash, self.chunk, self.first, self.below = None, [], None, []


def finish(batches, kids: dict[tuple[int, bytes], int], chunk_ids: int = 50_000):
    """Rows in order of (shard, path, conv_id) -> finished nodes (sid null) and, of each shard, partial sums and ids of the
    skeleton's nodes. Open are only the nodes on one path, and of these the children that wait for the parent's smallest
    member; ids that end in a node go into its hash at once, in a node of the skeleton into chunks of bounded size."""
    stack: list[_Open] = []
    out: list[tuple] = []

    def flush_ids(x: _Open) -> None:
        if x.chunk:
            out.append((x.sid, None, *[None] * 9, x.first, ",".join(x.chunk)))
            x.chunk, x.first = [], None

    def close() -> None:
        x, depth = stack.pop(), len(stack)
        up = stack[-1] if stack else None
        for child in x.below:
            out.append((None, None, *child[:2], x.low, *child[2:], None, None))
        if x.sid >= 0:
            flush_ids(x)
            out.append((x.sid, None, x.low, depth, None, x.n, x.kids, x.leaves, x.saved, x.bytes, None, None, None))
        else:
            leaves, saved = x.leaves if x.kids else 1, x.saved + (x.n - 1) * x.bytes
            node = (x.low, depth, x.n, x.kids, leaves, saved, x.bytes, (x.hash or hashlib.sha256()).hexdigest())
            if up.sid >= 0:
                out.append((None, up.sid, *node[:2], None, *node[2:], None, None))
            else:
                up.below.append(node)
            up.kids, up.leaves, up.saved = up.kids + 1, up.leaves + leaves, up.saved + saved
        if up:
            up.n += x.n
            up.low = x.low if up.low is None or x.low < up.low else up.low

    shard, before = None, b""
    for batch in batches:
        for s, path, conv, sizes in zip(*(batch.column(c).to_pylist() for c in ("shard", "path", "conv_id", "sizes")), strict=True):
            if s != shard:
                while stack:
                    close()
                shard, before = s, b""
                stack.append(_Open(0, 0))
            same = 0
            if path == before:
                same = len(path) // TURN
            else:
                for i in range(0, min(len(path), len(before)), TURN):
                    if path[i : i + TURN] != before[i : i + TURN]:
                        break
                    same += 1
            while len(stack) > same + 1:
                close()
            for i in range(same, len(path) // TURN):
                sid = stack[-1].sid
                stack.append(_Open(kids.get((sid, path[i * TURN : i * TURN + TURN]), -1) if sid >= 0 else -1, sizes[i]))
            top, before = stack[-1], path
            top.n += 1
            top.low = conv if top.low is None or conv < top.low else top.low
            if top.sid < 0:
                if top.hash is None:
                    top.hash = hashlib.sha256(str(conv).encode())
                else:
                    top.hash.update(b",%d" % conv)
            else:
                top.first = conv if top.first is None else top.first
                top.chunk.append(str(conv))
                if len(top.chunk) >= chunk_ids:
                    flush_ids(top)
            if len(out) >= 10_000:
                yield _batch(out, _NODE)
                out.clear()
    while stack:
        close()
    yield _batch(out, _NODE)


def hash_ends(batches):
    """(sid, first, ends) in order -> (sid, ends_sha256); a node's ids pass by in chunks and are never held together."""
    at, h = None, None
    for batch in batches:
        done = []
        for sid, ends in zip(batch.column("sid").to_pylist(), batch.column("ends").to_pylist(), strict=True):
            if sid != at:
                if at is not None:
                    done.append((at, h.hexdigest()))
                at, h = sid, hashlib.sha256(ends.encode())
            else:
                h.update(b"," + ends.encode())
        yield _batch(done, _ENDS)
    if at is not None:
        yield _batch([(at, h.hexdigest())], _ENDS)


def fold(batches, parents: list[int]):
    """The skeleton's nodes with their sums over all shards -> finished nodes. Children have larger ids than parents."""
    rows = {r["sid"]: r | {"parent_conv_id": None} for batch in batches for r in batch.to_pylist()}
    for sid in sorted(rows, reverse=True):
        r = rows[sid]
        r["n_leaves"] = r["n_leaves"] if r["n_children"] else 1
        r["saved_tokens"] += (r["n_convs"] - 1) * r["bytes"]
        r["ends_sha256"] = r["ends_sha256"] or hashlib.sha256().hexdigest()
        if sid:
            up = rows[parents[sid]]
            r["parent_conv_id"] = up["conv_id"]
            up["n_children"] += 1
            up["n_leaves"] += r["n_leaves"]
            up["saved_tokens"] += r["saved_tokens"]
    yield _batch([tuple(r[x.split()[0]] for x in _TOP.split(", ")) for r in rows.values()], _TOP)


def prefix_trie(conversations: DataFrame, shard_turns: int = 1_000_000, least_shards: int | None = None, most_shards: int = 16_384) -> DataFrame:
    """Every node of the trie of rebuilt conversations(conv_id, turn, role, text): see `rebuilt` for the rebuilding.

    Returns conv_id (smallest member), depth, parent_conv_id (the parent's; null for the root), n_convs (members),
    n_children, n_leaves (childless nodes of the subtree, the node included), saved_tokens (over the subtree, members but
    one times UTF-8 bytes of the node's last text), ends_sha256 (of the members that end in the node).

    Rows are range-partitioned by (path, conv_id). A node that lies in several shards is a prefix of a bound between two
    of them, so the broadcast trie of the bounds tells a shard which of its nodes are its own: it finishes these, and gives
    partial sums for the rest, which are added by node and folded up the skeleton in one small task. The hash of a node's
    ids is a chain by definition: in the skeleton the ids, joined in chunks, pass one task in order, and are not held.

    Turns are ordered by turn (null first), then role, then digest of the text, so ties and repeated rows have one order; a
    repeated row is a turn of its own. Null role or text is empty, null conv_id takes no part, an empty table gives no
    nodes. Turns are told apart by 128 bits of role and text. Other columns are left out. A conversation's path is one
    row, 24 bytes a turn.
    """
    spark = conversations.sparkSession
    paths = staged(rebuilt(conversations), "paths")
    total = paths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.size("sizes")), F.lit(0)).alias("turns")).first()
    least = least_shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = max(1, min(most_shards, total.n, max(least, -(-total.turns // shard_turns))))
    bounds = splitters(paths, shards, total.n) if shards > 1 else []
    kids = skeleton(bounds)
    parents = [0] * (len(kids) + 1)
    for (up, _), sid in kids.items():
        parents[sid] = up
    trie = spark.sparkContext.broadcast((bounds, kids))  # at most most_shards bounds and most_nodes nodes, see splitters

    @F.pandas_udf("int")
    def shard_of(path: pd.Series, conv: pd.Series) -> pd.Series:
        own = trie.value[0]
        return pd.Series([bisect.bisect_right(own, (bytes(p), c)) for p, c in zip(path, conv.tolist(), strict=True)], dtype="int32")

    def shard_nodes(batches):
        return finish(batches, trie.value[1])

    dealt = paths.withColumn("shard", shard_of("path", "conv_id")).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", "path", "conv_id")
    nodes = staged(dealt.mapInArrow(shard_nodes, _NODE), "trie-nodes")
    ends = nodes.where("ends is not null").select("sid", "first", "ends").repartition("sid").sortWithinPartitions("sid", "first").mapInArrow(hash_ends, _ENDS)
    sums = nodes.where("sid is not null and ends is null").groupBy("sid").agg(F.min("conv_id").alias("conv_id"), F.first("depth").alias("depth"), *(F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")), F.max("bytes").alias("bytes"))

    def folded(batches):
        return fold(batches, parents)

    frame = staged(sums.join(ends, "sid", "left").coalesce(1).mapInArrow(folded, _TOP), "skeleton")  # at most most_nodes rows
    out = [c for c in (x.split()[0] for x in _TOP.split(", ")) if c != "sid"]
    above = F.broadcast(frame.select(F.col("sid").alias("parent_sid"), F.col("conv_id").alias("_up")))
    own = nodes.where("sid is null").join(above, "parent_sid", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up"))
    return own.select(*out).unionByName(frame.select(*out))
