"""Token-id files: canonical length-limited Huffman coding of ids from global counts, table-driven decoding.

The file format is two Parquet tables in one folder, so that Spark's committers, splits and any of its stores apply:

codebook  symbol, bits: the code length of every id that occurs. Codes are canonical: in (bits, symbol) order.
blocks    part, block, first, n_ids, doc_ids, lengths, checkpoints, payload: some consecutive documents of one range
          of the order; `first` ids of that part come before it; the bit offset of every STRIDE-th id is in
          checkpoints, so a block is decoded by itself, from any checkpoint, without its neighbours.
"""

from __future__ import annotations

import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import once_per_worker, scratch_path

STRIDE = 256
BLOCK_IDS = 1 << 18


# ---- codes -----------------------------------------------------------------------------------------------------


def code_lengths(counts: dict[int, int], limit: int) -> dict[int, int]:
    """Bits of each symbol by package-merge: the best prefix code in which no code is longer than limit."""
    symbols = sorted(counts, key=lambda s: (counts[s], s))
    if len(symbols) < 2:
        return dict.fromkeys(symbols, 1)
    if len(symbols) > 1 << limit:
        raise ValueError(f"{len(symbols)} symbols do not fit codes of {limit} bits")
    n = len(symbols)
    w = np.array([counts[s] for s in symbols], dtype=np.float64)
    # Level by level: the packages of pairs of the level below, merged with the symbols; only the order is kept.
    levels, weight = [], w
    for _ in range(limit - 1):
        pairs = weight[: len(weight) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([w, pairs])
        order = np.argsort(both, kind="stable")
        levels.append(order)
        weight = both[order]
    bits = np.zeros(n, dtype=np.int64)
    take = 2 * n - 2
    for order in reversed(levels):
        chosen = order[:take]
        leaves = chosen[chosen < n]
        bits[leaves] += 1
        take = 2 * int((chosen >= n).sum())
    bits[:take] += 1
    return {s: int(b) for s, b in zip(symbols, bits, strict=True)}


def canonical(lengths: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """(code, bits) by symbol; codes count up in (bits, symbol) order."""
    size = max(lengths, default=-1) + 1
    codes, bits = np.zeros(size, dtype=np.uint32), np.zeros(size, dtype=np.uint8)
    code = last = 0
    for s in sorted(lengths, key=lambda s: (lengths[s], s)):
        code <<= lengths[s] - last
        last = lengths[s]
        codes[s], bits[s] = code, last
        code += 1
    return codes, bits


def decode_table(lengths: dict[int, int], limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(symbol, bits) by the next `limit` bits of a stream."""
    codes, bits = canonical(lengths)
    symbol, used = np.zeros(1 << limit, dtype=np.uint32), np.ones(1 << limit, dtype=np.uint8)
    for s, b in lengths.items():
        low = int(codes[s]) << (limit - b)
        symbol[low : low + (1 << (limit - b))] = s
        used[low : low + (1 << (limit - b))] = b
    return symbol, used


def encode_ids(ids: np.ndarray, codes: np.ndarray, bits: np.ndarray, stride: int = STRIDE) -> tuple[bytes, np.ndarray]:
    """(payload, bit offset of every stride-th id)."""
    if not len(ids):
        return b"", np.zeros(0, dtype=np.int64)
    n = bits[ids].astype(np.int64)
    at = np.cumsum(n) - n
    total = int(at[-1] + n[-1])
    code = codes[ids].astype(np.uint64)
    if len(ids) % 2:
        code, n = np.append(code, np.uint64(0)), np.append(n, 0)
    # Two codes at a time (at most 32 bits) go into 32-bit lanes; bits never overlap, so adding is or-ing.
    width = n[::2] + n[1::2]
    word = code[::2] << n[1::2].astype(np.uint64) | code[1::2]
    word <<= (64 - width - (at[::2] & 31)).astype(np.uint64)
    lane, lanes = at[::2] >> 5, (total >> 5) + 2
    out = np.bincount(lane, (word >> np.uint64(32)).astype(np.float64), minlength=lanes) + np.bincount(lane + 1, (word & np.uint64(0xFFFFFFFF)).astype(np.float64), minlength=lanes)
    return out.astype(np.uint64).astype(">u4").tobytes()[: (total + 7) // 8], at[::stride].copy()


def decode_ids(payload: bytes, checkpoints: np.ndarray, n_ids: int, symbol: np.ndarray, used: np.ndarray, limit: int, stride: int = STRIDE) -> np.ndarray:
    """All ids of a block: from every checkpoint at once, one table look-up per id."""
    if not n_ids:
        return np.zeros(0, dtype=np.uint32)
    raw = np.frombuffer(payload + bytes(stride * limit // 8 + 8), dtype=np.uint8).astype(np.uint32)
    window = raw[:-3] << 24 | raw[1:-2] << 16 | raw[2:-1] << 8 | raw[3:]
    at = checkpoints.astype(np.int64)
    out = np.empty((stride, len(at)), dtype=np.uint32)
    shift = np.uint32(32 - limit)
    for j in range(min(stride, n_ids)):
        key = (window[at >> 3] << (at & 7).astype(np.uint32)) >> shift
        out[j] = symbol[key]
        at += used[key]
    return out.T.reshape(-1)[:n_ids]


# ---- tokenizer -------------------------------------------------------------------------------------------------


# Fixed value: the pre-tokenizer pattern under which a word of letters alone is one piece.
LETTERS_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


#: Letters for which lower case and composed form are the same in every library, then ASCII signs but the apostrophe.
PLAIN_WORD = re.compile(r"([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-&(-/:-@\[-`{-~]*)")
#: What a byte-level pre-tokenizer writes for each byte: printing Latin-1 characters stand for themselves, the other
#: bytes for the characters from 256 on in turn.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_CHARS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _WordIds(dict):
    """word -> token ids as little-endian 32-bit bytes, through the library.

    Two generations of at most `limit` words are held: a word that is asked for again outlives its generation. What may
    be taken apart is read from the tokenizer's own description, and nothing is where it says otherwise:

    - lower: it lower-cases, so a text may be lower-cased (A-Z) before its words are looked up;
    - letters: its pattern keeps letters together and then signs together, and writes them as bytes, so a PLAIN_WORD is
      its two parts, and the model alone gives the letters.

    Needs a tokenizer whose pieces never span ASCII white space: then a text's ids are its words' ids in turn.
    """

    def __init__(self, spec: str, limit: int):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.limit, self.old = Tokenizer.from_str(spec), limit, {}
        about = json.loads(spec)
        steps = lambda x, inner: x.get(inner, [x]) if x else []
        self.lower = [x["type"] for x in steps(about["normalizer"], "normalizers")] == ["NFC", "Replace", "Lowercase"]
        cut = steps(about["pre_tokenizer"], "pretokenizers")
        self.letters = self.lower and [x["type"] for x in cut] == ["Split", "ByteLevel"] and cut[0]["pattern"].get("Regex") == LETTERS_PATTERN and not cut[1]["add_prefix_space"] and not cut[1]["use_regex"]
        self.added = [x["content"].lower().encode() if self.lower else x["content"].encode() for x in about["added_tokens"]]
        self.model = self.tokenizer.model

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def of_text(self, text: str) -> bytes:
        data = text.encode("utf-8", "replace")
        if self.lower:
            data = data.lower()
        if any(x in data for x in self.added):  # whether it is one depends on its case: the whole text as it stands
            return self.ids(text)
        return b"".join(map(self.__getitem__, data.split()))

    def __missing__(self, word: bytes) -> bytes:
        ids = self.old.get(word)
        if ids is None:
            text = word.decode()
            plain = PLAIN_WORD.fullmatch(text) if self.letters else None
            if plain is None or not plain[1]:
                ids = self.ids(text)
            elif plain[2]:
                ids = self[plain[1].encode()] + self[plain[2].encode()]
            else:
                written = text.lower().encode().decode("latin-1").translate(BYTE_CHARS)
                ids = b"".join(t.id.to_bytes(4, "little") for t in self.model.tokenize(written))
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.old = dict(self)
                self.clear()
            self[word] = ids
        return ids


def _token_blocks(batches, spec: str, end_id: int, cache_words: int, block_ids: int):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    words = once_per_worker(("word ids", zlib.crc32(spec.encode()), cache_words), lambda: _WordIds(spec, cache_words))
    end = np.array([end_id], dtype="<u4").tobytes()
    part, block, first = TaskContext.get().partitionId(), 0, 0
    docs, lengths, ids, held = [], [], [], 0

    def flush():
        nonlocal block, first, docs, lengths, ids, held
        row = pa.RecordBatch.from_pylist([{"part": part, "block": block, "first": first, "n_ids": held, "doc_ids": docs, "lengths": lengths, "ids": b"".join(ids)}], _blocks_schema(kind, "ids", pa.binary()))
        block, first = block + 1, first + held
        docs, lengths, ids, held = [], [], [], 0
        return row

    kind = None
    for batch in batches:
        kind = batch.schema.field(0).type
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = words.of_text(text.as_py() or "") + end
            docs.append(doc)
            lengths.append(len(own) // 4)
            ids.append(own)
            held += len(own) // 4
            if held >= block_ids:
                yield flush()
    if docs:
        yield flush()


def _blocks_schema(kind, last: str, last_type) -> pa.Schema:
    return pa.schema([("part", pa.int32()), ("block", pa.int64()), ("first", pa.int64()), ("n_ids", pa.int64()), ("doc_ids", pa.list_(kind)), ("lengths", pa.list_(pa.int64())), (last, last_type)])


# ---- files -----------------------------------------------------------------------------------------------------


def write_tokens(docs: DataFrame, tokenizer_file: str, path: str, end_id: int = 1, limit: int = 16, cache_words: int = 400_000, block_ids: int = BLOCK_IDS, partitions: int | None = None, range_bytes: int = 128 << 20, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Encode every whole text, append end_id, and write the ids in ascending id order in the format above.

    Range partitions by id, then by a hash of the text, so part after part is in order and rows that share an id (or have
    none) spread over parts too. There are as many parts as the session's shuffle setting, and more where a part would
    hold over range_bytes of text. Ids are counted over all documents, then coded. limit is
    raised if the ids that occur need it. A null text is an empty one: the end id alone. Null ids come first; repeated
    rows follow each other; an empty table gives empty files; other columns are left out.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())  # one vocabulary file
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n = partitions
    if not n:
        octets = rows.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-octets // range_bytes))
    order = [F.col("id").asc_nulls_first(), F.xxhash64("text").asc()]
    kind = rows.schema["id"].dataType.simpleString()

    def tokenize(batches):
        yield from _token_blocks(batches, spec.value, end_id, cache_words, block_ids)

    plain = f"part int, block long, first long, n_ids long, doc_ids array<{kind}>, lengths array<long>"
    raw_path = scratch_path(spark, "token-ids")
    rows.repartitionByRange(n, *order).sortWithinPartitions(*order).mapInArrow(tokenize, plain + ", ids binary").write.parquet(raw_path)
    raw = spark.read.schema(plain + ", ids binary").parquet(raw_path)

    def count(batches):
        total = np.zeros(0, dtype=np.int64)
        for batch in batches:
            for blob in batch.column(0):
                got = np.bincount(np.frombuffer(blob.as_buffer(), dtype="<u4").astype(np.int64))
                if len(got) > len(total):
                    total = np.concatenate([total, np.zeros(len(got) - len(total), dtype=np.int64)])
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["symbol", "n"])

    counted = raw.select("ids").mapInArrow(count, "symbol long, n long").groupBy("symbol").agg(F.sum("n").alias("n")).collect()  # at most one row per vocabulary entry
    counts = {int(r["symbol"]): int(r["n"]) for r in counted}
    limit = max(limit, (max(len(counts), 2) - 1).bit_length())
    lengths = code_lengths(counts, limit)
    book = spark.createDataFrame([(s, b, limit) for s, b in sorted(lengths.items())], "symbol long, bits int, code_limit int")
    book.coalesce(1).write.parquet(f"{path}/codebook")
    shared = spark.sparkContext.broadcast(canonical(lengths))

    def encode(batches):
        codes, bits = shared.value
        for batch in batches:
            payloads, checkpoints = [], []
            for blob in batch.column("ids"):
                payload, at = encode_ids(np.frombuffer(blob.as_buffer(), dtype="<u4"), codes, bits)
                payloads.append(payload)
                checkpoints.append(at)
            keep = batch.drop_columns(["ids"])
            yield pa.RecordBatch.from_arrays([*keep.columns, pa.array(checkpoints, pa.list_(pa.int64())), pa.array(payloads, pa.binary())], [*keep.schema.names, "checkpoints", "payload"])

    raw.mapInArrow(encode, plain + ", checkpoints array<long>, payload binary").write.parquet(f"{path}/blocks")
    return path


def read_tokens(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 and, if asked for, ids, decoded from the files."""
    book = spark.read.parquet(f"{path}/codebook").collect()  # at most one row per vocabulary entry
    lengths, limit = {int(r["symbol"]): int(r["bits"]) for r in book}, int(book[0]["code_limit"]) if book else 16
    shared = spark.sparkContext.broadcast((*decode_table(lengths, limit), limit))
    blocks = spark.read.parquet(f"{path}/blocks")
    parts = blocks.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row per range of the order
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))

    def decode(batches):
        symbol, used, limit = shared.value
        for batch in batches:
            for row in batch.to_pylist():
                ids = decode_ids(row["payload"], np.array(row["checkpoints"], dtype=np.int64), row["n_ids"], symbol, used, limit)
                n = np.array(row["lengths"], dtype=np.int64)
                ends = np.cumsum(n)
                raw = ids.astype("<u4")
                each = [raw[e - k : e] for k, e in zip(n, ends, strict=True)]
                columns = [pa.array([row["part"]] * len(n), pa.int32()), pa.array(row["doc_ids"], batch.schema.field("doc_ids").type.value_type), pa.array(row["first"] + ends - n, pa.int64()), pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in each], pa.int64())]
                names = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.astype(np.int64) for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    kind = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    schema = f"part int, doc_id {kind}, start long, n_tokens long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    decoded = blocks.mapInArrow(decode, schema)
    return decoded.join(F.broadcast(parts), decoded["part"] == parts["_part"]).withColumn("start", F.col("start") + F.col("_before")).drop("part", "_part", "_before")
