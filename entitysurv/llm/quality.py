"""Quality rules by compression bands: zstandard ratios over whole documents and fixed chunks."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: (least bytes, lowest ratio, highest ratio): compressed size over size of a whole text, by its length.
BANDS = [
    (0, 0.0, 9.9),
    (128, 0.40, 1.05),
    (256, 0.45, 0.92),
    (512, 0.46, 0.85),
    (1024, 0.435, 0.78),
    (2048, 0.43, 0.74),
    (4096, 0.415, 0.72),
    (8192, 0.400, 0.70),
    (16384, 0.390, 0.68),
    (32768, 0.380, 0.66),
    (65536, 0.33, 0.66),
]
#: The same for one chunk of CHUNK bytes; a text falls if more than BAD_CHUNKS of its full chunks are outside.
CHUNK, CHUNK_BAND, BAD_CHUNKS = 1024, (0.36, 0.80), 0.25

SYMBOLS = "#*$%&|<>"
FIELDS = [("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()), ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("ratio", pa.float64()), ("bad_chunks", pa.int64()), ("n_chunks", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_())]

_MIX = np.array([pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in range(1, 9)], dtype=np.uint64)


def repeated_words(words: list[bytes], width: int = 8) -> int:
    """Words inside windows of `width` words that occur at least twice in the text, first occurrences included."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), dtype=np.int64, count=len(words)).view(np.uint64)
    windows = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        windows += h[k : k + n] * _MIX[k]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, dtype=bool)
    hit[order[1:][same]] = True
    hit[order[:-1][same]] = True
    edges = np.zeros(len(words) + 1, dtype=np.int32)
    at = np.flatnonzero(hit)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + width, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def measure(text: str | None, zstd: zstandard.ZstdCompressor, bands, chunk, chunk_band, bad_share, min_words, max_repeat) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "replace")
    words = data.split()
    n = len(words)
    word_chars = len(text) - (len(data) - len(b"".join(words)))
    symbols = sum(map(text.count, SYMBOLS))
    lines = [x for x in data.split(b"\n") if x.strip()]
    repeat = repeated_words(words)
    ratio = len(zstd.compress(data)) / len(data) if data else 0.0
    low, high = next((lo, hi) for least, lo, hi in reversed(bands) if len(data) >= least)
    chunks = [len(zstd.compress(data[i : i + chunk])) / chunk for i in range(0, len(data) - chunk + 1, chunk)]
    bad = sum(not chunk_band[0] <= x <= chunk_band[1] for x in chunks)
    failed = n < min_words or 100 * repeat > max_repeat * n
    kept = not failed and low <= ratio <= high and bad <= bad_share * len(chunks)
    return n, word_chars, symbols, len(lines) - len(set(lines)), repeat, ratio, bad, len(chunks), failed, kept


def _measure_batches(batches, **how):
    zstd = zstandard.ZstdCompressor(level=3, write_content_size=False)
    for batch in batches:
        found = [measure(x.as_py(), zstd, **how) for x in batch.column(1)]
        columns = zip(*found, strict=True) if found else [[]] * len(FIELDS)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, (_, t) in zip(columns, FIELDS, strict=True))], ["id", *(n for n, _ in FIELDS)])


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, bad_share: float = BAD_CHUNKS, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """Measures and verdict of every whole text: id and FIELDS.

    base_failed: fewer than min_words words, or more than max_repeat percent of them in repeated 8-word windows. kept:
    not base_failed, the ratio of compressed to plain bytes lies in the band for the text's length, and at most
    bad_share of its full chunks lie outside chunk_band. One pass over the texts, no shuffle, each text alone in memory.
    Null and empty texts have no words and are not kept; null ids and repeated rows are kept as rows; an empty table
    gives no rows; other columns are left out.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, " + ", ".join(f"{n} {'boolean' if t == pa.bool_() else 'double' if t == pa.float64() else 'long'}" for n, t in FIELDS)
    how = {"bands": bands, "chunk": chunk, "chunk_band": chunk_band, "bad_share": bad_share, "min_words": min_words, "max_repeat": max_repeat}
    return rows.mapInArrow(partial(_measure_batches, **how), schema).withColumnRenamed("id", id_col)


def filter_quality(docs: DataFrame, text_col: str = "text", bands=BANDS, chunk: int = CHUNK, chunk_band=CHUNK_BAND, bad_share: float = BAD_CHUNKS, min_words: int = 20, max_repeat: int = 30) -> DataFrame:
    """The rows of docs that `quality` keeps, with all their columns, in one pass without a join."""
    how = {"bands": bands, "chunk": chunk, "chunk_band": chunk_band, "bad_share": bad_share, "min_words": min_words, "max_repeat": max_repeat}
    at = docs.columns.index(text_col)

    def keep(batches):
        zstd = zstandard.ZstdCompressor(level=3, write_content_size=False)
        for batch in batches:
            yield batch.filter(pa.array([measure(x.as_py(), zstd, **how)[-1] for x in batch.column(at)], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
