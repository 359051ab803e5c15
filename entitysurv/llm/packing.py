"""Best-fit packing of documents into sequences, with conflicts between sources and between duplicates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, staged


def best_fit(sizes: list[int], masks: list[int], capacity: int) -> list[tuple[int, int]]:
    """(bin, offset) of every item, largest item first (ties: as given).

    Bins are ordered by residual: a list of bins per residual value and a bitmap of the values in use. An item looks at
    the smallest residual that holds it and goes on to the successor until it meets a bin whose bitmap shares no bit
    with its own mask: the tightest compatible bin. Without one it opens a bin. Full bins leave the order.
    """
    at: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, bitmap, left = 0, [], []
    out: list[tuple[int, int]] = [(0, 0)] * len(sizes)
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        size, mask, found = sizes[i], masks[i], -1
        rest = used >> size
        r = size
        while rest:
            step = (rest & -rest).bit_length() - 1
            r += step
            found = next((b for b in at[r] if not bitmap[b] & mask), -1)
            if found >= 0:
                break
            rest >>= step + 1
            r += 1
        if found < 0:
            found = len(left)
            left.append(capacity)
            bitmap.append(0)
        else:
            at[r].remove(found)
            if not at[r]:
                used &= ~(1 << r)
        out[i] = (found, capacity - left[found])
        bitmap[found] |= mask
        left[found] -= size
        if left[found]:
            at[left[found]].append(found)
            used |= 1 << left[found]
    return out


def _pack(pdf: pd.DataFrame, capacity: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["id", "piece", "cluster"], ignore_index=True, na_position="last")
    repeated = pdf["cluster"][pdf["cluster"].duplicated(keep=False)]
    slots = {x: i for i, x in enumerate(sorted(set(pdf["slot"])))}
    bits = {x: len(slots) + i for i, x in enumerate(sorted(set(repeated)))}  # a cluster alone in the bucket needs no bit
    masks = [1 << slots[s] | (1 << bits[c] if c in bits else 0) for s, c in zip(pdf["slot"], pdf["cluster"], strict=True)]
    put = best_fit(pdf["length"].astype(int).tolist(), masks, capacity)
    pdf["bin"], pdf["at"] = [b for b, _ in put], [o for _, o in put]
    return pdf[["id", "piece", "pieces", "start", "length", "source", "cluster", "bucket", "bin", "at"]]


def pack(docs: DataFrame, capacity: int = 2048, bucket_pieces: int = 8_000, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """Pack all words of all documents into sequences of `capacity` words, one more position per piece for its end.

    A text is cut into pieces of at most capacity - 1 words; none is left out. Conflicts: two pieces of equal texts
    (a duplicate cluster) never share a sequence, so nothing is trained on twice in one context; and of one source a
    sequence holds at most its quota, twice the source's share of a sequence's expected pieces, rounded up: a source has
    that many slots, each piece a hashed one, and a sequence takes a slot once. So a source with a third of all rows
    still packs tightly while a small one spreads. Pieces are dealt by a hash of id and piece to buckets of about
    bucket_pieces; a bucket is one task of best fit, so a cluster of any size is spread over all buckets.

    Returns id, piece (0..), pieces, start and length (words), source, cluster (hash of the text), pack_id, offset.
    Null and empty texts have one piece of no words, which takes only the end position. Repeated rows are copies. A null
    source is a source of its own; null ids are kept; an empty table gives no rows; other columns are left out.
    """
    body = capacity - 1
    words = F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long")
    measured = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("source"), words.alias("words"), F.coalesce(F.md5(F.col(text_col)), F.lit("null")).alias("cluster"))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("words") / body)).cast("int")
    rows = staged(measured.withColumn("pieces", pieces), "pack-rows")
    by_source = rows.groupBy("source").agg(F.sum("pieces").alias("n"), F.sum(F.col("words") + F.col("pieces")).alias("filled"))
    t = by_source.agg(F.sum("n"), F.sum("filled")).first()
    n, filled = int(t[0] or 0), int(t[1] or 0)
    per_bin = max(1.0, n * capacity / max(filled, 1))
    quota = by_source.select(F.col("source").alias("_source"), F.ceil(2 * per_bin * F.col("n") / max(n, 1)).cast("int").alias("quota"))
    buckets = max(1, -(-n // bucket_pieces))
    start = (F.col("piece") * body).cast("long")
    dealt = (
        rows.join(quota, F.col("source").eqNullSafe(F.col("_source")))
        .withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)))
        .withColumn("start", start)
        .withColumn("length", F.least(F.lit(body).cast("long"), F.col("words") - F.col("start")) + 1)
        .withColumn("slot", F.concat_ws(":", F.pmod(F.xxhash64("piece", "id", "words"), F.col("quota")), F.coalesce("source", F.lit("\x00"))))
        .withColumn("bucket", F.pmod(F.xxhash64("id", "piece", F.lit("bucket")), F.lit(buckets)))
        .drop("_source", "quota", "words")
    )
    id_type = rows.schema["id"].dataType.simpleString()

    def task(pdf: pd.DataFrame) -> pd.DataFrame:
        return _pack(pdf, capacity)

    packed = dealt.groupBy("bucket").applyInPandas(task, f"id {id_type}, piece int, pieces int, start long, length long, source string, cluster string, bucket long, bin long, at long")
    return packed.select(F.col("id").alias(id_col), "piece", "pieces", "start", (F.col("length") - 1).alias("length"), "source", "cluster", F.concat_ws("-", "bucket", "bin").alias("pack_id"), F.col("at").alias("offset"))
