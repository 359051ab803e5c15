"""Greedy word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import json
from collections import deque
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

END = 256  #: the symbol after the last byte of a word


def _byte_alphabet() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabulary files use for the 256 bytes."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {chr(b): b for b in keep}, 0
    for b in range(256):
        if b not in keep:
            out[chr(256 + n)] = b
            n += 1
    return out


def load_vocabulary(path: str, end_mark: str = "</w>") -> list[tuple[int, ...]]:
    """Pieces of a byte-level vocabulary file as tuples of symbols; end_mark becomes the symbol END.

    Pieces with other characters (special tokens) are left out. Every single byte must be there, alone and at a word's end.
    """
    alphabet = _byte_alphabet()
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    out = set()
    for piece in vocabulary:
        last = piece.endswith(end_mark)
        body = piece[: -len(end_mark)] if last else piece
        if body and all(c in alphabet for c in body):
            out.add((*(alphabet[c] for c in body), *((END,) if last else ())))
    return sorted(out)


class LongestMatch:
    """Trie of the pieces with failure links that carry how many pieces are popped on the way.

    Reading a symbol either goes down the trie or follows the failure link: that emits the greedy pieces of what the
    state holds, as a number, and goes to the state of the rest. Each symbol is read once, so a word takes linear time. An end symbol that is left over by itself counts nothing.
    """

    def __init__(self, pieces: list[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        whole = [False]
        for piece in [*pieces, (END,)]:
            at = 0
            for c in piece:
                to = self.next[at].get(c)
                if to is None:
                    to = self.next[at][c] = len(self.next)
                    self.next.append({})
                    whole.append(False)
                at = to
            whole[at] = piece != (END,)
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n
        todo = deque([0])
        while todo:
            u = todo.popleft()
            for c, v in self.next[u].items():
                todo.append(v)
                if whole[v]:
                    self.fail[v], self.popped[v] = 0, 1
                    continue
                if (u, c) == (0, END):  # an end symbol that no piece took
                    self.fail[v] = 0
                    continue
                z, count = self.fail[u], self.popped[u]
                while z >= 0 and c not in self.next[z]:
                    count += self.popped[z]
                    z = self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.next[z][c], count

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of the word; the vocabulary covers every byte, so there always are."""
        at, total, nxt, fail, popped = 0, 0, self.next, self.fail, self.popped
        for c in (*word, END):
            while (to := nxt[at].get(c)) is None:
                total += popped[at]
                at = fail[at]
                if at < 0:
                    raise ValueError("the vocabulary lacks a single-byte piece")
            at = to
        while at:
            total += popped[at]
            at = fail[at]
        return total


class _Counts(dict):
    """word -> pieces; forgets all when it holds `limit` words, so its memory is bounded."""

    def __init__(self, automaton: LongestMatch, limit: int):
        super().__init__()
        self.automaton, self.limit = automaton, limit

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(word)
        if len(word) <= 64:
            if len(self) >= self.limit:
                self.clear()
            self[word] = n
        return n


def _count_batches(batches, pieces, cache_words):
    counts = _Counts(LongestMatch(pieces), cache_words)
    for batch in batches:
        words, tokens = [], []
        for text in batch.column(1):
            w = (text.as_py() or "").lower().encode("utf-8", "replace").split()
            words.append(len(w))
            tokens.append(sum(map(counts.__getitem__, w)))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["id", "n_words", "n_tokens"])


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", end_mark: str = "</w>", cache_words: int = 300_000) -> DataFrame:
    """Number of greedy longest-match word pieces of every whole text: id, n_words, n_tokens.

    The text is lower-cased and split at ASCII white space; a word is its UTF-8 bytes followed by the end symbol, cut
    from the left into the longest pieces of the vocabulary (a file path, read once on the driver); an end symbol that
    is left over alone counts nothing. No piece is built,
    only counted. One pass, no shuffle. Null and empty texts count 0 words and 0 tokens; null ids and repeated rows are
    kept; an empty table gives no rows; other columns are left out.
    """
    pieces = load_vocabulary(vocabulary, end_mark)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_tokens long"
    shared = docs.sparkSession.sparkContext.broadcast(pieces)  # bounded by the vocabulary file
    return rows.mapInArrow(partial(_shared_count, shared=shared, cache_words=cache_words), schema).withColumnRenamed("id", id_col)


def _shared_count(batches, shared, cache_words):
    yield from _count_batches(batches, shared.value, cache_words)
