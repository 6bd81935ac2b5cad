"""Packing of tokenised documents into fixed windows by best-fit decreasing.

A document's tokens are cut into full windows; what is left over is packed by best-fit decreasing:
pieces come longest first and each goes to the open window with the least room that still holds
it, found by a segment tree indexed by remaining capacity.

Lengths are integers up to the capacity, so pieces of one length are interchangeable, and so are
windows with the same room. The packing therefore runs on the histogram of lengths (at most
``capacity`` numbers, whatever the corpus holds) and moves whole intervals of windows at a time.
It yields a table that sends the r-th piece of a length to a window and an offset. Ranks are
computed distributed: a number inside (length, shard) plus the sum over earlier shards. The result
is the packing that best-fit decreasing gives on the whole corpus, not one per partition.

Edge cases: null or empty texts hold the end token only; repeated rows are packed as often as they
come; rows with a null doc_id are packed with a null doc_id; other columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import kernels as K
from .common import materialize

CAPACITY = 2048
U = np.uint64
END = 1
#: Words that a worker remembers, in about 30 bytes each; it starts anew beyond.
REMEMBERED = 1 << 21


class RoomTree:
    """A segment tree over remaining capacities 0..n: which of them have open windows."""

    def __init__(self, n: int):
        self.size = 1 << n.bit_length()
        self.open = np.zeros(2 * self.size, np.int64).tolist()

    def add(self, room: int, count: int) -> None:
        i = room + self.size
        while i:
            self.open[i] += count
            i >>= 1

    def tightest(self, need: int) -> int | None:
        """The least room >= need that an open window has."""
        i = need + self.size
        if self.open[i]:
            return need
        while i > 1:
            if i % 2 == 0 and self.open[i + 1]:
                i += 1
                while i < self.size:
                    i = 2 * i if self.open[2 * i] else 2 * i + 1
                return i - self.size
            i >>= 1
        return None


def best_fit_decreasing(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, count, first window, offset): pieces of that length with these
    ranks go to consecutive windows at that offset."""
    tree = RoomTree(capacity)
    spans: dict[int, list[tuple[int, int]]] = {}
    plan, windows = [], 0
    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                # every window opened now takes one piece, then the rest may fit on top
                fresh = -(-left // (capacity // length))
                spans.setdefault(capacity, []).append((windows, fresh))
                tree.add(capacity, fresh)
                windows += fresh
                room = capacity
            first, count = spans[room].pop()
            used = min(count, left)
            if used < count:
                spans[room].append((first + used, count - used))
            tree.add(room, -used)
            plan.append((length, rank, used, first, capacity - room))
            if room > length:
                spans.setdefault(room - length, []).append((first, used))
                tree.add(room - length, used)
            rank, left = rank + used, left - used
    return plan


class WordTable:
    """The ids of the words met so far, in arrays: sorted word hashes, and where their ids lie.

    A worker keeps one for each vocabulary, so later tasks find most of their words in it.
    """

    kept: dict[str, WordTable] = {}

    def __init__(self, vocabulary: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(public_tokenizers.path(vocabulary))
        self.clear()

    @classmethod
    def of(cls, vocabulary: str) -> WordTable:
        if vocabulary not in cls.kept:
            cls.kept[vocabulary] = cls(vocabulary)
        return cls.kept[vocabulary]

    def clear(self) -> None:
        self.names = np.zeros(0, np.uint64)
        self.begin, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0

    def ids(self, name: np.ndarray, start: np.ndarray, end: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For words (sorted distinct hashes, and their bytes): begin, size and the ids."""
        if len(self.names) > REMEMBERED:
            self.clear()
        at = np.searchsorted(self.names, name)
        new = np.flatnonzero((at == len(self.names)) | (np.append(self.names, U(0))[at] != name))
        for a in range(0, len(new), 1 << 15):
            self.learn(name[new[a : a + (1 << 15)]], start[new[a : a + (1 << 15)]], end[new[a : a + (1 << 15)]], data)
        at = np.searchsorted(self.names, name)
        return self.begin[at], self.size[at], self.flat

    def learn(self, name, start, end, data) -> None:
        """Encodes new words in one text; a token belongs to the word it begins in, as no token
        crosses white space."""
        raw = memoryview(np.ascontiguousarray(data))
        words = [str(raw[a:b], "utf-8", "replace") for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        found = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
        first = np.cumsum([0, *(len(w) + 1 for w in words)])[:-1]
        owner = np.searchsorted(first, np.array([o[0] for o in found.offsets], np.int64), "right") - 1
        size = np.bincount(owner, minlength=len(words))
        need = self.used + len(found.ids)
        if need > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), need), np.uint32)])
        self.flat[self.used : need] = found.ids
        to = np.searchsorted(self.names, name)
        self.begin = np.insert(self.begin, to, self.used + np.cumsum(size) - size)
        self.size = np.insert(self.size, to, size)
        self.names = np.insert(self.names, to, name)
        self.used = need


def tokenise(docs: DataFrame, vocabulary: str, capacity: int, end: int) -> DataFrame:
    """Pieces (doc_id, start, length, ids_crc32, doc_tokens) of each document's ids."""

    def pieces(batches):
        table = WordTable.of(vocabulary)
        for batch in batches:
            ids = batch.column("doc_id")
            data, offs = K.strings(batch.column("text"))
            for lo, hi in K.chunks(offs):
                part = data[offs[lo] : offs[hi]]
                starts, ends, first = K.words(part, offs[lo : hi + 1] - offs[lo])
                # No token crosses white space, so each distinct word is encoded once.
                name, at, word = np.unique(K.span_hash(K.prefix(part), starts, ends), return_index=True, return_inverse=True)
                begin, size, flat = table.ids(name, starts[at], ends[at], part)
                word = np.insert(word, first[1:], len(name))  # the end token after each document
                n = np.append(size, 1)[word]
                total = np.cumsum(n)
                tokens = flat[np.repeat(np.append(begin, 0)[word] - (total - n), n) + np.arange(total[-1])]
                tokens[total[first[1:] + np.arange(hi - lo)] - 1] = end
                stop = total[first[1:] + np.arange(hi - lo)]
                view = memoryview(np.ascontiguousarray(tokens).view(np.uint8))
                out: tuple[list, ...] = ([], [], [], [], [])
                a = 0
                for i, b in enumerate(stop.tolist()):
                    for s in range(a, b, capacity):
                        e = min(b, s + capacity)
                        for c, v in zip(out, (lo + i, s - a, e - s, zlib.crc32(view[4 * s : 4 * e]), b - a), strict=True):
                            c.append(v)
                    a = b
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array(out[0], pa.int64())), *(pa.array(c, pa.int64()) for c in out[1:])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(pieces, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def pack(docs: DataFrame, vocabulary: str = "word_bpe_49k.json", capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = materialize(tokenise(docs, vocabulary, capacity, end), "pieces")
    histogram = {r.length: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most ``capacity`` rows
    plan = np.array(sorted(best_fit_decreasing(histogram, capacity)) or np.zeros((0, 5)), np.int64)
    shared = spark.sparkContext.broadcast(plan)
    shards = max(16, min(1 << 16, sum(histogram.values()) >> 12))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(shards)))
    before = (
        dealt.groupBy("length", "shard")
        .count()
        .select("length", "shard", (F.sum("count").over(Window.partitionBy("length").orderBy("shard")) - F.col("count")).alias("before"))
    )
    place = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32")
    ranked = dealt.withColumn("place", F.row_number().over(place)).join(before, ["length", "shard"]).withColumn("rank", F.col("before") + F.col("place") - 1)

    def send(batches):
        rows = shared.value
        key = rows[:, 0] << 44 | rows[:, 1]
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(key, length << 44 | rank, "right") - 1
            cols = [batch.column(c) for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")]
            yield pa.RecordBatch.from_arrays(
                [*cols, pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            )

    return ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "rank").mapInArrow(
        send, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    )
