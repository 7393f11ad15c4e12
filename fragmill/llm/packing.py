"""Best-fit packing by a linear grouping scheme.

Workers cut texts into pieces; what the driver plans with is only the histogram of piece lengths, at most `capacity`
numbers however many documents there are.  Large lengths are sorted and dealt into groups of equal cardinality, each
rounded up to its longest; configurations of these few sizes are found by column generation and rounded down.  Actual
lengths are then substituted, so every sequence gets back the room that rounding took.  The large pieces that are left
are grouped anew, ever finer, until no configuration is used once; the small ones go best-fit into the tightest room.  The plan is a list of runs (length, first rank, count, first
sequence, offset), all in counts.  Pieces get a rank within their length from per-partition counts, and find their run
by binary search; no task gathers the pieces of one length.
"""

from __future__ import annotations

import base64
import bisect
import json
import re
import zlib
from collections.abc import Iterator
from itertools import groupby
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from .bpe import BYTE_VOCABULARY
from .pretoken import ByteCutter
from .shared import in_blocks, in_use, mapped, text_or_empty, written

#: Ids of a sequence, groups of large lengths, share of a sequence up to which a length is small, columns generated at most.
CAPACITY, GROUPS, SMALL, ROUNDS = 2048, 768, 1 / 3, 4000
#: Pre-tokens whose ids a worker remembers.
REMEMBERED = 200_000


class PieceCoder(dict):
    """Pre-token -> its ids as little-endian 32-bit integers.

    The ranks file is the same vocabulary as `byte_bpe_50k.json`, whose special strings and their ids are taken; its
    library encodes a single pre-token several times as fast, with the same ids.
    """

    def __init__(self):
        super().__init__()
        import tiktoken

        with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.one = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.cut = ByteCutter(public_tokenizers.PATTERN)
        with open(public_tokenizers.path(BYTE_VOCABULARY), encoding="utf-8") as f:  # its library would hold the vocabulary once more
            self.special = {t["content"]: np.array([t["id"]], "<u4").tobytes() for t in json.load(f)["added_tokens"]}
        self.apart = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")

    def __missing__(self, word: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        self[word] = out = np.array(self.one(word), dtype="<u4").tobytes()
        return out

    def ids(self, text: str) -> bytes:
        """All ids of a text; a special string is one id, as in the library's default."""
        parts = self.apart.split(text)
        return b"".join(self.special[p] if i % 2 else b"".join(map(self.__getitem__, self.cut(p))) for i, p in enumerate(parts))


_CODER: list[PieceCoder] = []


def cut_lengths(n: int, capacity: int) -> list[int]:
    """Only what is longer than a sequence is cut; the first piece may be shorter."""
    if n <= capacity:
        return [n]
    first = n % capacity
    return ([first] if first else []) + [capacity] * (n // capacity)


def pieces(docs: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """part, nth, doc_id, piece, start, length, ids_crc32: nth counts the pieces of that length within the part before it."""
    rows = docs.select("doc_id", text_or_empty(docs).alias("_text"))
    schema = StructType([*StructType.fromDDL("part int, nth long").fields, docs.schema["doc_id"], *StructType.fromDDL("piece int, start long, length int, ids_crc32 long").fields])
    arrow = to_arrow_schema(schema)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        in_use(_CODER)
        if not _CODER:
            _CODER.append(PieceCoder())
        coder, part, seen = _CODER[0], TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for b in batches:
            texts = b.column(1).to_pylist()
            for s in in_blocks(texts):
                row, cols = [], ([], [], [], [], [])
                for i in range(s.start, s.stop):
                    whole = coder.ids(texts[i]) + b"\0\0\0\0"
                    at = 0
                    for k, n in enumerate(cut_lengths(len(whole) // 4, capacity)):
                        row.append(i)
                        for c, v in zip(cols, (int(seen[n]), k, at, n, zlib.crc32(whole[4 * at : 4 * (at + n)]))):
                            c.append(v)
                        seen[n] += 1
                        at += n
                nth, piece, start, length, crc = cols
                yield pa.RecordBatch.from_arrays([pa.array([part] * len(row), pa.int32()), pa.array(nth, pa.int64()), b.column(0).take(pa.array(row, pa.int64())).cast(arrow.field(2).type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int32()), pa.array(crc, pa.int64())], schema=arrow)

    return mapped(rows, work, schema)


# ---- the plan, on counts of lengths


def equal_groups(large: list[tuple[int, int]], groups: int) -> list[list[tuple[int, int]]]:
    """(length, count) from the longest down, dealt into `groups` groups of equal cardinality."""
    total = sum(c for _, c in large)
    out, size, room = [], ceil(total / groups), 0
    for length, count in large:
        while count:
            if not room:
                out.append([])
                room = size
            n = min(count, room)
            out[-1].append((length, n))
            count, room = count - n, room - n
    return out


def configurations(sizes: list[int], counts: list[int], capacity: int, rounds: int = ROUNDS) -> list[tuple[tuple[int, ...], float]]:
    """Patterns over `sizes` (slots per size) and how often to use each, a linear programme by column generation."""
    k, size = len(sizes), np.array(sizes)
    basis = np.diag((capacity // size).astype(float))
    back, use = np.diag(1 / np.diag(basis)), np.array(counts) / np.diag(basis)
    most = capacity // int(size.min())
    room = np.arange(capacity + 1)[None, :] - size[:, None]  # what a size leaves of each capacity
    fits, room = room >= 0, np.maximum(room, 0)
    for turn in range(rounds):
        if turn % 64 == 63:
            back = np.linalg.inv(basis)
        price = back.sum(0)
        best, taken = np.zeros(capacity + 1), []
        for _ in range(most):  # the pattern of greatest price, by its number of slots
            worth = np.where(fits, best[room] + price[:, None], 0.0)
            which = worth.argmax(0)
            taken.append(np.where(worth[which, np.arange(capacity + 1)] > best + 1e-12, which, -1))
            best = np.maximum(best, worth[which, np.arange(capacity + 1)])
        if best[capacity] <= 1 + 1e-6:
            break
        column, at = np.zeros(k), capacity
        for which in reversed(taken):
            if (i := which[at]) >= 0:
                column[i] += 1
                at -= sizes[i]
        step = back @ column
        ok = step > 1e-9
        if not ok.any():
            break
        ratio = np.where(ok, use / np.where(ok, step, 1), np.inf)
        out = int(ratio.argmin())
        use = np.maximum(use - ratio[out] * step, 0)
        use[out] = ratio[out]
        basis[:, out] = column
        row = back[out] / step[out]
        back = back - np.outer(step, row)
        back[out] = row
    return [(tuple(int(x) for x in basis[:, j]), float(use[j])) for j in range(k) if use[j] > 1e-9]


class Plan:
    """Runs (length, first rank, count, first sequence, offset) of a histogram, as they are put."""

    def __init__(self, histogram: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {n: c for n, c in histogram.items() if c > 0}
        self.rank = dict.fromkeys(self.left, 0)
        self.runs: list[tuple[int, int, int, int, int]] = []
        self.opened = 0
        self.rooms: dict[int, list[tuple[int, int]]] = {}  # room -> stretches (first sequence, count)

    def put(self, length: int, count: int, sequence: int, offset: int) -> None:
        self.runs.append((length, self.rank[length], count, sequence, offset))
        self.rank[length] += count
        self.left[length] -= count

    def filled(self, lengths: list[int], count: int) -> None:
        """`count` sequences, each of a piece of every one of `lengths`."""
        offset = 0
        for n, same in groupby(lengths):
            for i in range(k := len(list(same))):
                self.put(n, count, self.opened, offset + i * n)
            offset += k * n
        if self.capacity - offset:
            self.rooms.setdefault(self.capacity - offset, []).append((self.opened, count))
        self.opened += count

    def substitute(self, pattern: tuple[int, ...], times: int, queues: list[list[list[int]]]) -> None:
        """`times` sequences of a configuration: every slot gets an actual piece of its group, the longest left.

        Stretches over which no slot changes its length are put at once.  A slot whose group is used up stays empty.
        """
        while times > 0:
            lengths, n = [], times
            for i, slots in enumerate(pattern):
                q = queues[i]
                while q and not q[0][1]:
                    q.pop(0)
                if slots and q and q[0][1] >= slots:
                    n = min(n, q[0][1] // slots)
                    lengths += [q[0][0]] * slots
                elif slots:  # the slots of this group differ in length, so this is one sequence
                    n, need = 1, slots
                    for length, count in q:
                        lengths += [length] * min(need, count)
                        need -= min(need, count)
            if not lengths:
                return
            for i, slots in enumerate(pattern):
                need = slots * n
                for x in queues[i]:
                    used = min(need, x[1])
                    x[1] -= used
                    need -= used
                    if not need:
                        break
            self.filled(lengths, n)
            times -= n

    def group(self, smallest: int, groups: int) -> None:
        """Large pieces by configurations of their groups' sizes; what rounding leaves is grouped anew, ever finer."""
        while True:
            large = sorted(((n, c) for n, c in self.left.items() if n > smallest and c), reverse=True)
            if not large:
                return
            merged: list[list[tuple[int, int]]] = []  # a length that fills whole groups is one size
            for g in equal_groups(large, groups):
                if merged and merged[-1][0][0] == g[0][0] and len(merged[-1]) == 1:
                    merged[-1] = [(g[0][0], merged[-1][0][1] + g[0][1])] + g[1:]
                else:
                    merged.append(list(g))
            queues = [[list(x) for x in g] for g in merged]
            found = configurations([g[0][0] for g in merged], [sum(c for _, c in g) for g in merged], self.capacity)
            whole = [(pattern, int(use + 1e-6)) for pattern, use in found]
            if not any(times for _, times in whole):  # only fractions are left: those of a half or more are used
                whole = [(pattern, 1) for pattern, use in sorted(found, key=lambda x: -x[1]) if use >= 0.5]
            if not whole:
                return
            before = self.opened
            for pattern, times in whole:
                self.substitute(pattern, times, queues)
            if self.opened == before:
                return

    def best_fit(self) -> None:
        """Everything left, the longest first, into the tightest room."""
        keys = sorted(self.rooms)
        for length in sorted(self.left, reverse=True):
            while self.left[length]:
                i = bisect.bisect_left(keys, length)
                if i < len(keys):
                    room = keys[i]
                    first, count = self.rooms[room].pop()
                    n = min(count, self.left[length])
                    if n < count:
                        self.rooms[room].append((first + n, count - n))
                    if not self.rooms[room]:
                        del self.rooms[room], keys[i]
                else:
                    room, n, first = self.capacity, max(1, self.left[length] // (self.capacity // length)), self.opened
                    self.opened += n
                self.put(length, n, first, self.capacity - room)
                if rest := room - length:
                    if rest not in self.rooms:
                        self.rooms[rest] = []
                        bisect.insort(keys, rest)
                    self.rooms[rest].append((first, n))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, small: float = SMALL) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Runs (length, first rank, count, first sequence, offset) and the number of sequences."""
    made = Plan(histogram, capacity)
    made.group(int(small * capacity), groups)
    made.best_fit()
    return made.runs, made.opened


def pack(docs: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: all documents in sequences of at most `capacity` ids.

    A document is its ids, then id 0; null text counts as empty and so is one id long.  Only longer ones than a sequence
    are cut.  Repeated rows are packed each; a null id stays null; pieces of one length are alike to the plan, so ties
    fall as rows come; texts of any length are cut whole; an empty table gives an empty one; other columns are not read.
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, capacity), "pieces")
    counts = written(cut.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs, _ = plan(histogram, capacity, groups)
    runs.sort()
    table = np.array(runs, dtype=np.int64).reshape(-1, 5)
    sent = spark.sparkContext.broadcast(table)  # runs of a plan over at most `capacity` lengths
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = cut.join(offsets, ["part", "length"]).select("doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", (F.col("nth") + F.col("before")).alias("rank"))

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        t = sent.value
        base = np.int64(1) << 44  # a rank below 2^44 within each length
        at = np.searchsorted(t[:, 0] * base + t[:, 1], length.to_numpy() * base + rank.to_numpy(), side="right") - 1
        return pd.DataFrame({"sequence_id": t[at, 3] + rank.to_numpy() - t[at, 1], "offset": t[at, 4]})

    return ranked.withColumn("_p", place("length", "rank")).select("doc_id", "piece", "start", "length", "ids_crc32", "_p.sequence_id", "_p.offset")
