"""Best-fit packing of documents into sequences, by exact-complement hashing.

1. Every text is encoded once and cut into pieces of at most ``limit`` ids; the
   pieces are written with their ids and numbered per task and length.
2. The number of pieces of each length, ``limit`` rows at most, goes to the
   driver, whose plan is made on counts alone: for a length its gap to ``limit``
   is looked up among single, pair and triple sums of lengths, and a combination
   is used as often as the counts allow. What has no exact complement is placed
   by best fit, longest first.
3. A piece's number among those of its length (its number in the task and the
   tasks before) says which place of the plan it takes.

No group is gathered: counts are summed, and pieces stay where they are. The
plan holds a few entries per length whatever the number of pieces.

A null text is empty; every document ends with ``end_id``, so an empty one has
one piece of length 1. Repeated rows are packed each. An empty table gives none.
A very long text is encoded in spans and cut into pieces by the task that reads it,
which takes memory in proportion to it. Pieces of equal length tie: they take the
plan's places in the order of tasks and of rows within them, so which sequence one
gets may differ between runs, not how many there are. Other columns, of any name,
are not read.
"""

from __future__ import annotations

from array import array
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import tidy, written
from .tokens import Chunks

BROADCAST_ROWS = 1_000_000
RANKS = 40  # bits for a piece's number among those of its length


@lru_cache(2)
def encoder(name: str) -> Chunks:
    return Chunks(name, lambda ids: array("I", ids).tobytes(), direct=True)


def encoded(texts: list[str | None], name: str, span_chars: int = 1 << 16) -> list[bytes]:
    """Unsigned 32-bit ids of each text, little-endian as the machines here are."""
    spans, owners = [], []
    for i, text in enumerate(texts):
        for span in encoder(name).cut(text or "", span_chars):
            spans.append(span)
            owners.append(i)
    out: list[list] = [[] for _ in texts]
    for i, ids in zip(owners, encoder(name).of(spans), strict=True):
        out[i].append(ids)
    return [b"".join(chain.from_iterable(x)) for x in out]


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, limit: int = 1024) -> DataFrame:
    """id, piece, start, length, ids, part, place: a piece's number among those of its length in its task."""
    from pyspark import TaskContext

    from .words import slices

    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen, end = TaskContext.get().partitionId(), Counter(), np.array([end_id], "<u4").tobytes()
        for whole in batches:
            for batch in slices(whole, "text", 2 << 20):
                rows: list[tuple] = []
                owners = []
                for i, ids in enumerate(encoded(batch.column("text").to_pylist(), vocabulary)):
                    ids += end
                    n = len(ids) // 4
                    first = (n - 1) % limit + 1
                    for k, lo in enumerate([0, *range(first, n, limit)]):
                        hi = first if k == 0 else lo + limit
                        rows.append((k, lo, hi - lo, ids[4 * lo : 4 * hi], part, seen[hi - lo]))
                        seen[hi - lo] += 1
                        owners.append(i)
                cols = list(zip(*rows, strict=True))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.int32(), pa.int64())
                arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(owners)), *arrays], [id_col, "piece", "start", "length", "ids", "part", "place"])
        tidy()

    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return given.mapInArrow(run, f"`{id_col}` {kind}, piece int, start bigint, length bigint, ids binary, part int, place bigint")


class Plan:
    """Sequences as patterns of lengths, each used some number of times."""

    def __init__(self, counts: dict[int, int], limit: int = 1024):
        self.limit = limit
        left = np.zeros(limit + 1, np.int64)
        for length, n in counts.items():
            left[length] = n
        self.patterns: list[tuple[tuple[int, ...], int]] = []
        self._complements(left)
        self._best_fit(left)
        self._places()

    def _complements(self, left: np.ndarray) -> None:
        if left[self.limit]:
            self._use(left, (self.limit,))
        for length in range(self.limit - 1, 0, -1):
            gap = self.limit - length
            for found in (self._single, self._pair, self._triple):
                while left[length] and (rest := found(left, length, gap)):
                    self._use(left, (length, *rest))

    def _use(self, left: np.ndarray, lengths: tuple[int, ...]) -> None:
        need = Counter(lengths)
        n = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= n * k
        self.patterns.append((tuple(sorted(lengths, reverse=True)), n))

    @staticmethod
    def _times(left: np.ndarray, *lengths: np.ndarray) -> np.ndarray:
        """How often each combination can be used."""
        each = []
        for x in lengths:
            need = sum((x == y).astype(np.int64) for y in lengths)
            each.append(left[x] // need)
        return np.minimum.reduce(each)

    def _single(self, left: np.ndarray, length: int, gap: int) -> tuple[int, ...]:
        return (gap,) if self._times(left, np.array([length]), np.array([gap]))[0] > 0 else ()

    def _pair(self, left: np.ndarray, length: int, gap: int) -> tuple[int, ...]:
        a = np.flatnonzero(left[: gap // 2 + 1])
        a = a[left[gap - a] > 0]
        if not a.size:
            return ()
        n = self._times(left, np.full_like(a, length), a, gap - a)
        k = int(n.argmax())
        return (int(a[k]), gap - int(a[k])) if n[k] > 0 else ()

    def _triple(self, left: np.ndarray, length: int, gap: int) -> tuple[int, ...]:
        a, b = self._triples(gap, left)
        if not a.size:
            return ()
        n = self._times(left, np.full_like(a, length), a, b, gap - a - b)
        k = int(n.argmax())
        return (int(a[k]), int(b[k]), gap - int(a[k]) - int(b[k])) if n[k] > 0 else ()

    @staticmethod
    def _triples(gap: int, left: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        have = np.flatnonzero(left[: gap + 1])
        a, b = np.meshgrid(have[have <= gap // 3], have[have <= gap // 2], indexing="ij")
        c = gap - a - b
        ok = (a <= b) & (b <= c)
        ok[ok] = left[c[ok]] > 0
        return a[ok], b[ok]

    def _best_fit(self, left: np.ndarray) -> None:
        open_bins: dict[int, list[list]] = defaultdict(list)  # room -> [pattern, count]

        def close(room: int, pattern: tuple[int, ...], n: int) -> None:
            if n:
                open_bins[room].append([pattern, n])

        for length in range(self.limit, 0, -1):
            n = int(left[length])
            while n:
                room = min((r for r, bins in open_bins.items() if r >= length and bins), default=0)
                pattern, have = open_bins[room].pop() if room else ((), n)
                room = room or self.limit
                per = room // length
                full = min(have, n // per)
                close(room - per * length, pattern + (length,) * per, full)
                n -= full * per
                rest = have - full
                if rest and n and n < per:
                    close(room - n * length, pattern + (length,) * n, 1)
                    n, rest = 0, rest - 1
                if pattern:
                    close(room, pattern, rest)
        self.patterns += [(tuple(p), n) for bins in open_bins.values() for p, n in bins]

    def _places(self) -> None:
        """Sorted starts of runs of numbers, as length << RANKS | number, and what a run stands for."""
        used: Counter = Counter()
        rows, base = [], 0
        for lengths, n in self.patterns:
            at = 0
            for x, times in Counter(lengths).items():
                rows.append(((x << RANKS) + used[x], base, at, times, x))
                used[x] += n * times
                at += x * times
            base += n
        rows.sort()
        self.n_sequences = base
        self.table = np.array(rows, np.int64).reshape(-1, 5)

    def place(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of the piece with this number among those of its length."""
        key = (length.astype(np.int64) << RANKS) + number
        row = self.table[np.searchsorted(self.table[:, 0], key, "right") - 1]
        t = key - row[:, 0]
        return row[:, 1] + t // row[:, 3], row[:, 2] + (t % row[:, 3]) * row[:, 4]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 2, limit: int = 1024) -> DataFrame:
    """id, piece, start, length, ids, sequence_id, offset: every piece with its place in a sequence."""
    spark = docs.sparkSession
    cut_up = written(pieces(docs, id_col, text_col, vocabulary, end_id, limit), "pieces")
    per_task = written(cut_up.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "piece_counts")
    plan = Plan({r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}, limit)
    shared = spark.sparkContext.broadcast(plan)
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ahead = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    if per_task.count() <= BROADCAST_ROWS:  # lengths x tasks; beyond, a shuffled join
        ahead = F.broadcast(ahead)

    @F.pandas_udf("sequence_id bigint, offset bigint")
    def slot(length: pd.Series, number: pd.Series) -> pd.DataFrame:
        sequence, offset = shared.value.place(length.to_numpy(), number.to_numpy())
        return pd.DataFrame({"sequence_id": sequence, "offset": offset})

    placed = cut_up.join(ahead, ["part", "length"]).withColumn("slot", slot("length", F.col("place") + F.col("ahead")))
    return placed.select(id_col, "piece", "start", "length", "ids", "slot.sequence_id", "slot.offset")
