"""Substring dedup: a log-structured index of window fingerprints.

A window is ``size`` consecutive words of one document. The index is a list of
immutable runs, each a written table of buckets with sorted fingerprints of the
windows of documents added before. A batch of new documents is handled so:

1. Each slice of texts fingerprints its windows. What a slice knows by itself is
   settled there: of equal windows only those of the least document go on, so a
   passage in a third of all rows sends one entry a slice.
2. Entries are dealt by bucket, the leading bits of the fingerprint. A bucket
   merge-joins its entries with the runs by fingerprint. A match is verified by a
   second hash of the window, made from its words' 64-bit hashes after another mixing:
   only windows that agree in both are equal. A window is a repeat if a run has it (earlier
   batches) or an entry of a document with a smaller id. The bucket's new windows
   become a new run.
3. Repeats are dealt by document and become spans of covered words, which the
   texts, read again, are cut by.

Runs of a full level are compacted into one of the next level. A window is told by
its bucket (7 bits with 128 buckets, 12 with 4096), 48 bits of fingerprint beside it
and 24 bits of the second hash. With b bits in all, n * n / 2 / 2**b pairs of different
windows among n are expected to be taken for equal: 1e-8 of 1e8 windows in 128 buckets,
6e-7 of 5e9 (about 30 GB) in 4096.

A null text has no words. A null id counts as larger than any; documents with
one id are not repeats of each other. Repeated rows get the same result. An
empty table gives none. A text longer than a slice is a slice of its own and takes
memory in proportion. Only the id (long) and the text are read, so clashing names
cannot arise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import drop, exists, new_path, tidy, write, written
from .words import U64, Words, mix64, slices, windows

STORED = 6  # bytes of a fingerprint beside its bucket
LOW = U64((1 << (8 * STORED)) - 1)
NO_ID = (1 << 63) - 1
BROADCAST_BYTES = 64 << 20
WINDOWS_A_BUCKET = 1_500_000
CHECK = 3  # bytes of the second hash
SLICE = 2 << 20
OTHER = U64(0xA24BAED4963EE407)
RUN, NEW, SETTLED, HIT = 0, 1, 2, 3
ROW = "bucket int, kind int, prints binary, checks binary, docs binary, places binary"
COLUMNS = ["bucket", "kind", "prints", "checks", "docs", "places"]
CHECKED = U64((1 << (8 * CHECK)) - 1)
RUN_ROW = "bucket int, prints binary, checks binary"


def to_bytes(x: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of each number, all first bytes, then all second bytes, and so on: they compress better."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].T).tobytes()


def from_bytes(b: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(b) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(b, np.uint8).reshape(n, -1).T
    return out.reshape(-1).view("<u8").astype(U64)


def pack_docs(ids: np.ndarray, tags: np.ndarray, counts: np.ndarray) -> bytes:
    """Documents with a tag of their text and how many entries follow for each."""
    steps = np.diff(ids.astype(np.int64), prepend=np.int64(0)).view(U64)
    return to_bytes(steps, 8) + to_bytes(tags, 4) + to_bytes(counts, 4)


def unpack_docs(b: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    n = len(b) // 16
    ids = np.cumsum(from_bytes(b[: 8 * n], 8).view(np.int64))
    return ids, from_bytes(b[8 * n : 12 * n], 4), from_bytes(b[12 * n :], 4).astype(np.int64)


def pack_places(places: np.ndarray, counts: np.ndarray) -> bytes:
    """Ascending places of each document as steps."""
    steps = np.diff(places.astype(np.int64), prepend=np.int64(0))
    first = np.cumsum(counts) - counts
    steps[first] = places[first]
    return to_bytes(steps.view(U64), 4)


def unpack_places(b: bytes, counts: np.ndarray) -> np.ndarray:
    steps = from_bytes(b, 4).astype(np.int64)
    sums = np.cumsum(steps)
    first = np.cumsum(counts) - counts
    return sums - np.repeat(sums[first] - steps[first], counts)


def grouped(owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values of an ascending array and how often each occurs."""
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    return owner[first], np.diff(np.append(first, len(owner)))


def ranked(prints: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order by fingerprint and second hash, both in it, and where each distinct window begins in it."""
    order = np.argsort(prints, kind="stable")
    p, c = prints[order], checks[order]
    other = c[1:] != c[:-1]
    if ((p[1:] == p[:-1]) & other).any():  # different windows with one fingerprint
        order = np.lexsort((checks, prints))
        p, c = prints[order], checks[order]
        other = c[1:] != c[:-1]
    return order, p, c, np.flatnonzero(np.concatenate([np.ones(min(len(p), 1), bool), (p[1:] != p[:-1]) | other]))


def among(history: tuple[np.ndarray, np.ndarray], prints: np.ndarray, checks: np.ndarray) -> np.ndarray:
    """Which windows a run has: its entries of the same fingerprint are verified by the second hash, one after the other."""
    old, old_checks = history
    at, end = np.searchsorted(old, prints, "left"), np.searchsorted(old, prints, "right")
    found = np.zeros(len(prints), bool)
    left = np.flatnonzero(at < end)
    while left.size:
        found[left] |= old_checks[at[left]] == checks[left]
        at[left] += 1
        left = left[(at[left] < end[left]) & ~found[left]]
    return found


class SubstringIndex:
    def __init__(self, spark: SparkSession, size: int = 13, buckets: int = 64, fan_in: int = 3, mask: int = (1 << 64) - 1):
        """``buckets``: a power of two; a level is compacted when it has ``fan_in`` runs. ``mask``: bits of a fingerprint that are used."""
        self.spark, self.size, self.fan_in, self.mask = spark, size, fan_in, U64(mask)
        self.bits = max(1, buckets.bit_length() - 1)
        self.buckets = 1 << self.bits
        self.levels: list[list[str]] = [[]]

    @property
    def runs(self) -> list[str]:
        return [path for level in self.levels for path in level]

    def dedup(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
        """id, n_words, n_removed, kept (the words left, joined by a space); the batch joins the index if ``keep``."""
        return self.cut(docs, self.match(docs, id_col, text_col, keep), id_col, text_col)

    @staticmethod
    def _given(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
        return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def match(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: bool = True) -> DataFrame:
        """id, tag (a hash of the text), cuts: the spans of repeated words of a batch; the batch joins the index if ``keep``."""
        path = new_path(self.spark, "batch")
        rows = self._given(docs, id_col, text_col).mapInArrow(self._entries(), ROW)
        for run in self.runs:
            none = [F.lit(None).cast("binary").alias(c) for c in ("docs", "places")]
            rows = rows.unionByName(self.spark.read.schema(RUN_ROW).parquet(run).select("bucket", F.lit(RUN).alias("kind"), "prints", "checks", *none))
        rows = rows.groupBy("bucket").applyInArrow(self._join(keep), ROW)
        write(rows, path, by="kind")
        out = self.spark.read.schema(ROW).parquet(path)
        cuts = written(out.where(F.col("kind") == HIT).groupBy("bucket").applyInArrow(self._spans(), "id bigint, tag bigint, cuts binary"), "cuts")
        drop(self.spark, f"{path}/kind={HIT}")
        run = f"{path}/kind={RUN}"
        if keep and exists(self.spark, run):
            self._add(run)
        return cuts

    def drop(self) -> None:
        """Delete the runs; what was matched before stays."""
        drop(self.spark, *self.runs)
        self.levels = [[]]

    def _add(self, run: str) -> None:
        self.levels[0].append(run)
        for k in range(1 << 30):
            if k >= len(self.levels) or len(self.levels[k]) < self.fan_in:
                return
            if k + 1 == len(self.levels):
                self.levels.append([])
            self.levels[k + 1].append(self._compacted(self.levels[k]))
            for old in self.levels[k]:
                drop(self.spark, old)
            self.levels[k] = []

    def _compacted(self, runs: list[str]) -> str:
        def merge(key: tuple, table: pa.Table) -> pa.Table:
            parts = [_run(*x) for x in zip(table.column("prints").to_pylist(), table.column("checks").to_pylist(), strict=True)]
            _, prints, checks, first = ranked(*(np.concatenate(x) for x in zip(*parts, strict=True)))
            del parts
            tidy()
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "prints": pa.array([_packed(prints[first])], pa.binary()), "checks": pa.array([to_bytes(checks[first], CHECK)], pa.binary())})

        rows = self.spark.read.schema(RUN_ROW).parquet(*runs)
        return write(rows.groupBy("bucket").applyInArrow(merge, RUN_ROW), new_path(self.spark, "run"))

    def _entries(self):
        size, bits, buckets, mask = self.size, self.bits, self.buckets, self.mask

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            import zlib

            for whole in batches:
                for batch in slices(whole, "text", SLICE):
                    words = Words(batch.column("text"))
                    hashes = words.hash()
                    prints, at = windows(hashes, words.doc, size)
                    if not len(prints):
                        continue
                    prints &= mask
                    checks = windows(mix64(hashes ^ OTHER), words.doc, size)[0] & CHECKED
                    del hashes
                    ids = np.array(batch.column("id").fill_null(NO_ID), np.int64)
                    tags = np.array([zlib.crc32(words.data[a:b]) for a, b in zip(words.at[:-1], words.at[1:], strict=True)], U64)
                    text = np.searchsorted(words.doc, at, "right") - 1
                    place = at - words.doc[text]
                    order, _, _, first = ranked(prints, checks)
                    least = np.minimum.reduceat(ids[text[order]], first)
                    settled = np.empty(len(at), bool)
                    settled[order] = ids[text[order]] > np.repeat(least, np.diff(np.append(first, len(order))))
                    bucket = (prints >> U64(64 - bits)).astype(np.int32)
                    shard = (ids % buckets).astype(np.int32)
                    out: dict[str, list] = {k: [] for k in COLUMNS}
                    for kind, here, deal in ((NEW, ~settled, bucket), (SETTLED, settled, shard[text])):
                        chosen = np.flatnonzero(here)
                        chosen = chosen[np.argsort(deal[chosen].astype(np.uint16 if buckets <= 1 << 16 else np.uint32), kind="stable")]
                        for b, lo, n in zip(*_runs(deal[chosen]), strict=True):
                            own = chosen[lo : lo + n]
                            docs, counts = grouped(text[own])
                            out["bucket"].append(int(b))
                            out["kind"].append(kind)
                            out["prints"].append(to_bytes(prints[own] & LOW, STORED) if kind == NEW else None)
                            out["checks"].append(to_bytes(checks[own], CHECK) if kind == NEW else None)
                            out["docs"].append(pack_docs(ids[docs], tags[docs], counts))
                            out["places"].append(pack_places(place[own], counts))
                    yield _batch(out)
            tidy()

        return run

    def _join(self, keep: bool):
        buckets = self.buckets

        def join(key: tuple, table: pa.Table) -> pa.Table:
            kinds = np.array(table.column("kind"))
            prints, checks, docs, places = (table.column(c).to_pylist() for c in ("prints", "checks", "docs", "places"))
            del table
            out: dict[str, list] = {k: [] for k in COLUMNS}

            def add(bucket: int, kind: int, *values: bytes | None) -> None:
                for column, value in zip(COLUMNS, (bucket, kind, *values), strict=True):
                    out[column].append(value)

            def emit(ids: np.ndarray, tags: np.ndarray, at: np.ndarray) -> None:
                order = np.lexsort((at, tags, ids, ids % buckets))
                ids, tags, at = ids[order], tags[order], at[order]
                for b, lo, n in zip(*_runs((ids % buckets).astype(np.int32)), strict=True):
                    own = slice(lo, lo + n)
                    doc = np.cumsum((np.diff(ids[own], prepend=ids[lo]) != 0) | (np.diff(tags[own], prepend=tags[lo]) != 0))
                    which, counts = grouped(doc)
                    first = lo + np.cumsum(counts) - counts
                    add(int(b), HIT, None, None, pack_docs(ids[first], tags[first], counts), pack_places(at[own], counts))

            for i in np.flatnonzero(kinds == SETTLED):
                add(int(key[0].as_py()), HIT, None, None, docs[i], places[i])
            new = np.flatnonzero(kinds == NEW)
            if len(new):
                all_prints = np.concatenate([from_bytes(prints[i], STORED) for i in new])
                ids = np.concatenate([np.repeat(x, c) for x, _, c in (unpack_docs(docs[i]) for i in new)])
                order, distinct, tests, first = ranked(all_prints, np.concatenate([from_bytes(checks[i], CHECK) for i in new]))
                least = np.minimum.reduceat(ids[order], first)
                distinct, tests = distinct[first], tests[first]
                old = np.zeros(len(distinct), bool)
                for i in np.flatnonzero(kinds == RUN):
                    old |= among(_run(prints[i], checks[i]), distinct, tests)
                hit = np.empty(len(order), bool)
                sizes = np.diff(np.append(first, len(order)))
                hit[order] = np.repeat(old, sizes) | (ids[order] > np.repeat(least, sizes))
                del order, all_prints
                found = np.flatnonzero(hit)
                if len(found):
                    tags = np.concatenate([np.repeat(t, c) for _, t, c in (unpack_docs(docs[i]) for i in new)])
                    at = np.concatenate([unpack_places(places[i], unpack_docs(docs[i])[2]) for i in new])
                    emit(ids[found], tags[found], at[found])
                if keep and not old.all():
                    add(int(key[0].as_py()), RUN, _packed(distinct[~old]), to_bytes(tests[~old], CHECK), None, None)
            tidy()
            return pa.Table.from_batches([_batch(out)])

        return join

    def _spans(self):
        size = self.size

        def spans(key: tuple, table: pa.Table) -> pa.Table:
            ids, tags, at = [], [], []
            for docs, places in zip(table.column("docs").to_pylist(), table.column("places").to_pylist(), strict=True):
                i, t, c = unpack_docs(docs)
                ids.append(np.repeat(i, c))
                tags.append(np.repeat(t, c))
                at.append(unpack_places(places, c))
            ids, tags, at = (np.concatenate(x) for x in (ids, tags, at))
            order = np.lexsort((at, tags, ids))
            ids, tags, at = ids[order], tags[order], at[order]
            fresh = np.ones(len(at), bool)  # the first window of a span
            fresh[1:] = (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]) | (at[1:] > at[:-1] + size)
            begin = np.flatnonzero(fresh)
            last = np.append(begin[1:], len(at)) - 1
            pairs = np.stack([at[begin], at[last] + size], axis=1).astype("<i8")
            doc = np.ones(len(begin), bool)
            doc[1:] = (ids[begin][1:] != ids[begin][:-1]) | (tags[begin][1:] != tags[begin][:-1])
            lo = np.flatnonzero(doc)
            hi = np.append(lo[1:], len(begin))
            return pa.table({
                "id": ids[begin[lo]],
                "tag": tags[begin[lo]].astype(np.int64),
                "cuts": pa.array([pairs[a:b].tobytes() for a, b in zip(lo, hi, strict=True)], pa.binary()),
            })

        return spans

    def cut(self, docs: DataFrame, cuts: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """id, n_words, n_removed, kept of every document, from the spans that ``match`` gave."""
        given = self._given(docs, id_col, text_col)
        size = cuts.agg(F.sum(F.octet_length("cuts") + 64)).first()[0] or 0
        cuts = cuts.withColumnRenamed("id", "cut_id")
        key: Column = F.coalesce(F.col("id"), F.lit(NO_ID))
        joined = given.withColumn("cut_id", key).withColumn("tag", F.crc32(F.col("text").cast("binary")))
        joined = joined.join(F.broadcast(cuts) if size <= BROADCAST_BYTES else cuts, ["cut_id", "tag"], "left").select("id", "text", "cuts")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", SLICE):
                    words = Words(batch.column("text"))
                    step = np.zeros(len(words.start) + 1, np.int64)
                    for i, body in enumerate(batch.column("cuts").to_pylist()):
                        if body:
                            pairs = np.frombuffer(body, "<i8").reshape(-1, 2) + words.doc[i]
                            np.add.at(step, pairs[:, 0], 1)
                            np.add.at(step, pairs[:, 1], -1)
                    stays = np.cumsum(step[:-1]) == 0
                    texts, left = _texts(words, stays)
                    yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(words.n.astype(np.int64)), pa.array((words.n - left).astype(np.int64)), texts], [id_col, "n_words", "n_removed", "kept"])
            tidy()

        return joined.mapInArrow(run, f"`{id_col}` bigint, n_words bigint, n_removed bigint, kept string")


def _runs(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Values of an ascending array, where each begins, how often it occurs."""
    if not len(x):
        return x, x, x
    first = np.flatnonzero(np.diff(x, prepend=x[0] - 1))
    return x[first], first, np.diff(np.append(first, len(x)))


def _packed(prints: np.ndarray) -> bytes:
    """Sorted fingerprints as steps: small numbers, whose leading bytes compress away."""
    return to_bytes(np.diff(prints, prepend=U64(0)), STORED)


def _run(prints: bytes, checks: bytes) -> tuple[np.ndarray, np.ndarray]:
    return np.cumsum(from_bytes(prints, STORED), dtype=U64), from_bytes(checks, CHECK)


def _batch(out: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(out[k], pa.int32() if k in ("bucket", "kind") else pa.binary()) for k in COLUMNS], COLUMNS)


def _texts(words: Words, stays: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """For each text its staying words joined by one space, and how many they are."""
    start, end = words.start[stays], words.end[stays]
    before = np.concatenate([[0], np.cumsum(stays)])[words.doc]
    n = np.diff(before)
    sizes = end - start + 1  # with the space after it
    close = np.cumsum(sizes)
    open_ = close - sizes
    total = int(close[-1]) if len(close) else 0
    source = np.arange(total) + np.repeat(start - open_, sizes)
    source[close - 1] = 0
    body = words.data[source] if total else np.zeros(0, np.uint8)
    body[close - 1] = 0x20
    bounds = np.concatenate([[0], close])[before]
    # the space after a text's last word goes
    drop_at = bounds[1:][n > 0] - 1
    mask = np.ones(total, bool)
    mask[drop_at] = False
    body = body[mask]
    bounds = bounds - np.concatenate([[0], np.cumsum(n > 0)])
    return pa.Array.from_buffers(pa.string(), len(n), [None, pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(body))]), n


def dedup_all(docs: DataFrame, size: int = 13, batches: int = 7, buckets: int | None = None, mask: int = (1 << 64) - 1) -> DataFrame:
    """All documents in ``batches`` of ascending ids and about as many rows, each matched against those before and added."""
    spark = docs.sparkSession
    shares = [k / batches for k in range(1, batches)]
    about = docs.select("doc_id", F.octet_length("text").alias("n")).agg(F.percentile_approx("doc_id", shares or [0.5], 1000).alias("at"), F.sum("n").alias("n")).first()
    if buckets is None:
        buckets = 64
        while buckets * WINDOWS_A_BUCKET * 6 < (about["n"] or 0):  # about 6 bytes a word
            buckets *= 2
    index, ends = SubstringIndex(spark, size, buckets, mask=mask), sorted(set(about["at"] or []))[: len(shares)]
    cuts, lower = None, F.lit(True)
    for end in [*ends, None]:
        some = lower & (F.col("doc_id") < end) if end is not None else lower | F.col("doc_id").isNull()
        found = index.match(docs.where(some))
        cuts = found if cuts is None else cuts.unionByName(found)
        lower = F.col("doc_id") >= end if end is not None else None
    index.drop()
    return index.cut(docs, cuts)
