"""Collocations of words, mined level by level (Apriori) and scored by their weakest cut.

Texts are lower-cased (A-Z), split at ``[.,;:!?]`` and line ends into pieces, and these
at spaces and tabs into words. Everything is counted by language. Level 1 counts all
words. Each later level k reads the texts again and emits a run of k words only where
both of its runs of k - 1 words are frequent, which are broadcast for that; a run that
is frequent has frequent parts, so none is lost. Every level is a table of runs with at
least ``least`` occurrences: (lang, word, count) or (head, tail, count), where head and
tail are the two overlapping runs of one word less. A run's cut is scored from the
counts of its two sides, which are in lower tables, and phrases are written out by
joining the tables on head and tail.

What is broadcast has a bound: up to ``exact`` runs as sorted 64-bit fingerprints, which
the count of the table shows first; beyond, as a table of ``1 << bits`` bits made in
tasks, where a rare run can pass for a frequent one. That emits more, and changes no
result, since every level keeps what its exact counts say.

Words are told apart by 64-bit fingerprints, which hold the language, and a run by the
two of its parts (128 bits): of 1e9 frequent ones 0.03 pairs are expected to share one
(computed). Counts and scores are exact: scores are taken in decimals of 38 digits,
which hold squares of counts up to 1e15.

A null or empty text has no words, a null language is ``und``. Repeated rows count as
often as they occur. Ties in score and count go by the phrase's bytes. Texts are read in
slices; a longer one is a slice of its own and takes memory in proportion. An empty table
gives no rows. Only lang and text are read, so extra columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .store import tidy, written
from .words import U64, Words, mix64, slices

BETWEEN = np.zeros(256, bool)  # pieces
BETWEEN[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = BETWEEN.copy()
APART[[0x20, 0x09]] = True
SLICE = 2 << 20
EXACT, BITS = 4_000_000, 28
GROUPS = 64


def _tongue(lang: str) -> np.uint64:
    return U64(int.from_bytes(md5(lang.encode()).digest()[:8], "little"))


def joined(head: np.ndarray, tail: np.ndarray) -> np.ndarray:
    """The fingerprint of a run from those of its two parts."""
    return mix64(mix64(head) * U64(0x9E3779B97F4A7C15) + tail)


class Runs:
    """Words of a slice of texts: their fingerprints, and for each whether the next one follows it in the same piece."""

    def __init__(self, part: pa.RecordBatch):
        self.words = Words(part.column("text"), lower=True, separators=APART)
        langs = part.column("lang").dictionary_encode()
        keys, own = np.array([_tongue(x) for x in langs.dictionary.to_pylist()], U64), np.asarray(langs.indices)
        self.owner = self.words.owner()
        self.lang = own[self.owner] if len(own) else self.owner
        self.names = langs.dictionary
        self.marks = mix64(self.words.hash() ^ keys[self.lang]) if len(keys) else np.zeros(0, U64)
        cuts = np.concatenate([[0], np.cumsum(BETWEEN[self.words.data], dtype=np.int32)])
        self.follows = (self.owner[1:] == self.owner[:-1]) & (cuts[self.words.start[1:]] == cuts[self.words.end[:-1]])


class Frequent:
    """A set of fingerprints: all of them in order, or a bit for each of their values modulo the number of bits."""

    def __init__(self, marks: np.ndarray | None, bits: np.ndarray | None = None):
        self.marks, self.bits = marks, bits

    def has(self, marks: np.ndarray) -> np.ndarray:
        if self.bits is not None:
            at = marks & U64(64 * len(self.bits) - 1)
            return (self.bits[at >> U64(6)] >> (at & U64(63)) & U64(1)).astype(bool)
        if not len(self.marks):
            return np.zeros(len(marks), bool)
        return self.marks[np.minimum(np.searchsorted(self.marks, marks), len(self.marks) - 1)] == marks


def frequent(table: DataFrame, exact: int = EXACT, bits: int = BITS) -> Frequent:
    """The runs of a level's table, in a bounded size."""
    if table.count() <= exact:
        return Frequent(np.sort(table.select("mark").toArrow().column("mark").to_numpy().view(U64)))
    low = table.select(F.col("mark").bitwiseAND((1 << bits) - 1).alias("p"))
    packed = low.groupBy(F.shiftright("p", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(p & 63 as int)))").alias("word"))
    found = packed.toArrow()  # at most 1 << bits - 6 rows
    out = np.zeros(1 << bits - 6, U64)
    out[found.column("at").to_numpy()] = found.column("word").to_numpy().view(U64)
    return Frequent(None, out)


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, word, mark, c) of each slice; the row without a word counts all words of a language."""
    for batch in batches:
        for part in slices(batch, "text", SLICE):
            runs = Runs(part)
            marks, first, counts = np.unique(runs.marks, return_index=True, return_counts=True)
            data, start, end = runs.words.data.tobytes(), runs.words.start[first], runs.words.end[first]
            spelled = [data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
            every = np.bincount(runs.lang, minlength=len(runs.names))
            lang = np.concatenate([runs.lang[first], np.arange(len(every))])
            more = np.zeros(len(every), np.int64)
            yield pa.RecordBatch.from_arrays(
                [runs.names.take(pa.array(lang, pa.int64())).cast(pa.string()), pa.array([*spelled, *[None] * len(every)], pa.binary()), pa.array(np.concatenate([marks.view(np.int64), more])), pa.array(np.concatenate([counts, every]).astype(np.int64))],
                ["lang", "word", "mark", "c"],
            )
    tidy()


def _level(k: int, shared) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(head, tail, c) of each slice, where head and tail are frequent."""
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                runs = Runs(part)
                marks, whole = runs.marks, np.ones(len(runs.marks), bool)
                for j in range(2, k):  # to runs of k - 1 words
                    whole = whole[:-1] & runs.follows[j - 2 :]
                    marks = joined(marks[:-1], marks[1:])
                known = whole & shared.value.has(marks)
                at = np.flatnonzero(known[:-1] & known[1:] & runs.follows[k - 2 :]) if len(known) > 1 else np.zeros(0, np.int64)
                _, first, counts = np.unique(joined(marks[at], marks[at + 1]), return_index=True, return_counts=True)
                at = at[first]
                for lo in range(0, len(at), 1 << 17):
                    some = at[lo : lo + (1 << 17)]
                    yield pa.RecordBatch.from_arrays([pa.array(marks[some].view(np.int64)), pa.array(marks[some + 1].view(np.int64)), pa.array(counts[lo : lo + (1 << 17)].astype(np.int64))], ["head", "tail", "c"])
        tidy()

    return run


def _marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        head, tail = (np.asarray(batch.column(c)).view(U64) for c in ("head", "tail"))
        yield batch.append_column("mark", pa.array(joined(head, tail).view(np.int64)))


def levels(docs: DataFrame, longest: int = 3, least: int = 10, exact: int = EXACT, bits: int = BITS) -> tuple[DataFrame, list[DataFrame]]:
    """Words of each language (lang, n), and a table for each length: runs with at least ``least`` occurrences."""
    read = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    found = read.mapInArrow(_words, "lang string, word binary, mark long, c long").groupBy("lang", "word").agg(F.first("mark").alias("mark"), F.sum("c").alias("c"))
    words = written(found.where(f"c >= {least} OR word IS NULL"), "level1")
    totals = words.where("word IS NULL").select("lang", F.col("c").alias("n"))
    tables = [words.where("word IS NOT NULL").select("lang", F.col("word").cast("string").alias("word"), "mark", "c")]
    for k in range(2, longest + 1):
        shared = docs.sparkSession.sparkContext.broadcast(frequent(tables[-1], exact, bits))
        runs = read.mapInArrow(_level(k, shared), "head long, tail long, c long").groupBy("head", "tail").agg(F.sum("c").alias("c")).where(f"c >= {least}")
        tables.append(written(runs.mapInArrow(_marked, "head long, tail long, c long, mark long"), f"level{k}"))
        shared.destroy()
    return totals, tables


def candidates(tables: list[DataFrame]) -> list[DataFrame]:
    """For each length from 2 on: mark, lang, phrase, last, c, and the counts of its beginnings and ends by length."""
    none = F.array().cast("array<long>")
    below = tables[0].select("mark", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), "c", none.alias("starts"), none.alias("ends"))
    out = []
    for k, table in enumerate(tables[1:], 2):
        heads = below.select(F.col("mark").alias("head"), "lang", F.col("phrase").alias("begin"), F.col("c").alias("hc"), "starts")
        tails = below.select(F.col("mark").alias("tail"), "last", F.col("c").alias("tc"), "ends")
        both = table.join(heads, "head").join(tails, "tail")
        longer = lambda a, c: F.concat(F.col(a), F.array(c))
        below = written(both.select("mark", "lang", F.concat_ws(" ", "begin", "last").alias("phrase"), "last", "c", longer("starts", "hc").alias("starts"), longer("ends", "tc").alias("ends")), f"phrases{k}")
        out.append(below)
    return out


def scored(found: list[DataFrame], tables: list[DataFrame], share: int = 50) -> DataFrame:
    """lang, phrase, a, l, r, score of the candidates that no longer one holds ``share`` % of, by their lowest cut."""
    kept = []
    for k, table in enumerate(found):
        if k + 1 < len(found):  # a candidate in a longer one is also in one of one word more, which is at least as frequent
            above = tables[k + 2]
            most = above.select(F.col("head").alias("mark"), "c").unionByName(above.select(F.col("tail").alias("mark"), "c")).groupBy("mark").agg(F.max("c").alias("most"))
            table = table.join(most, "mark", "left").where(f"most IS NULL OR 100 * most < {share} * c")
        kept.append(table.select("lang", "phrase", F.col("c").alias("a"), "starts", "ends"))
    every = kept[0]
    for table in kept[1:]:
        every = every.unionByName(table)
    wide = lambda c: c.cast("decimal(16,0)")
    million = F.lit(1_000_000).cast("decimal(7,0)")

    def cut(left, k):
        right = F.element_at("ends", (F.size("ends") - k).cast("int"))
        score = F.call_function("div", wide(F.col("a")) * wide(F.col("a")) * million, wide(left) * wide(right))
        return F.struct(score.alias("score"), k.alias("k"), left.alias("l"), right.alias("r"))

    lowest = F.array_min(F.transform("starts", cut))
    return every.select("lang", "phrase", "a", lowest.alias("x")).select("lang", "phrase", "a", "x.l", "x.r", "x.score")


def collocations(docs: DataFrame, longest: int = 3, least: int = 10, share: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first ``top`` of each language."""
    totals, tables = levels(docs, longest, least)
    rows = scored(candidates(tables), tables, share)
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    group = F.pmod(F.xxhash64("phrase"), F.lit(GROUPS))  # a language's first ones are among those of its groups
    some = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", group).orderBy(*order))).where(f"rank <= {top}")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(f"rank <= {top}")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
