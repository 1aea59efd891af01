"""LM scoring: Katz backoff over Good-Turing discounted n-gram counts.

Tokens are words in lower case (A-Z only) and one end per text. For a context h
of k-1 tokens and a token w with training count c(h, w) > 0

    p(w | h) = d(c) c(h, w) / total(h),    else    alpha(h) p(w | h'),

h' being h without its first token; alpha(h) = (1 - sum of p over the tokens
seen after h) / (1 - sum of p(. | h') over the same tokens), so that each
distribution sums to 1 exactly. d(c) is Katz's form of the Good-Turing discount
for c <= 5 and 1 above; where the counts of counts don't allow it, absolute
discounting. total(h) is the count of h, and one more if no token after h has a
discount, so that some mass is always left. At the lowest order the mass left
goes to one unknown word, p(w) = p(unknown) for every unseen w.

Every order has a table of counts, in rows of buckets by context (at order 1 by
word): distinct contexts, the tokens after each and their counts. Counts of each
slice of texts are summed before they are dealt out. Scoring deals out distinct
n-grams of a slice with the texts they stand in, looks them up in the bucket of
the highest order, and hands what was not seen down to the next one, recursively.
Buckets with more than TOKENS_A_PART tokens, where a frequent word is the context, are
counted and scored in parts: n-grams by a hash of the row that they come in, beside the
whole bucket's table in scoring; parts of counts are summed before they meet. Only
counts of counts (a few numbers an order) and the hot buckets' sizes go to the driver.

Tokens are told apart by 56 bits of a fingerprint beside their bucket. A null
text is empty and has one token, the end. The training part is told by the CRC-32
of the id as text (a null id: of "null"). Repeated rows are counted and scored
each. An empty table gives none. A text longer than a slice is a slice of its own and
takes memory in proportion. There are no ties. Only the id (long) and the text are
read, so clashing names cannot arise.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .store import drop, new_path, tidy, write
from .substring import NO_ID, _runs, from_bytes, pack_docs, to_bytes, unpack_docs
from .words import U64, Words, mix64, slices

WIDE = 7  # bytes of a fingerprint
LOW = U64((1 << (8 * WIDE)) - 1)
END, BEGIN = U64(0x5851F42D4C957F), U64(0x14057B7EF76781)
STEP = U64(0xD6E8FEB86659FD93)
CUTOFF = 5
COUNT_ROW = "bucket int, contexts binary, lower binary, follow binary, words binary, counts binary, stats array<bigint>"
SCORE_ROW = "bucket int, kind int, contexts binary, lower binary, follow binary, words binary, times binary, docs binary, owners binary, scores binary, known binary, tokens binary"
COUNTS, GRAMS, ALPHAS = 0, 1, 2
TOKENS_A_BUCKET = 2_500_000
TOKENS_A_PART = 4_500_000
AT_ONCE = 600_000  # tokens that a bucket looks up together
SLICE = 2 << 20


def is_held_out(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"null" if i == NO_ID else str(i).encode()) % 7 == 2 for i in ids.tolist()], bool)


class Tokens:
    """Tokens of a slice of texts: fingerprints, the text of each, and contexts of each order."""

    def __init__(self, batch: pa.RecordBatch):
        words = Words(batch.column("text"), lower=True)
        self.ids = np.array(batch.column("id").fill_null(NO_ID), np.int64)
        self.n = words.n + 1
        self.owner = np.repeat(np.arange(len(self.n)), self.n)
        begin = np.cumsum(self.n) - self.n
        self.token = np.empty(len(self.owner), U64)
        ends = np.zeros(len(self.owner), bool)
        ends[begin + words.n] = True
        self.token[ends] = END
        self.token[~ends] = words.hash() & LOW
        self.first = begin
        self.tags = np.array([zlib.crc32(words.data[a:b]) for a, b in zip(words.at[:-1], words.at[1:], strict=True)], U64)

    def contexts(self, order: int) -> np.ndarray:
        """Fingerprint of the order - 1 tokens before each; the places before a text hold BEGIN."""
        out, place = np.zeros(len(self.token), U64), np.arange(len(self.token)) - self.first[self.owner]
        for back in range(order - 1, 0, -1):
            before = np.concatenate([np.full(back, BEGIN), self.token[:-back]])[: len(out)]
            out = longer(out, np.where(place < back, BEGIN, before))
        return out


def longer(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Fingerprints of contexts with one more token."""
    return mix64(contexts * STEP + words) & LOW


def bucket_of(contexts: np.ndarray, words: np.ndarray, order: int, buckets: int) -> np.ndarray:
    return (mix64(contexts if order > 1 else words) >> U64(32)).astype(np.int64) % buckets


def pair_key(contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
    return mix64(contexts * STEP + words)


def distinct(contexts: np.ndarray, words: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """An order of all pairs that puts equal ones together, where each distinct pair begins in it, how often
    it occurs, and its bucket. Distinct pairs come by bucket and context. ``buckets`` 0: one bucket."""
    key = pair_key(contexts, words) if order > 1 else words
    sort = np.argsort(key)
    key = key[sort]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    times = np.diff(np.append(first, len(sort)))
    one = sort[first]
    c, w = contexts[one], words[one]
    to = bucket_of(c, w, order, buckets) if buckets else np.zeros(len(one), np.int64)
    inner = c if order > 1 else w
    by = np.argsort((to.astype(U64) << U64(56)) | inner) if buckets <= 256 else np.lexsort((inner, to))
    return sort, first[by], times[by], to[by]


class Table:
    """A bucket's counts: contexts (ascending), lower contexts, tokens after each, and the counts."""

    def __init__(self, contexts: bytes, lower: bytes, follow: bytes, words: bytes, counts: bytes):
        self.contexts = from_bytes(contexts, WIDE)
        self.lower = from_bytes(lower, WIDE) if lower else None  # up to order 2
        self.follow = from_bytes(follow, 4).astype(np.int64)
        self.words, self.counts = from_bytes(words, WIDE), from_bytes(counts, 5).astype(np.int64)
        self.row = np.repeat(np.arange(len(self.contexts)), self.follow)
        self.begin = np.cumsum(self.follow) - self.follow

    def probabilities(self, good: Discounts) -> np.ndarray:
        if good.order == 1:
            return good.discount(self.counts) * self.counts / good.total(np.array([good.n]), np.array([good.any_low]))[0]
        total = np.add.reduceat(self.counts, self.begin)
        low = np.minimum.reduceat(self.counts, self.begin) <= CUTOFF
        return good.discount(self.counts) * self.counts / good.total(total, low)[self.row]

    def find(self, contexts: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Places of pairs in the table, -1 if absent."""
        if not hasattr(self, "keys"):
            keys = pair_key(self.contexts[self.row], self.words)
            self.sorted = np.argsort(keys)
            self.keys = keys[self.sorted]
        want = pair_key(contexts, words)
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.sorted[at], -1)

    def find_context(self, contexts: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.contexts, contexts), len(self.contexts) - 1)
        return np.where(self.contexts[at] == contexts, at, -1)


class Discounts:
    """Katz's discounts of one order from its counts of counts; ``stats``: n1 .. n6, pairs, tokens."""

    def __init__(self, order: int, stats: list[int]):
        self.order, self.types, self.n = order, stats[6], stats[7]
        n = [0, *stats[:6]]
        self.any_low = sum(n[1 : CUTOFF + 1]) > 0
        d = np.ones(CUTOFF + 1)
        cut = (CUTOFF + 1) * n[CUTOFF + 1] / n[1] if n[1] else 1.0
        for r in range(1, CUTOFF + 1):
            good = (r + 1) * n[r + 1] / n[r] / r if n[r] else 0.0
            d[r] = (good - cut) / (1 - cut) if cut != 1 else 0.0
        if not all(0 < x < 1 for x in d[1:]):
            less = n[1] / (n[1] + 2 * n[2]) if n[1] and n[2] else 0.5
            d[1:] = 1 - less / np.arange(1, CUTOFF + 1)
        d[0] = 1.0
        self.d = d

    def discount(self, counts: np.ndarray) -> np.ndarray:
        return self.d[np.where(counts > CUTOFF, 0, counts)]

    @staticmethod
    def total(counts: np.ndarray, low: np.ndarray) -> np.ndarray:
        return counts + np.where(low, 0, 1)


class KatzModel:
    """Tables in the shared folder: counts of each order, backoff weights of each order above 1."""

    def __init__(self, spark, order: int = 2, buckets: int = 64, passes: int = 2, part: int = TOKENS_A_PART):
        if order not in (1, 2, 3):  # an n-gram handed down carries its next context only
            raise ValueError("order is 1, 2 or 3")
        self.spark, self.order, self.buckets, self.passes, self.part = spark, order, buckets, passes, part
        self.hot: dict[int, dict[int, int]] = {}  # by order: parts of the buckets that have several
        self.counts: dict[int, list[str]] = {}
        self.alphas: dict[int, str] = {}
        self.good: dict[int, Discounts] = {}
        self.unknown = 1.0

    # counts

    def fit(self, docs: DataFrame) -> KatzModel:
        """docs: id, text; learns from those that are not held out."""
        for order in range(1, self.order + 1):
            self.hot[order] = self._hot(order) if order > 1 else {}
            self.counts[order] = self._count(docs, order)
            if order == 1:
                self.hot[1] = self._hot(1)
            rows = self._counts(order).select(F.posexplode("stats").alias("i", "n"))
            sums = {r["i"]: r["n"] for r in rows.groupBy("i").agg(F.sum("n").alias("n")).collect()}  # eight numbers
            self.good[order] = Discounts(order, [sums.get(i, 0) for i in range(8)])
        one = self.good[1]
        if one.n:
            seen = self._counts(1).mapInArrow(_seen_mass(one), "mass double").agg(F.sum("mass")).first()[0]
            self.unknown = 1.0 - seen
            assert 0 < self.unknown < 1
        for order in range(2, self.order + 1):
            self.alphas[order] = self._weights(order)
        return self

    def _hot(self, order: int) -> dict[int, int]:
        """Parts of the buckets of an order with more than ``part`` tokens. A context comes up as often as it
        was counted at the order below as a context and its token; at order 1 words are what buckets hold."""
        buckets, below, begin = self.buckets, max(1, order - 1), np.zeros(1, U64)
        for _ in range(order - 1):
            begin = longer(begin, BEGIN)

        def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums = np.zeros(buckets, np.int64)
            for batch in batches:
                for parts in zip(*(batch.column(c).to_pylist() for c in ("contexts", "lower", "follow", "words", "counts")), strict=True):
                    t = Table(*parts)
                    context = t.contexts[t.row]
                    if order > 1:
                        context = longer(context if order > 2 else np.zeros(len(t.words), U64), t.words)
                        context[t.words == END] = begin  # as many texts begin as end
                    np.add.at(sums, bucket_of(context, t.words, order, buckets), t.counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets), pa.int32()), pa.array(sums)], ["bucket", "n"])

        rows = self._counts(below).mapInArrow(load, "bucket int, n bigint")
        rows = rows.groupBy("bucket").agg(F.sum("n").alias("n")).where(F.col("n") > self.part).collect()  # n / part at most
        return {r["bucket"]: -(-r["n"] // self.part) for r in rows}

    def _parts(self, order: int) -> Column:
        """Of a row's bucket."""
        if not self.hot[order]:
            return F.lit(1)
        return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in self.hot[order].items() for x in pair]), F.col("bucket")), F.lit(1))

    def _dealt(self, rows: DataFrame, order: int) -> DataFrame:
        """By bucket and ``part``: of a hot bucket each row of n-grams gets one by its hash."""
        own = F.pmod(F.xxhash64("words"), self._parts(order)).cast("int") if self.hot[order] else F.lit(0)
        return rows.withColumn("part", own)

    def _counts(self, order: int) -> DataFrame:
        """The table of an order, a row a bucket."""
        tables = [self.spark.read.schema(f"{COUNT_ROW}, done int").parquet(path) for path in self.counts[order]]
        return reduce(DataFrame.unionByName, tables).where("done = 1").drop("done")

    def _count(self, docs: DataFrame, order: int) -> list[str]:
        buckets = self.buckets

        def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", SLICE):
                    t = Tokens(batch)
                    train = ~is_held_out(t.ids)[t.owner]
                    words, contexts = t.token[train], t.contexts(order)[train]
                    lower = t.contexts(order - 1)[train] if order > 2 else None
                    if len(words):
                        yield from _count_rows(contexts, lower, words, np.ones(len(words), np.int64), order, buckets)

        def summed(key: tuple, table: pa.Table, last: bool) -> pa.Table:
            contexts, lower, words, counts = [], [], [], []
            for k in range(len(table)):  # a row at a time, so that what it is made of goes again
                t = Table(*(table.column(c)[k].as_py() for c in ("contexts", "lower", "follow", "words", "counts")))
                contexts.append(t.contexts[t.row])
                words.append(t.words)
                counts.append(t.counts)
                if order > 2:
                    lower.append(t.lower[t.row])
            contexts, words, counts = np.concatenate(contexts), np.concatenate(words), np.concatenate(counts)
            lower = np.concatenate(lower) if order > 2 else None
            out = pa.Table.from_batches(list(_count_rows(contexts, lower, words, counts, order, 0, int(key[0].as_py()), last)))
            tidy()
            return out

        hot = self.hot[order]

        def merge(key: tuple, table: pa.Table) -> pa.Table:
            last = key[0].as_py() not in hot
            out = summed(key, table, last)
            return out.append_column("done", pa.array([int(last)] * len(out), pa.int32()))

        def finish(key: tuple, table: pa.Table) -> pa.Table:
            out = summed(key, table, True)
            return out.append_column("done", pa.array([1] * len(out), pa.int32()))

        schema = f"{COUNT_ROW}, done int"
        rows = self._dealt(docs.mapInArrow(grams, COUNT_ROW), order).repartition(buckets, "bucket", "part")
        paths = [write(rows.groupBy("bucket", "part").applyInArrow(merge, schema), new_path(self.spark, f"counts_{order}"), by="done")]
        if hot:
            rest = self.spark.read.schema(schema).parquet(*paths).where("done = 0").repartition(buckets, "bucket")
            paths.append(write(rest.groupBy("bucket").applyInArrow(finish, schema), new_path(self.spark, f"counts_{order}"), by="done"))
        return paths

    def _weights(self, order: int) -> str:
        """Backoff weights: sums of lower-order probabilities over the tokens after each context, asked for by bucket of the lower order."""
        buckets, good, below = self.buckets, self.good[order], self.good[order - 1]
        # every pair seen at this order is seen at the lower one, whose weights are so not needed
        ask = "bucket int, kind int, contexts binary, lower binary, follow binary, words binary, counts binary, origin int, refs binary"

        def request(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b, *parts in zip(*(batch.column(c).to_pylist() for c in ("bucket", "contexts", "lower", "follow", "words", "counts")), strict=True):
                    t = Table(*parts)
                    contexts = t.lower[t.row] if order > 2 else np.zeros(len(t.words), U64)
                    to = bucket_of(contexts, t.words, order - 1, buckets)
                    chosen = np.argsort(to, kind="stable")
                    out: dict[str, list] = {k: [] for k in ("bucket", "kind", "contexts", "lower", "follow", "words", "counts", "origin", "refs")}
                    for k, lo, n in zip(*_runs(to[chosen]), strict=True):
                        own = chosen[lo : lo + n]
                        for name, value in (("bucket", int(k)), ("kind", GRAMS), ("contexts", to_bytes(contexts[own], WIDE) if order > 2 else b""), ("words", to_bytes(t.words[own], WIDE)), ("origin", b), ("refs", to_bytes(t.row[own].astype(U64), 4)), ("lower", None), ("follow", None), ("counts", None)):
                            out[name].append(value)
                    yield _as_batch(out, ask)

        def answer(key: tuple, table: pa.Table) -> pa.Table:
            kinds = table.column("kind").to_pylist()
            col = {c: table.column(c).to_pylist() for c in ("contexts", "lower", "follow", "words", "counts", "origin", "refs")}
            out: dict[str, list] = {"bucket": [], "refs": [], "sums": []}
            own = kinds.index(COUNTS)
            t = Table(*(col[c][own] for c in ("contexts", "lower", "follow", "words", "counts")))
            p = t.probabilities(below)
            for i, kind in enumerate(kinds):
                if kind == GRAMS:
                    words = from_bytes(col["words"][i], WIDE)
                    contexts = from_bytes(col["contexts"][i], WIDE) if order > 2 else np.zeros(len(words), U64)
                    value = p[t.find(contexts, words)]
                    refs, first = np.unique(from_bytes(col["refs"][i], 4), return_index=True)  # requests come in order of refs
                    out["bucket"].append(col["origin"][i])
                    out["refs"].append(to_bytes(refs, 4))
                    out["sums"].append(np.add.reduceat(value, first).astype("<f8").tobytes())
            return pa.table({"bucket": pa.array(out["bucket"], pa.int32()), "refs": pa.array(out["refs"], pa.binary()), "sums": pa.array(out["sums"], pa.binary())})

        def weigh(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
            t = Table(*(left.column(c)[0].as_py() for c in ("contexts", "lower", "follow", "words", "counts")))
            sums = np.zeros(len(t.contexts))
            for refs, part in zip(right.column("refs").to_pylist(), right.column("sums").to_pylist(), strict=True):
                sums[from_bytes(refs, 4).astype(np.int64)] += np.frombuffer(part, "<f8")
            seen = np.add.reduceat(t.probabilities(good), t.begin)
            alpha = (1 - seen) / np.maximum(1 - sums, 1e-300)
            return pa.table({"bucket": pa.array([key[0].as_py()], pa.int32()), "alphas": pa.array([alpha.astype("<f8").tobytes()], pa.binary())})

        path = new_path(self.spark, f"alphas_{order}")
        high, low = (self._counts(k).drop("stats") for k in (order, order - 1))
        tables = low.select("bucket", F.lit(COUNTS).alias("kind"), "contexts", "lower", "follow", "words", "counts", F.lit(None).cast("int").alias("origin"), F.lit(None).cast("binary").alias("refs"))
        asked = high.mapInArrow(request, ask).unionByName(tables).repartition(buckets, "bucket").groupBy("bucket").applyInArrow(answer, "bucket int, refs binary, sums binary")
        rows = high.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(weigh, "bucket int, alphas binary")
        return write(rows, path)

    # scores

    def score(self, docs: DataFrame) -> DataFrame:
        """id, held_out, n_tokens, n_known, train_tokens, base_score, score of every text."""
        parts, handed = [], []
        for order in range(self.order, 0, -1):
            # all tokens go through the highest order, in passes over parts of the texts, each of which
            # frees its shuffle before the next; at order 1 what is left and the words alone
            passes = self.passes if order == self.order > 1 else 1
            outs = []
            for k in range(passes):
                path = new_path(self.spark, f"scores_{order}")
                some = docs.where(F.pmod(F.xxhash64("id"), F.lit(passes)) == k) if passes > 1 else docs
                rows = some.mapInArrow(self._grams(order), SCORE_ROW) if order in (self.order, 1) else None
                for more in handed:
                    rows = more if rows is None else rows.unionByName(more)
                tables = self._tables(order).withColumn("part", F.explode(F.sequence(F.lit(0), self._parts(order) - 1)))
                rows = self._dealt(rows, order).unionByName(tables).repartition(self.buckets, "bucket", "part")
                write(rows.groupBy("bucket", "part").applyInArrow(self._look_up(order), SCORE_ROW), path)
                outs.append(self.spark.read.schema(SCORE_ROW).parquet(path))
            handed = [out.where(F.col("kind") == GRAMS) for out in outs]
            parts += [out.where(F.col("kind") == COUNTS) for out in outs]
        sums = parts[0]
        for p in parts[1:]:
            sums = sums.unionByName(p)
        good = self.good[1]
        rows = sums.repartition(self.buckets, "bucket").groupBy("bucket").applyInArrow(_sum_up, "id bigint, n_rows bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double")
        each = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows")))
        rows = rows.withColumn("_row", each).withColumn("train_tokens", F.lit(good.n).cast("long"))
        return rows.select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")

    def drop(self) -> None:
        """Delete the tables; scores that were asked for before stay readable."""
        drop(self.spark, *(path for paths in self.counts.values() for path in paths), *self.alphas.values())

    def _tables(self, order: int) -> DataFrame:
        none = lambda *names: [F.lit(None).cast("binary").alias(n) for n in names]
        read = self._counts(order)
        out = read.select("bucket", F.lit(COUNTS).alias("kind"), "contexts", "lower", "follow", "words", F.col("counts").alias("times"), *none("docs", "owners", "scores", "known", "tokens"))
        if order > 1:
            read = self.spark.read.parquet(self.alphas[order])
            out = out.unionByName(read.select("bucket", F.lit(ALPHAS).alias("kind"), *none("contexts", "lower", "follow", "words", "times", "docs", "owners"), F.col("alphas").alias("scores"), *none("known", "tokens")))
        return out

    def _grams(self, order: int):
        """Distinct n-grams of a slice, each with the texts it stands in. At order 1 under an order above: for the base score and known words only."""
        buckets, top = self.buckets, self.order

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in slices(whole, "text", SLICE):
                    t = Tokens(batch)
                    if len(t.token):
                        lower = t.contexts(order - 1) if order > 2 else None
                        yield from _gram_rows(t.contexts(order), lower, t.token, t.owner, order == top, t.ids, t.tags, order, buckets)

        return run

    def _look_up(self, order: int):
        buckets, good, unknown, top = self.buckets, self.good[order], self.unknown, self.order

        def look_up(key: tuple, table: pa.Table) -> pa.Table:
            kinds = table.column("kind").to_pylist()
            col = {c: table.column(c).to_pylist() for c in ("contexts", "lower", "follow", "words", "times", "docs", "owners", "scores")}
            del table
            t = alphas = None
            if COUNTS in kinds:
                i = kinds.index(COUNTS)
                t = Table(*(col[c][i] for c in ("contexts", "lower", "follow", "words", "times")))
                log_p = np.log10(t.probabilities(good))
            if ALPHAS in kinds:
                alphas = np.log10(np.frombuffer(col["scores"][kinds.index(ALPHAS)], "<f8"))
            batches = []
            rows = [[col[c][i] for c in ("contexts", "lower", "follow", "words", "times", "docs", "owners", "scores")] for i, kind in enumerate(kinds) if kind == GRAMS]
            for weight in (b"1", b"0"):
                mine = [r for r in rows if r[-1] == weight]
                for lo, hi in _portions([len(r[6]) // 4 for r in mine], AT_ONCE):
                    g = Grams(mine[lo:hi])
                    at = t.find(g.contexts, g.words) if t is not None else np.full(len(g.words), -1)
                    seen = at >= 0
                    value = np.zeros(len(g.words))
                    value[seen] = log_p[at[seen]] if t is not None else 0.0
                    base = known = None
                    if order == 1:
                        value[~seen] = np.log10(unknown)
                        if weight == b"0" or top == 1:  # rows of all tokens of their texts
                            counts = np.zeros(len(g.words), np.int64)
                            counts[seen] = t.counts[at[seen]] if t is not None else 0
                            base = np.log10((counts + 1) / (good.n + good.types + 1))
                            known = (counts > 0).astype(np.float64)
                    elif alphas is not None and not seen.all():
                        rest = np.flatnonzero(~seen)
                        row = t.find_context(g.contexts[rest])
                        value[rest] = np.where(row >= 0, alphas[row], 0.0)
                    batches.append(_partial_sums(g, value if weight == b"1" else None, base, known, buckets))
                    if order > 1 and not seen.all():
                        each = np.repeat(np.arange(len(g.words)), g.times)
                        tokens = np.flatnonzero(~seen[each])
                        gram = each[tokens]
                        below = g.lower[gram] if order > 2 else np.zeros(len(gram), U64)
                        batches += list(_gram_rows(below, None, g.words[gram], g.owners[tokens], True, g.ids, g.tags, order - 1, buckets))
            tidy()
            return pa.Table.from_batches(batches, schema=_arrow_schema(SCORE_ROW))

        return look_up


class Grams:
    """Rows of distinct n-grams put together: pairs with their lower contexts, how often each occurs, the text of each token."""

    def __init__(self, rows: list[list[bytes]]):
        parts: list[list[np.ndarray]] = [[] for _ in range(7)]
        base = 0
        for contexts, lower, follow, words, times, docs, owners, _ in rows:
            n = from_bytes(follow, 4).astype(np.int64)
            ids, tags, _ = unpack_docs(docs)
            below = np.repeat(from_bytes(lower, WIDE), n) if lower else np.zeros(0, U64)
            own = (np.repeat(from_bytes(contexts, WIDE), n), below, from_bytes(words, WIDE), from_bytes(times, 4).astype(np.int64), ids, tags, from_bytes(owners, 4).astype(np.int64) + base)
            for part, x in zip(parts, own, strict=True):
                part.append(x)
            base += len(ids)
        self.contexts, self.lower, self.words, self.times, self.ids, self.tags, self.owners = (np.concatenate(p) for p in parts)


def _portions(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Consecutive rows of about ``most`` tokens."""
    lo, size = 0, 0
    for k, n in enumerate(sizes):
        size += n
        if size >= most or k == len(sizes) - 1:
            yield lo, k + 1
            lo, size = k + 1, 0


def _arrow_schema(ddl: str) -> pa.Schema:
    kinds = {"int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(), "array<bigint>": pa.list_(pa.int64())}
    return pa.schema([(n, kinds[k]) for n, k in (x.split(" ") for x in ddl.split(", "))])


def _as_batch(out: dict[str, list], ddl: str) -> pa.RecordBatch:
    schema = _arrow_schema(ddl)
    n = len(next(iter(out.values())))
    return pa.RecordBatch.from_arrays([pa.array(out.get(f.name, [None] * n), f.type) for f in schema], schema=schema)


def _seen_mass(good: Discounts):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("contexts", "lower", "follow", "words", "counts")), strict=True)
            yield pa.RecordBatch.from_arrays([pa.array([float(Table(*r).probabilities(good).sum()) for r in rows])], ["mass"])

    return run


def _count_rows(contexts, lower, words, counts, order: int, buckets: int, bucket: int = 0, last: bool = False) -> Iterator[pa.RecordBatch]:
    """Summed counts as one row per bucket; ``buckets`` 0: all of this ``bucket``; ``last``: with counts of counts."""
    sort, first, times, to = distinct(contexts, words, order, buckets)
    sums = np.concatenate([[0], np.cumsum(counts[sort])])
    counts, own = sums[first + times] - sums[first], sort[first]
    contexts, lower, words = contexts[own], lower[own] if order > 2 else None, words[own]
    out: dict[str, list] = {k: [] for k in ("bucket", "contexts", "lower", "follow", "words", "counts", "stats")}
    for b, lo, n in zip(*_runs(to), strict=True):
        i = slice(lo, lo + n)
        c = contexts[i]
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        out["bucket"].append(int(b) if buckets else bucket)
        out["contexts"].append(to_bytes(c[begin], WIDE))
        out["lower"].append(to_bytes(lower[i][begin], WIDE) if order > 2 else b"")
        out["follow"].append(to_bytes(np.diff(np.append(begin, n)).astype(U64), 4))
        out["words"].append(to_bytes(words[i], WIDE))
        out["counts"].append(to_bytes(counts[i].astype(U64), 5))
        out["stats"].append(None if not last else [*(int((counts == r).sum()) for r in range(1, 7)), len(counts), int(counts.sum())])
    yield _as_batch(out, COUNT_ROW)


def _gram_rows(contexts, lower, words, owner, weight: bool, ids, tags, order: int, buckets: int) -> Iterator[pa.RecordBatch]:
    sort, first, times, to = distinct(contexts, words, order, buckets)
    tokens = sort[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first, times)]
    own, owner = sort[first], owner[tokens]
    contexts, lower, words = contexts[own], lower[own] if order > 2 else None, words[own]
    ends = np.concatenate([[0], np.cumsum(times)])
    out: dict[str, list] = {k: [] for k in ("bucket", "kind", "contexts", "lower", "follow", "words", "times", "docs", "owners", "scores")}
    for b, lo, n in zip(*_runs(to), strict=True):
        i = slice(lo, lo + n)
        c, o = contexts[i], owner[ends[lo] : ends[lo + n]]
        begin = np.flatnonzero(np.concatenate([[True], c[1:] != c[:-1]]))
        here = np.bincount(o, minlength=len(ids))
        texts = np.flatnonzero(here)
        place = np.zeros(len(ids), np.int64)
        place[texts] = np.arange(len(texts))
        out["bucket"].append(int(b))
        out["kind"].append(GRAMS)
        out["contexts"].append(to_bytes(c[begin], WIDE))
        out["lower"].append(to_bytes(lower[i][begin], WIDE) if order > 2 else b"")
        out["follow"].append(to_bytes(np.diff(np.append(begin, n)).astype(U64), 4))
        out["words"].append(to_bytes(words[i], WIDE))
        out["times"].append(to_bytes(times[i].astype(U64), 4))
        out["docs"].append(pack_docs(ids[texts], tags[texts], here[texts]))
        out["owners"].append(to_bytes(place[o].astype(U64), 4))
        out["scores"].append(b"1" if weight else b"0")
    yield _as_batch(out, SCORE_ROW)


def _partial_sums(g: Grams, value, base, known, buckets: int) -> pa.RecordBatch:
    """Sums over each text of the rows, dealt by text; kind COUNTS marks them. With ``base`` the rows stand for all tokens."""
    each, n = np.repeat(np.arange(len(g.words)), g.times), len(g.ids)
    score = np.bincount(g.owners, value[each], n) if value is not None else np.zeros(n)
    whole = base is not None
    sums = np.stack([score, np.bincount(g.owners, base[each], n) if whole else np.zeros(n)])
    none = np.zeros(n, np.int64)
    seen = np.bincount(g.owners, known[each], n) if whole else none
    tokens = np.bincount(g.owners, minlength=n) if whole else none
    ends = np.bincount(g.owners[g.words[each] == END], minlength=n) if whole else none
    # a text may come in several rows, which _sum_up puts together
    shard = (g.ids % buckets).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
    order = np.argsort(shard, kind="stable")
    sums, seen, tokens, ends, ids, tags, shard = sums[:, order], seen[order], tokens[order], ends[order], g.ids[order], g.tags[order], shard[order].astype(np.int64)
    out: dict[str, list] = {k: [] for k in ("bucket", "kind", "docs", "times", "scores", "known", "tokens")}
    for b, lo, k in zip(*_runs(shard), strict=True):
        own = slice(lo, lo + k)
        out["bucket"].append(int(b))
        out["kind"].append(COUNTS)
        out["docs"].append(pack_docs(ids[own], tags[own], np.ones(k, np.int64)))
        out["times"].append(to_bytes(ends[own].astype(U64), 4))
        out["scores"].append(np.ascontiguousarray(sums[:, own]).astype("<f8").tobytes())
        out["known"].append(to_bytes(seen[own].astype(U64), 4))
        out["tokens"].append(to_bytes(tokens[own].astype(U64), 4))
    return _as_batch(out, SCORE_ROW)


def _sum_up(key: tuple, table: pa.Table) -> pa.Table:
    """Sums of each text. Every row has one END, so repeated rows, whose sums come together, are counted by it."""
    ids, tags, sums, rest = [], [], [], []
    for d, s, *more in zip(*(table.column(c).to_pylist() for c in ("docs", "scores", "times", "tokens", "known")), strict=True):
        i, tag, _ = unpack_docs(d)
        ids.append(i)
        tags.append(tag)
        sums.append(np.frombuffer(s, "<f8").reshape(2, -1))
        rest.append(np.stack([from_bytes(x, 4).astype(np.int64) for x in more]))
    ids, tags = np.concatenate(ids), np.concatenate(tags)
    order = np.lexsort((tags, ids))
    first = np.flatnonzero(np.concatenate([[True], (np.diff(ids[order]) != 0) | (np.diff(tags[order]) != 0)]))
    own = ids[order][first]
    scores, base = np.add.reduceat(np.concatenate(sums, axis=1)[:, order], first, axis=1)
    rows, tokens, known = np.add.reduceat(np.concatenate(rest, axis=1)[:, order], first, axis=1)
    return pa.table({"id": own, "n_rows": rows, "held_out": is_held_out(own), "n_tokens": tokens // rows, "n_known": known // rows, "base_score": base / rows, "score": scores / rows})


def scored(docs: DataFrame, order: int = 2, buckets: int | None = None, part: int = TOKENS_A_PART) -> DataFrame:
    """A model of the training part of all documents, and the score of every one."""
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("id"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    if buckets is None:
        size, buckets = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0, 8
        while buckets * TOKENS_A_BUCKET * 6 < size:  # about 6 bytes a word
            buckets *= 2
    model = KatzModel(spark, order, buckets, part=part).fit(given)
    out = model.score(given)
    model.drop()
    return out
