"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

Five-word shingles weigh term frequency times inverse document frequency, in the
damped form 1 + SPREAD * ln(1 / f) / ln(1 / FLOOR) with f the share of documents that
hold the shingle: 1 for one that all hold, 1.5 for rare ones. Damped, because in a
large group of near copies the shared shingles are the frequent ones. Shares come from a table
of COUNTERS counters over all documents, whose error is a fixed share of the corpus
at any size (shingles of a text / COUNTERS, about FLOOR) and whose size does not
grow. Equal texts count as one document between them: a text with n copies counts
1 / n for each, n from a table of as many counters over hashes of the texts.

1. Each text gets ``bands`` x ``rows`` consistent weighted samples (Ioffe 2010).
   r, c and beta of a shingle and a sample come from its fingerprint; samples are
   pairs of shingle and level.
2. Texts that agree in all samples of a band are a group of candidates; groups
   with the same members are one.
3. In each group weighted Jaccard similarities are computed; texts that reach
   ``threshold`` are joined, and a pair already joined is not compared. Groups of
   more than ``chunk`` texts or ``most`` shingles are split, and the same pivots, the
   texts with most candidates of each of ``pivots`` hash classes, stand in every part.
   That joins most of a group; then its texts are dealt into blocks by the component
   they are in so far, and all pairs of blocks are compared but those within one
   component, so that no pair of two components is left out. Two turns, whatever the
   size of a group. A group of more than ``wide`` blocks is first told apart by rare
   shingles: with shingles in order of their frequency, two texts that reach the
   threshold share one among the rarest of each that are more than 1 - ``threshold``
   of its weight, so only texts with such a shingle in common are dealt into blocks.
   Where that sends more texts than pairs of blocks would, the group is left whole.
4. Components of the verified links are the classes.

Equal word sequences are one text from the start, so copies cost one text. A
text of 1 to 4 words is one shingle; one without words (null, empty) stands
alone. Repeated rows share their class. An empty table gives none. Texts are read
in slices of about 1 MB; a longer one is a slice of its own, and takes memory in
proportion. Ties cannot arise but between samples of equal value, of which the
least shingle is taken. Only the id and the text are read; other columns, of any
name, are passed on by ``deduplicated`` and not read by ``classes``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import small, components
from .store import drop, tidy, written
from .substring import from_bytes, to_bytes
from .words import U64, Words, mix64, random_u64, slices, windows

SHINGLE = 5
COUNTERS = 1 << 21
PARTS = 64
FLOOR = 2.0**-12
SPREAD = 0.5
ONE = 1 << 16  # a document without copies, in the counters
POOL = 1 << 16
ID_BITS = U64(44)
ID_MASK = U64((1 << 44) - 1)
BODY = "text_id bigint, ids binary, often binary"


class Shingled:
    """Distinct shingles of each text of a column: ids (44 bits), times, and the first of each text."""

    def __init__(self, column: pa.Array, shingle: int = SHINGLE):
        words = Words(column)
        hashes = words.hash()
        ids, at = windows(hashes, words.doc, shingle)
        owner = np.searchsorted(words.doc, at, "right") - 1
        short = np.flatnonzero((words.n > 0) & (words.n < shingle))
        if short.size:
            extra = np.array([self._one(hashes[words.doc[i] : words.doc[i + 1]]) for i in short], U64)
            ids, owner = np.concatenate([ids, extra]), np.concatenate([owner, short])
        key = np.sort((owner.astype(U64) << ID_BITS) | (ids >> U64(20)))
        first = np.ones(len(key), bool)
        first[1:] = key[1:] != key[:-1]
        start = np.flatnonzero(first)
        self.ids = key[start] & ID_MASK
        self.times = np.diff(np.append(start, len(key)))
        self.n_texts = len(words.n)
        self.at = np.searchsorted(key[start] >> ID_BITS, np.arange(self.n_texts + 1, dtype=U64))
        # whole word sequences: sums of words mixed with their places
        place = np.arange(len(hashes)) - np.repeat(words.doc[:-1], words.n)
        sums = np.zeros(len(hashes) + 1, U64)
        np.cumsum(mix64(hashes ^ (place.astype(U64) * U64(0x9E3779B97F4A7C15))), out=sums[1:])
        whole = mix64((sums[words.doc[1:]] - sums[words.doc[:-1]]) ^ words.n.astype(U64))
        self.text_id = (whole >> U64(1)).astype(np.int64)
        self.empty = words.n == 0

    @staticmethod
    def _one(hashes: np.ndarray) -> np.uint64:
        return windows(hashes, np.array([0, len(hashes)]), len(hashes))[0][0]


def summed(docs: DataFrame, add_up, n: int) -> np.ndarray:
    """Sums over all tasks of the ``n`` numbers that ``add_up(sums, batch)`` adds to. They travel as PARTS arrays a task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = None
        for batch in batches:
            sums = np.zeros(n, np.int64) if sums is None else sums
            add_up(sums, batch)
        if sums is not None:
            for part, own in enumerate(np.array_split(sums, PARTS)):
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([to_bytes(own, 8)], pa.binary())], ["part", "sums"])
        tidy()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, own in zip(batch.column("part").to_pylist(), batch.column("sums"), strict=True):
                own = from_bytes(own.as_py(), 8)
                sums[part] = sums[part] + own if part in sums else own
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([to_bytes(v, 8) for v in sums.values()], pa.binary())], ["part", "sums"])

    schema = "part int, sums binary"
    rows = docs.mapInArrow(count, schema).repartition(PARTS, "part").mapInArrow(add, schema).collect()  # PARTS rows of fixed size
    have = {r["part"]: from_bytes(bytes(r["sums"]), 8).astype(np.int64) for r in rows}
    return np.concatenate([have[k] for k in range(PARTS)]) if have else np.zeros(n, np.int64)


def copies(given: DataFrame) -> np.ndarray:
    """Rows per counter, told by the hash of the whole text."""

    def add_up(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        sums += np.bincount(np.array(batch.column("mark"), np.int64) % COUNTERS, minlength=COUNTERS)

    return summed(given.select(F.coalesce("mark", F.lit(0)).alias("mark")), add_up, COUNTERS)


def counters(given: DataFrame) -> tuple[np.ndarray, int]:
    """Documents per counter, and documents with a shingle, both times ONE; ``given``: text and mark, a hash of it."""
    alike = given.sparkSession.sparkContext.broadcast(np.minimum(copies(given), ONE).astype(np.int32))  # COUNTERS numbers

    def add_up(sums: np.ndarray, whole: pa.RecordBatch) -> None:
        for batch in slices(whole, "text"):
            s = Shingled(batch.column("text"))
            share = ONE // np.maximum(alike.value[np.array(batch.column("mark").fill_null(0), np.int64) % COUNTERS], 1)
            np.add.at(sums, (s.ids % U64(COUNTERS)).astype(np.int64), np.repeat(share, np.diff(s.at)))
            sums[COUNTERS] += int(share[~s.empty].sum())

    sums = summed(given.select("text", "mark"), add_up, COUNTERS + 1)
    alike.unpersist()
    return sums[:COUNTERS], int(sums[COUNTERS])


def idf(counts: np.ndarray, n: int) -> np.ndarray:
    share = np.clip(counts / max(n, 1), FLOOR, 1)
    return (1 + SPREAD * np.log(1 / share) / np.log(1 / FLOOR)).astype(np.float32)


@lru_cache(1)
def gammas(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """POOL draws of Gamma(2, 1), and the logarithms of POOL others."""
    u = ((random_u64(4 * POOL, seed) >> U64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    u = u.reshape(4, POOL)
    return (-np.log(u[0] * u[1])).astype(np.float32), np.log(-np.log(u[2] * u[3])).astype(np.float32)


def band_keys(s: Shingled, weights: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[text, band]: a fingerprint of the band's samples; texts without shingles get 0.

    For each sample the shingle's fingerprint is hashed to 16 bits that pick r, 16 that pick c and 32 for beta.
    """
    r, log_c = gammas()
    out = np.zeros((s.n_texts, bands), U64)
    have = np.flatnonzero(np.diff(s.at))
    if not have.size:
        return out.view(np.int64)
    begin, sizes = s.at[have], np.diff(s.at)[have]
    log_w = np.log(s.times.astype(np.float32) * weights[(s.ids % U64(COUNTERS)).astype(np.int64)])
    odd = random_u64(bands * rows, 23) | U64(1)
    for k in range(bands * rows):
        h = s.ids * odd[k]
        h ^= h >> U64(32)
        h *= U64(0xD6E8FEB86659FD93)
        bits = h.view(np.uint16).reshape(-1, 4)  # the order of the bytes only says which bits are which
        rk = r[bits[:, 3]]
        beta = h.astype(np.uint32).astype(np.float32) * np.float32(2.0**-32)
        level = np.floor(log_w / rk + beta)
        value = log_c[bits[:, 2]] - rk * (level - beta + np.float32(1))
        least = np.minimum.reduceat(value, begin)
        hit = np.flatnonzero(value == np.repeat(least, sizes))
        pick = hit[np.searchsorted(hit, begin)]
        sample = mix64(s.ids[pick] * U64(0x9E3779B97F4A7C15) + level[pick].astype(np.int64).astype(U64))
        out[have, k // rows] = mix64(out[have, k // rows] * U64(0xD6E8FEB86659FD93) + sample + U64(k + 1))
    return out.view(np.int64)


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray, float], b: tuple[np.ndarray, np.ndarray, float]) -> float:
    """Of two texts as (sorted ids, weights, sum of weights)."""
    if len(a[0]) > len(b[0]):
        a, b = b, a
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    same = b[0][at] == a[0]
    shared = float(np.minimum(a[1][same], b[1][at[same]]).sum())
    return shared / (a[2] + b[2] - shared)


def unpacked(table: pa.Table) -> list[tuple[np.ndarray, np.ndarray]]:
    """Shingles and times of each text."""
    out = []
    for body, often in zip(table.column("ids").to_pylist(), table.column("often").to_pylist(), strict=True):
        own = np.frombuffer(body, U64)
        times = np.ones(len(own), np.float32)
        at, more = np.frombuffer(often, "<u4").reshape(2, -1)
        times[at] = more
        out.append((own, times))
    return out


def reaching(a: list, b: list, weights: np.ndarray, threshold: float, columns: int = 2048) -> np.ndarray:
    """[text of a, text of b]: whether the weighted Jaccard similarity reaches the threshold.

    A shingle that a text holds t times is t columns, so shared weights are products of matrices.
    """
    keys, w = [], []
    for ids, times in [*a, *b]:
        n = times.astype(np.int64)
        level = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        keys.append(mix64(np.repeat(ids, n) + level.astype(U64) * U64(0x9E3779B97F4A7C15)))
        w.append(np.repeat(weights[(ids % U64(COUNTERS)).astype(np.int64)], n).astype(np.float64))
    owner = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    w = np.concatenate(w)
    total = np.bincount(owner, w, len(keys))
    column = np.unique(np.concatenate(keys), return_inverse=True)[1]
    first = owner < len(a)
    common = (np.bincount(column[first], minlength=column.max() + 1) > 0) & (np.bincount(column[~first], minlength=column.max() + 1) > 0)
    keep = np.flatnonzero(common[column])
    keep = keep[np.argsort(column[keep], kind="stable")]
    owner, w, first, column = owner[keep], w[keep], first[keep], (np.cumsum(common) - 1)[column[keep]]
    shared = np.zeros((len(a), len(b)))
    for lo in range(0, int(common.sum()), columns):
        at, to = np.searchsorted(column, [lo, lo + columns])
        x, y, f = np.zeros((len(a), columns)), np.zeros((len(b), columns)), first[at:to]
        x[owner[at:to][f], column[at:to][f] - lo] = w[at:to][f]
        y[owner[at:to][~f] - len(a), column[at:to][~f] - lo] = 1
        shared += x @ y.T
    return shared / (total[: len(a), None] + total[len(a) :] - shared) >= threshold


def join_up(texts: list[tuple[np.ndarray, np.ndarray, float]], threshold: float) -> list[int]:
    """For each text the first of its class; pairs of one class already are not compared."""
    root = list(range(len(texts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    members: dict[int, list[int]] = {}
    for x in range(len(texts)):
        members[x] = [x]
        for other in [k for k in members if k != x]:
            for y in members[other]:
                small, large = sorted((texts[x][2], texts[y][2]))
                if small >= threshold * large and weighted_jaccard(texts[x], texts[y]) >= threshold:
                    a, b = sorted((find(x), other))
                    root[b] = a
                    members[a] += members.pop(b)
                    break
    return [find(x) for x in range(len(texts))]


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """id, class_id (the least id of the class), text_id: one row per document."""
    made = _rooted(docs, id_col, text_col, **parameters)
    shared = made.where("root is not null").groupBy("root").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n"))
    named = small(written(shared.where("n > 1").select("root", "least"), "named"))
    # a class of one row is named by its own id
    out = made.join(named.withColumn("known", F.lit(True)), "root", "left")
    return out.select(F.col("id").alias(id_col), F.when(F.col("known"), F.col("least")).otherwise(F.col("id")).alias("class_id"), "text_id")


def _rooted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.8, bands: int = 10, rows: int = 4, chunk: int = 256, pivots: int = 32, most: int = 1 << 20, wide: int = 16) -> DataFrame:
    """id, mark (a hash of the text as given), text_id, root (one of each class; null without words): one row per document."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), F.xxhash64(text_col).alias("mark"))
    weights = spark.sparkContext.broadcast(idf(*counters(given)))  # COUNTERS floats

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                s = Shingled(batch.column("text"))
                keys = band_keys(s, weights.value, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands), pa.int32()), pa.array(keys.ravel()))
                sizes = pa.array(np.diff(s.at).astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("mark"), pa.array(s.text_id, mask=s.empty), sizes, lists], ["id", "mark", "text_id", "n", "keys"])
        tidy()

    signed = written(given.mapInArrow(sign, f"id {kind}, mark bigint, text_id bigint, n bigint, keys array<bigint>"), "signed")
    # rows of one text_id are alike but for the id and the mark; any of them may stand for the text
    texts = signed.where("text_id is not null").groupBy("text_id").agg(F.min(F.struct("mark", "id")).alias("owner"), F.first("n").alias("n"), F.first("keys").alias("keys"))
    keyed = texts.select("text_id", "owner", "n", F.posexplode("keys").alias("band", "key"))
    member = F.xxhash64("text_id")
    groups = keyed.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size"), F.sum("n").alias("shingles"), F.bit_xor(member).alias("x"), F.min("text_id").alias("lo"), F.max("text_id").alias("hi")).where("size > 1")
    parts = F.greatest(F.ceil(F.col("size") / chunk), F.ceil(F.col("shingles") / most)).cast("int")
    groups = groups.groupBy(F.xxhash64("size", "x", "lo", "hi").alias("grp")).agg(F.min(F.struct("band", "key")).alias("at"), F.min("size").alias("size"), F.min("shingles").alias("shingles"))
    groups = written(groups.select("grp", "size", parts.alias("parts"), "at.band", "at.key"), "bands")
    members = written(keyed.join(small(groups), ["band", "key"]).select("grp", "text_id", "owner", "n", "size", "parts"), "groups")
    links = _verified(given, members, weights, threshold, pivots, chunk // 2, most // 2, wide)
    roots = components(links).withColumnRenamed("id", "text_id")
    drop(spark, groups, members, links)
    return signed.select("id", "mark", "text_id").join(small(roots), "text_id", "left").withColumn("root", F.coalesce("root", "text_id"))


def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text_id, ids (sorted), often (place and times of those that occur more than once) of the texts of each slice."""
    for whole in batches:
        for batch in slices(whole, "text"):
            s = Shingled(batch.column("text"))
            once = np.unique(s.text_id, return_index=True)[1]
            once = once[~s.empty[once]]
            bodies = [(s.ids[s.at[i] : s.at[i + 1]].tobytes(), s.times[s.at[i] : s.at[i + 1]].astype("<u4")) for i in once]
            # most shingles occur once: those that do not are told by place and times
            often = [np.stack([f := np.flatnonzero(t > 1), t[f]]).astype("<u4").tobytes() for _, t in bodies]
            yield pa.RecordBatch.from_arrays([pa.array(s.text_id[once]), pa.array([b for b, _ in bodies], pa.binary()), pa.array(often, pa.binary())], ["text_id", "ids", "often"])
    tidy()


def _verified(given: DataFrame, groups: DataFrame, weights, threshold: float, pivots: int, block: int, most: int, wide: int) -> DataFrame:
    """Links (a, b) between texts of a group that reach the threshold, enough to connect all that are linked."""

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("pivot", "descending"), ("text_id", "ascending")])
        ids = np.array(table.column("text_id"), np.int64)
        texts = []
        for own, times in unpacked(table):
            w = times * weights.value[(own % U64(COUNTERS)).astype(np.int64)]
            texts.append((own, w, float(w.sum(dtype=np.float64))))
        return pa.table({"a": ids, "b": ids[np.array(join_up(texts, threshold), np.int64)]})

    wanted = small(written(groups.select("text_id", "owner.mark", "owner.id").dropDuplicates(["text_id"]).select("mark", "id").distinct(), "wanted"))
    wanted = wanted.withColumnRenamed("mark", "own_mark").withColumnRenamed("id", "own_id")
    texts = given.join(wanted, F.col("mark").eqNullSafe(F.col("own_mark")) & F.col("id").eqNullSafe(F.col("own_id"))).select("text")
    bodies = written(texts.mapInArrow(shingles, BODY).dropDuplicates(["text_id"]), "shingles")
    own = F.pmod(F.xxhash64(F.lit(0), "text_id"), F.col("parts")).cast("int")
    split = groups.select("grp", own.alias("part"), "text_id", F.lit(False).alias("pivot"))
    large = groups.where("parts > 1").select("grp", "text_id", "n", "size", "parts")
    some = not large.isEmpty()
    if some:
        often = groups.groupBy("text_id").agg(F.sum("size").alias("candidates"))
        classed = large.join(often, "text_id").groupBy("grp", F.pmod(F.xxhash64("text_id", F.lit(2)), F.lit(pivots)).alias("class"))
        chosen = classed.agg(F.max(F.struct("candidates", "text_id")).alias("best"), F.first("parts").alias("parts"))
        split = split.union(chosen.select("grp", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "best.text_id", F.lit(True)))
    split = written(split, "parts")
    found = bodies.join(small(split), "text_id").select("grp", "part", "text_id", "ids", "often", "pivot")
    links = written(found.groupBy("grp", "part").applyInArrow(verify, "a bigint, b bigint").where("a != b"), "links")
    out = _across(bodies, large, links, weights, threshold, block, most, wide) if some else links
    drop(given.sparkSession, bodies, split, *([links] if some else []))
    return out


def _rare(bodies: DataFrame, groups: DataFrame, weights, threshold: float) -> DataFrame:
    """unit, grp, text_id, n, root: texts of a group that share a rare shingle (a unit) and are in different components, as a written table.

    ``groups``: grp, text_id, n, root. Frequencies are counters over these texts; any order would do, this one makes units small.
    """
    spark = bodies.sparkSession
    own = bodies.join(small(written(groups.select("text_id").distinct(), "wide")), "text_id")

    def add_up(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        for body in batch.column("ids"):
            np.add.at(sums, (np.frombuffer(body.as_py(), U64) % U64(COUNTERS)).astype(np.int64), 1)

    held = np.minimum(summed(own.select("ids"), add_up, COUNTERS), (1 << 31) - 1).astype(np.int32)
    held = spark.sparkContext.broadcast(held)  # COUNTERS numbers

    def rarest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, of = [np.zeros(0, np.int64)], []
            for text, (ids, times) in zip(batch.column("text_id").to_pylist(), unpacked(pa.Table.from_batches([batch])), strict=True):
                counter = (ids % U64(COUNTERS)).astype(np.int64)
                order = np.lexsort((ids, held.value[counter]))
                w = (times * weights.value[counter]).astype(np.float64)[order]
                rest = np.cumsum(w[::-1])[::-1]  # the weight of a shingle and all that are more frequent
                order = order[rest >= threshold * rest[0] * (1 - 1e-9)]
                out.append(ids[order[held.value[counter[order]] > 1]].astype(np.int64))  # others are in one text
                of.append(np.full(len(out[-1]), text, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([out[0], *of])), pa.array(np.concatenate(out))], ["text_id", "shingle"])
        tidy()

    rare = own.mapInArrow(rarest, "text_id bigint, shingle bigint").join(groups, "text_id")
    rare = written(rare.select("grp", "shingle", "text_id", "n", "root"), "rare")
    held.unpersist()
    sets = rare.groupBy("grp", "shingle").agg(F.count(F.lit(1)).alias("size"), F.bit_xor(F.xxhash64("text_id")).alias("x"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    once = sets.where("lo < hi").groupBy("grp", "size", "x", "lo", "hi").agg(F.min("shingle").alias("shingle"))
    once = written(once.select("grp", "shingle"), "once")
    out = written(rare.join(small(once), ["grp", "shingle"]).select(F.xxhash64("grp", "shingle").alias("unit"), "grp", "text_id", "n", "root"), "units")
    drop(spark, rare, once)
    return out


def _filled(units: DataFrame, size: int, most: int) -> DataFrame:
    """unit, root, fill, small, blocks, texts: components of each unit that has more than one, with what is to be dealt.

    ``fill`` is a component's number of blocks, ``small`` that of all components below one block, ``blocks`` that of the unit.
    """
    per = units.groupBy("unit", "root").agg(F.count(F.lit(1)).alias("texts"), F.greatest(F.count(F.lit(1)) / size, F.sum("n") / most).alias("fill"))
    low, high = F.sum(F.when(F.col("fill") < 1, F.col("fill"))), F.sum(F.when(F.col("fill") >= 1, F.ceil("fill")))
    blocks = F.coalesce(F.ceil(low), F.lit(0)) + F.coalesce(high, F.lit(0))
    whole = per.groupBy("unit").agg(F.count(F.lit(1)).alias("classes"), low.alias("small"), blocks.alias("blocks"), F.sum("texts").alias("texts")).where("classes > 1")
    return per.drop("texts").join(whole.drop("classes"), "unit")


def _tasks(bodies: DataFrame, now: DataFrame, weights, threshold: float, size: int, most: int, wide: int) -> DataFrame:
    """task, unit, side, text_id, root: what is to be compared, side 0 with side 1 or, where there is none, within; a written table.

    ``now``: grp, text_id, n, root. Units of one block share tasks.
    """
    spark = bodies.sparkSession
    units = now.withColumn("unit", F.col("grp"))
    per = written(_filled(units, size, most), "components")
    whole = per.select("unit", "blocks", "texts").distinct()
    large = whole.where(F.col("blocks") > wide)
    if not large.isEmpty():
        some = written(now.join(small(written(large.select(F.col("unit").alias("grp")), "wide")), "grp"), "wide")
        rare = _rare(bodies, some, weights, threshold)
        told = _filled(rare, size, most).select("unit", "blocks", "texts").distinct()
        told = told.join(rare.select("unit", "grp").distinct(), "unit").groupBy("grp").agg(F.sum(F.col("blocks") * F.col("texts")).alias("sent"))
        cheaper = large.join(told, large["unit"] == told["grp"], "left").where(F.coalesce("sent", F.lit(0)) < F.col("blocks") * large["texts"])
        cheaper = small(written(cheaper.select(large["unit"].alias("grp")), "cheaper"))
        units = written(units.join(cheaper, "grp", "left_anti").select("unit", "text_id", "n", "root").union(rare.join(cheaper, "grp").select("unit", "text_id", "n", "root")), "units")
        drop(spark, per, some, rare)
        per = written(_filled(units, size, most), "components")
    single = per.where("blocks = 1").agg(F.sum("fill")).first()[0] or 0
    pure = F.col("fill") >= 1
    deal = F.pmod(F.xxhash64("text_id", F.lit(1)), F.ceil(F.when(pure, F.col("fill")).otherwise(F.col("small"))))
    block = F.struct(pure.alias("pure"), F.when(pure, F.col("root")).otherwise(0).alias("of"), deal.alias("k"))
    dealt = written(units.join(small(per), ["unit", "root"]).select("unit", "text_id", "root", "blocks", block.alias("block")), "blocks")
    shared = F.xxhash64(F.pmod(F.xxhash64("unit", F.lit(3)), F.lit(int(single) + 1)))
    alone = dealt.where("blocks = 1").select(shared.alias("task"), "unit", F.lit(0).alias("side"), "text_id", "root")
    blocks = dealt.where("blocks > 1").select("unit", "block").distinct()
    both = blocks.select("unit", F.col("block").alias("x")).join(blocks.select("unit", F.col("block").alias("y")), "unit")
    both = both.where("x <= y and not (x.pure and y.pure and x.of = y.of)").withColumn("task", F.xxhash64("unit", "x", "y"))
    sides = both.select("unit", "task", F.col("x").alias("block"), F.lit(0).alias("side"))
    sides = written(sides.union(both.where("x != y").select("unit", "task", F.col("y").alias("block"), F.lit(1).alias("side"))), "sides")
    out = written(alone.union(dealt.join(sides, ["unit", "block"]).select("task", "unit", "side", "text_id", "root")), "tasks")
    drop(spark, per, dealt, sides)
    return out


def _across(bodies: DataFrame, large: DataFrame, links: DataFrame, weights, threshold: float, size: int, most: int, wide: int) -> DataFrame:
    """``links``, and those between texts of a large group that are in different components of ``links``.

    Components of ``size`` texts or ``most`` shingles and more have blocks of their own, smaller ones share theirs.
    """
    roots = components(links)
    now = large.join(small(roots.withColumnRenamed("id", "text_id")), "text_id", "left")
    now = written(now.select("grp", "text_id", "n", F.coalesce("root", "text_id").alias("root")), "large")
    known = roots.select(F.col("id").alias("a"), F.col("root").alias("b")).where("a != b")
    tasks = _tasks(bodies, now, weights, threshold, size, most, wide)

    def verify(key: tuple, table: pa.Table) -> pa.Table:
        root, side, unit = (np.array(table.column(c), np.int64) for c in ("root", "side", "unit"))
        texts = unpacked(table)
        pairs = set()
        for own in np.split(order := np.argsort(unit, kind="stable"), np.flatnonzero(np.diff(unit[order])) + 1):
            a, b = own[side[own] == 0], own[side[own] == 1]
            b = b if b.size else a
            hits = np.nonzero(reaching([texts[k] for k in a], [texts[k] for k in b], weights.value, threshold) & (root[a][:, None] != root[b]))
            pairs |= {(min(x, y), max(x, y)) for x, y in zip(root[a][hits[0]].tolist(), root[b][hits[1]].tolist(), strict=True)}
        above: dict[int, int] = {}
        kept = []
        for x, y in sorted(pairs):  # a spanning forest of the joined components
            p, q = x, y
            while p in above:
                p = above[p]
            while q in above:
                q = above[q]
            if p != q:
                above[max(p, q)] = min(p, q)
                kept.append((x, y))
        return pa.table({"a": pa.array([x for x, _ in kept], pa.int64()), "b": pa.array([y for _, y in kept], pa.int64())})

    more = bodies.join(small(tasks), "text_id").groupBy("task").applyInArrow(verify, "a bigint, b bigint")
    out = written(known.union(more), "links")
    drop(bodies.sparkSession, now, tasks, roots)
    return out


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **parameters) -> DataFrame:
    """One document of each class stays, with its own columns: the least id (null last), of equal ids the least hash of the text, and of repeated rows one."""
    made = _rooted(docs, id_col, text_col, **parameters)
    least = made.where("root is not null").groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "mark")).alias("least"))
    stay = least.select("least.id", "least.mark").union(made.where("root is null").select("id", "mark").distinct())
    rows = made.groupBy("id", "mark").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")
    stay = written(stay.join(rows, stay["id"].eqNullSafe(rows["id"]) & stay["mark"].eqNullSafe(rows["mark"]), "left").select(stay["id"].alias("own_id"), stay["mark"].alias("own_mark"), F.coalesce("rows", F.lit(1)).alias("rows")), "stay")
    whole = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.xxhash64(text_col).alias("mark"))
    out = whole.join(small(stay), F.col("id").eqNullSafe(F.col("own_id")) & F.col("mark").eqNullSafe(F.col("own_mark")))
    once = out.where("rows = 1").select("row.*")
    if stay.where("rows > 1").isEmpty():
        return once
    return once.unionByName(out.where("rows > 1").dropDuplicates(["id", "mark"]).select("row.*"))
