"""A hash tree over a dataset, of fanout 16, built as a mountain range in each partition.

Leaves (one per row: H over doc_id, source, lang, n_chars, text) are put in order of
source and doc_id, dealt over partitions by ranges, and numbered inside their source.
A task runs over consecutive leaves with one stack of peaks: the 16th node of a run
carries, like a digit in base 16, into a node of the next level, and so on up; each
node so completed is a record. Runs that begin or end outside of what the task has
seen stay open; their members are the task's edges, at most 15 at each end and level.
Edges of all tasks are merged level by level, by runs of at most 16, and the last run
of a level is hashed as short as it is, without padding. So no task sees more than its
share, however many leaves one source has. The subroots of the sources are the leaves of
one more such tree, whose root stands for the dataset.

Proofs come down from the roots: each run of siblings is joined with the path of its
parent, and leaves meet theirs as runs, so a path is sent once for 16 leaves.

H: lowercase hex SHA-256 of its inputs end to end, digests as hex text. A null field is
``-``, others are their UTF-8 byte count, ``:`` and the value, so null and empty differ.
Null sources and ids come first; rows of one source and id are in order of their leaves,
and rows equal in all five fields have equal leaves, with a place of their own each. Very
long texts are hashed as they are. A source with one row has that leaf as its subroot,
and with one source its subroot is the root; an empty table has no root and no proofs.
Only the five fields are read, so extra columns and their names do not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import numbered
from .store import written

FAN = 16
BITS = 4
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts: str) -> str:
    return sha256("".join(parts).encode()).hexdigest()


def height(n: int) -> int:
    """Levels above the leaves."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def siblings(i: int, n: int) -> Iterator[tuple[int, int]]:
    """For leaf i of n, level by level: its place in its run and the number of the others there."""
    while n > 1:
        yield i % FAN, min(FAN, n - (i - i % FAN)) - 1
        i, n = i // FAN, -(-n // FAN)


def folded(leaf: str, others: str, *places: tuple[int, int]) -> str:
    """The root that a leaf and its siblings give. places: (index, number of leaves) of each tree on the way."""
    at = 0
    for i, n in places:
        for k, m in siblings(i, n):
            cut = at + 64 * k
            leaf, at = h(others[at:cut], leaf, others[cut : at + 64 * m]), at + 64 * m
    return leaf


class Mountains:
    """The peaks of one tree over leaves that come in order of their index, from any first one on."""

    def __init__(self, n: int):
        self.n, self.open = n, []  # per level: index of the first open node, and the open nodes' digests
        self.nodes: list[tuple[int, int, str, bool]] = []  # level, index, digest, edge

    def push(self, i: int, digest: str, level: int = 0) -> None:
        count = -(-self.n // (1 << BITS * level))
        if count == 1:
            return  # the root
        if level == len(self.open):
            self.open.append((i, []))
        first, run = self.open[level]
        if not run:
            first = i
            self.open[level] = (first, run)
        run.append(digest)
        if i % FAN == FAN - 1 or i == count - 1:
            if first % FAN == 0:
                up = h(*run)
                self.nodes.append((level + 1, i // FAN, up, False))
                self.open[level] = (0, [])
                self.push(i // FAN, up, level + 1)
            else:
                self._edges(level)

    def _edges(self, level: int) -> None:
        first, run = self.open[level]
        self.nodes += [(level, first + k, d, True) for k, d in enumerate(run)]
        self.open[level] = (0, [])

    def end(self) -> None:
        for level in range(len(self.open)):
            self._edges(level)


NODE = "g long, n long, level int, i long, h binary, edge boolean"


def _stacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes and edges of leaves (g, n, i, h); a leaf that does not follow the one before it begins another range."""
    out: list[tuple] = []
    now, g, last = None, None, None

    def record() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [[]] * 6
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.bool_())
        batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["g", "n", "level", "i", "h", "edge"])
        out.clear()
        return batch

    def take() -> None:
        out.extend((g, now.n, level, i, bytes.fromhex(d), edge) for level, i, d, edge in now.nodes)
        now.nodes.clear()

    for batch in batches:
        for tree, n, i, digest in zip(*(batch.column(c).to_pylist() for c in ("g", "n", "i", "h")), strict=True):
            if now is None or tree != g or i != last + 1:
                if now:
                    now.end()
                    take()
                now, g = Mountains(n), tree
            now.push(i, digest.hex())
            last = i
        if now:
            take()
        yield record()
    if now:
        now.end()
        take()
        yield record()


def _indexed(rows: DataFrame, order: tuple[str, ...], name: str) -> DataFrame:
    """Leaves in order with g (a tree for each ``key``, ascending like it), i (place in the tree) and n (leaves of the tree)."""
    placed = numbered(rows, ("key", *order), name)
    chunks = placed.groupBy("key", "part").agg(F.count(F.lit(1)).alias("count"), F.min("pos").alias("first"))  # rows: partitions and keys
    own = Window.partitionBy("key")
    ahead = F.coalesce(F.sum("count").over(own.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = F.shiftleft("part", 33) + F.col("first")
    table = written(chunks.select("key", "part", "first", ahead.alias("ahead"), F.sum("count").over(own).alias("n"), F.min(at).over(own).alias("g")), f"{name}_chunks")
    joined = placed.join(table, ["key", "part"])  # Spark broadcasts it if its file is small
    return joined.select(*[c for c in rows.columns if c != "key"], "g", "n", (F.col("ahead") + F.col("pos") - F.col("first")).alias("i"))


def _hash_runs(rows: DataFrame) -> DataFrame:
    """Nodes (g, n, i, h) of one level to those of the next; at most 16 rows a group."""
    runs = rows.groupBy("g", "n", F.shiftright("i", BITS).alias("i")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("run"))
    text = F.array_join(F.transform("run", lambda x: F.lower(F.hex(x["h"]))), "")
    return runs.select("g", "n", "i", F.unhex(F.sha2(text.cast("binary"), 256)).alias("h"))


@dataclass
class Tree:
    """leaves: g, n, i, h and others. levels[k]: nodes (g, n, i, h) of level k + 1 of all trees."""

    leaves: DataFrame
    levels: list[DataFrame]

    def nodes(self, level: int) -> DataFrame:
        return (self.levels[level - 1] if level else self.leaves).select("g", "n", "i", "h")

    def roots(self) -> DataFrame:
        """g, n, h of every tree."""
        out = self.leaves.where("n = 1").select("g", "n", "h")
        for k, nodes in enumerate(self.levels):
            out = out.unionByName(nodes.where(f"n > {FAN**k} AND n <= {FAN ** (k + 1)}").select("g", "n", "h"))
        return out


def tree(leaves: DataFrame, name: str) -> Tree:
    sorted_leaves = leaves.select("g", "n", "i", "h").sortWithinPartitions("g", "i")
    stack = written(sorted_leaves.mapInArrow(_stacked, NODE), f"{name}_stack")
    most = leaves.agg(F.max("n")).first()[0] or 0
    columns, merged, levels = ["g", "n", "i", "h"], None, []
    for level in range(height(most)):
        waiting = stack.where(f"edge AND level = {level}").select(*columns)
        if merged is not None:
            waiting = waiting.unionByName(merged.where(f"n > {FAN**level}"))
        merged = written(_hash_runs(waiting), f"{name}_merged{level + 1}")  # lineage ends here
        levels.append(stack.where(f"NOT edge AND level = {level + 1}").select(*columns).unionByName(merged))
    return Tree(leaves, levels)


def _others(run: Column, i: Column) -> Column:
    return F.aggregate(F.filter(run, lambda x: x["i"] != i), F.unhex(F.lit("")), lambda t, x: F.concat(t, x["h"]))


def _paths(own: Tree, base: DataFrame, down_to: int) -> DataFrame:
    """g, i, u and base's columns of all nodes of a level: u has the siblings on the way up, end to end, then the base's u."""
    extra = [c for c in base.columns if c not in ("g", "n", "u")]
    up = None
    for level in range(len(own.levels), down_to - 1, -1):
        low = FAN ** (level - 1) if level else 0
        start = base.where(f"n > {low} AND n <= {FAN**level}").select("g", F.lit(0).cast("long").alias("i"), "u", *extra)
        if up is not None:
            runs = own.nodes(level).groupBy("g", F.shiftright("i", BITS).alias("p")).agg(F.array_sort(F.collect_list(F.struct("i", "h"))).alias("run"))
            both = runs.join(up.withColumnRenamed("i", "p"), ["g", "p"])
            each = both.select("g", "u", *extra, "run", F.explode(F.transform("run", lambda x: x["i"])).alias("i"))
            start = start.unionByName(each.select("g", "i", F.concat(_others(F.col("run"), F.col("i")), F.col("u")).alias("u"), *extra))
        up = start
    return up


@dataclass
class Manifest:
    """documents: the tree of each source, whose leaves have doc_id and changed; sources: the tree of their subroots,
    whose leaves have the g of theirs as own. root is None without rows."""

    documents: Tree
    sources: Tree
    root: str | None


def field(column: str, text: Column | None = None) -> Column:
    value = F.col(column).cast("string") if text is None else text
    return F.when(F.col(column).isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def leaf(text: Column | None = None) -> Column:
    """The leaf of a row, as 32 bytes."""
    fields = [field(c, text if c == "text" else None) for c in FIELDS]
    return F.unhex(F.sha2(F.concat(*fields).cast("binary"), 256))


def tampered() -> Column:
    """The leaf of a row that a tampering changes: where 5 divides the checksum of the id, A-Z in the text become a-z; else null."""
    small = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, leaf(small))


def manifest(docs: DataFrame) -> Manifest:
    key = F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("+"), F.col("source").cast("string")))
    leaves = written(docs.select(key.alias("key"), "doc_id", leaf().alias("h"), tampered().alias("changed")), "leaves")
    own = tree(_indexed(leaves, ("doc_id", "h"), "rows"), "documents")
    subroots = written(own.roots().select(F.lit("").alias("key"), F.col("g").alias("own"), F.col("n").alias("size"), "h"), "subroots")
    top = tree(_indexed(subroots, ("own",), "sources"), "sources")
    root = top.roots().first()
    return Manifest(own, top, bytes(root["h"]).hex() if root else None)


PROVEN = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def proven(m: Manifest) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    kind = m.documents.leaves.schema["doc_id"].dataType.simpleString()
    first = m.sources.leaves.select("g", "n").distinct().withColumn("u", F.unhex(F.lit("")))
    tops = _paths(m.sources, first, 0).select("i", "u").join(m.sources.leaves.drop("g"), "i")
    base = tops.select(F.col("own").alias("g"), F.col("size").alias("n"), "u", F.col("i").alias("place"), F.col("n").alias("places"), F.col("h").alias("subroot"))
    alone = base.where("n = 1").select("g", F.lit(0).cast("long").alias("p"), *base.columns[2:])
    up = _paths(m.documents, base, 1) if m.documents.levels else None
    up = alone if up is None else alone.unionByName(up.withColumnRenamed("i", "p"))
    runs = m.documents.leaves.groupBy("g", "n", F.shiftright("i", BITS).alias("p")).agg(F.array_sort(F.collect_list(F.struct("i", "h", "doc_id", "changed"))).alias("run"))
    root = m.root

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, out = batch.column("ids").flatten(), []
            for n, digests, changed, p, u, place, places, subroot in zip(*(batch.column(c).to_pylist() for c in ("n", "hs", "changes", "p", "u", "place", "places", "subroot")), strict=True):
                hexes, above, subroot = [d.hex() for d in digests], u.hex(), subroot.hex()
                for k, (own, other) in enumerate(zip(hexes, changed, strict=True)):
                    others = "".join(hexes[:k]) + "".join(hexes[k + 1 :]) + above
                    seen = folded(other.hex() if other else own, others, (FAN * p + k, n), (place, places))
                    out.append((own, subroot, root, h(others), seen, seen == root))
            columns = list(zip(*out, strict=True)) or [[]] * 6
            kinds = [pa.string()] * 5 + [pa.bool_()]
            names = [x.split(" ")[0] for x in PROVEN.split(", ")]
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["doc_id", *names])

    joined = runs.join(up, ["g", "p"]).select("n", "p", "u", "place", "places", "subroot", F.col("run.doc_id").alias("ids"), F.col("run.h").alias("hs"), F.col("run.changed").alias("changes"))
    return joined.mapInArrow(run, f"doc_id {kind}, {PROVEN}")
