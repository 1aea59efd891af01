"""Merkle manifests, collocations and shards against brute force."""

import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256

import numpy as np
import pytest

from pyspark.sql import functions as F

from pericell.llm import collocations, merkle, queries, sharding


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(r, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r[0], r[3], r[2], r[4], text)))


def small(text):
    return None if text is None else "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def manifest(rows):
    """By whole levels in memory; rows: doc_id, text, lang, source, n_chars."""
    levels = lambda nodes: [nodes] if len(nodes) == 1 else [nodes, *levels([h(*nodes[k : k + 16]) for k in range(0, len(nodes), 16)])]
    sources = defaultdict(list)
    for r in rows:
        sources[r[3]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    order = sorted(sources, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(sources[s], key=lambda x: x[:3])]) for s in order}
    top, out = levels([trees[s][-1][0] for s in order]), []

    def way(tree, i):
        for nodes in tree[:-1]:
            yield nodes[i - i % 16 : i], nodes[i + 1 : i - i % 16 + 16]
            i //= 16

    for g, s in enumerate(order):
        for i, (known, _, own, r) in enumerate(sorted(sources[s], key=lambda x: x[:3])):
            steps = [*way(trees[s], i), *way(top, g)]
            seen = leaf(r, small(r[1])) if known and zlib.crc32(str(r[0]).encode()) % 5 == 0 else own
            for a, b in steps:
                seen = h(*a, seen, *b)
            out.append((r[0], own, trees[s][-1][0], top[-1][0], h(*(x for a, b in steps for x in a + b)), seen, seen == top[-1][0]))
    return sorted(out, key=repr)


def proofs(df):
    return sorted((tuple(r) for r in merkle.proven(merkle.manifest(df)).collect()), key=repr)


def test_merkle_manifest(spark, docs, none, rows):
    assert proofs(docs) == manifest(rows)
    assert proofs(docs.withColumn("h", F.lit(1)).withColumn("part", F.lit("x")).withColumn("key", F.lit(2))) == manifest(rows)
    assert proofs(none) == [] and merkle.manifest(none).root is None
    one = [rows[2]]
    assert proofs(spark.createDataFrame(one, docs.schema)) == manifest(one)


def test_merkle_levels(spark, docs):
    """A hot source of three levels, sources of 1, 16 and 17 rows, many small ones, equal rows, one id on many rows."""
    sizes = {"hot": 700, None: 16, "one": 1, "x": 17, "": 33, "é": 2} | {f"s{k}": 1 + k % 3 for k in range(40)}
    rows = [(k * 7 % 911, f"Text {k} ÀB", None if k % 3 else "en", s, k) for s, n in sizes.items() for k in range(n)]
    rows += [(5, "Same", "en", "hot", 1)] * 50 + [(None, None, None, "hot", None)] * 20
    given = spark.createDataFrame(rows, docs.schema)
    want = manifest(rows)
    assert proofs(given.repartition(9)) == want == proofs(given.coalesce(1))
    m = merkle.manifest(given)
    assert m.root == want[0][3] and len(m.documents.levels) == 3
    for level in range(1, 4):  # each node once
        found = m.documents.nodes(level).groupBy("g").agg(F.count("*").alias("c"), F.countDistinct("i").alias("d"), F.max("n").alias("n")).collect()
        assert all(r.c == r.d for r in found) and max(r.c for r in found) == -(-770 // 16**level)


@pytest.mark.parametrize("n, cuts", [(1, []), (5, [2]), (16, [7]), (17, [3, 16]), (300, [1, 100, 260]), (4100, [17, 1000, 1001, 4000]), (600, list(range(1, 600)))])
def test_mountains(n, cuts):
    """Parts of one tree, cut anywhere: completed nodes and merged edges are the tree's levels."""
    leaves = [h(str(k)) for k in range(n)]
    nodes, open_ = {}, defaultdict(dict)
    for a, b in zip([0, *cuts], [*cuts, n], strict=True):
        own = merkle.Mountains(n)
        for i in range(a, b):
            own.push(i, leaves[i])
        own.end()
        left = Counter(level for level, _, _, edge in own.nodes if edge)
        assert max(left.values(), default=0) <= 30
        for level, i, d, edge in own.nodes:
            (open_[level] if edge else nodes)[i if edge else (level, i)] = d
    want, level = leaves, 0
    while len(want) > 1:
        runs = defaultdict(list)
        for i, d in sorted(open_[level].items()):
            runs[i // 16].append(d)
        for i, run in runs.items():
            nodes[level + 1, i] = h(*run)
            open_[level + 1][i] = nodes[level + 1, i]
        want, level = [h(*want[k : k + 16]) for k in range(0, len(want), 16)], level + 1
        assert [nodes[level, i] for i in range(len(want))] == want
    assert merkle.height(n) == level


def test_tampering_is_found(docs):
    changed = proofs(docs.withColumn("text", F.when(F.col("doc_id") == 3, F.concat("text", F.lit("!"))).otherwise(F.col("text"))))
    was = {r[:2] for r in proofs(docs)}
    assert {r[0] for r in changed if r[:2] not in was} == {3} and changed[0][3] != proofs(docs)[0][3]


def phrases(rows, longest=3, least=10, share=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", small(text) or ""):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, count in f.items():
        found = {p: a for p, a in count.items() if len(p) > 1 and a >= least}
        inside = {q for p, a in found.items() for i in range(len(p)) for j in range(i + 2, len(p) + 1) if len(q := p[i:j]) < len(p) and 100 * a >= share * count[q]}
        ranked = []
        for p, a in found.items():
            if p not in inside:
                score, k = min((1_000_000 * a * a // (count[p[:k]] * count[p[k:]]), k) for k in range(1, len(p)))
                ranked.append((-score, -a, " ".join(p).encode(), count[p[:k]], count[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(ranked)[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def spoken(docs, rows):
    rng = np.random.default_rng(3)
    vocabulary = ["a", "B", "ß", "x-y", "(c", "漢", "d'e", "A"]
    marks = [" ", " ", " ", "\t", "  ", ". ", ",", "\n", "\r\n", "\x0b", " ; ", "?"]
    text = lambda n: "".join(vocabulary[i] + marks[j] for i, j in zip(rng.integers(0, 8, n) ** 2 // 8, rng.integers(0, 12, n), strict=True))
    more = [(1000 + k, text(int(rng.integers(0, 60))), ["en", "de", None, "und", ""][k % 5], "s", 0) for k in range(300)]
    return [*rows, *more, (1, "tic tac toe " * 30 + "tic tac tie", "en", None, 0), (2, "one two", "fr", None, None)]


def test_collocations(spark, docs, none, spoken):
    df = spark.createDataFrame(spoken, docs.schema).repartition(5)
    got = sorted(tuple(r) for r in collocations.collocations(df).collect())
    assert got == phrases(spoken) and len(got) > 100
    assert sorted(tuple(r) for r in collocations.collocations(df.withColumn("mark", F.lit(1)), 5, 3, 70, 20).collect()) == phrases(spoken, 5, 3, 70, 20)
    assert collocations.collocations(none).count() == 0


def test_collocations_beyond_the_broadcast(spark, docs, spoken):
    """Bits in place of all frequent runs: the same tables, also with so few bits that most are set."""
    df = spark.createDataFrame(spoken, docs.schema)
    rows = lambda given: [sorted((r.mark, r.c) for r in t.collect()) for t in given[1]]
    want = collocations.levels(df, 4, 5)
    assert rows(want) == rows(collocations.levels(df, 4, 5, exact=3, bits=20)) == rows(collocations.levels(df, 4, 5, exact=3, bits=7))
    marks = np.array([r.mark for r in want[1][1].collect()]).view(np.uint64)
    for found in (collocations.frequent(want[1][1]), collocations.frequent(want[1][1], 3, 12)):
        assert found.has(marks).all()
    assert not collocations.frequent(want[1][1]).has(marks + np.uint64(1)).any()


def test_scores_pass_64_bits(spark):
    big = 3_000_000_000_000
    found = spark.createDataFrame([("en", "a b", big, [big + 7], [big + 9], 1), ("en", "a b c", 11, [13, 17], [12, 19], 2)], "lang string, phrase string, c long, starts array<long>, ends array<long>, mark long")
    got = {r.phrase: (r.l, r.r, r.score) for r in collocations.scored([found.where("size(starts) = 1"), found.where("size(starts) = 2")], [None, None, spark.createDataFrame([], "head long, tail long, c long")]).collect()}
    assert got == {"a b": (big + 7, big + 9, 1_000_000 * big * big // ((big + 7) * (big + 9))), "a b c": (13, 19, 1_000_000 * 121 // (13 * 19))}


def shards(rows, n):
    sized = sorted(((k is not None, k or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode()), k) for k, t, *_ in rows))
    total, start, seen, out = sum(x[2] for x in sized), 0, Counter(), []
    for _, _, size, crc, k in sized:
        shard = min(n - 1, n * (2 * start + size) // (2 * total))
        out.append((k, size, crc, shard, seen[shard]))
        seen[shard] += 1
        start += size
    return sorted(out, key=repr)


@pytest.mark.parametrize("n", [1, 3, 8, 100])
def test_shards(spark, docs, none, rows, n):
    got = sorted((tuple(r) for r in sharding.plan(docs, n).collect()), key=repr)
    assert got == shards(rows, n)
    assert sharding.plan(none, n).count() == 0


def test_shards_of_hot_and_long_rows(spark, docs):
    """A third of the rows equal, a third under one id, and a text longer than several shards."""
    rows = [(7, "same text", "en", "s", 0)] * 400 + [(9, f"text {k}" * (k % 9), "en", "s", 0) for k in range(400)] + [(k, "x" * k, "en", "s", 0) for k in range(300)] + [(5, "y" * 40_000, "en", "s", 0)]
    df = spark.createDataFrame(rows, docs.schema).repartition(6)
    got = sorted((tuple(r) for r in sharding.plan(df).collect()), key=repr)
    assert got == shards(rows, 8)
    even = rows[:800]
    bytes_ = Counter()
    for r in sharding.plan(spark.createDataFrame(even, docs.schema)).collect():
        bytes_[r.shard] += r.size
    assert len(bytes_) == 8 and max(bytes_.values()) - min(bytes_.values()) <= 2 * max(len(r[1]) + 1 for r in even)


def test_sharded_rows(spark, docs, rows):
    whole = docs.withColumn("part", F.lit("own")).withColumn("low", F.lit(1))
    got = sharding.sharded(whole, 4)
    assert got.columns == [*whole.columns, *sharding.ADDED]
    assert sorted((tuple(r)[:5] for r in got.collect()), key=repr) == sorted((tuple(r) for r in docs.collect()), key=repr)
    assert sorted((r.doc_id, r.size, r.text_crc32, r.shard, r.slot) for r in got.collect() if r.doc_id is not None) == sorted(x for x in shards(rows, 4) if x[0] is not None)
    with pytest.raises(ValueError):
        sharding.sharded(docs.withColumn("Slot", F.lit(1)))


def test_shards_stay_in_the_jvm(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    plan = queries.op13_shards(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
