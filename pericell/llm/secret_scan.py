r"""Secret scans: multipart credential linking, by DataFrame functions only.

Every kind has a pattern, a test of its matches and a role: access identifier,
secret or endpoint. Strong kinds (``assign``, ``access``, ``hex``) are findings by
themselves. Weak kinds are reported only when a complementary part stands within
their scope, ``scope`` code points before or after in the same document: an
identifier or an endpoint needs a secret, a short secret needs an identifier. The
parts are interval-joined: each is dealt to the cells of ``scope`` code points that
its scope touches, candidates meet parts of their own cell only, and a semi-join
keeps a candidate once, so no pairs are made.

Places of matches come from cutting the text at the pattern: with pieces p and
matches m, match i starts after p0..pi and m0..m(i-1). Spans are in code points,
end exclusive. Matches of one kind are leftmost and non-overlapping; findings that
start together are in the order of KINDS.

A null text is empty and has no findings. Rows are told apart by a hash of id and
text, so repeated rows share findings and none is lost. Null ids are kept. An empty
table gives an empty one. Texts are searched whole; a very long one takes memory in
proportion. Findings are joined back to the documents as a table of their own, sent
whole up to a measured BROADCAST_BYTES. ``scanned`` replaces a column ``findings``
and passes on all others untouched; ``redacted`` passes on all but the text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .store import written

ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"  # the maximal runs of 16 and more, as [0-9a-f]+ with that length would give
IDENT = r"""((?i:access_?key_?id|client_?id|user_?name|user|login|account))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]{3,})"""
WEAK = r"""((?i:pwd|pass|auth|private_?key|credential))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]{6,})"""
ACCOUNT = r"""(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"""
HOST = r"""(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9.])(?::[0-9]{1,5})?"""
ENDPOINT = r"""(?:https?|ftps?|ssh|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\s"'<>]+"""

#: kind, pattern, group whose length counts, least length, role; in the order of the report.
KINDS = [
    ("assign", ASSIGN, 2, 12, "secret"),
    ("access", ACCESS, 0, 18, "id"),
    ("hex", HEX, 0, 16, "secret"),
    ("ident", IDENT, 2, 3, "id"),
    ("weak", WEAK, 2, 6, "secret"),
    ("endpoint", ENDPOINT, 0, 8, "place"),
    ("account", ACCOUNT, 0, 5, "id"),
    ("host", HOST, 0, 7, "place"),
]
STRONG = ("assign", "access", "hex")
#: Pairs of roles of which the first is reported near the second.
COMPLEMENTS = (("id", "secret"), ("secret", "id"), ("place", "secret"))
SCOPE = 200
BROADCAST_BYTES = 64 << 20


def _matches(text: Column, k: int) -> Column:
    """Matches of one kind as (k, gap: chars since the last match, size, counts: chars that count, i: place)."""
    _, pattern, group, _, _ = KINDS[k]

    def row(m: Column, piece: Column) -> Column:
        counted = F.length(F.regexp_extract(m, pattern, group)) if group else F.length(m)
        return F.when(m.isNotNull(), F.struct(F.lit(k).alias("k"), F.length(piece).alias("gap"), F.length(m).alias("size"), counted.alias("counts")))

    rows = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern), row)
    placed = F.transform(F.filter(rows, lambda r: r.isNotNull()), lambda r, i: F.struct(r["k"].alias("k"), r["gap"].alias("gap"), r["size"].alias("size"), r["counts"].alias("counts"), i.alias("i")))
    return F.when(text.rlike(pattern), placed)


def _candidates(text: Column) -> Column:
    empty = F.array().cast("array<struct<k:int,gap:int,size:int,counts:int,i:int>>")
    return F.concat(*[F.coalesce(_matches(text, k), empty) for k in range(len(KINDS))])


def _of_kind(place: int) -> Column:
    return F.element_at(F.array(*[F.lit(x[place]) for x in KINDS]), F.col("k") + 1)


def candidates(keyed: DataFrame) -> DataFrame:
    """key, kind, k, role, start, end of all matches that pass their test; ``keyed`` has key and text, equal keys with equal texts."""
    rows = keyed.select("key", F.explode(_candidates(F.col("text"))).alias("c")).select("key", "c.*")
    # Repeated rows give the same candidates, which would disturb the running sums.
    rows = rows.repartition("key").dropDuplicates(["key", "k", "i"])
    own = Window.partitionBy("key", "k").orderBy("i")
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(own).cast("long"))
    rows = rows.withColumn("start", F.col("end") - F.col("size")).where(F.col("counts") >= _of_kind(3))
    return rows.select("key", _of_kind(0).alias("kind"), "k", _of_kind(4).alias("role"), "start", "end")


def linked(rows: DataFrame, scope: int = SCOPE) -> DataFrame:
    """The weak candidates that have a complementary part within ``scope``, by an interval join on cells of ``scope`` code points."""
    cells = lambda lo, hi: F.explode(F.sequence(F.floor(lo / scope), F.floor(hi / scope))).alias("cell")
    weak = rows.where(~F.col("kind").isin(*STRONG)).select("*", cells(F.col("start"), F.col("end")))
    parts = rows.select(F.col("key").alias("of"), F.col("role").alias("part"), F.col("start").alias("lo"), F.col("end").alias("hi"), cells(F.col("start") - scope, F.col("end") + scope))
    parts = parts.withColumnRenamed("cell", "at")
    fits = F.lit(False)
    for role, other in COMPLEMENTS:
        fits = fits | ((F.col("role") == role) & (F.col("part") == other))
    near = (F.col("lo") - F.col("end") <= scope) & (F.col("start") - F.col("hi") <= scope)
    met = weak.join(parts, (F.col("key") == F.col("of")) & (F.col("cell") == F.col("at")) & fits & near, "left_semi")
    return met.drop("cell").distinct()


def findings(keyed: DataFrame, scope: int = SCOPE) -> DataFrame:
    """key, kind, k, start, end of all findings."""
    rows = written(candidates(keyed), "candidates")
    both = rows.where(F.col("kind").isin(*STRONG)).unionByName(linked(rows, scope))
    return both.select("key", "kind", "k", "start", "end")


def _key() -> Column:
    """Tells rows apart by id and text; equal rows share it."""
    return F.sha2(F.concat_ws("\x00", F.coalesce(F.col("id").cast("string"), F.lit("null")), F.coalesce(F.col("text"), F.lit(""))), 256)


def _scanned(docs: DataFrame, id_col: str, text_col: str, scope: int) -> DataFrame:
    """row (the document), text, findings: an array of (start, k, end, kind) in order, null if there are none."""
    base = docs.select(F.struct(*docs.columns).alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", _key())
    found = findings(base.select("key", F.coalesce("text", F.lit("")).alias("text")), scope)
    found = found.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("start", "k", "end", "kind"))).alias("findings"))
    found = written(found.withColumnRenamed("key", "found_key"), "findings")
    size = found.agg(F.sum(100 + 50 * F.size("findings"))).first()[0] or 0
    out = base.join(F.broadcast(found) if size <= BROADCAST_BYTES else found, F.col("key") == F.col("found_key"), "left")
    return out.select("row", "text", "findings")


def scanned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """The documents, each with ``findings``: an array of (start, k, end, kind) in order."""
    none = F.array().cast("array<struct<start:bigint,k:int,end:bigint,kind:string>>")
    own = [F.col("row")[c].alias(c) for c in docs.columns if c.lower() != "findings"]
    return _scanned(docs, id_col, text_col, scope).select(*own, F.coalesce("findings", none).alias("findings"))


def spans(found: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mark: str = "[SECRET]", scope: int = SCOPE) -> DataFrame:
    """The documents with every finding cut out of the text; overlapping findings become one mark."""
    full = _scanned(docs, id_col, text_col, scope)

    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        # 1-based substring between the last finding and this one
        piece = F.struct(acc["at"].alias("lo"), x["start"].alias("hi"))
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.when(fresh, F.concat(acc["parts"], F.array(piece))).otherwise(acc["parts"]).alias("parts"))

    begin = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<lo:bigint,hi:bigint>>").alias("parts"))
    full = full.withColumn("cut", F.when(F.size("findings") > 0, F.aggregate("findings", begin, step)))
    text = F.col("text")
    pieces = F.transform("cut.parts", lambda p: F.substr(text, (p["lo"] + 1).cast("int"), (p["hi"] - p["lo"]).cast("int")))
    tail = F.substr(text, (F.col("cut.at") + 1).cast("int"))
    clean = F.when(F.col("cut").isNull(), text).otherwise(F.concat(F.array_join(pieces, mark), F.lit(mark), tail))
    return full.select(*[clean.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
