"""One query per operator, over the whole documents table, and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, katz, media, merkle, mixing, neardup, packing, quality, secret_scan, sharding, substring, tokens, toxicity


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select(*columns)


def op1_katz_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return katz.scored(documents(spark, sf_dir, "doc_id", "text"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.classes(documents(spark, sf_dir, "doc_id", "text"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = packing.pack(documents(spark, sf_dir, "doc_id", "text"))
    return placed.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset")


def op4_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir, "doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", (1 - F.col("quality")).alias("low_quality"), "toxic")
    return toxicity.predicted(docs, toxicity.fit_chain(docs, labels))


def op5_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.repetition(documents(spark, sf_dir, "doc_id", "text", "source"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.count_tokens(documents(spark, sf_dir, "doc_id", "text"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = substring.dedup_all(documents(spark, sf_dir, "doc_id", "text"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(documents(spark, sf_dir, "doc_id", "text")).drop("text")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.scanned(documents(spark, sf_dir, "doc_id", "text").select("doc_id", "text"))
    base = F.filter("findings", lambda x: x["kind"].isin(*secret_scan.STRONG))
    count = lambda kind: F.size(F.filter("findings", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *[count(k) for k in secret_scan.STRONG], F.sha2(secret_scan.spans(base).cast("binary"), 256).alias("base_sha256"), secret_scan.spans(F.col("findings")).alias("spans"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    full = media.read_media(media.to_media(documents(spark, sf_dir, "doc_id", "text")))
    size = F.octet_length("payload")
    return full.select(
        "doc_id",
        "n_bytes",
        size.cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substr("payload", size - 31, F.lit(32))).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        "feature",
    )


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proven(merkle.manifest(documents(spark, sf_dir, *merkle.FIELDS)))


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(documents(spark, sf_dir, "lang", "text"))


def op13_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.plan(documents(spark, sf_dir, "doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit(sharding.LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {f.__name__: f for f in (op1_katz_scores, op2_near_dedup, op3_best_fit_packing, op4_toxicity_chain, op5_mix_sources, op6_token_counts, op7_substring_dedup, op8_quality_rules, op9_secret_scan, op10_media_columns, op11_merkle_manifest, op12_collocations, op13_shards)}

MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents
), own AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), weighed AS (
  SELECT *, (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS weight, 3 * source_size AS cap FROM own
), leveled AS (
  SELECT *, CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM weighed WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source ASC NULLS LAST)
), shared AS (
  SELECT *, level <= CAST(cap AS DOUBLE) / weight AS free, max(CASE WHEN level <= CAST(cap AS DOUBLE) / weight THEN level END) OVER () AS top FROM leveled
), rated AS (
  SELECT source, source_size, CASE WHEN free THEN top * weight ELSE CAST(cap AS DOUBLE) END AS target FROM shared
), drawn AS (
  SELECT s.doc_id, s.size, r.source_size, r.target, CASE WHEN r.source_size > 0 THEN least(r.target / r.source_size, 3.0) ELSE 0.0 END AS rate,
    CAST(('0x' || substr(md5('42:' || coalesce(CAST(s.doc_id AS VARCHAR), 'null')), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * (CAST(floor(rate) AS BIGINT) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) AS taken FROM drawn
"""


def _quality_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in dict.fromkeys(quality.STOP_WORDS))
    bounds = " AND ".join(f"{name} {sign} {float(bound)}" for name, least, most in quality.RULES for sign, bound in ((">=", least), ("<=", most)) if bound is not None)
    return rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM documents
), g AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d)
), p AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT r, CAST(sum(least(3, coalesce(nxt - i, 3))) AS BIGINT) AS n FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM p) GROUP BY r
), m AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, coalesce(rep.n, 0) AS n_repeat_words, len(l) AS n_lines,
    len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS stops,
    len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS bullets,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09\x0D]*$'))) AS cut
  FROM d LEFT JOIN rep USING (r)
), q AS (
  SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0.0::DOUBLE END AS mean_word_chars,
    CASE WHEN n_words > 0 THEN n_symbols::DOUBLE / n_words ELSE 0.0::DOUBLE END AS symbol_ratio,
    CASE WHEN n_words > 0 THEN stops::DOUBLE / n_words ELSE 0.0::DOUBLE END AS stop_ratio,
    CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0.0::DOUBLE END AS repeat_ratio,
    CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0.0::DOUBLE END AS dup_line_ratio,
    CASE WHEN n_lines > 0 THEN bullets::DOUBLE / n_lines ELSE 0.0::DOUBLE END AS bullet_line_ratio,
    CASE WHEN n_lines > 0 THEN cut::DOUBLE / n_lines ELSE 0.0::DOUBLE END AS ellipsis_line_ratio,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed
  FROM m
)
SELECT *, NOT base_failed AND {bounds} AS kept FROM q
"""


def _crc_table() -> list[int]:
    out = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        out.append(value)
    return out


#: A relation ``t`` with the table of CRC-32, and the checksum of a text, byte by byte.
CRC_SQL = f"t AS MATERIALIZED (SELECT {_crc_table()}::BIGINT[] AS crc)"


def _crc_sql(text: str) -> str:
    data = f"list_transform(regexp_extract_all(hex(encode({text})), '..'), lambda b: CAST('0x' || b AS BIGINT))"
    return f"xor(4294967295::BIGINT, list_reduce({data}, lambda c, b: xor(c >> 8, crc[1 + (xor(c, b) & 255)]), 4294967295::BIGINT))"


SHARDS_SQL = f"""
WITH {CRC_SQL}, d AS (
  SELECT doc_id, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {_crc_sql("coalesce(text, '')")} AS text_crc32 FROM documents, t
), p AS (
  SELECT *, row_number() OVER o AS r, coalesce(sum(size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, sum(size) OVER () AS total
  FROM d WINDOW o AS (ORDER BY doc_id ASC NULLS FIRST, size, text_crc32)
), s AS (
  SELECT *, CAST(least(7, 8 * (2 * start + size) // (2 * total)) AS INTEGER) AS shard FROM p
)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY r) - 1 AS BIGINT) AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM s
"""


def _levels_sql(name: str, leaves: str, levels: int) -> str:
    """``name``_0 to ``name``_levels: nodes (g, i, h) of trees over leaves (g, i, h); a tree's root repeats itself at i 0 once it is reached.
    ``name``_up: for each leaf the others on its way (text, from below), and for each level its place."""
    out = [f"{name}_0 AS ({leaves})"]
    for k in range(levels):
        out.append(f"""{name}_n{k} AS (SELECT *, count(*) OVER (PARTITION BY g) AS n FROM {name}_{k}),
{name}_{k + 1} AS (SELECT g, i // 16 AS i, CASE WHEN any_value(n) = 1 THEN any_value(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}_n{k} GROUP BY g, i // 16),
{name}_r{k} AS (SELECT g, i // 16 AS i, any_value(n) > 1 AS hashed, list(h ORDER BY i) AS run FROM {name}_n{k} GROUP BY g, i // 16)""")
    joins = " ".join(f"JOIN {name}_r{k} r{k} ON r{k}.g = a.g AND r{k}.i = a.i // {16 ** (k + 1)}" for k in range(levels))
    place = lambda k: f"1 + a.i // {16**k} % 16"
    before = lambda k: f"array_to_string(r{k}.run[1:{place(k)} - 1], '')"
    after = lambda k: f"array_to_string(r{k}.run[{place(k)} + 1:], '')"
    parts = " || ".join(f"{before(k)} || {after(k)}" for k in range(levels))
    steps = ", ".join(f"CASE WHEN r{k}.hashed THEN [{before(k)}, {after(k)}] END" for k in range(levels))
    out.append(f"{name}_up AS (SELECT a.g, a.i, {parts} AS others, [{steps}] AS steps FROM {name}_0 a {joins})")
    return ",\n".join(out)


def _merkle_sql(levels: int = 5, top: int = 4) -> str:
    """By levels one after another: right up to 16**levels rows a source and 16**top sources."""
    field = lambda c, value=None: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({value or c} AS VARCHAR)) || ':' || CAST({value or c} AS VARCHAR) END"
    row = lambda text: f"sha256({' || '.join(field(c, text if c == 'text' else None) for c in merkle.FIELDS)})"
    small = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""
WITH {CRC_SQL}, d AS (
  SELECT doc_id, source, {row("text")} AS h, CASE WHEN doc_id IS NOT NULL AND {_crc_sql("CAST(doc_id AS VARCHAR)")} % 5 = 0 THEN {row(small)} ELSE {row("text")} END AS changed FROM documents, t
), l AS (
  SELECT *, dense_rank() OVER (ORDER BY source ASC NULLS FIRST) - 1 AS g, row_number() OVER (PARTITION BY source ORDER BY doc_id ASC NULLS FIRST, h) - 1 AS i FROM d
),
{_levels_sql("own", "SELECT g, i, h FROM l", levels)},
{_levels_sql("top", f"SELECT 0 AS g, g AS i, h FROM own_{levels}", top)},
folded AS (
  SELECT l.doc_id, l.h AS leaf, s.h AS subroot, r.h AS root, sha256(a.others || b.others) AS proof_sha256,
    list_reduce(list_filter(list_concat(a.steps, b.steps), lambda x: x IS NOT NULL), lambda x, y: [sha256(y[1] || x[1] || y[2])], [l.changed])[1] AS folded_root
  FROM l JOIN own_up a ON a.g = l.g AND a.i = l.i JOIN top_up b ON b.i = l.g JOIN top_0 s ON s.i = l.g, top_{top} r
)
SELECT *, folded_root = root AS verified FROM folded
"""


PHRASES_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, p FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents)
), words AS (
  SELECT lang, piece, unnest(w) AS w1, unnest(range(len(w))) AS i FROM (SELECT lang, piece, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM pieces)
), runs AS (
  SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM words WINDOW o AS (PARTITION BY piece ORDER BY i)
), n AS (
  SELECT lang, count(*) AS n FROM runs GROUP BY lang
), f1 AS (
  SELECT lang, w1, count(*) AS f FROM runs GROUP BY ALL
), f2 AS (
  SELECT lang, w1, w2, count(*) AS f FROM runs WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), f3 AS (
  SELECT lang, w1, w2, w3, count(*) AS f FROM runs WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10
), longer AS (
  SELECT lang, w1, w2, max(f) AS most FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL
), cuts AS (
  SELECT p.lang, p.w1 || ' ' || p.w2 AS phrase, p.f AS a, 1 AS k, x.f AS l, y.f AS r
  FROM f2 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w2 LEFT JOIN longer m ON m.lang = p.lang AND m.w1 = p.w1 AND m.w2 = p.w2
  WHERE m.most IS NULL OR 100 * m.most < 50 * p.f
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 1, x.f, y.f FROM f3 p JOIN f1 x ON x.lang = p.lang AND x.w1 = p.w1 JOIN f2 y ON y.lang = p.lang AND y.w1 = p.w2 AND y.w2 = p.w3
  UNION ALL
  SELECT p.lang, p.w1 || ' ' || p.w2 || ' ' || p.w3, p.f, 2, x.f, y.f FROM f3 p JOIN f2 x ON x.lang = p.lang AND x.w1 = p.w1 AND x.w2 = p.w2 JOIN f1 y ON y.lang = p.lang AND y.w1 = p.w3
), scored AS (
  SELECT *, CAST(CAST(1000000 AS HUGEINT) * a * a // (CAST(l AS HUGEINT) * r) AS BIGINT) AS score FROM cuts
), lowest AS (
  SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM lowest
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op5_mix_sources": MIX_SQL, "op8_quality_rules": _quality_sql(), "op11_merkle_manifest": _merkle_sql(), "op12_collocations": PHRASES_SQL, "op13_shards": SHARDS_SQL}
