"""One query per operator over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tripstrata.llm import chat, embeddings, exact_dedup, licenses, likelihood, minhash, mixing, periodic, pieces, quality, repair, repeats, warc
from tripstrata.llm.base import same, staged, table
from tripstrata.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


def new_index(spark: SparkSession) -> exact_dedup.DigestIndex:
    """An empty digest index in the shared scratch folder."""
    width = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return exact_dedup.DigestIndex(spark, f"{scratch_dir(spark, 'digest-index')}/index", width)


# ---------------------------------------------------------------- 1 near-duplicates


@query("op1_minhash_dedup")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = minhash.near_duplicates(table(spark, sf_dir, "documents"))
    kept = F.col("id").eqNullSafe(F.col("component_id"))
    return rows.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", kept.alias("kept"))


# ---------------------------------------------------------------- 2 pieces


@query("op2_sentencepiece")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = pieces.encode(docs, pieces.Vocabulary.load(), restored_col="restored")
    return done.select("doc_id", F.size("tokens").alias("n_tokens"), "tokens", "restored")


# ---------------------------------------------------------------- 3 exact dedup

OP3_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t FROM documents),
h AS (
  SELECT doc_id, length(t) AS chars, sha256(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS text_sha256 FROM d),
g AS (
  SELECT doc_id, text_sha256,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id,
    count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM h)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, text_sha256 FROM g"""


@query("op3_exact_dedup", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = new_index(spark)
    rows = exact_dedup.deduplicate(table(spark, sf_dir, "documents"), index)
    index.close()  # the result reads what was staged
    digest = F.lower(F.hex("digest")).alias("text_sha256")
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", digest)


# ---------------------------------------------------------------- 7 mixing

OP7_SQL = r"""
WITH f AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size FROM documents),
z AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM f GROUP BY source),
r AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS s FROM z),
w AS (
  SELECT *, s % 3 + 1 AS weight, source_size * 3 AS cap FROM r),
l AS (
  SELECT *, CAST(cap AS DOUBLE) / weight AS ratio,
    CAST(sum(source_size) OVER () - coalesce(sum(cap) OVER b, 0) AS DOUBLE)
      / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS lvl
  FROM w WINDOW b AS (ORDER BY CAST(cap AS DOUBLE) / weight, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (SELECT arg_min(lvl, (ratio, s)) AS water FROM l WHERE ratio > lvl),
t AS (
  SELECT s, source, source_size,
    CASE WHEN water IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), water * weight) END AS target
  FROM l, level),
total AS (SELECT sum(size) AS n FROM f),
hi AS (
  SELECT s, sum(target / greatest(n, 1)::DOUBLE) OVER (ORDER BY s) AS hi FROM t, total),
bounds AS (
  SELECT s, coalesce(lag(hi) OVER (ORDER BY s), 0) AS lo,
    CASE WHEN s = max(s) OVER () THEN greatest(hi, 1) ELSE hi END AS hi FROM hi),
points AS (
  SELECT i, (i // 1048576) * ((0.6180339887498949::DOUBLE * 1048576) % 1.0::DOUBLE)
    + (i % 1048576) * 0.6180339887498949::DOUBLE AS x
  FROM (SELECT unnest(range(CAST((n + 31) // 32 AS BIGINT))) AS i FROM total)),
drawn AS (
  SELECT i, s FROM (SELECT i, x - floor(x) AS u FROM points) p JOIN bounds ON u >= lo AND u < hi),
ranked AS (SELECT s, row_number() OVER (PARTITION BY s ORDER BY i) - 1 AS k FROM drawn),
uses AS (
  SELECT s, k % ((source_size + 31) // 32) AS block, count(*) AS uses
  FROM ranked JOIN t USING (s) WHERE k < 3 * ((source_size + 31) // 32) GROUP BY ALL),
placed AS (
  SELECT s, doc_id, size, sum(size) OVER (PARTITION BY s ORDER BY md5('mix' || coalesce(CAST(doc_id AS VARCHAR), '')), doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) AS fin
  FROM f JOIN t ON f.source IS NOT DISTINCT FROM t.source),
cut AS (
  SELECT s, doc_id, size, fin, unnest(range(CAST((fin - size) // 32 AS BIGINT), CAST((fin - 1) // 32 + 1 AS BIGINT))) AS block FROM placed WHERE size > 0),
taken AS (
  SELECT s, doc_id, size, sum((least(fin, (block + 1) * 32) - greatest(fin - size, block * 32)) * coalesce(uses, 0)) AS taken
  FROM cut LEFT JOIN uses USING (s, block) GROUP BY s, doc_id, size, fin)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target, CAST(taken AS BIGINT) AS taken
FROM (SELECT * FROM taken UNION ALL SELECT s, doc_id, size, 0 FROM placed WHERE size = 0) JOIN t USING (s)"""


@query("op7_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


# ---------------------------------------------------------------- 8 chat

OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER o AS place, count(*) OVER (PARTITION BY conv_id) AS n,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '') OVER
      (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text ROWS UNBOUNDED PRECEDING) AS upto
  FROM conversations WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text)),
whole AS (
  SELECT min(conv_id) AS conv_id, place AS n_turns, count(*) AS copies, upto AS rendered FROM t WHERE place = n GROUP BY place, upto)
SELECT conv_id, CAST(n_turns AS INT) AS n_turns, copies, rendered FROM whole
WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.place = n_turns AND t.n > n_turns AND t.upto = rendered)"""


@query("op8_chat", OP8_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = chat.collapse_and_render(table(spark, sf_dir, "conversations"))
    return rows.select(F.col("conv").alias("conv_id"), F.col("n_turns").cast("int").alias("n_turns"), "copies", "rendered")


# ---------------------------------------------------------------- 5 licenses

_TEMPLATES = ", ".join(f"({n}, '{label}', '{text}')" for n, (label, text) in enumerate(licenses.TEMPLATES))
_PHRASES = ", ".join(f"('{phrase}', '{label}')" for phrase, label in licenses.PHRASES.items())

OP5_SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, trim(regexp_replace(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+', ' ', 'g')) AS norm FROM documents),
l AS (SELECT r, doc_id, CASE WHEN norm = '' THEN [] ELSE string_split(norm, ' ') END AS words FROM d),
w AS (SELECT r, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM l),
g AS (
  SELECT r, i, word || ' ' || lead(word) OVER o AS two, word || ' ' || lead(word) OVER o || ' ' || lead(word, 2) OVER o AS three
  FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
phrases(phrase, label) AS (VALUES {_PHRASES}),
base AS (SELECT r, i, label FROM g JOIN phrases ON phrase = two OR phrase = three),
b AS (
  SELECT r, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(label) AS labels FROM base GROUP BY r),
t0(template, label, text) AS (VALUES {_TEMPLATES}),
t AS (SELECT template, label, string_split(text, ' ') AS tw FROM t0),
tg AS (SELECT template, unnest(range(len(tw) - 2)) AS p, tw FROM t),
hits AS (
  SELECT DISTINCT r, template, i, p, i - p AS diagonal FROM tg JOIN g ON three = tw[p + 1] || ' ' || tw[p + 2] || ' ' || tw[p + 3]),
far AS (
  SELECT *, CASE WHEN diagonal - lag(diagonal) OVER o <= 4 THEN 0 ELSE 1 END AS far FROM hits
  WINDOW o AS (PARTITION BY r, template ORDER BY diagonal)),
s AS (SELECT *, sum(far) OVER (PARTITION BY r, template ORDER BY diagonal) AS span FROM far),
covered AS (SELECT r, template, span, unnest([p, p + 1, p + 2]) AS place FROM s),
spans AS (
  SELECT r, label, CAST(count(DISTINCT place) AS DOUBLE) / any_value(len(tw)) AS coverage
  FROM covered JOIN t USING (template) GROUP BY r, template, span, label),
best AS (SELECT r, list(label) AS labels, max(coverage) AS coverage FROM spans WHERE coverage >= 0.75 GROUP BY r)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  coalesce(array_to_string(list_sort(list_distinct(b.labels)), ','), '') AS base_labels,
  coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(b.labels, []), coalesce(best.labels, [])))), ','), '') AS labels,
  CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(coverage, 0) END AS score
FROM l LEFT JOIN b USING (r) LEFT JOIN best USING (r)"""


@query("op5_license_scan", OP5_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))[0].withColumnRenamed("id", "doc_id")


# ---------------------------------------------------------------- 10 archives

OP10_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
o AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS owner FROM p)
SELECT page_id, payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) + 1, 1) FOR i IN range(32)], '')
    AS payload_digest,
  CASE WHEN page_id = owner OR owner IS NULL THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM o"""


@query("op10_warc", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = warc.write_packages(table(spark, sf_dir, "pages"), scratch_dir(spark, "packages"))
    return warc.read_records(warc.locate(manifest), with_payload=False).drop("url", "payload")


# ---------------------------------------------------------------- 9 embeddings

@query("op9_embedding_dedup")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, recall = embeddings.near_duplicates(table(spark, sf_dir, "embeddings"))
    kept = F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    return rows.select(F.col("id").alias("vec_id"), "n_links", "component_id", kept, F.lit(recall).alias("audited_recall"))


# ---------------------------------------------------------------- 6 likelihood


@query("op6_lm_scoring")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = likelihood.scores(table(spark, sf_dir, "documents"), pieces.Vocabulary.load())
    return rows.withColumnRenamed("id", "doc_id")


# ---------------------------------------------------------------- 4 quality


@query("op4_quality")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = quality.trusted_ids(table(spark, sf_dir, "labels"))
    return quality.classify(table(spark, sf_dir, "documents"), trusted).withColumnRenamed("id", "doc_id")


# ---------------------------------------------------------------- 13 conversation repair


@query("op13_conversation_repair")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    facts, repaired = repair.repair(repair.damaged(turns))
    found = facts.alias("f").join(repair.digests(repaired).alias("d"), same("f", "d", ["conv"]))
    found = found.select(F.col("f.conv").alias("conv_id"), "gaps", *repair.COUNTS, "cost", "audit", "repaired_sha256")
    ids = turns.select("conv_id").distinct()
    none = {"audit": F.lit(""), "repaired_sha256": F.sha2(F.lit(""), 256)}
    rows = ids.alias("i").join(found.alias("r"), same("i", "r", ["conv_id"]), "left")
    values = [F.coalesce(f"r.{name}", none.get(name, F.lit(0))).alias(name) for name in found.columns[1:]]
    return rows.select("i.conv_id", *values)


# ---------------------------------------------------------------- 11 periodic runs


@query("op11_periodic_runs")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    rows = periodic.find_runs(periodic.repeated_tails(docs))
    line = lambda r: F.concat_ws(",", r.start, r.length, r.period)
    written = F.concat(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))))
    # greatest length first, then the smallest start and period
    best = F.array_max(F.transform("runs", lambda r: F.struct(r.length.alias("length"), (-r.start).alias("start"), (-r.period).alias("period"))))
    marked = rows.select("id", F.size("runs").cast("bigint").alias("n_runs"), best.alias("best"), F.array_join(written, "").alias("written"), "collapsed")
    length, period = F.col("best.length"), -F.col("best.period")
    result = marked.select(
        F.col("id").alias("doc_id"),
        "n_runs",
        (-F.col("best.start")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2("written", 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
    # written here, as texts go to the workers in small batches meanwhile
    return staged(result, "runs")


# ---------------------------------------------------------------- 12 repeated strings


@query("op12_suffix_array_dedup")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = repeats.cut_repeats(table(spark, sf_dir, "documents"))
    spans = F.size("spans").cast("bigint").alias("n_spans")
    return rows.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))
