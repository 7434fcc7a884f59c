"""Registered queries of this subpackage and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyloom.llm import bpe, filter_audit, hamming_search, language_id, line_dedup, mixing, near_dup, packing, periodic_runs, token_counts, toxicity, warc, winnow
from tallyloom.llm.folds import held_out
from tallyloom.session import table

VOCABULARY_FILE = "byte_bpe_50k.json"
NEIGHBOURS = 10
QUERY_STEP = 100


def vocabulary() -> bpe.Vocabulary:
    return bpe.load_vocabulary(public_tokenizers.path(VOCABULARY_FILE))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the text without repeated three-line windows, n_lines, n_removed."""
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict(docs, language_id.fit(docs), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op4_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = winnow.compare_edits(table(spark, sf_dir, "documents"))
    return rows.select(
        "doc_id",
        "n_chars",
        F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        winnow.digest(F.col("prints"), F.col("prints_at")).alias("fingerprint"),
        winnow.digest(F.col("edited_prints"), F.col("edited_prints_at")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
    )


def op6_hamming_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, rank, vec_id, distance over the sign codes of all embeddings, a query's own row included."""
    rows = table(spark, sf_dir, "embeddings")
    bits = hamming_search.dimension(rows)
    codes = rows.select(F.col("vec_id").alias("id"), hamming_search.sign_code(F.col("embedding"), bits).alias("code"))
    near = hamming_search.top_k(codes, codes.where(F.col("id") % QUERY_STEP == 0), NEIGHBOURS, bits)
    return near.select("query_id", "rank", F.col("id").alias("vec_id"), "distance")


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).select("doc_id", "size", "source_size", "target", "taken")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")), ["doc_id"])
    return found.select("doc_id", held_out().alias("held_out"), "score", "predicted")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), vocabulary(), ["doc_id"])


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, tokens before and after three edits a document, words in all and encoded again, digest of the edited text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", token_counts.sample_edits(F.col("text"), F.col("source")).alias("edits"))
    v = vocabulary()
    done = token_counts.apply_edits(token_counts.build_trees(docs, v), v, with_trees=False)
    return done.select("doc_id", "n_tokens", "edited_tokens", "n_words", "reencoded_words", F.sha2(F.encode("text", "UTF-8"), 256).alias("edited_sha256"))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def repeating(text: Column, doc_id: Column) -> Column:
    """The text whose words repeat from one of them on, with a period, for a tenth of the ids; other texts as they are."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), "")

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        at = lambda i: F.when(i < a, i).otherwise(a + (i - a) % p).cast("int")
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, at(i))), " ")).otherwise("")

    return F.when(h % 10 == 0, F.get(F.transform(F.array(words), repeated), F.lit(0))).otherwise(text)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", repeating(F.col("text"), F.col("doc_id")).alias("text"))
    rows = periodic_runs.find_runs(docs, keep=["doc_id"]).withColumn("best", periodic_runs.longest(F.col("runs")))
    return rows.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(F.col("best")[c].alias(c) for c in ("start", "length", "period")),
        F.floor(F.lit(1000) * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.encode(periodic_runs.listing(F.col("runs")), "UTF-8"), 256).alias("runs_sha256"),
        F.sha2(F.encode("collapsed", "UTF-8"), 256).alias("collapsed_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_line_dedup, op2_warc, op3_language_id, op4_near_dup, op5_winnowing, op6_hamming_topk, op7_mixing, op8_toxicity, op9_bpe, op10_token_counts, op11_packing, op12_filter_audit, op13_periodic_runs)
    return {f.__name__: f for f in ops}


_LINES = """
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM documents WHERE text IS NOT NULL),
windows AS (
  SELECT doc_id, pos, line AS a, lead(line) OVER w AS b, lead(line, 2) OVER w AS c
  FROM lines WINDOW w AS (PARTITION BY doc_id ORDER BY pos)),
ranked AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS n
  FROM windows WHERE c IS NOT NULL),
covered AS (SELECT DISTINCT doc_id, pos + unnest([0, 1, 2]) AS pos FROM ranked WHERE n > 1),
kept AS (
  SELECT l.doc_id, count(*) AS n_lines, count(c.pos) AS n_removed,
         coalesce(string_agg(l.line, chr(10) ORDER BY l.pos) FILTER (WHERE c.pos IS NULL), '') AS text
  FROM lines l LEFT JOIN covered c ON l.doc_id = c.doc_id AND l.pos = c.pos GROUP BY l.doc_id)
SELECT d.doc_id, k.text, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed
FROM documents d LEFT JOIN kept k USING (doc_id)
"""

_WARC = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS owner FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.owner IS NULL OR g.owner = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.owner <> p.page_id THEN g.owner END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""

_NEAR_DUP = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(words) < 5 THEN array_to_string(words, ' ')
                               ELSE array_to_string(list_slice(words, i, i + 4), ' ') END AS s
  FROM (SELECT doc_id, words, unnest(range(1, greatest(len(words) - 3, 2))) AS i FROM w WHERE len(words) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common
  FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * common >= 85 * (x.n + y.n - common)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, r.root AS component_id, d.doc_id = r.root AS kept
FROM documents d LEFT JOIN sizes s USING (doc_id) JOIN (SELECT a, min(b) AS root FROM reach GROUP BY a) r ON r.a = d.doc_id
"""

_HAMMING = """
WITH codes AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS code FROM embeddings),
ranked AS (
  SELECT q.vec_id AS query_id, c.vec_id, hamming(q.code, c.code) AS distance,
         row_number() OVER (PARTITION BY q.vec_id ORDER BY hamming(q.code, c.code), c.vec_id) AS rank
  FROM codes q, codes c WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, CAST(distance AS INTEGER) AS distance FROM ranked WHERE rank <= 10
"""

_MIXING = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source),
w AS (SELECT *, 3 * size AS cap, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS weight FROM s),
f AS (
  SELECT *, CAST(sum(size) OVER () - coalesce(sum(cap) OVER o, 0) AS BIGINT) AS rest,
         CAST(sum(weight) OVER () - coalesce(sum(weight) OVER o, 0) AS BIGINT) AS open, row_number() OVER p AS place
  FROM w WINDOW p AS (ORDER BY cap / weight, source IS NULL, source),
                o AS (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT min(place) AS at FROM f WHERE rest * weight <= cap * open),
t AS (
  SELECT f.source, f.size AS source_size,
         CASE WHEN f.place < l.at THEN CAST(f.cap AS DOUBLE)
              ELSE coalesce(CAST(g.rest * f.weight AS DOUBLE) / CAST(g.open AS DOUBLE), 0.0) END AS target
  FROM f, l LEFT JOIN f g ON g.place = l.at),
u AS (SELECT *, CASE WHEN source_size > 0 THEN least(CAST(floor(target / source_size) AS BIGINT), 3) ELSE 0 END AS whole FROM t),
r AS (
  SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.target - u.whole * u.source_size AS missing,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.draw ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
  FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(whole + CASE WHEN CAST(2 * ahead + size AS DOUBLE) <= 2 * missing THEN 1 ELSE 0 END, 3) AS BIGINT) AS taken
FROM r
"""


_AUDIT = r"""
WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY text) AS first FROM d),
l AS (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
f AS (
  SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
         CAST(len(words) < 50 AS INTEGER) + 2 * CAST(100 * len(list_distinct(words)) < 65 * len(words) AS INTEGER)
         + 4 * CAST(100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 5 * length(text) AS INTEGER)
         + 8 * CAST(regexp_matches(text, '[#$%&*|]') AS INTEGER) + 16 * CAST(coalesce(w.doc_id > first, false) AS INTEGER) AS mask
  FROM w LEFT JOIN l ON l.doc_id = w.doc_id),
m AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM f GROUP BY 1, 2),
orders AS (
  SELECT '' AS o, 0 AS k UNION ALL
  SELECT o || x, k + 1 FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x) WHERE k < 5 AND NOT contains(o, x)),
steps AS (
  SELECT o, k, 1 << CAST(ascii(substr(o, k, 1)) - 65 AS INTEGER) AS bit,
         coalesce((SELECT CAST(sum(1 << CAST(ascii(substr(o, j, 1)) - 65 AS INTEGER)) AS INTEGER) FROM range(1, 6) r(j) WHERE j < k), 0) AS before
  FROM (SELECT o, unnest(range(1, 6)) AS k FROM orders WHERE k = 5)),
r AS (
  SELECT part, o AS filter_order, CAST(k AS INTEGER) AS step, bit,
         CAST(coalesce(sum(n) FILTER (mask & (before | bit) = 0), 0) AS BIGINT) AS kept,
         CAST(coalesce(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS removed,
         CAST(coalesce(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0), 0) AS BIGINT) AS redundant,
         CAST(coalesce(sum(n) FILTER (mask = bit), 0) AS BIGINT) AS unique_fails,
         CAST(coalesce(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS good_lost,
         CAST(coalesce(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0), 0) AS BIGINT) AS toxic_lost
  FROM m, steps GROUP BY ALL)
SELECT * EXCLUDE (bit), CAST(sum(removed) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r
"""

_RUNS = r"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (
  SELECT row_number() OVER () AS row, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS h
  FROM documents, crc),
e AS (SELECT *, len(w) AS n, h // 10 AS g, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
q AS (SELECT row, doc_id, w, CASE WHEN h % 10 = 0 THEN a END AS a, 1 + (n - a) // (3 + g % 8) AS p FROM e),
words AS (
  SELECT row, i, CASE WHEN i >= a THEN w[a + (i - a) % p + 1] ELSE w[i + 1] END AS x, len(w) AS n
  FROM (SELECT *, unnest(range(len(w))) AS i FROM q)),
pairs AS (
  SELECT l.row, l.i, r.i - l.i AS d FROM words l JOIN words r ON l.row = r.row AND l.x = r.x AND r.i > l.i AND 2 * (r.i - l.i) <= l.n),
stretches AS (
  SELECT row, d, min(i) AS start, count(*) + d AS length
  FROM (SELECT *, i - row_number() OVER (PARTITION BY row, d ORDER BY i) AS island FROM pairs) GROUP BY row, d, island
  HAVING count(*) >= d AND count(*) + d >= 12),
runs AS (SELECT row, start, length, min(d) AS period FROM stretches GROUP BY ALL),
best AS (
  SELECT row, count(*) AS n_runs, first(start ORDER BY length DESC, start, period) AS start, max(length) AS length,
         first(period ORDER BY length DESC, start, period) AS period,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM runs GROUP BY row),
dropped AS (SELECT DISTINCT row, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT row, string_agg(x, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (row, i) GROUP BY row)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM d LEFT JOIN best USING (row) LEFT JOIN kept USING (row)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op2_warc": _WARC, "op4_near_dup": _NEAR_DUP, "op6_hamming_topk": _HAMMING, "op7_mixing": _MIXING, "op12_filter_audit": _AUDIT, "op13_periodic_runs": _RUNS}
