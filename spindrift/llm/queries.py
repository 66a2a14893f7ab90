"""The queries op1 to op13: each applies its operator to a whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindrift.llm import bpe, exact_dedup, language, near_dedup, neighbours, packing, pii, quality, ranking, rolling, sharding, toxicity, warc
from spindrift.sources import tables



def tokenizer(name: str) -> str:
    """Where a public vocabulary lies; the path is a parameter of each operator that takes one."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _documents(spark, sf_dir):
    return tables.spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op1_packing(spark, sf_dir):
    """The checksum is that of the ids which the operator gives, after they have been placed."""
    packed = packing.pack(_documents(spark, sf_dir), tokenizer("byte_bpe_50k.json"))
    return packed.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


def op2_neighbours(spark, sf_dir):
    return neighbours.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 100 == 0)


def op3_near_dedup(spark, sf_dir):
    return near_dedup.dedup(_documents(spark, sf_dir))


#: Documents with equal sets are one; the others are joined by their shingles, and components are what can be reached.
OP3_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(list_zip(w[:-5], w[2:-4], w[3:-3], w[4:-2], w[5:]), lambda z: concat_ws(' ', z[1], z[2], z[3], z[4], z[5]))) END AS g FROM w
), d AS (
  SELECT doc_id, g, len(g) AS n, min(doc_id) OVER (PARTITION BY CASE WHEN len(g) = 0 THEN CAST(doc_id AS VARCHAR) ELSE md5(array_to_string(list_sort(g), chr(10))) END) AS rep FROM g
), s AS (
  SELECT doc_id AS rep, n, unnest(g) AS shingle FROM d WHERE doc_id = rep AND n > 0
), e AS (
  SELECT a.rep AS a, b.rep AS b FROM s a JOIN s b ON a.shingle = b.shingle AND a.rep <> b.rep AND 100 * a.n >= 85 * b.n AND 100 * b.n >= 85 * a.n
  GROUP BY a.rep, b.rep, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), reached(rep, root) AS (
  SELECT DISTINCT rep, rep FROM d UNION SELECT e.b, reached.root FROM reached JOIN e ON e.a = reached.rep
), c AS (
  SELECT rep, min(root) AS component_id FROM reached GROUP BY 1
)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM d JOIN c USING (rep)
"""


def op4_sharding(spark, sf_dir):
    return sharding.layout(_documents(spark, sf_dir))


def op5_exact_dedup(spark, sf_dir):
    return exact_dedup.dedup(_documents(spark, sf_dir)).drop("n_points")


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
), r AS (
  SELECT doc_id, sha256(norm) AS text_sha256, count(*) OVER (PARTITION BY norm) AS group_size,
    first_value(doc_id) OVER (PARTITION BY norm ORDER BY n_points DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS keep_id
  FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM r
"""


def _labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op6_quality(spark, sf_dir):
    return quality.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op7_warc(spark, sf_dir):
    return warc.round_trip(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: Five hexadecimal digits are four of base 32.
OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), m AS (
  SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p
)
SELECT page_id, payload_bytes, array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    ((CAST('0x' || substr(h, (k // 4) * 5 + 1, 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM m
"""


def op8_pii(spark, sf_dir):
    return pii.report(_documents(spark, sf_dir))


def op9_toxicity(spark, sf_dir):
    return toxicity.classify(_documents(spark, sf_dir), _labels(spark, sf_dir))


def op10_bpe(spark, sf_dir):
    out = bpe.encode(_documents(spark, sf_dir), tokenizer("word_bpe_49k.json"))
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op11_rolling(spark, sf_dir):
    return rolling.windows_of_documents(_documents(spark, sf_dir))


_CRC_STEP = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_CRC = "xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


def _op11_sql() -> str:
    def of(width: int) -> str:
        frame = f"OVER (PARTITION BY source ORDER BY event_s RANGE BETWEEN {width} PRECEDING AND 1 PRECEDING)"
        return f"""SELECT doc_id, {width} AS window_s, event_s, count(*) {frame} AS n_events, sum(n) {frame} AS total, count(DISTINCT lang) {frame} AS n_langs,
    list_sort(list(n) FILTER (WHERE n IS NOT NULL) {frame}) AS held FROM e"""

    return f"""WITH steps AS (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)), lambda c, k: {_CRC_STEP}) AS v FROM range(256) AS r(i)), tab AS (SELECT list(v ORDER BY i) AS t FROM steps),
 h AS (SELECT doc_id, source, lang, length(text) AS n, {_CRC} AS h FROM documents, tab),
 e AS (SELECT doc_id, source, lang, n, 60 * CAST(floor((doc_id + h % 10000) / 6) AS BIGINT) AS event_s FROM h),
 w AS ({of(600)} UNION ALL {of(43200)})
SELECT doc_id, CAST(window_s AS BIGINT) AS window_s, event_s, CAST(n_events AS BIGINT) AS n_events, CAST(coalesce(total, 0) AS BIGINT) AS sum_chars, CAST(n_langs AS BIGINT) AS n_langs,
 CAST(held[(len(held) + 1) // 2] AS BIGINT) AS median_chars, CAST(held[(9 * len(held) + 9) // 10] AS BIGINT) AS high_chars FROM w"""


def op12_language(spark, sf_dir):
    return language.classify(_documents(spark, sf_dir))


def op13_ranking(spark, sf_dir):
    return ranking.search(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


_TERMS = r"regexp_extract_all(regexp_replace(translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '\x00', ' ', 'g'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP13_SQL = f"""
WITH q AS (SELECT DISTINCT item_id, unnest({_TERMS.format('text')}) AS term FROM benchmark),
 w AS (SELECT doc_id, {_TERMS.format('text')} AS t FROM documents WHERE text IS NOT NULL),
 s AS (SELECT count(*) FILTER (WHERE len(t) > 0) AS n_docs, CAST(sum(len(t)) AS BIGINT) AS n_terms FROM w),
 each AS (SELECT doc_id, len(t) AS n, unnest(t) AS term FROM w),
 p AS (SELECT doc_id, n, term, count(*) AS tf FROM each WHERE term IN (SELECT term FROM q) GROUP BY 1, 2, 3),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
 v AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * n_docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS weight FROM f, s),
 scored AS (SELECT item_id, doc_id, CAST(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * n_docs) // n_terms)))) AS BIGINT) AS score
   FROM q JOIN p USING (term) JOIN v USING (term), s GROUP BY 1, 2),
 ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 10
"""


def queries():
    return {f.__name__: f for f in (op1_packing, op2_neighbours, op3_near_dedup, op4_sharding, op5_exact_dedup, op6_quality, op7_warc, op8_pii, op9_toxicity, op10_bpe, op11_rolling, op12_language, op13_ranking)}


def oracle_sql():
    return {"op3_near_dedup": OP3_SQL, "op5_exact_dedup": OP5_SQL, "op7_warc": OP7_SQL, "op11_rolling": _op11_sql(), "op13_ranking": OP13_SQL}
