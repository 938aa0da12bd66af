"""Every operator of this folder as a registered query over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabscope.llm import (
    align,
    bpe,
    decontaminate,
    fingerprints,
    html_extract,
    id_codec,
    lm_score,
    near_dup,
    prefix_trie,
    suffix_dedup,
    toxicity,
    url_filter,
    warc,
)
from tabscope.llm.common import read_table

# Fixed value: the rules that the URL query applies.
URL_RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
#: Fixed value: the id that ends each document in token files.
END_ID = 2
#: Rows whose crc32 of the id, modulo 4, is this are never learnt from.
HELD_OUT = 2


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def main_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_texts(read_table(spark, sf_dir, "pages"))


def benchmark_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_passages(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return fingerprints.compare_edited(docs, fingerprints.lexicon(docs))


def near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read_table(spark, sf_dir, "documents"))


def bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def held_out() -> Column:
    return F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == HELD_OUT


def learnt_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "labels").filter(~held_out())


def toxicity_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = toxicity.fit_on(docs, learnt_labels(spark, sf_dir))
    return toxicity.score_documents(docs, model).select(
        "doc_id",
        F.coalesce(held_out(), F.lit(False)).alias("held_out"),
        "score",
        F.col("toxic").cast("int").alias("predicted"),
    )


def lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = lm_score.score_documents(read_table(spark, sf_dir, "documents"))
    return scores.select("doc_id", "n_words", *[F.round(c, 4).alias(c) for c in ("log_score", "mean_log")])


def repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.filter_urls(read_table(spark, sf_dir, "pages"), rules)


def token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = id_codec.write_ids(read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), END_ID)
    return id_codec.with_checksums(id_codec.read_documents(frames))


def conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rebuilt = prefix_trie.shared_heads(read_table(spark, sf_dir, "conversations"))
    return prefix_trie.prefix_trie(rebuilt)


def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
    scored = align.align_documents(read_table(spark, sf_dir, "documents"), *paths)
    return scored.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def page_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_html_extract": main_texts,
        "op2_decontaminate": benchmark_passages,
        "op3_fingerprints": document_fingerprints,
        "op4_near_dedup": near_dedup,
        "op5_bpe": bpe_round_trip,
        "op6_toxicity": toxicity_scores,
        "op7_lm_score": lm_scores,
        "op8_suffix_dedup": repeated_passages,
        "op9_url_filter": url_verdicts,
        "op10_id_codec": token_files,
        "op11_prefix_trie": conversation_trie,
        "op12_align": aligned_tokens,
        "op13_warc": page_archive,
    }


_RULE_ROWS = ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in URL_RULES)
URL_SQL = f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULE_ROWS}),
parts AS (
  SELECT page_id, coalesce(url, '') AS u, position('://' IN coalesce(url, '')) AS begins FROM pages
),
split AS (
  SELECT page_id,
    CASE WHEN begins = 0 THEN '' ELSE regexp_extract(substr(u, begins + 3), '^[^/?#]*') END AS raw_host,
    CASE WHEN begins = 0 THEN '' ELSE substr(u, begins + 3) END AS rest
  FROM parts
),
pieces AS (
  SELECT page_id, translate(raw_host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw_host) + 1), '^[^?#]*') AS path
  FROM split
)
SELECT page_id, host, path,
  (SELECT rule_host || rule_path FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
   ORDER BY length(rule_host) DESC, length(rule_path) DESC LIMIT 1) AS rule,
  coalesce((SELECT rule_verdict FROM rules
   WHERE (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
   ORDER BY length(rule_host) DESC, length(rule_path) DESC LIMIT 1), 'allow') AS verdict
FROM pieces
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = f"""words AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws
  FROM documents
)"""

NEAR_SQL = f"""
WITH RECURSIVE {_WORDS},
shingles AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) AS s
  FROM words WHERE len(ws) > 0
),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS n FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id
  GROUP BY x.doc_id, y.doc_id
),
links AS (
  SELECT a, b FROM common c JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
  WHERE 100 * c.n >= {near_dup.LINK_PERCENT} * (x.n + y.n - c.n)
),
reached AS (
  SELECT doc_id, doc_id AS other FROM documents
  UNION SELECT r.doc_id, l.b FROM reached r JOIN links l ON r.other = l.a
)
SELECT doc_id, coalesce(any_value(n), 0) AS n_shingles, min(other) AS component_id, doc_id = min(other) AS kept
FROM reached LEFT JOIN sizes USING (doc_id) GROUP BY doc_id
"""

LM_SQL = f"""
WITH {_WORDS},
tokens AS (SELECT doc_id, unnest(ws) AS word, unnest(range(len(ws))) AS place FROM words),
counts AS (SELECT word, count(*) AS n FROM tokens GROUP BY word),
total AS (SELECT CAST(sum(n) AS DOUBLE) AS t FROM counts),
grams AS (
  SELECT doc_id, lag(word, 1, ' ^') OVER (PARTITION BY doc_id ORDER BY place) AS v, word AS w FROM tokens
),
one AS (
  SELECT w AS word, CAST(count(*) AS DOUBLE) AS n FROM grams GROUP BY w
  UNION ALL SELECT ' ^', CAST(count(DISTINCT doc_id) AS DOUBLE) FROM grams
),
own AS (SELECT doc_id, v, w, CAST(count(*) AS DOUBLE) AS n FROM grams GROUP BY doc_id, v, w),
two AS (SELECT v, w, sum(n) AS n FROM own GROUP BY v, w),
scores AS (
  SELECT doc_id, CAST(sum(o.n) AS BIGINT) AS n_words,
    sum(o.n * CASE WHEN p.n > o.n THEN ln(p.n - o.n) - ln(a.n) ELSE ln({lm_score.BACKOFF} * b.n / t) END) AS score
  FROM own o JOIN two p ON p.v = o.v AND p.w = o.w JOIN one a ON a.word = o.v JOIN one b ON b.word = o.w CROSS JOIN total
  GROUP BY doc_id
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, round(coalesce(score, 0.0), 4) AS log_score, round(score / n_words, 4) AS mean_log
FROM documents LEFT JOIN scores USING (doc_id)
"""

_BYTES = suffix_dedup.LENGTH
REPEATS_SQL = f"""
WITH data AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
starts AS (
  SELECT doc_id, h, unnest(range(length(h) // 2 - {_BYTES - 1})) AS p FROM data WHERE length(h) >= {2 * _BYTES}
),
strings AS (SELECT doc_id, p, md5(substr(h, 2 * p + 1, {2 * _BYTES})) AS s FROM starts),
hits AS (SELECT doc_id, p FROM strings WHERE s IN (SELECT s FROM strings GROUP BY s HAVING count(*) > 1)),
marked AS (
  SELECT doc_id, p, coalesce(p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + {_BYTES}, TRUE) AS first FROM hits
),
grouped AS (SELECT doc_id, p, sum(CAST(first AS INT)) OVER (PARTITION BY doc_id ORDER BY p) AS span FROM marked),
spans AS (SELECT doc_id, span, min(p) AS b, max(p) + {_BYTES} AS e FROM grouped GROUP BY doc_id, span),
between_spans AS (
  SELECT doc_id, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY b), 0) AS k, b FROM spans
  UNION ALL SELECT doc_id, max(e), 4000000000 FROM spans GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * k + 1, 2 * least(b - k, length(h))), '' ORDER BY k) AS h FROM between_spans JOIN data USING (doc_id)
  GROUP BY doc_id
),
sizes AS (SELECT doc_id, CAST(sum(e - b) AS BIGINT) AS removed, count(*) AS n FROM spans GROUP BY doc_id)
SELECT doc_id, length(d.h) // 2 AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(n, 0) AS n_spans,
  sha256(unhex(coalesce(k.h, d.h))) AS kept_sha256
FROM data d LEFT JOIN kept k USING (doc_id) LEFT JOIN sizes USING (doc_id)
"""


TRIE_SQL = """
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) - 1 AS k
  FROM conversations WHERE conv_id IS NOT NULL
),
letters AS (SELECT DISTINCT conv_id, list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)) AS cs FROM own),
sums AS (
  SELECT conv_id, list_reduce(list_prepend(CAST(4294967295 AS UBIGINT), cs), lambda v, c:
    list_reduce(list_prepend(xor(v, c), list_transform(range(8), lambda i: CAST(0 AS UBIGINT))), lambda u, z: xor(u >> 1, (u & 1) * 3988292384))) AS v
  FROM letters
),
heads AS (SELECT conv_id, xor(v, CAST(4294967295 AS UBIGINT)) % 9 AS h FROM sums),
rebuilt AS (
  SELECT c.conv_id, 0 AS part, k, r, x FROM heads c JOIN own t ON t.conv_id = c.conv_id - c.conv_id % 5 AND k < h
  UNION ALL SELECT conv_id, 1, k, r, x FROM own JOIN heads USING (conv_id) WHERE k >= h
),
paths AS (
  SELECT conv_id, row_number() OVER w AS d, octet_length(encode(x)) AS size,
    string_agg(md5(length(r) || ':' || r || x), '') OVER w AS p
  FROM rebuilt WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)
),
lengths AS (SELECT conv_id, coalesce(max(d), 0) AS last FROM heads LEFT JOIN paths USING (conv_id) GROUP BY conv_id),
members AS (SELECT conv_id, d, size, p FROM paths UNION ALL SELECT conv_id, 0, 0, '' FROM heads),
nodes AS (
  SELECT p, min(conv_id) AS conv_id, min(d) AS depth, count(*) AS n_convs, (count(*) - 1) * min(size) AS saved,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE d = last), '')) AS ends_sha256
  FROM members JOIN lengths USING (conv_id) GROUP BY p
),
below AS (SELECT left(p, length(p) - 32) AS p, count(*) AS n_children FROM nodes WHERE p <> '' GROUP BY 1),
trees AS (
  SELECT a.p, CAST(sum(b.saved) AS BIGINT) AS saved_tokens, count(*) FILTER (WHERE k.p IS NULL) AS n_leaves
  FROM nodes a JOIN nodes b ON starts_with(b.p, a.p) LEFT JOIN below k ON k.p = b.p GROUP BY a.p
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens,
  n.ends_sha256
FROM nodes n JOIN trees t ON t.p = n.p LEFT JOIN below k ON k.p = n.p LEFT JOIN nodes u ON n.p <> '' AND u.p = left(n.p, length(n.p) - 32)
"""

ARCHIVE_SQL = """
WITH data AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
sums AS (SELECT page_id, h, sha1(h) AS s FROM data),
keepers AS (SELECT h, max(page_id) AS keeper FROM data GROUP BY h)
SELECT page_id, octet_length(encode(h)) AS payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((CAST('0x' || substr(s, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31 AS INT) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM sums JOIN keepers USING (h)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op4_near_dedup": NEAR_SQL,
        "op7_lm_score": LM_SQL,
        "op8_suffix_dedup": REPEATS_SQL,
        "op9_url_filter": URL_SQL,
        "op11_prefix_trie": TRIE_SQL,
        "op13_warc": ARCHIVE_SQL,
    }
