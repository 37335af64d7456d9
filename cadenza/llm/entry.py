"""Queries of the training-data operators and their SQL, as ``__spark_entry__`` adds them."""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.jaccard import JaccardJoin

    return JaccardJoin(read(spark, sf_dir, "documents"), n=3, threshold=Fraction(9, 10)).labelled()


def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cadenza.llm.tokenfile import read_tokens, write_tokens

    return read_tokens(write_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op4_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.mih import search

    return search(read(spark, sf_dir, "embeddings"), every=20, k=20)


def op5_line_crf_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.quality import score_quality

    return score_quality(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")).drop("text")


def op6_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.decontaminate import decontaminate

    hits = decontaminate(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return hits.select("doc_id", "n_words", "n_hit", F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_nb_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.toxicity import score_toxicity

    return score_toxicity(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "labels")).drop("text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.warc import read_warc, write_warc

    return read_warc(write_warc(read(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cadenza.llm.mixing import mix
    from cadenza.llm.tokencount import count_tokens

    counted = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), keep=("source",))
    return mix(counted, repeats=2.0, n_tokens=F.col("n_tokens") + 1)


def op3_trie_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from cadenza.llm.tokencount import count_tokens

    return count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op10_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from cadenza.llm.shards import shard

    return shard(read(spark, sf_dir, "documents"), shards=8)


QUERIES = {
    "op1_token_files": op1_token_files,
    "op2_temperature_mixing": op2_temperature_mixing,
    "op3_trie_token_counts": op3_trie_token_counts,
    "op10_balanced_shards": op10_balanced_shards,
    "op4_multi_index_hashing": op4_multi_index_hashing,
    "op5_line_crf_quality": op5_line_crf_quality,
    "op6_winnowing": op6_winnowing,
    "op7_nb_toxicity": op7_nb_toxicity,
    "op8_warc": op8_warc,
    "op9_ngram_jaccard": op9_ngram_jaccard,
}

#: A-Z as a-z, other letters as they are.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL: dict[str, str] = {
    "op8_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
m AS (SELECT h, min(page_id) AS first_id FROM p WHERE strlen(h) >= 100 GROUP BY h)
SELECT p.page_id, CAST(strlen(p.h) AS BIGINT) AS payload_bytes, sha256(p.h) AS payload_digest,
  CASE WHEN p.page_id > m.first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN p.page_id > m.first_id THEN m.first_id END AS refers_to
FROM p LEFT JOIN m ON m.h = p.h""",
    "op6_winnowing": rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS name, regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
size AS (SELECT name, w, least(len(w), 10) AS n FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT name, n, array_to_string(w[p : p + n - 1], ' ') AS t FROM (SELECT name, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM size) x),
dwin AS (SELECT r, p, n, array_to_string(w[p : p + n - 1], ' ') AS t FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM win) l WHERE len(w) >= n) x),
met AS (SELECT r, p, x.n, name FROM dwin x JOIN win ON win.n = x.n AND win.t = x.t),
hit AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, q FROM (SELECT r, unnest(range(p, p + n)) AS q FROM (SELECT DISTINCT r, p, n FROM met) y) z) u GROUP BY r),
named AS (SELECT r, count(DISTINCT name) AS n_items, string_agg(DISTINCT name, ',' ORDER BY name) AS names FROM met GROUP BY r)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit ON hit.r = d.r LEFT JOIN named ON named.r = d.r""",
    "op9_ngram_jaccard": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_sort(list_distinct(list_transform(range(1, len(w) - 1), lambda p: array_to_string(w[p : p + 2], ' ')))) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM d),
c AS (SELECT sh, len(sh) AS n, min(doc_id) AS c FROM s WHERE len(sh) > 0 GROUP BY sh),
t AS (SELECT c, n, unnest(sh) AS x FROM c),
p AS (SELECT a.c AS a, b.c AS b, a.n AS na, b.n AS nb, count(*) AS i FROM t a JOIN t b ON a.x = b.x AND a.c < b.c GROUP BY ALL HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach AS (SELECT c AS a, c AS b FROM c UNION SELECT reach.a, e.b FROM reach JOIN e ON e.a = reach.b),
root AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s.sh) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id
FROM s LEFT JOIN c ON c.sh = s.sh LEFT JOIN root ON root.a = c.c""",
}
