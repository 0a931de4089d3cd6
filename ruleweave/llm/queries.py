"""The queries of this subpackage over the driver's tables, and their SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import scratch
from .scratch import table


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bit-packed token blocks of all documents, written and read back."""
    from . import tokens

    out = scratch.path(spark, "token-blocks")
    tokens.write(table(spark, sf_dir, "documents"), out, tokenizer_file("byte_bpe_50k.json"))
    return tokens.documents(spark, out)


def op2_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    from . import html_text

    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near-duplicate documents, over all documents."""
    from . import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), share=85).drop("tie")


def op4_packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 2048 tokens."""
    from . import packing

    return packing.digests(packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_file("word_bpe_49k.json")))


def op5_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents."""
    from . import langid

    return langid.identify(table(spark, sf_dir, "documents")).select("doc_id", "held_out", "lang_pred", "score", "rejected")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents."""
    from . import toxicity

    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("tie")


def op7_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All texts as stored 8-bit audio, and its features."""
    from . import audio

    out = scratch.path(spark, "media")
    audio.write_media(table(spark, sf_dir, "documents"), out)
    found = scratch.path(spark, "audio-features")
    audio.write_features(spark.read.parquet(out), found)
    return audio.digests(spark.read.parquet(found))


def op8_contamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in all documents."""
    from . import decontam

    return decontam.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("tie")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and recurrent language-model scores of all documents."""
    from . import lm

    return lm.score(table(spark, sf_dir, "documents"))


def op10_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of nearly equal bytes."""
    from . import sharding

    placed = sharding.shard(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


Query = Callable[[SparkSession, str], DataFrame]


def program(query: Query) -> Query:
    """The query as a program of its own, which sets up its session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        scratch.small_batches(spark)
        return query(spark, sf_dir)

    return run


QUERIES: dict[str, Query] = {
    f.__name__: program(f)
    for f in (op1_token_blocks, op2_main_text, op3_near_duplicates, op4_packed, op5_languages, op6_toxicity, op7_audio, op8_contamination, op9_lm_scores, op10_shards)
}

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

NEAR_SQL = rf"""
WITH RECURSIVE words AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all({LOWER.format("text")}, '[^\x20\x09-\x0D]+') AS w FROM documents),
sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 OR w IS NULL THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS s FROM words),
one AS MATERIALIZED (SELECT doc_id, CAST(len(s) AS BIGINT) AS n, md5(CAST(list_sort(s) AS VARCHAR)) AS h, s FROM sets),
reps AS MATERIALIZED (SELECT min(doc_id) AS id, any_value(n) AS n, any_value(s) AS s, h FROM one WHERE n > 0 GROUP BY h),
terms AS MATERIALIZED (SELECT id, n, unnest(s) AS t FROM reps),
links AS MATERIALIZED (
  SELECT a.id AS x, b.id AS y FROM terms a JOIN terms b ON a.t = b.t AND a.id < b.id
    AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
  GROUP BY a.id, b.id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edges AS MATERIALIZED (SELECT x, y FROM links UNION ALL SELECT y, x FROM links),
reach(node, root) AS (
  SELECT id, id FROM reps UNION SELECT e.y, r.root FROM reach r JOIN edges e ON e.x = r.node AND r.root < e.y),
comp AS MATERIALIZED (SELECT node, min(root) AS root FROM reach GROUP BY node)
SELECT o.doc_id, o.n AS n_shingles, coalesce(c.root, o.doc_id) AS component_id,
  coalesce(c.root, o.doc_id) = o.doc_id AS kept
FROM one o LEFT JOIN reps r ON r.h = o.h AND o.n > 0 LEFT JOIN comp c ON c.node = r.id
"""

CONTAMINATION_SQL = rf"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS MATERIALIZED (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({LOWER.format("text")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS MATERIALIZED (
  SELECT DISTINCT item, least(len(w), 10) AS n,
    unnest(list_transform(range(1, len(w) - least(len(w), 10) + 2), lambda i: array_to_string(w[i:i + least(len(w), 10) - 1], ' '))) AS phrase
  FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM bw),
dw AS MATERIALIZED (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes)),
m AS MATERIALIZED (SELECT dw.doc_id, dw.i, dw.n, bw.item FROM dw JOIN bw ON dw.phrase = bw.phrase AND dw.n = bw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
k AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN k USING (doc_id)
"""

SHARDS_SQL = """
WITH tab AS (SELECT list(list_reduce(list_prepend(n, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT unnest(range(256)) AS n)),
bytes AS (SELECT doc_id, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)) AS b FROM documents),
sized AS (SELECT doc_id, CAST(len(b) + 1 AS BIGINT) AS size, xor(list_reduce(list_prepend(4294967295, b), lambda c, x: xor(c >> 8, t[CAST(xor(c, x) & 255 AS INTEGER) + 1])), 4294967295) AS text_crc32 FROM bytes, tab),
placed AS (SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto, sum(size) OVER () AS total FROM sized),
cutted AS (SELECT *, CAST(least(15, (2 * (upto - size) + size) * 16 // (2 * total)) AS INTEGER) AS shard FROM placed)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM cutted
"""

SQL: dict[str, str] = {
    "op10_shards": SHARDS_SQL,
    "op3_near_duplicates": NEAR_SQL,
    "op8_contamination": CONTAMINATION_SQL,
}
