"""The registered queries op<N>_<name> over the tables of a folder, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import blocks, bpe, decontam, jaccard, lattice, shard, suffixes, topk, toxicity, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of every document without the 50-byte strings that start in a smaller one."""
    return suffixes.report(_table(spark, sf_dir, "documents"), length=50)


def op2_pivot_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 best inner products of every 50th vector against all others."""
    return topk.search(_table(spark, sf_dir, "embeddings"), "id % 50 = 0", k=5, id_col="vec_id", vec_col="embedding", scale=256)


def op3_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metadata and a conversion record for every page."""
    r = warc.derive(_table(spark, sf_dir, "pages"), "page_id", "url", "html", bare=True)
    return r.withColumnRenamed("key", "page_id").withColumn("block", F.col("block").cast("string"))


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE over every whole document: counts and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_block_labeller(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return blocks.extract(_table(spark, sf_dir, "pages"))


def op6_subword_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log10 probability of every whole document under the subword lattice, and the base score."""
    import public_tokenizers

    return lattice.score(_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_size_aware_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The component of every document under links of 4-word shingle sets with a Jaccard similarity of 0.85 or more."""
    return jaccard.join(_table(spark, sf_dir, "documents"), words=4, percent=85).select("doc_id", "n_shingles", "component_id", "class_id")


def op8_suffix_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of every document inside benchmark windows, and whether it is contaminated."""
    return decontam.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("longest_run")


def op9_subsequence_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every whole document, learned from the labelled rows that are not held out."""
    documents = _table(spark, sf_dir, "documents")
    model = toxicity.fit(documents, _table(spark, sf_dir, "labels"))
    return toxicity.score(documents, model).select(
        "doc_id",
        F.expr("pmod(crc32(cast(doc_id as string)), 4) = 2").alias("held_out"),
        "score",
        F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"),
    )


def op10_ring_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents on a ring of 40 shards with counts at most one apart."""
    return shard.assign(_table(spark, sf_dir, "documents"), shards=40)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_pivot_topk": op2_pivot_topk,
    "op3_warc_derivatives": op3_warc_derivatives,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_block_labeller": op5_block_labeller,
    "op6_subword_lattice": op6_subword_lattice,
    "op7_size_aware_jaccard": op7_size_aware_jaccard,
    "op8_suffix_decontamination": op8_suffix_decontamination,
    "op9_subsequence_toxicity": op9_subsequence_toxicity,
    "op10_ring_shards": op10_ring_shards,
}

_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w"

_LOWER_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w"

ORACLE_SQL: dict[str, str] = {
    # bytes as two hexadecimal digits each, in pieces of 500, so that a string is found without counting from the text's start
    "op1_suffix_dedup": """
WITH x AS (SELECT doc_id, octet_length(encode(coalesce(text, ''))) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
piece AS (SELECT doc_id, n, unnest(range(0, len(c))) AS k, c FROM (SELECT doc_id, n, regexp_extract_all(h, '.{1,1000}') AS c FROM x)),
two AS (SELECT doc_id, n, k, c[k + 1] || coalesce(c[k + 2], '') AS s FROM piece),
g AS (SELECT doc_id, 500 * k + o AS p, md5_number(substr(s, 2 * o + 1, 100)) AS g FROM (SELECT *, unnest(range(0, least(500, n - 500 * k - 49))) AS o FROM two)),
f AS (SELECT g, min(doc_id) AS f FROM g GROUP BY g HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, p, p > lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 50 AS fresh FROM g JOIN f USING (g) WHERE doc_id > f),
run AS (SELECT doc_id, min(p) AS a, max(p) + 50 AS z FROM (SELECT *, count(*) FILTER (fresh) OVER (PARTITION BY doc_id ORDER BY p) AS i FROM hit) GROUP BY doc_id, i),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS y FROM run),
cut AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS last, string_agg(substr(h, 2 * y + 1, 2 * (a - y)), '' ORDER BY a) AS kept FROM gap JOIN x USING (doc_id) GROUP BY doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
    sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM x LEFT JOIN cut USING (doc_id)
""",
    "op7_size_aware_jaccard": f"""
WITH RECURSIVE d AS (SELECT doc_id, {_LOWER_WORDS} FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) BETWEEN 1 AND 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 2), lambda k: array_to_string(w[k:k + 3], ' ')) END) AS g FROM d),
sig AS (SELECT doc_id, count(*) AS n, string_agg(g, chr(10) ORDER BY g) AS sig FROM s GROUP BY doc_id),
class AS (SELECT doc_id, n, min(doc_id) OVER (PARTITION BY sig) AS rep FROM sig),
r AS (SELECT doc_id, n FROM class WHERE doc_id = rep),
rs AS (SELECT s.doc_id, n, g FROM s JOIN r USING (doc_id)),
link AS (SELECT a.doc_id AS a, b.doc_id AS b FROM rs a JOIN rs b USING (g) WHERE a.doc_id < b.doc_id AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS id, doc_id AS c FROM r UNION SELECT edge.b, reach.c FROM reach JOIN edge ON edge.a = reach.id WHERE reach.c < edge.b),
component AS (SELECT id, min(c) AS c FROM reach GROUP BY id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, coalesce(rep, d.doc_id) AS class_id, coalesce(c, d.doc_id) AS component_id
FROM d LEFT JOIN class USING (doc_id) LEFT JOIN component ON id = rep
""",
    "op8_suffix_decontamination": f"""
WITH b AS (SELECT item_id::VARCHAR AS item_id, {_WORDS} FROM benchmark),
win AS (
    SELECT item_id, n, unnest(list_transform(range(1, len(w) - n + 2), lambda k: array_to_string(w[k:k + n - 1], ' '))) AS g
    FROM (SELECT *, least(13, len(w)) AS n FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} FROM documents),
dg AS (
    SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d CROSS JOIN (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
h AS (SELECT DISTINCT doc_id, p, n, item_id FROM dg JOIN win USING (n, g)),
hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item_id FROM h) GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)
""",
    "op2_pivot_topk": """
WITH rows AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
    SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_inner_product(q.v::DOUBLE[], c.v::DOUBLE[])::BIGINT AS score
    FROM rows q JOIN rows c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 5
""",
}
