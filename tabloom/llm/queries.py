"""The registered queries of this subpackage and their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn
    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_WARC_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload, hex, CAST(strlen(payload) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 8), lambda i:
      array_to_string(list_transform([32768, 1024, 32, 1], lambda f:
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               CAST(((CAST('0x' || substr(hex, CAST(1 + 5 * i AS BIGINT), 5) AS BIGINT) // f) % 32) + 1 AS BIGINT), 1)), '')), '') AS payload_digest,
    max(page_id) OVER (PARTITION BY hex) AS top
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> top THEN top END AS refers_to
FROM d
"""


@query("op1_warc", _WARC_SQL)
def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write every page as a WARC record, then read all of them back by the index."""
    from .warc import read_records, write_archive
    index = write_archive(table(spark, sf_dir, "pages"), min_payload=0)
    return read_records(index).select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")


@query("op9_simhash")
def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash classes of all documents: 3-word shingles, at most 3 differing bits."""
    from .simhash import near_duplicates
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=3)


@query("op10_sharding")
def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards of nearly equal bytes; equal texts stay together."""
    from .sharding import assign_shards
    out = assign_shards(table(spark, sf_dir, "documents"), shards=16)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))


def _bpe_file() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


@query("op2_bpe")
def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of all documents, by shared chunks, and their decoded texts."""
    from .bpe import counted, decode, encode
    path = _bpe_file()
    out = decode(counted(encode(table(spark, sf_dir, "documents"), path)), path)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"),
                      F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query("op6_token_store")
def op6_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ids of all documents written as token files and read back by the index."""
    from .token_store import read_tokens, write_tokens
    index = write_tokens(table(spark, sf_dir, "documents"), _bpe_file(), end_id=0)
    return read_tokens(index).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


@query("op5_quality")
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents by the rule ensemble learnt from ``labels``."""
    from .quality import classify
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return classify(table(spark, sf_dir, "documents"), labels, threshold=0.3)[0]


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, with the item and the windows matched."""
    from .decontaminate import contaminated
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op3_chat")
def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that imitates the template, formatted and read back."""
    from .chat import conversation_digests, format_conversations
    tricky = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return conversation_digests(format_conversations(rows, _bpe_file(), budget=1024, history=256))


_TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.e) = len(q.e)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""


@query("op8_exact_topk", _TOPK_SQL)
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 largest integer inner products of every hundredth vector with all others."""
    from .topk import integer_vectors, top_k
    return top_k(integer_vectors(table(spark, sf_dir, "embeddings")), F.col("vec_id") % 100 == 0, k=10)


@query("op7_pseudo_likelihood")
def op7_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Masked pseudo-likelihood of all documents under a network learnt from them."""
    from .pseudo import fit, score
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs))


_MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))), 1, 13) AS BIGINT) AS draw
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source
), w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight, 2.0::DOUBLE * source_size AS most FROM s
), p AS (
  SELECT *, coalesce(sum(most) OVER earlier, 0) AS capped, sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0) AS weights_left,
    1.5::DOUBLE * sum(source_size) OVER () AS everything
  FROM w WINDOW earlier AS (ORDER BY most / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), t AS (
  SELECT max((everything - capped) / weights_left) AS level FROM p
), g AS (
  SELECT source, source_size, least(weight * level, most) AS target FROM w, t
), r AS (
  SELECT d.doc_id, d.size, d.draw, g.source_size, g.target, CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate
  FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source
)
SELECT doc_id, size, source_size, target,
  CAST(size * (floor(rate) + CASE WHEN draw < (rate - floor(rate)) * 4503599627370496 THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM r
"""


@query("op13_source_mixing", _MIX_SQL)
def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with the words that a mix of 150% takes: weights 5, 2, 1, none over twice."""
    from .mixing import mixture
    out = mixture(table(spark, sf_dir, "documents"), weights=(5, 2, 1), share=1.5, cap=2.0)
    return out.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_SPELLING_SQL = r"""
WITH RECURSIVE table_of_crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(range(0, 8), lambda v, k:
    CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384) ELSE v // 2 END, i)) AS crc
), runs AS (
  SELECT doc_id, word, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS word FROM documents)
  WHERE length(word) >= 6 GROUP BY ALL
), named AS (
  SELECT word, n, flatten(list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || word, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)] ELSE [195, unicode(c) - 64] END)) AS bytes
  FROM runs
), hashed AS (
  SELECT word, n, xor(list_reduce(bytes, lambda v, b: xor(v // 256, crc[1 + xor(v, b::BIGINT) % 256]), 4294967295), 4294967295) AS h FROM named, table_of_crc
), words AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n
  FROM (SELECT CASE WHEN h % 199 = 0 THEN substr(word, 1, h % length(word)) || substr(word, h % length(word) + 2) ELSE word END AS word, n FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest FROM (SELECT word, n, unnest(range(0, length(word))) AS i FROM words)
), near AS (
  SELECT a.word, b.word AS other, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
  UNION SELECT a.word, b.word, b.n FROM cut a JOIN words b ON a.rest = b.word
  UNION SELECT b.word, a.word, a.n FROM cut a JOIN words b ON a.rest = b.word
), best AS (
  SELECT word, other, n, count(*) OVER (PARTITION BY word) AS n_near, row_number() OVER (PARTITION BY word ORDER BY n DESC, other) AS place FROM near
), formed AS (
  SELECT w.word, w.n, coalesce(b.n_near, 0) AS n_near, CASE WHEN b.n >= 5 * w.n THEN b.other END AS form, CASE WHEN b.n >= 5 * w.n THEN b.n END AS form_n
  FROM words w LEFT JOIN best b ON w.word = b.word AND b.place = 1
), chain AS (
  SELECT word, word AS at, form AS next FROM formed
  UNION ALL
  SELECT c.word, f.word, f.form FROM chain c JOIN formed f ON c.next = f.word
)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.next IS NULL
"""


@query("op11_spelling", _SPELLING_SQL)
def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, their commonest neighbours at one edit, and where these lead."""
    from .spelling import spelling_variants
    return spelling_variants(table(spark, sf_dir, "documents"), least_length=6, least_count=5, damage=199, factor=5)


@query("op12_whitening")
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every sound embedding, shifted to integers and whitened to at most 16 components."""
    from .whitening import whiten
    return whiten(table(spark, sf_dir, "embeddings"), components=16)
