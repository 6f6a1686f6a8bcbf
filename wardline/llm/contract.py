"""One thin query per operator, over whole tables with production parameters."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wardline.llm import bpe, latent, licenses, lines, near, pii, quality, secrets, toxicity, vectors
from wardline.llm.common import small_batches, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


@query
def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query
def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


@query
def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(table(spark, sf_dir, "documents"))


@query
def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latent.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document that loses lines: the blocks as first:last:other document, and what is left."""
    out = lines.dedup(table(spark, sf_dir, "documents"), changed_only=True)
    cut = F.transform("_wl_cut", lambda c: F.concat_ws(":", c["first_line"].cast("string"), c["last_line"].cast("string"), c["of_doc_id"].cast("string")))
    n = F.aggregate("_wl_cut", F.lit(0).cast("bigint"), lambda a, c: a + c["last_line"] - c["first_line"] + 1)
    return out.select("doc_id", F.size("_wl_cut").cast("bigint").alias("n_blocks"), n.alias("n_lines"), F.array_join(cut, ",").alias("blocks"), F.length("text").cast("bigint").alias("n_chars_left"), F.sha2(F.encode("text", "utf-8"), 256).alias("text_sha256"))


_REACH = """
  r(id, root) AS (SELECT id, id FROM nodes UNION SELECT l.b, r.root FROM r JOIN l ON l.a = r.id)"""

ORACLES["op3_ngram_join"] = (
    """WITH RECURSIVE d AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
  s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d),
  n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
  p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
  l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
  nodes AS (SELECT doc_id AS id FROM documents),"""
    + _REACH
    + """
SELECT r.id AS doc_id, coalesce(n.n, 0) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.id GROUP BY 1, 2"""
)


@query
def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.join(table(spark, sf_dir, "documents"), words=3, percent=90)


ORACLES["op4_embedding_dedup"] = (
    """WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
  ok AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
  l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
  nodes AS (SELECT vec_id AS id FROM embeddings),"""
    + _REACH
    + """,
  k AS (SELECT a, count(*) AS n FROM l GROUP BY 1)
SELECT r.id AS vec_id, coalesce(k.n, 0) AS n_links, min(r.root) AS component_id, r.id = min(r.root) AS kept FROM r LEFT JOIN k ON k.a = r.id GROUP BY r.id, k.n"""
)


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.dedup(table(spark, sf_dir, "embeddings"))


@query
def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


@query
def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"), secrets.fit(secrets.labelled_findings(spark)))
