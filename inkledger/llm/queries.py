"""Queries of the training-data operators over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op1_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.token_files import token_output

    return token_output(table(spark, sf_dir, "documents"))


@query
def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


@query
def op3_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.simhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query
def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.language_id import identify

    return identify(table(spark, sf_dir, "documents"))


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.toxicity import toxicity

    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.line_dedup import counters, drop_boilerplate

    docs = table(spark, sf_dir, "documents")
    n_lines, n_dropped = counters(docs.columns)
    cleaned = drop_boilerplate(docs, "source", "text")
    return cleaned.select("doc_id", "source", "text", cleaned[n_lines].alias("n_lines"), cleaned[n_dropped].alias("n_dropped"))


ORACLES["op6_line_dedup"] = r"""
WITH lines AS (
  SELECT doc_id, source, md5(coalesce(text, '')) AS page, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS k
  FROM documents),
totals AS (SELECT source, count(DISTINCT md5(coalesce(text, ''))) AS n FROM documents GROUP BY source),
bad AS (
  SELECT l.source, trim(line, ' ' || chr(9) || chr(13)) AS line
  FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
  WHERE trim(line, ' ' || chr(9) || chr(13)) <> ''
  GROUP BY l.source, trim(line, ' ' || chr(9) || chr(13)), t.n
  HAVING count(DISTINCT page) >= 2 AND count(DISTINCT page) > 0.1 * t.n),
marked AS (
  SELECT l.doc_id, l.k, l.line, b.line IS NOT NULL AS gone
  FROM lines l LEFT JOIN bad b ON l.source IS NOT DISTINCT FROM b.source AND trim(l.line, ' ' || chr(9) || chr(13)) = b.line),
kept AS (
  SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (WHERE NOT gone), '') AS text,
         CAST(count(*) AS INTEGER) AS n_lines, CAST(count(*) FILTER (WHERE gone) AS INTEGER) AS n_dropped
  FROM marked GROUP BY doc_id)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE k.text END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


@query
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.token_counts import histogram

    return histogram(table(spark, sf_dir, "documents"))


@query
def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from inkledger.llm.warc import warc_round_trip

    return warc_round_trip(table(spark, sf_dir, "pages")).drop("url")


ORACLES["op7_warc"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha256(coalesce(html, '')) AS digest, octet_length(encode(coalesce(html, ''))) AS n FROM pages),
r AS (SELECT digest, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY digest)
SELECT p.page_id, CAST(p.n AS BIGINT) AS payload_bytes, p.digest AS payload_digest,
       CASE WHEN p.page_id > r.first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN p.page_id > r.first THEN r.first END AS refers_to
FROM p LEFT JOIN r ON p.digest = r.digest
"""


@query
def op9_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from inkledger.llm.ann import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)
