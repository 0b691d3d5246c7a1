"""Token counts from an exact histogram of document lengths.

Each document is encoded once, and only its length goes on: documents are
counted by length, before and after the shuffle. There are no more lengths
than the longest document has ids, so the histogram is small at any scale, and
suffix sums over it answer, for every context limit, how many documents are
longer, how many ids there are in all, how many are left if documents are
truncated there, and which share of the documents a limit holds whole.

Edge cases: null and empty texts have no ids and count as documents of length
0 (or of 1, with an end id); ids and other columns are not read, so repeated
rows and null ids count as documents; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.llm.encode import BYTE_BPE, ROOMY, encoder


def lengths(docs: DataFrame, vocabulary: str = BYTE_BPE, text_col: str = "text") -> DataFrame:
    """n_tokens, n_docs: partial counts of each batch of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, **ROOMY)
        for batch in batches:
            found = pa.array(encode.lengths(batch.column(0))).value_counts()
            yield pa.record_batch({"n_tokens": found.field("values"), "n_docs": found.field("counts")})

    return docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(run, "n_tokens long, n_docs long")


def histogram(docs: DataFrame, vocabulary: str = BYTE_BPE, text_col: str = "text") -> DataFrame:
    """A row for each length that occurs, taken as a context limit.

    n_tokens; n_docs: documents of that length; docs_longer, tokens_longer: of
    greater length, and their ids; total_docs, total_tokens; truncated_tokens:
    ids left if each document is cut to n_tokens; quantile: share of documents
    of at most that length.
    """
    counts = lengths(docs, vocabulary, text_col).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))
    # The windows hold one row for each length, as many as the longest document has ids at most.
    longer = W.orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, -1)
    whole = W.orderBy(F.desc("n_tokens")).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    ids = F.col("n_docs") * F.col("n_tokens")
    return (
        counts.select(
            "n_tokens",
            "n_docs",
            F.coalesce(F.sum("n_docs").over(longer), F.lit(0)).alias("docs_longer"),
            F.coalesce(F.sum(ids).over(longer), F.lit(0)).alias("tokens_longer"),
            F.sum("n_docs").over(whole).alias("total_docs"),
            F.sum(ids).over(whole).alias("total_tokens"),
        )
        .withColumn("truncated_tokens", F.col("total_tokens") - F.col("tokens_longer") + F.col("docs_longer") * F.col("n_tokens"))
        .withColumn("quantile", (F.col("total_docs") - F.col("docs_longer")) / F.col("total_docs"))
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """For each context limit, whether a document has that length or not: docs_longer, truncated_tokens, total_tokens."""
    ids = F.col("n_docs") * F.col("n_tokens")
    rows = []
    for limit in limits:
        over = F.col("n_tokens") > limit
        longer = F.coalesce(F.sum(F.when(over, F.col("n_docs"))), F.lit(0))
        left = F.coalesce(F.sum(F.col("n_docs") * F.least("n_tokens", F.lit(limit))), F.lit(0))
        rows.append(F.struct(F.lit(limit).cast("long").alias("context_limit"), longer.alias("docs_longer"), left.alias("truncated_tokens"), F.coalesce(F.sum(ids), F.lit(0)).alias("total_tokens")))
    return table.agg(F.array(*rows).alias("limits")).select(F.inline("limits"))


def quantile(table: DataFrame, share: float) -> int | None:
    """The least length that ``share`` of the documents do not exceed."""
    return table.where(F.col("quantile") >= share).agg(F.min("n_tokens")).first()[0]
