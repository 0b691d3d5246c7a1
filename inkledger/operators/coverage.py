"""Conservation of glyphs: every glyph ends in one disposition, and the report proves it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.schema import FINAL, INTENTIONAL, REAL_MISS


def unresolved(state: Column, reason: Column, unicode: Column) -> Column:
    """Pending glyphs, and Latin ones kept for a reason that is a miss."""
    missed = (state == "kept_original") & reason.isin(*REAL_MISS) & unicode.rlike("[A-Za-z]")
    return state.isin("pending", "translated_pending") | missed


def coverage(glyphs: DataFrame, *keys: str) -> DataFrame:
    """Counts by disposition for each group: total, rewritten, kept, intentional, non_text, pending, real_misses, complete."""
    state, reason, c = F.col("state"), F.col("reason"), F.col("unicode")
    bad = F.coalesce(unresolved(state, reason, c), F.lit(False))
    rows = glyphs.groupBy(*keys).agg(
        F.count("*").alias("total"),
        F.count_if(state == "rewritten").alias("rewritten"),
        F.count_if(state == "kept_original").alias("kept_original"),
        F.count_if((state == "kept_original") & reason.isin(*INTENTIONAL)).alias("intentional"),
        F.count_if(state == "non_text").alias("non_text"),
        F.count_if(state.isin("pending", "translated_pending")).alias("pending"),
        F.count_if(bad).alias("real_misses"),
    )
    return rows.withColumn("complete", F.col("real_misses") == 0)


def by_page(glyphs: DataFrame) -> DataFrame:
    """doc_id, misses: a map of each page with misses to their number."""
    pages = coverage(glyphs, "doc_id", "page_index").where("real_misses > 0")
    return pages.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("page_index", "real_misses")))).alias("misses"))


def first_unresolved(glyphs: DataFrame, most: int = 32) -> DataFrame:
    """doc_id, ids, truncated: the first unresolved ids, as a summary has them (a top-k report)."""
    bad = glyphs.where(unresolved(F.col("state"), F.col("reason"), F.col("unicode")))
    # A page keeps its first few before the pages of a document meet.
    page = bad.groupBy("doc_id", "page_index").agg(F.slice(F.array_sort(F.collect_list("id")), 1, most).alias("ids"), F.count("*").alias("n"))
    return page.groupBy("doc_id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("ids"))), 1, most).alias("ids"), (F.sum("n") > most).alias("truncated"))


def assert_complete(glyphs: DataFrame) -> DataFrame:
    """The report; fails when it is run if a document has a miss."""
    report = coverage(glyphs, "doc_id")
    checked = F.when(F.col("complete"), F.col("complete")).otherwise(F.raise_error(F.concat(F.lit("document "), F.col("doc_id").cast("string"), F.lit(": unresolved glyphs: "), F.col("real_misses").cast("string"))))
    return report.withColumn("complete", checked)


def mark(glyphs: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies changes (doc_id, id, new_state, new_reason); fails on glyphs that are final already."""
    joined = glyphs.join(changes, ["doc_id", "id"], "left")
    refused = F.col("new_state").isNotNull() & F.col("state").isin(*FINAL)
    state = F.when(refused, F.raise_error(F.lit("a final glyph can't change"))).otherwise(F.coalesce("new_state", "state"))
    return joined.withColumn("state", state.cast("string")).withColumn("reason", F.coalesce("new_reason", "reason")).drop("new_state", "new_reason")


def unmapped_fonts(glyphs: DataFrame, most: int = 8) -> DataFrame:
    """font_name, n: the fonts with most unmapped glyphs (a top-k report)."""
    return glyphs.where("reason = 'missing-glyph'").groupBy("font_name").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "font_name").limit(most)
