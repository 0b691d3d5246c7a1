"""The library's front door: extract, segment, translate, score."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.operators.coverage import coverage
from inkledger.operators.lines import paragraphs
from inkledger.operators.references import reference_lines
from inkledger.operators.translate import Translator, report, translate
from inkledger.options import Options
from inkledger.sources.pdf import read_pdfs


@dataclass
class Extraction:
    """One run over PDF files as tables that share ``path``."""

    pages: DataFrame
    glyphs: DataFrame
    regions: DataFrame
    diagnostics: DataFrame

    def summary(self) -> DataFrame:
        """path, total, pending, real_misses, complete."""
        return coverage(self.glyphs, "path").select("path", "total", "pending", "real_misses", "complete")


def extract(spark: SparkSession, path: str, max_pages: int | None = None) -> Extraction:
    rows = read_pdfs(spark, path, max_pages)
    box = ["path", "page_index", "x0", "y0", "x1", "y1"]
    return Extraction(
        pages=rows.where("kind = 'page'").select(*box, F.col("render_mode").alias("rotate")),
        glyphs=rows.where("kind = 'glyph'").drop("kind", "message"),
        regions=rows.where("kind in ('path', 'image')").select(*box, "kind"),
        diagnostics=rows.where("kind = 'diagnostic'").select("path", "page_index", "message"),
    )


def segments(glyphs: DataFrame) -> DataFrame:
    """doc_id, id, path, page_index, text: the paragraphs of extracted glyphs, in reading order.

    Glyphs of a page on about one baseline make a line; a gap of a quarter size is a space.
    """
    page = W.partitionBy("path", "page_index").orderBy(F.desc("y"), "x", "id")
    new = F.when(F.abs(F.col("y") - F.lag("y").over(page)) > 0.5 * F.greatest(F.lag("font_size").over(page), F.lit(1.0)), 1).otherwise(0)
    rows = glyphs.where(~F.col("invisible")).withColumn("new", new).withColumn("row", F.sum("new").over(page).cast("int"))
    line = W.partitionBy("path", "page_index", "row").orderBy("x", "id")
    gap = F.col("x") - (F.lag("x").over(line) + F.lag("dx").over(line))
    spaced = rows.withColumn("piece", F.concat(F.when(gap > 0.25 * F.col("font_size"), " ").otherwise(""), "unicode"))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "id", "piece"))), lambda s: s["piece"]), "")
    lines = spaced.groupBy("path", "page_index", "row").agg(joined.alias("text"), F.max("font_size").alias("size"), F.min("x").alias("x"), F.max("y").alias("y"))
    lines = lines.withColumn("doc_id", F.xxhash64("path"))
    marked = paragraphs(lines)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda s: s["text"]), " ")
    groups = marked.groupBy("doc_id", "path", "page_index", "paragraph").agg(text.alias("text"))
    return groups.withColumn("id", F.col("page_index").cast("long") * (1 << 32) + F.col("paragraph")).drop("paragraph")


def translate_segments(rows: DataFrame, translator: Translator, options: Options | None = None, saved: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The translated segments, and the run's report. Reference sections are left as they are, if options say so."""
    options = options or Options()
    if not options.skip_references:
        done = translate(rows, translator, saved, options.sizes, options.refusals)
        return done, report(done)
    # Ids order the segments of a document; the walk wants their ranks.
    ranked = rows.withColumn("row", F.row_number().over(W.partitionBy("doc_id").orderBy("id")))
    marked = ranked.join(reference_lines(ranked.select("doc_id", "row", "text")), ["doc_id", "row"])
    kept = marked.where("reference").select("doc_id", "id", F.col("text").alias("source"), F.col("text").alias("translated"), F.lit("prefilled").alias("how"), F.lit(None).cast("string").alias("reason"))
    done = translate(marked.where(~F.col("reference")).select("doc_id", "id", "text"), translator, saved, options.sizes, options.refusals).unionByName(kept)
    return done, report(done)
