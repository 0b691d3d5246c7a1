"""The glyph relation: one row to each character of a document that is laid out.

A document's lines go on pages of ``PAGE_LINES`` lines; every character is a
glyph of fixed advance, its font and disposition a function of what it is.
``output`` is the same with a deterministic loss and shift, as a translated
or rewritten copy would have. Both are projections over two generators, so
filters on documents and pages reach the scan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.schema import ADVANCE, LEADING, LEFT, PAGE_LINES, SIZE, TOP
from inkledger.sources.files import table


#: Bytes of stored documents to a task, where they are dealt out by id: their glyphs are sorted in memory then.
DEALT = 512 << 10


def _beside(spark: SparkSession) -> SparkSession:
    """A session like ``spark`` whose joins leave rows where they are if they are dealt out by some of the join's keys."""
    other = spark.newSession()
    for key, value in spark.conf.getAll.items():
        if key.startswith("spark.") and spark.conf.isModifiable(key):
            other.conf.set(key, value)
    other.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")
    return other


def dealt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, all of an id in one task: what is made of them meets by id and place without being sent once more.

    A text is a small part of its glyphs, so it is the text that is shuffled.
    """
    documents = table(_beside(spark), sf_dir, "documents")
    stored = int(str(documents._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return documents.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-stored // DEALT)), "doc_id")


def lines(documents: DataFrame) -> DataFrame:
    """doc_id, line_no, page_index, row, line: each line of each text."""
    rows = documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    return rows.select("doc_id", "line_no", F.floor(F.col("line_no") / PAGE_LINES).cast("int").alias("page_index"), (F.col("line_no") % PAGE_LINES).alias("row"), "line")


def font_of(c: Column) -> Column:
    return F.when(c.rlike("^[0-9]$"), "CMMI10").when(c.rlike("^[A-Z]$"), "Nimbus-Bold").otherwise("Nimbus-Roman")


def state_of(c: Column, pos: Column) -> Column:
    lower = c.rlike("^[a-z]$")
    return F.when(lower & (pos % 89 == 88), "pending").when(lower & (pos % 97 != 96), "rewritten").when(c == " ", "non_text").otherwise("kept_original")


def reason_of(c: Column) -> Column:
    """Why a glyph that was kept was kept."""
    return F.when(c.rlike("^[a-z]$"), "overflow").when(c.rlike("^[A-Z]$"), "name").when(c.rlike("^[0-9]$"), "formula").when(c.rlike(r"^[\x21-\x7e]$"), "punctuation").otherwise("missing-glyph")


def glyphs(documents: DataFrame) -> DataFrame:
    """doc_id, id, page_index, line_no, row, pos, unicode, x, y, x0, y0, x1, y1, font_size, font_name, state, reason."""
    chars = lines(documents).select("doc_id", "line_no", "page_index", "row", F.posexplode(F.split("line", "")).alias("pos", "unicode")).where("unicode <> ''")
    c, pos = F.col("unicode"), F.col("pos")
    x, y = F.lit(LEFT) + ADVANCE * pos, F.lit(TOP) - LEADING * F.col("row")
    state = state_of(c, pos)
    return chars.select(
        "doc_id", (F.col("line_no").cast("long") * (1 << 32) + pos).alias("id"), "page_index", "line_no", "row", "pos", "unicode",
        x.alias("x"), y.alias("y"), x.alias("x0"), (y - 2.0).alias("y0"), (x + ADVANCE).alias("x1"), (y + 8.0).alias("y1"),
        F.lit(SIZE).alias("font_size"), font_of(c).alias("font_name"), state.alias("state"), F.when(state == "kept_original", reason_of(c)).alias("reason"),
    )


def output(source: DataFrame) -> DataFrame:
    """The rewritten copy of a glyph relation: every 97th glyph of a line is lost, every 89th is 0.5 to the right and, each second time, of another size."""
    pos = F.col("pos")
    moved = F.when(pos % 89 == 88, 0.5).otherwise(0.0)
    kept = source.where(pos % 97 != 96)
    return kept.withColumns({"x": F.col("x") + moved, "x0": F.col("x0") + moved, "x1": F.col("x1") + moved, "font_size": F.when(pos % 178 == 177, 14.0).otherwise(F.col("font_size"))})


#: The separators of words (Zs), which show nothing.
SPACES = " \u00a0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u202f\u205f\u3000"


def visible(g: DataFrame) -> DataFrame:
    return g.where(F.btrim("unicode", F.lit(SPACES)) != "")
