"""Reference sections: where a document's bibliography begins and ends.

The rules for a line are conditions on columns. Only the walk over a
document's lines, in or out of a section, depends on what came before; it is
a fold over small codes, one to a line, and not over texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEADING, ENTRY, BREAK, OTHER = 1, 2, 3, 0
#: Lines to look ahead of a heading for an entry, and lines that may lie between two entries.
LOOK, GAP = 4, 2


def is_heading(text: Column) -> Column:
    return F.lower(F.trim(text)).rlike(r"^(?:[0-9]{1,2}\.? |[ivx]{1,4}\. )?(?:references|bibliography|works cited|literature cited|参考文献)\.?:?$")


def is_entry(text: Column) -> Column:
    t = F.trim(text)
    numbered = t.rlike(r"^\[[0-9]{1,3}\] [^ ]") | (t.rlike(r"^[0-9]{1,3}\. [A-Z]") & t.rlike(r"(?:19|20)[0-9]{2}"))
    named = t.rlike(r"^[A-Z][A-Za-z'’-]+, (?:[A-Z]\.[ -]?)+") & t.rlike(r"(?:19|20)[0-9]{2}")
    return numbered | named


def is_break(text: Column) -> Column:
    return F.trim(text).rlike(r"^(?:(?:Appendix|Appendices|Acknowledg(?:e)?ments|Supplement(?:ary)?)(?: [A-Z0-9])?(?:[.: ].{0,60})?|[A-Z] [A-Z][a-z]+.{0,40})$") & ~is_entry(text)


def code(text: Column) -> Column:
    return F.when(is_heading(text), HEADING).when(is_entry(text), ENTRY).when(is_break(text), BREAK).otherwise(OTHER)


def selected(codes: list[int]) -> list[bool]:
    """Which lines, in reading order, belong to a reference section."""
    out = [False] * len(codes)
    inside, last = False, -10
    for i, c in enumerate(codes):
        if inside:
            if c == BREAK:
                inside, last = False, -10
            else:
                out[i] = True
            continue
        if c == HEADING and ENTRY in codes[i + 1 : i + 1 + LOOK]:
            inside = out[i] = True
        elif c == ENTRY:
            if 0 <= i - last - 1 <= GAP and BREAK not in codes[last:i]:
                inside = True
                out[last : i + 1] = [True] * (i + 1 - last)
            last = i
    return out


def reference_lines(lines: DataFrame) -> DataFrame:
    """Lines (doc_id, row, text) with ``reference``: doc_id, row, reference.

    Only documents with a heading or an entry are folded, as arrays of codes.
    """
    coded = lines.select("doc_id", "row", code(F.col("text")).cast("byte").alias("code"))
    docs = coded.groupBy("doc_id").agg(F.max(F.col("code").isin(HEADING, ENTRY)).alias("some"), F.array_sort(F.collect_list(F.struct("row", "code"))).alias("lines"))
    quiet = docs.where("not some").select("doc_id", F.explode("lines.row").alias("row")).withColumn("reference", F.lit(False))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column("codes").to_pylist()
            yield pa.record_batch([batch.column("doc_id"), batch.column("rows"), pa.array([selected(r) for r in rows], pa.list_(pa.bool_()))], names=["doc_id", "rows", "marks"])

    folded = docs.where("some").select("doc_id", F.col("lines.row").alias("rows"), F.col("lines.code").alias("codes")).mapInArrow(fold, "doc_id long, rows array<int>, marks array<boolean>")
    found = folded.select("doc_id", F.inline(F.arrays_zip(F.col("rows").alias("row"), F.col("marks").alias("reference"))))
    return quiet.unionByName(found)
