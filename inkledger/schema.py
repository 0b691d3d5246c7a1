"""Types of the document relations."""

from __future__ import annotations

from pyspark.sql import types as T

COLOR = T.StructType([T.StructField("space", T.StringType()), T.StructField("components", T.ArrayType(T.DoubleType()))])
DISPOSITION = T.StructType([T.StructField(n, T.StringType()) for n in ("state", "text", "reason")])

SEGMENTS = "doc_id long, id long, page_index int, text string"
CHECKPOINT = "source string, translated string"
REPLAY = "translations array<struct<id:long,page_index:int,glyph_ids:array<long>,source:string,translated:string>>"
MANIFEST = "id string, url string, source string, title string, license string, sha256 string, bytes long, pages int, tags array<string>, ci boolean"

#: Reasons for which a kept glyph counts as missed if it is Latin, and those that are meant.
REAL_MISS = ("missing-glyph", "overflow", "untranslated", "no-font", "no-stream", "english-body", "math-prose", "incomplete-list")
INTENTIONAL = (
    "references", "figure", "table", "code", "math", "math-block", "formula", "formula-hole", "formula-join", "formula-stay", "name", "toc", "margin", "ocr",
    "unchanged", "shared-operator", "kept", "punctuation", "whitespace", "url", "folio", "line-kept", "vertical", "clipped", "type3", "annotation", "unmapped",
)
FINAL = ("rewritten", "kept_original", "non_text")

#: Fixed values of the page that glyphs are laid on: width, height, lines, left edge, first baseline, advance, leading, size.
PAGE_WIDTH, PAGE_HEIGHT = 612.0, 792.0
PAGE_LINES = 50
LEFT, TOP, ADVANCE, LEADING, SIZE = 72.0, 720.0, 5.0, 12.0, 10.0
