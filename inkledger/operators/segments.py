"""Segments on their way to a translator: unique texts, batches, context, replay."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.functions.text import prefilled, prompt_score, squash


#: Characters by which a saved first piece is looked up.
HEAD = 8


def owners(segments: DataFrame) -> DataFrame:
    """Segments (id, text) with ``owner``: the least id with that text.

    One row to a text is summed up, not windowed, so a hot text is no hot task; texts meet by a 32-byte digest,
    so no text is shuffled but with its own row.
    """
    rows = segments.withColumn("digest", F.unhex(F.sha2("text", 256)))
    first = rows.groupBy("digest").agg(F.min("id").alias("owner"), F.count("*").alias("copies"))
    return rows.join(first, "digest").drop("digest")


def unique_batches(segments: DataFrame, size: int = 8, prompt_size: int = 2) -> DataFrame:
    """doc_id, id, kind, batch, slot: the first segment of each text of a document, in batches of one kind.

    A batch ends when it is full or the next segment's kind differs. Segments that need no translator are left out.
    """
    rows = segments.where(~prefilled("text")).withColumn("kind", (prompt_score("text") >= 2).cast("int"))
    first = rows.groupBy("doc_id", "text", "kind").agg(F.min("id").alias("id"))
    order = W.partitionBy("doc_id").orderBy("id")
    rows = first.withColumn("turn", F.when(F.col("kind") == F.lag("kind").over(order), 0).otherwise(1)).withColumn("island", F.sum("turn").over(order))
    place = F.row_number().over(W.partitionBy("doc_id", "island").orderBy("id")) - 1
    limit = F.when(F.col("kind") == 1, min(prompt_size, size)).otherwise(size)
    rows = rows.withColumn("place", place).withColumn("slot", (F.col("place") % limit).cast("int"))
    batch = F.sum(F.when(F.col("slot") == 0, 1).otherwise(0)).over(order)
    return rows.withColumn("batch", batch).select("doc_id", "id", "kind", "batch", "slot")


def context(segments: DataFrame, group: str, order: str, text: str = "text", width: int = 2) -> DataFrame:
    """Segments with ``context_before`` and ``context_after``: the texts of up to ``width`` neighbours."""
    w = W.partitionBy(group).orderBy(order)
    return segments.withColumn("context_before", F.collect_list(text).over(w.rowsBetween(-width, -1))).withColumn("context_after", F.collect_list(text).over(w.rowsBetween(1, width)))


def request(batch: DataFrame) -> DataFrame:
    """doc_id, batch, payload: the JSON of each batch of segments with context."""
    segment = F.struct("slot", "id", "text", "context_before", "context_after")
    items = F.transform(F.array_sort(F.collect_list(segment)), lambda s: F.struct(s["id"].alias("id"), s["text"].alias("text"), s["context_before"].alias("context_before"), s["context_after"].alias("context_after")))
    return batch.groupBy("doc_id", "batch").agg(F.to_json(F.struct(items.alias("segments"))).alias("payload"))


def parse_reply(reply: Column) -> Column:
    """The translations of a reply: fences and talk around the JSON are dropped, a bare array will do, and text may be called translation."""
    body = F.regexp_extract(reply, r"(?s)([\[{].*[\]}])", 1)
    item = "array<struct<id:long,text:string,translation:string>>"
    wrapped = F.from_json(body, f"translations {item}")["translations"]
    items = F.coalesce(wrapped, F.from_json(body, item))
    return F.transform(F.filter(items, lambda x: x["id"].isNotNull()), lambda x: F.struct(x["id"].alias("id"), F.coalesce(x["text"], x["translation"]).alias("text")))


def digit_index(text: Column) -> Column:
    """A number of up to three digits alone: it is its own rendering."""
    return F.trim(text).rlike("^[0-9]{1,3}$")


def _without_index(text: Column) -> Column:
    """What follows a chapter number of up to three digits and a space; null if there is none."""
    rest = F.regexp_extract(F.ltrim(text), r"(?s)^[0-9]{1,3}\s+(\S.*)$", 1)
    return F.when(rest != "", F.trim(rest))


def saved_texts(saved: DataFrame, least: bool = False) -> DataFrame:
    """source, translated: one rendering of each source; one that differs from the source goes before an echo, but for short labels. Two others that differ are an error when it is run, or with ``least`` the smaller holds."""
    found = saved.groupBy("source").agg(F.sort_array(F.collect_set("translated")).alias("all"))
    own = F.filter("all", lambda t: t != F.col("source"))
    echoed = F.size(own) < F.size("all")
    short = (F.length(F.trim("source")) <= 48) & ~F.col("source").contains(". ") & (F.size(F.split(F.trim("source"), r"\s+")) <= 6)
    clash = F.get(own, F.lit(0)) if least else F.raise_error(F.concat(F.lit("two saved renderings of: "), F.substring("source", 1, 80))).cast("string")
    return found.select("source", F.when(echoed & (short | (F.size(own) == 0)), F.col("source")).when(F.size(own) == 1, own[0]).otherwise(clash).alias("translated"))


def replay_lookup(segments: DataFrame, saved: DataFrame) -> DataFrame:
    """Segments (id, text) with the saved rendering, and ``how`` it was found, the first that is:

    exact: by the text; squashed: by the text without white space; digits: a number alone; peeled: a section title
    that was saved with its chapter's number before it, less that of the rendering; joined: two saved pieces that
    make up the text, the longest first one; missing. Texts meet by digests.
    """
    key = lambda c: F.unhex(F.sha2(c, 256))
    exact = saved.select(key(F.col("source")).alias("k"), F.col("translated").alias("by_text")).groupBy("k").agg(F.min("by_text").alias("by_text"))
    loose = saved.groupBy(key(squash("source")).alias("k")).agg(F.min("translated").alias("by_key"))
    peeled = saved.select(_without_index(F.col("source")).alias("rest"), _without_index(F.col("translated")).alias("body")).where(F.col("rest").rlike(r"^[0-9]{1,3}\.") & F.col("body").isNotNull())
    peeled = peeled.groupBy(key(F.col("rest")).alias("k")).agg(F.min("body").alias("by_rest"))
    rows = segments.withColumn("k", key(F.col("text"))).join(exact, "k", "left").withColumn("k", key(squash("text"))).join(loose, "k", "left").withColumn("k", key(F.trim("text"))).join(peeled, "k", "left").drop("k")
    how = F.when(F.col("by_text").isNotNull(), "exact").when(F.col("by_key").isNotNull(), "squashed").when(digit_index(F.col("text")), "digits").when(F.col("by_rest").isNotNull(), "peeled")
    rows = rows.select("id", "text", F.when(digit_index(F.col("text")) & F.col("by_text").isNull() & F.col("by_key").isNull(), F.trim("text")).otherwise(F.coalesce("by_text", "by_key", "by_rest")).alias("found"), how.alias("how"))
    joined = _joined_pieces(rows.where("how is null").select("id", "text"), saved)
    met = rows.join(joined, "id", "left")
    return met.select("id", "text", F.coalesce("found", "by_pieces").alias("translated"), F.coalesce("how", F.when(F.col("by_pieces").isNotNull(), "joined"), F.lit("missing")).alias("how"))


def _joined_pieces(texts: DataFrame, saved: DataFrame) -> DataFrame:
    """id, by_pieces: the renderings of two saved pieces that make up a text (white space between them aside).

    First pieces meet a text by their first ``HEAD`` characters; what is left meets the other saved pieces by its digest.
    """
    head = lambda c: F.substring(c, 1, HEAD)
    left = saved.where(F.length("source") >= HEAD).select(head("source").alias("h"), F.col("source").alias("l"), F.col("translated").alias("lt"))
    met = texts.withColumn("h", head("text")).join(left, "h").where((F.length("l") < F.length("text")) & F.col("text").startswith(F.col("l")))
    met = met.withColumn("rest", F.substring("text", F.length("l") + 1, F.length("text"))).withColumn("k", F.unhex(F.sha2(F.trim("rest"), 256)))
    right = saved.groupBy(F.unhex(F.sha2(F.trim("source"), 256)).alias("k")).agg(F.min("translated").alias("rt"))
    gap = F.when(F.col("rest").rlike(r"^\s") | F.col("l").rlike(r"\s$"), " ").otherwise("")
    both = met.join(right, "k").select("id", F.struct(F.length("l").alias("n"), F.concat(F.rtrim("lt"), gap, F.ltrim("rt")).alias("t")).alias("m"))
    return both.groupBy("id").agg(F.max("m").alias("m")).select("id", F.col("m.t").alias("by_pieces"))


def breaker(attempts: DataFrame, group: str, order: list[str], refused: Column, after: int = 6) -> DataFrame:
    """Attempts with ``streak``, refusals in a row up to here, and ``halted``: whether one before reached ``after``."""
    w = W.partitionBy(group).orderBy(*order)
    rows = attempts.withColumn("refused", refused).withColumn("island", F.sum(F.when(F.col("refused"), 0).otherwise(1)).over(w))
    rows = rows.withColumn("streak", F.sum(F.col("refused").cast("int")).over(W.partitionBy(group, "island").orderBy(*order)))
    return rows.withColumn("halted", F.coalesce(F.max(F.col("streak") >= after).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(False))).drop("island")


def stalls(attempts: DataFrame, group: str, time: str, least: float) -> DataFrame:
    """Attempts with ``gap_s``: the seconds since the group's last, where at least ``least``."""
    w = W.partitionBy(group).orderBy(time)
    us = F.unix_micros(F.col(time).cast("timestamp"))
    return attempts.withColumn("gap_s", (us - F.lag(us).over(w)) / 1000000.0).where(F.col("gap_s") >= least)


#: Texts and characters of one packed request, and the mark between two texts.
PACKED_TEXTS, PACKED_CHARS, PACKED_MARK = 8, 1500, "XPHSEPX"


def packed(sizes: list[int], most: int = PACKED_TEXTS, room: int = PACKED_CHARS) -> list[int]:
    """The request that each text goes in: in order, a new one where it is full or has no room left; a text that is too long goes alone."""
    out, request, n, used = [], 0, 0, 0
    for size in sizes:
        extra = size + len(PACKED_MARK) + 2
        if n and (n >= most or used + extra > room):
            request, n, used = request + 1, 0, 0
        n, used = n + 1, used + extra
        out.append(request)
    return out


def packed_requests(segments: DataFrame) -> DataFrame:
    """doc_id, request, ids, payload: the texts (doc_id, id, text) of each document in packed requests, joined by the mark."""
    docs = segments.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("rows"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column("sizes").to_pylist()
            yield pa.record_batch([batch.column("doc_id"), batch.column("rows"), pa.array([packed(x) for x in sizes], pa.list_(pa.int32()))], names=["doc_id", "rows", "requests"])

    sized = docs.select("doc_id", "rows", F.transform("rows", lambda r: F.length(r["text"])).alias("sizes"))
    row = docs.schema["rows"].dataType.simpleString()
    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = sized.mapInArrow(fold, f"doc_id {kind}, rows {row}, requests array<int>").select("doc_id", F.inline(F.arrays_zip("rows", "requests")))
    gathered = placed.groupBy("doc_id", F.col("requests").alias("request")).agg(F.array_sort(F.collect_list("rows")).alias("rows"))
    return gathered.select("doc_id", "request", F.transform("rows", lambda r: r["id"]).alias("ids"), F.array_join(F.transform("rows", lambda r: r["text"]), f"\n{PACKED_MARK}\n").alias("payload"))


def unpacked(reply: Column, n: Column) -> Column:
    """The texts of a packed reply, the mark in any case; null unless there are ``n``."""
    parts = F.transform(F.split(reply, f"(?i){PACKED_MARK}", -1), lambda p: F.regexp_replace(p, r"^\s+|\s+$", ""))
    return F.when(F.size(parts) == n, parts)
