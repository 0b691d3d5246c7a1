"""Translation of segments by any translator, in passes over what is still pending.

A pass gathers unique shielded texts in batches, calls the translator once to
a batch, and keeps the replies that pass the checks. What is left goes into
the next pass with smaller batches, three passes at most; then the source is
kept, with a reason. Every pass is written before the next, so a call is not
made again because an executor was lost. Equal texts are sent once and fanned
out by a join.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.functions import flaws, text
from inkledger.operators.segments import parse_reply, replay_lookup
from inkledger.sources.rounds import written

#: Segments to a batch, by pass.
SIZES = (8, 2, 1)
#: Texts that are numbered together.
BUCKET = 512
#: Refusals in a row after which a partition makes no more calls.
HALT = 6


class Refused(RuntimeError):
    """The service will not answer now."""


class Translator(Protocol):
    """One call: a JSON request with segments in, a reply out. It must be safe to call in several processes and to call again."""

    def complete(self, payload: str) -> str: ...


class Identity:
    """Answers each segment with itself."""

    def complete(self, payload: str) -> str:
        return json.dumps({"translations": [{"id": s["id"], "text": s["text"]} for s in json.loads(payload)["segments"]]}, ensure_ascii=False)


class Marked:
    """Answers with the text between two marks, drops segments that contain ``omit``, and refuses payloads with ``refuse``."""

    def __init__(self, omit: str = "", refuse: str = ""):
        self.omit, self.refuse = omit, refuse

    def complete(self, payload: str) -> str:
        if self.refuse and self.refuse in payload:
            raise Refused("HTTP 429")
        rows = [{"id": s["id"], "text": f"«{s['text']}»"} for s in json.loads(payload)["segments"] if not self.omit or self.omit not in s["text"]]
        return "```json\n" + json.dumps(rows, ensure_ascii=False) + "\n```"


def _calls(translator: Translator, halt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        streak = 0
        for batch in batches:
            replies, errors = [], []
            for payload in batch.column("payload").to_pylist():
                reply, error = None, None
                if streak >= halt:
                    error = "halted"
                else:
                    try:
                        reply, streak = translator.complete(payload), 0
                    except Refused as e:
                        error, streak = str(e) or "refused", streak + 1
                    except Exception as e:  # a translator's failure is a row, not the job's end
                        error = f"{type(e).__name__}: {e}"
                replies.append(reply)
                errors.append(error)
            yield pa.record_batch([batch.column("batch"), pa.array(replies, pa.string()), pa.array(errors, pa.string())], names=["batch", "reply", "error"])

    return run


def _pass(pending: DataFrame, translator: Translator, size: int, halt: int) -> DataFrame:
    """key, shielded, reply, error of each pending text."""
    # Batches by a hash of the text: no order over all rows, and a batch never depends on how rows are dealt.
    # Buckets grow with the texts, so a window holds about BUCKET of them and calls spread over all tasks.
    buckets = 1 + pending.count() // BUCKET
    spread = pending.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(buckets)))
    numbered = spread.withColumn("n", F.row_number().over(W.partitionBy("bucket").orderBy("key")) - 1)
    numbered = numbered.withColumn("batch", F.concat_ws("-", "bucket", F.floor(F.col("n") / size).cast("string"))).withColumn("id", (F.col("n") % size).cast("long"))
    item = F.struct("id", F.col("shielded").alias("text"))
    payloads = numbered.groupBy("batch").agg(F.to_json(F.struct(F.array_sort(F.collect_list(item)).alias("segments"))).alias("payload"))
    answers = payloads.mapInArrow(_calls(translator, halt), "batch string, reply string, error string")
    items = answers.select("batch", "error", F.explode_outer(parse_reply(F.col("reply"))).alias("t"))
    replies = items.select("batch", "error", F.col("t.id").alias("id"), F.col("t.text").alias("reply"))
    errors = answers.select("batch", F.col("error").alias("batch_error"))
    found = numbered.join(replies.where("id is not null").select("batch", "id", "reply"), ["batch", "id"], "left").join(errors, "batch", "left")
    return found.select("key", "shielded", "reply", F.col("batch_error").alias("error"))


def translate(segments: DataFrame, translator: Translator, saved: DataFrame | None = None, sizes: tuple = SIZES, halt: int = HALT) -> DataFrame:
    """Segments (doc_id, id, text) with translated, how and reason.

    how: prefilled (no translator needed), saved, translated, or kept (with the reason). One row to a segment.
    """
    texts = segments.groupBy(F.coalesce("text", F.lit("")).alias("source")).agg(F.count("*").alias("copies"))
    shielded, slots = text.shield("source", keep_numbers=True)
    rows = texts.select(F.sha2("source", 256).alias("key"), "source", "copies", shielded.alias("shielded"), slots.alias("slots"))
    rows = rows.withColumn("done", F.when(text.prefilled("source"), F.col("source"))).withColumn("how", F.when(F.col("done").isNotNull(), "prefilled"))
    if saved is not None:
        known = saved.groupBy("source").agg(F.max("translated").alias("was"))
        rows = rows.join(known, "source", "left").withColumn("how", F.coalesce("how", F.when(F.col("was").isNotNull(), "saved"))).withColumn("done", F.coalesce("done", "was")).drop("was")
    rows = written(rows.withColumn("reason", F.lit(None).cast("string")), "texts")
    for size in sizes:
        pending = rows.where("done is null")
        if pending.isEmpty():
            break
        got = _pass(pending.select("key", "shielded"), translator, size, halt).select("key", "reply", "error")
        rows = rows.join(got, "key", "left")
        back = text.restored("reply", "slots")
        blank = (F.trim(back) == "") & (F.trim("source") != "")
        flawed = F.coalesce(flaws.changed_number(F.col("source"), back) | flaws.is_stub(back) | blank, F.lit(True))
        good = F.col("done").isNull() & back.isNotNull() & ~flawed
        reason = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("reply").isNull(), "no answer").when(back.isNull(), "placeholders changed").otherwise("flawed")
        rows = rows.select(
            "key", "source", "copies", "shielded", "slots",
            F.when(good, back).otherwise(F.col("done")).alias("done"),
            F.when(good, "translated").otherwise(F.col("how")).alias("how"),
            F.when(good | F.col("done").isNotNull(), F.lit(None)).otherwise(reason).alias("reason"),
        )
        rows = written(rows, "texts")
    final = rows.select("source", F.coalesce("done", "source").alias("translated"), F.coalesce("how", F.lit("kept")).alias("how"), F.when(F.col("done").isNull(), F.concat(F.lit("left a paragraph unchanged: "), "reason")).alias("reason"))
    return segments.withColumn("source", F.coalesce("text", F.lit(""))).join(final, "source").select("doc_id", "id", "source", "translated", "how", "reason")


def report(translated: DataFrame) -> DataFrame:
    """One row: segments by how they came about, unique texts, and the exit code (2 if any was kept)."""
    rows = translated.agg(F.count("*").alias("segments"), F.count_if(F.col("how") == "translated").alias("translated"), F.count_if(F.col("how") == "prefilled").alias("prefilled"), F.count_if(F.col("how") == "saved").alias("saved"), F.count_if(F.col("how") == "kept").alias("kept"))
    return rows.withColumn("exit_code", F.when(F.col("kept") > 0, 2).otherwise(0))


def replay(segments: DataFrame, saved: DataFrame) -> DataFrame:
    """Segments with their saved rendering; fails when it is run if one is missing."""
    met = replay_lookup(segments, saved)
    return met.withColumn("translated", F.coalesce("translated", F.raise_error(F.concat(F.lit("no saved rendering of segment "), F.col("id").cast("string"))).cast("string")))
