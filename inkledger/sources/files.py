"""Readers and writers of the small files that surround a document run."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.schema import CHECKPOINT, MANIFEST, REPLAY


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def glossary_csv(spark: SparkSession, path: str) -> DataFrame:
    """src, tgt: quoted CSV, '#' comments, an optional header."""
    rows = spark.read.csv(path, schema="src string, tgt string", quote='"', escape='"', comment="#", ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    header = (F.lower("src").isin("src", "source")) & (F.lower("tgt").isin("tgt", "target"))
    return rows.where(F.col("src").isNotNull() & F.col("tgt").isNotNull() & (F.col("src") != "") & ~header)


def glossary_json(spark: SparkSession, path: str) -> DataFrame:
    """src, tgt: an object of pairs, or an array of objects with src and tgt."""
    text = spark.read.text(path, wholetext=True)
    pairs = text.select(F.from_json("value", "map<string,string>").alias("m"), F.from_json("value", "array<struct<src:string,tgt:string>>").alias("a"))
    return pairs.select(F.explode(F.coalesce(F.map_entries("m"), F.array())).alias("e")).select(F.col("e.key").alias("src"), F.col("e.value").alias("tgt")).unionByName(pairs.select(F.inline("a"))).where("src is not null and tgt is not null")


def longest_first(glossary: DataFrame) -> DataFrame:
    """By bytes, the longest term first, then by the term."""
    return glossary.orderBy(F.octet_length("src").desc(), "src")


def checkpoint(spark: SparkSession, path: str) -> DataFrame:
    """source, translated from JSONL; broken lines are skipped, and of a source the line of the last append holds.

    Files without a sequence number are older than those with one.
    """
    rows = spark.read.text(path).select(F.from_json("value", CHECKPOINT + ", seq long").alias("r")).select("r.*").where("source is not null and translated is not null")
    return rows.groupBy("source").agg(F.max(F.struct(F.coalesce("seq", F.lit(0)), "translated")).alias("m")).select("source", "m.translated")


def append_checkpoint(pairs: DataFrame, path: str) -> None:
    """Appends a rendering of each source, with a number that grows with each append: the order of files doesn't matter."""
    pairs.select("source", "translated", F.lit(time.time_ns()).alias("seq")).write.mode("append").json(path)


def replay(spark: SparkSession, path: str) -> DataFrame:
    """id, page_index, glyph_ids, source, translated of an earlier report."""
    return spark.read.schema(REPLAY).json(path, multiLine=True).select(F.inline("translations"))


def manifest(spark: SparkSession, path: str, ci_only: bool = False) -> DataFrame:
    rows = spark.read.schema(f"version int, notes string, documents array<struct<{', '.join(f'{c.split()[0]}:{c.split()[1]}' for c in MANIFEST.split(', '))}>>").json(path, multiLine=True).select(F.inline("documents"))
    return rows.where("ci") if ci_only else rows


def verified(files: DataFrame, listed: DataFrame) -> DataFrame:
    """Files (id, content) against a manifest: id, size_ok, hash_ok; files that are not listed are null."""
    found = files.select("id", F.octet_length("content").cast("long").alias("n"), F.sha2("content", 256).alias("h"))
    return found.join(listed.select("id", "bytes", "sha256"), "id", "left").select("id", (F.col("n") == F.col("bytes")).alias("size_ok"), (F.col("h") == F.lower("sha256")).alias("hash_ok"))


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def markdown(df: DataFrame, title: str, limit: int = 200) -> str:
    """A report table of a small result."""
    rows = df.limit(limit).collect()
    head = "| " + " | ".join(df.columns) + " |"
    return "\n".join([f"# {title}", "", head, "|" + " --- |" * len(df.columns), *("| " + " | ".join(str(v) for v in r) + " |" for r in rows), ""])


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
