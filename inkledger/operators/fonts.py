"""Codes to characters by lookups: single entries, ranges, encodings, widths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def by_range(codes: DataFrame, ranges: DataFrame, span: int = 256) -> DataFrame:
    """Codes (font, code) with ``base``: that of the range (font, low, high, base) that holds them, plus the way in.

    A range lies in the buckets of ``span`` codes that it touches, so the join is an equal one.
    """
    r = ranges.withColumn("bucket", F.explode(F.sequence(F.floor(F.col("low") / span), F.floor(F.col("high") / span))))
    met = codes.select("font", "code").distinct().withColumn("bucket", F.floor(F.col("code") / span)).join(r, ["font", "bucket"]).where("code between low and high")
    # The last range that was given holds.
    return met.groupBy("font", "code").agg(F.max_by(F.col("base") + F.col("code") - F.col("low"), "low").alias("point"))


def decode(codes: DataFrame, singles: DataFrame, ranges: DataFrame, encoding: DataFrame) -> DataFrame:
    """Codes with ``unicode`` and ``how``: by single entry (font, code, text), by range, by encoding (code, text), or unmapped."""
    point = F.decode(F.unhex(F.lpad(F.hex("point"), 8, "0")), "UTF-32")
    rows = codes.join(singles.withColumnRenamed("text", "one"), ["font", "code"], "left").join(by_range(codes, ranges).select("font", "code", point.alias("ranged")), ["font", "code"], "left").join(encoding.withColumnRenamed("text", "encoded"), "code", "left")
    how: Column = F.when(F.col("one").isNotNull(), "single").when(F.col("ranged").isNotNull(), "range").when(F.col("encoded").isNotNull(), "encoding").otherwise("unmapped")
    return rows.withColumn("unicode", F.coalesce("one", "ranged", "encoded", F.lit("�"))).withColumn("how", how).drop("one", "ranged", "encoded")


def widths(codes: DataFrame, table: DataFrame, default: float = 1000.0) -> DataFrame:
    return codes.join(table, ["font", "code"], "left").withColumn("width", F.coalesce("width", F.lit(default)))


def uncovered(texts: DataFrame, covered: DataFrame) -> DataFrame:
    """c, n: characters of the texts that a face (c) lacks, the most frequent first."""
    chars = texts.select(F.explode(F.split("text", "")).alias("c")).where("trim(c) <> ''").groupBy("c").agg(F.count("*").alias("n"))
    return chars.join(covered, "c", "left_anti").orderBy(F.desc("n"), "c")
