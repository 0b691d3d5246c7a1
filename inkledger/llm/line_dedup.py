"""Line dedup by site-relative frequency, with DataFrame functions only.

Pages are grouped by host. A line's ratio is the number of the host's pages
that contain it, over the host's pages; a line of a ratio above ``RATIO`` that
is on ``LEAST`` pages or more is boilerplate there and is dropped from the
host's pages. ``LEAST`` is 2: a line that one page alone has repeats nothing,
and by its ratio alone each line of a host of under 1 / ``RATIO`` pages would
go. Exact copies of a page on one host are one page in both numbers, or a
much copied page would be boilerplate as a whole. A line is compared without
spaces, tabs and carriage returns at its ends; blank lines are neither counted
nor dropped.

Plan: the lines' 16-byte digests are grouped by host and line, so a hot line
or host is summed up before it is shuffled and never comes together in a task.
A host has at most ``lines per page / RATIO`` boilerplate lines, which bounds
the list that is joined to its pages; that join is a broadcast if the written
list is under Spark's own threshold, and else one whose hot hosts are split.

Edge cases: a null text stays null and is a page without lines; null hosts are
one host; repeated rows are copies of a page; texts without a boilerplate line
come back unchanged; other columns are carried along, whatever their names
(``n_lines`` and ``n_dropped`` get underscores behind them if the pages have
such columns); an empty table gives an empty one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.shared import discard, materialize

RATIO = 0.1
LEAST = 2

_ENDS = " \t\r"


def url_host(url: Column) -> Column:
    """The host of a URL, lower-cased; null if there is none."""
    return F.lower(F.nullif(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def _digest(x: Column) -> Column:
    return F.unhex(F.md5(x))


def _line(x: Column) -> Column:
    return F.btrim(x, F.lit(_ENDS))


def boilerplate(pages: DataFrame, host_col: str, text_col: str, ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """host, line (digest), n_pages, host_pages of each boilerplate line."""
    one = pages.select(F.col(host_col).alias("host"), _digest(F.coalesce(F.col(text_col), F.lit(""))).alias("page"), F.col(text_col).alias("text"))
    totals = materialize(one.select("host", "page").distinct().groupBy("host").agg(F.count("*").alias("host_pages")), "host-pages")
    lines = F.array_distinct(F.filter(F.transform(F.split("text", "\n"), _line), lambda x: x != ""))
    held = one.select("host", "page", F.explode(lines).alias("line")).select("host", "page", _digest(F.col("line")).alias("line"))
    # Distinct first: copies of a page on its host count once.
    counts = held.distinct().groupBy("host", "line").agg(F.count("*").alias("n_pages")).where(F.col("n_pages") >= least)
    counts = materialize(counts, "line-pages")
    found = materialize(counts.join(totals, counts.host.eqNullSafe(totals.host)).where(F.col("n_pages") > ratio * F.col("host_pages")).select(counts.host, "line", "n_pages", "host_pages"), "boilerplate")
    discard(pages.sparkSession, totals, counts)
    return found


def counters(columns: list[str]) -> list[str]:
    """The names of the two columns that ``drop_boilerplate`` adds to these."""
    taken = {c.lower() for c in columns}
    names = ["n_lines", "n_dropped"]
    while taken & set(names):
        names = [n + "_" for n in names]
    return names


def drop_boilerplate(pages: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, least: int = LEAST) -> DataFrame:
    """``pages`` with the boilerplate lines gone from ``text_col``, and the columns ``n_lines`` and ``n_dropped`` (see ``counters``) after the others."""
    spark = pages.sparkSession
    names = pages.columns
    found = boilerplate(pages, host_col, text_col, ratio, least)
    # One list to a host, of bounded length (see above).
    lists = materialize(found.groupBy("host").agg(F.collect_list("line").alias("lines")), "host-boilerplate")
    discard(spark, found)
    # Numbered names, so that no column of the pages can clash.
    rows = pages.toDF(*[f"c{k}" for k in range(len(names))])
    host, text = F.col(f"c{names.index(host_col)}"), F.col(f"c{names.index(text_col)}")
    joined = rows.join(lists, host.eqNullSafe(lists.host), "left")
    split = joined.withColumn("split", F.split(text, "\n"))
    kept = F.filter("split", lambda x: (_line(x) == "") | ~F.array_contains(F.col("lines"), _digest(_line(x))))
    split = split.withColumn("kept", F.when(F.col("lines").isNull(), F.col("split")).otherwise(kept))
    changed = F.size("kept") < F.size("split")
    out = [F.when(changed, F.array_join("kept", "\n")).otherwise(text).alias(f"c{k}") if n == text_col else F.col(f"c{k}") for k, n in enumerate(names)]
    return split.select(*out, F.coalesce(F.size("split"), F.lit(0)).alias("n"), F.coalesce(F.size("split") - F.size("kept"), F.lit(0)).alias("d")).toDF(*names, *counters(names))
