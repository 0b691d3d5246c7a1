"""Queries against DuckDB on small tables of what larger ones hold."""

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import inkledger.plans.geometry  # noqa: F401 -- these register theirs
import inkledger.plans.queries
import inkledger.plans.rules
from inkledger.plans.registry import ORACLES, QUERIES
from inkledger.sources import glyphs as gl


@pytest.fixture
def rows(spark, tmp_path):
    """Both sides' rows of a query over the tables given."""

    def of(name, **tables):
        con = duckdb.connect()
        for table, (schema, values) in tables.items():
            spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{table}.parquet")
            con.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
        found = con.execute(ORACLES[name])
        columns = [d[0] for d in found.description]
        want = sorted(map(repr, found.fetchall()))
        return sorted(repr(tuple(r)) for r in QUERIES[name](spark, str(tmp_path)).select(*columns).collect()), want

    return of


DOCS = "doc_id long, text string"


def test_saved_texts_of_one_word_copied(rows):
    got, want = rows("saved_texts", documents=(DOCS, [(1, "De."), (3, "De."), (6, "a b"), (9, "a b")]))
    assert got == want


def test_url_email_words_with_marks_around(rows):
    words = "a.1@mail7.example. www. https:// www.a.b (a@b.org) a@b.org ..@b.org http://x"
    got, want = rows("url_email_words", pages=("page_id long, html string", [(1, f"<p>{words}</p>")]), documents=(DOCS, [(1, words)]))
    assert got == want


def test_score_extractions_of_odd_tokens(rows):
    texts = [
        "of the.72@mail3.example.com%%% and a.5@b.c. or x.1@y.org, 7", "xhttps://a.b/1 https://a.b/2). a@https://c.d 3", "(Smith 1999) as Smith (1999) and [12, 3]", "1.5x 2.5 a3 4b. {5 6} {7 \u27e68\u27e9",
        "\n".join(["\u00e9" * 41 + "a" * 39, *["a" * 80] * 63]), "  \n ",
    ]
    got, want = rows("score_extractions", documents=(DOCS, list(enumerate(texts))))
    assert got == want


def test_score_extractions_of_odd_white_space(rows):
    texts = ["a\tb 1\r\n2\x0b\x0c", "a\u00a0b\u3000c\u2003\u202f1", "\u00a0\u1680", "\t", "\u2028\u0085\u200b\ufeff x"]
    got, want = rows("score_extractions", documents=(DOCS, list(enumerate(texts))))
    assert got == want


def test_score_extractions_of_odd_ids(rows):
    twice = "see [12] and 3.5 at a@b.org\nline 2 of 7"
    values = [(None, twice), (None, "x 4"), (1, None), (2, ""), (-5, "x 1"), (7, twice), (7, twice), *[(8, "ab 12 c" * 40)] * 3]
    got, want = rows("score_extractions", documents=(DOCS, values))
    assert got == want


def test_score_extractions_of_a_long_citation(rows):
    got, want = rows("score_extractions", documents=(DOCS, [(1, f"[{', '.join(map(str, range(3000)))}] and [1, 2 x 3]")]))
    assert got == want


@pytest.mark.parametrize("name", ["style_retention", "identity_align", "line_coverage"])
def test_separators_of_words_are_not_visible(rows, name):
    got, want = rows(name, documents=(DOCS, [(1, "a\u00a0b\u3000c\u2003\u202f1"), (2, "\u00a0\u1680\n\u205f"), (3, "\t\u200b \u2028")]))
    assert got == want


def test_glyphs_of_a_task_are_few(spark):
    """What is sorted in a task fits beside the other's of an executor, so it isn't spilled."""
    own = gl.dealt(spark, "/root/testdata/sf0.1").groupBy(F.spark_partition_id()).agg(F.sum(F.octet_length("text")).alias("n"))
    assert max(r.n for r in own.collect()) < 2_000_000


@pytest.mark.parametrize("name", ["identity_align", "cell_context", "style_retention"])
def test_glyphs_are_not_shuffled(spark, name):
    """A text is sent to its task once, and glyphs and cells meet there; only sums of a document may be sent again."""
    before = spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition")
    plan = QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    sent = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert sent and all(re.search(r"hashpartitioning\(doc_id#\d+L, \d+\)", line) for line in sent)
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == before


def test_keep_kinds_works_each_rule_out_once(spark):
    plan = QUERIES["keep_kinds"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("universite") == 3  # a word of institutions; texts are of three tables


def test_score_extractions_leaves_its_glyphs_where_the_texts_are(spark, tmp_path):
    texts = [f"Page {i} of 12,345 and [{i}].\n" * 40 for i in range(300)]
    spark.createDataFrame(list(enumerate(texts)), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    before = {p for p in map(str, spark_made(spark))}
    plan = QUERIES["score_extractions"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert before == {p for p in map(str, spark_made(spark))}  # nothing is written between
    assert not [line for line in plan.splitlines() if "Exchange" in line and "REPARTITION_BY" not in line]


def spark_made(spark):
    root = spark.conf.get("spark.checkpoint.dir", None)
    return [p for p in Path(root).glob("source-lines-*")] + [p for p in Path(root).glob("output-lines-*")]
