from collections import defaultdict

import duckdb
import pytest

from inkledger.llm import line_dedup as ld
from inkledger.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.01"


def brute(rows, ratio, least):
    """rows: (host, text)"""
    pages = defaultdict(set)
    on = defaultdict(set)
    for host, text in rows:
        pages[host].add(text or "")
        for line in (text or "").split("\n") if text is not None else ():
            if line.strip(" \t\r"):
                on[host, line.strip(" \t\r")].add(text)
    bad = {k for k, v in on.items() if len(v) >= least and len(v) > ratio * len(pages[k[0]])}
    out = []
    for host, text in rows:
        if text is None:
            out.append((host, None, 0, 0))
            continue
        lines = text.split("\n")
        kept = [x for x in lines if (host, x.strip(" \t\r")) not in bad]
        out.append((host, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return out


def test_query_equals_its_oracle_and_drops_lines(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF}/documents.parquet')")
    got = sorted(map(tuple, QUERIES["op6_line_dedup"](spark, SF).collect()))
    assert got == sorted(con.execute(ORACLES["op6_line_dedup"]).fetchall())
    assert sum(r[4] for r in got) > 0


def test_no_python_in_the_plan(spark):
    plan = QUERIES["op6_line_dedup"](spark, SF)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


@pytest.mark.parametrize("least", [1, 2])
def test_edge_rows_equal_brute_force(spark, least):
    rows = [("a", "menu\nx1\n\nfoot"), ("a", "menu \nx2\n\t foot\r"), ("a", "x3\nmenu\nmenu"), ("a", None), ("a", ""), ("b", "menu\ny"), (None, "menu\nq"), (None, "menu\nr"), (None, None), ("a", "x3\nmenu\nmenu"), ("c", "z\n" * 20000), ("d", "é ü\nß"), ("d", "é ü\nt")]
    pages = spark.createDataFrame([(*r, i, 0.5) for i, r in enumerate(rows)], "host string, text string, line int, lines double")
    got = ld.drop_boilerplate(pages, "host", "text", 0.4, least)
    assert got.columns == ["host", "text", "line", "lines", "n_lines", "n_dropped"]
    assert [(r.host, r.text, r.n_lines, r.n_dropped) for r in sorted(got.collect(), key=lambda r: r.line)] == brute(rows, 0.4, least)
    assert ld.drop_boilerplate(pages.limit(0), "host", "text").count() == 0


def test_url_host(spark):
    urls = [("http://A.b.c/x", "a.b.c"), ("https://u:p@h.org:80?x", "h.org"), ("no url", None), (None, None), ("ftp://x", "x")]
    df = spark.createDataFrame(urls, "u string, h string")
    assert all(r[0] == r[1] for r in df.select(ld.url_host(df.u), "h").collect())


def test_small_hosts_lose_what_repeats_and_nothing_else(spark):
    rows = [(h, f"menu\nown {h} {k}") for h, n in (("four", 4), ("two", 2), ("one", 1)) for k in range(n)]
    got = ld.drop_boilerplate(spark.createDataFrame(rows, "host string, text string"), "host").collect()
    assert sorted((r.host, r.text, r.n_dropped) for r in got) == sorted((h, t if h == "one" else t[5:], int(h != "one")) for h, t in rows)


def test_names_that_clash(spark, tmp_path):
    rows = [(i, f"menu\nx{i}", "s", 5, 0.5, "k") for i in range(6)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, n_lines int, N_Dropped_ double, c0 string").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    cleaned = ld.drop_boilerplate(docs)
    assert cleaned.columns == [*docs.columns, "n_lines__", "n_dropped__"] and cleaned.where("n_dropped__ = 1").count() == 6
    got = QUERIES["op6_line_dedup"](spark, str(tmp_path))
    assert got.columns == ["doc_id", "source", "text", "n_lines", "n_dropped"] and {tuple(r)[2:] for r in got.collect()} == {(f"x{i}", 2, 1) for i in range(6)}
