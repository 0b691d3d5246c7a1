import zlib
from collections import defaultdict

import corpus_pipeline as cp
from inkledger.llm import language_id as li

from .test_decontaminate import brute as contaminated
from .test_jaccard import kept as least_of_groups
from .test_line_dedup import brute as line_brute
from .test_packing import check

SF = "/root/testdata/sf0.001"


def test_each_stage_equals_brute_force_on_its_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    rows = {r.doc_id: r for r in docs.collect()}
    model = li.train(docs)
    kept = cp.language(spark, docs, SF)
    want = {i for i, r in rows.items() if (lambda p: p[0][0] != "und" and not p[2][0])(li._predict(model, [type("S", (), {"as_py": lambda self, t=r.text: t})()]))}
    assert kept.columns == columns and {r.doc_id for r in kept.collect()} == want and len(want) >= 0.98 * len(rows)

    lined = cp.lines(spark, kept, SF)
    before = sorted(kept.collect(), key=lambda r: r.doc_id)
    after = sorted(lined.collect(), key=lambda r: r.doc_id)
    cleaned = line_brute([(r.source, r.text) for r in before], 0.1, 2)
    assert lined.columns == columns and [(r.source, r.text) for r in after] == [c[:2] for c in cleaned]
    assert all(a.n_chars == (len(a.text) if c[3] else b.n_chars) for a, b, c in zip(after, before, cleaned, strict=True))

    single = cp.near_copies(spark, lined, SF)
    assert single.columns == columns and {r.doc_id for r in single.collect()} == least_of_groups([(r.doc_id, r.text) for r in after])

    clean = cp.benchmarks(spark, single, SF)
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    dirty = {r[0] for r in contaminated([(r.doc_id, r.text) for r in single.collect()], items) if r[5]}
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {r.doc_id for r in single.collect()} - dirty and dirty

    texts = [(r.doc_id, r.text) for r in clean.collect()]
    check(cp.packing(spark, clean, SF).collect(), texts)
    ran = cp.run(spark, SF).collect()
    assert check(ran, texts) > 0
    lengths = defaultdict(int)
    for r in ran:
        lengths[r.doc_id] += r.length
    assert set(lengths) == {i for i, _ in texts} and zlib.crc32(b"") == 0


def test_repeated_ids_and_empty_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    twice = docs.unionByName(docs.where("doc_id < 20"))
    got = [r.doc_id for r in cp.near_copies(spark, twice, SF).collect()]
    assert len(got) == len(set(got)) and set(got) == {r.doc_id for r in cp.near_copies(spark, docs, SF).collect()}
    for name, stage in cp.STAGES:
        assert stage(spark, docs.limit(0), SF).count() == 0, name


def test_edge_rows_run_through_all_stages(spark, tmp_path):
    prose = [f"the {a} of the {b} went with {c} and the {b} was {a} of it all in the end" for a in ("house", "garden", "river") for b in ("king", "miller", "baker") for c in ("joy", "grief")]
    rows = [(i, t, "en", "s", 7, float(i), "x", None) for i, t in enumerate(prose)]
    rows += [(100, None, "en", "s", 7, 0.0, "x", None), (101, "", None, None, None, 0.0, None, None), (102, "12 34", "en", "s", 1, 0.0, "x", None)]
    rows += [(103, " ".join(f"word{k}" for k in range(60000)), "en", None, 7, 0.0, "x", None), (104, rows[3][1], "en", None, 7, 0.0, "x", None), (104, rows[3][1], "en", None, 7, 0.0, "x", None)]
    rows += [(None, "menu\nsome words of the one without an id", "en", None, 7, 0.0, "x", None), (105, rows[5][1].upper(), "en", "t", 7, 0.0, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_lines int, n_dropped double, line string, piece int")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("a", "the garden of the baker went with joy and the baker was"), ("b", None), (None, "")], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, str(tmp_path))
        assert now.columns == docs.columns, name
    ids = [r.doc_id for r in now.collect()]
    assert not {100, 101, 102, 104, 105} & set(ids) and 103 in ids and ids.count(None) == 1 and 10 not in ids and len(ids) == len(set(ids))
    packed = cp.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == set(ids)
