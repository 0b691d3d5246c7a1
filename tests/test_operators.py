"""Operators against brute force on small inputs."""

import random

import pytest
from pyspark.sql import functions as F

from inkledger.operators import anomalies as an
from inkledger.operators import coverage as cov
from inkledger.operators import layout
from inkledger.operators import references as refs
from inkledger.operators import segments as seg
from inkledger.operators import spatial as sp
from inkledger.operators import translate as tr
from inkledger.sources import cjk, files, pdf
from inkledger.streaming import events as ev


def test_touching_and_nearest_equal_brute_force(spark):
    rng = random.Random(4)
    box = lambda: (lambda x, y: (x, y, x + rng.uniform(0, 60), y + rng.uniform(0, 30)))(rng.uniform(-50, 600), rng.uniform(-50, 800))
    left, right = ([(d, p, k, *box()) for d in (1, 2) for p in (0, 1) for k in range(25)] for _ in range(2))
    cols = "doc_id long, page_index int, key long, x0 double, y0 double, x1 double, y1 double"
    got = {tuple(r) for r in sp.touching(spark.createDataFrame(left, cols), spark.createDataFrame(right, cols), 2.0).collect()}
    want = {a[:3] for a in left for b in right if a[:2] == b[:2] and a[3] < b[5] + 4 and b[3] < a[5] + 4 and a[4] < b[6] + 4 and b[4] < a[6] + 4}
    assert got == want and want
    points = [(1, 0, i, round(rng.uniform(0, 20), 2), round(rng.uniform(0, 20), 2)) for i in range(300)]
    others = [(1, 0, i, round(rng.uniform(0, 20), 2), round(rng.uniform(0, 20), 2)) for i in range(300)]
    cols = "doc_id long, page_index int, id long, x double, y double"
    got = {r.id: r.near.id for r in sp.nearest(spark.createDataFrame(points, cols), spark.createDataFrame(others, cols)).collect()}
    want = {}
    for p in points:
        near = sorted((((p[3] - o[3]) ** 2 + (p[4] - o[4]) ** 2) ** 0.5, o[2]) for o in others)
        if near[0][0] <= 0.8:
            want[p[2]] = near[0][1]
    assert got == want


def test_coverage_card(spark):
    rows = [(1, 1, 0, "a", "pending", None), (1, 2, 0, "b", "rewritten", None), (1, 3, 0, "c", "kept_original", "overflow"), (1, 4, 0, "漢", "kept_original", "overflow"), (1, 5, 0, "d", "kept_original", "name"), (1, 6, 0, "e", "kept_original", "odd"), (2, 1, 0, " ", "non_text", None)]
    g = spark.createDataFrame(rows, "doc_id long, id long, page_index int, unicode string, state string, reason string")
    got = {r.doc_id: r for r in cov.coverage(g, "doc_id").collect()}
    assert (got[1].total, got[1].kept_original, got[1].intentional, got[1].real_misses, got[1].complete) == (6, 4, 1, 2, False)
    assert got[2].complete and cov.by_page(g).first().misses == {0: 2}
    with pytest.raises(Exception, match="unresolved"):
        cov.assert_complete(g).collect()
    change = lambda i: spark.createDataFrame([(1, i, "rewritten", None)], "doc_id long, id long, new_state string, new_reason string")
    assert cov.mark(g, change(1)).where("id = 1 and doc_id = 1").first().state == "rewritten"
    with pytest.raises(Exception, match="final"):
        cov.mark(g, change(2)).collect()


def test_translate_passes_retries_and_reports(spark):
    rows = [(1, 1, "Pay 41.8 to https://a.b now"), (1, 2, "Pay 41.8 to https://a.b now"), (1, 3, "---"), (2, 1, "skip this one"), (2, 2, "saved text"), (2, 3, None), (2, 4, "boom here")]
    df = spark.createDataFrame(rows, "doc_id long, id long, text string")
    saved = spark.createDataFrame([("saved text", "was")], "source string, translated string")
    out = tr.translate(df, tr.Marked(omit="skip", refuse="boom"), saved)
    got = {(r.doc_id, r.id): (r.translated, r.how) for r in out.collect()}
    assert got == {(1, 1): ("«Pay 41.8 to https://a.b now»", "translated"), (1, 2): ("«Pay 41.8 to https://a.b now»", "translated"), (1, 3): ("---", "prefilled"), (2, 1): ("skip this one", "kept"), (2, 2): ("was", "saved"), (2, 3): ("", "prefilled"), (2, 4): ("boom here", "kept")}
    r = tr.report(out).first()
    assert (r.segments, r.kept, r.exit_code) == (7, 2, 2)
    reasons = {x.source: x.reason for x in out.where("how = 'kept'").collect()}
    assert "429" in reasons["boom here"] and "no answer" in reasons["skip this one"]
    assert tr.translate(df, tr.Identity()).where("how = 'kept'").count() == 0
    with pytest.raises(Exception, match="no saved rendering"):
        tr.replay(df.where("id = 1"), saved).collect()


def test_reply_forms(spark):
    forms = ['{"translations":[{"id":1,"text":"x"}]}', '```json\n[{"id":1,"translation":"x"}]\n```', 'Sure: {"translations":[{"id":1,"text":"x"}]} done', "nonsense"]
    got = [r.r for r in spark.createDataFrame([(f,) for f in forms], "f string").select(seg.parse_reply(F.col("f")).alias("r")).collect()]
    assert [[tuple(x) for x in g] if g else g for g in got] == [[(1, "x")]] * 3 + [None]


def test_layout():
    text = "A line of plain words, see https://example.org/a-long-path here. 漢字、かな（括弧）です。"
    assert "".join(layout.pieces(text)) == text and any("https://example.org/a-long-path" in p for p in layout.pieces(text))
    for ems in (4, 9, 20, 100):
        lines = layout.wrap(text, ems)
        assert "".join(lines).replace(" ", "") == text.replace(" ", "")
        assert all(layout.width(x[:-1] if x[-1] in layout.HANGING else x) <= ems for x in lines)
    lines, size, leading = layout.fit("word " * 40, 200, 60, 12)
    assert size < 12 and len(lines) * leading <= 60.01
    assert layout.fit("word " * 400, 50, 20, 12) is None and layout.wrap("", 5) == []
    assert max(layout.justify("漢字漢字", 4.05)) <= 0.05 and layout.justify("abc", 9) == [0.0] * 3


def test_reference_fold(spark):
    text = ["Intro", "References", "[1] Smith, A. 2019", "more of it", "[2] Jones, B. 2020", "Appendix A", "tail"]
    rows = [(1, i, x) for i, x in enumerate(text)] + [(2, 0, "References"), (2, 1, "none follow")] + [(3, i, x) for i, x in enumerate(["x", "[1] A title 2001", "b", "[2] B title 2002", "c"])]
    got = {(r.doc_id, r.row) for r in refs.reference_lines(spark.createDataFrame(rows, "doc_id long, row int, text string")).where("reference").collect()}
    assert got == {(1, 1), (1, 2), (1, 3), (1, 4), (3, 1), (3, 2), (3, 3), (3, 4)}


def test_files(spark, tmp_path):
    (tmp_path / "g.csv").write_text('source,target\n# note\n"a, b",c\nlonger,d\n')
    assert [tuple(r) for r in files.longest_first(files.glossary_csv(spark, str(tmp_path / "g.csv"))).collect()] == [("longer", "d"), ("a, b", "c")]
    (tmp_path / "g.json").write_text('{"a":"b"}')
    (tmp_path / "h.json").write_text('[{"src":"a","tgt":"b"}]')
    assert all([tuple(r) for r in files.glossary_json(spark, str(tmp_path / n)).collect()] == [("a", "b")] for n in ("g.json", "h.json"))
    (tmp_path / "c.jsonl").write_text('{"source":"s","translated":"1"}\nbroken\n{"source":"s","translated":"2"}\n')
    assert [tuple(r) for r in files.checkpoint(spark, str(tmp_path / "c.jsonl")).collect()] == [("s", "2")]
    (tmp_path / "m.json").write_text('{"version":1,"documents":[{"id":"a","sha256":"' + "0" * 64 + '","bytes":3,"ci":true,"tags":["x"]},{"id":"b","ci":false}]}')
    listed = files.manifest(spark, str(tmp_path / "m.json"), ci_only=True)
    assert [r.id for r in listed.collect()] == ["a"]
    found = spark.createDataFrame([("a", bytearray(b"abc"))], "id string, content binary")
    assert tuple(files.verified(found, listed).first())[1:] == (True, False)
    assert "| a |" in files.markdown(listed.select("id"), "T")


def test_pdf(spark, tmp_path):
    (tmp_path / "hello.pdf").write_bytes(pdf.hello())
    (tmp_path / "bad.pdf").write_bytes(b"not a pdf")
    rows = pdf.read_pdfs(spark, str(tmp_path))
    glyphs = rows.where("kind = 'glyph'").orderBy("id").collect()
    assert "".join(g.unicode for g in glyphs) == "Hello" and [g.y for g in glyphs] == [720.0] * 5
    assert all(abs(a.x + a.dx - b.x) < 1e-9 for a, b in zip(glyphs, glyphs[1:], strict=False))
    report = cov.coverage(rows.where("kind = 'glyph'"), "path").first()
    assert (report.total, report.pending, report.complete) == (5, 5, False)
    assert rows.where("kind = 'diagnostic'").count() == 1 and rows.where("kind = 'page'").first().x1 == 612.0


def test_pdf_content():
    import zlib

    body = zlib.compress(b"q 1 0 0 rg 2 0 0 2 10 10 cm BT /F 10 Tf 0 5 Td [(A\\102) -500 <43>] TJ ET Q 0 0 100 1 re f /X Do BI /W 1 ID \x00(\x01 EI BT /F 5 Tf 3 Tr (z) ' ET")
    form = b"BT /F 8 Tf (in) Tj ET"
    cmap = b"1 beginbfchar <7A> <03B6> endbfchar 1 beginbfrange <41> <43> <0061> endbfrange"
    parts = [b"<</Type/Catalog/Pages 2 0 R>>", b"<</Type/Pages/MediaBox[0 0 200 300]/Kids[3 0 R]>>", b"<</Type/Page/Contents 4 0 R/Resources<</Font<</F 5 0 R>>/XObject<</X 6 0 R>>>>>>", b"<</Filter/FlateDecode/Length %d>>stream\n%s\nendstream" % (len(body), body), b"<</Type/Font/BaseFont/T/ToUnicode 7 0 R/FirstChar 65/Widths[600 600 600]>>", b"<</Subtype/Form/Length %d/Matrix[1 0 0 1 50 0]>>stream\n%s\nendstream" % (len(form), form), b"<</Length %d>>stream\n%s\nendstream" % (len(cmap), cmap)]
    rows = list(pdf.extract(b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % x for x in enumerate(parts, 1))))
    glyphs = [r for r in rows if r["kind"] == "glyph"]
    assert [g["unicode"] for g in glyphs] == ["a", "b", "c", "i", "n", "ζ"] and rows[0]["y1"] == 300
    assert [g["x"] for g in glyphs[:3]] == [10.0, 22.0, 44.0] and glyphs[0]["font_size"] == 20 and glyphs[0]["fill"] == [1.0, 0.0, 0.0]
    assert glyphs[3]["source_kind"] == "form" and glyphs[3]["x"] == 50 and glyphs[5]["invisible"]
    assert [r["kind"] for r in rows if r["kind"] in ("path", "image")] == ["path", "image"]


def test_upserts(spark, tmp_path):
    uri = str(tmp_path / "store")
    for at, value in ((1, "a"), (2, "b")):
        ev.upsert(spark.createDataFrame([("s", value, at), (f"t{at}", value, at)], "source string, translated string, at long"), uri)
    assert {tuple(r) for r in ev.latest(spark, uri).collect()} == {("s", "b"), ("t1", "a"), ("t2", "b")}


def test_contained_by_branch(spark):
    source = spark.createDataFrame([(1, 0, 100.0, 50.0, 100.0), (1, 0, 100.0, 115.0, 200.0), (1, 0, 110.0, 300.0, 350.0), (1, 0, 300.0, 0.0, 600.0)], "doc_id long, page_index int, y double, x0 double, x1 double")
    rows = [(50.0, 200.0, False, True), (47.0, 203.0, False, True), (46.0, 204.0, False, True), (30.0, 200.0, False, False), (202.0, 206.0, True, True), (202.0, 206.0, False, False), (210.0, 290.0, False, False), (295.0, 355.0, False, True)]
    lines = spark.createDataFrame([(1, 0, k, 104.0, a, b, 10.0, m) for k, (a, b, m, _) in enumerate(rows)] + [(1, 0, 99, 500.0, 0.0, 1.0, 10.0, False)], "doc_id long, page_index int, row int, y double, x0 double, x1 double, size double, mark boolean")
    got = {r.row: r.inside for r in sp.contained(lines, source).collect()}
    assert got == {**{k: r[3] for k, r in enumerate(rows)}, 99: False}


def test_crossings_skip_what_the_source_crosses(spark):
    line = "doc_id long, page_index int, row int, x0 double, x1 double, y double, size double"
    source = spark.createDataFrame([(1, 0, 0, 50.0, 150.0, 100.0, 10.0), (1, 0, 1, 50.0, 250.0, 130.0, 10.0)], line)
    output = spark.createDataFrame([(1, 0, 0, 50.0, 250.0, 103.0, 10.0), (1, 0, 1, 50.0, 260.0, 130.0, 10.0), (1, 0, 2, 50.0, 260.0, 160.0, 10.0)], line)
    regions = spark.createDataFrame([(1, 0, 200.0, 90.0, 400.0, 170.0), (1, 0, 205.0, 90.0, 209.0, 170.0), (1, 0, 210.0, 90.0, 400.0, 105.0), (1, 0, 0.0, 0.0, 612.0, 792.0)], "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    assert [(r.row, r.edge) for r in sp.boundary_crossings(output, source, sp.panel_edges(regions, 612, 792)).collect()] == [(0, 200.0)]


def test_orphan_rules_by_branch(spark):
    rules = [("path", 100.0, 101.0, 130.0, 102.0), ("path", 100.0, 100.0, 130.0, 102.0), ("path", 100.0, 101.0, 101.0, 102.0), ("path", 100.0, 101.0, 145.0, 102.0), ("image", 100.0, 101.0, 130.0, 102.0), ("path", 300.0, 101.0, 330.0, 102.0), ("path", 300.0, 115.0, 330.0, 116.0), ("path", 347.0, 101.0, 360.0, 102.0)]
    regions = spark.createDataFrame([(1, 0, k, *r) for k, r in enumerate(rules)], "doc_id long, page_index int, key int, kind string, x0 double, y0 double, x1 double, y1 double")
    boxes = spark.createDataFrame([(1, 0, 310.0, 95.0, 330.0, 108.0)], "doc_id long, page_index int, x0 double, y0 double, x1 double, y1 double")
    assert sorted(r.key for r in sp.orphan_rules(regions, boxes).collect()) == [0, 6, 7]


def test_toc_reasons(spark):
    rows = [("a 12", 72.0, 500.0, "latin-stub"), ("录 A", 72.0, 500.0, "split-appendix"), ("■ 附录 B 7", 72.0, 500.0, None), ("标题 附录 B 7", 72.0, 500.0, "run-on"), ("中 9", 72.0, 500.0, "orphan-char"), ("中 9", 72.0, 50.0, None), ("xiv", 300.0, 500.0, None), ("12", 300.0, 500.0, "detached-number"), ("12", 72.0, 500.0, None), ("Title 12", 72.0, 500.0, None)]
    df = spark.createDataFrame([(*r, 10.0) for r in rows], "text string, x double, y double, want string, size double")
    got = df.select("text", "want", an.toc_reason(F.col("text"), F.col("x"), F.col("y"), F.col("size")).alias("got")).collect()
    assert [(r.text, r.got) for r in got] == [(r.text, r.want) for r in got]


@pytest.mark.parametrize("name,text,vertical", [("GBK-EUC-H", "中文A字", False), ("90ms-RKSJ-V", "日本ｱA語", True), ("ETen-B5-H", "繁體A中", False), ("KSCms-UHC-H", "한국A어", False), ("UniGB-UCS2-H", "中文A", False), ("UniJIS-UTF32-V", "日本", True), ("EUC-H", "日本A語", False)])
def test_predefined_maps(name, text, vertical):
    p = cjk.predefined(name)
    assert "".join(p.unicode(c) for c in p.codes(text.encode(p.codec))) == text and p.vertical == vertical
    font = pdf.Font(two_bytes=True, predefined=p)
    assert [font.unicode(c) for c in font.codes(text.encode(p.codec))] == list(text)


def test_odd_codes_of_predefined_maps():
    p = cjk.predefined("GBK-EUC-H")
    assert list(p.codes(b"\xd6\xd0A\xd6")) == [b"\xd6\xd0", b"A", b"\xd6"] and p.unicode(b"\xd6") is None
    assert cjk.predefined("UniGB-UTF16-H").unicode(b"\xd8\x00") is None
    assert list(cjk.predefined("EUC-V").codes(b"\x8f\xa2\xaf\x8e\xb1")) == [b"\x8f\xa2\xaf", b"\x8e\xb1"]
    assert cjk.predefined("Identity-H") is None and cjk.predefined(None) is None
