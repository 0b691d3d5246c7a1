import pytest

from inkledger import api
from inkledger.operators.translate import Identity, Marked
from inkledger.options import Options, resolve
from inkledger.sources import pdf


def test_extract_segment_and_translate(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(pdf.hello("Hello there", 3))
    found = api.extract(spark, str(tmp_path))
    summary = found.summary().first()
    assert (summary.total, summary.pending, summary.complete) == (33, 33, False)
    assert found.pages.first().x1 == 612.0 and found.diagnostics.count() == 0 and found.regions.count() == 0
    rows = api.segments(found.glyphs)
    assert [r.text for r in rows.collect()] == ["Hello there Hello there Hello there"]
    done, report = api.translate_segments(rows, Marked(), Options())
    assert done.first().translated == "«Hello there Hello there Hello there»" and report.first().exit_code == 0


def test_references_stay(spark):
    text = ["Body text", "References", "[1] Smith, A. 2019", "[2] Jones, B. 2020"]
    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate(text)], "doc_id long, id long, text string")
    done = {r.id: r.translated for r in api.translate_segments(rows, Marked())[0].collect()}
    assert done == {0: "«Body text»", 1: text[1], 2: text[2], 3: text[3]}
    assert {r.translated for r in api.translate_segments(rows, Identity(), Options(skip_references=False))[0].collect()} == set(text)


def test_options():
    assert resolve({"from": "de", "batch_size": "4", "target": " "}, {"INKLEDGER_TARGET": "fr", "INKLEDGER_SOURCE": "xx"}) == Options(source="de", target="fr", batch_size=4)
    assert resolve({"unknown": 1}, {}) == Options() and Options(size_scale=9).scale == 1.05 and Options(batch_size=1).sizes == (1,)
    with pytest.raises(ValueError):
        resolve({"batch_size": 0}, {})
