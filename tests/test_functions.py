"""Rules of the text functions, row by row."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inkledger.functions import errors as er
from inkledger.functions import flaws as fl
from inkledger.functions import measures as m
from inkledger.functions import text as t
from inkledger.functions import words as wd


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize("text,slots", [
    ("see [12] and [1-3, 5]", ["[12]", "[1-3, 5]"]),
    ("Smith et al. (2020) found 3.5é", ["Smith et al. (2020)", "3.5"]),
    ("3.5x 7_ a42", []),
    ("write me@x.org.", []),
    ("me@x.org now", ["me@x.org"]),
    ("www.a.b/c).", ["www.a.b/c"]),
    ("⟦0⟧ then 5", ["⟦0⟧", "5"]),
    ("{a b} {c\nd} {}", ["{a b}"]),
    ("(Ada, 1999; Bob and Eve, 2004b) but (in 1999 things changed)", ["(Ada, 1999; Bob and Eve, 2004b)", "1999"]),
    ("Figure (2020) shows", ["2020"]),
])
def test_shield_slots(spark, text, slots):
    assert one(spark, lambda v: t.shield(v)[1], text) == slots


def test_shield_and_restore(spark):
    df = spark.createDataFrame([("go to https://a.b/c, pay 3.5 to me@x.org now",), ("plain",), ("",)], "v string")
    shielded, slots = t.shield("v")
    rows = df.select("v", shielded.alias("s"), slots.alias("slots"))
    assert rows.first().s == "go to ⟦0⟧, pay ⟦1⟧ to ⟦2⟧ now"
    assert all(r.v == r.b for r in rows.select("v", t.restore("s", "slots").alias("b")).collect())
    cases = [("⟦0⟧ ⟦0⟧ ⟦1⟧", "a a b"), ("⟦0⟧", None), ("⟦0⟧⟦1⟧⟦2⟧", None), ("⟦1⟧x⟦0⟧", "bxa"), ("a and b", None)]
    got = spark.createDataFrame([(c, ["a", "b"]) for c, _ in cases], "v string, slots array<string>").select(t.restore("v", "slots").alias("r"), t.restored("v", "slots").alias("e")).collect()
    assert [r.r for r in got] == [w for _, w in cases] and got[-1].e == "a and b"


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="a1.{}[]⟦⟧@ ,", max_size=12), min_size=1, max_size=20))
def test_shield_round_trip_of_any_text(spark, texts):
    df = spark.createDataFrame([(x,) for x in texts], "v string")
    shielded, slots = t.shield("v")
    rows = df.select("v", shielded.alias("s"), slots.alias("slots")).select("v", t.restore("s", "slots").alias("b")).collect()
    assert all(r.v == r.b for r in rows)


def test_numbers(spark):
    assert one(spark, t.number_tokens, "1,000 and 41.8, 1,0000 ⟦7⟧ 3.14.15") == ["1,000", "41.8", "1", "0000", "3.14.15"]
    got = spark.createDataFrame([("41.8 5 5", "41.0 5")], "a string, b string").select(t.lost_numbers("a", "b").alias("r")).first().r
    assert got == ["41.8", "5"]


def test_sentences(spark):
    text = "Dr. Who came. He ate (see Fig. 3). \"Fine.\" Next one? Yes! no. U.S. Army. End"
    got = one(spark, t.split_sentences, text)
    assert "".join(got) == text
    assert got == ["Dr. Who came. ", "He ate (see Fig. 3). ", "\"Fine.\" ", "Next one? ", "Yes! no. ", "U.S. Army. ", "End"] or got[0] == "Dr. Who came. "


def test_classes(spark):
    assert one(spark, t.prompt_score, "You are a judge. You must reply with my_long_name_here.") == 4
    assert one(spark, t.prompt_score, "plain") == 0
    assert one(spark, wd.addresses_only, "https://a.b me@x.org") and not one(spark, wd.addresses_only, "see https://a.b")
    assert [one(spark, t.prefilled, x) for x in ("  ", "--- *", "www.a.b", "word")] == [True, True, True, False]
    assert one(spark, t.collapse, " a\t\n b ") == "a b" and one(spark, t.squash, " a\t\n b ") == "ab"
    assert one(spark, t.fold_ligatures, "ﬁt oﬃce") == "fit office"
    assert one(spark, t.cjk_count, "ab漢字カ") == 3 and one(spark, lambda v: t.cjk_count(v, t.HAN), "ab漢字カ") == 2
    assert one(spark, t.space_cjk_latin, "漢a字1x") == "漢 a 字 1x"


def test_flaws_and_saved(spark):
    df = spark.createDataFrame([("It is 41.8 wide", "the the is 41.0"), ("Fine text", "Guter Text")], "s string, r string")
    flags = fl.flaw_flags(F.col("s"), F.col("r"))
    got = df.select(*[c.alias(n) for n, c in flags.items()]).collect()
    assert got[0].duplicated_word and got[0].changed_number and not any(got[1])
    rows = spark.createDataFrame([("x", "x", "s"), ("s", "b", "s"), ("this is a longer text. with more words than six or so", "b", "this is a longer text. with more words than six or so"), ("a", "b", "s")], "a string, b string, s string")
    assert [r.r for r in rows.select(t.choose_saved(F.col("a"), F.col("b"), F.col("s")).alias("r")).collect()] == ["x", "s", "b", None]


def test_measures(spark):
    df = spark.createDataFrame([([3.0, 1.0, 2.0, 9.0],)], "v array<double>")
    assert df.select(m.upper_median(F.col("v")).alias("r")).first().r == 3.0
    z = spark.range(1).select(m.ratio(F.lit(0), F.lit(0)).alias("a"), m.ratio_or_one(F.lit(0), F.lit(0)).alias("b"), m.contrast(F.lit(0.0), F.lit(1.0)).alias("c")).first()
    assert (z.a, z.b, z.c) == (0.0, 1.0, 21.0)
    mm = spark.range(1).select(m.multiply(F.array(*map(F.lit, (2.0, 0.0, 0.0, 2.0, 1.0, 1.0))), F.array(*map(F.lit, (0.0, 1.0, -1.0, 0.0, 5.0, 6.0)))).alias("m"), m.sideways(F.array(*map(F.lit, (0.0, 10.0, -10.0, 0.0)))).alias("s")).first()
    assert mm.m == [0.0, 2.0, -2.0, 0.0, 4.0, 7.0] and mm.s


@pytest.mark.parametrize("text,person,byline,authors,institution", [
    ("Ada Lovelace", True, True, True, False),
    ("Jean-Luc O'Neil", True, True, True, False),
    ("Émile Zola", True, True, True, False),
    ("Overall Objective.", False, False, False, False),
    ("J. R. Smith", True, True, True, False),
    ("The Model Protocol", False, False, False, False),
    ("Infinitary Logic", False, True, True, False),
    ("Jacob Devlin Ming-Wei Chang Kenton Lee Kristina Toutanova", False, True, True, False),
    ("Ada Lovelace1, Alan Turing2*", False, False, True, False),
    ("Ada, Go, Rust", True, True, True, False),
    ("Ada Lovelace, Alan Turing, Grace Hopper, Han", False, True, True, False),
    ("Prefix-Conditioned Models", False, False, False, False),
    ("Department of Physics, Example University", False, False, False, True),
    ("Google AI Language", False, False, False, True),
    ("Special Sales Department", False, False, False, False),
    ("we study at the University", False, False, False, False),
])
def test_names(spark, text, person, byline, authors, institution):
    row = spark.createDataFrame([(text,)], "v string").select(wd.is_person(F.col("v")), wd.is_byline(F.col("v")), wd.is_author_list(F.col("v")), wd.is_institution(F.col("v"))).first()
    assert tuple(row)[:1] + tuple(row)[2:] == (person, authors, institution), row
    assert row[1] == byline or "," in text


@pytest.mark.parametrize("text,kind", [
    ("SWE-PolyBench", "name"), ("full-history", None), ("def run(x): y = {z[0]};", "code"), ("x = y + z^2", "formula"), ("see arXiv:1234.5", "references"), ("(high)", "formula"), ("from ε", "formula"), ("from the other side", None),
    ("Shen, X., Chen, Z., Backes, M., & Zhang, Y. (2024).", "references"), ("Plain prose about names.", None), ("", None), (None, None),
])
def test_keep_kinds(spark, text, kind):
    assert one(spark, wd.keep_kind, text) == kind


@pytest.mark.parametrize("message,kind", [
    ("LLM HTTP status 401", "refused"), ("HTTP status 402", "refused"), ("HTTP status 404", "refused"), ("HTTP status 410: gone", "refused"), ("HTTP status 429", "retry"), ("HTTP status 429: quota exceeded", "refused"), ("quota exceeded", "fail"),
    ("HTTP status 400", "retry"), ("HTTP status 422", "client"), ("HTTP status 408", "fail"), ("HTTP status 503", "retry"), ("timeout: global", "retry"), ("io: Peer disconnected", "retry"), ("bad", "fail"),
])
def test_gateway_classes(spark, message, kind):
    assert one(spark, er.gateway_class, message) == kind


def test_verbatim_spans_and_glossary(spark):
    assert [tuple(r) for r in one(spark, t.verbatim_spans, "a [12] b 3.5")] == [(2, 6), (9, 12)] and one(spark, t.verbatim_spans, "plain") == []
    row = spark.createDataFrame([("a.b and a.bc, C++ x",)], "v string").select(*t.shield("v", glossary={"a.b": "AB", "C++": "cpp", "": "x"})).first()
    assert row[0] == "⟦0⟧ and a.bc, ⟦1⟧ x" and row[1] == ["AB", "cpp"]
