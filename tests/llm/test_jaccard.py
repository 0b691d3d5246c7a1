import random
import re

import corpus_pipeline as cp
from inkledger.llm import jaccard
from inkledger.llm.simhash import fingerprint, fingerprint_of

from .test_simhash import brute_roots

SF = "/root/testdata/sf0.001"


def grams(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def near(x, y):
    return x == y or 5 * len(x & y) >= 4 * len(x | y)


def kept(rows):
    """Ids (no null, none repeated) that are the least of their group."""
    sets = [(i, grams(t)) for i, t in rows]
    find = brute_roots((a, b) for a, x in sets for b, y in sets if a < b and near(x, y))
    return {i for i, _ in sets if find(i) == i}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return words


def planted():
    """Sources, copies of them with a few words changed (on both sides of the threshold), chains of edits, a common passage."""
    rng = random.Random(11)
    vocabulary = [f"w{i}" for i in range(400)]
    quote = [rng.choice(vocabulary) for _ in range(30)]
    texts = []
    for size in (6, 20, 60, 150, 150, 300):
        source = [rng.choice(vocabulary) for _ in range(size)]
        texts += [source] + [edited(rng, source, rng.randrange(1, 2 + size // 30)) for _ in range(12)]
        chain = source
        for _ in range(5):
            chain = edited(rng, chain, 1 + size // 100)
            texts.append(chain)
    crowd = [rng.choice(vocabulary) for _ in range(120)]
    texts += [edited(rng, crowd, rng.randrange(1, 5)) for _ in range(80)]
    texts += [[rng.choice(vocabulary) for _ in range(k)] + quote for k in range(1, 30)]
    rng.shuffle(texts)
    return [(i, " ".join(w)) for i, w in enumerate(texts)] + [(1000, None), (1001, " \n"), (1002, "Two words"), (1003, "two  WORDS")]


def test_the_stage_drops_edited_copies(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = kept(rows)
    assert {r.doc_id for r in cp.near_copies(spark, docs, SF).collect()} == want and len(want) < len(rows) - 80


def test_any_order_of_shingles_finds_all_links(spark, monkeypatch):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for sample, often in ((1, 2), (3, 1)):
        monkeypatch.setattr(jaccard, "SAMPLE", sample)
        monkeypatch.setattr(jaccard, "OFTEN", often)
        groups = jaccard.near_copies(docs).collect()
        assert {r.component_id for r in groups} == kept(rows) and len(groups) == len(rows)


def test_the_stage_on_the_given_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = cp.near_copies(spark, docs, SF)
    assert got.columns == docs.columns and {r.doc_id for r in got.collect()} == kept(rows)
    assert cp.near_copies(spark, docs.limit(0), SF).count() == 0


def test_repeated_and_missing_ids(spark):
    rows = [(1, "a b c d"), (2, "A B C D"), (7, "some words here now"), (7, "quite another text"), (9, "some words here now"), (None, "alone"), (4, None), (5, "")]
    got = cp.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "a b c d"), (7, "some words here now"), (7, "quite another text"), (None, "alone"), (4, None)], key=str)


def test_the_stage_links_by_simhash_first(spark, monkeypatch):
    """What the pigeonring finds within two bits is linked if it is similar, also without the index keys, and only then."""
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {i: grams(t) for i, t in rows}
    marks = {i: fingerprint_of(jaccard.shingles((t or "").encode())) for i, t in rows if sets[i]}
    met = [(a, b) for a in marks for b in marks if a < b and (marks[a] ^ marks[b]).bit_count() <= 2]
    near_ones = [(a, b) for a, b in met if near(sets[a], sets[b])]
    assert any(sets[a] != sets[b] for a, b in near_ones) and len(near_ones) < len(met)
    none = spark.createDataFrame([], "a long, b long")
    monkeypatch.setattr(jaccard, "links", lambda *_: none)
    blank = [i for i, x in sets.items() if not x]
    find = brute_roots([*near_ones, *((blank[0], b) for b in blank)])
    assert {r.doc_id for r in cp.near_copies(spark, docs, SF).collect()} == {i for i in sets if find(i) == i}


def test_fingerprint_of_hashes_is_that_of_the_text(monkeypatch):
    text = " ".join(str(i * 7 % 1000) for i in range(900)).encode()  # no shingle repeats
    monkeypatch.setattr(jaccard, "SLICE", 64)
    assert fingerprint_of(jaccard.shingles(text, 5)) == fingerprint(text, 5)
