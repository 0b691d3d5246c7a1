import hashlib
import random
import re

import numpy as np

from inkledger.llm import decontaminate as dc
from inkledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, window=10):
    grams = {}
    for item, text in items:
        w = words(text)
        for k in range(max(1, len(w) - window + 1)) if w else ():
            grams.setdefault(tuple(w[k : k + window]), set()).add(item)
    sizes = {len(g) for g in grams}
    out = []
    for doc, text in docs:
        w, hit, found = words(text), set(), set()
        for n in sizes:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit.update(range(k, k + n))
                    found |= {str(i) for i in grams[g] if i is not None}
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return out


KEY = {"key": lambda r: (r[0] is None, r)}


def test_query_equals_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    got = sorted(tuple(r)[:6] for r in QUERIES["op5_decontamination"](spark, SF).collect())
    assert got == sorted(brute(docs, items)) and any(r[5] for r in got)


def test_random_texts_short_items_and_many_files(spark, monkeypatch):
    rng = random.Random(5)
    text = lambda n, v: " ".join(rng.choice(v) for _ in range(n))
    items = [(i, text(rng.choice([0, 1, 2, 3, 4, 7]), "abcdÉ")) for i in range(12)] + [(None, "x y z"), (3, "twice here"), (20, None), (21, "...")]
    docs = [(i, text(rng.randrange(40), "aAbcdeÉ") + rng.choice(["", " x-Y z", " twice here"])) for i in range(60)] + [(None, None), (7, ""), (8, "a " * 30000)]
    d, b = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    for block, shard in ((1 << 24, 1 << 23), (8, 50)):
        monkeypatch.setattr(dc, "BLOCK", block)
        monkeypatch.setattr(dc, "SHARD", shard)
        got = [tuple(r)[:6] for r in dc.contamination(d, b, window=3).collect()]
        assert sorted(got, **KEY) == sorted(brute(docs, items, 3), **KEY)
        kept = [(r.doc_id, r.text) for r in dc.decontaminate(d, b, window=3).collect()]
        assert sorted(kept, key=str) == sorted([x for x, r in zip(docs, brute(docs, items, 3), strict=True) if not r[5]], key=str)


def test_longest_match_and_empty_tables(spark):
    d = spark.createDataFrame([(1, "no one two three four five no"), (2, "clean")], "doc_id long, text string")
    b = spark.createDataFrame([(9, "zero one two three four five six"), (8, "two three four")], "item_id long, text string")
    rows = {r.doc_id: r for r in dc.contamination(d, b, window=3).collect()}
    assert tuple(rows[1].longest) == (5, 1, "9", 1) and rows[2].longest is None
    assert [tuple(m) for m in rows[1].matches] == [(5, 1, "9", 1), (3, 2, "8", 0)] and rows[2].matches == []
    assert dc.contamination(d.limit(0), b).count() == 0
    assert [r.contaminated for r in dc.contamination(d, b.limit(0)).collect()] == [False, False]


def test_small_shards_of_null_and_short_texts(spark):
    items = [(1, "one two three four five six seven eight nine ten eleven twelve"), (2, "a b c d e f g h i j")]
    b = spark.createDataFrame(items, "item_id long, text string")
    cases = [[(0, " ".join("abcdefghijk"[:n]))] for n in range(12)] + [[(i, rng) for i in range(n)] for n in range(2, 10) for rng in (None, "", "a")]
    for rows in cases:
        d = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
        got = [tuple(r)[:6] for r in dc.contamination(d, b).collect()]
        assert sorted(got) == sorted(brute(rows, items))
    assert [r.doc_id for r in dc.decontaminate(spark.createDataFrame([(4, "too short")], "doc_id long, text string"), b).collect()] == [4]


def test_suffixes_are_in_whole_order():
    rng = random.Random(8)
    for n, most in ((0, 2), (1, 1), (40, 1), (200, 1), (400, 2), (400, 4), (60, 9)):
        for shortest in (1, 2, 3):
            ids = np.array([rng.randrange(most + 1) if rng.random() < 0.2 else rng.randrange(1, most + 1) for _ in range(n)], dtype=np.uint32)
            at, keys = dc.suffix_array(ids, shortest, 3)
            suffix = lambda i, x=ids.tolist(): tuple(x[i : (x + [0]).index(0, i)])
            assert sorted(at.tolist()) == [i for i in range(n) if len(suffix(i)) >= shortest]
            assert [suffix(i) for i in at] == sorted(suffix(i) for i in at) and len(keys) == len(at)
