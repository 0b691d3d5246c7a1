import random
import re

import xxhash
from pyspark.sql import functions as F

from inkledger.llm import simhash
from inkledger.llm.components import components
from inkledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_roots(pairs):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return find


def brute(rows):
    marks = [(i, brute_fingerprint(t)) for i, t in rows]
    find = brute_roots((a, b) for a, x in marks for b, y in marks if a < b and (x ^ y).bit_count() <= 2)
    return sorted((i, f"{x:016x}", find(i)) for i, x in marks)


def test_query_equals_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(tuple(r)[:3] for r in QUERIES["op3_simhash_dedup"](spark, SF).collect()) == brute(rows)


def test_links_hold_components_for_any_hot_bound(spark):
    rng = random.Random(3)
    prints = {rng.getrandbits(64) for _ in range(60)}
    for center in list(prints)[:6]:  # crowds and chains around a few
        x = center
        for _ in range(40):
            prints.add(center ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
            x ^= (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))
            prints.add(x)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    want = [(a, b) for a in prints for b in prints if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 2]
    find = brute_roots(want)
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    for hot in (0, 3, 1000):
        got = {tuple(r) for r in simhash.links(fps, hot=hot).collect()}
        assert got <= set(want) and (hot < 1000 or got == set(want))
        same = brute_roots(got)
        assert all(same(p) == find(p) for p in prints)


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a"), (5, "A"), (6, "w " * 50000), (6, "w " * 50000), (7, "é b"), (9, "É b")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, fp string")
    got = sorted(tuple(r)[:3] for r in simhash.near_duplicates(docs).collect())
    assert got == sorted((i, f"{brute_fingerprint(t):016x}", dict(zip([1, 2, 3, 4, 5, 6, 7, 9], [1, 1, 1, 4, 4, 6, 7, 9]))[i]) for i, t in rows)
    nulls = spark.createDataFrame([(None, "x y z"), (8, "x y z"), (None, "alone there")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(nulls).collect()), key=str) == [(8, 8), (None, 8), (None, None)]
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_long_texts_hash_in_slices(monkeypatch):
    text = " ".join(str(i * 7 % 1000) for i in range(5000))
    monkeypatch.setattr(simhash, "SLICE", 7)
    assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


def test_components_of_a_long_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 200)] + [(5, i) for i in range(300, 400)] + [(7, 7), (9, 8), (8, 9)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    find = brute_roots(edges)
    assert got == {x: find(x) for e in edges for x in e if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long").where(F.lit(True))).count() == 0


def test_one_of_each_keeps_what_differs(spark):
    rows = [(1, "a b c d"), (2, "A B C D"), (7, "some words here now"), (7, "quite another text there"), (7, "quite another text there"), (9, "some words here now"), (None, "a b c d"), (None, None), (4, None), (5, "")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, fp string")
    got = sorted(((r.doc_id, r.text) for r in simhash.one_of_each(docs).collect()), key=str)
    assert got == sorted([(1, "a b c d"), (7, "some words here now"), (7, "quite another text there"), (4, None), (None, "a b c d"), (None, None)], key=str)
    assert simhash.one_of_each(docs).columns == ["text", "doc_id", "fp"]
