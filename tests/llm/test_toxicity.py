import math
import random
import re
import zlib
from collections import Counter

import numpy as np

from inkledger.llm import toxicity as tx
from inkledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.1"


def test_held_out_precision_and_recall(spark):
    truth = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    got = QUERIES["op2_toxicity"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    positive = [r for r in out if truth[r.doc_id] == 1]
    caught = [r for r in positive if r.predicted]
    wrong = [r for r in out if truth[r.doc_id] == 0 and r.predicted]
    assert len(caught) >= 0.85 * len(positive) and len(wrong) <= 0.005 * len(out), (len(caught), len(positive), len(wrong), len(out))
    assert all(r.evidence and r.terms for r in caught)


def test_nearest_equals_brute_force():
    rng = random.Random(1)
    words = [f"w{i}".encode() for i in range(30)]
    examples = [(i, rng.randrange(2), {rng.choice(words) for _ in range(rng.randrange(8))}) for i in range(500)]
    df = np.array([sum(w in c for _, _, c in examples) for w in words], dtype=float)
    index = tx.Index(examples, words, df, len(examples))
    dense = np.zeros((len(index.vectors), len(words)))
    for k, (t, w) in enumerate(index.vectors):
        dense[k, t] = w
    for _ in range(200):
        t, w = index.vector({rng.choice(words) for _ in range(rng.randrange(1, 6))})
        places, cosines = index.nearest(t, w, 7)
        full = dense[:, t] @ w
        want = np.sort(full[full > 0])[::-1][:7]
        assert np.allclose(cosines, want) and np.allclose(full[places], want)


def test_isotonic_rises_and_pools():
    x, y = tx.isotonic(np.array([0.1, 0.2, 0.3, 0.3, 0.9]), np.array([0.0, 1.0, 0.0, 0.0, 1.0]), np.ones(5))
    assert (np.diff(y) >= 0).all() and y[-1] == 1 and abs(np.interp(0.25, x, y) - 1 / 3) < 1e-9


def test_edge_rows(spark):
    rng = random.Random(2)
    filler = lambda: " ".join(f"v{rng.randrange(300)}" for _ in range(40))
    rows = [(i, filler() + (" scum!" if i % 3 == 0 else "")) for i in range(400)]
    labels = [(i, int(i % 3 == 0), "x") for i in range(0, 400, 1)] + [(5, None, "x"), (None, 1, "x"), (0, 1, "x")]
    rows += [(900, None), (901, ""), (902, "Scum"), (902, "Scum"), (None, "scum of"), (903, "v1 " * 50000)]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    got = tx.toxicity(docs, lab).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows) and [by[k].predicted for k in (900, 901, 902, None, 903)] == [0, 0, 1, 1, 0]
    assert tx.toxicity(docs.limit(0), lab).count() == 0
    assert {r.score for r in tx.toxicity(docs, lab.limit(0)).collect()} == {0.0}


def brute(docs, labels, neighbours=15):
    """The query by plain dictionaries: scores, and the ids and cosines of the evidence."""
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    def terms(text):
        counts = Counter(split(text))
        for w, n in list(counts.items()):
            for k in (5, 6, 7):
                if len(w.encode()) > k:
                    counts[w.encode()[:k] + b"*"] += n
        named = {t if isinstance(t, bytes) else t.encode(): n for t, n in counts.items()}
        return set(named) | {b"%b#%d" % (t, k) for t, n in named.items() for k in (2, 3, 4, 6, 8, 12, 16, 24, 32, 48, 64) if k <= n}

    learn = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 != 1
    label = {}
    for i, y in labels:
        if learn(i) and y in (0, 1):
            label[i] = max(y, label.get(i, 0))
    texts = {i: t for i, t in docs if i in label}
    examples = []
    for i in sorted(texts):
        w = set(split(texts[i]))
        key = sorted(zlib.crc32(x.encode()) for x in w)[:4]
        if not any(y == label[i] and k == key and w and len(w & v) >= 0.8 * len(w | v) for _, y, k, v in examples):
            examples.append((i, label[i], key, w))
    examples = [(i, y, terms(texts[i])) for i, y, _, _ in examples]
    n1 = sum(y for _, y, _ in examples)
    n0 = len(examples) - n1
    every = set().union(*(t for _, _, t in examples))

    def g(t):
        a = sum(y for _, y, x in examples if t in x)
        b = sum(1 - y for _, y, x in examples if t in x)
        n = n0 + n1
        cells = [(a, (a + b) * n1 / n), (b, (a + b) * n0 / n), (n1 - a, (n - a - b) * n1 / n), (n0 - b, (n - a - b) * n0 / n)]
        return sum(2 * o * math.log(o / e) for o, e in cells if o)

    chosen = sorted(t for t in every if g(t) >= 10 + 2 * math.log(len(every)))
    has = [terms(t) for _, t in docs]
    idf = {t: 1 + math.log((len(docs) + 1) / (sum(t in x for x in has) + 1)) for t in chosen}

    def vector(x):
        v = {t: idf[t] for t in chosen if t in x}
        size = math.sqrt(sum(w * w for w in v.values()))
        return {t: w / size for t, w in v.items()}

    vectors = sorted(((sorted(chosen.index(t) for t in v), i, y, v) for i, y, x in examples if (v := vector(x))), key=lambda e: (e[0], e[1]))

    def near(v, but=None):
        found = [(sum(w * e[3].get(t, 0) for t, w in v.items()), k) for k, e in enumerate(vectors) if k != but]
        return sorted(((round(c, 12), k) for c, k in found if c > 0), key=lambda f: (-f[0], f[1]))[:neighbours]

    vote = lambda found: sum(c * vectors[k][2] for c, k in found) / sum(c for c, _ in found)
    total = Counter(label.values())
    weight = {1: total[1] / n1, 0: total[0] / n0}
    alone = [y for _, y, x in examples if not vector(x)]
    points = []
    for k, e in enumerate(vectors):
        found = near(e[3], k)
        if found:
            points.append((vote(found), e[2], weight[e[2]]))
        else:
            alone.append(e[2])
    curve = tx.isotonic(*(np.array(c, dtype=float) for c in zip(*points, strict=True)))
    heavy = sum(weight[y] for y in alone)
    rest = sum(weight[y] * y for y in alone) / heavy if heavy else 0.0
    out = []
    for (i, _), x in zip(docs, has, strict=True):
        found = near(vector(x)) if vector(x) else []
        out.append((i, float(np.interp(vote(found), *curve)) if found else rest, [(vectors[k][1], c) for c, k in found[:3]]))
    return out


def test_query_equals_a_plain_version(spark, tmp_path):
    rng = random.Random(7)
    filler = lambda n: [f"v{rng.randrange(200)}" for _ in range(n)]
    docs, labels = [], []
    for i in range(500):
        words = filler(rng.randrange(1, 60))
        toxic = i % 4 == 0
        for _ in range(rng.randrange(1, 4) if toxic else 0):
            words.insert(rng.randrange(len(words) + 1), rng.choice(["Scum", "wretched", "wretchedly", "louse"]))
        if rng.random() < 0.05:
            words += ["louse"] * (1 if not toxic else 9)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs += [(1000 + k, docs[k][1] + " more") for k in range(0, 60, 3)] + [(1000, "another text"), (2000, None), (2001, "wretched v1"), (None, "scum")]
    docs = list(dict(docs).items())
    labels += [(1000 + k, int(k % 2)) for k in range(0, 60, 3)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    key = lambda r: (r[0] is None, r[0])
    got = sorted(((r.doc_id, r.score, [(e.doc_id, e.cosine) for e in r.evidence]) for r in QUERIES["op2_toxicity"](spark, str(tmp_path)).collect()), key=key)
    want = sorted(brute(docs, labels), key=key)
    assert [r[0] for r in got] == [r[0] for r in want] and len({round(r[1], 6) for r in got}) > 2
    for g, w in zip(got, want, strict=True):
        assert abs(g[1] - w[1]) < 1e-9 and np.allclose([c for _, c in g[2]], [c for _, c in w[2]]), (g, w)


def test_copies_count_once_for_each_label(spark):
    same = " ".join(f"w{k}" for k in range(50))
    docs = spark.createDataFrame([(1, same), (2, same), (3, same + " x"), (5, same), (6, same.replace("w7 ", "z "))], "doc_id long, text string")
    found = tx._examples(docs.selectExpr("doc_id", "cast(text as binary) text"), spark.createDataFrame([(1, 0), (2, 1), (3, 0), (5, 1), (6, 0)], "doc_id long, toxic int").toArrow())
    assert [(r.doc_id, r.toxic) for r in sorted(found.collect())][:2] == [(1, 0), (2, 1)] and found.count() <= 3
