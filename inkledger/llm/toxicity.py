"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over a block-max inverted index.

Examples are a bounded, hashed sample of the labelled documents that may be
learned from: about ``POSITIVE`` and ``NEGATIVE`` of them, near copies of one
label taken once. Terms are words, the starts of words, since rare forms of one
stem are rarely seen themselves, and either of these being there at least so
many times, for as many times as there are. The index holds all terms whose
presence in the examples depends on the label beyond chance (a G-test with room
for the size of the vocabulary), since a cosine over all words of long texts
tells their topics and not their tone: the README has the figures of both. A
term's weight is its inverse frequency among all documents. Postings
are cut into blocks of ``BLOCK`` examples; a block's greatest weight of each
term bounds the cosine of all its examples, and blocks are scored in the order
of their bounds until none can hold one of the ``NEIGHBOURS`` nearest. So the
neighbours are exact.

Neighbours vote by their cosine. The votes of the examples themselves, each
left out of its own, are fitted to their labels by isotonic regression, with
weights that undo the sampling: ``score`` is a frequency of label 1. A text
without any term of the index gets the frequency among such examples.
``evidence`` names the nearest examples, ``terms`` the words that count.

Words and terms of the examples stay in tasks and in tables of the shared
folder; the driver gets the terms of the index, their frequencies, and each
example's terms of the index.

Edge cases: null and empty texts have no terms; a document with several labels
is toxic if any is 1; of several rows with one labelled id, one is an example;
null labels and null ids teach nothing; with no label left the score is 0 for
all; neighbours of one cosine come in a fixed order; repeated rows stay; extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkledger.llm.decontaminate import words_of
from inkledger.llm.shared import discard, give_back, materialize

#: Labelled documents sampled as examples, about.
POSITIVE = 2000
NEGATIVE = 4000
NEIGHBOURS = 15
BLOCK = 64
#: Bytes of the starts of longer words that are terms as well, written with a star.
STARTS = (5, 6, 7)
#: Examples of one label that share this part of their words are copies.
COPIES = 0.8
#: Score from which a document counts as toxic.
TOXIC = 0.7
#: Neighbours that are named.
NAMED = 3

_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
RESULT = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<doc_id:long,cosine:double,toxic:int>>, terms array<string>"


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def levels(n: int) -> Iterator[int]:
    """2, 3, 4, 6, 8, 12, ... up to ``n``: "at least so many times" is a term, written with a number sign."""
    k = 2
    while k <= n:
        yield k
        if k + k // 2 <= n:
            yield k + k // 2
        k *= 2


def terms_of(words: dict[bytes, int]) -> set[bytes]:
    """The terms of a text whose words have these counts."""
    counts = Counter(words)
    for w, n in words.items():
        for k in STARTS:
            if len(w) > k:
                counts[w[:k] + b"*"] += n
    return set(counts) | {b"%b#%d" % (t, k) for t, n in counts.items() for k in levels(n)}


class Index:
    """Examples as TF-IDF vectors of length 1, by term, in blocks."""

    def __init__(self, examples: list[tuple[int, int, set[bytes]]], terms: list[bytes], frequency: np.ndarray, n: int):
        """``examples``: id, label, terms; ``frequency``: documents with each term, of ``n``."""
        self.numbers = {t: k for k, t in enumerate(terms)}
        self.terms = terms
        self.idf = 1 + np.log((n + 1) / (frequency + 1))
        vectors = [self.vector(t) for _, _, t in examples]
        self.rest = [k for k, (t, _) in enumerate(vectors) if not len(t)]  # without terms
        order = sorted((k for k, (t, _) in enumerate(vectors) if len(t)), key=lambda k: (vectors[k][0].tolist(), examples[k][0]))  # like ones meet in a block
        self.ids = np.array([examples[k][0] for k in order], dtype=np.int64)
        self.labels = np.array([examples[k][1] for k in order], dtype=np.int64)
        self.rest_labels = np.array([examples[k][1] for k in self.rest], dtype=np.int64)
        self.vectors = [vectors[k] for k in order]
        self.blocks = -(-len(order) // BLOCK)
        postings: list[list[tuple[int, float]]] = [[] for _ in terms]
        for at, (t, w) in enumerate(self.vectors):
            for a, b in zip(t.tolist(), w.tolist(), strict=True):
                postings[a].append((at, b))
        self.places = [np.array([p for p, _ in x], dtype=np.int64) for x in postings]
        self.weights = [np.array([w for _, w in x]) for x in postings]
        self.cuts = [np.searchsorted(p, np.arange(self.blocks + 1) * BLOCK) for p in self.places]
        self.most = np.zeros((len(terms), self.blocks))
        for k, (p, w) in enumerate(zip(self.places, self.weights, strict=True)):
            np.maximum.at(self.most[k], p // BLOCK, w)

    def vector(self, terms: set[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of a text's terms that the index has, and their weights."""
        at = np.array(sorted(self.numbers[t] for t in terms if t in self.numbers), dtype=np.int64)
        weights = self.idf[at]
        return at, weights / np.sqrt((weights**2).sum()) if len(at) else weights

    def nearest(self, terms: np.ndarray, weights: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` examples of greatest cosine above 0 (ties: the first), and those cosines. ``without``: a place left out."""
        if not len(terms) or not self.blocks:
            return np.empty(0, np.int64), np.empty(0)
        bounds = weights @ self.most[terms]
        best: list[tuple[float, int]] = []
        for block in np.argsort(-bounds, kind="stable").tolist():
            # The margin is for sums that round differently.
            if bounds[block] <= 0 or (len(best) >= k and bounds[block] < -best[k - 1][0] - 1e-12):
                break
            cosines = np.zeros(BLOCK)
            for t, w in zip(terms.tolist(), weights.tolist(), strict=True):
                a, b = self.cuts[t][block], self.cuts[t][block + 1]
                cosines[self.places[t][a:b] - block * BLOCK] += w * self.weights[t][a:b]
            found = [(-float(cosines[j]), block * BLOCK + j) for j in np.flatnonzero(cosines > 0).tolist() if block * BLOCK + j != without]
            best = sorted(best + found)[:k]
        return np.array([j for _, j in best], dtype=np.int64), np.array([-c for c, _ in best])

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        return float((cosines * self.labels[places]).sum() / cosines.sum())


def isotonic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool adjacent violators: points of a rising curve of ``y`` by ``x``; equal ``x`` are one."""
    at, group = np.unique(x, return_inverse=True)
    weight, total = np.bincount(group, w), np.bincount(group, w * y)
    pools: list[list[float]] = []
    for a, n, s in zip(at.tolist(), weight.tolist(), total.tolist(), strict=True):
        pools.append([a, a, n, s])
        while len(pools) > 1 and pools[-2][3] / pools[-2][2] >= pools[-1][3] / pools[-1][2]:
            _, last, n1, s1 = pools.pop()
            pools[-1][1:] = [last, pools[-1][2] + n1, pools[-1][3] + s1]
    return np.array([v for p in pools for v in p[:2]]), np.array([v for p in pools for v in [p[3] / p[2]] * 2])


class Wanted:
    """Finds terms of an index in texts."""

    def __init__(self, terms: list[bytes]):
        self.terms = set(terms)
        # Words that are counted: those of a term, and those with a start that is one's.
        bases = {t.partition(b"#")[0] for t in terms}
        self.words = {t for t in bases if not t.endswith(b"*")}
        self.starts = {t[: STARTS[0]] for t in bases if t.endswith(b"*")}

    def __call__(self, words: list[bytes]) -> set[bytes]:
        wanted, starts, least = self.words, self.starts, STARTS[0]
        counts = Counter([w for w in words if w[:least] in starts or w in wanted])
        return terms_of(counts) & self.terms if counts else set()


class Model:
    def __init__(self, examples: list[tuple[int, int, set[bytes]]], terms: list[bytes], frequency: np.ndarray, n: int, totals: dict[int, int]):
        """``examples``: id, label, terms of the index; ``frequency``: documents with each term, of ``n``;
        ``totals``: labelled documents of each label, from which the examples were sampled."""
        self.index = Index(examples, terms, frequency, n)
        found = Counter(y for _, y, _ in examples)
        weight = {y: totals.get(y, 0) / n for y, n in found.items()}
        index = self.index
        votes, labels, alone = [], [], list(index.rest_labels)
        for place, (t, w) in enumerate(index.vectors):
            near = index.nearest(t, w, without=place)
            if len(near[0]):
                votes.append(index.vote(*near))
                labels.append(index.labels[place])
            else:
                alone.append(index.labels[place])
        y = np.array(labels, dtype=np.float64)
        self.curve = isotonic(np.array(votes), y, np.array([weight[int(v)] for v in labels])) if votes else (np.array([0.0, 1.0]), np.array([0.0, 1.0]))
        heavy = sum(weight[int(v)] for v in alone)
        self.alone = sum(weight[int(v)] for v in alone if v) / heavy if heavy else 0.0

        self.wanted = Wanted(terms)

    def score(self, words: list[bytes]) -> tuple[float, list[dict], list[str]]:
        found = self.wanted(words)
        if not found:
            return self.alone, [], []
        terms, weights = self.index.vector(found)
        places, cosines = self.index.nearest(terms, weights)
        if not len(places):
            return self.alone, [], []
        score = float(np.interp(self.index.vote(places, cosines), *self.curve))
        named = [{"doc_id": int(self.index.ids[p]), "cosine": float(c), "toxic": int(self.index.labels[p])} for p, c in zip(places[:NAMED], cosines[:NAMED], strict=True)]
        return min(1.0, max(0.0, score)), named, [self.index.terms[t].decode("utf-8", "replace") for t in terms]


def _single(parts: pa.Table) -> pa.Table:
    """Of examples of one label that share their four least word hashes, those that are no near copies of an earlier one: copies are no evidence of their own."""
    parts = parts.sort_by("doc_id")
    kept: list[np.ndarray] = []
    stays: list[bool] = []
    for x in parts.column("words"):
        own = np.array(x.as_py(), dtype=np.int64)
        shared = [len(np.intersect1d(own, y, assume_unique=True)) for y in kept]
        stays.append(not any(n >= COPIES * (len(own) + len(y) - n) > 0 for n, y in zip(shared, kept, strict=True)))
        if stays[-1]:
            kept.append(own)
    return parts.select(["doc_id", "toxic", "terms"]).filter(pa.array(stays))


def _examples(texts: DataFrame, sample: pa.Table) -> DataFrame:
    """doc_id, toxic, terms of the sampled documents without near copies, written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("doc_id", pa.int64()), ("toxic", pa.int32()), ("words", pa.list_(pa.int64())), ("terms", pa.list_(pa.binary()))])
        for batch in batches:
            for doc, toxic, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                counts = Counter(words_of(text.as_py()))
                yield pa.record_batch([[doc], [toxic], [sorted(set(map(zlib.crc32, counts)))], [sorted(terms_of(counts))]], schema=schema)
            give_back()

    spark = texts.sparkSession
    wanted = spark.createDataFrame(sample)  # bounded by POSITIVE + NEGATIVE, about
    found = texts.join(F.broadcast(wanted), "doc_id").select("doc_id", "toxic", "text").mapInArrow(run, "doc_id long, toxic int, words array<long>, terms array<binary>")
    found = materialize(found, "toxic-words")
    once = found.groupBy("doc_id").agg(F.min(F.struct("words", "terms", "toxic")).alias("m")).select("doc_id", "m.*")
    single = once.withColumn("key", F.slice("words", 1, 4)).groupBy("toxic", "key").applyInArrow(lambda t: _single(t), "doc_id long, toxic int, terms array<binary>")
    single = materialize(single, "toxic-examples")
    discard(spark, found)
    return single


def _telling(examples: DataFrame) -> list[bytes]:
    """Terms that depend on the label."""
    sizes = {r["toxic"]: r["count"] for r in examples.groupBy("toxic").count().collect()}
    n0, n1 = sizes.get(0, 0), sizes.get(1, 0)
    if not n0 or not n1:
        return []
    spark = examples.sparkSession
    counts = materialize(examples.select("toxic", F.explode("terms").alias("term")).groupBy("term").agg(F.sum("toxic").alias("a"), F.sum(1 - F.col("toxic")).alias("b")), "toxic-terms")
    a, b, n = F.col("a"), F.col("b"), n0 + n1
    table = [(a, (a + b) * n1 / n), (b, (a + b) * n0 / n), (n1 - a, (n - a - b) * n1 / n), (n0 - b, (n - a - b) * n0 / n)]
    g = sum((F.when(o > 0, 2 * o * F.ln(o / e)).otherwise(0.0) for o, e in table), F.lit(0.0))
    terms = counts.where(g >= 10 + 2 * float(np.log(max(1, counts.count())))).select("term").toArrow().column("term").to_pylist()
    discard(spark, counts)
    return sorted(terms)


def _frequency(docs: DataFrame, terms: list[bytes], text_col: str) -> tuple[np.ndarray, int]:
    """How many of all documents have each term, and how many there are."""
    wanted, place = Wanted(terms), {t: k for k, t in enumerate(terms)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(len(place) + 1, dtype=np.int64)
        for batch in batches:
            counts[-1] += batch.num_rows
            for x in batch.column(0):
                for t in wanted(words_of(x.as_py())):
                    counts[place[t]] += 1
        yield pa.record_batch({"place": pa.array(np.arange(len(counts))), "n": pa.array(counts)})

    rows = docs.select(F.col(text_col).cast("binary").alias("text")).mapInArrow(run, "place long, n long").groupBy("place").agg(F.sum("n").alias("n")).orderBy("place").toArrow()
    counts = rows.column("n").to_numpy() if rows.num_rows else np.zeros(len(terms) + 1, dtype=np.int64)
    return counts[:-1], int(counts[-1])


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    known = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(id_col)).groupBy(F.col(id_col).cast("long").alias("doc_id")).agg(F.max(label_col).cast("int").alias("toxic"))
    texts = docs.where(~held_out(id_col) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    pick = F.lit(False)
    for y, most in ((1, POSITIVE), (0, NEGATIVE)):
        share = min(1.0, most / totals[y]) if totals.get(y) else 0.0
        pick = pick | ((F.col("toxic") == y) & (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < int(share * (1 << 30))))
    examples = _examples(texts, known.where(pick).toArrow())
    terms = _telling(examples)
    wanted = set(terms)

    def restrict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [[t for t in x if t in wanted] for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.list_(pa.binary()))], names=["doc_id", "toxic", "terms"])

    rows = examples.mapInArrow(restrict, "doc_id long, toxic int, terms array<binary>").toArrow().sort_by("doc_id").to_pylist()
    discard(docs.sparkSession, examples)
    return Model([(r["doc_id"], r["toxic"], set(r["terms"])) for r in rows], terms, *_frequency(docs, terms, text_col), totals)


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted, evidence, terms of each document."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(train(docs, labels, id_col, text_col, label_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [model.value.score(words_of(x.as_py())) for x in batch.column(2)]
            scores = [r[0] for r in rows]
            yield pa.record_batch(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= TOXIC) for s in scores], pa.int32()), pa.array([r[1] for r in rows], _EVIDENCE), pa.array([r[2] for r in rows], pa.list_(pa.string()))],
                names=["doc_id", "held_out", "score", "predicted", "evidence", "terms"],
            )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, RESULT)
