"""Approximate nearest neighbours by balanced posting lists.

A bounded sample is clustered into centroids, about one to ``LIST`` vectors,
and clusters that are too large are split until lists are balanced. Every
vector goes to its nearest centroid's list, and boundary vectors to up to
``COPIES`` lists whose centroid is at most ``BOUNDARY`` times as far. The
centroids are searched by a graph in memory: each has links to its nearest
ones, and a beam of queries walks it together. A query takes all lists whose
centroid is at most a certain times as far as the nearest one; that ratio is
tuned on ``TUNED_ON`` of the queries, for queries may be unlike the rows: the
least at which the lists that they read hold the share ``TARGET`` of their true
neighbours among all rows; where those lists hold too few vectors, the
next ones are read as well. A query that reads more lists than the beam is wide
has all centroids ranked. Lists are scored exactly.

Inner products become distances by one more component, the root of the
greatest squared norm less the vector's own (0 for queries).

Neighbouring lists are put in groups of about ``GROUP`` vectors (of more, where
these would be many), and a list that alone has more, as copies of a vector make it, is cut into pieces of that
size by a hash. A task holds one piece of a group and lets the queries of it
pass by in batches; many queries are parted as well. Each query gets one row of
its best few from each piece.

Vectors that are null, zero, or hold null or non-finite components take no
part, nor do those not of the most frequent dimension (the smaller, if two are
as frequent). A null id takes no part. Rows repeated with one id are one
candidate, with its greatest score, and one query, the greatest such vector in
order of components. Empty tables give no rows; extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from inkledger.llm.shared import materialize

#: Vectors to a centroid, and centroids at most (they are held in memory).
LIST = 256
CENTROIDS = 4096
#: Vectors that centroids are fitted on, and queries that are held against all rows to tune the ratio.
SAMPLE = 32768
TUNED_ON = 512
TARGET = 0.94
COPIES = 4
BOUNDARY = 1.05
#: Vectors to a piece of a group; more, if there would be more groups than ``GROUPS``, as a query goes to most of them; ``LARGEST`` at most.
GROUP = 4096
GROUPS = 24
LARGEST = 65536
#: Queries that may pass one task; scores, and pairs scored exactly, that are in memory at once.
QUERIES = 1_000_000
SCORES = 1 << 20
PAIRS = 1 << 16
#: Lengths of vectors whose products are well within single precision.
PLAIN = (1e-12, 1e12)
#: Links of a centroid in the graph, entry points, and the least beam.
LINKS = 16
ENTRIES = 32
BEAM = 32


def split_centroids(x: np.ndarray, count: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """``count`` centroids or a few more: k-means, then clusters of over twice the mean size are halved."""
    rng = np.random.default_rng(seed)
    x = x[np.sort(np.unique(x, axis=0, return_index=True)[1])]
    count = max(1, min(count, len(x)))
    centers = x[rng.choice(len(x), count, replace=False)]
    for _ in range(rounds):
        near = _nearest(x, centers)
        sums = np.zeros_like(centers)
        np.add.at(sums, near, x)
        n = np.bincount(near, minlength=len(centers))
        centers = sums[n > 0] / n[n > 0, None]
    limit = max(2, 2 * len(x) // count)
    near = _nearest(x, centers)  # once: it costs vectors times centroids
    done, work = [], [x[near == k] for k in range(len(centers))]
    while work:
        part = work.pop()
        if len(part) <= limit:
            if len(part):
                done.append(part.mean(axis=0))
            continue
        a, b = part[rng.choice(len(part), 2, replace=False)]
        for _ in range(3):
            side = ((part - a) ** 2).sum(axis=1) <= ((part - b) ** 2).sum(axis=1)
            if side.all() or not side.any():
                break
            a, b = part[side].mean(axis=0), part[~side].mean(axis=0)
        if side.all() or not side.any():
            order = np.argsort(part[:, 0], kind="stable")
            side = np.isin(np.arange(len(part)), order[: len(part) // 2])
        work += [part[side], part[~side]]
    return np.array(done)


def _nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    half = 0.5 * (centers**2).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ centers.T - half, axis=1) for i in range(0, len(x), 4096)])


class Graph:
    """Centroids with links to their nearest ones, and a beam search over them."""

    def __init__(self, centers: np.ndarray):
        self.centers = centers
        n = len(centers)
        k = min(LINKS, n - 1)
        links = np.zeros((n, 0), dtype=np.int64)
        if k > 0:
            norms = (centers**2).sum(axis=1)
            near = []
            for i in range(0, n, 1024):
                d = norms[None] - 2 * centers[i : i + 1024] @ centers.T
                d[np.arange(len(d)), np.arange(i, i + len(d))] = np.inf
                near.append(np.argsort(d, axis=1, kind="stable")[:, :k])
            # A ring over all centroids keeps the graph in one piece.
            links = np.concatenate([*near], axis=0)
            links = np.concatenate([links, (np.arange(n)[:, None] + 1) % n, (np.arange(n)[:, None] - 1) % n], axis=1)
        self.links = links
        # Entries far from each other, so that each of a few separate clusters has one.
        entries, gap = [0], np.full(n, np.inf)
        while len(entries) < min(ENTRIES, n):
            gap = np.minimum(gap, ((centers - centers[entries[-1]]) ** 2).sum(axis=1))
            if gap.max() <= 0:
                break
            entries.append(int(gap.argmax()))
        self.entries = np.array(entries, dtype=np.int64)

    def search(self, q: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``beam`` nearest centroids found for each row (-1: fewer), nearest first, and their distances."""
        n, beam = len(self.centers), min(beam, len(self.centers))
        own = (q**2).sum(axis=1)[:, None]
        norms = (self.centers**2).sum(axis=1)

        def distance(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(own[rows] + norms[at] - 2 * np.einsum("ijk,ik->ij", self.centers[at], q[rows]), 0))

        rows = np.arange(len(q))
        seen = np.zeros((len(q), n), dtype=bool)
        start = np.tile(self.entries, (len(q), 1))
        seen[:, self.entries] = True
        at = np.full((len(q), beam), -1)
        far = np.full((len(q), beam), np.inf)
        at, far = _best(np.concatenate([at, start], axis=1), np.concatenate([far, distance(rows, start)], axis=1), beam)
        opened = np.zeros((len(q), n + 1), dtype=bool)  # the last column stands for -1
        opened[:, n] = True
        active = rows
        while len(active):
            closed = ~np.take_along_axis(opened[active], at[active], axis=1)
            some = closed.any(axis=1)
            active, closed = active[some], closed[some]
            if not len(active):
                break
            # The four nearest that are not opened yet.
            step = np.argsort(~closed, axis=1, kind="stable")[:, :4]
            nodes = np.where(np.take_along_axis(closed, step, axis=1), np.take_along_axis(at[active], step, axis=1), -1)
            np.put_along_axis(sub := opened[active], nodes, True, axis=1)
            opened[active] = sub
            near = np.where(nodes[:, :, None] >= 0, self.links[nodes], -1).reshape(len(active), -1)
            near = np.sort(near, axis=1)
            fresh = (near >= 0) & ~np.take_along_axis(seen[active], np.maximum(near, 0), axis=1)
            fresh[:, 1:] &= near[:, 1:] != near[:, :-1]
            who, which = np.nonzero(fresh)
            seen[active[who], near[who, which]] = True
            d = np.full(near.shape, np.inf)
            c = near[who, which]
            d[who, which] = np.sqrt(np.maximum(own[active[who], 0] + norms[c] - 2 * np.einsum("ij,ij->i", self.centers[c], q[active[who]]), 0))
            at[active], far[active] = _best(np.concatenate([at[active], np.where(fresh, near, -1)], axis=1), np.concatenate([far[active], d], axis=1), beam)
        return at, far

    def leading(self, q: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``count`` nearest centroids for each row, nearest first, and their distances; for many rows one product costs less than a walk."""
        rest = (self.centers**2).sum(axis=1) - 2 * q @ self.centers.T
        at = np.argpartition(rest, count - 1, axis=1)[:, :count] if count < len(self.centers) else np.tile(np.arange(len(self.centers)), (len(q), 1))
        far = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + np.take_along_axis(rest, at, axis=1), 0))
        return _best(at, far, count)

    def ranked(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All centroids for each row, nearest first, and their distances."""
        norms = (self.centers**2).sum(axis=1)
        far = np.sqrt(np.maximum((q**2).sum(axis=1)[:, None] + norms - 2 * q @ self.centers.T, 0))
        at = np.argsort(far, axis=1, kind="stable")
        return at, np.take_along_axis(far, at, axis=1)


def _best(at: np.ndarray, far: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(far, axis=1, kind="stable")[:, :beam]
    return np.take_along_axis(at, order, axis=1), np.take_along_axis(far, order, axis=1)


@dataclass
class Index:
    graph: Graph
    dimension: int
    norm2: float  # the greatest squared norm
    ratio: float

    def lifted(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.norm2 - (x**2).sum(axis=1), 0))
        return np.concatenate([x, rest[:, None]], axis=1)

    def lists_of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the lists that each vector is written to."""
        at, far = self.graph.leading(self.lifted(x), COPIES)
        return _pairs(at, far <= BOUNDARY * far[:, :1])

    def lists_for(self, q: np.ndarray, sizes: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(row, list) for the lists that each query reads: all within the ratio, and the nearest till they hold ``least`` rows.

        Where these go past the beam, all centroids are ranked: that costs less than a walk with a beam so wide.
        """
        padded = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
        at, far = self.graph.search(padded, BEAM)
        while True:
            held = np.where(at >= 0, sizes[at], 0)
            wanted = (at >= 0) & ((far <= self.ratio * far[:, :1]) | (np.cumsum(held, axis=1) - held < least))
            if at.shape[1] < BEAM or at.shape[1] >= len(self.graph.centers) or not wanted[:, -1].any():
                return _pairs(at, wanted)
            at, far = self.graph.ranked(padded)


def _pairs(at: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    rows, k = np.nonzero(keep)
    return rows, at[rows, k]


def fit(sample: np.ndarray, total: int, norm2: float) -> Index:
    """Centroids from the sample for ``total`` vectors; the ratio is still to be tuned."""
    index = Index(None, sample.shape[1], norm2, 1.0)
    index.graph = Graph(split_centroids(index.lifted(sample), max(1, min(CENTROIDS, total // LIST, len(sample) // 4))))
    return index


def tune(index: Index, q: np.ndarray, of: np.ndarray, held: list[list[int]], sizes: np.ndarray, least: int) -> None:
    """Sets the ratio, from the lists (``held``) of the true neighbours of the queries ``q`` (``of``: whose each is)."""
    if not len(of):
        return
    at, far = index.graph.ranked(np.concatenate([q, np.zeros((len(q), 1))], axis=1))
    ratio = np.empty_like(far)
    np.put_along_axis(ratio, at, far / np.maximum(far[:, :1], 1e-12), axis=1)
    # Least ratio at which a list with the neighbour is read.
    needed = np.array([ratio[i, own].min() for i, own in zip(of.tolist(), held, strict=True)])
    for share in (TARGET, *(x for x in (0.95, 0.97, 0.99, 1.0) if x > TARGET)):
        index.ratio = float(np.quantile(needed, share)) * (1 + 1e-9)
        reads = np.zeros((len(q), len(sizes)), dtype=bool)
        reads[index.lists_for(q, sizes, least)] = True
        # Lists are found by the graph: what it misses is made good by a greater ratio.
        if np.mean([reads[i, own].any() for i, own in zip(of.tolist(), held, strict=True)]) >= TARGET:
            break


def _valid(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """vec_id, v (array of doubles, or of floats if they were): the vectors that take part, but for their dimension."""
    held = vectors.select(F.col(vector_col).alias("v")).schema["v"].dataType
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(FLOATS if held.simpleString() == FLOATS else "array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(-1, dimension)


def build(rows: DataFrame) -> Index | None:
    """The index of vectors (vec_id, v), its ratio not tuned."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"), F.max(norm).alias("norm2")).orderBy(F.desc("n"), "d").limit(1).collect()
    if not sizes:
        return None
    d, n, norm2 = sizes[0]
    share = int(min(1.0, SAMPLE / n) * (1 << 30))
    picked = rows.where((F.size("v") == d) & (F.pmod(F.xxhash64("vec_id"), F.lit(1 << 30)) <= share)).orderBy("vec_id").toArrow()
    sample = picked.column("v").combine_chunks()
    sample = sample.combine_chunks() if isinstance(sample, pa.ChunkedArray) else sample
    if not picked.num_rows:
        return None
    return fit(_matrix(sample, d), n, norm2)


_TOP = "query_id long, vec_ids array<long>, scores array<double>"
_ROUTED = "group int, piece int, part int, kind int, id long, lists array<int>, v "
FLOATS = "array<float>"


def _by_row(row: np.ndarray, lists: np.ndarray, n: int) -> pa.ListArray:
    """The lists of each of ``n`` rows; ``row`` rises."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32()), pa.array(lists.astype(np.int32)))


def _routed(rows: list[tuple], kind: int, vectors: pa.Array) -> pa.RecordBatch:
    group, piece, part, ids, lists, at = zip(*rows, strict=True) if rows else [()] * 6
    numbers = [pa.array(x, pa.int32()) for x in (group, piece, part, [kind] * len(rows))]
    return pa.record_batch([*numbers, pa.array(ids, pa.int64()), pa.array(lists, pa.list_(pa.int32())), vectors.take(pa.array(at, pa.int64()))], names=["group", "piece", "part", "kind", "id", "lists", "v"])


def _plan(centers: np.ndarray, sizes: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
    """The group of each list (-1: empty), and the pieces of each group. Lists in a group lie next to each other along the centroids' longest axis."""
    axis = (centers - centers.mean(axis=0)) @ np.linalg.svd(centers - centers.mean(axis=0), full_matrices=False)[2][0]
    group_of = np.full(len(centers), -1, dtype=np.int64)
    pieces: list[int] = []
    size = max(GROUP, min(LARGEST, sum(sizes.values()) // GROUPS))
    held = size + 1
    for x in np.argsort(axis, kind="stable").tolist():
        n = sizes.get(x, 0)
        if not n:
            continue
        if held + n > size:
            pieces.append(max(1, -(-n // size)))
            held = 0
        group_of[x] = len(pieces) - 1
        held += n
    return group_of, np.array(pieces, dtype=np.int64)


class _Block:
    """The vectors of one piece of a group, by the first of their lists, and which others they are in."""

    def __init__(self, held: list[tuple], k: int):
        own = [x for h in held for x in h[2]]
        order = np.argsort([x[0] for x in own], kind="stable")
        own = [own[i] for i in order.tolist()]
        self.ids = np.concatenate([h[0] for h in held])[order]
        first = np.array([x[0] for x in own])
        self.lists = np.array(sorted({y for x in own for y in x}))
        self.start, self.end = np.searchsorted(first, self.lists), np.searchsorted(first, self.lists, "right")
        further: dict[int, list[int]] = {}
        for i, x in enumerate(own):
            for y in x[1:]:
                further.setdefault(y, []).append(i)
        self.further = [np.array(further.get(y, []), dtype=np.int64) for y in self.lists.tolist()]
        self.by_id = np.argsort(self.ids, kind="stable")
        self.sorted = self.ids[self.by_id]
        # So many rows hold k ids, if some ids repeat.
        self.rows = k * int(np.unique(self.sorted, return_counts=True)[1].max())
        # Rows that are in no list fill the last of the classes up.
        self.classes = max(128, 4 * self.rows)
        self.width = len(self.ids) + -len(self.ids) % self.classes
        self.x = np.concatenate([h[1] for h in held])[order]
        self.norm = np.sqrt((self.x**2).sum(axis=1).max())
        self.single = self.x.astype(np.float32) if PLAIN[0] < self.norm < PLAIN[1] else None

    def best(self, queries: pa.RecordBatch, d: int, k: int) -> pa.RecordBatch:
        """Each query's best few among the vectors of the lists that it reads."""
        q, names, reads = _matrix(queries.column("v"), d), queries.column("id").to_numpy(), queries.column("lists")
        norms = np.sqrt((q**2).sum(axis=1))
        # Rough scores in single precision, unless they might leave its range.
        single = self.single is not None and PLAIN[0] < norms.min() and norms.max() < PLAIN[1]
        x, y = (self.single, q.astype(np.float32)) if single else (self.x, q)
        rough = np.full((len(q), self.width), -np.inf, dtype=x.dtype)
        which = reads.flatten().to_numpy()
        who = np.repeat(np.arange(len(q)), reads.value_lengths().to_numpy())
        order = np.argsort(which, kind="stable")
        which, who = which[order], who[order]
        for j, (a, b) in enumerate(zip(np.searchsorted(which, self.lists).tolist(), np.searchsorted(which, self.lists, "right").tolist(), strict=True)):
            if a < b:
                some = who[a:b]
                rough[some, self.start[j] : self.end[j]] = y[some] @ x[self.start[j] : self.end[j]].T
                if len(more := self.further[j]):
                    rough[some[:, None], more] = y[some] @ x[more].T
        start, end = np.searchsorted(self.sorted, names), np.searchsorted(self.sorted, names, "right")
        for j in np.flatnonzero(end > start).tolist():
            rough[j, self.by_id[start[j] : end[j]]] = -np.inf
        # Each class of columns has its greatest; the k-th of these is no more than the k-th of all.
        tops = rough.reshape(len(q), -1, self.classes).max(axis=1)
        bar = np.partition(tops, self.classes - self.rows, axis=1)[:, self.classes - self.rows].astype(np.float64)
        slack = 4 * (d + 8) * np.finfo(x.dtype).eps * norms * self.norm
        bar = np.maximum(bar - slack, np.finfo(x.dtype).min).astype(x.dtype)
        row, at = np.divmod(np.flatnonzero(rough >= bar[:, None]), self.width)
        scores = np.concatenate([np.empty(0), *(_exact(self.x[at[i : i + PAIRS]], q[row[i : i + PAIRS]]) for i in range(0, len(row), PAIRS))])
        row, ids, scores = _leading_of(row, self.ids[at], scores, k)
        sizes = np.bincount(row, minlength=len(names))
        ends = pa.array(np.concatenate([[0], np.cumsum(sizes[sizes > 0])]), pa.int32())
        return pa.record_batch([pa.array(names[sizes > 0]), pa.ListArray.from_arrays(ends, pa.array(ids)), pa.ListArray.from_arrays(ends, pa.array(scores))], names=["query_id", "vec_ids", "scores"])


def _leading_of(row: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``_leading``, for each ``row`` by itself."""
    order = np.lexsort((-scores, ids, row))
    row, ids, scores = row[order], ids[order], scores[order]
    once = np.ones(len(row), dtype=bool)
    once[1:] = (row[1:] != row[:-1]) | (ids[1:] != ids[:-1])
    row, ids, scores = row[once], ids[once], scores[once]
    order = np.lexsort((ids, -scores, row))
    row, ids, scores = row[order], ids[order], scores[order]
    kept = np.arange(len(row)) - np.searchsorted(row, row) < k
    return row[kept], ids[kept], scores[kept]


def _exact(vectors: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products with ``q`` (a vector, or one to a row), summed in one order for every row, so that equal vectors tie."""
    return (vectors * q).sum(axis=1)


def _truth(posted: DataFrame, asked: DataFrame, d: int, k: int) -> tuple[np.ndarray, np.ndarray, list[list[int]]]:
    """Some of the queries (``TUNED_ON`` at most, by a hash), and the lists of their true neighbours among all rows, with whose each is."""
    some = asked.orderBy(F.xxhash64("vec_id"), "vec_id").limit(TUNED_ON).collect()
    q = np.array([r["v"] for r in some], dtype=np.float64).reshape(-1, d)
    given = posted.sparkSession.sparkContext.broadcast((np.array([r["vec_id"] for r in some], dtype=np.int64), q))

    def leading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, q = given.value
        found = None
        for batch in batches:
            for i in range(0, batch.num_rows, 2048):
                part = batch.slice(i, 2048)
                ids = part.column(0).to_numpy()
                scores = q @ _matrix(part.column(2), d).T
                scores[names[:, None] == ids] = -np.inf
                top = np.argpartition(-scores, k - 1, axis=1)[:, :k] if scores.shape[1] > k else np.tile(np.arange(scores.shape[1]), (len(q), 1))
                row, at = np.divmod(np.arange(top.size), top.shape[1])[0], top.ravel()
                more = pa.table({"query": pa.array(row, pa.int32()), "vec_id": pa.array(ids[at]), "score": pa.array(np.take_along_axis(scores, top, axis=1).ravel()), "lists": part.column(1).take(pa.array(at))})
                more = more.filter(pc.is_finite(more.column("score")))
                found = more if found is None else pa.concat_tables([found, more])
                order = np.lexsort((found.column("vec_id").to_numpy(), -found.column("score").to_numpy(), of := found.column("query").to_numpy()))
                of = of[order]
                found = found.take(pa.array(order[np.arange(len(of)) - np.searchsorted(of, of) < k]))
        if found is not None:
            yield from found.combine_chunks().to_batches()

    each = posted.select("vec_id", "lists", "v").mapInArrow(leading, "query int, vec_id long, score double, lists array<int>")
    ranked = each.withColumn("n", F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), "vec_id")))
    true = ranked.where(F.col("n") <= k).select("query", "lists").collect() if some else []
    return q, np.array([r["query"] for r in true], dtype=np.int64), [r["lists"] for r in true]


def nearest(vectors: DataFrame, queries: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` greatest inner products found for each vector that ``queries`` marks (a condition on ``vec_id``)."""
    spark = vectors.sparkSession
    rows = _valid(vectors, id_col, vector_col)
    index = build(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    d = index.dimension
    rows = rows.where(F.size("v") == d)
    kind = rows.schema["v"].dataType.simpleString()
    shared = spark.sparkContext.broadcast(index)  # bounded by CENTROIDS

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                row, lists = shared.value.lists_of(_matrix(part.column(1), d))
                yield pa.record_batch([part.column(0), _by_row(row, lists, part.num_rows), part.column(1)], names=["vec_id", "lists", "v"])

    posted = materialize(rows.mapInArrow(place, f"vec_id long, lists array<int>, v {kind}"), "posted")
    asked = rows.where(queries).groupBy("vec_id").agg(F.max("v").alias("v"))
    sizes = {r["list"]: r["n"] for r in posted.select(F.explode("lists").alias("list")).groupBy("list").agg(F.count("*").alias("n")).collect()}  # a row to a centroid
    counts = np.array([sizes.get(x, 0) for x in range(len(index.graph.centers))])
    tune(index, *_truth(posted, asked, d, k), counts, COPIES * (k + 1))
    tuned = spark.sparkContext.broadcast(index)
    plan = spark.sparkContext.broadcast((*_plan(index.graph.centers, sizes), counts))
    parts = 1 + asked.count() // QUERIES

    def posting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, pieces, _ = plan.value
        for batch in batches:
            ids, lists = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows: list[tuple] = []
            for k, (vec_id, own) in enumerate(zip(ids, lists, strict=True)):
                for g in {int(group_of[x]) for x in own}:
                    piece = (zlib.crc32(b"%d" % vec_id) + k) % int(pieces[g])
                    rows += [(g, piece, part, vec_id, [x for x in own if group_of[x] == g], k) for part in range(parts)]
            yield _routed(rows, 0, batch.column(2))

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group_of, pieces, counts = plan.value
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                row, lists = tuned.value.lists_for(_matrix(part.column(1), d), counts, COPIES * (k + 1))
                ids = part.column(0).to_pylist()
                rows: list[tuple] = []
                for j, own in enumerate(_by_row(row, lists, part.num_rows).to_pylist()):
                    by: dict[int, list[int]] = {}
                    for x in own:
                        if group_of[x] >= 0:
                            by.setdefault(int(group_of[x]), []).append(x)
                    rows += [(g, piece, zlib.crc32(b"%d" % ids[j]) % parts, ids[j], x, j) for g, x in by.items() for piece in range(int(pieces[g]))]
                yield _routed(rows, 1, part.column(1))

    routed = posted.mapInArrow(posting, _ROUTED + kind).unionByName(asked.mapInArrow(probing, _ROUTED + kind))
    keys = ["group", "piece", "part"]
    placed = routed.repartition(*keys).sortWithinPartitions(*keys, "kind")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, block = None, [], None
        for batch in batches:
            marks = np.stack([batch.column(c).to_numpy() for c in ("group", "piece", "part", "kind")], axis=1)
            cuts = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1).tolist(), len(marks)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a == b:
                    continue
                *here, kind = marks[a].tolist()
                if here != key:
                    key, held, block = here, [], None
                part = batch.slice(a, b - a)
                if kind == 0:
                    held.append((part.column("id").to_numpy(), _matrix(part.column("v"), d), part.column("lists").to_pylist()))
                elif held:
                    if block is None:
                        block = _Block(held, k)
                    step = max(1, min(256, SCORES // block.width))
                    for i in range(0, b - a, step):
                        yield block.best(part.slice(i, step), d, k)

    found = placed.mapInArrow(score, _TOP)

    def merge(key: tuple, parts: pa.Table) -> pa.Table:
        ids = parts.column("vec_ids").combine_chunks().flatten().to_numpy()
        scores = parts.column("scores").combine_chunks().flatten().to_numpy()
        top, best = _leading(ids, scores, k)
        n = len(top)
        return pa.table({"query_id": pa.array([key[0].as_py()] * n, pa.int64()), "rank": pa.array(np.arange(1, n + 1, dtype=np.int32)), "vec_id": pa.array(top), "score": pa.array(best)})

    return found.groupBy("query_id").applyInArrow(merge, "query_id long, rank int, vec_id long, score double")


def _leading(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` greatest scores, ties to the smaller id; an id once, with its greatest score."""
    order = np.lexsort((ids, -scores))
    ids, scores = ids[order], scores[order]
    once = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[once], scores[once]
