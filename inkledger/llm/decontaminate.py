"""Benchmark decontamination by suffix arrays of the training text.

Documents are taken in shards. A shard's words become numbers of the test
vocabulary (0: no word of it, and what parts documents), and the shard gets one
suffix array over them, in the order of whole suffixes up to where they leave
that vocabulary. Each test suffix is then found in it by binary search: the
range of suffixes that start with its window gives all places of the window. A
suffix that leaves the test vocabulary before the shortest window ends can't
match and isn't entered. Overlapping places give hit words; places that follow
each other in document and item give longest verbatim matches, one for each
item that a document has.

The test texts lie in files of bounded size in the shared folder; a worker
holds one of them at a time, and the words of all, so benchmarks may be large.
No document is shuffled.

Edge cases: a null text has no words, in documents and items; an item with no
word matches nothing; an item of fewer words than a window is one window, so a
shorter match is none; repeated items count once by id; an item with a null id
marks hit words but is not listed; documents keep their rows, null and repeated
ids included; empty tables on either side give no rows or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.shared import give_back, materialize, open_fs

#: Words of a window.
WINDOW = 10
#: Bytes of test text in a file.
BLOCK = 16 << 20
#: Bytes of training text in a shard, or one document.
SHARD = 8 << 20

_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_MATCH = [("n_words", pa.int32()), ("doc_word", pa.int32()), ("item_id", pa.string()), ("item_word", pa.int32())]
MATCH = "struct<n_words:int,doc_word:int,item_id:string,item_word:int>"
REPORT = f"doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, longest {MATCH}, matches array<{MATCH}>"


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text in UTF-8: digits, letters a-z (A-Z are lower-cased) and all that is not ASCII."""
    return text.translate(_TABLE).split() if text else []


class TestText:
    """The windows of some items, as numbers of the vocabulary of all."""

    __test__ = False

    def __init__(self, items: list[tuple[str | None, bytes | None]], window: int, vocabulary: dict[bytes, int]):
        self.window = window
        self.places: dict[tuple, list[tuple[int, int]]] = {}  # of a window: (item, word)
        self.names: list[str | None] = []
        for name, text in items:
            ids = [vocabulary[w] for w in words_of(text)]
            if not ids:
                continue
            for at in range(max(1, len(ids) - window + 1)):
                self.places.setdefault(tuple(ids[at : at + window]), []).append((len(self.names), at))
            self.names.append(name)
        self.windows = sorted(self.places)
        self.sizes = np.array([len(w) for w in self.windows], dtype=np.int64)
        self.items = [sorted({self.names[i] for i, _ in self.places[w]} - {None}) for w in self.windows]
        low = np.zeros((len(self.windows), window), dtype=">u4")
        for k, w in enumerate(self.windows):
            low[k, : len(w)] = w
        high = np.where(np.arange(window) < self.sizes[:, None], low, np.uint32(0xFFFFFFFF)).astype(">u4")
        self.low, self.high = _sortable(low), _sortable(high)


def _sortable(rows: np.ndarray) -> np.ndarray:
    """Rows of big-endian numbers as byte strings, which sort as the rows do."""
    rows = np.ascontiguousarray(rows)
    return rows.view(f"S{rows.shape[1] * 4}").ravel() if len(rows) else np.empty(0, f"S{rows.shape[1] * 4 or 4}")


def _keys(padded: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    rows = np.empty((len(at), window), dtype=">u4")
    for k in range(window):
        rows[:, k] = padded[at + k]
    return _sortable(rows)


def suffix_array(ids: np.ndarray, shortest: int, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the suffixes of ``ids`` that might match, in their order, and their first ``window`` words."""
    known = ids > 0
    stays = known.copy()
    for k in range(1, shortest):
        stays[: max(0, len(ids) - k)] &= known[k:]
        stays[max(0, len(ids) - k) :] = False
    at = np.flatnonzero(stays)
    if not len(at):
        return at, _sortable(np.empty((0, window), dtype=">u4"))
    padded = np.concatenate([ids, np.zeros(window, ids.dtype)])
    keys = _keys(padded, at, window)
    order = np.argsort(keys, kind="stable")
    at, keys = at[order], keys[order]
    # Suffixes that start alike are parted by their next words, and so on until they differ or end.
    ends = np.append(np.flatnonzero(~known), len(ids))
    end = ends[np.searchsorted(ends, at)]
    group = np.concatenate([[0], np.cumsum(keys[1:] != keys[:-1])])
    depth = window
    while True:
        alike = np.zeros(len(at), dtype=bool)
        alike[1:] = group[1:] == group[:-1]
        alike[:-1] |= alike[1:]
        tied = np.flatnonzero(alike & (at + depth < end))
        if not len(tied):
            return at, keys
        # The words that are left; those of ended suffixes count as none, and come first.
        tied = np.flatnonzero(np.isin(group, group[tied]))
        here = np.minimum(at[tied] + depth, end[tied])
        left = np.minimum(end[tied] - here, window)
        rows = np.empty((len(tied), window), dtype=">u4")
        for k in range(window):
            rows[:, k] = np.where(k < left, padded[np.minimum(here + k, len(ids))], 0)
        more = _sortable(rows)
        order = np.lexsort((np.unique(more, return_inverse=True)[1], group[tied]))
        at[tied], end[tied] = at[tied][order], end[tied][order]
        parts = more[order][1:] != more[order][:-1]
        new = np.zeros(len(at), dtype=np.int64)
        new[tied[1:][parts & (group[tied][1:] == group[tied][:-1])]] = 1
        first = np.concatenate([[0], (group[1:] != group[:-1]).astype(np.int64)])
        group = np.cumsum(np.maximum(first, new))
        depth += window


class _Found:
    """What one document has of the test texts, over all their files."""

    __slots__ = ("hit", "items", "matches")

    def __init__(self) -> None:
        self.hit: np.ndarray | None = None
        self.items: set[str] = set()
        self.matches: dict[str | None, tuple] = {}  # of an item: the longest


class Shard:
    """Documents, given as words, with their suffix array."""

    def __init__(self, docs: list[list[bytes]], vocabulary: dict[bytes, int], shortest: int, window: int):
        number = vocabulary.get
        self.sizes = np.array([len(w) for w in docs], dtype=np.int64)
        ids = np.zeros(int(self.sizes.sum()) + len(docs), dtype=np.uint32)
        self.starts = np.cumsum(self.sizes + 1) - self.sizes - 1
        for words, start in zip(docs, self.starts.tolist(), strict=True):
            ids[start : start + len(words)] = np.fromiter([number(w, 0) for w in words], np.uint32, len(words))
        self.at, self.keys = suffix_array(ids, shortest, window)


def search(shard: Shard, test: TestText, found: list[_Found]) -> None:
    """Adds to ``found`` what the shard's documents have of ``test``."""
    at, keys, starts, sizes = shard.at, shard.keys, shard.starts, shard.sizes
    if not test.windows or not len(at):
        return
    first, last = np.searchsorted(keys, test.low, "left"), np.searchsorted(keys, test.high, "right")
    counts = last - first
    some = np.flatnonzero(counts > 0)
    if not len(some):
        return
    # A place matches one window of each size at most, so these are no more than places times sizes.
    windows = np.repeat(some, counts[some])
    places = at[np.concatenate([np.arange(first[w], last[w]) for w in some])]
    order = np.lexsort((windows, places))
    windows, places = windows[order], places[order]
    docs = np.searchsorted(starts, places, "right") - 1
    cuts = [0, *(np.flatnonzero(np.diff(docs)) + 1).tolist(), len(docs)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        d = int(docs[a])
        own, here = windows[a:b], places[a:b] - starts[d]
        if found[d].hit is None:
            found[d].hit = np.zeros(int(sizes[d]), dtype=bool)
        edge = np.zeros(int(sizes[d]) + 1, dtype=np.int64)
        np.add.at(edge, here, 1)
        np.add.at(edge, here + test.sizes[own], -1)
        found[d].hit |= np.cumsum(edge)[:-1] > 0
        for w in np.unique(own).tolist():
            found[d].items.update(test.items[w])
        for item, match in _longest(own.tolist(), here.tolist(), test).items():
            if item not in found[d].matches or match[0] > found[d].matches[item][0]:
                found[d].matches[item] = match


def _longest(windows: list[int], places: list[int], test: TestText) -> dict:
    """For each item the longest run of words that the document has as well: (words, document word, item id, item word); the first of equals."""
    best: dict[str | None, tuple] = {}
    before, at = {}, -2
    now: dict[tuple[int, int], int] = {}
    for w, p in zip(windows, places, strict=True):
        if p != at:
            before, now, at = (now if p == at + 1 else {}), {}, p
        size = int(test.sizes[w])
        for item, t in test.places[test.windows[w]]:
            n = before.get((item, t - 1), 0) + 1
            now[item, t] = n
            name = test.names[item]
            if name not in best or size + n - 1 > best[name][0]:
                best[name] = (size + n - 1, p - n + 1, name, t - n + 1)
    return best


#: The vocabulary that this worker holds, by its file.
_held: dict[str, dict[bytes, int]] = {}


def _read(uri: str) -> pa.Table:
    fs, path = open_fs(uri)
    with fs.open_input_file(path) as f:
        return pq.read_table(f)


def _vocabulary(files: list[str]) -> dict[bytes, int]:
    name = " ".join(files)
    if name not in _held:
        _held.clear()
        words = [w for uri in files for w in _read(uri).column(0).to_pylist()]
        _held[name] = {w: k for k, w in enumerate(sorted(words), 1)}
    return _held[name]


class Tests:
    """Where the test texts and their words are, and the words of the shortest window."""

    __test__ = False

    def __init__(self, benchmark: DataFrame, window: int, id_col: str, text_col: str):
        rows = benchmark.select(F.col(id_col).cast("string").alias("item_id"), F.col(text_col).cast("binary").alias("text"))
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        self.window = window
        self.texts = sorted(materialize(rows.repartition(1 + size // BLOCK), "test-texts").inputFiles())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for x in batch.column(0):
                    words = words_of(x.as_py())
                    yield pa.record_batch([pa.array(list(set(words)), pa.binary()), pa.array([len(words)] * len(set(words)), pa.int64())], names=["word", "n"])

        words = materialize(rows.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.min("n").alias("n")), "test-words")
        self.words = sorted(words.select("word").inputFiles())
        self.shortest = min(window, words.agg(F.min("n")).first()[0] or window)


class _Searcher:
    """Holds documents against all files of test texts."""

    def __init__(self, tests: Tests):
        self.tests = tests
        self.vocabulary = _vocabulary(tests.words)
        self.last: tuple[str, TestText] | None = None

    def _test(self, uri: str) -> TestText:
        if self.last is None or self.last[0] != uri:
            self.last = None
            rows = _read(uri)
            self.last = uri, TestText(list(zip(rows.column(0).to_pylist(), rows.column(1).to_pylist(), strict=True)), self.tests.window, self.vocabulary)
        return self.last[1]

    def __call__(self, texts: pa.Array) -> Iterator[tuple[int, _Found]]:
        """Words and finds of each text."""
        docs: list[list[bytes]] = []
        size = 0
        for x in texts:
            text = x.as_py()
            docs.append(words_of(text))
            size += len(text or b"")
            if size >= SHARD:
                yield from self._search(docs)
                docs, size = [], 0
        yield from self._search(docs)

    def _search(self, docs: list[list[bytes]]) -> Iterator[tuple[int, _Found]]:
        found = [_Found() for _ in docs]
        if docs and self.vocabulary:
            shard = Shard(docs, self.vocabulary, self.tests.shortest, self.tests.window)
            for uri in self.tests.texts:
                search(shard, self._test(uri), found)
        yield from zip(map(len, docs), found, strict=True)


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document: its words, those hit, the items found, the longest match, and the longest of each item."""
    tests = Tests(benchmark, window, item_col, item_text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Searcher(tests)
        for batch in batches:
            rows: dict[str, list] = {k: [] for k in ("n_words", "n_hit", "n_items", "items_sha256", "longest", "matches")}
            for n, x in find(batch.column(1)):
                rows["n_words"].append(n)
                rows["n_hit"].append(0 if x.hit is None else int(x.hit.sum()))
                rows["n_items"].append(len(x.items))
                rows["items_sha256"].append(hashlib.sha256(",".join(sorted(x.items)).encode()).hexdigest())
                # The longest first; of equals the first in the document, then the first item.
                matches = sorted(x.matches.values(), key=lambda m: (-m[0], m[1], m[2] is None, m[2] or "", m[3]))
                named = [dict(zip((n for n, _ in _MATCH), m, strict=True)) for m in matches]
                rows["longest"].append(named[0] if named else None)
                rows["matches"].append(named)
            counts = [pa.array(rows[k], pa.int64()) for k in ("n_words", "n_hit", "n_items")]
            told = [pa.array(rows["items_sha256"]), pa.array([n > 0 for n in rows["n_hit"]], pa.bool_()), pa.array(rows["longest"], pa.struct(_MATCH)), pa.array(rows["matches"], pa.list_(pa.struct(_MATCH)))]
            yield pa.record_batch([batch.column(0), *counts, *told], names=["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest", "matches"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text")).mapInArrow(run, REPORT)


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that have any window of a benchmark item."""
    tests = Tests(benchmark, window, item_col, item_text_col)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Searcher(tests)
        for batch in batches:
            clean = [x.hit is None or not x.hit.any() for _, x in find(batch.column(place).cast(pa.binary()))]
            yield batch.filter(pa.array(clean, pa.bool_()))
            give_back()

    return docs.mapInArrow(run, docs.schema)
