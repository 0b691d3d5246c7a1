"""Best-fit packing of tokenized documents, over the whole table by counts of lengths.

Pieces of one length can stand for each other, so best-fit, largest first,
needs only how many pieces of each length there are: ``plan`` packs these
counts, all bins of equal room at a time, and says which bin and offset the
n-th piece of a length gets. The pieces are written with their number among
those of their length in their partition, counted, and placed in a second pass.
No bin is closed while it has room, and nothing grows with the table but
the counts: a number for each partition and length. No piece is ever dropped.

A document's ids end with id 2; one of more than ``CAPACITY`` ids is cut into
pieces of that length, but for the first, which holds the rest.

Edge cases: a null text is an empty one (a piece of one id); null and repeated
document ids are packed like others, row by row; an empty table gives no rows;
extra columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkledger.llm.encode import BYTE_BPE, ROOMY, encoder, release
from inkledger.llm.shared import materialize

END_ID = 2
CAPACITY = 1024
#: Pieces numbered at a time in a partition.
BLOCK = 20_000

_PIECE = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_NUMBERED = "doc_id long, piece int, start long, length long, ids_crc32 long, node int, rank long"
_PLACED = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"


class Plan:
    """Runs of pieces of one length that are placed alike: ``per`` to a bin, from bin ``first`` and ``offset`` on."""

    def __init__(self, runs: list[tuple[int, int, int, int, int]], n: int):
        runs = sorted(runs)
        self.size, self.rank, self.per, self.first, self.offset = (np.array(x, dtype=np.int64) for x in (zip(*runs, strict=True) if runs else [()] * 5))
        self.n = n
        # Ranks are below 2^44 or so; a length is below 2^11.
        self.key = (self.size << 48) + self.rank

    def places(self, sizes: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of the ``ranks``-th pieces of ``sizes``."""
        at = np.searchsorted(self.key, (sizes << 48) + ranks, "right") - 1
        row, k = np.divmod(ranks - self.rank[at], self.per[at])
        return self.first[at] + row, self.offset[at] + k * sizes


def plan(counts: np.ndarray, capacity: int = CAPACITY) -> Plan:
    """Best-fit, largest first, of ``counts[s]`` pieces of each length s.

    Bins are runs (first, count) kept by the room they have; a bit mask finds the least
    room that is enough. That of the bins with it the same is filled as far as it goes
    before the next is what one piece after the other would do.
    """
    with_room: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
    runs: list[tuple[int, int, int, int, int]] = []
    rooms = n = 0
    for size in range(len(counts) - 1, 0, -1):
        left, rank = int(counts[size]), 0
        while left:
            fitting = rooms >> size
            if fitting:
                room = size + (fitting & -fitting).bit_length() - 1
                first, count = with_room[room].pop()
                if not with_room[room]:
                    rooms &= ~(1 << room)
            else:
                room, first, count = capacity, n, -(-left // (capacity // size))
                n += count
            per = room // size
            whole = min(count, left // per)
            part = left - whole * per if whole < count else 0
            for bins, each in ((whole, per), (1 if part else 0, part), (count - whole - (1 if part else 0), 0)):
                if not bins:
                    continue
                if each:
                    runs.append((size, rank, each, first, capacity - room))
                    rank += bins * each
                    left -= bins * each
                with_room[room - each * size].append((first, bins))
                rooms |= 1 << (room - each * size)
                first += bins
    return Plan(runs, n)


def _ranks(sizes: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Each piece's number among those of its length; ``seen`` holds the pieces counted before, and is counted on."""
    order = np.argsort(sizes, kind="stable")
    counts = np.bincount(sizes, minlength=len(seen))
    ranks = np.empty(len(sizes), dtype=np.int64)
    ranks[order] = np.arange(len(sizes)) - np.repeat(np.cumsum(counts) - counts - seen, counts)
    seen += counts
    return ranks


def best_fit(sizes: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, int]:
    """Best-fit, largest first: each item's bin, and the number of bins."""
    sizes = np.asarray(sizes, dtype=np.int64)
    counts = np.zeros(capacity + 1, dtype=np.int64)
    ranks = _ranks(sizes, counts)
    made = plan(counts, capacity)
    return made.places(sizes, ranks)[0], made.n


def _pieces(batches: Iterator[pa.RecordBatch], vocabulary: str, room: dict) -> Iterator[pa.RecordBatch]:
    """Pieces of the documents, ``BLOCK`` or a few more at a time."""
    encode = encoder(vocabulary, **room)
    rows: list[tuple] = []

    def block() -> pa.RecordBatch:
        columns = [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _PIECE, strict=True)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_PIECE)

    for batch in batches:
        docs, d = batch.column(0).to_pylist(), 0
        for found, ends in encode.slices(batch.column(1)):
            ids = np.insert(found, ends, found.dtype.type(END_ID)).astype("<u4")
            start = 0
            for end in (ends + np.arange(1, len(ends) + 1)).tolist():
                cuts = [0, *range((end - start - 1) % CAPACITY + 1, end - start + 1, CAPACITY)]
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    rows.append((docs[d], k, a, b - a, zlib.crc32(ids[start + a : start + b])))
                start = end
                d += 1
                if len(rows) >= BLOCK:
                    yield block()
    if rows:
        yield block()
    del encode
    release(room)


def pack(docs: DataFrame, vocabulary: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text", room: dict = ROOMY) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    ``room``: what the encoder may take of a worker's memory; the result does not depend on it.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, seen = TaskContext.get().partitionId(), np.zeros(CAPACITY + 1, dtype=np.int64)
        for block in _pieces(batches, vocabulary, room):
            ranks = _ranks(block.column("length").to_numpy(), seen)
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(np.full(len(ranks), node, np.int32)), pa.array(ranks)], names=[*_PIECE.names, "node", "rank"])

    numbered = materialize(rows.mapInArrow(number, _NUMBERED), "pieces")
    counted = numbered.groupBy("node", "length").agg(F.count("*").alias("n")).toArrow()  # at most CAPACITY rows a partition
    node, length, n = (counted.column(c).to_numpy().astype(np.int64) for c in ("node", "length", "n"))
    totals = np.zeros(CAPACITY + 1, dtype=np.int64)
    np.add.at(totals, length, n)
    # How many pieces of a length the partitions before have.
    order = np.lexsort((node, length))
    before = np.empty(len(n), dtype=np.int64)
    before[order] = np.cumsum(n[order]) - n[order] - (np.cumsum(totals) - totals)[length[order]]
    keys = node << 11 | length
    order = np.argsort(keys)
    shared = docs.sparkSession.sparkContext.broadcast((plan(totals), keys[order], before[order]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, keys, before = shared.value
        for batch in batches:
            sizes, node = batch.column("length").to_numpy(), batch.column("node").to_numpy().astype(np.int64)
            ranks = batch.column("rank").to_numpy() + before[np.searchsorted(keys, node << 11 | sizes)]
            bins, offsets = made.places(sizes, ranks)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(bins), pa.array(offsets)], names=[*_PIECE.names, "sequence_id", "offset"])

    return numbered.mapInArrow(place, _PLACED)
