"""Token-ID output: Arrow files of equal-length sequences and masks.

A shard holds the ids of a run of documents, in order of their ids, laid end
to end and cut into sequences of one length. ``shard-N.tokens.arrow`` is an
Arrow IPC file, not compressed: ``tokens`` is a fixed-size list of unsigned 16-
or 32-bit ids (the narrowest that holds the vocabulary), ``mask`` one of
booleans, false over the padding that ends a shard. Its buffers can be mapped:
sequence ``i`` is a slice of one batch, with no copy. ``shard-N.docs.arrow``
has each document's id, place and length.

Edge cases: a null text is an empty one, whose ids are the end id alone; null
document ids come first; rows repeated with one id stay, ordered by text (rows
equal in both are interchangeable); an empty table writes no shard. Extra
columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkledger.llm.encode import WORD_BPE, encoder
from inkledger.llm.shared import discard, fresh_dir, materialize, open_fs, publish, spread

END_ID = 2
#: Tokens of a sequence.
LENGTH = 2048
#: Sequences of a record batch: what a writer holds in memory.
BATCH = 256

_MANIFEST = "shard int, uri string, n_docs long, n_tokens long"
_READ = "doc_id long, start long, n_tokens long, ids_crc32 long"


def _fixed(values: pa.Array, length: int) -> pa.Array:
    return pa.FixedSizeListArray.from_arrays(values, length)


class _Writer:
    """Cuts a run of ids into sequences and writes them by the batch."""

    def __init__(self, out, kind: np.dtype, length: int):
        self.kind, self.length = kind, length
        value = pa.from_numpy_dtype(kind)
        self.schema = pa.schema([("tokens", pa.list_(value, length)), ("mask", pa.list_(pa.bool_(), length))])
        self.file = pa.ipc.new_file(out, self.schema)
        self.held: list[bytes] = []
        self.size = 0

    def add(self, ids: bytes) -> None:
        self.held.append(ids)
        self.size += len(ids)
        if self.size >= BATCH * self.length * self.kind.itemsize:
            self._write(False)

    def _write(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.held), dtype=self.kind)
        n = -(-len(ids) // self.length) if last else len(ids) // self.length
        step = BATCH * self.length
        for start in range(0, n * self.length, step):
            part = ids[start : min(start + step, n * self.length)]
            room = -(-len(part) // self.length) * self.length
            mask = np.arange(room) < len(part)
            tokens = np.concatenate([part, np.zeros(room - len(part), self.kind)])
            self.file.write_batch(pa.record_batch([_fixed(pa.array(tokens), self.length), _fixed(pa.array(mask), self.length)], schema=self.schema))
        rest = ids[n * self.length :].tobytes()
        self.held, self.size = [rest], len(rest)

    def close(self) -> None:
        if self.size:
            self._write(True)
        self.file.close()


class TokenFile:
    """Random access to a shard's sequences: ``tokens(i)`` and ``mask(i)`` are views, not copies."""

    def __init__(self, uri: str):
        fs, path = open_fs(uri)
        source = pa.memory_map(path) if fs.type_name == "local" else fs.open_input_file(path)
        self.reader = pa.ipc.open_file(source)
        self.length = self.reader.schema.field("tokens").type.list_size
        sizes = [self.reader.get_batch(i).num_rows for i in range(self.reader.num_record_batches)]
        self.firsts = np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
        self.batch = (0, 0, None)

    def __len__(self) -> int:
        return int(self.firsts[-1])

    def _row(self, i: int) -> tuple[pa.RecordBatch, int]:
        first, end, batch = self.batch
        if not first <= i < end:
            b = int(np.searchsorted(self.firsts, i, "right")) - 1
            first, end, batch = self.batch = int(self.firsts[b]), int(self.firsts[b + 1]), self.reader.get_batch(b)
        return batch, i - first

    def tokens(self, i: int) -> np.ndarray:
        batch, row = self._row(i)
        return batch.column(0).values.slice(row * self.length, self.length).to_numpy()

    def mask(self, i: int) -> pa.BooleanArray:
        batch, row = self._row(i)
        return batch.column(1).values.slice(row * self.length, self.length)

    def run(self, start: int, n: int) -> Iterator[np.ndarray]:
        """Ids from ``start`` on, as views of one batch each."""
        end = start + n
        while start < end:
            batch, row = self._row(start // self.length)
            values = batch.column(0).values.to_numpy()
            first = row * self.length + start % self.length
            part = values[first : first + end - start]
            yield part
            start += len(part)


def write_token_files(docs: DataFrame, uri: str, vocabulary: str = WORD_BPE, length: int = LENGTH, id_col: str = "doc_id", text_col: str = "text") -> list[tuple[str, int]]:
    """Writes ``docs`` in ascending id order to shards below ``uri``.

    Returns each shard's URI (without its two endings) with the ids in all shards
    before it: a row for each partition, not for each document.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    # Texts spread what shares an id; ranges of ids stay in order.
    placed = rows.repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next((b for b in batches if b.num_rows), None)
        if first is None:
            return
        shard = TaskContext.get().partitionId()
        base = f"{uri}/shard-{shard:06d}"
        encode = encoder(vocabulary)
        ids: list[pa.Array] = []
        lengths: list[np.ndarray] = []

        def tokens(out) -> None:
            writer = _Writer(out, encode.type, length)
            batch = first
            while batch is not None:
                ids.append(batch.column(0))
                for found, ends in encode.slices(batch.column(1)):
                    writer.add(np.insert(found, ends, found.dtype.type(END_ID)).tobytes())
                    lengths.append(np.diff(ends, prepend=0) + 1)
                batch = next(batches, None)
            writer.close()

        publish(f"{base}.tokens.arrow", tokens)
        sizes = np.concatenate(lengths)
        index = pa.table({"doc_id": pa.chunked_array(ids), "start": np.cumsum(sizes) - sizes, "n_tokens": sizes})

        def places(out) -> None:
            with pa.ipc.new_file(out, index.schema) as f:
                f.write_table(index, max_chunksize=1 << 16)

        publish(f"{base}.docs.arrow", places)
        yield pa.record_batch({"shard": pa.array([shard], pa.int32()), "uri": [base], "n_docs": pa.array([len(sizes)], pa.int64()), "n_tokens": pa.array([int(sizes.sum())], pa.int64())})

    manifest = materialize(placed.mapInArrow(write, _MANIFEST), "token-manifest")
    shards = sorted(tuple(r) for r in manifest.select("shard", "uri", "n_tokens").collect())
    discard(spark, manifest)
    starts = np.concatenate([[0], np.cumsum([n for _, _, n in shards], dtype=np.int64)])
    return [(base, int(start)) for (_, base, _), start in zip(shards, starts, strict=False)]


def read_token_files(spark: SparkSession, shards: list[tuple[str, int]]) -> DataFrame:
    """Documents of the shards: id, start among all ids, length, and the crc32 of the ids."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                tokens = TokenFile(f"{base}.tokens.arrow")
                fs, path = open_fs(f"{base}.docs.arrow")
                with fs.open_input_file(path) as f:
                    places = pa.ipc.open_file(f)
                    for k in range(places.num_record_batches):
                        b = places.get_batch(k)
                        starts, sizes = b.column("start").to_numpy(), b.column("n_tokens").to_numpy()
                        sums = []
                        for start, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                            crc = 0
                            for part in tokens.run(start, n):
                                crc = zlib.crc32(part.astype("<u4"), crc)
                            sums.append(crc)
                        yield pa.record_batch({"doc_id": b.column("doc_id"), "start": pa.array(starts + before), "n_tokens": pa.array(sizes), "ids_crc32": pa.array(sums, pa.int64())})

    if not shards:
        return spark.createDataFrame([], _READ)
    return spread(spark, shards, "uri string, before long").mapInArrow(read, _READ)


def token_output(docs: DataFrame, vocabulary: str = WORD_BPE, length: int = LENGTH) -> DataFrame:
    """Writes ``docs`` to a folder of its own in the shared folder and reads the files back."""
    spark = docs.sparkSession
    return read_token_files(spark, write_token_files(docs, fresh_dir(spark, "tokens"), vocabulary, length))
