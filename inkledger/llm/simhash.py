"""SimHash near-duplicates: fingerprints, links by pigeonring filtering, components.

A fingerprint's 64 bits are a ring of three segments. If two fingerprints
differ in at most 2 bits, then from some segment on every chain of ``l``
consecutive segments differs in at most ``l * 2 / 3`` bits: none in the first,
one at most in the first two. So the chain's two segments (43 bits or so) are
an index key, and each fingerprint probes it with that key and with the key
less one set bit of the second segment. Of two fingerprints that differ there
in one bit exactly one has it set, so this finds each pair. Only what meets at
a key gets the full Hamming check.

Equal fingerprints are one node from the start. A key that over ``HOT``
fingerprints share is not paired up: the fingerprints that meet there are
grouped by what is left without two of their bits, for each two bits. Such a
group has four members at most, all within 2 bits of each other, and each
link is in one. That is linear, exact, and needs no cap.

Edge cases: null and blank texts have fingerprint zero and link like any other;
a null document id keeps its row, takes part in links, and is never a
component's id (null only if nothing else is reached); repeated rows stay;
extra columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkledger.llm.components import components
from inkledger.llm.shared import discard, give_back, materialize

SEED = 42
SHINGLE = 3
#: The segments and groups below are cut for this many differing bits.
BITS = 2
#: Fingerprints that may share an index key and still be compared one by one.
HOT = 32
#: Bit ranges of the ring's segments.
SEGMENTS = ((0, 22), (22, 43), (43, 64))
#: Shingles hashed at a time.
SLICE = 1_000_000


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The SimHash of a text in UTF-8, unsigned."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white spaces
    if not words:
        return 0
    joined = b" ".join(words)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    span = min(shingle, len(words)) - 1
    digest = xxhash.xxh64_digest
    counts = np.zeros(64, dtype=np.int64)
    n = len(words) - span
    for k in range(0, n, SLICE):
        at = zip(starts[k : min(k + SLICE, n)].tolist(), ends[k + span : min(k + SLICE, n) + span].tolist(), strict=True)
        counts += _ones(b"".join([digest(joined[a:b], SEED) for a, b in at]))
    return _majority(counts, n)


def _ones(hashes: bytes) -> np.ndarray:
    """In how many of the hashes (8 bytes each, the first the highest) each bit is set."""
    return np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)


def _majority(counts: np.ndarray, n: int) -> int:
    return int.from_bytes(np.packbits(counts * 2 > n).tobytes(), "big")


def fingerprint_of(hashes: np.ndarray) -> int:
    """The SimHash of the shingles that have these hashes (unsigned), unsigned."""
    counts = np.zeros(64, dtype=np.int64)
    for k in range(0, len(hashes), SLICE):
        counts += _ones(hashes[k : k + SLICE].astype(">u8").tobytes())
    return _majority(counts, len(hashes))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fp: the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(x.as_py() or b"", shingle) for x in batch.column(1)]
            yield pa.record_batch({"doc_id": batch.column(0), "fp": pa.array(np.array(found, dtype=np.uint64).view(np.int64))})
            give_back()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _mask(segment: int) -> int:
    a, b = SEGMENTS[segment % 3]
    return (1 << b) - (1 << a)


def _chains(fps: DataFrame) -> DataFrame:
    """Index keys: ring, key, fp. ``ring`` is the chain's first segment."""
    keys = [F.struct(F.lit(i).cast("byte").alias("ring"), F.col("fp").bitwiseAND(F.lit(_signed(_mask(i) | _mask(i + 1)))).alias("key")) for i in range(3)]
    return fps.select("fp", F.inline(F.array(*keys))).select("ring", "key", "fp")


def _probes(fps: DataFrame) -> DataFrame:
    """The chains, and those less one set bit of their second segment."""
    bit = F.col("bit")
    kept = ring = None
    for i in range(3):
        a, b = SEGMENTS[(i + 1) % 3]
        here = (bit >= a) & (bit < b)
        mask = F.lit(_signed(_mask(i) | _mask(i + 1)))
        kept = F.when(here, mask) if kept is None else kept.when(here, mask)
        ring = F.when(here, F.lit(i)) if ring is None else ring.when(here, F.lit(i))
    one = F.expr("shiftleft(1L, bit)")
    less = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
        .where(F.col("fp").bitwiseAND(one) != 0)
        .select(ring.cast("byte").alias("ring"), F.col("fp").bitwiseXOR(one).bitwiseAND(kept).alias("key"), "fp")
    )
    return _chains(fps).unionAll(less)


def _paired(index: DataFrame, probes: DataFrame) -> DataFrame:
    other = index.select("ring", "key", F.col("fp").alias("b"))
    met = probes.withColumnRenamed("fp", "a").join(other.hint("shuffle_hash"), ["ring", "key"])
    near = met.where((F.col("a") != F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= BITS))
    return near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _grouped(fps: DataFrame) -> DataFrame:
    """Star links of all fingerprints that are equal but for two bits; four to a group at most."""
    two = (
        fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i"))
        .select("fp", "i", F.explode(F.expr("sequence(i + 1, 63)")).alias("j"))
        .select("fp", (F.col("i") * 64 + F.col("j")).cast("short").alias("ij"), F.expr("fp & ~shiftleft(1L, i) & ~shiftleft(1L, j)").alias("left"))
    )
    groups = two.groupBy("ij", "left").agg(F.min("fp").alias("a"), F.max("fp").alias("z"), F.collect_set("fp").alias("all"))
    return groups.where("a <> z").select("a", F.explode("all").alias("b")).where("a <> b")


def links(fps: DataFrame, hot: int = HOT) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fps`` (fp) that differ in at most ``BITS`` bits.

    All links but, below hot keys, only enough of them to hold each component together.
    """
    spark = fps.sparkSession
    index, probes = _chains(fps), _probes(fps)
    crowded = materialize(index.groupBy("ring", "key").agg(F.count("*").alias("n")).where(F.col("n") > hot).select("ring", "key"), "hot-chains")
    if crowded.isEmpty():
        discard(spark, crowded)
        return _paired(index, probes)
    paired = _paired(index.join(crowded, ["ring", "key"], "left_anti"), probes)
    dense = probes.join(crowded, ["ring", "key"], "left_semi").select("fp").distinct()
    return paired.unionAll(_grouped(dense))


def linked_groups(marked: DataFrame, find: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id, root of ``marked`` (doc_id, fp); ``find`` gives the links (a, b) of distinct fingerprints (fp)."""
    spark = marked.sparkSession
    classes = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    roots = components(find(classes.select("fp")))
    placed = classes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    # Written first, so that both joins on hot keys can be split.
    named = materialize(named, "components")
    placed = materialize(placed.select("fp", "root").join(named, "root").select("fp", "component_id", "root"), "placed")
    digits = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    out = marked.join(placed, "fp").select("doc_id", digits("fp").alias("fingerprint"), "component_id", digits("root").alias("root"))
    discard(spark, classes, named, roots)
    return out


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (the least id that links reach), root.

    ``root`` names a component also where ids repeat: the least fingerprint in it.
    """
    marked = materialize(fingerprints(docs, shingle, id_col, text_col), "fingerprints")
    return linked_groups(marked, links)


def one_of_each(docs: DataFrame, shingle: int = SHINGLE, id_col: str = "doc_id", text_col: str = "text", near=near_duplicates, mark_of=fingerprint) -> DataFrame:
    """``docs`` with one row of each group of near copies: that with the least id.

    ``near`` gives the groups, and ``mark_of`` the fingerprint that they name a text by.

    A row without an id can't be named as the one that stays, and stays itself. Ids that
    repeat are told apart by their fingerprints, so different texts under one id both count;
    only those rows are fingerprinted once more.
    """
    names = docs.columns
    rows = docs.toDF(*[f"c{k}" for k in range(len(names))])
    own, text = f"c{names.index(id_col)}", f"c{names.index(text_col)}"
    key = F.col(own).cast("long")
    groups = materialize(near(docs, shingle, id_col, text_col), "groups")
    first = F.min(F.struct("doc_id", "fingerprint")).alias("m")
    stays = groups.where("doc_id is not null").groupBy("root").agg(first).select("m.doc_id", "m.fingerprint")
    stays = materialize(stays, "stays")
    repeated = materialize(groups.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated-ids")
    found = rows.join(stays, key == stays.doc_id, "left_semi")
    nameless = rows.where(F.col(own).isNull())
    if repeated.isEmpty():
        return found.unionByName(nameless).toDF(*names)
    single = found.join(repeated, key == repeated.doc_id, "left_anti")
    again = found.join(repeated, key == repeated.doc_id, "left_semi")
    place = int(text[1:])

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = [f"{mark_of(x.as_py() or b'', shingle):016x}" for x in batch.column(place).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks, pa.string())], names=[*batch.schema.names, "mark"])

    again = again.mapInArrow(mark, T.StructType([*again.schema.fields, T.StructField("mark", T.StringType())]))
    again = again.join(stays, (key == stays.doc_id) & (F.col("mark") == stays.fingerprint), "left_semi").dropDuplicates([own, "mark"]).drop("mark")
    return single.unionByName(again).unionByName(nameless).toDF(*names)
