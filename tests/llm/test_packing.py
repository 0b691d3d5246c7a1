import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkledger.llm import packing
from inkledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def expected(rows):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = []
    for doc_id, text in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        first = len(ids) - 1024 * (-(-len(ids) // 1024) - 1)
        at = [0, *range(first, len(ids) + 1, 1024)]
        out += [(doc_id, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(at, at[1:], strict=False))]
    return out


def check(got, rows):
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r)[:5] for r in got], key=key) == sorted(expected(rows), key=key)
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    return len(sequences)


def test_query_is_whole_and_tight(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    got = QUERIES["op4_best_fit_packing"](spark, SF).collect()
    n = check(got, rows)
    assert n <= packing.best_fit(np.array([r.length for r in got]))[1] * 1.01 + 1


def test_many_partitions_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 37)
    docs = spark.read.parquet(f"{SF}/documents.parquet").repartition(19)
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    got = packing.pack(docs).collect()
    n = check(got, rows)
    assert n <= packing.best_fit(np.array([r.length for r in got]))[1] * 1.03 + 2


def test_edge_rows(spark):
    rows = [(1, None), (2, ""), (None, "no id"), (3, "w " * 9000), (3, "w " * 9000), (4, "x"), (5, "<|endoftext|> a" * 700)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, length int")
    check(packing.pack(docs).collect(), rows)
    assert packing.pack(docs.limit(0)).count() == 0


@given(st.lists(st.integers(1, 1024), max_size=200))
def test_best_fit_never_overfills(sizes):
    bins, n = packing.best_fit(np.array(sizes, dtype=np.int64))
    fills = np.bincount(bins, weights=sizes, minlength=n) if sizes else np.empty(0)
    assert len(fills) == n and (fills <= 1024).all() and (fills > 0).all()


def test_no_bin_with_room_is_closed(spark):
    rng = np.random.default_rng(2)
    sizes = [*rng.integers(600, 800, 6000).tolist(), *rng.integers(100, 300, 12000).tolist()]
    rows = [(i, " w" * (n - 1)) for i, n in enumerate(sizes)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 3), "doc_id long, text string")
    got = packing.pack(docs).collect()
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(r.length for r in got) == sorted(sizes)
    assert all(b >= a + n for x in sequences.values() for (a, n), (b, _) in zip(sorted(x), sorted(x)[1:], strict=False)) and max(o + n for x in sequences.values() for o, n in x) <= 1024
    assert len(sequences) <= 1.03 * sum(sizes) / 1024


@given(st.lists(st.integers(1, 100), max_size=200))
def test_counts_pack_as_single_pieces_do(sizes):
    rooms = []
    for size in sorted(sizes, reverse=True):
        fits = [(r, i) for i, r in enumerate(rooms) if r >= size]
        if fits:
            rooms[min(fits)[1]] -= size
        else:
            rooms.append(100 - size)
    bins, n = packing.best_fit(np.array(sizes, dtype=np.int64), 100)
    assert sorted(100 - np.bincount(bins, weights=sizes, minlength=n)) == sorted(rooms) if sizes else n == 0
