import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from inkledger.llm import token_files as tf
from inkledger.llm.queries import QUERIES
from inkledger.llm.shared import fresh_dir

SF = "/root/testdata/sf0.001"


def brute(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out, start = [], 0
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], dtype="<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_query_equals_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(map(tuple, QUERIES["op1_token_files"](spark, SF).collect()))
    assert got == brute([tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_nulls_empty_long_and_extra_columns(spark):
    rows = [(3, None, "x"), (1, "", "y"), (2, "a b " * 20000, "z"), (None, "null id", "w"), (5, "tie", "v"), (6, "<|endoftext|> a <|startoftext|>b", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, start string")
    key = lambda r: (r[0] is not None, r[0])
    got = sorted(map(tuple, tf.token_output(docs, length=16).collect()), key=key)
    assert got == brute([r[:2] for r in rows])


def test_repeated_rows_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "same")] * 3 + [(1, "other words")], "doc_id long, text string")
    got = sorted(map(tuple, tf.token_output(docs).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == [1] * 4 and [r[1] for r in got] == list(np.cumsum([0, *[r[2] for r in got[:-1]]]))
    assert tf.token_output(docs.limit(0)).count() == 0


def test_sequences_are_views_of_equal_length(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    shards = tf.write_token_files(docs, fresh_dir(spark, "t"), length=128)
    for base, _ in shards:
        f = tf.TokenFile(f"{base}.tokens.arrow")
        for i in (0, len(f) // 2, len(f) - 1):
            tokens = f.tokens(i)
            assert len(tokens) == len(f.mask(i)) == 128 and not tokens.flags.owndata
            assert (tokens[~np.array(f.mask(i))] == 0).all()
        assert all(np.array(f.mask(i)).all() for i in range(len(f) - 1))
