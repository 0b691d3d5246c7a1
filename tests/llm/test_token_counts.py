import public_tokenizers
from tokenizers import Tokenizer

from inkledger.llm import token_counts as tc
from inkledger.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


def brute(texts):
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    n = [len(t.encode(x or "", add_special_tokens=False).ids) for x in texts]
    return n, sorted((k, n.count(k), sum(x > k for x in n), sum(x for x in n if x > k), len(n), sum(n), sum(min(x, k) for x in n), sum(x <= k for x in n) / len(n)) for k in set(n))


def test_query_equals_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert sorted(map(tuple, QUERIES["op10_token_counts"](spark, SF).collect())) == brute(texts)[1]


def test_edge_rows_limits_and_quantiles(spark):
    texts = [None, "", "a", "a", "one two three", "w " * 30000, "é ü", "x <|endoftext|>"]
    docs = spark.createDataFrame([(x, 1) for x in texts], "text string, n_tokens int")
    table = tc.histogram(docs)
    n, want = brute(texts)
    assert sorted(map(tuple, table.collect())) == want
    limits = [0, 1, 2, 1000, 10**6]
    assert sorted(map(tuple, tc.at_limits(table, limits).collect())) == [(k, sum(x > k for x in n), sum(min(x, k) for x in n), sum(n)) for k in limits]
    assert tc.quantile(table, 0.5) == sorted(n)[3]
    assert tc.histogram(docs.limit(0)).count() == 0
