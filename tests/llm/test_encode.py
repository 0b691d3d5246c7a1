import functools
import glob

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from inkledger.llm.encode import BYTE_BPE, WORD_BPE, encoder

ODD = ["", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n\na", "a  b", "a  b", "x\t y", "tail  ", "tail \n", "é ́a", "İ İ", "'s 't don't 'S", "\x1c a\x1c b", "<|endoftext|> a<|startoftext|>", "ΑΣ Σ", "日本語 テキスト", "a\r\nb c", "​   x", "🙂 🙂🙂", "x" * 500 + " " + "y" * 100]


@functools.cache
def untouched(name):
    return Tokenizer.from_file(public_tokenizers.path(name))


def whole(name, text):
    """The library's ids of its plain call."""
    return np.array(untouched(name).encode(text, add_special_tokens=False).ids, dtype=encoder(name).type).tobytes()


@pytest.mark.parametrize("name", [WORD_BPE, BYTE_BPE])
def test_pieces_give_the_ids_of_whole_texts(name):
    e = encoder(name)
    texts = ODD + [x for f in glob.glob("/root/testdata/sf0.001/documents.parquet") for x in pq.read_table(f)["text"].to_pylist() if x]
    assert list(e.batch(texts)) == [whole(name, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(" \n\t ́ \x1c\x85'sA9."), st.characters(exclude_categories=["Cs"])), max_size=30), min_size=1, max_size=4))
def test_any_text(texts):
    for name in (WORD_BPE, BYTE_BPE):
        e = encoder(name)
        assert list(e.batch(texts)) == [whole(name, t) for t in texts]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(" \nab.,éßÀ"), max_size=40), min_size=1, max_size=6))
def test_words_lines_and_runs_of_spaces(texts):
    for name in (WORD_BPE, BYTE_BPE):
        e = encoder(name)
        assert list(e.batch(texts)) == [whole(name, t) for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from(["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|", "|>", " ", "  ", "\n", "a", "Bc", "é", "̸"]), max_size=8), min_size=1, max_size=5))
def test_literals_of_added_tokens(parts):
    texts = ["".join(p) for p in parts]
    for name in (WORD_BPE, BYTE_BPE):
        assert list(encoder(name).batch(texts)) == [whole(name, t) for t in texts]


def test_a_literal_is_one_id():
    got = [np.frombuffer(x, encoder(WORD_BPE).type).tolist() for x in encoder(WORD_BPE).batch(["<|endoftext|> a"])]
    assert got == [[49407, 320]]
    got = [np.frombuffer(x, encoder(BYTE_BPE).type).tolist() for x in encoder(BYTE_BPE).batch(["<|endoftext|> a"])]
    assert got == [[50256, 257]]
