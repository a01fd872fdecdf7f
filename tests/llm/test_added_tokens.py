"""Texts that hold an added token have the ids of the plain library call."""

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from veilspark.llm import bpe, packing
from veilspark.llm import textvec as tv

from .fixtures import SCHEMA

PIECES = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|endof", "text|>", " ", "  ", "\n", "\t", "a", "Word", "\u00e9", "\u00a0", ".", "'s"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=8).map("".join), min_size=1, max_size=6))
def test_ids_are_those_of_the_plain_call(name, texts):
    enc, plain = bpe.encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
    for c in tv.chunks(pa.array(texts), 40):
        ids, docs = enc.encode(c)
        for i in range(c.n):
            assert ids[docs[i] : docs[i + 1]].tolist() == plain.encode(texts[c.lo + i], add_special_tokens=False).ids


def test_packing_gives_one_id_for_an_added_token(spark):
    plain = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = ["one  <|endoftext|> two", "three"]
    rows = [(i, t, "en", "s", len(t), "h", 1, 2, "k", 3, 4, "l") for i, t in enumerate(texts)]
    got = {r.doc_id: r.length for r in packing.pack(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: len(plain.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}
