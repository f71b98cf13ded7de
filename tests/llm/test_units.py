"""Texts are coded by their distinct units: what the library gives for them, and what is not done again."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer
from weftline.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)
#: White space of Unicode beside ASCII's, separators that Python counts as white space and Unicode doesn't, and what is a word of its own.
ODD = ["", " ", "  ", "   ", "\n", " \n", "\n ", "\t ", "\x0b", "\x1c", " \x1f ", "\x85", " \xa0", "  ", "　", "​", "\0", "a", "ab", " the", "'s", " 'll", "it's", "don't,", "12", "1٣", "x1", "!?", " -", "été", "日本", "á", "\U0001f600", "<|endoftext|>", " <|endoftext|> ", "<|endof", "b" * 230, "€" * 90]


def check(coder, texts):
    ids, ends = coder.encode_column(pa.array(texts, type=pa.string()))
    got = [x.tolist() for x in np.split(ids, ends)[: len(texts)]]
    assert got == [LIBRARY.encode(t or "", add_special_tokens=False).ids for t in texts]


@pytest.mark.parametrize("most", [0, 5, 200_000])
def test_units_of_odd_texts(monkeypatch, most):
    """Alone and together, from a table's middle, with units remembered and forgotten."""
    monkeypatch.setattr(bpe, "MOST_UNITS", most)
    coder = bpe.Bpe(PATH)
    for a in ODD:
        check(coder, [a + b + c for b in ODD for c in ("", " end")] + [None])
    assert len(coder.units) <= most
    whole = pa.array(["left out", "a b", None, "c  d", "a b"])
    assert coder.encode_all(whole.slice(1)) == [coder.encode(t) for t in whole.slice(1).to_pylist()]
    assert coder.encode_all(whole.slice(0, 0)) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.none() | st.lists(st.sampled_from(ODD) | st.text(max_size=6), max_size=12).map("".join), max_size=6))
def test_units_of_any_column(texts):
    check(bpe.bpe("byte_bpe_50k.json"), texts)


def test_known_units_are_not_split_again(monkeypatch):
    """Before, each word of each text became a Python object and was looked up twice, also where every word was known."""
    coder, text = bpe.Bpe(PATH), " Seven words, some with marks: don't split\nthem again."
    ids = coder.encode(text)

    def split(self, text):
        raise AssertionError("known units were split")

    monkeypatch.setattr(bpe.Bpe, "words", split)
    assert coder.encode(text) == ids and coder.encode(text * 3) == ids * 3
