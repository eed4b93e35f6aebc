import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from offerlens.llm import words
from tests.llm.conftest import alnum, shingles, spaced

TEXTS = st.lists(st.one_of(st.none(), st.text(alphabet="aAbB zé\n\t.1İ-", max_size=30)), max_size=8)


def found(texts, kind):
    out = [[] for _ in texts]
    for lo, _, data, at in words.chunks(pa.array(texts, pa.string())):
        row, start, end = words.spans(data, at, kind)
        for r, h in zip(row, words.hashes(data, start, end)[0], strict=True):
            out[r + lo].append(int(h))
    return out


def one(word):
    data = np.frombuffer(word.encode(), np.uint8)
    return int(words.hashes(data, np.array([0]), np.array([len(data)]))[0][0])


@settings(deadline=None, max_examples=60)
@given(TEXTS)
def test_words_match_regular_expressions(texts):
    assert found(texts, words.SPACED) == [[one(w) for w in spaced(t)] for t in texts]
    assert found(texts, words.ALNUM) == [[one(w) for w in alnum(t)] for t in texts]


@settings(deadline=None, max_examples=60)
@given(TEXTS, st.integers(1, 5))
def test_shingles_have_the_size_of_the_set(texts, k):
    for lo, hi, data, at in words.chunks(pa.array(texts, pa.string())):
        row, start, end = words.spans(data, at, words.SPACED)
        row, value = words.distinct(*words.shingles(row, words.hashes(data, start, end)[0], k))
        assert np.bincount(row, minlength=hi - lo).tolist() == [len(shingles(t, k)) for t in texts[lo:hi]]


@pytest.mark.parametrize("piece", [64, 1 << 20])
def test_long_texts_and_long_words(monkeypatch, piece):
    monkeypatch.setattr(words, "PIECE", piece)
    monkeypatch.setattr(words, "CHUNK", 100)
    monkeypatch.setattr(words, "_powers", [])
    texts = ["ab cd " * 60 + "x" * 500, "ab", "cd ab", ""]
    got = found(texts, words.SPACED)
    assert len(got[0]) == 121 and got[0][0] == got[1][0] == got[2][1] and got[0][1] == got[2][0]
    assert len(set(got[0])) == 3
    monkeypatch.setattr(words, "_powers", [])


def test_sliced_and_null_columns():
    column = pa.array(["skip", None, "a b", "c"]).slice(1)
    assert [len(x) for x in found(column.to_pylist(), words.SPACED)] == [0, 2, 1]
    parts = [(lo, hi) for lo, hi, _, _ in words.chunks(column)]
    assert parts == [(0, 3)]
    assert list(words.chunks(pa.array([], pa.string()))) == []
