import base64

import pytest
import tiktoken

from offerlens.llm import token_counts as T

TEXTS = ["", None, "hello world", "hello world", "a" * 500, "é\n\n x <|endoftext|>", "word " * 3000, "12345 67", "x y " * 900]


def brute(texts):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(T.VOCABULARY, "rb"))}
    enc = tiktoken.Encoding("t", pat_str=T.PIECES, mergeable_ranks=ranks, special_tokens={})
    return enc, [len(enc.encode_ordinary(t)) if t else 0 for t in texts]


def test_histogram_and_sums(spark, documents):
    docs = documents(list(enumerate(TEXTS)))
    counted = T.lengths(docs)
    enc, want = brute(TEXTS)
    assert {r.doc_id: r.n_tokens for r in counted.collect()} == dict(enumerate(want))
    assert all(enc.decode(enc.encode_ordinary(t)) == t for t in TEXTS if t)
    sums = T.suffix_sums(T.histogram(counted))
    for r in sums.collect():
        n = r.n_tokens
        assert (r.n_docs, r.docs_ge, r.tokens_ge) == (want.count(n), sum(x >= n for x in want), sum(x for x in want if x >= n))
        assert r.truncated_total == sum(min(x, n) for x in want)
        assert r.share_le == pytest.approx(sum(x <= n for x in want) / len(want))
    limits = [0, 1, 2, 100, 1023, 1024, 5000, 10**9]
    got = T.at_limits(sums, limits).collect()
    assert [tuple(r) for r in got] == [(k, sum(want), sum(min(x, k) for x in want), sum(x > k for x in want)) for k in limits]
    shares = [0.1, 0.5, 0.9, 1.0]
    order = sorted(want)
    assert [r.n_tokens for r in T.quantiles(sums, shares).collect()] == [
        next(x for i, x in enumerate(order) if order[-1] == x or sum(y <= x for y in order) / len(order) >= q) for q in shares]


def test_empty_table(spark, documents):
    sums = T.suffix_sums(T.histogram(T.lengths(documents([]))))
    assert sums.count() == 0
    assert [tuple(r) for r in T.at_limits(sums, [5]).collect()] == [(5, 0, 0, 0)]


def test_very_long_runs(spark, documents):
    """Runs at which the encoder's own expressions give out, and the same lengths from the whole encoder below that."""
    enc, _ = brute([])
    texts = [c * 2_000_000 for c in (" ", "\t", "\n", "a", "\u0301", "!")] + ["x" + " " * 1_500_000 + "'s y"]
    short = [c * 400_000 for c in (" ", "\t", "\n")] + ["x" + " " * 400_000 + "'s y"]
    got = {r.doc_id: r.n_tokens for r in T.lengths(documents(list(enumerate([*texts, *short])), extra=False)).collect()}
    assert [got[7 + i] for i in range(4)] == [len(enc.encode_ordinary(t)) for t in short]
    single = enc._core_bpe.encode_single_piece
    assert [got[i] for i in range(6)] == [len(single(t.encode())) for t in texts[:6]]
    assert got[6] == len(single(b"x")) + len(single(b" " * 1_499_999)) + len(single(b" '")) + len(single(b"s")) + len(single(b" y"))
