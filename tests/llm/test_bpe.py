import base64
import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from offerlens.llm import bpe, queries

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ALPHABET = ["a", "B", "é", "ß", "中", "Ⅷ", "5", "٣", " ", "  ", "\n", "\t", " ", "　", "\x1c", "'", "'s", "'re", "'ll", "’", "!", "-", "🙂",
            "é", "the ", "don't", "<|endoftext|>", "\r\n", "\x00", " ", "K", "'S"]


@pytest.fixture(scope="module")
def brute():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def said(rng, n):
    return "".join(rng.choice(ALPHABET) for _ in range(n))


def test_pieces_are_those_of_the_pattern():
    import regex

    rng = random.Random(3)
    texts = [said(rng, rng.randint(0, 25)) for _ in range(4000)] + ["", "", " ", "'", "''s", " 's", "\n's", "x  's's'd"]
    data, start, row = bpe.pieces(texts)
    got = [[] for _ in texts]
    for i, r in enumerate(row):
        if r >= 0:
            got[r].append(data[start[i]: start[i + 1]].decode())
    pattern = public_tokenizers.PATTERN.replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
    assert got == [regex.findall(pattern, t) for t in texts]
    assert bpe.pieces([])[2].tolist() == []


def test_against_the_library(spark, documents, brute, monkeypatch):
    monkeypatch.setattr(bpe, "BLOCK", 700)  # many blocks
    monkeypatch.setattr(bpe, "AT_ONCE", 90)
    monkeypatch.setattr(bpe, "MOST_CACHED", 40)
    rng = random.Random(8)
    texts = [said(rng, rng.randint(0, 60)) for _ in range(300)] + ["", None, "same text", "same text", "word " * 3000]
    docs = documents([(i if i % 9 else None, t) for i, t in enumerate(texts)])
    clash = docs.withColumn("ids", F.lit("clash")).withColumn("c0", F.col("text")).repartition(5)
    out = bpe.encode(clash, RANKS)
    assert [c for c in out.columns if c != "ids" and c != "n_tokens"] == [c for c in clash.columns if c not in ("text", "ids", "n_tokens")]
    back = bpe.decode(out, RANKS).collect()
    assert len(back) == len(texts)
    want = sorted((i if i % 9 else None, brute.encode_ordinary(t or ""), (t or "").encode()) for i, t in enumerate(texts) if i % 9)
    assert sorted((r.doc_id, r.ids, bytes(r.decoded)) for r in back if r.doc_id is not None) == want
    assert all(r.n_tokens == len(r.ids) and bytes(r.decoded) == (r.c0 or "").encode() for r in back)


def test_long_texts(spark, documents, brute):
    """Runs that the pattern's own engine can't match."""
    texts = [c * 2_000_000 for c in (" ", "\n", "a", "!", "é", "7")] + [" " * 1_000_000 + "x", "ab " * 700_000]
    out = bpe.encode(documents(list(enumerate(texts)), extra=False), RANKS, keep=["doc_id"])
    got = {r.doc_id: (r.n_tokens, bytes(r.decoded)) for r in bpe.decode(out, RANKS).collect()}
    single = brute._core_bpe.encode_single_piece
    for i, c in enumerate((" ", "\n", "a", "!", "é", "7")):
        assert got[i] == (len(single((c * 2_000_000).encode())), texts[i].encode())
    assert got[6] == (len(single(b" " * 999_999)) + len(single(b" x")), texts[6].encode())
    assert got[7] == (len(brute.encode_ordinary(texts[7])), texts[7].encode())


def test_decode_of_unknown_ids(spark):
    rows = [(1, [0, None, -5, 60_000, 1]), (2, None), (3, [])]
    got = bpe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), RANKS).orderBy("k").collect()
    assert [len(r.decoded) if r.decoded is not None else None for r in got] == [2, None, 0]


def test_empty_table(spark, documents):
    assert bpe.decode(bpe.encode(documents([]), RANKS), RANKS).count() == 0


def test_query(spark, brute):
    d = "/root/testdata/sf0.001"
    got = {r.doc_id: tuple(r)[1:] for r in queries.QUERIES["op11_bpe"](spark, d).collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    docs = spark.read.parquet(f"{d}/documents.parquet").collect()
    assert len(docs) == len(got)
    for r in docs:
        ids = brute.encode_ordinary(r.text or "")
        assert got[r.doc_id] == (len(ids), sha(",".join(map(str, ids)).encode()), sha((r.text or "").encode()))


def test_blocks_cut_again(spark, brute, tmp_path, monkeypatch):
    """A table of files is read twice; rows that come in another order are noticed."""
    monkeypatch.setattr(bpe, "BLOCK", 300)
    rng = random.Random(5)
    rows = [(i, said(rng, 40)) for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(str(tmp_path / "t"))
    table = spark.read.parquet(str(tmp_path / "t"))
    got = {r.doc_id: (r.ids, bytes(r.decoded)) for r in bpe.encode(table, RANKS, and_decode=True, reread=True).collect()}
    assert got == {i: (brute.encode_ordinary(t), t.encode()) for i, t in rows}
    with pytest.raises(Exception, match="another order"):
        mixed = table.mapInPandas(lambda frames: (f.sample(frac=1) for f in frames), table.schema)
        bpe.encode(mixed, RANKS, reread=True).collect()
