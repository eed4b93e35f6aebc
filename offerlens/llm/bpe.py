"""Byte-level BPE encoding and decoding by a global shuffle of distinct words.

Texts are cut into the pieces (words) that a vocabulary is made for. Texts that are read together form a block, at most
BLOCK characters long or one text; a block keeps its distinct words and, for every place, which of them stands there. The
blocks' words are dealt out by their hash, so that all blocks' copies of a word meet in one task, which encodes it once;
the ids go back to the blocks that hold the word, where each text is put together again place by place.

A block sends at most one row to each part of the word space, however often it holds a word. A word in every block thus
adds one word to rows that are there anyhow: no key is hot. The blocks are written once, so that a lost task costs a
reread; for a table of files their words alone are, and the places are found again when they are needed. Decoding looks ids up in the vocabulary's table of token bytes, whose size is checked before it is sent out.

Null and empty texts have no ids. Bytes that are no UTF-8 are read as U+FFFD. Special tokens in a text are ordinary text.
Repeated rows stay. Other columns are kept; ones named like a result give way to it. Ids the vocabulary doesn't
have, and null ids, decode to nothing; null lists decode to null.
"""
from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from offerlens.llm.scratch import Scratch

BLOCK = 16 << 20          # characters of text in a block
AT_ONCE = 4 << 20         # characters whose pieces are found, or pieces that are put together, at once
MOST_CACHED = 1_000_000   # words whose ids a task keeps; one that meets more starts anew
MOST_VOCABULARY_BYTES = 64 << 20
ENCODED = ("ids", "n_tokens")
CUT_ANEW = "documents came in another order when they were read again: encode them without reread, or write them to files first"

LETTER, NUMBER, SPACE, OTHER, END = 1, 2, 3, 0, 4
#: Endings that are pieces of their own after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_classes: list[np.ndarray] = []
_cores: dict[int, object] = {}
_tables: dict[int, pa.LargeBinaryArray] = {}


def _ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


def _core(data: bytes):
    """Encoder of one piece."""
    key = hash(data)
    if key not in _cores:
        import tiktoken

        _cores[key] = tiktoken.Encoding("pieces", pat_str=r"[\s\S]", mergeable_ranks=_ranks(data), special_tokens={})._core_bpe
    return _cores[key]


def _token_bytes(data: bytes) -> pa.LargeBinaryArray:
    """Bytes of every id; the last entry, for all other ids, is empty."""
    key = hash(data)
    if key not in _tables:
        ranks = _ranks(data)
        out = [b""] * (max(ranks.values(), default=-1) + 2)
        for token, rank in ranks.items():
            out[rank] = token
        _tables[key] = pa.array(out, pa.large_binary())
    return _tables[key]


def class_table() -> np.ndarray:
    """Class of every code point, as the encoding library's own regular expressions tell letters, numbers and spaces."""
    if not _classes:
        import tiktoken

        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        single = {bytes([i]): i for i in range(256)}
        table = np.zeros(0x110000, np.uint8)
        for kind, pattern in ((LETTER, r"\p{L}"), (NUMBER, r"\p{N}"), (SPACE, r"\s")):
            found = tiktoken.Encoding("class", pat_str=pattern, mergeable_ranks=single, special_tokens={})
            text = bytes(found.encode_ordinary(every)).decode()
            table[np.frombuffer(text.encode("utf-32-le"), np.uint32)] = kind
        _classes.append(table)
    return _classes[0]


def pieces(texts: Sequence[str]) -> tuple[bytes, np.ndarray, np.ndarray]:
    """(bytes, starts, rows): the texts' UTF-8 with a byte between texts, the byte at which every piece starts (and the
    end), and the row of every piece, -1 for what stands between two texts.

    The rule, on runs of letters, numbers, spaces and other characters: a blank before a run belongs to it; the last
    character of a run of spaces before another run is thus apart from the rest; an ending is cut off after an
    apostrophe that opens a run of others. No regular expression is run, so the length of a run doesn't matter.
    """
    joined = "\n".join(texts)
    code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
    n = len(code)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.cumsum(lengths + 1) - 1
    kind = class_table()[code]
    kind[ends[:-1]] = END
    begins = np.ones(n + 1, bool)
    begins[1:n] = kind[1:] != kind[:-1]
    begins[ends[:-1]] = begins[ends[:-1] + 1] = True
    # a run of spaces gives its last character to what follows it in the same text
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    begins[last] = True
    begins[last[code[last] == 0x20] + 1] = False
    mark = np.flatnonzero(code == 0x27)
    opens = begins[mark]  # no blank before it, and no other character
    for i in mark[opens].tolist():
        for ending in ENDINGS:
            stop = i + 1 + len(ending)
            if joined.startswith(ending, i + 1):
                begins[i + 1], begins[stop] = False, True
                break
    width = 1 + (code >= 0x80).astype(np.int8) + (code >= 0x800) + (code >= 0x10000)
    at = np.zeros(n + 1, np.int32 if n < 1 << 29 else np.int64)
    np.cumsum(width, out=at[1:])
    start = np.flatnonzero(begins)
    row = np.searchsorted(ends, start[:-1], "left")
    row[kind[start[:-1]] == END] = -1
    return joined.encode(), at[start].astype(np.int64), row


def _planes(values: np.ndarray) -> bytes:
    """Numbers below 2^32 as compressed planes of bytes: high bytes are mostly zero."""
    return _packed(np.ascontiguousarray(values.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes())


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _from_planes(data: bytes, n: int) -> np.ndarray:
    if not n:
        return np.zeros(0, np.int64)
    planes = np.frombuffer(pa.decompress(data, n * 4, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.ascontiguousarray(planes.T).view("<u4").reshape(-1).astype(np.int64)


def _stop(texts: list[str], lo: int, most: int) -> int:
    """End of the texts from ``lo`` on that are at most ``most`` characters together; one text at least."""
    hi, size = lo + 1, len(texts[lo])
    while hi < len(texts) and size + len(texts[hi]) <= most:
        size += len(texts[hi])
        hi += 1
    return hi


def _block(texts: list[str], parts: int, words_too: bool, places_too: bool) -> dict:
    """Distinct words of the texts, most frequent first, dealt into parts; and what stands where. ``check`` tells blocks apart."""
    cut, counts, lo, check = [], [], 0, 0
    while lo < len(texts):
        hi = _stop(texts, lo, AT_ONCE)
        data, starts, row = pieces(texts[lo:hi])
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(data)])
        cut.append(words.filter(pa.array(row >= 0)))
        counts.append(np.bincount(row[row >= 0], minlength=hi - lo))
        check = zlib.crc32(data, check)
        lo = hi
    coded = pa.chunked_array(cut, pa.large_binary()).dictionary_encode().combine_chunks()
    coded = coded.chunk(0) if isinstance(coded, pa.ChunkedArray) else coded
    cut, place = None, coded.indices.to_numpy()
    found = coded.dictionary
    part = np.fromiter((zlib.crc32(w.as_py()) % parts for w in found), np.int64, len(found))
    spelled = np.empty(len(found), np.int64)
    spelled[pc.sort_indices(found).to_numpy()] = np.arange(len(found))
    # frequent words have small numbers; among equally frequent ones those of a part stand together, in order
    order = np.lexsort((spelled, part, -np.bincount(place, minlength=len(found))))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    dealt: dict[int, list[bytes]] = {}
    for w, p in () if not words_too else zip(found.take(pa.array(order)).to_pylist(), part[order].tolist(), strict=True):
        dealt.setdefault(p, []).append(w)
    words = []
    for p, ws in sorted(dealt.items()):
        joined = b"".join(ws)
        sizes = _planes(np.fromiter(map(len, ws), np.int64, len(ws)))
        words.append({"part": p, "n": len(ws), "sizes": sizes, "length": len(joined), "bytes": _packed(joined)})
    return {
        "pieces": np.concatenate(counts), "check": check,
        "places": _planes(rank[place]) if places_too else None, "n_places": len(place),
        "part_of": _planes(part[order]), "n_words": len(order), "words": words,
    }


BLOCK_ROW = ("places binary, n_places long, part_of binary, n_words long, "
             "words array<struct<part: int, n: int, sizes: binary, length: long, bytes: binary>>")
WORDS_TYPE = pa.list_(pa.struct([("part", pa.int32()), ("n", pa.int32()), ("sizes", pa.binary()), ("length", pa.int64()), ("bytes", pa.binary())]))
IDS_ROW = "block string, part int, n int, sizes binary, n_ids long, ids binary"


def _blocks(docs: DataFrame, text_col: str, keep: list[str], parts: int, words_too: bool = True, places_too: bool = True) -> DataFrame:
    """One row per block: its documents' kept columns, the places and the words."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, count = TaskContext.get().partitionId(), 0
        for batch in batches:
            texts = [(x or b"").decode("utf-8", "replace") for x in batch.column(0).to_pylist()]
            kept = batch.columns[1:]
            lo = 0
            while lo < len(texts):
                hi = _stop(texts, lo, BLOCK)
                b = _block(texts[lo:hi], parts, words_too, places_too)
                held = pa.StructArray.from_arrays(
                    [*(c.slice(lo, hi - lo) for c in kept), pa.array(b["pieces"], pa.int64())],
                    names=[*(f"c{i}" for i in range(len(kept))), "pieces"])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([f"{task}-{count}-{b['check']}"]), pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), held),
                     pa.array([b["places"]], pa.binary()), pa.array([b["n_places"]]), pa.array([b["part_of"]], pa.binary()),
                     pa.array([b["n_words"]]), pa.array([b["words"]], WORDS_TYPE)],
                    names=["block", "docs", "places", "n_places", "part_of", "n_words", "words"])
                lo, count = hi, count + 1

    kinds = "".join(f"c{i}: {f.dataType.simpleString()}, " for i, f in enumerate(docs.select(*keep).schema))
    read = docs.select(F.col(text_col).cast("string").cast("binary").alias("_text"),
                       *[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)])
    return read.mapInArrow(rows, f"block string, docs array<struct<{kinds}pieces: bigint>>, {BLOCK_ROW}")


def _encoded_words(words: DataFrame, ranks) -> DataFrame:
    """The ids of a block's words of one part, and how many each word has."""
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, known = _core(ranks.value).encode_single_piece, {}
        for batch in batches:
            sizes_out, n_ids, ids_out = [], [], []
            for r in batch.select(["n", "sizes", "length", "bytes"]).to_pylist():
                data = pa.decompress(r["bytes"], r["length"], codec="zstd", asbytes=True)
                ids, counts, at = [], [], 0
                for size in _from_planes(r["sizes"], r["n"]).tolist():
                    word = data[at: at + size]
                    at += size
                    got = known.get(word)
                    if got is None:
                        if len(known) >= MOST_CACHED:
                            known.clear()
                        got = known[word] = encode(word)
                    ids += got
                    counts.append(len(got))
                sizes_out.append(_planes(np.array(counts)))
                n_ids.append(len(ids))
                ids_out.append(_planes(np.array(ids)))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("block", "part", "n")), pa.array(sizes_out, pa.binary()), pa.array(n_ids, pa.int64()),
                 pa.array(ids_out, pa.binary())], names=["block", "part", "n", "sizes", "n_ids", "ids"])

    return words.mapInArrow(rows, IDS_ROW)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ..., then the same for the next range."""
    end = np.cumsum(size)
    return np.repeat(start - end + size, size) + np.arange(end[-1] if len(end) else 0)


def _decoded(lists: pa.ListArray, table: pa.LargeBinaryArray) -> pa.Array:
    """The bytes of lists of ids, looked up in the table of token bytes."""
    unknown = len(table) - 1
    ids = lists.flatten().fill_null(unknown).to_numpy(zero_copy_only=False)
    ids = np.where((ids < 0) | (ids > unknown), unknown, ids)
    cut = np.zeros(len(lists) + 1, np.int64)
    np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), out=cut[1:])
    taken = table.take(pa.array(ids))
    at = np.frombuffer(taken.buffers()[1], np.int64)[: len(ids) + 1] if len(ids) else np.zeros(1, np.int64)
    valid = lists.is_valid().buffers()[1] if lists.null_count else None
    return pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(lists), [valid, pa.py_buffer(np.ascontiguousarray(at[cut])), taken.buffers()[2]]).cast(pa.binary())


def _put_together(left: pa.Table, right: pa.Table, ranks) -> pa.Table:
    """A block's texts as ids: each place takes the ids of its word. With ``ranks`` they are decoded, too."""
    if not left.num_rows:
        raise ValueError(CUT_ANEW)
    docs = left.column("docs").combine_chunks()
    docs = (docs.chunk(0) if isinstance(docs, pa.ChunkedArray) else docs).flatten()
    row = {c: left.column(c)[0].as_py() for c in ("places", "n_places", "part_of", "n_words")}
    part_of, place = _from_planes(row["part_of"], row["n_words"]), _from_planes(row["places"], row["n_places"])
    parts = right.sort_by("part").to_pylist()
    flat = lambda c, n: np.concatenate([np.zeros(0, np.int64), *(_from_planes(r[c], r[n]) for r in parts)])
    ids, got = flat("ids", "n_ids").astype(np.int32), flat("sizes", "n")
    if len(got) != len(part_of):
        raise ValueError(CUT_ANEW)
    order = np.argsort(part_of, kind="stable")
    size, start = np.empty(len(order), np.int64), np.empty(len(order), np.int64)
    size[order] = got
    start[order] = np.cumsum(got) - got
    tokens = np.zeros(len(place) + 1, np.int64)
    np.cumsum(size[place], out=tokens[1:])
    cut = np.zeros(len(docs) + 1, np.int64)
    np.cumsum(docs.field("pieces").to_numpy(), out=cut[1:])
    values = np.empty(tokens[-1], np.int32)
    for lo in range(0, len(place), AT_ONCE // 8):
        some = place[lo: lo + AT_ONCE // 8]
        values[tokens[lo]: tokens[lo + len(some)]] = ids[_ranges(start[some], size[some])]
    lists = pa.ListArray.from_arrays(pa.array(tokens[cut].astype(np.int32)), pa.array(values))
    columns = [*(docs.field(i) for i in range(docs.type.num_fields - 1)), lists]
    names = [*(f"c{i}" for i in range(len(columns) - 1)), "ids"]
    if ranks is not None:
        columns, names = [*columns, _decoded(lists, _token_bytes(ranks.value))], [*names, "decoded"]
    return pa.Table.from_arrays(columns, names=names)


def _vocabulary(spark: SparkSession, path: str):
    """The rank file's bytes, sent to every executor once their number is checked."""
    found = spark.read.format("binaryFile").load(path).select("length", "content").first()
    if found["length"] > MOST_VOCABULARY_BYTES:
        raise ValueError("the vocabulary is too large to be sent to every executor")
    return spark.sparkContext.broadcast(bytes(found["content"]))


def encode(
    docs: DataFrame, vocabulary: str, *, text_col: str = "text", keep: list[str] | None = None, and_decode: bool = False, reread: bool = False,
) -> DataFrame:
    """The columns ``keep`` (all but the text) plus ids (array<int>) and n_tokens, one row per document.

    With ``and_decode`` also ``decoded``, which ``decode`` would give for the ids, without another pass over them.
    ``reread`` is for a table of files, which gives the same rows in the same order whenever it is read: only the blocks' words
    are written then, and the blocks are cut again for the places. One that is cut differently is noticed and ends the job.
    """
    spark = docs.sparkSession
    ranks, parts = _vocabulary(spark, vocabulary), int(spark.conf.get("spark.sql.shuffle.partitions"))
    results = (*ENCODED, "decoded") if and_decode else ENCODED
    keep = [c for c in (docs.columns if keep is None else keep) if c not in results and (keep is not None or c != text_col)]
    scratch = Scratch(spark)
    if reread:
        words = scratch.keep(_blocks(docs, text_col, keep, parts, places_too=False).select("block", "words"))
        blocks = _blocks(docs, text_col, keep, parts, words_too=False)
    else:
        words = blocks = scratch.keep(_blocks(docs, text_col, keep, parts))
    words = words.select("block", F.explode("words").alias("w")).select("block", "w.*")
    encoded = _encoded_words(words.repartition("part"), ranks)
    kinds = "".join(f"c{i} {f.dataType.simpleString()}, " for i, f in enumerate(docs.select(*[f"`{c}`" for c in keep]).schema))
    held, table = blocks.select("block", "docs", "places", "n_places", "part_of", "n_words"), ranks if and_decode else None
    out = held.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(
        lambda left, right: _put_together(left, right, table), f"{kinds}ids array<int>" + ", decoded binary" * and_decode)
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(keep)], "ids", F.size("ids").cast("long").alias("n_tokens"),
                      *["decoded"] * and_decode)


def decode(
    encoded: DataFrame, vocabulary: str, *, ids_col: str = "ids", out_col: str = "decoded", keep: list[str] | None = None,
) -> DataFrame:
    """The columns ``keep`` (all) plus ``decoded``: the bytes of the ids, each looked up in the table of token bytes."""
    ranks = _vocabulary(encoded.sparkSession, vocabulary)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _token_bytes(ranks.value)
        for batch in batches:
            decoded = _decoded(batch.column(batch.num_columns - 1), table)
            yield pa.RecordBatch.from_arrays([*batch.columns, decoded], names=[*batch.schema.names, "_bytes"])

    kept = [c for c in (encoded.columns if keep is None else keep) if c != out_col]
    asked = encoded.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(kept)], F.col(ids_col).cast("array<int>").alias("_ids"))
    kinds = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in asked.schema)
    out = asked.mapInArrow(rows, f"{kinds}_bytes binary")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(kept)], F.col("_bytes").alias(out_col))
