import re

import pytest

SPACED = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spaced(text):
    return SPACED.findall((text or "").translate(FOLD))


def alnum(text):
    return ALNUM.findall((text or "").translate(FOLD))


def shingles(text, k):
    w = spaced(text)
    return {tuple(w[i: i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def closure(nodes, edges):
    """Smallest reachable node of every node."""
    root = {v: v for v in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            if root[a] != low or root[b] != low:
                root[a] = root[b] = low
                changed = True
    return root


@pytest.fixture(scope="session")
def documents(spark):
    """Rows -> a table with the columns of documents plus ones whose names clash with results."""
    def make(rows, extra=True):
        schema = "doc_id long, text string, lang string, source string, n_chars long"
        full = [(*r, *[None] * (5 - len(r))) for r in rows]
        df = spark.createDataFrame(full, schema)
        if extra:
            from pyspark.sql import functions as F
            for c in ("n_words", "n_hit", "items", "id", "key", "rep", "size", "target", "shard", "slot", "score", "labels", "kept",
                      "n_tokens", "line", "source_size", "words", "low", "token", "component_id", "_id", "text_score"):
                df = df.withColumn(c, F.lit("clash"))
        return df
    return make
