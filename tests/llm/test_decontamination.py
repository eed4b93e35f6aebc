import hashlib
import random

import pytest
from pyspark.sql import functions as F

from offerlens.llm import decontamination
from tests.llm.conftest import alnum


def brute(docs, items, window=10):
    win = set()
    for item, text in items:
        w = alnum(text)
        n = min(window, len(w))
        win |= {(item, tuple(w[i: i + n])) for i in range(len(w) - n + 1)} if n else set()
    out = []
    for doc, text in docs:
        w, hit, ids = alnum(text), set(), set()
        for item, p in win:
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i: i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    ids.add(str(item))
        out.append((doc, len(w), len(hit), ",".join(sorted(ids)), bool(hit)))
    return sorted(out, key=str)


def test_against_brute_force(spark, documents):
    rng = random.Random(5)
    vocab = ["a", "b", "the", "of", "Ünder", "ünder", "K", "k9", "İstanbul", *[f"v{i}" for i in range(60)]]
    say = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 3, 9, 10, 11, 30]))) for i in range(12)] + [(100, None), (101, "..."), (3, "the of"), (5, "ÜNDER"), (6, "ünder K")]
    docs = []
    for i in range(80):
        t = say(rng.randint(0, 60))
        if i % 2:
            t = f"{t}. {rng.choice(items)[1] or ''}\n{say(3).upper()}, {rng.choice(items)[1] or ''}"
        docs.append((i, t))
        items += [(7, "ΟΔΟΣ'Α Β Γ Δ Ε Ζ Η Θ Ι Κ"), (8, "ΟΔΟΣ'Α"), (9, "Σ ΑΣ. ασ"), (10, "İSTANBUL Kelvin ẞ")]
    docs += [(600, "x ΟΔΟΣ'Α Β Γ Δ Ε Ζ Η Θ Ι Κ y"), (601, "ΟΔΟΣ. Α"), (602, "ας Σ ΑΣ. ασ'"), (603, "i̇stanbul kelvin ß İstanbul Kelvin ẞ")]
    greek = ["Σ", "ΑΣ", "ασ", "ας", "ΟΔΟΣ", "οδος", "İ", "i̇", "I", "ı", "K", "k", "ẞ", "ß", "'", ". "]
    docs += [(700 + i, "".join(rng.choice(greek) + rng.choice(["", " ", "'", "."]) for _ in range(30))) for i in range(40)]
    items += [(20 + i, "".join(rng.choice(greek) + rng.choice(["", " "]) for _ in range(3))) for i in range(12)]
    docs += [(500, None), (501, ""), (502, "--- !"), (3, docs[3][1]), (3, "other " + (items[2][1])), (None, items[1][1]), (503, "v1 " * 20000 + items[9][1])]
    items_df = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = decontamination.decontaminate(documents(docs), items_df)
    rows = [(r.doc_id, r.n_words, r.n_hit, ",".join(r["items"]), r.contaminated) for r in got.collect()]
    assert sorted(rows, key=str) == brute(docs, items)
    kept = decontamination.clean(documents(docs), items_df)
    assert kept.columns == documents([]).columns
    assert kept.count() == sum(not r[-1] for r in rows)


def test_empty_tables(spark, documents):
    items = spark.createDataFrame([], "item_id long, text string")
    got = decontamination.decontaminate(documents([(1, "a b")]), items).collect()
    assert [(r.n_words, r.n_hit, r["items"], r.contaminated) for r in got] == [(2, 0, [], False)]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.decontaminate(documents([]), some).count() == 0


@pytest.mark.parametrize("rows", [10, 0])
def test_shuffled_tokens_give_the_same(spark, documents, monkeypatch, rows):
    """Beyond the broadcast bound the tokens are joined by a shuffle."""
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", rows)
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    docs = documents([(i, "x one two three four five six seven eight nine ten y") for i in range(30)] + [(99, "one two three")])
    got = decontamination.decontaminate(docs, items).collect()
    assert {(r.n_hit, r.contaminated) for r in got if r.doc_id < 99} == {(10, True)}
    assert [r.n_hit for r in got if r.doc_id == 99] == [0]


def test_hash_of_items():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
