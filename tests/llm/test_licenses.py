import math
import random
import textwrap

import numpy as np
import pyarrow as pa
import pytest

from offerlens.llm import licenses
from tests.llm.conftest import alnum

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute(text, templates, least):
    w = alnum(text)
    at = [(i, label) for p, label in PHRASES.items() for i in range(len(w) - len(p) + 1) if tuple(w[i: i + len(p)]) == p]
    labels, score = {x for _, x in at}, float(bool(at))
    for label, t in templates.items():
        n, t = len(alnum(t)), set(alnum(t))
        best = max((len(t.intersection(w[i: i + n])) for i in range(max(1, len(w) - n + 1))), default=0)
        if best >= math.ceil(least * len(t) - 1e-9):
            labels.add(label)
            score = max(score, best / len(t))
    starts = [i for i, _ in at]
    return (len(w), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at})),
            ",".join(sorted(labels)), round(score, 9))


@pytest.mark.parametrize("least", [0.5, 0.8, 1.0])
def test_against_brute_force(spark, documents, least):
    rng = random.Random(3)
    pool = [w for t in licenses.TEMPLATES.values() for w in t.split()] + ["other", "É", "MIT", "License"]
    rows = []
    for i in range(150):
        lines = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(rng.randint(0, 4))]
        t = rng.choice(list(licenses.TEMPLATES.values())).split()
        for _ in range(rng.randint(0, len(t) // 3)):
            t[rng.randrange(len(t))] = "changed"
        rng.shuffle(t)
        rows.append((i, "\n".join([*lines, " ".join(t)])))
    rows += [(500, None), (501, ""), (502, "MIT license"), (502, "MIT license"), (503, "mit\nLICENSE, general public license apache-license"),
             (None, "the Mit License"), (504, "filler words " * 30000 + "MIT License"), (505, licenses.TEMPLATES["mit-grant"].upper()), (506, "rights reserved"), (507, "reserved " * 400 + "all rights")]
    got = licenses.scan(documents(rows), least=least).collect()
    name = lambda r: (str(r[0]), r[1] or "")
    seen = sorted((name((r.doc_id, r.text)), (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))) for r in got)
    assert seen == sorted((name(r), brute(r[1], licenses.TEMPLATES, least)) for r in rows)


@pytest.mark.parametrize("width", [40, 72, 80, 100])
@pytest.mark.parametrize("mark", ["", "# ", " * ", "// "])
def test_wrapped_notices(spark, documents, width, mark):
    body = {k: "\n".join(mark + x for x in textwrap.wrap(t, width)) for k, t in licenses.TEMPLATES.items()}
    rows = [(i, "Some words before.\n" + text + "\nand after it.") for i, text in enumerate(body.values())]
    rows += [(100, "\n".join(body.values())), (101, " ".join(" ".join(rng_words(i)) for i in range(20)))]
    got = {r.doc_id: r.labels.split(",") for r in licenses.scan(documents(rows)).collect()}
    for i, label in enumerate(body):
        assert label in got[i] and label in got[100]
    assert got[101] == [""]


def rng_words(seed):
    """Words of one template each, too far apart for its blocks."""
    t = list(licenses.TEMPLATES.values())[seed % len(licenses.TEMPLATES)].split()
    return [x for word in t for x in [word, *["filler"] * (len(t) + 1)]]


def test_templates_without_hits_cost_nothing(spark, documents, monkeypatch):
    """Only templates with a rare word in the text are looked at."""
    seen = []
    looked = licenses._stretches
    monkeypatch.setattr(licenses, "_stretches", lambda heads, t, *rest: seen.append(t.label) or looked(heads, t, *rest))
    parts = [(f"t{i}", licenses._split(" ".join(f"w{i}x{j}" for j in range(20)))) for i in range(2000)]
    vocabulary = np.unique(np.concatenate([t for _, t in parts]))
    run = licenses._scanned(vocabulary, np.arange(len(vocabulary)), parts, [(licenses._split("mit license"), "mit")], 0, 0.8)
    text = " ".join(f"w7x{j}" for j in range(20))
    batch = pa.RecordBatch.from_arrays([pa.array(["nothing here", text, None])], names=["text"])
    out, = run([batch])
    assert seen == ["t7"] and out.column("labels").to_pylist() == ["", "t7", ""]


def test_empty_table_and_bad_templates(spark, documents):
    assert licenses.scan(documents([])).count() == 0
    with pytest.raises(ValueError):
        licenses.scan(documents([]), templates={"none": " . "})


def test_batches_without_any_template_word(spark, documents):
    """Alone in their batch, as at the end of a large file."""
    rows = [(1, "zzz qqq"), (2, "zzz"), (3, None), (4, "")]
    got = licenses.scan(documents(rows).repartition(8, "doc_id"), carry=["doc_id"]).collect()
    assert sorted((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) for r in got) == [
        (i, n, 0, None, None, "", "", 0.0) for i, n in ((1, 2), (2, 1), (3, 0), (4, 0))]
