import random

from offerlens.llm import line_dedup


def rows():
    rng = random.Random(8)
    out = []
    for i in range(40):
        prose = [" ".join("".join(rng.choices("abcdefg", k=6)) for _ in range(rng.randint(6, 20))) for _ in range(3)]
        mark = f"Page {i} of {rng.randint(1, 900)} printed on 2021-03-0{i % 9}"
        login = f"The user called name{chr(97 + i % 26)}{chr(97 + i // 26)} has signed in to this site today again"
        out.append((i, "\n".join([prose[0], mark, "", prose[1], login, prose[2], "short line"])))
    return out


def test_recurring_templates_go_and_prose_stays(spark, documents):
    data = rows() + [(100, None), (101, ""), (102, "\n\n"), (None, "one lone line of some words"), (3, rows()[3][1])]
    got = line_dedup.summary(documents(data)).collect()
    assert len(got) == len(data)
    for r in got:
        if r.doc_id is not None and r.doc_id < 100:
            assert (r.n_lines, r.n_dropped, r.dropped) == (6, 2, [1, 4])
        else:
            assert r.n_dropped == 0
    cleaned = line_dedup.clean(documents(data))
    assert cleaned.columns == documents([]).columns
    text = {r.doc_id: r.text for r in cleaned.collect()}
    want = [x for i, x in enumerate(data[5][1].split("\n")) if i not in (1, 4)]
    assert text[5] == "\n".join(want) and text[100] is None and text[101] == "" and text[102] == "\n\n"


def test_copies_of_one_document_do_not_make_lines_recur(spark, documents):
    text = "this line stands in every copy of it\nand so does this other line here"
    assert {r.n_dropped for r in line_dedup.summary(documents([(i, text) for i in range(50)])).collect()} == {0}
    varied = [(i, f"{text}\nown w{chr(97 + i)}") for i in range(10)]
    assert {r.n_dropped for r in line_dedup.summary(documents(varied)).collect()} == {2}


def test_lines_of_fields_are_kept(spark, documents):
    assert {r.n_dropped for r in line_dedup.summary(documents([(i, f"row {i} 1 2 3 4 5\nx{chr(97 + i % 26)}{i}") for i in range(40)])).collect()} == {0}


def test_equal_leading_words_alone_do_not_make_lines_recur(spark, documents):
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("hijklmn", k=7))
    data = [(i, "\n".join("How to make " + " ".join(word() for _ in range(n)) for n in (2, 3, 4))) for i in range(60)]
    assert {(r.n_lines, r.n_dropped) for r in line_dedup.summary(documents(data)).collect()} == {(3, 0)}


def test_similar_lines_of_one_document_do_not_recur(spark, documents):
    line = lambda i: f"The list holds an item of {chr(97 + i)}{chr(97 + i)} for every customer of this shop"
    alone = [(1, "\n".join(line(i) for i in range(20))), (2, "some other text of its own here")]
    assert {r.n_dropped for r in line_dedup.summary(documents(alone)).collect()} == {0}
    spread = [(k, line(2 * k) + "\n" + line(2 * k + 1)) for k in range(10)]
    assert {r.n_dropped for r in line_dedup.summary(documents(spread)).collect()} == {2}


def test_short_long_and_mixed_lines_recur(spark, documents):
    """Short exact lines, long lines in a few documents, and templates that hold a small part of their leaf."""
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("opqrstu", k=7))
    passage = "this passage " + " ".join(word() for _ in range(50))
    data = []
    for i in range(60):
        parts = [" ".join(word() for _ in range(12)), "All rights reserved.", f"We now have {' '.join(word() for _ in range(8))}"]
        parts.append(passage if i < 3 else "")
        kind = ("seen at the north gate by guards", "sold from a small shop near town") if i < 24 else ()
        parts.append(f"We now have {word()} {kind[i % 2]}" if kind else "")
        data.append((i, "\n".join(parts)))
    got = {r.doc_id: r.dropped for r in line_dedup.summary(documents(data), min_tokens=1).collect()}
    keepers = [i for i in range(3) if 3 not in got[i]]
    assert len(keepers) == 1
    for i in range(60):
        assert got[i] == [1] + ([3] if i < 3 and i not in keepers else []) + ([4] if i < 24 else [])
    assert all(1 not in r.dropped for r in line_dedup.summary(documents(data)).collect())


def test_empty_table(spark, documents):
    assert line_dedup.summary(documents([])).count() == 0
    assert line_dedup.clean(documents([])).count() == 0
