"""Repeated lines, and passages that only seem to repeat."""

import random

from linkloom.llm import passages


def cut(spark, docs):
    return {r.doc_id: r.text for r in passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}


def own(k, n=40):
    return " ".join(f"d{k}w{i}" for i in range(n))


def test_words_from_several_documents_stay(spark):
    one, two = " ".join(own(1, 60).split()[40:]), own(2, 20)
    docs = [(1, own(1, 60)), (2, own(2, 60)), (3, f"{own(3)} {one}\n{two} {own(33)}")]
    assert cut(spark, docs)[3] == docs[2][1]


def test_ends_of_a_passage_go(spark):
    passage = own(0, 60)
    left = cut(spark, [(1, f"{own(1)}\n{passage}\n{own(11)}"), (2, f"{own(2)}\n{passage}\n{own(22)}")])
    assert left[2].split() == f"{own(2)} {own(22)}".split()


def test_short_lines_go_after_the_first(spark):
    docs = [(1, f"{own(1)}\nA short header line.\n{own(11)}\nthe end"), (2, f"a short  header line\n{own(2)}\nA short header line\nThe end\n{own(22)}"), (3, f"{own(3)} a short header line {own(33)}")]
    left = cut(spark, docs)
    assert left[1] == docs[0][1] and left[3] == docs[2][1]
    assert left[2].split() == f"{own(2)} The end {own(22)}".split()  # three words and less meet by chance


def test_a_text_of_one_line_goes_whole(spark):
    line = own(7, 20)
    assert cut(spark, [(1, line), (2, line.upper()), (3, f"{line}\n")]) == {1: line, 2: "", 3: ""}


def test_scripts_without_spaces(spark):
    """A passage of Han characters pasted into two lines: each character counts as a word."""
    passage = "".join(chr(0x4E00 + (i * 37) % 5000) for i in range(200))
    docs = [(1, "前" * 3 + passage + "后"), (2, "甲乙丙丁" + passage + "戊己庚辛"), (3, "".join(chr(0x4E00 + (i * 91) % 5000) for i in range(150)))]
    left = cut(spark, docs)
    assert left[1] == docs[0][1] and left[3] == docs[2][1]
    assert len(left[2]) < 30 and left[2].startswith("甲乙丙丁") and left[2].endswith("戊己庚辛")


def test_rows_without_an_id_are_no_group(spark):
    """Null ids rank last and alike; many of them never meet in one list."""
    shared = own(0, 40)
    docs = [(5, f"{shared}\n{own(5)}"), *((None, f"{shared}\n{own(100 + k)}") for k in range(50)), (None, own(9))] + [(5, f"{shared}\n{own(5)}")] * 3
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    rows = passages.remove_repeats(frame).collect()
    assert sorted(r.text for r in rows if r.doc_id is None) == sorted([*(own(100 + k) for k in range(50)), own(9)])
    assert [r.text for r in rows if r.doc_id == 5] == [docs[0][1]] * 4
    plan = passages.remove_repeats(frame)._jdf.queryExecution().optimizedPlan().toString()
    assert "__linkloom_h" in plan


def test_planted_passages_by_construction(spark):
    """Passages of 50 to 120 words inside lines of other words: later copies go but for a few words at their ends, all else stays."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 9)))
    planted = [[word() for _ in range(rng.randint(50, 120))] for _ in range(15)]
    docs, marks, seen = [], {}, set()
    for i in range(120):
        text, mark = [], []
        for _ in range(rng.randint(1, 4)):
            line = [(word(), None) for _ in range(rng.randint(10, 90))]
            if rng.random() < 0.5:
                k, at = rng.randrange(15), rng.randint(0, len(line))
                line[at:at] = [(w, k) for w in planted[k]]
            text.append(" ".join(w for w, _ in line))
            mark += [(w, k is not None and k in seen, k) for w, k in line]
            seen |= {k for _, k in line if k is not None}
        docs.append((i, "\n".join(text)))
        marks[i] = mark
    left = {r.doc_id: r for r in passages.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    repeated = kept = 0
    for i, text in docs:
        gone = [False] * len(text)
        for a, b in left[i].removed:
            gone[a:b] = [True] * (b - a)
        assert "".join(c for c, g in zip(text, gone) if not g) == left[i].text
        at = 0
        for w, again, _ in marks[i]:
            at = text.index(w, at)
            out = gone[at]
            assert again or not out, "a word that does not repeat went"
            repeated += again
            kept += again and not out
            at += len(w)
    assert repeated > 1500 and kept < 0.08 * repeated
