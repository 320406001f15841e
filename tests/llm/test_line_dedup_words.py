import random
import re

import pytest

from tidemark.llm.line_dedup import dedup_lines, within
from tests.llm.test_line_dedup import distance

STARTS = re.compile(r"(?<=[\t-\r ])(?=[^\t-\r ])|(?=[ࠀ-\U0010ffff])")


def brute(rows, least, run):
    first, out, lines = {}, {}, []
    for doc, text in sorted(rows):
        for k, line in enumerate(text.split("\n")):
            if len(line) >= least and line not in first:
                first[line] = (doc, k)
                lines.append(line)
    cut = {x: [w for w in STARTS.split(x) if w] for x in lines}
    chars = lambda a, b: abs(len(a) - len(b)) < 2 and distance(a, b) <= 1
    words = lambda a, b: distance(cut[a], cut[b]) <= max(0, (max(len(cut[a]), len(cut[b])) - run) // (run + 1))
    near = {b for j, b in enumerate(lines) for a in lines[:j] if chars(a, b) or words(a, b)}
    for doc, text in rows:
        out[doc] = "\n".join(x for k, x in enumerate(text.split("\n")) if len(x) < least or (first[x] == (doc, k) and x not in near))
    return out, near


@pytest.mark.parametrize("run", [3, 8])
def test_word_edits_against_brute_force(docs, run):
    rng, rows = random.Random(run), []
    vocabulary = ["".join(rng.choice("bcdfglmn") + rng.choice("aeiou") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    make = lambda: [rng.choice(vocabulary) for _ in range(rng.randint(5, 60))]
    pool = [make() for _ in range(25)] + [["mo"] * 40, ["mo"] * 43, list("这是一个没有空格的很长的句子所以每个字都是一个词语再加上一些字")]
    for d in range(110):
        lines = []
        for _ in range(rng.randint(1, 2)):
            line = list(rng.choice(pool))
            for _ in range(rng.choice((0, 1, 1, 2, 3, 5, 7))):
                p = rng.randrange(len(line))
                line[p : p + rng.randint(0, 1)] = rng.choice(([], [rng.choice(vocabulary)], ["é" + rng.choice(vocabulary)]))
                line = line or ["x"]
            lines.append(("" if ord(line[0][0]) > 0x800 else rng.choice((" ", " ", " ", "  "))).join(line))
        rows.append((d, "\n".join(lines)))
    want, near = brute(rows, 20, run)
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(rows), run=run).collect()}
    assert got == want and len(near) > 20


def test_one_changed_word_in_twenty(docs):
    line = "all of these words stand in the line that another document has but for one word of it here again"
    got = {r["doc_id"]: (r["text"], r["n_near"]) for r in dedup_lines(docs([(1, line), (2, line.replace("document", "x"))]), run=8).collect()}
    assert got == {1: (line, 0), 2: ("", 1)}


def test_shorter_line_has_no_edits_of_its_own(docs):
    words = "these sixteen words stand in this line which is longest that allows no edits".split() + ["by", "itself"]
    assert len(words) == 16
    longer = " ".join([*words[:7], "really", *words[7:]])
    for first, second in ((" ".join(words), longer), (longer, " ".join(words))):
        got = {r["doc_id"]: r["n_near"] for r in dedup_lines(docs([(1, first), (2, second)]), run=8).collect()}
        assert got == {1: 0, 2: 1}


def test_edit_distance_of_words():
    rng = random.Random(4)
    for _ in range(3000):
        a = [rng.choice("abc") for _ in range(rng.randint(0, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 5)):
            p = rng.randint(0, len(b))
            b[p : p + rng.randint(0, 1)] = rng.choice(([], ["c"], ["d"]))
        for bound in range(6):
            assert within(a, b, bound) == (distance(a, b) <= bound)


def test_a_cloud_of_near_lines(docs):
    """Of any two, a part is near; a line has to be found whose near ones are far down its keys."""
    rng, rows = random.Random(6), []
    base = [f"w{rng.randrange(300)}" for _ in range(45)]
    for d in range(150):
        line = list(base)
        for _ in range(rng.randint(2, 4)):
            line[rng.randrange(45)] = f"x{rng.randrange(9)}"
        rows.append((d, " ".join(line)))
    want, near = brute(rows, 20, 8)
    assert {r["doc_id"]: r["text"] for r in dedup_lines(docs(rows), run=8).collect()} == want and 50 < len(near) < 150


def test_many_lines_with_a_word_in_common(docs):
    """Lines of one key that are not near one another, with a few near pairs among them."""
    rng, rows = random.Random(7), []
    for d in range(400):
        rows.append((d, " ".join(["extraordinarily", *(f"{rng.randrange(10**6):06d}" for _ in range(24))])))
    for d in range(0, 400, 40):
        line = rows[d][1].split()
        line[5] = "new"
        rows.append((1000 + d, " ".join(line)))
    got = {r["doc_id"] for r in dedup_lines(docs(rows), run=8).collect() if r["n_near"]}
    assert got == {1000 + d for d in range(0, 400, 40)}
