import random

import pytest

from tidemark.llm.line_dedup import dedup_lines


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, least, edits):
    first, out = {}, {}
    order = sorted({(r[0] is not None, r[0] or 0, r[1] or "") for r in rows})
    lines = []
    for known, doc, text in order:
        for k, line in enumerate(text.split("\n")):
            if len(line) >= least and line not in first:
                first[line] = (known, doc, k)
                lines.append(line)
    near = {b for j, b in enumerate(lines) for a in lines[:j] if edits and abs(len(a) - len(b)) < 2 and distance(a, b) <= 1}
    for known, doc, text in order:
        kept = [x for k, x in enumerate(text.split("\n")) if len(x) < least or (first[x] == (known, doc, k) and x not in near)]
        out[doc if known else None] = "\n".join(kept)
    return out


@pytest.mark.parametrize("edits", [0, 1])
def test_against_brute_force(docs, sentences, edits):
    rng, rows = random.Random(3), []
    pool = [sentences(rng.randint(2, 12), i) for i in range(60)] + ["é" * 25, "short", "x" * 400]
    for d in range(70):
        lines = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(pool)
            for _ in range(rng.choice((0, 0, 1, 1, 2))):
                p = rng.randrange(len(line))
                line = rng.choice((line[:p] + line[p + 1 :], line[:p] + "q" + line[p:], line[:p] + "q" + line[p + 1 :]))
            lines.append(line)
        rows.append((d, "\n".join(lines)))
    rows += [(None, pool[0]), (500, ""), (501, pool[5])]
    got = {r["doc_id"]: r["text"] for r in dedup_lines(docs(rows), max_edits=edits).collect()}
    assert got == brute(rows, 20, edits)


def test_nulls_repeats_and_counts(docs):
    line = "this line is long enough to go"
    got = dedup_lines(docs([(1, f"{line}\n{line}\nok"), (2, None), (3, line), (3, line), (4, line[:-1] + "!")]), keep=("lang", "size")).collect()
    found = sorted((r["doc_id"], r["text"], r["n_lines"], r["n_equal"], r["n_near"], r["n_long"], r["size"]) for r in got if r["text"] is not None)
    assert found == [(1, f"{line}\nok", 3, 1, 0, 1, 7), (3, "", 1, 1, 0, 0, 7), (3, "", 1, 1, 0, 0, 7), (4, "", 1, 0, 1, 0, 7)]
    assert [r["n_lines"] for r in got if r["text"] is None] == [0]
    assert dedup_lines(docs([])).collect() == []
    with pytest.raises(ValueError):
        dedup_lines(docs([]), max_edits=2)
