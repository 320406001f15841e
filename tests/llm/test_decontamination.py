import hashlib
import re

from tidemark.llm.decontamination import decontaminate


def split(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))


def brute(text, items):
    found, hit, ids = split(text), set(), set()
    for item, words in items:
        for i in range(max(1, len(words) - 9) if words else 0):
            window = words[i : i + 10]
            for at in range(len(found) - len(window) + 1):
                if found[at : at + len(window)] == window:
                    hit |= set(range(at, at + len(window)))
                    ids.add(str(item))
    return len(found), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit)


def test_against_brute_force(spark, docs, corpus, sentences):
    items = [(i, sentences(15 + 3 * i, 7000 + i)) for i in range(12)] + [(40, "one two"), (41, "la la la la la la la la la la la la"), (42, None), (43, ""), (44, "Solo"), (45, items_text := sentences(6, 8000)), (46, items_text)]
    rows = list(corpus)
    for i in range(30):
        passage = (items[i % 12][1] or "").split()
        rows.append((700 + i, sentences(i, i) + " " + " ".join(passage[i % 4 : i % 4 + 5 + i % 12]).upper() + ". " + sentences(20, 50 + i)))
    rows += [(800, "la " * 30), (801, items[0][1] + " " + items[0][1]), (802, "x " + items_text), (803, "solo solo"), (804, " ".join(items[1][1].split()[:9]))]
    bench = spark.createDataFrame([(*r, 1, "h") for r in items], "item_id long, text string, pos int, h string")
    got = decontaminate(docs(rows), bench).collect()
    want = sorted((str(d), *map(str, brute(t, [(i, split(x)) for i, x in items]))) for d, t in rows)
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in decontaminate(docs([(1, "a b"), (2, None)]), none).collect()] == [False, False]
    assert decontaminate(docs([]), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []
