import re

from tidemark.llm.licenses import BLOCK, NOTICES, PHRASES, STRIDE, Template, scan_blocks, scan_licenses


def brute(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({65 + i: 97 + i for i in range(26)}))
    places, labels = [], set()
    for t in PHRASES:
        n = len(t.words)
        at = [i for i in range(len(found)) if tuple(found[i : i + n]) == t.words]
        places += at
        labels |= {t.label} if at else set()
    base = set(labels)
    for t in NOTICES:
        labels |= {t.label for i in range(0, len(found), STRIDE) if len(set(found[i : i + BLOCK]) & set(t.words)) >= t.need}
    return len(found), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels))


def test_against_brute_force(docs, corpus, sentences):
    lines = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "CC BY CC BY 4.0", "This work is licensed under the GNU General Public License, version 3.", "mit mit license license"]
    rows = corpus + [(500 + i, sentences(20 * i, i) + "\n" + lines[i % 5] + "\n" + sentences(40, i) + " " + lines[(i + 2) % 5]) for i in range(30)]
    rows += [(600, "by " * 70 + "cc by"), (601, "GNU general\npublic license" * 3), (602, " ".join(["redistribution", "and", "use", "in", "source", "forms", "with", "or", "without", "modification", "are", "permitted"]))]
    got = scan_licenses(docs(rows)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels").collect()
    want = sorted((str(d), *map(str, brute(t))) for d, t in rows)
    assert sorted(tuple(map(str, r)) for r in got) == want


def test_scores(docs):
    got = {r["doc_id"]: r["score"] for r in scan_licenses(docs([(1, "released under the MIT license"), (2, "nothing here"), (3, None)])).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0}


def test_empty_table(docs):
    assert scan_licenses(docs([])).collect() == []


def test_long_templates(docs, sentences):
    """A template of 300 words is found wherever it stands, with a tenth of its words changed; so are phrases beside it."""
    words = sentences(300, 77).split()
    changed = [w if i % 12 else f"x{i}" for i, w in enumerate(words)]
    rows = [(1, sentences(500, 1) + " " + " ".join(changed) + " " + sentences(500, 2)), (2, " ".join(words[:100]) + " MIT License"), (3, sentences(40, 3) + " mit license " + " ".join(words)), (4, sentences(100, 4))]
    templates = (*PHRASES, Template("long", tuple(words)))
    got = scan_blocks(docs(rows), templates).collect()
    assert {r["doc_id"] for r in got if templates[r["template"]].label == "long"} == {1, 3}
    starts = {(r["doc_id"], s) for r in got for s in r["starts"]}
    assert starts == {(2, 100), (3, 40)}
