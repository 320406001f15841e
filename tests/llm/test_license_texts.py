"""Whole license texts, as they are, cut and changed in places."""

import random

from tidemark.llm.licenses import _BSD_2, _ISC, _MIT, _ZLIB, BLOCK, NOTICES, STRIDE, passages, scan_licenses

TEXTS = {"text:mit": _MIT, "text:bsd-2-clause": _BSD_2, "text:isc": _ISC, "text:zlib": _ZLIB}


def labels(row):
    return {x for x in row["labels"].split(",") if x.startswith("text:")}


def test_passages_cover_the_text_and_lie_in_a_block():
    for label, text in TEXTS.items():
        found = passages(label, text)
        assert sum((t.words for t in found), ()) == tuple("".join(c if c.isalnum() else " " for c in text.lower()).split())
        assert all(8 <= len(t.words) <= BLOCK - STRIDE + 1 for t in found)
    assert all(len(t.words) <= STRIDE + 1 for t in NOTICES)


def test_texts_wherever_they_stand(docs, sentences):
    rows = [(i, sentences(37 * i, i) + "\n" + text + "\n" + sentences(50, i + 9), "s") for i, text in enumerate(TEXTS.values())]
    got = {r["doc_id"]: r for r in scan_licenses(docs(rows)).collect()}
    for i, (label, text) in enumerate(TEXTS.items()):
        assert label in labels(got[i])  # and those of texts that share a passage with it
        for other in set(TEXTS) - {label} - labels(got[i]):
            assert not any(len(set(t.words) & set("".join(c if c.isalnum() else " " for c in text.lower()).split()[a : a + 33])) >= t.need for t in passages(other, TEXTS[other]) for a in range(0, 300, 8))
        assert got[i]["score"] == 1.0 and got[i]["blocks"] >= len(passages(label, text))


def test_cut_and_changed_texts(docs, sentences):
    rng = random.Random(4)
    rows, want = [], {}
    for n in range(40):
        label = rng.choice(list(TEXTS))
        words = TEXTS[label].split()
        start = rng.randint(0, len(words) - 70)
        kept = words[start : start + rng.randint(70, 100)]
        changed = [w if i % 12 else f"q{i}" for i, w in enumerate(kept)]
        rows.append((n, sentences(rng.randint(0, 90), n) + " " + " ".join(changed) + " " + sentences(20, n + 50), "s"))
        want[n] = label
    got = {r["doc_id"]: labels(r) for r in scan_licenses(docs(rows)).collect()}
    assert all(want[n] in got[n] for n in want)
    none = scan_licenses(docs([(1, sentences(900, 3), "s"), (2, " ".join(sorted(_MIT.split())[::3]), "s")])).collect()
    assert [labels(r) for r in none] == [set(), set()]
