import random
import zlib
from collections import Counter
from math import log

import numpy as np
import pytest

from tidemark.llm import languages

SOUNDS = {"aa": ("the ing ation er ould ea st wh", 1), "bb": ("ung sch ei ich über ße der en", 2), "cc": ("ción ñe os la ll que as ad", 3), "dd": ("ова при ств ный ть не", 4)}


def prose(lang, n, seed):
    rng = random.Random(seed * 31 + SOUNDS[lang][1])
    return " ".join("".join(rng.choice(SOUNDS[lang][0].split()) for _ in range(rng.randint(1, 3))) for _ in range(n)).capitalize() + "."


@pytest.fixture
def langs(spark):
    def make(rows):
        """rows: doc_id, text, lang; the other columns bear names that the operator uses."""
        full = [(i, t, lang, "s", 3, "b", "p", 0.5, "l") for i, t, lang in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n long, bucket string, place string, score double, lang_pred string")

    return make


@pytest.fixture(scope="module")
def corpus():
    names = list(SOUNDS)
    return [(i, prose(names[i % 7 % 4], 1 + i * 13 % 120, i), names[i % 7 % 4]) for i in range(400)]


def fold(i):
    return zlib.crc32(str(i).encode()) % 4


def slow_trigrams(text):
    """Letters and marks in words, in lower case, a space around each."""
    import unicodedata

    clean = "".join((c.lower() if len(c.lower()) == 1 else c) if unicodedata.category(c)[0] in "LM" else " " for c in text)
    return Counter(f" {w} "[i : i + 3] for w in clean.split() for i in range(len(w)))


def test_held_out_accuracy(langs, corpus):
    got = {r["doc_id"]: r for r in languages.identify(langs(corpus)).collect()}
    assert len(got) == len(corpus) and all(got[i]["held_out"] == (fold(i) == 2) for i, _, _ in corpus)
    held = [(i, lang) for i, t, lang in corpus if fold(i) == 2 and len(t) > 30]
    assert len(held) > 50 and np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got.values())


def test_labels_of_held_out_rows_teach_nothing(langs, corpus):
    a = languages.fit_languages(langs(corpus))
    b = languages.fit_languages(langs([(i, t, "zz" if fold(i) == 2 else lang) for i, t, lang in corpus]))
    assert a.languages == b.languages == tuple(SOUNDS) and (a.chances == b.chances).all()


def test_counts_against_brute_force(langs, corpus):
    odd = [(5000, "Straße ÉCOLE İİ 日本語 x1y áb  --  I'm", "aa"), (5001, "", "bb"), (5002, "12 34 !", "cc")]
    model = languages.fit_languages(langs(corpus + odd))
    total = {lang: Counter() for lang in SOUNDS}
    for i, text, lang in corpus + odd:
        if fold(i) != 2:
            total[lang] += slow_trigrams(text)
    sizes = np.array([sum(total[lang].values()) for lang in SOUNDS])
    every = sum(total.values(), Counter())
    bucket = {}
    for gram in every:
        b, _, _ = languages.trigrams(np.array([ord(c) for c in f"#{gram.strip()}#"], np.uint32), np.array([32], np.uint32), model.bits)
        at = {" ": 0}.get(gram[0], 1 if len(gram.strip()) == 3 else 0)
        bucket[gram] = int(b[at] if gram[0] != " " else b[0]) if len(gram.strip()) == 3 or gram[0] == " " else int(b[-1])
    unique = [g for g in bucket if Counter(bucket.values())[bucket[g]] == 1]
    assert len(unique) > 0.95 * len(bucket)
    lent = sum(every.values()) + 0.5 * (1 << model.bits)
    for gram in unique[:300]:
        want = (np.array([total[lang][gram] for lang in SOUNDS]) + languages.LENT * (every[gram] + 0.5) / lent) / (sizes + languages.LENT)
        assert np.allclose(model.chances[bucket[gram]], want, rtol=1e-12)


def slow_mixture(chances, count, penalty):
    """Forward selection with plain expectation-maximisation; every language is tried at every step."""
    n = sum(count)

    def fitted(chosen):
        pi = {k: 1 / len(chosen) for k in chosen}
        for _ in range(2000):
            new = dict.fromkeys(chosen, 0.0)
            for p, c in zip(chances, count, strict=True):
                total = sum(p[k] * pi[k] for k in chosen)
                for k in chosen:
                    new[k] += c * p[k] * pi[k] / total / n
            pi = new
        return sum(c * log(sum(p[k] * pi[k] for k in chosen)) for p, c in zip(chances, count, strict=True)), pi

    width = len(chances[0])
    value, pi = max(((fitted([k])) for k in range(width)), key=lambda x: x[0])
    while len(pi) < width:
        slope = {k: sum(c * p[k] / sum(p[j] * pi[j] for j in pi) for p, c in zip(chances, count, strict=True)) for k in range(width) if k not in pi}
        more, wider = fitted([*pi, max(slope, key=slope.get)])
        if more - value <= penalty * log(max(n, 2)):
            break
        value, pi = more, wider
    return pi


def test_mixtures_against_brute_force():
    rng = np.random.default_rng(6)
    chances = rng.dirichlet([0.3] * 40, size=4).T + 1e-4
    chances /= chances.sum(0)
    place, entries, count, want = [], [], [], []
    for t in range(25):
        pi = rng.dirichlet([0.4] * 4)
        found = rng.multinomial(int(rng.integers(3, 900)), (chances * pi).sum(1) / (chances * pi).sum())
        own = np.flatnonzero(found)
        place += [t] * len(own)
        entries += own.tolist()
        count += found[own].tolist()
        want.append(slow_mixture(chances[own].tolist(), found[own].tolist(), 1.0))
    share, _ = languages.mixtures(np.array(place), chances[entries], np.array(count), penalty=1.0, rounds=2000)
    assert {len(w) for w in want} > {1, 2}
    for t, pi in enumerate(want):
        assert set(np.flatnonzero(share[t] > 0)) == set(pi)
        assert all(abs(share[t, k] - v) < 0.03 for k, v in pi.items())


def test_texts_of_several_languages(langs, corpus):
    model = languages.fit_languages(langs(corpus))
    rows = [(1, prose("aa", 300, 1) + "\n" + prose("bb", 150, 2), None), (2, prose("cc", 200, 3), None), (3, prose("dd", 100, 4) + prose("cc", 250, 5) + prose("aa", 100, 6), None)]
    got = {r["doc_id"]: r for r in languages.tell_languages(langs(rows), model, keep=("source",)).collect()}
    named = {i: dict(x.split(":") for x in got[i]["languages"].split(",")) for i in got}
    assert set(named[1]) == {"aa", "bb"} and got[1]["lang_pred"] == "aa" and 0.55 < float(named[1]["aa"]) < 0.75
    assert set(named[2]) == {"cc"} and got[2]["score"] > 0.99 and set(named[3]) == {"aa", "cc", "dd"} and got[3]["lang_pred"] == "cc"
    assert got[1]["source"] == "s"


def test_odd_rows(langs, corpus):
    long = prose("bb", 3000, 9) + " 7" * 2_000_000 + prose("bb", 3000, 10) * 20
    rows = [(900, None, "aa"), (901, "", "aa"), (902, "12 .. 😀", "aa"), (903, "über", None), (None, prose("cc", 50, 1), "cc"), (904, long, "bb"), (904, long, "bb")]
    got = languages.identify(langs(corpus + rows)).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(corpus) + 7 and [by_id[i]["lang_pred"] for i in (900, 901, 902)] == ["und"] * 3
    assert by_id[903]["lang_pred"] == "bb" and by_id[904]["lang_pred"] == "bb" and by_id[None]["lang_pred"] == "cc" and not by_id[None]["held_out"]
    assert [r["lang_pred"] for r in languages.identify(langs([(1, "a b", None), (2, None, "aa")])).collect()] == ["und", "und"]
    assert languages.identify(langs([])).collect() == []


def test_pieces_of_a_long_text_count_as_the_whole(monkeypatch):
    text = prose("aa", 4000, 3) + "   --  " + prose("dd", 2000, 4)
    whole = [list(map(np.ndarray.tolist, x)) for x in languages.counted(["zz", text, None, "yy"], 16)]
    monkeypatch.setattr(languages, "PIECE", 997)
    parts = [list(map(np.ndarray.tolist, x)) for x in languages.counted(["zz", text, None, "yy"], 16)]
    assert [sum((p[k] for p in parts), []) for k in range(3)] == [sum((w[k] for w in whole), []) for k in range(3)]
    assert sum(whole[0][2]) == sum(sum(slow_trigrams(t).values()) for t in ("zz", text, "yy"))
