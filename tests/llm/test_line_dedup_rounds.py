import random

import numpy as np

from tidemark.llm import line_dedup as L
from tests.llm.test_line_dedup_words import brute


def test_a_text_is_hashed_once_not_for_each_line(docs):
    plan = L._lines(docs([(1, "a\nb")]), 1)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("xxhash64(text")


def test_rows_in_order_of_key_alone(docs):
    rng = np.random.default_rng(5)
    key = np.sort(rng.integers(0, 400, 3000))
    ids, place, parities = rng.integers(0, 200, 3000), (rng.integers(17, 60, 3000) << 32) | rng.integers(0, 30, 3000), rng.integers(0, 16, 3000).view(np.uint64)[:, None]
    order = np.lexsort((ids, place, key))
    want = np.zeros(3000, bool)
    want[order] = L._opened(key[order], ids[order], place[order], parities[order], 8)
    got = L._opened_groups(key, ids, place, parities, 8)
    assert (got == want).all() and 0 < got.sum() < 3000
    assert not L._opened_groups(key[:0], ids[:0], place[:0], parities[:0], 8).any()


def test_rounds_go_through_sought_keys_alone(docs, monkeypatch):
    """Lines of which some need more rounds: later ones read fewer rows, and results are as before, whether pairs are broadcast or not."""
    rng, rows, gone = random.Random(6), [], []
    base = [f"w{rng.randrange(300)}" for _ in range(45)]
    for d in range(150):
        line = list(base)
        for _ in range(rng.randint(2, 4)):
            line[rng.randrange(45)] = f"x{rng.randrange(9)}"
        rows.append((d, " ".join(line)))
    rows += [(1000 + d, " ".join(f"y{d}z{k}" if k else f"q{d}" for k in range(24)) + (" end" if d % 2 else "")) for d in range(60)]
    rows += [(2000 + d, rows[150 + d][1].replace(f"z7", "changed")) for d in range(60)]
    want, near = brute(rows, 20, 8)
    save = L.Scratch.save

    def told(self, df, name):
        out = save(self, df, name)
        if name.startswith("sought"):
            gone.append(out.count())
        return out

    monkeypatch.setattr(L.Scratch, "save", told)
    for broadcast in (True, False):
        if not broadcast:
            monkeypatch.setattr(L, "fits", lambda df: False)
        assert {r["doc_id"]: r["text"] for r in L.dedup_lines(docs(rows), run=8).collect()} == want and len(near) > 60
    assert gone and max(gone) < 200
