import hashlib
import re

from tidemark.llm.mixing import mix_sources


def targets(sizes):
    """Shares by weight, what is above the cap shared anew until nothing is."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        free = [s for s in names if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return share | {s: 3 * sizes[s] for s in full}
        full |= over


def check(docs, rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {}
    for _, text, source in rows:
        sizes[source] = sizes.get(source, 0) + size(text)
    want = targets(sizes)
    got = mix_sources(docs(rows)).collect()
    assert len(got) == len(rows)
    by_id = {r["doc_id"]: r for r in got}
    for s in sizes:
        mine = [r for r in rows if r[2] == s]
        assert abs(by_id[mine[0][0]]["target"] - want[s]) < 1e-6
        order = sorted(mine, key=lambda r: hashlib.md5(f"{'null' if r[0] is None else r[0]}:mix".encode()).hexdigest())
        budget, before = round(want[s] + 1e-9), 0
        epochs = budget // sizes[s] if sizes[s] else 0
        for d, text, _ in order:
            part = max(0, min(size(text), budget - epochs * sizes[s] - before))
            assert by_id[d]["taken"] == epochs * size(text) + part <= 3 * size(text)
            before += size(text)
        assert sum(by_id[r[0]]["taken"] for r in mine) == budget


def test_against_brute_force(docs, sentences):
    check(docs, [(i, sentences(3 + i * 7 % 90, i), f"s{i % 7}" if i % 5 else "hot") for i in range(400)])
    check(docs, [(i, sentences(4, i), "ab"[i % 2]) for i in range(9)] + [(50, sentences(900, 1), None), (51, None, "z"), (52, "", "é"), (53, "one", "")])


def test_repeated_rows_and_empty(docs):
    got = mix_sources(docs([(1, "a b c", "x"), (1, "a b c", "x"), (2, "d", "y"), (None, "e f", "y")])).collect()
    assert len(got) == 4 and sum(r["taken"] for r in got) == 9
    assert mix_sources(docs([])).collect() == []
    assert [r["taken"] for r in mix_sources(docs([(1, None, None)])).collect()] == [0]
