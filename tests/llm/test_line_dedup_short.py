from tidemark.llm.line_dedup import dedup_lines


def test_short_lines_go_if_equal(docs):
    rows = docs([(1, "Les.\n\n \nLes."), (2, "Les.\n\nLe."), (3, "Le.\n "), (None, "Le.")])
    got = {r["doc_id"]: (r["text"], r["n_equal"], r["n_near"]) for r in dedup_lines(rows, run=8, short_equal=True).collect()}
    assert got == {None: ("Le.", 0, 0), 1: ("Les.\n\n ", 1, 0), 2: ("", 2, 0), 3: (" ", 1, 0)}
