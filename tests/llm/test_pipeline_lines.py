import corpus_pipeline


def test_documents_keep_their_short_lines(spark, docs):
    line = "this line is long enough to go"
    rows = docs([(1, line), (2, f"{line}\nshort but own"), (3, f"{line}\n \u3000\n"), (4, "ok")])
    got = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, rows, "").collect()}
    assert got == {1: (line, len(line)), 2: ("short but own", 13), 4: ("ok", 2)}
