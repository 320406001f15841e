import random

import pytest

CLASH = "doc_id long, text string, lang string, source string, n_chars long, size long, h string, n long, sid long, part int, score double, key string"


def as_docs(spark, rows):
    """Rows (doc_id, text[, source]) as a table with further columns, some named as operators name their own."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), 7, "h", 3, 4, 5, 0.5, "k") for r in rows]
    return spark.createDataFrame(full, CLASH)


@pytest.fixture
def docs(spark):
    return lambda rows: as_docs(spark, rows)


@pytest.fixture(scope="session")
def sentences():
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("bcdfglmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(400)]

    def make(n, seed):
        own = random.Random(seed)
        return " ".join(own.choice(vocabulary) for _ in range(n))

    return make


@pytest.fixture(scope="session")
def corpus(sentences):
    """Copies, near copies, shared lines, nulls, empties, a very long text, repeated rows."""
    rows = [(i, sentences(60 + i % 50, i) + "\n" + sentences(12, 1000 + i % 3)) for i in range(40)]
    rows += [(100 + i, rows[0][1]) for i in range(6)]
    rows += [(200 + i, rows[1][1].replace(rows[1][1].split()[20], f"w{i}", 1)) for i in range(6)]
    rows += [(300, None), (301, ""), (302, "   \n "), (303, "one two"), (304, "one two"), (305, sentences(9000, 5)), (306, "Straße ÉCOLE 😀 naïve mots ici et là 😀 fin")]
    rows += [(400, sentences(50, 9)), (400, sentences(50, 9)), (None, sentences(30, 11))]
    return rows
