from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns whose names the operators use inside.
CLASHES = ", _doc string, row long, key string, size long, score double, copies long, node long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents from {doc_id: text} pairs, with null and clashing extra columns on request."""

    def make(rows, clash=False):
        data = []
        for i, (doc_id, text) in enumerate(rows):
            row = (doc_id, text, None if i % 5 == 0 else "en", None if i % 7 == 3 else f"src{i % 3}", None if text is None else len(text))
            data.append(row + ("x", 1, "k", 2, 0.5, 3, 4) * clash)
        return spark.createDataFrame(data, SCHEMA + CLASHES * clash)

    return make


@pytest.fixture(scope="session")
def corpus():
    """Invented texts with exact and near copies, shared passages, repeats, and the awkward cases."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(400)]
    line = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = line(40), "\n".join(line(rng.randint(8, 20)) for _ in range(6))
    rows = []
    for i in range(60):
        text = "\n".join(line(rng.randint(3, 25)) for _ in range(rng.randint(1, 6)))
        if i % 6 == 0:
            text = base if i % 12 == 0 else base.replace(base.split()[i], "changed")
        if i % 9 == 0:
            text += "\n" + passage + " " + line(5)
        rows.append((i * 3, text))
    rows += [(500, None), (501, ""), (502, "  \n\t "), (503, "One"), (504, "One"), (505, "a b c d"), (506, "A B c d"), (507, "é" * 40 + " x"), (508, line(4000)), (None, base), (509, base), (509, base)]
    return rows
