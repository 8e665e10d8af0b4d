"""Documents with the cases that every operator must stand."""

from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """Rows (doc_id, text[, lang[, source]]) as a documents frame."""

    def frame(rows):
        full = [(*r, *([None] * (4 - len(r))))[:4] for r in rows]
        return spark.createDataFrame([(i, t, lang, src, None if t is None else len(t)) for i, t, lang, src in full], SCHEMA)

    return frame


@pytest.fixture(scope="session")
def hard(make):
    """Nulls, empty and blank texts, ties, repeated rows, null ids, a long text, letters beyond ASCII."""
    long = " ".join(f"w{i % 977} tail{i}" for i in range(12_000))
    same = "the very same words stand here in this text more than once\nwith a second line\nand a third line\nand a fourth line"
    rows = [
        (1, same, "en", "a"), (2, same, "en", "a"), (3, same + " ", None, None), (4, None, "en", "b"), (5, "", "en", "b"), (6, " \t\r\n ", "en", ""), (7, "one", "en", "b"),
        (8, long, "en", "a"), (9, long + " end", "en", "c"), (10, "Été à la plage où ça va bien", "fr", "c"), (10, "Été à la plage où ça va bien", "fr", "c"), (11, "12 34 !!", "de", "b"),
        (None, same, "en", "a"), (None, None, None, None), (12, "A b C d", "en", "d"), (13, same.replace("very", "extremely"), "en", "a"),
    ]
    return make(rows)


@pytest.fixture(scope="session")
def none(make):
    return make([])
