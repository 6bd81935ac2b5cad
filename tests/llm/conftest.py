from __future__ import annotations

import pytest
from helpers import prose


DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, sig string, n long, token long, kind string, doc long"


@pytest.fixture
def documents(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", "src0", len(t or ""), "x", 1, 2, "k", 3) for i, t in rows], DOCUMENTS)

    return make


@pytest.fixture
def awkward():
    """Nulls, empty and white texts, ties, repeated rows, near copies and a very long text."""
    base = prose(1, 60)
    near = base.replace(base.split()[30], "changed", 1)
    long = prose(2, 30_000)
    return [(1, base), (2, base), (3, near), (4, None), (5, ""), (6, " \n\t "), (7, "one two"), (8, "One TWO"), (9, long), (9, long), (10, long + " tail"), (None, base), (11, prose(3, 80)), (12, "ÀÉ ünï " * 40)]
