from __future__ import annotations

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, n long, key long, start long"


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with further columns whose names clash with those the operators use inside."""

    def make(*rows):
        full = [(i, t, "en", "src", None if t is None else len(t), 1, 2, 3) for i, t in rows]
        return spark.createDataFrame(full, SCHEMA)

    return make


