import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parents[1]))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def documents(spark):
    """Documents out of (id, text) pairs, with columns whose names the operators use themselves."""

    def make(rows, lang="en", source="s"):
        full = [(i, t, lang, source, None if t is None else len(t), True, -1, "x", 7) for i, t in rows]
        return spark.createDataFrame(full, DOCUMENTS + ", kept boolean, n_words long, component string, taken int")

    return make
