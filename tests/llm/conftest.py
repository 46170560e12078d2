import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, words int, row_key long, _d int, h int"


@pytest.fixture(scope="session")
def documents(spark):
    """(doc_id, text) pairs, or (doc_id, text, lang), as a table with columns that clash with the operators' own."""

    def make(rows):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1] or ""), 1, 2, 3, 4) for r in rows]
        return spark.createDataFrame(full, DOCUMENTS)

    return make
