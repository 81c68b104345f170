import pytest

from ..conftest import spark  # noqa: F401  (the session of the other tests)

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture(scope="session")
def frame(spark):  # noqa: F811
    """documents from (doc_id, text[, lang]) tuples."""
    def make(rows, extra=""):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "src", len(r[1]) if r[1] is not None else None, *r[3:]) for r in rows]
        return spark.createDataFrame(full, SCHEMA + extra)
    return make
