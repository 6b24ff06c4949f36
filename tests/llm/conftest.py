import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents from (id, text) or (id, text, lang, source); with a clashing extra column."""
    def build(rows):
        full = [(*r, *(("en", "s") [len(r) - 2:] if len(r) < 4 else ())) for r in rows]
        return spark.createDataFrame(
            [(*r, len(r[1]) if r[1] is not None else None, "x") for r in full], COLUMNS)

    return build
