import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def make_docs(spark):
    """A documents table from (doc_id, text[, source]) rows, with further columns that are named like results."""

    def make(rows, extra=("score", "n_words", "kept", "piece", "component_id", "k", "line", "gone")):
        full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or ""), *[7] * len(extra)) for r in rows]
        return spark.createDataFrame(full, COLUMNS + "".join(f", {c} int" for c in extra))

    return make
