"""Small tables for the operator tests."""

import pytest

SF_SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def docs_of(spark):
    """DataFrame (doc_id, text, ...) from a list of texts or of (id, text) pairs, with
    clashing extra columns."""
    def make(texts, extra=True):
        rows = [t if isinstance(t, tuple) else (i, t) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string")
        if extra:  # names that the operators use for their own results and steps
            from pyspark.sql import functions as F
            df = df.withColumns({c: F.lit("x") for c in ("id", "n_words", "score", "kept", "rate", "labels", "host", "a",
                                                         "word", "block", "lang", "n_pii", "n_tokens", "class_id", "rank")})
        return df
    return make
