import os

import pytest

DATA = "/root/testdata/sf0.001"

needs_tables = pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the given tables")


@pytest.fixture
def texts(spark):
    """Build a documents table; rows are (doc_id, text) or (doc_id, text, lang, source)."""

    def build(*rows, extra=""):
        full = [(*r, *(None,) * (4 - len(r))) for r in rows]
        df = spark.createDataFrame(full, "doc_id bigint, text string, lang string, source string")
        df = df.selectExpr("*", "CAST(length(text) AS INT) AS n_chars")
        return df.selectExpr("*", extra) if extra else df

    return build
