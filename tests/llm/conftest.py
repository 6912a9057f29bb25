"""Fixtures of the training-data operators' tests."""

import pytest


@pytest.fixture(scope="session")
def llm(spark):
    from demandlens.llm.registry import importable
    return importable(spark)


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs_of(llm):
    """A documents table of (doc_id, text) rows, with columns that clash with
    names the operators use themselves."""
    from pyspark.sql import functions as F

    def make(rows, parts=3):
        full = [(i, t, "en", "src", len(t or "")) for i, t in rows]
        df = llm.createDataFrame(full, DOCS).repartition(parts)
        clash = ("n_words", "score", "kept", "component_id", "node", "sig", "bucket", "runs", "spans", "items", "drop", "row", "pos")
        return df.withColumns({c: F.lit("clash") for c in clash})
    return make
