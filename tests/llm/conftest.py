import pytest
from pyspark.sql import types as T

DOCS = "doc_id long, text string, lang string, source string, n_chars long, `_wcounts` string, fp string"


@pytest.fixture(scope="session")
def shared(spark, tmp_path_factory):
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    return spark


@pytest.fixture(scope="session")
def docs_of(shared):
    """A documents table with extra columns, from pairs of id and text."""

    def make(rows):
        full = [(k, t, "en", None, len(t or ""), "x", "y") for k, t in rows]
        return shared.createDataFrame(full, T._parse_datatype_string(DOCS))

    return make
