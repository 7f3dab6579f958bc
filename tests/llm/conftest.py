import pytest


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from complexa.session import ensure_checkpoint_dir, ship_package
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


@pytest.fixture(scope="session")
def documents(spark):
    """Small table of documents: rows of (doc_id, text), with columns of no use around them."""
    def make(rows):
        data = [(i, t, "en", "src", 0, 0, "rid", "unit") for i, t in rows]
        return spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long, row_no int, rid string, unit string")
    return make
