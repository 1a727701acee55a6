import pytest


@pytest.fixture(scope="session")
def docs(spark):
    """Makes a documents table from (doc_id, text[, source]) rows; extra columns clash with operators' own names."""
    def make(rows, **extra):
        rows = [(*r, "s")[:3] for r in rows]
        names = ["row", "key1", "__text", "kept", "id"]
        data = [(*r, "en", len(r[1] or ""), *[i] * len(names)) for i, r in enumerate(rows)]
        schema = ("doc_id long, text string, source string, lang string, n_chars long, "
                  + ", ".join(f"`{n}` long" for n in names))
        return spark.createDataFrame(data, schema)
    return make
