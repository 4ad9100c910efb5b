import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def stored(spark, tmp_path):
    """Rows as a stored table of documents; each call makes a new one."""
    count = iter(range(100))

    def make(rows, schema=DOCS, files=2):
        path = str(tmp_path / f"t{next(count)}")
        spark.createDataFrame(rows, schema).repartition(files).write.parquet(path)
        return spark.read.schema(schema).parquet(path)

    return make


@pytest.fixture
def docs(stored):
    """Rows from (doc_id, text) or (doc_id, text, source)."""
    return lambda rows: stored([(r[0], r[1], "en", r[2] if len(r) > 2 else "s", len(r[1] or "")) for r in rows])


ODD = [(1, None), (2, ""), (3, " \n\t "), (None, "alpha beta"), (4, "x" * 50_000), (5, "word " * 20_000), (6, "same text here"), (6, "same text here"), (7, "same text here"), (8, "ünï çödé 漢字 🙂"), (9, "a\x00b")]


@pytest.fixture
def odd_rows():
    """Nulls, empty, white, very long and repeated texts, a repeated and a null id."""
    return list(ODD)
