import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, `rank` string"


@pytest.fixture
def docs_of(spark):
    """Makes a documents table, with columns whose names operators use themselves."""

    def make(rows, sources=("a",)):
        full = [(i, t, "en", sources[k % len(sources)], None if t is None else len(t), 1, "x") for k, (i, t) in enumerate(rows)]
        return spark.createDataFrame(full, DOCS).repartition(3)

    return make


@pytest.fixture
def sf_dir(spark, tmp_path):
    """Writes tables as files of a data folder."""

    def write(**tables):
        for name, df in tables.items():
            df.write.parquet(str(tmp_path / f"{name}.parquet"))
        return str(tmp_path)

    return write
