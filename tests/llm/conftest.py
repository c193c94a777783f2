import pytest


@pytest.fixture(scope="session")
def docs_folder(tmp_path_factory):
    return tmp_path_factory.mktemp("tables")


@pytest.fixture
def stored(spark, tmp_path):
    """Writes rows as a Parquet table in several files and reads it again."""

    def write(rows, schema, name="documents", files=3):
        path = str(tmp_path / f"{name}.parquet")
        spark.createDataFrame(rows, schema).repartition(files).write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    return write
