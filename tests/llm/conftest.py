import pytest


@pytest.fixture
def tables(spark, tmp_path):
    """Writes rows as the tables of a folder and gives its path, so that registered queries can run on them."""

    def write(**named):
        for name, (rows, schema) in named.items():
            spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{name}.parquet")
        return f"file://{tmp_path}"

    return write
