import pytest


@pytest.fixture
def docs(spark):
    def make(texts, extra=False):
        rows = [(i, t, "src0", i) for i, t in enumerate(texts)]
        df = spark.createDataFrame(rows, "doc_id long, text string, source string, keys long")
        return df.withColumnRenamed("keys", "uid") if extra else df.drop("keys")

    return make
