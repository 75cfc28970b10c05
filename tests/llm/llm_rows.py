import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"


def rows_of(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=repr)


@pytest.fixture
def docs_table(spark):
    """(rows -> DataFrame) with extra columns whose names operators also use inside."""

    def make(rows, id="doc_id", parts=3):
        schema = T.StructType([T.StructField(id, T.LongType()), T.StructField("text", T.StringType()), *[T.StructField(c, T.StringType()) for c in ("__row", "__text", "print", "words", "n_words", "a")]])
        return spark.createDataFrame([(*r, "r", "t", "p", "w", "n", None) for r in rows], schema).repartition(parts)

    return make
