import pytest
from pyspark.sql import functions as F
from samples import SCHEMA, cases


@pytest.fixture(scope="session")
def docs(spark):
    """The cases, with extra columns whose names operators use inside."""
    frame = spark.createDataFrame(cases(), SCHEMA)
    return frame.select("*", F.lit(1).alias("score"), F.lit("z").alias("kept"), F.lit(2).alias("key"), F.lit(3).alias("bucket"), F.lit(4).alias("size"), F.lit("q").alias("lang_pred"))


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
