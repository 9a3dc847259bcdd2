import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tilewright.llm.common import on_workers

#: Columns a table may bring along that are named like inner columns of the operators.
CLASHING = ("node", "key", "size", "score", "predicted", "candidates", "words", "n", "row", "tree", "digest", "label", "place", "text_sha256")


@pytest.fixture(autouse=True)
def package_on_workers(spark):
    on_workers(spark)


@pytest.fixture(scope="session")
def table(spark):
    """Rows of an id and strings as a DataFrame over several partitions, with clashing extra columns."""

    def make(rows, *names, extra=CLASHING):
        fields = [StructField(names[0], LongType())] + [StructField(n, StringType()) for n in names[1:]]
        df = spark.createDataFrame(rows, StructType(fields)).repartition(3)
        return df.withColumns({c: F.lit(None).cast("string") for c in extra if c not in names})

    return make
