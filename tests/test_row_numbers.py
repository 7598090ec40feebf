from pyspark.sql import functions as F

from marlcore.operators import audit as A


def test_places_of_wide_rows(spark):
    """Wide rows stay in several partitions, while their counts fit one."""
    rows = spark.range(0, 12000, 1, 4).select("id", F.transform(F.sequence(F.lit(0), F.lit(127)), lambda x: F.rand(1) + x).alias("f"))
    got = A.with_row_numbers(rows, [F.asc("id")]).toPandas().sort_values("id")
    assert got.place.tolist() == list(range(1, 12001))
