from pyspark.sql import functions as F

from workload.inputs import fill, spread


def test_fill_puts_values_in_and_is_null_if_any_value_is(spark):
    rows = spark.createDataFrame([(1, "x"), (2, None)], "a INT, b STRING").select(
        "a", fill("@A@-@B@-@A@ @C@", A=F.col("a"), B=F.col("b")).alias("used"), fill("-@A@", A=F.col("a"), B=F.col("b")).alias("unused")
    )
    assert [tuple(r) for r in rows.orderBy("a").collect()] == [(1, "1-x-1 @C@", "-1"), (2, None, None)]


def test_spread_bounds_the_rows_of_a_task(spark, tmp_path):
    spark.range(3_000).coalesce(1).write.parquet(f"{tmp_path}/t")
    rows = spread(spark.read.parquet(f"{tmp_path}/t"), 100)
    sizes = rows.groupBy(F.spark_partition_id()).count()
    assert rows.count() == 3_000 and sizes.agg(F.max("count")).first()[0] <= 200
