from pyspark.sql import functions as F

from locusforge.streaming import arrivals
from tests import fixtures as fx


def test_arriving_studies_are_checked_and_deduplicated(spark, tmp_path):
    cols = [c.split()[0] for c in arrivals.SCHEMA.split(", ")]
    data = fx.rows(30)
    data[3] = [4, *data[0][1:]]
    data[5][8] = 0.0
    rows = fx.frame(spark, data).withColumn("study", F.lit("a")).withColumn("arrived", F.lit("2024-01-01").cast("timestamp")).select(*cols)
    rows.write.parquet(f"{tmp_path}/in/1")
    rows.withColumn("study", F.lit("b")).write.parquet(f"{tmp_path}/in/2")
    for _ in range(2):  # a second run has nothing left to do
        arrivals.follow(spark, f"{tmp_path}/in/*", f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
        got = spark.read.parquet(f"{tmp_path}/out").groupBy("study").count().collect()
        assert {r.study: r["count"] for r in got} == {"a": 28, "b": 28}
