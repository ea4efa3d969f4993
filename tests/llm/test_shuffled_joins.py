"""Tables that grow with the corpus are not gathered by the driver."""

from pyspark.sql import functions as F

from tidemark.llm import simhash


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_neighbours_of_fingerprints_are_not_broadcast(spark, tmp_path):
    """65 rows are made of each fingerprint, of which Spark knows only the size of the fingerprints."""
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    fps = spark.read.parquet(str(tmp_path / "fps"))
    places = fps.select("fp", F.explode(simhash.ball(F.col("fp"))).alias("place"))
    assert "Broadcast" in plan_of(places.join(fps.withColumnRenamed("fp", "place"), "place"))  # what Spark does by itself
    for links in (simhash.close_links(fps), simhash.stars(fps.select(F.lit(1).alias("a"), F.col("fp").alias("b")))):
        assert "SortMergeJoin" in plan_of(links)
        assert "Broadcast" not in plan_of(links)
