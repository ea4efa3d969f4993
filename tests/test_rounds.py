"""Rounds of a token are held as arrays of many, not as a row of state for each."""

import numpy as np

from tests.test_stream_state import drained
from tidemark.streaming import jobs, keyed


def test_rounds_of_a_batch_are_one_piece(spark, tmp_path):
    at, path = str(tmp_path / "c"), lambda name: str(tmp_path / name)
    spark.range(500).selectExpr("'t' AS token", "id AS updatedAt", "CAST(id AS string) AS answer", "0 AS decimals").coalesce(1).write.parquet(path("rounds"))
    spark.range(1).selectExpr("'t' AS token", "10000L AS at").write.parquet(path("asked"))
    read = lambda name: jobs.read_files(spark, path(name), spark.read.parquet(path(name)).schema)
    drained(jobs.start_append(keyed.price_stream(read("asked"), read("rounds"), lateness=9), path("out"), at, availableNow=True))
    assert spark.read.format("statestore").option("path", at).option("stateVarName", "rounds").load().count() == 1


def test_the_greatest_of_rounds_at_one_time():
    rounds = np.array([(5, 1.0, True), (3, 0.0, False), (5, 2.0, True), (3, -4.0, True), (7, 0.0, False)], keyed._ROUND)
    assert keyed._greatest(rounds).tolist() == [(3, -4.0, True), (5, 2.0, True), (7, 0.0, False)]
