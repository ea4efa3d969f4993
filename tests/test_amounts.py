"""Numbers are made and parsed once, and signs are read off the padded form."""

from pyspark.sql import functions as F

from tests.test_engine import events, swap
from tidemark.functions import bigint
from tidemark.plans import boundary

TEXTS = ["0", "-0", "", None, "1.5", " 7\n", "-12", "+3", "٣", "-" + "9" * 120, "0" * 120, "1" + "0" * 95]


def test_a_text_is_made_once_for_all_its_uses(spark):
    plan = boundary.parse_amounts(events(spark, swap()))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("repeat(") == 1


def test_the_sign_of_a_padded_number(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").withColumn("p", bigint.padded(F.col("t")))
    for r in rows.select("t", bigint.sign_of("p").alias("got"), bigint.signum(F.col("t")).alias("want")).collect():
        assert r.got == r.want, r.t
