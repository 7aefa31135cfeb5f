import re

from pyspark.sql import functions as F

from factgraph.operators import integrity
from factgraph.plans.model import Ledger
from factgraph.plans.star import Star

DATA = "/root/testdata/sf0.001"


def test_only_numbers_are_told_apart(spark):
    star = Star(spark, DATA)
    for df in (star.relationships(), star.evidence()):
        keys = re.findall(r"Aggregate \[([^\]]*)\]", df._jdf.queryExecution().optimizedPlan().toString())
        assert any("code" in k for k in keys) and not any("type" in k or "locator" in k for k in keys)


def test_rows_of_good_references_stay(spark):
    ledger = Ledger.empty(spark)
    ledger.assets = spark.range(100).select("id", F.lit(0).cast("long").alias("source_id"))
    ledger.relationships = spark.createDataFrame([(1, 5, 7), (2, 5, 200), (3, None, 200), (4, 300, 7)], "id long, from_id long, to_id long")
    found = integrity.foreign_key_violations(ledger, "relationships")
    assert sorted(map(tuple, found.collect())) == [("relationships", "from_id", 300), ("relationships", "to_id", 200), ("relationships", "to_id", 200)]
