from pyspark.sql import functions as F

from reviewlens.functions.skew import join_counted_lookup
from reviewlens.session import stage


def _facts(spark):
    facts = spark.range(20000).select(
        F.col("id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot"))
        .when(F.col("id") % 3 == 1, F.concat(F.lit("k"), F.col("id")))
        .otherwise(F.concat(F.lit("unknown"), F.col("id") % 10))
        .alias("key"),
    )
    return stage(facts, "facts")


def _lookup(facts):
    known = facts.filter(~F.col("key").startswith("unknown"))
    counted = known.groupBy("key").agg(F.count("*").alias("rows"))
    return stage(counted.withColumn("value", F.length("key")), "lookup")


def test_hot_and_cold_keys_match_a_plain_join(spark):
    facts = _facts(spark)
    lookup = _lookup(facts)
    joined = join_counted_lookup(facts, lookup, ["key"], "value", "rows")
    plain = facts.join(lookup.select("key", "value"), "key", "left").select("key", "id", "value")
    assert joined.count() == 20000
    assert joined.select("key", "id", "value").exceptAll(plain).count() == 0


def test_only_some_lookup_rows(spark):
    facts = _facts(spark)
    lookup = _lookup(facts)
    for condition in ("value = 3", "value > 4"):
        joined = join_counted_lookup(facts, lookup, ["key"], "value", "rows", F.expr(condition))
        plain = facts.join(lookup.filter(condition).select("key", "value"), "key")
        assert joined.count() == plain.count() > 0
        assert joined.select("key", "id", "value").exceptAll(plain.select("key", "id", "value")).count() == 0


def test_empty_lookup(spark):
    facts = spark.createDataFrame([("a", 1)], "key string, id int")
    lookup = spark.createDataFrame([], "key string, rows bigint, value int")
    assert join_counted_lookup(facts, lookup, ["key"], "value", "rows").first()["value"] is None
    assert join_counted_lookup(facts, lookup, ["key"], "value", "rows", F.col("value") > 0).isEmpty()


def test_hot_rows_cross_no_shuffle(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        facts = stage(
            spark.range(9000).select(
                "id", F.when(F.col("id") % 3 > 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("key")
            ),
            "facts",
        )
        counted = facts.groupBy("key").agg(F.count("*").alias("rows"))
        lookup = stage(counted.withColumn("value", F.length("key")), "lookup")
        joined = join_counted_lookup(facts, lookup, ["key"], "value", "rows")
        assert joined.filter("value is null").isEmpty() and joined.count() == 9000
        plan = joined._jdf.queryExecution().sparkPlan().toString()
        answered, rest = plan[plan.index("BroadcastHashJoin") :].split("SortMergeJoin", 1)
        # hot facts meet a broadcast only, and are gone before the join that shuffles
        assert "Inner" in answered and "LeftAnti" not in answered
        assert "LeftAnti" in rest and rest.count("SortMergeJoin") == 0
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
