import pytest

from lorekeep.llm import common


def test_sample_by_hash_is_fixed_and_bounded(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    got = {r["k"] for r in common.least_by_hash(df, "k", 300).collect()}
    want = {r["k"] for r in df.selectExpr("k", "xxhash64(k) as h").orderBy("h", "k").limit(300).collect()}
    assert got == want
    assert common.least_by_hash(df.limit(40), "k", 300).count() == 40 and common.least_by_hash(df.limit(0), "k", 3).count() == 0


def test_settled_tables_go_when_released(spark):
    df = common.settle(spark.range(3), "x")
    assert df.count() == 3
    common.release(df, spark.range(2))
    with pytest.raises(Exception, match="(?i)not.exist|not.found"):
        df.count()


def test_arrow_batches_are_bounded_and_lower_settings_stay(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        common.arrow_rows(spark)
        assert spark.conf.get(key) == str(common.ARROW_ROWS)
        spark.conf.set(key, "7")
        common.arrow_rows(spark)
        assert spark.conf.get(key) == "7"
    finally:
        spark.conf.set(key, before)
