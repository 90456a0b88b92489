import datetime
import json

from conftest import rows
from pyspark.sql import functions as F

from pricelens.plans import gold
from pricelens.sources import tables


def test_upsert_moves_partitions_and_repeats(spark, tmp_path):
    path = str(tmp_path / "t")
    cols = "id string, day string, v int, e string"
    assert tables.upsert(path, spark.createDataFrame([("a", "1", 1, "x"), ("b", "1", 2, "y"), ("c", "2", 3, None)], cols), ["id"], partition_col="day") == 3
    change = spark.createDataFrame([("a", "2", 9, None), ("d", "3", 4, "z")], cols)
    for _ in range(2):
        tables.upsert(path, change, ["id"], keep_if_null=("e",), partition_col="day")
        assert rows(spark.read.parquet(path).select("id", F.col("day").cast("string"), "v", "e")) == [("a", "2", 9, "x"), ("b", "1", 2, "y"), ("c", "2", 3, None), ("d", "3", 4, "z")]
    assert tables.upsert(path, change.limit(0), ["id"], partition_col="day") == 0


def test_update_columns_keep_the_rest(spark):
    target = spark.createDataFrame([(1, "a", True)], "k int, v string, flag boolean")
    source = spark.createDataFrame([(1, "b", False), (2, "c", False)], "k int, v string, flag boolean")
    assert rows(tables.merged(target, source, ["k"], update_cols=["v"])) == [(1, "b", True), (2, "c", False)]


def test_partition_replaced_by_nothing(spark, tmp_path):
    path = str(tmp_path / "p")
    df = spark.createDataFrame([(1, "x"), (2, "y")], "v int, d string")
    df.write.partitionBy("d").parquet(path)
    tables.replace_partition(path, df.limit(0), "d", "x")
    assert rows(spark.read.parquet(path).select("v")) == [(2,)]
    assert tables.read_or_empty(spark, str(tmp_path / "none"), df.schema).count() == 0


def test_gold_windows(spark):
    week = lambda k: datetime.date(2026, 1, 5) + datetime.timedelta(days=7 * k)
    data = [(week(k), "p", "b", "FR", float(10 + k), None) for k in range(12) for _ in range(3)] + [(week(0), "p", "b", "FR", 500.0, True)] + [(week(12), "p", "b", "FR", 100.0, False)] * 3
    prices = spark.createDataFrame(data, "week_start_date date, product_code string, store_brand_normalized string, country_code string, price_eur double, iqr_outlier boolean")
    index = gold.brand_week_index(prices, weeks=None).orderBy("week_start_date").collect()
    assert index[0].index_value == 100.0 and index[-1].index_value == 1000.0 and len(index) == 13
    top = gold.product_rankings(prices, weeks=None, top_n=1).first()
    assert (top.prev_median, top.curr_median) == (21.0, 100.0)
    assert [r.week_start_date for r in gold.price_anomalies(prices, weeks=None).collect()] == [week(12)]
    report = json.loads(gold.alert_report(gold.product_rankings(prices, weeks=None), gold.price_anomalies(prices, weeks=None), week(12)).first().report)
    assert report["counts"] == {"rankings": len(report["rankings"]), "anomalies": 1} and report["rankings"][0]["product_code"] == "p"


def test_upsert_holds_nothing_and_carries_over_only_what_stays(spark, tmp_path, monkeypatch):
    """The source is worked out once, into files, not held in memory or local disks; rows of partitions that it replaces whole are not shuffled."""

    def held(df, *level):
        raise AssertionError("a source as large as the table is held")

    monkeypatch.setattr(type(spark.range(1)), "persist", held)
    path, runs = str(tmp_path / "t"), spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            runs.add(batch.num_rows)
            yield batch

    first = spark.createDataFrame([(i, str(i % 2), i) for i in range(10)], "id int, day string, v int")
    tables.upsert(path, first, ["id"], partition_col="day")
    changed: list = []
    again = first.where("id % 2 = 0 or id = 1").withColumn("v", F.lit(-1)).mapInArrow(counted, first.schema)
    assert tables.upsert(path, again, ["id"], partition_col="day", changed=changed) == 6 and runs.value == 6 and sorted(map(str, changed)) == ["0", "1"]
    assert rows(spark.read.parquet(path).select("id", "v")) == sorted([(i, -1 if i % 2 == 0 or i == 1 else i) for i in range(10)], key=repr)
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_archive_of_a_single_line_shuffles_no_other(spark, monkeypatch):
    """The first archive joins one line to its order where it is; only the second deals all lines."""
    from pricelens import stored_queries

    plans, write = [], tables.write_archive

    def planned(df, *more):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, *more)

    monkeypatch.setattr(tables, "write_archive", planned)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        read = {r.what: r for r in stored_queries.snapshot_archive(spark, "/root/testdata/sf0.001").collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange hashpartitioning" not in plans[0] and plans[1].count("Exchange hashpartitioning") == 2
    assert read["read"].n == spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").count() and read["absent"].n == 0
