from conftest import rows
from pyspark.sql import functions as F

from pricelens import queries as Q
from pricelens.operators import cleaning
from pricelens.plans import daily, gold

SF = "/root/testdata/sf0.001"


def test_five_days_by_change_equal_a_rebuild(spark, tmp_path):
    """Each day touches its own weeks only, an empty delivery touches none, and all tables are those of a rebuild."""
    raw, base = Q.raw_snapshot(spark, SF), str(tmp_path / "out")
    number = F.crc32(F.col("id")) % 40
    raw = raw.withColumns({"date": F.date_sub(F.lit(Q.LAST), number.cast("int")), "dt": F.date_add(F.lit(Q.LAST), F.floor(number / 8).cast("int"))})
    raw.write.partitionBy("dt").parquet(str(tmp_path / "archive"))
    more = {"config": cleaning.CleanConfig(reference_date=Q.LAST), "order": [F.col("seen")], "min_obs": 2, "exact": True, "weeks": None, "recent": None, "top_n": None, "z": 1.0}
    done: list = []
    for _ in range(2):
        daily.follow(spark, str(tmp_path / "archive"), base, raw.drop("dt").schema, Q.AT, done, **more).awaitTermination()
    assert len(done) == 5 and all(1 <= len(weeks) <= 3 for _, weeks in done)
    prices = spark.read.parquet(f"{base}/prices")
    whole = gold.gold_of_weeks(gold.weekly_states(prices, 2, True), Q.LAST, weeks=None, recent=None, top_n=None, z=1.0)
    for name, made in whole.items():
        kept = spark.read.schema(made.schema).parquet(f"{base}/gold/{name}")
        digits = [F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in made.dtypes]
        assert rows(kept.select(*digits)) == rows(made.select(*digits)) and kept.count() > 0


def test_a_batch_of_days_is_held_nowhere(spark, tmp_path, monkeypatch):
    """Each day is read from its own files: the days of a batch are not kept in memory or on local disks."""

    def held(df, *level):
        raise AssertionError("a batch is held")

    raw = Q.raw_snapshot(spark, SF).where("seen.l_partkey < 20").withColumn("dt", F.lit(Q.LAST))
    raw.write.partitionBy("dt").parquet(str(tmp_path / "archive"))
    monkeypatch.setattr(type(raw), "persist", held)
    done: list = []
    more = {"config": cleaning.CleanConfig(reference_date=Q.LAST), "order": [F.col("seen")], "weeks": None, "recent": None, "top_n": None}
    daily.follow(spark, str(tmp_path / "archive"), str(tmp_path / "out"), raw.drop("dt").schema, Q.AT, done, **more).awaitTermination()
    assert [day for day, _ in done] == [Q.LAST] and spark.read.parquet(str(tmp_path / "out/prices")).count() > 0
