"""The daily chain: a snapshot becomes clean prices and rejections, these the gold tables, these the alert report."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import CleanConfig, transform_prices
from ..schemas import CLEAN_PRICES
from ..sources import tables
from . import gold


def run_daily(raw: DataFrame, base: str, run_date: date, ingested_at: datetime, config: CleanConfig | None = None, order: list[Column] | None = None, **gold_options) -> dict[str, int]:
    """Bring ``base`` up to date with a day's snapshot; the rows written to each table.

    Clean prices are merged by id into ``prices``, which is kept in partitions by run, rejections go to the day's archive, and each gold
    table is made anew from all prices. Running a day again changes nothing. The snapshot is read once for the prices and once for the
    rejections; what follows reads the written tables.
    """
    spark = raw.sparkSession
    clean, rejected, _ = transform_prices(raw, run_date, ingested_at, config, order)
    counts = {"prices": tables.upsert(f"{base}/prices", clean, ["id"], partition_col="pipeline_run_date")}
    counts["rejections"] = spark.read.parquet(tables.write_archive(rejected, f"{base}/rejections", run_date)).count()
    prices = spark.read.parquet(f"{base}/prices")
    counts |= tables.refresh(gold.gold_tables(prices, run_date, **gold_options), f"{base}/gold")
    made = {name: spark.read.parquet(f"{base}/gold/{name}") for name in ("product_rankings", "price_anomalies")}
    tables.write_report(gold.alert_report(made["product_rankings"], made["price_anomalies"], run_date), f"{base}/alerts", run_date)
    return counts


def run_day(raw: DataFrame, base: str, run_date: date, ingested_at: datetime, config: CleanConfig | None = None, order: list[Column] | None = None, min_obs: int = 3, exact: bool = False, **windows) -> list[date]:
    """Bring ``base`` up to date with a day's snapshot by change; the weeks that it changed.

    Clean prices lie by week, and weekly states beside them. A day rewrites the weeks that hold one of its prices, or held one before, reads
    only those to renew their states, and makes the gold tables from the states. The result is that of a rebuild from all prices.
    """
    spark = raw.sparkSession
    clean, rejected, _ = transform_prices(raw, run_date, ingested_at, config, order)
    weeks: list = []
    tables.upsert(f"{base}/prices", clean, ["id"], partition_col="week_start_date", changed=weeks)
    tables.write_archive(rejected, f"{base}/rejections", run_date)
    known = sorted(w for w in weeks if w is not None)
    if known:
        touched = spark.read.schema(CLEAN_PRICES).parquet(f"{base}/prices").where(F.col("week_start_date").isin(known))
        fresh = gold.weekly_states(touched, min_obs, exact)
        for name, state in fresh.items():
            tables.replace_partitions(f"{base}/{name}", state, "week_start_date", known)
        states = {name: tables.read_or_empty(spark, f"{base}/{name}", state.schema) for name, state in fresh.items()}
        tables.refresh(gold.gold_of_weeks(states, run_date, **windows), f"{base}/gold")
    return known


def follow(spark: SparkSession, archive: str, base: str, schema, ingested_at: datetime, done: list | None = None, **options) -> StreamingQuery:
    """Take in every day that the archive (partitions dt=day) has got since the last call, each with ``run_day``, and end.

    ``done`` gets (day, changed weeks). A batch that runs again after a failure has the same result.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        # Days are partitions, so each is read from its own files, and the batch is held nowhere.
        for day in sorted(r["dt"] for r in df.select("dt").distinct().collect()):
            weeks = run_day(df.where(F.col("dt") == F.lit(day)).drop("dt"), base, day, ingested_at, **options)
            if done is not None:
                done.append((day, weeks))

    days = spark.readStream.schema(schema.add("dt", "date") if "dt" not in schema.names else schema).option("basePath", archive).parquet(archive)
    return days.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint").trigger(availableNow=True).start()
