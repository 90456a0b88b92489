"""Weekly aggregates, indices, rankings, anomalies and alert reports over clean prices.

Weeks are chosen by ``week_start_date >= run_date - 7 * weeks``; ``weeks=None`` takes all. Since a week's Monday is never after
its dates, the same bound on ``price_date`` is implied and added, so that a table partitioned by day is pruned.
``exact`` chooses the exact lower median over the mergeable approximate one.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


BRAND_KEYS, PRODUCT_KEYS, SERIES_KEYS = ("store_brand_normalized", "country_code"), ("product_code",), ("product_code", "store_brand_normalized")


def window_start(run_date: date, weeks: int) -> date:
    return run_date - timedelta(days=7 * weeks)


def gold_source(prices: DataFrame, keys: list[str], run_date: date | None = None, weeks: int | None = None) -> DataFrame:
    """The rows that aggregates count: in the window, keys not null, not flagged as outliers (an unknown flag counts as none)."""
    rows = prices
    if weeks is not None:
        start = F.lit(window_start(run_date, weeks))
        rows = rows.where(F.col("week_start_date") >= start)
        if "price_date" in prices.columns:
            rows = rows.where(F.col("price_date") >= start)
    for key in keys:
        rows = rows.where(F.col(key).isNotNull())
    return rows.where(~F.coalesce(F.col("iqr_outlier"), F.lit(False))) if "iqr_outlier" in prices.columns else rows


def median(value: str, exact: bool = False) -> Column:
    """An observed median: the lower of two middle values."""
    return F.expr(f"percentile_disc(0.5) WITHIN GROUP (ORDER BY {value})") if exact else F.percentile_approx(value, 0.5, 10000)


def weekly_medians(prices: DataFrame, keys: list[str], run_date=None, weeks=None, min_obs: int = 3, exact: bool = False) -> DataFrame:
    """week_start_date, the keys, observations, avg_price_eur and median_price_eur, for groups of at least ``min_obs`` rows."""
    rows = gold_source(prices, ["week_start_date", *keys], run_date, weeks)
    return (
        rows.groupBy("week_start_date", *keys)
        .agg(F.count("*").alias("observations"), F.avg("price_eur").alias("avg_price_eur"), median("price_eur", exact).alias("median_price_eur"))
        .where(F.col("observations") >= min_obs)
    )


def brand_week_aggregates(prices: DataFrame, run_date: date | None = None, weeks: int | None = 12, min_obs: int = 3, exact: bool = False) -> DataFrame:
    """Observations, mean and median by week, brand and country."""
    return weekly_medians(prices, list(BRAND_KEYS), run_date, weeks, min_obs, exact)


def index_on_base(medians: DataFrame, keys: list[str], value: str = "median_price_eur") -> DataFrame:
    """``medians`` with base_price, the value of the first week of its keys, and index_value; null on a base of zero."""
    first = F.first(value).over(Window.partitionBy(*keys).orderBy("week_start_date"))
    return medians.withColumn("base_price", first).withColumn("index_value", F.try_divide(F.col(value), F.col("base_price")) * 100)


def brand_week_index(prices: DataFrame, run_date: date | None = None, weeks: int | None = 12, min_obs: int = 3, exact: bool = False) -> DataFrame:
    """Weekly medians of a brand and country, on the base of its first week in the window."""
    return index_of(brand_week_aggregates(prices, run_date, weeks, min_obs, exact))


def index_of(aggregates: DataFrame) -> DataFrame:
    return index_on_base(aggregates.drop("avg_price_eur"), list(BRAND_KEYS))


def product_rankings(
    prices: DataFrame, run_date: date | None = None, weeks: int | None = 8, min_obs: int = 3, top_n: int | None = 500, exact: bool = False
) -> DataFrame:
    """The largest relative changes of a product's weekly median against the week before that was observed.

    Over all weeks of the window; ties by week, then product. ``top_n=None`` gives all changes, in no order.
    """
    return ranked_moves(weekly_medians(prices, list(PRODUCT_KEYS), run_date, weeks, min_obs, exact), top_n)


def ranked_moves(medians: DataFrame, top_n: int | None = 500) -> DataFrame:
    """The changes of weekly medians of products, the largest first; all of them in no order without ``top_n``."""
    before = F.lag("median_price_eur").over(Window.partitionBy("product_code").orderBy("week_start_date"))
    moves = (
        medians.withColumn("prev_median", before)
        .where("prev_median > 0")
        .select(
            F.col("week_start_date").alias("reference_week"), "product_code", "prev_median", F.col("median_price_eur").alias("curr_median"),
            ((F.col("median_price_eur") - F.col("prev_median")) / F.col("prev_median")).alias("pct_change"), "observations",
        )
    )
    return moves if top_n is None else moves.orderBy(F.desc("pct_change"), "reference_week", "product_code").limit(top_n)


def price_anomalies(
    prices: DataFrame, run_date: date | None = None, weeks: int | None = 8, min_obs: int = 3, z: float = 3.0, exact: bool = False, keys: tuple[str, ...] = ("product_code", "store_brand_normalized")
) -> DataFrame:
    """Weekly medians at least ``z`` standard deviations (of the population) from the mean of their series.

    A score over n weeks can't exceed sqrt(n - 1), so with 8 weeks a threshold of 3 finds nothing.
    """
    return scored_series(weekly_medians(prices, list(keys), run_date, weeks, min_obs, exact), z, keys)


def scored_series(medians: DataFrame, z: float = 3.0, keys: tuple[str, ...] = ("product_code", "store_brand_normalized")) -> DataFrame:
    """Weekly medians that lie ``z`` standard deviations or more from the mean of their series."""
    series = Window.partitionBy(*keys)
    scored = medians.drop("avg_price_eur").withColumns({"mean_med": F.avg("median_price_eur").over(series), "std_med": F.stddev_pop("median_price_eur").over(series)})
    return scored.where("std_med > 0").withColumn("z_score", (F.col("median_price_eur") - F.col("mean_med")) / F.col("std_med")).where(F.abs("z_score") >= z)


def top_rankings(rankings: DataFrame, run_date: date, lookback: int = 2, min_pct: float = 0.05, n: int = 50) -> DataFrame:
    """The largest increases of at least ``min_pct`` in the last weeks."""
    recent = rankings.where((F.col("reference_week") >= F.lit(window_start(run_date, lookback))) & (F.col("pct_change") >= min_pct))
    return recent.orderBy(F.desc("pct_change"), "reference_week", "product_code").limit(n)


def top_anomalies(anomalies: DataFrame, run_date: date, lookback: int = 2, n: int = 100) -> DataFrame:
    """The anomalies of the last weeks that lie farthest out."""
    recent = anomalies.where(F.col("week_start_date") >= F.lit(window_start(run_date, lookback)))
    ties = [c for c in ("product_code", "store_brand_normalized") if c in anomalies.columns]
    return recent.orderBy(F.abs("z_score").desc(), "week_start_date", *ties).limit(n)


def alert_report(rankings: DataFrame, anomalies: DataFrame, run_date: date, lookback: int = 2, min_pct: float = 0.05, n_rankings: int = 50, n_anomalies: int = 100) -> DataFrame:
    """One row with the report as JSON: run date, counts by section, and both lists in order. Lists are bounded by their limits."""
    def listed(df: DataFrame, name: str, order: list[Column]) -> DataFrame:
        ranked = df.withColumn("__nr", F.row_number().over(Window.orderBy(*order)))
        body = F.transform(F.array_sort(F.collect_list(F.struct("__nr", F.struct(*df.columns).alias("row")))), lambda x: x["row"])
        return ranked.agg(body.alias(name))

    ups = listed(top_rankings(rankings, run_date, lookback, min_pct, n_rankings), "rankings", [F.desc("pct_change"), F.col("reference_week"), F.col("product_code")])
    odd = listed(top_anomalies(anomalies, run_date, lookback, n_anomalies), "anomalies", [F.abs("z_score").desc(), F.col("week_start_date"), F.col("product_code")])
    report = F.struct(
        F.lit(str(run_date)).alias("run_date"), F.struct(F.size("rankings").alias("rankings"), F.size("anomalies").alias("anomalies")).alias("counts"), "rankings", "anomalies"
    )
    return ups.crossJoin(odd).select(F.to_json(report, {"ignoreNullFields": "false"}).alias("report"))


def gold_tables(prices: DataFrame, run_date: date, **more) -> dict[str, DataFrame]:
    """The four tables by name, in the order in which they are refreshed."""
    return {
        "brand_week_aggregates": brand_week_aggregates(prices, run_date, **more),
        "brand_week_index": brand_week_index(prices, run_date, **more),
        "product_rankings": product_rankings(prices, run_date, **more),
        "price_anomalies": price_anomalies(prices, run_date, **more),
    }


#: Weekly states that are kept by week, with their keys: all gold tables follow from them.
WEEKLY = {"weekly_brands": BRAND_KEYS, "weekly_products": PRODUCT_KEYS, "weekly_series": SERIES_KEYS}


def weekly_states(prices: DataFrame, min_obs: int = 3, exact: bool = False) -> dict[str, DataFrame]:
    """Observations, mean and median of each week by the three sets of keys."""
    return {name: weekly_medians(prices, list(keys), min_obs=min_obs, exact=exact) for name, keys in WEEKLY.items()}


def gold_of_weeks(states: dict[str, DataFrame], run_date: date, weeks: int | None = 12, recent: int | None = 8, top_n: int | None = 500, z: float = 3.0) -> dict[str, DataFrame]:
    """The four gold tables from weekly states: what ``gold_tables`` makes of the prices themselves."""

    def since(name: str, n: int | None) -> DataFrame:
        return states[name] if n is None else states[name].where(F.col("week_start_date") >= F.lit(window_start(run_date, n)))

    return {
        "brand_week_aggregates": since("weekly_brands", weeks),
        "brand_week_index": index_of(since("weekly_brands", weeks)),
        "product_rankings": ranked_moves(since("weekly_products", recent), top_n),
        "price_anomalies": scored_series(since("weekly_series", recent), z),
    }
