"""Views that serve readers: brand statistics, enriched rankings, a hall of shame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .gold import median


def rankings_view(rankings: DataFrame, catalogue: DataFrame, limit: int = 20) -> DataFrame:
    """The largest increases with the product's name and brand, prices, sample size and ISO week; ``pct_change`` is a fraction."""
    names = catalogue.select(F.col("ean").alias("product_code"), "produit_nom", "brand")
    label = F.format_string("%d-W%02d", F.extract(F.lit("YEAROFWEEK"), "reference_week"), F.weekofyear("reference_week"))
    best = rankings.orderBy(F.desc("pct_change"), "reference_week", "product_code").limit(min(limit, 100))
    return best.join(names, "product_code", "left").select(
        F.col("product_code").alias("ean"), "produit_nom", "brand", "pct_change", F.col("curr_median").alias("price_eur_current"), F.col("prev_median").alias("price_eur_previous"),
        F.col("observations").alias("sample_size"), label.alias("period"),
    )


def hall_of_shame(moves: DataFrame, limit: int = 20) -> DataFrame:
    """Increases weighted by how often the product was seen that week: shame_score = pct_change * ln(1 + observations)."""
    scored = moves.where("pct_change > 0").withColumn("shame_score", F.col("pct_change") * F.log1p("observations"))
    return scored.orderBy(F.desc("shame_score"), "reference_week", "product_code").limit(min(limit, 100))


def brand_stats(catalogue: DataFrame, prices: DataFrame, moves: DataFrame, top: int = 5, exact: bool = False) -> DataFrame:
    """For each catalogue brand, in any case: product_count, avg_price_eur over unflagged prices, median_pct_change, and its largest increases.

    Only rows flagged as no outlier count; an unknown flag doesn't.
    """
    cat = catalogue.where("brand is not null").select(F.lower("brand").alias("brand"), "ean").distinct()
    # Prices are brought together by product before they meet the catalogue.
    sums = prices.where(F.col("iqr_outlier") == F.lit(False)).groupBy(F.col("product_code").alias("ean")).agg(F.sum("price_eur").alias("s"), F.count("price_eur").alias("n"))
    stats = cat.join(sums, "ean", "left").groupBy("brand").agg(F.countDistinct("ean").alias("product_count"), F.try_divide(F.sum("s"), F.sum("n")).alias("avg_price_eur"))
    mine = moves.withColumnRenamed("product_code", "ean").join(cat, "ean")
    changes = mine.groupBy("brand").agg(median("pct_change", exact).alias("median_pct_change"))
    rank = F.row_number().over(Window.partitionBy("brand").orderBy(F.desc("pct_change"), "reference_week", "ean"))
    listed = F.array_sort(F.collect_list(F.struct("rank", "ean", "pct_change", F.col("curr_median").alias("price_eur_current"), F.col("prev_median").alias("price_eur_previous"))))
    best = mine.withColumn("rank", rank).where(F.col("rank") <= top).groupBy("brand").agg(listed.alias("top_increases"))
    return stats.join(changes, "brand", "left").join(best, "brand", "left")
