"""Registered queries over the given tables, each with the SQL that must give the same rows.

``PRICE_OBS`` reads the order lines as price observations. Averages, ratios and deviations are rounded on both sides by
``floor(x * 1e6 + 0.4999) / 1e6``; medians and lags are observed values and stay as they are.
"""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import products as P
from .functions import scalars as S
from .operators import baskets, catalogue, cleaning, grams, receipts, similarity
from .plans import gold, serving
from .streaming import events

RUN = date(2001, 6, 1)


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def r6(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.floor(c * 1e6 + 0.4999) / 1e6


def price_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order lines as price observations: columns of clean prices, and those that order them."""
    li, pa, su, na = (t(spark, sf_dir, n) for n in ("lineitem", "part", "supplier", "nation"))
    joined = li.join(pa, li.l_partkey == pa.p_partkey).join(su, li.l_suppkey == su.s_suppkey).join(na, su.s_nationkey == na.n_nationkey)
    day = F.col("l_shipdate").cast("date")
    return joined.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("id"), day.alias("price_date"), S.week_start(day).alias("week_start_date"), F.col("p_name").alias("product_code"),
        F.col("p_brand").alias("store_brand_normalized"), F.col("n_name").alias("country_code"), (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price_eur"),
        (F.col("l_discount") > 0).alias("price_is_discounted"), "l_partkey", "l_suppkey", "l_orderkey", "l_quantity",
    )


PRICE_OBS = """price_obs AS (
    SELECT l_orderkey || '-' || l_linenumber AS id, CAST(l_shipdate AS DATE) AS price_date, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS week_start_date, p_name AS product_code,
        p_brand AS store_brand_normalized, n_name AS country_code, floor(l_extendedprice / l_quantity * 100) / 100 AS price_eur, l_discount > 0 AS price_is_discounted, l_partkey, l_suppkey, l_orderkey, l_quantity
    FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)"""


def _r6(x: str) -> str:
    return f"floor(({x}) * 1e6 + 0.4999) / 1e6"


# Gold -----------------------------------------------------------------------------------------------------------------


def brand_week_aggregates(spark, sf_dir):
    return gold.brand_week_aggregates(price_obs(spark, sf_dir), weeks=None, exact=True).withColumn("avg_price_eur", r6("avg_price_eur"))


def brand_week_aggregates_recent(spark, sf_dir):
    return gold.brand_week_aggregates(price_obs(spark, sf_dir), RUN, weeks=12, min_obs=2, exact=True).withColumn("avg_price_eur", r6("avg_price_eur"))


def brand_week_index(spark, sf_dir):
    return gold.brand_week_index(price_obs(spark, sf_dir), weeks=None, exact=True).withColumn("index_value", r6("index_value"))


def product_rankings(spark, sf_dir):
    return gold.product_rankings(price_obs(spark, sf_dir), weeks=None, exact=True).withColumn("pct_change", r6("pct_change"))


def _scores(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r6(c) for c in ("mean_med", "std_med", "z_score")})


def price_anomalies(spark, sf_dir):
    return _scores(gold.price_anomalies(price_obs(spark, sf_dir), weeks=None, exact=True, keys=("product_code",)))


def price_anomalies_by_brand(spark, sf_dir):
    return _scores(gold.price_anomalies(price_obs(spark, sf_dir), weeks=None, min_obs=1, exact=True))


def alert_rankings(spark, sf_dir):
    moves = gold.product_rankings(price_obs(spark, sf_dir), weeks=None, top_n=None, exact=True)
    return gold.top_rankings(moves, RUN).withColumn("pct_change", r6("pct_change"))


def alert_anomalies(spark, sf_dir):
    odd = gold.price_anomalies(price_obs(spark, sf_dir), weeks=None, z=1.0, exact=True, keys=("product_code",))
    return _scores(gold.top_anomalies(odd, RUN))


def alert_report(spark, sf_dir):
    prices = price_obs(spark, sf_dir)
    return gold.alert_report(gold.product_rankings(prices, weeks=None, top_n=None, exact=True), gold.price_anomalies(prices, weeks=None, z=1.0, exact=True, keys=("product_code",)), RUN)


def _weekly(keys: str, least: int = 3, where: str = "true") -> str:
    return f"""weekly AS (SELECT week_start_date, {keys}, count(*) AS observations, avg(price_eur) AS a, quantile_disc(price_eur, 0.5) AS median_price_eur
        FROM price_obs WHERE {where} GROUP BY ALL HAVING count(*) >= {least})"""


_MOVES = """moves AS (SELECT week_start_date AS reference_week, product_code, prev_median, median_price_eur AS curr_median, (median_price_eur - prev_median) / prev_median AS pct_change, observations
    FROM (SELECT *, lag(median_price_eur) OVER (PARTITION BY product_code ORDER BY week_start_date) AS prev_median FROM weekly) WHERE prev_median > 0)"""
_RANK_COLUMNS = f"reference_week, product_code, prev_median, curr_median, {_r6('pct_change')} AS pct_change, observations"


def _anomalies(keys: str) -> str:
    return f"""odd AS (SELECT week_start_date, {keys}, median_price_eur, observations, m AS mean_med, s AS std_med, (median_price_eur - m) / s AS z_score FROM
        (SELECT *, avg(median_price_eur) OVER (PARTITION BY {keys}) AS m, stddev_pop(median_price_eur) OVER (PARTITION BY {keys}) AS s FROM weekly) WHERE s > 0)"""


def _scored(keys: str) -> str:
    return f"week_start_date, {keys}, median_price_eur, observations, {_r6('mean_med')} AS mean_med, {_r6('std_med')} AS std_med, {_r6('z_score')} AS z_score"


_BW = "store_brand_normalized, country_code"
GOLD_SQL = {
    "brand_week_aggregates": f"WITH {PRICE_OBS}, {_weekly(_BW)} SELECT week_start_date, {_BW}, observations, {_r6('a')} AS avg_price_eur, median_price_eur FROM weekly",
    "brand_week_aggregates_recent": f"WITH {PRICE_OBS}, {_weekly(_BW, 2, where="week_start_date >= DATE '2001-06-01' - 84")} SELECT week_start_date, {_BW}, observations, {_r6('a')} AS avg_price_eur, median_price_eur FROM weekly",
    "brand_week_index": f"""WITH {PRICE_OBS}, {_weekly(_BW)}, bases AS (SELECT {_BW}, median_price_eur AS base_price FROM weekly QUALIFY row_number() OVER (PARTITION BY {_BW} ORDER BY week_start_date) = 1)
        SELECT week_start_date, w.store_brand_normalized, w.country_code, observations, median_price_eur, base_price, {_r6('median_price_eur / base_price * 100')} AS index_value FROM weekly w JOIN bases USING ({_BW})""",
    "product_rankings": f"WITH {PRICE_OBS}, {_weekly('product_code')}, {_MOVES} SELECT {_RANK_COLUMNS} FROM (SELECT * FROM moves ORDER BY pct_change DESC, reference_week, product_code LIMIT 500)",
    "price_anomalies": f"WITH {PRICE_OBS}, {_weekly('product_code')}, {_anomalies('product_code')} SELECT {_scored('product_code')} FROM odd WHERE abs(z_score) >= 3",
    "price_anomalies_by_brand": f"WITH {PRICE_OBS}, {_weekly('product_code, store_brand_normalized', 1)}, {_anomalies('product_code, store_brand_normalized')} SELECT {_scored('product_code, store_brand_normalized')} FROM odd WHERE abs(z_score) >= 3",
    "alert_rankings": f"""WITH {PRICE_OBS}, {_weekly('product_code')}, {_MOVES} SELECT {_RANK_COLUMNS} FROM
        (SELECT * FROM moves WHERE reference_week >= DATE '2001-06-01' - 14 AND pct_change >= 0.05 ORDER BY pct_change DESC, reference_week, product_code LIMIT 50)""",
    "alert_anomalies": f"""WITH {PRICE_OBS}, {_weekly('product_code')}, {_anomalies('product_code')} SELECT {_scored('product_code')} FROM
        (SELECT * FROM odd WHERE abs(z_score) >= 1 AND week_start_date >= DATE '2001-06-01' - 14 ORDER BY abs(z_score) DESC, week_start_date, product_code LIMIT 100)""",
}


# Cleaning -------------------------------------------------------------------------------------------------------------


def raw_snapshot(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """The order lines, or ``lines`` of them, as a raw snapshot with its faults: bad barcodes, currencies, countries, proofs, prices, dates and discounts."""
    li, od = t(spark, sf_dir, "lineitem") if lines is None else lines, t(spark, sf_dir, "orders")
    k = F.col("l_orderkey") * 7 + F.col("l_linenumber")
    bare = F.lpad(F.col("l_partkey").cast("string"), 12, "3")
    digit = (10 - F.aggregate(F.transform(F.sequence(F.lit(1), F.lit(12)), lambda i: F.substring(bare, i, F.lit(1)).cast("int") * F.when(i % 2 == 0, 3).otherwise(1)), F.lit(0), lambda a, x: a + x) % 10) % 10
    return li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.when(k % 97 == 0, F.lit(" ")).otherwise(F.concat_ws("-", "l_orderkey", "l_linenumber")).alias("id"), F.col("l_shipdate").cast("date").alias("date"),
        F.concat(bare, F.when(k % 23 == 0, (digit + 1) % 10).otherwise(digit).cast("string")).alias("product_code"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity")) / F.when(k % 53 == 0, 1.0).otherwise(100.0)).alias("price"),
        F.when(k % 3 == 0, F.floor(F.col("l_extendedprice") / F.col("l_quantity")) / 100 * 1.25).alias("price_without_discount"), (F.col("l_discount") > 0.05).alias("price_is_discounted"),
        F.when(k % 31 == 0, "USD").otherwise(" eur ").alias("currency"), F.when(k % 41 == 0, "Belgium").when(k % 5 == 0, "FRA").otherwise("france").alias("location_osm_address_country"),
        F.when(k % 37 == 0, "letter").when(k % 2 == 0, "price-tag").otherwise("Receipt").alias("proof_type"), F.concat(F.lit("Carrefour  Market, "), F.col("l_suppkey").cast("string")).alias("location_osm_display_name"),
        F.concat(F.lit("lyon "), (F.col("l_linenumber") % 9 + 1).cast("string"), F.lit("e")).alias("location_osm_address_city"), F.struct("l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_discount").alias("seen"),
    )


LAST = date(2001, 1, 1)
AT = datetime(2001, 1, 1, 3, 0)


def _transformed(spark, sf_dir):
    return cleaning.transform_prices(raw_snapshot(spark, sf_dir), LAST, AT, order=[F.col("seen")])


def transform_prices(spark, sf_dir):
    clean, _, _ = _transformed(spark, sf_dir)
    return clean.select("id", "price_date", "week_start_date", "product_code", "price_eur", "price_is_discounted", "currency", "proof_type", "country_code", "store_brand", "store_brand_normalized", "city", "iqr_outlier")


def rejections_by_reason(spark, sf_dir):
    _, rejected, _ = _transformed(spark, sf_dir)
    return rejected.groupBy("reason").agg(F.count("*").alias("n"), F.min("details").alias("first_details"), F.count("raw_price_date").alias("dated"))


def run_metrics(spark, sf_dir):
    _, _, metrics = _transformed(spark, sf_dir)
    return metrics.drop("rejections_by_reason")


_DIGIT = "(10 - list_sum([cast(substr(bare, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END FOR i IN range(1, 13)]) % 10) % 10"
RAW_SQL = f"""raw AS (SELECT *, CASE WHEN k % 97 = 0 THEN NULL ELSE l_orderkey || '-' || l_linenumber END AS id, bare || CASE WHEN k % 23 = 0 THEN ({_DIGIT} + 1) % 10 ELSE {_DIGIT} END AS product_code,
        floor(l_extendedprice / l_quantity) / CASE WHEN k % 53 = 0 THEN 1.0::DOUBLE ELSE 100 END AS price, CASE WHEN k % 3 = 0 THEN floor(l_extendedprice / l_quantity) / 100 * 1.25 END AS full_price
    FROM (SELECT *, l_orderkey * 7 + l_linenumber AS k, lpad(cast(l_partkey AS VARCHAR), 12, '3') AS bare FROM lineitem JOIN orders ON l_orderkey = o_orderkey)),
    judged AS (SELECT *, CASE WHEN id IS NULL THEN 'MISSING_REQUIRED_FIELD' WHEN k % 31 = 0 THEN 'INVALID_CURRENCY' WHEN k % 41 = 0 THEN 'INVALID_COUNTRY' WHEN k % 37 = 0 THEN 'INVALID_PROOF_TYPE'
        WHEN NOT price BETWEEN 0.01 AND 500 THEN 'OUT_OF_RANGE_PRICE' WHEN CAST(l_shipdate AS DATE) > DATE '2001-01-01' THEN 'FUTURE_DATE' WHEN k % 23 = 0 THEN 'INVALID_EAN'
        WHEN l_discount > 0.05 AND full_price IS NOT NULL AND (full_price <= price OR (full_price - price) / full_price > 0.95) THEN 'INCOHERENT_DISCOUNT' END AS reason FROM raw),
    firsts AS (SELECT * FROM judged WHERE reason IS NULL QUALIFY row_number() OVER (PARTITION BY id ORDER BY l_shipdate, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount) = 1),
    quartiles AS (SELECT product_code AS pc, quantile_cont(price, 0.25) AS q1, quantile_cont(price, 0.75) AS q3 FROM firsts GROUP BY 1 HAVING count(*) >= 5),
    flagged AS (SELECT *, coalesce(price < q1 - 3 * (q3 - q1) OR price > q3 + 3 * (q3 - q1), false) AS iqr_outlier FROM firsts LEFT JOIN quartiles ON product_code = pc)"""
CLEANING_SQL = {
    "transform_prices": f"""WITH {RAW_SQL} SELECT id, CAST(l_shipdate AS DATE) AS price_date, CAST(date_trunc('week', CAST(l_shipdate AS DATE)) AS DATE) AS week_start_date, product_code, price AS price_eur, l_discount > 0.05 AS price_is_discounted,
        'EUR' AS currency, CASE WHEN k % 2 = 0 THEN 'PRICE_TAG' ELSE 'RECEIPT' END AS proof_type, 'FR' AS country_code, 'Carrefour Market, ' || l_suppkey AS store_brand, 'Carrefour Market' AS store_brand_normalized, 'Lyon' AS city, iqr_outlier FROM flagged""",
    "rejections_by_reason": f"""WITH {RAW_SQL}, d AS (SELECT reason, CASE reason WHEN 'MISSING_REQUIRED_FIELD' THEN 'Missing required fields: id' WHEN 'INVALID_CURRENCY' THEN 'Unsupported currency: USD' WHEN 'INVALID_COUNTRY' THEN 'Unsupported country: BE'
            WHEN 'INVALID_PROOF_TYPE' THEN 'Unsupported proof type: LETTER' WHEN 'OUT_OF_RANGE_PRICE' THEN 'Price out of range [0.01, 500.00]: ' || cast(price AS VARCHAR) WHEN 'FUTURE_DATE' THEN 'price_date ' || CAST(l_shipdate AS DATE) || ' > reference 2001-01-01'
            WHEN 'INVALID_EAN' THEN 'checksum EAN-13 invalide (attendu ' || {_DIGIT} || ', recu ' || ({_DIGIT} + 1) % 10 || ')' ELSE 'prix remisé (' || price || '€) ≥ prix sans remise (' || full_price || '€)' END AS details FROM judged)
        SELECT reason, count(*) AS n, min(details) AS first_details, count(*) FILTER (reason NOT IN ('INVALID_EAN', 'INCOHERENT_DISCOUNT')) AS dated FROM d WHERE reason IS NOT NULL GROUP BY reason""",
    "run_metrics": f"""WITH {RAW_SQL}, n AS (SELECT (SELECT count(*) FROM raw) AS a, (SELECT count(*) FROM flagged) AS c, (SELECT count(*) FROM judged WHERE reason IS NOT NULL) AS r, (SELECT count(*) FROM flagged WHERE iqr_outlier) AS o)
        SELECT a AS rows_input, c AS rows_clean, r AS rows_rejected, round(c / a, 4) AS acceptance_rate, 1.0 AS store_brand_coverage, o AS iqr_outliers FROM n""",
}


def iqr_outliers(spark, sf_dir):
    return cleaning.flag_iqr(t(spark, sf_dir, "events"), "event_type", "value").where("iqr_outlier").select("event_id", "event_type", "value")


def iqr_outliers_hot(spark, sf_dir):
    """The same with quartiles in two passes for every event type, and for all events as one type."""
    ev = t(spark, sf_dir, "events").select("event_id", F.explode(F.array(F.col("event_type"), F.lit("all"))).alias("event_type"), "value")
    return cleaning.flag_iqr(ev, "event_type", "value", k=2.0, hot=50).where("iqr_outlier").select("event_id", "event_type", "value")


def price_range_filter(spark, sf_dir):
    ev = t(spark, sf_dir, "events")
    price = S.price_of(F.col("value"), "double")
    return ev.where(price.between(F.lit("1.00").cast(S.PRICE), F.lit("50.00").cast(S.PRICE))).groupBy("event_type").agg(F.count("*").alias("n"))


def dedup_first(spark, sf_dir):
    firsts = cleaning.keep_first(price_obs(spark, sf_dir), ["id"], [F.col(c) for c in ("price_date", "l_partkey", "l_suppkey", "price_eur")])
    return firsts.select("id", "price_date", "product_code", "price_eur", "l_suppkey")


def distinct_barcodes(spark, sf_dir):
    return price_obs(spark, sf_dir).select("product_code").distinct()


CLEANING_SQL |= {
    "iqr_outliers": """WITH q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM events GROUP BY 1 HAVING count(*) >= 5)
        SELECT event_id, event_type, value FROM events JOIN q USING (event_type) WHERE value < q1 - 3 * (q3 - q1) OR value > q3 + 3 * (q3 - q1)""",
    "iqr_outliers_hot": """WITH e AS (SELECT event_id, event_type, value FROM events UNION ALL SELECT event_id, 'all', value FROM events), q AS (SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.75) AS q3 FROM e GROUP BY 1 HAVING count(*) >= 5)
        SELECT event_id, event_type, value FROM e JOIN q USING (event_type) WHERE value < q1 - 2 * (q3 - q1) OR value > q3 + 2 * (q3 - q1)""",
    "price_range_filter": "SELECT event_type, count(*) AS n FROM events WHERE value BETWEEN 1 AND 50 GROUP BY 1",
    "dedup_first": f"WITH {PRICE_OBS} SELECT id, price_date, product_code, price_eur, l_suppkey FROM price_obs QUALIFY row_number() OVER (PARTITION BY id ORDER BY price_date, l_partkey, l_suppkey, price_eur) = 1",
    "distinct_barcodes": f"WITH {PRICE_OBS} SELECT DISTINCT product_code FROM price_obs",
}


# Column functions -----------------------------------------------------------------------------------------------------


def barcode_check(spark, sf_dir):
    code = F.concat(F.lpad(F.col("o_orderkey").cast("string"), 12, "0"), F.substring(F.col("o_custkey").cast("string"), -1, 1))
    return t(spark, sf_dir, "orders").select("o_orderkey", code.alias("code"), S.barcode_error(code).isNull().alias("valid"))


def barcode_normal(spark, sf_dir):
    return t(spark, sf_dir, "orders").select("o_orderkey", S.normal_barcode(F.concat(F.lit("n° "), F.col("o_orderkey").cast("string"), F.lit("-"), F.col("o_custkey").cast("string"))).alias("code"))


def price_parse(spark, sf_dir):
    text = F.concat(F.lit(" "), F.replace(F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("."), F.when(F.col("o_orderkey") % 2 == 0, ",").otherwise(".")), F.lit(" €"), F.when(F.col("o_orderkey") % 11 == 0, ".1").otherwise(""))
    return t(spark, sf_dir, "orders").select("o_orderkey", S.parse_price(text).cast("double").alias("price"))


def date_parse(spark, sf_dir):
    d = F.col("o_orderdate")
    text = F.when(F.col("o_orderkey") % 4 == 0, F.date_format(d, "yyyy/MM/dd")).when(F.col("o_orderkey") % 4 == 1, F.date_format(d, "dd/MM/yyyy")).when(F.col("o_orderkey") % 4 == 2, F.date_format(d, "yyyy-MM-dd'T'03:14:00'Z'")).otherwise("bogus")
    return t(spark, sf_dir, "orders").select("o_orderkey", S.parse_date(text).alias("day"), S.week_start(S.parse_date(text)).alias("week"))


def country_infer(spark, sf_dir):
    na = t(spark, sf_dir, "customer").join(t(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return na.select("c_custkey", S.country_code(F.concat(F.lit(" "), F.lower("n_name"))).alias("code"))


def brand_canonical(spark, sf_dir):
    raw = F.concat_ws(" ", F.element_at(F.array(F.lit("carrefour  city"), F.lit("LIDL"), F.lit("Épicerie"), F.lit("super u"), F.lit("le Casino")), (F.col("s_suppkey") % 5 + 1).cast("int")), F.concat(F.col("s_name"), F.lit(", Lyon")))
    return t(spark, sf_dir, "supplier").select("s_suppkey", S.canonical_brand(raw).alias("brand"))


def city_title(spark, sf_dir):
    raw = F.concat(F.lower(F.regexp_replace("s_name", "[^A-Za-z]", "-")), F.when(F.col("s_suppkey") % 2 == 0, " 7ème Arrondissement").otherwise(" 3e"))
    return t(spark, sf_dir, "supplier").select("s_suppkey", S.city_title(raw).alias("city"))


def discount_check(spark, sf_dir):
    price, full = F.col("l_extendedprice"), F.col("l_extendedprice") * F.when(F.col("l_linenumber") == 1, 30.0).otherwise(F.col("l_linenumber") / 3.0)
    found = t(spark, sf_dir, "lineitem").select("l_linenumber", S.discount_error(price, full, F.col("l_discount") > 0.02).isNotNull().alias("bad"))
    return found.groupBy("l_linenumber").agg(F.count_if("bad").alias("bad"), F.count("*").alias("n"))


def quantity_parse(spark, sf_dir):
    text = F.concat(F.when(F.col("p_size") % 3 == 0, "6 x ").otherwise(""), F.col("p_size").cast("string"), F.when(F.col("p_size") % 2 == 0, " cl").otherwise("Grams"))
    q = P.quantity(text)
    return t(spark, sf_dir, "part").select("p_partkey", q["value"].alias("value"), q["unit"].alias("unit"))


def department(spark, sf_dir):
    code = F.lpad((F.col("c_custkey") * 7919 % 100000).cast("string"), 5, "0")
    return t(spark, sf_dir, "customer").select("c_custkey", P.department(code).alias("departement"))


FUNCTIONS_SQL = {
    "barcode_check": """WITH c AS (SELECT o_orderkey, lpad(cast(o_orderkey AS VARCHAR), 12, '0') || right(cast(o_custkey AS VARCHAR), 1) AS code FROM orders)
        SELECT o_orderkey, code, length(code) = 13 AND list_sum([cast(substr(code, i, 1) AS INT) * CASE WHEN i % 2 = 0 THEN 3 ELSE 1 END FOR i IN range(1, 14)]) % 10 = 0 AS valid FROM c""",
    "barcode_normal": "WITH c AS (SELECT o_orderkey, o_orderkey || '' || o_custkey AS d FROM orders) SELECT o_orderkey, CASE WHEN length(d) <= 8 THEN lpad(d, 8, '0') WHEN length(d) <= 13 THEN lpad(d, 13, '0') ELSE d END AS code FROM c",
    "price_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN cast(cast(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) END AS price FROM orders",
    "date_parse": "WITH d AS (SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 3 THEN CAST(o_orderdate AS DATE) END AS day FROM orders) SELECT o_orderkey, day, CAST(date_trunc('week', day) AS DATE) AS week FROM d",
    "country_infer": "SELECT c_custkey, CASE n_name WHEN 'FRANCE' THEN 'FR' WHEN 'GERMANY' THEN 'DE' WHEN 'UNITED KINGDOM' THEN 'GB' END AS code FROM customer JOIN nation ON c_nationkey = n_nationkey",
    "brand_canonical": "SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'Carrefour City' WHEN 1 THEN 'Lidl' WHEN 2 THEN 'Épicerie ' || s_name WHEN 3 THEN 'Super U' ELSE 'Casino' END AS brand FROM supplier",
    "city_title": """SELECT s_suppkey, array_to_string([CASE WHEN x = '' THEN '' ELSE upper(x[1]) || lower(x[2:]) END FOR x IN string_split(regexp_replace(s_name, '[^A-Za-z]', '-', 'g'), '-')], '-') AS city FROM supplier""",
    "discount_check": """SELECT l_linenumber, count(*) FILTER (l_discount > 0.02 AND (f <= l_extendedprice OR (f - l_extendedprice) / f > 0.95)) AS bad, count(*) AS n
        FROM (SELECT *, l_extendedprice * CASE WHEN l_linenumber = 1 THEN 30.0::DOUBLE ELSE l_linenumber / 3.0::DOUBLE END AS f FROM lineitem) GROUP BY 1""",
    "quantity_parse": "SELECT p_partkey, CASE WHEN p_size % 3 = 0 THEN 6 ELSE 1 END * p_size * CASE WHEN p_size % 2 = 0 THEN 10.0::DOUBLE ELSE 1 END AS value, CASE WHEN p_size % 2 = 0 THEN 'ml' ELSE 'g' END AS unit FROM part",
    "department": """WITH c AS (SELECT c_custkey, lpad(cast(c_custkey * 7919 % 100000 AS VARCHAR), 5, '0') AS p FROM customer)
        SELECT c_custkey, CASE WHEN p LIKE '97%' OR p LIKE '98%' THEN left(p, 3) WHEN p LIKE '20%' THEN CASE WHEN p < '20200' THEN '2A' ELSE '2B' END ELSE left(p, 2) END AS departement FROM c""",
}


# Catalogue and similarity ---------------------------------------------------------------------------------------------


def catalogue_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as a catalogue: one product for each name, every seventh a tombstone."""
    parts = t(spark, sf_dir, "part").groupBy(F.col("p_name").alias("ean")).agg(F.min("p_brand").alias("brand"), F.min("p_type").alias("category_l3"), F.min("p_partkey").alias("k"))
    return parts.select("ean", F.col("ean").alias("produit_nom"), "brand", "category_l3", (F.col("k") % 7 != 0).alias("off_found"), F.expr("date_sub(date'2001-06-01', cast(k % 60 as int))").cast("timestamp").alias("enriched_at"))


_CATALOGUE = """catalogue AS (SELECT p_name AS ean, p_name AS produit_nom, min(p_brand) AS brand, min(p_type) AS category_l3, min(p_partkey) % 7 <> 0 AS off_found, DATE '2001-06-01' - CAST(min(p_partkey) % 60 AS INT) AS enriched_at FROM part GROUP BY p_name)"""


def undiscovered_products(spark, sf_dir):
    known = t(spark, sf_dir, "lineitem").where("l_quantity > 45").select(F.col("l_partkey").cast("string").alias("ean"))
    prices = t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("product_code"))
    return catalogue.undiscovered(prices, known, min_len=2)


def stale_products(spark, sf_dir):
    return catalogue.undiscovered(price_obs(spark, sf_dir), catalogue_of(spark, sf_dir), min_len=1, limit=20, stale_days=30, run_date=RUN)


def catalogue_search(spark, sf_dir):
    return catalogue.search(catalogue_of(spark, sf_dir), "RING", 20).select("ean", "produit_nom", "brand")


def catalogue_lookup(spark, sf_dir):
    keys = t(spark, sf_dir, "part").select(F.col("p_name").alias("ean")).union(t(spark, sf_dir, "supplier").select("s_name")).distinct()
    return catalogue.lookup(keys, catalogue_of(spark, sf_dir)).select("ean", "state")


def product_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parts as product documents."""
    words = F.transform(F.split("p_type", " "), lambda w: F.concat(F.lit("en:"), F.lower(w)))
    product = F.struct(
        F.col("p_name").alias("product_name"), F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("le "), F.col("p_name"))).otherwise("").alias("product_name_fr"), F.concat_ws(", ", "p_brand", F.lit("Other")).alias("brands"),
        words.alias("categories_tags"), F.when(F.col("p_size") % 2 == 0, "b").alias("nutriscore_grade"), (F.col("p_size") % 5).alias("nova_group"), F.lit("").alias("ecoscore_grade"), F.lit(None).cast("string").alias("image_front_url"),
        F.concat(F.lit("http://i/"), F.col("p_partkey").cast("string")).alias("image_url"), F.lit("6x125g").alias("quantity"), F.array(F.col("p_brand"), F.lit("bio")).alias("labels_tags"), F.array(F.when(F.col("p_size") > 25, "fr").otherwise("es")).alias("origins_tags"),
    )
    return t(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("code"), F.when(F.col("p_partkey") % 9 == 0, 0).otherwise(1).alias("status"), product.alias("product"))


def shape_catalogue(spark, sf_dir):
    return catalogue.shape_catalogue(product_documents(spark, sf_dir)).drop("enriched_at")


def initial_catalogue(spark, sf_dir):
    prices = t(spark, sf_dir, "lineitem").select(F.col("l_partkey").cast("string").alias("product_code"))
    return catalogue.initial_catalogue(product_documents(spark, sf_dir), prices).select("code", "status")


def comparable_groups(spark, sf_dir):
    made = catalogue.comparable_groups(product_documents(spark, sf_dir))
    return made.select("category_tag", F.array_join("labels", "|").alias("labels"), F.array_join("origins", "|").alias("origins"), "products", "example")


def _vectors(spark, sf_dir):
    return t(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def substitutes_topk(spark, sf_dir):
    return similarity.substitutes(_vectors(spark, sf_dir), key="vec_id", category="label", digits=6)


def substitutes_gated(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("unit", F.col("vec_id") % 2)
    return similarity.substitutes(rows, k=3, key="vec_id", category=["label", "unit"], digits=6)


def substitutes_lsh(spark, sf_dir):
    return similarity.substitutes_lsh(_vectors(spark, sf_dir), key="vec_id", category="label")


def _neighbours(extra: str, k: int) -> str:
    sim = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"
    return f"""SELECT vec_id, CAST(rank AS INT) AS rank, substitute, similarity FROM (SELECT a.vec_id, b.vec_id AS substitute, {sim} AS similarity, row_number() OVER (PARTITION BY a.vec_id ORDER BY {sim} DESC, b.vec_id) AS rank
        FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id {extra}) WHERE rank <= {k}"""


CATALOGUE_SQL = {
    "undiscovered_products": "SELECT DISTINCT cast(p_partkey AS VARCHAR) AS product_code FROM part WHERE p_partkey >= 10 AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45)",
    "stale_products": f"WITH {PRICE_OBS}, {_CATALOGUE} SELECT DISTINCT product_code FROM price_obs WHERE length(product_code) >= 1 AND NOT EXISTS (SELECT 1 FROM catalogue WHERE ean = product_code AND enriched_at >= DATE '2001-06-01' - 30) ORDER BY 1 LIMIT 20",
    "catalogue_search": f"WITH {_CATALOGUE} SELECT ean, produit_nom, brand FROM catalogue WHERE off_found AND (contains(lower(produit_nom), 'ring') OR contains(lower(brand), 'ring')) ORDER BY produit_nom, ean LIMIT 20",
    "catalogue_lookup": f"WITH {_CATALOGUE} SELECT k.ean, CASE WHEN c.ean IS NULL THEN 'unknown' WHEN off_found THEN 'enriched' ELSE 'tombstone' END AS state FROM (SELECT p_name AS ean FROM part UNION SELECT s_name FROM supplier) k LEFT JOIN catalogue c ON k.ean = c.ean",
    "shape_catalogue": """WITH d AS (SELECT *, p_partkey % 9 <> 0 AS f, ['en:' || lower(w) FOR w IN string_split(p_type, ' ')] AS tags, CASE WHEN p_partkey % 2 = 0 THEN 'le ' || p_name ELSE p_name END AS n FROM part)
        SELECT cast(p_partkey AS VARCHAR) AS ean, CASE WHEN f THEN n END AS produit_nom, CASE WHEN f THEN p_brand END AS brand, CASE WHEN f THEN tags[1] END AS category_l1, CASE WHEN f AND len(tags) >= 3 THEN tags[len(tags) // 2 + 1] END AS category_l2,
            CASE WHEN f THEN tags[-1] END AS category_l3, CASE WHEN f AND p_size % 2 = 0 THEN 'B' END AS nutriscore, CASE WHEN f AND p_size % 5 <> 0 THEN cast(p_size % 5 AS VARCHAR) END AS nova_group, CAST(NULL AS VARCHAR) AS ecoscore,
            CASE WHEN f THEN 'http://i/' || p_partkey END AS image_url, CASE WHEN f THEN n || ' | ' || p_brand || ' | ' || tags[-1] ELSE cast(p_partkey AS VARCHAR) END AS embedding_text, f AS off_found FROM d""",
    "initial_catalogue": "SELECT cast(p_partkey AS VARCHAR) AS code, CAST(CASE WHEN p_partkey % 9 = 0 THEN 0 ELSE 1 END AS INT) AS status FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem)",
    "comparable_groups": """SELECT 'en:' || lower(string_split(p_type, ' ')[-1]) AS category_tag, p_brand || '|bio' AS labels, CASE WHEN p_size > 25 THEN 'fr' ELSE 'es' END AS origins, count(DISTINCT p_partkey) AS products, min(cast(p_partkey AS VARCHAR)) AS example FROM part GROUP BY 1, 2, 3""",
    "substitutes_topk": _neighbours("", 5),
    "substitutes_gated": _neighbours("AND a.vec_id % 2 = b.vec_id % 2", 3),
}


# Baskets, tickets and serving -----------------------------------------------------------------------------------------


def purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as bought items: user_id, ean, quantity, purchased_at, price, enseigne, period (quarter)."""
    li, od, pa = (t(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    rows = li.join(od, li.l_orderkey == od.o_orderkey).join(pa, li.l_partkey == pa.p_partkey)
    return rows.select(
        F.col("o_custkey").alias("user_id"), F.col("p_name").alias("ean"), F.col("p_name").alias("product_code"), F.col("l_quantity").alias("quantity"), F.col("l_quantity"), F.col("o_orderdate").cast("date").alias("purchased_at"),
        (F.floor(F.col("l_extendedprice") / F.col("l_quantity") * 100) / 100).alias("price"), F.col("p_brand").alias("enseigne"), F.date_trunc("quarter", "o_orderdate").cast("date").alias("period"), "l_orderkey", "l_linenumber",
    )


_PURCHASES = """purchases AS (SELECT o_custkey AS user_id, p_name AS ean, l_quantity AS quantity, CAST(o_orderdate AS DATE) AS purchased_at, floor(l_extendedprice / l_quantity * 100) / 100 AS price, p_brand AS enseigne,
    CAST(date_trunc('quarter', o_orderdate) AS DATE) AS period FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey)"""
_HISTORY = "history AS (SELECT user_id, ean, count(*) AS purchase_count_6m, avg(quantity) AS avg_quantity, max(purchased_at) AS last_purchased_at FROM purchases WHERE purchased_at > DATE '2001-06-01' - INTERVAL 120 MONTH AND purchased_at <= DATE '2001-06-01' GROUP BY ALL)"


def basket_history(spark, sf_dir):
    return baskets.basket_history(purchases(spark, sf_dir), RUN, months=120).withColumn("avg_quantity", r6("avg_quantity"))


def laspeyres_national(spark, sf_dir):
    return baskets.laspeyres(purchases(spark, sf_dir), []).withColumn("value", r6("value"))


def laspeyres_regional(spark, sf_dir):
    return baskets.laspeyres(purchases(spark, sf_dir), ["enseigne"]).withColumn("value", r6("value"))


def personal_index(spark, sf_dir):
    bought = purchases(spark, sf_dir)
    return baskets.personal_index(bought, baskets.basket_history(bought, RUN, months=120)).withColumn("value", r6("value"))


def rolling_index(spark, sf_dir):
    made = baskets.rolling_index(purchases(spark, sf_dir), months=24)
    return made.withColumns({"variation": r6("variation"), "value": F.floor(F.col("value") * 1e4 + 0.4999) / 1e4})


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A thousand texts that are parts of product names and of suppliers' names, and some that are in none."""
    names = t(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("n"), F.col("p_partkey").alias("k"))
    return names.select(F.substring("n", (F.col("k") % 9 + 1).cast("int"), (F.col("k") % 7 + 1).cast("int")).alias("q")).distinct()


def search_many(spark, sf_dir):
    named = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ean"), F.concat_ws(" ", "p_name", "p_type").alias("produit_nom"), F.col("p_brand").alias("brand"), (F.col("p_partkey") % 7 != 0).alias("off_found"))
    return grams.search_many(named, _asked(spark, sf_dir), limit=5)


def names_alike(spark, sf_dir):
    """Product names with their first letter, and every third also with another in the midst, misread: the name that each is most like."""
    named = t(spark, sf_dir, "part").select(F.concat_ws(" ", F.lower("p_name"), F.lower("p_type"), F.col("p_size").cast("string")).alias("name"), F.col("p_partkey").alias("key"))
    misread = F.concat(F.lit("0"), F.substring("name", 2, 5), F.when(F.col("key") % 3 == 0, "1").otherwise(F.substring("name", 7, 1)), F.expr("substring(name, 8)"))
    return grams.spelt_alike(named.select(misread.alias("text")), named).select("text", "key", r6("similarity").alias("similarity"))


def index_series(spark, sf_dir):
    made = baskets.index_series(baskets.laspeyres(purchases(spark, sf_dir), ["enseigne"]), ["enseigne"])
    return made.select("enseigne", "base_period", r6("current").alias("current"), F.size("series").cast("long").alias("points"))


def regional_map(spark, sf_dir):
    return baskets.regional_map(baskets.laspeyres(purchases(spark, sf_dir), ["enseigne"]), "enseigne").withColumn("inflation_pct", r6("inflation_pct"))


def cheapest_store(spark, sf_dir):
    medians = gold.gold_source(price_obs(spark, sf_dir), ["product_code"])
    return baskets.cheapest_stores(medians)


def brand_stats(spark, sf_dir):
    prices = price_obs(spark, sf_dir).withColumn("iqr_outlier", F.when(F.col("l_quantity") > 40, None).otherwise(F.col("price_eur") > 2000))
    stats = serving.brand_stats(catalogue_of(spark, sf_dir), prices, gold.product_rankings(price_obs(spark, sf_dir), weeks=None, top_n=None, exact=True))
    return stats.select("brand", "product_count", r6("avg_price_eur").alias("avg_price_eur"), F.size("top_increases").cast("long").alias("listed"), F.col("top_increases")[0]["ean"].alias("top_ean"))


def rankings_view(spark, sf_dir):
    return serving.rankings_view(gold.product_rankings(price_obs(spark, sf_dir), weeks=None, exact=True), catalogue_of(spark, sf_dir)).withColumn("pct_change", r6("pct_change"))


def hall_of_shame(spark, sf_dir):
    moves = gold.product_rankings(price_obs(spark, sf_dir), weeks=None, top_n=None, exact=True)
    return serving.hall_of_shame(moves).withColumns({"pct_change": r6("pct_change"), "shame_score": r6("shame_score")})


def ticket_detail(spark, sf_dir):
    orders = t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket_id"), "o_custkey")
    lines = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ticket_id"), F.col("l_linenumber").alias("line_index")).agg(F.min("l_partkey").alias("l_partkey"))
    made = baskets.ticket_detail(orders, lines)
    return made.select("ticket_id", "o_custkey", F.array_join(F.transform("items", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


def ticket_page(spark, sf_dir):
    page = baskets.ticket_page(t(spark, sf_dir, "orders"), "o_custkey", limit=3, offset=2, newest="o_orderdate", key="o_orderkey")
    return page.select("o_custkey", "o_orderkey", F.col("row").cast("long").alias("row"), "total")


def _ticket_lines(spark, sf_dir):
    li = t(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("ticket_id"), F.col("l_linenumber").alias("line_index")).agg(F.min("l_partkey").alias("k"))
    return li.select("ticket_id", "line_index", F.concat(F.lit("ITEM "), F.col("k").cast("string")).alias("raw_text"), F.lit(None).cast("string").alias("ean"), F.lit(True).alias("needs_validation"), F.lit(False).alias("validated_by_user"))


def apply_corrections(spark, sf_dir):
    lines, tickets = _ticket_lines(spark, sf_dir), t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("ticket_id"), F.col("o_orderpriority").alias("enseigne"), F.lit("done").alias("status"))
    # Every third ticket gets a barcode for its first line; of those, every fifth names a line that no ticket has.
    patches = tickets.where("ticket_id % 3 = 0").select("ticket_id", F.when(F.col("ticket_id") % 5 == 0, 99).otherwise(1).alias("line_index"), F.lit("3017620422003").alias("ean"))
    fixed, done, aliases, violations = baskets.apply_corrections(lines, tickets, patches)
    count = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count("validated lines", fixed.where("validated_by_user")).unionByName(count("validated tickets", done.where("status = 'validated'"))).unionByName(count("aliases", aliases)).unionByName(count("violations", violations))


def resolve_products(spark, sf_dir):
    lines = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ticket_id"), F.lit(0).alias("line_index"), F.when(F.col("p_partkey") % 4 == 0, F.upper("p_name")).when(F.col("p_partkey") % 4 == 1, F.concat("p_name", F.lit("e"))).otherwise(F.col("p_brand")).alias("raw_text"), F.lit("").alias("enseigne"))
    aliases = t(spark, sf_dir, "part").select(F.col("p_brand").alias("raw_text"), F.lit("").alias("enseigne"), F.concat(F.lit("a"), F.col("p_brand")).alias("ean"), F.lit(1.0).alias("confidence"), F.lit(True).alias("validated_by_user")).distinct()
    found = baskets.resolve_products(lines, aliases, catalogue_of(spark, sf_dir).select(F.col("ean"), "produit_nom"))
    return found.groupBy("match_method").agg(F.count("*").alias("n"), F.countDistinct("ean").alias("eans"))


SERVING_SQL = {
    "basket_history": f"WITH {_PURCHASES}, {_HISTORY} SELECT user_id, ean, purchase_count_6m, {_r6('avg_quantity')} AS avg_quantity, last_purchased_at FROM history",
    "cheapest_store": f"""WITH {PRICE_OBS}, m AS (SELECT product_code, store_brand_normalized, quantile_disc(price_eur, 0.5) AS m FROM price_obs GROUP BY ALL)
        SELECT product_code, store_brand_normalized, m AS median_price_eur, n AS stores FROM (SELECT *, count(*) OVER (PARTITION BY product_code) AS n, row_number() OVER (PARTITION BY product_code ORDER BY m, store_brand_normalized) AS r FROM m) WHERE r = 1""",
    "rankings_view": f"""WITH {PRICE_OBS}, {_weekly('product_code')}, {_MOVES}, {_CATALOGUE} SELECT product_code AS ean, produit_nom, brand, {_r6('pct_change')} AS pct_change, curr_median AS price_eur_current, prev_median AS price_eur_previous, observations AS sample_size,
        strftime(reference_week, '%G-W%V') AS period FROM (SELECT * FROM moves ORDER BY pct_change DESC, reference_week, product_code LIMIT 20) JOIN catalogue ON ean = product_code""",
    "hall_of_shame": f"""WITH {PRICE_OBS}, {_weekly('product_code')}, {_MOVES} SELECT {_RANK_COLUMNS}, {_r6('shame_score')} AS shame_score FROM
        (SELECT *, pct_change * ln(1 + observations) AS shame_score FROM moves WHERE pct_change > 0 ORDER BY shame_score DESC, reference_week, product_code LIMIT 20)""",
    "brand_stats": f"""WITH {PRICE_OBS}, {_weekly('product_code')}, {_MOVES}, {_CATALOGUE}, s AS (SELECT lower(brand) AS brand, count(DISTINCT ean) AS product_count, avg(price_eur) AS a FROM catalogue LEFT JOIN price_obs ON product_code = ean AND l_quantity <= 40 AND price_eur <= 2000 GROUP BY 1),
        b AS (SELECT lower(brand) AS brand, ean, row_number() OVER (PARTITION BY lower(brand) ORDER BY pct_change DESC, reference_week, ean) AS r FROM moves JOIN catalogue ON ean = product_code)
        SELECT s.brand, product_count, {_r6('a')} AS avg_price_eur, n AS listed, top_ean FROM s LEFT JOIN (SELECT brand, least(count(*), 5) AS n, min(ean) FILTER (r = 1) AS top_ean FROM b GROUP BY 1) USING (brand)""",
    "ticket_detail": """WITH l AS (SELECT l_orderkey, l_linenumber, min(l_partkey) AS k FROM lineitem GROUP BY ALL)
        SELECT o_orderkey AS ticket_id, o_custkey, coalesce(string_agg(cast(k AS VARCHAR), ',' ORDER BY l_linenumber), '') AS parts FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "ticket_page": "SELECT o_custkey, o_orderkey, row, total FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) AS row, count(*) OVER (PARTITION BY o_custkey) AS total FROM orders) WHERE row BETWEEN 3 AND 5",
    "apply_corrections": """WITH l AS (SELECT DISTINCT l_orderkey, l_linenumber, min(l_partkey) AS k FROM lineitem GROUP BY ALL), p AS (SELECT o_orderkey, o_orderpriority, k FROM orders LEFT JOIN l ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderkey % 3 = 0),
        ok AS (SELECT * FROM p WHERE o_orderkey % 5 <> 0 AND k IS NOT NULL)
        SELECT 'validated lines' AS what, count(*) AS n FROM ok UNION ALL SELECT 'validated tickets', count(*) FROM ok UNION ALL SELECT 'aliases', count(DISTINCT (k, o_orderpriority)) FROM ok UNION ALL SELECT 'violations', (SELECT count(*) FROM p) - (SELECT count(*) FROM ok)""",
}


def _laspeyres(scope: str) -> str:
    by, on = (f"{scope}, ", f"b.{scope} = c.{scope} AND ") if scope else ("", "")
    part = f"PARTITION BY {scope}" if scope else ""
    return f"""cells AS (SELECT {by}period, ean, avg(price) AS p, sum(quantity) AS q FROM bought GROUP BY ALL), firsts AS (SELECT *, min(period) OVER ({part}) AS f FROM cells),
        ix AS (SELECT {'c.' + by if scope else ''}c.period, sum(c.p * b.q) / sum(b.p * b.q) * 100 AS value, count(*) AS sample_size FROM cells c JOIN firsts b ON {on}b.ean = c.ean AND b.period = b.f GROUP BY ALL)"""


SERVING_SQL |= {
    "laspeyres_national": f"WITH {_PURCHASES}, bought AS (FROM purchases), {_laspeyres('')} SELECT period, {_r6('value')} AS value, sample_size FROM ix",
    "laspeyres_regional": f"WITH {_PURCHASES}, bought AS (FROM purchases), {_laspeyres('enseigne')} SELECT enseigne, period, {_r6('value')} AS value, sample_size FROM ix",
    "personal_index": f"WITH {_PURCHASES}, {_HISTORY}, bought AS (SELECT p.* FROM purchases p SEMI JOIN (FROM history WHERE purchase_count_6m >= 2) h USING (user_id, ean)), {_laspeyres('user_id')} SELECT user_id, period, {_r6('value')} AS value, sample_size FROM ix",
    "rolling_index": f"""WITH {_PURCHASES}, c AS (SELECT user_id, ean, period, avg(price) AS p, sum(quantity) AS q FROM purchases GROUP BY ALL),
        m AS (SELECT *, sum(q) OVER w AS q0, last_value(p) OVER w AS p0 FROM c WINDOW w AS (PARTITION BY user_id, ean ORDER BY period RANGE BETWEEN INTERVAL 24 MONTHS PRECEDING AND INTERVAL 1 MONTH PRECEDING)),
        s AS (SELECT user_id, period, sum(p * q0) / sum(p0 * q0) AS v, count(*) AS sample_size FROM m WHERE q0 > 0 AND p0 IS NOT NULL GROUP BY ALL)
        SELECT user_id, period, {_r6('v')} AS variation, floor(exp(sum(ln(v)) OVER (PARTITION BY user_id ORDER BY period)) * 100 * 1e4 + 0.4999) / 1e4 AS value, sample_size FROM s WHERE v > 0""",
    "search_many": """WITH p AS (SELECT p_partkey AS k, p_name || ' ' || p_type AS n, p_brand AS b FROM part), q AS (SELECT DISTINCT substr(n, k % 9 + 1, k % 7 + 1) AS q FROM p)
        SELECT q, CAST(rank AS INT) AS rank, k AS ean, n AS produit_nom FROM (SELECT q, k, n, row_number() OVER (PARTITION BY q ORDER BY n, k) AS rank FROM q JOIN p ON contains(lower(n), lower(q)) OR contains(lower(b), lower(q)) WHERE k % 7 <> 0 AND q <> '') WHERE rank <= 5""",
    "names_alike": f"""WITH p AS (SELECT p_partkey AS k, lower(p_name) || ' ' || lower(p_type) || ' ' || p_size AS n FROM part),
        a AS (SELECT DISTINCT '0' || substr(n, 2, 5) || CASE WHEN k % 3 = 0 THEN '1' ELSE substr(n, 7, 1) END || substr(n, 8) AS text FROM p),
        d AS (SELECT text, k, 1 - levenshtein(text, n)::DOUBLE / greatest(length(text), length(n)) AS s FROM a JOIN p ON true)
        SELECT text, k AS key, {_r6('s')} AS similarity FROM d WHERE s >= 0.75 QUALIFY row_number() OVER (PARTITION BY text ORDER BY s DESC, k DESC) = 1""",
    "index_series": f"WITH {_PURCHASES}, bought AS (FROM purchases), {_laspeyres('enseigne')} SELECT enseigne, min(period) AS base_period, {_r6('max_by(value, period)')} AS current, count(*) AS points FROM ix GROUP BY 1",
    "regional_map": f"WITH {_PURCHASES}, bought AS (FROM purchases), {_laspeyres('enseigne')} SELECT enseigne, {_r6('value')} AS inflation_pct, sample_size, cast(period AS VARCHAR) AS period FROM ix WHERE period = (SELECT max(period) FROM ix)",
}


# Receipts and events --------------------------------------------------------------------------------------------------


def receipt_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders as receipt texts: a header, a date, one line for each item, a total."""
    li, od, pa = (t(spark, sf_dir, n) for n in ("lineitem", "orders", "part"))
    shown = F.concat(F.upper("p_name"), F.lit(" REF   "), F.replace(F.format_string("%.2f", F.col("l_quantity")), F.lit("."), F.lit(",")), F.lit(" €"))
    items = li.join(pa, li.l_partkey == pa.p_partkey).groupBy("l_orderkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", shown.alias("s")))), lambda x: x["s"]), "\n").alias("lines"), F.count("*").alias("n"))
    text = F.concat(F.lit("SUPER MARCHE\n12 rue de la Paix\n75001 Paris\n\n"), F.date_format("o_orderdate", "dd/MM/yyyy"), F.lit(" 14:30\n\n"), F.col("lines"), F.lit("\n\nTOTAL TTC   9,59 €\nMERCI"))
    return od.join(items, od.o_orderkey == items.l_orderkey).select(F.col("o_orderkey").cast("string").alias("ticket_id"), text.alias("text"))


def receipt_tickets(spark, sf_dir):
    tickets, _, _ = receipts.parse_receipts(receipt_corpus(spark, sf_dir))
    return tickets.select("ticket_id", "enseigne", "ticket_date", F.col("total_amount").cast("double").alias("total_amount"))


def receipt_lines(spark, sf_dir):
    _, lines, _ = receipts.parse_receipts(receipt_corpus(spark, sf_dir))
    return lines.groupBy("raw_text").agg(F.count("*").alias("n"), F.sum("line_total").cast("double").alias("total"))


def receipt_texts(spark, sf_dir):
    """Whole conversations and documents read as receipts: mostly nothing to find, and nothing to stumble over."""
    texts = t(spark, sf_dir, "conversations").select(F.concat_ws("-", "conv_id", "turn").alias("ticket_id"), "text").union(t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string")), "text"))
    read = receipts.read_receipts(texts)
    return read.select("ticket_id", F.size("ticket.produits").alias("items"), "reason")


def ticket_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as envelopes of uploaded tickets, some of them broken."""
    k = F.col("event_id")
    name = F.concat(F.lit("tickets/raw/u"), F.col("user_id").cast("string"), F.lit("/"), F.when(k % 11 == 0, "bad").otherwise(F.md5((k % 500).cast("string"))), F.lit(".jpg"))
    data = F.when(k % 13 == 0, "%%%").otherwise(F.base64(F.encode(F.to_json(F.struct(F.lit("b").alias("bucket"), name.alias("name"))), "utf-8")))
    attributes = F.struct(F.lit("OBJECT_FINALIZE").alias("eventType"), F.lit("b").alias("bucketId"), name.alias("objectId"))
    message = F.struct(attributes.alias("attributes"), F.when(k % 17 != 0, data).alias("data"), k.cast("string").alias("messageId"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("publishTime"))
    return t(spark, sf_dir, "events").select(message.alias("message"), F.lit("s").alias("subscription"))


def ticket_events_decoded(spark, sf_dir):
    valid, dead = events.decode_events(ticket_events(spark, sf_dir))
    return valid.select("ticket_id", "user_id", F.lit("").alias("reason")).unionByName(dead.select(F.lit("").alias("ticket_id"), F.lit("").alias("user_id"), "reason"))


_PLAIN = "substr(m, 1, 8) || '-' || substr(m, 9, 4) || '-' || substr(m, 13, 4) || '-' || substr(m, 17, 4) || '-' || substr(m, 21)"
EVENTS_SQL = {
    "receipt_tickets": """WITH l AS (SELECT l_orderkey, sum(cast(l_quantity AS DECIMAL(12,2))) AS s FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)
        SELECT cast(o_orderkey AS VARCHAR) AS ticket_id, 'SUPER MARCHE' AS enseigne, CAST(o_orderdate AS DATE) AS ticket_date, cast(s AS DOUBLE) AS total_amount FROM orders JOIN l ON l_orderkey = o_orderkey""",
    "receipt_lines": "SELECT upper(p_name) || ' REF' AS raw_text, count(*) AS n, cast(sum(cast(l_quantity AS DECIMAL(12,2))) AS DOUBLE) AS total FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "ticket_events_decoded": f"""SELECT CASE WHEN r = '' THEN {_PLAIN} ELSE '' END AS ticket_id, CASE WHEN r = '' THEN 'u' || user_id ELSE '' END AS user_id, r AS reason FROM (SELECT user_id, md5(cast(event_id % 500 AS VARCHAR)) AS m,
        CASE WHEN event_id % 17 = 0 THEN 'missing data' WHEN event_id % 13 = 0 THEN 'data is not base64 JSON' WHEN event_id % 11 = 0 THEN 'path is no ticket' ELSE '' END AS r FROM events)""",
}

QUERIES = {
    f.__name__: f
    for f in (
        brand_week_aggregates, brand_week_aggregates_recent, brand_week_index, product_rankings, price_anomalies, price_anomalies_by_brand, alert_rankings, alert_anomalies, alert_report, transform_prices,
        rejections_by_reason, run_metrics, iqr_outliers, iqr_outliers_hot, price_range_filter, dedup_first, distinct_barcodes, barcode_check, barcode_normal, price_parse, date_parse, country_infer, brand_canonical, city_title, discount_check,
        quantity_parse, department, undiscovered_products, stale_products, catalogue_search, catalogue_lookup, shape_catalogue, initial_catalogue, comparable_groups, substitutes_topk, substitutes_gated, substitutes_lsh,
        basket_history, laspeyres_national, laspeyres_regional, personal_index, rolling_index, search_many, names_alike, index_series, regional_map, cheapest_store, brand_stats, rankings_view, hall_of_shame, ticket_detail, ticket_page,
        apply_corrections, resolve_products, receipt_tickets, receipt_lines, receipt_texts, ticket_events_decoded,
    )
}
ORACLES = GOLD_SQL | CLEANING_SQL | FUNCTIONS_SQL | CATALOGUE_SQL | SERVING_SQL | EVENTS_SQL
