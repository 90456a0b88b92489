"""Baskets and tickets: purchase history, Laspeyres indices, alerts, resolution of receipt texts, corrections."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .grams import spelt_alike


def basket_history(lines: DataFrame, run_date: date, months: int = 6) -> DataFrame:
    """user_id, ean, purchase_count_6m, avg_quantity, last_purchased_at over the ``months`` up to the run date.

    ``lines`` holds user_id, ean, quantity and purchased_at; lines without a barcode don't count.
    """
    start = F.add_months(F.lit(run_date), -months)
    rows = lines.where((F.col("purchased_at").cast("date") > start) & (F.col("purchased_at").cast("date") <= F.lit(run_date)) & F.col("ean").isNotNull())
    return rows.groupBy("user_id", "ean").agg(F.count("*").alias("purchase_count_6m"), F.avg("quantity").alias("avg_quantity"), F.max("purchased_at").alias("last_purchased_at"))


def laspeyres(obs: DataFrame, scope: list[str], period: str = "period", product: str = "product_code", price: str = "price", quantity: str = "quantity") -> DataFrame:
    """scope, period, value, sample_size: 100 * sum(p_t q_0) / sum(p_0 q_0) against the first period of each scope.

    ``price`` is averaged and ``quantity`` summed by scope, period and product; products count that both periods have. A base
    worth nothing gives null.
    """
    cells = obs.groupBy(*scope, period, product).agg(F.avg(price).alias("p"), F.sum(quantity).alias("q"))
    firsts = cells.groupBy(*scope).agg(F.min(period).alias("__first"))
    base = cells.join(firsts, scope).where(F.col(period) == F.col("__first")).select(*scope, product, F.col("p").alias("p0"), F.col("q").alias("q0")) if scope else None
    if base is None:
        # One row, the first period of all.
        base = cells.join(F.broadcast(cells.agg(F.min(period).alias("__first"))), F.col(period) == F.col("__first")).select(product, F.col("p").alias("p0"), F.col("q").alias("q0"))
    value = F.try_divide(F.sum(F.col("p") * F.col("q0")), F.sum(F.col("p0") * F.col("q0"))) * 100
    return cells.join(base, [*scope, product]).groupBy(*scope, period).agg(value.alias("value"), F.count("*").alias("sample_size"))


def personal_index(obs: DataFrame, history: DataFrame, min_purchases: int = 2, **more) -> DataFrame:
    """``laspeyres`` for each user over the products they bought at least ``min_purchases`` times. ``obs`` holds user_id."""
    usual = history.where(F.col("purchase_count_6m") >= min_purchases).select("user_id", F.col("ean").alias("product_code"))
    return laspeyres(obs.join(usual, ["user_id", "product_code"], "left_semi"), ["user_id"], **more)


def rolling_index(obs: DataFrame, months: int = 6, user: str = "user_id", product: str = "product_code", period: str = "period", price: str = "price", quantity: str = "quantity") -> DataFrame:
    """user, period, variation, value, sample_size: what a user's basket costs against the time before, and the chain of it on a base of 100.

    The basket of a period (a month or longer, as its first day) is what the user bought in the ``months`` before it, and moves with it. Its products that are bought in the period
    as well are valued at their prices then and at those of their last purchase before. A period without such a product has no row.
    """
    cells = obs.groupBy(user, product, period).agg(F.avg(price).alias("p"), F.sum(quantity).alias("q"))
    before = f"OVER (PARTITION BY {user}, {product} ORDER BY {period} RANGE BETWEEN INTERVAL {months} MONTHS PRECEDING AND INTERVAL 1 MONTHS PRECEDING)"
    moved = cells.withColumns({"q0": F.expr(f"sum(q) {before}"), "p0": F.expr(f"last_value(p) {before}")}).where("q0 > 0 and p0 is not null")
    ratio = F.try_divide(F.sum(F.col("p") * F.col("q0")), F.sum(F.col("p0") * F.col("q0")))
    steps = moved.groupBy(user, period).agg(ratio.alias("variation"), F.count("*").alias("sample_size")).where("variation > 0")
    chained = F.exp(F.sum(F.ln("variation")).over(Window.partitionBy(user).orderBy(period))) * 100
    return steps.withColumn("value", chained).select(user, period, "variation", "value", "sample_size")


def index_series(series: DataFrame, scope: list[str], period: str = "period") -> DataFrame:
    """scope, base_period, current, series: points by period with a value, the first row's period, and the last point's value."""
    points = F.array_sort(F.collect_list(F.when(F.col("value").isNotNull(), F.struct(F.col(period).alias("date"), "value", "sample_size"))))
    # max_by skips nothing, so rows without a value are left out of its order.
    current = F.max_by("value", F.when(F.col("value").isNotNull(), F.col(period)))
    return series.groupBy(*scope).agg(F.min(period).alias("base_period"), current.alias("current"), points.alias("series"))


def regional_map(series: DataFrame, region: str = "departement", period: str = "period") -> DataFrame:
    """The values of the latest period of all, by region; regions that lack it are left out."""
    latest = series.agg(F.max(period).alias("__latest"))
    return series.join(F.broadcast(latest), F.col(period) == F.col("__latest")).where(F.col(region).isNotNull()).select(
        region, F.col("value").alias("inflation_pct"), "sample_size", F.col("__latest").cast("string").alias("period")
    )


def personal_alerts(rankings: DataFrame, history: DataFrame, preferences: DataFrame, lines: DataFrame, default_pct: float = 0.05, min_purchases: int = 2) -> DataFrame:
    """Increases of a user's usual products of at least their threshold; with favourite stores, only of products they bought there.

    ``preferences``: user_id, threshold_pct, favorite_enseignes (array). ``lines``: user_id, ean, enseigne. Users without
    preferences get the default threshold and no store filter.
    """
    usual = history.where(F.col("purchase_count_6m") >= min_purchases).select("user_id", F.col("ean").alias("product_code"))
    stores = lines.groupBy("user_id", F.col("ean").alias("product_code")).agg(F.collect_set("enseigne").alias("__stores"))
    hits = usual.join(rankings, "product_code").join(preferences, "user_id", "left").join(stores, ["user_id", "product_code"], "left")
    liked = F.coalesce(F.size("favorite_enseignes") == 0, F.lit(True)) | F.coalesce(F.arrays_overlap("favorite_enseignes", "__stores"), F.lit(False))
    return hits.where((F.col("pct_change") >= F.coalesce("threshold_pct", F.lit(default_pct))) & liked).select("user_id", *rankings.columns)


def cheapest_stores(prices: DataFrame, store: str = "store_brand_normalized") -> DataFrame:
    """product_code, store, median_price_eur, stores: the store of the lowest median price of each product (ties to the first name), and how many sell it."""
    medians = prices.groupBy("product_code", store).agg(F.percentile_approx("price_eur", 0.5, 10000).alias("m"))
    best = F.min(F.struct("m", store))
    return medians.groupBy("product_code").agg(best.alias("best"), F.count("*").alias("stores")).select("product_code", F.col(f"best.{store}").alias(store), F.col("best.m").alias("median_price_eur"), "stores")


def normal_text(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", " "))


def resolve_products(lines: DataFrame, aliases: DataFrame, catalogue: DataFrame, min_similarity: float = 0.75) -> DataFrame:
    """``lines`` (ticket_id, line_index, raw_text, enseigne) with ean, match_method and match_confidence.

    An alias of the same text and store comes first, then one of any store; validated aliases before others, then by confidence.
    Otherwise the catalogue name with the nearest spelling, if near enough, whichever word is misread; else method ``none``.
    """
    a = aliases.select(F.col("raw_text"), F.coalesce("enseigne", F.lit("")).alias("__store"), F.struct(F.coalesce("validated_by_user", F.lit(False)).alias("validated"), F.coalesce("confidence", F.lit(0.0)).cast("double").alias("confidence"), "ean").alias("__alias"))
    exact = a.groupBy("raw_text", "__store").agg(F.max("__alias").alias("__own"))
    loose = a.groupBy("raw_text").agg(F.max("__alias").alias("__any"))
    keyed = lines.withColumn("__store", F.coalesce("enseigne", F.lit("")))
    known = keyed.join(exact, ["raw_text", "__store"], "left").join(loose, "raw_text", "left").withColumn("__hit", F.coalesce("__own", "__any"))
    texts = known.where("__hit is null").select("raw_text").distinct().select("raw_text", normal_text(F.col("raw_text")).alias("__n"))
    names = catalogue.where("produit_nom is not null").select(F.col("ean").alias("key"), normal_text(F.col("produit_nom")).alias("name"))
    alike = spelt_alike(texts.select(F.col("__n").alias("text")), names, min_similarity)
    fuzzy = texts.join(alike, F.col("__n") == F.col("text")).select("raw_text", F.struct(F.col("key").alias("__ean"), F.col("similarity").alias("s")).alias("__fuzzy"))
    return known.join(fuzzy, "raw_text", "left").select(
        *lines.columns,
        F.coalesce(F.col("__hit.ean"), F.col("__fuzzy.__ean")).alias("ean"),
        F.when(F.col("__hit").isNotNull(), "alias").when(F.col("__fuzzy").isNotNull(), "fuzzy").otherwise("none").alias("match_method"),
        F.coalesce(F.col("__hit.confidence"), F.col("__fuzzy.s")).alias("match_confidence"),
    )


def ticket_detail(tickets: DataFrame, lines: DataFrame, key: str = "ticket_id", order: str = "line_index") -> DataFrame:
    """Each ticket with its lines as a list in order, empty where it has none."""
    rows = lines.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, *(c for c in lines.columns if c not in (key, order))))).alias("items"))
    out = tickets.join(rows, key, "left")
    return out.withColumn("items", F.coalesce("items", F.array().cast(out.schema["items"].dataType)))


def ticket_page(tickets: DataFrame, user: str, limit: int, offset: int = 0, newest: str = "uploaded_at", key: str = "ticket_id") -> DataFrame:
    """One page of every user's tickets, newest first, with ``total``, how many the user has."""
    mine = Window.partitionBy(user)
    ranked = tickets.withColumns({"row": F.row_number().over(mine.orderBy(F.col(newest).desc_nulls_last(), key)), "total": F.count("*").over(mine)})
    return ranked.where(F.col("row").between(offset + 1, offset + limit))


def apply_corrections(lines: DataFrame, tickets: DataFrame, patches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(lines, tickets, aliases, violations) after a batch of patches (ticket_id, line_index, ean, produit_nom, quantity, unit_price).

    A patch's values that aren't null win; its line counts as validated by the user, its ticket as validated, and a barcode it
    gives becomes an alias of the line's text in the ticket's store. A ticket with a patch for a line it doesn't have is a
    violation, and none of its patches apply.
    """
    keys = ["ticket_id", "line_index"]
    violations = patches.join(lines.select(*keys), keys, "left_anti")
    valid = patches.join(violations.select("ticket_id").distinct(), "ticket_id", "left_anti")
    fields = [c for c in ("ean", "produit_nom", "quantity", "unit_price") if c in patches.columns]
    new = valid.select(*keys, F.lit(True).alias("__patched"), *(F.col(c).alias(f"__{c}") for c in fields))
    joined = lines.join(new, keys, "left")
    hit = F.col("__patched").isNotNull()
    patched = joined.withColumns({
        **{c: F.coalesce(F.col(f"__{c}"), F.col(c) if c in lines.columns else F.lit(None)).cast(lines.schema[c].dataType if c in lines.columns else "string") for c in fields},
        "needs_validation": F.when(hit, F.lit(False)).otherwise(F.col("needs_validation")),
        "validated_by_user": F.when(hit, F.lit(True)).otherwise(F.col("validated_by_user")),
    })
    touched = valid.select("ticket_id").distinct().withColumn("__touched", F.lit(True))
    done = tickets.join(touched, "ticket_id", "left").withColumn("status", F.when(F.col("__touched"), F.lit("validated")).otherwise(F.col("status"))).drop("__touched")
    stores = tickets.select("ticket_id", F.coalesce("enseigne", F.lit("")).alias("enseigne"))
    aliases = (
        patched.where("__patched and __ean is not null and __ean <> ''").join(stores, "ticket_id")
        .groupBy("raw_text", "enseigne")
        .agg(F.max_by(F.struct("ean", *(["produit_nom"] if "produit_nom" in fields else [])), F.struct(*keys)).alias("last"))
        .select("raw_text", "enseigne", F.lit("user-validation").alias("source"), "last.*", F.lit(1.0).alias("confidence"), F.lit(True).alias("validated_by_user"))
    )
    return patched.drop("__patched", *(f"__{c}" for c in fields)), done, aliases, violations
