"""The product catalogue: which barcodes it lacks, what product documents say about them, search and lookup."""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import products as P
from ..functions.scalars import stripped
from ..schemas import CATALOGUE


def undiscovered(
    prices: DataFrame, catalogue: DataFrame, min_len: int = 8, limit: int | None = None, stale_days: int | None = None, run_date: date | None = None
) -> DataFrame:
    """product_code of priced barcodes that the catalogue lacks, or whose entry is older than ``stale_days``; by code, if there is a limit."""
    known = catalogue.select(F.col("ean").alias("product_code"), *(["enriched_at"] if stale_days is not None else []))
    if stale_days is not None:
        known = known.where(F.col("enriched_at") >= F.lit(run_date - timedelta(days=stale_days)).cast("timestamp"))
    codes = prices.where(F.length("product_code") >= min_len).select("product_code").distinct()
    missing = codes.join(known.select("product_code"), "product_code", "left_anti")
    return missing if limit is None else missing.orderBy("product_code").limit(limit)


def shape_catalogue(documents: DataFrame, enriched_at: datetime | None = None) -> DataFrame:
    """A catalogue row for each product document (code, status, product); a document that found nothing leaves a tombstone."""
    p = lambda c: F.nullif(F.col(f"product.{c}"), F.lit(""))
    found = F.coalesce(F.col("status") == 1, F.lit(False))
    l1, l2, l3 = P.category_levels(F.col("product.categories_tags"))
    name, brand = F.coalesce(p("product_name_fr"), p("product_name")), stripped(F.substring_index(F.col("product.brands"), ",", 1))
    shown: dict[str, Column] = {
        "produit_nom": name,
        "brand": brand,
        "category_l1": l1,
        "category_l2": l2,
        "category_l3": l3,
        "nutriscore": F.upper(p("nutriscore_grade")),
        "nova_group": F.when(F.col("product.nova_group") != 0, F.col("product.nova_group").cast("string")),
        "ecoscore": F.upper(p("ecoscore_grade")),
        "image_url": F.coalesce(p("image_front_url"), p("image_url")),
    }
    rows = documents.select(F.col("code").alias("ean"), found.alias("off_found"), *(F.when(found, c).alias(n) for n, c in shown.items()))
    text = P.embedding_text(F.col("produit_nom"), F.col("brand"), F.col("category_l3"), F.col("ean"))
    return rows.withColumns({"embedding_text": text, "enriched_at": F.lit(enriched_at).cast("timestamp")}).select(*CATALOGUE.names)


def initial_catalogue(documents: DataFrame, prices: DataFrame) -> DataFrame:
    """The documents of a bulk export whose barcode is priced."""
    codes = prices.select(F.col("product_code").alias("code")).distinct()
    return documents.join(codes, "code", "left_semi")


def daily_delta(documents: DataFrame, prices: DataFrame, catalogue: DataFrame, enriched_at: datetime | None = None) -> DataFrame:
    """The catalogue rows of a day's export that change something: of priced or known barcodes, those whose entry is new or differs."""
    codes = prices.select(F.col("product_code").alias("code")).union(catalogue.select("ean")).distinct()
    rows = shape_catalogue(documents.join(codes, "code", "left_semi"), enriched_at)
    stored = catalogue.select("ean", *(c for c in rows.columns if c not in ("ean", "enriched_at")))
    return rows.join(stored, [rows[c].eqNullSafe(stored[c]) for c in stored.columns], "left_anti")


def with_embeddings(catalogue: DataFrame, embeddings: DataFrame) -> DataFrame:
    """``catalogue`` with the embedding of each barcode that has one."""
    return catalogue.join(embeddings.select("ean", "embedding"), "ean", "left")


def search(df: DataFrame, q: str, limit: int = 20, name: str = "produit_nom", brand: str | None = "brand", found: str | None = "off_found") -> DataFrame:
    """Rows whose name or brand holds ``q``, in any case, by name; ``q`` is taken literally, and tombstones are left out."""
    hit = F.contains(F.lower(F.col(name)), F.lit(q.lower()))
    if brand:
        hit = F.coalesce(hit, F.lit(False)) | F.coalesce(F.contains(F.lower(F.col(brand)), F.lit(q.lower())), F.lit(False))
    rows = df.where(hit & F.col(found)) if found else df.where(hit)
    return rows.orderBy(F.col(name).asc_nulls_last(), *[c for c in ("ean",) if c in df.columns]).limit(min(limit, 100))


def lookup(keys: DataFrame, catalogue: DataFrame) -> DataFrame:
    """Each asked ``ean`` with its catalogue row and ``state``: enriched, tombstone or unknown."""
    row = catalogue.withColumn("__there", F.lit(True))
    state = F.when(F.col("__there").isNull(), "unknown").when(F.col("off_found"), "enriched").otherwise("tombstone")
    return keys.select("ean").join(row, "ean", "left").withColumn("state", state).drop("__there")


def comparable_groups(documents: DataFrame) -> DataFrame:
    """Unpackaged goods by category, labels and origins, whatever the order of the tags: the keys, codes and their number."""
    tags = lambda c: F.array_sort(F.array_distinct(F.coalesce(F.col(f"product.{c}"), F.array().cast("array<string>"))))
    keyed = documents.select("code", P.leaf_category(F.col("product.categories_tags")).alias("category_tag"), tags("labels_tags").alias("labels"), tags("origins_tags").alias("origins"))
    return keyed.groupBy("category_tag", "labels", "origins").agg(F.countDistinct("code").alias("products"), F.min("code").alias("example"))
