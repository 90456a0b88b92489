"""Schemas of the tables that the library reads and writes."""

from __future__ import annotations

from pyspark.sql import types as T


_TYPES = {
    "string": T.StringType(), "date": T.DateType(), "double": T.DoubleType(), "boolean": T.BooleanType(), "timestamp": T.TimestampType(), "bigint": T.LongType(), "int": T.IntegerType(),
    "strings": T.ArrayType(T.StringType()), "decimal(10,2)": T.DecimalType(10, 2), "decimal(10,3)": T.DecimalType(10, 3), "decimal(5,2)": T.DecimalType(5, 2),
}


def _schema(*fields: str | tuple[str, T.DataType]) -> T.StructType:
    """Of "name type" texts, or (name, type) for nested types."""
    pairs = (f if isinstance(f, tuple) else (lambda n, k: (n, _TYPES[k]))(*f.split(" ", 1)) for f in fields)
    return T.StructType([T.StructField(n, k) for n, k in pairs])


#: A raw snapshot of price observations, as published; other columns may stand beside these.
RAW_PRICES = _schema(
    "id string", "date date", "product_code string", "price double", "price_without_discount double", "price_is_discounted boolean", "currency string", "location_id string", "location_osm_display_name string",
    "location_osm_address_country string", "location_osm_address_country_code string", "location_osm_address_city string", "location_osm_address_postcode string", "location_osm_lat double", "location_osm_lon double", "proof_type string",
)
CLEAN_PRICES = _schema(
    "id string", "pipeline_run_date date", "price_date date", "week_start_date date", "product_code string", "price_eur double", "price_eur_decimal string", "price_without_discount_eur double",
    "price_is_discounted boolean", "currency string", "proof_type string", "country_code string", "store_brand string", "store_brand_normalized string", "location_id string", "location_name string",
    "location_osm_display_name string", "city string", "postcode string", "latitude double", "longitude double", "iqr_outlier boolean", "source string", "ingested_at timestamp", "raw_payload string",
)
REJECTIONS = _schema(
    "pipeline_run_date date", "id string", "product_code string", "reason string", "details string", "currency string", "raw_price string", "raw_price_date string", "country_code string", "proof_type string",
    "rejected_at timestamp", "raw_payload string",
)
CATALOGUE = _schema(
    "ean string", "produit_nom string", "brand string", "category_l1 string", "category_l2 string", "category_l3 string", "nutriscore string", "nova_group string", "ecoscore string", "image_url string",
    "embedding_text string", "off_found boolean", "enriched_at timestamp",
)
PRODUCT_DOCUMENT = _schema(
    "code string", "status int",
    ("product", _schema(
        "product_name string", "product_name_fr string", "brands string", "categories_tags strings", "nutriscore_grade string", "nova_group int", "ecoscore_grade string", "image_front_url string", "image_url string",
        "quantity string", "labels_tags strings", "origins_tags strings",
    )),
)
BRAND_WEEKS = _schema("week_start_date date", "store_brand_normalized string", "country_code string", "observations bigint", "avg_price_eur double", "median_price_eur double")
BRAND_INDEX = _schema("week_start_date date", "store_brand_normalized string", "country_code string", "observations bigint", "median_price_eur double", "base_price double", "index_value double")
RANKINGS = _schema("reference_week date", "product_code string", "prev_median double", "curr_median double", "pct_change double")
ANOMALIES = _schema("week_start_date date", "product_code string", "store_brand_normalized string", "median_price_eur double", "observations bigint", "mean_med double", "std_med double", "z_score double")
RECEIPT = _schema(("ticket", _schema(
    "date string", "chaine_supermarche string", "adresse string", ("produits", T.ArrayType(_schema("nom_produit string", "prix_unitaire_ou_kg string", "unites string"))),
)))
TICKET_EVENT = _schema(
    ("message", _schema(("attributes", _schema("eventType string", "bucketId string", "objectId string")), "data string", "messageId string", "publishTime string")), "subscription string"
)
LINE_ITEMS = _schema(
    "ticket_id string", "line_index int", "raw_text string", "quantity decimal(10,3)", "unit_price decimal(10,2)", "line_total decimal(10,2)", "ean string", "match_method string", "match_confidence decimal(5,2)",
    "needs_validation boolean", "validated_by_user boolean",
)
