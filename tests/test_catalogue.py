from conftest import rows

from pricelens.operators import catalogue


def test_embeddings_join_their_products(spark):
    products = spark.createDataFrame([("1", "a"), ("2", "b"), (None, "c")], "ean string, produit_nom string")
    vectors = spark.createDataFrame([("1", [0.5, 1.0]), ("9", [2.0, 2.0])], "ean string, embedding array<double>")
    assert rows(catalogue.with_embeddings(products, vectors).select("produit_nom", "embedding")) == [("a", [0.5, 1.0]), ("b", None), ("c", None)]


def test_delta_of_nothing(spark):
    """An export that repeats what is stored changes nothing, and neither does an empty one."""
    documents = spark.createDataFrame([("1", 1, ("Tea", "Brand")), ("2", 0, None)], "code string, status int, product struct<product_name:string,brands:string>")
    from pricelens.schemas import PRODUCT_DOCUMENT

    documents = spark.createDataFrame([], PRODUCT_DOCUMENT).unionByName(documents.selectExpr("code", "status", "from_json(to_json(product), '%s') AS product" % PRODUCT_DOCUMENT["product"].dataType.simpleString()))
    stored = catalogue.shape_catalogue(documents)
    prices = spark.createDataFrame([("1",), ("3",)], "product_code string")
    assert catalogue.daily_delta(documents, prices, stored).count() == 0
    assert rows(catalogue.daily_delta(documents, prices, stored.limit(0)).select("ean", "produit_nom")) == [("1", "Tea")]
    assert catalogue.daily_delta(documents.limit(0), prices, stored).count() == 0
