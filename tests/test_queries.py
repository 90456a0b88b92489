import __spark_entry__ as entry
import pytest

SF = "/root/testdata/sf0.001"


def test_registry():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["brand_week_index", "product_rankings", "dedup_first", "substitutes_topk", "laspeyres_regional", "ticket_events_decoded"])
def test_no_python_in_plans(spark, name):
    plan = entry.queries()[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InPandas" not in plan and "InArrow" not in plan


def test_substitutes_lsh_recall(spark):
    from pricelens.operators import similarity

    sf = "/root/testdata/sf0.01"
    found, truth = (entry.queries()[name](spark, sf).persist() for name in ("substitutes_lsh", "substitutes_topk"))
    got = similarity.recall(found, truth, key="vec_id").first()
    assert got.recall >= 0.9 and found.count() == truth.count()


def test_substitutes_lsh_completes_products(spark):
    """With buckets so narrow that hardly any are shared, each product has all its substitutes by the exact way."""
    from pyspark.sql import functions as F

    from pricelens.operators import similarity

    rows = spark.range(40).select("id", (F.col("id") % 2).alias("label"), F.array(*(F.sin(F.col("id") * k) for k in range(1, 9))).alias("embedding"))
    found = similarity.substitutes_lsh(rows.where("id > 0"), key="id", category="label", tables=1, bucket=1e-6)
    truth = similarity.substitutes(rows.where("id > 0"), key="id", category="label")
    assert similarity.recall(found, truth, key="id").first().recall == 1.0
