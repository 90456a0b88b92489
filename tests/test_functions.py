import datetime

import pytest
from pyspark.sql import functions as F

from pricelens.functions import products as P
from pricelens.functions import scalars as S


def values(spark, cases, fn):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(cases)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("x"))).collect()]


def test_price(spark):
    got = values(spark, ["3.49", "3,49", "3,49 €", " 12 ", None, "not a price", "1.2.3", "1.", "-", "", "1e5"], lambda c: S.parse_price(c).cast("double"))
    assert got == [3.49, 3.49, 3.49, 12.0, None, None, None, 1.0, None, None, 15.0]


def test_price_of_numbers(spark):
    df = spark.createDataFrame([(3.49, True), (float("nan"), False), (float("inf"), None), (None, None)], "d double, b boolean")
    assert [r[0] for r in df.select(S.price_of(F.col("d"), "double").cast("double")).collect()] == [3.49, None, None, None]
    assert [r[0] for r in df.select(S.price_of(F.col("b"), "boolean")).collect()] == [None] * 4


def test_date(spark):
    d = datetime.date(2026, 5, 17)
    cases = ["2026-05-17", "2026/05/17", "17/05/2026", "2026-05-17T03:14:00", "2026-05-17T03:14:00Z", "2026-05-17 03:14:00", "2026-05-17T03:14:00.123", "bogus", None, "2026-13-40"]
    assert values(spark, cases, S.parse_date) == [d] * 7 + [None] * 3
    assert values(spark, ["2026-05-17", "2026-05-11"], lambda c: S.week_start(S.parse_date(c))) == [datetime.date(2026, 5, 11)] * 2


def test_brand(spark):
    cases = {"E.Leclerc Drive, Lyon": "E.Leclerc", "Carrefour Hypermarché, Bordeaux": "Carrefour", "CARREFOUR MARKET": "Carrefour Market", "Monop' Daily, Paris": "Monoprix", "GÉANT CASINO": "Géant Casino", "Super U, Nantes": "Super U", "Bio C'Bon, Paris": "Bio C'Bon", "": None, None: None}
    assert values(spark, list(cases), S.canonical_brand) == list(cases.values())


def test_city(spark):
    cases = {"Paris 17e Arrondissement": "Paris", "Marseille 13e": "Marseille", "LYON": "Lyon", "lyon 7ème arrondissement": "Lyon", "Échirolles": "Échirolles", "saint-denis": "Saint-Denis", "  ": None, None: None}
    assert values(spark, list(cases), S.city_title) == list(cases.values())


def test_barcode(spark):
    good = ["3017620422003", "8076809513753", " 3017620422003 ", "96385074"]
    bad = ["9999999999999", "3017620422004", "12345678", "123456", "3017620422003X", "", None]
    assert [x is None for x in values(spark, good + bad, S.barcode_error)] == [True] * 4 + [False] * 7
    assert values(spark, ["3017620422004"], S.barcode_error) == ["checksum EAN-13 invalide (attendu 3, recu 4)"]


def test_country(spark):
    cases = {"France": "FR", "FRANCE": "FR", "fr": "FR", "FRA": "FR", "Guadeloupe": "GP", "saint   martin": "MF", "Atlantis": None, "": None, None: None}
    assert values(spark, list(cases), S.country_code) == list(cases.values())


@pytest.mark.parametrize("price,full,flag,ok", [(2.0, 3.0, False, True), (2.0, None, True, True), (3.0, 2.0, True, False), (0.05, 5.0, True, False), (2.0, 3.0, True, True)])
def test_discount(spark, price, full, flag, ok):
    df = spark.createDataFrame([(price, full, flag)], "p double, f double, d boolean")
    assert (df.select(S.discount_error(F.col("p"), F.col("f"), F.col("d"))).first()[0] is None) is ok


def test_quantity_and_categories(spark):
    got = values(spark, ["750 g", "1 L", "6x125g", "33 cl", "2 x 50 cl", "about", None], P.quantity)
    assert [tuple(x) if x else None for x in got] == [(750.0, "g"), (1.0, "L"), (750.0, "g"), (330.0, "ml"), (1000.0, "ml"), None, None]
    df = spark.createDataFrame([(["en:foods", "en:meat", "fr:x"],), ([],), (None,), (["fr:a", "fr:b"],)], "t array<string>")
    shown = df.select(*P.category_levels(F.col("t")), P.leaf_category(F.col("t")), P.category_group(F.col("t"))).collect()
    assert [tuple(r) for r in shown] == [("en:foods", "en:meat", "fr:x", "en:meat", "Fish Meat Eggs"), (None,) * 5, (None,) * 5, ("fr:a", None, "fr:b", "fr:b", None)]


def test_uuid_and_department(spark):
    assert values(spark, ["550E8400E29B41D4A716446655440000", "x"], S.dashed_uuid) == ["550e8400-e29b-41d4-a716-446655440000", "x"]
    assert values(spark, ["75011", "97410", "20090", "20200", "abc", None], P.department) == ["75", "974", "2A", "2B", None, None]


def test_stripping_is_no_search(spark):
    """White space as Python has it, of each kind at both ends, without a pattern, whose search took most of the time of cleaning and of lines."""
    from pyspark.sql import functions as F

    white = [chr(i) for i in range(0x3001) if chr(i).isspace()]
    texts = [*(f"{w} a{w} b {w}" for w in white), *white, "", None, "x", "\u200b y"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", S.stripped(F.col("t")).alias("got"))
    assert [r.got for r in df.collect()] == [((t or "").strip() or None) for t in texts]
    assert "regexp" not in df._jdf.queryExecution().optimizedPlan().toString()
    odd = "550E8400E29B41D4A716446655440000\n"
    assert [r[0] for r in spark.createDataFrame([(odd,)], "t string").select(S.dashed_uuid(F.col("t"))).collect()] == ["550e8400-e29b-41d4-a716-446655440000"]


def test_a_code_is_stripped_once(spark):
    """A code that is stripped already has the same errors, without another search for white space."""
    codes = ["3017620422003", "3017620422004", "12345678", "12a", "", None]
    assert values(spark, codes, lambda c: S.code_error(S.stripped(c))) == values(spark, codes, S.barcode_error)
    plan = spark.createDataFrame([("1",)], "c string").select(S.code_error(F.col("c")))._jdf.queryExecution().optimizedPlan().toString()
    assert "trim(" not in plan
