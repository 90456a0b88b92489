import random

from conftest import rows
from pyspark.sql import functions as F

from pricelens.operators import grams


def test_repeated_names_are_searched_once(spark):
    """Rows that repeat a name or brand: the same as every text against every row, of few rows of each."""
    names = ["red Apple", "apple pie", "Red pear", None, "plum"]
    data = [(i, names[i % 5], ["Apple & Co", "Noname", None][i % 3]) for i in range(90)]
    df = spark.createDataFrame(data, "ean long, produit_nom string, brand string")
    asked = spark.createDataFrame([("apple",), ("red",), ("p",), ("none",), ("",), (None,), ("no",)], "q string")
    expected = []
    for q in ("apple", "red", "p", "none", "no"):
        met = [(n is None, n or "", i) for i, n, b in data if q in (n or "").lower() or q in (b or "").lower()]
        expected += [(q, r + 1, i, None if none else n) for r, (none, n, i) in enumerate(sorted(met)[:4])]
    assert rows(grams.search_many(df, asked, limit=4, found=None)) == sorted(expected, key=repr)
    assert grams.few_of_each(df, "brand", [F.col("ean")], 4).count() == 12


def test_a_name_of_many_keys_is_compared_once(spark):
    """The largest key of a repeated name is found, whatever the number of keys."""
    names = spark.range(500).select(F.col("id").alias("key"), F.when(F.col("id") % 2 == 0, "green bolt").otherwise("small ring").alias("name"))
    texts = spark.createDataFrame([("grean bolt",), ("small rinq",), ("else",), ("",)], "text string")
    found = grams.spelt_alike(texts, names)
    assert rows(found) == [("grean bolt", 498, 0.9), ("small rinq", 499, 0.9)]


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        last, row[0] = row[0], i + 1
        for j, y in enumerate(b):
            last, row[j + 1] = row[j + 1], min(row[j + 1] + 1, row[j] + 1, last + (x != y))
    return row[-1]


def misread(rng, text, n):
    for _ in range(n):
        at, what = rng.randrange(len(text) + 1), rng.randrange(3)
        text = text[:at] + ("" if what == 2 else rng.choice("abc")) + text[at + (what > 0) :]
    return text


def test_names_of_few_edits_are_met_by_unchanged_parts(spark):
    """Short and long names of few letters against plain Python: each pair within the edits meets, whatever the block, and no other."""
    rng = random.Random(2)
    names = ["".join(rng.choice("abc") for _ in range(rng.choice((1, 2, 3, 4, 9, 14)))) for _ in range(60)]
    texts = sorted({misread(rng, n, rng.randrange(4)) for n in names})
    left, right = spark.createDataFrame([(a,) for a in texts], "s string"), spark.createDataFrame(list(enumerate(names)), "id long, s string")
    near = sorted({(a, i, edits(a, b)) for a in texts for i, b in enumerate(names) if a and edits(a, b) <= 2})
    for block in (4096, 3):
        assert sorted(set(rows(grams.few_edits(left, right, 2, block).select("a", "id", "edits")))) == near
    found = grams.few_edits(left.where("length(s) > 8"), right, 2, 4096)
    assert found.count() < 0.7 * sum(len(a) > 8 for a in texts) * len(names)
    best = []
    for a in filter(None, texts):
        s, i = max((1 - edits(a, b) / max(len(a), len(b)), i) for i, b in enumerate(names))
        best += [(a, i, round(s, 9))] if s >= 0.75 else []
    made = grams.spelt_alike(left.withColumnRenamed("s", "text"), right.select(F.col("id").alias("key"), F.col("s").alias("name")))
    assert sorted((a, i, round(s, 9)) for a, i, s in rows(made)) == sorted(best)
