"""Texts met by the character n-grams they share: search for many texts at once, and names that are spelt alike.

Both build postings, rows of a gram and the name that holds it, and join on few of them: a search on the rarest gram of what is asked, a
match on the rarest grams of both sides, so many that no match is missed. What meets is verified on the texts themselves. Names of a few edits
are met first, by a part that the edits leave unchanged, and only texts whose best match may have more go on to their grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Length of the grams of a search; shorter texts are a gram of their own.
SEARCHED = 3


def grams(text: Column, n: Column | int) -> Column:
    """The distinct substrings of ``n`` characters."""
    size = n if isinstance(n, Column) else F.lit(n)
    return F.when(F.length(text) >= size, F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substring(text, i, size)))).otherwise(F.array().cast("array<string>"))


def few_of_each(rows: DataFrame, by: str, order: list[Column], n: int) -> DataFrame:
    """The first ``n`` rows of each value of ``by``."""
    nr = F.row_number().over(Window.partitionBy(by).orderBy(*order))
    return rows.withColumn("__nr", nr).where(F.col("__nr") <= n).drop("__nr")


def search_many(catalogue: DataFrame, asked: DataFrame, limit: int = 20, key: str = "ean", name: str = "produit_nom", also: str | None = "brand", found: str | None = "off_found", q: str = "q") -> DataFrame:
    """q, rank, key, name: for each different text of ``asked`` the rows whose name or ``also`` holds it, in any case, by name, up to ``limit``.

    A text is taken literally; an empty one, or null, finds nothing. Of a text's trigrams the rarest among the names is looked up, and
    what it finds is verified. Rows with a false or null ``found`` are left out.
    """
    rows = catalogue.where(F.col(found)) if found else catalogue
    rows = rows.select(F.col(key).alias("__key"), F.col(name).alias("__name"), F.lower(F.coalesce(name, F.lit(""))).alias("__low"), F.lower(F.coalesce(also, F.lit("")) if also else F.lit("")).alias("__also"))
    texts = asked.select(F.col(q).alias("__q"), F.lower(q).alias("__asked")).where("__asked <> ''").distinct()
    wanted = texts.select("__q", "__asked", F.explode(grams(F.col("__asked"), F.least(F.lit(SEARCHED), F.length("__asked")))).alias("gram"))
    # Different texts are searched once, however many rows have them.
    read = rows.select(F.col("__low").alias("__text")).union(rows.select("__also")).where("__text <> ''").distinct()
    postings = read.select("__text", F.explode(F.flatten(F.array(*(grams(F.col("__text"), n) for n in range(1, SEARCHED + 1))))).alias("gram"))
    # Only grams that are asked for are counted and kept.
    needed = wanted.select("gram").distinct()
    held = postings.select("gram").join(needed, "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("held"))
    rarest = wanted.join(held, "gram", "left").groupBy("__q", "__asked").agg(F.min_by("gram", F.struct(F.coalesce("held", F.lit(0)), "gram")).alias("gram"))
    texts_met = rarest.join(postings, "gram").where(F.contains("__text", F.col("__asked"))).select("__q", "__asked", "__text")
    # Of the rows of a name, and of those with one ``also``, no text lists more than the first up to its limit. A row found by both comes by its name.
    order = [F.col("__name").asc_nulls_last(), F.col("__key")]
    named = few_of_each(rows, "__name", [F.col("__key")], limit).join(texts_met, F.col("__low") == F.col("__text"))
    beside = few_of_each(rows.where("__also <> ''"), "__also", order, limit).join(texts_met, F.col("__also") == F.col("__text")).where(~F.contains("__low", F.col("__asked")))
    met = named.unionByName(beside)
    rank = F.row_number().over(Window.partitionBy("__q").orderBy(F.col("__name").asc_nulls_last(), "__key"))
    return met.withColumn("rank", rank).where(F.col("rank") <= limit).select(F.col("__q").alias(q), "rank", F.col("__key").alias(key), F.col("__name").alias(name))


#: Edits within which names are met by unchanged parts.
EDITS = 2


def few_edits(left: DataFrame, right: DataFrame, edits: int, block: int) -> DataFrame:
    """a, b, id, edits: the pairs of ``left`` (s) and ``right`` (id, s), neither empty, within ``edits`` edits; a pair may come more than once.

    Of a name cut into one more part than there are edits, one part is unchanged in any text so near (Li et al., 2011), and no further from its place than
    the edits before and after it allow. Parts that many names have are cut by hash, so that no task has all of them.
    """
    cut = lambda i, n: F.floor(n * i / (edits + 1)).cast("int")
    i, size = F.col("i"), F.col("size")
    start, wide = cut(i, size), cut(i + 1, size) - cut(i, size)
    held = right.where("s <> ''").select("id", F.col("s").alias("b"), F.length("s").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(edits))).alias("i"))
    held = held.select("id", "b", "size", "i", F.substring("b", start + 1, wide).alias("part"))
    places = [(d, n, x) for d in range(-edits, edits + 1) for n in range(edits + 1) for x in range(-edits, edits + 1) if abs(x) + abs(x - d) <= edits]
    place = F.explode(F.array(*(F.struct(F.lit(d).alias("longer"), F.lit(n).alias("i"), F.lit(x).alias("moved")) for d, n, x in places)))
    asked = left.where("s <> ''").select(F.col("s").alias("a"), place.alias("p")).select("a", "p.i", "p.moved", (F.length("a") - F.col("p.longer")).alias("size")).where("size > 0")
    asked = asked.where((start + F.col("moved") >= 0) & (start + F.col("moved") + wide <= F.length("a")))
    asked = asked.select("a", "size", "i", F.substring("a", start + F.col("moved") + 1, wide).alias("part"))
    on = ["size", "i", "part"]
    large = held.groupBy(*on).agg(F.count("*").alias("held")).where(F.col("held") > block).select(*on, F.ceil(F.col("held") / block).cast("int").alias("cuts"))
    cuts = F.coalesce("cuts", F.lit(1))
    told = held.join(large, on, "left").select(*on, "id", "b", F.pmod(F.xxhash64("id"), cuts).cast("int").alias("nr"))
    asked = asked.join(large, on, "left").select(*on, "a", F.explode(F.sequence(F.lit(0), cuts - 1)).alias("nr"))
    return asked.join(told, [*on, "nr"]).select("a", "b", "id", F.levenshtein("a", "b", edits).alias("edits")).where("edits >= 0")


def spelt_alike(texts: DataFrame, names: DataFrame, min_similarity: float = 0.75, block: int = 4096) -> DataFrame:
    """text, key, similarity: for each of ``texts`` (text) the most similar of ``names`` (key, name), ties to the larger key, if it is similar enough.

    Similarity is one less the edit distance over the longer length. Texts within d edits share all but 2 d of their bigrams, occurrences
    counted, so each has one of the other's among its own rarest, so many as it may lack and one more. Bigrams are
    weighed by how few names hold them, and only the rarest meet. Bigrams that many names have are cut by hash, so that no task has all of them.
    Before that all pairs of up to ``EDITS`` edits are found by unchanged parts; a text whose best of these is nearer than any with more edits is done.
    """
    slack = 2 * (1 - min_similarity)

    def rare(df: DataFrame, held: DataFrame | None) -> DataFrame:
        n = F.length("s")
        pieces = F.transform(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: F.substring(F.col("s"), i, F.lit(2)))
        each = df.where("s <> ''").select("id", "s", F.posexplode(pieces).alias("at", "piece"))
        numbered = each.withColumn("nr", F.row_number().over(Window.partitionBy("id", "piece").orderBy("at"))).select("id", "s", F.concat_ws("~", "piece", "nr").alias("gram"))
        if held is None:
            held = numbered.groupBy("gram").agg(F.count("*").alias("held"))
        weighed = numbered.join(held, "gram", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        # A longer partner may have up to n / min_similarity characters, and as many more edits.
        lacks = F.floor(n / min_similarity * slack + 1e-9).cast("int") + 1
        order = F.row_number().over(Window.partitionBy("id").orderBy("held", "gram"))
        return weighed.withColumn("order", order).where(F.col("order") <= lacks).select("id", "s", "gram", "held")

    left = texts.select("text").where("text is not null and text <> ''").distinct().select(F.col("text").alias("id"), F.col("text").alias("s"))
    # A name that several keys have is one name, and the largest key is the one that is wanted of it.
    right = names.where("name is not null").groupBy("name").agg(F.max("key").alias("key")).select(F.struct("key", "name").alias("id"), F.col("name").alias("s"))
    alike = lambda edits: 1 - edits / F.greatest(F.length("a"), F.length("b"))
    best_of = lambda pairs: pairs.where(F.col("similarity") >= min_similarity).groupBy("a").agg(F.max(F.struct("similarity", F.col("id.key").alias("key"))).alias("best"))
    shown = lambda best: best.select(F.col("a").alias("text"), F.col("best.key").alias("key"), F.col("best.similarity").alias("similarity"))
    # With e edits, one more than were looked for, the longer text has at most e characters more, and further edits make no better match.
    most = F.length("a") / (F.length("a") + EDITS + 1)
    done = best_of(few_edits(left, right, EDITS, block).withColumn("similarity", alike(F.col("edits")))).where(F.col("best.similarity") > most + 1e-12).persist()
    left = left.join(done.select(F.col("a").alias("s")), "s", "left_anti").select("id", "s").persist()
    if left.isEmpty():
        return shown(done)
    pieces = F.transform(F.sequence(F.lit(1), F.greatest(F.length("s") - 1, F.lit(1))), lambda i: F.substring(F.col("s"), i, F.lit(2)))
    each = right.where("s <> ''").select("id", F.posexplode(pieces).alias("at", "piece"))
    held = each.withColumn("nr", F.row_number().over(Window.partitionBy("id", "piece").orderBy("at"))).groupBy(F.concat_ws("~", "piece", "nr").alias("gram")).agg(F.count("*").alias("held")).persist()
    parts = F.greatest(F.ceil(F.col("held") / block), F.lit(1)).cast("int")
    asked = rare(left, held).select("gram", F.col("s").alias("a"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
    told = rare(right, held).select("gram", "id", F.col("s").alias("b"), F.pmod(F.xxhash64("id"), parts).cast("int").alias("part"))
    # No pair that is similar enough has more edits than the longest text of all may have.
    longest = left.select("s").union(right.select("s")).agg(F.max(F.length("s"))).first()[0] or 0
    edits = F.levenshtein("a", "b", int(longest * (1 - min_similarity) + 1e-9) + 1)
    long = F.least(F.length("a"), F.length("b")) >= min_similarity * F.greatest(F.length("a"), F.length("b")) - 1e-9
    pairs = asked.join(told, ["gram", "part"]).where(long).select("a", "b", "id").distinct().withColumn("similarity", F.when(edits >= 0, alike(edits)))
    return shown(done.unionByName(best_of(pairs)))
