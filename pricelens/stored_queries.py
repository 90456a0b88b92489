"""Registered queries that go through stored tables: each writes with an operator of ``sources``, reads back, and has the SQL for what must be there.

The tables lie in the folder that the session names in ``spark.checkpoint.dir``, which a cluster shares.
"""

from __future__ import annotations

import tempfile
import uuid
from datetime import timedelta, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import queries as Q
from .functions import products as P
from .functions.scalars import dashed_uuid
from .operators import baskets, catalogue, cleaning, receipts, similarity
from .plans import daily, gold, serving
from .queries import _CATALOGUE, _HISTORY, _MOVES, _PURCHASES, PRICE_OBS, RAW_SQL, RUN, _r6, _weekly, price_obs, r6, t
from .schemas import CATALOGUE, RAW_PRICES
from .sources import tables
from .streaming import events


AT_UTC = Q.AT.replace(tzinfo=timezone.utc)


def folder(spark: SparkSession) -> str:
    """A folder of this call's own in the shared one; without one only where all runs on this machine."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/stored-{uuid.uuid4().hex}"


# Sources and sinks ----------------------------------------------------------------------------------------------------


def partition_replace(spark, sf_dir):
    """One partition gets fewer rows and another none."""
    ev, at = t(spark, sf_dir, "events").select("event_id", "event_type", "value"), f"{folder(spark)}/events"
    tables.replace_table(ev, at, "event_type", ["value"])
    tables.replace_partition(at, ev.where("event_type = 'click' and value > 100"), "event_type", "click")
    tables.replace_partition(at, ev.limit(0), "event_type", "view")
    return spark.read.parquet(at).groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids"))


def _lines(spark, sf_dir):
    return t(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").alias("quantity"), F.min("l_shipdate").cast("date").alias("day"))


def upsert_prices(spark, sf_dir):
    """All lines in partitions by year: lines 4 and 5 are met again, with a new quantity or none, and 6 and 7 come; then once more the same."""
    li, at = _lines(spark, sf_dir).withColumn("year", F.year("day")), f"{folder(spark)}/prices"
    keys = ["l_orderkey", "l_linenumber"]
    tables.upsert(at, li.where("l_linenumber <= 5"), keys, partition_col="year")
    source = li.where("l_linenumber >= 4").withColumn("quantity", F.when(F.col("l_orderkey") % 2 == 0, F.col("quantity") + 100))
    for _ in range(2):
        tables.upsert(at, source, keys, keep_if_null=("quantity",), partition_col="year")
    return spark.read.parquet(at).select(*keys, "quantity", "day")


def upsert_lines(spark, sf_dir):
    """Lines parsed again take the new text, and keep whether a user has validated them."""
    li, at = _lines(spark, sf_dir), f"{folder(spark)}/lines"
    rows = li.select(F.col("l_orderkey").alias("ticket_id"), F.col("l_linenumber").alias("line_index"), F.concat(F.lit("A"), F.col("quantity").cast("int").cast("string")).alias("raw_text"), (F.col("l_orderkey") % 3 == 0).alias("validated_by_user"))
    tables.upsert(at, rows.where("line_index <= 4"), ["ticket_id", "line_index"])
    again = rows.where("line_index >= 3").withColumns({"raw_text": F.concat(F.lit("B"), F.col("raw_text")), "validated_by_user": F.lit(False)})
    tables.upsert(at, again, ["ticket_id", "line_index"], update_cols=["raw_text"])
    return spark.read.parquet(at)


def upsert_aliases(spark, sf_dir):
    """Aliases by text, store and source, of which some have no store: a reading of each, then those that users validate and some that are read anew."""
    su, at = t(spark, sf_dir, "supplier"), f"{folder(spark)}/aliases"

    def alias(source: str, mark: str, rows):
        store = F.when(F.col("s_suppkey") % 2 == 0, F.col("s_nationkey").cast("string"))
        named = rows.select(F.col("s_name").alias("raw_text"), store.alias("enseigne"), F.lit(source).alias("source"), F.concat(F.lit(mark), F.col("s_suppkey").cast("string")).alias("ean"))
        return tables.alias_key(named).dropDuplicates(tables.ALIAS_KEY)

    tables.upsert(at, alias("ocr", "a", su), tables.ALIAS_KEY)
    tables.upsert(at, alias("user-validation", "b", su.where("s_suppkey % 3 = 0")).unionByName(alias("ocr", "c", su.where("s_suppkey % 5 = 0"))), tables.ALIAS_KEY)
    return spark.read.parquet(at)


def model_outputs(spark, sf_dir):
    """Product names as a model's transcriptions, some of them chatty, short or empty: what is left of each, and why it is no use."""
    k, lines = F.col("p_partkey") % 4, F.concat_ws("\n", "p_name", "p_type")
    text = F.when(k == 0, F.col("p_name")).when(k == 1, F.concat(F.lit("```\nVoici le ticket\n"), lines, F.lit("\n\njson\n```"))).when(k == 2, F.concat(F.lit("I think it says\n"), lines)).otherwise(" ")
    return t(spark, sf_dir, "part").select("p_partkey", receipts.clean_transcription(text).alias("cleaned"), receipts.output_error(text, "transcribe").alias("error"))


def merged_passes(spark, sf_dir):
    """Orders read in three passes: one with the shop, one with items and an address, one without any: the ticket of each."""
    od = t(spark, sf_dir, "orders").select("o_orderkey")
    item = lambda n: F.struct(F.concat(F.lit("ITEM "), n).alias("nom_produit"), F.lit("1.50").alias("prix_unitaire_ou_kg"), F.lit("1").alias("unites"))
    none = F.array().cast("array<struct<nom_produit:string,prix_unitaire_ou_kg:string,unites:string>>")
    number = F.col("o_orderkey").cast("string")
    ticket = lambda shop, address, items: F.to_json(F.struct(F.struct(F.lit("03/11/2025 10:00").alias("date"), shop.alias("chaine_supermarche"), address.alias("adresse"), items.alias("produits")).alias("ticket")))
    passes = (ticket(F.concat(F.lit("SHOP "), number), F.lit(""), none), ticket(F.lit(" "), F.concat(number, F.lit(" ROAD")), F.array(item(number), item(F.lit("X")))), ticket(F.lit("OTHER"), F.lit("ELSEWHERE"), none))
    parts = od.select(F.col("o_orderkey").alias("ticket_id"), F.posexplode(F.array(*passes)).alias("pass_nr", "text"))
    merged = receipts.merge_partial(parts)
    return merged.select("ticket_id", F.col("ticket.chaine_supermarche").alias("shop"), F.col("ticket.adresse").alias("address"), F.size("ticket.produits").cast("long").alias("items"), F.col("ticket.produits")[0]["nom_produit"].alias("first"))


def embedded_products(spark, sf_dir):
    """The parts with the vectors that some of them have, and the group of their categories."""
    parts = t(spark, sf_dir, "part").select(F.col("p_partkey").alias("ean"), F.col("p_size"))
    vectors = t(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("ean"), "embedding")
    tags = F.array(F.lit("en:unknown"), F.element_at(F.array(F.lit("en:dairy"), F.lit("en:none"), F.lit("en:fish"), F.lit("en:beverages")), F.col("p_size") % 4 + 1), F.lit("en:meat"))
    return catalogue.with_embeddings(parts, vectors).select("ean", F.col("embedding").isNotNull().alias("embedded"), P.category_group(tags).alias("group"))


def upsert_catalogue(spark, sf_dir):
    """The catalogue in full, then every third product again as it is today, and some that are new."""
    at = f"{folder(spark)}/catalogue"
    shaped = catalogue.shape_catalogue(Q.product_documents(spark, sf_dir)).select(*(f.name for f in CATALOGUE.fields))
    code = F.col("ean").cast("long")
    tables.upsert(at, shaped.where(code % 10 != 1), ["ean"])
    tables.upsert(at, shaped.where(code % 3 == 0).withColumn("brand", F.concat(F.lit("new "), F.col("brand"))), ["ean"])
    return spark.read.parquet(at).select("ean", "brand", "off_found")


def snapshot_archive(spark, sf_dir):
    """A snapshot archived by its day, twice, first of a single line and then of all, and read back with the schema of snapshots; a day without one is empty."""
    base, line = folder(spark), F.broadcast(t(spark, sf_dir, "lineitem").limit(1))
    for lines in (line, None):
        at = tables.write_archive(cleaning.conform(Q.raw_snapshot(spark, sf_dir, lines), RAW_PRICES), base, RUN)
    count = lambda df, what: df.agg(F.count("*").alias("n"), F.countDistinct(F.nullif("id", F.lit(" "))).alias("ids"), F.count("price_without_discount").alias("full_prices"), F.max("date").alias("last")).select(F.lit(what).alias("what"), "*")
    return count(tables.read_snapshot(spark, at), "read").unionByName(count(tables.read_or_empty(spark, f"{base}/dt=2000-01-01", RAW_PRICES), "absent"))


def stored_documents(spark, sf_dir):
    """Product documents written as lines of JSON, read back and shaped."""
    at = f"{folder(spark)}/documents"
    Q.product_documents(spark, sf_dir).write.json(at)
    return catalogue.shape_catalogue(tables.read_product_documents(spark, at)).drop("enriched_at")


def streamed_events(spark, sf_dir):
    """Ticket events written as lines of JSON and taken in by a stream that ends when all is read."""
    base = folder(spark)
    Q.ticket_events(spark, sf_dir).write.json(f"{base}/in")
    stream = tables.stream_ticket_events(spark, f"{base}/in").writeStream.format("parquet").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start(f"{base}/out")
    stream.awaitTermination()
    valid, dead = events.decode_events(spark.read.parquet(f"{base}/out"))
    return valid.select("ticket_id", "user_id", F.lit("").alias("reason")).unionByName(dead.select(F.lit("").alias("ticket_id"), F.lit("").alias("user_id"), "reason"))


def ticket_states(spark, sf_dir):
    """Uploads in two deliveries a day apart and an attempt on a third day: each ticket's state and attempts, its repeats and lines.

    Of the tickets a fifth never get a text, a fifth get one on the second day, and a fifth a blank one.
    """
    base, k = folder(spark), F.col("message.messageId").cast("long")
    uploads, delivery = Q.ticket_events(spark, sf_dir), F.when(k % 500 % 3 == 2, 1).otherwise(F.floor(k / 500) % 2)
    receipt = "MARCHE BLEU\n3 rue Y\n02/02/2024 10:00\nSAVON DOUX   2,40 €\nTOTAL 2,40"
    ids = t(spark, sf_dir, "events").select((F.col("event_id") % 500).alias("g")).distinct()
    known = ids.select("g", dashed_uuid(F.md5(F.col("g").cast("string"))).alias("ticket_id"), F.when(F.col("g") % 5 == 2, " ").otherwise(receipt).alias("text"))
    day = lambda n: AT_UTC + timedelta(days=n)
    texts = lambda n: known.where((F.col("g") % 5 > 0) & ((F.col("g") % 5 != 1) | F.lit(n > 0))).select("ticket_id", "text")
    for n in (0, 1):
        uploads.where(delivery == n).write.mode("append").json(f"{base}/in")
        stream = events.run_ticket_stream(tables.stream_ticket_events(spark, f"{base}/in"), lambda n=n: texts(n), f"{base}/out", clock=lambda n=n: day(n))
        stream.awaitTermination()
    events.attempt(spark, texts(2), f"{base}/out", day(2))
    repeats = spark.read.parquet(f"{base}/out/repeats").groupBy("ticket_id").agg(F.count("*").alias("repeats"))
    lines = spark.read.parquet(f"{base}/out/lines").groupBy("ticket_id").agg(F.count("*").alias("lines"))
    tickets = spark.read.parquet(f"{base}/out/tickets").join(repeats, "ticket_id", "left").join(lines, "ticket_id", "left")
    return tickets.select("ticket_id", "status", "attempts", F.coalesce("repeats", F.lit(0)).alias("repeats"), F.coalesce("lines", F.lit(0)).alias("lines"))


def ticket_waits(spark, sf_dir):
    """Clicks as claims and purchases of the same user as texts: each claim with what came within the hour, or timed out."""
    ev = t(spark, sf_dir, "events")
    claims = ev.where("event_type = 'click'").select(F.col("user_id").alias("ticket_id"), F.col("ts").alias("claimed_at"), "event_id")
    texts = ev.where("event_type = 'purchase'").select(F.col("user_id").alias("ticket_id"), F.col("event_id").cast("string").alias("text"), F.col("ts").alias("read_at"))
    return events.awaited(claims, texts, "6 hours").select("event_id", "text")


def clustered_products(spark, sf_dir):
    """The order lines as products with vectors: three for each line, in 20 categories of 40 clusters each, in 12 dimensions."""
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")) * 4 + F.col("j")
    li = t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("j"))
    group, cluster = F.col("l_partkey") % 20, F.floor(F.col("l_partkey") / 20) % 40
    wave = lambda seed, i: F.sin(F.pmod(F.xxhash64(*seed, F.lit(i)), F.lit(1_000_003)))
    v = F.array(*(wave((group, cluster), i) + 0.2 * wave((number,), 100 + i) for i in range(12)))
    return li.select(number.alias("key"), group.alias("category"), v.alias("embedding")).dropDuplicates(["key"])


def substitutes_ivf_recall(spark, sf_dir):
    """Substitutes by an inverted file for every twentieth product against all: recall at 5 is 0.9 or more with less than a fifth of the pairs."""
    products = clustered_products(spark, sf_dir).persist()
    asked = products.where("key % 20 = 0").select("key")
    near, held = (df.persist() for df in similarity.probed(products, "key", "category", "embedding", asked))
    pairs = near.groupBy("c0", "cell").agg(F.count("*").alias("a")).join(held.groupBy("c0", "cell").agg(F.count("*").alias("b")), ["c0", "cell"]).agg(F.sum(F.col("a") * F.col("b")).alias("pairs"))
    # Those that look into no cell are compared with their whole category.
    rest = products.join(asked, "key", "left_semi").join(near.select(F.col("a").alias("key")).distinct(), "key", "left_anti").groupBy("category").agg(F.count("*").alias("a"))
    rest = rest.join(products.groupBy("category").agg(F.count("*").alias("b")), "category").agg(F.sum(F.col("a") * F.col("b")).alias("whole"))
    pairs = pairs.crossJoin(F.broadcast(rest)).select((F.coalesce("pairs", F.lit(0)) + F.coalesce("whole", F.lit(0))).alias("compared"))
    sizes = products.groupBy("category").agg(F.count("*").alias("n"), F.count_if(F.col("key") % 20 == 0).alias("asked")).agg(F.sum(F.col("n") * F.col("asked")).alias("all"), F.sum("asked").alias("asked"))
    more = {"key": "key", "category": "category", "asked": asked}
    got = similarity.recall(similarity.substitutes_ivf(products, **more, made=(near, held)), similarity.substitutes(products, **more), key="key")
    whole = got.crossJoin(F.broadcast(pairs)).crossJoin(F.broadcast(sizes))  # three rows of one
    return whole.select("asked", F.col("pairs").alias("wanted"), (F.col("recall") >= 0.9).alias("recall_ok"), (F.col("compared") < 0.2 * F.col("all")).alias("share_ok"))


def substitutes_ivf(spark, sf_dir):
    """On the given vectors, which have no clusters: how many products have substitutes, and that recall at 5 is no less than a half."""
    vectors = Q._vectors(spark, sf_dir)
    more = {"key": "vec_id", "category": "label"}
    got = similarity.recall(similarity.substitutes_ivf(vectors, **more), similarity.substitutes(vectors, **more), key="vec_id")
    return got.select(F.col("pairs").alias("wanted"), (F.col("recall") >= 0.5).alias("recall_ok"))


def json_rows(spark, sf_dir):
    rows = t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("day"), F.when(F.col("o_orderkey") % 3 > 0, F.col("o_orderpriority")).alias("priority"), (F.col("o_custkey") > 100).alias("late"))
    return tables.json_rows(rows)


def gold_counts(spark, sf_dir):
    """The gold tables with their default medians, refreshed; the counts that the refresh returns, and those of the tables read back."""
    base = folder(spark)
    counted = tables.refresh(gold.gold_tables(price_obs(spark, sf_dir), RUN, weeks=None), base)
    out = None
    for name, n in counted.items():
        row = spark.read.parquet(f"{base}/{name}").agg(F.count("*").alias("stored")).select(F.lit(name).alias("name"), F.lit(n).cast("long").alias("n"), "stored")
        out = row if out is None else out.unionByName(row)
    return out


def gold_default_medians(spark, sf_dir):
    """The mergeable medians that the gold tables take by default; observed values, so the lower of two middle ones."""
    base = folder(spark)
    tables.refresh({"brand_week_index": gold.brand_week_index(price_obs(spark, sf_dir), weeks=None)}, base)
    return spark.read.parquet(f"{base}/brand_week_index").withColumn("index_value", r6("index_value"))


def alert_report_stored(spark, sf_dir):
    """The alert report written to its sink and read back as rows: section, place, product, week and the counts beside them."""
    prices, base = price_obs(spark, sf_dir), folder(spark)
    moves, odd = gold.product_rankings(prices, weeks=None, top_n=None), gold.price_anomalies(prices, weeks=None, z=1.0, keys=("product_code",))
    assert tables.write_report(spark.createDataFrame([("{}",)], "report string"), None, RUN) is None
    for report in (spark.createDataFrame([("{}",)], "report string"), gold.alert_report(moves, odd, RUN)):
        at = tables.write_report(report, base, RUN)
    entry = "array<struct<product_code:string,reference_week:date,week_start_date:date>>"
    read = spark.read.text(at).select(F.from_json("value", f"run_date string, counts struct<rankings:int,anomalies:int>, rankings {entry}, anomalies {entry}").alias("r"))
    section = lambda name: read.select("r.run_date", F.lit(name).alias("section"), F.col(f"r.counts.{name}").cast("long").alias("listed"), F.posexplode(f"r.{name}").alias("place", "x"))
    both = section("rankings").unionByName(section("anomalies"))
    return both.select("run_date", "section", "listed", (F.col("place") + 1).cast("long").alias("place"), "x.product_code", F.coalesce("x.reference_week", "x.week_start_date").alias("week"))


def daily_run(spark, sf_dir):
    """The daily chain over the snapshot, twice; the rows of the second run, and of the tables it leaves."""
    base = folder(spark)
    for _ in range(2):
        counts = daily.run_daily(Q.raw_snapshot(spark, sf_dir), base, Q.LAST, Q.AT, order=[F.col("seen")], weeks=None)
    counts["stored prices"] = spark.read.parquet(f"{base}/prices").count()
    counts["reports"] = spark.read.text(f"{base}/alerts/date={Q.LAST}/report").count()
    return spark.createDataFrame(list(counts.items()), "name string, n long")


def daily_weeks(spark, sf_dir):
    """Five days of snapshots, each with prices of eight dates, taken in by change: the gold tables equal those of a rebuild from all prices, and how many rows they have."""
    base, raw = folder(spark), Q.raw_snapshot(spark, sf_dir)
    order = F.coalesce(F.substring_index(F.col("id"), "-", 1).try_cast("int"), F.lit(0)) % 40
    raw = raw.withColumns({"date": F.date_sub(F.lit(Q.LAST), order), "dt": F.date_add(F.lit(Q.LAST), F.floor(order / 8).cast("int"))})
    raw.write.partitionBy("dt").parquet(f"{base}/archive")
    rules = cleaning.CleanConfig(reference_date=Q.LAST)
    daily.follow(spark, f"{base}/archive", f"{base}/out", raw.drop("dt").schema, Q.AT, config=rules, order=[F.col("seen")], exact=True, weeks=None, recent=None, top_n=None, z=2.0).awaitTermination()
    prices = spark.read.parquet(f"{base}/out/prices")
    whole = gold.gold_of_weeks(gold.weekly_states(prices, exact=True), Q.LAST, weeks=None, recent=None, top_n=None, z=2.0)
    out = prices.agg(F.lit("prices").alias("name"), F.count("*").alias("n"), F.lit(True).alias("same"))
    for name, made in whole.items():
        exact = [r6(c).alias(c) if c in ("avg_price_eur", "index_value", "pct_change", "mean_med", "std_med", "z_score") else F.col(c) for c in made.columns]
        kept, made = spark.read.schema(made.schema).parquet(f"{base}/out/gold/{name}").select(*exact), made.select(*exact)
        apart = kept.exceptAll(made).unionByName(made.exceptAll(kept)).agg(F.count("*").alias("apart"))
        out = out.unionByName(kept.agg(F.count("*").alias("n")).crossJoin(F.broadcast(apart)).select(F.lit(name).alias("name"), "n", (F.col("apart") == 0).alias("same")))
    return out


def catalogue_delta(spark, sf_dir):
    """A day's export against the catalogue: every fifth document has a new brand, and some products are not stored yet."""
    documents = Q.product_documents(spark, sf_dir)
    code = F.col("code").cast("long")
    stored = catalogue.shape_catalogue(documents.where(code % 7 != 0))
    changed = documents.withColumn("product", F.col("product").withField("brands", F.when(code % 5 == 0, "Other brand").otherwise(F.col("product.brands"))))
    prices = t(spark, sf_dir, "part").where("p_partkey % 2 = 0").select(F.col("p_partkey").cast("string").alias("product_code"))
    return catalogue.daily_delta(changed, prices, stored).select("ean", "brand", "off_found")


def dead_letters(spark, sf_dir):
    """Users as tickets: those with clicks fail once more than they have errors; then letters of eight days are dropped."""
    ev = t(spark, sf_dir, "events")
    attempts = ev.where("event_type = 'error'").groupBy(F.col("user_id").alias("ticket_id")).agg(F.count("*").alias("attempts"))
    made = events.retried(ev.where("event_type = 'click'").select(F.col("user_id").alias("ticket_id")), attempts, Q.AT)
    dead = made.where("dead_at is not null").withColumn("dead_at", F.when(F.col("ticket_id") % 2 == 0, F.col("dead_at") - F.make_interval(days=F.lit(8))).otherwise(F.col("dead_at")))
    waits = made.where("dead_at is null").select("ticket_id", "attempts", (F.unix_timestamp("next_at") - F.unix_timestamp(F.lit(Q.AT).cast("timestamp"))).alias("wait"))
    return waits.unionByName(events.kept_letters(dead, Q.AT).select("ticket_id", "attempts", F.lit(-1).cast("long").alias("wait")))


# What other queries leave out of their results ------------------------------------------------------------------------


def clean_metadata(spark, sf_dir):
    """Coordinates, payload and run columns of clean prices."""
    raw = Q.raw_snapshot(spark, sf_dir)
    k = F.length("location_osm_display_name")
    raw = raw.withColumns({"location_osm_lat": F.when(k % 3 == 0, F.lit("NaN")).when(k % 3 == 1, F.lit("x")).otherwise(F.lit(" 45.5")), "location_osm_lon": F.when(F.col("price") > 100, float("inf")).otherwise(F.col("price"))})
    clean, _, _ = cleaning.transform_prices(raw, Q.LAST, Q.AT, order=[F.col("seen")])
    return clean.select(
        "id", "latitude", r6("longitude").alias("longitude"), "pipeline_run_date", "source", F.col("ingested_at").isNotNull().alias("ingested"),
        F.get_json_object("raw_payload", "$.product_code").alias("payload_code"), F.get_json_object("raw_payload", "$.seen.l_suppkey").cast("long").alias("payload_suppkey"), F.col("raw_payload").contains('"price_without_discount":null').alias("payload_null"),
    )


def rejection_records(spark, sf_dir):
    """Every rejected row with its reason, source values and run columns."""
    _, rejected, _ = Q._transformed(spark, sf_dir)
    return rejected.select("id", "reason", "currency", "country_code", "proof_type", F.col("raw_price").cast("double").alias("raw_price"), "pipeline_run_date")


def rejection_metrics(spark, sf_dir):
    """The map of rejections by reason, as rows."""
    _, _, metrics = Q._transformed(spark, sf_dir)
    return metrics.select(F.explode("rejections_by_reason").alias("reason", "n"))


def brand_increases(spark, sf_dir):
    """The median change of a brand and its five largest increases, one to a row."""
    stats = serving.brand_stats(Q.catalogue_of(spark, sf_dir), price_obs(spark, sf_dir).withColumn("iqr_outlier", F.lit(False)), gold.product_rankings(price_obs(spark, sf_dir), weeks=None, top_n=None, exact=True), exact=True)
    return stats.select("brand", r6("median_pct_change").alias("median_pct_change"), F.explode("top_increases").alias("x")).select("brand", "median_pct_change", F.col("x.rank").cast("long").alias("place"), "x.ean", r6("x.pct_change").alias("pct_change"))


def index_points(spark, sf_dir):
    """The points of the index series, one to a row."""
    made = baskets.index_series(baskets.laspeyres(Q.purchases(spark, sf_dir), ["enseigne"]), ["enseigne"])
    return made.select("enseigne", F.explode("series").alias("x")).select("enseigne", F.col("x.date").cast("date").alias("period"), r6("x.value").alias("value"))


def personal_alerts(spark, sf_dir):
    """Alerts of all users over all moves, not only the largest ones."""
    bought, moves = Q.purchases(spark, sf_dir), gold.product_rankings(price_obs(spark, sf_dir), weeks=None, top_n=None, exact=True)
    prefs = t(spark, sf_dir, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(1.0).alias("threshold_pct"), F.array(F.lit("Brand#11"), F.lit("Brand#23")).alias("favorite_enseignes"))
    found = baskets.personal_alerts(moves, baskets.basket_history(bought, RUN, months=120), prefs, bought)
    return found.groupBy("user_id").agg(F.count("*").alias("alerts"), r6(F.max("pct_change")).alias("largest"))


def resolve_lines(spark, sf_dir):
    """Every receipt line with the barcode that an alias or the nearest spelling gives it."""
    part = t(spark, sf_dir, "part")
    k = F.col("p_partkey") % 4
    lines = part.select(F.col("p_partkey").alias("ticket_id"), F.lit(0).alias("line_index"), F.when(k == 0, F.upper("p_name")).when(k == 1, F.concat("p_name", F.lit("e"))).otherwise(F.col("p_brand")).alias("raw_text"), F.when(k == 2, F.lit("x")).otherwise("").alias("enseigne"))
    alias = lambda store, mark, sure: part.select(F.col("p_brand").alias("raw_text"), F.lit(store).alias("enseigne"), F.concat(F.lit(mark), F.col("p_brand")).alias("ean"), F.lit(sure).alias("confidence"), F.lit(True).alias("validated_by_user")).distinct()
    found = baskets.resolve_products(lines, alias("", "a", 0.5).unionByName(alias("x", "x", 0.25)), Q.catalogue_of(spark, sf_dir).select("ean", "produit_nom"))
    return found.select("ticket_id", "raw_text", "ean", "match_method", r6("match_confidence").alias("match_confidence"))


def substitute_states(spark, sf_dir):
    """found, none or unknown for products asked for: of every tenth vector, some alone in their category, and some that are not there."""
    rows = Q._vectors(spark, sf_dir).withColumn("label", F.when(F.col("vec_id") % 50 == 0, -F.col("vec_id") - 1).otherwise(F.col("label")))
    table = similarity.substitutes(rows, k=3, key="vec_id", category="label", digits=6)
    asked = rows.where("vec_id % 10 = 0").select("vec_id").union(rows.where("vec_id % 20 = 0").select(-F.col("vec_id") - 1))
    return similarity.lookup_substitutes(asked, rows, table, key="vec_id").select("vec_id", "state", F.coalesce(F.size("substitutes"), F.lit(0)).cast("long").alias("listed"))


def substitutes_recall(spark, sf_dir):
    """Whether the approximate substitutes hold nine tenths of the exact ones, and as many products."""
    found, truth = Q.substitutes_lsh(spark, sf_dir), similarity.substitutes(Q._vectors(spark, sf_dir), key="vec_id", category="label")
    products = found.agg(F.countDistinct("vec_id").alias("products"))
    return similarity.recall(found, truth, key="vec_id").crossJoin(products).select("pairs", (F.col("recall") >= 0.9).alias("enough"), "products")


def json_receipts(spark, sf_dir):
    """Orders as JSON receipts, fenced, with chatter before them, bare or broken, of which lines repeat and some have no name."""
    li = t(spark, sf_dir, "lineitem").join(t(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    item = F.struct(F.when(F.col("l_linenumber") == 6, "").otherwise(F.concat(F.lit(" "), F.upper("p_name"))).alias("nom_produit"), F.replace(F.format_string("%.2f", F.col("l_quantity")), F.lit("."), F.lit(",")).alias("prix_unitaire_ou_kg"), F.lit(2).alias("unites"))
    items = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("items"))
    od = t(spark, sf_dir, "orders").join(items, F.col("o_orderkey") == F.col("l_orderkey"))
    ticket = F.struct(F.date_format("o_orderdate", "dd/MM/yyyy").alias("date"), F.lit("HALLES").alias("chaine_supermarche"), F.lit("").alias("adresse"), F.concat("items", "items").alias("produits"))
    body = F.to_json(F.struct(ticket.alias("ticket")))
    k = F.col("o_orderkey") % 4
    text = F.when(k == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(k == 1, F.concat(F.lit("Voici: {} "), body)).when(k == 2, F.to_json(ticket)).otherwise(F.lit(" "))
    made, lines, errors = receipts.parse_receipts(od.select(F.col("o_orderkey").cast("string").alias("ticket_id"), text.alias("text")))
    counts = lines.groupBy("ticket_id").agg(F.count("*").alias("items"), F.sum("line_total").cast("double").alias("lines_total"), F.min("raw_text").alias("first"))
    heads = made.select("ticket_id", "enseigne", "ticket_date", F.col("total_amount").cast("double").alias("total_amount"))
    both = heads.join(counts, "ticket_id", "left").withColumn("reason", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)
    return both.withColumn("items", F.coalesce("items", F.lit(0).cast("long")))


QUERIES = {
    f.__name__: f
    for f in (
        partition_replace, upsert_prices, upsert_lines, upsert_aliases, model_outputs, merged_passes, embedded_products, upsert_catalogue, snapshot_archive, stored_documents, streamed_events, substitutes_ivf_recall, substitutes_ivf, ticket_states, ticket_waits, json_rows, gold_counts, gold_default_medians, alert_report_stored, daily_run, daily_weeks, catalogue_delta, dead_letters, clean_metadata,
        rejection_records, rejection_metrics, brand_increases, index_points, personal_alerts, resolve_lines, substitute_states, substitutes_recall, json_receipts,
    )
}

_LI = "li AS (SELECT l_orderkey, l_linenumber, min(l_quantity) AS quantity, CAST(min(l_shipdate) AS DATE) AS day FROM lineitem GROUP BY ALL)"
_TOP = f"""tops AS (SELECT 'rankings' AS section, product_code, reference_week AS week, row_number() OVER (ORDER BY pct_change DESC, reference_week, product_code) AS place FROM moves WHERE reference_week >= DATE '2001-06-01' - 14 AND pct_change >= 0.05),
    odds AS (SELECT 'anomalies' AS section, product_code, week_start_date AS week, row_number() OVER (ORDER BY abs(z_score) DESC, week_start_date, product_code) AS place FROM odd WHERE abs(z_score) >= 1 AND week_start_date >= DATE '2001-06-01' - 14)"""
_NORMAL = lambda c: f"trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
ORACLES = {
    "partition_replace": "SELECT event_type, count(*) AS n, sum(event_id)::BIGINT AS ids FROM events WHERE event_type <> 'view' AND (event_type <> 'click' OR value > 100) GROUP BY 1",
    "upsert_prices": f"""WITH {_LI} SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN quantity WHEN l_orderkey % 2 = 0 THEN quantity + 100 WHEN l_linenumber <= 5 THEN quantity END AS quantity, day FROM li""",
    "upsert_lines": f"""WITH {_LI} SELECT l_orderkey AS ticket_id, l_linenumber AS line_index, CASE WHEN l_linenumber >= 3 THEN 'B' ELSE '' END || 'A' || CAST(quantity AS INT) AS raw_text, l_linenumber <= 4 AND l_orderkey % 3 = 0 AS validated_by_user FROM li""",
    "upsert_aliases": """WITH s AS (SELECT s_name AS raw_text, CASE WHEN s_suppkey % 2 = 0 THEN CAST(s_nationkey AS VARCHAR) ELSE '' END AS enseigne, s_suppkey AS k FROM supplier)
        SELECT raw_text, enseigne, 'ocr' AS source, CASE WHEN k % 5 = 0 THEN 'c' ELSE 'a' END || k AS ean FROM s UNION ALL SELECT raw_text, enseigne, 'user-validation', 'b' || k FROM s WHERE k % 3 = 0""",
    "model_outputs": """SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 3 THEN '' ELSE p_name || chr(10) || p_type END AS cleaned,
        CASE p_partkey % 4 WHEN 0 THEN 'transcription too short' WHEN 2 THEN 'chatty output (i think)' WHEN 3 THEN 'empty output' END AS error FROM part""",
    "merged_passes": "SELECT o_orderkey AS ticket_id, 'SHOP ' || o_orderkey AS shop, o_orderkey || ' ROAD' AS address, 2 AS items, 'ITEM ' || o_orderkey AS first FROM orders",
    "embedded_products": """SELECT p_partkey AS ean, e.embedding IS NOT NULL AS embedded, CASE p_size % 4 WHEN 0 THEN 'Milk and dairy products' WHEN 3 THEN 'Beverages' ELSE 'Fish Meat Eggs' END AS "group"
        FROM part LEFT JOIN embeddings e ON p_partkey = vec_id""",
    "upsert_catalogue": """SELECT cast(p_partkey AS VARCHAR) AS ean, CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 3 = 0 THEN 'new ' ELSE '' END || p_brand END AS brand, p_partkey % 9 <> 0 AS off_found FROM part WHERE p_partkey % 10 <> 1 OR p_partkey % 3 = 0""",
    "snapshot_archive": f"""WITH {RAW_SQL} SELECT 'read' AS what, count(*) AS n, count(DISTINCT id) AS ids, count(full_price) AS full_prices, CAST(max(l_shipdate) AS DATE) AS last FROM raw UNION ALL SELECT 'absent', 0, 0, 0, NULL""",
    "stored_documents": Q.ORACLES["shape_catalogue"],
    "streamed_events": Q.ORACLES["ticket_events_decoded"],
    "substitutes_ivf_recall": """WITH k AS (SELECT DISTINCT (l_orderkey * 8 + l_linenumber) * 4 + j AS key FROM lineitem CROSS JOIN (VALUES (0), (1), (2)) x(j))
        SELECT count(*) AS asked, 5 * count(*) AS wanted, true AS recall_ok, true AS share_ok FROM k WHERE key % 20 = 0""",
    "substitutes_ivf": "SELECT sum(n * least(5, n - 1))::BIGINT AS wanted, true AS recall_ok FROM (SELECT count(*) AS n FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL GROUP BY label)",
    "ticket_states": f"""WITH v AS (SELECT event_id % 500 AS g, CASE WHEN event_id % 500 % 3 = 2 THEN 1 ELSE event_id // 500 % 2 END AS n FROM events WHERE event_id % 17 > 0 AND event_id % 13 > 0 AND event_id % 11 > 0),
        k AS (SELECT g, md5(cast(g AS VARCHAR)) AS m, min(n) AS n, count(*) - 1 AS repeats FROM v GROUP BY g)
        SELECT {Q._PLAIN} AS ticket_id, CASE g % 5 WHEN 0 THEN 'processing' WHEN 2 THEN 'failed' ELSE 'done' END AS status,
            CAST(CASE WHEN g % 5 = 0 THEN 3 - n WHEN g % 5 = 1 THEN 2 - n ELSE 1 END AS INT) AS attempts, repeats, CASE WHEN g % 5 IN (0, 2) THEN 0 ELSE 1 END AS lines FROM k""",
    "ticket_waits": """SELECT c.event_id, cast(x.event_id AS VARCHAR) AS text FROM (SELECT * FROM events WHERE event_type = 'click') c
        LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') x ON c.user_id = x.user_id AND x.ts BETWEEN c.ts AND c.ts + INTERVAL 6 HOURS""",
    "json_rows": "SELECT to_json({'o_orderkey': o_orderkey, 'day': CAST(o_orderdate AS DATE), 'priority': CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority END, 'late': o_custkey > 100})::VARCHAR AS json FROM orders",
    "gold_counts": " UNION ALL ".join(
        f"SELECT '{name}' AS name, count(*) AS n, count(*) AS stored FROM ({sql})"
        for name, sql in (
            ("brand_week_aggregates", Q.ORACLES["brand_week_aggregates"]), ("brand_week_index", Q.ORACLES["brand_week_index"]), ("product_rankings", Q.ORACLES["product_rankings"]),
            ("price_anomalies", Q.ORACLES["price_anomalies_by_brand"].replace("count(*) >= 1)", "count(*) >= 3)")),
        )
    ),
    "gold_default_medians": Q.ORACLES["brand_week_index"],
    "alert_report_stored": f"""WITH {PRICE_OBS}, {_weekly('product_code')}, {_MOVES}, {Q._anomalies('product_code')}, {_TOP}
        SELECT '2001-06-01' AS run_date, section, count(*) OVER (PARTITION BY section) AS listed, place, product_code, week FROM (FROM tops WHERE place <= 50 UNION ALL BY NAME FROM odds WHERE place <= 100)""",
    "daily_run": f"""WITH {RAW_SQL}, g AS (SELECT *, date_trunc('week', CAST(l_shipdate AS DATE)) AS w FROM flagged WHERE NOT iqr_outlier), b AS (SELECT w FROM g GROUP BY w HAVING count(*) >= 3),
        p AS (SELECT w, product_code, quantile_disc(price, 0.5) AS m FROM g GROUP BY ALL HAVING count(*) >= 3), moves AS (SELECT *, lag(m) OVER (PARTITION BY product_code ORDER BY w) AS before FROM p),
        a AS (SELECT m, avg(m) OVER (PARTITION BY product_code) AS x, stddev_pop(m) OVER (PARTITION BY product_code) AS s FROM p)
        SELECT 'prices' AS name, count(*) AS n FROM flagged UNION ALL SELECT 'stored prices', count(*) FROM flagged UNION ALL SELECT 'rejections', count(*) FROM judged WHERE reason IS NOT NULL UNION ALL SELECT 'brand_week_aggregates', count(*) FROM b
        UNION ALL SELECT 'brand_week_index', count(*) FROM b UNION ALL SELECT 'product_rankings', least(count(*), 500) FROM moves WHERE before > 0 UNION ALL SELECT 'price_anomalies', count(*) FROM a WHERE s > 0 AND abs((m - x) / s) >= 3 UNION ALL SELECT 'reports', 1""",
    "catalogue_delta": """SELECT cast(p_partkey AS VARCHAR) AS ean, CASE WHEN p_partkey % 9 <> 0 THEN CASE WHEN p_partkey % 5 = 0 THEN 'Other brand' ELSE p_brand END END AS brand, p_partkey % 9 <> 0 AS off_found FROM part
        WHERE CASE WHEN p_partkey % 7 = 0 THEN p_partkey % 2 = 0 ELSE p_partkey % 5 = 0 AND p_partkey % 9 <> 0 END""",
    "daily_weeks": f"""WITH {RAW_SQL.replace("SELECT product_code AS pc,", "SELECT product_code AS pc, l_orderkey % 40 // 8 AS pd,").replace("GROUP BY 1 HAVING count(*) >= 5", "GROUP BY 1, 2 HAVING count(*) >= 5").replace("ON product_code = pc", "ON product_code = pc AND l_orderkey % 40 // 8 = pd").replace("CAST(l_shipdate AS DATE) > DATE '2001-01-01'", "false")},
        p AS (SELECT CAST(date_trunc('week', DATE '2001-01-01' - CAST(l_orderkey % 40 AS INT)) AS DATE) AS w, product_code AS c, price, iqr_outlier AS o FROM flagged),
        b AS (SELECT w FROM p WHERE NOT o GROUP BY w HAVING count(*) >= 3),
        m AS (SELECT w, c, quantile_disc(price, 0.5) AS m FROM p WHERE NOT o GROUP BY w, c HAVING count(*) >= 3),
        z AS (SELECT m, avg(m) OVER (PARTITION BY c) AS a, stddev_pop(m) OVER (PARTITION BY c) AS s FROM m)
        SELECT 'prices' AS name, count(*) AS n, true AS same FROM p UNION ALL SELECT 'brand_week_aggregates', count(*), true FROM b UNION ALL SELECT 'brand_week_index', count(*), true FROM b
        UNION ALL SELECT 'product_rankings', count(*), true FROM (SELECT lag(m) OVER (PARTITION BY c ORDER BY w) AS l FROM m) WHERE l > 0
        UNION ALL SELECT 'price_anomalies', count(*), true FROM z WHERE s > 0 AND abs((m - a) / s) >= 2""",
    "dead_letters": """WITH n AS (SELECT user_id AS ticket_id, 1 + count(*) FILTER (event_type = 'error') AS attempts FROM events GROUP BY 1 HAVING count(*) FILTER (event_type = 'click') > 0)
        SELECT ticket_id, CAST(attempts AS INT) AS attempts, CASE WHEN attempts >= 5 THEN -1 ELSE least(10 * 2 ** (attempts - 1), 600) END::BIGINT AS wait FROM n WHERE attempts < 5 OR ticket_id % 2 <> 0""",
    "clean_metadata": f"""WITH {RAW_SQL}, c AS (SELECT *, length('Carrefour  Market, ' || l_suppkey) % 3 AS m FROM firsts)
        SELECT id, CASE WHEN m = 2 THEN 45.5::DOUBLE END AS latitude, CASE WHEN price <= 100 THEN {_r6('price')} END AS longitude, DATE '2001-01-01' AS pipeline_run_date, 'hf-open-prices' AS source, true AS ingested, product_code AS payload_code,
            l_suppkey::BIGINT AS payload_suppkey, full_price IS NULL AS payload_null FROM c""",
    "rejection_records": f"""WITH {RAW_SQL} SELECT id, reason, CASE WHEN k % 31 = 0 THEN 'USD' WHEN reason IN ('INVALID_EAN', 'INCOHERENT_DISCOUNT') THEN 'EUR' ELSE 'eur' END AS currency, CASE WHEN k % 41 = 0 THEN 'BE' ELSE 'FR' END AS country_code,
        CASE WHEN reason IN ('INVALID_EAN', 'INCOHERENT_DISCOUNT') THEN CASE WHEN k % 2 = 0 THEN 'PRICE_TAG' ELSE 'RECEIPT' END WHEN k % 37 = 0 THEN 'letter' WHEN k % 2 = 0 THEN 'price-tag' ELSE 'Receipt' END AS proof_type,
        price AS raw_price, DATE '2001-01-01' AS pipeline_run_date FROM judged WHERE reason IS NOT NULL""",
    "rejection_metrics": f"WITH {RAW_SQL} SELECT reason, count(*) AS n FROM judged WHERE reason IS NOT NULL GROUP BY 1",
    "brand_increases": f"""WITH {PRICE_OBS}, {_weekly('product_code')}, {_MOVES}, {_CATALOGUE}, b AS (SELECT lower(brand) AS brand, ean, pct_change, row_number() OVER (PARTITION BY lower(brand) ORDER BY pct_change DESC, reference_week, ean) AS place FROM moves JOIN catalogue ON ean = product_code),
        m AS (SELECT brand, quantile_disc(pct_change, 0.5) AS m FROM b GROUP BY 1) SELECT brand, {_r6('m')} AS median_pct_change, place, ean, {_r6('pct_change')} AS pct_change FROM b JOIN m USING (brand) WHERE place <= 5""",
    "index_points": f"WITH {_PURCHASES}, bought AS (FROM purchases), {Q._laspeyres('enseigne')} SELECT enseigne, period, {_r6('value')} AS value FROM ix",
    "personal_alerts": f"""WITH {PRICE_OBS}, {_weekly('product_code')}, {_MOVES}, {_PURCHASES}, {_HISTORY}
        SELECT user_id, count(*) AS alerts, {_r6('max(pct_change)')} AS largest FROM history h JOIN moves ON product_code = ean WHERE purchase_count_6m >= 2 AND CASE WHEN user_id % 3 = 0 AND user_id IN (SELECT c_custkey FROM customer)
            THEN pct_change >= 1 AND EXISTS (SELECT 1 FROM purchases p WHERE p.user_id = h.user_id AND p.ean = h.ean AND enseigne IN ('Brand#11', 'Brand#23')) ELSE pct_change >= 0.05 END GROUP BY 1""",
    "resolve_lines": f"""WITH {_CATALOGUE}, l AS (SELECT p_partkey AS ticket_id, p_brand, p_partkey % 4 AS k, CASE p_partkey % 4 WHEN 0 THEN upper(p_name) WHEN 1 THEN p_name || 'e' ELSE p_brand END AS raw_text FROM part),
        f AS (SELECT raw_text, ean, 1 - levenshtein({_NORMAL('raw_text')}, {_NORMAL('produit_nom')}) / greatest(length({_NORMAL('raw_text')}), length({_NORMAL('produit_nom')}), 1) AS s FROM (SELECT DISTINCT raw_text FROM l WHERE k < 2) JOIN catalogue
            ON string_split({_NORMAL('raw_text')}, ' ')[1] = string_split({_NORMAL('produit_nom')}, ' ')[1]),
        b AS (SELECT raw_text, ean, s FROM f WHERE s >= 0.75 QUALIFY row_number() OVER (PARTITION BY raw_text ORDER BY s DESC, ean DESC) = 1)
        SELECT ticket_id, raw_text, CASE WHEN k = 2 THEN 'x' || p_brand WHEN k = 3 THEN 'a' || p_brand ELSE ean END AS ean, CASE WHEN k >= 2 THEN 'alias' WHEN ean IS NOT NULL THEN 'fuzzy' ELSE 'none' END AS match_method,
            {_r6("CASE WHEN k = 2 THEN 0.25 WHEN k = 3 THEN 0.5 ELSE s END::DOUBLE")} AS match_confidence FROM l LEFT JOIN b USING (raw_text)""",
    "substitute_states": """WITH v AS (SELECT vec_id, CASE WHEN vec_id % 50 = 0 THEN -vec_id - 1 ELSE label END AS label FROM embeddings), n AS (SELECT a.vec_id, least(count(*) - 1, 3) AS n FROM v a JOIN v b USING (label) GROUP BY 1)
        SELECT vec_id, CASE WHEN n > 0 THEN 'found' ELSE 'none' END AS state, n AS listed FROM n WHERE vec_id % 10 = 0 UNION ALL SELECT -vec_id - 1, 'unknown', 0 FROM v WHERE vec_id % 20 = 0""",
    "substitutes_recall": "WITH n AS (SELECT vec_id, least(count(*) OVER (PARTITION BY label) - 1, 5) AS n FROM embeddings) SELECT sum(n)::BIGINT AS pairs, true AS enough, count(*) FILTER (n > 0) AS products FROM n",
    "json_receipts": """WITH l AS (SELECT DISTINCT l_orderkey, upper(p_name) AS name, l_quantity AS q FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <> 6), s AS (SELECT l_orderkey, count(*) AS n, 2 * sum(cast(q AS DECIMAL(12, 2))) AS total, min(name) AS first FROM l GROUP BY 1),
        o AS (SELECT * FROM orders JOIN (SELECT DISTINCT l_orderkey FROM lineitem JOIN part ON l_partkey = p_partkey) ON o_orderkey = l_orderkey)
        SELECT cast(o_orderkey AS VARCHAR) AS ticket_id, CASE WHEN bad THEN NULL ELSE 'HALLES' END AS enseigne, CASE WHEN NOT bad THEN CAST(o_orderdate AS DATE) END AS ticket_date, CASE WHEN NOT bad THEN cast(total AS DOUBLE) END AS total_amount,
            CASE WHEN NOT bad THEN coalesce(n, 0) ELSE 0 END AS items, CASE WHEN NOT bad THEN cast(total AS DOUBLE) END AS lines_total, CASE WHEN NOT bad THEN first END AS first, CASE WHEN bad THEN 'empty text' END AS reason
        FROM (SELECT *, o_orderkey % 4 = 3 AS bad FROM o) LEFT JOIN s ON s.l_orderkey = o_orderkey""",
}
