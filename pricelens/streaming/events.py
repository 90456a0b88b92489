"""Ticket events as a stream: decoding, claims without loss, attempts with waits, and tables kept up to date by idempotent upserts.

No event is dropped by time: what was claimed is known from stored claims, by object within the days that a batch's events were
published, and from the tickets' own states. So each event of a ticket becomes a claim or a repeat, however old it is or
whether it can tell its age, and each unreadable one a dead event.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.scalars import dashed_uuid
from ..operators.receipts import parse_receipts
from ..sources.tables import exists, replace_table, upsert

PATH = r"^tickets/raw/([^/]+)/([0-9a-fA-F]{32}|[0-9a-fA-F-]{36})\.[a-zA-Z0-9]+$"
PREFIX = "tickets/raw/"
CLAIMABLE = ("pending", "uploaded")


def ticket_id(path: Column) -> Column:
    """The ticket's id in an object's path, dashed; null for other paths."""
    return F.when(path.rlike(PATH), dashed_uuid(F.lower(F.regexp_extract(path, PATH, 2))))


def user_id(path: Column) -> Column:
    return F.when(path.rlike("^tickets/raw/[^/]+/[^/]+"), F.regexp_extract(path, "^tickets/raw/([^/]+)/", 1))


def decode_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, dead) of envelopes with ``message``: bucket, path, ticket_id, user_id and published_at, or the reason why not.

    Objects outside the prefix are no tickets and in neither. The row number, which the reason names, keeps filters on it behind the
    columns that it reads, so that each is worked out once.
    """
    decoded = df.withColumn("__inner", F.try_to_binary("message.data", F.lit("base64")).cast("string")).withColumn("__body", F.from_json("__inner", "bucket string, name string"))
    named = decoded.withColumns({"bucket": F.col("__body.bucket"), "path": F.col("__body.name")}).drop("__body")
    seen = named.withColumns({"__ticket": ticket_id(F.col("path")), "__json": F.get_json_object("__inner", "$").isNotNull(), "__row": F.monotonically_increasing_id()})
    reason = (
        F.when(F.col("__row") < 0, F.lit(None))
        .when(F.col("message").isNull(), "missing message")
        .when(F.coalesce("message.data", F.lit("")) == "", "missing data")
        .when(~F.col("__json"), "data is not base64 JSON")
        .when((F.coalesce("bucket", F.lit("")) == "") | (F.coalesce("path", F.lit("")) == ""), "missing bucket or name")
        .when(F.col("path").startswith(PREFIX) & F.col("__ticket").isNull(), "path is no ticket")
    )
    judged = seen.withColumn("reason", reason)
    valid = judged.where(F.col("reason").isNull() & F.col("path").startswith(PREFIX))
    return (
        valid.select("bucket", "path", F.col("__ticket").alias("ticket_id"), user_id(F.col("path")).alias("user_id"), F.try_to_timestamp("message.publishTime").alias("published_at"), "message.messageId"),
        judged.where("reason is not null").select(F.to_json("message").alias("message"), "reason"),
    )


def claimed(events: DataFrame, tickets: DataFrame) -> DataFrame:
    """Events whose ticket may be worked on: it is pending or uploaded, or not known yet."""
    taken = tickets.where(~F.col("status").isin(*CLAIMABLE)).select("ticket_id")
    return events.join(taken, "ticket_id", "left_anti")


def awaited(events: DataFrame, texts: DataFrame, wait: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """``events`` (ticket_id, claimed_at, ...), each with the text that came within ``wait`` of its claim, or with a null one when that time is out.

    ``texts`` holds ticket_id, text and read_at. On streams the state is bounded: claims and texts are kept until the watermark of both,
    ``late`` behind what was seen last, has passed their range; then a claim without a text is given out once, as timed out.
    """
    sides = (events, texts)
    if events.isStreaming:
        sides = (events.withWatermark("claimed_at", late), texts.withWatermark("read_at", late))
    right = sides[1].select(F.col("ticket_id").alias("__ticket"), "text", "read_at")
    within = (F.col("ticket_id") == F.col("__ticket")) & (F.col("read_at") >= F.col("claimed_at")) & (F.col("read_at") <= F.col("claimed_at") + F.expr(f"INTERVAL {wait}"))
    return sides[0].join(right, within, "left").drop("__ticket")


#: Attempts before a message is a dead letter, seconds to wait between them (at first and at most), days that dead letters are kept.
ATTEMPTS, WAITS, RETENTION = 5, (10, 600), 7


def retried(failed: DataFrame, attempts: DataFrame, at: datetime, limit: int = ATTEMPTS) -> DataFrame:
    """ticket_id, attempts, next_at, dead_at of the ``failed`` tickets (ticket_id): one attempt more than ``attempts`` (ticket_id, attempts) knows.

    The wait doubles with each attempt. A ticket that has failed ``limit`` times is tried no more and gets the time as dead_at.
    """
    known = attempts.groupBy("ticket_id").agg(F.max("attempts").alias("__before"))
    n = F.coalesce("__before", F.lit(0)).cast("int") + 1
    wait = F.least(F.lit(WAITS[0]) * F.pow(F.lit(2), F.col("attempts") - 1), F.lit(WAITS[1])).cast("int")
    now, dead = F.lit(at).cast("timestamp"), F.col("attempts") >= limit
    counted = failed.select("ticket_id").distinct().join(known, "ticket_id", "left").select("ticket_id", n.alias("attempts"))
    return counted.withColumns({"next_at": F.when(~dead, F.timestamp_seconds(F.unix_timestamp(now) + wait)), "dead_at": F.when(dead, now)})


def kept_letters(dead: DataFrame, at: datetime, days: int = RETENTION) -> DataFrame:
    """The dead letters that are not past their retention."""
    return dead.where(F.col("dead_at") >= F.lit(at).cast("timestamp") - F.make_interval(days=F.lit(days)))


_QUEUE = "ticket_id string, user_id string, day date, attempts int, next_at timestamp"
_LETTERS = "ticket_id string, attempts int, dead_at timestamp"


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def register(tickets: DataFrame, base: str) -> None:
    """Make known ``tickets`` (ticket_id, user_id, status pending or uploaded) that no event has named yet."""
    empty = {"enseigne": "string", "ticket_date": "date", "total_amount": "decimal(18,2)", "error": "string", "attempts": "int", "claimed_in": "long"}
    rows = tickets.select("ticket_id", "user_id", F.lit(None).cast("date").alias("day"), "status", *(F.lit(None).cast(kind).alias(c) for c, kind in empty.items()))
    upsert(f"{base}/tickets", rows, ["ticket_id"], update_cols=[], partition_col="day")


def claim_events(events: DataFrame, base: str, batch: int) -> DataFrame:
    """Of valid ``events`` one for each ticket that nobody has claimed, written to ``base/claims``; all others go to ``base/repeats``.

    Within a batch the earliest event stands for its ticket, untimed ones last. A batch that runs again gives the same: its own
    claims don't count. Claims lie by day of publishing, and only the days of the batch are read, since a message that is delivered
    again has the time of its first delivery; a ticket that comes with another time is known by its state.
    """
    spark = events.sparkSession
    first = Window.partitionBy("ticket_id").orderBy(F.col("published_at").asc_nulls_last(), "path", "messageId")
    seen = events.withColumns({"day": F.to_date("published_at"), "nr": F.row_number().over(first)})
    known = None
    if exists(spark, f"{base}/claims"):
        days = [r["day"] for r in events.select(F.to_date("published_at").alias("day")).distinct().collect()]  # of one batch
        within = F.col("day").isin([d for d in days if d is not None]) | (F.col("day").isNull() if None in days else F.lit(False))
        schema = "ticket_id string, user_id string, path string, messageId string, published_at timestamp, batch long, day date"
        known = spark.read.schema(schema).parquet(f"{base}/claims").where(within & (F.col("batch") != batch)).select("ticket_id")
    if exists(spark, f"{base}/tickets"):
        stored = spark.read.parquet(f"{base}/tickets")
        own = F.coalesce(F.col("claimed_in"), F.lit(-1)) == batch if "claimed_in" in stored.columns else F.lit(False)
        taken = stored.where(~F.col("status").isin(*CLAIMABLE) & ~own).select("ticket_id")
        known = taken if known is None else known.union(taken)
    if known is None:
        judged = seen.withColumn("taken", F.lit(False))
    else:
        judged = seen.join(known.distinct().withColumn("__known", F.lit(True)), "ticket_id", "left").withColumn("taken", F.col("__known").isNotNull()).drop("__known")
    judged = judged.select("ticket_id", "user_id", "path", "messageId", "published_at", "day", "nr", "taken").persist()
    try:
        mine = judged.where("nr = 1 and not taken").drop("nr", "taken")
        judged.where("nr > 1 or taken").drop("nr", "taken").write.mode("overwrite").parquet(f"{base}/repeats/batch={batch}")
        mine.write.mode("overwrite").partitionBy("day").parquet(f"{base}/claims/batch={batch}")
    finally:
        judged.unpersist()
    schema = "ticket_id string, user_id string, path string, messageId string, published_at timestamp, day date"
    return spark.read.schema(schema).parquet(f"{base}/claims/batch={batch}") if exists(spark, f"{base}/claims/batch={batch}") else spark.createDataFrame([], schema)


def attempt(spark: SparkSession, texts: DataFrame, base: str, at: datetime, claims: DataFrame | None = None, batch: int | None = None) -> None:
    """Work on new ``claims`` and on the tickets of ``base/queue`` whose wait is over at ``at``; bring tickets, lines, letters and the queue up to date.

    A ticket with a readable text is done, one with an unreadable text has failed. Without a text it is processing and waits in the queue, each
    time twice as long, until its last attempt: then it has failed and is a dead letter, which is kept for the retention. The queue is
    written last, so that an attempt that breaks off and runs again has the same result.
    """
    queue = _stored(spark, f"{base}/queue", _QUEUE)
    now = F.lit(at).cast("timestamp")
    work = queue.where(F.col("next_at") <= now).select("ticket_id", "user_id", "day", "attempts", F.lit(None).cast("long").alias("claimed_in"))
    if claims is not None:
        work = work.unionByName(claims.select("ticket_id", "user_id", "day", F.lit(0).alias("attempts"), F.lit(batch).cast("long").alias("claimed_in")))
    work = work.persist()
    try:
        if work.isEmpty():
            if exists(spark, f"{base}/letters"):
                replace_table(kept_letters(_stored(spark, f"{base}/letters", _LETTERS), at), f"{base}/letters")
            return
        given = texts.join(work.select("ticket_id"), "ticket_id", "left_semi")
        if given.isEmpty():  # nothing to parse, which is the costly part of the plan
            given = spark.createDataFrame([], "ticket_id string, text string")
        parsed, lines, errors = parse_receipts(given)
        lines = lines.join(work.select("ticket_id", "day"), "ticket_id")
        upsert(f"{base}/lines", lines, ["ticket_id", "line_index"], [c for c in lines.columns if c not in ("ticket_id", "line_index", "validated_by_user")], partition_col="day")
        read = work.join(parsed.withColumn("__done", F.lit(True)), "ticket_id", "left").join(errors.withColumnRenamed("reason", "error"), "ticket_id", "left")
        waits = retried(read.where("__done is null and error is null").select("ticket_id"), work.select("ticket_id", "attempts"), at).withColumnRenamed("attempts", "tried")
        out = read.join(waits, "ticket_id", "left").withColumn("attempts", F.coalesce("tried", F.col("attempts") + 1))
        status = F.when(F.col("error").isNotNull() | F.col("dead_at").isNotNull(), "failed").when(F.col("__done"), "done").otherwise("processing")
        error = F.coalesce("error", F.when(F.col("dead_at").isNotNull(), F.concat(F.lit("no text after "), F.col("attempts").cast("string"), F.lit(" attempts"))))
        settled = out.withColumns({"status": status, "error": error}).persist()
        try:
            columns = ["ticket_id", "user_id", "day", "status", "enseigne", "ticket_date", "total_amount", "error", "attempts", "claimed_in"]
            upsert(f"{base}/tickets", settled.select(*columns), ["ticket_id"], keep_if_null=("claimed_in",), partition_col="day")
            fresh = settled.where("dead_at is not null").select("ticket_id", "attempts", "dead_at")
            old = _stored(spark, f"{base}/letters", _LETTERS).join(fresh.select("ticket_id"), "ticket_id", "left_anti")
            replace_table(kept_letters(old.unionByName(fresh), at), f"{base}/letters")
            waiting = settled.where("status = 'processing'").select("ticket_id", "user_id", "day", "attempts", "next_at")
            rest = queue.join(work.select("ticket_id"), "ticket_id", "left_anti")
            replace_table(rest.unionByName(waiting), f"{base}/queue")
        finally:
            settled.unpersist()
    finally:
        work.unpersist()


def run_ticket_stream(
    source: DataFrame, texts: Callable[[], DataFrame], base: str, trigger: dict | None = None, clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc)
) -> StreamingQuery:
    """Keep the tables under ``base`` up to date from a stream of envelopes: tickets, lines, claims, repeats, dead, queue and letters.

    ``texts()`` gives (ticket_id, text), read anew for each batch, and ``clock()`` the time of an attempt. Every valid event is in exactly one
    of claims and repeats, and every unreadable one in dead. Tickets that wait are tried again with each batch, or by ``attempt``.
    """

    def batch(df: DataFrame, epoch: int) -> None:
        df.persist()
        try:
            valid, dead = decode_events(df)
            dead.write.mode("overwrite").parquet(f"{base}/dead/batch={epoch}")
            attempt(df.sparkSession, texts(), base, clock(), claim_events(valid, base, epoch), epoch)
        finally:
            df.unpersist()

    writer = source.writeStream.foreachBatch(batch).option("checkpointLocation", f"{base}/checkpoint")
    return writer.trigger(**(trigger or {"availableNow": True})).start()
