"""Exact deduplication by content sort.

Rows are range-partitioned by the beginning of their text and a hash of all of it; Spark samples the splitters, which stay small
because the range key does. Within a range the rows are sorted by their whole text, then by identifier from the largest down. So equal
texts lie next to each other: each row is compared with the one before it in full, which ends a run of equal texts or goes on with
it. A run's first row has its largest identifier, and its length is the number of copies.

A text with more than a ``HOT``-th of all rows would make one range too large. There are at most ``HOT`` such texts; their rows are
dealt to salts, so many that a salt has about a ``HOT``-th of all rows, and the runs of the salts are brought together at
the end by comparing the whole texts of their first rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, text_of, unused

HOT = 1000
PREFIX = 32
OWN = ("text", "prefix", "hash", "salt", "head", "run", "salts")


def _widely_shared(df: DataFrame, text: str, scratch: Scratch) -> DataFrame:
    """hash, salts: of the texts with more than a ``HOT``-th of the rows; at most ``HOT`` rows, so they may be sent to every task."""
    counts = scratch.put(df.select(F.xxhash64(text_of(text)).alias("hash")).groupBy("hash").agg(F.count("*").alias("n")).where("n > 1"))
    share = max(df.count() / HOT, 1.0)
    return counts.where(F.col("n") > share).select("hash", F.ceil(F.col("n") / share).cast("int").alias("salts"))


def _runs(df: DataFrame, text: str, doc_id: str, hot: DataFrame, own: dict[str, str]) -> DataFrame:
    """``df`` sorted by content, with columns named by ``own``: text, hash, salts (null but for widely shared texts), head (first of its run) and run (its number)."""
    t, prefix, hashed, salt, head, run, salts = (own[c] for c in OWN)
    shared = F.broadcast(hot.select(F.col("hash").alias(hashed), F.col("salts").alias(salts)))
    keyed = df.withColumn(t, text_of(text)).withColumns({prefix: F.substring(t, 1, PREFIX), hashed: F.xxhash64(t)}).join(shared, hashed, "left")
    ranged = keyed.withColumn(salt, F.coalesce(F.pmod(F.xxhash64(doc_id), F.col(salts)), F.lit(0))).repartitionByRange(prefix, hashed, salt)
    order = Window.partitionBy(prefix, hashed, salt).orderBy(t, F.col(f"`{doc_id}`").desc_nulls_last())
    marked = ranged.withColumn(head, ~F.lag(t).over(order).eqNullSafe(F.col(t)))
    return marked.withColumn(run, F.sum(F.col(head).cast("int")).over(order))


def exact_groups(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical; a null text counts as empty. Of equal texts the row with the largest id stays; null ids
    come last, and of rows that repeat both text and id one stays. An empty table gives an empty result.
    """
    scratch, own = Scratch(df.sparkSession), {c: f"__{c}" for c in OWN}
    slim = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    of_run = Window.partitionBy("__prefix", "__hash", "__salt", "__run")
    sha = F.sha2(F.col("__text").cast("binary"), 256)
    members = scratch.put(
        _runs(slim, "text", "doc_id", _widely_shared(slim, "text", scratch), own)
        .select("doc_id", "__prefix", "__hash", "__salt", "__run", "__head", sha.alias("text_sha256"), F.when(F.col("__head") & F.col("__salts").isNotNull(), F.col("__text")).alias("__shown"))
        .withColumns({"keep_id": F.max("doc_id").over(of_run), "group_size": F.count("*").over(of_run)})
        .drop("__prefix", "__hash", "__salt", "__run")
    )
    # First rows of the runs of widely shared texts: a few for each salt at most.
    met = members.where("__shown is not null").groupBy("__shown").agg(F.max("keep_id").alias("__keep"), F.sum("group_size").alias("__size"), F.min("text_sha256").alias("text_sha256"))
    return members.join(F.broadcast(met.drop("__shown")), "text_sha256", "left").select(
        "doc_id",
        F.coalesce("__keep", "keep_id").alias("keep_id"),
        F.coalesce("__size", "group_size").alias("group_size"),
        (F.col("__head") & F.col("doc_id").eqNullSafe(F.coalesce("__keep", "keep_id"))).alias("kept"),
        "text_sha256",
    )


def drop_exact_copies(df: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of ``df`` that stay, with its own columns whatever their names: one for each text, that with the largest id.

    A null text counts as empty; null ids come last, and of rows that repeat both text and id one stays. An empty table gives an empty result.
    """
    scratch, own = Scratch(df.sparkSession), dict(zip(OWN, unused(df, *OWN)))
    hot = _widely_shared(df, text, scratch)
    # The runs of widely shared texts meet first, from their texts and ids alone.
    slim = df.select(F.col(f"`{doc_id}`").alias("doc_id"), text_of(text).alias("text")).join(F.broadcast(hot.select("hash")), F.xxhash64("text") == F.col("hash"), "left_semi")
    heads = _runs(slim, "text", "doc_id", hot, {c: f"__{c}" for c in OWN}).where("__head").select("__text", "doc_id")
    met = scratch.put(heads.groupBy("__text").agg(F.max("doc_id").alias("keep")))
    stay, keep = unused(df.withColumns({own[c]: F.lit(0) for c in OWN}), "stay", "keep")
    first = _runs(df, text, doc_id, hot, own).where(own["head"])
    known = F.broadcast(met.select(F.sha2(F.col("__text").cast("binary"), 256).alias(stay), F.col("keep").alias(keep)))
    digest = F.when(F.col(own["salts"]).isNotNull(), F.sha2(F.col(own["text"]).cast("binary"), 256))
    joined = first.join(known, digest == F.col(stay), "left")
    return joined.where(F.col(stay).isNull() | F.col(f"`{doc_id}`").eqNullSafe(F.col(keep))).select(*(f"`{c}`" for c in df.columns))
