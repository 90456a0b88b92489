"""Tables as Parquet directories: reads that tolerate absence, partition overwrites, and keyed upserts.

A table is published by writing a new directory beside it and renaming, and the old one stays until that has succeeded, since a
plan that reads a path must not overwrite it. Renames go through Hadoop's file systems, so paths may be of any of them.
"""

from __future__ import annotations

import uuid
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import PRODUCT_DOCUMENT, RAW_PRICES, TICKET_EVENT


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _replace(spark: SparkSession, fresh: str, path: str) -> None:
    """Put the directory ``fresh`` in the place of ``path``; on failure the old one comes back.

    Between the two renames there is nothing at ``path``: a reader that plans in that moment fails and has to try again.
    """
    fs, target = _path(spark, path)
    _, new = _path(spark, fresh)
    _, old = _path(spark, f"{path}.old-{uuid.uuid4().hex}")
    fs.mkdirs(target.getParent())
    had = fs.exists(target)
    if had and not fs.rename(target, old):
        raise OSError(f"{path} can't be moved aside")
    if not fs.rename(new, target):
        if had:
            fs.rename(old, target)
        raise OSError(f"{fresh} can't be moved to {path}")
    if had:
        fs.delete(old, True)


def read_snapshot(spark: SparkSession, path: str, schema: T.StructType = RAW_PRICES) -> DataFrame:
    """A raw snapshot; only the schema's columns are read."""
    return spark.read.schema(schema).parquet(path)


def read_product_documents(spark: SparkSession, path: str) -> DataFrame:
    """Product documents, one JSON object to a line."""
    return spark.read.schema(PRODUCT_DOCUMENT).json(path)


def stream_ticket_events(spark: SparkSession, path: str) -> DataFrame:
    """Ticket events as they arrive, one JSON envelope to a line."""
    return spark.readStream.schema(TICKET_EVENT).json(path)


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at ``path``, or an empty one where there is none."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_archive(df: DataFrame, base: str, day: date) -> str:
    """Write ``df`` under ``base/dt=day``; another run of the same day replaces it."""
    path = f"{base}/dt={day:%Y-%m-%d}"
    df.write.mode("overwrite").option("compression", "snappy").parquet(path)
    return path


def replace_table(df: DataFrame, path: str, partition_col: str | None = None, cluster: list[str] | None = None) -> None:
    """Write ``df`` as the whole table, in partitions by one column and sorted within files, so that row groups can be skipped."""
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    rows = df
    if partition_col:
        # Small days are brought together and a day with most of the rows is split over as many tasks as its size needs.
        rows = rows.hint("rebalance", F.col(partition_col))
    if cluster or partition_col:
        rows = rows.sortWithinPartitions(*([partition_col] if partition_col else []), *(cluster or []))
    writer = rows.write.partitionBy(partition_col) if partition_col else rows.write
    writer.parquet(fresh)
    _replace(df.sparkSession, fresh, path)


def replace_partition(path: str, df: DataFrame, col: str, value) -> None:
    """Make ``df`` the rows of one partition, also when it is empty, which leaves none."""
    df.drop(col).write.mode("overwrite").parquet(f"{path}/{col}={value}")


def replace_partitions(path: str, df: DataFrame, col: str, values: list) -> None:
    """Make ``df`` the rows of the partitions ``values`` of the table at ``path``; those it has no rows for go, all others stay."""
    spark, fresh = df.sparkSession, f"{path}.new-{uuid.uuid4().hex}"
    df.hint("rebalance", F.col(col)).write.partitionBy(col).parquet(fresh)
    _publish(spark, fresh, path, col, values)


def _publish(spark: SparkSession, fresh: str, path: str, col: str, values: list) -> None:
    """Move the partitions under ``fresh`` into the table at ``path``; those of ``values`` that are not there go."""
    fs, root = _path(spark, fresh)
    written = {f.getPath().getName() for f in fs.listStatus(root) if f.isDirectory()}
    for name in written:
        _replace(spark, f"{fresh}/{name}", f"{path}/{name}")
    for value in values:  # partitions that lost their last row
        name = f"{col}={'__HIVE_DEFAULT_PARTITION__' if value is None else value}"
        if name not in written and exists(spark, f"{path}/{name}"):
            fs.delete(_path(spark, f"{path}/{name}")[1], True)
    fs.delete(root, True)


def refresh(tables: dict[str, DataFrame], base: str) -> dict[str, int]:
    """Overwrite each table under ``base`` in the given order; the rows written, counted while writing."""
    from pyspark.sql import Observation

    counts = {}
    for name, df in tables.items():
        seen = Observation(name)
        replace_table(df.observe(seen, F.count(F.lit(1)).alias("rows")), f"{base}/{name}")
        counts[name] = seen.get["rows"]
    return counts


def write_report(report: DataFrame, base: str | None, run_date: date) -> str | None:
    """Write a report of one JSON text under ``base/date=run_date``; without a base nothing is written."""
    if not base:
        return None
    path = f"{base}/date={run_date:%Y-%m-%d}/report"
    report.select("report").write.mode("overwrite").text(path)
    return path


def json_rows(df: DataFrame) -> DataFrame:
    """Each row as JSON text, dates and timestamps in ISO form and nulls included."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false", "dateFormat": "yyyy-MM-dd", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ssXXX"}).alias("json"))


def _replaces(columns: list[str], keys: list[str], update_cols: list[str] | None, keep_if_null: tuple[str, ...]) -> bool:
    """Whether matched rows take all of their columns from the source."""
    return not keep_if_null and (update_cols is None or set(update_cols) == set(columns) - set(keys))


def merged(target: DataFrame, source: DataFrame, keys: list[str], update_cols: list[str] | None = None, keep_if_null: tuple[str, ...] = ()) -> DataFrame:
    """``target`` with the rows of ``source`` merged in by ``keys``.

    Matched rows take the columns of ``update_cols`` (all but the keys by default) from the source; those of ``keep_if_null``
    only where the source has a value. Others keep the target's. Unmatched source rows are added whole. The source must hold a
    key once; null keys match each other.
    """
    updated = set(update_cols if update_cols is not None else [c for c in target.columns if c not in keys])
    if _replaces(target.columns, keys, update_cols, keep_if_null):
        same = [target[k].eqNullSafe(source[k]) for k in keys]
        return target.join(source, same, "left_anti").unionByName(source.select(*target.columns))
    old, new = target.withColumn("__old", F.lit(True)).alias("o"), source.select(*target.columns).withColumn("__new", F.lit(True)).alias("n")
    both = old.join(new, [F.col(f"o.{k}").eqNullSafe(F.col(f"n.{k}")) for k in keys], "full")
    has_old, has_new = F.col("o.__old").isNotNull(), F.col("n.__new").isNotNull()

    def value(c: str):
        o, n = F.col(f"o.{c}"), F.col(f"n.{c}")
        if c in keys:
            return F.when(has_old, o).otherwise(n)
        if c not in updated:
            return F.when(has_old, o).otherwise(n)
        return F.when(has_new, F.coalesce(n, o) if c in keep_if_null else n).otherwise(o)

    return both.select(*(value(c).alias(c) for c in target.columns))


def upsert(
    path: str, source: DataFrame, keys: list[str], update_cols: list[str] | None = None, keep_if_null: tuple[str, ...] = (), partition_col: str | None = None, changed: list | None = None
) -> int:
    """Merge ``source`` into the table at ``path``; the number of source rows. An empty source changes nothing.

    With ``partition_col`` only partitions that hold a key of the source, or get one, are rewritten; a key may move between them.
    Repeating an upsert changes nothing. ``changed`` gets the values of the partitions that were rewritten.
    """
    fresh = f"{path}.new-{uuid.uuid4().hex}"
    try:
        return _upsert(path, fresh, source, keys, update_cols, keep_if_null, partition_col, [] if changed is None else changed)
    finally:
        fs, at = _path(source.sparkSession, fresh)
        fs.delete(at, True)


def _write(df: DataFrame, path: str, partition_col: str | None) -> None:
    """Append ``df`` to the directory ``path``."""
    writer = df.hint("rebalance", F.col(partition_col)).write.partitionBy(partition_col) if partition_col else df.write
    writer.mode("append").parquet(path)


def _upsert(path: str, fresh: str, source: DataFrame, keys: list[str], update_cols: list[str] | None, keep_if_null: tuple[str, ...], partition_col: str | None, changed: list) -> int:
    spark, target = source.sparkSession, None
    if exists(spark, path):
        target = spark.read.parquet(path)
        if partition_col in target.columns and isinstance(target.schema[partition_col].dataType, T.NullType):  # as all its partitions are of null
            target = target.withColumn(partition_col, F.col(partition_col).cast(source.schema[partition_col].dataType))
        target = target.select(*[c for c in source.columns if c in target.columns], *[c for c in target.columns if c not in source.columns])
        source = source.select(*(F.col(c).cast(target.schema[c].dataType).alias(c) if c in source.columns else F.lit(None).cast(target.schema[c].dataType).alias(c) for c in target.columns))
    # The source is worked out once, into the directory that is to be published; it is counted, checked and merged from there.
    _write(source, fresh, partition_col)
    whole = spark.read.schema(source.schema).parquet(fresh).select(*source.columns)
    seen = whole.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.sum("n").alias("rows"), F.max("n").alias("most")).first()
    n = seen["rows"] or 0
    if not n:
        return 0
    if seen["most"] > 1:
        raise ValueError(f"the source holds a key of {keys} more than once")
    held = {r[0] for r in whole.select(partition_col).distinct().collect()} if partition_col else set()
    if target is None:
        _replace(spark, fresh, path)
        changed += held
        return n
    same = [target[k].eqNullSafe(whole[k]) for k in keys]
    affected, values = target, []
    replaced = _replaces(target.columns, keys, update_cols, keep_if_null)
    if partition_col:  # of which a table has one for each day or so
        met = whole.select(*keys, F.lit(True).alias("__met"))
        found = target.join(met, [target[k].eqNullSafe(met[k]) for k in keys], "left").groupBy(target[partition_col]).agg(F.count("*").alias("rows"), F.count("__met").alias("met")).collect()
        values = [*held, *(r[0] for r in found if r["met"] and r[0] not in held)]
        changed += values
        # Rows are carried over only from partitions that hold more than the source's keys.
        rest = [r[0] for r in found if r[0] in values and (not replaced or r["met"] < r["rows"])]
        affected = target.where(F.col(partition_col).isin([v for v in rest if v is not None]) | (F.col(partition_col).isNull() if None in rest else F.lit(False)))
    if replaced:
        if not partition_col or rest:
            _write(affected.join(whole, same, "left_anti"), fresh, partition_col)
    else:
        fresh = f"{path}.new-{uuid.uuid4().hex}"
        _write(merged(affected, whole, keys, update_cols, keep_if_null), fresh, partition_col)
    if partition_col:
        _publish(spark, fresh, path, partition_col, values)
    else:
        _replace(spark, fresh, path)
    return n


#: An alias is known by its text, store and source.
ALIAS_KEY = ["raw_text", "enseigne", "source"]


def alias_key(df: DataFrame) -> DataFrame:
    """Aliases with their store's name never null, as their key needs it."""
    return df.withColumn("enseigne", F.coalesce("enseigne", F.lit("")))
