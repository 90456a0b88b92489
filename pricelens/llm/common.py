"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import os
import tempfile
import uuid
from itertools import count

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the session names in ``spark.checkpoint.dir``, which a cluster shares between executors.

    Only where none is set and all runs on one machine, as in tests, a temporary one is made; on a cluster that is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        sc = spark.sparkContext
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="spark-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", named)
    return named


class Scratch:
    """Written tables of one run, in a folder of its own in the shared one. Executors may be lost: what is written stays."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder, self.numbers = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}", count()
        self.paths: dict[int, str] = {}

    def put(self, df: DataFrame) -> DataFrame:
        """The rows of ``df``, written and to be read from there: its lineage ends."""
        path = f"{self.folder}/{next(self.numbers)}"
        df.write.parquet(path)
        written = self.spark.read.schema(df.schema).parquet(path)
        self.paths[id(written)] = path
        return written

    def drop(self, *written: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        for df in written:
            drop_table(self.spark, self.paths.pop(id(df)))


def drop_table(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and return the written rows."""
    return Scratch(df.sparkSession).put(df)


def unused(df: DataFrame, *names: str) -> list[str]:
    """For each of ``names`` one that no column of ``df`` has, whatever its case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_of(name: str = "text"):
    """The text column with null as the empty string."""
    return F.coalesce(F.col(f"`{name}`"), F.lit(""))


def learns(doc_id: str, folds: int, held: int):
    """True for rows outside the held-out fold: crc32 of the id as text, modulo ``folds``, is not ``held``.

    A null id has no remainder; such a row is not held out and takes no part in learning.
    """
    return F.crc32(F.col(doc_id).cast("string")) % folds != held
