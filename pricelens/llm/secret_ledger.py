"""Secret scan through an incremental blob ledger.

Every version of a text is a blob, addressed by the digest of its bytes. The ledger is a table that says which rules, by name and
version, have read a blob and what each found. A scan appends to it: it reads only blobs with rules that have not read them yet, with
those rules alone, each blob once however many paths and versions hold it. Findings are then joined back to all paths, those of
retired rule versions left out.

Fixed values: the patterns and limits of the three base kinds, which the results must follow.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, text_of, unused
from .spans import find_spans, joined


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its pattern, a cheaper test that every text with a match passes, and how long group 1 of a match must be."""

    kind: str
    version: int
    pattern: str
    gate: str
    least: int = 0

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


RULES = (
    Rule("assign", 1, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]++)""", r"""(?i:password|passwd|secret|token|key)["']?\x20*[:=]""", 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}+", "AKIA"),
    Rule("hex", 1, r"[0-9a-f]{24,}+", r"[0-9a-f]{24}"),
    Rule("pem", 1, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", "-----BEGIN "),
    Rule("host_token", 1, r"gh[pousr]_[A-Za-z0-9]{36,}+", "gh[pousr]_"),
)
BASE_KINDS = ("assign", "access", "hex")
#: A finding names the rule version that made it.
FOUND = "array<struct<kind:string,start:int,end:int,score:int,rule:string>>"
SCHEMA = f"blob binary, rules array<string>, found {FOUND}"


def _blob(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


class Ledger:
    """The ledger in a folder, which may not exist yet."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def rows(self) -> DataFrame | None:
        """blob, rules, found: one row for each blob and scan that read it; None before the first scan."""
        at = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(SCHEMA).parquet(self.folder) if there else None

    def unseen(self, df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
        """blob, __text, due: the blobs of ``df`` (null counts as empty) with the names of the rules that have not read them yet."""
        texts = df.select(text_of(text).alias("__text"))
        blobs = texts.select(_blob(F.col("__text")).alias("blob"), "__text").dropDuplicates(["blob"])
        every, known = F.array(*(F.lit(r.name) for r in rules)), self.rows()
        if known is None:
            return blobs.withColumn("due", every)
        seen = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("__seen"))  # as many as there are scans
        due = F.array_except(every, F.coalesce("__seen", F.array().cast("array<string>")))
        return blobs.join(seen, "blob", "left").withColumn("due", due).where(F.size("due") > 0).drop("__seen")

    def scan(self, df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Read what is unseen in ``df`` and append it to the ledger."""
        body = F.col("__text")

        def spans(rule: Rule) -> Column:
            keep = (lambda m: F.length(F.regexp_extract(m, rule.pattern, 1)) >= rule.least) if rule.least else None
            found = find_spans(rule.kind, body, rule.pattern, F.array_contains("due", rule.name) & body.rlike(rule.gate), keep)
            return F.transform(found, lambda s: F.struct(*(s[c].alias(c) for c in ("kind", "start", "end", "score")), F.lit(rule.name).alias("rule")))

        found = F.concat(*map(spans, rules)) if rules else F.array()
        self.unseen(df, text, rules).select("blob", F.col("due").alias("rules"), found.cast(FOUND).alias("found")).write.mode("append").parquet(self.folder)

    def findings(self, df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, into: str = "found", one_scan: bool = False) -> DataFrame:
        """``df`` with ``into``: what ``rules`` have found in each row's text, by start and then rule as listed; null if the ledger has not all of them for it.

        Findings of other rule versions stay in the ledger and out of the result. ``one_scan`` says that all blobs were read in one
        scan, which spares bringing scans together.
        """
        names = [r.name for r in rules]
        place = F.create_map(*(F.lit(x) for i, n in enumerate(names) for x in (n, i))) if names else F.lit(None).cast("map<string,int>")
        known = self.rows()
        if known is None:
            known = self.spark.createDataFrame([], SCHEMA)
        if not one_scan:
            # Two scans that began before either had written, or one that was written twice, tell the same: each finding counts once.
            known = known.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("rules"))).alias("rules"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
        current = F.filter("found", lambda s: s["rule"].isin(*names))
        ordered = F.transform(F.array_sort(F.transform(current, lambda s: F.struct(s["start"].alias("at"), place[s["rule"]].alias("nr"), s.alias("span")))), lambda x: x["span"])
        whole = F.size(F.array_except(F.array(*map(F.lit, names)).cast("array<string>"), "rules")) == 0
        blob, own = unused(df, "blob", "own")
        told = known.where(whole).select(F.col("blob").alias(own), ordered.alias(into))
        paths = df.withColumn(blob, _blob(text_of(text)))
        return paths.join(told, F.col(blob) == F.col(own), "left").drop(blob, own)


def _count(kind: str) -> Column:
    return F.size(F.filter("__found", lambda s: s["kind"] == kind)).cast("long")


def secret_report(df: DataFrame, folder: str | None = None, text: str = "text", doc_id: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per input row: doc_id, counts of the base kinds, digest of the base spans and all spans.

    The ledger in ``folder`` is read and added to; without one a new ledger is begun in the shared folder. Null texts count as empty
    and have no findings; rows that share a text share its findings; every row is kept, and an empty table gives an empty result.
    """
    ledger = Ledger(df.sparkSession, folder or f"{Scratch(df.sparkSession).folder}/ledger")
    slim = df.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("__text"))
    fresh = ledger.rows() is None
    ledger.scan(slim, "__text", rules)
    found = ledger.findings(slim, "__text", rules, "__found", fresh)
    base = F.filter("__found", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *(_count(k).alias(f"n_{k}") for k in BASE_KINDS), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("__found")).alias("spans"))
