"""A Merkle manifest of a dataset, by nested-interval labels.

Each row is a leaf, and the leaves of a group, in the order of their ids, form a binary tree; the roots of the groups, in the order
of the groups, form a tree in turn, whose root stands for the dataset. A leaf is labelled with its rank, and a node with the interval
[lo, hi) of leaf ranks that it covers, so that it is an ancestor of every node whose interval lies in its own.

Levels are taken in storeys of ``STEP``. A storey's nodes of ``2 ** STEP`` neighbours lie in one bucket, which is their common ancestor's
interval, and are hashed up to it in one task; the next storey takes those ancestors. So a tree of 2^40 leaves has four storeys, and
no bucket holds more than 1024 rows, however large a group is. Downwards, a containment join within the buckets of each storey
attaches to every node the path that its ancestor has to the root; a node's siblings are those that cover what its parent's interval
has besides its own. Only the lowest storey has as many rows as the dataset, and it is shuffled once by rank and once by bucket, as
digests; texts are read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch

#: Levels of a storey.
STEP = 10
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Roots of groups are sent to every task if they are no more than so many.
FEW = 10_000


def leaf_of(fields: tuple[str, ...], instead: dict[str, Column] | None = None) -> Column:
    """The digest of a row: of each field its length in bytes, a colon and its value, or ``-`` for null."""

    def told(name: str) -> Column:
        value = (instead or {}).get(name, F.col(f"`{name}`")).cast("string")
        return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(told, fields)), 256))


def ranked(df: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """``df`` with rank (from 0, within ``tree``, by ``order``) and size, the rows of its tree.

    A range partition sorts all rows; a rank is a row's place in its partition and what the partitions before it hold of its tree, so
    a tree lies in as many tasks as its rows need.
    """
    sorted_rows = df.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("pos", F.monotonically_increasing_id())
    placed = scratch.put(sorted_rows.withColumn("part", F.shiftright("pos", 33)))
    before = Window.partitionBy("tree").orderBy("part")
    # A row for each partition and tree in it.
    parts = placed.groupBy("tree", "part").agg(F.min("pos").alias("first"), F.count("*").alias("held"))
    parts = scratch.put(parts.select("tree", "part", (F.sum("held").over(before) - F.col("held") - F.col("first")).alias("shift"), F.sum("held").over(Window.partitionBy("tree")).alias("size")))
    return placed.join(parts, ["tree", "part"]).withColumn("rank", F.col("pos") + F.col("shift")).drop("pos", "part", "shift")


def digest(parts: bytes) -> bytes:
    return hashlib.sha256(parts).hexdigest().encode()


def levels_of(size: int, storey: int) -> int:
    """The levels of a storey in a tree of ``size`` leaves: all that are left, ``STEP`` at most."""
    return max(0, min(STEP, (size - 1).bit_length() - STEP * storey))


Node = tuple[int, int, bytes]


def climb(nodes: list[Node], levels: int) -> list[list[Node]]:
    """The levels above neighbouring ``nodes`` (lo, hi, digest as hex), their own first: each node covers the intervals of two."""
    floors = [nodes]
    for _ in range(levels):
        below = floors[-1]
        floors.append([(below[i][0], below[min(i + 1, len(below) - 1)][1], digest(b"".join(n[2] for n in below[i : i + 2]))) for i in range(0, len(below), 2)])
    return floors


def siblings(parent: Node, children: list[Node]) -> Iterator[tuple[Node, bytes, bytes]]:
    """Each child of ``parent`` with the digests of those that cover what is before and after it in the parent's interval."""
    for child in children:
        before = b"".join(d for lo, hi, d in children if parent[0] <= lo and hi <= child[0])
        after = b"".join(d for lo, hi, d in children if child[1] <= lo and hi <= parent[1])
        yield child, before, after


#: A way to the root: one step for each level, with the digests before and after the node.
Path = tuple[tuple[bytes, bytes], ...]


def paths(floors: list[list[Node]], above: Path = ()) -> list[Path]:
    """Of each node of the lowest floor its way up; ``above`` is that of the top one."""
    known: list[Path] = [above]
    for level in range(len(floors) - 2, -1, -1):
        known = [((before, after), *way) for i, way in enumerate(known) for _, before, after in siblings(floors[level + 1][i], floors[level][2 * i : 2 * i + 2])]
    return known


def fold(leaf: bytes, way: Path) -> bytes:
    """The root that a leaf and its way give."""
    for before, after in way:
        leaf = digest(before + leaf + after)
    return leaf


def packed(way: Path) -> bytes:
    """A way as bytes: of each step the lengths of both sides in digests, then the digests."""
    return b"".join(bytes((len(b) // 64, len(a) // 64)) + bytes.fromhex((b + a).decode()) for b, a in way)


def unpacked(data: bytes) -> Path:
    steps, at = [], 0
    while at < len(data):
        b, a = data[at], data[at + 1]
        both = data[at + 2 : at + 2 + 32 * (b + a)].hex().encode()
        steps.append((both[: 64 * b], both[64 * b :]))
        at += 2 + 32 * (b + a)
    return tuple(steps)


def _hexes(column) -> list[bytes]:
    return [x.hex().encode() for x in column.to_pylist()]


_PARTS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64()), ("path", pa.binary())]))
_RAISED = "tree string, lo long, hi long, size long, digest binary, parts array<struct<lo:long,hi:long,path:binary>>"


def _raised(storey: int):
    """A bucket of a storey's nodes as its common ancestor, with the way of each of them up to it."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("lo")
        nodes = list(zip(table["lo"].to_pylist(), table["hi"].to_pylist(), _hexes(table["digest"])))
        size = table["size"][0].as_py()
        floors = climb(nodes, levels_of(size, storey))
        top = floors[-1][0]
        parts = [{"lo": n[0], "hi": n[1], "path": packed(way)} for n, way in zip(nodes, paths(floors))]
        row = [table["tree"][:1].combine_chunks(), pa.array([top[0]]), pa.array([top[1]]), pa.array([size]), pa.array([bytes.fromhex(top[2].decode())], pa.binary()), pa.array([parts], _PARTS)]
        return pa.table(row, names=["tree", "lo", "hi", "size", "digest", "parts"])

    return run


def attached(nodes: DataFrame, storey: int, scratch: Scratch) -> DataFrame:
    """tree, lo, hi, path, top: the way of each of ``nodes`` (tree, lo, hi, size, digest), which are a storey's, to the top of its tree."""
    floors = []
    while ((most := nodes.agg(F.max("size")).first()[0]) or 0) > 1 << STEP * storey:
        bucket = F.shiftright("lo", STEP * (storey + 1)).alias("bucket")
        up = scratch.put(nodes.groupBy("tree", bucket).applyInArrow(_raised(storey), _RAISED))
        floors.append((storey, up))
        nodes, storey = up.drop("parts"), storey + 1
    found = nodes.select("tree", "lo", "hi", F.lit(b"").alias("path"), F.col("digest").alias("top"))
    for level, up in reversed(floors):
        bucket = lambda lo, level=level: F.shiftright(lo, STEP * (level + 1))
        parts = up.select("tree", F.inline("parts"))
        ancestors = found.select(F.col("tree").alias("tree_"), F.col("lo").alias("lo_"), F.col("hi").alias("hi_"), F.col("path").alias("path_"), "top")
        within = (F.col("tree") == F.col("tree_")) & (bucket("lo") == bucket("lo_")) & (F.col("lo") >= F.col("lo_")) & (F.col("hi") <= F.col("hi_"))
        found = parts.join(ancestors, within).select("tree", "lo", "hi", F.concat("path", "path_").alias("path"), "top")
    return found


def _bucketed(table: pa.Table) -> pa.Table:
    """Neighbouring leaves as one row: their interval, ids and digests, and the digest of their common ancestor."""
    table = table.sort_by("rank").combine_chunks()
    ranks, size = table["rank"].to_pylist(), table["size"][0].as_py()
    top = climb([(r, r + 1, d) for r, d in zip(ranks, _hexes(table["leaf"]))], levels_of(size, 0))[-1][0]
    listed = lambda c: pa.ListArray.from_arrays(pa.array([0, len(ranks)], pa.int32()), table[c].combine_chunks())
    row = [table["tree"][:1].combine_chunks(), pa.array([top[0]]), pa.array([top[1]]), pa.array([size]), pa.array([bytes.fromhex(top[2].decode())], pa.binary()), *map(listed, ("id", "leaf", "bad"))]
    return pa.table(row, names=["tree", "lo", "hi", "size", "digest", "ids", "leaves", "bads"])


def _proved(batches):
    """Each leaf of a bucket with its proof, and the root that its leaf, or the tampered one in its place, folds to."""
    for batch in batches:
        for i in range(batch.num_rows):
            value = lambda c: batch.column(c)[i]
            lo, size, leaves = value("lo").as_py(), value("size").as_py(), [x.hex().encode() for x in value("leaves").as_py()]
            above = unpacked(value("path").as_py() + value("path_up").as_py())
            ways = paths(climb([(lo + k, lo + k + 1, d) for k, d in enumerate(leaves)], levels_of(size, 0)), above)
            proofs = [hashlib.sha256(b"".join(b + a for b, a in way)).hexdigest() for way in ways]
            shown = [leaf if bad is None else bad.hex().encode() for leaf, bad in zip(leaves, value("bads").as_py())]
            folded = [fold(leaf, way).decode() for leaf, way in zip(shown, ways)]
            subroot, root, n = value("top").as_py().hex(), value("root").as_py().hex(), len(leaves)
            columns = [value("ids").values, pa.array([x.decode() for x in leaves]), pa.array([subroot] * n), pa.array([root] * n), pa.array(proofs), pa.array(folded), pa.array([f == root for f in folded])]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])


def manifest(
    df: DataFrame, fields: tuple[str, ...] = FIELDS, group: str = "lang", doc_id: str = "doc_id", tampered: Column | None = None, instead: dict[str, Column] | None = None
) -> DataFrame:
    """One row per input row: the id, leaf, subroot of its group, root of the dataset, proof_sha256, folded_root and verified.

    The proof is the digest of all siblings on the way from the leaf over the subroot to the root. Where ``tampered`` holds, the leaf of
    the fields with those of ``instead`` in their places is folded with the untampered siblings; verified says whether a fold gives the root.
    A null is a value of its own in leaves and groups: the group of null comes first, and null ids come first in their group. Rows
    that repeat an id are ordered by their leaf; equal rows are leaves of their own with equal digests. Empty and long texts are
    values like others, other columns play no part, and an empty table gives an empty result.
    """
    scratch = Scratch(df.sparkSession)
    tree = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group}`").cast("string")), F.lit("0"))  # null comes first
    bad = F.when(tampered, leaf_of(fields, instead)) if tampered is not None else F.lit(None).cast("binary")
    leaves = df.select(tree.alias("tree"), F.col(f"`{doc_id}`").alias("id"), leaf_of(fields).alias("leaf"), bad.alias("bad"))
    leaves = scratch.put(leaves.withColumn("nr", F.monotonically_increasing_id()))  # deals out equal rows
    kind = leaves.schema["id"].dataType
    buckets = T.StructType.fromDDL("tree string, lo long, hi long, size long, digest binary")
    for name, of in (("ids", kind), ("leaves", T.BinaryType()), ("bads", T.BinaryType())):
        buckets.add(name, T.ArrayType(of))
    by_rank = ranked(leaves, ["id", "leaf", "nr"], scratch).drop("nr")
    held = scratch.put(by_rank.groupBy("tree", F.shiftright("rank", STEP).alias("bucket")).applyInArrow(_bucketed, buckets))
    found = scratch.put(attached(held.select("tree", "lo", "hi", "size", "digest"), 1, scratch))

    # The roots of the groups are the leaves of one more tree.
    groups = scratch.put(found.where("lo = 0").select(F.col("tree").alias("name"), F.col("top").alias("digest")))
    subroots = ranked(groups.withColumn("tree", F.lit("")), ["name"], scratch)
    subroots = scratch.put(subroots.select("tree", F.col("rank").alias("lo"), (F.col("rank") + 1).alias("hi"), "size", "digest", "name"))
    ways = attached(subroots.drop("name"), 0, scratch).select("lo", F.col("path").alias("path_up"), F.col("top").alias("root"))
    named = scratch.put(subroots.select("lo", F.col("name").alias("tree")).join(ways, "lo").drop("lo"))
    whole = found.drop("hi").join(F.broadcast(named) if named.count() <= FEW else named, "tree")

    out = T.StructType([T.StructField("id", kind)])
    for name in ("leaf", "subroot", "root", "proof_sha256", "folded_root"):
        out.add(name, "string")
    proved = held.drop("digest", "hi").join(whole, ["tree", "lo"]).mapInArrow(_proved, out.add("verified", "boolean"))
    return proved.withColumnRenamed("id", doc_id)
