"""Near-duplicate vectors of a label by cover trees, whose nodes are joined in pairs.

On unit vectors a cosine of at least ``similar`` is a Euclidean distance of at most ``t = sqrt(2 - 2 * similar)``. A cover tree's node has a
centre and a radius that covers all its vectors; its children's centres lie more than half its radius apart and cover it at half its
radius. Two nodes whose centres are further apart than ``t`` and both radii hold no pair, so the pair is pruned; where they are
nearer than ``t`` less both radii, all pairs of the two are links and are counted as a whole. Of the others, that with the larger radius is replaced by
its children. Pairs of single vectors are checked by their cosine in double precision, so the links are exact.

Large labels are dealt to cells first, which are the top level of their tree: centres are drawn farthest first from a bounded
sample, so that each beginning of their order covers the sample at a smaller radius, and a vector's home is its nearest centre. A
vector at distance d from a centre q and d' from its own p is within t of vectors of q's cell only if (d^2 - d'^2) / (2 |p - q|) <= t; it is
then a guest of that cell, or those of q are guests of p's, so that each pair of cells meets once (Das Sarma et al., 2014). The core of a cell, within t / 2
of its centre, is linked in full without being compared, so that a group of very near copies costs no more than it has rows. Cells are dealt to bins of bounded
size by hash, each a tree built once, and each pair of bins is a task's row. A task returns counts and a spanning forest, never pairs.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch
from .components import components

SIMILAR = 0.98
#: Vectors of a bin (about), most centres of a label and of all labels, vectors drawn for each centre.
BIN, CENTRES, ALL_CENTRES, DRAWN = 4096, 256, 4096, 4
#: Nodes of no more vectors have single ones as children.
LEAF = 64
#: Room for rounding in bounds; what lies within it is decided by the cosine itself.
ROOM = 1e-6


def unit(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``vectors`` scaled by powers of two so that squares neither overflow nor vanish, and as unit vectors."""
    if not vectors.size:
        return vectors.astype(np.float64), vectors.astype(np.float64)
    scaled = np.ldexp(vectors.astype(np.float64), -np.frexp(np.abs(vectors).max(1).astype(np.float64))[1][:, None])
    return scaled, scaled / np.sqrt(np.einsum("ij,ij->i", scaled, scaled))[:, None]


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Cosine of each row of ``a`` with that of ``b``, in double precision."""
    dot = np.einsum("ij,ij->i", a, b)
    return dot / np.sqrt(np.einsum("ij,ij->i", a, a) * np.einsum("ij,ij->i", b, b))


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of unit vectors by products: off by no more than ``ROOM`` where they matter."""
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


class Tree:
    """A cover tree over distinct vectors: nodes as arrays, each over a slice of ``order``; a node without children is one vector."""

    def __init__(self, vectors: np.ndarray):
        self.vectors, n = vectors, len(vectors)
        self.scaled, self.unit = unit(vectors)
        self.order = np.arange(n)
        self.centre, self.radius, self.begin, self.end, self.children = [], [], [], [], []
        if n:
            self._grow(0, n, 0)
        self.centre, self.begin, self.end, self.radius = (np.array(x) for x in (self.centre, self.begin, self.end, self.radius))

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("scaled", "unit")}

    def __setstate__(self, state):
        self.__dict__ = state
        self.scaled, self.unit = unit(self.vectors)

    def _node(self, at: int, begin: int, end: int, radius: float) -> int:
        self.centre.append(at)
        self.radius.append(radius)
        self.begin.append(begin)
        self.end.append(end)
        self.children.append(np.zeros(0, np.int64))
        return len(self.centre) - 1

    def _grow(self, begin: int, end: int, at: int) -> int:
        """The node of ``order[begin:end]`` with the vector ``at`` as its centre."""
        members = self.order[begin:end]
        away = distances(self.unit[members], self.unit[at][None])[:, 0]
        if len(members) == 1:
            return self._node(at, begin, end, 0.0)
        radius = float(away.max())
        node = self._node(at, begin, end, radius + ROOM)
        if radius <= ROOM or len(members) <= LEAF:  # a child each
            self.children[node] = np.array([self._node(m, begin + i, begin + i + 1, 0.0) for i, m in enumerate(members)])
            return node
        home, centres = self._cover(members, at, radius / 2)
        by_home = np.argsort(home, kind="stable")
        self.order[begin:end] = members[by_home]
        bounds = begin + np.searchsorted(home[by_home], np.arange(len(centres) + 1))
        self.children[node] = np.array([self._grow(int(bounds[k]), int(bounds[k + 1]), int(c)) for k, c in enumerate(centres)])
        return node

    def _cover(self, members: np.ndarray, first: int, within: float) -> tuple[np.ndarray, list[int]]:
        """Centres among ``members``, each further than ``within`` from those before it, and of each member the number of the first that covers it."""
        home, centres = np.full(len(members), -1), [first]
        for low in range(0, len(members), 256):
            part = members[low : low + 256]
            near = distances(self.unit[part], self.unit[centres]) <= within
            got = np.where(near.any(1), near.argmax(1), -1)
            left = np.flatnonzero(got < 0)
            among = distances(self.unit[part[left]], self.unit[part[left]]) <= within
            for i in range(len(left)):
                if got[left[i]] < 0:
                    fresh = got[left] < 0
                    got[left[among[i] & fresh]] = len(centres)
                    got[left[i]] = len(centres)
                    centres.append(int(part[left[i]]))
            home[low : low + 256] = got
        return home, centres


class Forest:
    """Sets of nodes that are joined by links, each named by one of them."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self, of: np.ndarray) -> np.ndarray:
        found = self.parent[of]
        while (further := self.parent[found] != found).any():
            found = np.where(further, self.parent[found], found)
        return found

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        a, b = self.roots(a), self.roots(b)
        apart = a != b
        if not apart.any():
            return
        for pair in np.unique(a[apart] * len(self.parent) + b[apart]):
            x, y = divmod(int(pair), len(self.parent))
            while self.parent[x] != x:
                x = int(self.parent[x])
            while self.parent[y] != y:
                y = int(self.parent[y])
            self.parent[max(x, y)] = min(x, y)
        self.parent = self.roots(np.arange(len(self.parent)))


class Join:
    """The links between two trees, or within one: ``near[i]`` is how many vectors, copies included, of the other are linked to i."""

    def __init__(self, a: Tree, b: Tree, copies_a: np.ndarray, copies_b: np.ndarray, similar: float):
        self.a, self.b, self.similar, self.reach = a, b, similar, float(np.sqrt(max(0.0, 2 - 2 * similar)))
        self.sums = [np.concatenate(([0], np.cumsum(c[t.order]))) for t, c in ((a, copies_a), (b, copies_b))]
        self.copies, self.near = (copies_a, copies_b), (np.zeros(len(copies_a), np.int64), np.zeros(len(copies_b), np.int64))
        self.forest = Forest(len(copies_a) + (0 if a is b else len(copies_b)))
        self.shift = 0 if a is b else len(copies_a)
        self.checked = 0
        if len(copies_a) and len(copies_b):
            self._visit(np.zeros(1, np.int64), np.zeros(1, np.int64))
        if a is b:
            self.near[0][:] -= copies_a  # a vector was linked to itself

    def _visit(self, left: np.ndarray, right: np.ndarray) -> None:
        """All pairs of the nodes ``left`` of a and ``right`` of b."""
        a, b = self.a, self.b
        for low in range(0, len(left), 512):
            some = left[low : low + 512]
            d = distances(a.unit[a.centre[some]], b.unit[b.centre[right]])
            self.checked += d.size
            both = a.radius[some][:, None] + b.radius[right][None]
            singles = (a.radius[some] == 0)[:, None] & (b.radius[right] == 0)[None]
            met = d <= self.reach + both + ROOM
            whole = met & (d <= self.reach - both - ROOM) & ~singles
            i, j = np.nonzero(whole)
            if len(i):
                self._all(some[i], right[j])
            rest = met & ~whole
            i, j = np.nonzero(rest & singles)
            for k in range(0, len(i), 100_000):
                x, y = i[k : k + 100_000], j[k : k + 100_000]
                self._check(a.centre[some[x]], b.centre[right[y]], d[x, y])
            rest &= ~singles
            down_b = rest & (b.radius[right][None] >= a.radius[some][:, None])
            for k in np.flatnonzero(down_b.any(0)):
                self._visit(some[down_b[:, k]], b.children[right[k]])
            rest &= ~down_b
            for k in np.flatnonzero(rest.any(1)):
                self._visit(a.children[some[k]], right[rest[k]])

    def _all(self, left: np.ndarray, right: np.ndarray) -> None:
        a, b = self.a, self.b
        (sum_a, sum_b), (near_a, near_b) = self.sums, self.near
        for x, y in zip(left, right):
            mine, other = a.order[a.begin[x] : a.end[x]], b.order[b.begin[y] : b.end[y]]
            near_a[mine] += sum_b[b.end[y]] - sum_b[b.begin[y]]
            if a is not b:
                near_b[other] += sum_a[a.end[x]] - sum_a[a.begin[x]]
            self.forest.join(np.concatenate((mine, other + self.shift)), np.full(len(mine) + len(other), mine[0]))

    def _check(self, i: np.ndarray, j: np.ndarray, d: np.ndarray) -> None:
        a, b = self.a, self.b
        linked = d < self.reach - ROOM
        near = np.flatnonzero(~linked)
        linked[near] = cosines(a.scaled[i[near]], b.scaled[j[near]]) >= self.similar
        if a is b:
            linked |= i == j
        i, j = i[linked], j[linked]
        np.add.at(self.near[0], i, self.copies[1][j])
        if a is not b:
            np.add.at(self.near[1], j, self.copies[0][i])
        self.forest.join(i, j + self.shift)


def _digested(batches):
    """Each vector as bytes, with a digest that names it within its label; null for those that take no part."""
    for batch in batches:
        names, data = [], []
        for label, values in zip(batch.column("label").to_pylist(), batch.column("embedding")):
            vector = (np.asarray(values.values) + 0.0).tobytes() if values.is_valid else None  # one zero only
            data.append(vector)
            names.append(hashlib.blake2b(vector, digest_size=16, key=hashlib.md5(label.encode()).digest()).digest() if values.is_valid else None)
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("vec_id", "label", "dim", "kind")), pa.array(names, pa.binary()), pa.array(data, pa.binary())], names=["vec_id", "label", "dim", "kind", "name", "vector"])


def members_of(df: DataFrame, vec_id: str, embedding: str, label: str) -> DataFrame:
    """vec_id, label (as text), dim, kind (the width of a component in bytes), name and vector (bytes) of each row; the last two are null for vectors that take no part."""
    narrow = df.schema[embedding].dataType.elementType.simpleString() == "float"
    rows = df.select(
        F.col(f"`{vec_id}`").cast("long").alias("vec_id"), F.col(f"`{label}`").cast("string").alias("label"), F.col(f"`{embedding}`").cast(f"array<{'float' if narrow else 'double'}>").alias("embedding")
    )
    finite = F.exists("embedding", lambda x: x != 0) & F.forall("embedding", lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    takes_part = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite
    rows = rows.withColumn("embedding", F.when(takes_part, F.col("embedding"))).withColumns({"dim": F.size("embedding"), "kind": F.lit(4 if narrow else 8)})
    return rows.mapInArrow(_digested, "vec_id long, label string, dim int, kind int, name binary, vector binary")


#: Turns the sign of an id, so that ids as bytes sort as ids do.
SIGN = -(1 << 63)


def _matrix(data: list[bytes], kind: int) -> np.ndarray:
    return np.frombuffer(b"".join(data), np.float32 if kind == 4 else np.float64).reshape(len(data), -1).astype(np.float64)


class Centres:
    """The centres of a label: unit vectors, names of the nodes at them, and distances between them."""

    def __init__(self, vectors: np.ndarray, names: list[bytes], wanted: int):
        _, units = unit(vectors)
        chosen, away = [0], distances(units, units[:1])[:, 0]
        while len(chosen) < wanted and away.max() > ROOM:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, distances(units, units[chosen[-1:]])[:, 0])
        self.units, self.names = units[chosen], [names[i] for i in chosen]
        self.apart = distances(self.units, self.units)


def _centres(pool: DataFrame) -> dict[tuple[str, int], Centres]:
    """Of each label too large for one bin its centres; of all labels ``ALL_CENTRES`` at most, the largest labels first.

    A label beyond that is one cell, whose bins meet all of each other.
    """
    large = pool.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > BIN)
    wanted, left = {}, ALL_CENTRES
    for r in large.orderBy(F.desc("n"), "label", "dim").limit(ALL_CENTRES).collect():
        wanted[r["label"], r["dim"]] = min(CENTRES, -(-r["n"] // BIN), left)
        left -= wanted[r["label"], r["dim"]]
        if not left:
            break
    if not wanted:
        return {}
    spark = pool.sparkSession
    asked = spark.createDataFrame([(*k, DRAWN * n) for k, n in wanted.items()], "label string, dim int, drawn int")
    order = Window.partitionBy("label", "dim").orderBy("name")  # names are digests, so their order is a draw
    # The limit by the largest draw is taken before rows are shuffled.
    first = pool.join(F.broadcast(asked), ["label", "dim"]).withColumn("nr", F.row_number().over(order)).where(F.col("nr") <= DRAWN * CENTRES).where("nr <= drawn")
    found: dict[tuple[str, int], list] = {}
    for r in first.orderBy("label", "dim", "nr").select("label", "dim", "kind", "node", "vector").collect():
        found.setdefault((r["label"], r["dim"]), []).append(r)
    return {k: Centres(_matrix([r["vector"] for r in rows], rows[0]["kind"]), [bytes(r["node"]) for r in rows], wanted[k]) for k, rows in found.items()}


CORE, REST, GUEST = 0, 1, 2
KEPT = ("label", "dim", "kind", "node", "copies", "vector")
_PLACED = "label string, dim int, kind int, node binary, copies long, vector binary, cell int, role int, hub binary"


def _placed(centres, reach: float):
    """Each vector in its own cell, in the core or not, and as a guest of the cells whose vectors it may be linked to."""

    def run(batches):
        for batch in batches:
            rows, cells, roles, hubs = [], [], [], []
            labels, dims, vectors = (batch.column(c).to_pylist() for c in ("label", "dim", "vector"))
            by: dict[tuple[str, int], list[int]] = {}
            for i, key in enumerate(zip(labels, dims)):
                by.setdefault(key, []).append(i)
            for key, at in by.items():
                known, at = centres.value.get(key), np.array(at)
                if known is None:
                    home, role, hub = np.zeros(len(at), int), np.full(len(at), REST), [None] * len(at)
                else:
                    _, units = unit(_matrix([vectors[i] for i in at], batch.column("kind")[int(at[0])].as_py()))
                    d = distances(units, known.units)
                    home = d.argmin(1)
                    own = d[np.arange(len(at)), home]
                    role = np.where(own <= reach / 2 - ROOM, CORE, REST)
                    hub = [known.names[h] if r == CORE else None for h, r in zip(home, role)]
                    # The hyperplane between two centres; an even sum of their numbers sends the larger to the smaller.
                    apart = np.maximum(known.apart[home], ROOM)
                    over = (d**2 - own[:, None] ** 2) / (2 * apart) <= reach + ROOM
                    number = np.arange(len(known.units))
                    goes = np.where((home[:, None] + number[None]) % 2 == 0, home[:, None] > number[None], home[:, None] < number[None])
                    x, q = np.nonzero(over & goes)
                    rows += at[x].tolist()
                    cells += q.tolist()
                    roles += [GUEST] * len(x)
                    hubs += [None] * len(x)
                rows += at.tolist()
                cells += home.tolist()
                roles += role.tolist()
                hubs += hub
            for low in range(0, len(rows), 8192):
                part = slice(low, low + 8192)
                taken = batch.take(pa.array(rows[part], pa.int64()))
                own_columns = [pa.array(cells[part], pa.int32()), pa.array(roles[part], pa.int32()), pa.array(hubs[part], pa.binary())]
                yield pa.RecordBatch.from_arrays([*(taken.column(c) for c in KEPT), *own_columns], names=[*KEPT, "cell", "role", "hub"])

    return run


def _planted(table: pa.Table) -> pa.Table:
    """A bin as one row: its tree, with the names and copies of its vectors."""
    table = table.sort_by("node")
    vectors = _matrix(table["vector"].to_pylist(), table["kind"][0].as_py())
    tree = pickle.dumps((Tree(vectors), table["node"].to_pylist(), np.asarray(table["copies"])), protocol=5)
    return pa.table({**{c: table[c][:1] for c in ("label", "dim", "cell", "role", "bin")}, "tree": pa.array([tree], pa.binary())})


def _joined(similar: float):
    """Of each pair of bins the vectors that have links: how many, and a vector that they are joined to."""

    def run(batches):
        last = None
        for batch in batches:
            for i in range(batch.num_rows):
                key = tuple(batch.column(c)[i].as_py() for c in ("label", "dim", "cell", "role", "bin"))
                if last != key:
                    a, last = pickle.loads(batch.column("tree")[i].as_py()), key
                same = key == tuple(batch.column(c)[i].as_py() for c in ("label", "dim", "cell", "other_role", "other_bin"))
                b = a if same else pickle.loads(batch.column("other")[i].as_py())
                join = Join(a[0], b[0], a[2], b[2], similar)
                near = join.near[0] if same else np.concatenate(join.near)
                names = a[1] if same else a[1] + b[1]
                some = np.flatnonzero(near > 0)
                hub = join.forest.roots(some)
                yield pa.RecordBatch.from_arrays([pa.array([names[x] for x in some], pa.binary()), pa.array(near[some], pa.int64()), pa.array([names[x] for x in hub], pa.binary())], names=["node", "near", "hub"])

    return run


def links(vectors: DataFrame, scratch: Scratch, similar: float = SIMILAR, bin_size: int = BIN) -> DataFrame:
    """node, near, hub of distinct ``vectors`` (label, dim, kind, node, copies, vector): how many others, copies counted, some bins hold
    that are linked to a node, and a node that links join it to. A node may have several rows, and none if it has no links."""
    reach = float(np.sqrt(max(0.0, 2 - 2 * similar)))
    centres = vectors.sparkSession.sparkContext.broadcast(_centres(vectors))  # ``ALL_CENTRES`` vectors at most
    placed = scratch.put(vectors.select(*KEPT).mapInArrow(_placed(centres, reach), _PLACED))
    cell = ["label", "dim", "cell"]
    sizes = scratch.put(placed.groupBy(*cell, "role").agg(F.ceil(F.count("*") / bin_size).alias("bins"), F.sum("copies").alias("held")).where((F.col("bins") > 1) | (F.col("role") == CORE)))
    several = sizes.where("bins > 1").drop("held")
    binned = placed.drop("hub").join(F.broadcast(several) if several.count() <= 4 * ALL_CENTRES else several, [*cell, "role"], "left")
    binned = binned.withColumn("bin", F.pmod(F.xxhash64("node"), F.coalesce("bins", F.lit(1)))).drop("bins")
    trees = scratch.put(binned.groupBy(*cell, "role", "bin").applyInArrow(_planted, "label string, dim int, cell int, role int, bin long, tree binary"))
    # Pairs of bins: the rest with itself, the core with the rest, and guests with both. They are paired by name, so that each pair is
    # dealt by both names and no task has all pairs of a cell.
    other = trees.select(*cell, F.col("role").alias("other_role"), F.col("bin").alias("other_bin"), F.col("tree").alias("other"))
    own, far = F.col("role"), F.col("other_role")
    met = ((own == REST) & (far == REST) & (F.col("bin") <= F.col("other_bin"))) | ((own == CORE) & (far != CORE)) | ((own == REST) & (far == GUEST))
    pairs = trees.drop("tree").join(other.drop("other"), cell).where(met).join(other, [*cell, "other_role", "other_bin"]).join(trees, [*cell, "role", "bin"])
    found = pairs.select(*cell, "role", "bin", "tree", "other_role", "other_bin", "other").mapInArrow(_joined(similar), "node binary, near long, hub binary")
    held = F.broadcast(sizes.where(own == CORE).drop("bins"))  # a row for each centre at most
    core = placed.where(own == CORE).join(held, [*cell, "role"]).select("node", (F.col("held") - F.col("copies")).alias("near"), "hub")
    return scratch.put(found.unionByName(core))


def near_vectors(df: DataFrame, similar: float = SIMILAR, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", bin_size: int = BIN) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors of one label and as many components are linked if their cosine is ``similar`` (above 0) or more. n_links counts the other
    rows that are linked directly, copies included, and component_id is the smallest id reachable. Vectors that are null, zero or
    hold null or non-finite components, and those without a label or an id, link with nothing; each is its own component. Rows
    that repeat an id are vectors of their own, which may be linked with each other. An empty table gives an empty result.
    """
    if not 0 < similar <= 1:
        raise ValueError("similar must be above 0 and at most 1")
    scratch = Scratch(df.sparkSession)
    members = scratch.put(members_of(df, vec_id, embedding, label))
    # Copies are one node, whose name begins with their smallest id, so that the smallest node of a component tells its smallest id.
    groups = members.where("name is not null").groupBy("label", "dim", "kind", "name").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    number = F.unhex(F.lpad(F.hex(F.col("least").bitwiseXOR(F.lit(SIGN))), 16, "0"))
    nodes = scratch.put(groups.withColumn("node", F.concat(number, "name")))
    found = links(nodes, scratch, similar, bin_size)
    near = found.groupBy("node").agg(F.sum("near").alias("near"))
    roots = components(found.select(F.col("node").alias("u"), F.col("hub").alias("v")), scratch)
    least = F.conv(F.hex(F.substring("root", 1, 8)), 16, -10).cast("long").bitwiseXOR(F.lit(SIGN))
    linked = nodes.select("name", "node", "least", "copies").join(near, "node", "left").join(roots, "node", "left")
    told = linked.select("name", (F.col("copies") - 1 + F.coalesce("near", F.lit(0))).alias("n_links"), F.coalesce(least, "least").alias("component_id")).where("n_links > 0")
    rows = members.select("vec_id", "name").join(told, "name", "left")
    component = F.coalesce("component_id", "vec_id")
    return rows.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
