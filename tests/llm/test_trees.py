"""Cover trees, the Merkle manifest and the dual-tree search against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from pricelens.llm import cover_tree, dual_tree, merkle

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [(1, None, None, None, None), (2, "", "en", "s", 0), (3, "a b", "en", "s", 3), (3, "a b", "en", "s", 3), (None, "a b", None, "s", 3), (5, "x" * 200_000, "fr", "s", 200_000), (6, "!!! ###", "en", None, 7), (4, "é", "É", "s", 1)]


def docs(spark, data):
    """Documents with columns whose names the operators use inside."""
    return spark.createDataFrame(data, DOCS).withColumns({"tree": F.lit(1), "rank": F.lit(2), "leaf": F.lit(3), "terms": F.lit("v"), "id": F.lit(0), "score": F.lit(1)})


# Merkle manifest ------------------------------------------------------------------------------------------------------


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def floors_of(hashes):
    out = [hashes]
    while len(out[-1]) > 1:
        out.append([sha(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def way_of(floors, k):
    way = []
    for level in floors[:-1]:
        way.append((level[k - 1] if k % 2 else "", level[k + 1] if k % 2 == 0 and k + 1 < len(level) else ""))
        k //= 2
    return way


def manifest_by_hand(data):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for doc_id, text, lang, source, n in data:
        leaf = sha(*map(told, (doc_id, source, lang, n, text)))
        spoilt = doc_id is not None and n is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        groups.setdefault(lang, []).append((doc_id, leaf, sha(*map(told, (doc_id, source, lang, n + 1, text))) if spoilt else leaf))
    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    for n in names:
        groups[n].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    trees = {n: floors_of([x[1] for x in groups[n]]) for n in names}
    top = floors_of([trees[n][-1][0] for n in names])
    out = []
    for j, n in enumerate(names):
        for k, (doc_id, leaf, shown) in enumerate(groups[n]):
            way = way_of(trees[n], k) + way_of(top, j)
            for before, after in way:
                shown = sha(before, shown, after)
            out.append((doc_id, leaf, trees[n][-1][0], top[-1][0], sha(*(b + a for b, a in way)), shown, shown == top[-1][0]))
    return sorted(out, key=repr)


def tampered(df):
    return merkle.manifest(df, tampered=F.crc32(F.col("doc_id").cast("string")) % 7 == 0, instead={"n_chars": F.col("n_chars") + 1})


def test_manifest_against_brute_force(spark):
    assert rows(tampered(docs(spark, ODD))) == manifest_by_hand(ODD)
    assert merkle.manifest(docs(spark, [])).count() == 0 and {r.verified for r in merkle.manifest(docs(spark, ODD)).collect()} == {True}
    rng = random.Random(3)
    some = [(rng.randrange(300), f"t{rng.randrange(9)}", rng.choice(["en"] * 5 + ["fr", "de", None]), None, rng.choice([None, i])) for i in range(150)]
    assert rows(tampered(docs(spark, some))) == manifest_by_hand(some)


def test_manifest_of_several_storeys(spark):
    """More leaves of one group than a bucket holds, and more groups as well."""
    data = [(i, "t", "hot", "s", i) for i in range(2500)] + [(i, "t", f"g{i}", "s", i) for i in range(1100)]
    assert rows(tampered(docs(spark, data))) == manifest_by_hand(data)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 8, 9, 31])
def test_paths_fold_to_the_root_and_pack(size):
    nodes = [(i, i + 1, sha(str(i)).encode()) for i in range(size)]
    floors = merkle.climb(nodes, merkle.levels_of(size, 0))
    assert len(floors[-1]) == 1 and floors[-1][0][:2] == (0, size)
    for node, way in zip(nodes, merkle.paths(floors)):
        assert merkle.fold(node[2], way) == floors[-1][0][2] and merkle.unpacked(merkle.packed(way)) == way


# Cover trees ----------------------------------------------------------------------------------------------------------


def clustered(rng, n, dim, clusters, noise):
    centres = rng.normal(size=(clusters, dim))
    return np.concatenate([centres[rng.integers(0, clusters, n)] + noise * rng.normal(size=(n, dim)), rng.normal(size=(n // 2, dim))])


@pytest.mark.parametrize(("n", "dim", "clusters", "noise"), [(400, 32, 8, 0.1), (300, 3, 3, 0.05), (400, 16, 1, 0.01), (50, 2, 1, 0.3), (1, 4, 1, 0)])
def test_tree_pairs_against_brute_force(n, dim, clusters, noise):
    rng = np.random.default_rng(n)
    x, y = clustered(rng, n, dim, clusters, noise), clustered(rng, n // 2 + 1, dim, clusters, noise)
    y[: len(y) // 2] = x[rng.integers(0, len(x), len(y) // 2)] + 0.02
    a, b, copies_a, copies_b = cover_tree.Tree(x), cover_tree.Tree(y), rng.integers(1, 4, len(x)), rng.integers(1, 4, len(y))
    near = a.unit @ b.unit.T >= 0.98
    got = cover_tree.Join(a, b, copies_a, copies_b, 0.98)
    assert (got.near[0] == near @ copies_b).all() and (got.near[1] == near.T @ copies_a).all()
    i, j = np.nonzero(near)
    assert (got.forest.roots(i) == got.forest.roots(j + len(x))).all()
    near = a.unit @ a.unit.T >= 0.98
    np.fill_diagonal(near, False)
    assert (cover_tree.Join(a, a, copies_a, copies_a, 0.98).near[0] == near @ copies_a).all()


def test_tree_covers_and_halves():
    x = clustered(np.random.default_rng(0), 600, 8, 5, 0.1)
    tree = cover_tree.Tree(x)
    assert sorted(tree.order) == list(range(len(x)))
    for node, children in enumerate(tree.children):
        held = tree.order[tree.begin[node] : tree.end[node]]
        assert (cover_tree.distances(tree.unit[held], tree.unit[tree.centre[node]][None]) <= tree.radius[node] + cover_tree.ROOM).all()
        for c in children:
            assert tree.begin[node] <= tree.begin[c] < tree.end[c] <= tree.end[node] and tree.radius[c] <= tree.radius[node] / 2 + cover_tree.ROOM


def classes_by_hand(data, similar=0.98):
    part = [(i, v, lab) for i, v, lab in data if i is not None and lab is not None and v is not None and None not in v and np.isfinite(v).all() and np.any(v)]
    scaled = lambda v: np.array(v) / np.abs(v).max()
    cos = lambda a, b: float(np.dot(scaled(a), scaled(b)) / math.sqrt(np.dot(scaled(a), scaled(a)) * np.dot(scaled(b), scaled(b))))
    near = [[k for k, (_, w, lb) in enumerate(part) if k != j and lb == lab and len(w) == len(v) and cos(np.array(v, float), np.array(w, float)) >= similar] for j, (_, v, lab) in enumerate(part)]
    root = [i for i, *_ in part]
    while True:
        fresh = [min([root[j], *(root[k] for k in ks)]) for j, ks in enumerate(near)]
        if fresh == root:
            break
        root = fresh
    out = [(i, len(ks), r, i == r) for (i, *_), ks, r in zip(part, near, root)]
    left = list(data)
    for p in part:
        left.remove(p)
    return sorted(out + [(i, 0, i, True) for i, *_ in left], key=repr)


@pytest.mark.parametrize("bin_size", [4096, 20])
def test_near_vectors_against_brute_force(spark, monkeypatch, bin_size):
    """Odd vectors, copies under one and several ids, a tight group, and a label of several cells and bins."""
    monkeypatch.setattr(cover_tree, "BIN", bin_size)
    rng = np.random.default_rng(7)
    hot = clustered(rng, 120, 6, 4, 0.05)
    tight = rng.normal(size=6) + 0.001 * rng.normal(size=(60, 6))
    data = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([hot, tight]))]
    data += [(1000 + i, hot[0].tolist(), 1) for i in range(30)] + [(5, hot[1].tolist(), 1), (-3, hot[1].tolist(), 1), (2000, hot[0].tolist(), 2), (2001, hot[0].tolist(), 2)]
    data += [(3000, [0.0] * 6, 1), (3001, None, 1), (3002, [1.0, None], 1), (3003, [float("nan"), 1.0], 1), (3004, [float("inf"), 1.0], 1), (3005, [], 1), (3006, hot[0].tolist(), None), (None, hot[0].tolist(), 1), (3007, [1.0, 2.0], 1), (3008, [1.0, 2.0], 1), (3009, [2.0, 4.0], 1)]
    data += [(3010, [1e200, 2e200], 3), (3011, [1e-200, 2e-200], 3)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label int").withColumns({"node": F.lit(1), "name": F.lit(2), "cell": F.lit(3), "near": F.lit(4)})
    assert rows(cover_tree.near_vectors(df, bin_size=bin_size)) == classes_by_hand(data)


def test_near_vectors_of_nothing(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<float>, label string")
    assert cover_tree.near_vectors(df).count() == 0
    with pytest.raises(ValueError):
        cover_tree.near_vectors(df, similar=0.0)


# Dual-tree search -----------------------------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def search_by_hand(documents, items, k=10):
    held = [(i, Counter(terms(t))) for i, t in documents]
    held = [(i, c, sum(c.values())) for i, c in held if c]
    n, total, df = len(held), sum(x for *_, x in held), Counter(t for _, c, _ in held for t in c)
    out = []
    asked = {}
    for i, t in items:
        if i is not None and t is not None:
            asked[i] = min(t, asked.get(i, t))
    for item, text in asked.items():
        scores = []
        for i, c, length in held:
            m = 100 - 75 + 75 * length * n // total
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if score > 0 and i is not None:
                scores.append((-score, i))
        out += [(item, rank + 1, i, -s) for rank, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_terms():
    for text in ["Aé Ébc-d_e9\x7fZ 　x", "", "\x00ABC\tabc", "ÀÉ İ ß straße 𝒳"]:
        assert [t.decode() for t in dual_tree.terms_of(text.encode())] == terms(text)


@pytest.mark.parametrize(("batch", "block"), [(2048, 4096), (40, 7)])
def test_search_against_brute_force(spark, monkeypatch, batch, block):
    monkeypatch.setattr(dual_tree, "BATCH", batch)
    monkeypatch.setattr(dual_tree, "BLOCK", block)
    rng = random.Random(5)
    word = lambda: rng.choice(["the", "The", "of", "a"]) if rng.random() < 0.5 else f"w{int(rng.paretovariate(0.6)) % 400}"
    text = lambda n: rng.choice([" ", "\n", "-"]).join(word() for _ in range(n))
    documents = [(i, text(rng.randint(1, 40))) for i in range(400)] + [(1000 + i, "w3 w5 the") for i in range(30)] + [(7, "w3 w5 the"), (None, "w3 w3 w5"), (2000, None), (2001, ""), (2002, "-- ..."), (2003, text(30_000))]
    items = [(i, text(rng.randint(1, 12))) for i in range(20)] + [(50, "w3 w5 w3"), (50, "w9"), (51, None), (52, ""), (None, "w3"), (53, "nowhere"), (54, text(2000)), (-1, "the")]
    df = spark.createDataFrame(documents, "doc_id long, text string").withColumns({"length": F.lit(1), "terms": F.lit(2), "score": F.lit(3), "item_id": F.lit(4)})
    asked = spark.createDataFrame(items, "item_id long, text string").withColumns({"doc_id": F.lit(1), "rank": F.lit(2)})
    assert rows(dual_tree.search(df.repartition(3), asked)) == search_by_hand(documents, items)


def test_search_of_nothing(spark):
    empty, some = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    asked = some.withColumnRenamed("doc_id", "item_id")
    assert dual_tree.search(empty, asked).count() == 0 and dual_tree.search(some, asked.limit(0)).count() == 0
    assert rows(dual_tree.search(some, asked).select("item_id", "rank", "doc_id")) == [(1, 1, 1)]


def test_whole_nodes_are_pruned():
    """Of clearly different documents most are pruned by bounds, and the best are found all the same."""
    rng = np.random.default_rng(2)
    rows_of = lambda n: [(np.sort(rng.choice(np.arange(50 * g, 50 * g + 50), 8, replace=False)), rng.integers(1, 1000, 8)) for g in range(20) for _ in range(n)]
    asked, docs_ = rows_of(2), rows_of(100)
    items = dual_tree.Items(list(range(40)), asked, 1000, np.ones(1000, np.int64))
    search = dual_tree.Search(items, 5)
    search.add(np.arange(2000), dual_tree.Rows.of(docs_))
    dense = lambda x: np.array([np.bincount(a, v, 1000) for a, v in x])
    scores = dense(asked) @ dense(docs_).T
    best = sorted((i, d, int(scores[i, d])) for i in range(40) for d in sorted(range(2000), key=lambda d: (-scores[i, d], d))[:5] if scores[i, d] > 0)
    assert sorted(search.found()) == best and search.scored < 0.2 * scores.size
