"""Embedding near-dedup with a forest of random-projection trees with spill overlap."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import grouped_batches, map_arrow, spread, stage
from trackloom.llm.components import components

TREES = 8
#: Vectors that a leaf is planned to have at most, those that came over from the other side of splits included.
LEAF = 512
#: Chance that one tree keeps a pair at the threshold in one leaf: the strips around the splits are as wide as that takes.
TOGETHER = 0.6
#: A strip's half width is at least this many deviations of such a pair's distance along a direction.
LEAST_REACH = 0.25
#: A node more than this share of whose rows would go to both sides isn't split further.
MOST_SPILL = 0.3
#: The splits are placed on a sample of about this many vectors; every vector is then sent through the trees.
SAMPLE = 40_000
#: Sampled rows that a node needs to be split at a place of its own.
LEAST_ROWS = 16
#: Rows of a leaf that one task holds; a larger leaf is compared in pairs of blocks.
BLOCK = 1024
#: With more links than this, two blocks of 512 rows count them by matrix products.
CROWDED = 4096
#: Projections are sums of whole numbers, so that a vector's leaves are the same wherever they are computed.
SCALE = 1 << 15


def _excess(z: np.ndarray) -> np.ndarray:
    """E max(0, |Z| - z) for a standard normal Z."""
    tail = np.array([math.erfc(x / math.sqrt(2)) / 2 for x in z])
    return 2 * (np.exp(-z * z / 2) / math.sqrt(2 * math.pi) - z * tail)


_Z = np.linspace(0, 4, 401)
_EXCESS = _excess(_Z)


class Tree:
    """Random directions, each split where the sample is thin between its 30 % and 70 % quantiles.

    Rows within the margin of a split go down on both sides. A pair at the threshold whose distance along
    the direction has deviation `apart` is parted with a chance of E max(0, |distance| - 2 margin) times the
    density of rows at the split; the margin holds that chance at `part`. A node is split until the rows
    that it is expected to have are at most LEAF, spill included. One that lies mostly in its own strip, as
    a group of near copies does, stays whole, however large. Where too few sampled rows are left to go on,
    the leaf is split by the first few of `further`, directions common to all leaves, at its own medians.
    """

    def __init__(self, sample: np.ndarray, factor: float, seed: int, apart: float, part: float):
        rng = np.random.default_rng(seed)
        self.seed, self.apart, self.part = seed, apart, part
        directions, self.middle, self.margin, self.down, self.leaf = [], [], [], [], []
        # of each leaf, its further splits
        further, splits = [], []
        todo = [(-1, 0, sample)]
        while todo:
            parent, side, own = todo.pop()
            if parent >= 0:
                self.down[parent][side] = len(self.down)
            direction = rng.standard_normal(sample.shape[1])
            direction = np.rint(direction / np.linalg.norm(direction) * SCALE).astype(np.int64)
            middle, margin, inside = self._split(own @ direction)
            node = len(self.down)
            whole = len(own) * factor <= LEAF
            split = not whole and inside <= MOST_SPILL and len(own) >= LEAST_ROWS
            directions.append(direction), self.middle.append(middle), self.margin.append(margin), self.down.append([node, node])
            self.leaf.append(-1 if split else len(splits))
            if split:
                at = own @ direction - middle
                todo += [(node, 0, own[at < margin]), (node, 1, own[at >= -margin])]
                continue
            rows, more = len(own) * factor, []
            while not whole and inside <= MOST_SPILL and rows > LEAF and len(own):
                if len(more) == len(further):
                    direction = rng.standard_normal(sample.shape[1])
                    further.append(np.rint(direction / np.linalg.norm(direction) * SCALE).astype(np.int64))
                more.append(self._split(own @ further[len(more)]))
                rows *= (1 + more[-1][2]) / 2
                if more[-1][2] > MOST_SPILL:
                    more.pop()
                    break
            splits.append(more)
        self.directions, self.down, self.leaf = np.array(directions), np.array(self.down), np.array(self.leaf)
        self.middle, self.margin = np.array(self.middle), np.array(self.margin)
        self.further = np.array(further) if further else np.zeros((0, sample.shape[1]), np.int64)
        self.more = np.array([len(m) for m in splits])
        shape = (len(splits), max(1, len(further)))
        self.middles, self.margins = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for i, more in enumerate(splits):
            for j, (middle, margin, _) in enumerate(more):
                self.middles[i, j], self.margins[i, j] = middle, margin

    def _split(self, at: np.ndarray) -> tuple[int, int, float]:
        """Middle, margin and the share of rows inside the strip."""
        if not len(at):
            return 0, 0, 0.0
        at = np.sort(at)
        deviation = max(float(at.std()), 1.0)
        near = max(self.apart, 0.05 * deviation)
        places = at[np.unique(np.linspace(0.3, 0.7, 9) * (len(at) - 1)).astype(int)]
        within = np.searchsorted(at, places + near) - np.searchsorted(at, places - near)
        middle = int(places[within.argmin()])
        # the density at the split, not below what a normal distribution of this deviation has at its quantiles
        density = max(within.min() / (2 * near * len(at)), 0.3 / deviation)
        z = float(np.interp(-self.part / (self.apart * density), -_EXCESS, _Z))
        margin = math.ceil(max(LEAST_REACH, z) * self.apart / 2)
        inside = np.searchsorted(at, middle + margin) - np.searchsorted(at, middle - margin)
        return middle, margin, float(inside / len(at))

    def leaves(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, leaf) pairs of quantised unit vectors."""
        row, node, out = np.arange(len(x)), np.zeros(len(x), np.int64), []
        while len(row):
            done = self.leaf[node] >= 0
            if done.any():
                out.append((row[done], self.leaf[node[done]]))
                row, node = row[~done], node[~done]
            at = np.einsum("ij,ij->i", x[row], self.directions[node, : x.shape[1]]) - self.middle[node]
            low, high = at < self.margin[node], at >= -self.margin[node]
            row, node = np.concatenate([row[low], row[high]]), np.concatenate([self.down[node[low], 0], self.down[node[high], 1]])
        row, leaf = (np.concatenate(p) for p in zip(*out, strict=True)) if out else (row, node)
        path = np.ones(len(leaf), np.int64)
        for level, direction in enumerate(self.further):
            at = x[row] @ direction[: x.shape[1]] - self.middles[leaf, level]
            on = self.more[leaf] > level
            low, high = ~on | (at < self.margins[leaf, level]), on & (at >= -self.margins[leaf, level])
            path = np.concatenate([np.where(on, 2 * path, path)[low], 2 * path[high] + 1])
            row, leaf = np.concatenate([row[low], row[high]]), np.concatenate([leaf[low], leaf[high]])
        return row, (self.seed << 56) + (leaf << 36) + path


def _unit(x: np.ndarray) -> np.ndarray:
    """Unit vectors in double precision, scaled first so that squares neither overflow nor vanish."""
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _quantised(x: np.ndarray, width: int) -> np.ndarray:
    """As whole numbers; components beyond the width of the trees' directions don't count there."""
    return np.rint(_unit(x)[:, :width] * SCALE).astype(np.int64)


def _all_leaves(trees: list[Tree], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, leaf) pairs over all trees; trees of one leaf are alike, so that the first stands for all."""
    quantised = _quantised(x, trees[0].directions.shape[1])
    found = [t.leaves(quantised) for t in (trees if any(len(t.leaf) > 1 or t.more.any() for t in trees) else trees[:1])]
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def _place(trees: list[Tree], kind: str):
    """Vectors as bytes, with their leaves."""

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in stream:
            for i in range(0, whole.num_rows, 2000):
                batch = whole.slice(i, 2000)
                v = batch.column("v")
                flat = v.flatten().to_numpy(zero_copy_only=False).astype(kind)
                lengths = v.value_lengths().to_numpy()
                ends = np.cumsum(lengths)
                rows, leaves = [], []
                for length in np.unique(lengths):
                    own = np.flatnonzero(lengths == length)
                    x = flat[(ends[own] - length)[:, None] + np.arange(length)]
                    row, leaf = _all_leaves(trees, x)
                    rows.append(own[row]), leaves.append(leaf)
                row, leaf = np.concatenate(rows), np.concatenate(leaves)
                order = np.argsort(row, kind="stable")
                offsets = np.searchsorted(row[order], np.arange(len(lengths) + 1)).astype(np.int32)
                data = pa.Array.from_buffers(pa.binary(), len(v), [None, pa.py_buffer(np.concatenate([[0], ends * flat.itemsize]).astype(np.int32)), pa.py_buffer(flat)])
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("weight"), pa.array(lengths, pa.int32()), data, pa.ListArray.from_arrays(pa.array(offsets), pa.array(leaf[order]))], names=["node", "weight", "length", "v", "leaves"])

    return run


def _compare(trees: list[Tree], threshold: float, kind: str):
    """Partial link counts and a spanning forest for each pair of blocks of a leaf.

    A pair that shares several leaves counts in the smallest only.
    """

    def pairs(x: np.ndarray, weight: np.ndarray, one: np.ndarray, two: np.ndarray, leaf: int, counts: np.ndarray, up: list[int]) -> list[tuple[int, int]]:
        unit = _unit(x)
        quick = unit.astype(np.float32)
        found, edges = [], []
        for i in range(0, len(one), 512):
            for j in range(0, len(two), 512):
                if one is two and j < i:
                    continue
                a, b = one[i : i + 512], two[j : j + 512]
                # single precision is off by less than 1e-4, what is that near is taken again in double
                near = quick[a] @ quick[b].T
                p, q = np.nonzero(near >= threshold - 1e-4)
                if one is two and i == j:
                    p, q = p[p < q], q[p < q]
                sure = near[p, q] >= threshold + 1e-4
                sure[~sure] = np.einsum("ij,ij->i", unit[a[p[~sure]]], unit[b[q[~sure]]]) >= threshold
                if sure.any():
                    found.append((a, b, p[sure], q[sure]))
        if not found:
            return edges
        linked = np.unique(np.concatenate([np.concatenate([a[p], b[q]]) for a, b, p, q in found]))
        row, leaves = _all_leaves(trees, x[linked])
        row, leaves = linked[row[leaves < leaf]], leaves[leaves < leaf]
        smaller: dict[int, list[int]] = {r: [] for r in linked.tolist()}
        for r, n in zip(row.tolist(), leaves.tolist(), strict=True):
            smaller[r].append(n)
        sets = {r: frozenset(s) for r, s in smaller.items()}
        for a, b, p, q in found:
            if len(p) > CROWDED:
                link = np.zeros((len(a), len(b)), bool)
                link[p, q] = True
                counted = link & ~_met(smaller, a, b)
                counts[a] += counted @ weight[b]
                counts[b] += counted.T @ weight[a]
                edges += _forest(link, a, b, up)
                continue
            for r, s in zip(a[p].tolist(), b[q].tolist(), strict=True):
                if sets[r].isdisjoint(sets[s]):
                    counts[r] += weight[s]
                    counts[s] += weight[r]
                m, n = _root(up, r), _root(up, s)
                if m != n:
                    up[n] = m
                    edges.append((r, s))
        return edges

    def run(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in grouped_batches(stream, ["leaf", "length", "pair"]):
            length, leaf = group.column("length")[0].as_py(), group.column("leaf")[0].as_py()
            x = np.frombuffer(b"".join(group.column("v").to_pylist()), kind).reshape(-1, length)
            node, side, weight = group.column("node").to_numpy(), group.column("side").to_numpy(), group.column("weight").to_numpy()
            counts, up = np.zeros(len(node), np.int64), list(range(len(node)))
            every = np.arange(len(node))
            one, two = (every[side == 0], every[side == 1]) if side.any() else (every, every)
            edges = pairs(x, weight, one, two, leaf, counts, up)
            some = np.flatnonzero(counts)
            if not len(some) and not edges:
                continue
            ends = np.array(edges, np.int64).reshape(-1, 2)
            a = pa.array(np.concatenate([node[some], node[ends[:, 0]]]))
            b = pa.concat_arrays([pa.nulls(len(some), pa.int64()), pa.array(node[ends[:, 1]], pa.int64())])
            yield pa.RecordBatch.from_arrays([a, b, pa.array(np.concatenate([counts[some], np.zeros(len(ends), np.int64)]))], names=["a", "b", "n"])

    return run


def _root(up: list[int], x: int) -> int:
    while up[x] != x:
        up[x] = up[up[x]]
        x = up[x]
    return x


def _met(smaller: dict[int, list[int]], a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For rows a and b of a leaf, whether they share a smaller leaf too."""
    sides = [[smaller.get(r, ()) for r in side.tolist()] for side in (a, b)]
    both = {x: n for n, x in enumerate({x for r in sides[0] for x in r} & {x for r in sides[1] for x in r})}
    if not both:
        return np.zeros((len(a), len(b)), bool)
    held = [np.zeros((len(side), len(both)), np.float32) for side in sides]
    for side, matrix in zip(sides, held, strict=True):
        for n, r in enumerate(side):
            matrix[n, [both[x] for x in r if x in both]] = 1
    return held[0] @ held[1].T > 0


def _forest(link: np.ndarray, a: np.ndarray, b: np.ndarray, up: list[int]) -> list[tuple[int, int]]:
    """Links that join parts which were apart; up follows."""
    edges = []
    of = np.array([_root(up, y) for y in b.tolist()])
    for n, x in enumerate(a.tolist()):
        r = _root(up, x)
        while len(apart := np.flatnonzero(link[n] & (of != r))):
            s = int(of[apart[0]])
            up[s] = r
            of[of == s] = r
            edges.append((x, int(b[apart[0]])))
    return edges


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vectors -> vec_id, n_links, component_id, kept; one row for each row of vectors.

    Two vectors are linked at cosine >= threshold in double precision; n_links counts the other rows
    linked directly, component_id is the smallest vec_id reachable, itself included.

    Null, zero and empty vectors and those with null or non-finite components link with nothing:
    n_links 0, component_id their own vec_id. Vectors of different lengths don't link. A null vec_id:
    n_links is counted, component_id is the smallest vec_id of what it is linked with or null, kept
    false. Repeated rows link as different vectors do, by their own cosine of 1. Rows that share a
    vec_id are rows like others. Other columns are ignored. An empty table gives an empty result.

    Equal vectors are one node with a weight. The trees' splits are placed on a bounded sample; every
    node goes through all trees, into both sides of a split where it is near it. Leaves are compared
    by matrix products in blocks of bounded size, hits near the threshold again in double precision, and
    each leaf returns counts and a spanning forest, never its pairs. A table of at most LEAF different
    vectors is one leaf, so that all are compared with all.
    """
    double = not vectors.schema[vector_col].dataType.simpleString().startswith("array<float")
    kind, of = ("<f8", "double") if double else ("<f4", "float")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast(f"array<{of}>").alias("v"))
    sound = F.expr(f"size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < {of}('inf')) and exists(v, x -> x <> 0)")
    rows = rows.withColumn("sound", F.coalesce(sound, F.lit(False)))
    # equal vectors are told by 128 bits
    rows = rows.withColumn("h", F.when(F.col("sound"), F.xxhash64("v"))).withColumn("g", F.when(F.col("sound"), F.xxhash64(F.lit(1), "v", F.reverse("v"))))
    nodes = rows.where("sound").groupBy("h", "g").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight"), F.first("v").alias("v"))
    nodes = stage(nodes.withColumn("node", F.monotonically_increasing_id()))
    keys = rows.select("vec_id", "h", "g")
    n = nodes.count()
    if not n:
        return keys.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    links = _links(nodes, n, threshold, kind)
    counts = links.where("b is null").groupBy(F.col("a").alias("node")).agg(F.sum("n").alias("n"))
    labels = components(links.where("b is not null").select("a", "b"))
    labelled = labels.join(nodes.select("node", "first"), "node")
    least = labelled.groupBy("component").agg(F.min("first").alias("least"))
    labels = labelled.join(least, "component").select("node", "least")
    of_class = nodes.select("h", "g", "node", "first", "weight").join(counts, "node", "left").join(labels, "node", "left")
    of_class = of_class.select("h", "g", (F.col("weight") - 1 + F.coalesce("n", F.lit(0))).alias("n_links"), F.coalesce("least", "first").alias("component_id"))
    out = keys.join(of_class, ["h", "g"], "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def grow(sample: np.ndarray, n: int, threshold: float) -> list[Tree]:
    """The forest for n vectors, from a sample of them as quantised unit vectors."""
    depth = max(1.0, math.log2(max(1, n) / LEAF) + 1)
    # along a direction, unit vectors at the threshold are this far apart, in units of the quantised projections
    apart = math.sqrt(max(1e-6, 2 * (1 - threshold)) / sample.shape[1]) * SCALE * SCALE
    return [Tree(sample, n / max(1, len(sample)), seed, apart, -math.log(TOGETHER) / depth) for seed in range(TREES)]


def _links(nodes: DataFrame, n: int, threshold: float, kind: str) -> DataFrame:
    width = nodes.groupBy(F.size("v").alias("k")).count().orderBy(F.desc("count"), "k").first().k
    # a thin slice of a hash, not a sort, so that nothing grows with the table; all of a small one
    some = nodes.where(F.size("v") == width).where(F.pmod("h", F.lit(1 << 40)) < int(min(1.0, SAMPLE / n) * (1 << 40)))
    sampled = some.select("v").limit(2 * SAMPLE).toArrow()["v"].combine_chunks()
    x = sampled.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    trees = grow(_quantised(x, width) if len(x) else np.zeros((0, width), np.int64), n, threshold)
    placed = stage(map_arrow(nodes.select("node", "weight", "v"), _place(trees, kind), "node long, weight long, length int, v binary, leaves array<long>"))
    members = placed.select("node", "weight", "length", "v", F.explode("leaves").alias("leaf"))
    sizes = placed.select("length", F.explode("leaves").alias("leaf")).groupBy("leaf", "length").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    # few leaves are too large for a task; the table of these is broadcast by Spark if its size allows
    large = stage(sizes.where("blocks > 1"))
    members = members.join(large, ["leaf", "length"], "left").withColumn("block", F.pmod(F.xxhash64("node", "leaf"), "blocks"))
    # block i meets every block j >= i: as the first side of (i, j) and as the second of (j, i)
    others = F.coalesce(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), F.array(F.lit(0).cast("long")))
    members = members.withColumn("other", F.explode(others))
    pair = F.coalesce(F.least("block", "other") * F.col("blocks") + F.greatest("block", "other"), F.lit(0))
    members = members.select("leaf", "length", pair.alias("pair"), F.coalesce((F.col("block") > F.col("other")).cast("int"), F.lit(0)).alias("side"), "node", "weight", "v")
    return stage(map_arrow(spread(members, "leaf", "length", "pair"), _compare(trees, threshold, kind), "a long, b long, n long"))
