"""Exact top-k inner-product search with a KD-tree per shard.

Shards are the leaves of a coarse KD-tree, fitted on a bounded sample (median splits of
the widest dimension); every vector is dealt to its leaf, and each leaf's box is made
tight over all its vectors. A leaf with more than SHARD vectors is dealt on by a hash.
Each shard's own tree is built once and stored as a row.

Queries visit leaves best first by their upper bound over the leaf's box, in rounds:
first the best one, then some more, then all the rest; a leaf whose bound lies under the
k-th score so far is never visited. In a round only the trees that some query still wants
are sent out, once for each BLOCK queries that want them; a task holds one tree, and
queries stream past it. Inside a tree the same is done over its nodes, down from the k-th
score that came along.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, stored, trim

SHARD = 16_384
#: Queries that a task passes by one tree.
BLOCK = 262_144
LEAF = 256
#: Leaves of the coarse tree: one for each SHARD vectors, but so many at least and at most.
FEWEST, MOST = 8, 1024
#: Components of the vectors that the coarse tree is fitted on, at most (32 MB; those with the smallest hashes).
SAMPLE = 4_000_000
#: Leaves that a query has visited after each round but the last.
VISITS = (1, 8)


class Tree:
    """Median splits; nodes in one array, children of i at left[i] and right[i]."""

    def __init__(self, x: np.ndarray, ids: np.ndarray):
        self.low, self.high, self.left, self.right, self.span = [], [], [], [], []
        order = np.arange(len(x))
        todo = [(0, len(x), -1, False)]
        while todo:
            a, z, parent, is_right = todo.pop()
            i = len(self.low)
            part = x[order[a:z]]
            low, high = part.min(0), part.max(0)
            self.low.append(low)
            self.high.append(high)
            self.left.append(-1)
            self.right.append(-1)
            self.span.append((a, z))
            if parent >= 0:
                (self.right if is_right else self.left)[parent] = i
            wide = high - low
            if z - a > LEAF and wide.max() > 0:
                m = (a + z) // 2
                order[a:z] = order[a:z][np.argpartition(part[:, wide.argmax()], m - a)]
                todo += [(m, z, i, True), (a, m, i, False)]
        self.x, self.ids = x[order], ids[order]
        self.low, self.high = np.array(self.low), np.array(self.high)

    def search(self, q: np.ndarray, own: int, k: int, least: float) -> list[tuple[int, int]]:
        """Best k of (score, id), smaller ids first among equals; nothing under ``least``."""
        bound = self.high @ np.maximum(q, 0) + self.low @ np.minimum(q, 0)
        bound = bound.tolist()
        heap = [(-bound[0], 0)]
        best: list[tuple[int, int]] = []  # (-score, id), sorted
        while heap:
            b, i = heappop(heap)
            if -b < least:
                break
            if self.left[i] >= 0:
                for c in (self.left[i], self.right[i]):
                    if bound[c] >= least:
                        heappush(heap, (-bound[c], c))
                continue
            a, z = self.span[i]
            score = self.x[a:z] @ q
            hit = np.flatnonzero(score >= least)
            hit = hit[self.ids[a:z][hit] != own]
            if len(hit):
                if len(hit) > k:  # only scores that can still be among the best k
                    kth = np.partition(score[hit], len(hit) - k)[len(hit) - k]
                    hit = hit[score[hit] >= kth]
                best = sorted(best + list(zip((-score[hit]).tolist(), self.ids[a:z][hit].tolist())))[:k]
                if len(best) == k:
                    least = max(least, -best[-1][0])
        return best


def quantised(vectors: DataFrame) -> DataFrame:
    """vec_id, floor(256 * x) of each component, and their number (dim); vectors that are null or hold null or non-finite components are left out."""
    e = F.col("embedding")
    fine = F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (
        vectors.where(e.isNotNull() & (F.size(e) > 0)).where(fine)
        .select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(e, lambda x: F.floor(x.cast("double") * 256).cast("double")).alias("v"), F.size(e).alias("dim"))
        .where("vec_id is not null")
    )


class Coarse:
    """Median splits of a sample into leaves; a vector goes right where its component is above the split."""

    def __init__(self, x: np.ndarray, leaves: int):
        self.split: list[tuple[int, float, int, int]] = []  # dimension, value, left, right; leaves are -1 - number
        self.leaves = 0
        todo = [(np.arange(len(x)), leaves, -1, False)]
        while todo:
            at, n, parent, is_right = todo.pop()
            part = x[at]
            wide = np.ptp(part, axis=0) if len(at) > 1 else np.zeros(0)
            here = -1 - self.leaves
            if n > 1 and len(wide) and wide.max() > 0:
                f = int(wide.argmax())
                value = float(np.median(part[:, f]))
                if value == part[:, f].max():
                    value = float(part[:, f][part[:, f] < value].max())
                above = part[:, f] > value
                here = len(self.split)
                self.split.append((f, value, 0, 0))
                todo += [(at[above], n // 2, here, True), (at[~above], n - n // 2, here, False)]
            else:
                self.leaves += 1
            if parent >= 0:
                f, value, left, right = self.split[parent]
                self.split[parent] = (f, value, left, here) if is_right else (f, value, here, right)

    def route(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        leaf = np.zeros(len(x), np.int32)
        todo = [(np.arange(len(x)), 0 if self.split else -1)]
        while todo:
            at, i = todo.pop()
            if i < 0:
                leaf[at] = -1 - i
            elif len(at):
                f, value, left, right = self.split[i]
                above = x[at, f] > value
                todo += [(at[~above], left), (at[above], right)]
        return leaf


def _routed(tree: Coarse, dim: int):
    """vec_id, v, dim and leaf; vectors of another length than most are all in leaf -1."""

    def run(parts):
        for p in parts:
            leaf = np.full(len(p), -1, np.int32)
            own = np.flatnonzero(p["dim"].to_numpy() == dim)
            if len(own):
                leaf[own] = tree.route(np.stack(p["v"].to_numpy()[own]))
            yield p.assign(leaf=leaf)

    return run


def _boxes(parts):
    """The box of each leaf's vectors within a batch."""
    for p in parts:
        for leaf, own in p[p["leaf"] >= 0].groupby("leaf"):
            x = np.stack(own["v"].to_numpy())
            yield pd.DataFrame({"leaf": [leaf], "low": [x.min(0)], "high": [x.max(0)]})


def _next_leaves(low: np.ndarray, high: np.ndarray, dim: int, done: int, upto: int | None):
    """Queries with each leaf of the round that can still hold one of their best k."""

    def run(parts):
        for q in parts:
            other = q[q["dim"] != dim]
            if done == 0 and len(other):
                yield other.assign(leaf=np.int32(-1))
            q = q[q["dim"] == dim]
            for i in range(0, len(q), 256):
                part = q.iloc[i : i + 256]
                x = np.stack(part["v"].to_numpy())
                bound = np.maximum(x, 0) @ high.T + np.minimum(x, 0) @ low.T
                order = np.argsort(-bound, axis=1, kind="stable")[:, done:upto]
                ok = np.take_along_axis(bound, order, 1) >= np.nan_to_num(part["least"].to_numpy(float), nan=-np.inf)[:, None]
                at, col = np.nonzero(ok)
                yield part.iloc[at].assign(leaf=order[at, col].astype(np.int32))

    return run


_CELL = ["dim", "leaf", "part"]


def _built(key: tuple, points: pd.DataFrame) -> pd.DataFrame:
    """A shard's tree as a row; components are whole numbers, kept as small as they fit."""
    tree = Tree(np.stack(points["v"].to_numpy()), points["vec_id"].to_numpy())
    if np.abs(tree.x).max(initial=0) < 2**31:
        tree.x = tree.x.astype(np.int16 if np.abs(tree.x).max(initial=0) < 2**15 else np.int32)
    out = pd.DataFrame({"dim": [key[0]], "leaf": [key[1]], "part": [key[2]], "tree": [pickle.dumps(tree, protocol=5)]})
    del tree, points
    trim()
    return out


def _searched(k: int):
    """For mapInArrow over cells in order, each with its tree first and then its queries: the best k of each query in that tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = None
        for batch in batches:
            out: list[tuple[int, int, int]] = []
            ids, least = batch.column("vec_id").to_pylist(), batch.column("least").to_pylist()
            trees, vectors = batch.column("tree"), batch.column("v")
            for row, own in enumerate(ids):
                if own is None:
                    tree = pickle.loads(trees[row].as_buffer())
                    tree.x = tree.x.astype(np.float64)
                    continue
                q = vectors[row].values.to_numpy()
                out += [(own, j, -int(s)) for s, j in tree.search(q, own, k, -np.inf if least[row] is None else least[row])]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["query_id", "vec_id", "score"])
        trim()

    return run


def _visited(going: DataFrame, trees: DataFrame, k: int, block: int) -> tuple[DataFrame, DataFrame]:
    """(query_id, vec_id, score) of the best k in each tree that a query goes to; and the trees that are sent out, a row for each time."""
    wanted = going.groupBy(*_CELL).agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    sent = trees.join(wanted, _CELL).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("blocks")
    asking = going.join(wanted, _CELL).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int")).drop("blocks")
    both = sent.withColumn("kind", F.lit(0)).unionByName(asking.withColumn("kind", F.lit(1)), allowMissingColumns=True)
    dealt = both.repartition(*_CELL, "block").sortWithinPartitions(*_CELL, "block", "kind")
    return dealt.select("tree", "vec_id", "v", "least").mapInArrow(_searched(k), "query_id long, vec_id long, score long"), sent


def _best(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query."""
    top = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("worse"), "vec_id"))), 1, k)
    return found.groupBy("query_id").agg(top.alias("top"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k highest integer inner products over all other vectors of its length.

    ``vectors`` and ``queries`` have vec_id and embedding. Ties go to the smaller
    vec_id; a query with fewer candidates gets them all; unusable vectors (null, empty,
    with null or non-finite components) take no part; rows that repeat a vec_id are
    candidates each, but not of their own id (of queries that share an id, the least
    vector asks); empty tables give an empty one; other columns are ignored. Scores must
    stay below 2**53 in size, where they are exact.
    """
    points = stored(quantised(vectors))
    asked = stored(quantised(queries).groupBy("vec_id").agg(F.min(F.struct("v", "dim")).alias("q")).select("vec_id", "q.*"))
    common = points.groupBy("dim").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").first()
    dim, n = (common.dim, common.n) if common else (0, 0)
    sample = points.where(F.col("dim") == dim).orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1, SAMPLE // max(dim, 1))).select("v").collect()
    tree = Coarse(np.array([r.v for r in sorted(sample)], float).reshape(len(sample), max(dim, 1)), min(MOST, max(FEWEST, -(-n // shard))))
    fields = "vec_id long, v array<double>, dim int, leaf int"
    routed = stored(points.mapInPandas(_routed(tree, dim), fields))
    # MOST boxes at most
    merged = routed.mapInPandas(_boxes, "leaf int, low array<double>, high array<double>").groupBy("leaf").applyInPandas(
        lambda p: pd.DataFrame({"leaf": [p["leaf"].iloc[0]], "low": [np.min(np.stack(p["low"]), 0)], "high": [np.max(np.stack(p["high"]), 0)]}), "leaf int, low array<double>, high array<double>"
    )
    low, high = np.zeros((tree.leaves, dim)), np.full((tree.leaves, dim), 0.0)
    for r in merged.collect():
        low[r.leaf], high[r.leaf] = r.low, r.high
    # a leaf is dealt on where it holds too many
    parts = stored(routed.groupBy("dim", "leaf").agg(F.ceil(F.count(F.lit(1)) / shard).cast("int").alias("parts")))
    placed = routed.join(parts, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int"))
    trees = stored(placed.select(*_CELL, "vec_id", "v").groupBy(*_CELL).applyInPandas(_built, "dim int, leaf int, part int, tree binary"))
    spent = [points, routed]
    found = None
    for done, upto in zip((0, *VISITS), (*VISITS, None)):
        if done and done >= tree.leaves:
            break
        now = asked.withColumn("least", F.lit(None).cast("double"))
        if found is not None:
            kth = _best(found, k).where(F.size("top") == k).select(F.col("query_id").alias("vec_id"), (-F.element_at("top", k)["worse"]).cast("double").alias("least"))
            now = asked.join(kth, "vec_id", "left")
        going = now.mapInPandas(_next_leaves(low, high, dim, done, upto), "vec_id long, v array<double>, dim int, least double, leaf int")
        going = going.join(parts, ["dim", "leaf"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")
        going = stored(going)
        more = stored(_visited(going, trees, k, block)[0])
        forget(going)
        found = more if found is None else found.unionByName(more)
    forget(*spent, trees, parts, asked)
    ranked = _best(found, k).select("query_id", F.posexplode("top").alias("rank", "t"))
    return ranked.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), "t.vec_id", (-F.col("t.worse")).cast("long").alias("score"))
