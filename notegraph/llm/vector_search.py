"""The k most similar vectors of every vector: a hierarchical k-means tree searched best bin first.

The tree is fitted on a bounded sample; leaves that would hold many rows are split again on the executors, each by a tree
fitted on a bounded sample of its own, so that leaves stay small as tables grow. Every row is indexed. A query keeps a
priority queue of tree nodes by distance and opens the best until it has visited its number of leaves; that number is
calibrated against brute force over all rows, on queries kept out of the sample. Rows travel once, to the bucket of
leaves they live in; a query travels on only to those further buckets that hold leaves it has to visit.
"""

from __future__ import annotations

import hashlib
import heapq
import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from notegraph.session import cut_lineage

#: Rows the tree and its calibration are fitted on, per field: the only part of the data the driver sees.
SAMPLE_ROWS = 8_192
#: Sample rows in a leaf before it is split no further, and branches of a split.
LEAF_ROWS, BRANCHES = 48, 8
#: Rows of a leaf, by the sample's share, from which on it is split on the executors, and the rows that is fitted on.
SPLIT_ROWS, SPLIT_SAMPLE = 4_096, 2_048
#: Recall that calibration aims at, and how many rows serve as its queries (about).
TARGET_RECALL, CALIBRATION_QUERIES = 0.98, 384
#: Distinct vectors in a bucket of leaves: what one task holds as a matrix (384 floats each: 25 MB).
BUCKET_ROWS = 16_384
#: Visitors that a task takes, in bucket sizes: with as many rows again, at most 113 MB of vectors.
VISITORS = 2


@dataclass
class Tree:
    """Nodes by number; ``kids[n]`` is empty for a leaf, whose place in 0..leaves-1 is ``leaf[n]``."""

    centres: np.ndarray
    kids: list[list[int]]
    leaf: list[int]
    leaves: int
    visits: int = 1

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Squared distance of unit vectors to every node's centre, up to a constant per row."""
        return (self.centres * self.centres).sum(1)[None, :] - 2.0 * (x @ self.centres.T)

    def home(self, far: np.ndarray) -> np.ndarray:
        """The leaf each row lives in: greedy descent."""
        at = np.zeros(len(far), dtype=np.int64)
        moving = np.arange(len(far)) if self.kids[0] else np.arange(0)
        while len(moving):
            for node in np.unique(at[moving]):
                rows, kids = moving[at[moving] == node], np.array(self.kids[node])
                at[rows] = kids[far[rows][:, kids].argmin(1)]
            moving = moving[[bool(self.kids[n]) for n in at[moving]]]
        return np.array(self.leaf)[at]

    def search(self, far: np.ndarray, visits: int) -> list[list[int]]:
        """Best bin first: the first ``visits`` leaves that come off the priority queue, nearest node first."""
        out = []
        for row in far.tolist():
            queue, found = [(row[0], 0)], []
            while queue and len(found) < visits:
                _, node = heapq.heappop(queue)
                while self.kids[node]:
                    kids = sorted((row[n], n) for n in self.kids[node])
                    for other in kids[1:]:
                        heapq.heappush(queue, other)
                    node = kids[0][1]
                found.append(self.leaf[node])
            out.append(found)
        return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    centres = x[rng.choice(len(x), size=k, replace=False)]
    side = np.zeros(len(x), dtype=np.int64)
    for _ in range(rounds):
        new = ((centres * centres).sum(1)[None, :] - 2.0 * (x @ centres.T)).argmin(1)
        if (new == side).all():
            break
        side = new
        for j in range(k):
            if (side == j).any():
                centres[j] = x[side == j].mean(0)
    return side


def fit_tree(x: np.ndarray, leaf_rows: int = LEAF_ROWS, branches: int = BRANCHES, seed: int = 7) -> Tree:
    """Hierarchical k-means over the rows of ``x``. No rows: a tree of one leaf around the origin."""
    rng = np.random.default_rng(seed)
    dim = x.shape[1] if x.ndim == 2 else 1
    centres: list[np.ndarray] = [x.mean(0) if len(x) else np.zeros(dim, "f4")]
    kids: list[list[int]] = [[]]
    open_nodes = [(0, np.arange(len(x)))]
    while open_nodes:
        node, rows = open_nodes.pop()
        if len(rows) <= leaf_rows:
            continue
        side = _kmeans(x[rows], min(branches, len(rows)), rng)
        groups = [rows[side == j] for j in np.unique(side)]
        if len(groups) < 2:
            continue  # nothing but copies
        for group in groups:
            kids[node].append(len(centres))
            open_nodes.append((len(centres), group))
            centres.append(x[group].mean(0))
            kids.append([])
    return numbered(np.stack(centres).astype("f4"), kids)


def numbered(centres: np.ndarray, kids: list[list[int]]) -> Tree:
    """The tree with its leaves numbered depth first, so that near leaves have near numbers."""
    leaf, n, stack = [-1] * len(kids), 0, [0]
    while stack:
        node = stack.pop()
        if kids[node]:
            stack += reversed(kids[node])
        else:
            leaf[node], n = n, n + 1
    return Tree(centres, kids, leaf, n)


def grafted(tree: Tree, grafts: dict[int, Tree]) -> Tree:
    """The tree with the leaves of ``grafts`` replaced by trees."""
    centres, kids = [tree.centres], [list(k) for k in tree.kids]
    for node, place in enumerate(tree.leaf):
        if place in grafts and grafts[place].leaves > 1:
            other = grafts[place]
            shift = len(kids) - 1  # its root is the leaf itself
            kids[node] = [k + shift for k in other.kids[0]]
            kids += [[k + shift for k in ks] for ks in other.kids[1:]]
            centres.append(other.centres[1:])
    return numbered(np.concatenate(centres), kids)


def _unit(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a list column that are usable vectors, and these as unit float32 vectors.

    Null, other length, a null, NaN or infinite element, or zero norm: unusable.
    """
    sizes = np.diff(column.offsets.to_numpy())
    valid = np.asarray(column.is_valid()) & (sizes == dim)
    rows = np.nonzero(valid)[0]
    if not len(rows):
        return rows, np.zeros((0, dim), "f4")
    flat = column.take(pa.array(rows)).flatten()
    x = flat.cast(pa.float32()).to_numpy(zero_copy_only=False).reshape(-1, dim)
    with np.errstate(invalid="ignore", over="ignore"):
        norm = np.sqrt((x.astype("f8") ** 2).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return rows[good], (x[good] / norm[good, None]).astype("f4")


def _share(key: str, salt: str, share: float):
    """Rows whose hash falls in a share of them; other salts are independent."""
    return F.pmod(F.xxhash64(F.col(key), F.lit(salt)), F.lit(1_000_000)) < int(min(1.0, share) * 1_000_000) + 1


def _sample(df: DataFrame, field: str, dim: int) -> np.ndarray:
    """The usable distinct vectors of a field of a bounded frame."""
    table = df.where(F.size(field) == dim).select(field).toArrow().column(0).combine_chunks()
    if isinstance(table, pa.ChunkedArray):
        table = pa.concat_arrays(table.chunks) if table.num_chunks else pa.array([], pa.list_(pa.float32()))
    return np.unique(_unit(table, dim)[1], axis=0)


def split_leaves(base: DataFrame, fields: list[str], trees: list[Tree], sizes: list[dict[int, float]], dim: int, split_rows: int, split_sample: int) -> list[Tree]:
    """The trees with leaves of more than ``split_rows`` rows split again. ``sizes`` holds the rows of each leaf as the
    sample has it. Each such leaf is fitted in a task on about ``split_sample`` of its rows; only its centres come back,
    so their size is bounded by the sample's leaves."""
    rates = [{leaf: min(1.0, split_sample / n) for leaf, n in size.items() if n > split_rows} for size in sizes]
    if not any(rates):
        return trees
    shared = base.sparkSession.sparkContext.broadcast((trees, rates))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, rates = shared.value
        for batch in batches:
            draw = batch.column(batch.num_columns - 1).to_numpy()
            for f, (tree, rate) in enumerate(zip(trees, rates)):
                for start in range(0, batch.num_rows if rate else 0, 2048):
                    rows, x = _unit(batch.column(f + 1).slice(start, 2048), dim)
                    if not len(rows):
                        continue
                    home = tree.home(tree.distances(x))
                    part = draw[start : start + 2048][rows]
                    keep = [i for i in range(len(rows)) if part[i] < rate.get(int(home[i]), 0.0)]
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(keep), pa.int32()), pa.array(home[keep], pa.int32()), pa.array([x[i].tobytes() for i in keep], pa.binary())], ["f", "leaf", "v"])

    def fit(pdf):
        import pandas as pd

        x = np.unique(np.frombuffer(b"".join(pdf["v"]), "f4").reshape(len(pdf), dim), axis=0)
        return pd.DataFrame({"f": [pdf["f"].iloc[0]], "leaf": [pdf["leaf"].iloc[0]], "tree": [pickle.dumps(fit_tree(x, max(LEAF_ROWS // 2, 1) if split_sample > LEAF_ROWS else 2))]})

    drawn = base.withColumn("_draw", F.pmod(F.xxhash64("id", F.lit("split")), F.lit(1_000_000)) / F.lit(1e6))
    made = drawn.mapInArrow(pick, "f int, leaf int, v binary").groupBy("f", "leaf").applyInPandas(fit, "f int, leaf int, tree binary").collect()
    grafts: list[dict[int, Tree]] = [{} for _ in fields]
    for row in made:
        grafts[row["f"]][row["leaf"]] = pickle.loads(row["tree"])  # noqa: S301 - written by fit above
    return [grafted(tree, g) if g else tree for tree, g in zip(trees, grafts)]


def calibrate(base: DataFrame, fields: list[str], trees: list[Tree], asked: list[np.ndarray], k: int, dim: int, target: float) -> list[int]:
    """Per field, the leaf visits at which the queries ``asked`` find ``target`` of their true ``k`` nearest among all
    rows, which every partition looks for by brute force, a block at a time; copies of a query are not its neighbours."""
    shared = base.sparkSession.sparkContext.broadcast((trees, asked))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees, asked = shared.value
        for batch in batches:
            for f, (tree, q) in enumerate(zip(trees, asked)):
                for start in range(0, batch.num_rows if len(q) else 0, 4096):
                    rows, x = _unit(batch.column(f + 1).slice(start, 4096), dim)
                    if not len(rows):
                        continue
                    sims = q @ x.T
                    sims[sims > 1 - 1e-6] = -2
                    top = np.argpartition(-sims, min(k, len(rows)) - 1, axis=1)[:, :k]
                    near = np.take_along_axis(sims, top, 1).ravel()
                    home, which = tree.home(tree.distances(x))[top].ravel(), np.repeat(np.arange(len(q)), top.shape[1])
                    kept = near > -1.5
                    yield pa.RecordBatch.from_arrays([pa.array([f] * int(kept.sum()), pa.int32()), pa.array(which[kept], pa.int32()), pa.array(home[kept], pa.int32()), pa.array(near[kept].astype("f8"))], ["f", "q", "leaf", "cosine"])

    best = W.partitionBy("f", "q").orderBy(F.desc("cosine"))
    true = base.mapInArrow(run, "f int, q int, leaf int, cosine double").withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k)
    need: list[list[int]] = [[] for _ in fields]
    places = [[{leaf: i for i, leaf in enumerate(order)} for order in (tree.search(tree.distances(q), tree.leaves) if len(q) else [])] for tree, q in zip(trees, asked)]
    for f, q, leaf in true.select("f", "q", "leaf").collect():  # k a query
        need[f].append(places[f][q][leaf])
    return [int(np.sort(n)[min(len(n) - 1, int(np.ceil(target * len(n))))]) + 1 if n else 1 for n in need]


@dataclass
class _Buckets:
    """Which buckets hold a leaf, and into how many chunks the queries of a bucket are cut.

    Neighbouring leaves share a bucket up to ``rows`` rows. A leaf with more is spread over several, all of which its
    visitors go to; a bucket with more than ``VISITORS`` times ``rows`` visits is repeated, each chunk answering a part of
    them. So no task holds more than ``VISITORS + 1`` times ``rows`` vectors, but for chance in the parts.
    """

    shards: dict[tuple[int, int], list[int]]
    chunks: dict[int, int]

    @classmethod
    def of(cls, leaves: list[int], filled: dict, visited: dict, rows: int) -> _Buckets:
        shards: dict[tuple[int, int], list[int]] = {}
        asked: dict[int, int] = {}
        number = 0
        for f, n in enumerate(leaves):
            room = 0
            for leaf in range(n):
                here = filled.get((f, leaf), 0)
                if room and room + here > rows:
                    number, room = number + 1, 0
                many = max(1, -(-here // rows))
                shards[f, leaf] = list(range(number, number + many))
                for shard in shards[f, leaf]:
                    asked[shard] = asked.get(shard, 0) + visited.get((f, leaf), 0)
                number += many - 1
                room += here if many == 1 else rows
            number += 1
        return cls(shards, {b: max(1, -(-n // (VISITORS * rows))) for b, n in asked.items()})


def nearest(df: DataFrame, key: str, fields: list[str], k: int = 5, dim: int = 384, sample_rows: int = SAMPLE_ROWS, target: float = TARGET_RECALL, bucket_rows: int = BUCKET_ROWS, split_rows: int = SPLIT_ROWS, split_sample: int = SPLIT_SAMPLE) -> DataFrame:
    """``(vec_field, id, neighbour, cosine)``: for each row and field its ``k`` most similar other rows.

    ``key`` must be a unique integer. Vectors that are null, of another length than ``dim``, zero or with NaN, infinite
    or null elements neither have nor are neighbours. Fewer than ``k`` other vectors: all of them. Identical vectors
    have cosine 1 to each other; of more than ``k`` copies any ``k`` serve, so a third of all rows being one vector
    costs no more than one vector: each partition sends ``k + 1`` copies on and links the rest to these on the spot.
    Extra columns are ignored; an empty table gives an empty result.
    """
    spark = df.sparkSession
    base = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), *fields)
    total = base.count()
    trees: list[Tree] = []
    sizes: list[dict[int, float]] = []
    asked: list[np.ndarray] = []
    for field in fields:
        held_out = _share("id", "asked", CALIBRATION_QUERIES / max(1, total))
        asked.append(_sample(base.where(held_out), field, dim))
        x = _sample(base.where(~held_out & _share("id", "sample", sample_rows / max(1, total))), field, dim)
        trees.append(fit_tree(x))
        share = np.bincount(trees[-1].home(trees[-1].distances(x)), minlength=trees[-1].leaves) / max(1, len(x)) if len(x) else np.zeros(0)
        sizes.append({leaf: float(n * total) for leaf, n in enumerate(share)})
    trees = split_leaves(base, fields, trees, sizes, dim, split_rows, split_sample)
    for tree, visits in zip(trees, calibrate(base, fields, trees, asked, k, dim, target)):
        tree.visits = visits
    shared = spark.sparkContext.broadcast(trees)
    keep = k + 1

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[tuple[int, bytes], list[int]] = {}
        for batch in batches:
            ids = batch.column(0).to_numpy()
            for f, tree in enumerate(shared.value):
                for start in range(0, batch.num_rows, 2048):
                    rows, x = _unit(batch.column(f + 1).slice(start, 2048), dim)
                    if not len(rows):
                        continue
                    mine, send, links = ids[start : start + 2048][rows], [], []
                    for i, vector in enumerate(x):
                        copies = seen.setdefault((f, hashlib.blake2b(vector.tobytes(), digest_size=12).digest()), [])
                        if len(copies) < keep:
                            copies.append(int(mine[i]))
                            send.append(i)
                        else:
                            links.append((int(mine[i]), copies[:k]))
                    if links:
                        yield _placed(f, [-1] * len(links), [a for a, _ in links], [None] * len(links), [b for _, b in links])
                    if send:
                        x = x[send]
                        far = tree.distances(x)
                        short = np.round(x * (32767.0 / np.abs(x).max(1, keepdims=True))).astype("i2")
                        yield _placed(f, tree.home(far).tolist(), mine[send].tolist(), [v.tobytes() for v in short], tree.search(far, tree.visits))

    def _placed(f: int, leaf: list, ids: list, vectors: list, visits: list) -> pa.RecordBatch:
        arrays = [pa.array([f] * len(ids), pa.int32()), pa.array(leaf, pa.int32()), pa.array(ids, pa.int64()), pa.array(vectors, pa.binary()), pa.array(visits, pa.list_(pa.int64()))]
        return pa.RecordBatch.from_arrays(arrays, ["f", "leaf", "id", "v", "visits"])

    placed = cut_lineage(base.mapInArrow(place, "f int, leaf int, id bigint, v binary, visits array<bigint>"))
    # One row a leaf, so bounded by the sample: rows that live in it, and queries that visit it.
    filled = {(r["f"], r["leaf"]): r["count"] for r in placed.where("leaf >= 0").groupBy("f", "leaf").count().collect()}
    visited = placed.where("leaf >= 0").select("f", F.explode("visits").alias("leaf")).groupBy("f", "leaf").count()
    plan = _Buckets.of([t.leaves for t in trees], filled, {(r["f"], r["leaf"]): r["count"] for r in visited.collect()}, bucket_rows)
    where = spark.sparkContext.broadcast(plan)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = where.value
        for batch in batches:
            pick, bucket, chunk, home, opened = [], [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in (0, 1, 2, 4)))
            for i, (f, leaf, own, go) in enumerate(rows):
                lives = plan.shards[f, leaf][own % len(plan.shards[f, leaf])]
                by: dict[int, list[int]] = {lives: []}
                for n in go:
                    for shard in plan.shards[f, n]:
                        by.setdefault(shard, []).append(n)
                for to, leaves in by.items():
                    asks = own % plan.chunks[to]
                    for c in range(plan.chunks[to]) if to == lives else (asks,):
                        pick.append(i)
                        bucket.append(to)
                        chunk.append(c)
                        home.append(leaf if to == lives else -1)
                        opened.append(leaves if c == asks else [])
            taken = batch.take(pa.array(pick, pa.int64()))
            arrays = [taken.column(0), pa.array(bucket, pa.int32()), pa.array(chunk, pa.int32()), pa.array(home, pa.int32()), taken.column(2), taken.column(3), pa.array(opened, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(arrays, ["f", "bucket", "chunk", "leaf", "id", "v", "opened"])

    def scan(pdf):
        import pandas as pd

        ids, leaf = pdf["id"].to_numpy(), pdf["leaf"].to_numpy()
        x = np.frombuffer(b"".join(pdf["v"]), "i2").reshape(len(pdf), dim).astype("f4")
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        reached: dict[int, list[int]] = {}
        for i, leaves in enumerate(pdf["opened"]):
            for n in leaves:
                reached.setdefault(n, []).append(i)
        best_id = np.full((len(pdf), k), -1, dtype=np.int64)
        best = np.full((len(pdf), k), -2.0, dtype="f4")
        for n, queries in reached.items():
            data = np.nonzero(leaf == n)[0]
            if not len(data):
                continue
            for block in range(0, len(queries), 1024):
                q = np.array(queries[block : block + 1024])
                for part in range(0, len(data), 8192):
                    d = data[part : part + 8192]
                    sims = x[q] @ x[d].T
                    sims[ids[q][:, None] == ids[d][None, :]] = -2
                    m = min(k, len(d))
                    top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
                    all_s = np.concatenate([best[q], np.take_along_axis(sims, top, 1)], axis=1)
                    all_i = np.concatenate([best_id[q], ids[d][top]], axis=1)
                    order = np.lexsort((all_i, -all_s), axis=1)[:, :k]
                    best[q], best_id[q] = np.take_along_axis(all_s, order, 1), np.take_along_axis(all_i, order, 1)
        row, col = np.nonzero(best > -1.5)
        return pd.DataFrame({"f": pdf["f"].iloc[0], "id": ids[row], "neighbour": best_id[row, col], "cosine": best[row, col].astype("f8")})

    out = "f int, id bigint, neighbour bigint, cosine double"
    routed = placed.where("leaf >= 0").mapInArrow(route, "f int, bucket int, chunk int, leaf int, id bigint, v binary, opened array<int>")
    found = routed.groupBy("f", "bucket", "chunk").applyInPandas(scan, out)
    copies = placed.where("leaf < 0").select("f", "id", F.explode("visits").alias("neighbour"), F.lit(1.0).alias("cosine"))
    best = W.partitionBy("f", "id").orderBy(F.desc("cosine"), F.asc("neighbour"))
    top = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).drop("_n").unionByName(copies)
    names = F.element_at(F.array(*[F.lit(f) for f in fields]), F.col("f") + 1)
    return top.select(names.alias("vec_field"), "id", "neighbour", "cosine")


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """Distinct pairs, lesser id first, where at least one is among the nearest of the other."""
    a, b = F.least("id", "neighbour"), F.greatest("id", "neighbour")
    return found.select("vec_field", a.alias("note_id_a"), b.alias("note_id_b")).distinct()


def exact_neighbours(df: DataFrame, key: str, field: str, every: int = 100, k: int = 5, dim: int = 384) -> DataFrame:
    """Brute force for the stated query set, ids divisible by ``every``, against all rows, a block of rows at a time.

    Each partition scores its rows against the query set and keeps ``k`` a query; the best of these are taken. The
    query set is broadcast, so ``every`` bounds its size.
    """
    base = df.where(F.col(key).isNotNull() & (F.size(field) == dim)).select(F.col(key).cast("long").alias("id"), field)
    asked = base.where(F.col("id") % every == 0).toArrow().combine_chunks()
    column = asked.column(1).combine_chunks() if asked.num_rows else pa.array([], pa.list_(pa.float32()))
    rows, q = _unit(column, dim)
    shared = df.sparkSession.sparkContext.broadcast((asked.column(0).to_numpy()[rows] if asked.num_rows else np.zeros(0, "i8"), q))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, q = shared.value
        for batch in batches:
            kept, x = _unit(batch.column(1), dim)
            if not len(kept) or not len(q):
                continue
            ids = batch.column(0).to_numpy()[kept]
            sims = q @ x.T
            sims[own[:, None] == ids[None, :]] = -2
            m = min(k, len(ids))
            top = np.argpartition(-sims, m - 1, axis=1)[:, :m]
            s = np.take_along_axis(sims, top, 1)
            row, col = np.nonzero(s > -1.5)
            yield pa.RecordBatch.from_arrays([pa.array(own[row]), pa.array(ids[top[row, col]]), pa.array(s[row, col].astype("f8"))], ["id", "neighbour", "cosine"])

    best = W.partitionBy("id").orderBy(F.desc("cosine"), F.asc("neighbour"))
    scored = base.mapInArrow(run, "id bigint, neighbour bigint, cosine double")
    return scored.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k).select(F.lit(field).alias("vec_field"), "id", "neighbour", "cosine")
